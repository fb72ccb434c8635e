"""Writers of export files."""
