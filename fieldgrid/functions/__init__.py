"""Column functions: each takes and returns Columns, so plans stay in generated code."""
