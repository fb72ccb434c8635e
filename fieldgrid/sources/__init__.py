"""Inputs: the domain tables derived from the driver's tables, and readers of candidate, boundary, forecast and elevation files."""
