"""Raster encoding and binary-data processing on DataFrames."""
