"""Relational, spatial and raster operators: DataFrame in, DataFrame out."""
