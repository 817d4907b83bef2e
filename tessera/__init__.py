"""Raster, asset-metadata and text-corpus analytics on PySpark DataFrames."""
