"""A DataFrame-first engine for point clouds and hyperspectral rasters on Spark."""
