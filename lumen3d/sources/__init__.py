"""Readers and writers of rasters and point clouds; files are read by Spark, wherever they are, and decoded in its tasks."""
