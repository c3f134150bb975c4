"""A PySpark-native engine for gridded (raster) analytics: bands are tables keyed by pixel row and column."""
