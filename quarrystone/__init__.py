"""A PySpark-native analytics engine for geospatial, 3D and building-model data."""
