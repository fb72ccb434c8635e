"""fieldgrid: Spark-native analytics of objects detected in georeferenced aerial imagery."""
