"""tidewatt: Spark-native analytics for sensor and power-station time series."""
