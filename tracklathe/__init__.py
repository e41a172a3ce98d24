"""tracklathe: a PySpark-native engine for sensor time series, trajectory evaluation and data hygiene at scale."""
