"""Spark-native harmonisation of sensor time series, with a corpus toolkit in ``sensorloom.llm``."""
