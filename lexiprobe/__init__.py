"""PySpark-native analytics for probing how identifier properties are encoded in program corpora."""
