"""A PySpark-native engine for label-dimensioned time series."""
