"""Time-series regime analytics on Spark: long tables of many series, declared as DataFrame plans."""
