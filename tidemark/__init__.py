"""tidemark: time-series research and validation operators for PySpark."""
