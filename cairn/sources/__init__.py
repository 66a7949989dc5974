"""Sources: each has ``read(spark, params) -> DataFrame`` (SRC-0)."""
