"""Table operators: ``op(df, ..., *, columns and parameters) -> DataFrame``."""
