"""Scalar operators: ``op(*columns, **parameters) -> Column``."""
