"""Operators: ``(DataFrame, spec, ...) -> DataFrame``, built-in expressions only."""
