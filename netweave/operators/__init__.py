"""Batch operators: DataFrame in, DataFrame (or small fitted state) out."""
