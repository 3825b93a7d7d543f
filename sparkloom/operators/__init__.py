"""Operators over DataFrames: tensors, features, windows, metrics, signals, models."""
