"""Profiling, preparation, split, feature, metric and model operators."""
