"""Readers, sinks and the dataset registry."""
