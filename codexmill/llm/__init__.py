"""Operators for training-data text."""
