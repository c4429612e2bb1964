"""Operators over texts and source files for training data; nothing outside this package imports it."""
