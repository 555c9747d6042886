"""Operators for training data; nothing else of the package imports this one."""
