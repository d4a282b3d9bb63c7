"""Operators for text and training data; nothing else in the library imports this subpackage."""
