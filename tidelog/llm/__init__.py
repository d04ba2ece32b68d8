"""Corpus operators for training-data work. Nothing else in the library imports this subpackage."""
