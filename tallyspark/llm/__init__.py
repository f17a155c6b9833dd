"""Corpus operators for language-model training data. Nothing else in the package imports this folder."""
