"""Operators for preparing language-model training data, and the pipeline stages built from them."""
