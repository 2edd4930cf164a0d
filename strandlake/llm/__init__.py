"""Operators for text corpora and embeddings. Nothing else in the package imports them."""
