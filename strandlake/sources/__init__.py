"""Readers for alignments, annotations, sequences and earlier results."""
