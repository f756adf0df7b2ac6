"""Readers of alignments, variants, regions, genes, matrices and sequences."""
