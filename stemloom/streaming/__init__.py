"""Folding of alignments as they arrive."""
