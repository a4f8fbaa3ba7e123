"""Readers and writers: alignments, structures, probabilities, connection tables, run settings; all as tables."""
