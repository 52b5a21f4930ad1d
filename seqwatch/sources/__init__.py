"""Readers: FASTA text, case line lists, region boundaries, landed search responses."""
