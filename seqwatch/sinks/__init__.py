"""Writers: FASTA text and partitioned tables."""
