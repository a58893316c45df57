"""Detection over streams of sequences."""
