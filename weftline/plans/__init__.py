"""Physical plans for encoding a corpus."""
