"""Table readers and file sources."""
