"""Column expressions: names and times, hashes, intervals, vectors."""
