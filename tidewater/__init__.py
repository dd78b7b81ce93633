"""Tidewater: curation of large collections of timestamped recordings, on Spark."""
