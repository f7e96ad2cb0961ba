"""Readers: vaults of notes, configuration, source-code symbols, retrieval benchmarks, version control."""
