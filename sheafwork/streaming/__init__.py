"""Structured Streaming: windows over events, session state, incremental file indexing."""
