"""The registry of queries over the shared tables."""
