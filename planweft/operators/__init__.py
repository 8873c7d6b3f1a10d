"""Plan nodes as DataFrame operations."""
