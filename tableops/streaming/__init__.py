"""The merge as a stream."""
