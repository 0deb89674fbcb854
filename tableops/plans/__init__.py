"""Composite jobs: replication, exports, SQL models."""
