"""Operators for training corpora: documents, web pages and their labels."""
