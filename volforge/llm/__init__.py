"""Operators for preparing training text and embeddings at corpus scale."""
