"""Operators of a training-data pipeline over ``documents``, ``embeddings``, ``labels`` and ``benchmark``."""
