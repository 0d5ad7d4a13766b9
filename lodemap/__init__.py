"""Concept maps from recorded model output and embedding vectors, on Spark."""

from lodemap.session import local_session

__all__ = ["local_session"]
