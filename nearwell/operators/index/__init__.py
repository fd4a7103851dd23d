"""Vector indexes."""

from .base import IndexParams, SearchParams, VectorIndex, create, load

__all__ = ["IndexParams", "SearchParams", "VectorIndex", "create", "load"]
