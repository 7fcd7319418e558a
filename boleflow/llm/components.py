"""Connected components of an edge table: the library's own."""

from ..operators.components import components

__all__ = ["components"]
