"""The library's operators as named queries over whole tables."""

from . import chunks, files, knowledge, labels, searching  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
