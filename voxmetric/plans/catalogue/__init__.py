"""All catalogue entries."""

from . import (  # noqa: F401
    files, ingest, mapping, nps, ordered, quality, surveys, text, themes, trends,
)
from .base import ENTRIES, Tables

__all__ = ["ENTRIES", "Tables"]
