"""presq: a PySpark-native engine for binary presence/absence matrices."""

from __future__ import annotations

__version__ = "0.1.0"
