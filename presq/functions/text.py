"""String normalisation shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(col: Column | str) -> Column:
    """Identifier form: spaces trimmed at both ends, upper-cased; null stays null."""
    col = F.col(col) if isinstance(col, str) else col
    return F.upper(F.trim(col))
