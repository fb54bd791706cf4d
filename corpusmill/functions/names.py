"""Names of columns that operators add for a while."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(name: str, *frames: DataFrame) -> str:
    """`name`, or a longer one that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name
