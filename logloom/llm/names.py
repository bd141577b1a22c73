"""Names of columns that operators carry along with their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that begin with an underscore renamed, and the way back.

    Operators that carry all columns along name theirs so.
    """
    mark = uuid.uuid4().hex
    taken = {c: f"own_{mark}_{i}" for i, c in enumerate(docs.columns) if c.startswith("_")}
    return docs.withColumnsRenamed(taken), {new: c for c, new in taken.items()}
