"""Relations that a model wrote as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lodemap.schemas import TRIPLES


def parse_relations(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Recorded JSON lists of {subject, relation, object} as rows, and the rejects.

    A row is rejected when its text is not a JSON list of objects, or when an entry lacks a
    field. Both results keep the other columns of `df`.
    """
    keys = [c for c in df.columns if c != col]
    listed = F.ltrim(F.col(col)).startswith("[")  # Spark would take a bare object for a list of one
    whole = F.when(listed, F.from_json(col, TRIPLES, {"mode": "PERMISSIVE"}))
    parsed = df.withColumn("triples", whole)
    complete = ~F.exists(
        "triples", lambda t: t.isNull() | t["subject"].isNull() | t["relation"].isNull() | t["object"].isNull()
    )
    ok = F.coalesce(F.col("triples").isNotNull() & complete, F.lit(False))
    rows = parsed.where(ok).select(*keys, F.inline("triples"))
    return rows, parsed.where(~ok).select(*keys, col)
