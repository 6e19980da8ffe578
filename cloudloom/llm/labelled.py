"""Bounded labelled samples for the classifiers, and the fold rule that they share."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 1 modulo 3. Null ids count as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, graded: bool = False) -> list[tuple[int, str]]:
    """(label, text) of at most ``per_class`` labelled documents of each value 0 and 1 (graded: 0, 1, 2, ...), the same on every run.

    Documents are drawn by a hash of doc_id among those that are not held out, and their texts are whole. Of rows that share a doc_id the
    smallest text is the document's. Only learning is sampled.
    """
    fits = (F.col(label) >= 0) & (F.col(label) % 1 == 0) if graded else F.col(label).isin(0, 1)
    known = labels.where(fits & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    values = sorted(r.label for r in known.select("label").distinct().collect()) if graded else [0, 1]
    if not values:
        return []
    drawn = [known.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in values]
    few = F.broadcast(functools.reduce(DataFrame.union, drawn))  # per_class rows of each value at most
    rows = docs.select("doc_id", "text").where("text is not null").join(few, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r.label, r.text) for r in sorted(rows, key=lambda r: r.doc_id)]
