"""A bounded sample of labelled documents to fit a classifier on."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, short_batches, stage


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """Staged rows (doc_id, text, y, place) of at most ``per_class`` label rows a class, chosen by a hash of the id, whole texts; and how
    many label rows each class has.  Rows that are held out, or whose label is null, are not looked at.  place is a second
    hash, to shuffle or split by.  The ids are few by that bound, so they are broadcast and no text is shuffled."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = stage(own.distinct(), "labels")
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = first[0].union(first[1])
    picked = short_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return stage(picked.withColumn("place", F.xxhash64(F.lit("place"), "doc_id")), "labelled"), share
