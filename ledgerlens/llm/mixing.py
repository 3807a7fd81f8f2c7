"""Mixing sources to target weights by systematic sampling.

A source's expected copies of each of its documents are its target over its size.  Within a source the
documents stand in one order, the expected copies are summed along it, one random offset is
added, and a document is emitted once for each integer that its part of the sum crosses.  The order is by size, so
that neighbours are alike and the words taken stay within about one document of the target; the
offset is a checksum of seed and source, so reruns agree.

Targets: the sources share ``share`` times all words by weight; a target stops at ``most`` times its source's
size, and what is over goes to the others by weight, until none is above.  With sources in
the order of (most * size / weight) this level has a closed form over prefix sums of the table of sources.

A document's place comes from one range partitioning by (source, size, doc_id) - a hot source or a hot
size is cut by doc_id - and from the row counts of each (partition, source): at most as many
rows as partitions and sources together.  No window holds a source's documents.

Null text has size 0.  A null source is a source and stands last.  Repeated rows each have a place of their
own.  Sources of size 0 have target 0.  An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, null_safe, stage

SHARE, MOST, WEIGHTS, SEED = 1.5, 2.0, (3, 1, 2), "mix"


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(per_source: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple = WEIGHTS, seed: str = SEED) -> DataFrame:
    """source, source_size, target, rate, offset.  ``per_source`` has a row for each source, so these windows
    over the whole of it see as many rows as there are sources."""
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    t = (per_source.withColumn("k", F.row_number().over(rank) - 1)
         .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int")))
         .withColumn("cap", F.col("source_size") * F.lit(float(most)))
         .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share))))
    up = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    t = (t.withColumn("capped_before", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("weight_from", F.sum("weight").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
         .withColumn("level", (F.col("total") - F.col("capped_before")) / F.col("weight_from"))
         .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
         .withColumn("level", F.coalesce(F.max(F.when(F.col("fits") & (F.col("level") >= 0), F.col("level"))).over(every), F.max(F.col("cap") / F.col("weight")).over(every))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    target = F.least(F.col("cap"), F.col("level") * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"), draw.alias("offset"))


def plan(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row."""
    order = [F.col("source").asc_nulls_last(), F.col("size"), F.col("doc_id").asc_nulls_last()]
    placed = stage(sizes(docs).repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "mix")
    runs = placed.groupBy("part", "source").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    runs = stage(runs, "mix-runs")
    goal = targets(runs.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("skip", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).select("part", "source", "skip")
    info = starts.join(goal, null_safe(starts, goal, "source")).select("part", starts["source"].alias("source"), "skip", "source_size", "target", "rate", "offset")
    rows = placed.join(info, (placed["part"] == info["part"]) & placed["source"].eqNullSafe(info["source"]))
    rank = F.col("at") + F.col("skip")
    reach = lambda r: F.floor(r.cast("double") * F.col("rate") + F.col("offset"))
    return rows.select("doc_id", placed["source"].alias("source"), "size", "source_size", "target", (reach(rank + 1) - reach(rank)).alias("copies"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, each as often as the plan says, with their columns."""
    key = Window.partitionBy("__id", "__source", "__size")
    planned = (plan(docs, **how).select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies"))
               .withColumn("__nth", F.row_number().over(key.orderBy("__copies"))).where("__copies > 0"))
    rows = docs.withColumns({"__i": F.col("doc_id").cast("long"), "__s": F.col("source").cast("string"),
                             "__z": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")})
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy("__i", "__s", "__z").orderBy(F.xxhash64(F.coalesce("text", F.lit(""))))))
    both = rows.join(planned, rows["__i"].eqNullSafe(planned["__id"]) & rows["__s"].eqNullSafe(planned["__source"]) & (rows["__z"] == planned["__size"]) & (rows["__n"] == planned["__nth"]))
    return (both.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
