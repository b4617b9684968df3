"""Mixing sources to target weights by weighted sampling without replacement (operator 12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.support import ordered_offsets, staged

# A document is taken at most so many times.
MOST_EPOCHS = 3
SOURCE_WEIGHTS = (5, 2, 1)
# Quality weights of the query: labelled good, labelled bad, and not labelled.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def source_targets(sizes: DataFrame, weights: Sequence[int] = SOURCE_WEIGHTS, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Add ``target`` to ``sizes`` (source, source_size): shares of the total size by weight.

    Sources in order of code points, null last, have the weights in turn. No target is above
    ``epochs`` times its source; what is above goes to the others by weight. That is one water level:
    a source is full if at the level that fills it the others do not yet need the total. Two sorted
    passes over the sources with running totals find the level, on any number of partitions.
    """
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    named = sizes.withColumn("_none", F.col("source").isNull())
    ranked = ordered_offsets(named, ["_none", "source"], {"_rank": F.lit(1).cast("long")})
    weighed = ranked.withColumn("_w", turn).withColumn("_most", F.col("source_size") * epochs).withColumn("_level", F.col("_most") / F.col("_w"))
    totals = weighed.agg(F.sum("source_size").alias("size"), F.sum("_w").alias("w")).first()
    size, weight = totals["size"] or 0, totals["w"] or 1
    filled = ordered_offsets(weighed, ["_level", "_none", "source"], {"_most_before": F.col("_most"), "_w_before": F.col("_w")})
    # What all sources hold at the level that fills this one, both sides times its weight to stay whole.
    wide = "decimal(19,0)"
    level_total = F.col("_most_before").cast(wide) * F.col("_w").cast(wide) + F.col("_most").cast(wide) * (weight - F.col("_w_before")).cast(wide)
    full = staged(filled.withColumn("_full", level_total <= F.lit(size).cast(wide) * F.col("_w").cast(wide)))
    rest = full.agg(
        (F.lit(size) - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_most"))), F.lit(0))).alias("size"),
        F.coalesce(F.sum(F.when(~F.col("_full"), F.col("_w"))), F.lit(1)).alias("w"),
    ).first()
    share = (F.col("_w") * rest["size"]).cast("double") / F.lit(float(rest["w"]))
    return full.select("source", "source_size", F.when(F.col("_full"), F.col("_most").cast("double")).otherwise(share).alias("target"))


def sampling_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """Efraimidis and Spirakis: an exponential variable with the weight as its rate.

    The first n by this key are n draws without replacement in proportion to the weights. It is a
    function of the id and the seed alone. A weight that is not positive comes last.
    """
    digits = F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(seed))), 1, 13)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.when(weight > 0, -F.log(uniform) / weight).otherwise(F.lit(float("inf")))


def mixed(docs: DataFrame, quality: DataFrame | None = None, weights: Sequence[int] = SOURCE_WEIGHTS, epochs: int = MOST_EPOCHS, seed: str = "/1") -> DataFrame:
    """How many words of every document a mix of the sources takes: one row for each row of ``docs``.

    Size is the number of words. A source with a target of e whole times its size and a rest takes
    all its documents e times; then its documents in order of their sampling keys, as long as half of
    a document still fits into the rest. So a source misses its target by half a document at most.
    ``quality`` (doc_id, weight) gives the weights of the keys; a document without one, or with a null
    weight, has UNKNOWN. Of several weights of an id the largest holds.

    A null or empty text has size 0 and takes 0. Null is a source of its own, the last one. Repeated
    rows are documents each; rows of one id follow each other by text. A null id is like the id ''.
    An empty table gives no rows. Only doc_id, source and text are read.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("_text"))
    if quality is None:
        rows = rows.withColumn("_weight", F.lit(UNKNOWN))
    else:
        best = quality.groupBy(F.col("doc_id").alias("_id")).agg(F.max("weight").cast("double").alias("_weight"))
        rows = rows.join(best, rows["doc_id"] == best["_id"], "left").drop("_id").withColumn("_weight", F.coalesce("_weight", F.lit(UNKNOWN)))
    rows = staged(rows.withColumn("_key", sampling_key(F.col("doc_id"), F.col("_weight"), seed)).withColumn("_none", F.col("source").isNull()).drop("_weight"))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, epochs)
    queued = ordered_offsets(rows, ["_none", "source", "_key", "doc_id", "_text"], {"_before": F.col("size")})
    starts = queued.groupBy("source").agg(F.min("_before").alias("_start"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0).cast("long"))
    plan = staged(
        targets.join(starts.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_epochs", whole)
        .select(F.col("source").alias("_of"), "source_size", "target", "_start", "_epochs", (F.col("target") - F.col("_epochs") * F.col("source_size")).alias("_rest"))
    )
    chosen = F.col("_before") - F.col("_start") + F.col("size") / 2 <= F.col("_rest")
    taken = F.col("size") * (F.col("_epochs") + F.when(chosen & (F.col("_rest") > 0), 1).otherwise(0))
    # Both sides come from shuffles that Spark can split, so a hot source is many tasks.
    return queued.join(plan, F.col("source").eqNullSafe(F.col("_of"))).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def label_weights(labels: DataFrame) -> DataFrame:
    """Quality weights of labelled documents: doc_id, weight."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, GOOD).when(F.col("quality") == 0, BAD).otherwise(UNKNOWN).alias("weight"))
