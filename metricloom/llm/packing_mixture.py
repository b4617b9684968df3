"""Mixture-controlled packing by deficit round-robin (operator 9)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.support import frugal, ordered_offsets, staged
from metricloom.llm.tokens import encoded

# Parts into which the rows of a source are dealt where they meet its quantum.
PARTS = 64

_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids binary"


def mixture_order(documents: DataFrame, window: int, piece: int, weights: DataFrame | None = None) -> DataFrame:
    """Places of all pieces: row, start, length, sequence_id, offset and source.

    ``documents`` has row, source and n_tokens. Each source is a queue of pieces of at most
    ``piece`` tokens; in each round it gains ``window`` times its share, and sends pieces while its
    deficit covers them. What it could not send is carried over, so a piece that ends C tokens into
    its queue is sent in round ceil(C / quantum): running totals give the schedule exactly, on any
    number of partitions. Rounds in order, and sources in each round, fill one window after another;
    a piece that meets the end of a window is cut there. A queue that is empty leaves its turn to
    the others. Shares are ``weights`` (source, weight), or else those of the corpus.
    """
    queued = ordered_offsets(documents, ["source", "row"], {"before": F.col("n_tokens")})
    totals = documents.groupBy(F.col("source").alias("of_source")).agg(F.sum("n_tokens").alias("tokens"))
    starts = queued.groupBy(F.col("source").alias("of_source")).agg(F.min("before").alias("queue_start"))
    if weights is None:
        shares = totals.withColumn("weight", F.col("tokens").cast("double"))
    else:
        shares = totals.join(weights.select(F.coalesce("source", F.lit("")).alias("of_source"), F.col("weight").cast("double")), "of_source", "left").fillna({"weight": 0.0})
        # A source without a weight comes after all others.
        shares = shares.withColumn("weight", F.greatest(F.col("weight"), F.lit(1e-12)))
    whole = shares.agg(F.sum("weight")).first()[0] or 1.0
    queues = starts.join(shares, "of_source").select("of_source", "queue_start", (window * F.col("weight") / whole).alias("quantum"))
    # A source can hold most documents, so each queue's two numbers are repeated and its rows dealt out.
    queues = queues.withColumn("of_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    pieces = (
        queued.join(queues, (F.col("source") == F.col("of_source")) & (F.pmod("row", F.lit(PARTS)) == F.col("of_part")))
        .withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(piece).cast("long"))))
        .withColumn("length", F.least(F.lit(piece).cast("long"), F.col("n_tokens") - F.col("start")))
        .withColumn("queued", F.col("before") - F.col("queue_start") + F.col("start"))
        .withColumn("round", F.ceil((F.col("queued") + F.col("length")) / F.col("quantum")))
        .select("row", "source", "start", "length", "round", "queued")
    )
    placed = ordered_offsets(pieces, ["round", "source", "queued"], {"place": F.col("length")})
    room = F.lit(window) - F.col("place") % window
    nothing = F.lit(0).cast("long")
    part = F.explode(F.when(F.col("length") > room, F.array(nothing, room)).otherwise(F.array(nothing)))
    cut = placed.withColumn("room", room).withColumn("skip", part)
    return cut.select(
        "row",
        "source",
        (F.col("start") + F.col("skip")).alias("start"),
        F.when(F.col("skip") > 0, F.col("length") - F.col("room")).otherwise(F.least("length", "room")).alias("length"),
        F.expr(f"(place + skip) div {window}").alias("sequence_id"),
        ((F.col("place") + F.col("skip")) % window).alias("offset"),
    )


def mixture_packed(docs: DataFrame, tokenizer_path: str, window: int = 1024, piece: int = 256, weights: DataFrame | None = None) -> DataFrame:
    """Every token of ``docs`` in one piece of one window, with its ids and their checksum.

    Only the last window can be short. After any number of windows a source that still has pieces
    is within one piece and one quantum of its share. A null or empty text has its end id alone; a
    null source is the source ''; repeated rows are packed each; an empty table gives no rows. Only
    doc_id, text and source are read.
    """
    if not 0 < piece <= window:
        raise ValueError("a piece must fit into a window")
    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    tokens = staged(encoded(docs.select("doc_id", "text", source), tokenizer_path, ["doc_id", "source"]))
    places = mixture_order(tokens.select("row", "source", "n_tokens"), window, piece, weights)
    cuts = places.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("cuts"))
    joined = tokens.select("row", "doc_id", "source", "n_tokens", "ids", "id_bytes").join(cuts, "row").select("doc_id", "source", "n_tokens", "ids", "id_bytes", "cuts.start", "cuts.length", "cuts.sequence_id", "cuts.offset")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string(), pa.binary()]
        for batch in batches:
            out, size = [], 0
            for doc, source, n, ids, width, *lists in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, length, sequence, offset in zip(*lists, strict=True):
                    mine = ids[start * width : (start + length) * width]
                    wide = mine if width == 4 else np.frombuffer(mine, "<u2").astype("<u4").tobytes()
                    out.append((doc, start, length, zlib.crc32(wide), n, sequence, offset, source, mine))
                    size += len(mine)
                if size > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds, strict=True)], names)

    return joined.mapInArrow(frugal(cut), _SCHEMA)
