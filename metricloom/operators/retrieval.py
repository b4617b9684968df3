"""Lexical retrieval: term index, inverse document frequency, batched top-k search, evaluation."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from metricloom.functions.scope import flag
from metricloom.functions.text import lexical_terms
from metricloom.operators.windows import first_n_per_group
from metricloom.session import delete, delete_on_exit, shared_folder, shuffles_freed, written, written_at

# Field weights.
FIELD_WEIGHTS = {"name": 3, "description": 1, "dependencies": 1}
# Scores are sums of rounded decimals, so equal evidence gives equal scores in any task order.
SCORE = "decimal(28,12)"
# Documents of one block of the stored index, on average.
BLOCK_DOCUMENTS = 64
# Blocks of the stored index that one task puts together or searches, and that one bucket has the postings of, about;
# more tasks and buckets follow from more blocks.
PART_BLOCKS, BUCKET_BLOCKS = 16, 64
# Bytes of rows of postings that are packed together.
PACKED_BYTES = 1 << 25


@dataclass(frozen=True)
class TermIndex:
    """Documents as distinct terms per field: ``(doc_id, <field> array<string>, ...)``."""

    documents: DataFrame
    fields: tuple[str, ...]


def build_index(documents: DataFrame, doc_id: str, fields: dict[str, Column | str]) -> TermIndex:
    """Terms per document and field; one row per document, nothing is shuffled."""
    unknown = [f for f in fields if f not in FIELD_WEIGHTS]
    if unknown:
        raise ValueError(f"fields without a weight: {unknown}")
    terms = [lexical_terms(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))).alias(f) for f, c in fields.items()]
    return TermIndex(documents.select(F.col(doc_id).alias("doc_id"), *terms), tuple(fields))


def with_dependencies(
    documents: DataFrame, doc_id: str, references: DataFrame, text: Column
) -> DataFrame:
    """Add the text of directly referenced documents as a ``dependencies`` field (one hop).

    ``references`` holds ``(doc_id, referenced_id)``. A document's own references are few and
    listed by itself, so gathering their texts is bounded by the document.
    """
    named = documents.select(F.col(doc_id).alias("referenced_id"), text.alias("_text"))
    gathered = (
        references.select(F.col("doc_id").alias("_referrer"), "referenced_id")
        .distinct()
        .join(named, "referenced_id")
        .groupBy("_referrer")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("referenced_id", "_text"))), lambda r: r["_text"]), " ").alias("dependencies"))
    )
    return documents.join(gathered, F.col(doc_id) == F.col("_referrer"), "left").drop("_referrer")


def postings(index: TermIndex) -> DataFrame:
    """(doc_id, field, term), exploded in place."""
    per_field = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in index.fields])
    return (
        index.documents.select("doc_id", F.explode(per_field).alias("f"))
        .select("doc_id", "f.field", F.explode("f.terms").alias("term"))
    )


def idf(index: TermIndex, vocabulary: DataFrame | None = None) -> DataFrame:
    """(term, documents, idf) over the whole corpus, whatever filters a search applies later.

    Each document contributes a term once because its fields are united before the explode;
    a frequent term leaves every task as one partial count.
    """
    total = index.documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    terms = index.documents.select(
        F.explode(F.array_distinct(F.concat(*[F.col(f) for f in index.fields]))).alias("term")
    )
    if vocabulary is not None:
        terms = terms.join(vocabulary, "term", "left_semi")
    counts = terms.groupBy("term").agg(F.count(F.lit(1)).alias("documents"))
    return counts.withColumn(
        "idf", F.log((total + 1).cast("double") / (F.col("documents") + 1).cast("double")) + 1.0
    )


@dataclass(frozen=True)
class StoredIndex:
    """A written index, from which searches are answered without the texts.

    ``blocks`` has a row for each term and block of documents that has it: ``term``, ``block``, the most
    that a document of the block can weigh for the term, and ``docs``, the documents and the number of the
    field that has it. It is bucketed by term, so that a search deals out its own terms only. ``terms`` has the
    document count and inverse document frequency of each term. ``parts`` is the number of tasks among which
    blocks are dealt, so that none has more of them when there are more; ``count`` is the number of blocks.
    """

    spark: SparkSession
    blocks_name: str
    terms: DataFrame
    fields: tuple[str, ...]
    parts: int
    count: int

    @property
    def blocks(self) -> DataFrame:
        return self.spark.table(self.blocks_name)


def _followed(spark: SparkSession, blocks: int, of_one: int) -> int:
    """Tasks for so many blocks with ``of_one`` in each, or those of the session if they are more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks // of_one))


def _block(doc_id: Column | str, blocks: int) -> Column:
    """Number of the block of a document, by a hash of its id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(blocks))


def _block_postings(documents: DataFrame, fields: Sequence[str], blocks: int) -> DataFrame:
    """For each term and block: ``most`` and ``docs`` of a stored index."""
    per_field = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f).alias("terms")) for k, f in enumerate(fields)])
    # Terms move once, document by document; what a block holds is then put together where it lies.
    parts = _followed(documents.sparkSession, blocks, PART_BLOCKS)
    dealt = documents.withColumn("block", _block("doc_id", blocks)).repartition(parts, "block")
    found = (
        dealt.select("doc_id", "block", F.explode(per_field).alias("f"))
        .select("block", F.struct("doc_id", F.col("f.field").alias("field")).alias("doc"), F.explode("f.terms").alias("term"))
    )
    # No document of the block weighs more than all fields in which some document has the term.
    most = sum((F.max(F.when(F.col("doc.field") == k, FIELD_WEIGHTS[f]).otherwise(0)) for k, f in enumerate(fields)), F.lit(0))
    # At most the documents of one block are gathered.
    return found.groupBy("term", "block").agg(most.alias("most"), F.collect_list("doc").alias("docs"))


def _dealt_by_term(grouped: DataFrame, buckets: int) -> DataFrame:
    """``grouped`` with the rows of each bucket of terms in one task, where they move packed, many as one compressed value."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            order = np.argsort(table["_bucket"].to_numpy(), kind="stable")
            bucket, rows = table["_bucket"].to_numpy()[order], table.drop_columns(["_bucket"]).take(pa.array(order)).combine_chunks()
            starts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist()]
            values = []
            for start, end in zip(starts, [*starts[1:], len(bucket)], strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(rows.slice(start, end - start))
                values.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(values, pa.binary())], ["bucket", "rows"])

        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACKED_BYTES:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                yield from pa.ipc.open_stream(value.as_buffer())

    # The hash by which Spark finds the bucket of a row that it writes.
    packed = grouped.withColumn("_bucket", F.pmod(F.hash("term"), F.lit(buckets))).mapInArrow(pack, "bucket int, rows binary")
    return packed.repartitionById(buckets, "bucket").select("rows").mapInArrow(unpack, grouped.schema)


def store_index(index: TermIndex, block_documents: int = BLOCK_DOCUMENTS) -> StoredIndex:
    """Write the inverted index of ``index``; the terms of each text are found once.

    Documents are dealt into blocks by a hash of their id, ``block_documents`` of them on average. A
    frequent term is a row for each block, so no task and no row holds all its documents.
    """
    spark = index.documents.sparkSession
    total = index.documents.count()
    blocks = max(1, -(-total // block_documents))
    # Written before they are dealt by term, so that only one of the two shuffles is on disk.
    grouped, gathered = written_at(_block_postings(index.documents, index.fields, blocks))
    name = f"term_index_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{spark.sparkContext.applicationId}-{name}"
    buckets = _followed(spark, blocks, BUCKET_BLOCKS)
    with shuffles_freed(spark):
        _dealt_by_term(grouped, buckets).write.option("path", path).bucketBy(buckets, "term").sortBy("term").saveAsTable(name)
    delete_on_exit(spark, path)
    delete(spark, gathered)
    counts = spark.table(name).groupBy("term").agg(F.sum(F.size(F.array_distinct("docs.doc_id"))).cast("bigint").alias("documents"))
    value = F.log(F.lit(total + 1.0) / (F.col("documents") + 1).cast("double")) + 1.0
    return StoredIndex(spark, name, written(counts.withColumn("idf", value)), index.fields, _followed(spark, blocks, PART_BLOCKS), blocks)


def _asked(stored: StoredIndex, queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """The known terms of each query with their weights."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(lexical_terms(text)).alias("term"))
    return written(asked.join(stored.terms, "term").select("query_id", "term", F.round("idf", 12).cast(SCORE).alias("idf")))


def _weight(stored: StoredIndex, field: Column) -> Column:
    return F.element_at(F.array(*[F.lit(FIELD_WEIGHTS[f]) for f in stored.fields]), field + 1)


def _scored(stored: StoredIndex, asked: DataFrame, wanted: DataFrame, keep: DataFrame | None) -> DataFrame:
    """Scores of the documents of the ``wanted`` (query_id, block), from their blocks of postings.

    A row of postings moves once, to the task of its block, however many queries have its term. A document is in
    one block; block by block its postings meet the terms of the queries that want it.
    """
    terms = wanted.join(asked, "query_id").select("block", "query_id", "term", "idf").repartition(stored.parts, "block")
    read = stored.blocks.select("term", "block", "docs").join(asked.select("term").distinct(), "term", "left_semi").repartition(stored.parts, "block")
    kind = stored.blocks.schema["docs"].dataType.elementType["doc_id"].dataType
    if keep is not None:
        # Ids that a filter admits go where their blocks are, at most those of a block together.
        ids = keep.select(F.col("doc_id").cast(kind).alias("doc_id")).repartition(stored.parts, "doc_id").distinct()
        kept = ids.withColumn("block", _block("doc_id", stored.count)).repartition(stored.parts, "block").groupBy("block").agg(F.collect_list("doc_id").alias("kept"))
        admitted = F.filter("docs", lambda d: F.array_contains("kept", d["doc_id"]))
        read = read.join(kept, "block").select("term", "block", admitted.alias("docs"))
    weights = np.array([FIELD_WEIGHTS[f] for f in stored.fields], np.int64)
    schema = T.StructType([wanted.schema["query_id"], T.StructField("doc_id", kind), T.StructField("score", T.DecimalType(28, 12))])

    none = to_arrow_schema(schema)

    def score(asked: pa.Table, postings: pa.Table) -> pa.Table:
        known = pc.index_in(asked["term"].combine_chunks(), postings["term"].combine_chunks())
        here = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        if not len(here):
            return none.empty_table()
        docs = postings["docs"].combine_chunks()
        ids = docs.flatten().field("doc_id").dictionary_encode("encode")
        places, owners = ids.indices.to_numpy(), pc.list_parent_indices(docs).to_numpy()
        # A row for each term of the block and a column for each of its documents.
        weight = np.zeros((len(docs), len(ids.dictionary)), np.int64)
        np.add.at(weight, (owners, places), weights[docs.flatten().field("field").to_numpy()])
        queries = asked["query_id"].combine_chunks().take(pa.array(here)).dictionary_encode("encode")
        order = np.argsort(queries.indices.to_numpy(), kind="stable")
        own = queries.indices.to_numpy()[order]
        rows = known.take(pa.array(here)).to_numpy()[order]
        units = np.frombuffer(asked["idf"].combine_chunks().take(pa.array(here[order])).buffers()[1], np.int64)[: 2 * len(order) : 2]
        # Two halves of each number, so that no sum leaves 64 bits.
        starts = np.searchsorted(own, np.arange(len(queries.dictionary)))
        high, low = (np.add.reduceat(weight[rows] * half[:, None], starts) for half in (units >> 24, units & 0xFFFFFF))
        q, d = np.nonzero(high | low)
        values = np.empty((len(q), 2), np.uint64)
        high, low = high[q, d], low[q, d]
        low += (high & 0xFFFFFF) << 24
        high = (high >> 24) + (low >> 48)
        low &= (1 << 48) - 1
        values[:, 0], values[:, 1] = (high & 0xFFFF).astype(np.uint64) << np.uint64(48) | low.astype(np.uint64), (high >> 16).astype(np.uint64)
        scores = pa.Array.from_buffers(pa.decimal128(28, 12), len(q), [None, pa.py_buffer(values.tobytes())])
        return pa.table([queries.dictionary.take(pa.array(q)), ids.dictionary.take(pa.array(d)), scores], ["query_id", "doc_id", "score"])

    return terms.groupBy("block").cogroup(read.groupBy("block")).applyInArrow(score, schema)


def search_stored(stored: StoredIndex, queries: DataFrame, query_id: str, text: str, k: int, keep: DataFrame | None = None) -> DataFrame:
    """``search`` over a stored index: the same rows, without reading a text.

    For each query, the most that each block of documents can score is the sum over its terms of
    the block's maxima. The block with the highest bound is scored first; its k-th score, if it has k
    documents, is what a document of another block must reach, and blocks whose bound is less are not
    read at all.
    """
    if k < 1:
        raise ValueError("k must be positive")
    asked = _asked(stored, queries, query_id, text)
    weighed = asked.join(stored.blocks.select("term", "block", "most"), "term").repartition(stored.parts, "query_id", "block")
    bounds = written(weighed.groupBy("query_id", "block").agg(F.sum((F.col("most") * F.col("idf")).cast(SCORE)).alias("bound")))
    order = (F.col("score").desc(), F.col("doc_id").asc())
    first = bounds.groupBy("query_id").agg(F.max(F.struct("bound", "block")).alias("_m")).select("query_id", "_m.block")
    tops = first_n_per_group(_scored(stored, asked, first, keep), ("query_id",), order, k, "rank")
    least = tops.filter(F.col("rank") == k).select(F.col("query_id").alias("_query"), F.col("score").alias("least"))
    wanted = bounds.join(least, F.col("query_id") == F.col("_query"), "left").filter(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).select("query_id", "block")
    return first_n_per_group(_scored(stored, asked, written(wanted), keep), ("query_id",), order, k, "rank")


def search(
    index: TermIndex,
    queries: DataFrame,
    query_id: str,
    text: str,
    k: int,
    keep: DataFrame | None = None,
) -> DataFrame:
    """Top ``k`` documents per query by summed field weight times IDF of shared terms.

    ``keep`` lists the document ids a filter admits; IDF still counts the whole corpus. The index is
    written first; who searches more than once keeps it with ``store_index``.
    """
    return search_stored(store_index(index), queries, query_id, text, k, keep)


def term_contributions(stored: StoredIndex, queries: DataFrame, query_id: str, text: str, hits: DataFrame) -> DataFrame:
    """For each hit and field, a map from shared term to its weight.

    Only the blocks of hits are read again; a map is bounded by its query's terms.
    """
    asked = _asked(stored, queries, query_id, text)
    kind = stored.blocks.schema["docs"].dataType.elementType["doc_id"].dataType
    # Terms of hits are few; rows of postings are read with them, before there is one for each document and query.
    wanted = written(hits.select("query_id", F.col("doc_id").cast(kind).alias("doc_id"), "rank").withColumn("block", _block("doc_id", stored.count)).join(asked, "query_id"))
    read = stored.blocks.select("term", "block", "docs").join(wanted.select("term").distinct(), "term", "left_semi")
    found = wanted.join(read, ["term", "block"]).withColumn("doc", F.explode("docs")).filter("doc.doc_id = doc_id").select("query_id", "term", "idf", "doc_id", "doc.field", "rank")
    weight = (_weight(stored, F.col("field")) * F.col("idf")).cast(SCORE).cast("double")
    name = F.element_at(F.array(*[F.lit(f) for f in stored.fields]), F.col("field") + 1)
    return found.groupBy("query_id", "doc_id", "rank", name.alias("field")).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("term", weight.alias("weight"))))).alias("terms")
    )


def hit_rate(hits: DataFrame, labels: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Share of labelled queries whose expected document ranks within each k.

    ``labels`` holds ``(query_id, expected_doc_id)`` with one expected document per query.
    """
    found = labels.join(
        hits.select("query_id", F.col("doc_id").alias("expected_doc_id"), "rank"),
        ["query_id", "expected_doc_id"],
        "left",
    )
    wide = found.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(flag(F.col("rank") <= k)).alias(f"hit_{k}") for k in ks],
    )
    return wide.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(k).alias("k"),
                        F.col(f"hit_{k}").alias("hits"),
                        F.col("n").alias("included_queries"),
                        F.try_divide(F.col(f"hit_{k}").cast("double"), F.col("n").cast("double")).alias("hit_rate"),
                    )
                    for k in ks
                ]
            )
        ).alias("r")
    ).select("r.*")


def group_coverage(
    hits: DataFrame, groups: DataFrame, ks: Sequence[int] = (1, 3, 5, 10)
) -> DataFrame:
    """Per query and k: the share of target groups with a hit, whether all were found, and the
    missing groups.

    ``groups`` holds ``(query_id, group_no, doc_id)``. Only the best rank of a group matters, so
    memberships reduce to one minimum per group before anything else.
    """
    best = (
        groups.join(hits.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
        .groupBy("query_id", "group_no")
        .agg(F.min("rank").alias("best_rank"))
    )
    at = best.select("query_id", "group_no", "best_rank", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    found = F.coalesce(F.col("best_rank") <= F.col("k"), F.lit(False))
    return at.groupBy("query_id", "k").agg(
        F.count(F.lit(1)).alias("group_count"),
        F.sum(flag(found)).alias("found_count"),
        F.try_divide(F.sum(flag(found)).cast("double"), F.count(F.lit(1)).cast("double")).alias("coverage"),
        F.min(flag(found)).alias("all_found"),
        F.array_sort(F.collect_list(F.when(~found, F.col("group_no")))).alias("missing_groups"),
    )


def coverage_summary(coverage: DataFrame, cases: DataFrame) -> DataFrame:
    """Mean coverage and complete queries per scope and k over reviewed cases, plus ``all``.

    ``cases`` holds ``(query_id, scope, reviewed)``.
    """
    rows = coverage.join(cases.filter(F.col("reviewed")).select("query_id", "scope"), "query_id")
    scoped = rows.select("k", "coverage", "all_found", F.explode(F.array(F.col("scope"), F.lit("all"))).alias("scope"))
    return scoped.groupBy("scope", "k").agg(
        F.count(F.lit(1)).alias("reviewed_count"),
        F.avg("coverage").alias("mean_coverage"),
        F.sum("all_found").alias("complete_queries"),
    )
