"""Retrieval, vectors, duplicates and near duplicates, scanning, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from metricloom.functions.text import lexical_terms, normalize_template, redact
from metricloom.operators.retrieval import (
    build_index,
    coverage_summary,
    group_coverage,
    hit_rate,
    idf,
    postings,
    search_stored,
    store_index,
    term_contributions,
    with_dependencies,
)
from metricloom.operators.scanning import classify_errors, scan_summary, secret_scan
from metricloom.operators.similarity import (
    cosine_pairs,
    clusters,
    count_vectors,
    coverage_counts,
    dice_forest,
    dice_pairs,
    distinct_texts,
    duplicate_groups,
    never_used,
    repetition_policy,
)
from registry.common import tables

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# ---------------------------------------------------------------- terms and index


def _corpus(spark, folder):
    docs = tables(spark, folder)("documents")
    return docs, build_index(docs, "doc_id", {"name": F.concat_ws(" ", "lang", "source"), "description": "text"})


_TERM = r"[a-z_][a-z_0-9]*(?:\.[a-z_][a-z_0-9]*)?"
_HAN = r"[\x{4E00}-\x{9FFF}]+"


def _terms(col: str) -> str:
    return f"""list_distinct(list_concat(regexp_extract_all(lower({col}), '{_TERM}'),
  flatten([[substr(r, CAST(i AS INTEGER), 2) for i in range(1, length(r))] for r in regexp_extract_all(lower({col}), '{_HAN}')])))"""


_INDEX = f"""ix AS (SELECT doc_id, lang, {_terms("lang || ' ' || source")} AS nm, {_terms('text')} AS ds FROM documents),
post AS (SELECT doc_id, 'name' AS field, unnest(nm) AS term FROM ix UNION ALL SELECT doc_id, 'description', unnest(ds) FROM ix),
dfq AS (SELECT term, count(DISTINCT doc_id) AS documents FROM post GROUP BY 1),
idfs AS (SELECT term, documents, ln(((SELECT count(*) FROM documents) + 1.0)::DOUBLE / (documents + 1)::DOUBLE) + 1.0 AS idf FROM dfq),
qt AS (SELECT item_id AS query_id, term, CAST(round(idf, 12) AS DECIMAL(28,12)) AS w
  FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark) JOIN idfs USING (term)),
m AS (SELECT query_id, doc_id, field, term, w * CASE field WHEN 'name' THEN 3 ELSE 1 END AS weight FROM post JOIN qt USING (term))"""


def _term_lists(spark, folder):
    docs = tables(spark, folder)("conversations")
    terms = lexical_terms("text")
    return docs.select("conv_id", "turn", F.array_join(F.array_sort(terms), " ").alias("terms"))


QUERIES["text_lexical_terms"] = _term_lists
ORACLES["text_lexical_terms"] = f"SELECT conv_id, turn, array_to_string(list_sort({_terms('text')}), ' ') AS terms FROM conversations"
QUERIES["retrieval_postings"] = lambda spark, folder: postings(_corpus(spark, folder)[1]).groupBy("field", "term").agg(
    F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
)
ORACLES["retrieval_postings"] = f"WITH {_INDEX} SELECT field, term, count(*) AS documents, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM post GROUP BY 1, 2"
QUERIES["retrieval_idf"] = lambda spark, folder: idf(_corpus(spark, folder)[1]).withColumn("idf", F.round("idf", 9))
ORACLES["retrieval_idf"] = f"WITH {_INDEX} SELECT term, documents, round(idf, 9) AS idf FROM idfs"


_STORED: dict = {}


def _stored(spark, folder, corpus=None):
    """The written index of a folder's corpus; a session writes it once and searches it many times."""
    key = (spark.sparkContext.applicationId, folder, corpus)
    if key not in _STORED:
        _STORED[key] = store_index((corpus or (lambda s, f: _corpus(s, f)[1]))(spark, folder))
    return _STORED[key]


def _index_summary(spark, folder):
    stored = _stored(spark, folder)
    rows = stored.blocks.select("term", F.explode("docs").alias("doc")).groupBy("doc.field").agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("term").alias("terms"))
    return rows.select(F.element_at(F.array(*[F.lit(f) for f in stored.fields]), F.col("field") + 1).alias("field"), "postings", "terms")


QUERIES["retrieval_stored_index"] = _index_summary
ORACLES["retrieval_stored_index"] = f"WITH {_INDEX} SELECT field, count(*) AS postings, count(DISTINCT term) AS terms FROM post GROUP BY 1"


def _hits(spark, folder, k, keep=None):
    stored = _stored(spark, folder)
    return stored, search_stored(stored, tables(spark, folder)("benchmark"), "item_id", "text", k, keep)


def _scored(frame):
    return frame.withColumn("score", F.round(F.col("score"), 6).cast("double"))


_RANKED = "r AS (SELECT query_id, doc_id, sum(weight) AS score, row_number() OVER (PARTITION BY query_id ORDER BY sum(weight) DESC, doc_id) AS rank FROM m{where} GROUP BY 1, 2)"
QUERIES["retrieval_search_top5"] = lambda spark, folder: _scored(_hits(spark, folder, 5)[1])
ORACLES["retrieval_search_top5"] = f"WITH {_INDEX}, {_RANKED.format(where='')} SELECT query_id, doc_id, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM r WHERE rank <= 5"


def _filtered(spark, folder):
    docs = tables(spark, folder)("documents")
    return _scored(_hits(spark, folder, 10, docs.filter(F.col("lang").isin("fr", "es")))[1])


QUERIES["retrieval_search_filtered_top10"] = _filtered
ORACLES["retrieval_search_filtered_top10"] = f"""WITH {_INDEX}, {_RANKED.format(where=" WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('fr', 'es'))")}
SELECT query_id, doc_id, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM r WHERE rank <= 10"""


def _turns(spark, folder):
    turns = tables(spark, folder)("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "conv_id", "turn", "role", "text"
    )
    references = turns.filter(F.col("turn") > 0).select(
        "doc_id", F.concat_ws("-", F.col("conv_id"), F.col("turn") - 1).alias("referenced_id")
    )
    docs = with_dependencies(turns, "doc_id", references, F.concat_ws(" ", "role", "text"))
    return build_index(docs, "doc_id", {"name": "role", "description": "text", "dependencies": "dependencies"})


def _dependencies(spark, folder):
    return _scored(search_stored(_stored(spark, folder, _turns), tables(spark, folder)("benchmark"), "item_id", "text", 3))


QUERIES["retrieval_search_with_dependencies_top3"] = _dependencies
ORACLES["retrieval_search_with_dependencies_top3"] = f"""WITH t AS (SELECT conv_id || '-' || turn AS doc_id, conv_id, turn, role, text FROM conversations),
d AS (SELECT t.doc_id, t.role, t.text, p.role || ' ' || p.text AS dep FROM t LEFT JOIN t p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1),
post AS (SELECT doc_id, 3 AS f, unnest({_terms('role')}) AS term FROM d UNION ALL SELECT doc_id, 1, unnest({_terms('text')}) FROM d
  UNION ALL SELECT doc_id, 1, unnest({_terms('dep')}) FROM d WHERE dep IS NOT NULL),
idfs AS (SELECT term, ln(((SELECT count(*) FROM d) + 1.0)::DOUBLE / (count(DISTINCT doc_id) + 1)::DOUBLE) + 1.0 AS idf FROM post GROUP BY 1),
qt AS (SELECT item_id AS query_id, term, CAST(round(idf, 12) AS DECIMAL(28,12)) AS w
  FROM (SELECT item_id, unnest({_terms('text')}) AS term FROM benchmark) JOIN idfs USING (term)),
m AS (SELECT query_id, doc_id, w * f AS weight FROM post JOIN qt USING (term)), {_RANKED.format(where='')}
SELECT query_id, doc_id, CAST(round(score, 6) AS DOUBLE) AS score, rank FROM r WHERE rank <= 3"""


def _evidence(spark, folder):
    stored, hits = _hits(spark, folder, 3)
    out = term_contributions(stored, tables(spark, folder)("benchmark"), "item_id", "text", hits)
    return out.select(
        "query_id", "doc_id", "rank", "field", F.explode("terms").alias("term", "weight")
    ).withColumn("weight", F.round("weight", 6))


QUERIES["retrieval_term_contributions"] = _evidence
ORACLES["retrieval_term_contributions"] = f"""WITH {_INDEX}, {_RANKED.format(where='')}
SELECT query_id, doc_id, rank, field, term, round(CAST(weight AS DOUBLE), 6) AS weight FROM r JOIN m USING (query_id, doc_id) WHERE rank <= 3"""


def _passages(spark, folder):
    """(query, line number, document): documents that repeat a whole line of a benchmark text."""
    t = tables(spark, folder)
    asked = t("benchmark").select(
        F.col("item_id").alias("query_id"), F.posexplode(F.split("text", "\n")).alias("group_no", "line")
    )
    lines = t("documents").select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("line"))
    return asked.filter(F.length("line") > 0).join(lines, "line").select("query_id", "group_no", "doc_id").distinct()


_PASSAGES = """b AS (SELECT item_id AS query_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS group_no, unnest(s) AS line FROM (SELECT item_id, string_split(text, chr(10)) AS s FROM benchmark)),
dl AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
g AS (SELECT DISTINCT query_id, group_no, doc_id FROM b JOIN dl USING (line) WHERE length(line) > 0)"""


def _hit_rate(spark, folder):
    _, hits = _hits(spark, folder, 10)
    labels = _passages(spark, folder).groupBy("query_id").agg(F.min("doc_id").alias("expected_doc_id"))
    return hit_rate(hits, labels, (1, 3, 5, 10)).withColumn("hit_rate", F.round("hit_rate", 6))


QUERIES["retrieval_hit_rate"] = _hit_rate
ORACLES["retrieval_hit_rate"] = f"""WITH {_INDEX}, {_RANKED.format(where='')}, {_PASSAGES},
l AS (SELECT query_id, min(doc_id) AS doc_id FROM g GROUP BY 1),
j AS (SELECT l.query_id, rank FROM l LEFT JOIN r ON r.query_id = l.query_id AND r.doc_id = l.doc_id AND rank <= 10)
SELECT k, count(*) FILTER (rank <= k) AS hits, count(*) AS included_queries,
round(count(*) FILTER (rank <= k) / count(*), 6) AS hit_rate FROM j, (VALUES (1), (3), (5), (10)) v(k) GROUP BY k"""


def _coverage(spark, folder):
    _, hits = _hits(spark, folder, 10)
    return group_coverage(hits, _passages(spark, folder))


_COVERAGE = f"""WITH {_INDEX}, {_RANKED.format(where='')}, {_PASSAGES},
best AS (SELECT g.query_id, group_no, min(rank) AS best FROM g LEFT JOIN r ON r.query_id = g.query_id AND r.doc_id = g.doc_id AND rank <= 10 GROUP BY 1, 2),
c AS (SELECT query_id, k, count(*) AS group_count, count(*) FILTER (best <= k) AS found_count, count(*) FILTER (best <= k) / count(*) AS coverage,
  CAST(count(*) = count(*) FILTER (best <= k) AS INTEGER) AS all_found, coalesce(string_agg(CAST(group_no AS VARCHAR), ',' ORDER BY group_no) FILTER (best IS NULL OR best > k), '') AS missing_groups
  FROM best, (VALUES (1), (3), (5), (10)) v(k) GROUP BY 1, 2)"""
QUERIES["retrieval_group_coverage"] = lambda spark, folder: _coverage(spark, folder).withColumns(
    {"coverage": F.round("coverage", 6), "missing_groups": F.concat_ws(",", F.col("missing_groups").cast("array<string>"))}
)
ORACLES["retrieval_group_coverage"] = f"{_COVERAGE} SELECT query_id, k, group_count, found_count, round(coverage, 6) AS coverage, all_found, missing_groups FROM c"


def _coverage_summary(spark, folder):
    cases = tables(spark, folder)("benchmark").select(
        F.col("item_id").alias("query_id"),
        F.when(F.length("text") > 250, "long").otherwise("short").alias("scope"),
        (F.length("text") > 60).alias("reviewed"),
    )
    out = coverage_summary(_coverage(spark, folder), cases)
    return out.withColumn("mean_coverage", F.round("mean_coverage", 6))


QUERIES["retrieval_coverage_summary"] = _coverage_summary
ORACLES["retrieval_coverage_summary"] = f"""{_COVERAGE},
s AS (SELECT c.*, unnest([CASE WHEN length(text) > 250 THEN 'long' ELSE 'short' END, 'all']) AS scope FROM c JOIN benchmark ON item_id = query_id WHERE length(text) > 60)
SELECT scope, k, count(*) AS reviewed_count, round(avg(coverage), 6) AS mean_coverage, CAST(sum(all_found) AS BIGINT) AS complete_queries FROM s GROUP BY 1, 2"""

# ---------------------------------------------------------------- vectors

_WORDS = ("click", "view", "signup", "purchase")


# A user's events of one day are a document; days with an error have a term outside the vocabulary.
_DAY = "user_id * 100000 + datediff(CAST(ts AS DATE), DATE'1970-01-01')"
_DAY_SQL = "user_id * 100000 + date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"


def _vectors(spark, folder, words=_WORDS):
    events = tables(spark, folder)("events").withColumn("day", F.expr(_DAY))
    return count_vectors(events, "day", "event_type", words)


def _count_vectors(spark, folder):
    good, bad = _vectors(spark, folder)
    return good.select("doc_id", *[F.col("vector")[i].alias(w) for i, w in enumerate(_WORDS)], F.lit(0).cast("bigint").alias("unknown_terms")).unionByName(
        bad.select("doc_id", *[F.lit(None).cast("bigint").alias(w) for w in _WORDS], "unknown_terms")
    )


QUERIES["text_count_vectors"] = _count_vectors
ORACLES["text_count_vectors"] = f"""WITH c AS (SELECT {_DAY_SQL} AS doc_id, {', '.join(f"count(*) FILTER (event_type = '{w}') AS {w}" for w in _WORDS)},
count(*) FILTER (event_type = 'error') AS unknown_terms FROM events GROUP BY 1)
SELECT doc_id, {', '.join(f"CASE WHEN unknown_terms = 0 THEN {w} END AS {w}" for w in _WORDS)}, unknown_terms FROM c"""


def _neighbours(ids, name):
    return ids.select(F.col(name).alias("left_id"), (F.col(name) + 1).alias("right_id"))


def _cosine_embeddings(spark, folder):
    vectors = tables(spark, folder)("embeddings")
    return cosine_pairs(vectors, "vec_id", "embedding", _neighbours(vectors, "vec_id")).withColumn("cosine", F.round("cosine", 6))


QUERIES["text_cosine_embedding_pairs"] = _cosine_embeddings
ORACLES["text_cosine_embedding_pairs"] = """SELECT a.vec_id AS left_id, b.vec_id AS right_id,
round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine, CAST(NULL AS VARCHAR) AS reason
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"""


def _cosine_counts(spark, folder):
    """Each day of a user beside the next, over all events."""
    good, _ = _vectors(spark, folder, (*_WORDS, "error"))
    return cosine_pairs(good, "doc_id", "vector", _neighbours(good, "doc_id")).withColumn("cosine", F.round("cosine", 6))


QUERIES["text_cosine_count_vector_pairs"] = _cosine_counts
ORACLES["text_cosine_count_vector_pairs"] = f"""WITH v AS (SELECT {_DAY_SQL} AS day, [{', '.join(f"CAST(count(*) FILTER (event_type = '{w}') AS DOUBLE)" for w in (*_WORDS, "error"))}] AS v
FROM events GROUP BY 1)
SELECT a.day AS left_id, b.day AS right_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, CAST(NULL AS VARCHAR) AS reason
FROM v a JOIN v b ON b.day = a.day + 1"""

# ---------------------------------------------------------------- duplicates

QUERIES["text_exact_duplicates"] = lambda spark, folder: duplicate_groups(tables(spark, folder)("documents"), "doc_id", "text")
ORACLES["text_exact_duplicates"] = """SELECT sha256(text) AS text_sha256, count(*) AS copies, min(doc_id) AS first_doc_id FROM documents GROUP BY 1 HAVING count(*) > 1"""

_WHITE = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]+"
def _templates(spark, folder):
    return tables(spark, folder)("documents"), normalize_template("text")


def _template_duplicates(spark, folder):
    docs, template = _templates(spark, folder)
    return duplicate_groups(docs, "doc_id", template).select("copies", "first_doc_id")


QUERIES["text_template_duplicates"] = _template_duplicates


def _pairs(spark, folder, linked=dice_pairs):
    docs, template = _templates(spark, folder)
    texts = distinct_texts(docs, "doc_id", template)
    return docs, texts, linked(texts)


QUERIES["text_dice_pairs"] = lambda spark, folder: _pairs(spark, folder)[2].withColumn("similarity", F.round("similarity", 6))


def _clusters(spark, folder):
    _, texts, pairs = _pairs(spark, folder, dice_forest)
    return clusters(pairs, texts)


QUERIES["text_similarity_clusters"] = _clusters


def _policy(spark, folder):
    docs, texts, pairs = _pairs(spark, folder, dice_forest)
    out = repetition_policy(pairs, clusters(pairs, texts), texts, duplicate_groups(docs, "doc_id", "text"))
    return out.withColumns(
        {
            "high_similarity_pairs": F.col("high_similarity_pairs").cast("bigint"),
            "possible_pairs": F.col("possible_pairs").cast("bigint"),
            "pair_ratio": F.round("pair_ratio", 9),
        }
    )


QUERIES["text_repetition_policy"] = _policy

# The same operators on plain lower-case text without digits, where SQL can state the template.
_PLAIN_SQL = "regexp_replace(lower(text), '[^\\p{L}\\p{N}_<>]', '', 'g')"


def _plain(spark, folder, linked=dice_pairs):
    docs = tables(spark, folder)("documents")
    template = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_<>]", "")
    texts = distinct_texts(docs, "doc_id", template)
    return docs, texts, linked(texts)


_PLAIN = f"""WITH RECURSIVE t AS (SELECT min(doc_id) AS id, count(*) AS copies, x FROM (SELECT doc_id, {_PLAIN_SQL} AS x FROM documents) GROUP BY x),
ch AS (SELECT id, x, string_split(x, '') AS c FROM t),
oc AS (SELECT id, c[i] || c[i + 1] AS g, c[i] || c[i + 1] || c[i + 2] AS g3 FROM (SELECT id, c, unnest(range(1, len(c))) AS i FROM ch WHERE len(c) > 1)),
gr AS (SELECT DISTINCT id, g FROM (SELECT id, g FROM oc UNION ALL SELECT id, g3 FROM oc WHERE length(g3) = 3 UNION ALL SELECT id, x FROM ch WHERE length(x) < 2)),
po AS (SELECT id, hash(g) AS h, count(*) OVER (PARTITION BY id) AS n FROM gr),
sh AS (SELECT a.id AS left_id, b.id AS right_id, any_value(a.n) AS ln, any_value(b.n) AS rn, count(*) AS shared
  FROM po a JOIN po b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2),
pr AS (SELECT left_id, right_id, l.copies AS left_copies, r.copies AS right_copies, 2.0::DOUBLE * shared / (ln + rn) AS similarity
  FROM sh JOIN t l ON l.id = left_id JOIN t r ON r.id = right_id WHERE 2.0::DOUBLE * shared / (ln + rn) >= 0.86),
hi AS (SELECT * FROM pr WHERE similarity >= 0.86),
e AS (SELECT left_id AS s, right_id AS d FROM hi UNION SELECT right_id, left_id FROM hi),
v AS (SELECT s AS id FROM e UNION SELECT id FROM t WHERE copies > 1),
reach(id, seen) AS (SELECT id, id FROM v UNION SELECT reach.id, e.d FROM reach JOIN e ON e.s = reach.seen),
lab AS (SELECT id, min(seen) AS component FROM reach GROUP BY 1),
cl AS (SELECT component AS cluster_id, count(*) AS distinct_texts, CAST(sum(copies) AS BIGINT) AS documents FROM lab JOIN t USING (id) GROUP BY 1)"""
QUERIES["text_dice_pairs_plain"] = lambda spark, folder: _plain(spark, folder)[2].withColumn("similarity", F.round("similarity", 6))
ORACLES["text_dice_pairs_plain"] = f"{_PLAIN} SELECT left_id, right_id, round(similarity, 6) AS similarity, left_copies, right_copies FROM hi"


def _plain_clusters(spark, folder):
    _, texts, pairs = _plain(spark, folder, dice_forest)
    return clusters(pairs, texts)


QUERIES["text_similarity_clusters_plain"] = _plain_clusters
ORACLES["text_similarity_clusters_plain"] = f"{_PLAIN} SELECT * FROM cl"


def _plain_policy(spark, folder):
    docs, texts, pairs = _plain(spark, folder, dice_forest)
    out = repetition_policy(pairs, clusters(pairs, texts), texts, duplicate_groups(docs, "doc_id", "text"))
    return out.withColumns(
        {
            "high_similarity_pairs": F.col("high_similarity_pairs").cast("bigint"),
            "possible_pairs": F.col("possible_pairs").cast("bigint"),
            "pair_ratio": F.round("pair_ratio", 9),
        }
    )


QUERIES["text_repetition_policy_plain"] = _plain_policy
ORACLES["text_repetition_policy_plain"] = f"""{_PLAIN}, n AS (SELECT count(*) AS n FROM documents),
p AS (SELECT (SELECT sum(left_copies * right_copies) FROM hi) + (SELECT sum(copies * (copies - 1) // 2) FROM t) AS p)
SELECT n AS documents, CAST(p AS BIGINT) AS high_similarity_pairs, n * (n - 1) // 2 AS possible_pairs, (SELECT max(documents) FROM cl) AS largest_cluster,
(SELECT count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)) AS exact_duplicate_groups,
(SELECT count(*) FROM t WHERE copies > 1) AS template_duplicate_groups, round(p / (n * (n - 1) / 2), 9) AS pair_ratio, 0 AS passed FROM n, p"""


def _case_coverage(spark, folder):
    docs = tables(spark, folder)("documents")
    cases = docs.select("lang", "source", F.split(F.concat_ws(",", "lang", "source"), ",").alias("tags"))
    return coverage_counts(cases, ("lang", "source"), ("tags",))


QUERIES["text_coverage_counts"] = _case_coverage
ORACLES["text_coverage_counts"] = """WITH v AS (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents
UNION ALL SELECT 'tags', unnest([lang, source]) FROM documents) SELECT field, value, count(*) AS cases FROM v GROUP BY 1, 2"""
QUERIES["text_dictionary_never_used"] = lambda spark, folder: never_used(
    tables(spark, folder)("documents"), "doc_id", tables(spark, folder)("labels"), "doc_id"
)
ORACLES["text_dictionary_never_used"] = "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

# ---------------------------------------------------------------- scanning

_RULES = (
    ("assigned_token", r'(?i)token[ \t]*=[ \t]*"[0-9a-f]{40}"'),
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("openai_style_secret", r"\bsk-[A-Za-z0-9_-]{20,}\b"),
    ("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("long_number", r"[0-9]{12,}"),
)


def _scan(spark, folder):
    docs = tables(spark, folder)("documents")
    return secret_scan(docs, "doc_id", "text", _RULES, excluded=F.col("source") == "src19")


QUERIES["text_secret_scan"] = _scan
ORACLES["text_secret_scan"] = """WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS line, unnest(s) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE source <> 'src19'))
""" + " UNION ALL ".join(
    f"""SELECT doc_id, '{n}' AS rule, CAST(line AS INTEGER) AS line FROM (SELECT doc_id, line, unnest(regexp_extract_all(x, '{p}')) FROM l)"""
    for n, p in _RULES
)


def _scan_summary(spark, folder):
    docs = tables(spark, folder)("documents")
    return scan_summary(docs, secret_scan(docs, "doc_id", "text", _RULES))


QUERIES["text_secret_scan_summary"] = _scan_summary
ORACLES["text_secret_scan_summary"] = "WITH f AS (SELECT " + " + ".join(
    f"sum(len(regexp_extract_all(text, '{p}')))" for _, p in _RULES
) + " AS n FROM documents) SELECT (SELECT count(*) FROM documents) AS scanned_documents, CAST(n AS BIGINT) AS finding_count, CAST(n = 0 AS INTEGER) AS passed FROM f"

QUERIES["text_redact"] = lambda spark, folder: tables(spark, folder)("pages").select(
    "page_id", redact("html").alias("redacted"), F.length(redact("html", 1 << 30)).alias("full_length")
)
_RED = f"""regexp_replace(regexp_replace(trim(regexp_replace(html, '{_WHITE}', ' ', 'g')), '(?i)file:[^\\s,;]+', '<database-path>', 'g'),
'(?i)(?:[a-z]:\\\\|[a-z]:/)[^\\s,;]+', '<database-path>', 'g')"""
ORACLES["text_redact"] = f"SELECT page_id, left({_RED}, 500) AS redacted, length({_RED}) AS full_length FROM pages"


def _errors(spark, folder):
    events = tables(spark, folder)("events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = (
        F.when(k < 10, "safety")
        .when(k < 20, "timeout")
        .when(k < 30, "binding")
        .when(k < 40, "sql_syntax")
        .when(k < 50, "field")
        .when(k < 95, "database")
        .otherwise("other")
    )
    message = (
        F.when(k < 60, F.concat(F.lit("No such function: f_"), k.cast("string")))
        .when(k < 70, F.concat(F.lit("table t has "), k.cast("string"), F.lit(" values for 3 columns")))
        .when(k < 80, F.lit("database is locked"))
        .otherwise(F.concat(F.lit("\t wrong number of arguments to function "), F.col("event_type"), F.lit("()\u00a0\r\n")))
    )
    log = events.select("event_id", (F.col("event_type") == "view").alias("ok"), kind.alias("kind"), (F.col("value") > 20).alias("started"), message.alias("message"))
    out = classify_errors(log, F.col("ok"), F.col("kind"), F.col("started"), F.col("message"))
    return out.select("event_id", "rule_id", "category", "eligible")


QUERIES["text_classify_errors"] = _errors
ORACLES["text_classify_errors"] = """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
r AS (SELECT event_id, CASE WHEN event_type = 'view' THEN 'execution_succeeded' WHEN k < 10 THEN 'day8_safety_failure' WHEN k < 20 THEN 'sqlite_timeout'
  WHEN k < 30 THEN 'parameter_binding_failure' WHEN k < 50 THEN CASE WHEN value > 20 THEN 'sqlite_' ELSE 'pre_execution_' END || CASE WHEN k < 40 THEN 'sql_syntax' ELSE 'field' END
    || CASE WHEN value > 20 THEN '_after_safety' ELSE '' END
  WHEN k >= 95 THEN 'unknown_execution_error_default_deny' WHEN value <= 20 THEN 'database_unavailable_before_execution'
  WHEN k < 60 THEN 'sqlite_missing_scalar_function' WHEN k < 70 THEN 'sqlite_cte_column_count' WHEN k < 80 THEN 'database_error_default_deny'
  ELSE 'sqlite_function_argument_count' END AS rule_id FROM e),
c AS (SELECT *, CASE WHEN rule_id = 'execution_succeeded' THEN 'not_applicable' WHEN rule_id = 'day8_safety_failure' OR rule_id LIKE 'pre_%' THEN 'safety_failure'
  WHEN rule_id = 'sqlite_timeout' THEN 'resource_failure' WHEN rule_id = 'parameter_binding_failure' THEN 'contract_failure'
  WHEN rule_id LIKE '%_after_safety' OR rule_id IN ('sqlite_missing_scalar_function', 'sqlite_cte_column_count', 'sqlite_function_argument_count') THEN 'repairable_sql_error'
  WHEN rule_id LIKE 'database_unavailable%' THEN 'environment_error' ELSE 'unclassified_database_error' END AS category FROM r)
SELECT event_id, rule_id, category, CAST(category = 'repairable_sql_error' AS INTEGER) AS eligible FROM c"""
