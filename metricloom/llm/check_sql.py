"""SQL that gives the rows of those queries that SQL can express."""

from __future__ import annotations

from metricloom.llm.quality_rules import CHARACTER_CLASSES, COMMON_WORDS, QualityRules

# Only A-Z is lower-cased.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULES = QualityRules()


def _literals(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


NEAR_DUPLICATES = rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) END) AS s FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id, doc_id AS node FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN both_ways l ON l.a = r.node),
least AS (SELECT doc_id, min(node) AS component_id FROM reached GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


def _distance(histogram: str, reference: str) -> str:
    """Jensen-Shannon distance of two lists of counts of the same length."""
    share = [f"{h} / nullif(list_sum({h}s), 0)" for h in ("x", "y")]
    return f"""(SELECT coalesce(sqrt(greatest(sum(
        CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)), 0)
      FROM (SELECT {share[0]} AS p, {share[1]} AS q FROM (
        SELECT unnest({histogram}) AS x, unnest({reference}) AS y, {histogram} AS xs, {reference} AS ys)))"""


def _quality() -> str:
    left = ", ".join(f"(length(t) - length(regexp_replace(t, '{p}+', '', 'g')))::DOUBLE" for p in CHARACTER_CLASSES.values())
    bins = range(1, len(CHARACTER_CLASSES) + 2)
    most = max(map(len, COMMON_WORDS.values())) + 1
    lists = " ".join(f"WHEN '{lang}' THEN {_literals(words)}" for lang, words in COMMON_WORDS.items())
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
p AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]+') AS tokens,
    [{left}] AS classes,
    CASE lang {lists} ELSE []::VARCHAR[] END AS listed FROM d),
h AS (
  SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    classes[{len(CHARACTER_CLASSES)}]::BIGINT AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    list_append(classes, length(t) - list_sum(classes)) AS chars,
    list_transform(listed, lambda x: len(list_filter(tokens, lambda y: y = x))::DOUBLE) AS found FROM p),
c AS (SELECT * EXCLUDE (found), list_append(found, greatest(n_words - coalesce(list_sum(found), 0), 0)) AS common FROM h),
r AS (
  SELECT lang, [{", ".join(f"sum(chars[{i}])" for i in bins)}] AS of_chars,
    [{", ".join(f"coalesce(sum(common[{i}]), 0)" for i in range(1, most + 1))}] AS of_common FROM c GROUP BY 1),
windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM p)),
repeated AS (
  SELECT doc_id, sum(step) AS n FROM (
    SELECT doc_id, least(3, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i), 3)) AS step FROM windows WHERE n > 1) GROUP BY 1),
j AS (
  SELECT c.*, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words,
    {_distance("chars", "of_chars")} AS char_distance,
    {_distance("list_resize(common, " + str(most) + ", 0.0::DOUBLE)", "of_common")} AS word_distance
  FROM c JOIN r USING (lang) LEFT JOIN repeated USING (doc_id)),
v AS (
  SELECT *, n_words < {_RULES.least_words} OR 100 * n_repeat_words > {_RULES.most_repeated_percent} * n_words AS base_failed,
    word_chars >= {_RULES.min_chars} AND char_distance > {_RULES.char_distance} AS char_failed,
    n_words >= {_RULES.min_words} AND word_distance > {_RULES.word_distance} AS word_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT char_failed AND NOT word_failed AS kept,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance, char_failed, word_failed FROM v"""


DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 10 THEN [w]
    ELSE list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) END) AS x FROM b),
lengths AS (SELECT DISTINCT len(x) AS n FROM windows),
places AS (
  SELECT doc_id, i, n, w[i:i + n - 1] AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM places JOIN windows USING (x)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


HARD_NEGATIVES = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id)::INT AS positive_rank
  FROM s WHERE same QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, positive_rank, positive_score, id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


MIXTURE = r"""
WITH best AS (
  SELECT doc_id AS id, max(CASE quality WHEN 1 THEN 2.0 WHEN 0 THEN 0.5 ELSE 1.0 END)::DOUBLE AS weight FROM labels GROUP BY 1),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / coalesce(weight, 1.0) AS key
  FROM documents LEFT JOIN best ON id = doc_id),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
    [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM d GROUP BY source),
level AS (
  SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS w_total,
    coalesce(sum(most) OVER before, 0) AS most_before, coalesce(sum(w) OVER before, 0) AS w_before
  FROM s WINDOW before AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
filled AS (SELECT *, most_before * w + most * (w_total - w_before) <= total * w AS is_full FROM level),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN most::DOUBLE ELSE
    (w * (total - coalesce(sum(most) FILTER (is_full) OVER (), 0)))::DOUBLE / (sum(w) FILTER (NOT is_full) OVER ())::DOUBLE END AS target
  FROM filled),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM targets),
queued AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before FROM d)
SELECT doc_id, size, source_size, target, q.source AS source,
  size * (epochs + CASE WHEN target - epochs * source_size > 0 AND before + size / 2.0 <= target - epochs * source_size THEN 1 ELSE 0 END)::BIGINT AS taken
FROM queued q JOIN plan p ON q.source IS NOT DISTINCT FROM p.source"""


FILTER_INTERACTIONS = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
good AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS failed
  FROM d LEFT JOIN good USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step] AS letter, 1 << (strpos('ABCDE', filter_order[step]) - 1)::INT AS b,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (strpos('ABCDE', filter_order[i]) - 1)::INT)), 0)::INT AS earlier
  FROM orders, range(1, 6) u(step)),
figures AS (
  SELECT part, filter_order, step, letter,
    coalesce(sum(n) FILTER (failed & (earlier | b) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (failed & b > 0 AND failed & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (failed & b > 0 AND failed & earlier > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (failed = b), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (failed & b > 0 AND failed & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (failed & b > 0 AND failed & earlier = 0), 0)::BIGINT AS toxic_lost
  FROM c, steps GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (letter), (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM figures"""


ORACLES = {
    "op2_near_duplicates": NEAR_DUPLICATES,
    "op3_quality_rules": _quality(),
    "op7_decontamination": DECONTAMINATION,
    "op11_hard_negatives": HARD_NEGATIVES,
    "op12_mixed_sources": MIXTURE,
    "op13_filter_interactions": FILTER_INTERACTIONS,
}
