"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.llm import bpe, filter_audit, language_id, lm, nearest, packing, private_data, quality_classifier, quality_rules, simhash, token_files, url_filters, variants
from wrenfold.llm.common import new_path, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the policies base and v2."""
    entries = quality_rules.ledger(read_table(spark, sf_dir, "documents"))
    return entries.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality_rules.verdict("base")).alias("base_failed"),
        quality_rules.verdict("v2").alias("kept"),
        "fail_bits",
    )


_DUCK_CONDITIONS = " + ".join(
    f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, condition in enumerate(quality_rules.RULES.values())
)
ORACLES["op1_quality_rules"] = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), s AS (
  SELECT r, doc_id, text,
    list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM t
), win AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM s)
), dup AS (
  SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1
), rep AS (
  SELECT r, count(DISTINCT i + d) AS n FROM win JOIN dup USING (r, g), (VALUES (0), (1), (2)) v(d) GROUP BY r
), m AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
    len(regexp_extract_all(text, '!!')) AS n_shouts, len(regexp_extract_all(text, '[*%$&#]{{3}}')) AS n_marked
  FROM s LEFT JOIN rep USING (r)
), b AS (
  SELECT *, {_DUCK_CONDITIONS} AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & {quality_rules.mask("base")}) <> 0 AS base_failed, (fail_bits & {quality_rules.mask("v2")}) = 0 AS kept, fail_bits
FROM b
"""


@query
def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    judged = url_filters.judge(pages)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def _host_sql(url: str) -> str:
    small = "abcdefghijklmnopqrstuvwxyz"
    return f"translate(regexp_extract(regexp_extract(coalesce({url}, ''), '(?s)^.*?://(.*)$', 1), '^[^/?#]*'), '{small.upper()}', '{small}')"


def _rules_sql(value: int) -> str:
    """The verdict (0) or text (1) of the longest rule that fits."""
    longest_first = sorted(url_filters.RULES, key=lambda r: -len(r[1] + r[2]))
    whens = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(v, h + p)[value]}'" for v, h, p in longest_first]
    return f"CASE {' '.join(whens)} END"


#: Rounds of the SQL, after which 0.85 to their number is below 1e-7.
_ROUNDS = 100
_ROUNDS_SQL = ", ".join(
    f"s{k} AS (SELECT kind, host, sum(score) AS score FROM (SELECT s.kind, m.dst AS host, s.score * m.w * 0.85::DOUBLE AS score "
    f"FROM s{k - 1} s JOIN moves m ON m.kind = s.kind AND m.src = s.host UNION ALL SELECT kind, host, seed * (1 - 0.85::DOUBLE) FROM seeds) GROUP BY kind, host)"
    for k in range(1, _ROUNDS + 1)
)
ORACLES["op2_url_filters"] = rf"""
WITH p AS (
  SELECT page_id, html, {_host_sql("url")} AS host,
    regexp_extract(regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1), '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), j AS (
  SELECT page_id, host, path, {_rules_sql(1)} AS rule, {_rules_sql(0)} AS by_rule FROM p
), l AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS url FROM p
), e AS (
  SELECT src, dst, count(*) AS n FROM (SELECT src, {_host_sql("CASE WHEN starts_with(url, '//') THEN ':' || url ELSE url END")} AS dst FROM l) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst
), b AS (
  SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e
), moves AS (
  SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS w FROM b
), ruled AS (
  SELECT CASE WHEN by_rule = 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM j WHERE by_rule IS NOT NULL GROUP BY 1, 2
), seeds AS (
  SELECT kind, host, n / sum(n) OVER (PARTITION BY kind) AS seed FROM ruled
), s0 AS (SELECT kind, host, seed * (1 - 0.85::DOUBLE) AS score FROM seeds), {_ROUNDS_SQL}, t AS (
  SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM (SELECT kind, host, score / sum(score) OVER (PARTITION BY kind) AS score FROM s{_ROUNDS}) GROUP BY host
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN distrust > 0.75::DOUBLE * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict,
  round(trust, 9) AS trust, round(distrust, 9) AS distrust
FROM j LEFT JOIN t USING (host)
"""


@query
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, at three-word shingles and three bits."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=3, limit=3)
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1, with_ids=False)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, written in files and read from them."""
    folder = new_path(spark, "token-files")
    listing = token_files.write(read_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(listing).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.encode(read_table(spark, sf_dir, "documents"), path, decoded=True)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; the model learns from four of five folds of ids."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = language_id.in_fold("doc_id", 5)
    model = language_id.train(docs.where(~held_out))
    return language_id.predict(docs, model).select("doc_id", language_id.in_fold("doc_id", 5).alias("held_out"), "lang_pred", "score", "switches")


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    return nearest.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLES["op9_nearest_neighbours"] = """
WITH e AS (
  SELECT row_number() OVER () AS n, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.n <> c.n AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; the model learns from nine of ten folds of ids."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = lm.train(docs.where(~language_id.in_fold("doc_id", 10)))
    scored = lm.score(docs, model, counts)
    return scored.select(
        "doc_id",
        language_id.in_fold("doc_id", 10).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; a source is a host, its languages are its paths."""
    docs = read_table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, read_table(spark, sf_dir, "labels"))
    return quality_classifier.judge(quality_classifier.evidence(docs, model, "source", "lang"))


@query
def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document, and the terms that give it away."""
    found = private_data.find(read_table(spark, sf_dir, "documents"))
    base = private_data.listed(private_data.by_pattern(F.col("spans")))
    return found.select(
        "doc_id",
        *[private_data.of_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")],
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        private_data.listed(F.col("spans")).alias("spans"),
    )


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents of at least 5 letters and 3 occurrences, with their forms."""
    words = variants.counted(read_table(spark, sf_dir, "documents"), every=97)
    return variants.variants(words.where((F.length("word") >= 5) & (F.col("n") >= 3)))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each source, in all their orders."""
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d
), m AS (
  SELECT doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > first_id, false)] AS fails FROM w
), f AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), c AS (
  SELECT part, fails, len(list_filter(fails, lambda x: x)) AS held, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM m LEFT JOIN f USING (doc_id) GROUP BY part, fails
), v AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || e.x || g.x || h.x AS filter_order FROM v a, v b, v e, v g, v h WHERE len(list_distinct([a.x, b.x, e.x, g.x, h.x])) = 5
), s AS (
  SELECT filter_order, step, ord(filter_order[step]) - 64 AS k, list_transform(string_split(filter_order[1:step - 1], ''), lambda x: ord(x) - 64) AS earlier
  FROM o, (SELECT unnest(range(1, 6)) AS step)
), j AS (
  SELECT part, filter_order, step, fails[k] AS hit, step > 1 AND len(list_filter(earlier, lambda q: coalesce(fails[q], false))) > 0 AS gone, held, n, good, toxic FROM s, c
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS BIGINT) AS removed,
  CAST(coalesce(sum(n) FILTER (gone AND hit), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (hit AND held = 1), 0) AS BIGINT) AS unique_fails,
  CAST(coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(toxic) FILTER (NOT gone AND hit), 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(n * 120 // greatest(held, 1)) FILTER (hit), 0) AS BIGINT) AS shapley
FROM j GROUP BY part, filter_order, step
"""
