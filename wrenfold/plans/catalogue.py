"""The queries of the knowledge-record operators and their SQL.

Records are made from the driver tables: documents (their first line is the title, their source the scope) with the
vectors of embeddings that have their id, and the turns of conversations as versions.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wrenfold.functions import redaction, render, textops, vectors
from wrenfold.operators import fusion, lexical, merge, similarity, store, versions
from wrenfold.operators.blocks import BlockIndex
from wrenfold.operators.embedders import TableEmbedder
from wrenfold.sources import records as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Texts that come in fewer splits than there are cores, as one small file does, are dealt to all."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if name == "documents" and rows.rdd.getNumPartitions() < cores else rows


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- records

RECORDS_SQL = """rec AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, string_split(text, chr(10))[1] AS title,
    CASE WHEN doc_id % 3 = 0 THEN 'resolved_failure' ELSE 'workflow' END AS kind, source || ' ' || lang AS context, text AS content,
    CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'checked by ' || lang END AS verification, [lang, source] AS tags,
    CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 10 = 1 THEN 'global' ELSE source END AS project_scope
  FROM documents
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    at = F.timestamp_seconds(F.lit(1_700_000_000) + i)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        i.cast("string").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(i % 3 == 0, "resolved_failure").otherwise("workflow").alias("kind"),
        F.concat_ws(" ", "source", "lang").alias("context"),
        F.col("text").alias("content"),
        F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("checked by "), F.col("lang"))).alias("verification"),
        F.array("lang", "source").alias("tags"),
        F.when(i % 10 == 0, None).when(i % 10 == 1, "global").otherwise(F.col("source")).alias("project_scope"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def _with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return records(spark, sf_dir).join(found, "doc_id", "left").withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))


# ---- text

#: A made-up secret for each rule, and none for the last remainder.
SECRETS = [
    "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "AKIA" + "Z" * 16,
    "aws_secret_access_key = '" + "k" * 40 + "'", "ghp_" + "d" * 36, "glpat-" + "e" * 20, "sk-" + "f" * 24, "sk-ant-" + "g" * 24, "AIza" + "h" * 35,
    "xoxb-" + "i" * 12, "Bearer " + "j" * 20, "postgres://user:pw" + "l" * 6 + "@host/db", 'password: "' + "m" * 9 + '"', "nothing",
]
VOLATILES = ["123e4567-e89b-12d3-a456-426614174000", "0xdeadbeef", "2024-05-06T07:08:09Z", "/tmp/a.b/c", ":8080", "plain"]
SIGNATURES = ["error E0382 here", "TS2322 found", "ORA-00942", "SQLSTATE 42P01", "ValueError: x", "CS1002", "NullPointerException", "none at all"]


def _pick(items: list[str], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (i % len(items)).cast("int") + 1)


def _pick_sql(items: list[str], i: str = "doc_id") -> str:
    return f"[{', '.join(map(_quoted, items))}][{i} % {len(items)} + 1]"


def _redacting_sql(select: str, tail: str = "") -> str:
    """A chain of CTEs, one a rule."""
    parts = [f"s0 AS (SELECT doc_id, source, text || ' ' || {_pick_sql(SECRETS)} AS t, 0 AS n FROM documents)"]
    for k, (pattern, marker) in enumerate(redaction.SECRET_RULES):
        for j in (1, 2):
            marker = marker.replace(f"${j}", f"\\{j}")
        parts.append(f"s{k + 1} AS (SELECT doc_id, source, regexp_replace(t, {_quoted(pattern)}, {_quoted(marker)}, 'g') AS t, n + len(regexp_extract_all(t, {_quoted(pattern)})) AS n FROM s{k})")
    return f"WITH {', '.join(parts)} SELECT {select} FROM s{len(redaction.SECRET_RULES)} {tail}"


def _redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "text", _pick(SECRETS, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", "source", redaction.redact(text).alias("r"))


@query(_redacting_sql("doc_id, md5(t) AS clean_md5, CAST(n AS INTEGER) AS n_redacted"))
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir).select("doc_id", F.md5(F.col("r.clean").cast("binary")).alias("clean_md5"), F.col("r.n").alias("n_redacted"))


@query(_redacting_sql("source, CAST(sum(n) AS BIGINT) AS n_redacted", "GROUP BY source"))
def redact_count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted(spark, sf_dir).groupBy("source").agg(F.sum("r.n").alias("n_redacted"))


def _scrub_sql(text: str) -> str:
    for pattern in redaction.VOLATILE:
        text = f"regexp_replace({text}, {_quoted(pattern)}, '', 'g')"
    return text


@query(f"SELECT doc_id, md5({_scrub_sql('text || chr(32) || ' + _pick_sql(VOLATILES))}) AS scrubbed_md5 FROM documents")
def scrub_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "text", _pick(VOLATILES, F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(redaction.scrub(text).cast("binary")).alias("scrubbed_md5"))


@query(f"SELECT doc_id, nullif(replace(lower(regexp_extract({_pick_sql(SIGNATURES)} || ' ' || text, {_quoted(redaction.SIGNATURE)})), ' ', ''), '') AS signature FROM documents")
def error_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", _pick(SIGNATURES, F.col("doc_id")), "text")
    return table(spark, sf_dir, "documents").select("doc_id", redaction.error_signature(text).alias("signature"))


_KEY_SQL = f"""coalesce(nullif(trim(project_scope), ''), 'global') || ':' || trim(regexp_replace(lower(
  CASE WHEN trim({_scrub_sql("title")}) = '' THEN title ELSE {_scrub_sql("title")} END), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '-')"""


@query(f"WITH {RECORDS_SQL} SELECT id, {_KEY_SQL} AS dedup_key FROM rec")
def dedup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("id", textops.dedup_key(F.col("project_scope"), F.col("title")).alias("dedup_key"))


@query(f"WITH {RECORDS_SQL}, k AS (SELECT doc_id, {_KEY_SQL} AS dedup_key FROM rec) SELECT dedup_key, count(*) AS n, min(doc_id) AS first_id FROM k GROUP BY dedup_key")
def exact_dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("doc_id", textops.dedup_key(F.col("project_scope"), F.col("title")).alias("dedup_key"))
    return rows.groupBy("dedup_key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def _bounded_sql(column: str, most: int) -> str:
    v = rf"regexp_replace({column}, '^\s+|\s+$', '', 'g')"
    return f"CASE WHEN {v} = '' THEN 'empty' WHEN strlen({v}) > {most} THEN 'too long: ' || strlen({v}) END"


@query(f"WITH {RECORDS_SQL} SELECT id, {_bounded_sql('title', 40)} AS title_reason, {_bounded_sql('content', 8192)} AS content_reason, {_bounded_sql('verification', 65536)} AS verification_reason FROM rec")
def validate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    bounds = {"title": 40, "content": 8192, "verification": 65536}
    return rows.select("id", *[textops.bounded(F.col(c), n)["reason"].alias(f"{c}_reason") for c, n in bounds.items()])


@query("""SELECT doc_id, array_to_string(list_distinct_in_order, ',') AS tags FROM (
  SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS list_distinct_in_order
  FROM (SELECT doc_id, [lower(lang), lower(source), lower(source)] AS t FROM documents))""")
def clean_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.concat(F.lit(" "), F.upper("lang")), F.col("source"), F.lit(" "), F.upper("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(textops.clean_tags(raw)["value"], ",").alias("tags"))


@query("""SELECT doc_id, array_to_string(list_filter(b, lambda x, i: list_position(s, lower(x)) = i), ',') AS tags FROM (
  SELECT doc_id, b, list_transform(b, lambda x: lower(x)) AS s FROM (
    SELECT doc_id, [lang, upper(source)] || [source, upper(lang), CASE WHEN doc_id % 2 = 0 THEN 'Even' ELSE 'odd' END] AS b FROM documents))""")
def tag_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = F.array(F.col("source"), F.upper("lang"), F.when(F.col("doc_id") % 2 == 0, "Even").otherwise("odd"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(textops.union_tags(F.array(F.col("lang"), F.upper("source")), new), ",").alias("tags"))


def _merge_sql(old: str, new: str) -> str:
    t = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
    return f"""CASE WHEN {t(old)} = {t(new)} OR {t(new)} = '' THEN {old} WHEN {t(old)} = '' THEN {new} WHEN contains({old}, {t(new)}) THEN {old}
    ELSE {t(old)} || chr(10) || '---' || chr(10) || 'Additional verification: ' || {t(new)} END"""


@query(f"""SELECT conv_id, turn, md5({_merge_sql('was', 'text')}) AS merged_md5 FROM (
  SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) WHERE was IS NOT NULL""")
def verification_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("was", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("was is not null")
    return rows.select("conv_id", "turn", F.md5(textops.merge_verification(F.col("was"), F.col("text")).cast("binary")).alias("merged_md5"))


@query(f"""WITH {RECORDS_SQL}, k AS (SELECT *, {_KEY_SQL} AS dedup_key FROM rec),
g AS (SELECT dedup_key, min(doc_id) AS a, max(doc_id) AS b FROM k GROUP BY dedup_key HAVING count(*) > 1)
SELECT o.id, n.title, n.kind, md5(n.content) AS content_md5, {_merge_sql('o.verification', 'n.verification')} AS verification,
  array_to_string(list_filter(o.tags || n.tags, lambda x, i: list_position(list_transform(o.tags || n.tags, lambda y: lower(y)), lower(x)) = i), ',') AS tags,
  coalesce(n.project_scope, o.project_scope) AS project_scope, n.dedup_key
FROM g JOIN k o ON o.doc_id = g.a JOIN k n ON n.doc_id = g.b""")
def smart_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last record of each key, merged."""
    rows = records(spark, sf_dir).withColumn("dedup_key", textops.dedup_key(F.col("project_scope"), F.col("title")))
    one = F.struct(*[F.col(c) for c in rows.columns])
    pairs = rows.groupBy("dedup_key").agg(F.min_by(one, "doc_id").alias("old"), F.max_by(one, "doc_id").alias("new"), F.count(F.lit(1)).alias("n")).where("n > 1")
    m = pairs.select(merge.merged(F.col("old"), F.col("new"), F.col("new.updated_at")).alias("m")).select("m.*")
    return m.select("id", "title", "kind", F.md5(F.col("content").cast("binary")).alias("content_md5"), "verification", F.array_join("tags", ",").alias("tags"), "project_scope", "dedup_key")


@query(f"WITH {RECORDS_SQL} SELECT id FROM rec WHERE list_contains(tags, 'de') AND list_contains(tags, 'src3')")
def contains_all_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(textops.has_all_tags(F.col("tags"), ["DE", "src3"])).select("id")


_PARTS_SQL = """parts AS (
  SELECT *, CASE WHEN contains(token, '_') THEN [token] || list_filter(string_split(token, '_'), lambda x: x <> '' AND x <> token)
    ELSE [token] || list_filter(string_split(regexp_replace(regexp_replace(token, '(\\p{Ll})(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu})(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g'), ' '),
      lambda x: strlen(x) > 1 AND x <> token) END AS part FROM words
)"""
#: A name in snake case and one in camel case, with an acronym, after a document's first line.
_NAMES_SQL = "source || '_' || lang || '_x ' || 'get' || upper(lang[1]) || lang[2:] || 'HTTPOf' || upper(source[1]) || source[2:]"


def _lines_with_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.concat("source", F.lit("_"), "lang", F.lit("_x get"), F.initcap("lang"), F.lit("HTTPOf"), F.initcap("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", names, F.substring_index("text", "\n", 1)).alias("q"))


@query(rf"""WITH q AS (SELECT doc_id, string_split(trim({_NAMES_SQL} || ' ' || string_split(text, chr(10))[1]), '') AS c FROM documents),
cut AS (SELECT doc_id, array_to_string(list_filter(c[1:1024], lambda x, i: strlen(array_to_string(c[1:i], '')) <= 1024), '') AS q FROM q),
words AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS place FROM (SELECT doc_id, list_filter(regexp_split_to_array(q, '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '') AS t FROM cut)),
{_PARTS_SQL}, each AS (SELECT doc_id, place * 100 + unnest(range(len(part))) AS place, unnest(part) AS term FROM parts),
once AS (SELECT doc_id, arg_min(term, place) AS term, min(place) AS place FROM each GROUP BY doc_id, lower(term)),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS n FROM once)
SELECT doc_id, string_agg(term || CASE WHEN length(term) >= 3 THEN '+' ELSE '' END, ',' ORDER BY place) AS terms FROM kept WHERE n <= 24 GROUP BY doc_id""")
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms of every document's first line, taken as a query."""
    terms = F.transform(textops.query_terms(F.col("q")), lambda t: F.concat(t["term"], F.when(t["prefix"], "+").otherwise("")))
    return _lines_with_names(spark, sf_dir).select("doc_id", F.array_join(terms, ",").alias("terms"))


@query(rf"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all({_NAMES_SQL} || ' ' || coalesce(text, ''), '[\p{{L}}\p{{N}}_]+')) AS token FROM documents),
{_PARTS_SQL} SELECT token, array_to_string(part, ',') AS parts FROM parts""")
def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of every distinct token of all texts."""
    names = F.concat("source", F.lit("_"), "lang", F.lit("_x get"), F.initcap("lang"), F.lit("HTTPOf"), F.initcap("source"))
    found = F.regexp_extract_all(F.concat_ws(" ", names, "text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    tokens = table(spark, sf_dir, "documents").select(F.explode(found).alias("token")).distinct()
    return tokens.select("token", F.array_join(textops.identifier_parts(F.col("token")), ",").alias("parts"))


@query("SELECT p_partkey, CAST(greatest(1, least(50, CASE WHEN p_size - 10 >= 0 THEN p_size - 10 ELSE 5 END)) AS INTEGER) AS n FROM part")
def limit_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", textops.limit_of(F.col("p_size") - 10).alias("n"))


# ---- keyword search

PLAIN_TERMS = [lexical.Term(("thon",), True), lexical.Term(("onthe",), True), lexical.Term(("ere",), False)]
PHRASE_TERMS = [lexical.Term(("of", "the"), False), lexical.Term(("and", "thon"), True)]
DOC_WEIGHTS = {"title": 10.0, "context": 4.0, "content": 1.0}


def _bm25_sql(weights: dict[str, float], terms: list[lexical.Term], k: int | None, base: str = "rec") -> str:
    """CTEs that end in `bm(id, score)`."""
    fields = " UNION ALL ".join(f"SELECT id, '{c}' AS col, CAST({w} AS DOUBLE) AS w, regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+') AS words FROM {base}" for c, w in weights.items())

    def match(t: lexical.Term, j: int) -> str:
        word = f"words[i + {j}]"
        return f"starts_with({word}, '{t.parts[j]}')" if t.prefix and j == len(t.parts) - 1 else f"{word} = '{t.parts[j]}'"

    found = " UNION ALL ".join(f"SELECT id, {n} AS term, sum(w) AS f FROM pos WHERE {' AND '.join(match(t, j) for j in range(len(t.parts)))} GROUP BY id" for n, t in enumerate(terms))
    tail = f"ORDER BY score, id LIMIT {k}" if k else ""
    return f"""fields AS ({fields}), sizes AS (SELECT id, sum(len(words)) AS n FROM fields GROUP BY id),
    total AS (SELECT count(*) AS nn, sum(n) / count(*) AS mean FROM sizes),
    pos AS (SELECT id, w, words, unnest(range(1, len(words) + 1)) AS i FROM fields),
    found AS ({found}), df AS (SELECT term, count(*) AS df FROM found GROUP BY term),
    idf AS (SELECT term, CASE WHEN ln((nn - df + 0.5) / (df + 0.5)) > 0 THEN ln((nn - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM df, total),
    bm AS (SELECT id, round(-sum(idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * sizes.n / mean))), 6) AS score
      FROM found JOIN idf USING (term) JOIN sizes USING (id), total GROUP BY id {tail})"""


def _bm25(spark: SparkSession, sf_dir: str, weights: dict[str, float], terms: list[lexical.Term]) -> DataFrame:
    rows = records(spark, sf_dir)
    found = lexical.postings(rows, tuple(weights), stemmed=False, fold=False, terms=terms)
    total, mean = lexical.sizes(rows, tuple(weights))
    return lexical.bm25(found, terms, weights, total, mean).select("id", F.round("score", 6).alias("score"))


@query(f"WITH {RECORDS_SQL}, {_bm25_sql({'content': 1.0}, PLAIN_TERMS[:2], 10)} SELECT id, score FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top(_bm25(spark, sf_dir, {"content": 1.0}, PLAIN_TERMS[:2]), 10)


@query(f"WITH {RECORDS_SQL}, {_bm25_sql({'content': 1.0}, PLAIN_TERMS, None)} SELECT id, score FROM bm")
def bm25_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, {"content": 1.0}, PLAIN_TERMS)


@query(f"WITH {RECORDS_SQL}, {_bm25_sql(DOC_WEIGHTS, PLAIN_TERMS, None)} SELECT id, score FROM bm")
def bm25_weighted_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, DOC_WEIGHTS, PLAIN_TERMS)


@query(f"WITH {RECORDS_SQL}, {_bm25_sql(DOC_WEIGHTS, PHRASE_TERMS, None)} SELECT id, score FROM bm")
def bm25_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir, DOC_WEIGHTS, PHRASE_TERMS)


@query()
def bm25_stemmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns, stemmed: tested against an independent engine."""
    rows = records(spark, sf_dir)
    weights = store.WEIGHTS
    terms = lexical.terms_of(spark, "threshing theEres of_the")
    found = lexical.postings(rows, tuple(weights), terms=terms)
    total, mean = lexical.sizes(rows, tuple(weights))
    return lexical.top(lexical.bm25(found, terms, weights, total, mean), 20)


BLOCK_TERMS = [*PLAIN_TERMS, *PHRASE_TERMS]


@query(f"WITH {RECORDS_SQL}, {_bm25_sql(DOC_WEIGHTS, BLOCK_TERMS, 20)} SELECT id, score FROM bm")
def keyword_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best by an index that skips blocks: built over all records, searched, and left in the shared folder."""
    index = BlockIndex(spark, _new_folder(spark, "blocks"), DOC_WEIGHTS, stemmed=False, fold=False)
    index.add(records(spark, sf_dir).select(F.col("id").alias("entry_id"), F.col("doc_id").alias("seq"), *DOC_WEIGHTS), 1)
    found = index.search(BLOCK_TERMS, 20)
    return spark.createDataFrame([(i, score) for i, _, score in found.hits], "id string, score double").withColumn("score", F.round("score", 6))


def _new_folder(spark: SparkSession, name: str) -> str:
    """A folder that driver and executors share, from spark.checkpoint.dir; a local session without one gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        folder = "file://" + tempfile.mkdtemp(prefix="wrenfold-")
    return f"{folder.rstrip('/')}/wrenfold/{name}-{uuid.uuid4().hex}"


# ---- vectors


def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


_VECTORS_SQL = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("project_scope"), "embedding")


@query(f"WITH {_VECTORS_SQL} SELECT vec_id AS id, round(list_dot_product(x, (SELECT x FROM v WHERE vec_id = 0)), 6) AS score FROM v ORDER BY list_dot_product(x, (SELECT x FROM v WHERE vec_id = 0)) DESC, vec_id LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.vector_top(_vectors(spark, sf_dir), _vector(spark, sf_dir, 0), 10, floor=-1.0)
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"""WITH {_VECTORS_SQL}, s AS (SELECT vec_id AS id, list_dot_product(x, (SELECT x FROM v WHERE vec_id = 0)) AS s FROM v
  WHERE label = (SELECT label FROM v WHERE vec_id = 0)) SELECT id, round(s, 6) AS score FROM (SELECT * FROM s ORDER BY s DESC, id LIMIT 50) WHERE s >= 0.35""")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope = table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["label"]
    found = similarity.vector_top(_vectors(spark, sf_dir), _vector(spark, sf_dir, 0), 50, scope=str(scope))
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_VECTORS_SQL} SELECT vec_id, CAST(k AS INTEGER) AS k, n AS norm, round(e / s, 6) AS x FROM (SELECT vec_id, round(sqrt(list_dot_product(x, x)), 6) AS n, sqrt(list_dot_product(x, x)) AS s, unnest(x) AS e, unnest(range(len(x))) AS k FROM v)")
def vector_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.length(v), 6).alias("norm"), F.posexplode(vectors.normalise(v)).alias("k", "x"))
    return rows.withColumn("x", F.round("x", 6))


@query(f"""WITH {_VECTORS_SQL}, n AS (SELECT *, sqrt(list_dot_product(x, x)) AS n FROM v)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.x, b.x) / (a.n * b.n), 6) AS cosine FROM n a JOIN n b ON a.vec_id < b.vec_id
WHERE list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.35""")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("id", F.lit(None).cast("string").alias("scope"), F.col("embedding").alias("vector"))
    return similarity.cosine_pairs(rows, 0.35).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {_VECTORS_SQL}, i AS (SELECT vec_id, label, list_transform(x, lambda e, k: e + 0.01 * ((k - 1 + vec_id) % 3)) AS x FROM v),
p AS (SELECT i.vec_id AS id, v.vec_id AS match, row_number() OVER (PARTITION BY i.vec_id ORDER BY v.vec_id DESC) AS r FROM i JOIN v ON i.label = v.label
WHERE list_dot_product(i.x, v.x) / sqrt(list_dot_product(i.x, i.x) * list_dot_product(v.x, v.x)) >= 0.92) SELECT id, match FROM p WHERE r = 1""")
def near_duplicate_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).select("id", F.col("project_scope").alias("scope"), F.col("embedding").cast("array<double>").alias("vector"))
    moved = F.transform("vector", lambda e, k: e + F.lit(0.01).cast("double") * ((k + F.col("id")) % 3))
    return similarity.near_duplicates(rows.withColumn("vector", moved), rows.withColumn("updated_at", F.timestamp_seconds("id")))


@query("""WITH b AS (SELECT doc_id, hex(encode(text)) AS h, unnest(range(strlen(text))) AS i FROM documents),
s AS (SELECT doc_id, i % 32 AS k, sum(CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2)) AS INTEGER)) AS s FROM b GROUP BY doc_id, i % 32),
n AS (SELECT doc_id, sqrt(sum(s * s)) AS n FROM s GROUP BY doc_id) SELECT doc_id, CAST(k AS INTEGER) AS k, round(s / n, 6) AS x FROM s JOIN n USING (doc_id) WHERE s > 0""")
def mock_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(vectors.bucket_embedding(F.col("text"))).alias("k", "x"))
    return rows.where("x > 0").select("doc_id", "k", F.round("x", 6).alias("x"))


@query(f"""WITH {_VECTORS_SQL}, n AS (SELECT count(*) AS n FROM v), t AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[a-zA-Z]+')) AS w FROM conversations),
e AS (SELECT conv_id, turn, x FROM t, n JOIN v ON vec_id = (ascii(w) * 7 + length(w)) % n),
c AS (SELECT conv_id, turn, unnest(x) AS x, unnest(range(64)) AS k FROM e)
SELECT conv_id, turn, CAST(k AS INTEGER) AS k, round(avg(x), 6) AS x FROM c GROUP BY conv_id, turn, k""")
def mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    words = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]+"), F.lit(0))).alias("w"))
    tokens = words.select("id", ((F.ascii("w") * 7 + F.length("w")) % e.count()).cast("long").alias("token"))
    # letters times lengths are few, however many vectors there are
    used = e.select(F.col("vec_id").alias("token"), "embedding").join(tokens.select("token").distinct(), "token", "left_semi")
    found = vectors.pooled(tokens, used, "id", "token", "embedding", unit=False, small=True, width=e.agg(F.max(F.size("embedding"))).first()[0])
    cells = found.select("id.conv_id", "id.turn", F.posexplode("vector").alias("k", "x"))
    return cells.select("conv_id", "turn", "k", F.round("x", 6).alias("x"))


TURN_QUERY = "how do I restore a backup of the table"


@query(f"""WITH {_VECTORS_SQL}, n AS (SELECT count(*) AS n FROM v), q AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1, -1, {_quoted(TURN_QUERY)}),
w AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM q),
t AS (SELECT conv_id, turn, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % n AS token, count(*) AS c FROM w, n GROUP BY ALL),
e AS (SELECT conv_id, turn, c, unnest(x) AS x, unnest(range(len(x))) AS k FROM t JOIN v ON vec_id = token),
s AS (SELECT conv_id, turn, k, sum(c * x) AS s FROM e GROUP BY conv_id, turn, k),
u AS (SELECT conv_id, turn, k, CAST(CAST(s / sqrt(sum(s * s) OVER (PARTITION BY conv_id, turn)) AS FLOAT) AS DOUBLE) AS x FROM s),
d AS (SELECT a.conv_id, a.turn, sum(a.x * b.x) AS s FROM u a JOIN u b ON a.k = b.k AND b.conv_id = -1 GROUP BY a.conv_id, a.turn)
SELECT conv_id, turn, round(coalesce(s, 0), 6) AS score FROM conversations LEFT JOIN d USING (conv_id, turn)""")
def table_embedder_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's nearness to a query, both embedded by a table of token vectors."""
    e = table(spark, sf_dir, "embeddings")
    n = e.count()
    words = lambda text: F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    tokens = lambda text: F.transform(words(text), lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % n)
    model = TableEmbedder(e.select(F.col("vec_id").alias("token"), F.col("embedding").alias("vector")), tokens)
    asked = model.add(spark.range(1), F.lit(TURN_QUERY)).first()["embedding"]
    turns = model.add(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), F.col("text"))
    score = vectors.dot(F.col("embedding"), F.array(*[F.lit(x) for x in asked]))
    return turns.select("conv_id", "turn", F.round(score, 6).alias("score"))


@query("SELECT vec_id, len(embedding) * 4 AS n_bytes, md5(array_to_string(list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT)), ',')) AS md5 FROM embeddings")
def bytes_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.to_bytes("embedding").alias("b"))
    rows = rows.select("vec_id", F.octet_length("b").cast("long").alias("n_bytes"), vectors.from_bytes("b").alias("v"))
    whole = F.transform("v", lambda x: F.round(x * F.lit(1000).cast("float")).cast("long").cast("string"))
    return rows.select("vec_id", "n_bytes", F.md5(F.array_join(whole, ",").cast("binary")).alias("md5"))


# ---- hybrid search

_HYBRID_SQL = f"""WITH {RECORDS_SQL}, {_bm25_sql(DOC_WEIGHTS, PLAIN_TERMS, 50)}, {_VECTORS_SQL},
lex AS (SELECT id, row_number() OVER (ORDER BY score, id) AS keyword_rank FROM bm),
dots AS (SELECT CAST(vec_id AS VARCHAR) AS id, list_dot_product(x, (SELECT x FROM v WHERE vec_id = 0)) AS s FROM v WHERE vec_id IN (SELECT doc_id FROM documents)),
sem AS (SELECT id, row_number() OVER (ORDER BY s DESC, id) AS semantic_rank FROM (SELECT * FROM dots ORDER BY s DESC, id LIMIT 50) WHERE s >= 0.35),
fused AS (SELECT id, keyword_rank, semantic_rank, coalesce(1.0 / (20.0 + keyword_rank), 0) + coalesce(1.0 / (20.0 + semantic_rank), 0) AS s FROM lex FULL OUTER JOIN sem USING (id))"""


def _hybrid(spark: SparkSession, sf_dir: str, vector: bool, **options: object) -> DataFrame:
    rows = records(spark, sf_dir)
    found = lexical.postings(rows, tuple(DOC_WEIGHTS), stemmed=False, fold=False, terms=PLAIN_TERMS)
    total, mean = lexical.sizes(rows, tuple(DOC_WEIGHTS))
    return fusion.hybrid(rows, found, PLAIN_TERMS, DOC_WEIGHTS, total, mean, _vector(spark, sf_dir, 0) if vector else None, vectors=_record_vectors(spark, sf_dir), **options)


def _record_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding) of the records that have a vector, with nothing else of them."""
    held = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    return found.join(held, "id", "left_semi")


def _hits(found: DataFrame) -> DataFrame:
    ranks = [F.col(c).cast("long").alias(c) for c in ("keyword_rank", "semantic_rank")]
    return found.select("id", "title", *ranks, F.round("score", 6).alias("score"), "ranking")


@query(f"{_HYBRID_SQL} SELECT id, keyword_rank, semantic_rank, round(s, 6) AS score FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword = fusion.ranked(lexical.top(_bm25(spark, sf_dir, DOC_WEIGHTS, PLAIN_TERMS), 50), "keyword", False)
    semantic = fusion.ranked(similarity.vector_top(_record_vectors(spark, sf_dir), _vector(spark, sf_dir, 0), 50), "semantic", True)
    return fusion.fuse(keyword, semantic).select("id", F.col("keyword_rank").cast("long"), F.col("semantic_rank").cast("long"), F.round("score", 6).alias("score"))


@query(f"""{_HYBRID_SQL}, won AS (SELECT * FROM fused ORDER BY s DESC, id LIMIT 5)
SELECT id, title, keyword_rank, semantic_rank, round(s, 6) AS score, 'reciprocal_rank_fusion' AS ranking FROM won JOIN rec USING (id)""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(_hybrid(spark, sf_dir, True, limit=5))


@query(f"""WITH {RECORDS_SQL}, {_bm25_sql(DOC_WEIGHTS, PLAIN_TERMS, 500)}, lex AS (SELECT id, row_number() OVER (ORDER BY score, id) AS keyword_rank FROM bm),
won AS (SELECT * FROM lex ORDER BY keyword_rank LIMIT 50) SELECT id, title, keyword_rank, CAST(NULL AS BIGINT) AS semantic_rank, round(1.0 / (20.0 + keyword_rank), 6) AS score,
'lexical_only' AS ranking FROM won JOIN rec USING (id) WHERE project_scope = 'global'""")
def lexical_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a vector; the scope filters after the cut, so fewer than `limit` may come back."""
    return _hits(_hybrid(spark, sf_dir, False, limit=50, scope="global"))


@query(f"{_HYBRID_SQL} SELECT (SELECT count(*) FROM lex) + (SELECT count(*) FROM sem) AS candidate_count")
def hybrid_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyword = lexical.top(_bm25(spark, sf_dir, DOC_WEIGHTS, PLAIN_TERMS), 50)
    return fusion.candidate_count(keyword, similarity.vector_top(_record_vectors(spark, sf_dir), _vector(spark, sf_dir, 0), 50))


# ---- a store

_SAVES_SQL = """saves AS (
  SELECT doc_id AS seq, 'about ' || lang AS title, 'doc ' || md5(coalesce(text, '')) AS content, 'seen in <' || source || '>' AS verification, [lang, source] AS tags,
    CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE 'k' || doc_id % 97 END AS key FROM documents
)"""


@query(f"""WITH {_SAVES_SQL}, n AS (SELECT key, count(*) AS n, arg_max(title, seq) AS title, arg_max(content, seq) AS content FROM saves GROUP BY key),
proof AS (SELECT key, string_agg(verification, chr(10) || '---' || chr(10) || 'Additional verification: ' ORDER BY seq) AS verification
  FROM (SELECT key, verification, min(seq) AS seq FROM saves GROUP BY key, verification) GROUP BY key),
tag AS (SELECT key, string_agg(tag, ',' ORDER BY seq, i) AS tags FROM (SELECT key, tag, min(seq) AS seq, arg_min(i, seq) AS i
  FROM (SELECT key, seq, unnest(tags) AS tag, unnest([1, 2]) AS i FROM saves) GROUP BY key, tag) GROUP BY key)
SELECT key AS dedup_key, title, content, verification, tags, n - 1 AS revisions FROM n JOIN proof USING (key) JOIN tag USING (key)""")
def store_batch_save(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents saved as one batch, a third of them under one key; the records and their numbers of revisions."""
    kb = _saved(spark, sf_dir)
    revisions = versions.history(kb.log()).groupBy("id").agg(F.count(F.lit(1)).alias("revisions"))
    found = kb.current().join(revisions, "id", "left")
    return found.select("dedup_key", "title", "content", "verification", F.array_join("tags", ",").alias("tags"), F.coalesce("revisions", F.lit(0)).cast("long").alias("revisions"))


@query(f"""WITH {_SAVES_SQL} SELECT key AS dedup_key, arg_max(title, seq) AS title, arg_max(content, seq) AS content, (SELECT count(*) - count(DISTINCT key) FROM saves) AS total_revisions
FROM saves WHERE key IN ('hot', 'k5', 'k96') GROUP BY key""")
def store_point_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three records by key, read again by id, and the store's number of revisions; one further key is held by none."""
    kb = _saved(spark, sf_dir)
    found = [r["id"] for key in ("hot", "k5", "k96", "k97") for r in kb.get_by_key(key).select("id").collect()]
    rows = reduce(DataFrame.unionByName, [kb.get(i) for i in found])
    return rows.join(kb.stats()).select("dedup_key", "title", "content", F.col("total_history_revisions").alias("total_revisions"))


def _saved(spark: SparkSession, sf_dir: str) -> store.KnowledgeStore:
    """A store in a new folder with all documents saved as one batch."""
    kb = store.KnowledgeStore(spark, _new_folder(spark, "store"), embed=None)
    i, none = F.col("doc_id"), F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents")
    kb.save(docs.select(
        i.alias("seq"), F.concat(F.lit("about "), "lang").alias("title"), F.lit("workflow").alias("kind"), F.col("lang").alias("context"),
        F.concat(F.lit("doc "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("content"), F.format_string("seen in <%s>", "source").alias("verification"),
        F.array("lang", "source").alias("tags"), none.alias("project_scope"), none.alias("entry_id"),
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (i % 97).cast("string"))).alias("dedup_key"),
    ))
    return kb


# ---- versions

_LOG_SQL = "log AS (SELECT conv_id AS entry_id, turn AS seq, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) == 1
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("entry_id"), F.col("turn").alias("seq"), F.when(first, "insert").otherwise("update").alias("op"), F.timestamp_seconds("turn").alias("at"), "text", "role"
    )


@query(f"WITH {_LOG_SQL} SELECT entry_id, seq, role, md5(text) AS text_md5 FROM log WHERE next IS NULL")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.current(_log(spark, sf_dir)).select("entry_id", "seq", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {_LOG_SQL} SELECT entry_id, CAST(version AS INTEGER) AS version, 'update' AS operation, role, md5(text) AS text_md5, next AS at_s FROM log WHERE next IS NOT NULL")
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.history(_log(spark, sf_dir)).select("entry_id", "version", "operation", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.unix_seconds("timestamp").alias("at_s"))


@query(f"WITH {_LOG_SQL} SELECT entry_id, CAST(max(version) AS INTEGER) AS version FROM log GROUP BY entry_id HAVING count(*) > 1")
def reindex_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number under which a re-embedding of every entry files its present state."""
    return versions.next_version(_log(spark, sf_dir))


@query(f"WITH {_LOG_SQL} SELECT entry_id, role, md5(text) AS text_md5 FROM log WHERE version = 1 AND next IS NOT NULL")
def rollback_to_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after every entry that has a first version was brought back to it."""
    log = _log(spark, sf_dir)
    wanted = log.groupBy("entry_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entry_id", F.lit(1).alias("version"))
    writes = versions.rolled_back(log, wanted, F.timestamp_seconds(F.lit(10**9)), F.lit(10**9).cast("long"))
    after = versions.current(versions.appended(log, writes)).join(wanted, "entry_id", "left_semi")
    return after.select("entry_id", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {_LOG_SQL} SELECT entry_id, md5(text) AS text_md5 FROM log WHERE next IS NULL AND entry_id % 3 <> 0")
def delete_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    gone = log.select("entry_id").distinct().where("entry_id % 3 = 0").withColumns({"seq": F.lit(10**9).cast("long"), "op": F.lit("delete"), "at": F.timestamp_seconds(F.lit(10**9))})
    return versions.current(versions.appended(log, gone)).select("entry_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 2 * o_totalprice ELSE o_totalprice END AS price FROM orders
WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0""")
def upsert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even orders are there; those divisible by three come in at twice the price."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("price"))
    return versions.upsert(orders.where("o_orderkey % 2 = 0"), orders.where("o_orderkey % 3 = 0").withColumn("price", 2 * F.col("price")), "o_orderkey")


@query(f"""WITH {RECORDS_SQL}, g AS (SELECT project_scope, count(*) AS n FROM rec GROUP BY project_scope)
SELECT coalesce(project_scope, 'global') AS scope, n, (SELECT count(*) FROM rec) AS total_entries, (SELECT count(*) - count(DISTINCT conv_id) FROM conversations) AS total_history_revisions,
EXISTS (SELECT 1 FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) AS semantic_active FROM g""")
def stats_by_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries, with the vectors that they have, and all but the first turns of conversations as revisions."""
    one = store.stats(_with_vectors(spark, sf_dir), versions.history(_log(spark, sf_dir)))
    others = ["total_entries", "total_history_revisions", "semantic_active"]
    return one.select(*others, F.inline("projects")).select("scope", "n", *others)


@query(f"WITH {RECORDS_SQL} SELECT id, title, coalesce(project_scope, 'global') AS scope, substr(content, 1, 120) AS head FROM rec ORDER BY doc_id DESC LIMIT 20")
def recent_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).orderBy(F.desc("updated_at"), "id").limit(20)
    return rows.select("id", "title", render.scope_label(F.col("project_scope")).alias("scope"), F.substring("content", 1, 120).alias("head"))


@query(f"WITH {RECORDS_SQL} SELECT id, title, md5(content) AS content_md5 FROM rec WHERE id = '17'")
def get_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where("doc_id = 17").select("id", "title", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"WITH {RECORDS_SQL}, k AS (SELECT id, {_KEY_SQL} AS dedup_key FROM rec) SELECT id, dedup_key FROM k WHERE dedup_key = (SELECT dedup_key FROM k WHERE id = '3')")
def get_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).select("id", textops.dedup_key(F.col("project_scope"), F.col("title")).alias("dedup_key"))
    key = rows.where("id = '3'").first()["dedup_key"]
    return rows.where(F.col("dedup_key") == key)


# ---- files and rendering


@query(f"WITH {RECORDS_SQL} SELECT id, title, project_scope, md5(content) AS content_md5, CAST(len(tags) AS INTEGER) AS n_tags FROM rec")
def import_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as lines of JSON and parsed again by the same schema."""
    rows = records(spark, sf_dir).withColumn("dedup_key", F.lit(None).cast("string"))
    lines = rows.select(sources.to_json(rows).alias("value"))
    back = sources.imported(lines.select(F.from_json("value", sources.RECORD, {"mode": "FAILFAST"}).alias("r")).select("r.*"))
    return back.select("id", "title", "project_scope", F.md5(F.col("content").cast("binary")).alias("content_md5"), F.size("tags").alias("n_tags"))


@query(f"""WITH {RECORDS_SQL} SELECT id, json_extract_string(j, '$.title') AS title, json_extract_string(j, '$.project_scope') AS project_scope, false AS has_key FROM
(SELECT id, json_object('title', title, 'project_scope', project_scope) AS j FROM rec)""")
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).withColumn("dedup_key", F.lit(None).cast("string"))
    lines = rows.select("id", sources.to_json(rows).alias("j"))
    return lines.select("id", F.get_json_object("j", "$.title").alias("title"), F.get_json_object("j", "$.project_scope").alias("project_scope"), F.contains("j", F.lit('"dedup_key"')).alias("has_key"))


def _columns(rows: DataFrame) -> dict[str, Column]:
    return {c: rows[c] for c in rows.columns}


@query(f"""WITH {RECORDS_SQL} SELECT id, md5('# ' || title || chr(10) || chr(10) || '- **Kind:** ' || kind || chr(10) || '- **Scope:** ' || coalesce(project_scope, 'global') || chr(10)
|| '- **Tags:** ' || array_to_string(tags, ', ') || chr(10) || chr(10) || '## Context' || chr(10) || context || chr(10) || chr(10) || '## Resolution' || chr(10) || content || chr(10) || chr(10)
|| '## Verification' || chr(10) || verification || chr(10)) AS markdown_md5 FROM rec""")
def render_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return rows.select("id", F.md5(render.entry(_columns(rows)).cast("binary")).alias("markdown_md5"))


@query(f"""WITH {RECORDS_SQL} SELECT id, '1. **' || title || '** (`' || kind || '`) - ID: `' || id || '`' || chr(10) || '   - **Scope:** `' || coalesce(project_scope, 'global')
|| '` | **Tags:** `' || array_to_string(tags, ', ') || '`' || chr(10) || '   - **Context:** ' || substr(context, 1, 100) || chr(10) || '   - **Fix:** ' || substr(content, 1, 120) || chr(10) || chr(10) AS markdown FROM rec""")
def render_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return rows.select("id", render.compact(F.lit(1), _columns(rows)).alias("markdown"))


@query("SELECT source, count(*) FILTER (strlen(text) <= 4096) AS within, count(*) FILTER (strlen(text) > 4096) AS beyond FROM documents GROUP BY source")
def bounded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    within, beyond = sources.bounded_lines(table(spark, sf_dir, "documents"), "text", 4096)
    return _by_source(within, "within").join(_by_source(beyond, "beyond"), "source", "full_outer").select("source", F.coalesce("within", F.lit(0)).alias("within"), F.coalesce("beyond", F.lit(0)).alias("beyond"))


def _by_source(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias(name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hybrid_search(spark, sf_dir)
