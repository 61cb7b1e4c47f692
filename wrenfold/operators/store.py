"""The knowledge store: a dataset folder with an append-only log, and what is done with it.

A write appends one folder of Parquet to the log under a number that it claims by making a file that must be new, so
the second of two writers takes the next one. Readers see the folders that are written to their end, and no other; the
state is a plan over them. The keyword index (`blocks`), the vector index (`vector_blocks`) and the counts have a part
for each write, made after it; a search or write first makes what a writer that stopped has left out. A search carries
numbers, scopes and tags, and reads texts for its winners alone.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce
from urllib.parse import unquote, urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType, TimestampType

from wrenfold.functions.redaction import redact
from wrenfold.functions.textops import bounded, clean_tags, dedup_key, embed_text, has_all_tags, head_bytes, kind_or
from wrenfold.functions.vectors import bucket_embedding
from wrenfold.functions import render
from wrenfold.operators import batches, fusion, lexical, versions
from wrenfold.operators.blocks import BlockIndex
from wrenfold.operators.embedders import Embedder, embedder
from wrenfold.operators.vector_blocks import VectorIndex
from wrenfold.sources.records import export_array, export_lines, imported
from wrenfold.schema import LIMITS, RANK_CONSTANT, RECORD, SCORE_FLOOR, VECTOR, WEIGHTS

LOG = StructType([StructField("entry_id", StringType()), StructField("seq", LongType()), StructField("op", StringType()), StructField("at", TimestampType()), *RECORD.fields, VECTOR, StructField("n_tokens", IntegerType()), StructField("source", StringType()), StructField("batch", IntegerType())])
#: Columns of the log that are no part of a record.
COUNTS = "project_scope string, n long, vectors long, revisions long"
LOG_ONLY = ("entry_id", "seq", "op", "at", "n_tokens", "source", "batch")
TEXTS = ("title", "context", "content", "verification")
#: Folders that a dataset may not lie in. Fixed values.
SYSTEM_FOLDERS = ("/etc", "/dev", "/proc", "/sys", "/bin", "/sbin", "/usr/bin", "/usr/sbin", "/System", "/Library", "/private/etc", "/var/run")
PRIVATE_FOLDERS = (".ssh", ".gnupg", ".aws", ".docker", ".bashrc", ".zshrc", ".gitconfig")


def checked_root(root: str) -> str:
    """The dataset's folder, or ValueError for blanks, `..`, system folders and private ones of a home."""
    if not root.strip():
        raise ValueError("the folder is blank")
    uri = urlsplit(root)
    path = unquote(uri.path) if uri.scheme else root  # file:/x and file://host/x name the path /x as well
    parts = path.split("/")
    if ".." in parts:
        raise ValueError("the folder has `..`")
    if path.startswith(SYSTEM_FOLDERS) or any(p.startswith(PRIVATE_FOLDERS) for p in parts):
        raise ValueError("the folder is a system's or private")
    return root.rstrip("/")


def default_embedder(text: Column) -> Column:
    return bucket_embedding(head_bytes(text)).cast("array<float>")


class KnowledgeStore:
    """embed: an embedder, a column expression from text to a vector, or None for keyword search alone."""

    def __init__(self, spark: SparkSession, root: str, embed: Embedder | Callable[[Column], Column] | None = default_embedder):
        self.spark, self.root, self.embed = spark, checked_root(root), embedder(embed)

    def _exists(self, name: str = "log") -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _batches(self, name: str) -> list[int]:
        """Numbers of the folders that are written to their end."""
        if not self._exists(name):
            return []
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/batch=*/_SUCCESS")
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found)

    def log(self) -> DataFrame:
        """Rows of the folders that are written to their end."""
        found = [f"{self.root}/log/batch={b}" for b in self._batches("log")]
        if not found:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).option("basePath", f"{self.root}/log").parquet(*found)

    def _claim(self, batch: int) -> int:
        """The first number from batch on that no writer has taken, taken by this one."""
        while True:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{batch}")
            try:
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, False).close()
                return batch
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                batch += 1

    def _append(self, writes: DataFrame, source: str | None = None) -> None:
        last = self.log().agg(F.max("batch"), F.max("seq")).first()
        batch, seq = self._claim((last[0] or 0) + 1), last[1] or 0
        rows = writes.withColumns({"seq": F.col("seq") + F.lit(seq + 1), "n_tokens": lexical.length(writes, tuple(WEIGHTS)), "source": F.lit(source)})
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in LOG.fields if f.name != "batch"]).sortWithinPartitions("entry_id", "seq")
        # Bloom filters and the order let point reads skip row groups
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("entry_id", "dedup_key")}
        rows.write.options(**blooms).parquet(f"{self.root}/log/batch={batch}")
        self.index_missing()

    def index(self) -> BlockIndex:
        return BlockIndex(self.spark, f"{self.root}/index", WEIGHTS)

    def vectors(self) -> VectorIndex:
        return VectorIndex(self.spark, f"{self.root}/vectors")

    def index_missing(self) -> None:
        """Indexes the folders of the log that no segment covers, and merges segments."""
        index, vectors = self.index(), self.vectors()
        held, kept = set(index.batches()), set(vectors.batches())
        missing = sorted(set(self._batches("log")) - (held & kept))
        for batch in missing:
            log = self.log()
            new = log.where(F.col("batch") == batch)
            narrow = log.select("entry_id", "seq", "op", "batch", "project_scope", (F.size("embedding") > 0).cast("long").alias("vectors"))
            # what the batch replaces or deletes: rows that were current before it, and its own but the last of an entry
            before = versions.live(narrow.where(F.col("batch") < batch), "project_scope", "vectors")
            last = narrow.where(F.col("batch") == batch).groupBy("entry_id").agg(F.max("seq").alias("last"))
            before = before.join(last, "entry_id", "left_semi")
            self._count(narrow, before, batch)
            gone = before.select("entry_id", "seq")
            own = narrow.where(F.col("batch") == batch).join(last, "entry_id").where("seq < last").select("entry_id", "seq")
            gone = gone.unionByName(own)
            if batch not in kept:
                vectors.add(new.where("op <> 'delete'"), batch, gone)
            if batch not in held:
                index.add(new.where("op <> 'delete'"), batch, gone)
        if missing:
            index.compact()

    def _count(self, narrow: DataFrame, before: DataFrame, batch: int) -> None:
        """Writes what a batch adds to the counts by scope, and to the number of revisions."""
        new = narrow.where(F.col("batch") == batch)
        after = versions.live(new, "project_scope", "vectors").select("project_scope", "vectors", F.lit(1).alias("n"))
        less = before.select("project_scope", (-F.col("vectors")).alias("vectors"), F.lit(-1).alias("n"))
        scopes = after.unionByName(less).groupBy("project_scope").agg(F.sum("n").alias("n"), F.sum("vectors").alias("vectors"))
        # every state of an entry but its first overwrote one
        states = new.where("op <> 'delete'").select("entry_id")
        first = states.distinct().join(narrow.where((F.col("batch") < batch) & (F.col("op") != "delete")).select("entry_id"), "entry_id", "left_anti")
        both = states.select(F.lit(1).alias("r")).unionByName(first.select(F.lit(-1).alias("r"))).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("revisions"))
        rows = scopes.withColumn("revisions", F.lit(0).cast("long")).unionByName(both, allowMissingColumns=True)
        rows.select(*[F.col(c).cast(t) for c, t in (f.split() for f in COUNTS.split(", "))]).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counts/batch={batch}")

    # reads

    def current(self, vectors: bool = False) -> DataFrame:
        """Records, with their vectors if asked for."""
        log = self.log()
        return versions.current(log if vectors else log.drop("embedding")).drop(*LOG_ONLY)

    def all(self, scope: str | None = None, tags: list[str] = []) -> DataFrame:  # noqa: B006
        """Records, the latest first."""
        rows = self.current()
        if scope is not None:
            rows = rows.where(F.col("project_scope") == scope)
        if tags:
            rows = rows.where(has_all_tags(F.col("tags"), tags))
        return rows.orderBy(F.desc("updated_at"), "id")

    def get(self, entry_id: str, vectors: bool = False) -> DataFrame:
        found = versions.current(self.log().where(F.col("entry_id") == entry_id)).drop(*LOG_ONLY)
        return found if vectors else found.drop("embedding")

    def get_by_key(self, key: str) -> DataFrame:
        """The record that holds a key: its entry is found by the key's Bloom filters, and read by the entry's."""
        log = self.log().drop("embedding")
        held = log.where(F.col("dedup_key") == key).select("entry_id").distinct()
        some = [r["entry_id"] for r in held.limit(101).collect()]
        # a key that more entries have held is found by a join
        rows = log.where(F.col("entry_id").isin(some)) if len(some) <= 100 else log.join(held, "entry_id", "left_semi")
        return versions.current(rows).drop(*LOG_ONLY).where(F.col("dedup_key") == key)

    def history(self, entry_id: str) -> DataFrame:
        return versions.history(self.log().where(F.col("entry_id") == entry_id)).drop("n_tokens", "source").orderBy(F.desc("version"))

    def revision(self, entry_id: str, version: int) -> DataFrame:
        """One overwritten state, or no row."""
        return self.history(entry_id).where(F.col("version") == version)

    def holds(self, source: str) -> bool:
        """Whether a batch of that source is in the log."""
        return not self.log().where(F.col("source") == source).isEmpty()

    def recent(self, n: int = 20) -> DataFrame:
        return self.all().limit(n)

    def stats(self) -> DataFrame:
        """As stats(), summed from what each batch has added."""
        self.index_missing()
        found = [f"{self.root}/counts/batch={b}" for b in self._batches("log")]
        rows = self.spark.read.schema(COUNTS).parquet(*found) if found else self.spark.createDataFrame([], COUNTS)
        by_scope = rows.where("n is not null").groupBy("project_scope").agg(F.sum("n").alias("n"), F.sum("vectors").alias("vectors")).where("n > 0")
        return _report(by_scope, rows.agg(F.coalesce(F.sum("revisions"), F.lit(0)).alias("total_history_revisions")))

    def search(self, query: str, limit: int = 5, scope: str | None = None, tags: list[str] = [], prefilter: bool = False) -> DataFrame:  # noqa: B006
        """The `limit` (1 to 50) best records for a query; scope, tags and prefilter as in fusion.hybrid."""
        return self.search_with_report(query, limit, scope, tags, prefilter)[0]

    def search_with_report(self, query: str, limit: int = 5, scope: str | None = None, tags: list[str] = [], prefilter: bool = False) -> tuple[DataFrame, dict[str, float]]:  # noqa: B006
        """search(), and its candidates of both sides, milliseconds by phase, and blocks that match and were scored.

        Between the phases go ids, numbers, scopes and tags: of `candidates(limit)` rows a side at most, 500.
        """
        limit = min(50, max(1, limit))
        k = fusion.candidates(limit)
        clock = [time.perf_counter()]
        lap = lambda: (clock.append(time.perf_counter()), 1000 * (clock[-1] - clock[-2]))[1]
        vector = None
        if self.embed is not None:
            vector = self.embed.add(self.spark.range(1), F.lit(query), "v").first()["v"]
        report = {"embedding_ms": lap()}
        self.index_missing()
        found = self.index().search(lexical.terms_of(self.spark, query), k)
        keyword = {i: (rank, score, seq) for rank, (i, seq, score) in enumerate(found.hits, 1)}
        report |= {"keyword_ms": lap(), "blocks": found.blocks, "scored_blocks": found.scored_blocks}
        near = self.vectors().search(vector or [], k, SCORE_FLOOR, scope, tags)
        semantic = {i: (rank, score, seq) for rank, (i, seq, score) in enumerate(near.hits, 1)}
        report |= {"vector_ms": lap(), "vector_blocks": near.blocks, "scored_vector_blocks": near.scored_blocks, "candidate_count": len(keyword) + len(semantic)}

        scores = {i: sum(1.0 / (RANK_CONSTANT + side[i][0]) for side in (keyword, semantic) if i in side) for i in keyword.keys() | semantic.keys()}
        order = sorted(scores, key=lambda i: (-scores[i], i))
        if not prefilter:
            order = order[:limit]
        fits = F.lit(True) if scope is None else F.coalesce(F.col("project_scope") == scope, F.lit(False))
        if scope is not None or tags:
            if tags:
                fits &= has_all_tags(F.col("tags"), tags)
            narrow = self.log().where(F.col("entry_id").isin(order)).select("entry_id", "seq", "project_scope", "tags")
            seqs = self.spark.createDataFrame([(i, (keyword.get(i) or semantic[i])[2]) for i in order], "entry_id string, seq long")
            left = {r["entry_id"] for r in narrow.join(F.broadcast(seqs), ["entry_id", "seq"]).where(fits).select("entry_id").collect()}
            order = [i for i in order if i in left][:limit]
        none = (None, None, None)
        label = "reciprocal_rank_fusion" if vector is not None else "lexical_only"
        rows = [
            (i, (keyword.get(i) or semantic[i])[2], *keyword.get(i, none)[:2], *semantic.get(i, none)[:2], scores[i], label, place)
            for place, i in enumerate(order, 1)
        ]
        won = self.spark.createDataFrame(rows, "entry_id string, seq long, keyword_rank int, keyword_score double, semantic_rank int, semantic_score double, score double, ranking string, place int")
        records = self.log().where(F.col("entry_id").isin(order)).drop("embedding", *[c for c in LOG_ONLY if c not in ("entry_id", "seq")])
        report["fusion_ms"] = lap()
        return records.join(F.broadcast(won), ["entry_id", "seq"]).drop("entry_id", "seq"), report

    # writes

    def save(self, saves: DataFrame, at: Column | None = None, source: str | None = None) -> DataFrame:
        """Saves a batch of (seq, title, kind, context, content, verification, tags, project_scope, entry_id, dedup_key).

        seq is the batch's own order, and no two rows share one. source: a name of the batch that holds() finds.
        Returns (seq, entry_id, reason, deduplicated, merged, secrets_redacted); a row with a reason is not saved.
        """
        at = at if at is not None else F.current_timestamp()
        checked = prepare(saves, self.embed).withColumn("now", at)
        known = self.current(vectors=True)
        # resolved once and staged, so that report and log agree on new ids and times
        scratch = f"{self.root}/saves/{uuid.uuid4().hex}"
        checked.write.parquet(f"{scratch}/checked")
        checked = self.spark.read.schema(checked.schema).parquet(f"{scratch}/checked")
        resolved = batches.resolve(checked, known, scratch)
        resolved.write.parquet(f"{scratch}/plan")
        plan = self.spark.read.schema(resolved.schema).parquet(f"{scratch}/plan")
        self._append(batches.fold(plan.where("reason is null"), known, scratch), source)
        return plan.select("seq", "entry_id", "reason", "deduplicated", "merged", "secrets_redacted")

    def delete(self, ids: list[str]) -> int:
        """Deletes entries, and returns how many were there. Their history stays."""
        found = self.current(vectors=True).where(F.col("id").isin(ids))
        writes = found.select(F.col("id").alias("entry_id"), F.lit(0).alias("seq"), F.lit("delete").alias("op"), F.current_timestamp().alias("at"), "*")
        n = writes.count()
        if n:
            self._append(writes)
        return n

    def rollback(self, entry_id: str, version: int) -> None:
        """Brings an old version back, without vector and key; ValueError if there is none."""
        wanted = self.spark.createDataFrame([(entry_id, version)], "entry_id string, version int")
        log = self.log().where(F.col("entry_id") == entry_id)
        writes = versions.rolled_back(log, wanted, F.current_timestamp(), F.lit(0).cast("long")).withColumn("updated_at", F.current_timestamp())
        if writes.isEmpty():
            raise ValueError(f"no version {version} of {entry_id}")
        self._append(writes)

    def import_records(self, records: DataFrame, by_key: bool = False) -> int:
        """Takes records as they are, without redaction or merging, and returns how many.

        by_key: a record overwrites the entry of its key, or becomes a new one; those without a key are always new.
        Otherwise every record's id must be there, and no other entry may hold its key (ValueError if not), and that
        entry is overwritten.
        """
        rows = imported(records).withColumns({"now": F.current_timestamp(), "seq": F.monotonically_increasing_id()})
        known = self.current()
        if by_key:
            keys = known.where("dedup_key is not null").groupBy("dedup_key").agg(F.min("id").alias("was"), F.min_by("created_at", "id").alias("since"))
            rows = rows.join(keys, "dedup_key", "left")
            own = F.coalesce("dedup_key", F.concat(F.lit("row "), F.col("seq").cast("string")))
            new = F.concat(F.lit("k-"), F.sha2(F.concat_ws("|", own, F.col("now").cast("string")), 256))
            again = F.row_number().over(Window.partitionBy(own).orderBy("seq")) > 1
            rows = rows.withColumns({"entry_id": F.coalesce("was", new), "op": F.when(F.col("was").isNull() & ~again, "insert").otherwise("merge")})
        else:
            rows = rows.join(known.select("id", F.col("id").alias("was"), F.col("created_at").alias("since")), "id", "left")
            rows = rows.withColumns({"entry_id": F.col("was"), "op": F.lit("update")})
            held = known.select("dedup_key", F.col("id").alias("id")).unionByName(rows.select("dedup_key", "id")).where("dedup_key is not null")
            if not held.groupBy("dedup_key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").isEmpty():
                raise ValueError("records have keys that other entries hold")
        path = f"{self.root}/imports/{uuid.uuid4().hex}"
        rows = _embedded(rows, self.embed)
        rows = rows.withColumns({"id": F.col("entry_id"), "created_at": F.coalesce("since", "now"), "updated_at": F.col("now"), "at": F.col("now")})
        rows.write.parquet(path)
        staged = self.spark.read.schema(rows.schema).parquet(path)
        n, unknown = staged.agg(F.count(F.lit(1)), F.count_if(F.col("entry_id").isNull())).first()
        if unknown:
            raise ValueError(f"{unknown} records have ids that are not there")
        if n:
            self._append(staged)
        return n

    def export_records(self, path: str, scope: str | None = None, lines: bool = False) -> int:
        """Writes the records, the latest first, as JSON lines or arrays, and returns how many."""
        rows = self.current()
        (export_lines if lines else export_array)(rows, path, scope)
        return (rows if scope is None else rows.where(F.col("project_scope") == scope)).count()

    def size_bytes(self) -> int:
        """Bytes of the log's files; 0 where there is none."""
        if not self._exists():
            return 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/log")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def report(self) -> str:
        """The statistics as text."""
        row = self.stats().first()
        head = [f"Folder:             {self.root}", f"Total entries:      {row['total_entries']}", f"Audit revisions:    {row['total_history_revisions']}"]
        head += [f"Size:               {self.size_bytes() / 1024:.2f} KB", f"Vectors:            {row['semantic_active']}", "", "Scopes:"]
        return "\n".join([*head, *[f"  - {p['scope']:<20} : {p['n']} entries" for p in row["projects"]]])

    def recent_markdown(self, n: int = 20) -> str:
        rows = self.recent(n)
        return "# Recent Knowledge Entries\n\n" + "".join(r["m"] for r in rows.select(render.recent({c: F.col(c) for c in rows.columns}).alias("m")).collect())

    def reindex(self) -> None:
        """Embeds every record anew; each gets a history row."""
        if self.embed is None:
            return
        writes = _embedded(self.current(), self.embed).withColumn("updated_at", F.current_timestamp())
        self._append(writes.select(F.col("id").alias("entry_id"), F.lit(0).alias("seq"), F.lit("update").alias("op"), F.col("updated_at").alias("at"), "*"))


def _embedded(rows: DataFrame, embed: Embedder | None) -> DataFrame:
    """rows with the vectors of their texts and tags, which are empty without an embedder."""
    if embed is None:
        return rows.withColumn("embedding", F.array().cast("array<float>"))
    return embed.add(rows, embed_text(*[F.col(c) for c in TEXTS], F.col("tags")))


def prepare(saves: DataFrame, embed: Embedder | None) -> DataFrame:
    """Saves with checked, redacted fields, key, vector, secrets_redacted and reason (null where all is well)."""
    checks = {c: bounded(F.col(c), getattr(LIMITS, c)) for c in TEXTS}
    rows = saves.select("*", *[v.alias(f"{c}_ok") for c, v in checks.items()], clean_tags(F.col("tags")).alias("tags_ok"))
    reasons = [F.concat(F.lit(f"{c}: "), F.col(f"{c}_ok.reason")) for c in TEXTS]
    reason = F.coalesce(*reasons, F.concat(F.lit("tags: "), F.col("tags_ok.reason")), F.when(kind_or(F.col("kind")).isNull(), "kind: unknown"))
    rows = rows.withColumn("reason", reason).select("*", *[redact(F.col(f"{c}_ok.value")).alias(f"{c}_red") for c in TEXTS])
    rows = rows.withColumns({c: F.col(f"{c}_red.clean") for c in TEXTS})
    rows = rows.withColumns({"tags": F.col("tags_ok.value"), "secrets_redacted": sum((F.col(f"{c}_red.n") for c in TEXTS), F.lit(0))})
    rows = rows.withColumn("dedup_key", F.coalesce("dedup_key", dedup_key(F.col("project_scope"), F.col("title"))))
    rows = _embedded(rows, embed)
    return rows.drop(*[f"{c}_ok" for c in TEXTS], "tags_ok", *[f"{c}_red" for c in TEXTS])


def stats(records: DataFrame, revisions: DataFrame) -> DataFrame:
    """One row: entries, revisions, (scope, n) by n, and whether any record has a vector.

    Scopes are counted before null is called global, so a scope of that name is a pair of its own.
    """
    by_scope = records.groupBy("project_scope").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("embedding") > 0).alias("vectors"))
    return _report(by_scope, revisions.agg(F.count(F.lit(1)).alias("total_history_revisions")))


def _report(by_scope: DataFrame, revisions: DataFrame) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), F.coalesce("project_scope", F.lit("global")).alias("scope"), "n")))
    one = by_scope.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_entries"), F.transform(pairs, lambda p: F.struct(p["scope"], p["n"])).alias("projects"), (F.coalesce(F.sum("vectors"), F.lit(0)) > 0).alias("semantic_active"))
    return one.join(revisions)  # a row each
