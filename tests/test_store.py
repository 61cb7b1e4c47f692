"""Save, merge, history, rollback, delete, search and reopening of the store."""

import pytest
from pyspark.sql import functions as F

from wrenfold.functions.textops import has_all_tags
from wrenfold.operators import lexical
from wrenfold.schema import WEIGHTS
from wrenfold.operators.store import KnowledgeStore, checked_root
from wrenfold.streaming.upserts import SAVES, parsed, refused, save_stream


def save(spark, store, *rows):
    base = {"kind": "workflow", "context": "c", "content": "x", "verification": "v", "tags": [], "project_scope": None, "entry_id": None, "dedup_key": None}
    full = [{"seq": i, **base, **r} for i, r in enumerate(rows)]
    names = [c.split()[0] for c in SAVES.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in full], SAVES)
    return {r["seq"]: r for r in store.save(df).collect()}


def test_lifecycle(spark, tmp_path):
    root = f"file://{tmp_path}/kb"
    store = KnowledgeStore(spark, root)
    got = save(spark, store, {"title": "Lock timeout in pool", "content": "raise the limit", "tags": ["DB"], "project_scope": "alpha"})
    entry = got[0]["entry_id"]
    assert got[0]["reason"] is None and not got[0]["deduplicated"]
    hit = store.search("timeouts", scope="alpha").collect()
    assert [r["id"] for r in hit] == [entry] and hit[0]["keyword_rank"] == 1

    # the same title merges: id and creation stay, tags and evidence add up
    again = save(spark, store, {"title": "Lock timeout in pool", "content": "use a queue", "verification": "seen", "tags": ["db", "Ops"], "project_scope": "alpha"})
    assert again[0]["entry_id"] == entry and again[0]["merged"]
    row = store.get(entry).first()
    assert row["tags"] == ["db", "ops"] and row["content"] == "use a queue"
    assert row["verification"] == "v\n---\nAdditional verification: seen"
    assert [(r["version"], r["operation"], r["content"]) for r in store.history(entry).collect()] == [(1, "update", "raise the limit")]

    # an explicit id replaces, words of the old text are gone from the index
    save(spark, store, {"title": "Other words entirely", "content": "zebra", "entry_id": entry, "project_scope": "alpha"})
    assert store.get(entry).first()["title"] == "Other words entirely"
    keyword_only = KnowledgeStore(spark, root, embed=None)
    assert keyword_only.search("queue").count() == 0
    found = keyword_only.search("zebra").collect()
    assert found[0]["ranking"] == "lexical_only" and found[0]["semantic_rank"] is None
    # the scope is not searchable text
    assert keyword_only.search("alpha").count() == 0

    store.rollback(entry, 1)
    back = store.get(entry, vectors=True).first()
    assert "embedding" not in store.get(entry).columns and "embedding" not in store.all().columns
    assert back["content"] == "raise the limit" and back["dedup_key"] is None and len(back["embedding"]) == 0
    with pytest.raises(ValueError):
        store.rollback(entry, 99)

    # another session's view of the same folder
    assert KnowledgeStore(spark, root).get(entry).count() == 1
    stats = store.stats().first()
    assert stats["total_entries"] == 1 and stats["total_history_revisions"] == 3
    assert store.delete([entry, "nobody"]) == 1
    assert store.current().count() == 0 and store.history(entry).count() == 3


def test_batch_of_one_key_and_refusals(spark, tmp_path):
    store = KnowledgeStore(spark, f"file://{tmp_path}/kb")
    got = save(
        spark, store,
        {"title": "Same title", "content": "one", "verification": "a"},
        {"title": "Same   title 2024-01-01", "content": "two", "verification": "b"},
        {"title": " ", "content": "none"},
        {"title": "Secret", "content": "password = hunter2hunter2"},
        {"title": "Gone", "entry_id": "missing"},
        {"title": "Kind", "kind": "odd"},
    )
    assert got[0]["entry_id"] == got[1]["entry_id"] and got[1]["deduplicated"]
    assert got[2]["reason"] == "title: empty" and got[4]["reason"] == "entry_id: unknown" and got[5]["reason"] == "kind: unknown"
    assert got[3]["secrets_redacted"] == 1
    one = store.get(got[0]["entry_id"]).first()
    assert one["content"] == "two" and one["verification"] == "a\n---\nAdditional verification: b"
    assert store.history(got[0]["entry_id"]).count() == 1
    assert store.get(got[3]["entry_id"]).first()["content"] == "password=[REDACTED_SECRET]"
    store.reindex()
    assert store.history(got[3]["entry_id"]).count() == 1


def test_near_duplicate_merges(spark, tmp_path):
    store = KnowledgeStore(spark, f"file://{tmp_path}/kb")
    a = save(spark, store, {"title": "The quick brown fox", "content": "x" * 400})
    b = save(spark, store, {"title": "The quick brown fix", "content": "x" * 400})
    assert b[0]["entry_id"] == a[0]["entry_id"] and b[0]["merged"]
    c = save(spark, store, {"title": "The quick brown fax", "content": "x" * 400, "project_scope": "else"})
    assert c[0]["entry_id"] != a[0]["entry_id"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"seq": 0, "title": "From a stream", "kind": "workflow", "context": "c", "content": "d", "verification": "v", "tags": []}\nnot json\n')
    store = KnowledgeStore(spark, f"file://{tmp_path}/kb")
    lines = spark.readStream.text(str(tmp_path / "in"))
    save_stream(parsed(lines), store, str(tmp_path / "ck")).awaitTermination()
    assert [r["title"] for r in store.current().collect()] == ["From a stream"]
    # the first batch run again, as after a stop between its save and its commit, changes nothing
    save_stream(parsed(lines), store, str(tmp_path / "ck")).awaitTermination()
    (tmp_path / "ck" / "commits" / "0").unlink()
    (tmp_path / "ck" / "commits" / ".0.crc").unlink(missing_ok=True)
    save_stream(parsed(lines), store, str(tmp_path / "ck")).awaitTermination()
    assert store.log().count() == 1
    left = refused(spark.createDataFrame([("not json",), ("x" * 600_000,), ('{"seq": 1}',), (None,)], "value string")).collect()
    assert [(r["bytes"], r["reason"]) for r in left] == [(8, "no save in JSON"), (600_000, "longer than the bound"), (None, "no save in JSON")]


def test_stored_index(spark, tmp_path):
    """Search finds the same whether all, some or none of the index is stored."""
    store = KnowledgeStore(spark, f"file://{tmp_path}/kb", embed=None)
    got = save(spark, store, {"title": "Lock timeouts", "content": "raise the limits"}, {"title": "Cold starts", "content": "limit and lock"}, {"title": "Gone soon", "content": "lock"})
    save(spark, store, {"title": "Lock timeouts", "content": "zebra locks"})
    store.delete([got[2]["entry_id"]])

    records = store.current()
    terms = lexical.terms_of(spark, "locks limit timeout")
    scored = lexical.bm25(lexical.postings(records, tuple(WEIGHTS)), terms, WEIGHTS, *lexical.sizes(records, tuple(WEIGHTS)))
    want = [(r["id"], pytest.approx(r["score"])) for r in lexical.top(scored, 9).collect()]
    found = lambda: [(i, s) for i, _, s in store.index().search(terms, 9).hits]
    assert store.index().batches() == [1, 2, 3] and store.index().totals() == lexical.sizes(records, tuple(WEIGHTS))
    assert len(want) == 2 and found() == want
    for lost in ("segment=3-3", "segment=2-2"):
        (tmp_path / "kb" / "index" / lost / "_WHOLE").unlink()
    assert store.search("locks limit timeout").count() == 2 and found() == want
    (tmp_path / "kb" / "index").rename(tmp_path / "kb" / "elsewhere")
    assert store.search("locks limit timeout").count() == 2 and found() == want


def test_search_carries_no_texts(spark, tmp_path):
    # vectors by hash, so that no two are near
    store = KnowledgeStore(spark, f"file://{tmp_path}/kb", embed=lambda t: F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: (F.xxhash64(t, i) % 1000 / 1000).cast("float")))
    save(spark, store, *[{"title": f"Lock number {k}", "content": f"text {k} " * 9, "project_scope": "ab"[k % 2], "tags": ["x"] if k % 3 else ["y"]} for k in range(12)])
    hits, report = store.search_with_report("lock number", limit=4, scope="a", tags=["X"], prefilter=True)
    rows = hits.orderBy("place").collect()
    assert len(rows) == 4 and [r["place"] for r in rows] == [1, 2, 3, 4] and all(r["project_scope"] == "a" and r["tags"] == ["x"] for r in rows)
    assert "embedding" not in hits.columns and report["candidate_count"] >= 12 and all(report[f"{p}_ms"] > 0 for p in ("embedding", "keyword", "vector", "fusion"))
    assert "Exchange" not in hits._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert report["vector_blocks"] >= 1
    assert store.search("lock", limit=4, scope="zz").count() == 0


def test_counts_by_increments(spark, tmp_path):
    """Counts that batches add up to equal those of the whole log, after merges, moves between scopes and deletes."""
    from wrenfold.operators import store as module
    from wrenfold.operators import versions

    kb = KnowledgeStore(spark, f"file://{tmp_path}/kb", embed=lambda t: F.when(t.contains("plain"), F.array().cast("array<float>")).otherwise(F.array(F.lit(1.0).cast("float"))))
    assert kb.stats().first()["total_entries"] == 0
    row = lambda k, scope, **more: {"title": f"t{k}", "content": "plain" if k % 2 else "x", "project_scope": scope, "dedup_key": f"k{k}", **more}
    got = save(spark, kb, row(1, "a"), row(3, "a"), row(4, None), row(5, "global"), row(3, "b"))
    save(spark, kb, row(1, "c", entry_id=got[0]["entry_id"]), row(7, "a"), row(7, "a"))
    kb.delete([got[1]["entry_id"], got[2]["entry_id"]])
    save(spark, kb, row(3, "a"))
    want = module.stats(kb.current(vectors=True), versions.history(kb.log())).first().asDict(recursive=True)
    have = kb.stats().first().asDict(recursive=True)
    assert have == want and have["total_entries"] == 4 and have["total_history_revisions"] == 3
    plan = kb.stats()._jdf.queryExecution().toString()
    assert "content" not in plan and "title" not in plan
    # point reads: filters reach the scan of the log, and a key finds whoever holds it now
    assert kb.get_by_key("k3").count() == 1 and kb.get_by_key("k4").count() == 0 and kb.get_by_key("nobody").count() == 0
    plan = kb.get(got[0]["entry_id"])._jdf.queryExecution().toString()
    assert "EqualTo(entry_id" in plan


def test_unfinished_writes_are_unseen(spark, tmp_path):
    store = KnowledgeStore(spark, f"file://{tmp_path}/kb")
    save(spark, store, {"title": "one"})
    half = tmp_path / "kb" / "log" / "batch=2"
    store.log().drop("batch").withColumn("entry_id", F.lit("half")).write.parquet(f"file://{half}")
    (half / "_SUCCESS").unlink()
    assert store.log().count() == 1 and store.search("one").count() == 1
    # another writer has taken the third number
    (tmp_path / "kb" / "claims" / "2").touch()
    (tmp_path / "kb" / "claims" / "3").touch()
    save(spark, store, {"title": "two words", "content": "other text"})
    assert sorted(r["batch"] for r in store.log().select("batch").collect()) == [1, 4]


@pytest.mark.parametrize("bad", ["", " ", "/etc/kb", "/data/../x", "/home/a/.ssh/kb", "file:/etc/kb", "file://localhost/etc/kb", "file:///data/%2e%2e/x"])
def test_folders(bad):
    with pytest.raises(ValueError):
        checked_root(bad)


def test_one_entry_a_key(spark, tmp_path):
    """An import may not give a key to a second entry; where a log has it so all the same, a save goes to one of them."""
    store = KnowledgeStore(spark, f"file://{tmp_path}/kb")
    got = save(spark, store, {"title": "alpha beta", "content": "one " * 40, "project_scope": "a"}, {"title": "gamma delta", "content": "7 8 9", "project_scope": "b"})
    rows = store.current().withColumn("dedup_key", F.lit("k1")).drop("embedding")
    with pytest.raises(ValueError, match="keys"):
        store.import_records(rows)
    one = rows.where(F.col("id") == got[0]["entry_id"])
    assert store.import_records(one) == 1
    assert store.import_records(one.unionByName(one).withColumn("dedup_key", F.lit("new key")), by_key=True) == 2
    assert store.current().where("dedup_key = 'new key'").count() == 1
    again = save(spark, store, {"title": "epsilon", "dedup_key": "k1", "project_scope": "c"})
    assert len(again) == 1 and again[0]["entry_id"] == got[0]["entry_id"]


def test_tags_fold_ascii_only(spark):
    rows = spark.createDataFrame([(["\u00e9A"],)], "tags array<string>")
    assert rows.where(has_all_tags(F.col("tags"), ["\u00e9a"])).count() == 1 and rows.where(has_all_tags(F.col("tags"), ["\u00c9a"])).count() == 0
