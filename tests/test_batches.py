"""Batches of saves against the same saves one by one."""

import random

import pytest
from pyspark.sql import functions as F

from test_store import save
from wrenfold.operators import batches
from wrenfold.operators.store import KnowledgeStore

SAVE = "seq long, title string, kind string, context string, content string, verification string, tags array<string>, project_scope string, entry_id string, dedup_key string"


def vector(text):
    """A vector of two numbers from the digits in a content: near for digits that are near."""
    angle = F.regexp_extract(text, r"angle(\d+)", 1).try_cast("int") * 0.1
    return F.when(angle.isNull(), F.array().cast("array<float>")).otherwise(F.array(F.cos(angle), F.sin(angle)).cast("array<float>"))


class Plain:
    """Saves one by one, in plain Python."""

    def __init__(self):
        self.entries, self.rows, self.clock = {}, [], 0

    def save(self, seq, title, content, verification, tags, scope, named, key):
        self.clock += 1
        blank = not title.strip()
        angle = int(content.split("angle")[1]) * 0.1 if "angle" in content else None
        to, how = next((i for i, e in sorted(self.entries.items(), key=str) if e["key"] == key), None), "merged"
        if to is None and named is None and angle is not None:
            import math

            near = [(e["at"], i) for i, e in self.entries.items() if e["scope"] == scope and e["angle"] is not None and math.cos(e["angle"] - angle) >= 0.92]
            to = max(near)[1] if near else None
        if to is None:
            how = "replaced"
            if named is not None and named not in self.entries:
                return None, "lost"
            to = named if named is not None else ("new", seq)
        old = self.entries.get(to)
        if how == "merged":
            proof = old["verification"]
            if verification.strip() not in ("", proof.strip()):
                proof = verification if not proof.strip() else proof if verification.strip() in proof else f"{proof.strip()}\n---\nAdditional verification: {verification.strip()}"
            names = {t.lower() for t in old["tags"]}
            new = {"title": old["title"] if blank else title, "content": content, "verification": proof, "scope": scope or old["scope"], "key": key}
            new["tags"] = old["tags"] + [t for k, t in enumerate(tags) if t.lower() not in names and t not in tags[:k]]
        else:
            new = {"title": title, "content": content, "verification": verification, "scope": scope, "key": key, "tags": tags}
        self.entries[to] = {**new, "angle": angle, "at": self.clock}
        self.rows.append((to, self.entries[to]))
        return to, how


def random_saves(rng, n, ids):
    out = []
    for seq in range(n):
        angle = rng.choice(["", f" angle{rng.randrange(60)}"])
        out.append((
            seq, rng.choice(["One", "Two", "Three words"]), f"text {rng.randrange(9)}{angle}", rng.choice(["seen", "seen twice", "not", "run again"]),
            rng.sample(["a", "b", "c", "d"], rng.randint(0, 3)), rng.choice([None, "s", "t"]), rng.choice([None, None, None, "missing", *ids]), f"key{rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7])}",
        ))
    return out


def state(e):
    return (e["title"], e["content"], e["verification"], tuple(e["tags"]), e["scope"], e["key"])


@pytest.mark.parametrize(("seed", "part"), [(1, 1 << 20), (2, 900), (3, 900)])
def test_like_one_by_one(spark, tmp_path, monkeypatch, seed, part):
    """Two batches with moving keys, named entries and near vectors; ranges of 900 bytes cut entries up."""
    monkeypatch.setattr(batches.fold, "__defaults__", (part,))
    rng = random.Random(seed)
    plain, store, names = Plain(), KnowledgeStore(spark, f"file://{tmp_path}/kb", embed=vector), {}
    for _ in range(2):
        ids = list(names)
        saves = random_saves(rng, 60, [names[i] for i in ids])
        back = {v: k for k, v in names.items()}
        plain.rows = []
        want = [plain.save(s, t, c, v, tags, sc, back.get(named, named), key) for s, t, c, v, tags, sc, named, key in saves]
        plain_new = {("new", s): ("new", len(names), s) for s in range(60)}
        rows = [(s, t, "workflow", "c", c, v, tags, sc, named, key) for s, t, c, v, tags, sc, named, key in saves]
        before = store.log().count()
        got = {r["seq"]: r for r in store.save(spark.createDataFrame(rows, SAVE).repartition(3)).collect()}
        for s, (to, how) in enumerate(want):
            if how == "lost":
                assert got[s]["reason"] == "entry_id: unknown"
                continue
            assert got[s]["reason"] is None and got[s]["merged"] == got[s]["deduplicated"] == (how == "merged"), s
            names.setdefault(plain_new.get(to, to), got[s]["entry_id"])
            assert names[plain_new.get(to, to)] == got[s]["entry_id"], s
        plain.entries = {plain_new.get(i, i): e for i, e in plain.entries.items()}
        logged = store.log().orderBy("seq").collect()[before:]
        assert len(logged) == len(plain.rows)
        for r, (to, e) in zip(logged, plain.rows, strict=True):
            assert r["entry_id"] == r["id"] == names[plain_new.get(to, to)]
            assert (r["title"], r["content"], r["verification"], tuple(r["tags"]), r["project_scope"], r["dedup_key"]) == state(e)
    current = {r["id"]: r for r in store.current().collect()}
    assert current.keys() == {names[i] for i in plain.entries}
    keys = [r["dedup_key"] for r in current.values()]
    assert len(keys) == len(set(keys))


def test_half_a_batch_on_one_key(spark, tmp_path, monkeypatch):
    """One key's 400 saves lie in many ranges, none of which holds more than its share."""
    monkeypatch.setattr(batches.fold, "__defaults__", (4000,))
    seen = []
    keep = batches._written
    monkeypatch.setattr(batches, "_written", lambda df, scratch, name: seen.append((name, keep(df, scratch, name))) or seen[-1][1])
    store = KnowledgeStore(spark, f"file://{tmp_path}/kb", embed=None)
    rows = [(k, "Hot" if k % 2 else f"Title {k}", "workflow", "c", f"text {k}", f"proof {k % 5}", [f"t{k % 7}"], None, None, "hot" if k % 2 else f"k{k}") for k in range(800)]
    got = store.save(spark.createDataFrame(rows, SAVE)).collect()
    assert len({r["entry_id"] for r in got}) == 401 and sum(r["merged"] for r in got) == 399
    dealt = dict(seen)["dealt"].groupBy("entry_id", "part").count()
    assert dealt.agg(F.max("count")).first()[0] < 100 and dealt.count() > 410
    hot = store.get_by_key("hot").first()
    assert hot["content"] == "text 799" and sorted(hot["tags"]) == sorted(f"t{k}" for k in range(7))
    assert hot["verification"].count("proof") == 5 and store.history(hot["id"]).count() == 399


def test_one_key_for_two_named_entries(spark, tmp_path):
    """Two entries saved by name with one new key: the second save joins the first one's entry."""
    store = KnowledgeStore(spark, f"file://{tmp_path}/kb", embed=None)
    got = save(spark, store, {"title": "One"}, {"title": "Two"})
    a, b = got[0]["entry_id"], got[1]["entry_id"]
    again = save(spark, store, {"title": "One", "entry_id": a, "dedup_key": "new"}, {"title": "Two", "entry_id": b, "dedup_key": "new"}, {"title": "Two", "entry_id": b})
    assert [(again[k]["entry_id"], again[k]["merged"]) for k in range(3)] == [(a, False), (a, True), (b, True)]
    assert store.get_by_key("new").count() == 1 and store.current().count() == 2


def test_folding_is_dealt_by_the_bytes_of_saves(spark, tmp_path, monkeypatch):
    """Tasks of the folding are as many as the texts ask for, though the shuffled rows are few bytes."""
    monkeypatch.setattr(batches, "FOLDED", 20_000)
    kb = KnowledgeStore(spark, f"file://{tmp_path}/kb", embed=None)
    i = F.col("id")
    columns = {"title": F.lit("t"), "kind": F.lit("workflow"), "context": F.lit("c"), "content": F.lit("x"), "verification": F.lit("v"), "tags": F.array().cast("array<string>")}
    none = F.lit(None).cast("string")
    saves = spark.range(600).select(i.alias("seq"), *[v.alias(c) for c, v in columns.items()], none.alias("project_scope"), none.alias("entry_id"), F.concat(F.lit("k"), (i % 50).cast("string")).alias("dedup_key"))
    kb.save(saves)
    assert len(list((tmp_path / "kb" / "log" / "batch=1").glob("*.parquet"))) >= 4
    assert kb.current().count() == 50 and kb.log().count() == 600
