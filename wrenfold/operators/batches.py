"""A batch of saves, decided and folded as if its saves came one by one in the order of seq.

Deciding. A save goes to the entry that holds its key at that moment; else it replaces the entry that it names (or is
refused); else, unnamed, it goes to the latest near duplicate of its scope; else it is a new entry. What earlier saves
of the batch have done counts: they make entries, move keys from one entry to another and change vectors. Saves of one
key make a group. Most groups touch nothing but the entry that holds their key: then the first save decides for all,
by sums over keys, however many there are. The others are joined into components by what may connect them (a named
entry, the holder of a key, vectors near each other), and each component is gone through in order by one task, on rows
of key, scope, name and vectors, in which saves of one key that follow one another are one row. Near vectors are found
block by block, and each block pair returns a spanning forest, not its pairs.

Folding. An entry's saves become log rows, each the state after it. Saves lie in ranges of (entry, seq) of up
to SAVES saves, so an entry with half of a batch is many ranges. What a range does to a state that is not known yet is
itself a narrow state (the last title, texts, scope and key, the tags, the evidence in order): these are run through
for the entries of several ranges, which gives each range the state it starts from; then all ranges are folded at once.

Defined cases: refused saves take part in nothing; equal times go by id, saves of the batch are later than what was
there; where a log holds a key twice, the least id holds it; an empty batch gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wrenfold.functions.textops import merge_verification, strip, union_tags
from wrenfold.operators import merge, similarity
from wrenfold.schema import NEAR_DUPLICATE, RECORD

#: Bytes of texts that a task of the dealing gets, about, and saves of a range: states are appended to an array, whose
#: copies are as many as the square of the range.
PART, SAVES = 8 << 20, 256
#: The same of a task of the folding, which takes far longer than its bytes let a reader of shuffles expect.
FOLDED = 4 << 20
#: Copies of a row a key to which a hot key's saves are dealt.
SALTS = 16


def _written(df: DataFrame, scratch: str, name: str) -> DataFrame:
    path = f"{scratch}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _node(kind: str, name: str) -> Column:
    """A key's or entry's number; two that share one merely share a component."""
    return F.xxhash64(F.lit(kind), F.col(name))


def _forest(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join whatever rows (id, scope, vector) of left and right are near each other in a scope."""

    def within(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: tuple[list, list] = ([], [])
        if len(x) and len(y):
            ids, places = np.unique(np.concatenate([x["id"], y["id"]]), return_inverse=True)
            root = np.arange(len(ids))
            a, b = places[: len(x)], places[len(x) :]
            for i, near in zip(a, similarity._unit(x["vector"]) @ similarity._unit(y["vector"]).T >= least, strict=True):
                for j in np.unique(root[b[near]]):
                    if j != root[i]:
                        out[0].append(ids[i])
                        out[1].append(ids[j])
                        root[root == j] = root[i]
        return similarity._frame(a=out[0], b=out[1])

    return similarity.compare(left, right, within, "a long, b long").distinct()


def components(edges: DataFrame, scratch: str) -> DataFrame:
    """(node, label) of the nodes of (a, b), label the least node that links lead to.

    Every round each node takes the least label around it, then the label of its label.
    """
    both = _written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), scratch, "edges")
    at = _written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), scratch, "labels-0")
    turn = 0
    while True:
        turn += 1
        around = both.join(at.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("other"))
        step = at.join(around, "node").select("node", F.col("label").alias("was"), F.least("label", "other").alias("label"))
        jump = at.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label").select("node", F.least("label", "further").alias("label"), "was")
        step = _written(step, scratch, f"labels-{turn}")
        at = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return at


def resolve(checked: DataFrame, known: DataFrame, scratch: str) -> DataFrame:
    """Adds to checked saves entry_id, the entry that each goes to, merged (into what is there) and deduplicated.

    known: the records, with vectors. scratch: a folder of this call's own.
    """
    valid = checked.where("reason is null").select("seq", F.col("dedup_key").alias("key"), F.col("project_scope").alias("scope"), F.col("entry_id").alias("named"), F.col("embedding").alias("vector"), "now")
    valid = _written(valid, scratch, "valid")
    entries = known.select("id", F.col("dedup_key").alias("key"), F.col("project_scope").alias("scope"), F.col("embedding").alias("vector"), "updated_at")
    groups = valid.groupBy("key").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    holders = entries.where("key is not null").groupBy("key").agg(F.min("id").alias("holder"), F.min_by("scope", "id").alias("holder_scope"))
    groups = _written(groups.join(holders, "key", "left"), scratch, "groups")

    # what connects groups with entries, and with each other
    names = valid.where("named is not null").select("key", "named").distinct().join(groups.select("key", "holder"), "key").where("holder is null or holder <> named")
    linked = names.select(_node("key", "key").alias("a"), _node("entry", "named").alias("b"))
    scopes = valid.where("scope is not null").select("key", F.col("scope").alias("other")).unionByName(groups.where("holder_scope is not null").select("key", F.col("holder_scope").alias("other"))).distinct()
    # an entry keeps its scope when a save of its key has none
    seen = valid.select("key", "scope", "vector").unionByName(valid.where("scope is null").join(scopes, "key").select("key", F.col("other").alias("scope"), "vector"))
    seen = seen.where("size(vector) > 0").select(_node("key", "key").alias("id"), "scope", "vector").distinct()
    there = entries.where("size(vector) > 0").select(_node("entry", "id").alias("id"), "scope", "vector")
    linked = linked.unionByName(_forest(seen, seen, NEAR_DUPLICATE)).unionByName(_forest(seen, there, NEAR_DUPLICATE))
    held = groups.where("holder is not null").select(_node("key", "key").alias("a"), _node("entry", "holder").alias("b"))
    linked = _written(linked.where("a <> b").distinct(), scratch, "links").join(held, ["a", "b"], "left_anti")

    decided = _plain(valid, groups)
    if not linked.isEmpty():
        touched = linked.select("a").unionByName(linked.select(F.col("b").alias("a"))).distinct()
        # keys of entries that others may change, and entries of keys in a component
        near_held = held.join(touched, "a", "left_semi").unionByName(held.join(touched.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"))
        labels = components(linked.unionByName(near_held).distinct(), scratch)
        mixed = _written(_in_order(valid, entries, labels), scratch, "mixed")
        decided = decided.join(mixed.select("seq"), "seq", "left_anti").unionByName(mixed)
    new = F.concat(F.lit("k-"), F.sha2(F.concat_ws("|", "maker_key", F.col("maker").cast("string"), F.col("now").cast("string")), 256))
    decided = decided.withColumnsRenamed({"to": "goes_to", "merged": "joins"})
    rows = checked.join(decided, "seq", "left")
    rows = rows.withColumns({"reason": F.coalesce("reason", F.when(F.col("lost"), "entry_id: unknown")), "merged": F.coalesce("joins", F.lit(False))})
    rows = rows.withColumns({"deduplicated": F.col("merged"), "entry_id": F.when(F.col("reason").isNull(), F.coalesce("goes_to", new)).otherwise(F.col("entry_id"))})
    return rows.drop("goes_to", "joins", "maker", "maker_key", "lost")


DECIDED = "seq long, to string, maker long, maker_key string, merged boolean, lost boolean"


def _plain(valid: DataFrame, groups: DataFrame) -> DataFrame:
    """DECIDED rows of groups that touch nothing but the holder of their key: the first save decides."""
    lookup = groups.where("n > 1 or holder is not null").select("key", "first", "holder", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = valid.select("seq", "key", F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int").alias("salt")).join(lookup, ["key", "salt"], "left")
    maker = F.coalesce("first", "seq")
    return rows.select(
        "seq", F.col("holder").alias("to"), maker.alias("maker"), F.col("key").alias("maker_key"), (F.col("holder").isNotNull() | (F.col("seq") > maker)).alias("merged"), F.lit(False).alias("lost")
    )


def _in_order(valid: DataFrame, entries: DataFrame, labels: DataFrame) -> DataFrame:
    """DECIDED rows of the saves in components."""
    saves = valid.withColumn("node", _node("key", "key")).join(labels, "node")
    order = Window.partitionBy("label").orderBy("seq")
    # a save of the key of the save before it goes where that went, unless that may have been refused
    follows = (F.lag("key").over(order) == F.col("key")) & F.lag("named").over(order).isNull()
    saves = saves.withColumn("starts", F.when(follows, 0).otherwise(1)).withColumn("run", F.sum("starts").over(order))
    later = F.when(F.col("starts") == 0, F.col("scope"))
    runs = saves.groupBy("label", "run").agg(
        F.min("seq").alias("at"), F.min_by("key", "seq").alias("key"), F.min_by("named", "seq").alias("id"), F.min_by("scope", "seq").alias("scope"),
        F.max_by(later, F.when(later.isNotNull(), F.col("seq"))).alias("later_scope"), F.min_by("vector", "seq").alias("vector"), F.max_by("vector", "seq").alias("last_vector"),
    )
    none = F.lit(None).cast("string")
    held = entries.withColumn("node", _node("entry", "id")).join(labels, "node").select(
        "label", F.lit(None).cast("long").alias("run"), F.unix_micros("updated_at").alias("at"), "key", "id", "scope", none.alias("later_scope"), "vector", F.col("vector").alias("last_vector")
    )
    columns = held.columns
    told = runs.select(*columns).unionByName(held).groupBy("label").applyInPandas(_one_by_one, "label long, run long, to string, maker long, maker_key string, merged boolean, lost boolean")
    rows = saves.select("seq", "label", "run", "starts").join(told, ["label", "run"])
    return rows.select("seq", "to", "maker", "maker_key", F.expr("starts = 0 or merged").alias("merged"), "lost")


def _one_by_one(rows: pd.DataFrame) -> pd.DataFrame:
    """Goes through a component's runs in order. State: entries with key, scope, vector, the latest last."""
    blank = lambda x: None if x is None or x != x else x
    there = rows[rows["run"].isna()].sort_values(["at", "id"], ascending=[True, False], kind="stable")
    todo = rows[rows["run"].notna()].sort_values("at", kind="stable")
    state: dict[str | int, list] = {}  # in the order of their last change: [key, scope, unit vector or None]
    holders: dict[str, set] = {}

    def unit(v: np.ndarray | None) -> np.ndarray | None:
        if v is None or not len(v):
            return None
        v = np.asarray(v, np.float64)
        return v / (np.sqrt((v * v).sum()) or 1.0)

    def put(i: str | int, key: str | None, scope: str | None, vector: np.ndarray | None) -> None:
        old = state.pop(i, None)
        if old is not None and old[0] is not None:
            holders[old[0]].discard(i)
        state[i] = [key, scope, vector]
        if key is not None:
            holders.setdefault(key, set()).add(i)

    def latest_near(scope: str | None, vector: np.ndarray) -> str | int | None:
        some = [(i, v) for i, (_, s, v) in state.items() if s == scope and v is not None and len(v) == len(vector)]
        if not some:
            return None
        near = np.flatnonzero(np.stack([v for _, v in some]) @ vector >= NEAR_DUPLICATE)
        return some[near[-1]][0] if len(near) else None

    for r in there.itertuples():
        put(r.id, blank(r.key), blank(r.scope), unit(r.vector))
    makers: dict[int, str] = {}
    out = []
    for r in todo.itertuples():
        named, scope, first = blank(r.id), blank(r.scope), unit(r.vector)
        to = min(holders.get(r.key) or (), key=lambda i: (isinstance(i, int), i), default=None)
        if to is None and named is None and first is not None:
            to = latest_near(scope, first)
        merged = to is not None
        if not merged and named is not None:
            if named not in state:
                out.append((r.label, int(r.run), None, None, None, False, True))
                continue
            to = named
        if to is None:
            to = int(r.at)
            makers[to] = r.key
        if merged:
            scope = state[to][1] if scope is None else scope
        later = blank(r.later_scope)
        put(to, r.key, scope if later is None else later, unit(r.last_vector))
        new = isinstance(to, int)
        out.append((r.label, int(r.run), None if new else to, to if new else None, makers[to] if new else None, merged, False))
    return similarity._frame(**{c: [row[k] for row in out] for k, c in enumerate(("label", "run", "to", "maker", "maker_key", "merged", "lost"))})


# ---- folding

_FIELDS = [f.name for f in RECORD.fields]
_TYPE = RECORD.simpleString()


def _after(old: Column, save: Column) -> Column:
    """The record after a save onto old, which may be null."""
    new = save["record"]
    replaced = F.struct(*[(F.coalesce(old["created_at"], new[c]) if c == "created_at" else new[c]).alias(c) for c in _FIELDS])
    return F.when(old.isNotNull() & save["merged"], merge.merged(old, new, new["updated_at"])).otherwise(replaced).cast(_TYPE)


def _effect(saves: Column) -> Column:
    """What a range of an entry's saves does to a state: the state itself where a save replaces it, else its parts."""
    kept = lambda value, ok: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.transform(saves, value), ok)), -1)
    proofs = F.array_distinct(F.filter(F.transform(saves, lambda s: s["record"]["verification"]), lambda v: strip(v) != ""))
    # evidence that an earlier one holds adds nothing to whatever holds that
    proofs = F.filter(proofs, lambda v, i: ~F.exists(F.slice(proofs, F.lit(1), i), lambda w: F.contains(w, strip(v))))
    return F.struct(
        F.exists(saves, lambda s: ~s["merged"]).alias("resets"),
        F.aggregate(saves, F.lit(None).cast(_TYPE), _after).alias("whole"),
        kept(lambda s: s["record"]["title"], lambda t: strip(F.coalesce(t, F.lit(""))) != "").alias("title"),
        kept(lambda s: s["record"]["project_scope"], lambda x: x.isNotNull()).alias("project_scope"),
        kept(lambda s: s["record"]["dedup_key"], lambda x: x.isNotNull()).alias("dedup_key"),
        F.aggregate(saves, F.array().cast("array<string>"), lambda tags, s: union_tags(tags, s["record"]["tags"])).alias("tags"),
        proofs.alias("proofs"),
    )


def _applied(old: Column, effect: Column) -> Column:
    """The record after a range, from the one before it (null: none) and the range's effect."""
    whole = effect["whole"]
    fresh = F.struct(*[(F.coalesce(old["created_at"], whole[c]) if c == "created_at" else whole[c]).alias(c) for c in _FIELDS])
    parts = {
        "id": old["id"], "title": F.coalesce(effect["title"], old["title"]), "verification": F.aggregate(effect["proofs"], old["verification"], merge_verification),
        "tags": union_tags(old["tags"], effect["tags"]), "project_scope": F.coalesce(effect["project_scope"], old["project_scope"]),
        "created_at": old["created_at"], "dedup_key": F.coalesce(effect["dedup_key"], old["dedup_key"]),
    }
    return F.when(old.isNull() | effect["resets"], fresh).otherwise(F.struct(*[parts.get(c, whole[c]).alias(c) for c in _FIELDS])).cast(_TYPE)


def fold(plan: DataFrame, known: DataFrame, scratch: str, part_bytes: int = PART) -> DataFrame:
    """The log rows of a batch: (entry_id, seq, op, at, the record's columns, embedding) after each save of plan."""
    incoming = plan.withColumns({"id": F.col("entry_id"), "created_at": F.col("now"), "updated_at": F.col("now")})
    rows = incoming.select("entry_id", F.col("seq").cast("long").alias("seq"), "merged", F.struct(*_FIELDS).cast(_TYPE).alias("record"), F.col("embedding").cast("array<float>").alias("embedding"))
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(c), F.lit(0)) for c in ("title", "context", "content", "verification")])
    bytes_ = plan.agg(F.sum(size + 200)).first()[0] or 0
    dealt = rows.repartitionByRange(max(1, -(-bytes_ // part_bytes)), "entry_id", "seq").sortWithinPartitions("entry_id", "seq").withColumn("at", F.monotonically_increasing_id())
    place = F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / SAVES)
    dealt = dealt.withColumn("part", (F.shiftrightunsigned("at", 33) * (1 << 25) + place).cast("long")).drop("at")
    dealt = _written(dealt, scratch, "dealt")  # the ranges are what is written here, whoever reads them
    ranges = dealt.groupBy("entry_id", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "merged", "record", "embedding"))).alias("saves"))

    spans = dealt.groupBy("entry_id").agg(F.min("part").alias("first"), F.max("part").alias("last"))
    spans = _written(spans.join(known.select(F.col("id").alias("entry_id"), F.struct(*_FIELDS).cast(_TYPE).alias("old")), "entry_id", "left"), scratch, "spans")
    several = spans.where("first < last").select("entry_id", "old")
    effects = ranges.join(several.select("entry_id"), "entry_id", "left_semi").select("entry_id", F.struct("part", _effect(F.col("saves")).alias("effect")).alias("e"))
    effects = effects.groupBy("entry_id").agg(F.sort_array(F.collect_list("e"), asc=True).alias("effects")).join(several, "entry_id")
    begun = f"struct<part: bigint, old: {_TYPE}>"
    start = F.struct(F.col("old").alias("last"), F.array().cast(f"array<{begun}>").alias("out")).cast(f"struct<last: {_TYPE}, out: array<{begun}>>")
    step = lambda s, e: F.struct(_applied(s["last"], e["effect"]).alias("last"), F.concat(s["out"], F.array(F.struct(e["part"].alias("part"), s["last"].alias("old")).cast(begun))).alias("out"))
    carried = effects.select("entry_id", F.inline(F.aggregate("effects", start, step, lambda s: s["out"])))
    carried = carried.unionByName(spans.where("first = last").select("entry_id", F.col("first").alias("part"), "old"))

    made = f"struct<seq: bigint, op: string, record: {_TYPE}, embedding: array<float>>"

    def save(state: Column, s: Column) -> Column:
        record = _after(state["last"], s)
        op = F.when(state["last"].isNull(), "insert").otherwise("update")
        row = F.struct(s["seq"].alias("seq"), op.alias("op"), record.alias("record"), s["embedding"].alias("embedding")).cast(made)
        return F.struct(record.alias("last"), F.concat(state["out"], F.array(row)).alias("out"))

    begin = F.struct(F.col("old").alias("last"), F.array().cast(f"array<{made}>").alias("out")).cast(f"struct<last: {_TYPE}, out: array<{made}>>")
    met = ranges.join(carried, ["entry_id", "part"]).repartition(max(1, -(-bytes_ // FOLDED)), "entry_id", "part")
    done = met.select("entry_id", F.explode(F.aggregate("saves", begin, save, lambda s: s["out"])).alias("w"))
    return done.select("entry_id", "w.seq", "w.op", F.col("w.record.updated_at").alias("at"), "w.record.*", "w.embedding")
