"""Personal data by pattern, and terms that give it away by what the corpus says.

Patterns find addresses and numbers; their values, in a normal form, are the entities to protect. A term discloses
an entity if the corpus ties the two together: with occurrences of words as the events, p(e) the share of all
occurrences within WINDOW words of e, and p(e|t) that share among the term's own, the pointwise mutual information
log(p(e|t) / p(e)) is at most the entity's information -log p(e), which it reaches when the term never stands
elsewhere. A term whose ratio of the two is ALPHA or more, seen with the entity in at least SUPPORT different
surroundings, is taken out of every document that holds the entity: generalised to the class of all terms with its
first letters if that class as a whole stays below ALPHA, else removed. Documents without an entity stay as they are.

One pass over the texts writes, for each document, its spans; for those that hold an entity their terms with places
and neighbours; and the counts of terms. All else is joins and sums of these narrow rows. A surrounding is named by
the least hash of its other terms, so copies and near copies count as one.

Spans are kind:start:end in code points. Kinds in their order: KINDS. The four of patterns are always kept, the
terms' do not overlap them.

Defined cases: a null text is empty; repeated rows each get their row, and each counts; a null doc_id stays null;
very long texts are read whole, in time proportional to their length; ties have no part in it, as every term above
the threshold is taken; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfold.llm.common import written

KINDS = ("email", "ip", "card", "phone", "generalised", "removed")
GENERALISED, REMOVED = 4, 5
WINDOW, SUPPORT, ALPHA = 8, 3, 0.9
#: Letters that a generalised term keeps, and the least letters of a term.
HEAD, SHORTEST = 2, 3
#: Distinct terms that a task counts before it hands them on.
HELD_TERMS = 300_000
#: Rows of a batch that the pass returns.
ROWS = 4000

# possessive repeats and the look behind take the same matches as the plain patterns, but never try a run twice
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGIT = {c: None for c in map(ord, " -().+")}
TERM = re.compile(r"[0-9A-Za-zÀ-῿Ⰰ-⿯぀-\U0010FFFF]+")

PASS = pa.schema(
    [
        ("what", pa.string()), ("row", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))),
        ("text", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("places", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ("entity", pa.string()), ("near", pa.list_(pa.struct([("entity", pa.string()), ("context", pa.int64())]))),
    ]
)
_PASS_SQL = (
    "what string, row long, doc_id long, spans array<struct<start: int, kind: int, end: int>>, text string, term string, n long, "
    "places array<struct<start: int, end: int>>, entity string, near array<struct<entity: string, context: long>>"
)


def _luhn_sum(digits: str) -> int:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the patterns' matches that pass their tests, by start, then kind."""
    found = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                done = m.end()
                found.append((start, 0, done, text[start:done].lower()))
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
            found.append((m.start(), 1, m.end(), ".".join(p or "0" for p in parts)))
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:  # 19 digits and 18 separators at most
            digits = m.group().translate(_NO_DIGIT)
            if 12 <= len(digits) <= 19 and _luhn_sum(digits) % 10 == 0:
                found.append((m.start(), 2, m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = m.group().translate(_NO_DIGIT)
            if 9 <= len(digits) <= 15:
                found.append((m.start(), 3, m.end(), digits))
    return sorted(found)


def _terms(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, term) outside the spans."""
    out, k, reach = [], 0, -1
    for m in TERM.finditer(text):
        start, end = m.span()
        while k < len(spans) and spans[k][0] < end:
            reach = max(reach, spans[k][2])
            k += 1
        if start >= reach and end - start >= SHORTEST:
            out.append((start, end, m.group().lower()))
    return out


def _neighbours(terms: list[tuple[int, int, str]], spans: list[tuple[int, int, int, str]], window: int) -> dict[str, list[tuple[str, int]]]:
    """For each term near an entity, (entity, name of the surroundings) for every such occurrence."""
    near = defaultdict(list)
    at = 0
    for start, kind, _, value in spans:
        while at < len(terms) and terms[at][0] < start:
            at += 1
        some = [t for _, _, t in terms[max(0, at - window) : at + window]]
        hashes = [xxhash.xxh64_intdigest(t) >> 1 for t in some]
        order = sorted(set(hashes))
        entity = f"{KINDS[kind]}:{value}"
        for t, h in zip(some, hashes, strict=True):
            # the least hash of the other terms
            near[t].append((entity, order[0] if order[0] != h else order[1] if len(order) > 1 else 0))
    return near


def _scan(window: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        counts: Counter[str] = Counter()
        out: list[dict] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist(out, schema=PASS)
            out.clear()
            return made

        def counted() -> Iterator[pa.RecordBatch]:
            names = [f.name for f in PASS]
            whole = {"what": pa.array(["count"] * len(counts), pa.string()), "term": pa.array(counts.keys(), pa.string()), "n": pa.array(counts.values(), pa.int64())}
            yield pa.RecordBatch.from_arrays([whole.get(n, pa.nulls(len(counts), PASS.field(n).type)) for n in names], schema=PASS)
            counts.clear()

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                row += 1
                spans = base_spans(text)
                out.append({"what": "doc", "row": row, "doc_id": doc_id, "spans": [{"start": s, "kind": k, "end": e} for s, k, e, _ in spans], "text": text if with_text else None})
                if not spans:
                    counts.update(w for w in TERM.findall(text.lower()) if len(w) >= SHORTEST)
                else:
                    terms = _terms(text, spans)
                    counts.update(t for _, _, t in terms)
                    near = _neighbours(terms, spans, window)
                    places = defaultdict(list)
                    for start, end, t in terms:
                        places[t].append({"start": start, "end": end})
                    for t, where in places.items():
                        out.append({"what": "term", "row": row, "term": t, "places": where, "near": [{"entity": e, "context": c} for e, c in near.get(t, ())]})
                    out.extend({"what": "entity", "row": row, "entity": e} for e in sorted({f"{KINDS[k]}:{v}" for _, k, _, v in spans}))
                if len(out) >= ROWS:
                    yield batch()
                if len(counts) > HELD_TERMS:
                    yield from counted()
        yield batch()
        yield from counted()

    return run


def disclosures(seen: DataFrame, window: int, support: int, alpha: float) -> DataFrame:
    """(term, entity, kind) of the terms that disclose an entity, from the rows of a pass."""
    counts = seen.where("what = 'count'").groupBy("term").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    pairs = seen.where("what = 'term'").select("term", F.inline("near")).groupBy("term", "entity", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = written(pairs.groupBy("term", "entity").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("contexts")), "disclosure-pairs")
    entities = pairs.groupBy("entity").agg(F.sum("both").alias("near_entity"))
    head = F.substring("term", 1, HEAD)

    def ratio(both: str, own: str) -> Column:
        """Information that a term gives of an entity, of all that there is: log(p(e|t) / p(e)) / -log p(e)."""
        # a term near two mentions at once counts for both, so the share may pass one
        share = F.least(F.col(both) / F.col(own), F.lit(1.0))
        rarity = -F.log(F.col("near_entity") / F.lit(float(total)))
        return F.when(rarity > 0, 1 + F.log(share) / rarity).otherwise(F.lit(0.0))

    strong = pairs.where(F.col("contexts") >= support).join(counts, "term").join(entities, "entity")
    strong = written(strong.where(ratio("both", "n") >= alpha).select("term", "entity", "near_entity", head.alias("head")), "disclosures")
    heads = strong.select("head").distinct()
    of_head = counts.groupBy(head.alias("head")).agg(F.sum("n").alias("head_n")).join(heads, "head", "left_semi")
    near_head = pairs.groupBy(head.alias("head"), "entity").agg(F.sum("both").alias("head_both"))
    classed = strong.join(of_head, "head").join(near_head, ["head", "entity"])
    return classed.select("term", "entity", F.when(ratio("head_both", "head_n") < alpha, GENERALISED).otherwise(REMOVED).alias("kind"))


def find(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    window: int = WINDOW,
    support: int = SUPPORT,
    alpha: float = ALPHA,
    with_text: bool = False,
) -> DataFrame:
    """(doc_id, spans), spans an array of (start, kind, end) by start, then kind, kind an index of KINDS.

    with_text: text comes too, and clean, in which spans are replaced.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = written(rows.mapInArrow(_scan(window, with_text), _PASS_SQL), "personal-data", ("what",))
    terms = seen.where("what = 'term'").select("row", "term", "places")
    held = seen.where("what = 'entity'").select("row", "entity")
    told = disclosures(seen, window, support, alpha)
    # a term is tied to few entities at this ratio, so this join multiplies little
    hits = terms.join(told, "term").join(held, ["row", "entity"], "left_semi").groupBy("row", "term").agg(F.max("kind").alias("kind"), F.first("places").alias("places"))
    added = hits.groupBy("row").agg(F.flatten(F.collect_list(F.transform("places", lambda p: F.struct(p["start"].alias("start"), F.col("kind").alias("kind"), p["end"].alias("end"))))).alias("added"))
    found = seen.where("what = 'doc'").join(added, "row", "left")
    spans = F.sort_array(F.concat("spans", F.coalesce("added", F.expr("cast(array() as array<struct<start: int, kind: int, end: int>>)"))))
    found = found.select("doc_id", spans.alias("spans"), "text")
    return found.withColumn("clean", cleaned(F.col("text"), F.col("spans"))) if with_text else found.drop("text")


def cleaned(text: Column, spans: Column) -> Column:
    """The text with marks for the patterns' spans, heads for generalised terms, and without removed ones.

    Where spans overlap, the first one's mark stands for all.
    """
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS[:GENERALISED]])

    def step(state: Column, s: Column) -> Column:
        mark = (
            F.when(s["start"] < state["at"], "")
            .when(s["kind"] < GENERALISED, F.get(marks, s["kind"]))
            .when(s["kind"] == GENERALISED, F.concat(F.substring(text, s["start"] + 1, F.lit(HEAD)), F.lit("*")))
            .otherwise("")
        )
        between = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        return F.struct(F.greatest(s["end"], state["at"]).alias("at"), F.concat(state["out"], F.array(F.concat(between, mark))).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.aggregate(spans, start, step, rest)


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def by_pattern(spans: Column) -> Column:
    """The spans that patterns found."""
    return F.filter(spans, lambda s: s["kind"] < GENERALISED)
