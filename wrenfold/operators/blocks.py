"""A stored keyword index whose searches skip blocks: exact BM25 top k with an upper bound for each block.

Records are numbered in blocks of 64, so which of a block's records hold a token is one long of bits. A segment keeps

    blocks    (token, first, offs, bits, f_max, n_min, froms, ns, fs, places)    a row for each token of a group of blocks
    records   (entry_id, seq, block, slot, n)
    stats     (records, tokens)                                                  one row

Rows of blocks and of records are in the same files, with nulls in the columns of the other. A row of `blocks` has
an item for each block first + offs that holds the token, and from its place in froms on an item of ns, fs and places
for each record there, in the order of bits. The columns that a step does not name are not read: bounds
leave the latter three, scores the places. A task writes each group's rows as they are made, sorted by token, in short
pages: so nothing is shuffled, sorted by Spark or spilled, and a lookup reads a page or two of each group; merging segments
sorts them across files.
`dead` keeps the slots of rows that later writes replaced or deleted. A search reads `blocks` for its terms: the
bits, without the dead, give every term's exact number of records (a term that is the start of several tokens counts
a record once, by OR), and f_max and n_min bound what a block's best record can score. Blocks are then scored in the
order of their bounds, the first FIRST of them, then GROWTH times as many, until no bound reaches the k-th best score:
the result is that of scoring everything, ties included. Phrases are found exactly before that, in the blocks in which
all their words meet.

Segments cover a run of batches. After a write the latest segments of like size become one, by renumbering their live
records and without reading a text, so a search opens O(log batches) folders. A merged segment takes the place of
what it covers by the appearance of its mark, which is made last; a stop before that changes nothing.

Defined cases: null texts have no words; a record without words counts for the mean length and is never found; equal
scores go by id; no terms, or an index without records, gives no rows; a token is as long as its text has it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wrenfold.functions.stemming import stem, tokens
from wrenfold.operators.lexical import K1, LEAST_IDF, B, Term, _matches
from wrenfold.schema import WEIGHTS

#: Records of a block, one for each bit of a long.
SLOTS = 64
#: Blocks that are scored first, and how many times more in each further round.
FIRST, GROWTH = 64, 8
#: Segments of a size class that become one, and records from which a size class is left.
FANOUT, SMALLEST = 4, 10_000
#: Blocks of a group, tokens from which a task begins another group, and rows of an Arrow batch that it sends back.
GROUP, HELD, SENT = 128, 1 << 20, 20_000
#: Rows of a page of a file at most.
PAGE = 2_000
#: A place is the column's number times this, plus the word's place in the column.
COLUMN = 1 << 26

BOUNDS = "token string, first long, offs array<int>, bits array<long>, f_max array<double>, n_min array<int>"
BLOCKS = f"{BOUNDS}, froms array<int>, ns array<int>, fs array<double>, places array<array<int>>"
RECORDS = "entry_id string, seq long, block long, slot int, n int"
DEAD = "segment string, block long, slot int, n int"
_ITEMS = {"offs": pa.int32(), "bits": pa.int64(), "f_max": pa.float64(), "n_min": pa.int32(), "froms": pa.int32(), "ns": pa.int32(), "fs": pa.float64(), "places": pa.list_(pa.int32())}
_MADE = pa.schema(
    [("token", pa.string()), ("first", pa.int64()), *[(c, pa.list_(t)) for c, t in _ITEMS.items()]]
    + [("entry_id", pa.string()), ("seq", pa.int64()), ("block", pa.int64()), ("slot", pa.int32()), ("n", pa.int32())]
)
_MADE_SQL = f"{BLOCKS}, entry_id string, seq long, block long, slot int, n int"


@dataclass
class Search:
    """The k best (id, seq, score), and what was read: blocks and postings that match, and those that were scored."""

    hits: list[tuple[str, int, float]]
    blocks: int
    scored_blocks: int
    postings: int
    scored_postings: int


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most GROUP * SLOTS records, and of HELD tokens if they are more than one."""
    for b in batches:
        ends = np.cumsum(sum(np.diff(b.column(2 + c).offsets.to_numpy()).astype(np.int64) for c in range(columns)))
        at = 0
        while at < len(b):
            most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right"))
            to = min(len(b), at + GROUP * SLOTS, max(at + 1, most))
            yield b.slice(at, to - at)
            at = to


def _maker(weights: tuple[float, ...], stemmed: bool, batch_no: int):
    """Numbers the records of each group, the shorter first, and makes their rows, those of blocks in the order of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        at = (batch_no << 40) + (TaskContext.get().partitionId() << 24)
        factor = np.array(weights)
        for b in _groups(batches, len(weights)):
            words = [b.column(2 + c) for c in range(len(weights))]
            sizes = np.stack([np.diff(w.offsets.to_numpy()) for w in words])
            n = sizes.sum(axis=0).astype(np.int32)
            number = np.empty(len(b), np.int64)
            order = np.argsort(n, kind="stable")
            number[order] = np.arange(len(b))
            flat = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
            names = flat.dictionary
            if stemmed:
                words_seen = names.to_pylist()
                if len(known) > 200_000:
                    known.clear()
                for w in words_seen:
                    if w not in known:
                        known[w] = stem(w)
                names = pa.array([known[w] for w in words_seen], pa.string())
            kinds = names.unique().sort()
            key = pc.index_in(names, kinds).to_numpy(zero_copy_only=False).astype(np.int64)[flat.indices.to_numpy()]
            del flat
            key <<= 32
            key |= np.concatenate([np.repeat(number, s) for s in sizes])
            col = np.repeat(np.arange(len(weights), dtype=np.int32), sizes.sum(axis=1))
            place = np.concatenate([np.arange(s.sum(), dtype=np.int32) - np.repeat((np.cumsum(s) - s).astype(np.int32), s) for s in sizes])
            place += col * COLUMN
            # places of a record and token come in their order, and the sort keeps it
            by = np.argsort(key, kind="stable")
            key, place, col = key[by], place[by], col[by]
            del by
            # where records, blocks and tokens begin: in the places, the records and the blocks
            hit = _starts(key)
            owner = key[hit] & 0xFFFFFFFF
            block = _starts(key[hit] // SLOTS)
            token = _starts(key[hit][block] >> 32)
            lengths = n[order][owner]
            f = np.add.reduceat(factor[col], hit) if len(hit) else np.empty(0)
            fold = lambda how, x: how.reduceat(x, block) if len(block) else x
            ends = lambda starts, size: pa.array(np.append(starts, size).astype(np.int32))
            by_block, by_hit = ends(token, len(block)), ends(block[token], len(hit))
            held_before = block - np.repeat(block[token], np.diff(np.append(token, len(block))))
            listed = {
                "offs": (by_block, (owner[block] // SLOTS).astype(np.int32)), "bits": (by_block, fold(np.bitwise_or, np.left_shift(np.uint64(1), (owner % SLOTS).astype(np.uint64))).view(np.int64)),
                "f_max": (by_block, fold(np.maximum, f)), "n_min": (by_block, fold(np.minimum, lengths)), "froms": (by_block, held_before.astype(np.int32)),
                "ns": (by_hit, lengths), "fs": (by_hit, f), "places": (by_hit, pa.ListArray.from_arrays(ends(hit, len(key)), pa.array(place))),
            }
            made = {c: pa.ListArray.from_arrays(to, x if isinstance(x, pa.Array) else pa.array(x)) for c, (to, x) in listed.items()}
            made |= {"token": kinds, "first": pa.array(np.full(len(token), at))}
            held = {
                "block": pa.array(at + number // SLOTS), "slot": pa.array((number % SLOTS).astype(np.int32)),
                "n": pa.array(n), "entry_id": b.column(0), "seq": b.column(1),
            }
            at += -(-len(b) // SLOTS)
            # what is not sent goes before the next group's memory is taken
            del key, place, col, hit, owner, block, lengths, f, listed, held_before
            for some, size in ((made, len(token)), (held, len(b))):
                full = pa.RecordBatch.from_arrays([some.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in _MADE], schema=_MADE)
                for start in range(0, size, SENT):
                    yield full.slice(start, SENT)
            del made, held, some, full

    return run


def _by_block(rows: DataFrame, *hits: str) -> DataFrame:
    """(token, block, bits, and each block's part of the named columns)."""
    held = lambda i: F.bit_count(F.get("bits", i)).cast("int")
    part = lambda c, i: F.slice(F.col(c), F.get("froms", i) + 1, held(i)).alias(c)
    return rows.select("token", F.inline(F.transform("offs", lambda o, i: F.struct((F.col("first") + o).alias("block"), F.get("bits", i).alias("bits"), *[part(c, i) for c in hits]))))


def _by_hit(**items: str) -> Column:
    """A row for each record of a block: its slot, and items of other columns under the names given."""
    slots = F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.call_function("getbit", F.col("bits"), s) == 1)
    return F.inline(F.arrays_zip(slots.alias("slot"), *[F.col(c).alias(a) for a, c in items.items()]))


def _bit(slot: str = "slot") -> Column:
    return F.expr(f"shiftleft(1L, {slot})")


class BlockIndex:
    """Segments below a folder. weights: of the columns; stemmed, fold: as in lexical.postings."""

    def __init__(self, spark: SparkSession, root: str, weights: dict[str, float] = WEIGHTS, stemmed: bool = True, fold: bool = True):
        self.spark, self.root, self.weights, self.stemmed, self.fold = spark, root.rstrip("/"), weights, stemmed, fold

    # folders

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self, pattern: str) -> list[str]:
        """Names of the folders that are whole."""
        at, fs = self._at(f"{self.root}/{pattern}/_WHOLE")
        return [f.getPath().getParent().getName().split("=", 1)[1] for f in fs.globStatus(at) or []]

    def _mark(self, folder: str) -> None:
        at, fs = self._at(f"{self.root}/{folder}/_WHOLE")
        fs.create(at, True).close()

    def _drop(self, folder: str) -> None:
        at, fs = self._at(f"{self.root}/{folder}")
        fs.delete(at, True)

    def segments(self) -> list[str]:
        """`first-last` of the segments in force: whole, and covered by no other whole one; in the order of batches."""
        runs = sorted((tuple(map(int, s.split("-"))) for s in self._marked("segment=*")), key=lambda r: (r[0], -r[1]))
        out: list[tuple[int, int]] = []
        for r in runs:
            if not out or r[1] > out[-1][1]:
                out.append(r)
        return [f"{a}-{b}" for a, b in out]

    def batches(self) -> list[int]:
        """Batches that segments in force cover."""
        return [b for s in self.segments() for b in range(int(s.split("-")[0]), int(s.split("-")[1]) + 1)]

    def _read(self, kind: str, schema: str, segments: list[str]) -> DataFrame:
        own = F.col("token" if kind == "blocks" else "block").isNotNull()
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/segment={s}/rows").where(own) for s in segments]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], schema)

    def dead(self, segments: list[str] | None = None) -> DataFrame:
        """Slots of rows of the segments in force that a later write replaced or deleted."""
        segments = self.segments() if segments is None else segments
        found = [f"{self.root}/dead={b}/slots" for b in self._marked("dead=*")]
        rows = self.spark.read.schema(DEAD).parquet(*found) if found else self.spark.createDataFrame([], DEAD)
        return rows.where(F.col("segment").isin(segments))

    # writes

    def add(self, rows: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """Indexes a batch: rows (entry_id, seq, the columns), of which gone (entry_id, seq) are dead, as may be rows of earlier batches."""
        kinds = dict(rows.dtypes)
        text = lambda c: F.concat_ws(" ", c) if kinds[c].startswith("array") else F.col(c)
        words = [tokens(text(c), self.fold).alias(c) for c in self.weights]
        made = rows.select("entry_id", F.col("seq").cast("long"), *words).mapInArrow(_maker(tuple(self.weights.values()), self.stemmed, batch), _MADE_SQL)
        name = f"{batch}-{batch}"
        folder = f"{self.root}/segment={name}"
        self._kept(made).mode("overwrite").parquet(f"{folder}/rows")  # both kinds in one pass
        self._add_stats(folder)
        if gone is not None:
            self.bury(gone, batch)
        self._mark(f"segment={name}")

    def bury(self, gone: DataFrame, batch: int) -> None:
        """Marks rows (entry_id, seq) of segments in force, and of the batch itself, as dead by this batch."""
        names = sorted({*self.segments(), f"{batch}-{batch}"})
        rows = reduce(DataFrame.unionByName, [self._read("records", RECORDS, [s]).withColumn("segment", F.lit(s)) for s in names])
        found = rows.join(gone.select("entry_id", F.col("seq").cast("long")), ["entry_id", "seq"], "left_semi")
        found.select("segment", "block", "slot", "n").write.mode("overwrite").parquet(f"{self.root}/dead={batch}/slots")
        self._mark(f"dead={batch}")

    @staticmethod
    def _kept(rows: DataFrame):
        return rows.write.options(**{"compression": "zstd", "parquet.page.row.count.limit": str(PAGE)})

    def _write(self, name: str, blocks: DataFrame, records: DataFrame) -> None:
        folder = f"{self.root}/segment={name}"
        blocks = blocks.select(*[f.split()[0] for f in BLOCKS.split(", ")])
        # a range of a token is one of groups, so a common token is many partitions
        self._kept(blocks.repartitionByRange("token", "first").sortWithinPartitions("token", "first")).mode("overwrite").parquet(f"{folder}/rows")
        rows = records.select(*[c.split()[0] for c in RECORDS.split(", ")])
        self._kept(rows.repartitionByRange("block").sortWithinPartitions("block", "slot")).mode("append").parquet(f"{folder}/rows")
        self._add_stats(folder)

    def _add_stats(self, folder: str) -> None:
        """One row."""
        stats = self.spark.read.schema(RECORDS).parquet(f"{folder}/rows").where("block is not null").agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
        stats.write.mode("overwrite").parquet(f"{folder}/stats")

    def compact(self) -> list[str]:
        """Merges the latest segments while FANOUT of them are of one size class; returns the segments in force."""
        while True:
            names = self.segments()
            sizes = self._sizes(names)
            level = lambda s: 0 if sizes[s][0] < SMALLEST else 1 + int(math.log(sizes[s][0] / SMALLEST, FANOUT))
            tail = 1
            # a batch number without a segment may belong to a writer that has not ended
            while tail < len(names) and level(names[-tail - 1]) <= level(names[-1]) and int(names[-tail - 1].split("-")[1]) + 1 == int(names[-tail].split("-")[0]):
                tail += 1
            if tail < FANOUT:
                return names
            self._merge(names[-tail:])

    def _merge(self, names: list[str]) -> None:
        """One segment of the live records of several, which end with the latest: so no dead slot of it is known yet."""
        first, last = names[0].split("-")[0], names[-1].split("-")[1]
        gone = self.dead(names).select("block", "slot")
        live = self._read("records", RECORDS, names).join(gone, ["block", "slot"], "left_anti")
        # the new numbers are written with the old ones, then read from there
        at = F.monotonically_increasing_id()
        number = live.repartitionByRange("n", "block", "slot").sortWithinPartitions("n", "block", "slot").withColumn("at", at)
        split = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        number = number.select(
            "entry_id", "seq", "n", F.col("block").alias("was"), F.col("slot").alias("was_slot"),
            (F.lit((int(last) << 40) + (1 << 39)) + split[0] * (1 << 24) + F.shiftright(split[1], 6)).alias("block"), split[1].bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot"),
        )
        draft = f"{self.root}/draft-{uuid.uuid4().hex}"
        number.write.parquet(draft)
        number = self.spark.read.schema(number.schema).parquet(draft)
        old = _by_block(self._read("blocks", BLOCKS, names), "ns", "fs", "places").select("token", F.col("block").alias("was"), _by_hit(n="ns", f="fs", places="places")).withColumnRenamed("slot", "was_slot")
        moved = old.join(number.select("was", "was_slot", "block", "slot"), ["was", "was_slot"])
        # a group has GROUP * SLOTS records at most, and both sums use one exchange
        moved = moved.withColumn("first", F.col("block") - F.pmod("block", F.lit(GROUP))).repartition("token", "first")
        hits = F.sort_array(F.collect_list(F.struct("slot", "n", "f", "places")))
        moved = moved.groupBy("token", "first", "block").agg(F.bit_or(_bit()).alias("bits"), F.max("f").alias("f_max"), F.min("n").alias("n_min"), hits.alias("hits"))
        each = F.struct((F.col("block") - F.col("first")).cast("int").alias("off"), "bits", "f_max", "n_min", "hits")
        moved = moved.groupBy("token", "first").agg(F.sort_array(F.collect_list(each)).alias("b"))
        items = {"offs": F.col("b.off"), **{c: F.col(f"b.{c}") for c in ("bits", "f_max", "n_min")}, "hits": F.flatten("b.hits")}
        before = lambda b, i: F.aggregate(F.slice("bits", F.lit(1), i), F.lit(0), lambda s, x: s + F.bit_count(x).cast("int"))
        moved = moved.select("token", "first", *[v.alias(c) for c, v in items.items()]).withColumn("froms", F.transform("bits", before))
        moved = moved.withColumns({"ns": F.col("hits.n"), "fs": F.col("hits.f"), "places": F.col("hits.places")})
        self._write(f"{first}-{last}", moved, number)
        self._mark(f"segment={first}-{last}")
        for s in names:
            self._drop(f"segment={s}")
        at_draft, fs = self._at(draft)
        fs.delete(at_draft, True)

    def _sizes(self, names: list[str]) -> dict[str, tuple[int, int]]:
        if not names:
            return {}
        parts = [self.spark.read.schema("records long, tokens long").parquet(f"{self.root}/segment={s}/stats").withColumn("segment", F.lit(s)) for s in names]
        return {r["segment"]: (r["records"], r["tokens"]) for r in reduce(DataFrame.unionByName, parts).collect()}  # a row a segment

    def totals(self, names: list[str] | None = None) -> tuple[int, float]:
        """Live records, and their mean number of tokens."""
        names = self.segments() if names is None else names
        sizes = self._sizes(names).values()
        gone = self.dead(names).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        total, words = sum(a for a, _ in sizes) - gone[0], sum(b for _, b in sizes) - gone[1]
        return total, words / max(1, total)

    # search

    def search(self, terms: list[Term], k: int) -> Search:
        """The k live records of the lowest (best) score."""
        names = self.segments()
        total, mean = self.totals(names)
        if not terms or not total or k < 1:
            return Search([], 0, 0, 0, 0)
        slots = [(t, j, part, term.prefix and j == len(term.parts) - 1) for t, term in enumerate(terms) for j, part in enumerate(term.parts)]
        token = F.col("token")
        wanted = reduce(lambda a, b: a | b, [_matches(token, part, prefix) for _, _, part, prefix in slots])
        which = F.filter(F.array(*[F.when(_matches(token, part, prefix), F.struct(F.lit(t).alias("term"), F.lit(j).alias("part"))) for t, j, part, prefix in slots]), lambda s: s.isNotNull())
        dead = self.dead(names).groupBy("block").agg(F.bit_or(_bit()).alias("dead"))
        alive = lambda rows: rows.join(dead, "block", "left").withColumn("dead", F.coalesce("dead", F.lit(0).cast("long")))
        hits = self._read("blocks", BLOCKS, names).where(wanted)

        found = self._read("blocks", BOUNDS, names).where(wanted)
        bound = lambda o, i: F.struct((F.col("first") + o).alias("block"), *[F.get(c, i).alias(c) for c in ("bits", "f_max", "n_min")])
        found = found.select("token", F.inline(F.transform("offs", bound))).select("*", F.inline(which))
        parts = found.groupBy("block", "term", "part").agg(F.bit_or("bits").alias("bits"), F.sum("f_max").alias("f"), F.min("n_min").alias("n"), F.sum(F.bit_count("bits")).alias("rows"))
        parts = alive(parts).withColumn("bits", F.col("bits").bitwiseAND(F.bitwise_not("dead"))).where("bits <> 0").drop("dead")
        long = [t for t, term in enumerate(terms) if len(term.parts) > 1]
        bounds = parts.where(~F.col("term").isin(long)).select("block", "term", "bits", "f", "n", "rows") if long else parts.drop("part")
        phrases = None
        if long:
            meet = parts.where(F.col("term").isin(long)).groupBy("block", "term").agg(F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("parts"))
            meet = meet.where((F.col("parts") == F.get(F.array(*[F.lit(len(t.parts)) for t in terms]), F.col("term"))) & (F.col("bits") != 0)).select("block", "term", F.col("bits").alias("both"))
            phrases = self._phrases(_by_block(hits, "ns", "places").select("block", "bits", "ns", "places", F.inline(which)).join(meet, ["block", "term"]), terms).persist()
            exact = phrases.groupBy("block", "term").agg(F.bit_or(_bit()).alias("bits"), F.max("f").alias("f"), F.min("n").alias("n"), F.count(F.lit(1)).alias("rows"))
            bounds = bounds.unionByName(exact)
        bounds = bounds.persist()
        held = {r["term"]: r["df"] for r in bounds.groupBy("term").agg(F.sum(F.bit_count("bits")).alias("df")).collect()}  # a row a term
        if not held:
            return Search([], 0, 0, 0, 0)
        raw = {t: math.log((total - df + 0.5) / (df + 0.5)) for t, df in held.items()}
        idf = F.create_map(*[x for t, v in raw.items() for x in (F.lit(t), F.lit(v if v > 0 else LEAST_IDF))])
        share = F.element_at(idf, F.col("term")) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.lit(mean or 1.0)))
        ranked = bounds.groupBy("block").agg(F.sum(share).alias("most"), F.sum("rows").alias("rows")).persist()

        best: list[tuple[str, int, float]] = []
        blocks, rows = ranked.agg(F.count(F.lit(1)), F.sum("rows")).first()
        done_blocks = done_rows = 0
        floor, size = None, FIRST  # bounds from floor up are scored
        while done_blocks < blocks:
            left = ranked if floor is None else ranked.where(F.col("most") < floor)
            if len(best) == k:
                # a bound may be short of a score by rounding alone
                left = left.where(F.col("most") * (1 + 1e-9) >= -best[-1][2])
                n = left.count()
                if not n:
                    break
                size = n if n <= size * GROWTH else size * GROWTH
            cut = left.orderBy(F.desc("most")).limit(size).agg(F.min("most")).first()[0]
            chosen = left.where(F.col("most") >= cut)
            b, r = chosen.agg(F.count(F.lit(1)), F.sum("rows")).first()
            scored = self._scores(hits, phrases, chosen.select("block"), terms, which, share, alive, names)
            best = sorted([*best, *map(tuple, scored.orderBy("score", "entry_id").limit(k).collect())], key=lambda x: (x[2], x[0]))[:k]
            done_blocks, done_rows, floor = done_blocks + b, done_rows + r, cut
            size = size if len(best) == k else size * GROWTH
        for table in (phrases, bounds, ranked):
            if table is not None:
                table.unpersist()
        return Search(best, blocks, done_blocks, rows, done_rows)

    def _phrases(self, hits: DataFrame, terms: list[Term]) -> DataFrame:
        """(block, slot, n, term, f) of the records in which the words of a phrase stand side by side."""
        each = hits.select("block", "term", "part", "both", _by_hit(n="ns", places="places")).where(F.expr("both & shiftleft(1L, slot)") != 0)
        each = each.select("block", "slot", "n", "term", "part", F.explode("places").alias("place"))
        starts = each.groupBy("block", "slot", "n", "term", (F.col("place") - F.col("part")).alias("at")).agg(F.count(F.lit(1)).alias("parts"))
        starts = starts.where(F.col("parts") == F.get(F.array(*[F.lit(len(t.parts)) for t in terms]), F.col("term")))
        weight = F.get(F.array(*[F.lit(float(w)) for w in self.weights.values()]), F.floor(F.col("at") / COLUMN).cast("int"))
        return starts.groupBy("block", "slot", "n", "term").agg(F.sum(weight).alias("f"))

    def _scores(self, hits: DataFrame, phrases: DataFrame | None, chosen: DataFrame, terms: list[Term], which: Column, share: Column, alive, names: list[str]) -> DataFrame:
        """(entry_id, seq, score) of the live records in the chosen blocks that hold a term."""
        one = [t for t, term in enumerate(terms) if len(term.parts) == 1]
        rows = alive(_by_block(hits, "ns", "fs").join(chosen, "block")).select("block", "bits", "ns", "fs", "dead", F.inline(which)).where(F.col("term").isin(one))
        rows = rows.select("block", "term", "dead", _by_hit(n="ns", f="fs")).where(F.expr("dead & shiftleft(1L, slot)") == 0)
        hits = rows.groupBy("block", "slot", "n", "term").agg(F.sum("f").alias("f"))
        if phrases is not None:
            hits = hits.unionByName(phrases.join(chosen, "block").select("block", "slot", "n", "term", "f"))
        # at most 24 terms, added in their order, so equal records score equally to the last bit
        scored = hits.groupBy("block", "slot").agg(F.sort_array(F.collect_list(F.struct("term", share.alias("x")))).alias("parts"))
        scored = scored.select("block", "slot", (-F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["x"])).alias("score"))
        known = self._read("records", RECORDS, names).join(chosen, "block").select("block", "slot", "entry_id", "seq")
        return scored.join(known, ["block", "slot"]).select("entry_id", "seq", "score")
