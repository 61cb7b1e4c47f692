"""Personal data, spelling variants and the audit of filters against plain Python."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from wrenfold.llm import filter_audit, private_data, queries, variants
from wrenfold.llm.common import read_table

DOCS = "doc_id long, text string, source string, mask int, kind string, n long, row long"


def table(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, s, 7, "x", 8, 9) for i, t, s in rows], DOCS)


# ---- audit of filters


def brute_audit(docs, labels):
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)}
        fails |= {"D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        rows.append((s or "", i, fails))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if r[2][f]]
                left = [r for r in left if not r[2][f]]
                shapley[f] += len(gone)
                failing = [r for r in mine if r[2][f]]
                alone = sum(sum(r[2].values()) == 1 for r in failing)
                out[part, order, step] = [len(left), len(gone), len(failing) - len(gone), alone, sum(r[1] in good for r in gone), sum(r[1] in toxic for r in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.collect()}


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    texts = [None, "", " \t", "A B C", "a b # c", "word " * 60, " ".join(f"w{k}" for k in range(60)), " ".join(f"W{k}" for k in range(60)) + " é😀", long, "x y\x1cz"]
    rng = random.Random(3)
    docs = [(rng.choice([None, *range(25)]), rng.choice(texts), rng.choice([None, "", "s", "t"])) for _ in range(120)]
    docs += [(5, "a b # c", "s"), (5, "a b # c", "s"), (5, "a b # c", "t"), (-3, long, None)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(20)] + [(1, None, 1), (4, 1, None), (None, 1, 1)]
    flags = spark.createDataFrame([(i, q, None if t is None else int(t), "z") for i, q, t in labels], "doc_id long, quality int, toxic int, part string")
    for parts in (1, 5):
        got = audit_rows(filter_audit.audit(table(spark, docs).repartition(parts), flags))
        assert got == brute_audit(docs, [(i, q, int(t or 0)) for i, q, t in labels])
    assert filter_audit.audit(table(spark, []), flags).count() == 0
    assert audit_rows(filter_audit.audit(table(spark, docs[:3]), flags.limit(0))) == brute_audit(docs[:3], [])


def test_copies_across_fillings_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD", 500)
    docs = [(k * 7919 % 100, f"text {k % 9}", "s") for k in range(400)]
    entries = [e for part in (docs[:150], docs[150:]) for e in filter_audit._decided(part, [])]
    got = Counter()
    for i, p, mask, n in filter_audit._chained(iter(entries), 1):
        got[i, mask] += n
    least = {t: min(i for i, u, _ in docs if u == t) for _, t, _ in docs}
    assert got == Counter((i, int(i > least[t])) for i, t, _ in docs)


def test_colliding_fingerprints_join_nothing():
    entries = [(1, (5, b"a", 0, {"s": 1})), (1, (3, b"b", 0, {"s": 1})), (1, (4, b"a", 0, {"s": 2})), (1, (4, b"a", 0, {"t": 1})), (1, (9, b"b", 0, {"s": 1}))]
    got = Counter(filter_audit._chained(iter(entries), 16))
    assert got == Counter([(5, "s", 16, 1), (9, "s", 16, 1), (4, "s", 0, 2), (4, "t", 0, 1), (3, "s", 0, 1)])


def test_audit_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    theirs = con.sql(queries.ORACLES["op13_filter_audit"])
    assert theirs.columns == queries.op13_filter_audit(spark, SMALL).columns
    assert sorted(map(tuple, queries.op13_filter_audit(spark, SMALL).collect())) == sorted(theirs.fetchall())


# ---- spelling variants


def brute_near(words):
    """Pairs of words that one edit parts, by trying every edit."""
    letters, known, pairs = {c for w in words for c in w}, set(words), set()
    for w in known:
        tried = {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in ("", *letters) if c or k}
        pairs |= {(w, v) for v in tried & known if v != w}
    return pairs


def brute_variants(counts):
    near = defaultdict(set)
    for a, b in brute_near(counts):
        near[a].add(b)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def brute_counts(docs):
    counts = Counter()
    for i, t, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return counts


@settings(max_examples=150, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=6), max_size=60))
def test_near_words_of_a_bundle(words):
    got = []
    for length in range(1, 8):
        some = sorted(w for w in words if len(w) in (length - 1, length))
        for first, last in ((0, length // 2), (length // 2, length)):
            for i, j in zip(*variants.near_in(some, length, first, last), strict=True):
                got += [(some[i], some[j])] if len(some[i]) == length else [(some[i], some[j]), (some[j], some[i])]
    assert len(got) == len(set(got)) and set(got) == brute_near(words)


def test_wavelet_tree():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64, 200):
        values = rng.permutation(n)
        tree = variants.WaveletTree(values)
        a, b = np.sort(rng.integers(0, n + 1, (2, 300)), axis=0)
        c, d = np.sort(rng.integers(0, n + 1, (2, 300)), axis=0)
        q, v = tree.report(a, b, c, d)
        want = {(k, x) for k in range(300) for x in values[a[k] : b[k]].tolist() if c[k] <= x < d[k]}
        assert set(zip(q.tolist(), v.tolist(), strict=True)) == want and len(q) == len(want)


@pytest.mark.parametrize("bundle", [30, 1_000_000])
def test_variants_of_hot_beginnings_and_chains(spark, bundle):
    """A third of the words share a beginning, another third an end; bundles of 30 letters make groups split."""
    rng = random.Random(8)
    some = ["".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(150)]
    counts = {w: rng.choice([3, 5, 10, 40]) for w in ["inter" + x for x in some] + [x + "ation" for x in some] + ["".join(rng.choice("abcdé") for _ in range(7)) for _ in range(150)]}
    counts |= {"a" * 300: 3, "a" * 301: 9, "chaina": 3, "chainab": 6, "chainabc": 13, "chainabcd": 26}
    rows = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, key int")
    got = {r["word"]: tuple(r)[1:] for r in variants.variants(rows, bundle=bundle).collect()}
    assert got == brute_variants(counts)
    assert got["chaina"][1] == "chainabcd"


def test_counted_words(spark):
    docs = [(1, None, None), (2, "", None), (3, "ÀÉ été Éa abc ABC x" * 40, None), (3, "abc abc", None), (3, "abc abc", None), (None, "word wörd ß×÷", None), (9, "y" * 70_000 + " Y", None)]
    docs += [(k, "typing errors are made by rule here " * 3, None) for k in range(100, 160)]
    got = {r["word"]: r["n"] for r in variants.counted(table(spark, docs)).collect()}
    assert got == dict(brute_counts(docs))
    assert variants.variants(variants.counted(table(spark, []))).count() == 0


def test_variants_query(spark):
    docs = [tuple(r) for r in read_table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    counts = {w: n for w, n in brute_counts(docs).items() if n >= 3 and len(w) >= 5}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.op12_spelling_variants(spark, SMALL).collect()}
    assert got == brute_variants(counts) and len(got) > 1000


# ---- personal data

EMAIL, IP, CARD, PHONE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def brute_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x // 10 + x % 10
    return total % 10 == 0


def brute_base(text):
    out = []
    for kind, (name, pattern) in enumerate({"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(len(p) < 4000 and int(p) <= 255 for p in m.group().split(".")) if name == "ip" else True, "card": 12 <= len(digits) <= 19 and brute_luhn(digits), "phone": 9 <= len(digits) <= 15}[name]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def brute_disclosed(docs, window=8, support=3, alpha=0.9):
    """(term, entity) -> kind, by the definition, from whole texts."""
    own, both, contexts = Counter(), Counter(), defaultdict(set)
    held = []
    for text in docs:
        text = text or ""
        spans = private_data.base_spans(text)
        terms = [(m.start(), m.end(), m.group().lower()) for m in private_data.TERM.finditer(text) if m.end() - m.start() >= 3]
        terms = [t for t in terms if not any(s < t[1] and t[0] < e for s, _, e, _ in spans)]
        own.update(t for _, _, t in terms)
        for s, kind, _, value in spans:
            before = [t for a, _, t in terms if a < s][-window:]
            after = [t for a, _, t in terms if a >= s][:window]
            for t in before + after:
                e = f"{private_data.KINDS[kind]}:{value}"
                both[t, e] += 1
                contexts[t, e].add(min((private_data.xxhash.xxh64_intdigest(u) >> 1 for u in set(before + after) - {t}), default=0))
        held.append((terms, {f"{private_data.KINDS[k]}:{v}" for _, k, _, v in spans}))
    near, total = Counter(), sum(own.values())
    for (_, e), n in both.items():
        near[e] += n

    def ratio(b, n, e):
        rarity = -math.log(near[e] / total)
        return 1 + math.log(min(b / n, 1)) / rarity if rarity > 0 else 0

    found = {}
    for (t, e), b in both.items():
        if len(contexts[t, e]) >= support and ratio(b, own[t], e) >= alpha:
            head = t[:2]
            hb, hn = (sum(x for (u, f), x in both.items() if u[:2] == head and f == e), sum(x for u, x in own.items() if u[:2] == head))
            found[t, e] = 4 if ratio(hb, hn, e) < alpha else 5
    return [sorted((a, max(found[t, e] for e in es if (t, e) in found), b) for a, b, t in terms if any((t, e) in found for e in es)) for terms, es in held]


ODD = st.text("a.@-+12 3(é%", max_size=40)


@settings(max_examples=400, deadline=None)
@given(ODD)
def test_patterns(text):
    assert [s[:3] for s in private_data.base_spans(text)] == brute_base(text)


def test_patterns_on_odd_texts():
    for text in ["a@b.c@d.e@f.gg x", "@d.ee@f.gg", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.01.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (366) 555-9807", "é a.b@c-d.ee.", "0" * 30, "+1", "1.1.1." + "9" * 5000]:
        assert [s[:3] for s in private_data.base_spans(text)] == brute_base(text), text
    for text in ("a" * 2_000_000, "1" * 2_000_000, "1." * 1_000_000, "+1((((" * 300_000, "@" * 1_000_000):
        private_data.base_spans(text)  # in time proportional to the length


def private_fixture():
    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [some(40) for _ in range(150)]
    docs += [f"{some(15)} Zorblatt {some(2)} jo.h@mail.example.org {some(2)} qwv77x {some(20)}" for _ in range(6)]
    docs += [f"{some(15)} zoq {some(20)}" for _ in range(40)]  # a class that gives nothing away: zo*
    docs += [docs[152]] * 3 + [f"rare{k} 10.2.3.4 {some(20)}" for k in range(4)] + ["one x@y.zz once"] * 50 + [None, "", "a" * 30_000 + " q@r.st"]
    return docs


def test_disclosing_terms(spark):
    docs = private_fixture()
    got = {}
    rows = private_data.find(table(spark, [(i, t, None) for i, t in enumerate(docs)]), with_text=True).collect()
    for r in rows:
        got[r["doc_id"]] = [tuple(s) for s in r["spans"]]
    added = brute_disclosed(docs)
    assert got == {i: sorted(brute_base(t) + added[i]) for i, t in enumerate(docs)}
    kinds = Counter(k for spans in got.values() for _, k, _ in spans)
    assert kinds[private_data.GENERALISED] >= 6 and kinds[private_data.REMOVED] >= 6
    for r in rows:
        text = docs[r["doc_id"]] or ""
        if not r["spans"]:
            assert r["clean"] == text
        elif "jo.h" in text:
            assert "[EMAIL]" in r["clean"] and "orblatt" not in r["clean"] and "qwv77x" not in r["clean"]
    for i in (0, 190):  # no entity: nothing is taken
        assert got[i] == []


def test_private_edges(spark):
    assert private_data.find(table(spark, [])).count() == 0
    rows = private_data.find(table(spark, [(None, None, None), (1, "a@b.cc", None), (1, "a@b.cc", None)])).collect()
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in rows) == [(0, 0), (1, 1), (1, 1)]


def test_private_query(spark):
    docs = [tuple(r) for r in read_table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    added = dict(zip((i for i, _ in docs), brute_disclosed([t for _, t in docs]), strict=True))
    names = private_data.KINDS
    got = {r["doc_id"]: r for r in queries.op11_private_data(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        base = brute_base(t)
        joined = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)
        r = got[i]
        assert tuple(r)[1:5] == tuple(sum(k == kind for _, k, _ in base) for kind in range(4))
        assert r["base_sha256"] == hashlib.sha256(joined(base).encode()).hexdigest() and r["spans"] == joined(sorted(base + added[i]))
