"""Quality rules and url filters: SQL or brute force on small tables, and the edge cases."""

import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from conftest import SMALL

from wrenfold.llm import quality_rules, queries, url_filters


def brute_repeats(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    return len({i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)})


EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "a b c a b c"), (5, "x\nx\n x\n\n\nx"), (5, "x\nx\n x\n\n\nx"), (None, "#* né 😀 <|>"), (7, "a b"),
    (8, "w " * 5000), (9, "\u00a0a\u2003b \x0bc"), (10, " ".join(f"w{i}" for i in range(20000))),
]


def test_measures(spark):
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in EDGES], "doc_id long, text string, n_words int, fail_bits int")
    got = quality_rules.ledger(rows).collect()
    assert len(got) == len(EDGES)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    for i, t in EDGES:
        if t and len(t) > 50_000:
            continue
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]
        r = by[i, len(words)]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert r["word_chars"] == sum(map(len, words)) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t or "")
        assert r["n_repeat_words"] == (5000 if i == 8 else brute_repeats(t))
    assert by[10, 20000]["n_repeat_words"] == 0


def test_empty(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert quality_rules.ledger(rows).count() == 0
    assert quality_rules.ablation(quality_rules.ledger(rows), "v1").count() == 0


def test_policies_and_ablation(spark):
    entries = spark.createDataFrame([(0,), (0,), (1,), (3,), (4,), (4,), (128,)], "fail_bits long")
    assert entries.where(quality_rules.verdict("base")).count() == 5 and entries.where(quality_rules.verdict("v1")).count() == 3
    got = {r["rule"]: (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) for r in quality_rules.ablation(entries, "v1").collect()}
    assert got["few_words"] == (2, 1, 4) and got["repeated_words"] == (1, 0, 3) and got["many_symbols"] == (2, 2, 5)


@pytest.mark.parametrize("name", ["op1_quality_rules", "op2_url_filters", "op9_nearest_neighbours"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, SMALL)
    theirs = con.sql(queries.ORACLES[name])
    names = sorted(ours.columns)
    assert names == sorted(theirs.columns)
    a = sorted((tuple(r[n] for n in names) for r in ours.collect()), key=repr)
    b = sorted((tuple(r[theirs.columns.index(n)] for n in names) for r in theirs.fetchall()), key=repr)
    assert a == b


def test_host_path_rule(spark):
    urls = {
        "https://A.Example.ORG/es/x?y#z": ("a.example.org", "/es/x", "example.org/es/", "block"),
        "x://example.org": ("example.org", "", None, "allow"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://example.org/": ("example.org", "/", "org/", "allow"),
        "http://myorg/": ("myorg", "/", None, "allow"),
        "a://b.com/fr/#://c": ("b.com", "/fr/", "com/fr/", "allow"),
        "a://É.com?q=/de/": ("É.com", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(rows).collect()}
    assert got == dict(enumerate(urls.values()))
    assert url_filters.judge(rows.limit(0)).count() == 0


def brute_spread(edges, seeds, damping, rounds):
    """Dense PageRank by numpy; hosts without links give their mass back to the seeds."""
    hosts = sorted({h for e in edges for h in e} | set(seeds))
    at = {h: k for k, h in enumerate(hosts)}
    m = np.zeros((len(hosts), len(hosts)))
    for a, b in edges:
        m[at[b], at[a]] += 1
    m /= np.maximum(m.sum(axis=0), 1)
    seed = np.array([seeds.get(h, 0.0) for h in hosts])
    state = seed
    for _ in range(rounds):
        moved = damping * (m @ state)
        state = moved + (1 - moved.sum()) * seed
    return dict(zip(hosts, state.tolist(), strict=True))


def link(h):
    return f'<a href="http://{h}/x">y</a>'


def test_spread_and_threshold(spark):
    pages = [
        (1, "http://good.org/a", link("mid.net") + link("mid.net") + "<a HREF='//far.net/q'>z</a>"), (2, "http://bad.com/de/a", None),
        (3, "http://farm.net/a", link("bad.com")), (4, "http://mid.net/a", link("far.net")), (5, "http://far.net/", ""), (6, "http://alone.net/q", link("alone.net")),
    ]
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filters.judge(rows).collect()}
    edges = [("good.org", "mid.net")] * 2 + [("good.org", "far.net"), ("farm.net", "bad.com"), ("mid.net", "far.net")]
    trust = brute_spread(edges, {"good.org": 1.0}, 0.85, 300)
    distrust = brute_spread([(b, a) for a, b in edges], {"bad.com": 1.0}, 0.85, 300)
    for i, h in ((4, "mid.net"), (5, "far.net"), (1, "good.org")):
        assert abs(got[i]["trust"] - trust[h]) < 1e-5
    assert abs(got[3]["distrust"] - distrust["farm.net"]) < 1e-5 and got[3]["verdict"] == "block" and got[3]["trust"] == 0
    assert got[4]["verdict"] == "allow" and got[6]["verdict"] == "allow" and got[6]["trust"] is None


def test_spread_goes_on_until_it_settles(spark):
    pages = [(0, "http://bad.com/de/a", None)] + [(k, f"http://h{k}.net/", link(f"h{k - 1}.net" if k > 1 else "bad.com")) for k in range(1, 21)]
    got = {r["page_id"]: r for r in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for k in range(1, 21):
        assert got[k]["verdict"] == "block" and abs(got[k]["distrust"] / (got[0]["distrust"] * 0.85**k) - 1) < 1e-5
    ring = spark.createDataFrame([("trust", "a", "b", 1.0), ("trust", "b", "a", 1.0)], "kind string, src string, dst string, w double")
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, seed double")
    scores = {r["host"]: r["score"] for r in url_filters.spread(ring, seeds, damping=0.3, rounds=2).collect()}
    assert abs(scores["a"] - 0.7 / 0.91) < 1e-5 and abs(scores["b"] - 0.21 / 0.91) < 1e-5


def test_thousands_of_hosts_and_a_hub(spark):
    """A made-up web of 2000 hosts, a fifth of whose links lead to one hub, and every third of which links nowhere."""
    rng = random.Random(9)
    names = ["hub.net"] + [f"h{k}.{rng.choice(['net', 'org', 'io'])}" for k in range(2000)]
    pages, edges, seeds = [], [], {}
    for k, h in enumerate(names):
        to = [] if k % 3 == 1 else ["hub.net" if rng.random() < 0.2 else rng.choice(names) for _ in range(6)]
        to = [t for t in to if t != h]
        blocked = k % 7 == 2 and not h.endswith("org")
        pages.append((k, f"http://{'x.com' if blocked else h}/{'de/' if blocked else ''}p", "".join(map(link, to))))
        own = "x.com" if blocked else h
        edges += [(own, t) for t in to if t != own]
        if own.endswith(".org"):
            seeds.setdefault("trust", {}).setdefault(own, 0)
            seeds["trust"][own] += 1
    share = {h: n / sum(seeds["trust"].values()) for h, n in seeds["trust"].items()}
    trust = brute_spread(edges, share, 0.85, 200)
    distrust = brute_spread([(b, a) for a, b in edges], {"x.com": 1.0}, 0.85, 200)
    got = url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), threshold=0.4).collect()
    for r in got:
        t, d = trust.get(r["host"], 0.0), distrust.get(r["host"], 0.0)
        assert abs((r["trust"] or 0) - t) < 1e-5 and abs((r["distrust"] or 0) - d) < 1e-5
        if r["rule"] is None and abs(d - 0.4 * (t + d)) > 1e-6:
            assert r["verdict"] == ("block" if d > 0.4 * (t + d) else "allow")


def test_url_sql_on_a_web(spark, tmp_path):
    """The query, its SQL and numpy on a web with a hub, chains and links without a scheme."""
    rng = random.Random(6)
    names = ["hub.net"] + [f"h{k}.{rng.choice(['net', 'org', 'io'])}" for k in range(300)]
    pages = [(0, "http://x.com/de/p", "")]
    edges = []
    for k, h in enumerate(names[1:]):
        to = ["hub.net" if rng.random() < 0.2 else rng.choice(names) for _ in range(4)] + (["x.com"] if k % 5 == 0 else [])
        to = [t for t in to if t != h] if k % 3 else []
        pages.append((k + 1, f"http://{h}/p", " ".join(f'<A HREF = "{rng.choice(["https:", ""])}//{t.upper()}/q">' for t in to) + "<a xhref='http://no.net/'>"))
        edges += [(h, t) for t in to]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    ours = {r["page_id"]: r for r in queries.op2_url_filters(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    theirs = con.sql(queries.ORACLES["op2_url_filters"])
    at = {c: k for k, c in enumerate(theirs.columns)}
    org = [h for h in names if h.endswith(".org")]
    trust = brute_spread(edges, dict.fromkeys(org, 1 / len(org)), 0.85, 300)
    distrust = brute_spread([(b, a) for a, b in edges], {"x.com": 1.0}, 0.85, 300)
    rows = theirs.fetchall()
    assert len(rows) == len(ours) == len(pages) and {r[at["verdict"]] for r in rows} == {"allow", "block"}
    for r in rows:
        q, host = ours[r[at["page_id"]]], r[at["host"]]
        assert (q["host"], q["path"], q["rule"], q["verdict"]) == tuple(r[at[c]] for c in ("host", "path", "rule", "verdict"))
        for kind, brute in (("trust", trust), ("distrust", distrust)):
            assert abs((q[kind] or 0) - (r[at[kind]] or 0)) < 1e-6 and abs((q[kind] or 0) - brute.get(host, 0.0)) < 1e-6


def test_sources_hold_no_control_characters():
    top = Path(queries.__file__).parents[2]
    for path in [*top.glob("*.py"), *top.glob("wrenfold/**/*.py"), *top.glob("tests/**/*.py")]:
        assert not re.search(r"[\x00-\x08\x0b-\x1f\x7f]", path.read_text()), path


def test_no_python_on_the_native_paths(spark):
    for df in (queries.op1_quality_rules(spark, SMALL), queries.op2_url_filters(spark, SMALL)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
