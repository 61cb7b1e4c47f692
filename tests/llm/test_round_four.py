"""What the findings of round 3 asked for, held to plain Python."""

import numpy as np

from pyspark.sql import functions as F

from wrenfold.llm import jaccard, lm, simhash


def test_lm_learns_from_every_place(spark, monkeypatch):
    """Each token of each text is a place of the fit once, with the two before it, also where texts are cut; in one task and in rounds of many."""
    monkeypatch.setattr(lm, "PIECE", 3)
    monkeypatch.setattr(lm, "WORDS", 5)
    texts = ["a b c d e f a b", "", "c", "a b c", "f e d c b a a", "f e d c b a a"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    model, _ = lm.train(docs)
    places, of = model.lookup()
    want = []
    for t in texts:
        row = [0, 0, *[int(of[places[x]]) for x in t.split()], 0]
        want += [(row[k - 2], row[k - 1], row[k]) for k in range(2, len(row))]
    got = []
    for r in lm.coded(docs, model).collect():
        codes = [lm.CONTEXT, lm.CONTEXT, *np.frombuffer(r["classes"], np.uint16).tolist()]
        for k in range(2, len(codes)):
            if codes[k] < lm.CONTEXT:
                near = codes[k - 1] % lm.CONTEXT
                got.append((codes[k - 2] % lm.CONTEXT if near else 0, near, codes[k]))
    assert sorted(got) == sorted(want) and len(want) == model.tokens
    # a task for every two places or so: all of the rounds together still see all
    monkeypatch.setattr(lm, "STEPS", 1)
    monkeypatch.setattr(lm, "RUN", 2)
    monkeypatch.setattr(lm, "RUNS", 1)
    weights = lm.fitted(lm.coded(docs, model), model)
    assert all(np.isfinite(x).all() for x in weights.values())
    begun = lm.State.begun(model.class_counts()).w
    assert all((weights["s"][k] != begun["s"][k]).any() for k in {t for _, _, t in want})


def test_near_duplicates_go_through_operator_5(spark, monkeypatch):
    """With MinHash bands that never meet, what the fingerprints link is found, and whole sets still decide."""
    base = [f"w{k}" for k in range(2000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(reversed(base)), "a b c d e f", "x y z"]
    one, two = (simhash.fingerprint(t, 5) for t in texts[:2])
    limit = bin((one ^ two) & (2**64 - 1)).count("1")
    assert limit <= 10
    monkeypatch.setattr(jaccard, "LIMIT", max(3, limit))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = jaccard._sets(rows.select(F.struct("doc_id", "text").alias("doc")), "text", 5)
    reps = sets.select("set", "fp", F.col("doc.doc_id").alias("doc_id"))
    ids = {r["set"]: r["doc_id"] for r in reps.collect()}
    assert {r["doc_id"]: r["fp"] for r in reps.collect()} == {k: simhash.fingerprint(t, 5) for k, t in enumerate(texts)}
    found = {frozenset((ids[r["a"]], ids[r["b"]])) for r in jaccard.alike(reps.select("set", "fp")).collect()}
    assert frozenset((0, 1)) in found
    assert {r["doc_id"] for r in jaccard.one_of_each(rows).collect()} == {0, 2, 3, 4}
