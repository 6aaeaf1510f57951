"""The pipeline's near-dedup stage against all pairs, on near copies and a crowd of them."""

import itertools
import random

import numpy as np

import corpus_pipeline
from sentrel.llm import near_copies
from sentrel.llm.common import Scratch


def edited(rnd, text, n):
    words = text.split()
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


def similarity(a, b):
    cut = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))} if (t or "").split() else set()
    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rnd = random.Random(21)
    base = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(20, 300))) for _ in range(25)]
    texts = [None, "", " \n", "one", "One", "one two"]
    for t in base:
        texts += [t, t, *[edited(rnd, t, rnd.choice([1, 2, 4, 8, 30])) for _ in range(4)]]
    texts += [edited(rnd, base[0], 3) for _ in range(40)]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return rows


def test_stage_leaves_one_of_each_component(spark):
    rows = [*corpus(), (None, "no id")]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(rows, 2):
        if i is not None and j is not None and similarity(a, b) >= 0.8:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = [r["doc_id"] for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()]
    assert len(got) == len(set(got)) and set(got) == {find(i) for i, _ in rows}
    assert corpus_pipeline.near_dedup_stage(spark, docs.where("false"), "").count() == 0


def test_all_similar_pairs_are_connected_in_a_band_of_several_components(spark):
    rnd = random.Random(4)
    t = " ".join(f"w{i}" for i in range(60))
    texts = [edited(rnd, t, n) for n in (0, 1, 1, 2, 2, 3, 3, 4, 4, 6)]
    sets = [near_copies.shingles(x) for x in texts]
    # All share one band: the first one's star misses links between the others.
    rows = [(k, k, [5]) for k in range(len(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {r["doc_id"]: r["fp"] for r in near_copies.marked(docs, ["doc_id"], False).collect()}
    distinct = spark.createDataFrame([(fps[k], k, b) for k, _, b in rows], "fp long, first long, bands array<long>")
    scratch = Scratch(spark, "test")
    roots = {r["node"]: r["root"] for r in near_copies.components(near_copies.links(docs, distinct, scratch), scratch).collect()}
    similar = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    assert similar and all(roots[fps[a]] == roots[fps[b]] for a, b in similar)


def test_operator_9_finds_candidates(spark):
    """Copies that differ in one of many runs are linked by fingerprints alone."""
    rnd = random.Random(9)
    base = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(3000)) for _ in range(4)]
    docs = spark.createDataFrame(list(enumerate([*base, *[f"{t} tail" for t in base]])), "doc_id long, text string")
    known = near_copies.marked(docs, ["doc_id"], True).collect()
    fps = {r["doc_id"]: r["fp"] for r in known}
    distinct = spark.createDataFrame([(r["fp"], r["doc_id"], [], r["sim"]) for r in known], "fp long, first long, bands array<long>, sim long")
    scratch = Scratch(spark, "test")
    found = near_copies.simhash_pairs(distinct, scratch)
    near = {(r["a"], r["b"]) for r in near_copies.links(docs, distinct, scratch, candidates=found).collect()}
    assert near == {tuple(sorted((fps[i], fps[i + 4]))) for i in range(4)}


def test_a_crowd_of_unlike_members_gives_no_square(spark, monkeypatch):
    """All share a band, none is similar: 10,000 pairs were verified before."""
    rnd = random.Random(5)
    t = " ".join(f"w{i}" for i in range(200))
    texts = [edited(rnd, t, 12) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {r["doc_id"]: r["fp"] for r in near_copies.marked(docs, ["doc_id"], False).collect()}
    distinct = spark.createDataFrame([(fps[k], k, [5]) for k in range(150)], "fp long, first long, bands array<long>")
    seen, real = [], near_copies.verified
    monkeypatch.setattr(near_copies, "verified", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    near_copies.links(docs, distinct, Scratch(spark, "test")).count()
    assert len(seen) == 2 and sum(seen) < 450
