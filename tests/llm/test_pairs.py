"""Near-duplicates, repeats and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.near_dedup import near_duplicates, shingle_set, superminhash
from tessera.llm.substring_dedup import remove_repeats
from tessera.llm.words import STEP, mix


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocabulary, k=70)
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 3, 12, 13, 14, 60, 200]))
        if rng.random() < 0.4 and rows:
            words = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randint(0, 4)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            at = rng.randint(0, len(words))
            words = words[:at] + passage[rng.randint(0, 30) :] + words[at:]
        rows.append((i, " ".join(words)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "A b"), (n + 4, "a B")]


def linked(rows, n):
    sets = [(i, shingle_set(t.encode() if t else None, n)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if i < j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, n):
    rows = corpus(n)
    out = near_duplicates(docs(rows), n=n).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == linked(rows, n)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_near_duplicates_crowded(docs, monkeypatch):
    """A bucket of many texts just beyond the threshold is compared in blocks."""
    rng = random.Random(2)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(2, 6)):
            words[rng.randrange(60)] = f"x{rng.random()}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr("tessera.llm.near_dedup.BLOCK", 600)
    out = near_duplicates(docs(rows), n=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == linked(rows, 2)


def test_near_duplicates_odd_rows(docs):
    rows = [(None, "a b c"), (3, "a b c"), (3, "x y z"), (9, "x y z"), (None, None)]
    out = near_duplicates(docs(rows), n=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in out if r.doc_id is not None) == [(3, 3, True), (3, 3, True), (9, 3, False)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)] * 2
    assert near_duplicates(docs([]), n=2).collect() == []


def test_superminhash_is_the_sequential_one():
    def literal(elements, m):
        out = [np.inf] * m
        for e in elements:
            base, order = mix(np.array([e], np.uint64)), list(range(m))
            for r in range(m):
                d = mix(base + np.uint64((r + 1) * int(STEP) & (1 << 64) - 1))
                v = r + float((d >> np.uint64(11))[0]) * 2.0**-53
                k = r + int(((mix(d) >> np.uint64(32)) * np.uint64(m - r))[0] >> np.uint64(32))
                s = order[k]
                order[k] = order[r]
                out[s] = min(out[s], v)
        return out

    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 2**63, size=k).astype(np.uint64) for k in (1, 3, 20, 200)]
    got = superminhash(np.concatenate(sets), np.repeat(np.arange(4), [1, 3, 20, 200]), 4, 32)
    assert all(np.array_equal(got[k], literal(s, 32)) for k, s in enumerate(sets))


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_of_a_path(spark, few):
    n = 300
    order = random.Random(1).sample(range(n), n)
    links = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a bigint, b bigint").repartition(5)
    out = {r.node: r.component for r in components(links, few).collect()}
    assert out == {**dict.fromkeys(range(1, n), 0), 501: 500}
    assert components(links.where("false"), few).collect() == []


@pytest.mark.parametrize(("window", "gram"), [(13, 4), (5, 2), (50, 16)])
def test_remove_repeats(docs, window, gram):
    rows = corpus(window)
    first = {}
    for i, t in rows:
        words = (t or "").split()
        for k in range(len(words) - window + 1):
            first.setdefault(tuple(words[k : k + window]), i)
    want = {}
    for i, t in rows:
        words = (t or "").split()
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        want[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone, strict=True) if not g))
    out = remove_repeats(docs(rows), window=window, gram=gram, keep_spacing=False).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in out} == want
    assert sum(x[1] for x in want.values())


def test_remove_repeats_odd_rows(docs):
    long = " ".join(f"w{k}" for k in range(30))
    rows = [(None, long), (4, long), (4, long), (6, f"a  b\n{long}\tc"), (7, None)]
    out = remove_repeats(docs(rows), window=13, keep=("words", "n")).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.kept_text) for r in out) == [("4", 0, long), ("4", 0, long), ("6", 30, "a  b\tc"), ("7", 0, ""), ("None", 0, long)]
    assert remove_repeats(docs([]), window=13).collect() == []


def test_digest_of_nothing(spark):
    row = spark.range(1).select(F.sha2(F.lit(""), 256).alias("x")).first()
    assert row.x == hashlib.sha256(b"").hexdigest()
