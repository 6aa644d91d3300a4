"""The Jaccard join against all pairs, and components."""

import re

import numpy as np
import pytest

from kindred.llm import jaccard, registry
from kindred.llm.common import documents
from kindred.llm.components import components
from tests.llm.conftest import ODD
from tests.oracle import DATA


def brute_sets(texts, k):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    return out


def brute(rows, k, percent):
    """(doc_id, n, component) of (doc_id, text) rows."""
    sets = brute_sets([t for _, t in rows], k)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in enumerate(sets):
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for own in by.values() if len(own) > 1 for i in own for j in own if i < j}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        known = least.get(r)
        least[r] = d if known is None else known if d is None else min(d, known)
    return sorted(((d, len(s), least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def run(df, **params):
    return sorted((tuple(r) for r in jaccard.near_duplicates(df, jaccard.JoinParams(**params)).collect()), key=str)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, f"{DATA}/sf0.01").collect()]
    got = sorted((tuple(r) for r in registry.op8_jaccard(spark, f"{DATA}/sf0.01").collect()), key=str)
    assert got == brute(rows, 4, 85) and sum(c != d for d, _, c in got) > 20


def test_families_of_near_copies(spark):
    rng = np.random.default_rng(8)
    rows = []
    for f in range(6):
        base = [f"w{x}" for x in rng.integers(0, 500, 120)]
        for _ in range(25):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, len(w)))] = f"v{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for k, percent in ((4, 85), (5, 80)):
        want = brute(rows, k, percent)
        assert run(df, words=k, percent=percent) == want and run(df, words=k, percent=percent, waves=0, sketch_bits=8, bloom_bits=10) == want


def test_large_families_in_any_number_of_waves(spark):
    """500 copies around a middle, 300 that drift from one to the next, and 300 about as far from each other as links reach."""
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(0, 900)}"

    def changed(w, n):
        w = list(w)
        for _ in range(n):
            w[int(rng.integers(0, len(w)))] = word()
        return w

    middle, drift, wide = ([word() for _ in range(100)] for _ in range(3))
    texts = [changed(middle, int(rng.integers(0, 4))) for _ in range(500)]
    for _ in range(300):
        drift = changed(drift, 1)
        texts.append(drift)
    texts += [changed(wide, 2) for _ in range(300)]
    rows = [(i, " ".join(texts[k])) for i, k in enumerate(rng.permutation(len(texts)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, 4, 85)
    for params in ({}, {"waves": 0}, {"waves": 1}, {"waves": 4, "dense": 0}):
        assert run(df, words=4, percent=85, **params) == want


def test_a_dense_group_that_does_not_link(spark, monkeypatch):
    """Sets of 356 of 400 words are about 0.8 alike: none links at 0.85, and the last wave makes next to no pairs of them."""
    made, whole = [], jaccard._untried
    monkeypatch.setattr(jaccard, "_untried", lambda pairs, tried: made.append(whole(pairs, tried)) or made[-1])
    monkeypatch.setattr(jaccard, "drop_table", lambda df: None)
    rng = np.random.default_rng(4)
    counts = []
    for size in (80,):
        rows = [(i, " ".join(f"w{x}" for x in np.sort(rng.permutation(400)[:356]))) for i in range(size)]
        rows += [(size + i, " ".join(f"v{x}" for x in np.sort(rng.permutation(400)[: 398 - i % 3]))) for i in range(20)]  # and some that do
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        want = brute(rows, 1, 85)
        assert sum(c == d for d, _, c in want) == size + 1
        for waves in (6,):
            made.clear()
            assert run(df, words=1, percent=85, waves=waves) == want
        counts.append(made[-1].count())
    assert max(counts) <= 40, counts


def test_odd_rows(spark, odd, empty):
    assert run(odd, words=4, percent=85) == brute([(r[0], r[1]) for r in ODD], 4, 85)
    assert run(empty) == []
    short = [(5, "One two"), (4, "one\ttwo "), (3, "one two three"), (9, ""), (2, "one two three four five"), (1, "ONE two three four five"), (7, "é É x y z")]
    assert run(spark.createDataFrame(short, "doc_id long, text string"), words=4, percent=85) == brute(short, 4, 85)


@pytest.mark.parametrize("percent", [80, 85, 100])
def test_bounds_are_exact(percent):
    for a in range(1, 60):
        assert jaccard.prefix_length(a, percent) == a - -(-percent * a // 100) + 1
        for b in range(1, 60):
            need = jaccard.least_overlap(a, b, percent)
            ok = [i for i in range(min(a, b) + 1) if 100 * i >= percent * (a + b - i)]
            assert need == (ok[0] if ok else need) and (ok or need > min(a, b))


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [tuple(map(int, rng.integers(200, 260, 2))) for _ in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_range_counts_never_turn_a_link_away():
    rng = np.random.default_rng(5)
    for n in (1, 3, 40, 700, 20_000):
        for share in (0.7, 0.8, 0.9, 1.0):
            whole = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) << np.uint64(1))
            a = np.sort(whole[rng.permutation(len(whole))[:n]])
            b = np.sort(np.concatenate([a[: int(share * n)], np.setdiff1d(whole, a)[: n // 20]]))
            if len(b) and jaccard.similar(a, b, 80):
                assert jaccard.may_overlap(jaccard.range_counts(a), jaccard.range_counts(b), 80)
    full = np.full(32, 65535, np.uint16)
    assert jaccard.may_overlap(full, np.ones(32, np.uint16), 80)
    assert not jaccard.may_overlap(np.ones(32, np.uint16), np.repeat(np.array([2, 0], np.uint16), 16), 80)
