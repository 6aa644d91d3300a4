"""Exact repeats against a dictionary of all strings."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from kindred.llm import registry, repeats
from kindred.llm.common import documents
from tests.llm.conftest import ODD
from tests.oracle import DATA


def brute(rows, size):
    seen = Counter(t[p : p + size] for _, t in rows for p in range(len(t) - size + 1))
    out = []
    for d, t in rows:
        gone = np.zeros(len(t) + 2, bool)
        for p in range(len(t) - size + 1):
            if seen[t[p : p + size]] > 1:
                gone[p + 1 : p + 1 + size] = True
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((d, len(t), len(t) - len(kept), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **params):
    return sorted((tuple(r) for r in repeats.digest(df, **params).collect()), key=str)


def encoded(rows):
    return [(d, (t or "").encode()) for d, t in rows]


def test_query(spark):
    docs = documents(spark, f"{DATA}/sf0.001")
    want = brute(encoded([(r.doc_id, r.text) for r in docs.collect()]), 400)
    assert sorted((tuple(r) for r in registry.op7_repeats(spark, f"{DATA}/sf0.001").collect()), key=str) == want and sum(w[2] for w in want) > 0


@pytest.mark.parametrize("group", [0, 3, 20_000])
def test_small_strings(spark, group):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcé"), 6)) for _ in range(40)]
    passages = [" ".join(rng.choice(words, 14)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choice(words, int(rng.integers(0, 12)))) for _ in range(4)]
        for _ in range(int(rng.integers(0, 3))):
            p = passages[int(rng.integers(0, 6))]
            lo = int(rng.integers(0, 20))
            parts.insert(int(rng.integers(0, 4)), p[lo : lo + int(rng.integers(20, 90))])
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[0][1]), (0, rows[0][1]), (0, rows[1][1] + "x"), (201, "ab" * 60), (202, "z" * 39), (203, "z" * 40), (204, "q" * 41), (None, passages[0]), (205, None), (206, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(df, size=40, gram=20, group=group) == brute(encoded(rows), 40)


def test_odd_rows(spark, odd, empty):
    rows = encoded([(r[0], r[1]) for r in ODD])
    want = brute(rows, 400)
    long = next(w for w in want if w[0] == 5)
    assert run(odd) == want and run(empty) == [] and long[1] - long[2] == len(" token = abcdefgh")


def test_one_anchor_in_very_many_contexts(spark):
    """20,000 contexts of one passage, in groups of 500 at most: halves of halves, down to single places."""
    rng = np.random.default_rng(4)
    core = "".join(rng.choice(list("abcdefgh"), 20))
    side = ["".join(rng.choice(list("xyz"), 6)) for _ in range(60)]
    few = ["".join(rng.choice(list("xyz"), 11)) for _ in range(9)]
    rows = [(i, "".join([str(i), "-", *rng.choice(side, 2), rng.choice(few), core, rng.choice(few), *rng.choice(side, 2), "-", str(i)])) for i in range(20_000)]
    rows += [(20_000 + i, core * 3) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = brute(encoded(rows), 40)
    assert run(df, size=40, gram=20, group=500) == want and sum(w[2] > 0 for w in want) > 1000


def test_sort_is_a_suffix_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    starts = rng.integers(0, 380, 90)
    lengths = np.minimum(rng.integers(0, 60, 90), 400 - starts)
    group = np.sort(rng.integers(0, 5, 90))
    s = repeats.Suffixes(data, starts, lengths)
    order, extension = s.sort(group)
    texts = [data[a : a + n].tobytes() for a, n in zip(starts, lengths)]
    assert order.tolist() == sorted(range(90), key=lambda i: (group[i], texts[i], i))
    plain = s._sort_bytes(group, np.searchsorted(group, group))
    assert plain[0].tolist() == order.tolist() and plain[1].tolist() == extension.tolist()


def test_collisions_are_caught(monkeypatch):
    contexts = [bytes([97 + (i * 7 + j * j) % 5 for j in range(60)]) for i in range(6)] + [b"a" * 60, b"a" * 59 + b"b"]
    group, before = np.zeros(8, np.int64), np.full(8, 20)
    want = repeats.shared_places(group, contexts, before, 40, 20)
    assert want.any() and not want.all()
    monkeypatch.setattr(repeats, "prefix_hashes", lambda v: np.zeros(len(v) + 1, np.uint64))  # every hash collides
    assert (repeats.shared_places(group, contexts, before, 40, 20) == want).all()
