"""Phrases, the conversation trie and web archives: brute force on small and odd tables, round trips."""

import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from kindred.llm import collocations, prefix_trie, registry, warc
from tests.llm.conftest import ODD
from tests.oracle import DATA

SF = f"{DATA}/sf0.01"


# --- phrases
def brute_phrases(rows, depth=4, least=30, covered=80, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(c, "\n")
        for piece in low.split("\n"):
            words = tuple(w for w in piece.replace("\t", " ").split(" ") if w)
            total[lang] += len(words)
            for i in range(len(words)):
                for d in range(1, min(depth, len(words) - i) + 1):
                    counts[lang][words[i : i + d]] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = set()
        for p, a in found.items():
            for d in range(2, len(p)):
                for i in range(len(p) - d + 1):
                    if 100 * a >= covered * f[p[i : i + d]]:
                        hidden.add(p[i : i + d])
        scored = []
        for p, a in found.items():
            if p not in hidden:
                score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, rank, p.decode(), -a, l, r, total[lang], -s) for rank, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def phrases(df, **params):
    got = collocations.collocations(df, collocations.PhraseParams(**params)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(map(tuple, got.collect()))


def small_texts():
    rng = np.random.default_rng(3)
    words = ["the", "The", "of", "a", "\xe9t\xe9", "new", "york", "city", "hall", "x-y"]
    ends = [". ", ", ", "\n", "  ", "\t", "! ", "\r\n", "\x0b", " \xa0 "]
    rows = []
    for k in range(300):
        parts = []
        for _ in range(int(rng.integers(0, 40))):
            parts.append(" ".join(rng.choice(words, int(rng.integers(1, 7)))) if rng.random() < 0.6 else "New York City Hall" if rng.random() < 0.5 else "of the new")
            parts.append(str(rng.choice(ends)))
        rows.append(("".join(parts) if k % 29 else None, [None, "en", "fr", "und"][int(rng.integers(4))]))
    return rows


@pytest.mark.parametrize("params", [{}, {"least": 5, "top": 20}, {"least": 2, "covered": 50, "shard_words": 500}, {"depth": 3, "least": 10}, {"depth": 2, "least": 1}])
def test_phrases_against_brute_force(spark, params):
    rows = small_texts()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    got = phrases(df, **params)
    assert got == brute_phrases(rows, **{k: v for k, v in params.items() if k != "shard_words"}) and got


def test_phrases_in_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(collocations, "RANGE_BYTES", 500)
    rows = small_texts()
    assert phrases(spark.createDataFrame(rows, "text string, lang string"), least=3) == brute_phrases(rows, least=3)


def test_phrases_odd_rows(spark, odd, empty):
    assert phrases(empty) == []
    want = brute_phrases([(r[1], r[2]) for r in ODD], least=2)
    assert phrases(odd, least=2) == want and {w[0] for w in want} >= {"en", "fr"}
    assert phrases(spark.createDataFrame([("", None), (None, "en")], "text string, lang string")) == []


def test_scores_pass_64_bits(spark):
    big = (1 << 62) + 1
    got = spark.range(1).select(collocations._score(F.lit(big), F.lit(big).cast("decimal(20,0)") + F.lit(big)).alias("s")).first().s
    assert got == 2_000_000 * big // (2 * big)


# --- conversation trie
def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            letter = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append((turn is not None, turn or 0, letter, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        seq = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], sha(p)) for p, m in nodes.items())


def trie(df):
    got = prefix_trie.trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in got.collect())


CONVERSATIONS = "conv_id long, turn long, role string, text string, rank int, size long, name string"


def conversations(spark, rows, partitions=4):
    return spark.createDataFrame([(*r, 1, 2, "n") for r in rows], CONVERSATIONS).repartition(partitions)


def test_trie_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = registry.op12_trie(spark, SF)
    assert sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got.collect()) == brute_trie(rows)


@pytest.mark.parametrize("seed", range(6))
def test_trie_against_brute_force(spark, seed):
    """Few texts, so that sequences are each other's prefixes and copies, over several sorted runs."""
    rng = np.random.default_rng(seed)
    texts = ["", "a", "b", "\xe9\xe9", None][: 2 + seed % 4]
    rows = []
    for c in rng.choice(np.arange(-40, 400), 250, replace=False).tolist():
        same = int(rng.integers(4)) == 0
        for t in range(int(rng.integers(1, 4 if seed < 3 else 15))):
            rows.append((c, t if rng.random() < 0.95 else None, "user" if t % 2 else None, "a" if same else texts[int(rng.integers(len(texts)))]))
    rows += [(None, 1, "user", "x")] * 3 + rows[:5]
    assert trie(conversations(spark, rows)) == brute_trie(rows)


def test_trie_of_copies_and_of_one_long_conversation(spark):
    rows = [(5 * c, t, "user", f"t{t}") for c in range(2000) for t in range(2)] + [(7, t, "user", f"{t % 7}" * 10) for t in range(300)]
    assert trie(conversations(spark, rows)) == brute_trie(rows)


def test_trie_walk_runs_cut_anywhere():
    """A run cut in two gives the same members of the spine's nodes and the same edges once the spines are added up."""
    letters = [hashlib.md5(bytes([k])).digest() for k in range(3)]
    rng = np.random.default_rng(0)
    keys = sorted({b"".join(letters[k] for k in rng.integers(0, 3, int(rng.integers(0, 6)))) for _ in range(80)})
    for at in range(1, len(keys), 7):
        n_convs = Counter()
        for run in (keys[:at], keys[at:]):
            walk = prefix_trie.Walk()
            for k, key in enumerate(run):
                walk.add(key, np.ones(len(key) // 16, np.int64), 1, k)
            walk.end()
            for row in walk.rows:
                if row["kind"] == "spine":
                    n_convs[row["name"]] += row["n_convs"]
        for name, n in n_convs.items():
            depth = next(d for d in range(7) if any(hashlib.md5(k[: 16 * d]).digest() == name for k in keys))
            assert n == sum(hashlib.md5(k[: 16 * depth]).digest() == name for k in keys if len(k) >= 16 * depth)


def test_trie_odd_rows(spark):
    assert trie(conversations(spark, [])) == []
    assert trie(conversations(spark, [(None, 0, "user", "x")])) == []
    rows = [(1, None, None, None), (1, None, None, None), (2, 0, "user", "x" * 200_000), (11, 0, "user", "x" * 200_000), (3, 0, "us", "er"), (4, 0, "user", ""), (0, 3, "", "user")]
    assert trie(conversations(spark, rows)) == brute_trie(rows)


# --- web archives
PAGES = "page_id long, url string, html string, n long, key string, part int"


def brute_pages(rows, least=100):
    out = []
    first = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= least:
            key = (page is None, page or 0)
            first[html] = min(first.get(html, key), key)
    for page, _, html in rows:
        data = (html or "").encode()
        f = first.get(html)
        again = f is not None and (page is None, page or 0) != f
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f[1] if again else None))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2) for r in rows], PAGES).repartition(3)


ROWS = [
    (1, "http://a/", "x" * 99), (2, "http://b/", "x" * 99), (9, "http://c/\r\nX-Page-ID: 7", "y" * 100), (3, None, "y" * 100), (4, "http://d/ \xe9", "\xe9" * 50), (5, "u", "\xe9" * 50), (6, "u", None), (7, "u", ""),
    (None, "u", "y" * 100), (None, "v", "z" * 200), (None, "w", "z" * 200), (3, None, "y" * 100), (8, "u", "WARC/1.1\r\n\r\n\r\n" * 20), (10, "u", "<p>\r\n\r\n" * 400_000), (11, "u", "<p>\r\n\r\n" * 400_000), (-5, "u", "\x00" * 150),
]


def test_pages_round_trip(spark):
    df = pages(spark, ROWS)
    got = warc.pages_as_records(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == brute_pages(ROWS)
    none = warc.pages_as_records(pages(spark, ROWS).where("false"))
    assert none.count() == 0


@pytest.mark.parametrize("params", [{"frame": 1}, {"frame": 300, "bundle": 1}, {"least": 1}])
def test_pages_in_small_frames_and_bundles(spark, params):
    bundles = warc.write(pages(spark, ROWS), warc.WarcParams(**params))
    if "bundle" in params:
        assert bundles.count() > 3
    got = warc.read(bundles).collect()
    assert len(got) == len(ROWS) and sum(r.record_type == "revisit" for r in got) == sum(r[3] == "revisit" for r in brute_pages(ROWS, params.get("least", 100)))
    places = warc.index(bundles)
    assert places.count() == len(ROWS)
    wanted = places.where("page_id IN (4, 8, 11)").select("record_id")
    found = {r.record_id: warc.parse(bytes(r.record)) for r in warc.fetch(bundles, wanted).collect()}
    assert len(found) == 3 and all(h["warc-record-id"] == f"<{name}>" for name, (h, _, _) in found.items())
    assert {h["x-page-id"]: p for h, p, _ in found.values()}["8"] == b"WARC/1.1\r\n\r\n\r\n" * 20


def test_bundles_are_common_zstandard_files(spark, tmp_path):
    bundles = warc.write(pages(spark, ROWS), warc.WarcParams(frame=500))
    files = [r.file for r in warc.export(bundles, str(tmp_path / "out")).collect()]
    assert len(files) == bundles.count() and all(f.endswith(".warc.zst") for f in files)
    kinds = Counter()
    for file in files:
        data, at = b"", 0
        with open(file, "rb") as f, zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True) as r:
            data = r.read()
        while at < len(data):
            headers, _, at = warc.parse(data, at)
            kinds[headers["warc-type"]] += 1
    assert kinds == Counter(r[3] for r in brute_pages(ROWS))


def test_damage_is_found():
    w = warc.BundleWriter(warc.WarcParams(frame=10))
    for k in range(5):
        w.add(b"record %d" % k)
    data = w.close()
    opened = warc.Bundle(data)
    assert [opened.frame(k) for k in range(5)] == [b"record %d" % k for k in range(5)]
    assert struct.unpack("<I", data[-4:])[0] == 0x8F92EAB1
    start = opened.starts
    for bad in (data[:-1], data[1:], data[: start[1] - 2] + b"zz" + data[start[1] :]):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            warc.Bundle(bad).frame(0)
