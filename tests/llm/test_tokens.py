"""Token ids, packing and grammar shards."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kindred.llm import grammar, packing, registry
from kindred.llm.common import documents
from kindred.llm.tokens import Encoder, vocabulary
from tests.llm.conftest import ODD
from tests.oracle import DATA

SF = f"{DATA}/sf0.01"
CACHE: dict = {}
FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TEXTS = ["", "a", "  a b", "a  b", "a \nb", " x ", " ", "don't  stop", "é̀ ̀ x", "<|endoftext|> a<|endoftext|>", "a\x1cb \x1c c", "İstanbul ΣΑΣ ΣΑΣ. x", "foo \n bar\n\n  baz", "日本 語", "x" * 3000, "a\xa0 b \xa0", "Ça 12x3.,!? (É)×y\n\nZ  w", "a's b'", "-1.5e+3\tx", "\ta\t b"]


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


@pytest.mark.parametrize("name", FILES)
def test_cached_ids_are_the_library_s(spark, name):
    texts = TEXTS + [r.text for r in documents(spark, SF).limit(60).collect()]
    want = [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]
    for entries in (10, 1_000_000):
        enc = Encoder(vocabulary(name), entries)
        for _ in range(2):
            ids, n = enc.encode(pa.array(texts, pa.string()))
            ends = np.cumsum(n)
            assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == want


@pytest.mark.parametrize("name", FILES)
@given(texts=st.lists(st.text(alphabet="ab é\n\t'sΣ1,.  ́", max_size=12), max_size=4))
@settings(max_examples=150, deadline=None)
def test_any_spacing(name, texts):
    if name not in CACHE:
        CACHE[name] = Encoder(vocabulary(name)), library(name)
    enc, lib = CACHE[name]
    ids, n = enc.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert ids.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]


@pytest.mark.parametrize("name", FILES)
@given(texts=st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", " ", "\n", "B\u00e9", "<|endoftext|", "'s", "  "]), max_size=8).map("".join), max_size=5))
@settings(max_examples=400, deadline=None)
def test_special_tokens_in_texts(name, texts):
    """A special token's string gives its id, as by the library's plain call."""
    if name not in CACHE:
        CACHE[name] = Encoder(vocabulary(name)), library(name)
    enc, lib = CACHE[name]
    ids, n = enc.encode(pa.array([*texts, None], pa.string()))
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)] + [[]]
    assert ids.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]


def test_end_ids_within_texts(spark):
    """A text's own end ids don't end its document."""
    texts = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "!", "", "!!! <|startoftext|>!" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for end in (0, 50256):
        got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in grammar.read(grammar.write(df, end_id=end)).collect()}
        lib = library("byte_bpe_50k.json")
        for k, t in enumerate(texts):
            ids = lib.encode(t, add_special_tokens=False).ids + [end]
            assert got[k] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    check_packing(packing.pack(df).collect(), list(enumerate(texts)))


# --- packing
def check_packing(rows, texts):
    """rows: pieces; texts: (doc_id, text) of every row packed."""
    want = Counter()
    for doc, t in texts:
        ids = np.array([*library_ids(t or ""), 1], "<u4")
        at = 0
        for n in packing.lengths_of(len(ids)):
            want[(doc, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids))] += 1
            at += n
        assert at == len(ids)
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, sum(r.length for r in rows)


def library_ids(text, cache={}):  # noqa: B006
    lib = cache.setdefault("t", library("word_bpe_49k.json"))
    return lib.encode(text, add_special_tokens=False).ids


def test_packing_query(spark):
    docs = documents(spark, SF)
    padding, total = check_packing(registry.op2_packing(spark, SF).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert padding / total < 0.01


def test_packing_odd_rows(spark, odd, empty):
    check_packing(packing.pack(odd).collect(), [(r[0], r[1]) for r in ODD])
    assert packing.pack(empty).count() == 0


@given(st.dictionaries(st.sampled_from([*range(1, 32), *range(32, 2048, 32), 2048]), st.integers(1, 300), max_size=30))
@settings(max_examples=40, deadline=None)
def test_plan_gives_every_rank_one_slot(histogram):
    p = packing.plan(histogram)
    used = defaultdict(set)
    for n, count in histogram.items():
        slots = sorted(p.slots[n])
        assert slots[0][0] == 0
        for k, (first, each, base, offset) in enumerate(slots):
            for rank in range(first, slots[k + 1][0] if k + 1 < len(slots) else count):
                at = offset + (rank - first) % each * n
                span = set(range(at, at + n))
                seq = used[base + (rank - first) // each]
                assert not seq & span and at + n <= 2048
                seq |= span
    assert all(s == set(range(len(s))) for s in used.values()) and len(used) == p.sequences


def test_column_generation_reaches_the_bound():
    lengths, demand = np.array([45, 36, 31, 14]), np.array([97.0, 610.0, 395.0, 211.0])
    found = packing.cutting_stock(lengths, demand, 100)
    assert abs(sum(t for _, t in found) - 452.25) < 1e-6  # the textbook optimum of this instance
    assert np.allclose(sum(c * t for c, t in found), demand)


# --- grammar
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=8))
@settings(max_examples=150, deadline=None)
def test_shard_round_trip(docs):
    counts = np.array([len(d) for d in docs], np.int64)
    ids = np.array([x for d in docs for x in d], np.uint32)
    shard = grammar.Shard(grammar.write_shard(ids, counts, 6, grammar.RepairParams(rounds=6, pairs=3, least=2)))
    assert shard.decode().tolist() == ids.tolist()
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, d in enumerate(docs):
        assert shard.decode(i, i + 1).tolist() == d
    assert [shard.id_at(k) for k in range(len(ids))] == ids.tolist() and ends[-1] == shard.n_ids


def test_shards_get_smaller():
    ids = np.tile(np.arange(40, dtype=np.uint32), 500)
    file = grammar.write_shard(ids, np.array([len(ids)]), 50_257)
    assert len(file) < len(ids) / 4 and len(grammar.Shard(file).rules) > 0


def test_runs_of_one_id_and_large_vocabularies():
    ids = np.array([7] * 4096 + [8, 9, 7, 7, 7], np.uint32)
    counts = np.array([1001, 3095, 0, 5])
    shard = grammar.Shard(grammar.write_shard(ids, counts, 10))
    assert shard.decode().tolist() == ids.tolist() and shard.decode(3, 4).tolist() == [8, 9, 7, 7, 7]
    assert shard.rule_lengths.max() >= 64 and len(shard.symbols) < 100
    with pytest.raises(ValueError):
        grammar.write_shard(ids, counts, 70_000)


def check_grammar(got, texts):
    lib, base = library("byte_bpe_50k.json"), 0
    want = Counter()
    for t in texts:
        ids = np.array([*lib.encode(t[1] or "", add_special_tokens=False).ids, 0], "<u4")
        want[(t[0], base, len(ids), zlib.crc32(ids.tobytes()))] += 1
        base += len(ids)
    assert Counter(tuple(r) for r in got) == want


def test_grammar_query(spark):
    texts = sorted((r.doc_id, r.text) for r in documents(spark, SF).collect())
    check_grammar(registry.op6_grammar(spark, SF).collect(), texts)


def test_grammar_odd_rows(spark, odd, empty):
    small = grammar.read(grammar.write(odd, shard_ids=50)).collect()
    check_grammar(small, sorted(((r[0], r[1]) for r in ODD), key=lambda r: (r[0] is not None, r[0] or 0)))
    assert grammar.read(grammar.write(empty)).count() == 0
