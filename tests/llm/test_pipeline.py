"""The pipeline against a plain version, stage by stage, on a small table."""

import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from kindred.llm import mixing, pii
from kindred.llm.common import cut, documents
from tests.llm.test_jaccard import brute
from tests.llm.test_tokens import check_packing
from tests.oracle import DATA

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    stages, docs = dict(corpus_pipeline.STAGES), documents(spark, SF)
    assert list(stages) == ["language", "near_duplicates", "pii", "mixing", "packing"]
    extra = spark.createDataFrame([(9001, "12 -- 34", "en", "src1", 8), (9002, None, None, None, None)], docs.schema)
    rows = cut(docs.unionByName(extra), "in")

    kept = cut(stages["language"](spark, rows, SF), "s1")
    assert kept.schema == docs.schema and Counter(map(tuple, kept.collect())) == Counter(map(tuple, docs.collect()))

    one = cut(stages["near_duplicates"](spark, kept, SF), "s2")
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in kept.collect()], 5, 80)}
    assert one.schema == docs.schema and sorted(r.doc_id for r in one.collect()) == sorted(want) and len(want) < 200

    clean = cut(stages["pii"](spark, one, SF), "s3")
    model = pii.train(one)
    before = {r.doc_id: r for r in one.collect()}
    for r in clean.collect():
        old = before[r.doc_id]
        base, added = pii.find(old.text, model)
        assert r.text == pii.redact(old.text, base + added) and r.n_chars == (len(r.text) if base else old.n_chars)
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text)

    mixed = cut(stages["mixing"](spark, clean, SF), "s4")
    plan = {r.doc_id: r.copies for r in mixing.mix(clean.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in plan.items() if n})

    check_packing(stages["packing"](spark, mixed, SF).collect(), [(r.doc_id, r.text) for r in mixed.collect()])


def test_deduplication_of_odd_rows(spark, odd, empty):
    from kindred.llm import jaccard

    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(odd).collect())
    assert [g[1] for g in got] == [-7, 1, 2, 3, 4, 5, 6, 8, 0]
    assert jaccard.one_of_each(odd).columns == odd.columns and jaccard.one_of_each(empty).count() == 0


def test_one_of_each_does_not_depend_on_the_plan(spark):
    from kindred.llm import jaccard

    rows = [(7, "one text of some few words", f"s{k}") for k in range(6)] + [(8, "one text of some few words", "a"), (9, "other words that stand alone here", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tags", F.create_map(F.lit("k"), F.col("source")))
    for parts in (1, 3, 7):
        got = sorted((r.doc_id, r.source) for r in jaccard.one_of_each(frame.repartition(parts, F.xxhash64("source", F.lit(parts)))).collect())
        assert got == [(7, "s0"), (9, None)]


def test_run_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name, frame in (("odd", odd), ("empty", empty)):
        frame.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        docs, texts = documents(spark, str(tmp_path / name)), {}
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = cut(f(spark, docs, str(tmp_path / name)), stage)
            assert docs.columns == odd.columns
        texts = [(r.doc_id, r.text) for r in docs.collect()]
        check_packing(got, texts)
        assert len(texts) >= 3 if name == "odd" else not texts


def test_language_stage_without_labels(spark, odd):
    stage, docs = dict(corpus_pipeline.STAGES)["language"], documents(spark, SF)
    extra = spark.createDataFrame([(9001, "12 -- 34", "en", "src1", 8), (9002, None, None, None, None)], docs.schema)
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = stage(spark, bare.unionByName(extra.withColumn("lang", F.lit(None).cast("string"))), SF)
    assert kept.schema == bare.schema and Counter(map(tuple, kept.collect())) == Counter(map(tuple, bare.collect()))
    # labels on rows that nothing is learned from: null ids, and ids that are held out
    unlearned = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.col("lang")))
    assert stage(spark, unlearned, SF).count() == docs.count()
    no_lang = odd.withColumn("lang", F.lit(None).cast("string"))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in stage(spark, no_lang, SF).collect()) == [(False, -7), (False, 3), (False, 3), (False, 5), (False, 8), (True, 0)]


def test_language_stage_rejects_noise(spark):
    rng = np.random.default_rng(5)
    noise = " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(60))
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 5
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 5
    docs = documents(spark, SF)
    rows = [(9015, noise, "en"), (9017, russian, "de"), (9020, noise[:40], "en"), (9022, noise, None), (9029, russian, "ru"), (9034, russian, None), (9036, finnish, "en")]
    extra = spark.createDataFrame([(d, t, lang, "src1", len(t)) for d, t, lang in rows], docs.schema)
    all_rows = docs.unionByName(extra)
    want = {r.doc_id for r in all_rows.collect()} - {9015, 9017}
    # all added rows are held out, so nothing is learned from them
    kept = [r.doc_id for r in dict(corpus_pipeline.STAGES)["language"](spark, all_rows, SF).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == want


def test_language_stage_of_poor_models(spark):
    russian = "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 5
    words = "one two three four five six seven eight nine ten " * 10
    for lang in ("en", "ru"):  # one label on a few rows, learned from little
        rows = [(i, words, "en" if i < 3 else None) for i in range(20)] + [(100 + i, russian, lang if i < 3 else None) for i in range(20)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        assert dict(corpus_pipeline.STAGES)["language"](spark, docs, SF).count() == 40


def test_a_broken_dependency_is_not_hidden():
    """The entry module goes without the operators only where they are taken out, not where something that they need is missing."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'regex': raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__\n"
    )
    got = subprocess.run([sys.executable, "-c", code], cwd=Path(corpus_pipeline.__file__).parent, capture_output=True, text=True)
    assert got.returncode != 0 and "ModuleNotFoundError: regex" in got.stderr
