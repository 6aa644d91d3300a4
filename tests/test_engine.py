"""Text, vector, import, index and prediction semantics on small rows."""

import http.server
import io
import json
import socket
import threading
import time
import zipfile
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred import errors as E
from kindred.config import EmbeddingConfig, EngineConfig, ImportConfig, SearchConfig
from kindred.functions import text as tx
from kindred.functions import vectors as vx
from kindred.operators import index as ix
from kindred.operators import staging, store, vote
from kindred.plans.api import Engine
from kindred.sources import xlsx
from kindred.sources.cellformat import display
from kindred.sources.embedder import HashEmbedder, HttpEmbedder, parse_response
from kindred.streaming.predictions import predict_stream


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("raw, want", [
    ("  甲方\r\n 不得转让  ", "甲方 不得转让"), (None, ""), ("　a　b　", "a b"), ("a\xa0b", "a\xa0b"), ("\x01a\x0bb\x0cc\rd\x02", "a b c d"), ("", ""),
])
def test_normalize(spark, raw, want):
    assert one(spark, raw, tx.normalize) == want


@pytest.mark.parametrize("raw, codes, error", [
    (" TYPE03；TYPE01,TYPE03 ; TYPE02 ", "TYPE01;TYPE02;TYPE03", None),
    ("TYPE 01", None, E.MSG_CODE_SPACE + "TYPE 01"), ("；,", None, E.MSG_CODES_EMPTY), (None, None, E.MSG_CODES_EMPTY),
    ("x" * 64, "x" * 64, None), ("x" * 65 + ";a b", None, E.MSG_CODE_LONG), ("a b;" + "x" * 65, None, E.MSG_CODE_SPACE + "a b"),
    ("A\nB\nC", "A\nB\nC", None), ("A\nB", None, E.MSG_CODE_SPACE + "A\nB"), ("A　B", "A　B", None),
    (";".join(f"{i:063d}" for i in range(62)) + ";" + "y" * 31, ";".join(f"{i:063d}" for i in range(62)) + ";" + "y" * 31, None),
    (";".join(f"{i:063d}" for i in range(62)) + ";" + "y" * 40, None, E.MSG_CODES_LONG),
])
def test_codes(spark, raw, codes, error):
    assert one(spark, raw, tx.codes_error) == error
    if error is None:
        assert one(spark, raw, tx.canonical_codes) == codes


@pytest.mark.parametrize("raw, want", [("A;;B;;", ["A", "", "B"]), (";A", ["", "A"]), (";", []), (" ", []), (None, []), ("a; b", ["a", " b"])])
def test_parse_codes(spark, raw, want):
    assert one(spark, raw, tx.parse_codes) == want


def test_length_counts_utf16_units(spark):
    assert one(spark, "a😀b", tx.utf16_length) == 4
    assert one(spark, "😀" * 2000, tx.paragraph_error) is None
    assert one(spark, "😀" * 2000 + "a", tx.paragraph_error) == E.MSG_PARAGRAPH_LONG.format(limit=4000)


def test_vectors(spark):
    assert np.allclose(one(spark, [3.0, 4.0, 0.0], vx.l2_normalize, "array<float>"), [0.6, 0.8, 0])
    for bad in ([], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], None):
        assert one(spark, bad, vx.l2_normalize, "array<float>") is None
    df = spark.createDataFrame([([0.6, 0.8, 0.0], 3)], "v array<float>, d int").withColumn("b", vx.encode("v"))
    r = df.select("b", vx.decode("b", "d").alias("back"), vx.decode("b", F.lit(2)).alias("wrong"), vx.dot(F.col("v"), F.col("v")).alias("dot")).first()
    assert len(r.b) == 12 and np.allclose(r.back, [0.6, 0.8, 0]) and r.wrong is None and abs(r.dot - 1) < 1e-6


def sheet(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 2)], "row_no int, paragraph string, raw_codes string")


def test_staging(spark):
    rows = [("p", "A"), (" ", "\t"), ("p", "A"), (" p ", "B"), ("p", "C"), ("", "A"), ("q", "a b"), ("q", "Z")]
    got = {r.row_no: (r.status, r.first_row) for r in staging.stage(sheet(spark, rows)).collect()}
    assert got == {2: ("new", 2), 4: ("skipped", 2), 5: ("conflict", 2), 6: ("conflict", 2), 7: ("invalid", None), 8: ("invalid", None), 9: ("new", 9)}
    staged = staging.stage(sheet(spark, [(f"p{i}", "A") for i in range(5)]), 3)
    assert [(r.row_no, r.message) for r in staging.errors(staged, 3).collect()] == [(5, E.MSG_ROW_CAP.format(limit=3))]
    assert staged.count() == 4
    assert staging.stage(sheet(spark, []) if False else sheet(spark, [(None, None)])).count() == 0


CFG = SearchConfig(min_similarity=0.5)


def corpus(spark):
    rows = [(1, "历史段落一", "TYPE_A;TYPE_B", [1.0, 0.0, 0.0]), (2, "历史段落二", "TYPE_A", [0.9, 0.4358899, 0.0]), (3, "bad", "X", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "sample_id long, original_text string, codes string, vector array<float>")
    return ix.build_index(df.withColumn("text_hash", tx.text_hash(tx.normalize(F.col("original_text")))), 3)


def test_index_and_vote(spark):
    index = corpus(spark)
    assert ix.index_status(index).first()[:] == ("DEGRADED", 2, 1)
    assert ix.index_status(index.where("not good")).first()[:] == ("EMPTY", 0, 1)
    assert ix.index_status(index.where("good")).first()[:] == ("READY", 2, 0)
    good = ix.good_samples(index)
    ask = spark.createDataFrame([(7, "历史段落一", [1.0, 0.0, 0.0]), (8, "新的相似段落", [1.0, 0.0, 0.0]), (9, "far", [0.0, 0.0, 1.0])], "query_id long, t string, vector array<float>")
    ask = ask.withColumn("text_hash", tx.text_hash(tx.normalize(F.col("t"))))
    got = {r.query_id: r for r in vote.predict(ask, good, ix.hash_index(good), CFG).collect()}
    assert got[7].match_type == "EXACT" and [c.code for c in got[7].change_types] == ["TYPE_A", "TYPE_B"] and got[7].references[0].sample_id == 1
    assert got[8].match_type == "SEMANTIC"
    assert [(c.code, c.level, c.support_count) for c in got[8].change_types] == [("TYPE_A", "HIGH", 2), ("TYPE_B", "CANDIDATE", 1)]
    assert abs(got[8].change_types[1].score - 1 / 1.81) < 1e-6
    assert (got[9].match_type, got[9].max_similarity, got[9].change_types, got[9].references) == ("NO_RELIABLE_MATCH", 0.0, [], [])
    none = vote.predict(ask, good, ix.hash_index(good), replace(CFG, vote_top_k=0)).where("query_id = 8").first()
    assert none.change_types == [] and len(none.references) == 2
    assert vote.predict(ask, good, ix.hash_index(good), replace(CFG, retrieve_top_k=0)).where("query_id = 8").first().match_type == "NO_RELIABLE_MATCH"


def test_ties_and_repeated_labels(spark):
    rows = [(i, "t", ["A", "A"] if i == 4 else [], [1.0, 0.0]) for i in range(6)]
    c = spark.createDataFrame(rows, "sample_id long, original_text string, codes array<string>, vector array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    h = vote.search_hits(q, c, replace(CFG, retrieve_top_k=3))
    assert [r.sample_id for r in h.orderBy("rank").collect()] == [0, 1, 2]
    v = vote.vote(vote.search_hits(q, c, CFG), 10).first()
    assert v.support_count == 2 and abs(v.score - 2 / 6) < 1e-9


class Fixed:
    dimension = 3

    def __init__(self):
        self.calls = 0

    def embed(self, texts):
        return [[1.0, 0.0, 0.0] for _ in texts]

    def is_healthy(self):
        return True


def engine(spark, root, **imports):
    return Engine(spark, str(root), Fixed(), EngineConfig(EmbeddingConfig(model_version="test-v1", dimension=3, batch_size=2), ImportConfig(**imports), CFG))


def test_import_and_predict(spark, tmp_path):
    e = engine(spark, tmp_path / "s")
    assert e.index_status()["status"] == "EMPTY"
    got = e.import_file("a.xlsx", xlsx.write_sheet([("历史段落A", "TYPE02;TYPE01"), (" 历史段落A", "TYPE01;TYPE02")]))
    assert (got["success"], got["total_rows"], got["inserted"], got["skipped"], got["index_reloaded"]) == (True, 2, 1, 1, True)
    row = e.store.read().first()
    assert row.codes == "TYPE01;TYPE02" and len(row.vector_data) == 12 and row.sample_id == 1 and row.source_file == "a.xlsx"
    bad = e.import_file("a.xlsx", xlsx.write_sheet([("同一段落", "TYPE01"), ("同一段落", "TYPE02")]))
    assert not bad["success"] and [x["row"] for x in bad["errors"]] == [3] and e.store.read().count() == 1
    clash = e.import_file("a.xlsx", xlsx.write_sheet([("历史段落A", "TYPE09"), ("other", "T")]))
    assert not clash["success"] and clash["errors"] == [{"row": 2, "message": E.MSG_STORE_CONFLICT}]
    again = e.import_file("a.xlsx", xlsx.write_sheet([("历史段落A", "TYPE01;TYPE02"), ("new", "T")]))
    assert (again["inserted"], again["skipped"]) == (1, 1) and e.store.read().agg(F.max("sample_id")).first()[0] == 2
    assert e.import_file("a.xlsx", xlsx.write_sheet([], ("x", "y")))["errors"] == [{"row": 1, "message": E.MSG_HEADER}]
    assert e.predict_one("历史段落A ")["match_type"] == "EXACT"
    semantic = e.predict_one("something else")
    assert semantic["match_type"] == "SEMANTIC" and semantic["model_version"] == "test-v1"
    assert e.index_status()["status"] == "READY" and e.index_status()["sample_count"] == 2
    for call in (lambda: e.predict_one(" \t"), lambda: e.predict_one("　"), lambda: e.predict_one("x" * 4001), lambda: e.import_file("a.xls", b"x"), lambda: e.import_file("a.xlsx", b""), lambda: e.import_file("a.xlsx", b"zip?")):
        with pytest.raises(E.EngineError):
            call()
    assert E.envelope(e.predict_one, "")["code"] == 400 and E.envelope(lambda: 1 / 0)["code"] == 500


def test_disabled_sample_blocks_its_hash(spark, tmp_path):
    e = engine(spark, tmp_path / "s")
    e.import_samples(sheet(spark, [("p", "A")]))
    rows = e.store.read().withColumn("enabled", F.lit(0)).withColumn("text_hash", F.lit(tx and "h"))
    e.store.insert_all(rows)
    with pytest.raises(E.EngineError):
        e.store.insert_all(rows)
    assert e.store.read().count() == 2 and len(e.store.versions()) == 2


def test_failed_reload_keeps_snapshot(spark):
    holder = ix.IndexHolder()
    old = holder.reload(corpus(spark).drop("good"), 3)
    with pytest.raises(Exception):
        holder.reload(spark.range(1), 3)
    assert holder.current is old


def test_xlsx_source(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx.write_sheet([(" p ", "A"), ("", ""), ("q", "B")]))
    spark.dataSource.register(xlsx.XlsxSource)
    got = spark.read.format("xlsx_sheet").load(str(tmp_path / "a.xlsx")).collect()
    assert [tuple(r) for r in got] == [(2, "p", "A"), (3, "", ""), (4, "q", "B")]


def test_http_embedder_retries():
    seen = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(body)
            status = 500 if len(seen) == 1 else 404 if body["inputs"] == ["gone"] else 200
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps([[3, 4, 0]]).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpEmbedder(EmbeddingConfig(endpoint=f"http://127.0.0.1:{server.server_port}/", dimension=3))
    assert np.allclose(client.embed(["x"]), [[0.6, 0.8, 0]]) and len(seen) == 2
    with pytest.raises(E.EngineError) as e:
        client.embed(["gone"])
    assert e.value.code == 503 and len(seen) == 3
    server.shutdown()
    for body in ([[1, 2]], [[1, 2, "x"]], [], {}, [[0, 0, 0]], [[1, 2, True]]):
        with pytest.raises(E.EngineError):
            parse_response(body, 1, 3)


def test_stream(spark, tmp_path):
    e = engine(spark, tmp_path / "s")
    e.import_samples(sheet(spark, [("p", "A")]))
    spark.createDataFrame([(1, "p"), (2, "q")], "query_id long, paragraph string").write.parquet(str(tmp_path / "in"))
    got = []
    q = predict_stream(spark.readStream.schema("query_id long, paragraph string").parquet(str(tmp_path / "in")), e, lambda df, i: got.extend(df.collect()), str(tmp_path / "c"))
    q.awaitTermination()
    assert {r.query_id: r.match_type for r in got} == {1: "EXACT", 2: "SEMANTIC"}


def test_hash_embedder_is_stable():
    assert HashEmbedder(8).embed(["a"]) == HashEmbedder(8).embed(["a"])


def test_ids_follow_rows(spark):
    rows = spark.range(10000).select((F.col("id") * 3).alias("row_no"))
    got = store.assign_ids(rows.repartition(7), 5).orderBy("row_no").collect()
    assert [r.sample_id for r in got] == list(range(5, 10005))


class Down(Fixed):
    """Fails as a client does that can't reach its service, from the call `good` on."""

    def __init__(self, good=0):
        super().__init__()
        self.good = good

    def embed(self, texts):
        if any(t.startswith("fail") for t in texts) or not self.good:
            raise E.EngineError("embedding service failed: URLError", E.UNAVAILABLE)
        return super().embed(texts)


def test_model_failures_are_503(spark, tmp_path):
    e = engine(spark, tmp_path / "s")
    e.embedder = Down()
    rows = sheet(spark, [("p", "A")])
    want = {"code": 503, "message": "embedding service failed: URLError", "data": None}
    assert E.envelope(e.import_samples, rows) == want and E.envelope(e.predict_one, "p") == want
    assert E.envelope(lambda: e.predict(spark.createDataFrame([(1, "q")], "query_id long, paragraph string")).collect()) == want
    with pytest.raises(E.EngineError) as error:
        e.import_samples(rows)
    assert error.value.code == 503
    # no folder stays after a failed embed, and nothing is left in memory
    assert list((tmp_path / "s").glob("v*")) == [] and e.store.read().count() == 0
    e.embedder = Down(good=1)
    assert e.import_samples(rows)["inserted"] == 1 and E.envelope(e.import_samples, sheet(spark, [("q", "A"), ("fail", "A")]))["code"] == 503
    assert e.store.read().count() == 1 and len(list((tmp_path / "s").glob("v*"))) == 2  # a folder and its marker


def test_reloads_hold_one_index(spark, tmp_path):
    e = engine(spark, tmp_path / "s")
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    e.import_samples(sheet(spark, [("p", "A")]))
    n = held()
    for _ in range(5):
        e.reload_index()
    assert held() <= n  # fewer when Spark has dropped what others left
    assert not e.import_samples(sheet(spark, [("p", "B")]))["success"] and held() <= n


def test_query_vectors_of_a_wrong_size(spark):
    good = ix.good_samples(corpus(spark))
    for vector in ([1.0, 0.0], None):
        ask = spark.createDataFrame([(8, "h", vector)], "query_id long, text_hash string, vector array<float>")
        got = E.envelope(lambda: vote.predict(ask, good, ix.hash_index(good), CFG, dimension=3).collect())
        assert (got["code"], got["message"]) == (400, E.MSG_QUERY_DIMENSION)
    assert vote.predict(ask, good, ix.hash_index(good), CFG).first().match_type == "NO_RELIABLE_MATCH"


def test_names_are_cut_by_utf16_units(spark):
    for name in ("x" * 600, "😀" * 300, "x" + "😀" * 300, "段" * 500, "short", None):
        units = (name or "").encode("utf-16-le")[:1000].decode("utf-16-le", "ignore")
        assert one(spark, name, tx.truncate_name) == (units if name is not None else None)


@pytest.mark.parametrize("number, code, want", [
    (3.0, None, "3"), (0.1 + 0.2, "General", "0.3"), (1234.5, "0", "1235"), (1234.567, "#,##0.00", "1,234.57"), (0.256, "0%", "26%"), (0.2564, "0.00%", "25.64%"),
    (-1234.5, "#,##0.00_);(#,##0.00)", "(1,234.50)"), (-2.0, "0.0", "-2.0"), (5, "000", "005"), (0.5, "#.##", ".5"), (1234567, "#,##0,", "1,235"), (12345, "0.00E+00", "1.23E+04"),
    (7, '"T"00', "T07"), (5, '0"件"', "5件"), (3, "[Red]0;[Blue]-0;zero", "3"), (0, '0;-0;"none"', "none"), (9.5, '[$¥-804]#,##0.00', "¥9.50"),
    (45292, "yyyy-mm-dd", "2024-01-01"), (45292.75, "yyyy/m/d h:mm", "2024/1/1 18:00"), (45292.75, "h:mm AM/PM", "6:00 PM"), (45292, 'yyyy"年"m"月"d"日"', "2024年1月1日"),
    (45292, "d-mmm-yy", "1-Jan-24"), (1.5, "[h]:mm:ss", "36:00:00"), (0.000694444, "mm:ss", "01:00"), (59, "m/d/yy", "2/28/00"), (61, "m/d/yy", "3/1/00"),
])
def test_cells_show_their_format(number, code, want):
    assert display(float(number), code) == want


def test_formatted_cells_of_a_sheet():
    book = io.BytesIO(xlsx.write_sheet([("p", "A")]))
    out = io.BytesIO()
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(book) as a, zipfile.ZipFile(out, "w") as b:
        for n in a.namelist():
            data = a.read(n).decode()
            if n.endswith("sheet1.xml"):
                data = data.replace("</sheetData>", '<row r="3"><c r="A3" s="1"><v>45292</v></c><c r="B3" s="2"><v>0.5</v></c></row></sheetData>')
            b.writestr(n, data)
        b.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts><cellXfs count="3"><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="9"/></cellXfs></styleSheet>')
    assert xlsx.read_sheet(out.getvalue())[2] == (3, "2024-01", "50%")


def test_import_by_path(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(xlsx.write_sheet([("p", "A")]))
    e = engine(spark, tmp_path / "s")
    assert e.import_path(f"file://{tmp_path}/a.xlsx")["inserted"] == 1 and e.store.read().first().source_file == "a.xlsx"


def test_connect_and_read_timeouts():
    client = HttpEmbedder(EmbeddingConfig(connect_timeout_ms=1500, read_timeout_ms=400, dimension=3, max_retries=0))
    with socket.socket() as server:  # takes connections and never answers
        server.bind(("127.0.0.1", 0))
        server.listen()
        client.cfg = replace(client.cfg, endpoint=f"http://127.0.0.1:{server.getsockname()[1]}/")
        started = time.monotonic()
        with pytest.raises(E.EngineError):
            client.embed(["x"])
        assert 0.3 < time.monotonic() - started < 1.4  # the read timeout, not the other
