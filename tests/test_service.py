"""The service under load and failure: one embedding a text, writers at the same time, reloads, folders of sheets, broken replies."""

import http.server
import io
import json
import os
import socket
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from kindred import errors as E
from kindred.config import EmbeddingConfig, EngineConfig, ImportConfig, SearchConfig
from kindred.operators import index as ix
from kindred.operators import store as st
from kindred.operators.tables import cut, scope, shared_dir
from kindred.plans.api import Engine
from kindred.sources import xlsx
from kindred.sources.embedder import HashEmbedder, HttpEmbedder
from tests.test_engine import CFG, sheet


class Counting(HashEmbedder):
    """Notes every text in a file, as it runs in other processes."""

    def __init__(self, path, dimension=8):
        super().__init__(dimension)
        self.path = str(path)

    def embed(self, texts):
        with open(self.path, "a") as f:
            f.write("".join(f"{t}\n" for t in texts))
        return super().embed(texts)

    def seen(self):
        return open(self.path).read().split() if os.path.exists(self.path) else []


def service(spark, tmp_path, min_similarity=-1.0):
    embedder = Counting(tmp_path / "texts")
    return Engine(spark, str(tmp_path / "s"), embedder, EngineConfig(EmbeddingConfig(model_version="m", dimension=8), ImportConfig(), SearchConfig(min_similarity=min_similarity)))


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, paragraph string").repartition(4)


def test_each_text_is_embedded_once(spark, tmp_path):
    e = service(spark, tmp_path)
    e.import_samples(sheet(spark, [("known", "A"), ("other", "B")]))
    assert sorted(e.embedder.seen()) == ["known", "other"]
    os.remove(e.embedder.path)
    got = {r.query_id: r for r in e.predict(asked(spark, ["known", "new", " new ", "new", "newer", "known"] + ["more"] * 5)).collect()}
    assert sorted(e.embedder.seen()) == ["more", "new", "newer"]
    assert [got[k].match_type for k in range(11)] == ["EXACT", "SEMANTIC", "SEMANTIC", "SEMANTIC", "SEMANTIC", "EXACT"] + ["SEMANTIC"] * 5
    assert got[1][1:] == got[2][1:] == got[3][1:] and got[1].max_similarity != got[4].max_similarity
    os.remove(e.embedder.path)
    assert {r.match_type for r in e.predict(asked(spark, ["known", "other"])).collect()} == {"EXACT"} and e.embedder.seen() == []
    assert e.predict_one("newest")["match_type"] == "SEMANTIC" and e.embedder.seen() == ["newest"]
    with pytest.raises(E.EngineError):
        e.predict(asked(spark, ["fine", " "]))


def test_predict_neither_aggregates_nor_counts_samples(spark, tmp_path):
    e = service(spark, tmp_path)
    e.import_samples(sheet(spark, [(f"p{k}", "A") for k in range(20)]))
    executions = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    requests = asked(spark, ["a", "b"])
    before = executions()
    df = e.predict(requests)
    assert executions() - before == 2  # the routed requests and the vectors are written; neither samples nor requests are counted
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # every aggregate is over requests: the cached samples are scanned, and joined or searched
    assert "InMemoryRelation" in plan and "max_by" not in plan and df.count() == 2


def store_rows(spark, store, names, first=None):
    rows = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "row_no int, paragraph string")
    rows = rows.withColumns({"normalized_text": F.col("paragraph"), "text_hash": F.sha2("paragraph", 256), "codes": F.lit("A"), "vector": F.array(F.lit(1.0).cast("float"))})
    return st.storage_projection(st.assign_ids(rows, store.next_id() if first is None else first), "m", 1, "f")


def together(*calls):
    results = [None] * len(calls)

    def run(k, call):
        try:
            results[k] = call()
        except Exception as e:
            results[k] = e

    threads = [threading.Thread(target=run, args=x) for x in enumerate(calls)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return results


def test_two_writers_of_one_batch(spark, tmp_path):
    stores = [st.SampleStore(spark, str(tmp_path / "s")) for _ in range(2)]
    stores[0].create()
    rows = [store_rows(spark, s, [f"t{k}" for k in range(20)]) for s in stores]
    got = together(*(lambda s=s, r=r: s.insert_all(r) for s, r in zip(stores, rows)))
    assert sorted(map(str, got)) == ["20", "text_hash is not unique"]
    assert stores[0].read().count() == 20 and stores[1].next_id() == 21
    assert sorted(x.name.split("=")[0] for x in (tmp_path / "s").iterdir()) == ["v00000000.done", "values"]  # nothing of the loser


def test_many_writers_take_ids_of_their_own(spark, tmp_path):
    stores = [st.SampleStore(spark, str(tmp_path / "s"), buckets=4) for _ in range(4)]
    stores[0].create()
    rows = [store_rows(spark, s, [f"{w}-{k}" for k in range(5)]) for w, s in enumerate(stores)]
    assert together(*(lambda s=s, r=r: s.insert_all(r) for s, r in zip(stores, rows))) == [5] * 4
    all_rows = stores[0].read().collect()
    assert sorted(r.sample_id for r in all_rows) == list(range(1, 21)) and len({r.text_hash for r in all_rows}) == 20
    assert stores[0].insert_all(store_rows(spark, stores[0], [])) == 0 and len(stores[0].versions()) == 4


def files_read(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in text.split("PartitionFilters: [")[1].split("]")[0]
    nodes, total = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.executedPlan())
        if node.metrics().contains("numFiles"):
            total += node.metrics().apply("numFiles").value()
        nodes += [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_an_import_reads_the_buckets_of_its_hashes(spark, tmp_path):
    store = st.SampleStore(spark, str(tmp_path / "s"), buckets=32)
    store.create()
    for v in range(3):
        store.insert_all(store_rows(spark, store, [f"{v}-{k}" for k in range(200)]))
    batch = spark.createDataFrame([("0-7",), ("new",)], "t string").select(F.sha2("t", 256).alias("text_hash"))
    held = store.holding(batch)
    assert 1 <= files_read(held) <= 2 * 3 and held.join(batch, "text_hash", "left_semi").count() == 1
    before = sorted(map(tuple, store.read().select("sample_id", "text_hash").collect()))
    store.compact()
    assert len(store.live()) == 1 and files_read(store.holding(batch)) <= 2
    assert sorted(map(tuple, store.read().select("sample_id", "text_hash").collect())) == before and store.next_id() == 601
    store.vacuum()
    assert store.read().count() == 600 and store.insert_all(store_rows(spark, store, ["after"])) == 1 and store.read().count() == 601
    with pytest.raises(E.EngineError):
        store.insert_all(store_rows(spark, store, ["1-3"]))


def test_reload_decodes_new_versions_only(spark, tmp_path, monkeypatch):
    e = service(spark, tmp_path)
    read, calls = e.store.read, []
    monkeypatch.setattr(e.store, "read", lambda versions=None: calls.append(versions) or read(versions))
    e.import_samples(sheet(spark, [("a", "A")]))
    old = e.index.current
    waiting = e.predict(asked(spark, ["a", "zz"]))
    e.import_samples(sheet(spark, [("b", "B"), ("c", "C")]))
    e.reload_index()
    assert [c for c in calls if c] == [["v00000000"], ["v00000001"]]
    now = e.index.current
    assert (old.sample_count, now.sample_count, len(now.segments), now.status) == (1, 3, len(old.segments) + 1, "READY") and now.segments[0] is old.segments[0]
    assert sorted(r.match_type for r in waiting.collect()) == ["EXACT", "SEMANTIC"]  # of the old snapshot
    assert {r.query_id: (r.match_type, r.references[0].sample_id) for r in e.predict(asked(spark, ["a", "b", "c"])).collect()} == {0: ("EXACT", 1), 1: ("EXACT", 2), 2: ("EXACT", 3)}
    blocks = [r.block for r in now.samples.collect()]
    assert set(blocks) <= set(range(now.blocks))
    for k in range(ix.MOST_SMALL + 4):  # small segments are built anew as one
        e.store.insert_all(store_rows(spark, e.store, [f"x{k}"]).withColumns({"vector_data": F.lit(bytes(range(1, 33))), "vector_dim": F.lit(8)}))
        e.index.follow({v: e.store.marker(v)["rows"] for v in e.store.live()}, lambda vs: st.active_samples(read(vs), "m", 8), 8)
    assert e.index.current.blocks <= ix.MOST_SMALL + 2 and e.index.current.sample_count == 3 + ix.MOST_SMALL + 4
    assert e.predict_one("x1")["match_type"] == "EXACT"


def test_tables_of_a_scope(spark):
    with scope():
        df = cut(spark.range(5).toDF("x"), "scoped")
        with scope():
            inner = cut(df, "inner")
        assert df.count() == 5
        with pytest.raises(Exception):
            inner.count()
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0])
    assert shared_dir(spark)


# --- sheets
def test_a_folder_of_sheets(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for k in range(100):
        (tmp_path / "in" / ("deep" if k % 2 else ".") / f"s{k:03d}.xlsx").write_bytes(xlsx.write_sheet([(f"p{k}", "A"), (f"q{k}", "B")]))
    (tmp_path / "in" / "note.txt").write_text("no sheet")
    spark.dataSource.register(xlsx.XlsxSource)
    df = spark.read.format("xlsx_sheet").option("fileName", "true").load(str(tmp_path / "in"))
    assert df.columns == ["row_no", "paragraph", "raw_codes", "file_name"] and df.rdd.getNumPartitions() == 100
    rows = df.collect()
    assert len(rows) == 200 and len({r.file_name for r in rows}) == 100 and all(f"s{int(r.paragraph[1:]):03d}.xlsx" in r.file_name for r in rows)
    some = spark.read.format("xlsx_sheet").load(str(tmp_path / "in" / "*" / "s00?.xlsx"))
    assert sorted({r.paragraph for r in some.collect()}) == sorted(f"{c}{k}" for c in "pq" for k in (1, 3, 5, 7, 9))
    assert spark.read.format("xlsx_sheet").load(f"file://{tmp_path}/in/*/s*.xlsx").count() == 100
    assert xlsx.read_sheets(spark, f"file://{tmp_path}/in").select("file_name").distinct().count() == 100
    with pytest.raises(Exception):
        spark.read.format("xlsx_sheet").load(str(tmp_path / "gone")).collect()


def with_part(name, data):
    book, out = io.BytesIO(xlsx.write_sheet([("p", "A")])), io.BytesIO()
    with zipfile.ZipFile(book) as a, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as b:
        for n in a.namelist():
            b.writestr(n, data if n == name else a.read(n))
        if name not in a.namelist():
            b.writestr(name, data)
    return out.getvalue()


def test_bombs_are_refused():
    bomb = with_part("xl/sharedStrings.xml", b" " * 5_000_000)
    assert len(bomb) < 20_000
    with pytest.raises(E.EngineError, match="unpacks"):
        xlsx.read_sheet(bomb, 1_000_000)
    # a size that isn't true: the stated one is small
    said = (5_000_000).to_bytes(4, "little")
    lie = bomb.replace(said, (900).to_bytes(4, "little"))
    with pytest.raises(E.EngineError):
        xlsx.read_sheet(lie, 1_000_000)
    with pytest.raises(E.EngineError):
        xlsx.read_sheet(xlsx.write_sheet([("p", "A")])[:-30])


# --- the embedding service
@pytest.fixture
def broken_server():
    """Answers by a list of kinds: good, cut (a reply broken off), reset, odd (no HTTP), 500."""
    kinds, connections = [], []
    listener = socket.socket()
    listener.bind(("127.0.0.1", 0))
    listener.listen()

    def serve(s):
        f = s.makefile("rb")
        while kinds:
            length = None
            while (line := f.readline().strip()):
                if line.lower().startswith(b"content-length"):
                    length = int(line.split(b":")[1])
            if length is None:
                break
            f.read(length)
            kind, body = kinds.pop(0), b"[[3, 4, 0]]"
            if kind == "reset":
                s.setsockopt(socket.SOL_SOCKET, socket.SO_LINGER, b"\1\0\0\0\0\0\0\0")
                break
            status = {"odd": b"HELLO\r\n", "500": b"HTTP/1.1 500 no\r\n"}.get(kind, b"HTTP/1.1 200 OK\r\n")
            s.sendall(status + b"Content-Length: %d\r\n\r\n" % (len(body) + (50 if kind == "cut" else 0)) + body)
            if kind in ("cut", "odd", "close"):
                break
        f.close()
        s.close()

    def accept():
        while True:
            try:
                s, _ = listener.accept()
            except OSError:
                return
            connections.append(s)
            threading.Thread(target=serve, args=(s,), daemon=True).start()

    threading.Thread(target=accept, daemon=True).start()
    yield f"http://127.0.0.1:{listener.getsockname()[1]}/embed?x=1", kinds, connections
    listener.close()


@pytest.mark.parametrize("kind", ["cut", "reset", "odd", "500"])
def test_broken_replies_are_read_failures(broken_server, kind):
    url, kinds, _ = broken_server
    client = HttpEmbedder(EmbeddingConfig(endpoint=url, dimension=3, max_retries=1, read_timeout_ms=2000))
    kinds += [kind, "good"]
    assert client.embed(["x"])[0][0] == pytest.approx(0.6)
    kinds += [kind] * 2
    with pytest.raises(E.EngineError) as e:
        client.embed(["x"])
    assert e.value.code == 503 and not kinds
    kinds += [kind] * 2
    assert client.is_healthy() is False
    kinds += ["good"]
    assert client.is_healthy() is True


def test_a_worker_keeps_its_connection(broken_server):
    import pickle

    url, kinds, connections = broken_server
    client = HttpEmbedder(EmbeddingConfig(endpoint=url, dimension=3, max_retries=0))
    kinds += ["good"] * 3 + ["close", "good"]
    for _ in range(5):  # the fifth finds its connection closed, and opens another without a try of its own
        client.embed(["x"])
    assert len(connections) == 2 and pickle.loads(pickle.dumps(client))._held is None
    assert HttpEmbedder(EmbeddingConfig(endpoint="http://127.0.0.1:9/", connect_timeout_ms=200)).is_healthy() is False


def test_plain_servers_still_work():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            n = len(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["inputs"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps([[3, 4, 0]] * n).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpEmbedder(EmbeddingConfig(endpoint=f"http://127.0.0.1:{server.server_port}", dimension=3))
    assert len(client.embed(["x", "y"])) == 2 and len(client.embed(["z"])) == 1
    server.shutdown()
    assert CFG.min_similarity == 0.5
