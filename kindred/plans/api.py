"""The service's four calls: import samples, predict, reload the index, index status."""

from __future__ import annotations

import logging
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.config import EngineConfig
from kindred.errors import MSG_PARAGRAPH_EMPTY, UNAVAILABLE, EngineError, raised_by_worker
from kindred.functions import text as tx
from kindred.operators import staging, store as st, vote
from kindred.operators.index import IndexHolder
from kindred.operators.tables import scope
from kindred.schemas import SHEET
from kindred.sources import xlsx
from kindred.sources.embedder import Embedder, embed_column, embedded_texts

log = logging.getLogger(__name__)


class Engine:
    """Logs carry counts, hashes and times; never texts or vectors."""

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder, cfg: EngineConfig | None = None):
        self.spark, self.cfg, self.embedder = spark, cfg or EngineConfig(), embedder
        self.store = st.SampleStore(spark, root)
        self.store.create()
        self.index = IndexHolder()
        try:
            self.reload_index()
        except Exception as e:
            log.warning("index not loaded at start: %s", type(e).__name__)

    def import_file(self, name: str, data: bytes) -> dict:
        xlsx.check_upload(name, data, self.cfg.imports.max_file_bytes)
        try:
            rows = xlsx.data_rows(xlsx.read_sheet(data))
        except EngineError as e:
            if str(e) == xlsx.E.MSG_HEADER:
                return self._failed(0, 0, [{"row": 1, "message": str(e)}])
            raise
        return self.import_samples(self.spark.createDataFrame(rows, SHEET), name)

    def import_path(self, path: str) -> dict:
        """import_file() of one file in any file system that Spark reads."""
        return self.import_file(*xlsx.read_bytes(self.spark, path))

    def import_samples(self, sheet: DataFrame, source_file: str | None = None) -> dict:
        """All or nothing: any error leaves the store as it was."""
        cap = self.cfg.imports.max_rows
        staged = staging.stage(sheet, cap, self.cfg.search.max_paragraph_length).persist()
        compared = None
        try:
            total, skipped = staged.agg(F.count("*"), F.count_if(F.col("status") == "skipped")).first()
            errors = staging.errors(staged, cap)
            if found := self._errors(errors):
                return self._failed(total, skipped, found)
            new = staged.where(F.col("status") == "new")
            compared = st.compare_with_store(new, self.store.holding(new)).persist()
            skipped += compared.where(F.col("store_status") == "skipped").count()
            if found := self._errors(st.store_conflict_errors(compared)):
                return self._failed(total, skipped, found)
            fresh = compared.where(F.col("store_status") == "new")
            inserted = 0 if fresh.isEmpty() else self._insert(fresh, source_file)
        except Exception as e:
            raise raised_by_worker(e) or e
        finally:
            staged.unpersist()
            if compared is not None:
                compared.unpersist()
        reloaded = True
        try:
            self.reload_index()
        except Exception as e:
            reloaded = False
            log.error("rows stored, index not refreshed: %s", type(e).__name__)
        return {"success": True, "total_rows": total, "inserted": inserted, "skipped": skipped, "index_reloaded": reloaded, "errors": []}

    def _insert(self, fresh: DataFrame, source_file: str | None) -> int:
        emb = self.cfg.embedding
        rows = st.assign_ids(fresh.select("row_no", "paragraph", "normalized_text", "text_hash", "codes"), self.store.next_id())
        embedded = embed_column(rows, self.embedder, "normalized_text", emb.batch_size)  # written once; insert_all() reads it back
        return self.store.insert_all(st.storage_projection(embedded, emb.model_version, emb.dimension, source_file))

    def predict(self, requests: DataFrame) -> DataFrame:
        """Predictions of (query_id, paragraph); empty or too long paragraphs are an error.

        Requests are routed and texts without an exact match embedded, each once, before this returns: both are written as tables, and
        an embedder's failure is an EngineError here. Search and vote are lazy. The tables stay until the application ends, or
        until the tables.scope() ends in which predict() was called.
        """
        snapshot = self._snapshot()
        ready = requests.select("query_id", tx.normalize(F.col("paragraph")).alias("normalized_text"))
        ready = ready.withColumn("text_hash", tx.text_hash(F.col("normalized_text")))
        embed = lambda rows: embedded_texts(rows, self.embedder, "text_hash", "normalized_text", self.cfg.embedding.batch_size)
        check = lambda c: tx.paragraph_error(c, self.cfg.search.max_paragraph_length)
        try:
            return vote.predict_texts(ready, snapshot.samples, snapshot.hashes, self.cfg.search, embed, self.cfg.embedding.dimension, snapshot.blocks, check)
        except Exception as e:
            raise raised_by_worker(e) or e

    def predict_one(self, paragraph: str | None) -> dict:
        if paragraph is None or not paragraph.strip("".join(map(chr, range(33)))):
            raise EngineError(MSG_PARAGRAPH_EMPTY)
        started = time.monotonic()
        try:
            with scope():
                row = self.predict(self.spark.createDataFrame([(1, paragraph)], "query_id long, paragraph string")).first()
        except Exception as e:
            raise raised_by_worker(e) or e
        log.info("predicted in %d ms, %s", (time.monotonic() - started) * 1000, row.match_type)
        return {**row.asDict(recursive=True), "model_version": self.cfg.embedding.model_version}

    def _snapshot(self):
        if self.index.current is None:
            raise EngineError("index not loaded", UNAVAILABLE)
        return self.index.current

    def reload_index(self) -> dict:
        """Take up what the store has published since the last load; only that is decoded. Requests see the old snapshot until the swap."""
        emb = self.cfg.embedding
        read = lambda versions: st.active_samples(self.store.read(versions), emb.model_version, emb.dimension)
        self.index.follow({v: self.store.marker(v)["rows"] for v in self.store.live()}, read, emb.dimension)
        return self.index_status()

    def index_status(self) -> dict:
        s = self._snapshot()
        return {"status": s.status, "sample_count": s.sample_count, "error_count": s.error_count, "loaded_at": s.loaded_at, "model_version": self.cfg.embedding.model_version, "dimension": self.cfg.embedding.dimension}

    def is_healthy(self) -> bool:
        return self.embedder.is_healthy()

    @staticmethod
    def _errors(errors: DataFrame) -> list[dict]:
        return [{"row": r.row_no, "message": r.message} for r in errors.orderBy("row_no").collect()]  # at most max_rows + 1 rows

    @staticmethod
    def _failed(total: int, skipped: int, errors: list[dict]) -> dict:
        return {"success": False, "total_rows": total, "inserted": 0, "skipped": skipped, "index_reloaded": False, "errors": errors}


def new_store_root(base: str) -> str:
    return f"{base.rstrip('/')}/samples-{uuid.uuid4().hex[:8]}"
