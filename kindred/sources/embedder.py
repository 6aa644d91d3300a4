"""Embedders: the HTTP one with its retry rule and checks, and a deterministic one for offline use."""

from __future__ import annotations

import hashlib
import http.client
import json
import math
import urllib.parse
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.config import EmbeddingConfig
from kindred.errors import UNAVAILABLE, EngineError, marked
from kindred.operators.tables import bounded, cut

#: Rows that leave a worker together with their vectors, about.
YIELD_ROWS = 512


class Embedder(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def unit(vector: list[float]) -> list[float]:
    """float32 elements of the vector divided by its float64 norm."""
    v = np.asarray(vector, dtype=np.float32).astype(np.float64)
    norm = math.sqrt(sum(x * x for x in v.tolist())) if v.size else 0.0
    if not np.isfinite(v).all() or norm == 0 or not math.isfinite(norm):
        raise ValueError("vector can't be normalised")
    return (v / norm).astype(np.float32).tolist()


def parse_response(body: object, count: int, dimension: int) -> list[list[float]]:
    """Check count, shape and elements of a reply, and normalise its rows."""
    if not isinstance(body, list) or len(body) != count:
        raise EngineError("embedding count mismatch", UNAVAILABLE)
    for row in body:
        if not isinstance(row, list) or len(row) != dimension:
            raise EngineError("embedding dimension mismatch", UNAVAILABLE)
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in row):
            raise EngineError("embedding element is not a number", UNAVAILABLE)
    try:
        return [unit(row) for row in body]
    except ValueError as e:
        raise EngineError("embedding reply can't be processed: ValueError", UNAVAILABLE) from e


class HttpEmbedder:
    """POSTs {"inputs": [...]} and expects one row of numbers for each text.

    Server errors and connection or read failures are tried again at once, max_retries times; a reply that is broken off or isn't
    HTTP is a read failure. Anything else fails at once. Errors carry the cause's class, never a body. A process keeps its
    connection from call to call; where the server has closed it meanwhile, a new one is opened, which isn't a try.
    """

    def __init__(self, cfg: EmbeddingConfig):
        self.cfg, self.dimension = cfg, cfg.dimension
        self._held: tuple[str, http.client.HTTPConnection] | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_held": None}  # workers open their own

    def embed(self, texts: list[str]) -> list[list[float]]:
        body = json.dumps({"inputs": texts}).encode()
        for left in range(max(0, self.cfg.max_retries), -1, -1):
            try:
                status, reply = self._post(body)
            except (OSError, http.client.HTTPException) as e:
                if not left:
                    raise EngineError(f"embedding service failed: {type(e).__name__}", UNAVAILABLE) from e
                continue
            if status >= 500 and left:
                continue
            if not 200 <= status < 300:
                raise EngineError(f"embedding service failed: HTTP {status}", UNAVAILABLE)
            try:
                return parse_response(json.loads(reply), len(texts), self.dimension)
            except ValueError as e:
                raise EngineError(f"embedding reply can't be processed: {type(e).__name__}", UNAVAILABLE) from e
        raise AssertionError

    def _post(self, body: bytes) -> tuple[int, bytes]:
        kept = self._held is not None and self._held[0] == self.cfg.endpoint
        try:
            return self._exchange(body)
        except (ConnectionError, http.client.BadStatusLine):
            if not kept:
                raise
        return self._exchange(body)  # the kept connection was stale: RemoteDisconnected is such an error too

    def _exchange(self, body: bytes) -> tuple[int, bytes]:
        """One request on the kept connection, or on a new one, which gives up after connect_timeout_ms and then waits read_timeout_ms
        for each read. After a failure, or if the server asks for it, the connection isn't kept."""
        at = urllib.parse.urlsplit(self.cfg.endpoint)
        connection = self._held[1] if self._held is not None and self._held[0] == self.cfg.endpoint else None
        self._held = None
        if connection is None:
            kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
            connection = kind(at.hostname, at.port, timeout=self.cfg.connect_timeout_ms / 1000)
        try:
            if connection.sock is None:
                connection.connect()
                connection.sock.settimeout(self.cfg.read_timeout_ms / 1000)
            connection.request("POST", (at.path or "/") + (f"?{at.query}" if at.query else ""), body, {"Content-Type": "application/json"})
            reply = connection.getresponse()
            data = reply.read()
        except BaseException:
            connection.close()
            raise
        if connection.sock is not None:
            self._held = self.cfg.endpoint, connection
        return reply.status, data

    def is_healthy(self) -> bool:
        try:
            self.embed(["health"])
        except Exception:  # whatever it was, the probe answers
            return False
        return True


class HashEmbedder:
    """A deterministic stand-in: elements from the text's SHA-256 in counter mode."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            raw = b"".join(hashlib.sha256(f"{i}:{t}".encode()).digest() for i in range(-(-self.dimension // 32)))
            out.append(unit((np.frombuffer(raw, np.uint8)[: self.dimension].astype(np.float32) - 127.5).tolist()))
        return out

    def is_healthy(self) -> bool:
        return True


def embedded_texts(rows: DataFrame, embedder: Embedder, key: str, text: str, batch_size: int = 8) -> DataFrame:
    """(key, vector), as a table: each distinct key is embedded once, by the job that this call runs; equal keys have equal texts."""
    distinct = rows.groupBy(key).agg(F.any_value(text).alias(text))
    return cut(embed_column(distinct, embedder, text, batch_size).select(key, "vector"), "embedded")


def embed_column(df: DataFrame, embedder: Embedder, text: str, batch_size: int = 8) -> DataFrame:
    """Add `vector` by calling the embedder on slices of the partition's rows; any failure fails the job.

    A worker holds one batch of rows, bounded by bytes, and the texts of one slice; rows leave as soon as YIELD_ROWS have their vectors.
    """
    step = max(1, batch_size)
    at_once = max(step, YIELD_ROWS // step * step)
    bounded(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                rows = batch.slice(at, at_once)
                vectors = np.empty((rows.num_rows, embedder.dimension), np.float32)
                for first in range(0, rows.num_rows, step):
                    texts = rows.column(text).slice(first, step).to_pylist()
                    try:
                        got = embedder.embed(texts)
                    except EngineError as e:
                        raise marked(e) from e
                    if len(got) != len(texts) or any(len(v) != embedder.dimension for v in got):
                        raise marked(EngineError("embedding batch incomplete", UNAVAILABLE))
                    vectors[first : first + step] = got
                starts = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * embedder.dimension)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.ListArray.from_arrays(starts, pa.array(vectors.ravel()))], [*rows.schema.names, "vector"])

    schema = T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))])
    return df.mapInArrow(run, schema)
