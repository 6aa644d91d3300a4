"""The sample store: comparison with a batch, projection, ids and the all-or-nothing write."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.errors import MSG_STORE_CONFLICT, EngineError
from kindred.functions import text as tx
from kindred.functions import vectors as vx
from kindred.operators.ranking import running_start
from kindred.schemas import SAMPLE_STORE


#: How often a writer takes up a batch again that others came before.
TRIES = 50


def active_samples(store: DataFrame, model_version: str, dimension: int) -> DataFrame:
    """Enabled samples of one model and dimension. Filters reach the scan."""
    return store.where((F.col("model_version") == model_version) & (F.col("vector_dim") == dimension) & (F.col("enabled") == 1))


def compare_with_store(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Batch rows with store_status: new, skipped (same labels) or conflict. Disabled samples don't count.

    One hash of the store is one row (its key is unique), so the left join keeps the batch's rows.
    """
    known = store.where(F.col("enabled") == 1).groupBy(F.col("text_hash").alias("_hash")).agg(F.max(F.struct("sample_id", "codes")).alias("_known"))
    joined = batch.join(known, batch.text_hash == known["_hash"], "left")
    status = (
        F.when(F.col("_hash").isNull(), "new")
        .when(F.col("codes") == F.col("_known.codes"), "skipped")
        .otherwise("conflict")
    )
    return joined.withColumn("store_status", status).drop("_hash", "_known")


def new_rows(batch: DataFrame, store: DataFrame) -> DataFrame:
    return batch.join(store.where(F.col("enabled") == 1).select("text_hash"), "text_hash", "left_anti")


def store_conflict_errors(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("store_status") == "conflict").select("row_no", F.lit(MSG_STORE_CONFLICT).alias("message"))


def assign_ids(rows: DataFrame, first_id: int) -> DataFrame:
    """sample_id counted from first_id in row order."""
    return running_start(rows, "row_no", F.lit(1), "sample_id").withColumn("sample_id", (F.col("sample_id") + first_id).cast("long"))


def storage_projection(rows: DataFrame, model_version: str, dimension: int, source_file: str | None) -> DataFrame:
    """Rows with an id and a vector in the store's schema."""
    return rows.select(
        "sample_id",
        F.col("paragraph").alias("original_text"),
        "normalized_text",
        "text_hash",
        "codes",
        vx.encode(F.col("vector")).alias("vector_data"),
        F.lit(dimension).alias("vector_dim"),
        tx.truncate_name(F.lit(source_file).cast("string")).alias("source_file"),
        F.lit(1).alias("enabled"),
        F.current_timestamp().alias("create_time"),
        F.lit(model_version).alias("model_version"),
    )


def import_summary(compared: DataFrame) -> DataFrame:
    """One row: total_rows, inserted, skipped, n_errors. Any error means that nothing is inserted.

    Parse errors stop before the store is looked at, so then its duplicates don't count as skipped.
    """
    n = lambda cond: F.count_if(cond)
    parse = n(F.col("status").isin("invalid", "conflict"))
    clash = n((F.col("status") == "new") & (F.col("store_status") == "conflict"))
    known = n((F.col("status") == "new") & (F.col("store_status") == "skipped"))
    fresh = n((F.col("status") == "new") & (F.col("store_status") == "new"))
    return compared.agg(
        F.count("*").alias("total_rows"),
        F.when((parse == 0) & (clash == 0), fresh).otherwise(0).alias("inserted"),
        (n(F.col("status") == "skipped") + F.when(parse == 0, known).otherwise(0)).alias("skipped"),
        F.when(parse > 0, parse).otherwise(clash).alias("n_errors"),
    )


class SampleStore:
    """Samples as versions of a Parquet folder. A version is a marker, v<number>.done, which names its data folder and the next free id.

    A batch is written to a folder of its own and published by creating the marker of the next number, which only one writer can: on
    local disks by a hard link, elsewhere by a rename that doesn't replace. A writer that comes second looks at the winner's rows: hashes
    are checked again, disabled samples included, and ids that are taken meanwhile are moved up. So no hash and no id is published
    twice, and a batch that fails leaves no rows and no folder.

    Data is laid out by buckets of the hash, a folder each. holding() reads those of some hashes only, so an import's comparison and its last
    check read as many buckets as the batch has, whatever the store holds; compact() joins the files of many versions.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 256):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs, self._known = fs, {}

    def create(self) -> None:
        self._fs.mkdirs(self._path(self.root))

    def drop(self) -> None:
        self._fs.delete(self._path(self.root), True)

    def versions(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(n[: -len(".done")] for n in names if n.endswith(".done"))

    def marker(self, version: str) -> dict:
        """What a version says: folder, rows, next_id, and, where it replaces all before it, compacted. Markers never change."""
        if version not in self._known:
            stream = self._fs.open(self._path(f"{self.root}/{version}.done"))
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            self._known[version] = json.loads(text)
        return self._known[version]

    def live(self) -> list[str]:
        """The versions that hold the rows: the last compacted one, if any, and those after it."""
        names = self.versions()
        compacted = [k for k, v in enumerate(names) if self.marker(v).get("compacted")]
        return names[compacted[-1] :] if compacted else names

    def read(self, versions: list[str] | None = None) -> DataFrame:
        return self._stored(versions).select(*SAMPLE_STORE.names)

    def holding(self, hashes: DataFrame) -> DataFrame:
        """The samples in the buckets of the hashes (one column text_hash). The buckets, a bounded number, come to the driver, so that
        the scan leaves out the folders of others."""
        buckets = [r[0] for r in hashes.select(self._bucket()).distinct().collect()]
        return self._stored().where(F.col("bucket").isin(buckets)).select(*SAMPLE_STORE.names)

    def _bucket(self) -> Column:
        return (F.conv(F.substring(F.sha2("text_hash", 256), 1, 8), 16, 10).cast("long") % self.buckets).cast("int").alias("bucket")

    def _stored(self, versions: list[str] | None = None) -> DataFrame:
        paths = [f"{self.root}/{self.marker(v)['folder']}" for v in (self.live() if versions is None else versions)]
        schema = T.StructType([*SAMPLE_STORE.fields, T.StructField("bucket", T.IntegerType())])
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*paths)

    def next_id(self) -> int:
        """The first id that no published sample has; the newest marker knows it."""
        names = self.versions()
        return self.marker(names[-1])["next_id"] if names else 1

    def insert_all(self, rows: DataFrame) -> int:
        """Publish the rows, all or none. Ids below the next free one are moved up together."""
        folder = self._write(rows)
        try:
            for _ in range(TRIES):
                names, written = self.versions(), self._data(folder)
                n, distinct, first, last = written.agg(F.count("*"), F.count_distinct("text_hash"), F.min("sample_id"), F.max("sample_id")).first()
                if not n:
                    self._delete(folder)
                    return 0
                if n != distinct or not written.join(self.holding(written).select("text_hash"), "text_hash", "left_semi").isEmpty():
                    raise EngineError("text_hash is not unique", 500)
                free = self.marker(names[-1])["next_id"] if names else 1
                if first < free:
                    old, folder = folder, self._write(written.withColumn("sample_id", F.col("sample_id") + (free - first)))
                    self._delete(old)
                    last += free - first
                if self._publish(len(names), {"folder": folder, "rows": n, "next_id": last + 1}):
                    return n
            raise EngineError("the batch could not be published: too many other writers", 500)
        except BaseException:  # whatever it was, no folder stays
            self._delete(folder)
            raise

    def compact(self) -> None:
        """Publish all rows as one version, with one file a bucket. Folders of the versions before stay for those who read them, until vacuum()."""
        names = self.versions()
        if len(self.live()) < 2:
            return
        folder = self._write(self.read())
        try:
            n = sum(self.marker(v)["rows"] for v in self.live())
            if not self._publish(len(names), {"folder": folder, "rows": n, "next_id": self.next_id(), "compacted": True}):
                raise EngineError("the store changed while it was compacted", 500)
        except BaseException:
            self._delete(folder)
            raise

    def vacuum(self) -> None:
        """Delete the folders that compacted versions have replaced; frames that still read them fail."""
        live = {self.marker(v)["folder"] for v in self.live()}
        for v in self.versions():
            if self.marker(v)["folder"] not in live:
                self._delete(self.marker(v)["folder"])

    def _data(self, folder: str) -> DataFrame:
        return self.spark.read.schema(SAMPLE_STORE).parquet(f"{self.root}/{folder}")

    def _write(self, rows: DataFrame) -> str:
        folder = f"values=n{uuid.uuid4().hex}"
        columns = [f.name for f in SAMPLE_STORE.fields]
        try:
            # one file a bucket, dealt by it
            dealt = rows.select(*columns, self._bucket()).repartition("bucket")
            dealt.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        except BaseException:
            self._delete(folder)
            raise
        return folder

    def _delete(self, folder: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{folder}"), True)

    def _publish(self, number: int, marker: dict) -> bool:
        """Create the marker of that number, whole, unless there is one."""
        path, half = self._path(f"{self.root}/v{number:08d}.done"), self._path(f"{self.root}/.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(half)
        try:
            stream.write(bytearray(json.dumps(marker).encode()))
        finally:
            stream.close()
        try:
            at = self._fs.resolvePath(self._path(self.root)).toUri()
            if at.getScheme() == "file":  # where a rename replaces
                try:
                    os.link(f"{at.getPath()}/{half.getName()}", f"{at.getPath()}/{path.getName()}")
                except FileExistsError:
                    return False
                return True
            return not self._fs.exists(path) and self._fs.rename(half, path)
        finally:
            self._fs.delete(half, False)
