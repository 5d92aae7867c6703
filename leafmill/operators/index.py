"""Maintaining an index of chunks: upserts, deletes, change detection and statistics on plain DataFrames and Parquet."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the greatest by `order`, nulls lowest; equal ones by the whole row, so that the choice is fixed."""
    rest = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in df.dtypes if c not in keys]
    by = [*(F.col(c).desc_nulls_last() for c in order), F.xxhash64(*rest).desc() if rest else F.lit(1)]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("__n = 1").drop("__n")


def upsert(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The target with the incoming rows in place of those with their keys. Incoming rows without a key are left out, and
    of several with one key the first by content stays."""
    new = latest(incoming.where(F.col(key).isNotNull()), [key], [])
    return target.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_documents(target: DataFrame, doc_ids: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """The target without the chunks of the given documents; chunks of no document stay."""
    return target.join(doc_ids.select(doc_col).where(F.col(doc_col).isNotNull()).distinct(), doc_col, "left_anti")


def changes(stored: DataFrame, incoming: DataFrame, key: str = "doc_key", content: str = "content_hash") -> DataFrame:
    """(key, change): inserted, updated, deleted or unchanged for every key of either side. Incoming rows of null content
    say nothing about their key, which then counts as unchanged where it is stored."""
    s, i = stored.select(key, F.col(content).alias("old")).distinct(), incoming.select(key, F.col(content).alias("new")).distinct()
    both = s.withColumn("in_old", F.lit(True)).join(i.withColumn("in_new", F.lit(True)), key, "full")
    what = F.when(F.col("in_new").isNull(), "deleted").when(F.col("new").isNull(), F.when(F.col("in_old").isNotNull(), "unchanged")).when(F.col("in_old").isNull(), "inserted").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return both.select(key, what.alias("change")).where(F.col("change").isNotNull())


def index_stats(chunks: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """(documents, chunks, vectors, in_sync)."""
    return chunks.agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.count(vector_col).alias("vectors")).withColumn("in_sync", F.col("chunks") == F.col("vectors"))


class ConcurrentWrite(Exception):
    """Another writer made the version first."""


class ChunkStore:
    """An index below `root`, a shared folder, in `buckets` by the hash of its key.

    A write makes the buckets it touches anew, in a folder of its own, and a small file that says in which folder each
    bucket of this version lies; readers follow the newest of these files, so they never see half a write, and a failed
    write leaves the old version. Two writers that start from one version cannot both end: the file of a version is
    created only once. Folders no kept version names are removed; `keep` versions are kept, for readers that still use them.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "node_id", buckets: int = 16, keep: int = 2):
        self.spark, self.root, self.key, self.buckets, self.keep = spark, root.rstrip("/"), key, buckets, keep
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        p = self._path(f"{self.root}/versions")
        return sorted(int(x.getPath().getName()) for x in self._fs.listStatus(p) if x.getPath().getName().isdigit()) if self._fs.exists(p) else []

    def version(self) -> int:
        return max(self._versions(), default=-1)

    def exists(self) -> bool:
        return self.version() >= 0

    def _manifest(self, v: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/versions/{v}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows of the current version, or of some of its buckets."""
        m = self._manifest(self.version())
        schema = StructType.fromJson(m["schema"])
        paths = [f"{self.root}/{folder}/__b={b}" for b, folder in m["at"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, key: str | None = None):
        return F.pmod(F.xxhash64(F.col(key or self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def _commit(self, df: DataFrame, touched: list[int] | None) -> int:
        """A version in which `df` stands in place of the touched buckets, of all where that is None."""
        v = self.version() + 1
        old = self._manifest(v - 1) if v else {"at": {}}
        folder = f"data-{v}-{uuid.uuid4().hex[:8]}"
        df.withColumn("__b", self._bucket()).repartition(self.buckets, "__b").write.partitionBy("__b").parquet(f"{self.root}/{folder}")
        p = self._path(f"{self.root}/{folder}")
        made = {x.getPath().getName()[4:]: folder for x in self._fs.listStatus(p) if x.getPath().getName().startswith("__b=")}
        kept = {} if touched is None else {b: f for b, f in old["at"].items() if int(b) not in touched}
        tmp = self._path(f"{self.root}/versions/tmp-{folder}")
        self._fs.mkdirs(self._path(f"{self.root}/versions"))
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps({"at": kept | made, "schema": df.schema.jsonValue()}).encode()))
        out.close()
        to = self._path(f"{self.root}/versions/{v}")
        if self._fs.exists(to) or not self._fs.rename(tmp, to):
            self._fs.delete(p, True)
            raise ConcurrentWrite(f"version {v} of {self.root}")
        self._clean()
        return v

    def _clean(self) -> None:
        versions = self._versions()
        for v in versions[: -self.keep]:
            self._fs.delete(self._path(f"{self.root}/versions/{v}"), False)
        named = {f for v in versions[-self.keep :] for f in self._manifest(v)["at"].values()}
        for x in self._fs.listStatus(self._path(self.root)):
            n = x.getPath().getName()
            if n.startswith("data-") and n not in named and int(n.split("-")[1]) <= versions[-1]:
                self._fs.delete(x.getPath(), True)

    def write(self, df: DataFrame) -> int:
        """The rows as the next version, in place of all there are."""
        return self._commit(df, None)

    def create(self, df: DataFrame) -> bool:
        """Creates the index unless it is there or the rows are none; whether it did."""
        if self.exists() or df.isEmpty():
            return False
        self.write(df)
        return True

    def upsert(self, rows: DataFrame, key: str | None = None) -> int:
        """Puts rows in place of those with their keys; only the buckets of these keys are written."""
        if key not in (None, self.key):
            raise ValueError(f"the store is kept by {self.key}, not by {key}")
        rows = rows.where(F.col(self.key).isNotNull())
        if not self.exists():
            return self._commit(latest(rows, [self.key], []), None)
        touched = self._touched(rows)
        return self._commit(upsert(self.read(touched), rows, self.key), touched)

    def merge(self, rows: DataFrame, order: list[str]) -> int:
        """Of every key the greatest row by `order`, of those there are and the new ones; only their buckets are written."""
        rows = rows.where(F.col(self.key).isNotNull())
        if not self.exists():
            return self._commit(latest(rows, [self.key], order), None)
        touched = self._touched(rows)
        return self._commit(latest(self.read(touched).unionByName(rows, allowMissingColumns=True), [self.key], order), touched)

    def delete(self, doc_ids: DataFrame) -> int:
        """Without the chunks of the documents; only buckets that hold such chunks are written."""
        gone = doc_ids.select("doc_id").where("doc_id is not null").distinct()
        touched = self._touched(self.read().select(self.key, "doc_id").join(gone, "doc_id", "left_semi"))
        return self._commit(delete_documents(self.read(touched), gone), touched) if touched else self.version()

    def predelete_and_upsert(self, rows: DataFrame, predelete: bool = True) -> int:
        """With `predelete`, chunks of the rows' documents leave first, so that none of an older text stays; else as `upsert`."""
        if predelete and self.exists():
            self.delete(rows.select("doc_id"))
        return self.upsert(rows)


def reingest(items: DataFrame, handler, most: int = 50, delay: float = 0.0, order: str = "doc_key") -> list[tuple[str, str | None]]:
    """(item, error) of the first `most` items in order, each given to `handler` by itself with a pause between them; an item
    that fails has its error and does not stop the others. What is beyond `most` is left for the next call."""
    out = []
    for n, r in enumerate(items.select(order).where(F.col(order).isNotNull()).distinct().orderBy(order).limit(most).collect()):
        if n and delay:
            time.sleep(delay)
        try:
            handler(r[0])
            out.append((r[0], None))
        except Exception as e:  # noqa: BLE001  (isolated to its item)
            out.append((r[0], f"{type(e).__name__}: {e}"))
    return out
