"""Processing only new or changed records: log-based change capture with offsets and replayed batch plans.

`pending_changes` compares the log of observations with what successful runs applied. `IncrementalSync` runs batches over
an append-only log in order of arrival: records belong to partitions by a hash of their key, every partition has an offset up
to which it was applied, a batch plan (start and end offsets) is written before anything is processed, and the sink drops
what it already holds by key and offset. A plan without its commit mark is replayed as it was written, so that a failure at any point
neither skips nor repeats a record.
"""

from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, functions as F


def observed(observations: DataFrame, *extra: str) -> DataFrame:
    """(source, blob_id, seen_at, file_hash) and the `extra` columns: what observations say, hashes in lower case.

    The hash is file_hash, or doc_id where that is null; observations without either, and those without a source or a
    time, say nothing.
    """
    h = F.lower(F.coalesce("file_hash", "doc_id"))
    return observations.select("source", "blob_id", "seen_at", h.alias("file_hash"), *extra).where("source is not null and blob_id is not null and file_hash is not null and seen_at is not null")


def newest(said: DataFrame, *extra: str) -> DataFrame:
    """The latest of each source: the greatest seen_at, whenever it landed; equal times go to the greater blob_id. `extra`
    columns are kept."""
    last = said.groupBy("source").agg(F.max(F.struct("seen_at", "blob_id", "file_hash", *extra)).alias("last"))
    return last.select("source", "last.blob_id", "last.seen_at", "last.file_hash", *(f"last.{c}" for c in extra))


def current_state(observations: DataFrame) -> DataFrame:
    """(source, file_hash, at): the hash of the latest observation of every source."""
    return newest(observed(observations)).select("source", "file_hash", F.col("seen_at").alias("at"))


def applied_state(log: DataFrame, runs: DataFrame) -> DataFrame:
    """(source, content_hash): what the last successful run that wrote a source left, in lower case; equal runs go to the
    greater log_id. Rows of runs that are unknown or did not succeed do not count."""
    fine = runs.where(F.col("status") == "success").select("run_no").distinct()
    last = log.join(fine, "run_no", "left_semi").where("source is not null").groupBy("source").agg(F.max(F.struct("run_no", "log_id", "content_hash")).alias("last"))
    return last.select("source", F.lower("last.content_hash").alias("content_hash"))


def pending(now: DataFrame, then: DataFrame) -> DataFrame:
    """(source, file_hash) of the files to process next: new ones and those whose hash differs from the applied one."""
    return now.join(then, "source", "left").where(~F.col("file_hash").eqNullSafe(F.col("content_hash"))).select("source", "file_hash")


def pending_changes(observations: DataFrame, log: DataFrame, runs: DataFrame) -> DataFrame:
    """(source, file_hash) to process next, from all observations at once."""
    return pending(current_state(observations), applied_state(log, runs))


class IncrementalSync:
    """Exactly-once batches from an append-only log into a sink below `root`, a folder that all executors share.

    The log has a key, an `offset` column that grows in order of arrival (a landing time, or a number given at append), and
    `ties`, columns that tell rows of one offset apart. `plan` writes, or finds unfinished, the next batch; `read` gives its
    records; `apply` writes a result of `read` (with key, offset and ties) to the batch's own folder of the sink; `commit`
    ends the batch. `run` does all four. Offsets are kept for each of `partitions` hash ranges of the key, a fixed number.

    A run reads the log from the smallest offset of its partitions on, a filter that reaches the scan, so that its cost goes
    by what is new. Rows of exactly the last offset are read once more, since others may arrive under it; the sink holds
    those it knows by key, offset and ties. Rows without an offset are looked at in every run. A batch that is replayed
    replaces its own folder, whatever a run that died left there. One run at a time may use a root.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, offset: str, ties: tuple[str, ...] = (), partitions: int = 16):
        self.spark, self.root, self.key, self.offset, self.ties, self.partitions = spark, root.rstrip("/"), key, offset, tuple(ties), partitions
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, name: str, value: dict) -> None:
        """Complete or not there: written aside, then renamed."""
        tmp, to = self._path(f"{self.root}/tmp-{name}"), self._path(f"{self.root}/{name}")
        self._fs.mkdirs(self._path(self.root))
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if not self._fs.rename(tmp, to):
            raise OSError(f"cannot rename to {to}")

    def _read(self, name: str) -> dict | None:
        p = self._path(f"{self.root}/{name}")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _names(self, folder: str, begin: str, end: str = "") -> list[int]:
        p = self._path(folder)
        names = [x.getPath().getName() for x in self._fs.listStatus(p)] if self._fs.exists(p) else []
        return sorted(int(n[len(begin) : len(n) - len(end)]) for n in names if n.startswith(begin) and n.endswith(end))

    def _bound(self, log: DataFrame, ends: dict[str, str]):
        """The partition's offset among `ends`, null for one without."""
        kind = dict(log.dtypes)[self.offset]
        p = F.pmod(F.xxhash64(self.key), F.lit(self.partitions)).cast("int")
        values = {int(k): v for k, v in ends.items() if v is not None}
        return F.try_element_at(F.create_map(*(F.lit(x).cast(t) for k, v in values.items() for x, t in ((k, "int"), (v, kind)))), p) if values else F.lit(None).cast(kind)

    def _since(self, log: DataFrame, start: dict[str, str]) -> DataFrame:
        """The log's rows with a key, from the offsets `start` on."""
        kind, o, rows = dict(log.dtypes)[self.offset], F.col(self.offset), log.where(F.col(self.key).isNotNull())
        if len(start) == self.partitions:  # a partition that had no row yet has no bound
            low = min(start.values(), key=str if kind.startswith(("timestamp", "date", "string")) else Decimal)
            rows = rows.where((o >= F.lit(low).cast(kind)) | o.isNull())
        since = self._bound(log, start)
        return rows.where(o.isNull() | since.isNull() | (o >= since))

    def unfinished(self) -> bool:
        """Whether there is a plan without its commit mark."""
        done = self._names(self.root, "plan-", ".json")
        return bool(done) and self._read(f"commit-{done[-1]}.json") is None

    def plan(self, log: DataFrame, process=lambda df: df) -> dict | None:
        """The batch to process: an unfinished one as it was written, else a new one, else None when there is nothing new: no
        later offset, and under the offsets read before nothing from which `process` makes rows that the sink lacks."""
        done = self._names(self.root, "plan-", ".json")
        start = {}
        if done:
            last = self._read(f"plan-{done[-1]}.json")
            if self._read(f"commit-{done[-1]}.json") is None:
                return last
            start = last["end"]
        new = self._since(log, start)
        p = F.pmod(F.xxhash64(self.key), F.lit(self.partitions)).cast("int").alias("p")
        ends = new.where(F.col(self.offset).isNotNull()).groupBy(p).agg(F.max(self.offset).cast("string").alias("o")).collect()
        batch = {"batch": (done[-1] + 1) if done else 0, "start": start, "end": start | {str(r["p"]): r["o"] for r in ends}}
        if batch["end"] == start and self._unknown(process(self.read(log, batch)), batch).isEmpty():
            return None
        self._write(f"plan-{batch['batch']}.json", batch)
        return batch

    def read(self, log: DataFrame, batch: dict) -> DataFrame:
        """The batch's records: those from the start to the end of their partition, and those without an offset. Rows without
        a key belong to no batch; a row delivered again under the same key, offset and ties comes once."""
        o = F.col(self.offset)
        rows = self._since(log, batch["start"]).where(o.isNull() | (o <= self._bound(log, batch["end"])))
        return rows.dropDuplicates([self.key, self.offset, *self.ties])

    def _unknown(self, rows: DataFrame, batch: dict) -> DataFrame:
        """The rows that no earlier batch wrote. Only rows of a start offset, or of none, can be among those."""
        held = self._folders(batch["batch"])
        if not held:
            return rows
        names = [self.key, self.offset, *self.ties]
        old = self._since(self.spark.read.parquet(*held), batch["start"]).select(*(F.col(c).alias(f"__{c}") for c in names))
        on = F.col(self.key) == F.col(f"__{self.key}")
        for c in names[1:]:
            on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return rows.join(old, on, "left_anti")

    def _folders(self, before: int | None = None) -> list[str]:
        """The sink's folders that hold rows of committed batches, below `before` if given."""
        sink = f"{self.root}/sink"
        whole = [n for n in self._names(sink, "upto-") if self._fs.exists(self._path(f"{sink}/upto-{n}"))]
        base = max(whole, default=-1)
        parts = [n for n in self._names(sink, "batch-") if n > base and (before is None or n < before)]
        parts = [n for n in parts if self._read(f"commit-{n}.json") is not None]
        return ([f"{sink}/upto-{base}"] if whole else []) + [f"{sink}/batch-{n}" for n in parts]

    def sink(self) -> DataFrame:
        """What all committed batches wrote."""
        return self.spark.read.parquet(*self._folders())

    def apply(self, rows: DataFrame, batch: dict) -> None:
        """Writes the rows whose key, offset and ties no earlier batch wrote, in place of what an earlier try of this one did."""
        self._unknown(rows, batch).write.mode("overwrite").parquet(f"{self.root}/sink/batch-{batch['batch']}")

    def commit(self, batch: dict) -> None:
        if self._read(f"commit-{batch['batch']}.json") is None:
            self._write(f"commit-{batch['batch']}.json", {"batch": batch["batch"]})

    def run(self, log: DataFrame, process=lambda df: df) -> dict | None:
        """One batch from plan to commit; `process` must keep the key, offset and ties columns."""
        batch = self.plan(log, process)
        if batch is not None:
            self.apply(process(self.read(log, batch)), batch)
            self.commit(batch)
        return batch

    def compact(self, merge, most: int = 16) -> bool:
        """Merges the sink's folders into one where they are more than `most`; whether it did. `merge` must give rows that
        stand for all it is given, as the newest of each key do."""
        folders, last = self._folders(), max(self._names(f"{self.root}/sink", "batch-"), default=-1)
        if len(folders) <= most or self._read(f"commit-{last}.json") is None:
            return False
        tmp, to = f"{self.root}/sink/tmp", f"{self.root}/sink/upto-{last}"
        merge(self.spark.read.parquet(*folders)).write.mode("overwrite").parquet(tmp)
        if not self._fs.rename(self._path(tmp), self._path(to)):
            raise OSError(f"cannot rename to {to}")
        for f in folders:
            self._fs.delete(self._path(f), True)
        return True


def capture(spark: SparkSession, root: str, observations: DataFrame, partitions: int = 16) -> DataFrame:
    """(source, blob_id, seen_at, file_hash): brings the state kept below `root` up to the observations and gives the latest one
    of every source.

    Observations are taken in order of landed_at, told apart by blob_id, and a call processes those that landed since the last
    one. Each batch leaves the newest observation of its sources in the sink. A call that failed is taken up where its plan
    was written.
    """
    sync = IncrementalSync(spark, root, "source", "landed_at", ("blob_id",), partitions)
    keep = lambda df: newest(df, "landed_at")
    said = observed(observations, "landed_at")
    unfinished = sync.unfinished()
    sync.run(said, keep)
    if unfinished:  # that was the call before; now what landed since
        sync.run(said, keep)
    sync.compact(keep)
    return newest(sync.sink()) if sync._folders() else newest(said)
