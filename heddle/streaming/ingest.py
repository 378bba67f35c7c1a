"""Incremental ingest: new files as a stream, upserts per micro-batch, event windows with late data."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from heddle.operators.archive import regrouped, upserted


def changed(listing: DataFrame, log: DataFrame, parser_version: int) -> DataFrame:
    """Files (path, mtime) that the log (path, mtime, parser_version) doesn't have in this state and with this parser or a newer one."""
    seen = log.filter(F.col("parser_version") >= parser_version).select("path", "mtime")
    return listing.join(seen, ["path", "mtime"], "left_anti")


class Log:
    """Numbered JSON entries in a folder. An entry is there as a whole or not at all, and only one writer can create a number.

    It is written beside the log and then linked (on a local disk) or renamed without overwriting (elsewhere) to its number, so
    a writer that dies leaves nothing that counts. What can't be parsed is passed over. Stores without such a rename, as
    object stores are, need a single writer.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def numbers(self) -> list[int]:
        fs, folder = self._file("")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def entry(self, number: int) -> dict | None:
        """The entry of a number, or None if there is none or it can't be parsed."""
        fs, path = self._file(f"{number:020d}")
        try:
            file = fs.open(path)
        except Exception:  # gone in between
            return None
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        except ValueError:
            return None
        finally:
            file.close()

    def last(self) -> tuple[int, dict | None]:
        """The highest number there is, and the newest entry that can be parsed."""
        numbers = self.numbers()
        found = (self.entry(n) for n in reversed(numbers))
        return (numbers[-1] if numbers else 0), next((e for e in found if e is not None), None)

    def append(self, number: int, entry: dict) -> None:
        """RuntimeError if another writer has the number."""
        fs, draft = self._file(f"_draft-{uuid.uuid4().hex}")
        _, path = self._file(f"{number:020d}")
        out = fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(entry).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        try:
            if fs.getScheme() == "file":
                local = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(path), local(draft))
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, none)
        except Exception as e:  # the file system's own error tells whether another writer was first
            if fs.exists(path):
                raise RuntimeError(f"another writer has stored version {number} of {self.path}") from e
            raise
        finally:
            fs.delete(draft, False)


class Snapshots:
    """A table as immutable folders of key buckets, and a log whose last entry names the folder of each bucket.

    An upsert writes the buckets that its keys fall into and no others, and then one entry of the log; a write that fails
    before that changes nothing, and a second writer of the same version fails and may try again on the new state.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.log = Log(spark, f"{self.path}/log")

    def _last(self) -> tuple[int, dict | None]:
        return self.log.last()

    def _commit(self, version: int, entry: dict) -> None:
        self.log.append(version, entry)

    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets))

    def _read(self, entry: dict, buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        paths = [f"{self.path}/{folder}/_bucket={b}" for b, folder in entry["folders"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _written(self, df: DataFrame, key: str | None) -> dict[str, str]:
        folder = f"v-{uuid.uuid4().hex}"
        bucket = F.lit(0) if key is None else self._bucket(key)
        df.withColumn("_bucket", bucket).write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(path)]
        return {n.removeprefix("_bucket="): folder for n in names if n.startswith("_bucket=")}

    def current(self) -> DataFrame | None:
        entry = self._last()[1]
        return None if entry is None else self._read(entry)

    def version(self) -> int:
        return self._last()[0]

    def _store(self, version: int, key: str | None, schema: StructType, folders: dict[str, str]) -> None:
        self._commit(version, {"key": key, "buckets": self.buckets, "schema": schema.jsonValue(), "folders": folders})

    def replace(self, df: DataFrame, key: str | None = None) -> None:
        version = self._last()[0]
        self._store(version + 1, key, df.schema, self._written(df, key))

    def _changed(self, keys: DataFrame, key: str, change: Callable[[DataFrame], DataFrame], fresh: DataFrame) -> None:
        """Stores what change makes of the buckets that keys fall into."""
        number, entry = self._last()
        if entry is None or entry["key"] != key or entry["buckets"] != self.buckets:
            out = change(self._read(entry) if entry else fresh.limit(0))
            self._store(number + 1, key, out.schema, self._written(out, key))
            return
        hit = [str(r["b"]) for r in keys.select(self._bucket(key).alias("b")).distinct().collect()]  # as many as there are buckets
        if hit:
            out = change(self._read(entry, hit))
            kept = {b: f for b, f in entry["folders"].items() if b not in hit}
            self._store(number + 1, key, out.schema, kept | self._written(out, key))

    def upsert(self, fresh: DataFrame, key: str, version: str | None = None) -> None:
        """One row for each key: fresh rows replace stored ones, never an older version a newer one."""
        self._changed(fresh, key, lambda stored: upserted(stored, fresh, key, version), fresh)

    def replace_groups(self, fresh: DataFrame, keys: DataFrame, key: str) -> None:
        """Many rows for a key: all stored rows of the keys go, and the fresh rows of these keys come. A key without fresh rows loses its rows."""
        self._changed(keys, key, lambda stored: regrouped(stored, fresh, keys, key), fresh)

    def vacuum(self, keep: int = 10) -> int:
        """Deletes the folders that none of the last `keep` entries of the log names, and the entries before these; gives their number.

        Nothing may read those versions, nor may a writer be at work: what it has written has no entry yet.
        """
        numbers = self.log.numbers()
        entries = [e for e in (self.log.entry(n) for n in numbers[-keep:]) if e is not None]
        named = {f for e in entries for f in e["folders"].values()}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("v-") and f.getPath().getName() not in named] if entries else []
        for path in old:
            fs.delete(path, True)
        for n in numbers[:-keep]:
            fs.delete(self.log._file(f"{n:020d}")[1], False)
        return len(old)


def watch(spark: SparkSession, path: str, schema: str, archive: Snapshots, key: str, checkpoint: str, version: str | None = None) -> StreamingQuery:
    """Upserts the records of new JSON files below path; all that are there, then stops."""

    def each(batch: DataFrame, _: int) -> None:
        archive.upsert(batch, key, version)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).json(path)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows(events: DataFrame, length: str, late: str) -> DataFrame:
    """(start, name, n, total) by window and name of events (ts, name, duration_ms), a table or a stream; in a stream late ones within the limit count."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    own = own.groupBy(F.window("ts", length).alias("w"), "name").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total"))
    return own.select(F.col("w.start").alias("start"), "name", "n", "total")


def gap_sessions(events: DataFrame, key: str, pause: str, late: str, identity: str = "event_id") -> DataFrame:
    """(key, start, end, n, total, names) of runs of events (ts, duration_ms, name, identity) of a key without a longer pause, a table or a stream.

    In a stream a run is given out once, when the watermark has passed its end by the pause; an event that comes again within
    the time that late ones have counts once; what comes later than that is dropped, and the query's progress counts it.
    """
    # a watermark needs times with a zone: times without one are those of the session's zone for as long
    kind = events.schema["ts"].dataType.simpleString()
    own = events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events
    own = own.withWatermark("ts", late).dropDuplicatesWithinWatermark([identity]) if events.isStreaming else own.dropDuplicates([identity])
    own = own.groupBy(F.session_window("ts", pause).alias("w"), key).agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return own.select(key, F.col("w.start").cast(kind).alias("start"), F.col("w.end").cast(kind).alias("end"), "n", "total", "names")


def exported_runs(runs: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends the closed runs of a stream of gap_sessions to a table below path; all input that is there, then stops. A restart repeats nothing."""
    return runs.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def job_states(log: DataFrame) -> DataFrame:
    """State of each job from an append-only log (job_id, chunk, status, at): the first completion of a chunk counts; a number, where there is one, tells what came first at the same time."""
    rank = F.when(F.col("status") == "complete", 0).otherwise(1)
    number = F.col("number") if "number" in log.columns else F.lit(0)
    order = F.struct(rank.alias("rank"), *(F.when(rank == 0, c).otherwise(-c).alias(n) for n, c in (("at", F.unix_micros("at")), ("number", number))))
    chunks = log.groupBy("job_id", "chunk").agg(F.min_by("status", order).alias("status"))
    state = F.when(F.count_if(F.col("status") != "complete") == 0, "complete").when(F.count_if(F.col("status") == "failed") > 0, "failed").otherwise("running")
    return chunks.groupBy("job_id").agg(F.count("*").alias("chunks"), F.count_if(F.col("status") == "complete").alias("complete"), state.alias("state"), F.min(F.when(F.col("status") == "pending", F.col("chunk"))).alias("next_chunk"))


def due(jobs: DataFrame, runs: DataFrame, stamp: str, now: str) -> DataFrame:
    """Jobs (job, backoff_minutes, daily_cap) that are to run: the store's stamp differs from the one of their last success, their last run lies far enough back, and they haven't run too often on this day.

    runs: an append-only log (job, at, stamp, ok); each failure since the last success doubles the wait.
    """
    moment = F.lit(now).cast("timestamp_ntz")
    good = runs.filter("ok").groupBy("job").agg(F.max_by("stamp", "at").alias("seen"), F.max("at").alias("good_at"))
    own = runs.join(good, "job", "left")
    state = own.groupBy("job").agg(F.max("at").alias("last"), F.count_if(F.to_date("at") == F.to_date(moment)).alias("today"), F.count_if(~F.col("ok") & (F.col("good_at").isNull() | (F.col("at") > F.col("good_at")))).alias("failures"), F.first("seen").alias("seen"))
    out = jobs.join(state, "job", "left")
    waited = (F.unix_micros(moment.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 60_000_000
    ready = F.col("last").isNull() | (waited >= F.col("backoff_minutes") * F.pow(F.lit(2), F.col("failures")))
    return out.filter(~F.col("seen").eqNullSafe(F.lit(stamp)) & ready & (F.coalesce("today", F.lit(0)) < F.col("daily_cap"))).select("job", F.coalesce("failures", F.lit(0)).alias("failures"))
