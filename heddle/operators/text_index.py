"""A full-text index that is kept current by batches.

Each batch of documents becomes a segment: a table of postings sorted by term, so that a prefix is a range of it and the row
groups and pages outside are skipped by their statistics, and a small table of document lengths. What a batch changes or
removes is withdrawn: a document's postings don't count in segments before the number that its withdrawal names. Nothing
that is written is changed; when there are several segments of like size, one takes their place, without what was withdrawn,
so that there are as many segments as the logarithm of the postings. The numbers that scores need (documents, tokens) are
kept in the log by difference and never counted from postings.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.search import own_postings
from heddle.streaming.ingest import Log

#: So many segments of a size class are merged into one; sizes of a class differ by this factor at most.
FAN = 4
#: Bytes of a row group of postings: the least that a search reads of a file.
ROW_GROUP = 8 << 20
#: Postings that a task sorts, so few that they stay in memory; tasks of a pass at least, and passes at most.
SORTED, TASKS, PASSES = 1 << 19, 8, 8
#: Terms that the bounds of passes are drawn from, about.
SAMPLE = 20_000
#: Whether Spark removes the shuffle files of a query when it ends, rather than when the driver happens to collect its garbage.
_REMOVED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_POSTINGS = "doc string, term string, positions array<int>, tf bigint, dl int"


class TextIndex:
    """The index below a path. Documents are rows (doc, text); a null text has no tokens but is a document."""

    def __init__(self, spark: SparkSession, path: str, stemmed: bool = True, row_group: int = ROW_GROUP):
        self.spark, self.path, self.stemmed, self.row_group = spark, path.rstrip("/"), stemmed, row_group
        self.log = Log(spark, f"{self.path}/log")

    def _state(self) -> tuple[int, dict]:
        number, entry = self.log.last()
        return number, entry or {"segments": [], "withdrawn": [], "documents": 0, "tokens": 0}

    def exists(self) -> bool:
        return self.log.last()[1] is not None

    def statistics(self) -> tuple[int, float]:
        """(documents, mean length), from the log."""
        entry = self._state()[1]
        return entry["documents"], entry["tokens"] / max(1, entry["documents"])

    def segments(self) -> int:
        return len(self._state()[1]["segments"])

    def _tables(self, entry: dict, kind: str, schema: str) -> DataFrame:
        out = self.spark.createDataFrame([], f"{schema}, segment int")
        for s in entry["segments"]:
            own = self.spark.read.schema(schema).parquet(f"{self.path}/{s['folder']}/{kind}").withColumn("segment", F.lit(s["number"]))
            out = own if s is entry["segments"][0] else out.unionAll(own)
        return out

    def _withdrawn(self, entry: dict) -> DataFrame:
        """(doc, before): the postings of doc in segments of lower numbers don't count."""
        paths = [f"{self.path}/{folder}" for folder in entry["withdrawn"]]
        schema = "doc string, before int"
        own = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return own.groupBy("doc").agg(F.max("before").alias("before")) if len(paths) > 1 else own

    def _live(self, entry: dict, kind: str, schema: str) -> DataFrame:
        rows = self._tables(entry, kind, schema)
        if not entry["withdrawn"]:
            return rows
        gone = self._withdrawn(entry).withColumnRenamed("doc", "_doc")
        return rows.join(gone, (F.col("doc") == F.col("_doc")) & (F.col("segment") < F.col("before")), "left_anti")

    def postings(self) -> DataFrame:
        """(doc, term, positions, tf, dl) of the documents as they are now; filters on term reach the files."""
        return self._live(self._state()[1], "postings", _POSTINGS).drop("segment")

    def documents(self) -> DataFrame:
        """(doc, dl) of the documents as they are now, those without tokens too."""
        return self._live(self._state()[1], "lengths", "doc string, dl int").drop("segment")

    @contextmanager
    def _little_disk(self) -> Iterator[None]:
        """Queries that run in here leave no shuffle files."""
        before = self.spark.conf.get(_REMOVED, "false")
        self.spark.conf.set(_REMOVED, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_REMOVED, before)

    def _ranges(self, rows: DataFrame, n: int) -> list[tuple[int, Column]]:
        """(tasks, condition) of the passes that n rows are sorted in: ranges of terms of about the same number of rows, which hold all terms."""
        tasks = math.ceil(max(1, n) / SORTED)
        passes = max(1, min(PASSES, tasks // TASKS))
        drawn = sorted(r["term"] for r in rows.select("term").sample(min(1.0, SAMPLE / n), seed=1).collect()) if passes > 1 else []
        bounds = sorted({drawn[k * len(drawn) // passes] for k in range(1, passes)}) if drawn else []
        above = [F.lit(True), *(F.col("term") > t for t in bounds)]
        upto = [*(F.col("term") <= t for t in bounds), F.lit(True)]
        return [(math.ceil(tasks / len(above)), x & y) for x, y in zip(above, upto, strict=True)]

    def _segment(self, number: int, rows: DataFrame, n: int, lengths: DataFrame) -> dict:
        """Writes postings (n or fewer) sorted by term, one range of terms after another, so that one range's shuffle is on disk at a time; and lengths. Gives the segment's entry."""
        folder = f"s-{uuid.uuid4().hex}"
        for tasks, these in self._ranges(rows, n):
            own = rows.filter(these).select("doc", "term", "positions", "tf", "dl").repartitionByRange(tasks, "term", "doc").sortWithinPartitions("term", "doc")
            own.write.mode("append").option("parquet.block.size", self.row_group).option("compression", "zstd").parquet(f"{self.path}/{folder}/postings")
        lengths.select("doc", "dl").write.parquet(f"{self.path}/{folder}/lengths")
        n = self.spark.read.parquet(f"{self.path}/{folder}/postings").count()  # from the files' footers
        return {"folder": folder, "number": number, "rows": n}

    def _merged(self, entry: dict) -> dict:
        """The entry after segments of like size are merged, as often as there are enough of them."""
        while True:
            classes: dict[int, list[dict]] = {}
            for s in entry["segments"]:
                classes.setdefault(int(math.log(max(1, s["rows"]), FAN)), []).append(s)
            full = next((of for _, of in sorted(classes.items()) if len(of) >= FAN), None)
            if full is None:
                return entry
            part = entry | {"segments": full}
            new = self._segment(max(s["number"] for s in full), self._live(part, "postings", _POSTINGS), sum(s["rows"] for s in full), self._live(part, "lengths", "doc string, dl int"))
            left = sorted([s for s in entry["segments"] if s not in full] + [new], key=lambda s: s["number"])
            entry = entry | {"segments": left}
            kept = self._withdrawn(entry).filter(F.col("before") > left[0]["number"])
            folder = f"w-{uuid.uuid4().hex}"
            kept.write.parquet(f"{self.path}/{folder}")
            entry = entry | {"withdrawn": [folder] if self.spark.read.parquet(f"{self.path}/{folder}").head(1) else []}

    def update(self, docs: DataFrame, removed: DataFrame | None = None) -> None:
        """Puts docs (doc, text), each once, in place of what was indexed under these names, and takes removed (doc) out."""
        number, entry = self._state()
        with self._little_disk():
            self._update(number + 1, entry, docs, removed)

    def rebuild(self, docs: DataFrame) -> None:
        """Puts docs (doc, text), each once, in place of all that was indexed."""
        with self._little_disk():
            self._update(self._state()[0] + 1, {"segments": [], "withdrawn": [], "documents": 0, "tokens": 0}, docs, None)

    def _update(self, number: int, entry: dict, docs: DataFrame, removed: DataFrame | None) -> None:
        own = docs.select(F.col("doc").cast("string").alias("doc"), "text")
        folder = f"s-{uuid.uuid4().hex}"
        rows = own_postings(own, "doc", F.col("text"), self.stemmed)
        draft = f"{self.path}/{folder}/draft"
        rows.write.option("compression", "zstd").parquet(draft)
        rows = self.spark.read.schema(_POSTINGS).parquet(draft)
        tokens = rows.groupBy("doc").agg(F.first("dl").alias("dl"))
        lengths = own.select("doc").join(tokens, "doc", "left").select("doc", F.coalesce("dl", F.lit(0)).alias("dl"))
        segment = self._segment(number, rows, rows.count(), lengths)  # the number from the files' footers
        lengths = self.spark.read.schema("doc string, dl int").parquet(f"{self.path}/{segment['folder']}/lengths")
        gone = lengths.select("doc") if removed is None else lengths.select("doc").union(removed.select(F.col("doc").cast("string"))).distinct()
        before = self._live(entry, "lengths", "doc string, dl int").join(gone, "doc", "left_semi")
        hidden = f"w-{uuid.uuid4().hex}"
        before.select("doc", F.lit(number).alias("before"), "dl").write.parquet(f"{self.path}/{hidden}")
        old = self.spark.read.parquet(f"{self.path}/{hidden}").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("s")).first()
        new = lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("s")).first()
        changed = {
            "segments": entry["segments"] + [segment] * (new["n"] > 0),
            "withdrawn": entry["withdrawn"] + [hidden] * (old["n"] > 0),
            "documents": entry["documents"] - old["n"] + new["n"],
            "tokens": entry["tokens"] - old["s"] + new["s"],
        }
        self.log.append(number, self._merged(entry | changed))
        path = self.spark._jvm.org.apache.hadoop.fs.Path(draft)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)
