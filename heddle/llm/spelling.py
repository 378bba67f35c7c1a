"""Words of a corpus grouped with the frequent words that they are one edit away from.

One edit leaves a half of a word intact, so two near words share their first or their last half. The dictionary is
therefore laid out twice, by its words and by its reversed words, and ranges of it are scanned for blocks of words that share
a prefix or a suffix. A block is two sorts of words, of m letters and of m+1, since an edit changes a length by one at most;
pairs are of two words of m letters or of one of each. A block that is too large is subdivided by the same rule: of the
stretch of letters that its words may differ in, an edit leaves one half intact again, which makes a longer prefix or
suffix. Blocks too large for a task are subdivided on Spark, the others where they are scanned. Every pair has one block that
may report it (the one whose stretch holds the end of the words' common prefix), so no pair is found twice.

Cases: null texts have no words; a null id counts as the text `null` in the checksum; repeated rows are separate documents;
very long words are words like others; other columns are ignored; an empty table gives no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.base import forgotten, new_path

#: Least length and count of a word, how many times its own count a form's has to be.
LENGTH, COUNT, RATIO = 5, 3, 2
#: One of so many runs of a document loses a letter.
LOSSES = 97
#: Words of a block that one task scans, and words of a block whose pairs are all compared.
SCANNED, COMPARED = 4096, 32
#: Pairs that a task compares at a time.
_PAIRS = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the distinct words of LENGTH code points and COUNT places or more, by built-in functions."""
    runs = F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit("([A-Za-zÀ-ÿ]+)")))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("id"), runs.alias("run"))
    rows = rows.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    rows = rows.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    lost = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    rows = rows.select(F.when(F.col("h") % LOSSES == 0, lost).otherwise(F.col("run")).alias("word"))
    return rows.filter(F.length("word") >= LENGTH).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= COUNT)


def _block(a: Column, b: Column) -> Column:
    """What the words of a block share: a prefix of a letters, a suffix of b letters, read from its end."""
    return F.concat(F.substring("word", F.lit(1), a), F.lit("\n"), F.substring(F.reverse("word"), F.lit(1), b))


def _halved(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, a, b) with either half of the stretch between prefix and suffix added to the prefix or to the suffix."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    longer = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
    other = F.struct(F.col("a").alias("a"), (F.col("m") - F.col("a") - half).alias("b"))
    return rows.select("word", "n", "m", F.explode(F.array(longer, other)).alias("cut")).select("word", "n", "m", "cut.a", "cut.b")


def blocks(dictionary: DataFrame, most: int = SCANNED) -> list[DataFrame]:
    """(word, n, m, a, b, key) of all blocks, those of more than `most` words subdivided as long as their words may differ in more than one letter."""
    spark = dictionary.sparkSession
    size = F.length("word").cast("int")
    sorts = dictionary.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).filter(F.col("m") >= LENGTH)
    rows, out = _halved(sorts.select("*", F.lit(0).alias("a"), F.lit(0).alias("b"))), []
    while True:
        path = new_path(spark, "spelling-blocks")
        rows.withColumn("key", _block(F.col("a"), F.col("b"))).write.option("compression", "zstd").parquet(path)
        rows = spark.read.parquet(path)
        sizes = rows.groupBy("m", "a", "b", "key").agg(F.count("*").alias("words")).filter((F.col("words") > most) & (F.col("m") - F.col("a") - F.col("b") > 1))
        if not sizes.head(1):
            return [*out, rows]
        large = sizes.drop("words")
        out.append(rows.join(large, ["m", "a", "b", "key"], "left_anti").select(rows.columns))
        rows = _halved(rows.join(large, ["m", "a", "b", "key"], "left_semi"))


class _Scan:
    """Compares words of blocks and sums up, for each word, how many are near and which of these is the most frequent."""

    def __init__(self):
        self.words: list[bytes] = []
        self.n: list[int] = []
        self.left, self.right, self.caps, self.m, self.pairs = [], [], [], [], 0

    def add(self, words: list[bytes], n: list[int], m: int, a: int, b: int) -> Iterator[pa.RecordBatch]:
        """Takes the words of a block; gives results whenever enough has come together."""
        at = len(self.words)
        self.words += words
        self.n += n
        yield from self._within(np.arange(at, len(self.words)), m, a, b)

    def _within(self, own: np.ndarray, m: int, a: int, b: int) -> Iterator[pa.RecordBatch]:
        stretch = m - a - b
        if len(own) > COMPARED and stretch > 1:
            half = stretch // 2
            for a_, b_ in ((a + half, b), (a, m - a - half)):
                parts: dict[bytes, list[int]] = {}
                for i in own.tolist():
                    w = self.words[i]
                    parts.setdefault(w[:a_] + b"\n" + w[len(w) - b_ :], []).append(i)
                for part in parts.values():
                    if len(part) > 1:
                        yield from self._within(np.array(part), m, a_, b_)
            return
        sizes = np.array([len(self.words[i]) for i in own.tolist()])
        short, long = own[sizes == m], own[sizes != m]
        rows = max(1, _PAIRS // max(1, len(own)))
        for at in range(0, len(short), rows):
            some = short[at : at + rows]
            i, j = (x.ravel() for x in np.meshgrid(np.arange(at, at + len(some)), np.arange(len(short)), indexing="ij"))
            self._take(short[i[i < j]], short[j[i < j]], m, m - b if b else m + 1)
            if len(long):
                i, j = (x.ravel() for x in np.meshgrid(some, long, indexing="ij"))
                self._take(i, j, m, m - b if b else m + 1)
            if self.pairs >= _PAIRS:
                yield from self.flushed()

    def _take(self, left: np.ndarray, right: np.ndarray, m: int, cap: int) -> None:
        if len(left):
            self.left.append(left)
            self.right.append(right)
            self.caps.append(np.full(len(left), cap))
            self.m.append(np.full(len(left), m))
            self.pairs += len(left)

    def flushed(self) -> Iterator[pa.RecordBatch]:
        """(word, n_near, best_n, best) of what is near among the pairs taken so far; words stay for blocks that go on."""
        if self.pairs:
            left, right, caps, m = (np.concatenate(x) for x in (self.left, self.right, self.caps, self.m))
            self.left, self.right, self.caps, self.m, self.pairs = [], [], [], [], 0
            found = [np.zeros(0, np.int64)] * 2
            for size in np.unique(m).tolist():
                this = np.flatnonzero(m == size)
                near = _near(self.words, left[this], right[this], size, caps[this])
                found = [np.concatenate((x, y[this][near])) for x, y in zip(found, (left, right), strict=True)]
            if len(found[0]):
                yield self._summed(*found)

    def forget(self) -> None:
        if not self.pairs:
            self.words, self.n = [], []

    def _summed(self, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        own, other = np.concatenate((left, right)), np.concatenate((right, left))
        used, at = np.unique(other, return_inverse=True)
        order_of = np.empty(len(used), np.int64)
        order_of[sorted(range(len(used)), key=lambda i: (-self.n[used[i]], self.words[used[i]]))] = np.arange(len(used))
        order = np.lexsort((order_of[at], own))
        own, other = own[order], other[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        counts = np.diff(np.append(first, len(own)))
        text = lambda ids: pa.array([self.words[i].decode("latin-1") for i in ids.tolist()], pa.string())
        best = other[first]
        return pa.RecordBatch.from_arrays([text(own[first]), pa.array(counts, pa.int64()), pa.array([self.n[i] for i in best.tolist()], pa.int64()), text(best)], names=["word", "n_near", "best_n", "best"])


def _near(all_words: list[bytes], left: np.ndarray, right: np.ndarray, m: int, caps: np.ndarray) -> np.ndarray:
    """Which pairs of a word of m letters with one of m or m+1 are one edit apart, and have their common prefix end before the cap."""
    used, at = np.unique(np.concatenate((left, right)), return_inverse=True)
    own = [all_words[i] for i in used.tolist()]
    forward = np.frombuffer(b"".join(w.ljust(m + 1, b"\0") for w in own), np.uint8).reshape(-1, m + 1)
    backward = np.frombuffer(b"".join(w[::-1].ljust(m + 1, b"\0") for w in own), np.uint8).reshape(-1, m + 1)
    longer = np.array([len(w) > m for w in own])[at[len(left) :]]
    out, step = np.zeros(len(left), bool), max(1, (_PAIRS * 16) // (m + 1))
    for k in range(0, len(left), step):
        i, j = at[: len(left)][k : k + step], at[len(left) :][k : k + step]
        prefix, suffix = (np.append(x[i, :m] != x[j, :m], np.ones((len(i), 1), bool), 1).argmax(1) for x in (forward, backward))
        out[k : k + step] = (prefix + suffix >= m - ~longer[k : k + step]) & (prefix < caps[k : k + step])
    return np.flatnonzero(out)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan, key, words, n = _Scan(), None, [], []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("m", "a", "b", "key", "word", "n")]
        for *of, word, times in zip(*cols, strict=True):
            if of != key:
                if len(words) > 1:
                    yield from scan.add(words, n, *key[:3])
                    if len(scan.words) > _PAIRS:
                        yield from scan.flushed()
                    scan.forget()
                key, words, n = of, [], []
            words.append(word.encode("latin-1"))
            n.append(times)
    if len(words) > 1:
        yield from scan.add(words, n, *key[:3])
    yield from scan.flushed()


def near_words(dictionary: DataFrame, most: int = SCANNED) -> DataFrame:
    """(word, n_near, best_n, best) of the words of dictionary (word, n) that have near words; best is the most frequent, the first of several."""
    found = None
    for rows in blocks(dictionary, most):
        ranges = rows.repartitionByRange("m", "a", "b", "key").sortWithinPartitions("m", "a", "b", "key", "word")
        part = ranges.mapInArrow(_scanned, "word string, n_near long, best_n long, best string")
        found = part if found is None else found.unionAll(part)
    first = F.min(F.struct((-F.col("best_n")).alias("order"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first")).select("word", "n_near", (-F.col("first.order")).alias("best_n"), F.col("first.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form) by doubling: each round, words go on to the root of their root.

    A form is at least RATIO times as frequent as its word, so chains are as long as a count has bits, and rounds are few.
    """
    spark, path = forms.sparkSession, None
    roots = forms.withColumnRenamed("form", "root")
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        before, path = path, new_path(spark, "spelling-roots")
        step.write.option("compression", "zstd").parquet(path)
        if before:
            forgotten(spark, before)
        step = spark.read.parquet(path)
        roots = step.drop("moved")
        if not step.filter("moved").head(1):
            return roots


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = SCANNED) -> DataFrame:
    """One row for each word of docs: word, form, root, n, n_near, form_n."""
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "spelling-words")
    words(docs, id_col, text_col).write.option("compression", "zstd").parquet(path)
    dictionary = spark.read.parquet(path)
    path = new_path(spark, "spelling-near")
    near_words(dictionary, most).write.option("compression", "zstd").parquet(path)
    own = dictionary.join(spark.read.parquet(path), "word", "left")
    own = own.withColumn("form", F.when(F.col("best_n") >= RATIO * F.col("n"), F.col("best")))
    out = own.join(_roots(own.filter("form is not null").select("word", "form")), "word", "left")
    form_n = F.when(F.col("form").isNotNull(), F.col("best_n"))
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form_n.alias("form_n"))
