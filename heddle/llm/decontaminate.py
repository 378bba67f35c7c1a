"""Benchmark decontamination by winnowing.

A text's words are hashed; of the K-gram hashes in each run of WINDOW - K + 1 neighbours the least is kept, in test
items and documents alike, so two texts that share WINDOW consecutive words share a kept hash. Kept hashes of
documents are looked up among those of the items, and each hit is extended: the windows around it are compared with
the items' windows. Items shorter than a window can't be winnowed; their whole word sequence is looked up at each
place instead.

Items of BLOCK_WORDS words in all at most go to the tasks as one broadcast. Beyond that, kept hashes of documents and
items meet in a join (salted, as one hash may stand in a third of the documents), and a document's text meets the
items that share a kept hash with it, to be extended there; nothing of the items passes the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.base import arrow_type, free_names, grams, member, mixed, parts, slabs, words_of, written

#: Words of a window, words of a hashed gram, words of items that one broadcast holds, words of one piece of an item, ways that a
#: hash is salted, pieces of items that a text meets at a time.
WINDOW, K, BLOCK_WORDS, PIECE_WORDS, SALTS, TOGETHER = 10, 5, 1_000_000, 200_000, 16, 16


def winnowed(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the kept K-grams of word hashes; owner tells whose words they are (runs of equal numbers)."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, K)
    best, at = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, WINDOW - K + 1):
        less = g[j : j + n] <= best
        best[less] = g[j : j + n][less]
        at[less] = j
    whole = owner[:n] == owner[WINDOW - 1 :]
    pos = np.unique((np.arange(n) + at)[whole])
    return pos, g[pos]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word hashes of the items, long items in overlapping pieces."""
    for batch in batches:
        ids, words = [], []
        for item, text in zip(batch.column("item").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            h = words_of(text or b"")[0]
            for at in range(0, max(len(h) - WINDOW + 1, min(len(h), 1)), PIECE_WORDS):
                ids.append(item)
                words.append(h[at : at + PIECE_WORDS + WINDOW - 1].astype("<u8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(words, pa.binary())], names=["item", "words"])


class _Lookup:
    """Sorted distinct hashes, each with the items that have it."""

    def __init__(self, hashes: list[np.ndarray], items: list[str]):
        h = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        names = sorted(set(items))
        at = {x: i for i, x in enumerate(names)}
        own = np.repeat(np.array([at[x] for x in items], np.int64), [len(x) for x in hashes])
        pairs = np.unique(np.stack([h, own.astype(np.uint64)]), axis=1) if len(h) else np.zeros((2, 0), np.uint64)
        self.names = names
        self.keys, self.first = np.unique(pairs[0], return_index=True)
        self.first = np.append(self.first, pairs.shape[1])
        self.items = pairs[1].astype(np.int64)

    def items_of(self, keys: np.ndarray) -> list[str]:
        found = {int(i) for k in keys for i in self.items[self.first[k] : self.first[k + 1]]}
        return [self.names[i] for i in found]


class _Index:
    """The windows, kept hashes and short items of one block of benchmark items."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        long, short, kept = ([], []), {}, []
        for item, words in rows:
            h = np.frombuffer(words, "<u8")
            if len(h) >= WINDOW:
                long[0].append(grams(h, WINDOW))
                long[1].append(item)
                kept.append(winnowed(h, np.zeros(len(h), np.int64))[1])
            else:
                a, b = short.setdefault(len(h), ([], []))
                a.append(grams(h, len(h)))
                b.append(item)
        self.windows = _Lookup(*long)
        self.kept = np.unique(np.concatenate([*kept, np.zeros(0, np.uint64)]))
        self.short = {n: _Lookup(*x) for n, x in short.items()}

    def hits(self, h: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, _Lookup]]:
        """(words, starts, keys, lookup) of the items' windows found in a sequence of words."""
        pos, g = winnowed(h, owner)
        pos = pos[member(g, self.kept)[0]]
        starts = np.unique((pos[:, None] - np.arange(WINDOW - K + 1)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts <= len(h) - WINDOW)]
        starts = starts[owner[starts] == owner[starts + WINDOW - 1]]
        if len(starts):
            around = np.lib.stride_tricks.sliding_window_view(h, WINDOW)[starts]
            found, key = member(grams(around.T, WINDOW)[0], self.windows.keys)
            yield WINDOW, starts[found], key[found], self.windows
        for n, lookup in self.short.items():
            if len(h) >= n:
                found, key = member(grams(h, n), lookup.keys)
                found &= owner[: len(h) - n + 1] == owner[n - 1 :]
                at = np.flatnonzero(found)
                yield n, at, key[at], lookup


def _runs(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.diff(np.concatenate(([0], marks.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


_FOUND = "row long, doc_id {id}, n_words long, starts array<int>, ends array<int>, items array<string>"


def _runs_and_items(ix: _Index, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """Of each text: words, starts and ends of the hit runs, items found."""
    for first, last, data, offsets in slabs(texts):
        h, at, _ = words_of(data)
        owner = np.searchsorted(offsets, at, "right") - 1
        edge = np.searchsorted(owner, np.arange(last - first + 1))
        depth, found = np.zeros(len(h) + 1, np.int64), {}
        for n, s, keys, lookup in ix.hits(h, owner):
            np.add.at(depth, s, 1)
            np.add.at(depth, s + n, -1)
            own = owner[s]
            cut = np.flatnonzero(np.diff(own)) + 1
            for d, k in zip(own[np.concatenate(([0], cut))] if len(own) else [], np.split(keys, cut), strict=False):
                found.setdefault(int(d), set()).update(lookup.items_of(np.unique(k)))
        hit = np.cumsum(depth)[:-1] > 0
        for d in range(last - first):
            s, e = _runs(hit[edge[d] : edge[d + 1]]) if d in found else ((), ())
            yield int(edge[d + 1] - edge[d]), s, e, list(found.get(d, ()))


def _lists(found: list[tuple]) -> list[pa.Array]:
    n_words, starts, ends, items = zip(*found, strict=True) if found else [()] * 4
    return [pa.array(n_words, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]


def _scan(index, id_type: pa.DataType):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(_runs_and_items(index.value, batch.column("text").cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id").cast(id_type), *_lists(found)], names=["row", "doc_id", "n_words", "starts", "ends", "items"])

    return scan


def _marks(h: np.ndarray, short: list[int]) -> np.ndarray:
    """What a text or an item meets by: its kept hashes, and the hashes of all its runs of as many words as short items have."""
    own = [winnowed(h, np.zeros(len(h), np.int64))[1], *(mixed(grams(h, n) + np.uint64(n)) for n in short)]
    return np.unique(np.concatenate(own))


def _marked(short: list[int], id_type: pa.DataType):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            words = [words_of(t or b"")[0] for t in batch.column("text").cast(pa.binary()).to_pylist()]
            marks = pa.array([_marks(h, short).view(np.int64) for h in words], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id").cast(id_type), pa.array([len(h) for h in words], pa.int64()), marks], names=["row", "doc_id", "n_words", "marks"])

    return work


def _marked_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [np.frombuffer(w, "<u8") for w in batch.column("words").to_pylist()]
        marks = [_marks(h, [len(h)] if len(h) < WINDOW else []).view(np.int64) for h in words]
        yield pa.RecordBatch.from_arrays([batch.column("piece"), pa.array(marks, pa.list_(pa.int64()))], names=["piece", "marks"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text against the pieces that it met."""
    for batch in batches:
        found = []
        for text, pieces in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            found += _runs_and_items(_Index([(p["item"], p["words"]) for p in pieces]), [text])
        yield pa.RecordBatch.from_arrays([batch.column("row"), *_lists(found)[1:]], names=["row", "starts", "ends", "items"])


def _joined(rows: DataFrame, pieces: DataFrame, id_type: str) -> DataFrame:
    """Hit runs and items, as _FOUND, by a join of the kept hashes."""
    rows = written(rows, "docs")
    pieces = written(pieces.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    n = (F.octet_length("words") / 8).cast("int")
    short = sorted(r["n"] for r in pieces.filter(n < WINDOW).select(n.alias("n")).distinct().collect())  # WINDOW - 1 numbers at most
    marked = written(rows.mapInArrow(_marked(short, arrow_type(id_type)), f"row long, doc_id {id_type}, n_words long, marks array<long>"), "marks")
    of_items = pieces.mapInArrow(_marked_pieces, "piece long, marks array<long>").select("piece", F.explode("marks").alias("mark"))
    of_items = of_items.select("piece", "mark", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    of_docs = marked.select("row", F.explode("marks").alias("mark")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    met = of_docs.join(of_items, ["mark", "salt"]).select("row", "piece").distinct()
    met = met.join(pieces, "piece").select("row", "piece", F.struct("item", "words").alias("own"))
    place = F.floor((F.row_number().over(Window.partitionBy("row").orderBy("piece")) - 1) / TOGETHER)
    met = met.withColumn("some", place).groupBy("row", "some").agg(F.collect_list("own").alias("pieces"))
    found = met.join(rows.select("row", "text"), "row").select("row", "text", "pieces").mapInArrow(_extended, "row long, starts array<int>, ends array<int>, items array<string>")
    found = found.groupBy("row").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")))
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return marked.drop("marks").join(found, "row", "left").select("row", "doc_id", "n_words", none("starts", "int"), none("ends", "int"), none("items", "string"))


def _summed(id_type: pa.DataType):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, n_items, digests = [], [], []
            for starts, ends, items in zip(*(batch.column(c).to_pylist() for c in ("starts", "ends", "items")), strict=True):
                total, to = 0, 0
                for s, e in sorted(zip(starts, ends, strict=True)):
                    total += max(0, e - max(s, to))
                    to = max(to, e)
                names = sorted(set(items))
                n_hit.append(total)
                n_items.append(len(names))
                digests.append(hashlib.sha256(",".join(names).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(id_type), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digests, pa.string()), batch.column("starts"), batch.column("ends"), batch.column("items")],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "starts", "ends", "items"],
            )

    return summed


def _found(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    """Hit runs and items of rows (row, doc_id, text), as _FOUND."""
    spark = rows.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).alias("text"))
    pieces = written(items.mapInArrow(_pieces, "item string, words binary"), "pieces")
    total = pieces.agg(F.sum(F.octet_length("words").cast("long")).alias("n")).first()["n"] or 0
    id_type = rows.schema["doc_id"].dataType.simpleString()
    if total > 8 * BLOCK_WORDS:
        return _joined(rows, pieces, id_type)
    index = spark.sparkContext.broadcast(_Index([(r["item"], bytes(r["words"])) for r in pieces.collect()]))  # BLOCK_WORDS words at most
    return rows.mapInArrow(_scan(index, arrow_type(id_type)), _FOUND.format(id=id_type))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, starts, ends, items.

    starts and ends are the hit runs of words (end exclusive), items the ids, as strings, of the items found there.
    A null text has no words, and so has an empty one; an item without words is never found; a null item id is
    written as 'null'; an item id that occurs on several rows counts once. With no items nothing is hit. Repeated
    documents are separate rows, and other columns are ignored. Texts are worked through whole, in slabs.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, starts array<int>, ends array<int>, items array<string>"
    return _found(rows, benchmark, item_col, item_text_col).drop("row").mapInArrow(_summed(arrow_type(id_type)), schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs.

    Rows are numbered once, in a written table. Null and empty texts have no words and stay; repeated rows stay or go
    together; columns of any name stay; an empty table gives an empty one, and without items all rows stay.
    """
    (number,) = free_names(docs.columns, "__row")
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    found = _found(rows.select(F.col(number).alias("row"), F.lit(0).alias("doc_id"), F.col(text_col).alias("text")), benchmark, item_col, item_text_col)
    hit = written(found.filter(F.size("starts") > 0).select(F.col("row").alias(number)), "hit")
    return rows.join(hit, number, "left_anti").drop(number).select(*(F.col(f"`{c}`") for c in docs.columns))
