"""Removal of repeated passages by suffix arrays in a logarithmic family of levels.

A passage is LENGTH bytes that also start in a document with a smaller id. Every window of LENGTH bytes has one anchor,
its least K-gram hash, at a place that the window's bytes alone decide. So equal windows meet where their anchors meet:
 1. anchor hashes meet across documents, and those that only one id has are dropped;
 2. the windows around the others meet by anchor. They are the suffixes, cut at LENGTH bytes, that could match. Batches
    of them, in the order of ids, get sorted (a suffix array), are scanned against the levels so far (all of smaller
    ids) and become a level; levels of like size merge;
 3. each document gets its matches back.
Documents travel in batches cut by running bytes. Within a batch equal anchors and equal runs of windows are counted
once, and where batches meet equal runs once more, so copies don't pile up in one task; windows around anchors that many
batches share (HOT) go out one by one, by a hash of their own bytes, so a common anchor doesn't either. Partitions grow
in number with the bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.base import member, mixed, powers, whole_ids, written

#: Bytes of a passage and of an anchor's K-gram (a power of two).
LENGTH, K = 50, 16
#: Bytes from which a batch of documents is full and most rows of it; suffixes of one batch of the index; bytes of
#: documents for each partition; batches from which on an anchor is hot.
BATCH_BYTES, BATCH_ROWS, SUFFIXES, PARTITION_BYTES, HOT = 4 << 20, 4096, 1 << 15, 16 << 20, 4096
#: Bytes that are looked at for anchors at a time (less than 1 << 28), few enough for a processor's cache.
_PIECE = 1 << 16
_PLACES = LENGTH - K + 1
_LOW = np.uint64((1 << 28) - 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


def runs_of(data: np.ndarray, owner_end: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, anchor, hash) of the runs of windows with one anchor; owner_end has each byte's end of document."""
    none = np.zeros(0, np.int64)
    n = len(data) - LENGTH + 1
    if n <= 0:
        return none, none, none, np.zeros(0, np.uint64)
    g, size = _BYTES[data], 1
    while size < K:
        by = powers(size + 1)[-1]
        g, size = g[:-size] * by + g[size:], 2 * size
    g = mixed(g)
    least, size = (g & ~_LOW) | (_LOW - np.arange(len(g), dtype=np.uint64)), 1  # equal hashes: the later place is less
    while 2 * size <= _PLACES:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[:n], least[_PLACES - size : _PLACES - size + n])
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = np.arange(LENGTH, n + LENGTH) <= owner_end[:n]
    step = np.ones(n + 1, bool)
    step[1:-1] = least[1:] != least[:-1]
    first = np.flatnonzero(inside[1:-1] & (step[:-1] | ~inside[:-2]))
    last = np.flatnonzero(inside[1:-1] & (step[1:] | ~inside[2:]))
    anchor = (_LOW - (least[first] & _LOW)).astype(np.int64)
    return first, last - first + 1, anchor, g[anchor]


class _Texts:
    """Texts with ids, laid end to end, and their runs."""

    def __init__(self, texts: list[bytes | None], ids: list[int | None]):
        self.texts = texts
        use = [i for i, (t, d) in enumerate(zip(texts, ids, strict=True)) if d is not None and t and len(t) >= LENGTH]
        size = np.array([len(texts[i]) for i in use], np.int64)
        self.edge = np.concatenate(([0], np.cumsum(size)))
        self.which = np.array(use, np.int64)
        self.data = np.frombuffer(b"".join(texts[i] for i in use), np.uint8)
        parts = []
        for lo in range(0, len(self.data), _PIECE):  # windows that start in a piece, for small temporaries
            hi = min(len(self.data), lo + _PIECE + LENGTH - 1)
            a, b = np.searchsorted(self.edge, lo, "right") - 1, np.searchsorted(self.edge, hi)
            end = np.repeat(self.edge[a + 1 : b + 1] - lo, np.diff(self.edge[a : b + 1].clip(lo, hi)))
            s, n, p, h = runs_of(self.data[lo:hi], end)
            parts.append((s + lo, n, p + lo, h))
        none = np.zeros(0, np.int64)
        self.start, self.count, self.anchor, self.hash = (np.concatenate([*x, none.astype(t)]) for x, t in zip(zip(*parts, strict=True) if parts else [[]] * 4, (np.int64, np.int64, np.int64, np.uint64), strict=True))
        self.doc = np.searchsorted(self.edge, self.start, "right") - 1
        self.id = np.array([ids[i] for i in use], np.int64)[self.doc] if use else none


def _pressed(*columns: np.ndarray) -> bytes:
    """Arrays one after the other, compressed, behind their size."""
    raw = b"".join(c.tobytes() for c in columns)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpressed(packed: bytes, at: int = 0) -> bytes:
    return pa.decompress(packed[at + 8 :], int.from_bytes(packed[at : at + 8], "little"), codec="zstd", asbytes=True)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _grouped(key: np.ndarray) -> np.ndarray:
    """An order by key that keeps the order within a key."""
    return np.argsort(key.astype(np.uint16) if len(key) and 0 <= key.min() and key.max() < 1 << 16 else key, kind="stable")  # 16 bits: by radix


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.zeros(0, np.int64)


def _repeated(h: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """Which of the values are there under more than one id."""
    out = np.zeros(len(h), bool)
    if len(h):
        order = np.argsort(h)
        first, own = _starts(h[order]), id_[order]
        more = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
        out[order] = np.repeat(more, np.diff(np.append(first, len(h))))
    return out


def _eights(data: np.ndarray, at: np.ndarray, n: int = 1) -> np.ndarray:
    """n numbers of the 8 * n bytes at each of these places."""
    return np.ndarray(len(data) - 8 * n + 1, f"V{8 * n}", data, strides=(1,))[at].view("<u8").reshape(len(at), n)


def _firsts(data: np.ndarray, begin: np.ndarray, size: np.ndarray, place: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """Runs of windows without those whose bytes and place of the anchor a run of a smaller id surely has."""
    first = np.ones(len(begin), bool)
    if len(begin):
        like = (place * 2 * LENGTH + size).astype(np.uint64)
        for at in (begin, begin + place, begin + size - 8):
            like = mixed(like ^ _eights(data, at)[:, 0])
        own = np.flatnonzero(_repeated(like, id_))
        own = own[np.lexsort((id_[own], like[own]))]
        start = _starts(like[own])
        least = np.repeat(own[start], np.diff(np.append(start, len(own))))
        same = (id_[own] > id_[least]) & (size[own] == size[least]) & (place[own] == place[least])
        own, least = own[same], least[same]
        same = np.ones(len(own), bool)
        for k in range(0, LENGTH + _PLACES, 8):
            at = np.minimum(k, size[own] - 8)
            same &= (_eights(data, begin[own] + at) == _eights(data, begin[least] + at))[:, 0]
        first[own[same]] = False
    return first


def _slices(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    cut = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else []
    for a, b in zip(cut, [*cut[1:], len(key)][: len(cut)], strict=True):
        yield int(key[a]), slice(int(a), int(b))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with a number and its batch: a batch ends where its bytes or rows are full, so a long text makes no batch of many."""
    base = TaskContext.get().partitionId() << 33
    row, number, held, rows = base, base, 0, 0
    for batch in batches:
        numbers = []
        for n in pc.binary_length(batch.column("text").cast(pa.binary())).to_pylist():
            n = n or 0
            if rows and (held + n > BATCH_BYTES or rows >= BATCH_ROWS):
                number, held, rows = number + 1, 0, 0
            held, rows = held + n, rows + 1
            numbers.append(number)
        own = pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64))
        row += batch.num_rows
        yield pa.RecordBatch.from_arrays([own, pa.array(numbers, pa.int64()), batch.column("doc_id"), batch.column("text")], names=["row", "batch", "doc_id", "text"])


def _anchors(buckets: int):
    """Of each batch of documents its distinct anchor hashes with the least and largest id, packed by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            out = ([], [], [])
            for b, own in _slices(batch.column("batch").to_numpy(zero_copy_only=False)):
                t = _Texts(texts[own], ids[own])
                order = np.argsort(t.hash)
                h, i = t.hash[order], t.id[order]
                first = _starts(h)
                h, lo, hi = h[first], np.minimum.reduceat(i, first) if len(first) else i, np.maximum.reduceat(i, first) if len(first) else i
                key = _bucket(h, buckets)
                order = _grouped(key)
                h, lo, hi, key = h[order], lo[order], hi[order], key[order]
                for k, part in _slices(key):
                    out[0].append(k)
                    out[1].append(b)
                    out[2].append(_pressed(h[part], lo[part], hi[part] - lo[part]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["bucket", "batch", "packed"])

    return work


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to each batch of documents: those of its anchor hashes that more than one id has, and which of them are hot."""
    own, packed = [], []
    for batch in batches:
        own += batch.column("batch").to_pylist()
        packed += batch.column("packed").to_pylist()
    parts = [np.frombuffer(_unpressed(p), np.uint64).reshape(3, -1) for p in packed]
    if not parts:
        return
    h, lo, hi = (np.concatenate([p[k] for p in parts]) for k in range(3))
    lo, hi = lo.view(np.int64), (lo + hi).view(np.int64)
    order = np.argsort(h)
    first = _starts(h[order])
    more = np.minimum.reduceat(lo[order], first) < np.maximum.reduceat(hi[order], first)
    keep = np.zeros(len(h), bool)
    times = np.diff(np.append(first, len(h)))
    keep[order] = np.repeat(more, times)
    hot = np.zeros(len(h), bool)
    hot[order] = np.repeat(times >= HOT, times)
    at = np.repeat(np.array(own), [p.shape[1] for p in parts])[keep]
    h, hot = h[keep], hot[keep]
    order = np.argsort(at, kind="stable")
    at, h, hot = at[order], h[order], hot[order]
    found = [(b, h[part].tobytes(), h[part][hot[part]].tobytes()) for b, part in _slices(at)]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), *(pa.array([x[k] for x in found], pa.binary()) for k in (1, 2))], names=["batch", "hashes", "hot"])


#: One run of windows as it travels: id, row, place in the text, windows, anchor less start.
_RUN = np.dtype([("id", "<i8"), ("row", "<i8"), ("start", "<i4"), ("count", "<i2"), ("anchor", "<i2")])
_HIT = np.dtype([("row", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)
    return data[at]


def _windows(buckets: int):
    """Of a batch of documents the runs of windows at shared anchors, packed by bucket; runs that a smaller id of the batch has too are matches at once."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            texts, ids, rows = left.column("text").cast(pa.binary()).to_pylist(), left.column("doc_id").to_pylist(), left.column("row").to_numpy()
            b = left.column("batch")[0].as_py()
            t = _Texts(texts, ids)
            wanted, hot = (np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in right.column(c).to_pylist()])) for c in ("hashes", "hot"))
            own = np.flatnonzero(member(t.hash, wanted)[0])
            many = member(t.hash[own], hot)[0]
            times = np.where(many, t.count[own], 1)  # runs at hot anchors become single windows
            own, many = np.repeat(own, times), np.repeat(many, times)
            step = np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
            begin, count = t.start[own] + step, np.where(many, 1, t.count[own])
            run = np.zeros(len(own), _RUN)
            doc = t.doc[own]
            run["id"], run["row"] = t.id[own], rows[t.which[doc]] if len(own) else 0
            run["start"], run["count"], run["anchor"] = begin - t.edge[doc], count, t.anchor[own] - begin
            size = count + LENGTH - 1
            first = _firsts(t.data, begin, size, t.anchor[own] - begin, t.id[own])  # the least id of equal runs goes on
            again = np.zeros(int((~first).sum()), _HIT)
            again["row"], again["start"], again["end"] = run["row"][~first], run["start"][~first], run["start"][~first] + size[~first]
            if len(again):
                out[0].append(b % buckets)
                out[1].append(b)
                out[2].append(b"\0" + again.tobytes())
            go = np.flatnonzero(first)
            meet = t.hash[own]
            for at in range(0, len(meet), _PIECE):
                i = at + np.flatnonzero(many[at : at + _PIECE])
                window = t.data[begin[i][:, None] + np.arange(LENGTH)[None, :]].astype(np.uint64) + np.uint64(1)
                meet[i] = mixed((window * powers(LENGTH)).sum(1, dtype=np.uint64))
            key = _bucket(meet, buckets)
            go = go[_grouped(key[go])]
            for k, part in _slices(key[go]):
                i = go[part]
                out[0].append(k)
                out[1].append(b)
                columns = [np.ascontiguousarray(run[c][i]) for c in _RUN.names]
                out[2].append(b"\1" + _pressed(np.int64(len(i)), *columns, _gathered(t.data, begin[i], size[i])))
        return pa.table({"bucket": pa.array(out[0], pa.int32()), "batch": pa.array(out[1], pa.int64()), "packed": pa.array(out[2], pa.binary())})

    return work


class SuffixIndex:
    """Levels of sorted suffixes (their first LENGTH bytes); each new batch is scanned against them, becomes a level, and is merged with levels of its size."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def add(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the sorted, distinct suffixes earlier batches have; then the new ones become a level."""
        found = np.zeros(len(suffixes), bool)
        for level in self.levels:
            found |= _merge_scanned(level, suffixes)
        new = suffixes[~found]
        if len(new):
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            a, b = self.levels.pop(), self.levels.pop()
            both = np.concatenate([b, a])
            both.sort(kind="stable")  # merges the two sorted runs
            self.levels.append(both)
        return found


def _merge_scanned(level: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Which suffixes the level has: both are sorted and distinct, so in their merge a suffix stands right behind its equal."""
    both = np.concatenate([level, suffixes])
    order = np.argsort(both, kind="stable")  # merges the two sorted runs, the level's first among equals
    both = both[order]
    again = order[1:][both[1:] == both[:-1]]
    found = np.zeros(len(suffixes), bool)
    found[again - len(level)] = True
    return found


def _matched(data: np.ndarray, at: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """Which of the suffixes at these places of data also belong to a smaller id.

    Equal suffixes have equal sums of their bytes, so only those whose sum more than one id has get sorted and scanned.
    """
    hit, index = np.zeros(len(at), bool), SuffixIndex()
    total = np.zeros(len(at), np.uint64)
    for a in range(0, len(at), _PIECE):
        own = at[a : a + _PIECE]
        h = _eights(data, own + LENGTH - 8)[:, 0]
        for part in _eights(data, own, LENGTH // 8).T:
            h = (h ^ (h >> np.uint64(29))) * _MIX + part
        total[a : a + _PIECE] = mixed(h)
    order = np.flatnonzero(_repeated(total, id_))
    order = order[np.argsort(id_[order], kind="stable")]
    ordered, suffixes = id_[order], np.ndarray(max(0, len(data) - LENGTH + 1), f"S{LENGTH}", data, strides=(1,))
    a = 0
    while a < len(order):
        b = min(len(order), a + SUFFIXES)
        b = int(np.searchsorted(ordered, ordered[b - 1], "right"))  # all of an id in one batch
        own = order[a:b]
        text = suffixes[at[own]]
        array = np.lexsort((id_[own], text))
        text, ids = text[array], id_[own][array]
        first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
        group = np.cumsum(np.concatenate(([False], text[1:] != text[:-1])))
        hit[own[array]] = index.add(text[first])[group] | (ids > ids[first][group])
        a = b
    return hit


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Back to each batch of documents: the matches in its rows."""
    runs, raw, where, out = [], [], [], []
    for batch in batches:
        for b, p in zip(batch.column("batch").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if p[0] == 0:
                out.append((b, p[1:]))
                continue
            p = _unpressed(p, 1)
            n, at = int.from_bytes(p[:8], "little"), 8
            run = np.zeros(n, _RUN)
            for c in _RUN.names:
                run[c] = np.frombuffer(p, _RUN[c], n, at)
                at += n * _RUN[c].itemsize
            runs.append(run)
            raw.append(p[at:])
            where.append(np.full(n, b))
    if runs:
        run, data, where = np.concatenate(runs), np.frombuffer(b"".join(raw), np.uint8), np.concatenate(where)
        size, most, ids = run["count"].astype(np.int64) + LENGTH - 1, run["anchor"].astype(np.int64), run["id"].copy()
        base = np.cumsum(size) - size
        go = _firsts(data, base, size, most, ids)
        again = np.flatnonzero(~go)
        less = np.where(go, most - run["count"], most)  # runs that others have need no look at their windows
        hits = []
        for place in range(_PLACES):  # windows with different places of the anchor differ
            i = np.flatnonzero((most >= place) & (less < place))
            if len(i):
                shift = most[i] - place
                h = _matched(data, base[i] + shift, ids[i])
                hits.append(np.stack([i[h], run["start"][i][h] + shift[h]]))
        which, start = np.concatenate(hits, axis=1) if hits else (np.zeros(0, np.int64),) * 2
        order = np.lexsort((start, which))
        which, start = which[order], start[order]
        first = np.flatnonzero((np.diff(which, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        last = np.append(first[1:], len(which)) - 1 if len(first) else first
        hit = np.zeros(len(first) + len(again), _HIT)
        of = np.concatenate((which[first], again))
        hit["row"] = run["row"][of]
        hit["start"], hit["end"] = np.concatenate((start[first], run["start"][again])), np.concatenate((start[last] + LENGTH, (run["start"] + size)[again]))
        at = where[of]
        order = np.argsort(at, kind="stable")
        out += [(b, hit[order[part]].tobytes()) for b, part in _slices(at[order])]
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["batch", "hits"])


def _removed(left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents without the matched bytes, as digests and spans."""
    ids, rows = left.column("doc_id"), left.column("row").to_numpy()
    texts = left.column("text").cast(pa.binary()).to_pylist()
    hits = np.concatenate([np.frombuffer(x, _HIT) for x in right.column("hits").to_pylist()] or [np.zeros(0, _HIT)])
    hits = hits[np.lexsort((hits["start"], hits["row"]))]
    n_bytes, n_removed, digests, starts, ends = [], [], [], [], []
    at = hits["row"].copy()
    for text, low, high in zip(texts, np.searchsorted(at, rows), np.searchsorted(at, rows, "right"), strict=True):
        text = text or b""
        own = hits[low:high]
        s, e = own["start"].astype(np.int64), np.maximum.accumulate(own["end"].astype(np.int64))
        cut = np.flatnonzero(s[1:] > e[:-1]) + 1
        s, e = s[np.concatenate(([0], cut))] if len(s) else s, e[np.append(cut - 1, len(e) - 1)] if len(e) else e
        kept, at = hashlib.sha256(), 0
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            kept.update(text[at:a])
            at = b
        kept.update(text[at:])
        n_bytes.append(len(text))
        n_removed.append(int((e - s).sum()))
        digests.append(kept.hexdigest())
        starts.append(s)
        ends.append(e)
    longs = pa.list_(pa.int64())
    return pa.table(
        {"doc_id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array([len(s) for s in starts], pa.int64()),
         "kept_sha256": pa.array(digests, pa.string()), "starts": pa.array(starts, longs), "ends": pa.array(ends, longs)}
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans (starts, ends).

    Texts count as UTF-8 bytes; a byte goes if LENGTH bytes around it also start in a document with a smaller id, as
    the texts came in. A null text counts as empty. Rows with a null id are left whole and take nothing from others.
    Rows with equal ids take nothing from each other. Ids are whole numbers, others are refused. Other columns are ignored; an empty table gives no rows. Rows are
    numbered once, in a written table: a scan that is planned again may be cut into other partitions and would number
    them otherwise.
    """
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(rows.mapInArrow(_numbered, "row long, batch long, doc_id long, text string"), "docs")
    total = rows.agg(F.sum(F.octet_length("text").cast("long")).alias("bytes")).first()["bytes"] or 0
    partitions = max(1, -(-total // PARTITION_BYTES))
    buckets = 4 * partitions
    packed = "bucket int, batch long, packed binary"
    anchors = rows.mapInArrow(_anchors(buckets), packed).repartition(partitions, "bucket")
    shared = written(anchors.mapInArrow(_shared, "batch long, hashes binary, hot binary"), "anchors")
    by_batch = rows.repartition(partitions, "batch").groupBy("batch")
    windows = by_batch.cogroup(shared.repartition(partitions, "batch").groupBy("batch")).applyInArrow(_windows(buckets), packed).repartition(partitions, "bucket")
    hits = windows.mapInArrow(_matches, "batch long, hits binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>"
    return by_batch.cogroup(hits.repartition(partitions, "batch").groupBy("batch")).applyInArrow(_removed, schema)
