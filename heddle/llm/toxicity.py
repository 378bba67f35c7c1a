"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word's input is the sum of two hashed word vectors and the mean of the hashed vectors of its character trigrams. The
network reads windows of words that overlap, forwards and backwards, pools the states by attention and gives each
window a score; a text's score is that of its worst window, in training as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from heddle.llm.base import free_names, member, mixed, parts, slabs, words_of

#: Words of a window and from one window's start to the next: what has up to half a window's words is whole in one.
WINDOW, STRIDE = 32, 16
#: Sizes: hashed word and trigram vectors, their length, the states of each direction.
WORDS, CHARS, DIM, HIDDEN = 1 << 18, 1 << 12, 12, 12
#: Documented bound of training: labelled rows of each class, read whole; then its steps and rows in a step.
ROWS_PER_CLASS, STEPS, BATCH = 2000, 240, 48
#: Step size, the trigram vectors' share of it, and the training texts that must hold a word for it to get a vector.
RATE, CHAR_RATE, COMMON = 0.08, 0.1, 3
#: Most times that training goes through the rarer class.
EPOCHS = 100
#: Score from which a text is predicted toxic, and the numbers that hold out a third of all rows.
THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1
#: Windows that one step of the recurrence works on.
_MANY = 2048


def word_inputs(data: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(two word slots, trigram slots in a row, first trigram of each word) of words; the bytes are lower-cased ASCII-wise."""
    raw = np.frombuffer(data, np.uint8)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    at = np.arange(int(lens.sum())) - np.repeat(first - starts, lens)
    b = raw[at].astype(np.uint64) if len(at) else np.zeros(0, np.uint64)
    b += np.where((b >= 0x41) & (b <= 0x5A), 32, 0).astype(np.uint64)
    left, right = np.roll(b, 1), np.roll(b, -1)
    if len(b):
        left[first] = 0
        right[first + lens - 1] = 0
    grams = mixed(left << np.uint64(16) | b << np.uint64(8) | right) % np.uint64(CHARS)
    one = hashes % np.uint64(WORDS)
    two = mixed(hashes) % np.uint64(WORDS)
    return one.astype(np.int64), two.astype(np.int64), grams.astype(np.int64), first


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over n words: each word is in one at least; the last one ends with the text."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.append(np.arange(0, n - WINDOW, STRIDE), n - WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Network:
    """Parameters, forward pass, and gradients by back-propagation through time."""

    def __init__(self, seed: int = 1, dtype=np.float32):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by=1.0: (rng.normal(size=shape) * by).astype(dtype)
        self.p = {"words": np.zeros((WORDS, DIM), dtype), "chars": draw(CHARS, DIM, by=0.3)}
        for d in "fb":
            self.p |= {"W" + d: draw(DIM, 3 * HIDDEN, by=DIM**-0.5), "U" + d: draw(HIDDEN, 3 * HIDDEN, by=HIDDEN**-0.5), "b" + d: np.zeros(3 * HIDDEN, dtype)}
        self.p |= {"A": draw(2 * HIDDEN, HIDDEN, by=(2 * HIDDEN) ** -0.5), "v": draw(HIDDEN), "u": draw(2 * HIDDEN, by=0.5), "c": np.zeros(1, dtype)}

    def embed(self, one: np.ndarray, two: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        p = self.p
        if not len(one):
            return np.zeros((0, DIM), p["c"].dtype)
        size = np.diff(np.append(first, len(grams)))
        return p["words"][one] + p["words"][two] + np.add.reduceat(p["chars"][grams], first, axis=0) / size[:, None].astype(p["c"].dtype)

    def _states(self, xw: np.ndarray, mask: np.ndarray | None, d: str, keep: list | None) -> np.ndarray:
        """States after each word; xw: the inputs' products with W plus b, (n, words, 3 HIDDEN)."""
        u, h, n = self.p["U" + d], np.zeros((len(xw), HIDDEN), xw.dtype), xw.shape[1]
        out = np.empty((n, len(xw), HIDDEN), xw.dtype)
        for t in range(n) if d == "f" else range(n - 1, -1, -1):
            x, hu = xw[:, t], h @ u
            gates = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            to = new + z * (h - new)
            if mask is not None:
                to = np.where(mask[:, t, None], to, h)
            if keep is not None:
                keep.append((t, h, hu[:, 2 * HIDDEN :], z, r, new))
            out[t] = h = to
        return out

    def _pooled(self, states: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, ...]:
        e = np.tanh(states @ self.p["A"])
        s = e @ self.p["v"]
        if mask is not None:
            s = np.where(mask.T, s, -1e9)
        w = np.exp(s - s.max(0))
        if mask is not None:
            w = w * mask.T
        w = w / np.maximum(w.sum(0), 1e-9)
        return e, w, np.einsum("tn,tnh->nh", w, states)

    def logits(self, xwf: np.ndarray, xwb: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        states = np.concatenate([self._states(xwf, mask, "f", None), self._states(xwb, mask, "b", None)], axis=2)
        return self._pooled(states, mask)[2] @ self.p["u"] + self.p["c"][0]

    def inputs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x @ self.p["Wf"] + self.p["bf"], x @ self.p["Wb"] + self.p["bb"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, want: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean log loss over windows x (n, words, DIM): of the parameters, of x; and the loss."""
        p, g = self.p, {}
        keep = {"f": [], "b": []}
        xw = dict(zip("fb", self.inputs(x), strict=True))
        states = np.concatenate([self._states(xw[d], mask, d, keep[d]) for d in "fb"], axis=2)
        e, w, pooled = self._pooled(states, mask)
        y = _sigmoid(pooled @ p["u"] + p["c"][0])
        loss = -float(np.mean(np.log(np.where(want > 0, y, 1 - y) + 1e-9)))
        dl = ((y - want) / len(x)).astype(x.dtype)
        g["c"], g["u"] = dl.sum(keepdims=True), dl @ pooled
        dp = dl[:, None] * p["u"]
        dw = np.einsum("nh,tnh->tn", dp, states)
        ds = w * (dw - (w * dw).sum(0))
        ds_e = ds[:, :, None] * p["v"] * (1 - e * e)
        g["v"] = np.einsum("tn,tnh->h", ds, e)
        g["A"] = np.einsum("tni,tnj->ij", states, ds_e)
        dstates = w[:, :, None] * dp + ds_e @ p["A"].T
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            u, dh = p["U" + d], np.zeros((len(x), HIDDEN), x.dtype)
            gu, gw, gb = np.zeros_like(u), np.zeros_like(p["W" + d]), np.zeros_like(p["b" + d])
            for t, h, hn, z, r, new in reversed(keep[d]):
                dh = dh + dstates[t][:, k * HIDDEN : (k + 1) * HIDDEN]
                m = mask[:, t, None]
                dto, skip = dh * m, dh * ~m
                dn = dto * (1 - z) * (1 - new * new)
                dz = dto * (h - new) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                dx_t = np.concatenate([dz, dr, dn], axis=1)
                dhu = np.concatenate([dz, dr, dn * r], axis=1)
                gu += h.T @ dhu
                gw += x[:, t].T @ dx_t
                gb += dx_t.sum(0)
                dx[:, t] += dx_t @ p["W" + d].T
                dh = dto * z + dhu @ u.T + skip
            g["U" + d], g["W" + d], g["b" + d] = gu, gw, gb
        return g, dx, loss


class _Example:
    """A training text: its words' slots, and which words stand in its windows."""

    def __init__(self, text: bytes):
        self.hashes, s, e = words_of(text)
        self.slots = word_inputs(text, s, e, self.hashes)
        at = windows_of(len(s))[:, None] + np.arange(WINDOW)[None, :]
        self.mask = at < len(s)
        self.at = np.where(self.mask, at, len(s))

    def inputs(self, net: Network, prior: np.ndarray) -> np.ndarray:
        """Inputs of the words and of the place behind them; prior: what to add to each word's input."""
        return np.concatenate([net.embed(*self.slots) + prior, np.zeros((1, DIM), np.float32)])


def _log_odds(toxic: np.ndarray, clean: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """How much oftener toxic than clean texts hold words, smoothed, as a logarithm."""
    return np.log((np.maximum(toxic, 0) + 0.5) / (n[1] + 1)) - np.log((np.maximum(clean, 0) + 0.5) / (n[0] + 1))


def _add_rows(param: np.ndarray, square: np.ndarray, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
    """An Adagrad step for the rows of a table that have gradients."""
    if not len(rows):
        return
    order = np.argsort(rows, kind="stable")
    own, first = np.unique(rows[order], return_index=True)
    g = np.add.reduceat(grads[order], first, axis=0)
    square[own] += g * g
    param[own] -= (rate * g / (np.sqrt(square[own]) + 1e-6)).astype(param.dtype)


def train(texts: list[bytes], labels: list[int], seed: int = 1) -> Network:
    """A network fitted to labelled texts: in each step as many of either class, each by its worst window of all as the network then is.

    Words that fewer than COMMON of the texts hold keep a zero vector: they would only tell single texts apart. The
    others start from their log odds along a fixed direction; while training, a text's own count is left out of them.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    by = [np.flatnonzero(np.array(labels) == c) for c in (0, 1)]
    if not len(by[0]) or not len(by[1]):
        net.p["u"][:] = 0
        net.p["c"][:] = 0 if not len(labels) else (-3 if len(by[0]) else 3)
        return net
    distinct = [np.unique(words_of(t)[0]) for t in texts]
    seen, counts = np.unique(np.concatenate(distinct), return_counts=True)
    common = seen[counts >= COMMON]
    held = np.zeros((2, len(common)), np.int64)
    for label, own in zip(labels, distinct, strict=True):
        known, at = member(own, common)
        held[label, at[known]] += 1
    n = (len(by[0]), len(by[1]))
    odds = [_log_odds(held[1], held[0] - 1, n), _log_odds(held[1] - 1, held[0], n)]
    along = (rng.normal(size=DIM) * DIM**-0.5).astype(np.float32)
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = min(STEPS, -(-EPOCHS * min(n) * 2 // BATCH))
    for step in range(steps):
        rows = np.concatenate([rng.choice(c, BATCH // 2) for c in by])
        drawn, known, x = [_Example(texts[i]) for i in rows], [], []  # made anew, as the slots of all texts take much more than the texts
        for i, p in zip(rows, drawn, strict=True):
            own, at = member(p.hashes, common)
            known.append(own)
            x.append(p.inputs(net, (np.where(own, odds[labels[i]][at] if len(common) else 0, 0)[:, None] * along).astype(np.float32)))
        base = np.cumsum([0, *(len(y) for y in x[:-1])])
        x, mask, at = np.concatenate(x), np.concatenate([p.mask for p in drawn]), np.concatenate([p.at + b for b, p in zip(base, drawn, strict=True)])
        xw = net.inputs(x)
        score = np.concatenate([net.logits(*(y[at[a : a + _MANY]] for y in xw), mask[a : a + _MANY]) for a in range(0, len(at), _MANY)])
        edge = np.concatenate(([0], np.cumsum([len(p.at) for p in drawn])))
        worst = np.array([a + int(score[a:b].argmax()) for a, b in zip(edge, edge[1:], strict=False)])
        want = np.array([labels[i] for i in rows], np.float32)
        g, dx, _ = net.gradients(x[at[worst]], mask[worst], want)
        rate = RATE * (1 - 0.8 * step / steps)
        word_rows, word_grads, char_rows, char_grads = [], [], [], []
        for j, p in enumerate(drawn):
            at = p.at[worst[j] - edge[j]][p.mask[worst[j] - edge[j]]]
            one, two, grams, first = p.slots
            d = dx[j][: len(at)]
            own = known[j][at] if len(at) else np.zeros(0, bool)
            word_rows += [one[at][own], two[at][own]]
            word_grads += [d[own], d[own]]
            size = np.diff(np.append(first, len(grams)))[at]
            place = np.repeat(first[at] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            char_rows.append(grams[place])
            char_grads.append(np.repeat(d / size[:, None].astype(np.float32), size, axis=0))
        _add_rows(net.p["words"], square["words"], np.concatenate(word_rows), np.concatenate(word_grads), rate)
        _add_rows(net.p["chars"], square["chars"], np.concatenate(char_rows), np.concatenate(char_grads), rate * CHAR_RATE)
        for k, v in g.items():
            square[k] += v * v
            net.p[k] -= (rate * v / (np.sqrt(square[k]) + 1e-6)).astype(np.float32)
    half = (_log_odds(held[1], held[0], n)[:, None] * along / 2).astype(np.float32)
    for slot in (common % np.uint64(WORDS), mixed(common) % np.uint64(WORDS)):
        np.add.at(net.p["words"], slot.astype(np.int64), half)
    return net


def scores(net: Network, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Score of each text and first word of its worst window; all windows of all texts are read."""
    out, where = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for first, last, data, offsets in slabs(texts):
        h, s, e = words_of(data)
        edge = np.searchsorted(s, offsets)
        distinct, one, word = np.unique(h, return_index=True, return_inverse=True)
        x = net.embed(*word_inputs(data, s[one], e[one], distinct))
        x = np.concatenate([x, np.zeros((1, DIM), np.float32)])
        xw = net.inputs(x)
        word = np.append(word, len(distinct))
        owner, starts = [], []
        for d in range(last - first):
            w = windows_of(int(edge[d + 1] - edge[d]))
            owner.append(np.full(len(w), d))
            starts.append(w + edge[d])
        owner, starts = np.concatenate(owner), np.concatenate(starts)
        logit = np.empty(len(starts), np.float32)
        short = starts + WINDOW > edge[1:][owner]
        for group in (np.flatnonzero(short), np.flatnonzero(~short)):
            for a in range(0, len(group), _MANY):
                own = group[a : a + _MANY]
                at = starts[own][:, None] + np.arange(WINDOW)[None, :]
                mask = at < edge[1:][owner[own]][:, None]
                index = word[np.where(mask, at, len(h))]
                logit[own] = net.logits(xw[0][index], xw[1][index], None if mask.all() else mask)
        cut = np.searchsorted(owner, np.arange(last - first))
        top = np.maximum.reduceat(logit, cut)
        out[first:last] = _sigmoid(top.astype(np.float64))
        best = np.flatnonzero(logit == top[owner])
        docs, place = np.unique(owner[best], return_index=True)
        where[first:last][docs] = starts[best[place]] - edge[:-1][docs]
    return out, where


def held_out(id_: Column) -> Column:
    """Whether a row is held out: a third of all rows by the checksum of the id."""
    return F.coalesce(F.crc32(id_.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 1) -> Network:
    """A network fitted to at most ROWS_PER_CLASS labelled rows of either class, none of them held out.

    Labels are drawn by a hash of the id, and where the drawn ids have more distinct rows, those by a hash of the row. An id
    that is labelled both 0 and 1 is left out.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    own = own.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return train([], [])
    share = F.coalesce(*(F.when(F.col("label") == c, min(1.0, ROWS_PER_CLASS / n)) for c, n in counts.items()))
    own = own.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).join(F.broadcast(own), "id").select(F.col("id").cast("string"), F.col("label").cast("int"), "text").distinct()
    # an id may have many rows: at most ROWS_PER_CLASS of each class come to the driver, with their whole texts
    drawn = [rows.filter(F.col("label") == c).orderBy(F.xxhash64("id", "text", F.lit(seed)), "id", "text").limit(ROWS_PER_CLASS) for c in (0, 1)]
    rows = drawn[0].unionAll(drawn[1]).collect()
    rows = sorted({(r["id"], r["label"], bytes(r["text"])) for r in rows})
    return train([r[2] for r in rows], [r[1] for r in rows], seed)


def _scored(net, columns: list[str], text: str, own: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            score, where = scores(net.value, batch.column(text).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(score), pa.array(where)], names=[*columns, *own])

    return work


def _with_scores(docs: DataFrame, net: Network, text_col: str) -> tuple[DataFrame, str, str]:
    """docs with the score and the worst window's first word, and the names of these two columns."""
    text, score, worst = free_names(docs.columns, "__text", "__score", "__worst")
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType()), StructField(worst, LongType())])
    rows = docs.withColumn(text, F.col(text_col))
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(net), docs.columns, text, [score, worst]), schema), score, worst


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, worst_word.

    score is between 0 and 1, predicted is 1 from THRESHOLD on, worst_word the first word of the worst window. Null
    and empty texts are scored as a window without words. A null id counts as not held out. Labels other than 0 and 1
    are left out, and so are ids labelled both; without labels of both classes every text gets the same score. Repeated
    rows are separate rows; other columns are ignored; an empty table gives no rows.
    """
    net = fit(docs, labels, id_col, text_col)
    out, score, worst = _with_scores(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), net, "text")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col(score).alias("score"), (F.col(score) >= THRESHOLD).cast("int").alias("predicted"), F.col(worst).alias("worst_word"))


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose score is below THRESHOLD.

    Null and empty texts are scored as a window without words; repeated rows stay or go together; columns of any name
    stay; an empty table gives an empty one. Without labels of both classes all rows get one score.
    """
    out, score, _ = _with_scores(docs, fit(docs, labels, id_col, text_col), text_col)
    return out.filter(F.col(score) < THRESHOLD).select(*(F.col(f"`{c}`") for c in docs.columns))
