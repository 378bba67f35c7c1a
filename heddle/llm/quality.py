"""Quality of documents by how far their characters and common words are from what is usual in their language.

Each document has two histograms: characters by class (capitals, small letters, other letters, digits, white space, marks of
punctuation, all else), and words by which of the language's common words they are (or none). The references of a language
are the same histograms over all its different texts, so that copies don't count more than once. A document fails if the
Jensen-Shannon distance of either histogram from its reference is above a threshold. Short texts differ from any reference
by chance: what a sample of that length is expected to differ by is taken off first, and below a least length nothing is
judged. Nor is it where a language has too little text for a reference.

Common words are those that make up 1/SHARE of a language's words or more, copies counted or not. Each task keeps SHARE * 2
counters for a language and takes the same amount off all of them when they become too many, so a count comes out too small
by n / (2 * SHARE) at most; what could be common by that bound is counted exactly when the texts are read for the features.
At most SHARE words can be common, and LANGUAGES languages have references of their own (the others share one), which
bounds what goes to the driver and to the tasks.

Cases: a null text has no words and fails the base rules; a null language is the language ''; repeated rows are separate
documents; other columns are ignored; an empty table gives an empty one. Ids may have any type.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from heddle.llm.base import parts, written

#: Words and share in percent of repeated ones beyond which the base rules fail.
LEAST_WORDS, REPEATED = 10, 20
#: A common word is one of SHARE words of its language at least; languages with references of their own.
SHARE, LANGUAGES = 500, 256
#: Least code points and words of a text that is judged; least words of the texts that make a reference.
LEAST_CHARS, LEAST_JUDGED, LEAST_REFERENCE = 150, 40, 5000
#: Distances (square roots of divergences in bits) that are too far.
CHARS_FAR, WORDS_FAR = 0.25, 0.27
#: The language of all that have no reference of their own.
OTHERS = "*"
CLASSES = ("upper", "lower", "letter", "digit", "space", "mark", "other")
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\r\x0b\x0c"
_MARKS = ".,;:!?'\"()-"
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def _class_of(c: str) -> int:
    kind = unicodedata.category(c)
    if kind == "Lu":
        return 0
    if kind == "Ll":
        return 1
    if kind[0] == "L":
        return 2
    if kind == "Nd":
        return 3
    return 4 if ord(c) < 128 and c.encode() in _SPACES else 5 if c in _MARKS else 6


_classes: list[np.ndarray] = []


def class_counts(text: str) -> np.ndarray:
    """Code points of a text in each of CLASSES."""
    if not _classes:
        table = np.full(0x110000, 6, np.uint8)
        table[:0x20000] = [_class_of(chr(c)) for c in range(0x20000)]
        table[0x20000:0x32400] = [_class_of(chr(c)) for c in range(0x20000, 0x32400)]
        _classes.append(table)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_classes[0][codes], minlength=len(CLASSES))


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """How many words stand in windows of width words that the text has twice or more."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    key = ids
    for step in range(1, width):  # ranks of windows that grow by a word
        key = np.unique(key[: n - step] * len(known) + ids[step:], return_inverse=True)[1]
    cover = np.zeros(n + 1, np.int64)
    again = np.flatnonzero(np.bincount(key)[key] > 1)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + width, -1)
    return int((np.cumsum(cover) > 0).sum())


def measures(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words of a text, and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars = len(text) - (len(data) - len(data.translate(None, _SPACES)))
    lines = Counter(line for line in data.split(b"\n") if line.strip())
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    return words, (len(words), chars, symbols, lines.total() - len(lines), repeated_words(words))


def _reduced(counts: Counter, keep: int) -> Counter:
    """At most keep counters: the count of the next one is taken off all."""
    if len(counts) <= keep:
        return counts
    values = np.fromiter(counts.values(), np.int64, len(counts))
    off = int(np.partition(values, len(values) - keep - 1)[len(values) - keep - 1])
    return Counter({w: n - off for w, n in counts.items() if n > off})


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n, docs): lower bounds of the counts of frequent words; for the null word all words and texts of the language."""
    counts, totals, docs, keep = {}, Counter(), Counter(), 2 * SHARE
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
            own = counts.setdefault(lang, Counter())
            own.update(words)
            totals[lang] += len(words)
            docs[lang] += 1
            if len(own) > 64 * keep:
                counts[lang] = _reduced(own, keep)
    for lang, own in counts.items():
        rows = [(w.decode("utf-8", "replace"), n) for w, n in _reduced(own, keep).items()] + [(None, totals[lang])]
        cols = [pa.array([lang] * len(rows), pa.string()), pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([0] * (len(rows) - 1) + [docs[lang]], pa.int64())], names=["lang", "word", "n", "docs"])


def candidates(rows: DataFrame) -> dict[str, list[str]]:
    """Sorted words that may be common, for each language of its own and for OTHERS, of rows (lang, text)."""
    found = written(rows.mapInArrow(_frequent, "lang string, word string, n long, docs long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "quality-words")
    totals = found.filter("word is null")
    first = [r["lang"] for r in totals.orderBy(F.desc("docs"), "lang").limit(LANGUAGES).collect()]
    key = F.when(F.col("lang").isin(first), F.col("lang")).otherwise(OTHERS) if totals.offset(LANGUAGES).head(1) else F.col("lang")
    counts = found.groupBy(key.alias("lang"), "word").agg(F.sum("n").alias("n"))
    whole = counts.filter("word is null").select("lang", F.col("n").alias("total"))
    likely = counts.filter("word is not null").join(whole, "lang").filter(F.col("n") * 2 * SHARE >= F.col("total"))
    out: dict[str, list[str]] = {lang: [] for lang in first} | {OTHERS: []}
    for r in likely.select("lang", "word").collect():  # 2 * SHARE words of LANGUAGES + 1 languages at most
        out[r["lang"]].append(r["word"])
    return {lang: sorted(words) for lang, words in out.items()}


def _features(common: dict[str, list[str]]):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {lang: {w.encode(): i for i, w in enumerate(words)} for lang, words in common.items()}
        for batch in parts(batches):
            langs, hashes, figures, classes, at, times = [], [], [], [], [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                words, own = measures(text)
                langs.append(lang if lang in index else OTHERS)
                known = index[langs[-1]]
                found = Counter(known[w] for w in (w.translate(_LOWER) for w in words) if w in known)
                hashes.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                figures.append(own)
                classes.append(class_counts(text))
                at.append(list(found))
                times.append(list(found.values()))
            cols = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(hashes, pa.binary())]
            cols += [pa.array(c, pa.int64()) for c in zip(*figures, strict=True)] or [pa.array([], pa.int64())] * 5
            cols += [pa.array(classes, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", "hash", *_FIGURES, "classes", "at", "times"])

    return features


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def references(features: DataFrame, common: dict[str, list[str]]) -> dict[str, tuple[np.ndarray, dict[int, float], float]]:
    """(shares of the classes, share of each common word, words of the different texts) for each language."""
    texts = features.groupBy("lang", "hash", "n_words").agg(F.count("*").alias("copies"), F.first("classes").alias("classes"), F.first("at").alias("at"), F.first("times").alias("times"))
    texts = written(texts, "quality-texts")
    sums = [F.sum(F.col("classes")[i]).alias(c) for i, c in enumerate(CLASSES)]
    whole = texts.groupBy("lang").agg(F.sum("n_words").alias("words"), F.sum(F.col("n_words") * F.col("copies")).alias("all"), *sums).collect()  # a row a language
    each = texts.select("lang", "copies", F.explode(F.arrays_zip("at", "times")).alias("x")).groupBy("lang", F.col("x.at").alias("at"))
    each = each.agg(F.sum("x.times").alias("n"), F.sum(F.col("x.times") * F.col("copies")).alias("all")).collect()  # a row a candidate
    out, total = {}, {r["lang"]: r for r in whole}
    for r in whole:
        shares = np.array([r[c] for c in CLASSES], float)
        out[r["lang"]] = (shares / max(1.0, shares.sum()), {}, r["words"])
    for r in sorted(each, key=lambda r: r["at"]):
        of = total[r["lang"]]
        if r["n"] * SHARE >= of["words"] and r["all"] * SHARE >= of["all"]:
            out[r["lang"]][1][r["at"]] = r["n"] / of["words"]
    return out


def divergence(p: np.ndarray, q: np.ndarray, n: int) -> float:
    """Jensen-Shannon divergence in bits of two distributions, less what a sample of n from q is expected to have."""
    both = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = [np.where(x > 0, x * np.log2(x / both), 0.0) for x in (p, q)]
    return max(0.0, float(terms[0].sum() + terms[1].sum()) / 2 - (np.count_nonzero(q) - 1) / (8 * math.log(2) * n))


def _judged(known: dict[str, tuple[np.ndarray, dict[int, float], float]], schema: StructType):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {lang: {i: k for k, i in enumerate(words)} for lang, (_, words, _) in known.items()}
        shares = {lang: np.append(list(words.values()), 1 - sum(words.values())) for lang, (_, words, _) in known.items()}
        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            lang, n_words, repeats = (cols[c].to_pylist() for c in ("lang", "n_words", "n_repeat_words"))
            classes, at, times = (cols[c].to_pylist() for c in ("classes", "at", "times"))
            failed, kept, chars, words = [], [], [], []
            for i, n in enumerate(n_words):
                failed.append(n < LEAST_WORDS or 100 * repeats[i] > REPEATED * n)
                usual, _, size = known[lang[i]]
                length, far = sum(classes[i]), False
                chars.append(None)
                words.append(None)
                if size >= LEAST_REFERENCE and length >= LEAST_CHARS:
                    chars[-1] = math.sqrt(divergence(np.array(classes[i]) / length, usual, length))
                    far = chars[-1] > CHARS_FAR
                if size >= LEAST_REFERENCE and n >= LEAST_JUDGED:
                    own, place = np.zeros(len(shares[lang[i]])), places[lang[i]]
                    for k, t in zip(at[i], times[i], strict=True):
                        if k in place:
                            own[place[k]] = t
                    own[-1] = n - own.sum()
                    words[-1] = math.sqrt(divergence(own / n, shares[lang[i]], n))
                    far = far or words[-1] > WORDS_FAR
                kept.append(not failed[-1] and not far)
            out = [cols["doc_id"], *(cols[c] for c in _FIGURES), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(chars, pa.float64()), pa.array(words, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return judge


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    A distance is null where it isn't judged. lang_col: the column of languages; None if all texts are of one.
    """
    lang = F.lit("") if lang_col is None else F.coalesce(F.col(lang_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    common = candidates(rows.select("lang", "text"))
    id_field = StructField("doc_id", docs.schema[id_col].dataType)
    figures = StructType.fromDDL(", ".join(f"{c} long" for c in _FIGURES)).fields
    own = StructType([id_field, *StructType.fromDDL("lang string, hash binary"), *figures, *StructType.fromDDL("classes array<long>, at array<int>, times array<long>")])
    features = written(rows.mapInArrow(_features(common), own), "quality-features")
    known = references(features, common)
    out = StructType([id_field, *figures, *StructType.fromDDL("base_failed boolean, kept boolean, char_distance double, word_distance double")])
    return features.drop("hash").mapInArrow(_judged(known, out), out)
