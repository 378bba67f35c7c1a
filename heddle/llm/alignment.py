"""How the tokens of two tokenizers lie over one another, in each text and over the whole corpus.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece model. Neither joins anything across the start of
white space behind other characters (but for white space that tokens of B have there), so a text falls into segments, white
space and what follows up to the next of it, that both encode on their own, and groups and links never leave a segment. Texts
go once into a written table of blocks of documents; a block holds its different segments, encoded once, and the sequence of
them for each document.

All work on a block's segments is on token ends at once: cumulative sums give the ends, those that both have cut the segments
into groups, binary searches label tokens with groups and find the tokens that overlap, repeats spell out the links.

A pair's corpus-wide count comes from the different pairs of each block, summed by pair and salt and then by pair. The counts
go back to the blocks that hold the pair, so that what is shuffled are a block's different pairs and never its links.

Cases: texts that are null, empty, or that either tokenizer doesn't give back byte for byte have no tokens; repeated rows and
repeated or null ids are separate documents; very long texts are sequences of segments like others; other columns are ignored
whatever their names; an empty table gives an empty one. Ids may have any type.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from heddle.llm.base import written
from heddle.llm.bpe import _byte_chars

#: Code points of text in a block.
BLOCK = 6_000_000
#: Segments that the libraries encode in one call.
_BATCH = 500
#: Salts of the first sum of a pair's counts.
SALTS = 16
#: Bits of a B id in the key of a pair.
_B_BITS = 16
# The characters with the property White_Space.
_RARE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE = "\t-\r " + _RARE
#: How byte-level tokenizers split text, and the character from which on libraries may hold different views on what is a letter.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SETTLED = "\u0500"
_rare = re.compile(f"[{_RARE}]").search
_space = re.compile(f"[{_SPACE}]").match


class Pair:
    """Both tokenizers, with the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte = {c: i for i, c in enumerate(_byte_chars())}
        spelled = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in spelled]
        self._ranked = self._by_rank(path_a)
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(self.bytes_a) > 1 << 16 or len(self.bytes_b) > 1 << _B_BITS:
            raise ValueError("vocabularies of up to 65,536 tokens are supported")
        # white space that pieces have behind other characters joins segments; a line feed in a piece would spoil what B is asked
        known = [p.replace("▁", " ") for i, p in enumerate(pieces) if not self.b.is_byte(i) and len(p) > 1]
        joins = re.escape("".join(sorted({c for p in known for d, c in zip(p, p[1:], strict=False) if _space(c) and not _space(d)})))
        more = f"(?:[{joins}][{_SPACE}]*[^{_SPACE}]*)*" if joins else ""
        self._cut = re.compile(f"[{_SPACE}]*[^{_SPACE}]+{more}|[{_SPACE}]+").findall
        self._cut_plain = re.compile(self._cut.__self__.pattern.replace(_RARE, "")).findall  # much faster, and the same where there is no rare white space
        self.cuttable = not any("\n" in p for p in known)
        self.len_a, self.len_b = (np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b))
        self._lead = self.b.encode("\n")  # the space that B adds and the line feed

    def _by_rank(self, path: str):
        """What encodes as A does but much faster, if A splits as byte-level tokenizers do and its merges are in order of the tokens they make; else None."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain = plain and not spec["normalizer"] and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        made = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
        special, merged = {t["content"] for t in spec["added_tokens"]}, set(made)
        single = all(len(t) == 1 for t, i in model["vocab"].items() if i not in merged and t not in special)
        if not plain or not single or sorted(merged) != made:
            return None
        ranks = {self.bytes_a[i]: i for t, i in model["vocab"].items() if t not in special}
        return tiktoken.Encoding("a", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ids_a(self, text: str) -> list[int]:
        if self._ranked and max(text) < _SETTLED:
            return self._ranked(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def segments(self, text: str) -> list[str]:
        """space+text in segments, or whole if these tokenizers could join them."""
        if not self.cuttable:
            return [" " + text]
        return (self._cut if not text.isascii() and _rare(text) else self._cut_plain)(" " + text)

    def _same(self, want: bytes, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == want and b"".join(map(self.bytes_b.__getitem__, b)) == want

    def _libraries(self, text: str) -> tuple[list[int], list[int]] | None:
        """(A ids, B ids) of a segment or of segments that don't end in white space, in one call of each library; None where the bytes are others."""
        lead = len(self._lead)
        a, b = self._ids_a(text), self.b.encode("\n" + text)  # behind a line feed B adds no space
        return (a, b[lead:]) if b[:lead] == self._lead and self._same(text.encode("utf-8", "surrogatepass"), a, b[lead:]) else None

    def encode_segments(self, segments: list[str]) -> tuple[list[array], list[np.ndarray], np.ndarray]:
        """(ids of all segments under A and under B, how many each segment has under A and under B, which segments have none as their bytes are others)."""
        ids, sizes, bad = (array("H"), array("H")), (np.zeros(len(segments), np.int64), np.zeros(len(segments), np.int64)), np.zeros(len(segments), bool)
        at = 0
        while at < len(segments):
            to = at
            while to < min(len(segments), at + _BATCH) and not segments[to][-1].isspace():
                to += 1
            some = segments[at:to]
            coded = self._libraries("".join(some)) if len(some) > 1 else None
            counts = self._counts(some, *coded) if coded else None
            if counts:
                for k in (0, 1):
                    ids[k].extend(coded[k])
                    sizes[k][at:to] = counts[k]
            else:
                to = max(to, at + 1)
                for i in range(at, to):
                    one = self._libraries(segments[i])
                    bad[i] = one is None
                    for k in (0, 1):
                        ids[k].extend(one[k] if one else [])
                        sizes[k][i] = len(one[k]) if one else 0
            at = to
        return list(ids), list(sizes), bad

    def _counts(self, segments: list[str], a: list[int], b: list[int]) -> list[np.ndarray] | None:
        """How many ids under A and under B each segment has; None if a token reaches from one into the next."""
        want, out = np.cumsum([len(s.encode("utf-8", "surrogatepass")) for s in segments]), []
        for ids, lengths in ((a, self.len_a), (b, self.len_b)):
            ends = np.cumsum(lengths[np.array(ids)])
            at = np.searchsorted(ends, want)
            if not np.array_equal(ends[at], want):
                return None
            out.append(np.diff(np.concatenate(([-1], at))))
        return out

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """(ids of space+text under A, of text under B) by the libraries, the text in one piece."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        return (a, b) if self._same((" " + text).encode("utf-8", "surrogatepass"), a, b) else None


_loaded: dict[tuple[str, str], Pair] = {}


def tokenizers(path_a: str, path_b: str) -> Pair:
    """Both tokenizers of two files, kept by the Python worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Pair(path_a, path_b)
    return _loaded[path_a, path_b]


def ends_of(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The byte offsets at which tokens end."""
    return np.cumsum(lengths[ids])


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets at which tokens of both end, group of each A token, group of each B token)."""
    cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)


def links_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A, in B) of all pairs of tokens whose byte ranges overlap, in order of A and then of B."""
    if not len(ends_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts_a = np.concatenate(([0], ends_a[:-1]))
    first, last = np.searchsorted(ends_b, starts_a, "right"), np.searchsorted(ends_b, ends_a, "left")
    n = last - first + 1
    in_a = np.repeat(np.arange(len(ends_a)), n)
    return in_a, np.arange(len(in_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def spelled_groups(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
    """The groups' tokens in order, each with the mark behind it: together `a1,a2|b1;a3|b2,b3;`."""
    sides = np.concatenate((2 * group_a, 2 * group_b + 1))
    order = np.argsort(sides, kind="stable")
    ids, side = np.concatenate((a, b))[order].tolist(), sides[order]
    last = np.append(side[1:] != side[:-1], True)
    marks = np.where(last, np.where(side & 1, ";", "|"), ",").tolist()
    return [f"{i}{m}" for i, m in zip(ids, marks, strict=True)]


class _Numbers(dict):
    """Numbers what it is asked for in order of first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _packed(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(values.tobytes())


def _opened(packed: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind).astype(np.int64)


_BLOCK = "n array<int>, segments binary, na binary, nb binary, a binary, b binary"


def _block(both: Pair, texts: list[str | None], parts: list[np.ndarray], known: _Numbers) -> list:
    """The columns of a block: segments of each document, their sequence, and the tokens of the different segments."""
    ids, sizes, bad = both.encode_segments(list(known))
    whole = ([], [])
    if bad.any():  # such a text is encoded whole
        for i, part in enumerate(parts):
            if len(part) and bad[part].any():
                own = both.encode(texts[i])
                parts[i] = np.array([len(known) + len(whole[0])] if own else [], np.uint32)
                for k in (0, 1):
                    whole[k].extend([own[k]] if own else [])
    joined = lambda k: np.concatenate([np.array(x, np.uint16) for x in (ids[k], *whole[k])])
    counts = lambda k: np.array([*sizes[k], *map(len, whole[k])], np.uint32)
    sequence = np.concatenate([np.zeros(0, np.uint32), *parts])
    binary = [_packed(x) for x in (sequence, counts(0), counts(1), joined(0), joined(1))]
    return [pa.array([list(map(len, parts))], pa.list_(pa.int32())), *(pa.array([x], pa.binary()) for x in binary)]


def _encoded(path_a: str, path_b: str, most: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = tokenizers(path_a, path_b), 0
        ids, texts, parts, size, known = [], [], [], 0, _Numbers()

        def block() -> pa.RecordBatch:
            nonlocal number, ids, texts, parts, size, known
            doc_ids = pa.chunked_array(ids).combine_chunks()
            key = TaskContext.get().partitionId() << 32 | number
            number += 1
            cols = [pa.array([key], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids), *_block(both, texts, parts, known)]
            ids, texts, parts, size, known = [], [], [], 0, _Numbers()
            return pa.RecordBatch.from_arrays(cols, names=["block", "ids", "n", "segments", "na", "nb", "a", "b"])

        for batch in batches:
            column, from_ = batch.column("text"), 0
            for at in range(batch.num_rows):
                text = column[at].as_py()
                own = both.segments(text) if text else []
                texts.append(text)
                parts.append(np.fromiter(map(known.__getitem__, own), np.uint32, len(own)))
                size += len(text or "") + 64
                if size >= most:
                    ids.append(batch.column("doc_id").slice(from_, at + 1 - from_))
                    yield block()
                    from_ = at + 1
            if from_ < batch.num_rows:
                ids.append(batch.column("doc_id").slice(from_))
        if texts:
            yield block()

    return encode


class _Segments:
    """The different segments of a block, their tokens and links; links and groups are in order of segments."""

    def __init__(self, both: Pair, row: dict):
        self.sequence = _opened(row["segments"], "<u4")
        self.na, self.nb = _opened(row["na"], "<u4"), _opened(row["nb"], "<u4")
        self.a, self.b = _opened(row["a"], "<u2"), _opened(row["b"], "<u2")
        self.ends_a, self.ends_b = ends_of(self.a, both.len_a), ends_of(self.b, both.len_b)
        in_a, in_b = links_of(self.ends_a, self.ends_b)
        self.keys = self.a[in_a] << _B_BITS | self.b[in_b]
        self.link_segment = np.repeat(np.arange(len(self.na)), self.na)[in_a]

    def summed(self, values: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """Sums of values by segment."""
        before = np.concatenate(([0], np.cumsum(values)))
        at = np.searchsorted(segment, np.arange(len(self.na) + 1))
        return np.diff(before[at])


def _block_pairs(path_a: str, path_b: str):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(path_a, path_b)
        for batch in batches:
            for row in batch.to_pylist():
                own = _Segments(both, row)
                times = np.bincount(own.sequence, minlength=len(own.na))
                key, at = np.unique(own.keys, return_inverse=True)
                n = np.zeros(len(key), np.int64)
                np.add.at(n, at, times[own.link_segment])
                key, n = key[n > 0], n[n > 0]  # segments of texts that were encoded whole may have no place
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), row["block"], np.int64)), pa.array(key), pa.array(n)], names=["block", "key", "n"])

    return pairs


def _answered(path_a: str, path_b: str):
    def answer(blocks: pa.Table, counts: pa.Table) -> pa.Table:
        both, out = tokenizers(path_a, path_b), []
        key = counts.column("key").to_numpy()
        order = np.argsort(key)
        key, count, best = (np.append(counts.column(c).to_numpy()[order], 0) for c in ("key", "count", "best"))
        for i in range(blocks.num_rows):
            row = {name: blocks.column(name)[i] for name in blocks.schema.names}
            own = _Segments(both, {k: v.as_py() for k, v in row.items() if k not in ("ids", "n")})
            cuts, group_a, group_b = groups_of(own.ends_a, own.ends_b)
            at = np.searchsorted(key[:-1], own.keys)
            found = key[at] == own.keys  # all that have a place
            spelled, to = spelled_groups(own.a, own.b, group_a, group_b), np.cumsum(own.na + own.nb).tolist()
            lines = ["".join(spelled[k:m]) for k, m in zip([0, *to], to, strict=False)]
            groups = own.summed(np.ones(len(cuts), np.int64), np.searchsorted(np.cumsum(own.na), np.searchsorted(own.ends_a, cuts), "right"))
            links = own.summed(np.ones(len(own.keys), np.int64), own.link_segment)
            each = [own.na, own.nb, groups, links, own.summed(np.where(found, best[at], 0), own.link_segment), own.summed(np.where(found, count[at], 0), own.link_segment)]
            ends = np.concatenate(([0], np.cumsum(row["n"].values.to_numpy())))
            whole = [np.diff(np.concatenate(([0], np.cumsum(x[own.sequence])))[ends]) for x in each]
            sequence, shas = own.sequence.tolist(), []
            for k, m in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                shas.append(hashlib.sha256("".join(map(lines.__getitem__, sequence[k:m]))[:-1].encode()).hexdigest() if m > k else "")
            out.append(pa.Table.from_arrays([row["ids"].values, *map(pa.array, whole), pa.array(shas, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    return answer


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(one row for each document, one row for each pair of ids that is linked anywhere).

    Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Pairs: a_id, b_id, n, best (n is the
    highest of its b_id). Both tokenizer files have to lie at the same paths on every executor.
    """
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spec = StructType([StructField("block", LongType()), StructField("ids", ArrayType(id_type)), *StructType.fromDDL(_BLOCK)])
    blocks = written(rows.mapInArrow(_encoded(path_a, path_b, block), spec), "alignment-blocks")
    pairs = written(blocks.drop("ids", "n").mapInArrow(_block_pairs(path_a, path_b), "block long, key long, n long"), "alignment-pairs")
    salted = pairs.groupBy("key", F.pmod(F.hash("block"), F.lit(SALTS)).alias("salt")).agg(F.sum("n").alias("n"))
    counts = salted.groupBy("key").agg(F.sum("n").alias("count")).withColumn("b_id", F.col("key").bitwiseAND((1 << _B_BITS) - 1))
    highest = counts.groupBy("b_id").agg(F.max("count").alias("highest"))  # one row for each B id, 65,536 at most
    counts = counts.join(F.broadcast(highest), "b_id").select("key", "count", (F.col("count") == F.col("highest")).cast("int").alias("best"))
    counts = written(counts, "alignment-counts")
    answers = pairs.select("block", "key").join(counts, "key")
    out = StructType([StructField("doc_id", id_type), *StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")])
    found = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_answered(path_a, path_b), out)
    return found, counts.select(F.shiftright("key", _B_BITS).alias("a_id"), F.col("key").bitwiseAND((1 << _B_BITS) - 1).alias("b_id"), F.col("count").alias("n"), (F.col("best") == 1).alias("best"))
