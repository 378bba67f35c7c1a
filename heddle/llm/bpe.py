"""BPE encoding and decoding by dynamic programming over prefixes.

For a word, the encoding of each prefix ends in exactly one token. A token that ends at a place (all of them come from
an automaton over the vocabulary) is that last token if it is compatible with the last token of the prefix before it:
if merging the two tokens' symbols by the rules gives back these two tokens. Back-pointers then give the word's ids.

Normalisation and splitting follow the tokenizer file: NFC, lower case, runs of letters, single digits, runs of other
characters and English contractions; white space falls away; special tokens are cut out of the raw text first.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.base import arrow_type, parts

#: Words that a task's memory of encodings holds, and the longest word that goes there.
MEMO_WORDS, MEMO_LENGTH = 300_000, 48
#: Pairs of tokens whose compatibility a task remembers.
MEMO_PAIRS = 300_000
#: Shift that marks a word's last symbol.
_LAST = 0x4000
_END = "</w>"
_NEVER = 1 << 30


def _byte_chars() -> str:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class _Memo(dict):
    """A mapping that works out what is missing, and keeps it while there is room."""

    def __init__(self, work, room: int):
        super().__init__()
        self._work, self._room = work, room

    def __missing__(self, key):
        value = self._work(key)
        if len(self) < self._room:
            self[key] = value
        return value


class WordBpe:
    """A tokenizer file of the kind described above; the file is an argument, it is never copied."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END or model["continuing_subword_prefix"] or spec["decoder"]:
            raise ValueError("not a word BPE tokenizer")
        chars = _byte_chars()
        self._to_chars = dict(enumerate(chars))
        self._plain = {b: c for b, c in enumerate(chars) if ord(c) != b}
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self._id = {self._symbols(t): i for t, i in vocab.items() if t not in self.special}
        self._text = {i: s for s, i in self._id.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self._rank = {self._pair(*(self._id[self._symbols(x)] for x in m)): r for r, m in enumerate(merges)}
        self._matches = ahocorasick.Automaton()
        for s, i in self._id.items():
            self._matches.add_word(s, (len(s), i))
        self._matches.make_automaton()
        self._spines: dict[int, tuple[list, list] | None] = {}
        self._fits = _Memo(self._compatible, MEMO_PAIRS)
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self._split = regex.compile(split).findall
        ascii_ = split.replace(r"\p{White_Space}", r"\t-\r ").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        self._split_ascii = re.compile(ascii_).findall
        self._cut = regex.compile("|".join(map(regex.escape, self.special))).split if self.special else None
        self._special = regex.compile("|".join(map(regex.escape, self.special))).findall if self.special else None
        self._ids = _Memo(lambda w: np.array(self.encode_word(w), "<u4").tobytes(), MEMO_WORDS)

    @staticmethod
    def _symbols(token: str) -> str:
        """A token's symbols, one character each; a word's last symbol is shifted."""
        return token[: -len(_END) - 1] + chr(ord(token[-len(_END) - 1]) + _LAST) if token.endswith(_END) and len(token) > len(_END) else token

    @staticmethod
    def _pair(left: int, right: int) -> int:
        return left << 20 | right

    def _spine(self, token: int) -> tuple[list, list] | None:
        """How the rules build a token: its parts at the left edge and at the right edge, each with the rank that absorbs it.

        None if the rules never build it. Least rank goes first, leftmost first.
        """
        if token not in self._spines:
            parts = [self._id[c] for c in self._text[token]]
            left, right = [], []
            while len(parts) > 1:
                rank, at = min((self._rank.get(self._pair(*p), _NEVER), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == _NEVER:
                    break
                if at == 0:
                    left.append((parts[0], rank))
                if at == len(parts) - 2:
                    right.append((parts[-1], rank))
                parts[at : at + 2] = [self._id[self._text[parts[at]] + self._text[parts[at + 1]]]]
            self._spines[token] = ([*left, (token, _NEVER)], [*right, (token, _NEVER)]) if parts == [token] else None
        return self._spines[token]

    def _compatible(self, pair: int) -> bool:
        """Whether the rules, applied to both tokens' symbols in a row, never merge across the border."""
        left, right = self._spine(pair >> 20), self._spine(pair & 0xFFFFF)
        if left is None or right is None:
            return False
        left, right, i, j = left[1], right[0], 0, 0
        while True:
            (x, up), (y, down) = left[i], right[j]
            across = self._rank.get(x << 20 | y, _NEVER)
            if across != _NEVER and across < up and across <= down:
                return False
            if up == down == _NEVER:
                return True
            if up <= down:
                i += 1
            else:
                j += 1

    def encode_word(self, word: str) -> list[int]:
        """Ids of one piece of split text."""
        if word.isascii():
            chars = word[:-1] + chr(ord(word[-1]) + _LAST) if word.isprintable() else ""
        else:
            chars = ""
        if not chars:
            chars = word.encode().decode("latin-1").translate(self._plain)
            chars = chars[:-1] + chr(ord(chars[-1]) + _LAST)
        n, fits = len(chars), self._fits
        last, back = [-1] * (n + 1), [0] * (n + 1)
        for end, (size, token) in self._matches.iter(chars):
            end += 1
            if last[end] < 0:
                at = end - size
                if at:
                    if last[at] < 0 or not fits[last[at] << 20 | token]:
                        continue
                elif self._spine(token) is None:
                    continue
                last[end], back[end] = token, at
        ids, at = [], n
        while at:
            ids.append(last[at])
            at = back[at]
        return ids[::-1]

    def _word_ids(self, word: str) -> bytes:
        return self._ids[word] if len(word) <= MEMO_LENGTH else self._ids._work(word)

    def _pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self._split_ascii(text.lower())
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")  # lower case by single characters: no final sigma
        return self._split(text.lower())

    def _coded(self, words: list[str]) -> bytes:
        """Ids of words as little-endian unsigned 32-bit integers."""
        if words and max(map(len, words)) > MEMO_LENGTH:
            return b"".join(map(self._word_ids, words))
        return b"".join(map(self._ids.__getitem__, words))

    def encode_decode(self, text: str | None) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, what they decode to) of a whole text; null counts as empty."""
        text = text or ""
        if not self.special or not any(s in text for s in self.special):
            ids = self._coded(self._pieces(text))
        else:
            parts_ = []
            for part, mark in zip(self._cut(text), [*self._special(text), None], strict=True):
                parts_ += [self._coded(self._pieces(part)), np.array([self.special[mark]] if mark else [], "<u4").tobytes()]
            ids = b"".join(parts_)
        return ids, self.decode(np.frombuffer(ids, "<u4").tolist())

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_decode(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    """The tokenizer of a file, kept by the Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _encode(path: str, id_type: pa.DataType, full: bool, digests: bool, decoded: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in parts(batches):
            n, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for text in batch.column("text"):
                a, b = bpe.encode_decode(text.as_py())
                n.append(len(a) // 4)
                if full:
                    ids.append(np.frombuffer(a, "<u4").astype(np.int32))
                if decoded:
                    texts.append(b)
                if digests:
                    ids_sha.append(hashlib.sha256(a).hexdigest())
                    text_sha.append(hashlib.sha256(b.encode()).hexdigest())
            cols = {"doc_id": batch.column("doc_id").cast(id_type), "n_tokens": pa.array(n, pa.int64())}
            if digests:
                cols |= {"ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
            if full:
                cols["ids"] = pa.array(ids, pa.list_(pa.int32()))
            if decoded:
                cols["decoded"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return encode


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True, digests: bool = False, decoded: bool | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, with digests ids_sha256 and decoded_sha256, with full ids, with decoded (by default as full) the decoded text.

    path: the tokenizer file, on every executor. A null text counts as empty: no tokens. Repeated documents are
    separate rows; ids may have any type; other columns are ignored; texts are encoded whole, and nothing is shuffled.
    """
    decoded = full if decoded is None else decoded
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = ", ids_sha256 string, decoded_sha256 string" * digests + ", ids array<int>" * full + ", decoded string" * decoded
    return rows.mapInArrow(_encode(path, arrow_type(id_type), full, digests, decoded), f"doc_id {id_type}, n_tokens long{own}")
