"""Secret scans with structural confirmation.

Three base patterns report what they match. Runs of base64 or hex are candidates only: they are decoded
(base64 from each place where a key can begin, over line ends that may be escaped or indented), and reported if the
bytes parse as a private key (DER or OpenSSH, all nested lengths of which fit) or if the text is a signed token whose
header decodes to JSON that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from heddle.llm.base import free_names, slabs

#: The base patterns, in the order in which kinds are listed, and the least lengths of what they report.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "key", "openssh", "token")
_RANK = {k: i for i, k in enumerate(KINDS)}

#: Shortest runs that are candidates for decoding.
HEX_RUN, BASE64_RUN = 24, 40
#: A line's end inside a run, as it is or escaped, and what indents the lines.
_BREAK = re.compile(r"[\x20\t]*(?:\r?\n|\\+r\\+n|\\+n)[\x20\t]*")
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}(?:{_BREAK.pattern}[A-Za-z0-9+/_-]+)*={{0,2}}")
#: How a DER sequence and an OpenSSH key begin in base64.
_HEADER = re.compile("M[A-I]|b3BlbnNzaC1rZXktdjEA")
_HEXES = re.compile(r"[0-9A-Fa-f]{64,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{7,})\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_OPENSSH = b"openssh-key-v1\0"


def _class(chars: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[list(chars)] = False
    return out


_NOT_HEX = _class(b"0123456789abcdefABCDEF")
_NOT_64 = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")


def _with_run(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray, least: int) -> set[int]:
    """Which texts of a slab have a run of at least so many bytes of a class."""
    ends = np.flatnonzero(outside[data])
    ends = np.concatenate(([-1], ends, [len(data)]))
    return set((np.searchsorted(offsets, ends[:-1][np.diff(ends) > least] + 1, "right") - 1).tolist())


def _der(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(tag, start, end) of the contents of the DER element at that place, or None if its length doesn't fit."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > len(data) or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at : at + size], "big"), at + size
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= len(data) else None


def _inner_key(data: bytes) -> bool:
    """Whether the octets inside a PKCS#8 key are one element, whole: a sequence that begins with a version number, or octets."""
    own = _der(data)
    if own is None or own[2] != len(data):
        return False
    first = _der(data[: own[2]], own[1])
    return own[0] == 0x04 and own[2] > own[1] or own[0] == 0x30 and first is not None and first[0] == 0x02 and first[2] <= own[2]


class _More(Exception):
    """Parsing needs so many bytes."""


def openssh_length(data: bytes, limit: int | None = None) -> int:
    """Bytes that an OpenSSH private key at the start of data takes; 0 if there is none. limit: how many there are where data has only the first of them."""
    limit = len(data) if limit is None else limit

    def part(at: int, size: int) -> int:
        if at + size > limit:
            raise ValueError
        if at + size > len(data):
            raise _More(at + size)
        return at + size

    def string(at: int) -> tuple[int, int]:
        start = part(at, 4)
        return start, part(start, int.from_bytes(data[at:start], "big"))

    try:
        if not data.startswith(_OPENSSH):
            return 0
        at, names = len(_OPENSSH), []
        for _ in range(3):  # cipher, key derivation and its options
            start, at = string(at)
            names.append(data[start:at])
        if not all(re.fullmatch(rb"[a-z0-9@.-]+", n) for n in names[:2]):
            return 0
        count = int.from_bytes(data[at : (after := part(at, 4))], "big")
        at = after
        if not 1 <= count <= 64:
            return 0
        for _ in range(count):
            start, at = string(at)
            kind_at, kind_end = string(start)
            if kind_end > at or not re.fullmatch(rb"[A-Za-z0-9@.-]+", data[kind_at:kind_end]):
                return 0
        start, at = string(at)
        if at - start < 8 or (at - start) % 8 or (names[0] == b"none" and data[start : start + 4] != data[start + 4 : start + 8]):
            return 0
        return at
    except ValueError:
        return 0


def private_key_length(data: bytes) -> int:
    """Bytes that a DER private key (PKCS#1, PKCS#8 or SEC 1) at the start of data takes; 0 if there is none."""
    outer = _der(data)
    if outer is None or outer[0] != 0x30:
        return 0
    parts, at = [], outer[1]
    while at < outer[2]:
        part = _der(data, at)
        if part is None or part[2] > outer[2]:
            return 0
        parts.append((part[0], data[part[1] : part[2]]))
        at = part[2]
    tags = [t for t, _ in parts]
    if not parts or parts[0][0] != 0x02 or parts[0][1] not in (b"\0", b"\1"):
        return 0
    rsa = tags[:9] == [0x02] * 9 and len(parts[1][1]) >= 16
    pkcs8 = tags[:3] == [0x02, 0x30, 0x04] and (x := _der(parts[1][1])) is not None and x[0] == 0x06 and _inner_key(parts[2][1])
    ec = tags[:2] == [0x02, 0x04] and parts[0][1] == b"\1" and 16 <= len(parts[1][1]) <= 66
    return outer[2] if rsa or pkcs8 or ec else 0


def _decoded64(run: str) -> bytes:
    text = run.translate(str.maketrans("-_", "+/", "=\r\n"))
    try:
        return base64.b64decode(text[: len(text) - (len(text) % 4 == 1)] + "=" * (-len(text) % 4 % 3), validate=False)
    except binascii.Error:
        return b""


def _outer_length(data: bytes) -> int:
    """Bytes that a private key with such a header takes; 0 if the header is another."""
    if len(data) < 2 or data[0] != 0x30:
        return 0
    n, at = data[1], 2
    if n >= 0x80:
        at += n & 0x7F
        n = int.from_bytes(data[2:at], "big")
    return at + n if data[at : at + 3] in (b"\x02\x01\0", b"\x02\x01\1") else 0


def _openssh64(text: str, at: int) -> int:
    """Bytes that an OpenSSH key takes whose base64 begins at that place; only as much of the run is decoded as its lengths ask for."""
    need, limit = 64, (len(text) - at) * 3 // 4
    while True:
        try:
            return openssh_length(_decoded64(text[at : at + -(-need // 3) * 4])[:limit], limit)
        except _More as more:
            need = more.args[0]


def _keys64(run: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the private keys that begin anywhere in a run of base64."""
    base, to = [], 0  # the places of the run's characters, without the line ends
    for m in _BREAK.finditer(run):
        base.append(np.arange(to, m.start()))
        to = m.end()
    place = np.concatenate([*base, np.arange(to, len(run.rstrip("=")))])
    text = "".join(run[p[0] : p[-1] + 1] for p in base if len(p)) + run[to:].rstrip("=")
    done = 0
    for m in _HEADER.finditer(text):
        at = m.start()
        if at < done:
            continue
        if m[0] != "b3BlbnNzaC1rZXktdjEA":
            n = _outer_length(_decoded64(text[at : at + 16]))
            done_at = at - (-4 * n // 3)
            if not n or done_at > len(text) or private_key_length(_decoded64(text[at:done_at])) != n:
                continue
            done, kind = done_at, "key"
        else:
            n = _openssh64(text, at)
            done_at = at - (-4 * n // 3)
            if not n:
                continue
            done, kind = done_at, "openssh"
        end = len(run) if done == len(text) else int(place[done - 1]) + 1
        yield int(place[at]), end, kind


def spans_of(text: str, hexes: bool = True, runs: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in a text, sorted; hexes, runs: whether it has runs long enough to look at."""
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexes:
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
        for m in _HEXES.finditer(text):
            data = bytes.fromhex(m[0][: len(m[0]) // 2 * 2])
            if n := openssh_length(data):
                out.append((m.start(), m.start() + 2 * n, "openssh"))
            elif n := private_key_length(data):
                out.append((m.start(), m.start() + 2 * n, "key"))
    if runs:
        for m in _BASE64.finditer(text):
            out += [(m.start() + a, m.start() + b, kind) for a, b, kind in _keys64(m[0])]
    if "." in text and "ey" in text:
        for m in _TOKEN.finditer(text):
            try:
                head = json.loads(_decoded64(m[1]))
            except ValueError:
                continue
            if isinstance(head, dict) and isinstance(head.get("alg"), str):
                out.append((m.start(), m.end(), "token"))
    return sorted(out, key=lambda s: (s[0], _RANK[s[2]], s[1]))


def _scan(own_text: str, own_clean: str, columns: list[str], keep: bool, masked: bool, mark: str):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(own_text).cast(pa.binary()).to_pylist()
            texts = batch.column(own_text).to_pylist()
            counts = {k: [] for k in ("assign", "access", "hex")}
            digests, spans, clean = [], [], []
            for first, last, data, offsets in slabs(raw):
                bytes_ = np.frombuffer(data, np.uint8)
                hexes, runs = (_with_run(bytes_, offsets, *x) for x in ((_NOT_HEX, HEX_RUN), (_NOT_64, BASE64_RUN)))
                for d in range(last - first):
                    text = texts[first + d]
                    found = spans_of(text or "", d in hexes, d in runs)
                    base = [f"{k}:{s}:{e}" for s, e, k in found if k in counts]
                    for k in counts:
                        counts[k].append(sum(x[2] == k for x in found))
                    digests.append(hashlib.sha256(",".join(base).encode()).hexdigest())
                    spans.append(",".join(f"{k}:{s}:{e}" for s, e, k in found))
                    if masked:
                        clean.append(_masked(text, found, mark))
            own = [pa.array(counts[k], pa.int64()) for k in counts] + [pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            if masked:
                own, names = [pa.array(clean, pa.string())], [own_clean]
            kept = [batch.column(c) for c in columns] if keep else []
            yield pa.RecordBatch.from_arrays([*kept, *own], names=[*(columns if keep else []), *names])

    return scan


def _masked(text: str | None, spans: list[tuple[int, int, str]], mark: str) -> str | None:
    if not text or not spans:
        return text
    out, at, to = [], 0, -1
    for s, e, _ in spans:
        if s > to:
            out += [text[at:s], mark]
        to = max(to, e)
        at = max(at, e)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans holds kind:start:end of all spans (code points, end exclusive) by start and then kind, comma-joined;
    base_sha256 is the digest of the base kinds' share of it. Spans of different kinds may overlap. A null text counts
    as empty: no spans. Repeated documents are separate rows; other columns are ignored; texts are scanned whole.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return rows.mapInArrow(_scan("__text", "", ["doc_id"], True, False, ""), f"doc_id {id_type}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each maximal run of overlapping spans in the text replaced by mark.

    All rows and columns stay, repeated rows and columns of any name too; null and empty texts stay as they are; an empty
    table gives an empty one.
    """
    own_text, own_clean = free_names(docs.columns, "__text", "__clean")
    rows = docs.withColumn(own_text, F.col(text_col))
    schema = StructType([*docs.schema.fields, StructField(own_clean, StringType())])
    out = rows.mapInArrow(_scan(own_text, own_clean, docs.columns, True, True, mark), schema)
    return out.select(*(F.col(own_clean).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
