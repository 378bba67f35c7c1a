"""Full-text search: postings built once, then BM25 as Column arithmetic over the postings that match."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.constants import BM25_B, BM25_K1, CANDIDATE_SESSIONS, IDF_FLOOR
from heddle.functions.porter import tokens


@dataclass(frozen=True)
class Query:
    """A parsed query: terms that must all occur as prefixes, or a phrase of whole tokens."""

    kind: str
    terms: tuple[str, ...]


def parse(text: str | None, stemmed: bool = True) -> Query | None:
    """None for a blank query; one quoted phrase is a phrase; else all terms, as prefixes."""
    text = (text or "").replace("\0", " ").strip()
    if len(text) > 2 and text[0] == text[-1] == '"' and '"' not in text[1:-1]:
        terms = tuple(tokens(text, stemmed))
        return Query("phrase", terms) if terms else None
    terms = tuple(t for word in text.replace('"', " ").split() for t in tokens(word, stemmed))
    return Query("all", terms) if terms else None


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toks = [tokens(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(toks, pa.list_(pa.string()))], names=["doc", "tokens"])


def _folding() -> tuple[str, str]:
    """Letters with marks of the Latin, Greek and Cyrillic blocks and what is left of them; combining marks have nothing left."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(code):
            pairs.append((chr(code), plain))
    return "".join(a for a, _ in pairs) + "".join(chr(c) for c in range(0x300, 0x370)), "".join(b for _, b in pairs)


def token_column(text: Column) -> Column:
    """Tokens of a text without stemming, by built-in functions."""
    return F.regexp_extract_all(F.translate(F.lower(text), *_folding()), F.lit(r"([\p{L}\p{N}]+)"))


def _frequencies(query: Query):
    """What tells the length of a list of tokens and how often each part of the query is in it."""
    if query.kind == "phrase":
        phrase = " " + "  ".join(query.terms) + " "

        def parts(tokens: Column) -> list[Column]:
            line = F.concat(F.lit(" "), F.array_join(tokens, "  "), F.lit(" "))
            return [((F.length(line) - F.length(F.replace(line, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")]

    else:
        begins = lambda term: lambda token: token.startswith(term)

        def parts(tokens: Column) -> list[Column]:
            return [F.size(F.filter(tokens, begins(term))).cast("long") for term in query.terms]

    return lambda tokens: F.struct(F.size(tokens).alias("dl"), *(f.alias(f"tf{i}") for i, f in enumerate(parts(tokens))))


def scan_hits(docs: DataFrame, doc: str, text: Column, query: Query) -> DataFrame:
    """(doc, score) of documents that satisfy the query, without an index and without stemming: one pass for the statistics, one for the scores, no shuffle of tokens.

    A text is tokenized once in a pass, and in the second only if it holds the terms as plain strings.
    """
    n_parts = 1 if query.kind == "phrase" else len(query.terms)
    rows = docs.select(F.col(doc).cast("string").alias("doc"), F.translate(F.lower(text), *_folding()).alias("folded"))
    measured = F.transform(F.array(F.regexp_extract_all("folded", F.lit(r"([\p{L}\p{N}]+)"))), _frequencies(query))
    # inline is where filters stop, so that the tokens of a text are worked out once
    counts = lambda df: df.select("doc", F.inline(measured))
    stats = counts(rows).agg(F.count("*").alias("n"), F.sum("dl").alias("s"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(n_parts))).first()
    n, mean = stats["n"], (stats["s"] or 0) / max(1, stats["n"])
    likely = rows
    for term in query.terms:
        likely = likely.filter(F.col("folded").contains(term))
    hits = counts(likely)
    for i in range(n_parts):
        hits = hits.filter(F.col(f"tf{i}") > 0)
    score = sum((bm25(F.col(f"tf{i}"), F.col("dl"), F.lit(stats[f"df{i}"]), n, mean) for i in range(n_parts)), F.lit(0.0))
    return hits.select("doc", score.alias("score"))


def scanned(docs: DataFrame, doc: str, text: Column, query: Query, limit: int) -> DataFrame:
    """The best of scan_hits."""
    return best(scan_hits(docs, doc, text, query), limit)


def postings(docs: DataFrame, doc: str, text: Column, stemmed: bool = True) -> DataFrame:
    """(doc, term, positions, tf, dl): one row for each document and term; write it once and read it by term."""
    rows = docs.select(F.col(doc).cast("string").alias("doc"), text.alias("text"))
    rows = rows.mapInArrow(_tokenized, "doc string, tokens array<string>") if stemmed else rows.select("doc", token_column(F.col("text")).alias("tokens"))
    each = rows.select("doc", F.size("tokens").alias("dl"), F.posexplode("tokens").alias("pos", "term"))
    return each.groupBy("doc", "term").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.count("*").alias("tf"), F.first("dl").alias("dl"))


#: Postings that are sorted by term and go on together, or as many as one document has.
TOGETHER = 1 << 18


def _inverted(stemmed: bool):
    """Documents (doc, said) as postings; said is the text, or its tokens if they aren't to be stemmed."""

    def table(rows: list[tuple[str, int, dict[str, list[int]]]]) -> pa.RecordBatch:
        tf = [len(p) for _, _, at in rows for p in at.values()]
        places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tf)]), pa.int32()), pa.array([k for _, _, at in rows for p in at.values() for k in p], pa.int32()))
        columns = [pa.array([doc for doc, _, at in rows for _ in at], pa.string()), pa.array([t for _, _, at in rows for t in at], pa.string()), places, pa.array(tf, pa.int64()), pa.array([dl for _, dl, at in rows for _ in at], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "term", "positions", "tf", "dl"]).sort_by("term")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            for doc, said in zip(batch.column("doc"), batch.column("said"), strict=True):
                own = tokens(said.as_py()) if stemmed else said.as_py() or []
                at: dict[str, list[int]] = {}
                for k, term in enumerate(own):
                    at.setdefault(term, []).append(k)
                rows.append((doc.as_py(), len(own), at))
                n += len(at)
                if n >= TOGETHER:
                    yield table(rows)
                    rows, n = [], 0
        if n:
            yield table(rows)

    return work


def own_postings(docs: DataFrame, doc: str, text: Column, stemmed: bool = True) -> DataFrame:
    """postings of documents that are a row each: worked out in that row, without a shuffle. They are sorted in pieces, so that of a table of them a range of terms is read by pages."""
    rows = docs.select(F.col(doc).cast("string").alias("doc"), (text if stemmed else token_column(text)).alias("said"))
    return rows.mapInArrow(_inverted(stemmed), "doc string, term string, positions array<int>, tf bigint, dl int")


def statistics(index: DataFrame, n_docs: int | None = None) -> tuple[int, float]:
    """(documents, mean length); n_docs counts documents without tokens too."""
    row = index.groupBy("doc").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.sum("dl").alias("s")).first()
    n = n_docs if n_docs is not None else row["n"]
    return n, (row["s"] or 0) / max(1, n)


def text_statistics(docs: DataFrame, text: Column) -> tuple[int, float]:
    """(documents, mean length) of texts themselves, without stemming and without an index: one pass and no shuffle of tokens."""
    row = docs.agg(F.count("*").alias("n"), F.sum(F.size(token_column(text))).alias("s")).first()
    return row["n"], (row["s"] or 0) / max(1, row["n"])


def bm25(tf: Column, dl: Column, df: Column, n: int, mean: float) -> Column:
    """The score of one term, the less the better; terms in most documents count next to nothing."""
    raw = F.log((F.lit(float(n)) - df + 0.5) / (df + 0.5))
    idf = F.when(raw <= 0, IDF_FLOOR).otherwise(raw)
    return -idf * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / F.lit(float(mean))))


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda p: p + F.lit(by))


def matches(index: DataFrame, query: Query, n: int, mean: float, prefix: bool = True) -> DataFrame:
    """(doc, score) of documents that satisfy the query. Only postings of the query's terms are read."""
    if query.kind == "phrase":
        own = index.filter(F.col("term").isin(*query.terms)).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"), F.first("dl").alias("dl"))
        empty = F.array().cast("array<int>")
        starts = F.coalesce(F.col("at")[query.terms[0]], empty)
        for i, t in enumerate(query.terms[1:], 1):
            starts = F.array_intersect(starts, _moved(F.coalesce(F.col("at")[t], empty), -i))
        own = own.select("doc", "dl", F.size(starts).alias("tf")).filter("tf > 0").withColumn("q", F.lit(0))
        terms = 1
    else:
        hit = [(i, F.col("term").startswith(t) if prefix else F.col("term") == t) for i, t in enumerate(query.terms)]
        which = F.array_compact(F.array(*(F.when(c, F.lit(i)) for i, c in hit)))
        anywhere = hit[0][1]
        for _, c in hit[1:]:
            anywhere = anywhere | c
        own = index.filter(anywhere).select("doc", "tf", "dl", F.explode(which).alias("q")).groupBy("doc", "q").agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
        terms = len(query.terms)
    df = own.groupBy("q").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    scored = own.join(F.broadcast(df), "q").withColumn("score", bm25(F.col("tf"), F.col("dl"), F.col("df"), n, mean))
    return scored.groupBy("doc").agg(F.sum("score").alias("score"), F.count("*").alias("found")).filter(F.col("found") == terms).drop("found")


def best(hits: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Pages of a total order, so that they tile."""
    return hits.orderBy("score", "doc").offset(offset).limit(limit)


def in_scope(messages: DataFrame, query: Query, roles: list[str] | None = None, stemmed: bool = True) -> DataFrame:
    """Messages of the roles that satisfy the whole query on their own: (session_id, seq)."""
    own = messages if roles is None else messages.filter(F.col("role").isin(*roles))
    index = postings(own.withColumn("_doc", F.concat_ws("#m", "session_id", F.col("seq").cast("string"))), "_doc", F.col("content"), stemmed)
    found = matches(index, query, 1, 1.0).select(F.split("doc", "#m").alias("x"))
    return found.select(F.col("x")[0].alias("session_id"), F.col("x")[1].cast("int").alias("seq"))


def search_messages(messages: DataFrame, index: DataFrame, query: Query, n: int, mean: float, limit: int, stemmed: bool = True) -> DataFrame:
    """Messages of the best sessions, scored by statistics of those sessions' messages only: (session_id, seq, score)."""
    found = matches(index, query, n, mean).filter(~F.col("doc").startswith("memory:"))  # an index may hold memory entries too
    sessions = best(found, max(CANDIDATE_SESSIONS, 5 * limit)).select(F.col("doc").alias("session_id"))
    own = messages.join(F.broadcast(sessions), "session_id", "left_semi")  # a page of sessions at most
    local = postings(own.withColumn("_doc", F.concat_ws("#m", "session_id", F.col("seq").cast("string"))), "_doc", F.col("content"), stemmed)
    hits = best(matches(local, query, *statistics(local)), limit)
    return hits.select(F.split("doc", "#m")[0].alias("session_id"), F.split("doc", "#m")[1].cast("int").alias("seq"), "score").orderBy("score", "session_id", "seq")


def first_evidence(messages: DataFrame, hits: DataFrame, per_session: int) -> DataFrame:
    """The first matching messages of each session, by place."""
    own = hits.withColumn("r", F.row_number().over(Window.partitionBy("session_id").orderBy("seq"))).filter(F.col("r") <= per_session)
    return own.join(messages, ["session_id", "seq"]).select("session_id", "seq", "role", "r")


def keyword_score(words: list[str], keywords: Column, title: Column, text: Column) -> Column:
    """The plain scorer: 5 for a keyword, 10 for a word in the title, 2 for one in the text."""
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.array_contains(keywords, w), 5).otherwise(0) + F.when(F.lower(title).contains(w), 10).otherwise(0) + F.when(F.lower(text).contains(w), 2).otherwise(0)
    return total


def occurrences(rows: DataFrame, key: list[str], text: str, needle: str) -> DataFrame:
    """Non-overlapping occurrences, case folded: key, ordinal from 0, place (characters before it), by splitting."""
    parts = F.split(F.lower(text), r"\Q" + needle.lower() + r"\E", -1)
    sizes = F.transform(parts, lambda p: F.length(p))
    own = rows.select(*key, sizes.alias("sizes")).filter(F.size("sizes") > 1)
    each = own.select(*key, "sizes", F.explode(F.sequence(F.lit(1), F.size("sizes") - 1)).alias("k"))
    place = F.aggregate(F.slice("sizes", F.lit(1), F.col("k")), F.lit(0), lambda s, n: s + n) + (F.col("k") - 1) * len(needle)
    return each.select(*key, (F.col("k") - 1).alias("ordinal"), place.cast("int").alias("place"))


def found_in_session(rows: DataFrame, key: str, order: str, text: str, needle: str, per_page: int = 40, chars: int = 160, most: int = 200) -> DataFrame:
    """The first matches of a session's visible texts in order: (key, order, ordinal, place, page, snippet); page counts texts from 1, snippet is what stands around a match, with ellipses where it is cut."""
    own = occurrences(rows, [key, order, text], text, needle).withColumn("n", F.length(text))
    start = F.greatest(F.lit(0), F.col("place") - max(0, (chars - len(needle)) // 2))
    end = F.least(F.col("n"), start + chars)
    start = F.when((end - start < chars) & (start > 0), F.greatest(F.lit(0), end - chars)).otherwise(start)
    cut = F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.col("n"), "…").otherwise(""))
    own = own.select(key, order, "ordinal", "place", (F.floor(F.col(order) / per_page) + 1).cast("int").alias("page"), F.translate(cut, "<>", "").alias("snippet"))
    return own.orderBy(key, order, "place").limit(most)


def snippet(words: list[str], hits: set[int], size: int) -> str:
    """The window of so many words with most hits, hits in marks, cut ends as an ellipsis."""
    if len(words) <= size:
        start = 0
    else:
        start = max(range(len(words) - size + 1), key=lambda a: (sum(a <= h < a + size for h in hits), -a))
    out = " ".join(f"«{w}»" if i in hits else w for i, w in enumerate(words[start : start + size], start))
    return ("…" if start else "") + out + ("…" if start + size < len(words) else "")


def with_snippets(rows: DataFrame, text: str, query: Query, size: int = 24, stemmed: bool = True) -> DataFrame:
    """A page of rows with snippet: for the few rows that are shown, in Arrow batches."""
    terms = query.terms

    def cut(value: str | None) -> str:
        words = (value or "").split()
        return snippet(words, {i for i, w in enumerate(words) if any(t.startswith(q) for t in tokens(w, stemmed) for q in terms)}, size)

    return rows.withColumn("snippet", F.pandas_udf(lambda values: values.map(cut), "string")(F.col(text)))
