"""Every query with SQL against DuckDB at the smallest size; those without run."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from heddle.plans import kept_queries, restated_queries, rule_queries, session_queries, source_queries, text_queries  # noqa: F401
from heddle.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, decimal.Decimal):
        return f"{float(x):.9g}"
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted([plain(r[c]) for c in cols] for r in df.collect())
    if name in SQL:
        result = duck.execute(SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == cols
        assert got == sorted([plain(r[names.index(c)]) for c in cols] for r in result.fetchall())


def test_injected_display_covers_all_rows_and_rules(spark, duck):
    rows = QUERIES["C26_Y05_injected_display"](spark, DIR).collect()
    seen = {(r.source, r.id, r.turn) for r in rows}
    turns, events = duck.execute("select (select count(*) from conversations), (select count(*) from events)").fetchall()[0]
    assert len(seen) == turns + events and len(rows) == turns * len(restated_queries.INJECTED_FORMS) + events
    labels = {"", "Hook feedback", "Task notification", "System reminder", "Local command", "System context", "AGENTS instructions", "System prompt", "Skill loaded: user"}
    for source in ("turn", "event"):
        own = [r for r in rows if r.source == source]
        assert {r.kind for r in own} == {"prompt", "slash_prompt", "event"} and {r.switched_off for r in own} == {"prompt"}
        assert labels - {r.label for r in own} <= ({"Skill loaded: user"} if source == "event" else set())
        assert {r.form for r in own} == set(range(len(restated_queries.INJECTED_FORMS)))


def test_displayed_of_odd_texts(spark, tmp_path):
    odd = [None, "", " ", "\n", "\n\n\n", "\r\n \r", " x ", "a b\n\nc\r\nd\re", "\ta\t", "a\x0b", "\x0ba\x0b b", "\x0b", "a\x0c b\x0c", "a \u2028", "a\n\u2028\n", " a \u0085 ", "\u0085", "\u2028", "a\u00a0", "a\x1c", "$1 \\1 `b` <c>", "\n```\n\n</details>"]
    lengths = [0, 1, 2, 4, 11]
    rows = [(i * 100 + k, t, k) for i, t in enumerate(odd) for k in lengths]
    doc_id, text, n_chars = zip(*rows, strict=True)
    columns = {"doc_id": pa.array(doc_id, pa.int64()), "text": pa.array(text, pa.string()), "lang": ["en"] * len(rows), "source": ["s"] * len(rows), "n_chars": pa.array(n_chars, pa.int64())}
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p if 'documents' not in p else tmp_path / 'documents.parquet'}'")
    got = {r.doc_id: r.shown for r in QUERIES["P10_displayed"](spark, str(tmp_path)).collect()}
    want = dict(con.execute(SQL["P10_displayed"]).fetchall())
    assert len(want) == len(rows) and [(t, k) for i, t, k in rows if got[i] != want[i]] == []
