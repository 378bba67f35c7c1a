import gzip
import hashlib
import random

from heddle.llm import warc
from heddle.llm.warc import LoserTree, archive, records_of, url_key

PAGE = "page_id long, url string, html string, run string, payload int"


def brute(rows):
    payloads = [(h or "").encode() for _, _, h, *_ in rows]
    out = []
    for (i, *_), p in zip(rows, payloads, strict=True):
        same = sorted((r[0] is None, r[0] or 0) for r, q in zip(rows, payloads, strict=True) if q == p)
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), same if len(p) >= 100 and len(same) > 1 else None))
    return out


def test_round_trip(spark, tmp_path):
    rng = random.Random(1)
    bodies = ["x" * 99, "y" * 100, "é" * 60, "", None, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 5, "long " * 9000] + [f"<p>{i}</p>" * 30 for i in range(8)]
    urls = ["http://www.B.com/x?b=1&a=2", "https://a.org", None, "", "http://b.com:8080/\nq", "http://a.org/é", "::bad["]
    rows = [(i, rng.choice(urls), rng.choice(bodies), "r", 1) for i in range(300)] + [(None, None, bodies[-1], None, None)]
    rng.shuffle(rows)
    out = archive(spark.createDataFrame(rows, PAGE).repartition(5), str(tmp_path / "w")).collect()
    got = {r.page_id: r for r in out}
    assert len(out) == len(rows) and len(got) == len(rows)
    for i, n, digest, same in brute(rows):
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (n, digest)
        first = same[0][1] if same else i
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", first))
    keys = [(r.urlkey, r.ts, r.run, r.offset) for r in sorted(out, key=lambda r: (r.range_no, r.range_pos))]
    assert keys == sorted(keys)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-")]
    assert sum(len(list(records_of(gzip.decompress(p.read_bytes())))) for p in files) == len(rows)


def records(path):
    return [(fields, bytes(block)) for p in path.iterdir() if p.name.startswith("part-") for _, _, fields, block in records_of(gzip.decompress(p.read_bytes()))]


def test_revisits_name_a_record(spark, tmp_path, monkeypatch):
    for share, folder in ((1 / 1000, "hot"), (2.0, "cold")):
        monkeypatch.setattr(warc, "COMMON", share)
        rows = [(i, f"u{i}", "x" * (100 + i % 4), "", 0) for i in range(40)] + [(99, "u", "short", "", 0)]
        archive(spark.createDataFrame(rows, PAGE).repartition(3), str(tmp_path / folder)).collect()
        found = records(tmp_path / folder)
        ids = [f["warc-record-id"] for f, _ in found]
        responses = {f["warc-record-id"] for f, _ in found if f["warc-type"] == "response"}
        assert len(set(ids)) == len(rows) and len(responses) == 5
        assert {f["warc-refers-to"] for f, _ in found if f["warc-type"] == "revisit"} <= responses


def test_many_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 20)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 9000)
    rows = [(i, f"http://h{i % 17}.org/{i % 5}", "y" * (i * 37 % 900), "", 0) for i in range(300)]
    out = archive(spark.createDataFrame(rows, PAGE).repartition(4), str(tmp_path / "w")).collect()
    assert len({r.range_no for r in out}) > 8 and len({r.run for r in out}) > 8
    keys = [(r.urlkey, r.ts, r.run, r.offset) for r in sorted(out, key=lambda r: (r.range_no, r.range_pos))]
    assert keys == sorted(keys) and len(keys) == 300


def test_repeated_rows_and_empty(spark):
    rows = [(4, "u", "z" * 200, "", 0)] * 6 + [(9, "u", "z" * 200, "", 0)]
    out = sorted((r.page_id, r.record_type, r.refers_to) for r in archive(spark.createDataFrame(rows, PAGE)).collect() if r.record_type == "revisit")
    assert out == [(9, "revisit", 4)]
    assert archive(spark.createDataFrame([], PAGE)).collect() == []


def test_loser_tree():
    rng = random.Random(2)
    for k in range(12):
        runs = [sorted(rng.choices(range(50), k=rng.randint(0, 20))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert url_key("http://www.Example.com:80/A?b=2&a=1") == "com,example)/a?a=1&b=2"
    assert url_key("https://x.org:8443") == "org,x:8443)/"
