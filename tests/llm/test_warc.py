import gzip
import hashlib
import heapq
import io
import random

import pytest

from tesserae.llm import warc
from tesserae.llm.common import new_path
from tesserae.llm.queries import oracle_sql, queries

from . import cases

FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, offset int")


def expected(data):
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, _, html in data:
        h = html or ""
        first[h] = min(first.get(h, i), i, key=order)
    out = []
    for i, _, html in data:
        b = (html or "").encode()
        again = len(b) >= 100 and order(i) > order(first[html or ""])
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return out


def pages():
    rng = random.Random(0)
    same = "é" * 50
    data = [(i, rng.choice([f"http://www.A{i % 7}.example.org/x?{i}#f", "https://b.net", None, "", "no scheme", "http://x.org/a\r\nWARC-Type: revisit"]), rng.choice([same, same[:-1], "small", None, "", f"own {i} " * 40, "\r\n\r\nWARC/1.1\r\n" * 20])) for i in range(150)]
    return data + [data[3], data[3], (None, "http://z.org/", same), (None, "http://z.org/", "null " * 30), (7000, "http://big.org/", "x" * 3_000_000)]


def test_fixture(spark):
    data = pages()
    cases.same(warc.archive(frame(spark, data)).select(*FIELDS), expected(data))


def test_order_and_round_trip(spark):
    data = [r for r in pages() if r[0] is not None]
    path = new_path(spark, "warc-test")
    manifest = warc.write_archives(frame(spark, data).repartition(5), path, file_bytes=2000)
    assert manifest.count() > 5
    got = warc.read_archives(manifest, payloads=True)
    html = {}
    for r in got.where("record_type = 'response'").collect():
        html[r.page_id] = bytes(r.html)
    for r in got.collect():
        want = next(h for i, _, h in data if i == r.page_id) or ""
        assert html[r.refers_to if r.refers_to is not None else r.page_id] == want.encode()
    merged = warc.merge_index(warc.read_archives(manifest)).collect()
    keys = [(r.url_key, r.captured, r.page_id) for r in merged]
    assert keys == sorted(keys) and len(keys) == len(data)
    for r in merged[:40]:
        with open(r.run, "rb") as f:
            f.seek(r.offset)
            text = gzip.decompress(f.read(r.length)).decode("utf-8", "replace")
        assert f"WARC-Record-ID: <urn:page:{r.page_id}>" in text


def test_ranges_are_merged_in_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_A_RANGE", 20)
    data = [(i, f"http://h{i % 3}.org/{i % 5}", "x") for i in range(200)]
    manifest = warc.write_archives(frame(spark, data).repartition(6), file_bytes=300)
    merged = warc.merge_index(warc.read_archives(manifest))
    assert merged.rdd.getNumPartitions() > 3
    keys = [(r.url_key, r.captured, r.page_id) for r in merged.collect()]
    assert keys == sorted(keys)


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs))


def test_reader_refuses_damage():
    good = warc.record(1, "http://a.org/", b"payload", None, hashlib.sha256(b"payload").hexdigest())
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload\r\n\r\n", b"Payload\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.parse(good[:-3])
    data = gzip.compress(good) + gzip.compress(good)
    assert [x[2] for x in warc.members(io.BytesIO(data).read, 7)] == [good, good]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-5]).read, 64))


def test_url_keys():
    assert warc.url_key("http://www.Example.org:80/A?b#c") == "org:80,example)/a?b"
    assert warc.url_key("https://b.net") == "net,b)/" and warc.url_key(None) == ""


def test_table_and_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE VIEW pages AS SELECT * FROM read_parquet('/root/testdata/sf0.01/pages.parquet')")
    got = queries()["op9_warc"](spark, "/root/testdata/sf0.01")
    assert got.columns == FIELDS
    cases.same(got, con.execute(f"SELECT {', '.join(FIELDS)} FROM ({oracle_sql()['op9_warc']})").fetchall())


def test_a_very_long_page_and_odd_columns(spark):
    long = "<p>é</p>" * 1_500_000
    pages = spark.createDataFrame([(5, "http://a.org/", long, "x"), (3, "http://a.org/", long, "y"), (None, None, None, "z")], "page_id long, url string, html string, digest string")
    rows = {r.page_id: r for r in warc.archive(pages).collect()}
    assert rows[3].record_type == "response" and rows[5].record_type == "revisit" and rows[5].refers_to == 3
    assert rows[5].payload_bytes == len(long.encode()) and rows[None].payload_bytes == 0


def test_empty(spark):
    assert warc.archive(frame(spark, [])).count() == 0
