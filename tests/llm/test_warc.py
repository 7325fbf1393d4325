import base64
import gzip
import hashlib
import os

import duckdb

from seqloom.llm import warc as op

PAGES = [(1, "http://a/", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (2, "http://b/", "same"), (3, None, "same"), (4, "http://c/", None), (5, "http://d/\r\nx: y", ""), (6, "http://e/", "x" * 200_000), (0, "http://f/", "same"), (7, "http://g/", "\r\n\r\n"), (8, "http://h/", "trail\r\n\r\n")]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "clash", b"z") for r in rows], "page_id long, url string, html string, digest string, payload binary")


def plain(rows, least=0):
    first = {}
    for i, _, html in sorted(rows):
        first.setdefault(html or "", i)
    out = {}
    for i, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= least and first[html or ""] < i
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first[html or ""] if again else None)
    return out


def flat(df):
    return {r["page_id"]: tuple(r)[1:] for r in df.collect()}


def test_round_trip(spark):
    nested = op.round_trip(pages(spark))
    assert flat(op.resolved(nested)) == plain(PAGES)
    rows = nested.collect()
    html = {i: (h or "").encode() for i, _, h in PAGES}
    assert len(rows) == len(PAGES)
    for r in rows:
        i = int(r["metadata"]["fields"]["page-id"])
        assert r["request"]["target"] == r["reply"]["target"]
        assert r["reply"]["payload"] == (html[i] if r["reply"]["type"] == "response" else None)
        if r["reply"]["type"] == "revisit":
            assert r["reply"]["refers_to_target"] == {"same": "http://f/", "": "http://c/"}[html[i].decode()]


def test_small_payloads_stay_responses(spark):
    assert flat(op.resolved(op.round_trip(pages(spark), min_bytes=4, payloads=False))) == plain(PAGES, 4)


def test_many_repeated_payloads_are_joined(spark, monkeypatch):
    monkeypatch.setattr(op, "BROADCAST_ROWS", 0)
    assert flat(op.resolved(op.round_trip(pages(spark), payloads=False))) == plain(PAGES)


def test_archives_are_gzip_members_of_bounded_size(spark, tmp_path):
    rows = [(i, f"http://a/{i}", os.urandom(30).hex() * 5) for i in range(40)]
    op.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w"), file_bytes=4000)
    files = [p.read_bytes() for p in (tmp_path / "w").glob("part-*")]
    assert len(files) > 3 and all(len(f) < 6000 for f in files)
    # a plain gzip reader sees the same records
    assert sum(gzip.decompress(f).count(b"WARC-Type: response\r\n") for f in files) == 40
    assert all(len(list(op.parse(f))) == sum(1 for m in op.members(f) if m) for f in files)


def test_parse_plain_and_gzip():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 6\r\n\r\n\r\n\r\n\r\n\r\n\r\n"
    for data in (record * 2, gzip.compress(record) * 2, gzip.compress(record * 2) + op.END_MEMBER):
        assert [(h["warc-type"], b) for h, b in op.parse(data)] == [("metadata", b"\r\n\r\n\r\n"[:6])] * 2


def test_empty(spark):
    assert op.resolved(op.round_trip(pages(spark, []), payloads=False)).count() == 0


def run(spark, rows, folder):
    pages(spark, rows).select("page_id", "url", "html").write.parquet(f"{folder}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    want = con.execute(op.OP7_SQL)
    names = [d[0] for d in want.description]
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted((tuple(r) for r in op.op7_warc(spark, str(folder)).select(names).collect()), key=key), sorted(want.fetchall(), key=key)


def test_every_row_is_a_capture_as_in_sql(spark, tmp_path):
    rows = [(1, "http://a/", "one"), (1, "http://a/", "one"), (1, "http://other/", "one"), (1, "http://a/", "two"), (2, None, None), (2, None, None), (3, "x", ""), (9, "z", "one"), *PAGES[5:]]
    got, want = run(spark, rows, tmp_path)
    assert got == want and len(got) == len(rows)


def test_null_ids(spark, tmp_path):
    pages(spark, [(None, "http://b/", "three"), (None, "http://c/", "three"), (4, "http://b/", "four"), (None, "http://b/", "four")]).write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in op.op7_warc(spark, str(tmp_path)).select("payload_bytes", "record_type", "refers_to", "page_id").collect()), key=str)
    assert got == sorted([(5, "response", None, None), (5, "response", None, None), (4, "response", None, 4), (4, "revisit", 4, None)], key=str)
