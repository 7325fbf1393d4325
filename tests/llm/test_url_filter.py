from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import url_filter as op


def plain(url, rules=op.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else op.DEFAULT


URLS = [None, "", "no scheme", "http://", "https://COM/", "http://example.com/en/x?q#f", "http://www.example.com/en/", "http://a.b.www.example.com/en/1", "http://example.com", "http://xexample.com/en/", "http://net/es/1", "http://a.net/es", "http://a.net/fr/#/es/", "http://com./", "http://.com/", "ftp://ÀB.net/fr/x", "a://b://net/es/", "http://example.com:80/en/", "http://user@example.com/en/", "http://net/es/\n/x", "http://a!b.com/", "http://exa.mple.com/en/", "http://example!x.com/en/1", "http://example .com/en/1", "http://x !example.com/en/", "http://example\x01.com/en/", "http://a\U0010ffff.com/en/x", "http://\U0010ffff\U0010ffff.net/es/"]
PART = st.sampled_from(["com", "net", "www", "example", ".", "/", "en/", "es/", "fr/", "?", "#", "://", "http://", "x", "A", "!", "-", " ", "\x01", "\U0010ffff"])


def judged(spark, urls, rules=op.RULES):
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in op.judge(df, op.rules_table(spark, rules)).collect()}


def test_rules(spark):
    got = judged(spark, URLS)
    assert got == {i: plain(u) for i, u in enumerate(URLS)}


def test_random(spark):
    found = []

    @settings(max_examples=300, deadline=None, database=None)
    @given(st.lists(PART, max_size=9))
    def collect(parts):
        found.append("http://" + "".join(parts))

    collect()
    rules = (*op.RULES, ("a.com", "/", "block"), ("com", "/en/", "block"), ("x", "", "block"))
    assert judged(spark, found, rules) == {i: plain(u, rules) for i, u in enumerate(found)}


def test_ranges_of_a_hot_host(spark, monkeypatch):
    monkeypatch.setattr(op, "RANGE_ROWS", 50)
    urls = [f"http://hot.example.com/{('en', 'de')[i % 2]}/{i}" for i in range(700)] + [f"http://h{i}.net/es/{i}" for i in range(100)]
    assert judged(spark, urls) == {i: plain(u) for i, u in enumerate(urls)}


def test_one_url_of_a_third_of_the_rows_is_cut(spark, monkeypatch):
    monkeypatch.setattr(op, "RANGE_ROWS", 40)
    urls = ["http://www.example.com/en/"] * 200 + [None] * 100 + [f"http://h{i % 40}.example.com/en/{i}" for i in range(300)]
    assert judged(spark, urls) == {i: plain(u) for i, u in enumerate(urls)}
    keyed = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("url key", "xxhash64(page_id) mark")
    keyed = keyed.fillna("")
    splits = op._splits(keyed, 600, 15)
    assert len(splits) == 14 and sum(k == "http://www.example.com/en/" for k, _ in splits) >= 4


def test_null_and_repeated_page_ids(spark):
    df = spark.createDataFrame([(None, "http://example.com/en/"), (None, "http://example.com/en/"), (7, None), (7, "http://net/es/")], "page_id long, url string")
    got = sorted((tuple(r) for r in op.judge(df, op.rules_table(spark)).select("page_id", "rule", "verdict").collect()), key=str)
    assert got == [(7, "net/es/", "block"), (7, None, "allow"), (None, "example.com/en/", "block"), (None, "example.com/en/", "block")]


def test_empty(spark):
    assert judged(spark, []) == {}
