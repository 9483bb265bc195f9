"""Operator 7: extraction and rules against plain Python, the model on held-out hosts, defined cases."""

import re

from carthouse.llm import urls

SCHEMA = "page_id long, url string, host int, grams string"
URLS = [None, "foo", "", "HTTP://Ex.ORG", "a://b.example.org/es/?x", "://", "x://É.com/de/1#q?z", "http://a/b://c/d",
        "http://h?x/y", "https://example.org/en/1234", "https://notexample.org/es/", "https://sub.example.org/en/2",
        "http://x.com/fr/a", "http://x.com/de/a", "http://x.com/fra", "http://com/de/", "http://org", "http://a.test/" + "p" * 20_000]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules_equal_plain_python(spark):
    df = spark.createDataFrame([(i, u, 1, "g") for i, u in enumerate(URLS)] + [(None, URLS[3], None, None)], SCHEMA)
    got = urls.judge_urls(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path = parts(URLS[r.page_id if r.page_id is not None else 3])
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
        if not host and not path:
            assert r.verdict == "allow"


def test_the_model_tells_unseen_urls_apart(spark):
    bad = ["http://play-casino.invalid/now", "https://m.pills4you.invalid/order", "http://free-bets24.invalid/x",
           "https://www.adult-videos.invalid/1"]
    good = ["http://library.invalid/books", "https://www.garden.invalid/roses", "http://weather.invalid/today"]
    df = spark.createDataFrame([(i, u, None, None) for i, u in enumerate(bad + good)], SCHEMA)
    got = {r.page_id: r.verdict for r in urls.judge_urls(df).collect()}
    assert [got[i] for i in range(len(bad + good))] == ["block"] * len(bad) + ["allow"] * len(good)


def test_empty_table_and_no_python_in_the_plan(spark):
    df = urls.judge_urls(spark.createDataFrame([], SCHEMA))
    assert df.count() == 0
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
