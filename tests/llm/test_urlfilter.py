"""URL filters: rule syntax, brute force over every rule, edge cases."""

import re

import pytest

from lexlab.llm import urlfilter as U
from tests.conftest import SF_SMALL


def brute(url):
    tail = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", tail).group()
    path = re.match(r"[^?#]*", tail[len(host):]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for h, p, verdict in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
                          ("com", "/fr/", "allow"), ("com", "/de/", "block")):
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or len(h + p) > len(best[0]):
                best = (h + p, verdict)
    return host, path, best


URLS = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "http://example.org", "http://notorg/x",
        "http://org/", "http://x.com/fr/1#a", "http://com/de/", "http://www.casino-win.example.com/en/1.html",
        "http://m.casino-win.example.com/fr/1", "ftp://b.net?x=/fr/", "no scheme", "", None, "a://b://c.org/x",
        "http://free-bets.example.net/x", "http://ex.com/\u00fc/fr/", "http://x.com/de/\nz"]


def test_contract_rules_and_edges(spark):
    rows = [(i, u, "clash", "clash") for i, u in enumerate(URLS + URLS[:3])] + [(0, URLS[0], "c", "c"), (None, None, "c", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = U.judge_urls(df).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    for i, u in enumerate(URLS):
        host, path, best = brute(u)
        r = by_id[i]
        assert (r["host"], r["path"]) == (host, path), u
        assert r["rule"] == (best and best[0]), u
        if best:
            assert r["verdict"] == best[1]
    assert by_id[7]["verdict"] == "block" and by_id[7]["rule"] is None
    assert by_id[8]["verdict"] == "allow" and by_id[8]["rule"] == "com/fr/"
    assert by_id[14]["verdict"] == "block" and by_id[9]["verdict"] == "allow"


def test_empty_table_and_no_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert U.judge_urls(df).count() == 0
    one = spark.createDataFrame([(1, "http://casino-win.org/x")], "page_id long, url string")
    r = U.judge_urls(one, (), ()).collect()[0]
    assert (r["rule"], r["verdict"], r["pattern"]) == (None, "allow", None)
    assert U.judge_urls(one).collect()[0]["rule"] == "org/"


def test_literal_tokens_are_required():
    assert U.literal_tokens(U.listed("block", "example.org", "/en/1")) == ["en", "example", "org"]
    assert U.literal_tokens(U.Rule("*ads*")) == []
    assert U.literal_tokens(U.Rule("||casino-win.*")) == ["casino", "win"]


@pytest.mark.parametrize("sf", [SF_SMALL])
def test_oracle(spark, sf):
    from lexlab.plans.compare import compare, duck_connect
    df = U.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"))
    res = compare(df, duck_connect(sf), U.oracle_sql())
    assert res["match"], res


def test_main_path_is_native(spark):
    plan = U.judge_urls(spark.read.parquet(f"{SF_SMALL}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_only_ascii_letters_fold(spark):
    urls = ["http://a.net/casino\u212a", "http://a.net/CASINO/x", "http://a.net/\u0130casino/", "http://a.net/casino"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(df).collect()}
    fits = [bool(re.search(U.to_regex(U.Rule("*^casino^*")), u.split("://")[1])) for u in urls]
    assert [got[i] == "block" for i in range(4)] == [True, False, True, True] == fits


def test_a_long_list_is_joined_and_not_in_the_plan(spark):
    rules = [U.Rule(f"||host{i}.net/p{i}^", "block", f"rule {i}") for i in range(50_000)]
    urls = [f"http://www.host{i}.net/p{i}/x" for i in range(0, 50_000, 997)] + ["http://host5.net/p6/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = U.judge_urls(df, (), rules)
    got = {r["page_id"]: (r["verdict"], r["pattern"]) for r in out.collect()}
    assert got == {**{i: ("block", f"rule {997 * i}") for i in range(len(urls) - 1)}, len(urls) - 1: ("allow", None)}
    assert "rule 49999" not in out._jdf.queryExecution().executedPlan().toString()
