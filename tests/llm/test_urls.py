import numpy as np
import pytest
import xxhash

from labelq.llm import urls as U

URLS = [None, "", "no scheme/net/", "http://foo.net/x", "http://foo.net", "https://A.EXAMPLE.NET/en/1?q=/x", "https://example.net/en", "https://example.net/EN/", "https://badexample.net/en/", "ftp://x.example.com/de/#f",
        "http://example.org/fr/", "http://org/fr/a", "http://net/", "://net/", "http://ÉX.NET/", "http://x.com/de/?u=http://y.net/", "http://a.net:80/", "http://.net/", "http://net.net?/", "http://x.net#/en/", "a://b://c.net/", "http://fr.org/fr/", "http://ok.com/"]


def judge(url, rules):
    host, path = U.split_url(url)
    best = None
    for rule, verdict in rules:
        h, _, p = rule.partition("/")
        p = "/" + p if "/" in rule else ""
        if host and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best[0] if best else None, best[1] if best else "allow"


def pages(spark, urls=URLS):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("page_id", "url", "'x' as host", "1 as rule", "2 as digest", "'<p>' as html")


@pytest.mark.parametrize("rules", [U.RULES, [], [*U.RULES, ("com", "block"), ("x.com/de/", "allow"), ("a.net:80/", "allow")]])
@pytest.mark.parametrize("way", ["array", "ranges", "frame"])
def test_against_every_rule(spark, rules, way, monkeypatch):
    if way == "ranges":
        monkeypatch.setattr(U, "BROADCAST_BYTES", 40)
    given = spark.createDataFrame(rules, "rule string, verdict string") if way == "frame" else rules
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages(spark), given).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(URLS)}


def test_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda b, *a: len(b) % 2)
    a = U.DigestArray(U.DigestArray.pack([("aa", True), ("bb", False), ("c", True), ("aa", False)]))
    found = a.find(["bb", "aa", "c", "d", "zz", ""])
    assert [a.text(i) if i >= 0 else None for i in found] == ["bb", "aa", "c", None, None, None]
    assert bool(a.blocked[found[1]]) and not a.blocked[found[0]]


def test_large_array():
    keys = [f"site{i}.example/{i % 7}/" for i in range(5000)]
    a = U._mapped(U.DigestArray.pack([(k, i % 2 == 0) for i, k in enumerate(keys)]))
    assert (np.diff(a.keys.astype(object)) > 0).all() and [a.text(i) for i in a.find(keys)] == keys and (a.find(["nope", "site1"]) == -1).all()


def test_empty_and_repeated(spark):
    assert U.judge_urls(pages(spark).limit(0), U.RULES).count() == 0
    two = spark.createDataFrame([(1, "http://a.net/"), (1, "http://a.net/"), (None, None)], "page_id long, url string")
    assert sorted((r.page_id or 0, r.verdict) for r in U.judge_urls(two, U.RULES).collect()) == [(0, "allow"), (1, "block"), (1, "block")]


@pytest.mark.parametrize("bound", [1 << 20, 40])
def test_rules_listed_twice_and_clashing(spark, bound, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_BYTES", bound)
    for rules in ([("net/", "block"), ("net/", "allow")], [("net/", "allow"), ("net/", "block"), ("net/", "allow")]):
        got = {r.page_id: r.verdict for r in U.judge_urls(pages(spark, ["http://a.net/", "http://a.com/"]), rules).collect()}
        assert got == {0: "block", 1: "allow"}


def test_many_rules_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(U, "BROADCAST_BYTES", 2000)
    rules = [(f"site{i}.example/{'abc'[i % 3]}/", ("block", "allow")[i % 2]) for i in range(400)] + [("example/", "allow")]
    urls = [f"http://www.site{i % 450}.example/{'abcd'[i % 4]}/x" for i in range(900)] + ["http://other.example/"] * 300
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages(spark, urls), rules).collect()}
    assert got == {i: judge(u, rules) for i, u in enumerate(urls)}
