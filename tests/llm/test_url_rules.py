import re

from contextmill.llm.url_rules import RULES, RuleIndex, domain_rule, filter_urls, glob_rule

from .helpers import clashing

URLS = [None, "", "no scheme", "http://", "https://A.Net/x", "http://net/", "http://net", "http://sub.example.NET/en/1?q=a#b", "http://example.net/EN/1", "http://xexample.net/en/1",
        "http://notnet/", "a://b://c.net/", "http://example.com/de/1", "http://m.example.com/de", "http://x.org/fr/", "http://x.org/en/#/fr/", "http://x.org?u=/fr/",
        "http://adult-x.example.com/en/1", "http://www.adult-x.example.net/en/1", "http://m.ads-track.example.com/", "http://x.com/ads-tracker", "http://user@h:80/p",
        "HTTP://É.net/é", "http://a.com/" + "x" * 100_000, "http://a.com/\nnet/"]


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [(len(n), n, a) for n, a in (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
            if (host == n.split("/")[0] or host.endswith("." + n.split("/")[0])) and path.startswith(n[n.index("/"):])]
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    low = (host + path).lower()
    bad = re.search(r"(?:^|[^0-9a-z_-])(?:adult-x|spam-farm|cheap-pills|casino-win|free-bets)\.", low) or "ads-track" in low
    return host, path, None, "block" if bad else "allow"


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(3, URLS[3]), (None, URLS[5])], "page_id long, url string")
    got = sorted(((r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in filter_urls(clashing(pages), RULES).collect()), key=repr)
    assert got == sorted([(i, brute(u)) for i, u in enumerate(URLS)] + [(3, brute(URLS[3])), (None, brute(URLS[5]))], key=repr)


def test_empty_table(spark):
    assert filter_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def test_rarest_literal_and_rules_without_one():
    rules = [domain_rule("example.net/en/", "allow"), glob_rule("*x*", "block"), domain_rule("net/pre", "block")]
    index = RuleIndex(rules, {"example": 90, "net": 50, "en": 20})
    assert set(index.by_token) == {"en", "net"} and len(index.always) == 1
    assert index.judge("a.net/prefix")[0] == "net/pre"
    assert index.judge("b.org/x") == (None, None, "block")


def test_longest_wins_and_ties_go_by_name():
    index = RuleIndex([domain_rule("b.net/", "allow"), domain_rule("net/", "block"), domain_rule("b.net/a", "block"), domain_rule("b.net/b", "allow")], {})
    assert index.judge("x.b.net/z")[:2] == ("b.net/", "allow")
    assert index.judge("b.net/ab")[:2] == ("b.net/a", "block")
