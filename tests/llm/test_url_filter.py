"""URL rules against a plain matcher."""

import random
import re

import pytest

from lattica.llm.queries import URL_RULES
from lattica.llm.url_filter import GlobAutomaton, judge_urls


def plain(url, rules, default="allow"):
    rest = re.match(r"[^?#]*", url.split("://", 1)[1]).group() if url and "://" in url else ""
    host, path = re.match(r"(?s)([^/]*)(.*)", rest).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len((h + p).encode()), len(h), -k) for k, (_, h, p) in enumerate(rules) if ("." + host).endswith("." + h) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    v, h, p = rules[-max(fits)[2]]
    return host, path, h + p, v


CASES = [
    None, "", "no scheme", "http://", "https://EXAMPLE.com", "https://example.com/", "https://example.com/en", "https://example.com/en/x", "http://www.example.com/en/1?q",
    "http://xexample.com/en/", "http://a.net/es/", "http://net/es/", "http://a.net/fr/x#y", "http://a.net/de/", "http://evil.net/x.com/", "http://a.org/.example.com/en/",
    "http://a.com?x=/en/", "http://a.com#/en/", "://com/", "x://y://com/", "http://éxample.COM/en/", "http://com", "http://.com/", "http://a.com/\nnew", "http://a.com/" + "x" * 50_000,
]


def test_cases_and_rows(spark):
    rows = [(k, u, "host") for k, u in enumerate(CASES)] + [(None, "http://a.com/", "h"), (1, "http://a.com/", "h")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string")
    got = sorted(map(tuple, judge_urls(pages, URL_RULES).collect()), key=str)
    assert got == sorted([(k, *plain(u, URL_RULES)) for k, u, _ in rows], key=str)
    assert judge_urls(pages.limit(0), URL_RULES).collect() == []


def test_many_rules_over_several_words():
    rnd = random.Random(3)
    hosts, paths = ["a.b", "b", "c.a.b", "ab", "a"], ["/", "/x/", "/x/y", "/y"]
    rules = [(rnd.choice(["allow", "block"]), h, p) for h in hosts for p in paths]
    urls = [rnd.choice(["", "z.", "c.", "a."]) + rnd.choice(hosts) + rnd.choice(["", "/", "/x", "/x/", "/x/y/z", "/y/a.b/x/"]) for _ in range(3000)]
    a = GlobAutomaton(rules)
    assert a.words > 1
    got = a.match([("." + u).encode() for u in urls])
    for u, r in zip(urls, got):
        want = plain("s://" + u, rules)[2]
        assert (rules[r][1] + rules[r][2] if r >= 0 else None) == want, u


@pytest.mark.parametrize("rule", [("deny", "a", "/"), ("allow", "a/b", "/"), ("allow", "", "/"), ("allow", "a", "x")])
def test_wrong_rules_are_refused(rule):
    with pytest.raises(ValueError):
        GlobAutomaton([rule])
