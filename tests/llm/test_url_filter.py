from __future__ import annotations

import random

import pytest

from wiretide.llm import url_filter
from wiretide.llm.registry import URL_RULES
from wiretide.llm.url_filter import build_trie, filter_urls, match

URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http://a.net",
    "http://a.net/",
    "https://A.Example.NET/en/x?y#z",
    "http://example.net/en",
    "http://badexample.net/en/",
    "http://x.org/fr/",
    "http://org/fr/1",
    "http://x.example.com/de/?q=/",
    "x://y://z.net/a",
    "http://user@b.net:80/",
    "http://b.net?x=/",
    "http://É.net/\nx",
    "http://a.net./",
]


def plain(url, rules):
    """Every rule tried on its own."""
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    tail = rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for verdict, rule in rules:
        r_host, slash, r_path = rule.partition("/")
        if (host == r_host or host.endswith("." + r_host)) and path.startswith(slash + r_path):
            rank = (r_host.count("."), len(slash + r_path), verdict == "block")
            best = max(best or (rank, rule, verdict), (rank, rule, verdict))
    return (host, path, best[1], best[2]) if best else (host, path, None, "allow")


@pytest.mark.parametrize("limit", [10**6, 0])
def test_awkward_urls(spark, monkeypatch, limit):
    monkeypatch.setattr(url_filter, "MAX_BROADCAST_RULES", limit)
    rows = [(i, u, "x", "h", "r") for i, u in enumerate([*URLS, *URLS])]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(table, URL_RULES).collect()}
    assert got == {i: plain(u, URL_RULES) for i, u, *_ in rows}
    assert filter_urls(table.limit(0), URL_RULES).count() == 0


def test_trie_against_every_rule():
    rng = random.Random(1)
    paths = ["", "/", "/a", "/a/", "/ab", "/a/b", "/a/b/", "//", "/a//b"]
    hosts = ["net", "b.net", "a.b.net", "c.net", "x"]
    for _ in range(300):
        rules = list({(rng.choice(["allow", "block"]), rng.choice(hosts) + rng.choice(paths)) for _ in range(6)})
        trie = build_trie(rules)
        for host in [*hosts, "q.a.b.net", "ab.net", ""]:
            for path in [*paths, "/abc/d", "/a/bc"]:
                assert match(trie, host, path) == plain(f"h://{host}{path}", rules)[2:], (rules, host, path)
