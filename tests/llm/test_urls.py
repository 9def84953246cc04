from __future__ import annotations

import random

from emberlog.llm import urls
from emberlog.llm.urls import RULE_SCHEMA, filter_urls

SCHEMA = "page_id bigint, url string, html string, Url string, part int, action string"


def pages(spark, found):
    return spark.createDataFrame([(i, u, "<p>", "x", 9, "block") for i, u in found], SCHEMA)


def key(url):
    if url is None or "://" not in url:
        return None
    rest = url.split("://", 1)[1].split("#")[0]
    cut = min([rest.find(c) for c in "/?" if c in rest] + [len(rest)])
    host, path = rest[:cut].split("@")[-1].split(":")[0].lower().rstrip("."), rest[cut:]
    return ",".join(reversed(host.split("."))) + ",)" + (path if path.startswith("/") else "/" + path) if host else None


def prefix(pattern):
    host, slash, path = pattern.partition("/")
    start = ",".join(reversed(host.lower().split("."))) + ","
    return start + ")" + slash + path if slash else start


def brute(found, rules):
    out = []
    for i, u in found:
        k = key(u)
        hit = sorted((len(prefix(p)), r, a) for r, p, a in rules if p and k is not None and k.startswith(prefix(p)))
        out.append((i, k, [r for _, r, _ in hit], hit[-1][2] if hit else None))
    return sorted(out, key=repr)


def got(spark, found, rules):
    rows = filter_urls(pages(spark, found), spark.createDataFrame(rules, RULE_SCHEMA)).collect()
    assert all(r.kept == (r.action != "block") for r in rows)
    return sorted([(r.page_id, r.key, list(r.rule_ids), r.action) for r in rows], key=repr)


def test_against_all_pairs(spark, monkeypatch):
    rng = random.Random(2)
    host = lambda n: ".".join(rng.choice(["a", "b", "ab", "c"]) for _ in range(n)) + rng.choice([".com", ".org"])
    found = [(i, f"{rng.choice(['http', 'https'])}://{host(rng.randint(0, 3)).lstrip('.')}{rng.choice(['', '/', '/a', '/a/b', '/ab?q=1', '?x', '#t', '/b#t'])}") for i in range(400)]
    rules = [(i, host(rng.randint(0, 2)).lstrip(".") + rng.choice(["", "", "/", "/a", "/a/"]), rng.choice(["allow", "block"])) for i in range(60)] + [(99, "com", "block")]
    want = brute(found, rules)
    assert got(spark, found, rules) == want
    # many parts: rules run over their bounds
    monkeypatch.setattr(urls, "PART_BYTES", 1)
    monkeypatch.setattr(urls, "parts_for", lambda df, n, projected: 23)
    assert got(spark, found, rules) == want


def test_odd_tables(spark):
    found = [(1, None), (2, ""), (3, "no url"), (None, "http://a.com/x"), (5, "HTTP://User@A.com.:80"), (5, "HTTP://User@A.com.:80"), (6, "http://a.com/" + "y" * 100_000), (7, "http://é.com/ü")]
    rules = [(1, "a.com", "block"), (2, None, "block"), (3, "", "block"), (4, "a.com/y", "allow"), (5, "a.com", "allow"), (None, "é.com", "block")]
    rows = got(spark, found, rules)
    assert [(r[0], r[2], r[3]) for r in rows] == sorted(
        [(1, [], None), (2, [], None), (3, [], None), (5, [1, 5], "allow"), (5, [1, 5], "allow"), (6, [1, 5, 4], "allow"), (7, [None], "block"), (None, [1, 5], "allow")], key=lambda r: repr((r[0],))
    )
    assert got(spark, [], rules) == [] and [r[2] for r in got(spark, found[3:5], [])] == [[], []]


def test_urls_without_a_scheme_or_with_blanks_around(spark):
    host = "adult-x.example.com"
    found = list(enumerate([f"{host}/a", f"//{host}/a", f" http://{host}/a", f"http://{host} \n", f"{host}", f"M.{host}.:80?b", "/a/b.c", "adult", f"bob@{host}", f"mailto:bob@{host}", f"see {host}", "javascript:x.y()", "//", " "]))
    rows = got(spark, found, [(1, host, "block"), (2, "c", "block"), (3, "adult", "block")])
    key = "com,example,adult-x,"
    keys = [f"{key})/a"] * 3 + [f"{key})/"] * 2 + [f"{key}m,)/?b"] + [None] * 8
    assert rows == sorted([(i, k, [1] if k else [], "block" if k else None) for i, k in enumerate(keys)], key=repr)
