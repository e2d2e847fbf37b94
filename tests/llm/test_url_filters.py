import re

import numpy as np
from pyspark.sql import functions as F

from sparkintel.llm.rows import join_skewed
from sparkintel.llm.staging import Staged
from sparkintel.llm.url_filters import RULES, judge_urls, personal_ranks

URLS = [
    None, "", "no scheme", "http://a.example.net/en/1", "HTTPS://WWW.Example.NET/en", "http://x.net", "http://x.net/", "http://x.net?y=/en/", "http://example.com/de/1#a", "http://m.example.com/DE/", "http://org/fr/", "http://ä.Org/fr/?q://z",
    "http://notexample.net/en/", "://", "http://://b.net/", "ftp://good.org/a", "http://farm.example.com/x", "http://farm.example.com/de/x", "http://hub.example.org/fr/x", "http://hub.example.org/x",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_against_brute_force(spark):
    html = '<a href="http://other.example.info/x">x</a> <a href=/local>y</a>'
    data = [(k, u, html if k % 2 else None, "clash") for k, u in enumerate(URLS)] + [(3, URLS[3], html, "clash")]
    got = judge_urls(spark.createDataFrame(data, "page_id long, url string, html string, host string").repartition(3)).collect()
    assert len(got) == len(data)
    for r in got:
        host, path = parts(URLS[r["page_id"]])
        name, verdict = rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, name)
        assert r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    data = [(1, "http://seed.org/fr/1", link("friend.info")), (2, "http://bad.net/1", link("friend.info")), (3, "http://friend.info/1", link("seed.org")), (4, "http://feeder.info/1", link("bad.net", "bad.net")), (5, "http://alone.info/1", None)]
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert {k: r["verdict"] for k, r in got.items()} == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow"}
    assert got[3]["trust"] > 0 and got[4]["distrust"] > 0 and got[5]["trust"] == got[5]["distrust"] == 0


def test_all_that_hangs_on_a_blocked_domain_is_blocked(spark):
    """Ten subdomains of a blocked one go with it, whatever the number of other blocked hosts; those of a trusted one stay, and so do strangers."""
    for others in (0, 3, 60):
        data = [(0, "http://bad.example.com/de/1", None), (1, "http://good.org/fr/1", None)]
        data += [(10 + k, f"http://s{k}.bad.example.com/x", None) for k in range(10)] + [(30 + k, f"http://s{k}.good.org/x", None) for k in range(10)]
        data += [(50 + k, f"http://stranger{k}.info/x", '<a href="http://stranger0.info/">x</a>') for k in range(10)] + [(100 + k, f"http://other{k}.net/x", None) for k in range(others)]
        got = {r["page_id"]: r["verdict"] for r in judge_urls(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
        assert {got[10 + k] for k in range(10)} == {"block"} and {got[30 + k] for k in range(10)} == {got[50 + k] for k in range(10)} == {"allow"}


def test_a_trickle_blocks_nobody(spark):
    """A directory that links to very many hosts, one of them blocked, passes; hosts that link to little else do not."""
    link = lambda h: f'<a href="http://{h}/">x</a>'
    data = [(0, "http://bad.net/x", None), (1, "http://directory.info/x", "".join(link(f"stranger{k}.info") for k in range(60)) + link("bad.net"))]
    data += [(10 + k, f"http://farm{k}.info/x", link("bad.net") * 50 + link("stranger1.info")) for k in range(9)] + [(100 + k, f"http://stranger{k}.info/x", None) for k in range(60)]
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert {got[10 + k]["verdict"] for k in range(9)} == {"block"} and got[1]["verdict"] == "allow" and 0 < got[1]["distrust"] < got[10]["distrust"]
    assert {got[100 + k]["verdict"] for k in range(60)} == {"allow"}


def test_ranks_against_the_linear_system(spark):
    rng = np.random.default_rng(3)
    edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, 12, (40, 2)) if a != b and a < 10})
    frame = spark.createDataFrame([("k", str(a), str(b), float(1 + (a + b) % 3)) for a, b in edges], "kind string, src string, dst string, weight double")
    seeds = spark.createDataFrame([("k", "0", 0.25), ("k", "3", 0.75)], "kind string, host string, share double")
    got = {int(r["host"]): r["rank"] for r in personal_ranks(frame, seeds, Staged(spark, "t"), steps=60).collect()}
    p = np.zeros((12, 12))
    for a, b in edges:
        p[a, b] = 1 + (a + b) % 3
    p /= np.maximum(p.sum(1, keepdims=True), 1)
    s = np.zeros(12)
    s[0], s[3] = 0.25, 0.75
    want = np.linalg.solve(np.eye(12) - 0.85 * p.T, 0.15 * s)
    want /= want.sum()
    assert np.allclose([got.get(k, 0) for k in range(12)], want, atol=2e-3)


def test_empty(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert judge_urls(spark.createDataFrame([(1, None, None)], "page_id long, url string, html string")).select(F.col("verdict")).first()[0] == "allow"


def test_one_host_with_most_pages(spark):
    data = [(k, "http://hot.net/x" if k % 3 else f"http://h{k}.info/x", None) for k in range(900)] + [(1000, None, None)]
    got = judge_urls(spark.createDataFrame(data, "page_id long, url string, html string").repartition(5)).collect()
    assert len(got) == 901 and {r["verdict"] for r in got if r["host"] == "hot.net"} == {"block"} and {r["verdict"] for r in got if r["host"] != "hot.net"} == {"allow"}


def test_join_skewed(spark):
    rows = [(1, k) for k in range(5000)] + [(k, k) for k in range(2, 900)] + [(None, 7)]
    left, facts = spark.createDataFrame(rows, "key long, v long").repartition(7), spark.createDataFrame([(k, f"f{k}") for k in range(0, 500)], "key long, fact string")
    got = sorted((tuple(r) for r in join_skewed(left, facts, "key").select("key", "v", "fact").collect()), key=str)
    assert got == sorted(((k, v, f"f{k}" if k is not None and k < 500 else None) for k, v in rows), key=str)


def test_a_blocked_path_leaves_its_hosts_alone(spark):
    """Hosts of which one path of several is blocked keep their other urls, unlike one that is blocked nearly whole, and what links there."""
    data, n = [], 0
    for k in range(12):
        for path in ("de/a", "en/a", "en/b", "about"):
            data.append((n := n + 1, f"http://h{k}.example.com/{path}", None))
    data += [(1000 + k, f"http://dark.example.org/bad/{k}", None) for k in range(40)] + [(1100, "http://dark.example.org/rest", None)]
    data += [(1200 + k, f"http://friend{k}.info/x", '<a href="http://dark.example.org/bad/1">x</a>' * 5) for k in range(4)]
    rules = [("block", "example.com", "/de/"), ("block", "example.org", "/bad/")]
    got = judge_urls(spark.createDataFrame(data, "page_id long, url string, html string"), rules=rules).collect()
    assert {r["verdict"] for r in got if r["host"].endswith("example.com") and r["rule"] is None} == {"allow"}
    assert {r["verdict"] for r in got if r["rule"]} == {"block"}
    assert {r["verdict"] for r in got if r["page_id"] >= 1100} == {"block"}


def test_very_long_html(spark):
    """A page of very many links, the only one to a blocked host, and one of no link in very much text."""
    links = "".join(f'<a href="http://far{k % 40}.info/{k}">x</a>' for k in range(20_000)) + '<a href="http://bad.net/">x</a>'
    data = [(0, "http://long.info/", links), (1, "http://plain.info/", "word " * 400_000), (2, "http://bad.net/x", None)]
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert len(got) == 3 and [got[k]["verdict"] for k in (1, 2)] == ["allow", "block"] and 0 < got[0]["distrust"] and got[1]["distrust"] == 0
