import ipaddress
import re

from pyspark.sql import functions as F

from sparkintel.functions.addresses import RESERVED, canonical_ip, extract_ips, extract_ips_loose, extract_loose, order_key

MIXED = "5.5.5.5:8080 [2606:4700::1111]:443 fe80::a%wlan1 198.51.100.9 z7.7.7.7q 2606:4700::64"


def ips(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return sorted(r["ip"] for r in extract_ips(df, F.col("text"), F.col("id"), v6=True).collect())


def test_strict_dialect(spark):
    assert ips(spark, MIXED) == sorted(["5.5.5.5", "2606:4700::64", "2606:4700::1111", "fe80::a"])
    assert ips(spark, "8.8.8.8. x8.8.8.8 8.8.8.8:0 8.8.8.8:65536 [8.8.8.8] 01.1.1.1 1.1.1") == []
    assert ips(spark, "8.8.8.8] 9.9.9.9:65535/ " + "A" * 120 + "1.2.3.4") == ["8.8.8.8", "9.9.9.9"]
    assert ips(spark, "fe80::1%eth0/64 [::1]:99999 1::2::3") == []


def test_order_of_tokens_does_not_matter(spark):
    parts = MIXED.split()
    for k in range(len(parts)):
        assert len(ips(spark, " ".join(parts[k:] + parts[:k]))) == 4


def loose(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(extract_ips_loose(F.col("t")).alias("x")).first()["x"]


def test_loose_dialect(spark):
    got = loose(spark, "seen at 5.6.7.8, in ab5.5.5.5cd, ftp://6.6.6.6:21/x and [fe80::2]:80 or " + "Z" * 90 + " 7.8.9.1. _4.4.4.4 4.4.4.4_")
    assert got == ["5.6.7.8", "6.6.6.6", "7.8.9.1"]


def test_one_pass_over_tokens(spark):
    """Patterns are tried once for each token, and Python is asked once."""
    df = spark.createDataFrame([(1, MIXED)], "id long, text string")
    plan = extract_ips(df, F.col("text"), F.col("id"), v6=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("RLIKE") <= 12


def test_reserved_networks(spark):
    one_of_each = " ".join(n.split("/")[0].replace(".0/", ".1/") for n in RESERVED)
    assert loose(spark, f"{one_of_each} 8.8.8.8") == ["8.8.8.8"]
    assert len(RESERVED) == 17


def test_canonical_forms_and_order(spark):
    values = ["192.0.2.1", "[2001:DB8::1]", "fe80::1%eth0", "999.1.1.1", "::ffff:1.2.3.4", None, "x"]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    got = {r["k"]: r["c"] for r in df.select("k", canonical_ip(F.col("v")).alias("c")).collect()}
    assert [got[k] for k in range(7)] == ["192.0.2.1", "2001:db8::1", "fe80::1", None, "::ffff:1.2.3.4", None, None]
    ordered = spark.createDataFrame([(v,) for v in ("10.0.0.1", "9.0.0.1", "2001:db8::1", "::2")], "v string").orderBy(order_key(F.col("v")))
    assert [r["v"] for r in ordered.collect()] == ["9.0.0.1", "10.0.0.1", "::2", "2001:db8::1"]


def test_loose_dialect_of_both_versions(spark):
    """Against the tokens one by one."""
    texts = ["a 2606:4700::64, [2606:4700::1111]:443 fe80::b%wlan1 x::y ::1", "8.8.8.8 10.0.0.1 1::2::3 12:30:59 2606:4700::64%", "no address", None, "v::6 2001:DB8:0:0::7 ::ffff:9.9.9.9 aa:bb:cc:dd:ee:ff:00:11"]
    want = set()
    for k, text in enumerate(texts):
        for token in re.findall(r"[A-Za-z0-9_.:%-]+", text or ""):
            found = re.findall(r"(?<![A-Za-z0-9_])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![A-Za-z0-9_])", token) + ([re.sub(r"%[A-Za-z0-9._-]+$", "", token)] if token.count(":") > 1 else [])
            for one in found:
                try:
                    ip = ipaddress.ip_address(one)
                except ValueError:
                    continue
                if ip.version == 6 or not any(ip in ipaddress.ip_network(n) for n in RESERVED):
                    want.add((k, str(ip)))
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    assert {tuple(r) for r in extract_loose(df, F.col("text"), F.col("k")).collect()} == want
