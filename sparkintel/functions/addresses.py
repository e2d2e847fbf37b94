"""IP addresses in text: two token dialects, canonical forms, order keys and reserved networks."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Networks whose addresses are not actionable, and limits of a token.
RESERVED = (
    "0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.88.99.0/24 "
    "192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 233.252.0.0/24 240.0.0.0/4 255.255.255.255/32"
).split()
LONGEST_TOKEN = 110
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def is_v4(c: Column) -> Column:
    """Four octets without leading zeros."""
    return c.rlike(f"^{V4}$")


def ip_number(c: Column) -> Column:
    """The value of a v4 address, null for others."""
    return F.when(is_v4(c), F.aggregate(F.split(c, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long")))


def _compressed(values: pd.Series) -> pd.Series:
    def one(text):
        try:
            return str(ipaddress.IPv6Address(text))
        except (ValueError, TypeError):
            return None

    return values.map(one)


_v6_canonical = F.pandas_udf(_compressed, StringType())
_v6_once = F.pandas_udf(_compressed, StringType()).asNondeterministic()


@F.pandas_udf(StringType())
def _v6_key(values: pd.Series) -> pd.Series:
    return values.map(lambda text: None if text is None else format(int(ipaddress.IPv6Address(text)), "032x"))


def canonical_ip(c: Column) -> Column:
    """v4 as it is, v6 compressed in lower case; a zone or brackets are taken off; else null."""
    bare = F.regexp_replace(F.regexp_replace(c, r"^\[([^\]]*)\]$", "$1"), r"%[A-Za-z0-9_.-]{1,63}$", "")
    return F.when(is_v4(bare), bare).when(F.contains(bare, F.lit(":")), _v6_canonical(F.when(F.contains(bare, F.lit(":")), bare)))


def ip_version(c: Column) -> Column:
    return F.when(is_v4(c), 4).when(F.contains(c, F.lit(":")), 6)


def order_key(c: Column) -> Column:
    """Orders by version and number: v4 before v6."""
    return F.when(is_v4(c), F.concat(F.lit("4"), F.lpad(F.hex(ip_number(c)), 8, "0"))).otherwise(F.concat(F.lit("6"), _v6_key(F.when(F.contains(c, F.lit(":")), c))))


def in_networks(number: Column, networks: list[str] | None = None) -> Column:
    """Whether a v4 number lies in any of the networks: a range check for each, inside codegen."""
    ranges = [ipaddress.ip_network(n) for n in networks or RESERVED]
    return reduce(lambda a, b: a | b, [number.between(int(r.network_address), int(r.broadcast_address)) for r in ranges])


def networks_of(df: DataFrame, number: str, networks: DataFrame) -> DataFrame:
    """Rows of df with the networks (network, low, high) that their v4 number lies in, one row for each.

    Both sides are cut into the 256 blocks of the first octet and joined on those, so that a table of very
    many networks is an equi-join and no nested loop; a network has as many rows as it touches blocks.
    """
    block = lambda c: F.shiftright(c, 24)
    cut = networks.select("network", "low", "high", F.explode(F.sequence(block(F.col("low")), block(F.col("high")))).alias("block"))
    joined = df.withColumn("block", block(F.col(number))).join(cut, "block")
    return joined.where(F.col(number).between(F.col("low"), F.col("high"))).drop("block", "low", "high")


def strict_tokens(text: Column) -> Column:
    """Maximal runs of token characters, each with the slash that may follow; runs that are too long go."""
    runs = F.regexp_extract_all(text, F.lit(r"[0-9A-Za-z:.%\[\]_-]+/?"), F.lit(0))
    return F.filter(runs, lambda t: F.octet_length(F.rtrim(t, F.lit("/"))) <= LONGEST_TOKEN)


def strict_v4(token: Column) -> Column:
    """The v4 address of a token: alone or with a port from 1 to 65535, perhaps with a bracket after it."""
    body = F.regexp_replace(F.rtrim(token, F.lit("/")), r"\]$", "")
    port = F.regexp_extract(body, r":([0-9]{1,5})$", 1)
    return F.when(body.rlike(f"^{V4}$"), body).when(body.rlike(f"^{V4}:[0-9]{{1,5}}$") & port.cast("int").between(1, 65535), F.regexp_extract(body, f"^({V4}):", 1))


def strict_v6_text(token: Column) -> Column:
    """What may be a v6 address in a token, without brackets, port and zone, else null; still unchecked."""
    body, slash = F.rtrim(token, F.lit("/")), F.endswith(token, F.lit("/"))
    bracket = F.regexp_extract(body, r"^\[([0-9A-Fa-f:.]+)(%[A-Za-z0-9_.-]{1,63})?\](:[0-9]{1,5})?$", 1)
    port = F.regexp_extract(body, r"\]:([0-9]{1,5})$", 1)
    plain = F.regexp_extract(body, r"^([0-9A-Fa-f:.]+)(%[A-Za-z0-9_.-]{1,63})?\]?$", 1)
    good_port = (port == "") | F.coalesce(port.try_cast("int").between(1, 65535), F.lit(False))
    zone_before_slash = slash & F.contains(body, F.lit("%"))
    found = F.when((bracket != "") & good_port, bracket).when(plain != "", plain)
    return F.when(F.contains(found, F.lit(":")) & ~zone_before_slash, found)


def _settled(*columns: Column) -> Column:
    """A struct that is computed once: what uses its fields is not put before it, where it would compute them anew."""
    return F.explode_outer(F.array(F.struct(*columns))).alias("x")


def extract_ips(df: DataFrame, text: Column, *keep: Column, v6: bool = False) -> DataFrame:
    """Distinct addresses of each row in the strict dialect: keep..., ip. Reserved v4 networks are left out.

    Only tokens that look like addresses leave their text, each once a row; of these, v6 candidates, which
    have two colons at least, go to Python.
    """
    four_like, six_like = r"^[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]", ":.*:"
    looks = f"{four_like}|{six_like}" if v6 else four_like
    tokens = F.array_distinct(F.filter(strict_tokens(text), lambda t: t.rlike(looks)))
    named = df.where(text.rlike("[0-9A-Fa-f][.:]|::" if v6 else "[0-9A-Fa-f][.:]")).select(*keep, F.explode_outer(tokens).alias("token")).where("token IS NOT NULL")
    names = named.columns[:-1]
    four = F.when(F.col("token").rlike(four_like), strict_v4(F.col("token"))).alias("four")
    raw = (F.when(F.col("token").rlike(six_like), strict_v6_text(F.col("token"))) if v6 else F.lit(None).cast("string")).alias("raw")
    told = named.select(*names, _settled(four, raw)).select(*names, "x.*")
    told = told.select(*names, _settled(F.col("four"), F.col("raw"), ip_number(F.col("four")).alias("number"))).select(*names, "x.*")
    found = told.where((F.col("four").isNotNull() & ~in_networks(F.col("number"))) | F.col("raw").isNotNull())
    if not v6:
        return found.select(*names, F.col("four").alias("ip")).distinct()
    # A filter on what Python gives would otherwise be put before it and ask it twice.
    return found.select(*names, F.coalesce("four", _v6_once("raw")).alias("ip")).where("ip IS NOT NULL").distinct()


def extract_ips_loose(text: Column) -> Column:
    """v4 addresses of the loose dialect: not beside a letter, digit or underscore, dots may follow; `extract_loose` has v6 too."""
    pattern = rf"(?<![A-Za-z0-9_]){V4}(?![A-Za-z0-9_])"
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_.:%-]+"), F.lit(0))
    found = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    return F.filter(F.array_distinct(found), lambda ip: ~in_networks(ip_number(ip)))


def extract_loose(df: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """Distinct addresses of each row in the loose dialect, of both versions: keep..., ip.

    A token with two colons or more is a candidate of version 6 as a whole, but for a zone after `%`; v4
    addresses are looked for inside tokens. Reserved v4 networks are left out.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_.:%-]+"), F.lit(0))
    six = F.transform(F.filter(tokens, lambda t: t.rlike(":.*:")), lambda t: F.regexp_replace(t, r"%[A-Za-z0-9._-]+$", ""))
    found = df.where(text.rlike("[0-9A-Fa-f][.:]|::")).select(*keep, F.explode_outer(F.array_distinct(F.concat(extract_ips_loose(text), six))).alias("token")).where("token IS NOT NULL")
    names = found.columns[:-1]
    told = F.when(F.contains("token", F.lit(":")), _v6_once(F.when(F.contains("token", F.lit(":")), F.col("token")))).otherwise(F.col("token"))
    return found.select(*names, told.alias("ip")).where("ip IS NOT NULL").distinct()
