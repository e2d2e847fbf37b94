"""Repository addresses in text, by a strict and a lenient reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PART = r"[A-Za-z0-9][A-Za-z0-9_.-]{0,99}"


def repository_key(url: Column) -> Column:
    """`github.com/owner/name` in lower case for https, http, git, ssh, scp and bare spellings, else null.

    Exactly an owner and a name; no query or fragment, no credentials but the user git of ssh; a port
    only for ssh. One `.git` and one slash at the end are dropped.
    """
    spelled = rf"^(?:(?:https?|git)://(?i:github\.com)/|ssh://git@(?i:github\.com)(?::([0-9]{{1,5}}))?/|git@(?i:github\.com):|(?i:github\.com)/)({_PART})/({_PART})/?$"
    port = F.regexp_extract(url, spelled, 1)
    name = F.regexp_replace(F.regexp_extract(url, spelled, 3), r"\.git$", "")
    good = url.rlike(spelled) & ((port == "") | port.try_cast("int").between(1, 65535)) & (name != "")
    return F.when(good, F.lower(F.concat(F.lit("github.com/"), F.regexp_extract(url, spelled, 2), F.lit("/"), name)))


def repository_key_lenient(url: Column) -> Column:
    """The key of an address with a scheme: percent-escapes read, ports 22, 80 and 443 allowed, no bare form."""
    read = F.coalesce(F.try_url_decode(url), url)
    spelled = rf"^(?:(?:https?|git)://(?i:github\.com)(?::(?:22|80|443))?/|ssh://git@(?i:github\.com)(?::(?:22|80|443))?/|git@(?i:github\.com):)({_PART})/({_PART})/?$"
    name = F.regexp_replace(F.regexp_extract(read, spelled, 2), r"\.git$", "")
    return F.when(read.rlike(spelled) & (name != ""), F.lower(F.concat(F.lit("github.com/"), F.regexp_extract(read, spelled, 1), F.lit("/"), name)))


def repository_tokens(df: DataFrame, text: Column, *keep: Column, longest: int = 2048) -> DataFrame:
    """Repository addresses in text with their byte offsets: keep..., identity_key, spelling, offset."""
    pattern = F.lit(r"[A-Za-z0-9:/@._?#%-]+")
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("token"), F.split(text, r"[A-Za-z0-9:/@._?#%-]+", -1).alias("gap"))
    rows = df.where(text.rlike("(?i)github")).select(*keep, F.posexplode(both).alias("n", "x"))
    names = rows.columns[:-2]
    run = Window.partitionBy(*names).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select(*names, "n", "x.token", (F.sum(F.octet_length("x.gap") + F.coalesce(F.octet_length("x.token"), F.lit(0))).over(run) - F.octet_length("x.token")).cast("long").alias("offset"))
    keyed = placed.where(F.octet_length("token") <= longest).withColumn("identity_key", repository_key(F.col("token")))
    return keyed.where("identity_key IS NOT NULL").select(*names, "identity_key", F.col("token").alias("spelling"), "offset")


def parent_url(full_name: Column) -> Column:
    """The address of a parent named `owner/name`, null if the name is none."""
    return F.when(full_name.rlike(f"^{_PART}/{_PART}$"), F.concat(F.lit("https://github.com/"), full_name))


def repo_ref(c: Column) -> Column:
    """The key of a repository that is named by its address or by `owner/name` alone; null for neither."""
    spelled = F.when(c.rlike("://|@"), c).otherwise(F.concat(F.lit("https://github.com/"), F.regexp_replace(c, "^/+|/+$", "")))
    return repository_key_lenient(spelled)
