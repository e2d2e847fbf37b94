"""Structured answers and their evidence: checks, attributions, full cards, prompt blocks, summaries."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparkintel.operators.versions import effective_corrections, latest_by

#: How sources are preferred by kind.
KINDS = ["readme", "authors", "maintainers"]


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


def normal_name(c: Column) -> Column:
    """A person's name for comparison: compatibility form, no case, single spaces. ASCII stays in the JVM."""
    plain = F.when(c.rlike(r"^[\x00-\x7F]*$"), F.lower(c)).otherwise(_nfkc(F.when(~c.rlike(r"^[\x00-\x7F]*$"), c)))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def json_leaves(answers: DataFrame, key: str, body: str) -> DataFrame:
    """Distinct trimmed scalars of JSON of any depth: key, leaf."""

    def walk(value: object) -> Iterator[str]:
        if isinstance(value, dict):
            value = list(value.values())
        if isinstance(value, list):
            for v in value:
                yield from walk(v)
        elif value is not None and (text := str(value).strip()):
            yield text

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, text in zip(pdf[key], pdf[body], strict=True):
                try:
                    rows += [(k, leaf) for leaf in dict.fromkeys(walk(json.loads(text)))]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=[key, "leaf"])

    return answers.select(key, body).mapInPandas(work, f"{key} {answers.schema[key].dataType.simpleString()}, leaf string")


def answer_violations(answers: DataFrame, key: str, body: str, longest: int = 2000, most: int = 30) -> DataFrame:
    """What is wrong with answers of the form {summary, tool_types, people}: key, violation."""
    v = F.try_parse_json(body)
    known = F.array(*[F.lit(f) for f in ("summary", "tool_types", "people")])
    fields = F.json_object_keys(body)
    parsed = F.from_json(body, "struct<summary:string,tool_types:array<string>,people:array<struct<name:string,quote:string>>>")
    wrong = F.array(
        F.when(v.isNull(), "json"), F.when(F.size(F.array_except(fields, known)) > 0, "unknown_field"), F.when(F.length(F.trim(parsed["summary"])) == 0, "blank"), F.when(F.length(parsed["summary"]) > longest, "long"),
        F.when(F.size(parsed["tool_types"]) > most, "items"), F.when(F.exists(parsed["people"], lambda p: F.coalesce(p["quote"], F.lit("")) == ""), "evidence"),
    )
    return answers.select(key, F.explode(F.array_compact(wrong)).alias("violation"))


def attribute_language(claims: DataFrame, people: DataFrame, owners: DataFrame) -> DataFrame:
    """Language claims that hold, others as Unknown: repository_id, subject, category.

    A claim needs evidence and a documented person as subject; organisations get none.
    """
    named = people.groupBy("repository_id").agg(F.collect_set(normal_name(F.col("person"))).alias("names"))
    joined = claims.join(named, "repository_id", "left").join(owners, "repository_id", "left")
    held = (F.coalesce("quote", F.lit("")) != "") & F.coalesce(F.array_contains("names", normal_name(F.col("subject"))), F.lit(False))
    allowed = F.coalesce(F.col("owner_type") != "Organization", F.lit(True))
    return joined.where(allowed).select("repository_id", "subject", F.when(held, F.col("category")).otherwise("Unknown").alias("category"))


def profile_text(profiles: DataFrame) -> DataFrame:
    """Bounded evidence text of owners' profiles; only of users with a login."""
    lines = F.concat_ws("\n", F.concat(F.lit("name: "), F.nullif("name", F.lit(""))), F.concat(F.lit("bio: "), F.nullif("bio", F.lit(""))), F.concat(F.lit("location: "), F.nullif("location", F.lit(""))))
    return profiles.where("type = 'User' AND login IS NOT NULL AND login <> ''").select("login", F.left(lines, F.lit(4000)).alias("text"))


def source_kind(path: Column) -> Column:
    """What a file documents by its name: readme, authors, maintainers, package, or null."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.when(name.rlike(r"^readme([._-].*)?$"), "readme").when(name.rlike(r"^authors([._-].*)?$"), "authors").when(name.rlike(r"^maintainers([._-].*)?$"), "maintainers").when(name.isin("package.json", "pyproject.toml", "setup.py", "cargo.toml", "go.mod"), "package")


def is_translation(path: Column) -> Column:
    """README_ko.md or README.zh-CN.md, but not README.md."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.rlike(r"(?i)^[a-z]+[._-][a-z]{2}([_-][a-z]{2,4})?(\.[a-z]+)?$") & ~name.rlike(r"(?i)^[a-z]+\.(md|rst|txt|py)$")


def capture_sources(files: DataFrame, group: str, max_doc: int, max_repo: int) -> DataFrame:
    """Documentary files of each repository within its budget of bytes: group, path, kind, kept, sha256, translation.

    Binary files (a NUL in the first 8192 bytes) are left out; a file gives at most max_doc bytes, and
    files follow each other by kind and path until max_repo is reached.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.lit(0))
    named = files.withColumn("kind", source_kind(F.col("path"))).where("kind IS NOT NULL")
    texts = named.where((F.instr(F.decode(F.substring("content", 1, 8192), "ISO-8859-1"), F.lit("\x00")) == 0))
    sized = texts.withColumn("size", F.least(F.octet_length("content"), F.lit(max_doc)))
    order = Window.partitionBy(group).orderBy(F.when(rank == 0, len(KINDS) + 1).otherwise(rank), "path").rowsBetween(Window.unboundedPreceding, -1)
    kept = F.least(F.col("size"), max_repo - F.coalesce(F.sum("size").over(order), F.lit(0)))
    cut = sized.withColumn("kept", kept).where("kept > 0")
    return cut.select(group, "path", "kind", F.col("kept").cast("long"), F.sha2(F.expr("substring(content, 1, CAST(kept AS INT))"), 256).alias("sha256"), is_translation(F.col("path")).alias("translation"))


def full_cards(cards: DataFrame, snapshots: DataFrame, copies: DataFrame, runs: DataFrame, corrections: DataFrame, fields: list[str]) -> DataFrame:
    """Cards with the rest of their latest snapshot, last fetch state, present copies and corrections."""
    latest = latest_by(snapshots.select("repository_id", "captured_at", "id", "license_spdx", "parent_full_name"), ["repository_id"], ["captured_at", "id"]).drop("captured_at", "id")
    here = copies.where("missing_at IS NULL").groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_copies"))
    state = runs.where("kind = 'fetch'").groupBy("repository_id").agg(F.max_by("state", "run_id").alias("fetch_state"))
    fixed = effective_corrections(corrections, ["repository_id"], fields)
    joined = reduce(lambda a, b: a.join(b, "repository_id", "left"), [latest, here, state, fixed], cards)
    parent = F.when(F.col("parent_full_name").rlike("^[^/]+/[^/]+$"), F.concat(F.lit("https://github.com/"), F.col("parent_full_name")))
    shown = [F.coalesce(f"corrected_{c}", c).alias(c) if c in fields else F.col(c) for c in cards.columns]
    return joined.select(*shown, "license_spdx", parent.alias("parent_url"), F.coalesce("n_copies", F.lit(0)).alias("n_copies"), "fetch_state")


def search_document(cards: DataFrame, fields: list[str]) -> DataFrame:
    """The text of each card that search looks through."""
    return cards.select("repository_id", F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields]).alias("text"))


def scan_metadata(files: DataFrame, matches: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: files discovered, selected and scanned, matched files, matches, errors, and the job's status."""
    counts = files.agg(F.count(F.lit(1)).alias("discovered"), F.count_if("selected").alias("selected"), F.count_if("scanned").alias("scanned"))
    hits = matches.agg(F.countDistinct("path").alias("matched"), F.count(F.lit(1)).alias("matches"))
    bad = errors.agg(F.count(F.lit(1)).alias("errors"))
    joined = counts.crossJoin(hits).crossJoin(bad)  # one row each
    return joined.withColumn("status", F.when(F.col("errors") > 0, "partial").otherwise("succeeded"))


def enrich_summary(tuples: DataFrame, completed: DataFrame, limit: int) -> DataFrame:
    """One row: tuples, distinct addresses, those selected, completed and remaining."""
    ips = tuples.select("ip").distinct()
    done = ips.join(completed.select("ip").distinct().withColumn("done", F.lit(True)), "ip", "left")
    out = done.agg(F.count(F.lit(1)).alias("ips"), F.count_if(F.col("done")).alias("completed"))
    return tuples.agg(F.count(F.lit(1)).alias("tuples")).crossJoin(out).select("tuples", "ips", F.least("ips", F.lit(limit)).alias("selected"), "completed", (F.col("ips") - F.col("completed")).alias("remaining"))


def sum_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric").agg(F.sum("value").alias("value"))
