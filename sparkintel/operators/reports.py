"""Report lines and capture summaries, in an order that is always the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.functions.addresses import order_key
from sparkintel.functions.strings import md_escape
from sparkintel.operators.folds import in_ranges, numbered_in_order

SECTIONS = ["With intel", "Without intel", "Ambiguous", "Incomplete"]
#: The sections of each adapter's report in their order.
REPORT_SECTIONS = {
    "ip": ["Summary", "IPs With Local Intelligence", "IPs Without Local Intelligence", "Intelligence Lookup Incomplete", "IP-list Singularities", "Warnings", "Details"],
    "file": ["Summary", "Executables With Local Intelligence", "Executables Without Local Intelligence", "Ambiguous MD5 Matches", "Intelligence Lookup Incomplete", "Warnings", "Details"],
    "repository": ["Summary", "Repositories With Local Intelligence", "Repositories Without Local Intelligence", "Intelligence Lookup Incomplete", "Warnings", "Details"],
    "match": ["Summary", "Matched Files", "Rule Details", "Warnings"],
}


def _cells(*columns: Column) -> Column:
    """A line of a table: cells between bars."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *columns), F.lit(" |"))


def _listed(items: Column) -> Column:
    """Escaped values of an array, or None."""
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, md_escape), "; ")).otherwise("None")


def _more(c: Column) -> Column:
    """What is said of a line besides, if anything."""
    return F.when(c.isNull(), "").otherwise(F.concat(F.lit(", "), md_escape(c)))


def _numbered(parts: list[tuple[str, DataFrame, list[Column], Column]], adapter: str, capture: str) -> DataFrame:
    """Parts (section, rows, order, line) as one table: capture, section_no, section, row_no, line. A capture of very many rows is numbered range by range."""
    dealt = []
    for section, rows, order, line in parts:
        ranged = in_ranges(rows, F.col(capture), *order)
        dealt.append(ranged.select(F.col(capture).alias("capture"), F.lit(REPORT_SECTIONS[adapter].index(section)).alias("section_no"), F.lit(section).alias("section"), line.alias("line")))
    return numbered_in_order(dealt, ["capture", "section_no"], "row_no").select("capture", "section_no", "section", "row_no", "line")


def _summary(rows: DataFrame, capture: str, counters: dict[str, Column], more: dict[str, Column] | None = None) -> tuple[DataFrame, list[Column], Column]:
    """The counters of each capture as lines, in their order."""
    per = rows.groupBy(capture).agg(*[c.alias(f"c{k}") for k, c in enumerate(counters.values())])
    labels = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), F.col(f"c{k}").cast("string").alias("value")) for k, label in enumerate(counters)])
    lines = per.select(capture, F.explode(labels).alias("x")).select(capture, "x.*")
    return lines, [F.col("k")], F.concat(F.lit("- "), F.col("label"), F.lit(": "), md_escape(F.col("value")))


def warning_lines(errors: DataFrame, capture: str) -> tuple[DataFrame, list[Column], Column]:
    """errors: capture, path, code, message."""
    return errors, [F.col("path"), F.col("code"), F.col("message")], F.concat(F.lit("- "), md_escape(F.col("code")), F.lit(": "), md_escape(F.col("path")), F.lit(": "), md_escape(F.col("message")))


def _outcomes(statuses: tuple[str, ...]) -> Column:
    return F.concat_ws(" / ", *[F.count_if(F.col("status") == s).cast("string") for s in statuses])


def ip_report(lookups: DataFrame, singularities: DataFrame, errors: DataFrame, capture: str = "capture") -> DataFrame:
    """The report of addresses: capture, section_no, section, row_no, line.

    lookups: capture, ip, status, error_code, malicious, country_code, reverse_dns (array), paths (sorted
    array). singularities: capture, path, threshold. errors: capture, path, code, message. Addresses are
    ordered by verdict (Yes, none, No, no hit), then by version, number and first path.
    """
    rank = F.when(F.col("status") != "hit", 3).when(F.col("malicious") == "Yes", 0).when(F.col("malicious").isNull(), 1).otherwise(2)
    order = [rank, order_key(F.col("ip")), F.element_at("paths", 1)]
    bad = F.col("status").isin("unavailable", "error")
    links = _listed(F.col("paths"))
    counters = {
        "Unique IPs found": F.count(F.lit(1)), "IPs with local intelligence": F.count_if(F.col("status") == "hit"), "IPs without local DB records": F.count_if(F.col("status") == "miss"),
        "IPs with incomplete lookups": F.count_if(bad), "Lookup hits / misses / unavailable / errors": _outcomes(("hit", "miss", "unavailable", "error")),
    }
    s = REPORT_SECTIONS["ip"]
    detail = F.concat(F.lit("### "), F.col("ip"), F.lit(": IPv"), F.when(F.contains("ip", F.lit(":")), "6").otherwise("4"), F.lit(", "), md_escape(F.col("status")), _more(F.col("error_code")), F.lit(", "), links)
    return _numbered(
        [
            (s[0], *_summary(lookups, capture, counters)),
            (s[1], lookups.where("status = 'hit'"), order, _cells(F.col("ip"), md_escape(F.col("malicious")), md_escape(F.col("country_code")), _listed(F.col("reverse_dns")), links)),
            (s[2], lookups.where("status = 'miss'"), order, _cells(F.col("ip"), links)),
            (s[3], lookups.where(bad), order, _cells(F.col("ip"), md_escape(F.col("status")), md_escape(F.col("error_code")), links)),
            (s[4], singularities, [F.col("path")], _cells(md_escape(F.col("path")), md_escape(F.format_string("more than %d distinct valid IPs; stopped at %d", F.col("threshold"), F.col("threshold") + 1)))),
            (s[5], *warning_lines(errors, capture)),
            (s[6], lookups, order, detail),
        ], "ip", capture,
    )


def rank_files(lookups: DataFrame) -> list[Column]:
    """Files by verdict: yes, unknown, no, no hit; then by SHA-256 and first path."""
    rank = F.when(F.col("status") != "hit", 3).when(F.col("malicious") == "yes", 0).when(F.col("malicious") == "unknown", 1).when(F.col("malicious") == "no", 2).otherwise(3)
    return [rank, F.col("sha256"), F.element_at("paths", 1)]


def file_report(lookups: DataFrame, errors: DataFrame, capture: str = "capture") -> DataFrame:
    """The report of files: capture, section_no, section, row_no, line.

    lookups: capture, sha256, md5, status, error_code, match_type, reason, file_ids, malicious, tags and
    names (arrays), magics (sorted array), paths (sorted array).
    """
    order, bad, links = rank_files(lookups), F.col("status").isin("unavailable", "error"), _listed(F.col("paths"))
    paths = lambda status: F.coalesce(F.sum(F.when(F.col("status") == status, F.size("paths"))), F.lit(0))
    counters = {
        "Successfully hashed executable paths": F.coalesce(F.sum(F.size("paths")), F.lit(0)), "Executables with local intelligence": paths("hit"), "Executables without local intelligence": paths("miss"), "Unique executable hashes": F.count(F.lit(1)),
        "Lookup hits / misses / ambiguities / unavailable / errors": _outcomes(("hit", "miss", "ambiguous", "unavailable", "error")),
    }
    s = REPORT_SECTIONS["file"]
    strength = F.when(F.col("match_type") == "sha256", "SHA-256").otherwise("MD5 (weak)")
    detail = F.concat(F.lit("### "), F.col("sha256"), F.lit(": "), F.col("md5"), F.lit(", "), md_escape(F.col("status")), _more(F.coalesce("error_code", "reason")), F.lit(", "), links)
    return _numbered(
        [
            (s[0], *_summary(lookups, capture, counters)),
            (s[1], lookups.where("status = 'hit'"), order, _cells(F.col("sha256"), F.col("md5"), strength, md_escape(F.col("malicious")), _listed(F.col("tags")), _listed(F.col("names")), links)),
            (s[2], lookups.where("status = 'miss'"), order, _cells(F.col("sha256"), F.col("md5"), _listed(F.col("magics")), links)),
            (s[3], lookups.where("status = 'ambiguous'"), order, _cells(F.col("md5"), F.col("sha256"), F.col("file_ids"), md_escape(F.col("reason")), links)),
            (s[4], lookups.where(bad), order, _cells(F.col("sha256"), F.col("md5"), md_escape(F.col("status")), md_escape(F.col("error_code")), links)),
            (s[5], *warning_lines(errors, capture)),
            (s[6], lookups, order, detail),
        ], "file", capture,
    )


def repository_report(lookups: DataFrame, errors: DataFrame, capture: str = "capture") -> DataFrame:
    """The report of repositories, by key: capture, section_no, section, row_no, line.

    lookups: capture, identity_key, status, error_code, information_status, purpose, paths (sorted array).
    """
    order, bad, links = [F.col("identity_key")], F.col("status").isin("unavailable", "error"), _listed(F.col("paths"))
    url = F.concat(F.lit("https://"), F.col("identity_key"))
    link = F.concat(F.lit("["), md_escape(url), F.lit("](<"), url, F.lit(">)"))
    s = REPORT_SECTIONS["repository"]
    return _numbered(
        [
            (s[0], *_summary(lookups, capture, {"Unique repositories": F.count(F.lit(1)), "Lookup hits / misses / unavailable / errors": _outcomes(("hit", "miss", "unavailable", "error"))})),
            (s[1], lookups.where("status = 'hit'"), order, _cells(link, md_escape(F.col("information_status")), md_escape(F.col("purpose")), links)),
            (s[2], lookups.where("status = 'miss'"), order, _cells(md_escape(url), links)),
            (s[3], lookups.where(bad), order, _cells(md_escape(url), md_escape(F.col("status")), md_escape(F.col("error_code")))),
            (s[4], *warning_lines(errors, capture)),
            (s[5], lookups.where("status = 'hit'"), order, F.concat(F.lit("### "), md_escape(url), F.lit(": "), md_escape(F.col("information_status")), F.lit(", "), links)),
        ], "repository", capture,
    )


def match_report(matches: DataFrame, errors: DataFrame, capture: str = "capture") -> DataFrame:
    """The report of signature matches: capture, section_no, section, row_no, line.

    matches: capture, path, sha256, md5, namespace, rule, tags (array), source.
    """
    files = matches.groupBy(capture, "path").agg(F.first("sha256").alias("sha256"), F.first("md5").alias("md5"), F.count(F.lit(1)).alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"))  # as many as a rule set has rules
    s = REPORT_SECTIONS["match"]
    return _numbered(
        [
            (s[0], *_summary(matches, capture, {"Matched files": F.countDistinct("path"), "Rule matches": F.count(F.lit(1))})),
            (s[1], files, [F.col("path")], _cells(md_escape(F.col("path")), md_escape(F.col("sha256")), md_escape(F.col("md5")), F.col("n").cast("string"), md_escape(F.array_join("tags", ", ")))),
            (s[2], matches, [F.col("path"), F.col("namespace"), F.col("rule")], F.concat(F.lit("### "), md_escape(F.col("path")), F.lit(": "), md_escape(F.col("namespace")), F.lit("/"), md_escape(F.col("rule")), F.lit(", "), md_escape(F.col("source")))),
            (s[3], *warning_lines(errors, capture)),
        ], "match", capture,
    )


def report_lines(statuses: DataFrame, capture: str, indicator: str, order: list[Column]) -> DataFrame:
    """One line for each indicator of a capture under the section of its status: capture, section, row_no, line."""
    section = F.when(F.col("status") == "hit", SECTIONS[0]).when(F.col("status") == "miss", SECTIONS[1]).when(F.col("status") == "ambiguous", SECTIONS[2]).otherwise(SECTIONS[3])
    named = statuses.withColumn("section", section)
    number = F.row_number().over(Window.partitionBy(capture, "section").orderBy(*order))
    text = F.concat(F.lit("- "), md_escape(F.col(indicator)), F.lit(" | "), md_escape(F.col("malicious")), F.lit(" | "), md_escape(F.col("first_path")))
    return named.select(capture, "section", number.alias("row_no"), text.alias("line"))


def report_counts(statuses: DataFrame, capture: str) -> DataFrame:
    """The summary section: indicators of each capture by status."""
    return statuses.groupBy(capture).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("hit", "miss", "ambiguous", "error", "unavailable")])


def capture_summary(captures: DataFrame, statuses: DataFrame, singularities: DataFrame, adapters: list[str]) -> DataFrame:
    """A row for each capture and adapter: its state (`not_enabled` without one), codes and singular files."""
    names = captures.sparkSession.createDataFrame([(a, k) for k, a in enumerate(adapters)], "adapter string, place int")
    grid = captures.select("capture").crossJoin(F.broadcast(names))  # a handful of adapters
    single = singularities.groupBy("capture", "adapter").agg(F.count(F.lit(1)).alias("singular"))
    joined = grid.join(statuses, ["capture", "adapter"], "left").join(single, ["capture", "adapter"], "left")
    return joined.select("capture", "place", "adapter", F.coalesce("state", F.lit("not_enabled")).alias("state"), F.coalesce("codes", F.lit("")).alias("codes"), F.coalesce("singular", F.lit(0)).alias("singular"))


def write_reports(lines: DataFrame, capture: str, folder: str) -> None:
    """A folder of text for each capture; partitioned, so that a reader of one capture opens no other."""
    ordered = lines.repartition(capture).sortWithinPartitions(capture, "section", "row_no")
    ordered.select(F.col(capture).alias("capture_name"), "line").write.mode("overwrite").partitionBy("capture_name").text(folder)


def list_captures(captures: DataFrame, history: DataFrame) -> DataFrame:
    """Captures with their last analysis."""
    last = history.groupBy("capture").agg(F.max_by(F.struct("run_id", "state"), F.struct("started_at", "run_id")).alias("last"))
    return captures.join(last, "capture", "left").select("capture", F.col("last.run_id").alias("last_run"), F.coalesce("last.state", F.lit("never")).alias("last_state"))


def append_history(statuses: DataFrame, folder: str, capture: str = "capture") -> None:
    """Adds an analysis of each capture to the history: capture, run_id, started_at, policy, state."""
    statuses.select(F.col(capture).alias("capture"), "run_id", "started_at", "policy", "state").write.mode("append").parquet(folder)


def append_audit(rows: DataFrame, folder: str, table: str) -> None:
    """Adds rows to an audit table, which is only ever added to; partitioned by day, so that readers skip what is old."""
    at = F.to_date("at") if "at" in rows.columns else F.current_date()
    rows.withColumn("day", at).write.mode("append").partitionBy("day").parquet(f"{folder}/{table}")


def recent_failures(results: DataFrame, k: int = 5) -> DataFrame:
    """The last failures of providers: top-k without a full sort."""
    return results.where("provider_status = 'failed'").orderBy(F.col("fetched_at").desc(), "provider_name").select("provider_name", "provider_status", "error_summary", "fetched_at").limit(k)


def summary_counts(files: DataFrame, tags: DataFrame, scans: DataFrame, visits: DataFrame) -> DataFrame:
    """What a store holds: measure, value; files, malicious ones, tags, scans, and directories by state."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("measure"), "value")
    by_state = visits.groupBy(F.concat(F.lit("visits "), "status").alias("measure")).agg(F.count(F.lit(1)).alias("value"))
    return one(files, "files").union(one(files.where("malicious = 'yes'"), "malicious")).union(one(tags, "tags")).union(one(scans, "scans")).union(by_state)


def list_cards(cards: DataFrame) -> DataFrame:
    """Cards in the order of their keys."""
    return cards.orderBy("identity_key")
