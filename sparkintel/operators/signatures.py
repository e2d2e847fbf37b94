"""Executable candidates and signature matches."""

from __future__ import annotations

import fnmatch
import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.functions.literals import find_literals

#: Headers, extensions and descriptions of executables, the descriptions in the order in which they are looked for.
HEADERS = ["4D5A", "7F454C46", "FEEDFA", "CFFAEDFE", "CAFEBABE"]
INDICATORS = [
    "pe32", "pe32+", "msi installer", "windows installer", "elf 32-bit", "elf 64-bit", "elf", "shared object", "mach-o", "dex", "dalvik", "posix shell script", "bourne-again shell script", "powershell",
]
EXTENSIONS = [".exe", ".dll", ".sys", ".ocx", ".msi", ".so", ".dylib", ".app", ".dex", ".apk", ".ps1", ".sh", ".bash"]
GENERIC = ["", "data", "ascii text", "unicode text"]
#: What the scanner takes for a script or a binary.
SCRIPT_EXTENSIONS = [".ps1", ".bat", ".cmd", ".sh", ".py", ".pl", ".php", ".rb", ".js", ".vbs"]
BINARY_EXTENSIONS = [".exe", ".dll", ".sys", ".bin", ".elf", ".so", ".dylib"]
SCAN_HEADERS = ["4D5A", "7F454C46", "FEEDFACE", "CEFAEDFE", "FEEDFACF", "CFFAEDFE", "CAFEBABE", "BEBAFECA"]
MIME_FRAGMENTS = ["executable", "x-sh", "x-python", "x-perl", "x-php", "x-ruby", "javascript"]
HEADER_BYTES = 8192
#: Regular expressions that one column tries; a rule set has as many such columns as it takes.
REGEXES_A_COLUMN = 200


def header(content: Column) -> Column:
    """The first bytes of a file, which its kind is told by."""
    return F.substring(content, 1, HEADER_BYTES)


def extension(path: Column) -> Column:
    """The extension with its dot, in lower case; a name that only starts with a dot has none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def _starts_with_any(content: Column, headers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(content, F.unhex(F.lit(h))) for h in headers])


def _text(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def is_exec_candidate(content: Column, path: Column) -> Column:
    """A known header, `#!` with anything after it, or a known extension."""
    sample = header(content)
    line = F.startswith(sample, F.unhex(F.lit("2321"))) & _text(F.substring(sample, 3, HEADER_BYTES)).rlike(r"[^ \t\n\x0B\f\r]")
    return _starts_with_any(sample, HEADERS) | line | extension(path).isin(EXTENSIONS)


def _told(description: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(description, F.lit(i)), F.lit(f"magic: {i}")) for i in INDICATORS])


def classify_exec(description: Column, path: Column, use_extension: bool = True) -> Column:
    """`magic: x` for the first indicator in a description; the extension only if the description says nothing.

    It says nothing if what stands before its first comma is generic, or for an apk that is a zip archive.
    """
    text = F.lower(F.trim(F.coalesce(description, F.lit("")), F.lit(" \t\n\x0b\f\r")))
    silent = F.trim(F.substring_index(text, ",", 1)).isin(GENERIC) | ((extension(path) == ".apk") & F.startswith(text, F.lit("zip archive data")))
    by_name = F.when(silent & extension(path).isin(EXTENSIONS), F.concat(F.lit("extension fallback: "), extension(path)))
    return F.coalesce(_told(text), by_name) if use_extension else _told(text)


def classify_exec_loose(description: Column, path: Column) -> Column:
    """The first indicator, else the extension whatever the description says."""
    text = F.lower(F.coalesce(description, F.lit("")))
    return F.coalesce(_told(text), F.when(extension(path).isin(EXTENSIONS), F.concat(F.lit("extension fallback: "), extension(path))))


def classifier_state(use_magic: bool, described: bool, use_extension: bool) -> str:
    """`available`, or what is left when no description can be had: `degraded` to extensions, or `unavailable`."""
    if not use_magic and not use_extension:
        raise ValueError("at least one way of classifying is needed")
    return "available" if described or not use_magic else "degraded" if use_extension else "unavailable"


def describe_files(files: DataFrame, describe=None, content: str = "content") -> DataFrame:
    """Files with a `description`: by a column function over the header where one is given, else null."""
    return files.withColumn("description", F.lit(None).cast("string") if describe is None else describe(header(F.col(content))))


def is_scan_candidate(content: Column, path: Column, mime: Column | None = None) -> Column:
    """What the scanner takes for executable: by extension, header, a first line that names an interpreter, or MIME type."""
    first = F.regexp_extract(_text(header(content)), r"^(.*)", 1)
    interpreter = F.trim(F.substring(first, 3, 510), F.lit(" \t\x0b\f\r"))
    line = F.startswith(first, F.lit("#!")) & (interpreter != "")
    told = F.lit(False) if mime is None else F.coalesce(reduce(lambda a, b: a | b, [F.contains(F.lower(mime), F.lit(m)) for m in MIME_FRAGMENTS]), F.lit(False))
    return extension(path).isin(SCRIPT_EXTENSIONS + BINARY_EXTENSIONS) | _starts_with_any(content, SCAN_HEADERS) | line | told


def match_candidates(df: DataFrame, path: str, size: str, globs: list[str], regexes: list[str], most: int | None = None, selector: str = "all", content: str = "content", mime: str | None = None) -> DataFrame:
    """Files no larger than `most` of which the name fits any glob and the path any regex; `exec-only` takes executables alone."""
    if selector not in ("all", "exec-only"):
        raise ValueError(f"unknown selector: {selector}")
    for pattern in regexes:
        re.compile(pattern)
    base = F.element_at(F.split(path, "/"), -1)
    kept = df if most is None else df.where(F.col(size) <= most)
    if selector == "exec-only":
        kept = kept.where(is_scan_candidate(F.col(content), F.col(path), None if mime is None else F.col(mime)))
    if globs:
        kept = kept.where(reduce(lambda a, b: a | b, [base.rlike(fnmatch.translate(g).replace(r"\Z", r"\z")) for g in globs]))
    return kept.where(reduce(lambda a, b: a | b, [F.col(path).rlike(r) for r in regexes])) if regexes else kept


def _found(text: Column, expression: Column | str, place: Column) -> list[Column]:
    return [place.cast("long").alias("offset"), F.regexp_count(text, expression if isinstance(expression, Column) else F.lit(expression)).cast("long").alias("times")]


def _tried(files: DataFrame, key: str, text: str, expressions: list[str]) -> DataFrame:
    """key, pattern, offset, times of regular expressions: all are tried in one pass, those that match are then counted."""
    java = files.sparkSession.sparkContext._jvm.java.util.regex.Pattern
    for e in expressions:
        try:
            java.compile(e)
        except (Py4JJavaError, PySparkException) as error:
            raise ValueError(f"not a regular expression: {e}") from error
    columns = [F.array_compact(F.array(*[F.when(F.col(text).rlike(e), k) for k, e in enumerate(expressions[at : at + REGEXES_A_COLUMN], at)])) for at in range(0, len(expressions), REGEXES_A_COLUMN)]
    # Outer, as otherwise a filter on the matches would be put before it and try them all once more.
    matched = files.where(F.col(text).isNotNull()).select(key, text, F.explode_outer(F.flatten(F.array(*columns))).alias("place")).where("place IS NOT NULL")
    listed = files.sparkSession.createDataFrame(list(enumerate(expressions)), "place int, pattern string")  # the rule set
    named = matched.join(F.broadcast(listed), "place")
    first = F.call_function("regexp_extract", F.col(text), F.concat(F.lit("(?s)^(.*?)(?:"), F.col("pattern"), F.lit(")")), F.lit(1))
    return named.select(key, "pattern", *_found(F.col(text), F.col("pattern"), F.length(first)))


def match_signatures(files: DataFrame, key: str, text: str, rules: DataFrame) -> DataFrame:
    """Matches of rules: key, namespace, rule, n_strings, first_offset.

    rules: namespace, rule, pattern_id, pattern, condition (`any`, `all` or a number as text) and, where
    there are regular expressions too, kind (`text` or `regex`). All literals are looked for in one pass;
    occurrences may overlap. Regular expressions,
    as Java reads them, are tried in one pass over the texts, and counted where they match. Texts may be null.
    """
    kinded = rules if "kind" in rules.columns else rules.withColumn("kind", F.lit("text"))
    named = kinded.select("namespace", "rule", "pattern_id", "pattern", "condition", "kind").where("pattern <> ''")
    literals = [r["pattern"] for r in named.where("kind = 'text'").select("pattern").distinct().orderBy("pattern").collect()]  # the rule set
    spots = find_literals(files, key, text, literals)
    if "kind" in rules.columns:
        expressions = [r["pattern"] for r in named.where("kind = 'regex'").select("pattern").distinct().orderBy("pattern").collect()]
        spots = spots.union(_tried(files, key, text, expressions)) if expressions else spots
    found = spots.join(named, "pattern")
    wanted = named.groupBy("namespace", "rule").agg(F.countDistinct("pattern_id").alias("patterns"))
    per = found.groupBy(key, "namespace", "rule", "condition").agg(F.countDistinct("pattern_id").alias("n_patterns"), F.sum("times").cast("long").alias("n_strings"), F.min("offset").cast("long").alias("first_offset"))
    need = F.when(F.col("condition") == "any", 1).when(F.col("condition") == "all", F.col("patterns")).otherwise(F.col("condition").try_cast("int"))
    return per.join(wanted, ["namespace", "rule"]).where(F.col("n_patterns") >= need).select(key, "namespace", "rule", "n_strings", "first_offset")


def order_matches(matches: DataFrame, path: str = "path") -> DataFrame:
    """Matches as reports list them: by path, namespace and rule."""
    return matches.orderBy(path, "namespace", "rule")


def order_errors(errors: DataFrame, path: str = "path") -> DataFrame:
    """Errors as reports list them: by path, code and message."""
    return errors.orderBy(path, "code", "message")


def match_rows(files: DataFrame, matches: DataFrame, path: str = "path") -> DataFrame:
    """A row for each file and rule with nested columns as compact JSON: file_path, sha256, md5, rule, namespace, tags, meta, strings.

    files: path, sha256, md5; matches: path, namespace, rule, tags (array), meta (map), strings (array of structs).
    """
    meta = F.map_from_entries(F.array_sort(F.map_entries("meta")))
    return order_matches(matches.join(files.select(path, "sha256", "md5"), path), path).select(
        F.col(path).alias("file_path"), "sha256", "md5", "rule", "namespace", F.to_json(F.array_sort("tags")).alias("tags"), F.to_json(meta).alias("meta"), F.coalesce(F.to_json("strings"), F.lit("[]")).alias("strings")
    )


def match_documents(files: DataFrame, matches: DataFrame, path: str = "path") -> DataFrame:
    """A row for each file with its matches nested, by namespace and rule: file_path, sha256, md5, matches."""
    order = F.struct("namespace", "rule", F.array_sort("tags").alias("tags"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries("meta")))).alias("meta"), "strings")
    nested = matches.groupBy(path).agg(F.array_sort(F.collect_list(order)).alias("matches"))  # as many as a rule set has rules
    return files.select(path, "sha256", "md5").join(nested, path).select(F.col(path).alias("file_path"), "sha256", "md5", "matches").orderBy("file_path")


def write_matches(files: DataFrame, matches: DataFrame, folder: str, kind: str, metadata: DataFrame | None = None) -> None:
    """The report of a scan as `json` (a file's matches nested) or `csv` (a row for each file and rule), its metadata beside it."""
    if kind not in ("json", "csv"):
        raise ValueError(f"unknown format of reports: {kind}")
    if kind == "json":
        match_documents(files, matches).write.mode("overwrite").json(f"{folder}/matches")
    else:
        match_rows(files, matches).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/matches")
    if metadata is not None:
        metadata.select(F.lit(1).alias("schema_version"), F.struct(*metadata.columns).alias("scan_metadata")).write.mode("overwrite").json(f"{folder}/metadata")


def attach_provenance(matches: DataFrame, manifest: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Matches with their rule's origin; files with a match of unknown namespace lose all, and are errors."""
    joined = matches.join(manifest, "namespace", "left").withColumn("unknown", F.bool_or(F.col("source").isNull()).over(Window.partitionBy(key)))
    errors = joined.where("unknown").select(key, F.lit("integrity").alias("code")).distinct()
    return joined.where("NOT unknown").drop("unknown"), errors


def cap_strings(strings: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """The first strings of each match by offset and identifier, and whether there were more."""
    order = Window.partitionBy(*keys)
    ranked = strings.withColumn("place", F.row_number().over(order.orderBy("offset", "identifier"))).withColumn("truncated", F.count(F.lit(1)).over(order) > cap)
    return ranked.where(F.col("place") <= cap)


def match_summary(matches: DataFrame, key: str, tags: str) -> DataFrame:
    """Matches of each file and its distinct tags, sorted."""
    return matches.groupBy(key).agg(F.count(F.lit(1)).alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(tags)))), ",").alias("tags"))
