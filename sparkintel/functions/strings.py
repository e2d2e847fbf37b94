"""Small column functions: escapes, guards, names, hashes and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def csv_safe(c: Column) -> Column:
    """Text that no spreadsheet takes for a formula; null as empty."""
    return F.when(c.isNull(), "").when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def md_escape(c: Column) -> Column:
    """Text on one line that Markdown and HTML show as it is; null as `not recorded`.

    Characters of the categories C, Zl and Zp, which hide or reorder text, are written as their code points.
    """
    hidden = r"[\p{C}\p{Zl}\p{Zp}]"
    code = lambda x: F.lower(F.hex(F.ascii(x)))
    # Character by character, and only where there is any.
    spelled = F.array_join(F.transform(F.split(c, ""), lambda x: F.when(x.rlike(hidden), F.concat(F.lit("\\u"), F.lpad(code(x), F.greatest(F.length(code(x)), F.lit(4)), F.lit("0")))).otherwise(x)), "")
    marked = F.regexp_replace(F.when(c.rlike(hidden), spelled).otherwise(c), r"([\\`*_{}\[\]()#+\-.!|~])", r"\\$1")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        marked = F.replace(marked, F.lit(sign), F.lit(name))
    return F.coalesce(marked, F.lit("not recorded"))


def normalize_hash(c: Column) -> Column:
    """Trimmed and in lower case; empty and `none` are null."""
    low = F.lower(F.trim(c))
    return F.when(~low.isin("", "none"), low)


def redact_url(c: Column) -> Column:
    """A URL without its credentials."""
    return F.regexp_replace(c, r"^([a-z+.-]+://)[^/@]*@", "$1")


def quoted(c: Column) -> Column:
    """A regular expression that matches the text itself, whatever it holds."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def sanitize_name(c: Column) -> Column:
    """A capture's name: other characters one by one as `_`; `capture` for what would be no name."""
    label = F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")
    return F.when(label.isin("", ".", ".."), "capture").otherwise(label)


def safe_part(c: Column) -> Column:
    """A part of a file name: runs of other characters as one `_`, no dots or `_` at its ends; `scan` if nothing is left."""
    cleaned = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(cleaned == "", "scan").otherwise(cleaned)


def capture_label(name: Column, suffixes: tuple[str, ...] = (".en_dec", ".enc")) -> Column:
    """An archive's name without the first of the suffixes that ends it, in any case."""
    cut = F.coalesce(*[F.when(F.endswith(F.lower(name), F.lit(x)), F.left(name, F.length(name) - len(x))) for x in suffixes])
    return F.coalesce(cut, name)


def report_stem(path: Column) -> Column:
    """The last part of a path if reports may be named by it, else null."""
    stem = F.element_at(F.split(path, "/"), -1)
    return F.when((stem != "") & ~stem.isin(".", "..") & ~stem.rlike("[\\\\\\x00-\\x1f\\x7f-\\x9f\\u2028\\u2029]"), stem)


def display_path(path: Column, base: str) -> Column:
    """A path below a base relative to it, `.` for the base itself; others as they are."""
    root = base.rstrip("/")
    return F.when(path == root, ".").when(F.startswith(path, F.lit(f"{root}/")), F.substr(path, F.lit(len(root) + 2))).otherwise(path)


def is_uuid(c: Column) -> Column:
    """A UUID in its canonical lower-case form."""
    return c.rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def is_utc_time(c: Column) -> Column:
    """An ISO timestamp that ends in Z and names a moment that there is."""
    return c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?Z$") & F.try_to_timestamp(F.replace(c, F.lit(","), F.lit("."))).isNotNull()


def utc_stamp(at: Column) -> Column:
    """A moment in ISO form with Z, as reports tell when they were made; the session's zone must be UTC."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def staging_stamp(at: Column) -> Column:
    """The part of a staged archive's name that tells when it came."""
    return F.date_format(at, "yyMMdd-HHmmss")


def outcome_shares(*counts: Column) -> Column:
    """Counters as one text, as reports show them: a / b / c."""
    return F.concat_ws(" / ", *[c.cast("string") for c in counts])


def rule_namespace(source: Column, path: Column) -> Column:
    """A namespace from a rule's source and path: readable, and different for different paths."""
    return F.concat(F.left(F.regexp_replace(F.concat(source, F.lit("__"), path), r"[^A-Za-z0-9_]", "_"), F.lit(160)), F.lit("_"), F.left(F.sha2(path, 256), F.lit(12)))


def unique_clean(values: Column) -> Column:
    """Trimmed non-empty strings, the first of each."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def terms(json_list: Column) -> Column:
    """The strings of a JSON list, joined by spaces; bad JSON is empty."""
    return F.coalesce(F.array_join(F.from_json(json_list, "array<string>"), " "), F.lit(""))


def canonical_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def is_safe_name(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._-]+$") & ~c.isin(".", "..", ".partial")


def is_safe_member(path: Column) -> Column:
    """A relative path inside its archive: not empty, absolute or upwards, no backslash or NUL."""
    return (path != "") & ~path.rlike(r"^/|\\|\x00") & ~F.array_contains(F.split(path, "/"), "..")


def bound_meta(meta: Column, key: int = 128, value: int = 512, entries: int = 64) -> Column:
    """A map cut to so many entries, keys and values to so many characters."""
    cut = F.slice(F.transform(F.map_entries(meta), lambda e: F.struct(F.left(e["key"], F.lit(key)), F.left(e["value"], F.lit(value)))), 1, entries)
    return F.map_from_entries(cut)


def utf8_floor(c: Column, most: Column) -> Column:
    """The text of at most so many bytes, without a part of a character at the cut."""
    raw, n = F.encode(c, "UTF-8"), most.cast("int")
    # A character starts at a byte that does not continue one; it has at most four bytes.
    ends = [F.when(~F.hex(F.substring(raw, n + 1 - back, F.lit(1))).rlike("^[89AB]"), n - back) for back in range(4)]
    return F.when(F.octet_length(c) <= n, c).when(n <= 0, "").otherwise(F.substring(raw, F.lit(1), F.coalesce(*ends)).cast("string"))


def utf8_head(c: Column, most: int) -> Column:
    """The text of at most so many bytes, without a part of a character at the cut."""
    return utf8_floor(c, F.lit(most))
