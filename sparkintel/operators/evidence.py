"""Evidence: byte budgets over sources, exact quotes, documented languages, script statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.functions.scripts import SCRIPTS, script_counts
from sparkintel.functions.strings import quoted, utf8_floor
from sparkintel.operators.folds import fold_in_order, running_digest

#: Scripts of one language, codes of one category, and codes that share one.
DIRECT = {"hangul": "Korean", "kana": "Japanese", "hebrew": "Hebrew"}
CATEGORIES = {"zh": "Chinese", "ru": "Russian", "ko": "Korean", "ja": "Japanese", "ar": "Arabic", "he": "Hebrew", "hi": "Hindi", "en": "English"}
SLAVIC = ["uk", "be", "bg", "mk", "sr", "pl", "cs", "sk", "sl", "hr", "bs"]
#: Scripts whose language a detector tells, and the order of documents by kind.
TOLD_BY_DETECTOR = ["arabic", "devanagari", "cyrillic", "han", "latin"]
SOURCE_KINDS = ["readme", "authors", "maintainers"]
#: What is white space in links; Java's own class is that of ASCII.
_SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def select_evidence(documents: DataFrame, versions: DataFrame, most: int) -> DataFrame:
    """Original, current sources of each repository within a budget of bytes: repository_id, place, version_id, locator, content_hash, content, kept.

    documents: document_id, repository_id, kind, locator, origin, priority, translation; versions: version_id,
    document_id, content, content_hash. Translations stay out, of a document's versions the latest counts, and
    sources follow each other by priority (falling), kind, origin (falling) and locator. The source that
    passes the budget is cut after its last whole character; the up to three bytes that this leaves
    go to the next sources whose first characters fit. Empty sources give nothing.
    """
    latest = versions.groupBy("document_id").agg(F.max("version_id").alias("version_id"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in SOURCE_KINDS]), F.col("kind")), F.lit(0)), F.lit(len(SOURCE_KINDS) + 1)).cast("int")
    own = documents.where(~F.coalesce(F.col("translation"), F.lit(False))).join(latest, "document_id").join(versions.drop("document_id"), "version_id")
    own = own.select("repository_id", "version_id", "locator", "content_hash", "content", F.octet_length("content").cast("long").alias("size"), (-F.col("priority")).alias("later"), rank.alias("rank"), "origin", "document_id").where("size > 0")
    # Bytes before each source; texts stay where they are, as their sizes and first characters are enough to decide.
    order = [F.col("later"), F.col("rank"), F.col("origin").desc_nulls_last(), F.col("locator"), F.col("document_id")]
    turn = Window.partitionBy("repository_id").orderBy(*order)
    light = own.select("repository_id", "version_id", "size", F.left("content", F.lit(3)).alias("head"), *[c for c in ("later", "rank", "origin", "locator", "document_id")])
    placed = light.select("repository_id", "version_id", "size", "head", F.row_number().over(turn).alias("place"), (F.sum("size").over(turn) - F.col("size")).alias("before"))
    whole = placed.where(F.col("before") + F.col("size") <= most).select("repository_id", "version_id", "place", F.col("size").alias("kept"))
    over = placed.where((F.col("before") < most) & (F.col("before") + F.col("size") > most))
    cut = over.join(own.select("version_id", "content"), "version_id").select("repository_id", "version_id", "place", F.octet_length(utf8_floor(F.col("content"), F.lit(most) - F.col("before"))).cast("long").alias("kept"), "before")
    left = cut.select("repository_id", (F.lit(most) - F.col("before") - F.col("kept")).alias("left")).where("left > 0")

    def step(state: int | None, row: tuple) -> tuple[int, tuple | None]:
        place, version, head, start = row
        state, kept = start if state is None else state, 0
        for c in head:
            if kept + len(c.encode()) > state:
                break
            kept += len(c.encode())
        return state - kept, (version, place, kept) if kept else None

    after = placed.where(F.col("before") >= most).join(left, "repository_id")
    crumbs = fold_in_order(after, ["repository_id"], ["place"], ["place", "version_id", "head", "left"], f"version_id {versions.schema['version_id'].dataType.simpleString()}, place int, kept long", lambda: None, step)
    chosen = whole.unionByName(cut.drop("before").where("kept > 0")).unionByName(crumbs)
    shown = own.select("version_id", "locator", "content_hash", "content").join(chosen, "version_id")
    return shown.select("repository_id", "place", "version_id", "locator", "content_hash", utf8_floor(F.col("content"), F.col("kept")).alias("content"), "kept")


def quote_positions(source: Column, quote: Column) -> tuple[Column, Column]:
    """Offset of the first occurrence, and how many there are, overlapping ones counted."""
    first = F.instr(source, quote) - 1
    count = F.regexp_count(source, F.concat(F.lit("(?="), quoted(quote), F.lit(")")))
    return first, count


def validate_quotes(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """Each quote against the source that it names: valid, or why not; its place and number."""
    joined = quotes.join(sources.select("source_id", "content"), "source_id", "left")
    first, count = quote_positions(F.col("content"), F.col("quote"))
    state = F.when(F.col("content").isNull(), "unknown_source").when((F.col("quote") == "") | ~F.contains("content", F.col("quote")), "not_in_source").otherwise("valid")
    good = F.col("state") == "valid"
    return joined.withColumn("state", state).select("quote_id", "source_id", "state", F.when(good, first).cast("long").alias("start_offset"), F.when(good, count).cast("long").alias("occurrences"))


def clean_prose(text: Column) -> Column:
    """Prose without fenced, indented and inline code and without links; lines end at line feeds alone."""
    steps = [r"(?s)```.*?```", r"(?md)^(?: {4}|\t).*$", r"`[^`\n]*`", rf"https?://[^{_SPACE}]+"]
    return reduce(lambda c, p: F.regexp_replace(c, p, " "), steps, text)


def mapped_language(code: Column) -> Column:
    """The category of a language code; null for codes of none."""
    found = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), code)
    return F.coalesce(found, F.when(code.isin(*SLAVIC), "Slavic-other"))


def infer_language(df: DataFrame, text: Column, detector: Column, *keep: Column, min_letters: int = 100, ratio: float = 0.2, eligible: Column | None = None) -> DataFrame:
    """keep..., letters, dominant, category, method, confidence, detected, scripts (letters of each), rationale.

    The script with most letters (of equals the first of SCRIPTS) decides: that of one language by itself,
    one of several languages by the detector's code if that has a category. Too few letters, a script
    without its share of them, other scripts, and subjects that are not eligible are Unknown.
    detector: the code that a detector gave, or null.
    """
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    counted = df.select(*keep, detector.alias("code"), ok.alias("eligible"), script_counts(clean_prose(text)).alias("scripts"))
    names = counted.columns[: len(keep)]
    letters = reduce(lambda a, b: a + b, [F.col(f"scripts.{n}") for n in SCRIPTS])
    top = F.greatest(*[F.col(f"scripts.{n}") for n in SCRIPTS])
    dominant = reduce(lambda c, n: F.when(F.col(f"scripts.{n}") == top, n).otherwise(c), reversed(SCRIPTS), F.lit(None).cast("string"))
    told = counted.select("*", letters.alias("letters"), top.alias("top"), dominant.alias("dominant"), mapped_language(F.col("code")).alias("mapped"))
    script = F.col("dominant")
    cases = [
        (~F.col("eligible"), "Unknown", "combined", "organization or unresolved multi-author subject"),
        (F.col("letters") < min_letters, "Unknown", "combined", "insufficient original-source letters"),
        (F.col("top") < F.lit(ratio) * F.col("letters"), "Unknown", "combined", "no script reached the configured dominance threshold"),
        *[(script == s, language, "unicode-script", f"dominant {s} script") for s, language in DIRECT.items()],
        ((script == "latin") & F.col("mapped").isNotNull(), None, "language-detector", "Latin prose classified by offline detector"),
        (script.isin(*TOLD_BY_DETECTOR) & F.col("mapped").isNotNull(), None, "combined", F.concat(F.lit("dominant "), script, F.lit(" script corroborated by detector"))),
        (script.isin(*TOLD_BY_DETECTOR), "Unknown", "combined", F.concat(script, F.lit(" script requires a supported detector result"))),
        (F.lit(True), "Unknown", "combined", "unsupported script distribution"),
    ]
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    chosen = lambda k: reduce(lambda c, case: F.when(case[0], F.col("mapped") if case[k] is None else as_column(case[k])).otherwise(c), reversed(cases), F.lit(None).cast("string"))
    category, asked = chosen(1), (F.col("eligible") & (F.col("letters") >= min_letters) & (F.col("top") >= F.lit(ratio) * F.col("letters")) & ~script.isin(*DIRECT))
    return told.select(*names, "letters", "dominant", category.alias("category"), chosen(2).alias("method"), F.when(category == "Unknown", "unknown").otherwise("medium").alias("confidence"), F.when(asked, F.col("code")).alias("detected"), "scripts", chosen(3).alias("rationale"))


def explicit_language(sources: DataFrame, people: DataFrame, languages: list[str]) -> DataFrame:
    """Statements like "NAME is a native LANGUAGE speaker" in a repository's sources about its people."""
    joined = sources.join(people, "repository_id")
    pattern = F.concat(F.lit(r"(?i)\b"), quoted(F.col("person")), F.lit(rf"\s+is\s+a\s+native\s+({'|'.join(languages)})\s+speaker\b"))
    found = joined.withColumn("language", F.call_function("regexp_extract", F.col("content"), pattern, F.lit(1))).where("language <> ''")
    return found.groupBy("repository_id", "person").agg(F.min_by("language", "source_id").alias("language"))


def evidence_rows(sources: DataFrame) -> DataFrame:
    """The blocks of each repository as its rows, to be read in order of place and joined by blank lines: repository_id, place, text, entry.

    sources: repository_id, place, version_id, locator, content, content_hash. entry is the row's part of
    the set hash.
    """
    opening = F.concat(F.lit('<source id="'), F.col("version_id").cast("string"), F.lit('" locator="'), F.col("locator"), F.lit('" untrusted="true">\n'))
    entry = F.to_json(F.struct(F.col("content_hash").alias("hash"), "version_id"))
    return sources.select("repository_id", "place", F.concat(opening, F.col("content"), F.lit("\n</source>")).alias("text"), entry.alias("entry"))


def evidence_blocks(sources: DataFrame) -> DataFrame:
    """What stands for the blocks of each repository: repository_id, set_hash, n.

    set_hash is the hash of the canonical JSON list of version ids and content hashes, in order; n the length
    of the blocks. Hashes alone are brought together, and read as a stream that keeps one running hash,
    so that a repository of very many sources is never one row or one frame.
    """
    rows = evidence_rows(sources)
    lengths = rows.groupBy("repository_id").agg((F.sum(F.length("text")) + 2 * (F.count(F.lit(1)) - 1)).alias("length"))
    hashes = running_digest(rows.select("repository_id", "place", "entry"), ["repository_id"], F.col("entry"), ["place"], ",", ("[", "]"))
    same = hashes["repository_id"].eqNullSafe(lengths["repository_id"])
    return hashes.join(lengths, same).select(hashes["repository_id"], F.col("digest").alias("set_hash"), F.col("length").alias("n"))
