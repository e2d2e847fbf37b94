from pyspark.sql import functions as F

from sparkintel.functions import strings
from sparkintel.functions.repositories import parent_url, repository_key, repository_key_lenient, repository_tokens
from sparkintel.operators.evidence import explicit_language, quote_positions, validate_quotes
from sparkintel.operators.indicators import repo_observations, traversal_key
from sparkintel.operators.search import bm25_search, query_terms
from sparkintel.operators.signatures import classify_exec, classify_exec_loose, is_exec_candidate, match_candidates

STRICT_GOOD = ["https://github.com/Team/Tool.git", "ssh://git@github.com:22/Team/Tool", "git@github.com:Team/Tool.git", "github.com/Team/Tool/"]
STRICT_BAD = ["https://github.com/team/tool/pulls/7", "https://notgithub.com/team/tool", "https://me:pw@github.com/team/tool", "git@github.com:team/tool#top", "ssh://git@github.com:99999/team/tool"]
LENIENT_BAD = ["https://pw@github.com/Team/Tool", "https://github.com/Team/Tool?tab=all", "https://host.test/Team/Tool", "https://github.com/Team/Tool/wiki", "git@github.com:Team", "github.com/Team/Tool/"]


def column(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r["x"] for r in df.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_repository_keys(spark):
    assert set(column(spark, STRICT_GOOD, repository_key)) == {"github.com/team/tool"}
    assert set(column(spark, STRICT_BAD, repository_key)) == {None}
    assert set(column(spark, STRICT_GOOD[:3], repository_key_lenient)) == {"github.com/team/tool"}
    assert set(column(spark, LENIENT_BAD, repository_key_lenient)) == {None}
    assert column(spark, ["a/b", "a/b/c", None], parent_url) == ["https://github.com/a/b", None, None]


def test_repository_occurrences(spark):
    text = "é https://github.com/Team/Tool git@github.com:Team/Tool.git"
    found = repository_tokens(spark.createDataFrame([(1, text)], "f int, text string"), F.col("text"), F.col("f"))
    got = repo_observations(found, ["f"]).collect()
    assert [(r["identity_key"], r["occurrence_count"], r["first_offset"], r["spelling"]) for r in got] == [("github.com/team/tool", 2, 3, "git@github.com:Team/Tool.git")]


def test_strings(spark):
    assert column(spark, ["=1", "a", None, "-x"], strings.csv_safe) == ["'=1", "a", "", "'-x"]
    assert column(spark, [" AB ", "None", ""], strings.normalize_hash) == ["ab", None, None]
    assert column(spark, ["https://u:p@h/x", "https://h/x"], strings.redact_url) == ["https://h/x", "https://h/x"]
    assert column(spark, ["aé", "日本", "ab"], lambda c: strings.utf8_head(c, 2)) == ["a", "", "ab"]
    assert column(spark, ['["a","b"]', "bad", None], strings.terms) == ["a b", "", ""]
    assert column(spark, ["a/b", "/a", "a/../b", "", "a\\b"], strings.is_safe_member) == [True, False, False, False, False]
    assert column(spark, ["ok.1", "..", "a/b"], strings.is_safe_name) == [True, False, False]


def test_executables(spark):
    rows = [("plain", b"MZ\x90"), ("sample", b"\x7fELF\x02"), ("tool", b"#!/usr/bin/env python\n"), ("run.PS1", b"x"), ("library.DLL", b""), ("notes.txt", b"hi"), ("empty", b"#!  \n")]
    df = spark.createDataFrame(rows, "p string, c binary")
    assert [r["x"] for r in df.select(is_exec_candidate(F.col("c"), F.col("p")).alias("x")).collect()] == [True] * 5 + [False] * 2
    d = spark.createDataFrame([("a.exe", None), ("a.txt", "PE32 executable"), ("a.exe", "JPEG image"), ("notes.txt", None), ("x.apk", "Zip archive data")], "p string, d string")
    assert [r["x"] for r in d.select(classify_exec(F.col("d"), F.col("p")).alias("x")).collect()] == ["extension fallback: .exe", "magic: pe32", None, None, "extension fallback: .apk"]
    told = ["ELF 64-bit LSB shared object", "ASCII text, with very long lines", "data", "Zip archive data, at least v1", " POSIX shell script, text ", "text, ascii text", "Dalvik dex file"]
    e = spark.createDataFrame([(k, f"dir.d/x{k}.sh", t) for k, t in enumerate(told)], "k int, p string, d string").orderBy("k")
    assert [r["x"] for r in e.select("k", classify_exec(F.col("d"), F.col("p")).alias("x")).orderBy("k").collect()] == ["magic: elf 64-bit", "extension fallback: .sh", "extension fallback: .sh", None, "magic: posix shell script", None, "magic: dex"]
    assert [r["x"] for r in d.select(classify_exec_loose(F.col("d"), F.col("p")).alias("x")).collect()][2] == "extension fallback: .exe"


def test_candidate_filters(spark):
    df = spark.createDataFrame([("in/release/blob-7.bin", 5), ("in/staging/x.bin", 5), ("in/release/a.txt", 5), ("other/b.exe", 500)], "path string, size long")
    got = match_candidates(df, "path", "size", ["*.exe", "*.bin"], ["^other/", "^in/release/"], 100)
    assert [r["path"] for r in got.collect()] == ["in/release/blob-7.bin"]


def test_quotes(spark):
    assert column(spark, ["aaaa"], lambda c: quote_positions(c, F.lit("aa"))[1]) == [3]
    quotes = spark.createDataFrame([(1, 1, "exact words"), (2, 1, "Invented"), (3, 9, "exact words")], "quote_id long, source_id long, quote string")
    sources = spark.createDataFrame([(1, "before, exact words and more")], "source_id long, content string")
    got = {r["quote_id"]: (r["state"], r["start_offset"]) for r in validate_quotes(quotes, sources).collect()}
    assert got == {1: ("valid", 8), 2: ("not_in_source", None), 3: ("unknown_source", None)}


def test_text_that_ends_a_quotation_of_patterns(spark):
    """Data in a regular expression stays data."""
    odd = r"a\E.*\Qb"
    assert column(spark, [f"x{odd}{odd}y", "axxb"], lambda c: quote_positions(c, F.lit(odd))[1]) == [2, 0]
    quotes = spark.createDataFrame([(1, 1, r"end \E of"), (2, 1, r"\E"), (3, 1, "")], "quote_id long, source_id long, quote string")
    sources = spark.createDataFrame([(1, r"the end \E of it \E")], "source_id long, content string")
    got = {r["quote_id"]: (r["state"], r["start_offset"], r["occurrences"]) for r in validate_quotes(quotes, sources).collect()}
    assert got == {1: ("valid", 4, 1), 2: ("valid", 8, 2), 3: ("not_in_source", None, None)}
    people = spark.createDataFrame([(1, r"A\E|B")], "repository_id long, person string")
    told = spark.createDataFrame([(1, 1, r"A\E|B is a native Korean speaker"), (1, 2, "B is a native Greek speaker")], "repository_id long, source_id long, content string")
    assert [r["language"] for r in explicit_language(told, people, ["Korean", "Greek"]).collect()] == ["Korean"]


def test_search(spark):
    df = spark.createDataFrame([(1, "one log-reader for lines"), (2, "nothing here"), (3, "reader reader reader")], "id long, text string")
    assert [r["id"] for r in bm25_search(df, "id", "text", "reader").collect()] == [3, 1]
    assert [r["id"] for r in bm25_search(df, "id", "text", "log-reader (").collect()] == [1]
    cafe = spark.createDataFrame([(1, "Le café Ünïque"), (2, "le cafe unique"), (3, "cafe\u0301 e\u0301")], "id long, text string")
    assert sorted(r["id"] for r in bm25_search(cafe, "id", "text", "cafe").collect()) == [1, 2, 3]
    assert sorted(r["id"] for r in bm25_search(cafe, "id", "text", "CAFÉ unique").collect()) == [1, 2]
    for bad in ("", "  ", "***()"):
        try:
            query_terms(bad)
        except ValueError:
            continue
        raise AssertionError(bad)


def test_traversal_order(spark):
    paths = ["b/a", "a/z", "c", "a/b/c", "B", "a/a"]
    df = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(traversal_key(F.col("p")))
    assert [r["p"] for r in df.collect()] == ["B", "c", "a/a", "a/z", "a/b/c", "b/a"]
