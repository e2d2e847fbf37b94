"""Languages by script, escapes and the choice of evidence, against the rules spelled out."""

import html
import random
import unicodedata

from pyspark.sql import functions as F

from sparkintel.functions import strings
from sparkintel.functions.scripts import NAMED, SCRIPTS, script_counts
from sparkintel.operators.evidence import infer_language, select_evidence
from tests.test_functions import column


def escaped(text):
    spelled = "".join(f"\\u{ord(c):04x}" if unicodedata.category(c)[0] == "C" or unicodedata.category(c) in ("Zl", "Zp") else c for c in text)
    return html.escape("".join("\\" + c if c in "\\`*_{}[]()#+-.!|~" else c for c in spelled))


def test_escapes(spark):
    shown = ["a*b<c>&", "x\ny", f"{chr(0x202E)}evil{chr(0x200B)}{chr(0x85)}", "it's \"so\"", f"{chr(0xE0001)}tag", "tab\t\x00", chr(0x2028), "naïve 日本 😀", ""]
    assert column(spark, [*shown, None], strings.md_escape) == [*map(escaped, shown), "not recorded"]


def test_cuts_between_characters(spark):
    texts = ["", "abc", "äöü", "日本語", "a😀b😀", "ab日"]
    for most in range(-1, 12):
        want = [t.encode()[: max(most, 0)].decode(errors="ignore") for t in texts]
        assert column(spark, texts, lambda c: strings.utf8_floor(c, F.lit(most))) == want


def test_languages(spark):
    rows = [
        (1, "무엇을 하는지 알려 줍니다 " * 20, None, "Korean"), (2, "ひらがなでかいたものです漢字 " * 12, None, "Japanese"), (3, "plain words " * 20, "en", "English"), (4, "short", "en", "Unknown"),
        (5, "```\nこれは" + "あ" * 200 + "\n```", None, "Unknown"), (6, "Слова и ещё слова " * 10, "ru", "Russian"), (7, "Слова " * 30, "uk", "Slavic-other"), (8, "Слова " * 30, None, "Unknown"),
        (9, "des mots " * 30, "fr", "Unknown"), (10, "漢字" * 80 + "か", None, "Unknown"), (11, "漢字" * 80 + "か", "zh", "Chinese"), (12, "यह शब्द " * 40, "hi", "Hindi"), (13, "λόγος " * 30, "el", "Unknown"),
        (14, "    indented\n" * 30 + "see https://host/" + "a" * 200 + chr(0x2003) + "x", "en", "Unknown"), (15, None, "en", "Unknown"), (16, "שלום " * 30, "ar", "Hebrew"),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "k int, text string, code string")
    got = {r["k"]: r for r in infer_language(df, F.col("text"), F.col("code"), F.col("k")).collect()}
    assert {k: r["category"] for k, r in got.items()} == {r[0]: r[3] for r in rows}
    assert (got[16]["method"], got[16]["detected"]) == ("unicode-script", None) and (got[3]["method"], got[11]["method"]) == ("language-detector", "combined")
    assert (got[9]["detected"], got[9]["rationale"]) == ("fr", "latin script requires a supported detector result") and got[10]["scripts"]["han"] == 160
    none = infer_language(df, F.col("text"), F.col("code"), F.col("k"), eligible=F.lit(False))
    assert {r["category"] for r in none.collect()} == {"Unknown"}


def test_scripts_of_every_letter(spark):
    """Each code point's class is that of its name."""
    codes = [chr(c) for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(codes[k : k + 997]) for k in range(0, len(codes), 997)]
    for text, got in zip(texts, column(spark, texts, script_counts), strict=True):
        want = dict.fromkeys(SCRIPTS, 0)
        for c in filter(str.isalpha, text):
            name = unicodedata.name(c, "")
            found = [s for s, words in NAMED.items() if any(w in name for w in words)]
            want[found[0] if found else "other"] += 1
        assert got.asDict() == want


def chosen(documents, versions, repository, most):
    """The sources of one repository, one after the other."""
    rank = {"readme": 0, "authors": 1, "maintainers": 2}
    latest = {}
    for version, document, content in versions:
        latest[document] = max(latest.get(document, (0, "")), (version, content))
    own = [d for d in documents if d[1] == repository and not d[6] and d[0] in latest]
    own.sort(key=lambda d: d[3])
    own.sort(key=lambda d: d[4], reverse=True)
    own.sort(key=lambda d: (-d[5], rank.get(d[2], 3)))
    out, left = [], most
    for d in own:
        version, content = latest[d[0]]
        cut = content.encode()[:left].decode(errors="ignore")
        if left > 0 and cut:
            out.append((version, cut))
            left -= len(cut.encode())
    return out


def test_evidence_within_a_budget(spark):
    rng = random.Random(11)
    documents, versions = [], []
    for k in range(240):
        documents.append((k, k % 12, rng.choice(["readme", "authors", "maintainers", "notes"]), f"l{k}", rng.choice(["local", "github"]), rng.randrange(3), rng.random() < 0.2))
        for v in range(rng.randrange(1, 4)):
            versions.append((1000 * v + k, k, "".join(rng.choice("aé日😀") for _ in range(rng.randrange(0, 25)))))
    d = spark.createDataFrame(documents, "document_id long, repository_id long, kind string, locator string, origin string, priority int, translation boolean")
    v = spark.createDataFrame([(*x, "h") for x in versions], "version_id long, document_id long, content string, content_hash string").repartition(3)
    for most in (0, 1, 3, 50, 151, 152, 153, 100_000):
        got = {}
        for r in sorted(select_evidence(d, v, most).collect(), key=lambda r: r["place"]):
            assert len(r["content"].encode()) == r["kept"]
            got.setdefault(r["repository_id"], []).append((r["version_id"], r["content"]))
        assert got == {k: x for k in range(12) if (x := chosen(documents, versions, k, most))}
