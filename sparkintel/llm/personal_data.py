"""Personal data by weak supervision, in DataFrame operations only.

Candidate spans come from strict and loose patterns. Five labelers vote on each (for, against, or
silent): the strict rule of its kind, its structure (check digit, part ranges, digit counts, quotes on
both sides), a gazetteer (domain ends, number plans, issuer prefixes, reserved networks, names of
credentials and of digests), the words before it, and its edges. Expectation-maximisation over the
counts of vote patterns, by kind, estimates how often each labeler is right on true and on false spans.
A silent labeler says nothing, so that what a labeler never judges is no evidence; reliabilities are
anchored by a few assumed votes and never worse than chance, so that the same evidence has the same
verdict in small tables and in large ones.

The posteriors are soft labels for a logistic span classifier for each kind over features of the span
and its surroundings (length, share of digits, what stands on either side, cue and name before it),
which sees no votes. Spans of the strict rules always stay; the classifier adds others that do not
overlap them.

Vote patterns are at most 3^5 a kind and feature patterns at most 1024, whatever the corpus, so both
fits are on the driver; finding, voting, counting and scoring are columns. Texts are read once to find
spans, each pattern runs once over a text, and a second time only where it has found something.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.llm.staging import Staged

#: The base patterns, made linear with possessive quantifiers and checks of what precedes,
#: which come after a first character, as most places fail at that.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9]{2})[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9]{2})(?<![0-9][ -][0-9])(?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?i:dot)[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "phone": r"(?=[(2-9])(?<![0-9+(.-])(?<!\+[0-9]{1,3}[ .-])\(?[2-9][0-9]{2}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9])(?=[a-f]*+[0-9])[0-9a-f]{32,64}+(?![A-Za-z0-9])",
}
#: What a match of each pattern must have in it, to pass over most texts at once: a character, or a pattern that is quick.
NEEDS = {("email", True): "@", ("phone", True): "+", ("ip", False): ":"}
NEEDS_LIKE = {
    ("ip", True): r"[0-9]\.[0-9]", ("card", True): "[0-9][ -]?[0-9]", ("email", False): r"[\[(][aA][tT][\])]", ("phone", False): "[0-9][ .-][0-9]{4}", ("secret", False): "[0-9][0-9a-f]{16}|[0-9a-f]{16}[0-9]",
}
KINDS = ["email", "ip", "card", "phone", "secret"]
#: Fixed values.
DOMAIN_ENDS = "com org net edu gov mil int info biz io co dev app de fr es it nl uk us eu ch at be pl pt ca au jp cn in br ru se no fi dk".split()
CUES = "e-?mail|mail to|contact|phone|tel|call|mobile|fax|ip|host|server|address|card|visa|account|token|key|secret|password|api"
COUNTER_CUES = "version|release|isbn|issn|sku|order|invoice|section|license|build|rev"
CREDENTIALS = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential"
DIGESTS = "sha-?[0-9]*|md5|commit|digest|checksum|hash|revision|etag|fingerprint"
#: A name, then what may stand between it and its value.
NAMED = r"(^|[^a-z0-9])({})[a-z_-]{{0,8}}[ \t]*([:=]|is)?[ \t]*[\"'`(]?$"
VOTERS = ["rule", "structure", "gazetteer", "context", "edges"]
#: How often a labeler is assumed to be right, by so many votes, before any is seen.
ANCHOR, ANCHOR_VOTES = 0.8, 10.0
#: Features of a span and the number of their values, from 0.
FEATURES = {"f_length": 4, "f_digits": 4, "f_before": 4, "f_after": 4, "f_cue": 4}
ACCEPT = 0.95
CONTEXT = 24


def _searched(text: Column, kind: str, base: bool) -> Column:
    if need := NEEDS.get((kind, base)):
        return F.when(F.contains(text, F.lit(need)), text).otherwise("")
    return F.when(text.rlike(need), text).otherwise("") if (need := NEEDS_LIKE.get((kind, base))) else text


def _matches(found: Column, gaps: Column, kind: str, base: bool) -> Column:
    """Per match: kind, base, its number, itself, the length of the gap before it, that gap's end and what follows.

    found: the matches; gaps: what stands before each of them, and after the last.
    """
    both = F.arrays_zip(found.alias("found"), F.slice(gaps, 1, F.size(found)).alias("gap"), F.slice(gaps, 2, F.size(found)).alias("next"))
    return F.transform(
        both, lambda z, n: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), n.cast("int").alias("n"), z["found"].alias("found"), F.length(z["gap"]).alias("gap"), F.right(z["gap"], F.lit(CONTEXT)).alias("before"), F.left(z["next"], F.lit(1)).alias("after"))
    )


def _luhn(digits: Column) -> Column:
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, n: F.when(n % 2 == 1, d.cast("int") * 2).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


def candidates(docs: DataFrame, text: Column, *keep: Column) -> DataFrame:
    """A row for each candidate span with its votes: keep..., kind, start, end, is_base, votes."""
    patterns = [(k, True, p) for k, p in BASE.items()] + [(k, False, p) for k, p in LOOSE.items()]
    named = docs.select(*keep, F.coalesce(text, F.lit("")).alias("text"))
    names = named.columns[:-1]
    found = named.select(*names, "text", *[F.regexp_extract_all(_searched(F.col("text"), k, base), F.lit(p), F.lit(0)).alias(f"m{i}") for i, (k, base, p) in enumerate(patterns)])
    gaps = [F.when(F.size(f"m{i}") > 0, F.split("text", F.lit(p), F.lit(-1))).alias(f"g{i}") for i, (_, _, p) in enumerate(patterns)]
    found = found.select(*names, *[f"m{i}" for i in range(len(patterns))], *gaps)
    none = F.array().cast("array<struct<kind:string,base:boolean,n:int,found:string,gap:int,before:string,after:string>>")
    lists = [F.when(F.size(f"m{i}") > 0, _matches(F.col(f"m{i}"), F.col(f"g{i}"), k, base)).otherwise(none) for i, (k, base, _) in enumerate(patterns)]
    # Outer, as otherwise a filter on the size of the lists would be put before them and find them all once more.
    rows = found.select(*names, F.explode_outer(F.concat(*lists)).alias("x")).where("x IS NOT NULL").select(*names, "x.*").distinct()  # repeated rows find the same
    run = Window.partitionBy(names[0], "kind", "base").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("found")).over(run)
    rows = rows.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("found"))
    kind, base, digits = F.col("kind"), F.col("base"), F.regexp_replace("found", "[^0-9]", "")
    parts = F.split("found", r"\.")
    small = F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(parts, lambda p: F.coalesce(F.right(p, F.lit(9)).try_cast("int"), F.lit(999)) <= 255)
    structure = (
        F.when((kind == "ip") & base, small)
        .when(kind == "ip", F.col("found").contains(":"))
        .when(kind == "card", F.length(digits).between(14, 19) & _luhn(digits))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .when(kind == "secret", F.length(digits).between(F.length("found") / 4, F.length("found") * 9 / 10))
        .otherwise(True)
    )
    rows = rows.withColumn("sound", structure).withColumn("is_base", base & F.col("sound"))
    domain = F.lower(F.regexp_extract("found", r"([A-Za-z0-9-]+)$", 1))
    first = F.regexp_extract("found", r"^([0-9]+)", 1).try_cast("int")
    gazetteer = (
        F.when(kind == "email", _vote(domain.isin(DOMAIN_ENDS), domain.rlike("^[0-9-]")))
        .when((kind == "ip") & base, _vote(first.between(1, 223) & ~first.isin(10, 127), first.isNull() | (first >= 240)))
        .when(kind == "card", _vote(digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6(011|5))"), digits.rlike("^[0789]")))
        .when(kind == "phone", _vote(digits.rlike("^(1[2-9]|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"), digits.rlike("^0")))
        .when(kind == "secret", _vote(F.lower("before").rlike(NAMED.format(CREDENTIALS)), F.lower("before").rlike(NAMED.format(DIGESTS))))
        .otherwise(0)
    )
    before = F.lower("before")
    cue, counter = before.rlike(rf"(^|[^a-z])({CUES})\b[^a-z0-9]*$"), before.rlike(rf"(^|[^a-z])({COUNTER_CUES})\b[^a-z]*$")
    quoted = before.rlike("[\"'`]$") & F.col("after").isin('"', "'", "`")
    votes = {
        "rule": F.when(base, _vote(F.col("sound"), ~F.col("sound"))).otherwise(0),
        # A run of hexadecimal digits is sound by its pattern alone; only its quotes speak for it.
        "structure": F.when(kind == "secret", _vote(F.col("sound") & quoted, ~F.col("sound"))).otherwise(_vote(F.col("sound"), ~F.col("sound"))),
        "gazetteer": gazetteer,
        # Without a cue, a run of hexadecimal digits is more often a digest.
        "context": _vote(cue, counter | ((kind == "secret") & ~cue)),
        "edges": _vote(before.rlike(r"(^|[\s\"'(\[:=,|])$"), before.rlike(r"[A-Za-z0-9]$")),
    }
    side = lambda c: F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike("^[\"'`(\\[)\\]<>]"), 1).when(c.rlike("^[:=,;.|]"), 2).otherwise(3)
    share = F.length(digits) / F.length("found")
    features = {
        "f_length": F.when(F.length("found") < 12, 0).when(F.length("found") < 20, 1).when(F.length("found") < 36, 2).otherwise(3),
        "f_digits": F.when(share < 0.25, 0).when(share < 0.6, 1).when(share < 0.95, 2).otherwise(3),
        "f_before": side(F.right("before", F.lit(1))), "f_after": side(F.col("after")),
        "f_cue": F.when(before.rlike(NAMED.format(CREDENTIALS)), 3).when(counter | before.rlike(NAMED.format(DIGESTS)), 0).when(cue, 2).otherwise(1),
    }
    return rows.select(*names, "kind", "start", "end", "is_base", *[votes[v].cast("int").alias(v) for v in VOTERS], *[features[f].cast("int").alias(f) for f in FEATURES])


def estimate_reliabilities(counts: list[tuple[str, tuple[int, ...], int]], steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of each vote pattern and the voters' chances: chances[voter, truth, vote + 1], of the votes that it casts.

    Starts from the share of votes for. Silence is left out of the likelihood. ANCHOR_VOTES assumed votes
    stand for each voter and truth, right at a rate of ANCHOR, and two for the share of each kind.
    """
    votes = np.array([v for _, v, _ in counts], int).reshape(len(counts), len(VOTERS))
    n = np.array([c for _, _, c in counts], float)
    kinds = np.array([KINDS.index(k) for k, _, _ in counts], int)
    p = (1 + (votes > 0).sum(1)) / (2 + (votes != 0).sum(1)) if len(n) else np.zeros(0)
    chances = np.zeros((len(VOTERS), 2, 3))
    for _ in range(steps):
        for j in range(len(VOTERS)):
            for truth, weight in ((0, n * (1 - p)), (1, n * p)):
                right = 1 if truth else -1
                good, bad = weight[votes[:, j] == right].sum(), weight[votes[:, j] == -right].sum()
                rate = max(0.5, (good + ANCHOR * ANCHOR_VOTES) / (good + bad + ANCHOR_VOTES))
                chances[j, truth, 1 + right], chances[j, truth, 1 - right] = rate, 1 - rate
        log = np.zeros((len(n), 2))
        for k in range(len(KINDS)):
            here = kinds == k
            share = ((n * p)[here].sum() + 1) / (n[here].sum() + 2)
            log[here] = np.log([1 - share, share])
        for j in range(len(VOTERS)):
            log += np.where(votes[:, [j]] != 0, np.log(np.maximum(chances[j][:, votes[:, j] + 1].T, 1e-12)), 0.0)
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if not len(n) or np.abs(new - p).max() < 1e-9:
            p = new
            break
        p = new
    return p, chances


def _one_hot(features: tuple[int, ...]) -> list[float]:
    return [1.0, *(float(v == x) for v, size in zip(features, FEATURES.values(), strict=True) for x in range(size))]


def train_classifier(counts: list[tuple[tuple[int, ...], float, float]], ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    """Weights of one kind's logistic regression, by Newton steps: (features, spans, those of them that are true).

    Spans count by their share, as a thousand in all, so that the fit is the same at every size of a table.
    """
    x = np.array([_one_hot(f) for f, _, _ in counts])
    n, true = np.array([c for _, c, _ in counts], float), np.array([t for _, _, t in counts], float)
    target, n, weights = true / n, 1000 * n / n.sum(), np.zeros(x.shape[1])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
        gradient = x.T @ (n * (target - q)) - ridge * weights
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(weights)), gradient)
        weights += step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return weights


def classifier_column(weights: dict[str, np.ndarray]) -> Column:
    """The chance that a span is personal data, by its kind's weights; 0 for a kind that was not fitted."""
    scores = F.lit(None).cast("double")
    for kind, own in sorted(weights.items()):
        score, at = F.lit(float(own[0])), 1
        for name, size in FEATURES.items():
            score += F.get(F.array(*[F.lit(float(w)) for w in own[at : at + size]]), F.col(name))
            at += size
        scores = F.coalesce(F.when(F.col("kind") == kind, score), scores)
    return F.coalesce(1 / (1 + F.exp(-scores)), F.lit(0.0))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    spans lists all spans as kind:start:end by start, then kind, in code points, end exclusive; n_* and
    base_sha256 are of the base rules alone. Null text counts as empty; repeated rows each have a row.
    An empty table gives an empty result.
    """
    staged = Staged(docs.sparkSession, "personal-data")
    # An id and its text name a row, also when ids repeat or are null: two hashes stand for the text.
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    texts = rows.select(F.struct("id", F.xxhash64("text", F.lit(1)).alias("hash"), F.xxhash64("text", F.lit(2)).alias("again")).alias("row"), "text")
    voted = staged.write(candidates(texts.where(_may_hold(F.col("text"))), F.col("text"), F.col("row")))
    patterns = voted.groupBy("kind", *VOTERS).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 5 * 3^5 rows
    counts = sorted((r["kind"], tuple(r[v] for v in VOTERS), r["n"]) for r in patterns)
    posterior, _ = estimate_reliabilities(counts)
    names = ", ".join(["kind", *VOTERS, "posterior"])
    # An inline table of as many rows as there are vote patterns; a row of nulls, so that it is never empty.
    values = ["(CAST(NULL AS STRING), 0, 0, 0, 0, 0, 0D)", *(f"('{k}', {', '.join(map(str, v))}, {float(p)!r}D)" for (k, v, _), p in zip(counts, posterior, strict=True))]
    soft = docs.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(values)} AS soft({names})")
    labelled = voted.join(F.broadcast(soft), ["kind", *VOTERS])
    seen = labelled.groupBy("kind", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum("posterior").alias("true")).collect()  # at most 5 * 4^5 rows
    by_kind: dict[str, list] = {}
    for r in seen:
        by_kind.setdefault(r["kind"], []).append((tuple(r[f] for f in FEATURES), r["n"], r["true"]))
    scored = voted.withColumn("score", classifier_column({k: train_classifier(sorted(rows)) for k, rows in by_kind.items()}))
    within = Window.partitionBy("row").orderBy("start", "end")
    base_end = F.max(F.when(F.col("is_base"), F.col("end"))).over(within.rowsBetween(Window.unboundedPreceding, -1))
    base_next = F.min(F.when(F.col("is_base"), F.col("start"))).over(within.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (F.coalesce(base_next, F.col("end")) >= F.col("end"))
    kept = scored.withColumn("free", free).where(F.col("is_base") | (F.col("free") & (F.col("score") >= accept)))
    order = reduce(lambda c, k: c.when(F.col("kind") == k[1], k[0]), list(enumerate(KINDS))[1:], F.when(F.col("kind") == KINDS[0], 0))
    span = F.struct("start", order.alias("place"), "end", "is_base", "kind")
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("all"))
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("all", lambda s: s["is_base"])
    lists = lists.select(
        "row", *[F.size(F.array_remove(F.transform(base, lambda s: s["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(named(base), 256).alias("base_sha256"), named(F.col("all")).alias("spans"), (F.size("all") - F.size(base)).cast("long").alias("n_added"), F.size("all").cast("long").alias("n_spans"),
    )
    none = {f"n_{k}": F.lit(0).cast("long") for k in KINDS[:4]} | {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit(""), "n_added": F.lit(0).cast("long"), "n_spans": F.lit(0).cast("long")}
    return texts.select("row").join(lists, "row", "left").select(F.col("row.id").alias(id_col), *[F.coalesce(c, none[c]).alias(c) for c in none])


def _may_hold(text: Column) -> Column:
    """Whether a text has a digit, an at sign, a bracket before one that is written out, or a colon of an address: else nothing matches."""
    return text.rlike(r"[0-9@\[(:]")
