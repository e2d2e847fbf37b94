"""Quality rules: text statistics and a decision list learned from labels.

Sequential covering learns rules for the bad class one after another from a bounded sample of
labelled statistics. A rule is a conjunction of thresholds; it grows on two thirds of what earlier
rules leave, by information gain, until it covers no good document, and is pruned from its end on the
last third, where it must hold by itself. The list becomes one ordered Spark conditional expression
over the statistics of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkintel.llm.sampling import lowest_hashes
from sparkintel.llm.staging import Staged
from sparkintel.llm.words import mix, text_groups, windows, word_bounds, word_hashes

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
#: Labelled rows that the rules are learned from, at most: those of the smallest hashes of their ids.
SAMPLE = 20_000
PRECISION, MOST_RULES, MOST_CONDITIONS = 0.9, 12, 4
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punctuation", "n_lines", "n_distinct"]


def _per_text(values: np.ndarray, upto: np.ndarray) -> np.ndarray:
    sums = np.r_[0, np.cumsum(values)]
    return sums[upto[1:]] - sums[upto[:-1]]


_CLASS = {name: np.isin(np.arange(256), np.frombuffer(chars, np.uint8)) for name, chars in {"n_symbols": SYMBOLS, "n_upper": bytes(range(65, 91)), "n_digits": bytes(range(48, 58)), "n_punctuation": b".,;:!?'\"()-"}.items()}


def _repeated_lines(text: bytes) -> int:
    lines, seen, times = text.split(b"\n"), set(), 0
    for line in lines:
        if line.strip():
            times += line in seen
            seen.add(line)
    return times


def _counts(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    first, last, upto = word_bounds(data, starts)
    hashes, texts = word_hashes(data, first, last), len(starts) - 1
    text_of = np.repeat(np.arange(texts), np.diff(upto))
    solid = np.zeros(len(data) + 1, np.int8)
    solid[first] += 1
    solid[last] -= 1
    whole = (data & 0xC0) != 0x80
    out = {"n_words": np.diff(upto), "word_chars": _per_text(whole & (np.cumsum(solid[:-1]) > 0), starts)}
    out |= {name: _per_text(lut[data], starts) for name, lut in _CLASS.items()}
    out["n_lines"] = _per_text(data == 10, starts) + 1
    view = data.tobytes()
    out["n_dup_lines"] = np.array([_repeated_lines(view[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)])
    runs = windows(hashes, WINDOW)
    inside = np.flatnonzero(text_of[: len(runs)] == text_of[WINDOW - 1 :]) if len(runs) else np.zeros(0, np.int64)
    keys = mix(runs[inside] + text_of[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, group, times = np.unique(keys, return_inverse=True, return_counts=True)
    again = inside[times[group] > 1]
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(cover[:-1]) > 0, upto)
    out["n_distinct"] = np.bincount(_distinct(text_of, hashes), minlength=texts)
    return out


def _distinct(text_of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The text of each distinct (text, word)."""
    keys = mix(hashes + text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return text_of[np.unique(keys, return_index=True)[1]]


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the counts of every whole text; null counts as empty."""
    kind = docs.schema[id_col].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_counts(data, starts) for _, data, starts in text_groups(batch.column(1))]
            columns = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64) if parts else [], pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=pa.schema([("id", to_arrow_type(kind)), *((c, pa.int64()) for c in COUNTS)]))

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(work, f"id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS))


def features() -> dict[str, Column]:
    """Ratios that the conditions test, 0 where there is nothing to divide by."""
    c = F.col
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    return {
        "words": c("n_words").cast("double"), "word_length": share("word_chars", "n_words"), "symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "upper": share("n_upper", "word_chars"), "digits": share("n_digits", "word_chars"), "punctuation": share("n_punctuation", "n_words"),
        "words_a_line": share("n_words", "n_lines"), "distinct": share("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.feature] > self.threshold if self.above else x[:, self.feature] <= self.threshold


def _covers(rule: list[Condition], x: np.ndarray) -> np.ndarray:
    return reduce(np.logical_and, [c.holds(x) for c in rule], np.ones(len(x), bool))


def _best_condition(x: np.ndarray, bad: np.ndarray) -> Condition | None:
    """The threshold of most information gain for the bad class, midway between two values."""
    p0, n0 = bad.sum(), len(bad) - bad.sum()
    best, most = None, 1e-9
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        value, up = x[order, f], np.cumsum(bad[order])
        cut = np.flatnonzero(value[1:] > value[:-1])
        if not len(cut):
            continue
        below, count = up[cut], cut + 1
        for above in (False, True):
            p, n = (p0 - below, n0 - (count - below)) if above else (below, count - below)
            gain = p * (np.log2((p + 1e-9) / (p + n)) - np.log2(p0 / (p0 + n0)))
            k = int(np.argmax(gain))
            if gain[k] > most:
                most, best = gain[k], Condition(f, above, float((value[cut[k]] + value[cut[k] + 1]) / 2))
    return best


def learn_rules(x: np.ndarray, bad: np.ndarray, seed: int = 0) -> list[list[Condition]]:
    """Ordered rules, each for the bad class."""
    rules: list[list[Condition]] = []
    left = np.arange(len(x))
    chance = np.random.default_rng(seed)
    while len(rules) < MOST_RULES and bad[left].sum() >= 3:
        chance.shuffle(left)
        grow, prune = left[: 2 * len(left) // 3], left[2 * len(left) // 3 :]
        rule: list[Condition] = []
        inside = grow
        while len(rule) < MOST_CONDITIONS and len(inside) and bad[inside].any() and not bad[inside].all():
            if (condition := _best_condition(x[inside], bad[inside])) is None:
                break
            rule.append(condition)
            inside = inside[condition.holds(x[inside])]

        def worth(rule: list[Condition], rows: np.ndarray) -> tuple[float, float]:
            covered = bad[rows[_covers(rule, x[rows])]]
            return (2 * covered.mean() - 1 if len(covered) else -1.0), float(covered.sum())

        while len(rule) > 1 and worth(rule[:-1], prune) >= worth(rule, prune):
            rule = rule[:-1]
        covered = left[_covers(rule, x[left])] if rule else left[:0]
        if not len(covered) or bad[covered].mean() < PRECISION or (worth(rule, prune)[0] + 1) / 2 < PRECISION:
            break
        rules.append(rule)
        left = np.setdiff1d(left, covered)
    return rules


def rule_column(rules: list[list[Condition]], names: list[str]) -> Column:
    """The number of the first rule that holds, from 1; null for none."""
    chain = F.when(F.lit(False), F.lit(0))
    for number, rule in enumerate(rules, 1):
        tests = [F.col(names[c.feature]) > c.threshold if c.above else F.col(names[c.feature]) <= c.threshold for c in rule]
        chain = chain.when(reduce(lambda a, b: a & b, tests), F.lit(number))
    return chain


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per input row: id, the counts, base_failed, rule, kept.

    base_failed: fewer than 20 words, or over 30% of the words in repeated windows. Without a usable
    label (null labels and labels of other documents don't count) there is no rule, and the base alone
    decides. Null text counts as empty. Repeated rows each have a row. An empty table gives an empty
    result.
    """
    staged = Staged(docs.sparkSession, "quality")
    counted = staged.write(text_counts(docs, id_col, text_col))
    ratios = features()
    marks = labels.select(labels[id_col].alias("id"), labels[label_col].alias("label")).where("label IS NOT NULL AND id IS NOT NULL").distinct()
    known = lowest_hashes(counted.join(marks, "id").withColumn("hash", F.xxhash64("id")), "hash", sample, "id", "label")
    table = known.select(*[c.alias(n) for n, c in ratios.items()], F.col("label").cast("int").alias("label")).toPandas()
    rules = learn_rules(table[list(ratios)].to_numpy(float), (table["label"] == 0).to_numpy())
    judged = counted.select("*", *[c.alias(n) for n, c in ratios.items()]).withColumn("rule", rule_column(rules, list(ratios)))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select(F.col("id").alias(id_col), *COUNTS[:5], failed.alias("base_failed"), F.col("rule").cast("int").alias("rule"), (~failed & F.col("rule").isNull()).alias("kept"))
