"""Language identification in two steps: the family, then the language within it.

A text is the histogram of its byte pairs and triples, lower-cased and with single spaces, hashed and
square-rooted. Linear support vector machines, one for each family against the rest, name the family;
inside it, one for each pair of its languages votes. All are fitted on a bounded sample of labelled
rows by Newton steps on the squared hinge loss, in tasks. Texts are scored whole, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkintel.llm.sampling import lowest_of_labels
from sparkintel.llm.staging import Staged

SIZE = 2048
#: Labelled texts that the machines are fitted on, at most: for each label those of the smallest hashes.
SAMPLE = 2000
UNKNOWN = "und"
#: Families of common languages; a language that is not here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "sinitic": "zh yue".split(),
    "semitic": "ar he am".split(),
    "indic": "hi bn ur pa gu mr ne".split(),
}
_FAMILY = {language: family for family, own in FAMILIES.items() for language in own}
_SLICE = 1 << 18


def family_of(language: str) -> str:
    return _FAMILY.get(language.lower().partition("-")[0], language)


def text_features(text: str) -> np.ndarray:
    """The root of the share of each hashed pair and triple of bytes; of length 1."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "replace"), np.uint8)
    counts = np.zeros(SIZE)
    for at in range(0, len(data), _SLICE):
        a = data[at : at + _SLICE + 2].astype(np.int32)
        pairs = a[:-1] * 257 + a[1:]
        triples = pairs[:-1] * 263 + a[2:]
        counts += np.bincount((pairs * 2654435 >> 7) & SIZE - 1, minlength=SIZE) + np.bincount((triples * 40503 >> 5) & SIZE - 1, minlength=SIZE)
    return np.sqrt(counts / max(1.0, counts.sum()))


def fit_machine(x: np.ndarray, up: np.ndarray, cost: float = 10.0, steps: int = 20) -> np.ndarray:
    """Weights and offset of a linear machine: least |w|^2 / 2 + cost * mean squared hinge."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    y, w = np.where(up, 1.0, -1.0), np.zeros(x.shape[1])
    weight = cost * len(x) * np.where(up, 0.5 / max(1, up.sum()), 0.5 / max(1, (~up).sum()))
    for _ in range(steps):
        active = y * (x @ w) < 1
        a, c = x[active], weight[active]
        gradient = w + a.T @ (c * (a @ w - y[active]))
        if np.abs(gradient).max() < 1e-6 * max(1.0, cost):
            break
        # (I + A' C A)^-1 g by the smaller system in the number of active rows.
        root = np.sqrt(c)[:, None].astype(x.dtype) * a
        w = w - (gradient - root.T @ np.linalg.solve(np.eye(len(root)) + root @ root.T, root @ gradient))
    return w


def machines_of(languages: list[str]) -> dict:
    """The model of so many languages before any machine is fitted: families, their languages, and no weights."""
    groups: dict[str, list[str]] = {}
    for language in sorted(set(languages)):
        groups.setdefault(family_of(language), []).append(language)
    return {"families": sorted(groups), "groups": groups, "against": [], "pairs": {}}


def machine_names(model: dict) -> list[tuple[str, ...]]:
    """(family,) for each machine of a family against the rest, then (a, b) for each pair of one family's languages."""
    against = [(f,) for f in model["families"]] if len(model["families"]) > 1 else []
    return against + [pair for own in model["groups"].values() for pair in combinations(own, 2)]


def fit_named(name: tuple[str, ...], x: np.ndarray, languages: np.ndarray) -> np.ndarray:
    """Weights of one machine, from the features of all texts and their languages."""
    if len(name) == 1:
        return fit_machine(x, np.array([family_of(v) for v in languages]) == name[0])
    here = (languages == name[0]) | (languages == name[1])
    return fit_machine(x[here], languages[here] == name[0])


def fit_on_executors(kept: DataFrame, model: dict) -> dict:
    """The model with its machines, fitted from kept (lang, features); a task takes the sample once and fits its share of the machines.

    The driver gets the weights alone.
    """
    names = machine_names(model)
    tasks = min(len(names), kept.sparkSession.sparkContext.defaultParallelism)
    if not tasks:
        return model

    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table["lang"].to_pylist(), table["features"].to_pylist(), strict=True))  # whatever order rows come in
        x, languages = np.frombuffer(b"".join(f for _, f in rows), np.float32).reshape(-1, SIZE), np.array([v for v, _ in rows])
        own = range(key[0].as_py(), len(names), tasks)
        return pa.table({"machine": pa.array(own, pa.int32()), "weights": pa.array([fit_named(names[k], x, languages).tobytes() for k in own], pa.binary())})

    sent = kept.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "lang", "features")
    fitted = sent.repartitionByRange(tasks, "task").groupBy("task").applyInArrow(work, "machine int, weights binary")
    weights = {names[r["machine"]]: np.frombuffer(bytes(r["weights"])) for r in fitted.collect()}
    against = [weights[(f,)] for f in model["families"]] if len(model["families"]) > 1 else []
    return model | {"against": against, "pairs": {name: w for name, w in weights.items() if len(name) == 2}}


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(3 * margin, -30, 30)))


def predict_language(model: dict, x: np.ndarray) -> tuple[str, float]:
    """The language of one text and a score between 0 and 1."""
    if not model["families"]:
        return UNKNOWN, 0.0
    score, family = 1.0, model["families"][0]
    if model["against"]:
        chances = _chance(np.array([w[:-1] @ x + w[-1] for w in model["against"]]))
        best = int(np.argmax(chances))
        score, family = float(chances[best] / chances.sum()), model["families"][best]
    own = model["groups"][family]
    votes, sure = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0)
    for a, b in combinations(own, 2):
        w = model["pairs"][a, b]
        chance = float(_chance(w[:-1] @ x + w[-1]))
        votes[a if chance >= 0.5 else b] += 1
        sure[a] += chance
        sure[b] += 1 - chance
    best = max(own, key=lambda v: (votes[v], sure[v], v))
    return best, score * (sure[best] / (len(own) - 1) if len(own) > 1 else 1.0)


def learn_languages(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """A model from at most `sample` distinct labelled texts of docs for which `use` holds, by text and label alone.

    Every label is learned, with an even share of the sample or all its texts; copies take no part of it.
    """
    rows = docs.where(use & docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang"))
    edges = lowest_of_labels(rows.select(F.xxhash64("text").alias("hash"), "lang"), "hash", "lang", sample)
    if not edges:
        return machines_of([])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(t).astype(np.float32).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["lang", "features"])

    upto = F.broadcast(docs.sparkSession.createDataFrame(sorted(edges.items()), "lang string, edge long"))
    kept = rows.join(upto, "lang").where(F.xxhash64("text") <= F.col("edge")).select("text", "lang").dropDuplicates(["text", "lang"])  # as many as the sample
    staged = Staged(docs.sparkSession, "languages")
    return fit_on_executors(staged.write(kept.mapInArrow(work, "lang string, features binary")), machines_of(list(edges)))


def has_letter(text: Column) -> Column:
    """Whether a text has a character of Unicode's category L; false for null."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def language_column(model: dict, text: Column) -> Column:
    """lang_pred and score of a text as a struct. Only texts with a letter are sent to Python, and nothing else of a row."""

    def tell(texts: pa.Array) -> pa.Array:
        named, sure = [], []
        for at in range(0, len(texts), 64):
            for t in texts.slice(at, 64).to_pylist():
                language, score = predict_language(model, text_features(t)) if t else (UNKNOWN, 0.0)
                named.append(language)
                sure.append(score)
        return pa.StructArray.from_arrays([pa.array(named, pa.string()), pa.array(sure, pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf(tell, "struct<lang_pred:string,score:double>")(F.when(has_letter(text), text))


def identify_languages(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score, from the whole text alone.

    Null texts and texts without a letter are `und` with score 0, as is every text if nothing was learned.
    """
    told = docs.select(docs[id_col].alias("id"), language_column(model, docs[text_col]).alias("told"))
    return told.select(F.col("id").alias(id_col), "told.lang_pred", "told.score")


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: a fifth, by the crc32 of the id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def language_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that are not held out and predicts every row: id, held_out, lang_pred, score."""
    model = learn_languages(docs, ~held_out(docs[id_col]), id_col, text_col, lang_col)
    found = identify_languages(docs, model, id_col, text_col)
    return found.select(id_col, held_out(F.col(id_col)).alias("held_out"), "lang_pred", "score")
