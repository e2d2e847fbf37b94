import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkintel.llm.mixing import mix_sources, mixed_documents


def targets(sizes):
    """Repeated sharing until no source is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    found, free, rest = {}, set(names), sum(sizes.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return found | share
        for s in over:
            found[s] = 3 * sizes[s]
            rest -= found[s]
        free -= over
    return found


def test_targets_and_taken(docs, rows):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += words(r[1])
    want = targets(sizes)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(words(r[1]) for r in rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    small = min(words(r[1]) for r in rows if words(r[1]) > 1)
    for source, size in sizes.items():
        assert abs(taken[source] - want[source]) <= max(0.02 * size, 10 * small)


def test_rates_solve_the_dual(docs):
    """The rates of each source are those of an exponential tilt, capped, that meets its target; by bisection."""
    own = defaultdict(list)
    for r in mix_sources(docs).collect():
        own[r["source"]].append(r)
    for found in own.values():
        mean, target = found[0]["source_size"] / len(found), found[0]["target"]
        words = [r["size"] for r in found if r["size"]]
        rate = lambda m, size, mean=mean: min(3.0, math.exp(min(2.0, m * size / mean)))
        if not 0 < target < 3 * sum(words) * (1 - 1e-9):
            continue
        low, high = -1000.0, 1000.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(rate(middle, n) * n for n in words) < target else (low, middle)
        for r in found:
            assert r["rate"] == pytest.approx(rate(low, r["size"]) if r["size"] else 1.0, rel=1e-4)


def test_reruns_agree_on_other_partitions(docs):
    key = lambda df: sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in df.collect())
    assert key(mix_sources(docs)) == key(mix_sources(docs.repartition(7)))


def test_one_hot_class(spark):
    """A third of the rows share one size and source; the rest are a source of their own."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a b c d").otherwise(F.repeat(F.lit("w "), (F.col("id") % 50 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise("other").alias("source"))
    got = mix_sources(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    for r in got:
        assert abs(r["taken"] - r["target"]) < 8 and r["most"] <= 3


def test_mixed_documents_have_their_copies(docs):
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mix_sources(docs)
    assert mixed.count() == got.agg(F.sum(F.when(F.col("size") == 0, 1).otherwise(F.col("copies")))).first()[0]


def test_empty(no_docs):
    assert mix_sources(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


def test_texts_without_words_are_not_ranked(spark):
    """Very many of one source: no window over them, and none is lost."""
    rows = [(k, None if k % 2 else " ", "a") for k in range(3000)] + [(5000 + k, "some words here", "a" if k < 5 else "b") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mix_sources(docs)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(got.collect()) == len(rows) and got.where("size = 0 AND (copies > 0 OR taken > 0)").count() == 0
    filters = [line for line in plan.split("Window")[1].splitlines() if "Filter" in line]
    assert "given" in filters[0] and "n#" in filters[0]  # below the window stand only rows that a rank decides


def test_a_step_is_one_short_plan(spark, docs):
    """The driver keeps every plan and job of a session, so that the search asks for few of them."""
    sc, group = spark.sparkContext, "mixing-jobs"
    sc.setJobGroup(group, group)
    try:
        mix_sources(docs).count()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup(group)) < 66
