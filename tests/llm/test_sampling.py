from pyspark.sql import functions as F

from sparkintel.llm.sampling import even_shares, lowest_hashes, lowest_of_labels


def test_lowest_hashes_do_not_depend_on_partitions(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("hash"))
    want = sorted(r["hash"] for r in rows.collect())[:100]
    for parts in (1, 7):
        assert sorted(r["hash"] for r in lowest_hashes(rows.repartition(parts), "hash", 100, "id").collect()) == want
    assert lowest_hashes(rows, "hash", 9000).count() == 5000 and lowest_hashes(rows.where("false"), "hash", 10).count() == 0


def test_copies_count_once_where_asked(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k")).select(F.xxhash64("k").alias("hash"))
    got = [r["hash"] for r in lowest_hashes(rows, "hash", 50, distinct=True).collect()]
    assert len(got) == len(set(got)) >= 10


def test_copies_do_not_shrink_the_sample(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 1).otherwise(F.col("id")).alias("k")).select(F.xxhash64("k").alias("hash"))
    want = sorted({r["hash"] for r in rows.collect()})
    for most in (1, 50, 900, 1400):
        assert [r["hash"] for r in lowest_hashes(rows, "hash", most, distinct=True).collect()] == want[:most]


def test_each_label_has_its_share(spark):
    assert even_shares({"a": 1000, "b": 7, "c": 500}, 107) == {"b": 7, "a": 50, "c": 50} and even_shares({"a": 5, "b": 5, "c": 5}, 2) == {"a": 1, "b": 1, "c": 1}
    rows = spark.range(40_000).select(F.xxhash64(F.col("id") % 1000).alias("hash"), F.when(F.col("id") % 1000 < 3, "rare").otherwise("common").alias("lang"))
    edges = lowest_of_labels(rows, "hash", "lang", 200)
    got = {lang: len({r["hash"] for r in rows.where(F.col("lang") == lang).collect() if r["hash"] <= edge}) for lang, edge in edges.items()}
    assert got == {"rare": 3, "common": 197}
    assert lowest_of_labels(rows.where("false"), "hash", "lang", 200) == {}
