"""Stores in buckets: imports in turn leave what one import of all leaves, and touch no more than the buckets of their keys."""

import random

import pytest
from pyspark.sql import functions as F

from sparkintel.operators import change_sets, imports
from sparkintel.operators.import_sets import Part, one_row_a_key
from sparkintel.plans.import_queries import _ip_tables, _repo_tables
from sparkintel.sources import exports

SF = "/root/testdata/sf0.001"


def small(tables, spark):
    return {k: spark.createDataFrame(df.collect(), df.schema).coalesce(1) for k, df in tables.items()}


def rows(df, *columns):
    return sorted(tuple(map(str, r)) for r in df.select(*(columns or sorted(df.columns))).collect())


def until(part, seq):
    listing = part.snapshots[part.listing]
    return Part(part.merge, part.snapshots | {part.listing: listing.where(F.col("import_seq") <= seq)}, part.empty, part.listing, part.checks)


def test_imports_in_turn_leave_what_one_import_leaves(spark, tmp_path):
    """All tables of repositories; addresses have a query with SQL."""
    store, snapshots = (small(t, spark) for t in _repo_tables(spark, SF))
    name, root, layout = "repositories", str(tmp_path / "kept"), change_sets.Layout(change_sets.REPO_LAYOUT.keys, buckets=8)
    part = Part(imports.merge_repos, snapshots, store, "imports")
    change_sets.import_changes(spark, root, {name: until(part, 1)}, {name: layout})
    change_sets.import_changes(spark, root, {name: part}, {name: layout})
    got, want = change_sets.open_kept(spark, root, name, part, layout), imports.merge_repos(store, snapshots).store
    assert set(got) == set(want)
    for table in want:
        assert rows(got[table]) == rows(want[table].select(*got[table].columns)), table
    assert change_sets.import_changes(spark, root, {name: part}, {name: layout})["already_imported"] and exports.current_version(spark, root) == 2


def test_an_import_reads_and_writes_the_buckets_it_touches(spark, tmp_path):
    """One address of a large store: one bucket is read and written, others stay in their folder; older versions can be read."""
    root, layout = str(tmp_path / "kept"), change_sets.Layout(change_sets.IP_LAYOUT.keys, change_sets.IP_LAYOUT.grows, 16)
    store = small(_ip_tables(spark, SF)[0], spark)
    store = {k: df.where("false") for k, df in store.items()}
    entity = store["entities"].schema
    names = [f"10.0.{i % 7}.{i}" for i in range(200)]
    made = lambda ips, digest, country: spark.createDataFrame([(ip, 4, country, None, "No", "2024", "2024") for ip in ips], entity).withColumn("source_sha256", F.lit(digest))
    none = {k: df.where("false").withColumn("source_sha256", F.lit("")) for k, df in store.items() if k not in ("entities", "ledger", "runs", "results")} | {k: store[k] for k in ("runs", "results")}
    listed = lambda *digests: spark.createDataFrame(list(digests), "source_sha256 string, import_seq long")
    part = Part(imports.merge_ip, none | {"entities": made(names, "d1", "A"), "snapshots": listed(("d1", 1))}, store, checks=[one_row_a_key("entities", "ip")])
    first = change_sets.import_changes(spark, root, {"a": part}, {"a": layout})
    [(folder, buckets)] = first["places"]["a"]["entities"].items()
    assert len(buckets) == 16

    late = made([names[3]], "d2", "B").withColumn("last_updated", F.lit("2025")).union(made(["10.9.9.9"], "d2", "C"))
    opened = []

    def watched(old, snapshots):
        opened.append({table: set(df.inputFiles()) for table, df in old.items()})
        return imports.merge_ip(old, snapshots)

    second = Part(watched, part.snapshots | {"entities": late.union(made(names, "d1", "A")), "snapshots": listed(("d1", 1), ("d2", 2))}, store, checks=part.checks)
    done = change_sets.import_changes(spark, root, {"a": second}, {"a": layout})
    touched = [r[0] for r in late.select(change_sets.bucket_of(F.col("ip"), 16)).distinct().collect()]
    assert done["touched"] == {"a": {"ip": len(touched)}} and 1 <= len(touched) <= 2
    assert {p.split("bucket=")[1].split("/")[0] for p in opened[0]["entities"]} == {str(b) for b in touched if b in buckets}
    assert not opened[0]["ledger"] and done["applied"]["a"]["entities_inserted"] == 1 and done["applied"]["a"]["entities_merged"] == 1
    places = done["places"]["a"]["entities"]
    assert places[folder] == [b for b in buckets if b not in touched] and sorted(b for f, bs in places.items() if f != folder for b in bs) == sorted(touched)
    now, before = (change_sets.open_kept(spark, root, "a", part, layout, n)["entities"] for n in (2, 1))
    assert now.count() == 201 and before.count() == 200 and now.where("country_code = 'B'").count() == 1 and not before.where("country_code = 'B'").count()
    with pytest.raises(ValueError, match="lies in 16 buckets"):
        change_sets.open_kept(spark, root, "a", part, change_sets.Layout(layout.keys, layout.grows, 8))


def test_what_fails_publishes_nothing(spark, tmp_path):
    """Rows of a bucket that was not read would be there twice: a merge that gives some is refused, as is what checks find."""
    root, layout = str(tmp_path / "kept"), change_sets.Layout({"notes": "key"}, buckets=64)
    store = {"notes": spark.createDataFrame([("a", "old")], "key string, note string"), "ledger": spark.createDataFrame([], "source_sha256 string")}
    told = {"notes": spark.createDataFrame([("b", "new", "d1"), ("c", "new", "d2")], "key string, note string, source_sha256 string"), "imports": spark.createDataFrame([("d1", 1), ("d2", 2)], "source_sha256 string, import_seq long")}

    def merge(old, snapshots, key="key"):
        fresh = imports.fresh_snapshots(snapshots["imports"], old["ledger"]).select("source_sha256")
        new = snapshots["notes"].join(fresh, "source_sha256").select(F.expr(key).alias("key"), "note")
        return imports.Merged({"notes": old["notes"].union(new), "ledger": old["ledger"].union(fresh)}, new.agg(F.count(F.lit(1)).alias("rows")))

    part = Part(merge, told, store, "imports")
    assert change_sets.import_changes(spark, root, {"n": until(part, 1)}, {"n": layout})["applied"] == {"n": {"rows": 1}}
    unsound, moved = Part(merge, told, store, "imports", [lambda s: s["notes"].where("key = 'c'")]), Part(lambda o, n: merge(o, n, "concat(key, 'moved')"), told, store, "imports")
    for odd, why in ((unsound, "not sound"), (moved, "did not read")):
        with pytest.raises(ValueError, match=why):
            change_sets.import_changes(spark, root, {"n": odd}, {"n": layout})
        assert exports.current_version(spark, root) == 1 and len(list((tmp_path / "kept/data").iterdir())) == 1
    change_sets.import_changes(spark, root, {"n": part}, {"n": layout})
    assert rows(change_sets.open_kept(spark, root, "n", part, layout)["notes"]) == [("a", "old"), ("b", "new"), ("c", "new")]


def test_files_by_their_hashes(spark, tmp_path):
    """Random rows with few hashes, in many buckets: files, names and tags after imports in turn, against whole merges in turn."""
    rng, pick = random.Random(3), lambda r, many: r.choice([None, *many])
    columns = "row_id long, import_seq long, sha256 string, md5 string, magic string, malicious string, created_at string, updated_at string, source_sha256 string"
    told, tags = [], []
    for seq in (1, 2, 3):
        for i in range(9):
            at = str(rng.randrange(9))
            told.append((i, seq, pick(rng, "abcdefgh"), pick(rng, "mnopqrst"), pick(rng, ["x", "y"]), rng.choice(["yes", "no", "unknown"]), at, at, f"d{seq}"))
            tags.append((i, rng.choice("uvw"), "local", at, f"d{seq}"))
    child = "row_id long, value string, source string, first_seen string, source_sha256 string"
    snapshots = {
        "files": spark.createDataFrame(told, columns).coalesce(1), "tags": spark.createDataFrame(tags, child).coalesce(1), "file_names": spark.createDataFrame([], child), "observations": spark.createDataFrame([], "row_id long, path string, source_sha256 string"),
        "lookups": spark.createDataFrame([], "row_id long, provider string, status string, completed_at string, raw_path string, source_sha256 string"), "snapshots": spark.createDataFrame([(f"d{n}", n) for n in (1, 2, 3)], "source_sha256 string, import_seq long"),
    }
    layout = change_sets.Layout(change_sets.FILE_LAYOUT.keys, buckets=32, touches=change_sets.touched_files)
    part, root, turn = Part(change_sets.merge_indexed_files, snapshots, change_sets.empty_indexed_store(spark), checks=[one_row_a_key("files", "group")]), str(tmp_path / "kept"), imports.empty_file_store(spark)
    for seq in (1, 2, 3):
        done = change_sets.import_changes(spark, root, {"f": until(part, seq)}, {"f": layout})
        turn = small(imports.merge_file_store(turn, snapshots | {"snapshots": snapshots["snapshots"].where(F.col("import_seq") <= seq)}).store, spark)
        got = change_sets.open_kept(spark, root, "f", part, layout)
        for table in ("files", "tags", "ledger"):
            assert rows(got[table]) == rows(turn[table].select(*got[table].columns)), (seq, table)
        assert rows(got["by_md5"], "md5", "group") == rows(turn["files"].where("md5 IS NOT NULL"), "md5", "group")
        assert rows(got["tops"]) == [(str(turn["files"].agg(F.max("import_seq")).first()[0]),)]
    assert done["touched"]["f"]["group"] < 32 and done["touched"]["f"]["md5"] <= 8
