"""A set of stores is imported whole or not at all."""

import pytest
from pyspark.sql import functions as F

from sparkintel.operators import imports
from sparkintel.operators.import_sets import Part, import_set, one_row_a_key, open_store, refers, set_id
from sparkintel.operators.merges import union_ignore
from sparkintel.plans.import_queries import _file_tables, _ip_tables
from sparkintel.sources import exports

SF = "/root/testdata/sf0.001"


def merge_notes(store, snapshots):
    """A small store: notes by key, what is there stays; a blank key refuses the whole."""
    fresh = imports.fresh_snapshots(snapshots["imports"], store["ledger"])
    new = snapshots["notes"].join(fresh.select("source_sha256"), "source_sha256").drop("source_sha256")
    imports._refuse(new.where("key = ''"), "noncanonical note")
    merged = {"notes": union_ignore(store["notes"], new, ["key"]), "ledger": store["ledger"].union(fresh.select("source_sha256"))}
    return imports.Merged(merged, new.agg(F.count(F.lit(1)).alias("rows")))


@pytest.fixture(scope="module")
def parts(spark):
    small = lambda tables: {k: spark.createDataFrame(df.collect(), df.schema).coalesce(1) for k, df in tables.items()}
    ip = _ip_tables(spark, SF)
    notes = {"notes": spark.createDataFrame([("a", "old")], "key string, note string"), "ledger": spark.createDataFrame([], "source_sha256 string")}
    told = {"notes": spark.createDataFrame([("a", "new", "d1"), ("b", "new", "d1")], "key string, note string, source_sha256 string"), "imports": spark.createDataFrame([("d1", 1)], "source_sha256 string, import_seq long")}
    return {
        "addresses": Part(imports.merge_ip, small(ip[1]), small(ip[0]), checks=[one_row_a_key("entities", "ip")]),
        "notes": Part(merge_notes, told, notes, "imports", [refers("notes", "notes", "key")]),
    }


def listed(path):
    return sorted(p.name for p in path.iterdir()) if path.exists() else []


def test_preview_import_and_again(spark, tmp_path, parts):
    root = str(tmp_path / "set")
    dry = import_set(spark, root, parts, dry_run=True)
    assert dry["dry_run"] and dry["previews"]["addresses"]["snapshots_imported"] == 4 and not (tmp_path / "set").exists()
    done = import_set(spark, root, parts)
    assert done["version"] == 1 and done["import_set_id"] == dry["import_set_id"] == set_id(done["sources"]) and done["applied"] == dry["previews"]
    first = open_store(spark, root, "addresses", parts["addresses"], 1)
    assert first["entities"].count() == imports.merge_ip(parts["addresses"].empty, parts["addresses"].snapshots).store["entities"].count()
    again = import_set(spark, root, parts)
    assert again["already_imported"] and [n for n in listed(tmp_path / "set/versions") if not n.startswith(".")] == ["0000000001"] and exports.current_version(spark, root) == 1


def test_all_or_none(spark, tmp_path, parts):
    """What fails in the second store, in a check or at the end leaves the version that was there."""
    root = str(tmp_path / "set")
    exports.write_version(spark, root, {f"{name}/{table}": df for name, part in parts.items() for table, df in part.empty.items()})
    before = open_store(spark, root, "addresses", parts["addresses"], 1)["entities"].count()

    def broken(store, snapshots):
        merged = merge_notes(store, snapshots)
        merged.store["notes"] = merged.store["notes"].withColumn("note", F.raise_error(F.lit("no room")).cast("string"))
        return merged

    own = parts["notes"]
    noncanonical = own.snapshots | {"notes": own.snapshots["notes"].withColumn("key", F.lit(""))}
    unsound = [one_row_a_key("notes", "note")]  # two notes say "new" once another is there
    twice = own.snapshots | {"notes": own.snapshots["notes"].withColumn("key", F.concat("key", F.lit("2")))}
    for odd in (Part(broken, own.snapshots, own.empty, "imports"), Part(merge_notes, twice, own.empty, "imports", unsound), Part(merge_notes, noncanonical, own.empty, "imports")):
        with pytest.raises(Exception, match="no room|not sound|noncanonical"):
            import_set(spark, root, parts | {"notes": odd})
        assert exports.current_version(spark, root) == 1 and len(listed(tmp_path / "set/data")) == 1
    assert open_store(spark, root, "addresses", parts["addresses"], 1)["entities"].count() == before


def test_another_writer_comes_first(spark, tmp_path, parts):
    root, rival = str(tmp_path / "set"), spark.range(3)

    def overtaken(store, snapshots):
        merged = imports.merge_ip(store, snapshots)
        exports.write_version(spark, root, {"t": rival})
        return merged

    own = parts["addresses"]
    with pytest.raises(exports.Conflict):
        import_set(spark, root, {"addresses": Part(overtaken, own.snapshots, own.empty)})
    assert exports.current_version(spark, root) == 1 and exports.read_version(spark, root, "t").count() == 3 and len(listed(tmp_path / "set/data")) == 1


def test_readers_see_old_or_new(spark, tmp_path):
    root = str(tmp_path / "v")
    with pytest.raises(LookupError):
        exports.read_version(spark, root, "t")
    exports.write_version(spark, root, {"t": spark.range(1)})
    old = exports.read_version(spark, root, "t")
    for n in range(2, 13):  # numbers of two digits come after those of one
        exports.write_version(spark, root, {"t": spark.range(n)}, facts={"by": "test"})
        assert exports.read_version(spark, root, "t").count() == n == exports.current_version(spark, root)
    assert old.count() == 1 and exports.read_version(spark, root, "t", 5).count() == 5 and exports.describe_version(spark, root)["by"] == "test"
    with pytest.raises(exports.Conflict):
        exports.publish(spark, root, "elsewhere", 3)
    assert exports.current_version(spark, root) == 12


def test_files_are_merged_into_what_a_merge_gave(spark):
    """Two imports, one after the other, leave the files of one import of both; a bare MD5 that gets its SHA-256 takes its tags along."""
    small = lambda df: spark.createDataFrame(df.collect(), df.schema).coalesce(1)
    _, snapshots = _file_tables(spark, SF)
    snapshots = {k: small(v) for k, v in snapshots.items()}
    digests = [r[0] for r in snapshots["snapshots"].orderBy("import_seq").collect()]
    one = imports.merge_file_store(imports.empty_file_store(spark), snapshots).store
    turn = imports.empty_file_store(spark)
    for digest in digests:
        turn = {k: small(v) for k, v in imports.merge_file_store(turn, {k: v.where(F.col("source_sha256") == digest) for k, v in snapshots.items()}).store.items()}
    names = ["group", "sha256", "md5", "magic", "malicious", "created_at", "updated_at"]
    plain = lambda df, *columns: sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    assert plain(one["files"], *names) == plain(turn["files"], *names) and plain(one["tags"], "group", "value", "first_seen") == plain(turn["tags"], "group", "value", "first_seen")
    columns = "row_id long, import_seq long, sha256 string, md5 string, magic string, malicious string, created_at string, updated_at string, source_sha256 string"
    rest = {k: v.where("false") for k, v in snapshots.items()}

    def then(store, rows, digest, tags=()):
        listed = spark.createDataFrame([(digest, 1)], "source_sha256 string, import_seq long")
        tagged = spark.createDataFrame([(*t, "local", "1", digest) for t in tags], "row_id long, value string, source string, first_seen string, source_sha256 string")
        return imports.merge_file_store(store, rest | {"files": spark.createDataFrame([(*r, None, "no", "1", "1", digest) for r in rows], columns), "tags": tagged, "snapshots": listed}).store

    first = then(imports.empty_file_store(spark), [(1, 1, None, "m"), (2, 1, "a", None)], "d1", [(1, "bare"), (2, "a tag")])
    second = then(first, [(1, 1, "b", "m"), (2, 1, "a", "m"), (3, 1, None, "m")], "d2", [(3, "later")])
    assert sorted((r["group"], r["value"]) for r in second["tags"].collect()) == [("s:a", "a tag"), ("s:b", "bare"), ("s:b", "later")]
    assert sorted((r["sha256"], r["md5"]) for r in second["files"].collect()) == [("a", "m"), ("b", "m")]
