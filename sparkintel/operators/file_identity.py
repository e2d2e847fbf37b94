"""Which rows of many snapshots are one file, by SHA-256 and MD5, as if they were imported one after the other.

An import finds a row's file by its SHA-256, else by its MD5: the oldest file that has it at that moment,
unless both have a SHA-256 and these differ; what finds none becomes a file. A file lacking one of the
hashes takes it from the first row that brings it. So files depend on the order of the rows. Here that
order is not replayed; what it leads to follows from a few minima of each hash:

* a file of a SHA-256 gets the first MD5 that its rows bring, when the first of them brings it;
* a row without SHA-256 makes a file if no file has its MD5 before, and then the first row that starts a
  SHA-256 with that MD5 joins it, unless an older file has taken the MD5 in the meantime;
* the file that an MD5 finds changes only when an older file takes that MD5 later on, so that the
  files it finds are the record lows of their ages.

Rows only meet in aggregates, in joins to one row a hash, and in windows over those record lows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.functions.strings import normalize_hash
from sparkintel.operators.merges import max_verdict, timestamp_key

FILE_VERDICTS = ["yes", "no", "unknown"]


def _ordered(rows: DataFrame) -> DataFrame:
    """row_id, sha256, md5, known_as and `at`: files of the store first, then by import, place and row."""
    own = lambda name, otherwise: F.col(name) if name in rows.columns else otherwise
    base = rows.select(
        "row_id", (~own("there", F.lit(False))).alias("new"), own("import_seq", F.lit(0)).cast("long").alias("import_seq"), own("place", F.lit(0)).cast("long").alias("place"),
        normalize_hash(F.col("sha256")).alias("sha256"), normalize_hash(F.col("md5")).alias("md5"), own("known_as", F.concat(F.lit("r:"), F.col("row_id").cast("string"))).alias("known_as"),
    )
    return base.select("row_id", "sha256", "md5", "known_as", F.struct("new", "import_seq", "place", "row_id").alias("at"))


def _least(c: Column, when: Column) -> Column:
    return F.min(F.when(when, c))


def assign_files(rows: DataFrame) -> DataFrame:
    """row_id, group, conflict: the file of each row, and `md5_conflict` where its MD5 is another file's or not its file's.

    rows: row_id, sha256, md5; import_seq, place (else 0) and row_id give the order, and `there` (else false)
    marks rows that are files of the store already, which come first and are not joined with each other
    unless they have one name. A file is named by its SHA-256, else by its MD5, else by `known_as` (else
    its row). Blank hashes are none.
    """
    base = _ordered(rows)

    # Each SHA-256: when it starts, and the MD5 that its file has and since when.
    told = F.min(F.when(F.col("md5").isNotNull(), F.struct("at", "md5")))
    shas = base.where("sha256 IS NOT NULL").groupBy("sha256").agg(F.min("at").alias("starts"), told.alias("told")).select("sha256", "starts", F.col("told.at").alias("takes"), F.col("told.md5").alias("md5"))
    taking = shas.where("md5 IS NOT NULL")
    fresh = F.col("starts.new") & (F.col("starts") == F.col("takes"))

    # Each MD5: its file without SHA-256 (`bare`), and the SHA-256 that may join that.
    alone = base.where("sha256 IS NULL AND md5 IS NOT NULL").groupBy("md5").agg(_least(F.col("at"), ~F.col("at.new")).alias("stored"), _least(F.col("at"), F.col("at.new")).alias("told"))
    first = taking.groupBy("md5").agg(F.min("takes").alias("first"), F.min(F.when(fresh, F.struct("takes", "sha256"))).alias("joins"))
    facts = first.join(alone, "md5", "full_outer")
    bare = F.coalesce("stored", F.when(F.col("first").isNull() | (F.col("told") < F.col("first")), F.col("told")))
    facts = facts.select("md5", "first", "joins", bare.alias("bare"))
    older = taking.where(~fresh).join(facts.where("bare IS NOT NULL AND joins IS NOT NULL").select("md5", "joins", "bare"), "md5")
    blocked = older.where((F.col("takes") < F.col("joins.takes")) & (F.col("starts") < F.col("bare"))).select("md5").distinct().withColumn("blocked", F.lit(True))
    facts = facts.join(blocked, "md5", "left").select("md5", "first", "bare", F.when(F.col("bare").isNotNull() & F.col("blocked").isNull(), F.col("joins.sha256")).alias("joined"))

    name = lambda kind, c: F.concat(F.lit(kind), c)
    of_sha = name("s:", F.col("sha256"))
    with_facts = shas.join(facts, "md5", "left")
    joined = F.coalesce(F.col("joined") == F.col("sha256"), F.lit(False))
    # A row that starts a SHA-256 whose MD5 some file has, and is not joined with it.
    stands = fresh & ~joined & ((F.col("first") < F.col("starts")) | F.coalesce(F.col("bare") < F.col("starts"), F.lit(False)))
    by_sha = with_facts.select("sha256", "starts", "takes", F.col("md5").alias("has"), F.coalesce(stands, F.lit(False)).alias("stands"))

    # What an MD5 finds: the files that take it, each if it is older than all that took it before.
    ages = taking.join(facts, "md5").where(~fresh | (F.col("takes") == F.col("first")) | joined)
    ages = ages.select("md5", F.col("takes").alias("from"), F.when(joined, F.col("bare")).otherwise(F.col("starts")).alias("age"), of_sha.alias("group"))
    bares = facts.where("bare IS NOT NULL").select("md5", F.col("bare").alias("from"), F.col("bare").alias("age"), F.coalesce(name("s:", F.col("joined")), name("m:", F.col("md5"))).alias("group"))
    order = Window.partitionBy("md5").orderBy("from")
    before = F.min("age").over(order.rowsBetween(Window.unboundedPreceding, -1))
    lows = ages.unionByName(bares).withColumn("before", before).where(F.col("before").isNull() | (F.col("age") < F.col("before")))
    lows = lows.withColumn("until", F.lead("from").over(order)).select("md5", "from", "until", "group")

    named = base.where("sha256 IS NOT NULL").join(by_sha, "sha256")
    other = F.coalesce((F.col("md5") != F.col("has")) & (F.col("takes") < F.col("at")), F.lit(False))
    clash = F.when((F.col("stands") & (F.col("at") == F.col("starts"))) | other, "md5_conflict")
    one = named.select("row_id", of_sha.alias("group"), clash.alias("conflict"))
    plain = base.where("sha256 IS NULL AND md5 IS NOT NULL")
    stored = plain.where("NOT at.new").join(facts.select("md5", "joined"), "md5")
    two = stored.select("row_id", F.coalesce(name("s:", F.col("joined")), name("m:", F.col("md5"))).alias("group"), F.lit(None).cast("string").alias("conflict"))
    met = plain.where("at.new").join(lows, "md5").where((F.col("from") <= F.col("at")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    three = met.select("row_id", "group", F.lit(None).cast("string").alias("conflict"))
    none = base.where("sha256 IS NULL AND md5 IS NULL").select("row_id", F.col("known_as").alias("group"), F.lit(None).cast("string").alias("conflict"))
    return one.union(two).union(three).union(none)


def _in_turn(rows: DataFrame, files: DataFrame | None) -> DataFrame:
    """Rows with `at`, `group`, clean values, whether each is newer than all of its file before it, and the magic held until then."""
    own = rows.join(assign_files(rows) if files is None else files, "row_id").join(_ordered(rows).select("row_id", "at"), "row_id")
    own = own.withColumn("magic", F.nullif(F.trim("magic"), F.lit(""))).withColumn("malicious", F.when(F.col("malicious").isin(FILE_VERDICTS), F.col("malicious")).otherwise("unknown"))
    own = own.withColumn("when", timestamp_key(F.col("updated_at")))
    before = Window.partitionBy("group").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("when").over(before)
    own = own.withColumn("newer", F.coalesce(F.col("when.valid") & newest["valid"] & (F.col("when") > newest), F.lit(False)))
    held = F.coalesce(F.last(F.when(F.col("newer"), F.col("magic")), True).over(before), F.first("magic", True).over(before))
    return own.withColumn("held", held)


def merge_files(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row for each file of several snapshots: group, sha256, md5, magic, malicious, created_at, updated_at, n_rows.

    rows: as for `assign_files`, and magic, malicious, created_at, updated_at. A row that is newer than all
    before it gives its magic, another fills a blank one; verdicts take the greatest; of times that are
    equal or no times, the first stays. files: the rows of `assign_files`, where they are there already.
    """
    own = _in_turn(rows, files)
    # Of equally late rows the first: the order turned round.
    back = F.struct(F.when(F.col("at.new"), 0).otherwise(1), -F.col("at.import_seq"), -F.col("at.place"), *([] if dict(rows.dtypes)["row_id"] == "string" else [-F.col("row_id")]))
    told = F.col("magic").isNotNull()
    magic = F.coalesce(F.max_by("magic", F.when(F.col("newer") & told, F.col("at"))), F.min_by("magic", F.when(told, F.col("at"))))
    md5 = normalize_hash(F.col("md5"))
    return own.groupBy("group").agg(
        F.max(normalize_hash(F.col("sha256"))).alias("sha256"), F.min_by(md5, F.when(md5.isNotNull(), F.col("at"))).alias("md5"), magic.alias("magic"),
        F.coalesce(max_verdict(F.col("malicious"), FILE_VERDICTS), F.lit("unknown")).alias("malicious"),
        F.min_by("created_at", F.struct(timestamp_key(F.col("created_at")).alias("k"), "at")).alias("created_at"), F.max_by("updated_at", F.struct(F.col("when"), back)).alias("updated_at"), F.count(F.lit(1)).alias("n_rows"),
    )


def file_warnings(rows: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """row_id, kind: rows whose MD5 is in conflict, and rows whose magic was another and not newer."""
    own = _in_turn(rows, files)
    stays = F.when((F.col("magic") != F.col("held")) & ~F.col("newer"), "magic_conflict")
    return own.where("at.new").select("row_id", F.explode(F.array_compact(F.array("conflict", stays))).alias("kind"))
