"""Files of snapshots against an import of one row after the other."""

import random
from datetime import datetime

import pytest

from sparkintel.operators.file_identity import assign_files, file_warnings, merge_files

RANK = {"unknown": 0, "no": 1, "yes": 2}


def key(text):
    try:
        return (1, datetime.fromisoformat(text).isoformat())
    except (TypeError, ValueError):
        return (0, text or "")


def replay(rows):
    """Files in order and warnings, by importing each row; rows of the store are files as they are."""
    files, warnings = [], []
    for row_id, there, _, sha, md5, magic, malicious, created, updated in sorted(rows, key=lambda r: (not r[1], r[2], r[0])):
        magic, verdict = magic or None, malicious if malicious in RANK else "unknown"
        found = None
        if not there:
            found = next((f for f in files if sha and f["sha"] == sha), None)
            if not found and md5:
                other = next((f for f in files if f["md5"] == md5), None)
                if other and sha and other["sha"] and other["sha"] != sha:
                    warnings.append((row_id, "md5_conflict"))
                else:
                    found = other
        if not found:
            files.append({"sha": sha, "md5": md5, "magic": magic, "malicious": verdict, "created": created, "updated": updated, "rows": [row_id]})
            continue
        if found["md5"] and md5 and found["md5"] != md5:
            warnings.append((row_id, "md5_conflict"))
        if magic and found["magic"] and magic != found["magic"]:
            later = key(updated) > key(found["updated"]) and key(updated)[0] == key(found["updated"])[0] == 1
            if later:
                found["magic"] = magic
            else:
                warnings.append((row_id, "magic_conflict"))
        found["magic"] = found["magic"] or magic
        found["sha"], found["md5"] = found["sha"] or sha, found["md5"] or md5
        found["malicious"] = max(found["malicious"], verdict, key=RANK.get)
        found["created"] = min(found["created"], created, key=key)
        found["updated"] = max(found["updated"], updated, key=key)
        found["rows"].append(row_id)
    return files, sorted(warnings)


def made(seed, n, stored):
    rng = random.Random(seed)
    hashes = max(2, n // 8)
    pick = lambda kind, p: f"{kind}{rng.randrange(hashes)}" if rng.random() < p else None
    at = lambda: f"2024-01-{rng.randrange(1, 20):02d} 00:00:00"
    rows = [[k, False, rng.randrange(5), pick("s", 0.6), pick("m", 0.7), rng.choice(["A", "B", "", None]), rng.choice(["yes", "no", "unknown", "odd"]), at(), rng.choice([at(), at(), at(), "no time"])] for k in range(n)]
    # A store has each SHA-256 once and one file without for an MD5.
    shas, alone = set(), set()
    for row in rows[:stored]:
        if (row[3] in shas) if row[3] else (row[4] is None or row[4] in alone):
            continue
        row[1] = True
        (shas if row[3] else alone).add(row[3] or row[4])
    rng.shuffle(rows)
    return rows


SCHEMA = "row_id long, there boolean, import_seq long, sha256 string, md5 string, magic string, malicious string, created_at string, updated_at string"


@pytest.mark.parametrize("seed", range(3))
def test_as_if_imported_one_by_one(spark, seed):
    tables = [made(100 * seed + k, 8 + 5 * k, stored=4 * (k % 3)) for k in range(20)]
    # Many small tables in one, apart by their hashes and numbers.
    rows = [[r[0] + 1000 * t, r[1], r[2], r[3] and f"{r[3]}-{t}", r[4] and f"{r[4]}-{t}", *r[5:]] for t, table in enumerate(tables) for r in table]
    files, warnings = replay(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(3)
    groups = {}
    for r in assign_files(df).collect():
        groups.setdefault(r["group"], []).append(r["row_id"])
    assert sorted(sorted(g) for g in groups.values()) == sorted(sorted(f["rows"]) for f in files)
    got = sorted((r["sha256"] or "", r["md5"] or "", r["magic"] or "", r["malicious"], r["created_at"], r["updated_at"], r["n_rows"]) for r in merge_files(df).collect())
    assert got == sorted((f["sha"] or "", f["md5"] or "", f["magic"] or "", f["malicious"], f["created"], f["updated"], len(f["rows"])) for f in files)
    assert sorted((r["row_id"], r["kind"]) for r in file_warnings(df).collect()) == warnings


def test_cases(spark):
    day = lambda k: f"2024-01-{k:02d}"
    rows = [(1, "a", None, "A", day(1)), (2, "a", None, "", day(3)), (3, "a", None, "B", day(2)), (4, None, "m", None, day(1)), (5, "b", "m", None, day(1)), (6, "c", "m", None, day(1))]
    got = merge_files(spark.createDataFrame(rows, "row_id long, sha256 string, md5 string, magic string, updated_at string").selectExpr("*", "0L AS import_seq", "'no' AS malicious", "updated_at AS created_at"))
    assert sorted((r["sha256"], r["md5"], r["magic"], r["n_rows"]) for r in got.collect()) == [("a", None, "A", 3), ("b", "m", None, 2), ("c", "m", None, 1)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert assign_files(df).count() == merge_files(df).count() == file_warnings(df).count() == 0
