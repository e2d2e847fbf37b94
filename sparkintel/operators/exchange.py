"""Request bundles, the queue of requests, and budgets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkintel.functions.addresses import canonical_ip
from sparkintel.functions.repositories import repository_key
from sparkintel.functions.strings import is_sha256, is_utc_time, is_uuid
from sparkintel.operators.folds import fitting_in_order, fold_in_order

#: What a bundle holds at most, its fields, what may be asked for, and the measures of a budget.
MOST_ITEMS, MOST_BYTES = 500_000, 64 << 20
BUNDLE_FIELDS = ["schema_version", "bundle_id", "source_instance_id", "source_sequence", "created_at", "selection", "policy_sha256", "files", "ips", "repositories", "counts"]
SELECTIONS = ["missing", "all"]
MEASURES = ["requests", "repositories", "input_tokens", "output_tokens", "cost_micro_usd"]
OUTCOMES = ["success", "not_found", "error", "rate_limited"]


def backoff(base: Column, attempts: Column) -> Column:
    """Seconds until the next try: the base doubled with each attempt, up to eight times and one day."""
    return F.least(F.lit(86_400), base * F.pow(F.lit(2), F.least(attempts, F.lit(8)))).cast("long")


def bundle_violations(items: DataFrame, value: str, bundle: str = "bundle_id", place: str = "place", valid: Column | None = None) -> DataFrame:
    """What is wrong with the lists of bundles: order (not strictly ascending), form, size."""
    before = F.lag(value).over(Window.partitionBy(bundle).orderBy(place))
    ordered = items.withColumn("before", before)
    wrong = F.filter(F.array(F.when(F.col("before") >= F.col(value), "order"), F.when(~valid, "form") if valid is not None else F.lit(None).cast("string")), lambda v: v.isNotNull())
    rows = ordered.select(bundle, place, F.explode(wrong).alias("violation"))
    long = items.groupBy(bundle).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ITEMS).select(bundle, F.lit(None).cast("long").alias(place), F.lit("size").alias("violation"))
    return rows.select(bundle, F.col(place).cast("long").alias(place), "violation").union(long)


#: Types of the fields and items of a bundle, closed: no other fields, nothing else in their place.
_FIELD_TYPES = {"schema_version": "BIGINT", "bundle_id": "STRING", "source_instance_id": "STRING", "source_sequence": "BIGINT", "created_at": "STRING", "selection": "STRING", "policy_sha256": "STRING", "counts": "OBJECT<files: BIGINT, ips: BIGINT, repositories: BIGINT>"}
_ITEM_TYPES = {"files": ["OBJECT<md5: STRING, sha256: STRING>", "OBJECT<md5: VOID, sha256: STRING>"], "ips": ["STRING"], "repositories": ["OBJECT<canonical_url: STRING, identity_key: STRING>"]}


def header_violations(bundles: DataFrame, key: str = "bundle_id") -> DataFrame:
    """What is wrong with bundles as JSON (key, body): key, violation.

    Fields are exactly BUNDLE_FIELDS; version 1, canonical UUIDs, a positive sequence, a UTC time, a known
    selection, a digest of the policy, and counts that are those of the lists. Fields and items have exactly
    their types and inner fields (`types`, `items`); a key that comes twice makes a body no JSON (`json`).
    """
    v = F.try_parse_json("body")
    get = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind)
    no = lambda good: ~F.coalesce(good, F.lit(False))
    kind_of = lambda name: F.schema_of_variant(get(name, "variant"))
    fields, expected = F.json_object_keys("body"), F.array(*[F.lit(f) for f in BUNDLE_FIELDS])
    lists = {n: get(n, "array<variant>") for n in _ITEM_TYPES}
    sizes = {n: F.coalesce(F.size(c), F.lit(-1)) for n, c in lists.items()}
    counted = reduce(lambda a, b: a & b, [get(f"counts.{n}", "long") == size for n, size in sizes.items()])
    typed = reduce(lambda a, b: a & b, [kind_of(n) == t for n, t in _FIELD_TYPES.items()])
    of_type = lambda name: lambda x: F.schema_of_variant(x).isin(_ITEM_TYPES[name])
    sound = reduce(lambda a, b: a & b, [F.forall(c, of_type(n)) for n, c in lists.items()])
    wrong = F.array(
        F.when(F.col("v").isNull(), "json"), F.when(no((F.size(fields) == len(BUNDLE_FIELDS)) & (F.size(F.array_except(fields, expected)) == 0)), "fields"), F.when(no(get("schema_version", "long") == 1), "version"),
        F.when(no(is_uuid(get("bundle_id")) & is_uuid(get("source_instance_id"))), "uuid"), F.when(no(get("source_sequence", "long") >= 1), "sequence"), F.when(no(is_utc_time(get("created_at"))), "time"), F.when(no(get("selection").isin(SELECTIONS)), "selection"),
        F.when(no(is_sha256(get("policy_sha256"))), "policy"), F.when(no(counted), "counts"), F.when(F.col("v").isNotNull() & no(typed), "types"), F.when(F.col("v").isNotNull() & no(sound), "items"),
        F.when(reduce(lambda a, b: a + b, sizes.values()) > MOST_ITEMS, "size"), F.when(F.octet_length("body") > MOST_BYTES, "bytes"),
    )
    return bundles.select(key, "body", v.alias("v")).select(key, F.explode(F.array_compact(wrong)).alias("violation"))


def indicator_violations(items: DataFrame, bundle: str = "bundle_id") -> DataFrame:
    """What is wrong with the indicators of bundles: bundle, kind, place, violation.

    items: bundle, kind (files, ips, repositories), place, value (SHA-256, address or key), extra (MD5 or
    address of the repository). Values of a kind ascend strictly and are in their canonical form.
    """
    before = F.lag("value").over(Window.partitionBy(bundle, "kind").orderBy("place"))
    file = is_sha256(F.col("value")) & F.coalesce(F.col("extra").rlike("^[0-9a-f]{32}$"), F.lit(True))
    repository = repository_key(F.col("extra")) == F.col("value")
    good = F.when(F.col("kind") == "files", file).when(F.col("kind") == "ips", canonical_ip(F.col("value")) == F.col("value")).when(F.col("kind") == "repositories", repository)
    ordered = items.withColumn("before", before).withColumn("good", F.coalesce(good, F.lit(False)))
    wrong = F.array_compact(F.array(F.when(F.col("before") >= F.col("value"), "order"), F.when(~F.col("good"), "form")))
    return ordered.select(bundle, "kind", "place", F.explode(wrong).alias("violation"))


def bundle_digest(items: DataFrame, bundle: str, value: str) -> DataFrame:
    """Canonical JSON of each bundle's sorted distinct values, its number and SHA-256."""
    body = F.to_json(F.array_sort(F.collect_set(value)))
    return items.groupBy(bundle).agg(F.countDistinct(value).alias("n_items"), F.sha2(body, 256).alias("digest"))


def import_requests(requests: DataFrame) -> DataFrame:
    """The queue after requests in their order of import: identity, request_count, last_source, last_seq, replaced.

    A bundle that comes again counts once. The payload is replaced by a request of another source or a
    higher sequence than what is there; an older one is only counted.
    """
    once = requests.groupBy("identity", "source", "seq").agg(F.min("import_seq").alias("import_seq"))

    def step(state: tuple, row: tuple) -> tuple[tuple, None]:
        count, source, seq, replaced = state
        if source is None or row[0] != source or row[1] > seq:
            source, seq, replaced = row[0], row[1], replaced + 1
        return (count + 1, source, seq, replaced), None

    typed = once.select("identity", F.col("source").cast("string").alias("source"), F.col("seq").cast("long").alias("seq"), "import_seq")
    return fold_in_order(typed, ["identity"], ["import_seq"], ["source", "seq"], "request_count long, last_source string, last_seq long, replaced long", lambda: (0, None, None, 0), step, lambda s: s)


ITEM = "payload string, first_requested_at timestamp, last_requested_at timestamp, last_source string, last_seq long, last_bundle_id string, request_count long, status string, last_outcome string, next_eligible_at timestamp, lease_until timestamp, lease_token string, attempts long"


def new_bundles(bundles: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bundles to import, each once, and those that conflict.

    bundles: bundle_id, source, seq, import_seq; ledger: bundle_id, source, seq of those that are imported.
    A bundle that is in the ledger or comes again is left out. One that has the source and sequence of
    another bundle is a conflicting transfer: the one that was there, or came first, holds.
    """
    rest = [c for c in bundles.columns if c != "bundle_id"]
    once = bundles.groupBy("bundle_id").agg(F.min_by(F.struct(*rest), F.struct("import_seq", "source", "seq")).alias("b")).select("bundle_id", "b.*").join(ledger.select("bundle_id"), "bundle_id", "left_anti")
    first = F.first("bundle_id").over(Window.partitionBy("source", "seq").orderBy("import_seq", "bundle_id"))
    held = ledger.select("source", "seq", F.col("bundle_id").alias("holder"))
    judged = once.withColumn("first", first).join(held, ["source", "seq"], "left").withColumn("clash", F.col("holder").isNotNull() | (F.col("first") != F.col("bundle_id")))
    fresh = judged.where("NOT clash").select(*bundles.columns)
    return fresh, judged.where("clash").select("bundle_id", "source", "seq", F.coalesce("holder", "first").alias("conflicts_with"))


def import_bundles(items: DataFrame, requests: DataFrame) -> DataFrame:
    """The queue after the requests of new bundles: identity and the fields of ITEM.

    requests: identity, payload, bundle_id, source, seq, created_at, import_seq. A newer request (another
    source, or a higher sequence) replaces the payload, makes the item pending, ends its lease and, unless
    it was rate limited, its wait. An older one is only counted. Each item is folded in order of import.
    """
    fields = [f.split()[0] for f in ITEM.split(", ")]
    blank = {f: F.lit(None) for f in fields}
    made = {"payload": F.col("payload"), "first_requested_at": F.col("created_at"), "last_requested_at": F.col("created_at"), "last_source": F.col("source").cast("string"), "last_seq": F.col("seq").cast("long"), "last_bundle_id": F.col("bundle_id").cast("string")}
    shape = lambda df, columns, at: df.select("identity", at.cast("long").alias("import_seq"), *[columns[f.split()[0]].cast(f.split()[1]).alias(f.split()[0]) for f in ITEM.split(", ")])
    known = shape(items.withColumn("there", F.lit(True)), {f: F.col(f) for f in fields}, F.lit(None))
    asked = shape(requests, blank | made, F.col("import_seq"))
    at = {f: k for k, f in enumerate(fields)}

    def step(state: list | None, row: tuple) -> tuple[list, None]:
        order, *new = row
        if order is None:  # the item as it was
            return list(new), None
        if state is None:
            new[at["request_count"]], new[at["status"]], new[at["attempts"]] = 1, "pending", 0
            return list(new), None
        state[at["request_count"]] += 1
        if state[at["last_source"]] != new[at["last_source"]] or new[at["last_seq"]] > state[at["last_seq"]]:
            for f in ("payload", "last_requested_at", "last_source", "last_seq", "last_bundle_id"):
                state[at[f]] = new[at[f]]
            state[at["status"]], state[at["lease_until"]], state[at["lease_token"]] = "pending", None, None
            if state[at["last_outcome"]] != "rate_limited":
                state[at["next_eligible_at"]] = None
        return state, None

    return fold_in_order(known.union(asked), ["identity"], ["import_seq"], ["import_seq", *fields], ITEM, lambda: None, step, lambda s: tuple(s))


def finish_items(items: DataFrame, outcomes: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Items after the outcomes of their leases, and the pause that rate limits set for all.

    items: identity, lease_token, attempts, status. outcomes: identity, lease_token, outcome and, where a
    provider told it, retry_after_seconds. An outcome with another token changes nothing. The pause is
    only ever moved on: hold it against the one before.
    """
    joined = items.join(outcomes, ["identity", "lease_token"], "left")
    base = F.when(F.col("outcome").isin("not_found", "rate_limited"), 3600).otherwise(300)
    done = F.col("outcome") == "success"
    told = F.col("retry_after_seconds") if "retry_after_seconds" in outcomes.columns else F.lit(None)
    wait = F.when(F.col("outcome").isNotNull() & ~done, F.coalesce(told.cast("long"), backoff(base, F.col("attempts"))))
    after = joined.select(
        "identity", F.when(F.col("outcome").isNull(), F.col("status")).when(done, "resolved").otherwise("pending").alias("status"),
        (F.col("attempts") + F.col("outcome").isNotNull().cast("long")).alias("attempts"), F.timestamp_add("SECOND", wait, now).alias("next_eligible_at"), "outcome",
    )
    return after, after.where("outcome = 'rate_limited'").agg(F.max("next_eligible_at").alias("paused_until"))


def eligible_items(items: DataFrame, now: Column, paused_until: Column | None = None) -> DataFrame:
    free = (F.col("status") != "resolved") & (F.col("next_eligible_at").isNull() | (F.col("next_eligible_at") <= now)) & (F.col("lease_until").isNull() | (F.col("lease_until") <= now))
    return items.where(free if paused_until is None else free & (paused_until.isNull() | (paused_until <= now)))


def lease(items: DataFrame, k: int) -> DataFrame:
    """The k items asked for last: top-k without a full sort."""
    return items.orderBy(F.col("last_seq").desc(), F.col("last_requested_at").desc(), "identity").limit(k)


def lease_items(items: DataFrame, bundles: DataFrame, k: int, now: Column, seconds: int = 300, paused_until: Column | None = None) -> DataFrame:
    """The k free items asked for last, leased, with the selection of the bundle that asked: identity, lease_token, lease_until, selection.

    bundles: bundle_id, selection. An item whose bundle is not known is not leased.
    """
    free = eligible_items(items, now, paused_until).join(bundles.select(F.col("bundle_id").alias("last_bundle_id"), "selection"), "last_bundle_id")
    token = F.sha2(F.concat_ws("/", F.col("identity").cast("string"), F.col("attempts").cast("string"), now.cast("string")), 256)
    return lease(free, k).select("identity", token.alias("lease_token"), F.timestamp_add("SECOND", F.lit(seconds), now).alias("lease_until"), "selection")


def budget_usage(ledger: DataFrame) -> DataFrame:
    """Use of each run: commits and reserves without an end, folded last in first out for each item.

    ledger: run_id, run_item_id, id, kind, cost. A commit or release without an open reserve is malformed.
    """
    none = [F.lit(0).cast("long").alias(m) for m in MEASURES[:-1]]
    out = budget_measures(ledger.select("run_id", "run_item_id", "id", "kind", *none, F.col("cost").cast("long").alias(MEASURES[-1])), same_value=False)
    return out.select("run_id", F.col(MEASURES[-1]).alias("used"), "malformed")


def budget_measures(ledger: DataFrame, same_value: bool = True) -> DataFrame:
    """Use of each run by all measures: run_id, MEASURES, malformed.

    ledger: run_id, run_item_id, id, kind and the measures. Commits count, and reserves without an end,
    last in first out for each item. A commit or release without an open reserve, a release of another
    value than its reserve, a row without an item and an unknown kind make the run malformed.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, None]:
        open_, spent, bad = state
        kind, item, value = row[0], row[1], [v or 0 for v in row[2:]]
        if item is None or kind not in ("reserve", "commit", "release"):
            return (open_, spent, True), None
        if kind == "reserve":
            open_.append(value)
        elif not open_:
            bad = True
        else:
            reserved = open_.pop()
            bad = bad or (kind == "release" and same_value and reserved != value)
            if kind == "commit":
                spent = [a + b for a, b in zip(spent, value, strict=True)]
        return (open_, spent, bad), None

    def end(state: tuple) -> tuple:
        open_, spent, bad = state
        return (*[sum(x) for x in zip(spent, *open_, strict=True)], bad)

    item = F.col("run_item_id").alias("item")
    per = fold_in_order(ledger.withColumn("item", item), ["run_id", "run_item_id"], ["id"], ["kind", "item", *MEASURES], ", ".join(f"{m} long" for m in MEASURES) + ", bad boolean", lambda: ([], [0] * len(MEASURES), False), step, end)
    return per.groupBy("run_id").agg(*[F.sum(m).alias(m) for m in MEASURES], F.bool_or("bad").alias("malformed"))


def cost_micro_usd(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Exact cost, rounded up; rates are prices of a million tokens in dollars."""
    dec = "decimal(30,12)"
    return F.ceil(tokens_in.cast("decimal(20,0)") * rate_in.cast(dec) + tokens_out.cast("decimal(20,0)") * rate_out.cast(dec)).cast("long")


def admit(requests: DataFrame, limit: int) -> DataFrame:
    """Which requests of a run fit its limit of cost, in order; a refused one takes nothing: run_id, id, cost, admitted."""
    return fitting_in_order(requests.withColumn("run_id", F.col("run_id").cast("long")), "run_id", "cost", limit, "admitted")


def admit_reservations(events: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Which events of a run its five ceilings allow, in order: run_id, id, kind, allowed and what is used after each, by measure.

    events: run_id, id, kind, the measures and, for a settlement, what it replaces as reserved_<measure>.
    A reserve adds, a release takes away, a settlement puts what was used in place of what was reserved.
    What would pass a ceiling or fall below nothing is refused and changes nothing.
    """
    ceilings = [limits[m] for m in MEASURES]
    many = len(MEASURES)

    def step(used: list, row: tuple) -> tuple[list, tuple]:
        number, kind, value, reserved = row[0], row[1], [v or 0 for v in row[2 : 2 + many]], [v or 0 for v in row[2 + many :]]
        if kind == "reserve":
            after = [u + v for u, v in zip(used, value, strict=True)]
        elif kind == "release":
            after = [u - v for u, v in zip(used, value, strict=True)]
        else:
            after = [u - r + v for u, r, v in zip(used, reserved, value, strict=True)]
        good = kind in ("reserve", "release", "settle") and all(a >= 0 for a in after) and (kind == "release" or all(a <= c for a, c in zip(after, ceilings, strict=True)))
        used = after if good else used
        return used, (number, kind, good, *used)

    like = "id long, kind string, allowed boolean, " + ", ".join(f"{m} long" for m in MEASURES)
    typed = events.select("run_id", F.col("id").cast("long").alias("id"), "kind", *[F.col(m).cast("long").alias(m) for m in MEASURES], *[F.col(f"reserved_{m}").cast("long").alias(f"reserved_{m}") for m in MEASURES])
    return fold_in_order(typed, ["run_id"], ["id"], ["id", "kind", *MEASURES, *[f"reserved_{m}" for m in MEASURES]], like, lambda: [0] * many, step)
