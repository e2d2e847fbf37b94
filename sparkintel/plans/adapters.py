"""Adapters of a capture's analysis: named steps that each turn tables into records, errors and metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkintel.operators.answers import sum_metrics
from sparkintel.operators.lookups import adapter_status, all_records

Tables = dict[str, DataFrame]


@dataclass
class Analysed:
    """What an adapter gives: records by kind, errors (severity, code), metrics (metric, value)."""

    records: Tables = field(default_factory=dict)
    errors: DataFrame | None = None
    metrics: DataFrame | None = None


@dataclass(frozen=True)
class Adapter:
    """accepts: whether there is work for it in these tables; process: the work, as a plan and not a job."""

    name: str
    process: Callable[[Tables], Analysed]
    accepts: Callable[[Tables], bool] = lambda tables: True


def registry(*adapters: Adapter) -> dict[str, Adapter]:
    names = [a.name for a in adapters]
    if len(set(names)) < len(names):
        raise ValueError("two adapters have one name")
    return dict(zip(names, adapters, strict=True))


def analyse(tables: Tables, adapters: dict[str, Adapter]) -> tuple[DataFrame | None, DataFrame | None, DataFrame | None]:
    """The records, states and summed metrics of all adapters that accept the tables; None where none has any.

    Each adapter sees the tables and what the ones before it have recorded.
    """
    records: Tables = {}
    errors = metrics = None
    ran = []
    for name, adapter in adapters.items():
        seen = tables | records
        if not adapter.accepts(seen):
            continue
        ran.append(name)
        found = adapter.process(seen)
        records |= found.records
        if found.errors is not None:
            own = found.errors.select(F.lit(name).alias("adapter"), "severity", "code")
            errors = own if errors is None else errors.union(own)
        if found.metrics is not None:
            own = found.metrics.select("metric", "value")
            metrics = own if metrics is None else metrics.union(own)
    return (all_records(records) if records else None), (adapter_status(errors, ran) if errors is not None else None), (sum_metrics(metrics) if metrics is not None else None)
