"""What reports are cut down to: budgets, compact rows, and the total order of every report.

A projection filters, then orders, then cuts to its top rows, and says in ``truncated`` whether it cut any.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.metrics import severity_rank
from sedimenta.operators import drift

METRICS = ("cognitive", "cyclomatic", "crap", "loc")
SORT_KEYS = ("crap", "cognitive", "cyclomatic")


def _state(name: str = "state") -> Column:
    return F.when(F.col(name) == "new", 0).when(F.col(name) == "existing", 1).otherwise(2)


def _worst() -> Column:
    return severity_rank(F.col("severity")).desc()


#: Total order of each report, by the names of its columns; absent values come first unless it says otherwise.
ORDERS = {
    "vulnerabilities": lambda: [_worst(), _state().asc(), *map(F.asc_nulls_first, ("ecosystem", "package", "version", "advisory"))],
    "security": lambda: [_worst(), _state().asc(), F.asc_nulls_last("path"), *map(F.asc_nulls_first, ("line", "tool", "rule"))],
    "mutants": lambda: [*map(F.asc_nulls_first, ("path", "start_line", "start_column", "provider", "operator", "status", "native_id", "description"))],
    "changed": lambda: [F.asc("path"), F.coalesce("after_start", "before_start").asc(), F.asc("fn")],
    "debt": lambda: [F.asc("path"), F.asc("fn"), F.asc("dimension")],
    "plans": lambda: [F.asc("query"), F.asc("rank"), F.asc_nulls_first("relation"), F.asc_nulls_first("detail")],
    "policy": lambda: [F.asc("rule"), F.asc("source"), F.asc("target")],
    "clones": lambda: [F.asc("group_id"), F.asc("path")],
    "ci": lambda: [F.asc("path"), F.asc("line"), F.asc("kind"), F.asc("message")],
    "unresolved": lambda: [F.asc("source"), F.asc("specifier"), F.asc("line"), F.asc("reason")],
    "priority": lambda: [F.desc("priority"), F.asc("ordinal")],
}


def ordered(report: DataFrame, name: str, top: int | None = None) -> DataFrame:
    """report in its total order; with a top, its first rows and their place."""
    order = ORDERS[name]()
    if top is None:
        return report.orderBy(*order)
    return report.orderBy(*order).limit(top).withColumn("place", F.row_number().over(Window.partitionBy().orderBy(*order)))


@dataclass(frozen=True)
class Budget:
    """What a projection keeps: least crap (an unknown one is dropped then), least change, sort key and number of rows."""

    min_crap: float | None = None
    min_delta: float | None = None
    sort_by: str | None = None
    top: int | None = None

    def __post_init__(self) -> None:
        if self.sort_by is not None and self.sort_by not in SORT_KEYS:
            raise ValueError(f"sort_by is one of {', '.join(SORT_KEYS)}")


def _cut(rows: DataFrame, order: list[Column], top: int | None) -> DataFrame:
    if top is None:
        return rows.orderBy(*order).withColumn("truncated", F.lit(False))
    cut = rows.agg((F.count("*") > top).alias("truncated"))
    return rows.crossJoin(F.broadcast(cut)).orderBy(*order).limit(top)


def functions(rows: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(path, fn, line, cognitive, cyclomatic, crap, coverage, truncated) within a budget; by path and line unless it has a sort key."""
    kept = rows if budget.min_crap is None else rows.where(F.col("crap") >= budget.min_crap)
    order = [F.asc("path"), F.asc("line"), F.asc("fn")] if budget.sort_by is None else [F.desc_nulls_last(budget.sort_by), F.asc("path"), F.asc("fn"), F.asc("line")]
    return _cut(kept, order, budget.top).select("path", "fn", "line", "cognitive", "cyclomatic", "crap", "coverage", "truncated")


def greatest_delta(metrics: tuple[str, ...] = METRICS) -> Column:
    """The greatest change of any metric, whichever way; a side that is missing, or a metric that is unknown on one, counts 0."""
    return F.greatest(*(F.coalesce(F.abs(F.col(f"after_{m}") - F.col(f"before_{m}")).cast("double"), F.lit(0.0)) for m in metrics), F.lit(0.0))


def changes(pairs: DataFrame, budget: Budget = Budget(), metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(kind, path, fn, nth, crap_delta, max_delta, truncated): regressions and improvements of pairs, each list within the budget.

    Without a sort key regressions go by how much crap grew, improvements by path. A row's own metrics are those after, or
    before if it is gone. truncated holds if either list was cut.
    """
    told = pairs.withColumns({
        "kind": drift.direction(list(metrics)),
        "crap_delta": F.coalesce(F.col("after_crap") - F.col("before_crap"), F.lit(0.0)),
        "max_delta": greatest_delta(metrics),
        **{m: F.when(F.col("after_present").isNotNull(), F.col(f"after_{m}")).otherwise(F.col(f"before_{m}")) for m in SORT_KEYS},
    }).where("kind IN ('regressed', 'improved')")
    if budget.min_crap is not None:
        told = told.where(F.col("crap") >= budget.min_crap)
    if budget.min_delta is not None:
        told = told.where(F.col("max_delta") >= budget.min_delta)
    tie = [F.asc("path"), F.asc("fn"), F.asc("nth")]
    orders = {k: [F.desc_nulls_last(budget.sort_by), *tie] for k in ("regressed", "improved")} if budget.sort_by else {"regressed": [F.desc("crap_delta"), *tie], "improved": tie}
    names = ("kind", "path", "fn", "nth", "crap_delta", "max_delta")
    lists = [_cut(told.where(F.col("kind") == k), order, budget.top) for k, order in orders.items()]
    out = lists[0].select(*names).unionAll(lists[1].select(*names))
    sizes = told.groupBy().pivot("kind", ["regressed", "improved"]).count()
    most = F.greatest(F.coalesce("regressed", F.lit(0)), F.coalesce("improved", F.lit(0)))
    flag = F.lit(False) if budget.top is None else most > budget.top
    return out.crossJoin(F.broadcast(sizes.select(flag.alias("truncated"))))


def violations(pairs: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Pairs whose after side is over a limit; an unknown crap is over its limit, and an entity that is gone is over none."""
    over = F.lit(False)
    for metric, limit in limits.items():
        beyond = F.col(f"after_{metric}") > limit
        over = over | (F.coalesce(beyond, F.lit(True)) if metric == "crap" else F.coalesce(beyond, F.lit(False)))
    return pairs.where(F.col("after_present").isNotNull() & over)


def compact(rows: DataFrame, *measures: str) -> DataFrame:
    """rows with measures to one decimal; unknown ones stay so."""
    return rows.withColumns({m: F.round(F.col(m).cast("double"), 1) for m in measures})


def duplication_priority(groups: DataFrame, answers: DataFrame) -> DataFrame:
    """groups (group_id, weight, ...) with the priority weight * extraction of answers (group_id, extraction, confidence); without one it is 0."""
    joined = groups.join(answers, "group_id", "left")
    return joined.withColumn("priority", F.round(F.col("weight") * F.coalesce("extraction", F.lit(0.0)), 4))
