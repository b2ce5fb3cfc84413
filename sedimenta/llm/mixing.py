"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its share by weight of a budget, at most CAP times its size; what is beyond goes
to the others by weight until no target is above (water-filling, solved in one pass over the sources by
the ratio of cap to weight). Of a target, complete epochs come first: every document is taken as
often as its source's size goes into the target. For the rest, documents go by an exponential key
-ln(u) / weight, least first, with u a hash of doc_id and weight the document's quality, as far as their
prefix sum goes into the rest; the document in which it ends gives the words that are missing.

The prefix sums descend by radix: sizes are summed by source and the leading bits of the key, then, only within the value in
which a source's rest ends, by the next LEVEL_BITS bits, until that value is one key. So whatever the weights make of
the keys, no task holds more of a source than 2 ** LEVEL_BITS sums, and what a source takes is one last key:
documents never move for it, however large a source is.

Null and empty texts have size 0 and are never taken. Sources go by code point, null last; a source of
size 0 has target 0. Rows with equal doc_id and text have equal keys; if the rest ends in them, each gives the same number of
words. Reruns agree, as nothing but the rows decides. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.llm.tables import n_words_of, staged

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
#: Keys are kept as whole numbers of 2 ** -KEY_BITS, of 62 bits at most; rows of the same key go by a hash of 64 bits.
KEY_BITS = 52
LEVEL_BITS = 12
#: Sources up to this number are broadcast to the documents; more are joined by shuffle.
BROADCAST_SOURCES = 10_000
SEED = "mix"


def quality_of(text: Column) -> Column:
    """Weight from 0.05 to 1: less with each symbol, exclamation mark or digit a character."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>!0-9]+", ""))
    return F.greatest(F.lit(0.05), F.lit(1.0) - F.lit(4.0) * odd / F.greatest(F.length(text), F.lit(1)))


def key_of(doc_id: Column, weight: Column) -> Column:
    """Exponential with rate weight; the same for the same doc_id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source."""
    every = Window.partitionBy()
    turn = (F.row_number().over(every.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.get(F.array(*map(F.lit, weights)), turn).cast("double")).withColumn("_cap", F.col("source_size") * float(cap))
    before = every.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * float(budget) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = weighed.withColumn("_level", left / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))))
    return level.select("source", "source_size", F.least("_cap", F.col("_w") * F.max("_level").over(every)).alias("target"))


def mixed(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), weight: Column | None = None, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """columns of docs and size, source_size, target, taken (words, repeats counted) of every document.

    A column of docs with one of these four names gives way to the mix's.
    """
    columns = tuple(c for c in columns if c not in ("size", "source_size", "target", "taken"))
    w = quality_of(F.col("text")) if weight is None else weight
    key = F.least(key_of(F.col("doc_id"), w) * float(1 << KEY_BITS), F.lit(float(1 << 62) - 1024)).cast("long")
    base = docs.select(F.struct(*columns).alias("_row"), F.col("source").alias("_source"), n_words_of(F.col("text")).alias("_size"), key.alias("_key"), F.xxhash64("doc_id", "text").alias("_tie"))
    base = staged(base)  # a text is measured once
    rows = base.select("_source", "_size", "_key", "_tie").where("_size > 0")
    sizes = base.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    of_source = targets(sizes, weights, budget, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    planned = staged(of_source.select("source", "source_size", "target", epochs.cast("long").alias("_epochs")).withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size")))
    few = planned.count() <= BROADCAST_SOURCES
    cuts = _cuts(rows, planned.where("_rest > 0").select(F.col("source").alias("_s"), F.col("_rest").alias("_left")), few)
    told = planned.join(cuts, planned["source"].eqNullSafe(cuts["_s"]), "left").drop("_s")
    size, here, last = F.col("_size"), F.struct("_key", "_tie"), F.struct(F.col("_last_key"), F.col("_last_tie"))
    drawn = (
        F.when(F.col("_rest") <= 0, F.lit(0))
        .when(F.col("_last_key").isNull(), size)  # the rest is all of the source
        .when(here < last, size)
        .when(here == last, F.least(size, F.col("_each")))
        .otherwise(F.lit(0))
    )
    return base.join(F.broadcast(told) if few else told, base["_source"].eqNullSafe(told["source"])).select(
        "_row.*", size.alias("size"), "source_size", "target", (size * F.col("_epochs") + drawn).cast("long").alias("taken")
    )


def _levels() -> list[tuple[str, int]]:
    """(column, shift) of each level of the descent: its value is the column without so many bits."""
    return [(c, max(0, top - LEVEL_BITS * k)) for c, top in (("_key", 62 - LEVEL_BITS), ("_tie", 64 - LEVEL_BITS)) for k in range(-(-top // LEVEL_BITS) + 1)]


def _cuts(rows: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """(_s, _last_key, _last_tie, _each): the key at which a source's sum of sizes passes its goal _left, and what each row of it gives.

    A source whose sum doesn't pass its goal has no row.
    """
    found, here = [], rows
    for column, shift in _levels():
        side = F.broadcast(goals) if few else goals
        on = here["_source"].eqNullSafe(goals["_s"])
        if "_value" in goals.columns:
            on &= (F.col("_at") == F.col("_value")) & F.col("_key").between(F.col("_low"), F.col("_high"))
        inside = here.join(side, on).select("_s", "_left", "_size", "_key", "_tie", F.shiftright(column, shift).alias("_at"))
        sums = inside.groupBy("_s", "_at").agg(
            F.sum("_size").alias("_n"), F.count("*").alias("_rows"), F.first("_left").alias("_left"),
            *(f(c).alias(f"{name}{c}") for c in ("_key", "_tie") for name, f in (("_min", F.min), ("_max", F.max))),
        )
        before = F.sum("_n").over(Window.partitionBy("_s").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
        passed = staged(sums.withColumn("_before", before).where("_before <= _left AND _left < _before + _n"))
        one = "_min_key = _max_key AND _min_tie = _max_tie"
        found.append(passed.where(one).select("_s", F.col("_min_key").alias("_last_key"), F.col("_min_tie").alias("_last_tie"), F.floor((F.col("_left") - F.col("_before")) / F.col("_rows")).alias("_each")))
        goals = passed.where(f"NOT ({one})").select("_s", (F.col("_left") - F.col("_before")).alias("_left"), F.col("_at").alias("_value"), F.col("_min_key").alias("_low"), F.col("_max_key").alias("_high"))
        if not goals.take(1):
            break
        here = rows.withColumn("_at", F.shiftright(column, shift))
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


#: The registered query in DuckDB.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         greatest(0.05::DOUBLE, 1.0::DOUBLE - 4.0::DOUBLE * (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>!0-9]+', '', 'g')))
                  / greatest(length(coalesce(text, '')), 1)) AS w,
         (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE AS u
  FROM documents),
k AS (SELECT doc_id, source, text, size, -ln(u) / w AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT source, source_size, [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((SELECT sum(w) FROM r) - coalesce(sum(w) OVER o, 0)) AS level
      FROM r WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, w * (SELECT max(level) FROM l)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * epochs + least(size, greatest(0, floor(rest - before))) AS BIGINT) AS taken
FROM p
"""
