"""What the commit stream says about files: facts, recency, ownership, co-change.

Ages are measured from the newest commit of the snapshot, never from the wall clock, and windows
are inclusive: a commit exactly ``days`` old is inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.operators.graph import stored

DAY = 86_400
WINDOWS = (30, 90, 365)
#: Commits with more files than this count as changes but make no pairs.
WIDEST_COMMIT = 50
#: Pairs that a task counts, about.
PAIRS_OF_A_TASK = 500_000


def head(commits: DataFrame) -> DataFrame:
    """One row: the time of the newest commit, in unix seconds."""
    return commits.agg(F.unix_timestamp(F.max("ts")).alias("head_ts"))


def within(days: int) -> Column:
    """Is the commit at most days old? Needs columns ts and head_ts."""
    return F.greatest(F.col("head_ts") - F.unix_timestamp("ts"), F.lit(0)) <= days * DAY


def touched(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """commit_files with each commit's time and identity, and the head time (one row, broadcast)."""
    return commit_files.join(commits, "commit").crossJoin(F.broadcast(head(commits)))


def facts(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """A row per path: commits, changes by window, lines, first and last time, contributors."""
    return touched(commits, commit_files).groupBy("path").agg(
        F.count("*").alias("commits"),
        *(F.count(F.when(within(d), 1)).alias(f"changes_{d}d") for d in WINDOWS),
        F.sum("lines_added").alias("lines_added"),
        F.sum("lines_deleted").alias("lines_deleted"),
        F.min(F.unix_timestamp("ts")).alias("first_ts"),
        F.max(F.unix_timestamp("ts")).alias("last_ts"),
        F.countDistinct("identity").alias("contributors"),
        F.countDistinct(F.when(within(90), F.col("identity"))).alias("recent_contributors"),
    )


def recency(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """A row per window: how many commits, files and touches are inside."""
    t = touched(commits, commit_files)
    windows = F.explode(F.array(*(F.when(within(d), F.lit(d)) for d in WINDOWS))).alias("window_days")
    return t.select("commit", "path", windows).where("window_days IS NOT NULL").groupBy("window_days").agg(
        F.countDistinct("commit").alias("commits"), F.countDistinct("path").alias("files"), F.count("*").alias("touches")
    )


def touches(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(path, identity, touches): one per commit."""
    return commit_files.select("commit", "path").distinct().join(commits, "commit").groupBy("path", "identity").agg(F.count("*").alias("touches"))


def concentration(by_identity: DataFrame, key: str = "path", paths: DataFrame | None = None) -> DataFrame:
    """Per key: authors, total touches, the top author's share, and the bus factor.

    The bus factor is the least number of authors, by touches and then identity, that have half of the touches. With paths, a
    key that nobody touched has a row too: no authors, no touches, and nothing known of the rest.
    """
    found = _concentration(by_identity, key)
    if paths is None:
        return found
    every = paths.select(key).distinct().join(found, key, "left")
    return every.withColumns({c: F.coalesce(c, F.lit(0).cast(found.schema[c].dataType)) for c in ("authors", "touches")})


def _concentration(by_identity: DataFrame, key: str) -> DataFrame:
    """Authors with as many touches are one row of a key, so that a key of very many authors, like the root, isn't one task's."""
    classes = by_identity.groupBy(key, "touches").agg(F.count("*").alias("_n"), F.min("identity").alias("_least"))
    of_key = Window.partitionBy(key)
    ranked = of_key.orderBy(F.desc("touches")).rowsBetween(Window.unboundedPreceding, 0)
    held = F.col("_n") * F.col("touches")
    told = classes.withColumns({"_total": F.sum(held).over(of_key), "_so_far": F.sum(held).over(ranked), "_rank": F.sum("_n").over(ranked)})
    before = F.col("_so_far") - held
    half = (2 * before < F.col("_total")) & (2 * F.col("_so_far") >= F.col("_total"))
    reached = F.col("_rank") - F.col("_n") + F.ceil((F.col("_total") - 2 * before) / (2 * F.col("touches")))
    return told.groupBy(key).agg(
        F.sum("_n").alias("authors"),
        F.max("_total").alias("touches"),
        F.max_by("_least", "touches").alias("top_author"),
        F.round(F.max("touches") / F.max("_total") * 100, 6).alias("top_share"),
        F.min(F.when(half, reached)).cast("int").alias("bus_factor"),
    )


def ancestors(path: Column) -> Column:
    """Every directory above a path, and ``.``."""
    parts = F.split(path, "/")
    inner = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    return F.concat(F.array(F.lit(".")), inner)


def rolled_up(df: DataFrame, *aggregates: Column, path: str = "path") -> DataFrame:
    """aggregates for every ancestor directory; each row counts once for each of them."""
    return df.withColumn("module", F.explode(ancestors(F.col(path)))).groupBy("module").agg(*aggregates)


def module_touches(by_identity: DataFrame) -> DataFrame:
    """(module, identity, touches) from (path, identity, touches)."""
    return by_identity.withColumn("module", F.explode(ancestors(F.col("path")))).groupBy("module", "identity").agg(F.sum("touches").alias("touches"))


def coupling(commit_files: DataFrame, least: int = 2, widest: int = WIDEST_COMMIT, ceiling: int | None = None) -> DataFrame:
    """Unordered pairs (source < target) of files changed together at least so often.

    Pairs come from commits of at most ``widest`` files; a file's changes count all its commits. The width bounds
    the pairs of a commit, so pairs grow in proportion to commits. There is no ceiling unless one is given; past that there are no rows at all.
    """
    files = stored(commit_files.select("commit", "path").distinct())
    totals = files.groupBy("path").agg(F.count("*").alias("changes"))
    # a commit's width is known before its paths are gathered, so a wide one is never in one place
    widths = files.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= widest)
    narrow = files.join(widths, "commit").groupBy("commit").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.max("n").alias("n"))
    if ceiling is not None:
        allowed = narrow.agg((F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)) <= ceiling).alias("allowed"))
        narrow = narrow.crossJoin(F.broadcast(allowed)).where("allowed")
    # most pairs are found once, so counting them before they are dealt would only fill the memory of whoever lists them
    n = widths.agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0
    pairs = (
        narrow.select("paths", F.posexplode("paths").alias("i", "source"))
        .select("source", F.explode(F.expr("slice(paths, i + 2, size(paths))")).alias("target"))
        .repartition(max(1, -(-n // PAIRS_OF_A_TASK)), "source", "target").groupBy("source", "target").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= least)
    )
    of = lambda side: totals.select(F.col("path").alias(side), F.col("changes").alias(f"{side}_changes"))
    both = pairs.join(of("source"), "source").join(of("target"), "target")
    return both.select(
        "source", "target", "co_changes", "source_changes", "target_changes",
        F.round(F.col("co_changes") / F.col("source_changes"), 6).alias("forward"),
        F.round(F.col("co_changes") / F.col("target_changes"), 6).alias("backward"),
        F.round(F.col("co_changes") / (F.col("source_changes") + F.col("target_changes") - F.col("co_changes")), 6).alias("jaccard"),
    )


def coupled_with(commit_files: DataFrame, target: object, least: int = 2, widest: int = WIDEST_COMMIT, limit: int = 20) -> DataFrame:
    """Files that change with one target: its narrow commits, by share of the target's changes; a top-k report."""
    files = commit_files.select("commit", "path").distinct()
    own = files.where(F.col("path") == F.lit(target)).select("commit")
    near = files.join(own, "commit", "left_semi")
    narrow = near.groupBy("commit").agg(F.count("*").alias("n")).where(F.col("n") <= widest).select("commit")
    together = near.join(narrow, "commit").where(F.col("path") != F.lit(target)).groupBy("path").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= least)
    changes = files.join(together.select("path"), "path", "left_semi").groupBy("path").agg(F.count("*").alias("changes"))
    mine = own.agg(F.count("*").alias("target_changes"))
    return (
        together.join(changes, "path").crossJoin(F.broadcast(mine))
        .select("path", "co_changes", "changes", "target_changes", F.round(F.col("co_changes") / F.col("target_changes"), 6).alias("directional"))
        .orderBy(F.desc("directional"), F.desc("co_changes"), F.asc("path")).limit(limit)
    )


def resolved_identities(commits: DataFrame, mailmap: DataFrame) -> DataFrame:
    """commits with identity by mailmap(ord, old_name, old_email, new_identity): a rule with a name beats one of the email alone, then the first wins."""
    rules = mailmap.select(F.lower("old_email").alias("_email"), F.lower("old_name").alias("_name"), "new_identity", F.struct(F.col("old_name").isNull().alias("later"), "ord").alias("_order"))
    # an author's rule is looked up once, however many commits there are
    people = commits.select(F.lower("email").alias("_mail"), F.lower("author").alias("_person")).distinct()
    fits = (F.col("_mail") == F.col("_email")) & (F.col("_name").isNull() | (F.col("_name") == F.col("_person")))
    best = people.join(rules, fits).groupBy("_mail", "_person").agg(F.min_by("new_identity", "_order").alias("_new"))
    same = F.lower("email").eqNullSafe(F.col("_mail")) & F.lower("author").eqNullSafe(F.col("_person"))
    return commits.join(best, same, "left").withColumn("identity", F.coalesce("_new", F.lower("email"))).drop("_mail", "_person", "_new")
