"""Dependency graphs as edge tables: fan-in and fan-out, reachability, distances, cycles, test selection.

Iterations keep a frontier: each round joins only what the last one found, and drops what is known.
Rounds are written to the session's checkpoint folder, so that a lost executor costs one round.

A round costs the same however little it finds, and graphs of a few thousand edges may need many. So edges are
counted first: up to ONE_TASK_EDGES of them are searched by one task, and more by rounds. Both give the same rows.

What hangs together is found by contraction: tasks of CHUNK_EDGES edges each group the nodes of their share, groups become
nodes, and so on until one task holds what is left. Searches from many starts go by such groups: each task
has the edges of some of them, and some of their starts.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.paths import language, matches
from sedimenta.operators import searches

#: Rounds after which a search that still finds nodes is an error, not a result.
MOST_ROUNDS = 10_000
#: Edges, or edges times starts, up to which one task searches a graph.
ONE_TASK_EDGES = 200_000
#: Edges and nodes up to which one task counts what depends on every node: it holds a bit for each pair of nodes.
COUNTED_EDGES, COUNTED_NODES = 1_000_000, 40_000
#: Edges of a task that groups nodes, or that searches from many starts.
CHUNK_EDGES = 4_000_000
#: Edges up to which a weakly connected group is searched whole by each task; a larger one is searched by rounds.
WALKED_EDGES = 32_000_000
#: Tasks at least over which the starts of a search are dealt.
WALKING_TASKS = 24
#: Contraction goes on while it leaves at most this share of the edges.
CONTRACTED = 0.9


def _kept(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir isn't set: rounds are stored where driver and executors can read them")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="sedimenta-"))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, computed once for all that use it."""
    return _kept(df)


def _one_task(edges: DataFrame, starts: DataFrame | None, search: Callable[[dict, list], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of search(following nodes by node, starts) over edges (_from, _to), whose number the caller has checked."""
    rows = edges.select(F.lit(0).alias("_kind"), "_from", "_to")
    if starts is not None:
        rows = rows.unionAll(starts.select(F.lit(1), F.col("node"), F.col("node")))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        following: dict = {}
        begin = []
        for batch in batches:
            for kind, a, b in batch.itertuples(index=False):
                if kind:
                    begin.append(a)
                else:
                    following.setdefault(a, []).append(b)
        yield pd.DataFrame(list(search(following, begin)), columns=names)

    return rows.coalesce(1).mapInPandas(run, schema)


def _search(following: dict, begin: list) -> dict:
    """Distance of all that the nodes of begin reach."""
    distance = dict.fromkeys(begin, 0)
    now = list(distance)
    while now:
        after = []
        for a in now:
            for b in following.get(a, ()):
                if b not in distance:
                    distance[b] = distance[a] + 1
                    after.append(b)
        now = after
    return distance


def _components(following: dict) -> Iterator[list]:
    """Strongly connected components, each behind all that it reaches: Tarjan's search with a stack of its own."""
    order: dict = {}
    low: dict = {}
    open_: list = []
    inside: set = set()
    for first in following:
        if first in order:
            continue
        todo = [(first, iter(following[first]))]
        order[first] = low[first] = len(order)
        open_.append(first)
        inside.add(first)
        while todo:
            node, rest = todo[-1]
            for b in rest:
                if b not in order:
                    order[b] = low[b] = len(order)
                    open_.append(b)
                    inside.add(b)
                    todo.append((b, iter(following.get(b, ()))))
                    break
                if b in inside:
                    low[node] = min(low[node], order[b])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == order[node]:
                    component = []
                    while not component or component[-1] != node:
                        component.append(open_.pop())
                    inside.difference_update(component)
                    yield component


def _reach_counts(edges: DataFrame, weights: DataFrame, kind: str) -> DataFrame:
    """(node, reached): the weights (node, weight), else 1, of all that a node reaches, itself included, over edges (_from, _to) without cycles.

    One task holds a bit for each pair of nodes. What is reached is counted once for each binary digit of weights.
    """
    rows = edges.select(F.lit(0).alias("_kind"), "_from", "_to", F.lit(0).cast("long").alias("_weight")).unionAll(weights.select(F.lit(1), "node", "node", F.col("weight").cast("long")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        following: dict = {}
        weight: dict = {}
        for batch in batches:
            for sort, a, b, w in batch.itertuples(index=False):
                if sort:
                    weight[a] = w
                else:
                    following.setdefault(a, []).append(b)
        order = [n for component in _components(following) for n in component]
        own = [weight.get(n, 1) for n in order]
        digits = []
        for k in range(max(own, default=0).bit_length()):
            flags = bytearray(len(order) // 8 + 1)
            for i, w in enumerate(own):
                flags[i >> 3] |= (w >> k & 1) << (i & 7)
            digits.append(int.from_bytes(flags, "little"))
        reach: dict = {}
        found = []
        for i, n in enumerate(order):
            bits = 1 << i
            for b in following.get(n, ()):
                bits |= reach[b]
            reach[n] = bits
            found.append((n, sum((bits & flags).bit_count() << k for k, flags in enumerate(digits))))
        yield pd.DataFrame(found, columns=["node", "reached"])

    return rows.coalesce(1).mapInPandas(run, f"node {kind}, reached bigint")


def _steps(edges: DataFrame, reverse: bool) -> DataFrame:
    """Distinct edges (_from, _to), stored."""
    ends = ("target", "source") if reverse else ("source", "target")
    return _kept(edges.select(*(F.col(c).alias(n) for c, n in zip(ends, ("_from", "_to"), strict=True))).distinct())


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def deduplicated(edges: DataFrame) -> DataFrame:
    """(source, target, kind): one row per edge, ``import`` over ``call``; loops dropped."""
    return edges.where("source <> target").groupBy("source", "target").agg(F.when(F.max((F.col("kind") == "import").cast("int")) == 1, "import").otherwise("call").alias("kind"))


def fan(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) of every node, zeros included."""
    counted = edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    sums = counted.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    return nodes.join(sums, "node", "left").select("node", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def _contracted(left: DataFrame, kernel, chunk: int) -> tuple[DataFrame | None, DataFrame, bool]:
    """(groups, rest, whole) of edges (source, target), stored, distinct and without loops.

    groups has the nodes (node, cycle) of the kernel's groups of two or more, cycle being one of the group; rest the edges between groups, in which a
    group is its cycle; whole tells that no group is left in rest, which is so unless a round left more than CONTRACTED of the edges. A task groups some of the
    edges, so a node may be in groups of several tasks: it goes with the least. What that leaves apart the next round joins.
    """
    kind, n, groups = _type(left, "source"), left.count(), None
    while n:
        parts = -(-n // chunk)
        dealt = left.repartition(parts, "source", "target") if parts > 1 else left.coalesce(1)
        found = dealt.select("source", "target").mapInArrow(searches.grouped(kernel), f"node {kind}, cycle {kind}")
        if parts > 1:
            found = _kept(found.groupBy("node").agg(F.min("cycle").alias("cycle")))
            again = found.select(F.col("node").alias("_node"), F.col("cycle").alias("_cycle"))
            found = found.join(again, F.col("cycle") == F.col("_node"), "left").select("node", F.coalesce("_cycle", "cycle").alias("cycle"))
        found = _kept(found)
        groups = found if groups is None else _kept(_regrouped(groups, found))
        left = _kept(_relabelled(left, found))
        before, n = n, left.count()
        if parts == 1:
            return groups, left, True
        if n > CONTRACTED * before:
            return groups, left, False
    return groups, left, True


def _relabelled(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Distinct edges (source, target) between groups (node, cycle)."""
    of = lambda side: groups.select(F.col("node").alias(f"_{side}"), F.col("cycle").alias(f"_{side}_cycle"))
    both = edges.join(of("s"), F.col("source") == F.col("_s"), "left").join(of("t"), F.col("target") == F.col("_t"), "left")
    return both.select(F.coalesce("_s_cycle", "source").alias("source"), F.coalesce("_t_cycle", "target").alias("target")).where("source <> target").distinct()


def _regrouped(groups: DataFrame, found: DataFrame) -> DataFrame:
    """groups (node, cycle) after further ones were found among them."""
    more = found.select(F.col("node").alias("_node"), F.col("cycle").alias("_cycle"))
    moved = groups.join(more, F.col("cycle") == F.col("_node"), "left").select("node", F.coalesce("_cycle", "cycle").alias("cycle"))
    return moved.unionByName(found.join(groups.select(F.col("node").alias("_node")), F.col("node") == F.col("_node"), "left_anti"))


def distances(edges: DataFrame, starts: DataFrame, reverse: bool = False, most_rounds: int = MOST_ROUNDS, one_task: int = ONE_TASK_EDGES, only: DataFrame | None = None, walked: int = WALKED_EDGES) -> DataFrame:
    """(start, node, distance) of all that each start (node) reaches, itself at 0; reverse goes against the edges. only (node) has the nodes to report."""
    step = _steps(edges, reverse)
    starts = _kept(starts.select("node").distinct())
    reported = lambda found: found if only is None else found.join(only.select("node"), "node", "left_semi").select("start", "node", "distance")
    if step.count() * max(1, starts.count()) <= one_task:
        kind = _type(step, "_from")
        each = lambda following, begin: ((s, n, d) for s in begin for n, d in _search(following, [s]).items())
        return reported(_one_task(step, starts, each, f"start {kind}, node {kind}, distance int"))
    found = _walked(step, starts, only, walked)
    return reported(_rounds(step, starts, most_rounds)) if found is None else found


def _walked(step: DataFrame, starts: DataFrame, only: DataFrame | None, most: int) -> DataFrame | None:
    """distances by tasks that each hold whole weakly connected groups and some of their starts; None if a group has more than most edges."""
    kind = _type(step, "_from")
    edges = _kept(step.where("_from <> _to").select(F.col("_from").alias("source"), F.col("_to").alias("target")))
    n = edges.count()
    bins, heads = max(1, -(-n // CHUNK_EDGES)), None
    if bins > 1:
        groups, rest, _ = _contracted(edges, searches.weak, CHUNK_EDGES)
        while rest.take(1):  # a round that joined little
            more, rest, _ = _contracted(rest, searches.weak, CHUNK_EDGES)
            groups = _kept(_regrouped(groups, more))
        heads = groups.select(F.col("node").alias("_node"), F.pmod(F.xxhash64("cycle"), F.lit(bins)).cast("int").alias("_bin"))
    binned = lambda df: df.withColumn("_bin", F.lit(0)) if heads is None else df.join(heads, F.col("node") == F.col("_node"))
    lists = _kept(binned(edges.groupBy(F.col("source").alias("node")).agg(F.collect_list("target").alias("following"))).select("_bin", "node", "following"))
    if lists.groupBy("_bin").agg(F.sum(F.size("following")).alias("n")).where(F.col("n") > most).take(1):
        return None
    deals = -(-WALKING_TASKS // bins)
    every = F.explode(F.sequence(F.lit(0), F.lit(deals - 1)))
    none = F.lit(None).cast(f"array<{kind}>")
    rows = lists.select("_bin", every.alias("_deal"), F.lit(0).alias("kind"), "node", "following")
    begin = starts if heads is None else _kept(starts.join(heads, F.col("node") == F.col("_node"), "left"))
    placed = begin.withColumn("_bin", F.lit(0)) if heads is None else begin.where("_bin IS NOT NULL")
    rows = rows.unionAll(placed.select("_bin", F.pmod(F.xxhash64("node", F.lit("deal")), F.lit(deals)).cast("int"), F.lit(1), "node", none))
    if only is not None:
        rows = rows.unionAll(binned(only.select("node").distinct()).select("_bin", every, F.lit(2), "node", none))
    told = only is not None
    out = rows.repartitionById(bins * deals, F.col("_bin") * deals + F.col("_deal")).select("kind", "node", "following").mapInArrow(lambda batches: searches.walked(batches, told), f"start {kind}, node {kind}, distance int")
    if heads is None:
        return out
    alone = begin.where("_bin IS NULL").select("node") if only is None else begin.where("_bin IS NULL").select("node").join(only.select("node"), "node", "left_semi")
    return out.unionAll(alone.select(F.col("node").alias("start"), "node", F.lit(0)))


def _rounds(step: DataFrame, starts: DataFrame, most_rounds: int) -> DataFrame:
    seen = frontier = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("distance"))
    for k in range(1, most_rounds + 1):
        found = frontier.join(step, F.col("node") == F.col("_from")).select("start", F.col("_to").alias("node")).distinct()
        frontier = _kept(found.join(seen, ["start", "node"], "left_anti").withColumn("distance", F.lit(k)))
        if not frontier.take(1):
            return seen
        seen = seen.unionAll(frontier)
        if k % 8 == 0:
            seen = _kept(seen)
    raise RuntimeError(f"nodes are still found after {most_rounds} rounds")


def reached(edges: DataFrame, starts: DataFrame, reverse: bool = False, most_rounds: int = MOST_ROUNDS, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node) of all that any start reaches, starts included; one row per node whatever the number of starts."""
    step = _steps(edges, reverse)
    starts = _kept(starts.select("node").distinct())
    if step.count() + starts.count() <= one_task:
        return _one_task(step, starts, lambda following, begin: ((n,) for n in _search(following, begin)), f"node {_type(step, '_from')}")
    seen = frontier = starts
    for k in range(1, most_rounds + 1):
        found = frontier.join(step, F.col("node") == F.col("_from")).select(F.col("_to").alias("node")).distinct()
        frontier = _kept(found.join(seen, "node", "left_anti"))
        if not frontier.take(1):
            return seen
        seen = seen.unionAll(frontier)
        if k % 8 == 0:
            seen = _kept(seen)
    raise RuntimeError(f"nodes are still found after {most_rounds} rounds")


def unused(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """Nodes that no entry reaches."""
    return nodes.join(reached(edges, entries), "node", "left_anti")


def cycles(edges: DataFrame, most_rounds: int = MOST_ROUNDS, one_task: int = CHUNK_EDGES) -> DataFrame:
    """(node, cycle) of strongly connected components of two nodes or more; cycle is the least node of each.

    Pairs of nodes that reach each other are never listed.
    """
    found, _ = _condensed(edges, most_rounds, one_task)
    least = found.groupBy("cycle").agg(F.min("node").alias("_least"))
    return found.join(least, "cycle").select("node", F.col("_least").alias("cycle"))


def _condensed(edges: DataFrame, most_rounds: int = MOST_ROUNDS, one_task: int = CHUNK_EDGES) -> tuple[DataFrame, DataFrame]:
    """(components, rest): the nodes (node, cycle) of strongly connected components of two or more, cycle being one of them; distinct edges (source, target) between components.

    Tasks of one_task edges contract; what they can't is coloured, and all is if one_task is 0.
    """
    left = _kept(edges.select("source", "target").where("source <> target").distinct())
    groups, rest, whole = _contracted(left, searches.strong, one_task) if one_task else (None, left, False)
    if not whole:
        found = _kept(_coloured(rest, most_rounds, one_task))
        groups = found if groups is None else _kept(_regrouped(groups, found))
        rest = _kept(_relabelled(rest, found))
    if groups is None:
        groups = edges.select(F.col("source").alias("node"), F.col("source").alias("cycle")).where(F.lit(False))
    return groups, rest


def _coloured(left: DataFrame, most_rounds: int, one_task: int) -> DataFrame:
    """cycles of edges (source, target), stored, distinct and without loops.

    Nodes without an edge in, or without one out, are trimmed until none is left to trim. Then, round by
    round, every node takes the greatest node that reaches it as its colour; the nodes that reach the
    colour's own node within the colour are its component, and leave. Work goes with edges times rounds.
    """
    edges = left
    out = None
    for _ in range(most_rounds):
        while True:
            n = left.count()
            if not n:
                break
            ends = left.select(F.col("source").alias("n")).intersect(left.select(F.col("target").alias("n")))
            left = _kept(left.join(ends, left["source"] == ends["n"], "left_semi").join(ends.withColumnRenamed("n", "m"), F.col("target") == F.col("m"), "left_semi"))
            if left.count() == n:
                break
        if not left.take(1):
            break
        colours = _kept(left.select(F.col("source").alias("node")).distinct().withColumn("colour", F.col("node")))
        changed = colours
        while changed.take(1):
            offers = changed.join(left, F.col("node") == F.col("source")).groupBy("target").agg(F.max("colour").alias("_offer"))
            joined = _kept(colours.join(offers, F.col("node") == F.col("target"), "left").select("node", F.greatest("colour", F.coalesce("_offer", "colour")).alias("colour"), (F.col("_offer") > F.col("colour")).alias("_moved")))
            colours, changed = joined.select("node", "colour"), joined.where("_moved").select("node", "colour")
        of = lambda side: colours.select(F.col("node").alias(side), F.col("colour").alias(f"_{side}"))
        within = _kept(left.join(of("source"), "source").join(of("target"), "target").where(F.col("_source") == F.col("_target")).select("source", "target"))
        component = reached(within, colours.where("node = colour").select("node"), reverse=True, one_task=one_task).join(colours, "node")
        several = component.groupBy("colour").agg(F.count("*").alias("_n"), F.min("node").alias("cycle")).where("_n > 1")
        found = _kept(component.join(several, "colour").select("node", "cycle"))
        out = found if out is None else out.unionAll(found)
        gone = component.select("node")
        left = _kept(left.join(gone.withColumnRenamed("node", "_s"), F.col("source") == F.col("_s"), "left_anti").join(gone.withColumnRenamed("node", "_t"), F.col("target") == F.col("_t"), "left_anti"))
    if out is None:
        out = edges.select(F.col("source").alias("node"), F.col("source").alias("cycle")).where(F.lit(False))
    return out


def impact_counts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, direct_dependents, blast_radius, blast_radius_percent) of every node, zeros included.

    The blast radius is how many other nodes depend on a node, however far away; its percentage is of all other nodes. Nodes of a
    cycle have the same one, so it is counted between components: by one task, or by listing which component reaches which.
    """
    step = _kept(edges.select("source", "target").where("source <> target").distinct())
    nodes = _kept(nodes.select("node").distinct())
    total = nodes.count()
    groups, rest = _condensed(step, one_task=CHUNK_EDGES)
    weights = _kept(groups.groupBy(F.col("cycle").alias("node")).agg(F.count("*").alias("weight")))
    back = rest.select(F.col("target").alias("_from"), F.col("source").alias("_to"))
    ends = _kept(back.select(F.col("_from").alias("node")).union(back.select("_to")).distinct())
    if rest.count() <= COUNTED_EDGES and ends.count() <= COUNTED_NODES:
        counted = _reach_counts(back, weights.join(ends, "node", "left_semi"), _type(step, "source"))
    else:
        pairs = distances(rest, ends, reverse=True).join(weights, "node", "left")
        counted = pairs.groupBy(F.col("start").alias("node")).agg(F.sum(F.coalesce("weight", F.lit(1))).alias("reached"))
    direct = step.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("direct_dependents"))
    of_node = nodes.join(groups.select("node", "cycle"), "node", "left").withColumn("_component", F.coalesce("cycle", "node"))
    of_component = weights.join(counted, "node", "full").select(F.col("node").alias("_component"), F.coalesce("reached", "weight").alias("_reached"))
    known = of_node.join(of_component, "_component", "left").join(direct, "node", "left")
    known = known.select("node", F.coalesce("direct_dependents", F.lit(0)).alias("direct_dependents"), (F.coalesce("_reached", F.lit(1)) - 1).alias("blast_radius"))
    percent = F.col("blast_radius") * 100.0 / (total - 1) if total > 1 else F.lit(0.0)
    return known.select("node", "direct_dependents", "blast_radius", F.round(percent, 6).alias("blast_radius_percent"))


# Extensions of files that can't change what a program does.
DOCUMENTATION = ("md", "markdown", "rst", "adoc", "txt", "pdf", "png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp")
TIERS = ("graph", "directory", "all")


def _judged(changed: DataFrame, tests: DataFrame, files: DataFrame, always_run: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(changed files (path, why), candidates (test, named)); see select_tests."""
    path = F.col("path")
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    known = files.select(F.col("path").alias("_file"), F.lit(True).alias("_known"), *([F.col("parse_error")] if "parse_error" in files.columns else [F.lit(False).alias("parse_error")]))
    why = (
        F.when(matches(path, always_run), "always run").when(extension.isin(*DOCUMENTATION), "documentation").when(language(path).isNull(), "unsupported extension")
        .when(F.coalesce("parse_error", F.lit(False)), "parse error").when(F.col("_known").isNull(), "not in graph").otherwise("seed")
    )
    judged = _kept(changed.select("path").distinct().join(known, path == F.col("_file"), "left").select("path", why.alias("why")))
    candidates = tests.select(F.col("path").alias("test"), F.lit(True).alias("named"))
    if "declares_tests" in files.columns:
        candidates = candidates.unionAll(files.where("declares_tests").select("path", F.lit(False)))
    return judged, _kept(candidates.groupBy("test").agg(F.max("named").alias("named")))


def _stuck(judged: DataFrame, covered: DataFrame) -> DataFrame:
    """(path, why) of changed files that select by directory, those without a test among covered (path) included."""
    uncovered = judged.where("why = 'seed'").join(covered, "path", "left_anti").select("path", F.lit("no test found").alias("why"))
    return judged.where("why IN ('unsupported extension', 'parse error', 'not in graph')").unionAll(uncovered)


def _top(path: Column) -> Column:
    """The top directory; null for a file at the root."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1))


def select_tests(changed: DataFrame, tests: DataFrame, files: DataFrame, edges: DataFrame, always_run: tuple[str, ...] = ()) -> DataFrame:
    """(test, tier, via): the tests to run for changed (path), each with its strongest tier and the changed files that select it.

    A changed file that matches a glob of always_run selects all of tests (path): tier all. Documentation selects nothing. A file
    in no known language, with a parse error, or not among files (path; parse_error, declares_tests) selects the tests of its top
    directory: tier directory; so does one that no test depends on. Every other one selects the tests that depend on it, itself included: tier graph.
    Besides tests, files that declare tests are found by way of the graph.
    """
    judged, candidates = _judged(changed, tests, files, always_run)
    seeds = judged.where("why = 'seed'").select(F.col("path").alias("node"))
    reach = _kept(distances(edges, seeds, reverse=True, only=candidates.select(F.col("test").alias("node"))).select(F.col("node").alias("test"), F.col("start").alias("via")))
    named = candidates.where("named").select("test")
    in_top = named.withColumn("_top", _top(F.col("test")))
    beneath = _stuck(judged, reach.select(F.col("via").alias("path"))).withColumn("_in", _top(F.col("path")))
    # a file at the root has all tests below it; each other one those of its top directory
    directory = beneath.where("_in IS NOT NULL").join(in_top, F.col("_in") == F.col("_top")).unionByName(beneath.where("_in IS NULL").join(in_top, F.lit(True)))
    rows = (
        reach.select("test", F.lit(0).alias("tier"), "via")
        .unionAll(directory.select("test", F.lit(1), "path"))
        .unionAll(judged.where("why = 'always run'").join(named, F.lit(True)).select("test", F.lit(2), "path"))
    )
    names = F.array(*map(F.lit, TIERS))
    return rows.groupBy("test").agg(F.get(names, F.max("tier")).alias("tier"), F.array_join(F.array_sort(F.collect_set("via")), ",").alias("via"))


def selection_totals(changed: DataFrame, tests: DataFrame, files: DataFrame, edges: DataFrame, always_run: tuple[str, ...] = ()) -> DataFrame:
    """One row: test_files, selected, ratio, escalation (the strongest tier above the graph's, or null), and the sorted reasons.

    A selected file that tests doesn't name counts as a test file, so the ratio is 1 at most; without tests it is 0. Which file
    selects which test isn't asked, so both are searched for at once and no pairs of them are made.
    """
    judged, candidates = _judged(changed, tests, files, always_run)
    seeds = judged.where("why = 'seed'").select(F.col("path").alias("node"))
    tested = reached(edges, candidates.select(F.col("test").alias("node"))).select(F.col("node").alias("path"))
    stuck = _kept(_stuck(judged, tested))
    always = judged.where("why = 'always run'").select("path")
    named = candidates.where("named").select("test")
    tops = stuck.select(_top(F.col("path")).alias("_in")).distinct()
    below = named.join(tops.where("_in IS NOT NULL"), _top(F.col("test")) == F.col("_in"), "left_semi")
    every = named.join(tops.where("_in IS NULL").select(F.lit(1)).unionAll(always.select(F.lit(1))).limit(1), F.lit(True)).select("test")
    found = reached(edges, seeds, reverse=True).select(F.col("node").alias("test")).join(candidates, "test", "left_semi")
    chosen = _kept(found.unionAll(below).unionAll(every).distinct())
    reasons = stuck.withColumn("tier", F.lit(1)).unionByName(always.withColumns({"why": F.lit("always run"), "tier": F.lit(2)}))
    reasons = reasons.select("path", "tier", F.concat(F.col("why"), F.lit(": "), "path").alias("reason"))
    named = tests.select(F.col("path").alias("test")).distinct()
    counts = chosen.agg(F.count("*").alias("selected")).crossJoin(named.unionAll(chosen).distinct().agg(F.count("*").alias("test_files")))
    told = reasons.agg(F.get(F.array(*map(F.lit, TIERS)), F.max("tier")).alias("escalation"), F.array_join(F.array_sort(F.collect_set("reason")), ";").alias("reasons"))
    ratio = F.round(F.coalesce(F.try_divide(F.col("selected").cast("double"), F.col("test_files")), F.lit(0.0)), 6)
    return counts.crossJoin(told).select("test_files", "selected", ratio.alias("ratio"), "escalation", "reasons")


def renamed(renames: DataFrame, touched: DataFrame, most_hops: int = 64) -> DataFrame:
    """touched (path, ts) with the name each path has today; a rename (old, new, ts) holds for rows not younger than it.

    Chains are followed a hop at a time, each to the earliest rename that comes after the row's time.
    """
    now = _kept(touched.withColumn("_row", F.monotonically_increasing_id()).withColumns({"current": F.col("path"), "_at": F.col("ts")}))
    moves = renames.select(F.col("old").alias("_old"), F.col("new").alias("_new"), F.col("ts").alias("_moved"))
    for _ in range(most_hops):
        hop = now.join(moves, (F.col("current") == F.col("_old")) & (F.col("_moved") >= F.col("_at"))).groupBy("_row").agg(F.min_by(F.struct("_new", "_moved"), F.struct("_moved", "_new")).alias("_hop"))
        if not hop.take(1):
            break
        now = _kept(now.join(hop, "_row", "left").select(*touched.columns, "_row", F.coalesce("_hop._new", "current").alias("current"), F.when(F.col("_hop").isNotNull(), F.expr("timestampadd(MICROSECOND, 1, _hop._moved)")).otherwise(F.col("_at")).alias("_at")))
    return now.drop("_row", "_at")
