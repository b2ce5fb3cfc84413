"""Text and code: tokens, k-gram clones, metric folds over event streams, suppressions, SQL lint."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.hashing import Hasher, mix, runs_of, slices

_HASHER = Hasher(30)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = True
#: Characters of text, about, whose k-grams one task compares.
BIN_CHARS = 24_000_000
MOST_BINS = 4096


def tokens(docs: DataFrame, file: str, language: str, text: str) -> DataFrame:
    """(file, language, pos, token): lower-case runs of ASCII letters, from position 0."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]+"), 0)
    return docs.select(F.col(file).alias("file"), F.col(language).alias("language"), F.posexplode(words).alias("pos", "token"))


def kgrams(docs: DataFrame, file: str, language: str, text: str, k: int) -> DataFrame:
    """(file, language, pos, gram): a rolling hash of every run of k tokens; made within the row, without a shuffle.

    Hashing a run's every token anew would cost k times as much, so it is done in Arrow batches, where prefix sums do.
    """
    schema = docs.select(F.col(file).alias("file"), F.col(language).alias("language")).schema.add("pos", "integer").add("gram", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, pos, own in _grams(batch.column("_text"), k):
                row = pa.array(row)
                yield pa.RecordBatch.from_arrays([batch.column("file").take(row), batch.column("language").take(row), pa.array(pos), pa.array(own.view(np.int64))], names=["file", "language", "pos", "gram"])

    return docs.select(F.col(file).alias("file"), F.col(language).alias("language"), F.lower(text).alias("_text")).mapInArrow(run, schema)


def _grams(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, position, hash) of every run of k tokens, some texts at a time."""
    for first, end, data, offsets in slices(texts):
        starts, ends = runs_of(_LETTER[data])
        begin = np.searchsorted(starts, offsets)
        grams = _HASHER.grams(_HASHER.words(data, starts, ends), k)
        counts = np.maximum(np.diff(begin) - k + 1, 0)
        pos = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        yield np.repeat(np.arange(first, end), counts), pos.astype(np.int32), grams[pos + np.repeat(begin[:-1], counts)]


def repeated_kgrams(docs: DataFrame, file: str, language: str, text: str, k: int, bin_chars: int = BIN_CHARS) -> DataFrame:
    """The rows of kgrams whose gram is found twice or more in its language.

    Most runs are found once, so hashes are dealt over bins and compared in arrays, a row of many, and what is found once goes no further. A
    batch sends a gram that it has several times to its bin once, so that a frequent one is no more than a value of each batch there.
    """
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    bins = max(1, min(MOST_BINS, -(-chars // bin_chars)))
    named = docs.select(F.col(file).alias("file"), F.col(language).alias("language"), F.lower(text).alias("_text"))
    kind = named.schema["file"].dataType.simpleString()
    names = ["bin", "known", "language", "files", "pos", "grams"]

    def row(bin_: np.ndarray, known: bool, language: pa.Scalar, offsets: np.ndarray, files: pa.Array, pos: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
        listed = lambda values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        columns = [pa.array(bin_, pa.int32()), pa.repeat(known, len(bin_)), pa.repeat(language, len(bin_)), listed(files), listed(pa.array(pos)), listed(pa.array(grams.view(np.int64)))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch in batches:
            found = list(_grams(batch.column("_text"), k))
            if not found:
                continue
            rows, places, grams = (np.concatenate(x) for x in zip(*found, strict=True))
            coded = batch.column("language").dictionary_encode(null_encoding="encode")
            of_row = coded.indices.to_numpy()[rows]
            for c, language in enumerate(coded.dictionary):
                own = np.flatnonzero(of_row == c)
                if not len(own):
                    continue
                hashes = mix(grams[own])
                order = np.argsort(hashes)
                own, hashes = own[order], hashes[order]
                head = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
                counts = np.diff(np.append(head, len(own)))
                several = own[np.repeat(counts > 1, counts)]
                if len(several):
                    yield row(np.array([turn % bins]), True, language, np.array([0, len(several)]), batch.column("file").take(pa.array(rows[several])), places[several], grams[several])
                    turn += 1
                bin_of = ((hashes[head] >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
                first = own[head]
                offsets = np.append(np.flatnonzero(np.append(True, bin_of[1:] != bin_of[:-1])), len(head))
                yield row(bin_of[offsets[:-1]], False, language, offsets, batch.column("file").take(pa.array(rows[first])), np.where(counts > 1, -1, places[first]).astype(np.int32), grams[first])

    def flat(language: pa.Scalar, files: pa.Array, pos: pa.Array, grams: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([files, pa.repeat(language, len(files)), pos, grams], names=["file", "language", "pos", "gram"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for known, language, files, pos, grams in zip(*(batch.column(c) for c in names[1:]), strict=True):
                if known.as_py():
                    yield flat(language, files.values, pos.values, grams.values)
                else:
                    held.setdefault(language.as_py(), (language, []))[1].append((files.values, pos.values, grams.values))
        for language, parts in held.values():
            files, pos, grams = (pa.chunked_array(x) for x in zip(*parts, strict=True))
            hashes = grams.to_numpy()
            order = np.argsort(hashes)
            same = hashes[order][1:] == hashes[order][:-1]
            twice = order[np.append(False, same) | np.append(same, False)]
            twice = pa.array(np.sort(twice[pos.to_numpy()[twice] >= 0]))
            if len(twice):
                yield flat(language, *(x.take(twice).combine_chunks() for x in (files, pos, grams)))

    dealt = named.mapInArrow(deal, f"bin int, known boolean, language string, files array<{kind}>, pos array<int>, grams array<bigint>")
    return dealt.repartitionById(bins, "bin").select(*names).mapInArrow(compare, f"file {kind}, language string, pos int, gram bigint")


def kgram_groups(grams: DataFrame) -> DataFrame:
    """(language, gram, occurrences, files) of runs found twice or more."""
    by_file = grams.groupBy("language", "gram", "file").agg(F.count("*").alias("_n"))
    return by_file.groupBy("language", "gram").agg(F.sum("_n").alias("occurrences"), F.count("*").alias("files")).where("occurrences > 1")


def clone_runs(grams: DataFrame, k: int) -> DataFrame:
    """(file, start, end): maximal stretches of tokens of which every k-gram is found elsewhere in its language.

    Counting comes before joining, and what is joined back is a gram's count and not its partners: stretches grow
    with the text and not with the square of a clone group.
    """
    return repeated_runs(_repeated(grams), k)


def clone_groups(grams: DataFrame, k: int, texts: DataFrame | None = None) -> DataFrame:
    """(group_id, occurrences, files, tokens) of maximal stretches that are alike as a whole: the group's id is a digest of its k-gram hashes."""
    return repeated_groups(_repeated(grams), k)


def _repeated(grams: DataFrame) -> DataFrame:
    return grams.join(grams.groupBy("language", "gram").agg(F.count("*").alias("_n")).where("_n > 1").select("language", "gram"), ["language", "gram"])


def _stretched(repeated: DataFrame) -> DataFrame:
    """Rows that have the same _i in a file follow one another. As in a join, no unknown language is equal to another."""
    return repeated.where("language IS NOT NULL").select("file", "pos", "gram", (F.col("pos") - F.row_number().over(Window.partitionBy("file").orderBy("pos"))).alias("_i"))


def repeated_runs(repeated: DataFrame, k: int) -> DataFrame:
    """clone_runs from rows like those of repeated_kgrams."""
    return _stretched(repeated).groupBy("file", "_i").agg(F.min("pos").alias("start"), (F.max("pos") + k).alias("end")).drop("_i")


def repeated_groups(repeated: DataFrame, k: int) -> DataFrame:
    """clone_groups from rows like those of repeated_kgrams: a stretch's rows are all that it needs, so nothing is joined to it."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "gram"))), lambda x: x["gram"].cast("string"))
    digests = _stretched(repeated).groupBy("file", "_i").agg((F.max("pos") + k - F.min("pos")).alias("_tokens"), F.sha2(F.array_join(listed, ","), 256).alias("group_id"))
    return digests.groupBy("group_id").agg(F.count("*").alias("occurrences"), F.countDistinct("file").alias("files"), F.max("_tokens").alias("tokens")).where("occurrences > 1")


def logical_runs(events: DataFrame, fn: str, seq: str, pos: str, op: str) -> DataFrame:
    """(fn, runs): how often a logical operator differs from the one before in its sequence."""
    before = F.lag(op).over(Window.partitionBy(fn, seq).orderBy(pos))
    return events.withColumn("_new", (~F.col(op).eqNullSafe(before)).cast("long")).groupBy(fn).agg(F.sum("_new").alias("runs"))


def metric_fold(events: DataFrame, fn: str = "fn") -> DataFrame:
    """Metrics by function from events (kind, nesting, text).

    A decision adds 1 + nesting to cognitive and 1 to cyclomatic complexity, an else and a labelled jump 1 to cognitive;
    cyclomatic complexity begins at 1. Operators and operands count once distinct and once in all.
    """
    kind = lambda k: F.col("kind") == k
    return events.groupBy(fn).agg(
        (F.sum(kind("decision").cast("long")) + 1).alias("cyclomatic"),
        F.sum(F.when(kind("decision"), 1 + F.col("nesting")).when(kind("else") | kind("jump"), 1).otherwise(0)).cast("long").alias("cognitive"),
        F.max("nesting").alias("max_nesting"),
        F.countDistinct(F.when(kind("operator"), F.col("text"))).alias("distinct_operators"),
        F.count(F.when(kind("operator"), 1)).alias("operators"),
        F.countDistinct(F.when(kind("operand"), F.col("text"))).alias("distinct_operands"),
        F.count(F.when(kind("operand"), 1)).alias("operands"),
    )


SUPPRESSIBLE = ("cognitive", "cyclomatic", "nesting", "loc", "parameters", "crap")


def suppressions(text: Column) -> Column:
    """Metrics that a comment ``lint: allow(a, b)`` names, known ones only, in order; null without such a comment."""
    inside = F.regexp_extract(text, r"lint:\s*allow\(([^)]*)\)", 1)
    named = F.transform(F.split(inside, ","), lambda x: F.lower(F.trim(x)))
    return F.when(text.rlike(r"lint:\s*allow\("), F.array_intersect(F.array(*map(F.lit, SUPPRESSIBLE)), named))


#: Rules on statement text whose literals and comments are blanked: (rule, severity, pattern that must match, pattern that must not).
SQL_RULES = (
    ("update_without_where", "high", r"^\s*update\b", r"\bwhere\b"),
    ("delete_without_where", "high", r"^\s*delete\s+from\b", r"\bwhere\b"),
    ("non_sargable_predicate", "medium", r"\bwhere\b.*\b(lower|upper|trim|date|cast|coalesce|substr|substring)\s*\([^)]*\)\s*(=|<|>|like\b|in\b)", None),
)
LARGE_OFFSET = 1000


def statements(files: DataFrame) -> DataFrame:
    """(path, ordinal, line, raw, sql) of files (path, text): split at semicolons outside quotes and comments.

    raw is the statement's own text; in sql literals, quoted or dollar-quoted, are '' and comments blanks.
    """
    blank = r"(?s)--[^\n]*|/\*.*?\*/"
    literal = r"(?s)'(?:[^']|'')*'|\$([A-Za-z_]*)\$.*?\$\1\$"
    part = r"(?s)(?:--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\$([A-Za-z_]*)\$.*?\$\1\$|[^;])+"
    parts = F.regexp_extract_all(F.col("text"), F.lit(part), 0)
    listed = files.select("path", F.posexplode(parts).alias("ordinal", "raw")).withColumn("_lines", F.size(F.split("raw", "\n")) - 1)
    before = F.coalesce(F.sum("_lines").over(Window.partitionBy("path").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    lead = F.size(F.split(F.regexp_extract("raw", r"(?s)^((?:\s|--[^\n]*\n|/\*.*?\*/)*)", 1), "\n")) - 1
    cleaned = F.lower(F.regexp_replace(F.regexp_replace("raw", blank, " "), literal, "''"))
    return listed.select("path", "ordinal", (before + lead + 1).alias("line"), F.trim("raw").alias("raw"), F.trim(F.regexp_replace(cleaned, r"\s+", " ")).alias("sql")).where("sql <> ''")


def sql_findings(files: DataFrame, large_offset: int = LARGE_OFFSET) -> DataFrame:
    """(path, line, rule, severity) of risky statements."""
    s = statements(files)
    cases = []
    for rule, severity, must, never in SQL_RULES:
        hit = F.col("sql").rlike(must) if never is None else F.col("sql").rlike(must) & ~F.col("sql").rlike(never)
        cases.append(F.when(hit, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))))
    wild = F.lower(F.col("raw")).rlike(r"\bi?like\s+'%")
    cases.append(F.when(wild, F.struct(F.lit("leading_wildcard").alias("rule"), F.lit("medium").alias("severity"))))
    cases.append(F.when(F.nullif(F.regexp_extract("sql", r"\boffset\s+(\d+)", 1), F.lit("")).try_cast("bigint") > large_offset, F.struct(F.lit("large_offset").alias("rule"), F.lit("medium").alias("severity"))))
    found = s.select("path", "line", F.explode(F.filter(F.array(*cases), lambda r: r.isNotNull())).alias("r"))
    return found.select("path", "line", "r.rule", "r.severity")


def unknown_tables(files: DataFrame) -> DataFrame:
    """(path, line, table): tables that statements refer to and that no statement of any file creates; names of a statement's own WITH don't count."""
    s = statements(files)
    name = r"((?:[a-z_][a-z0-9_]*\.)?[a-z_][a-z0-9_]*)"
    declared = s.select(F.explode(F.regexp_extract_all("sql", F.lit(rf"\bcreate\s+(?:temp(?:orary)?\s+|unlogged\s+)?(?:table|(?:materialized\s+)?view)\s+(?:if\s+not\s+exists\s+)?{name}"), 1)).alias("table")).select(F.substring_index("table", ".", -1).alias("table")).distinct()
    named = F.regexp_extract_all("sql", F.lit(rf"(?:\bwith\s+(?:recursive\s+)?|,\s*){name}\s*(?:\([^)]*\)\s*)?as\s*(?:not\s+)?(?:materialized\s+)?\("), 1)
    refs = F.regexp_extract_all("sql", F.lit(rf"\b(?:from|join|update|into)\s+(?:only\s+)?{name}(?!\s*\(|[a-z0-9_.])"), 1)
    used = s.where(~F.col("sql").rlike(r"^\s*create\b")).select("path", "line", F.explode(F.array_except(refs, named)).alias("table")).select("path", "line", F.substring_index("table", ".", -1).alias("table")).distinct()
    return used.join(declared, "table", "left_anti").select("path", "line", "table")


def sql_in_host(files: DataFrame) -> DataFrame:
    """(path, line, rule) of query calls in host code (path, text) that build their text from parts, or stand in a loop's body by indentation."""
    lines = files.select("path", F.posexplode(F.split("text", "\n")).alias("n", "code"))
    call = F.col("code").rlike(r"\b(?:query|execute|exec|prepare|raw)\s*\(")
    dynamic = call & F.col("code").rlike(r"\(\s*(?:f\"|f'|`[^`]*\$\{|[\"'][^\"']*[\"']\s*(?:\+|%|\.\.))")
    order = Window.partitionBy("path").orderBy("n")
    depth = F.length(F.regexp_extract("code", r"^(\s*)", 1))
    loop = F.when(F.col("code").rlike(r"^\s*(?:for|while)\b"), F.struct(depth.alias("d"), F.col("n").alias("n")))
    near = F.last(loop, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = lines.select("path", (F.col("n") + 1).alias("line"), dynamic.alias("dynamic"), (call & (depth > near["d"])).alias("looped"))
    rules = F.array(F.when(F.col("dynamic"), "dynamic_sql"), F.when(F.col("looped"), "query_in_loop"))
    return marked.select("path", "line", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))
