"""Quality rules as weak supervision: rules vote or abstain, and expectation-maximisation weighs them.

Everything that touches rows is a column expression. A document's votes are small integers; the
fit needs only how many documents there are of each combination of votes, which is at most
3 ** len(RULES) rows however large the corpus, and covers all of it. The expectation-maximisation
runs over these counts and gives each rule's accuracy on good text and on each kind of bad text; the
posterior probability is then again a column expression.

Null and empty texts have no words and fail the base rules. Rows repeat as they are, and columns
other than doc_id and text aren't read. On an empty table there is nothing to fit and no row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.tables import let, staged

_SPACE = r"[\x20\x09-\x0D]+"
_WINDOW = 5


def _words(text: Column) -> Column:
    """A text begins with a separator or not; only then is there an empty first part."""
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _grams(words: Column) -> Column:
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.transform(F.slice(h, 1, F.size(h) - _WINDOW + 1), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, _WINDOW)))))


def _covered(starts: Column) -> Column:
    """How many words the windows at these ascending starts cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        starts,
        zero,
        lambda a, s: F.struct((a["n"] + s + _WINDOW - F.greatest(a["end"], s)).alias("n"), (s + _WINDOW).alias("end")),
        lambda a: a["n"],
    )


def _repeated(grams: Column) -> Column:
    """Starts of the windows found twice or more; they are sorted only in texts that have any."""
    pairs = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.cast("long").alias("i"))))
    again = lambda p: F.filter(p, lambda x, k: (x["g"] == F.get(p, k - 1)["g"]) | (x["g"] == F.get(p, k + 1)["g"]))
    return let(pairs, lambda p: F.sort_array(F.transform(again(p), lambda x: x["i"])))


def _repeat_words(words: Column) -> Column:
    return F.when(
        F.size(words) >= _WINDOW,
        let(_grams(words), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_covered(_repeated(g)))),
    ).otherwise(F.lit(0).cast("long"))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def features(docs: DataFrame) -> DataFrame:
    """doc_id and what the rules are about, each a long, over the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.length(text)

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(x, lambda line: line.rlike(r"[.!?:;\"'\x{BB}\x{201D}\x{2026})][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended_lines"),
        )

    without = lambda pattern: (size - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    return docs.select(
        "doc_id",
        let(_words(text), of_words).alias("w"),
        let(_lines(text), of_lines).alias("l"),
        without(r"[#*$%&|<>]+").alias("n_symbols"),
        without(r"\p{Lu}+").alias("n_upper"),
        without(r"[!?]+").alias("n_shouts"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """Votes against where bad holds, else for where good holds, else abstains."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 10", "n_words >= 40"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 13 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("dup_lines", "2 * n_dup_lines > n_lines", "n_lines > 1 AND 10 * n_dup_lines <= n_lines"),
    Rule("repeat_words", "3 * n_repeat_words > n_words", "n_words >= 40 AND 50 * n_repeat_words <= n_words"),
    Rule("upper_case", "3 * n_upper > word_chars", "6 * n_upper <= word_chars"),
    Rule("shouting", "4 * n_shouts > n_words", "20 * n_shouts <= n_words"),
    Rule("line_ends", "n_lines > 1 AND 5 * n_ended_lines < n_lines", "2 * n_ended_lines >= n_lines"),
)


def votes(df: DataFrame) -> DataFrame:
    """df with a column _vote_<rule> of -1, 0 or 1 for each rule."""
    return df.withColumns({f"_vote_{r.name}": F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0) for r in RULES})


@dataclass(frozen=True)
class Weights:
    """Of each class its share, and how often each rule that votes votes against its texts. Class 0 is good text.

    Junk is of many kinds, which break other rules each; in one class of bad text the rules wouldn't be independent. So each
    rule has a class of bad text, of the kind that it knows.
    """

    shares: tuple[float, ...]
    against: tuple[tuple[float, ...], ...]

    def gain(self, kind: int, rule: int, vote: int) -> float:
        """What a vote adds to the log odds of that kind of bad text against good text."""
        q, good = self.against[kind][rule], self.against[0][rule]
        return 0.0 if vote == 0 else math.log(q / good) if vote < 0 else math.log((1 - q) / (1 - good))


#: Where the estimates start, which tells the classes apart: the share of good text, how often a rule votes against good text,
#: against its own kind of bad text, and against another kind.
START = (0.85, 0.002, 0.9, 0.05)
#: Votes at the start's rates, and a text of each class, that are counted besides those there are: without them a class of
#: no text has no rate. They don't grow with the corpus.
PSEUDO = 2.0


def start() -> Weights:
    k = len(RULES)
    good, wrong, own, other = START
    kinds = (tuple(own if i == j else other for i in range(k)) for j in range(k))
    return Weights((good, *((1 - good) / k,) * k), ((wrong,) * k, *kinds))


def maximise(counts: dict[tuple[int, ...], int], rounds: int = 300) -> Weights:
    """Expectation-maximisation over the counts of vote combinations. Nothing bounds the rates but the pseudo-counts."""
    k = len(RULES)
    total = sum(counts.values())
    now = first = start()
    for _ in range(rounds if total else 0):
        mass = [0.0] * (k + 1)
        seen = [[0.0] * k for _ in mass]
        against = [[0.0] * k for _ in mass]
        for v, n in counts.items():
            for c, p in enumerate(classes(now, v)):
                mass[c] += n * p
                for j, x in enumerate(v):
                    if x:
                        seen[c][j] += n * p
                        if x < 0:
                            against[c][j] += n * p
        rates = tuple(tuple((against[c][j] + PSEUDO * first.against[c][j]) / (seen[c][j] + PSEUDO) for j in range(k)) for c in range(k + 1))
        after = Weights(tuple((m + 1) / (total + k + 1) for m in mass), rates)
        moved = max(abs(x - y) for old, new in zip(now.against, rates, strict=True) for x, y in zip(old, new, strict=True))
        now = after
        if moved < 1e-8:
            break
    return now


def classes(weights: Weights, vote: tuple[int, ...]) -> list[float]:
    """Probability of each class."""
    z = [math.log(p / weights.shares[0]) + sum(weights.gain(c, j, x) for j, x in enumerate(vote)) for c, p in enumerate(weights.shares)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def posterior(weights: Weights, vote: tuple[int, ...]) -> float:
    return classes(weights, vote)[0]


def fit(voted: DataFrame) -> Weights:
    names = [f"_vote_{r.name}" for r in RULES]
    rows = voted.groupBy(*names).count().collect()  # 3 ** len(RULES) rows at most
    return maximise({tuple(r[n] for n in names): r["count"] for r in sorted(rows)})


def probability(weights: Weights) -> Column:
    """Posterior probability of good text, from the vote columns."""
    bad = F.lit(0.0)
    for c in range(1, len(weights.shares)):
        z = F.lit(math.log(weights.shares[c] / weights.shares[0]))
        for j, r in enumerate(RULES):
            vote = F.col(f"_vote_{r.name}")
            z = z + F.when(vote < 0, weights.gain(c, j, -1)).when(vote > 0, weights.gain(c, j, 1)).otherwise(0.0)
        bad = bad + F.exp(z)
    return 1 / (1 + bad)


def judged(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """A row per document: counts, votes' posterior, and whether it is kept."""
    voted = votes(staged(features(docs)))
    p = probability(fit(voted))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return voted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (p >= threshold)).alias("kept"), p.alias("quality_probability"),
    )
