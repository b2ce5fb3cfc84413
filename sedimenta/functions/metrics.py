"""Column functions of the metric model: complexity, thresholds, effort, ratings, severities.

Unknown is null and stays so: no function here turns it into zero, unless its text says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("unknown", "info", "low", "medium", "high", "critical")
#: Remediation minutes per unit over a limit.
MINUTES = {"cognitive": 8, "cyclomatic": 4, "nesting": 10, "crap": 12}
#: Highest share of minutes per loc * 30 for the grades A to D.
BANDS = ((0.05, "A"), (0.10, "B"), (0.20, "C"), (0.50, "D"))
# Fixed values of the risk model: the weight of each component, what a policy severity counts, and from where on a measure counts in full.
RISK_WEIGHTS = {"complexity": 20, "crap": 15, "churn": 20, "impact": 20, "ownership": 10, "policy": 15}
POLICY_RISK = {"info": 30.0, "warning": 60.0, "error": 100.0}
FULL = {"cognitive": 30.0, "cyclomatic": 20.0, "crap": 30.0, "changes": 20.0}

#: What a metric says: its unit, an explanation, and when it is unknown.
EXPLAINED = {
    "cognitive": ("points", "How hard a function's control flow is to follow: a break in the flow counts 1, and 1 more for each level it is nested.", "never"),
    "cyclomatic": ("paths", "Linearly independent paths through a function: 1 and 1 more for each decision.", "never"),
    "nesting": ("levels", "Deepest level of nested control flow.", "never"),
    "loc": ("lines", "Lines from a function's first to its last.", "never"),
    "coverage": ("share", "Covered lines and branches among those that a report knows.", "no coverage report has a line of the function"),
    "crap": ("points", "Complexity that tests don't cover: c * c * (1 - coverage) ** 3 + c, with c the cyclomatic complexity.", "the coverage is unknown"),
    "maintainability": ("0 to 100", "171 - 5.2 ln(volume) - 0.23 cyclomatic - 16.2 ln(loc), scaled.", "never"),
    "risk": ("0 to 100", "Weighted mean of complexity, crap, churn, impact, ownership and policy over those that are known.", "never"),
}


def crap(cyclomatic: Column, coverage: Column) -> Column:
    """c^2 (1 - coverage)^3 + c; unknown without coverage."""
    c = cyclomatic.cast("double")
    return c * c * F.pow(1 - coverage, 3) + c


def halstead_volume(length: Column, vocabulary: Column) -> Column:
    """length * log2(vocabulary), 0 for an empty vocabulary."""
    return F.when(vocabulary > 0, length * F.log2(vocabulary.cast("double"))).otherwise(F.lit(0.0))


def halstead_difficulty(distinct_operators: Column, operands: Column, distinct_operands: Column) -> Column:
    return F.when(distinct_operands > 0, distinct_operators / 2 * operands / distinct_operands).otherwise(F.lit(0.0))


def maintainability(volume: Column, cyclomatic: Column, loc: Column) -> Column:
    """171 - 5.2 ln(volume) - 0.23 cyclomatic - 16.2 ln(loc), scaled to 0..100."""
    one = F.lit(1.0)
    raw = 171 - 5.2 * F.log(F.greatest(volume, one)) - 0.23 * cyclomatic - 16.2 * F.log(F.greatest(loc.cast("double"), one))
    return F.least(F.greatest(raw * 100 / 171, F.lit(0.0)), F.lit(100.0))


def violation_reasons(limits: dict[str, float]) -> Column:
    """Ordered array of the metrics strictly over their limit; an unknown crap violates as crap_unavailable."""
    found = []
    for name, limit in limits.items():
        over = F.when(F.col(name) > limit, F.lit(name))
        found.append(F.when(F.col(name).isNull(), F.lit("crap_unavailable")).otherwise(over) if name == "crap" else over)
    return F.filter(F.array(*found), lambda r: r.isNotNull())


def unsuppressed(reasons: Column, suppressed: Column) -> Column:
    """reasons without those that the source suppresses; crap also hides crap_unavailable."""
    hidden = F.when(F.array_contains(suppressed, "crap"), F.concat(suppressed, F.array(F.lit("crap_unavailable")))).otherwise(suppressed)
    return F.array_except(reasons, F.coalesce(hidden, F.array().cast("array<string>")))


def effort(limits: dict[str, float]) -> dict[str, Column]:
    """Remediation minutes by metric; an unknown metric adds none."""
    out = {}
    for name, limit in limits.items():
        over = F.greatest(F.col(name) - limit, F.lit(0))
        out[name] = F.coalesce(F.ceil(MINUTES[name] * over).cast("long"), F.lit(0).cast("long"))
    return out


def maintainability_rating(minutes: Column, loc: Column) -> Column:
    """Grade of minutes / (loc * 30); without code nothing is to be mended, which is an A."""
    share = F.when(loc > 0, minutes / (loc * 30)).otherwise(F.lit(0.0))
    out = F.lit("E")
    for bound, grade in reversed(BANDS):
        out = F.when(share <= bound, grade).otherwise(out)
    return out


def severity_of_label(label: Column) -> Column:
    """Of a scanner's label, in any case; what isn't known is unknown."""
    lower = F.lower(label)
    named = F.when(lower == "critical", "critical").when(lower.isin("high", "error"), "high")
    return named.when(lower.isin("medium", "moderate", "warning"), "medium").when(lower.isin("low", "note"), "low").otherwise("unknown")


def severity_of_score(score: Column) -> Column:
    """Bands of a 0-10 score, open at both ends; none, or one that isn't finite, is unknown."""
    finite = score.isNotNull() & ~F.isnan(score.cast("double")) & (F.abs(score) != float("inf"))
    return F.when(~finite, "unknown").when(score < 4, "low").when(score < 7, "medium").when(score < 9, "high").otherwise("critical")


def severity_rank(severity: Column) -> Column:
    """Severities order by declaration, never by label."""
    return (F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(1)) - 1).cast("int")


def security_rating(counts: dict[str, Column]) -> Column:
    """A without findings down to E with a critical one; null if all that is found is unknown."""
    rated = F.when(counts["critical"] > 0, "E").when(counts["high"] > 0, "D").when(counts["medium"] > 0, "C").when((counts["low"] > 0) | (counts["info"] > 0), "B")
    return rated.when(counts["unknown"] > 0, F.lit(None).cast("string")).otherwise("A")


def weighted_score(components: dict[str, Column], weights: dict[str, int] | None = None) -> Column:
    """Weighted mean over the components that are known; 0 if none is."""
    weights = weights or RISK_WEIGHTS
    top, below = F.lit(0.0), F.lit(0.0)
    for name, value in components.items():
        top = top + F.when(value.isNotNull(), value * weights[name]).otherwise(0.0)
        below = below + F.when(value.isNotNull(), F.lit(float(weights[name]))).otherwise(0.0)
    return F.when(below > 0, top / below).otherwise(F.lit(0.0))


def risk_components(cognitive: Column, cyclomatic: Column, crap: Column, changes: Column, blast_percent: Column, concentration: Column, policy: Column) -> dict[str, Column]:
    """The six components, 0 to 100. Files always have complexity, impact and policy, none being 0; the others may be unknown."""
    level = F.lit(0.0)
    for name, value in POLICY_RISK.items():
        level = F.when(policy == name, value).otherwise(level)
    none = lambda c: F.coalesce(c, F.lit(0))
    return {
        "complexity": F.greatest(saturated(none(cognitive), FULL["cognitive"]), saturated(none(cyclomatic), FULL["cyclomatic"])),
        "crap": F.when(crap.isNotNull(), saturated(crap, FULL["crap"])),
        "churn": F.when(changes.isNotNull(), saturated(changes, FULL["changes"])),
        "impact": F.least(F.coalesce(blast_percent, F.lit(0.0)), F.lit(100.0)),
        "ownership": concentration,
        "policy": level,
    }


def saturated(value: Column, full: float) -> Column:
    """0 to 100; 100 from full on."""
    return F.least(F.greatest(value / full, F.lit(0.0)), F.lit(1.0)) * 100


def grew(before: Column, after: Column) -> Column:
    """after - before, 0 at least; null if either is."""
    return F.when(before.isNotNull() & after.isNotNull(), F.greatest(after - before, F.lit(0)))
