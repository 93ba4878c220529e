"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Every text gets a few counts. Two rules reject on them alone. Of the rest, each group (language and source) is described by
a minimum-covariance-determinant estimate of transformed counts: from two starts, the coordinates' medians with the spreads of their
middle halves and the plain mean and covariance, concentration steps keep the share of rows with the smallest Mahalanobis
distances and take mean and covariance of those, until no group's determinant falls any more. The smaller determinant of the two is
the estimate. Rows beyond ``cutoff`` are rejected.

Every step is one partially aggregated group-by over a narrow table in the shared folder; only one row of moments per group
crosses, so a group with a third of all rows costs no task more than another.

Defined cases: a null or empty text has no words and fails; null language or source is a group of its own; in groups
with fewer than ``least_rows`` rows the robust start, widened, is the estimate; where a count hardly varies, its spread is
floored, so that small differences are no outliers; texts of any length are read whole; repeated rows are judged alike; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ranksmith.llm.common import SPACE, guarded, guarded_name, kept_columns, row_keys
from ranksmith.storage import written

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["x0", "x1", "x2", "x3", "x4"]

# The least spread of each transformed count: log words, word length, share of symbols, and weighted shares of equal lines and
# repeated words. Beyond sqrt(CUTOFF) times its floor each of the last three can reject alone: 35 equal lines of 70, not 5 of 6.
FLOORS = [0.5, 0.5, 0.03, 0.25, 0.25]
# Chi-square with five degrees of freedom: about one row in 10^9 of a normal distribution lies beyond.
CUTOFF = 52.0
SHARE = 0.75
# A step that lowers the logarithm of a determinant by less than this is the last.
SETTLED = 0.01
START = "_start"


def sorted_windows(words: Column) -> Column:
    """The hashes of all windows of three words with their places, sorted.

    Equal neighbours mark repeated windows, and each marked place in order covers up to three words that
    the next one does not.
    """
    places = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(
        F.transform(
            places,
            lambda k: F.struct(
                F.xxhash64(F.get(words, k), F.get(words, k + 1), F.get(words, k + 2)).alias("h"), k.alias("k")
            ),
        )
    )


def with_counts(table: DataFrame, text: str) -> DataFrame:
    """The rows with the five counts and ``_q_n_lines``; helper columns begin with ``_q``."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(value, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    table = table.withColumns(
        {
            "_q_words": F.filter(F.split(value, f"[{SPACE}]+", -1), lambda w: w != ""),
            "_q_lines": lines,
            "word_chars": F.length(F.regexp_replace(value, f"[{SPACE}]+", "")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(value, "[^#*$%&|<>]+", "")).cast("bigint"),
        }
    )
    table = table.withColumns(
        {
            "n_words": F.size("_q_words").cast("bigint"),
            "_q_n_lines": F.size("_q_lines"),
            "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("bigint"),
            "_q_windows": sorted_windows(F.col("_q_words")),
        }
    )
    h = lambda k: F.get("_q_windows", k)["h"]
    table = table.withColumn(
        "_q_repeats",
        F.sort_array(
            F.transform(
                F.filter("_q_windows", lambda w, k: (w["h"] == h(k - 1)) | (w["h"] == h(k + 1))), lambda w: w["k"]
            )
        ),
    )
    gaps = F.transform("_q_repeats", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_q_repeats", k + 1) - p, F.lit(3))))
    table = table.withColumn(
        "n_repeat_words", F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, gap: total + gap)
    )
    return table.drop("_q_words", "_q_lines", "_q_windows", "_q_repeats")


def transformed() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p("n_words"),
        F.col("word_chars") / words,
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        # A share, weighted by the count's size: small for a short notice in a short text, large for a page of copies.
        F.log1p("n_dup_lines") * F.col("n_dup_lines") / F.greatest(F.col("_q_n_lines"), F.lit(1)),
        F.log1p("n_repeat_words") * F.col("n_repeat_words") / words,
    ]


def moments(rows: DataFrame, group: list[str], *more: Column) -> DataFrame:
    """Rows, means and covariances of each group."""
    products = [(i, j) for i in range(5) for j in range(i + 1)]
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(x).alias(f"m{i}") for i, x in enumerate(FEATURES)],
        *[F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c{i}{j}") for i, j in products],
        *more,
    )


def triangle(estimate: DataFrame, inflate: Column) -> DataFrame:
    """The Cholesky factor l00 to l44 of the covariance, inflated, with the squared floors added to its diagonal."""
    for i in range(5):
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") * inflate
            if i == j:
                value = value + F.lit(FLOORS[i] ** 2)
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            if i == j:
                estimate = estimate.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(FLOORS[i] ** 2 / 4))))
            else:
                estimate = estimate.withColumn(f"l{i}{j}", value / F.col(f"l{j}{j}"))
    return estimate


def distance() -> Column:
    """Squared Mahalanobis distance by forward substitution with the group's factor."""
    solved: list[Column] = []
    for i, x in enumerate(FEATURES):
        value = F.col(x) - F.col(f"m{i}")
        for k, z in enumerate(solved):
            value = value - F.col(f"l{i}{k}") * z
        solved.append(value / F.col(f"l{i}{i}"))
    return sum(z * z for z in solved)


def met(rows: DataFrame, estimate: DataFrame, group: list[str]) -> DataFrame:
    """Rows with their group's estimate; null groups meet too. Spark splits a hot group of the join."""
    renamed = estimate.withColumnsRenamed({g: f"{g}_of" for g in group})
    on = [rows[g].eqNullSafe(renamed[f"{g}_of"]) for g in group]
    return rows.join(renamed, on, "left").drop(*[f"{g}_of" for g in group])


def log_determinant() -> Column:
    """Half the logarithm of the determinant: the sum over the factor's diagonal."""
    return sum(F.log(f"l{i}{i}") for i in range(5))


def robust_start(rows: DataFrame, group: list[str]) -> DataFrame:
    """Medians, and spreads from the middle half as for a normal distribution (its width is 1.349 deviations)."""
    middle = rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, x in enumerate(FEATURES)],
    )
    for i in range(5):
        middle = middle.withColumn(f"m{i}", F.col(f"q{i}")[1])
        for j in range(i + 1):
            spread = F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)
            middle = middle.withColumn(f"c{i}{j}", spread)
    return triangle(middle.drop(*[f"q{i}" for i in range(5)]), F.lit(1.0)).withColumn(START, F.lit(0))


def estimates(rows: DataFrame, group: list[str], share: float, least_rows: int) -> DataFrame:
    """Mean and Cholesky factor of each group: of concentration steps from both starts, what has the smallest determinant.

    Every step reads the estimates that still improve. It ends when none does; as a determinant cannot fall below that of
    the floors, it does end.
    """
    factors = [f"l{i}{j}" for i in range(5) for j in range(i + 1)]
    kept = [*group, START, "n", *[f"m{i}" for i in range(5)], *factors]
    robust = robust_start(rows, group)
    plain = triangle(moments(rows, group), F.lit(1.0)).withColumn(START, F.lit(1))
    start = written(robust.select(*kept).unionByName(plain.select(*kept)), "estimate")
    # Groups too small for a covariance keep the robust start, the wider the fewer rows it rests on.
    wider = F.sqrt(1 + least_rows / F.col("n"))
    few = start.where((F.col("n") < least_rows) & (F.col(START) == 0)).withColumns({c: F.col(c) * wider for c in factors})
    current = start.where(F.col("n") >= least_rows).withColumn("reached", F.lit(None).cast("double"))
    found = few.withColumn("reached", F.lit(0.0))
    own = [*group, START]
    while True:
        measured = met(rows, current, group).where(F.col(START).isNotNull()).withColumn("d", distance())
        measured = measured.select(*own, "reached", *FEATURES, "d")
        limits = written(measured.groupBy(*own).agg(F.percentile_approx("d", share, 1000).alias("limit")), "limits")
        nearest = met(measured, limits, own).where(F.col("d") <= F.col("limit"))
        better = triangle(moments(nearest, own, F.first("reached").alias("before")), F.lit(_inflation(share)))
        better = better.withColumn("reached", log_determinant())
        better = written(better.select(*kept, "before", "reached"), "estimate")
        found = found.unionByName(better.drop("before"))
        current = better.where(F.col("before").isNull() | (F.col("reached") < F.col("before") - SETTLED)).drop("before")
        if current.isEmpty():
            break
    columns = [c for c in kept if c not in group]
    least = found.groupBy(*group).agg(F.min(F.struct("reached", *columns)).alias("e"))
    return written(least.select(*group, *[F.col(f"e.{c}").alias(c) for c in columns if c != START]), "estimate")


def _inflation(share: float) -> float:
    """How much a covariance of the inner ``share`` of a five-variate normal distribution is too small.

    share / P(chi2 with 7 degrees <= the share quantile of chi2 with 5), the consistency factor of the estimator.
    """
    from math import erf, exp, pi, sqrt

    def chi2(x: float, degrees: int) -> float:
        total = erf(sqrt(x / 2))
        term = sqrt(2 * x / pi) * exp(-x / 2)
        for k in range(3, degrees + 1, 2):
            total -= term
            term *= x / k
        return total

    low, high = 0.0, 100.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2(middle, 5) < share else (low, middle)
    return share / chi2(low, 7)


def judge_quality(
    documents: DataFrame,
    text: str = "text",
    group: tuple[str, ...] = ("lang", "source"),
    keep: list[str] | None = None,
    share: float = SHARE,
    cutoff: float = CUTOFF,
    least_rows: int = 30,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """The rows with the five counts, ``base_failed``, ``distance`` (null for rows that failed) and ``kept``.

    ``keep`` names the input columns to pass on (default all); they are written once with the counts.
    """
    results = [*COUNTS, "base_failed", "distance", "kept"]
    passed = kept_columns(documents, results, keep)
    table, _ = guarded(documents)
    names = {c: guarded_name(documents, c) for c in passed}
    groups = [guarded_name(documents, g) for g in group]
    counted = with_counts(table, guarded_name(documents, text))
    counted = counted.withColumn(
        "base_failed",
        (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
    )
    counted = counted.withColumns({f"g{k}": F.col(g) for k, g in enumerate(groups)})
    held = [*names.values(), *[f"g{k}" for k in range(len(groups))], *COUNTS, "base_failed"]
    counted = counted.select(*held, "_q_n_lines").withColumns(dict(zip(FEATURES, transformed()))).drop("_q_n_lines")
    own = [f"g{k}" for k in range(len(groups))]
    counted = written(counted, "counted")
    sound = counted.where(~F.col("base_failed")).select(*own, *FEATURES)
    current = estimates(sound, own, share, least_rows)
    judged = met(counted, current, own)
    far = F.when(~F.col("base_failed"), distance())
    return judged.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        *COUNTS,
        "base_failed",
        far.alias("distance"),
        (~F.col("base_failed") & (F.coalesce(far, F.lit(0.0)) <= cutoff)).alias("kept"),
    )


def sound_documents(
    documents: DataFrame, text: str = "text", group: tuple[str, ...] = ("lang", "source"), **options
) -> DataFrame:
    """The documents that are kept, with the columns they came with. Only keys and counts are written; the texts meet them once."""
    table, back = guarded(documents)
    value, groups = guarded_name(documents, text), tuple(guarded_name(documents, g) for g in group)
    keyed = table.withColumns(row_keys(value, *groups))
    judged = judge_quality(keyed.select(value, *groups, "k1", "k2"), value, groups, keep=["k1", "k2"], **options)
    kept = written(judged.where("kept").select("k1", "k2").distinct(), "kept")
    return back(keyed.join(kept, ["k1", "k2"], "left_semi"))
