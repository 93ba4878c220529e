"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Each source has a target number of words. Document rates between 0 and ``cap`` are sought that meet every source's target and
otherwise stay as near to 1 as they can, in the sense of relative entropy bounded on both sides. The solution tilts
rates exponentially in the document's size: the odds r / (cap - r) are those of rate 1 times exp(lambda * size / mean size).
The convex dual has one unknown per source, and its gradient and curvature are sums over documents. Newton's
iterations therefore are grouped sums over the counts of (source, size), kept inside a bracket that shrinks
with each sign of the gradient.

Rates become copies in groups of some hundred documents of a source, dealt by a hash: from the longest to the shortest,
each takes the whole number next below or above its rate that brings the words taken so far nearest to the words wanted.

Defined cases: a null or empty text has size 0 and rate 1 and takes nothing; a null source is a source, ordered last;
a source without words has target 0; rows equal in id, text and source get equal numbers of copies; the result is the same at
every run, however the rows are partitioned; texts of any length are read whole; rates that do not reach the targets in ``most``
iterations are an error; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ranksmith.llm.common import SPACE, guarded, guarded_name, kept_columns, row_keys
from ranksmith.storage import written

GROUP_ROWS = 200
BOUND = 1e6


def cycled_weights(documents: DataFrame, source: str, weights: tuple[float, ...]) -> DataFrame:
    """(source, weight): the weights in turn for the sources by code point, null last. One row per source."""
    sources = documents.select(F.col(f"`{source}`").alias("source")).distinct()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.array(*[F.lit(float(w)) for w in weights])
    return sources.select("source", F.get(given, (rank % len(weights)).cast("int")).alias("weight"))


def with_source(table: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    """The join on the source, where null meets null."""
    other = other.withColumnRenamed("source", "source_of")
    return table.join(other, F.col("source").eqNullSafe(F.col("source_of")), how).drop("source_of")


def targets(sizes: DataFrame, weights: DataFrame, share: float, cap: float) -> DataFrame:
    """(source, source_size, n, target): ``share`` of all words dealt by weight, none above ``cap`` times its source.

    Sources in order of cap * size / weight: those whose cap lies below their part of what earlier ones leave are full;
    the rest get the same number of words for each unit of weight.
    """
    known = with_source(sizes, weights).withColumn("full", cap * F.col("source_size"))
    before = Window.orderBy(F.try_divide("full", "weight").asc_nulls_last(), "source").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = known.withColumns(
        {
            "left": share * F.sum("source_size").over(whole) - F.coalesce(F.sum("full").over(before), F.lit(0.0)),
            "weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    )
    known = known.withColumn("unit", F.try_divide("left", "weights"))
    unit = F.max(F.when(F.col("full") >= F.col("unit") * F.col("weight"), F.col("unit"))).over(whole)
    return known.withColumn("unit", unit).select(
        "source",
        "source_size",
        "n",
        F.coalesce(F.least("full", F.col("unit") * F.col("weight")), F.col("full")).alias("target"),
    )


def rate(size: Column, cap: float) -> Column:
    """The tilted rate under the source's ``lambda``; full sources take the cap, empty ones rate 1."""
    odds = F.exp(F.least(F.greatest(F.col("lambda") * size / F.col("mean"), F.lit(-700.0)), F.lit(700.0))) / (cap - 1)
    tilted = cap * odds / (1 + odds)
    return F.when(F.col("mean") <= 0, F.lit(1.0)).when(F.col("target") >= cap * F.col("source_size"), F.lit(cap)).otherwise(tilted)


def exact_sum(column: Column) -> Column:
    """A sum that does not depend on the order of its rows, so that every run takes the same steps."""
    return F.sum(column.cast("decimal(28,8)")).cast("double")


def tilts(counts: DataFrame, aims: DataFrame, cap: float, tolerance: float, most: int) -> DataFrame:
    """(source, source_size, n, target, mean, lambda): Newton's iterations on the dual, one grouped sum each."""
    state = written(
        aims.withColumns(
            {
                "mean": F.col("source_size") / F.greatest(F.col("n"), F.lit(1)),
                "lambda": F.lit(0.0),
                "low": F.lit(-BOUND),
                "high": F.lit(BOUND),
                "error": F.lit(1.0),
            }
        ),
        "state",
    )
    for _ in range(most):
        words = F.col("rows") * F.col("size")
        r = rate(F.col("size"), cap)
        steps = (
            with_source(counts, state)
            .groupBy("source")
            .agg(
                exact_sum(words * r).alias("words"),
                exact_sum(words * F.try_divide("size", "mean") * r * (1 - r / cap)).alias("slope"),
            )
        )
        over = F.coalesce(F.col("words"), F.lit(0.0)) - F.col("target")
        low = F.when(over < 0, F.greatest("low", "lambda")).otherwise(F.col("low"))
        high = F.when(over > 0, F.least("high", "lambda")).otherwise(F.col("high"))
        newton = F.col("lambda") - over / F.when(F.col("slope") > 1e-9, F.col("slope"))
        # Outside the bracket, or where the slope is lost: half way towards the bound in powers, so that far bounds come near fast.
        towards = F.when(over > 0, low).otherwise(high)
        near = F.when(
            F.abs(towards) >= BOUND, F.col("lambda") + F.when(over > 0, -1.0).otherwise(1.0) * F.greatest(F.lit(1.0), F.abs("lambda"))
        ).otherwise((low + high) / 2)
        chosen = F.when((newton > low) & (newton < high), newton).otherwise(near)
        done = (F.col("target") >= cap * F.col("source_size")) | (F.col("source_size") <= 0)
        error = F.when(done, F.lit(0.0)).otherwise(F.abs(over) / F.greatest(F.col("target"), F.lit(1.0)))
        solved = error <= tolerance
        state = written(
            with_source(state, steps, "left").select(
                "source",
                "source_size",
                "n",
                "target",
                "mean",
                F.when(solved, F.col("lambda")).otherwise(chosen).alias("lambda"),
                low.alias("low"),
                high.alias("high"),
                error.alias("error"),
            ),
            "state",
        )
        left = state.agg(F.max("error")).first()[0] or 0.0
        if left <= tolerance:
            break
    else:
        raise RuntimeError(f"after {most} iterations a source is still {left:.2g} of its target away from it")
    return state.select("source", "source_size", "n", "target", "mean", F.round("lambda", 8).alias("lambda"))


def rounded(rates: DataFrame) -> DataFrame:
    """(k1, k2, copies and the rest of ``rates``) for rows (group, size, rate, rows, k1, k2, ...): whole numbers that keep
    each group's words on course. A row here stands for ``rows`` equal documents, which get the same number."""
    carried = [c for c in rates.columns if c not in ("group", "size", "k1", "k2")]
    item = F.struct((-F.col("size")).alias("order"), "k1", "k2", "size", *carried)
    grouped = rates.groupBy("group").agg(F.sort_array(F.collect_list(item)).alias("items"))
    start = F.struct(F.lit(0.0).alias("due"), F.array().cast("array<bigint>").alias("out"))

    def add(state, x):
        words = x["size"] * x["rows"]
        due = state["due"] + x["rate"] * words
        near = F.when(words > 0, F.round(due / words)).otherwise(F.round(x["rate"]))
        copies = F.least(F.greatest(near, F.floor(x["rate"])), F.ceil(x["rate"])).cast("bigint")
        return F.struct((due - copies * words).alias("due"), F.concat(state["out"], F.array(copies)).alias("out"))

    folded = F.aggregate("items", start, add, lambda state: state["out"])
    pairs = F.arrays_zip(F.col("items"), folded.alias("copies"))
    return grouped.select(F.explode(pairs).alias("x")).select("x.items.*", F.col("x.copies").alias("copies")).drop("order")


def mix(
    documents: DataFrame,
    weights: DataFrame | tuple[float, ...],
    share: float = 1.5,
    cap: float = 2.0,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: list[str] | None = None,
    group_rows: int = GROUP_ROWS,
    tolerance: float = 1e-7,
    most: int = 60,
) -> DataFrame:
    """The rows with ``size`` (words), ``source_size``, ``target`` (of the source), ``rate``, ``copies`` and ``taken``.

    ``weights`` is a table (source, weight) or weights to give in turn to the sources by code point, null last.
    """
    results = ["size", "source_size", "target", "rate", "copies", "taken"]
    passed = kept_columns(documents, results, keep)
    table, _ = guarded(documents)
    names = {c: guarded_name(documents, c) for c in passed}
    value = F.coalesce(F.col(guarded_name(documents, text)), F.lit(""))
    id, source = guarded_name(documents, id), guarded_name(documents, source)
    filled = table.withColumn("value", F.coalesce(F.col(guarded_name(documents, text)), F.lit("")))
    keyed = filled.withColumns(row_keys(id, "value", source))
    size = F.regexp_count("value", F.lit(f"[^{SPACE}]+")).cast("bigint")
    measured = keyed.select(F.col(source).alias("source"), size.alias("size"), "k1", "k2")
    measured = written(measured.groupBy("source", "size", "k1", "k2").agg(F.count(F.lit(1)).alias("rows")), "measured")
    counts = written(measured.groupBy("source", "size").agg(F.sum("rows").alias("rows")), "counts")
    sizes = counts.groupBy("source").agg(
        F.sum(F.col("rows") * F.col("size")).alias("source_size"), F.sum("rows").alias("n")
    )
    if isinstance(weights, tuple):
        weights = cycled_weights(counts, "source", weights)
    solved = tilts(counts, written(targets(sizes, weights, share, cap), "targets"), cap, tolerance, most)
    solved = written(solved, "tilts")
    groups = F.ceil(F.col("n") / group_rows)
    rated = with_source(measured, solved, "left").withColumns(
        {
            "rate": rate(F.col("size"), cap),
            "group": F.xxhash64("source", F.pmod(F.xxhash64("k1", F.lit(2)), groups), F.col("source").isNull()),
        }
    )
    decided = rounded(rated.select("group", "size", "rate", "rows", "k1", "k2", "source_size", "target"))
    final = keyed.select(*names.values(), "k1", "k2").join(written(decided, "decided"), ["k1", "k2"])
    return final.select(
        *[F.col(n).alias(c) for c, n in names.items()],
        "size",
        "source_size",
        "target",
        "rate",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(documents: DataFrame, weights: DataFrame | tuple[float, ...], **options) -> DataFrame:
    """The documents as often as the mix takes them, with the columns they came with."""
    table, back = guarded(documents)
    options = {"id": "doc_id", "text": "text", "source": "source"} | options
    for name in ("id", "text", "source"):
        options[name] = guarded_name(documents, options[name])
    found = mix(table, weights, **options)
    return back(found.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))))
