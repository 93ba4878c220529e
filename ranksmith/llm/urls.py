"""URL filters: rules on a host and a path, met through hashed expressions.

A URL is expanded into expressions, each a suffix of its host with as many labels as some rule's host and a prefix of its path
as long as some rule's path, so their number is bounded by the rules, however long the URL is. An expression meets the rules in an equality join on the first 32 bits of its SHA-256; the whole digest
then confirms it, and the longest rule decides.

Every distinct URL is judged once, so a repeated URL costs one judgement, and Spark splits its rows when the judgement
is joined back. DataFrame functions only.

Defined cases: null or without ``://``: empty host and path, no rule. A URL repeated in many rows gives each
row the same verdict. URLs, hosts and paths of any length are read whole. No rules, or an empty table: default verdicts, or an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ranksmith.llm.common import kept_columns

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ACTIONS = ("allow", "block")


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://``: up to ``/ ? #``, and from there up to ``? #``."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def label_count(host: Column) -> Column:
    """The number of parts that dots make of a host."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def counts_of(numbers: Column, table: DataFrame) -> Column:
    """The different numbers, in order, as an array."""
    found = sorted(r[0] for r in table.select(numbers).distinct().collect())
    return F.array(*[F.lit(n) for n in found]).cast("array<int>")


def digested(host: Column, path: Column) -> Column:
    """SHA-256 of an expression; a zero byte keeps host and path apart."""
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge_urls(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", keep: list[str] | None = None
) -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` (host and path joined, or null) and ``verdict``.

    ``rules`` has ``host``, ``path`` and ``action`` (allow or block). A rule fits its host and all hosts below, where
    the path starts with the rule's. Of several the longest counts, then the one with the longer host, then block.
    """
    distinct = pages.select(F.col(f"`{url}`").alias("_url")).distinct()
    host, path = host_and_path(F.col("_url"))
    parsed = distinct.select("_url", host.alias("_host"), path.alias("_path"))

    known = rules.select(
        lower_ascii(F.coalesce("host", F.lit(""))).alias("_rule_host"),
        F.coalesce("path", F.lit("")).alias("_rule_path"),
        F.col("action").alias("_action"),
    ).where(F.col("_action").isin(*ACTIONS))
    known = known.withColumn("_digest", digested(F.col("_rule_host"), F.col("_rule_path")))
    known = known.groupBy("_rule_host", "_rule_path", "_digest").agg(F.max("_action").alias("_action"))
    known = known.withColumn("_prefix", F.substring("_digest", 1, 8))

    # At most as many numbers as the longest rule path has characters, and the longest rule host labels.
    lengths, labels = counts_of(F.length("_rule_path"), known), counts_of(label_count(F.col("_rule_host")), known)
    expressions = (
        parsed.where(F.col("_host") != "")
        .withColumn("_labels", F.explode(F.filter(labels, lambda n: n <= label_count(F.col("_host")))))
        .withColumn("_suffix", F.expr("substring_index(_host, '.', -_labels)"))
        .withColumn("_length", F.explode(F.filter(lengths, lambda n: n <= F.length("_path"))))
        .select("_url", digested(F.col("_suffix"), F.expr("substring(_path, 1, _length)")).alias("_found"))
        .withColumn("_prefix", F.substring("_found", 1, 8))
    )
    met = expressions.join(known, "_prefix").where(F.col("_found") == F.col("_digest"))
    best = met.groupBy("_url").agg(
        F.max(
            F.struct(
                (F.length("_rule_host") + F.length("_rule_path")).alias("size"),
                F.length("_rule_host").alias("host_size"),
                F.col("_action").alias("action"),
                F.concat("_rule_host", "_rule_path").alias("rule"),
            )
        ).alias("_best")
    )
    passed = kept_columns(pages, ["host", "path", "rule", "verdict"], keep)
    host, path = host_and_path(F.col(f"p.`{url}`"))
    return (
        pages.alias("p")
        .join(best.alias("b"), F.col(f"p.`{url}`") == F.col("b._url"), "left")
        .select(
            *[F.col(f"p.`{c}`") for c in passed],
            host.alias("host"),
            path.alias("path"),
            F.col("b._best.rule").alias("rule"),
            F.coalesce("b._best.action", F.lit(default)).alias("verdict"),
        )
    )
