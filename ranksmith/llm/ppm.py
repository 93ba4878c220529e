"""Prediction by partial matching: code lengths of texts under a byte-context trie of the training documents.

The trie is a set of tables, one for each context length up to ``order``: a node is a context, packed into a number, with the
total of its followers, how many differ, and the followers' total one context shorter. They are grouped sums of the
counts of (context, byte), so the model is as large as the corpus makes it and stands on no one machine.

The probability of a byte is found at the longest context of the trie that precedes it. A byte not seen there costs an
escape (its probability is the number of different followers over that number plus their total), and the next shorter
context is asked without the followers already ruled out (exclusion). Below the empty context all 256 symbols are
equally likely: the bytes of UTF-8, of which 0xFF never occurs and stands for the end of a text, and before its start.

Scoring: documents are dealt into groups of about ``group_bytes``, equal ones spread like any others. A task lists what
its group needs, each word and each context with its byte once; Spark joins these lists with the model; the group's documents
meet the answers in one task, which adds them up. No list is longer than the group's own text, and a task holds the list
and a megabyte of text, or one longer text.

Defined cases: texts of any length are read whole; a null or empty text has the end as its one token; equal rows score alike; without training documents
every byte is equally likely and no token is known; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ranksmith.llm.common import Copies, guarded, guarded_name, kept_columns, raw, slices
from ranksmith.storage import scratch_path, written

ORDER = 4
GROUP_BYTES = 16 << 20
LEAST_BYTES = 2 << 20
PIECE_BYTES = 1 << 20
# A task adds up its lists of grams when so many are pending.
PENDING_GRAMS = 1 << 20
END = b"\xff"
WORD, GRAM, DOCUMENT = 0, 1, 2


def word_key(word: bytes) -> int:
    """A signed 64-bit number for a word."""
    value = xxhash.xxh3_64_intdigest(word)
    return value - (1 << 64) if value >> 63 else value


class Vocabulary:
    """The words of a group as numbers, with their keys."""

    def __init__(self):
        self.number: dict[bytes, int] = {END: 0}
        self.keys: list[int] = [word_key(END)]

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' words and ends as numbers, and the texts' numbers of tokens."""
        lines = [t.lower().split() for t in texts]
        number = self.number
        for word in {w for line in lines for w in line if w not in number}:
            number[word] = len(number)
            self.keys.append(word_key(word))
        counts = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
        out = np.zeros(int(counts.sum()), np.int64)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(counts) - 1] = False
        get = number.__getitem__
        out[inner] = np.fromiter((get(w) for line in lines for w in line), np.int64, len(out) - len(lines))
        return out, counts


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For every byte and the end of each text: it and the ``order`` symbols before, packed; and how many each text has."""
    gap = END * order
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    packed = np.zeros(len(data) - order, np.uint64)
    for k in range(order + 1):
        packed <<= np.uint64(8)
        packed |= data[k : k + len(packed)]
    # Of the symbols between two texts only the first is scored.
    scored = np.ones(len(packed), bool)
    ends = np.cumsum(sizes + order) - order
    for k in range(1, order):
        scored[(ends + k)[ends + k < len(packed)]] = False
    return packed[scored].view(np.int64), sizes + 1


class Counts:
    """Distinct keys with the sums of their counts, in order. New ones wait and are merged when there are many."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray):
        self.waiting.append((keys, counts))
        if sum(len(k) for k, _ in self.waiting) >= max(PENDING_GRAMS, len(self.keys)):
            self.merge()

    def merge(self):
        if not self.waiting:
            return
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting = []
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
        self.keys, self.counts = keys[first], np.add.reduceat(counts, first) if len(first) else counts


def needs(grouped: DataFrame, text: str, order: int) -> DataFrame:
    """Rows (group, kind, key, count): what each group needs, once, with how often its training documents have it."""

    def run(batches):
        group, words, symbols = None, Vocabulary(), Counts()
        totals = np.zeros(0, np.int64)
        for piece in slices(batches, text, PIECE_BYTES):
            group = piece.column("_group")[0].as_py()
            texts, trains = raw(piece.column(text)), piece.column("_trains").to_numpy(zero_copy_only=False)
            index, sizes = words(texts)
            new = np.bincount(index[np.repeat(trains, sizes)], minlength=len(words.keys))
            new[: len(totals)] += totals
            totals = new
            packed, sizes = grams(texts, order)
            of_training = np.repeat(trains, sizes)
            for mask, weight in ((of_training, 1), (~of_training, 0)):
                found, n = np.unique(packed[mask], return_counts=True)
                symbols.add(found, n * weight)
        if group is None:
            return
        symbols.merge()
        for kind, k, c in ((WORD, np.array(words.keys, np.int64), totals), (GRAM, symbols.keys, symbols.counts)):
            for a in range(0, len(k), 1 << 18):
                part = k[a : a + (1 << 18)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(part), group, np.int32)),
                        pa.array(np.full(len(part), kind, np.int8)),
                        pa.array(part),
                        pa.array(c[a : a + len(part)]),
                    ],
                    names=["group", "kind", "key", "count"],
                )

    return grouped.select("_group", "_trains", text).mapInArrow(run, "group int, kind tinyint, key bigint, count bigint")


def low_bytes(column: str, n: int) -> Column:
    return F.col(column).bitwiseAND(F.lit((1 << 8 * n) - 1))


def bounded(table: DataFrame, key_bytes: int) -> DataFrame:
    """Broadcast tables keyed by at most two bytes: they have at most 65,536 rows."""
    return F.broadcast(table) if key_bytes <= 2 else table


def log_probabilities(seen: DataFrame, order: int) -> DataFrame:
    """(key, value): the log10 probability of the last byte of every context-with-byte in ``seen`` (key, count)."""
    copies = Copies(seen.sparkSession)
    seen = copies(seen, "grams")
    followers = {order: seen.where("count > 0").select(F.col("key").alias(f"k{order}"), F.col("count").alias(f"n{order}"))}
    for k in range(order - 1, -1, -1):
        shorter = followers[k + 1].groupBy(low_bytes(f"k{k + 1}", k + 1).alias(f"k{k}"))
        followers[k] = copies(shorter.agg(F.sum(f"n{k + 1}").alias(f"n{k}")), "followers")
    asked = seen.select("key")
    for k in range(order, -1, -1):
        own = followers[k].withColumn(f"c{k}", F.shiftright(f"k{k}", 8))
        below = F.lit(0)
        if k:
            own = own.withColumn(f"k{k - 1}", low_bytes(f"k{k}", k)).join(bounded(followers[k - 1], k), f"k{k - 1}")
            below = F.sum(f"n{k - 1}")
        node = own.groupBy(f"c{k}").agg(
            F.sum(f"n{k}").alias(f"total{k}"), F.count(F.lit(1)).alias(f"differ{k}"), below.alias(f"below{k}")
        )
        asked = asked.withColumn(f"c{k}", F.shiftright(low_bytes("key", k + 1), 8))
        asked = asked.join(bounded(copies(node, "nodes"), k), f"c{k}", "left").drop(f"c{k}")
        asked = asked.withColumn(f"k{k}", low_bytes("key", k + 1))
        asked = asked.join(bounded(followers[k], k + 1), f"k{k}", "left").drop(f"k{k}")
    value, open_, ruled_total, ruled_differ = F.lit(0.0), F.lit(True), F.lit(0), F.lit(0)
    for k in range(order, -1, -1):
        known = F.col(f"total{k}").isNotNull()
        total = F.col(f"total{k}") - ruled_total
        differ = F.col(f"differ{k}") - ruled_differ
        found = F.col(f"n{k}").isNotNull()
        step = (
            F.when(~open_ | ~known, 0.0)
            .when(found, F.log10(F.col(f"n{k}") / (total + differ)))
            .when(differ > 0, F.log10(differ / (total + differ)))
            .otherwise(0.0)
        )
        asked = asked.withColumns(
            {f"value{k}": value + step, f"open{k}": open_ & ~found, f"rt{k}": F.coalesce(f"below{k}", F.lit(0)), f"rd{k}": F.coalesce(f"differ{k}", F.lit(0))}
        )
        value, open_, ruled_total, ruled_differ = (F.col(f"{c}{k}") for c in ("value", "open", "rt", "rd"))
    least = F.when(open_, -F.log10(F.lit(256) - ruled_differ)).otherwise(0.0)
    found = written(asked.select("key", (value + least).alias("value")), "model")
    copies.drop(*[copy for copy, _ in list(copies.paths.values())])
    return found


class Lookup:
    """Places of 64-bit keys, by hashing into a table with room to spare."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.table = np.full(1 << self.bits, -1, np.int32)
        slot, left = self.slots(keys), np.arange(len(keys), dtype=np.int32)
        while len(left):
            free = self.table[slot] < 0
            self.table[slot[free]] = left[free]
            lost = self.table[slot] != left
            slot, left = (slot[lost] + 1) & (len(self.table) - 1), left[lost]

    def slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; all must be there."""
        slot = self.slots(keys)
        found = self.table[slot]
        left = np.flatnonzero(self.keys[found] != keys)
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.table) - 1)
            found[left] = self.table[slot[left]]
            left = left[self.keys[found[left]] != keys[left]]
        return found


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs; no run is empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, values.dtype)


def score_documents(
    documents: DataFrame,
    trains: Column,
    text: str = "text",
    order: int = ORDER,
    smoothing: float = 0.1,
    group_bytes: int = GROUP_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (word frequencies, smoothed) and ``score`` (the
    text's log10 probability under the trie, end included; divided by log10(2) it is minus the code length in bits).

    ``trains`` says of each row whether the models learn from it. ``order`` is at most 6.
    """
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    passed = kept_columns(documents, results, keep)
    marked = documents.withColumn("_rs_trains", F.coalesce(trains, F.lit(False)))
    table, _ = guarded(marked)
    value = guarded_name(marked, text)
    names = {c: guarded_name(marked, c) for c in passed}
    spark = documents.sparkSession
    total = table.agg(F.sum(F.octet_length(value))).first()[0] or 0
    n_groups = max(1, -(-total // group_bytes), min(spark.sparkContext.defaultParallelism, -(-total // LEAST_BYTES)))
    columns = list(names.values())
    carried = list(dict.fromkeys([*columns, value]))
    # Written once, as the number of a row, which spreads equal rows over the groups, may differ in a second run.
    number = F.xxhash64(F.monotonically_increasing_id())
    grouped = table.select(
        *carried,
        F.pmod(number, F.lit(n_groups)).cast("int").alias("_group"),
        F.col(guarded_name(marked, "_rs_trains")).alias("_trains"),
    )
    path = scratch_path(spark, "dealt")
    grouped.write.option("compression", "zstd").parquet(path)
    grouped = spark.read.schema(grouped.schema).parquet(path)
    lists = written(needs(grouped.repartitionById(n_groups, "_group"), value, order), "needs")

    # A group has a word once, so no word has more rows here than there are groups.
    of_word = Window.partitionBy("key")
    words = lists.where(F.col("kind") == WORD).withColumns(
        {"total": F.sum("count").over(of_word), "first": F.min("group").over(of_word) == F.col("group")}
    )
    words = written(words.select("group", "kind", "key", "total", "first"), "words")
    tokens, differ = words.where("first and total > 0").agg(F.sum("total"), F.count(F.lit(1))).first()
    tokens = tokens or 0

    needed = lists.where(F.col("kind") == GRAM)
    seen = needed.groupBy("key").agg(F.sum("count").alias("count"))
    answers = words.select("group", "kind", "key", F.col("total").cast("double").alias("value")).union(
        needed.select("group", "kind", "key").join(log_probabilities(seen, order), "key").select("group", "kind", "key", "value")
    )
    rows = grouped.select(
        F.col("_group").alias("group"), F.lit(DOCUMENT).cast("tinyint").alias("kind"), F.lit(None).cast("bigint").alias("key"), F.lit(None).cast("double").alias("value"), *carried
    ).unionByName(answers, allowMissingColumns=True)
    schema = T.StructType([table.schema[c] for c in columns])
    for name in results:
        schema = schema.add(name, T.DoubleType() if name.endswith("score") else T.LongType())
    floor = smoothing * (differ + 1) + tokens

    def run(batches):
        parts = {WORD: ([], []), GRAM: ([], [])}
        words, ready = Vocabulary(), None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for kind in (WORD, GRAM):
                mine = np.flatnonzero(kinds == kind)
                if len(mine):
                    a, b = int(mine[0]), int(mine[-1]) + 1
                    parts[kind][0].append(batch.column("key")[a:b].to_numpy(zero_copy_only=False).astype(np.int64))
                    parts[kind][1].append(batch.column("value")[a:b].to_numpy(zero_copy_only=False).astype(np.float64))
            mine = np.flatnonzero(kinds == DOCUMENT)
            if not len(mine):
                continue
            if ready is None:
                keys, counts = (np.concatenate(x) for x in parts[WORD])
                place = np.argsort(keys)
                keys, counts = keys[place], counts[place]
                ready = Lookup(np.concatenate(parts[GRAM][0])), np.concatenate(parts[GRAM][1])
                parts.clear()
                parts.update({WORD: ([], []), GRAM: ([], [])})
            for piece in slices([batch.slice(int(mine[0]), len(mine))], value, PIECE_BYTES):
                texts = raw(piece.column(value))
                index, n_tokens = words(texts)
                count = counts[np.searchsorted(keys, np.array(words.keys, np.int64).clip(None, keys[-1]))][index]
                packed, n_symbols = grams(texts, order)
                of_symbols = ready[1][ready[0](packed)]
                arrays = [
                    n_tokens,
                    summed((count > 0).astype(np.int64), n_tokens),
                    np.full(len(texts), tokens),
                    summed(np.log10((count + smoothing) / floor), n_tokens),
                    summed(of_symbols, n_symbols),
                ]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c) for c in columns] + [pa.array(a) for a in arrays], names=schema.names
                )

    met = rows.repartitionById(n_groups, "group").sortWithinPartitions("kind")
    scored = met.mapInArrow(run, schema)
    return scored.toDF(*names, *results)
