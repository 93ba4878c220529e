"""Importance resampling towards a target: hashed n-gram gains, exponential noise, the best share without replacement.

1. A task joins the texts of a batch with a separator that no word can hold. One pass of a regular expression finds all words;
   the documents' offsets, searched with ``searchsorted`` for the words' places, say which document each is of, and n-grams
   whose first and last word are of different documents are masked. ``bincount`` of the hashed rest counts the batch.
2. Spark adds up the buckets' counts of the documents and of the target. A bucket's gain is the rounded logarithm of its smoothed
   share in the target over that in the documents. There are as many gains as buckets, whatever the corpus.
3. The same pass over each batch adds up the gains of every document's features. Gumbel noise, drawn from a hash of the id, makes
   the highest scores a sample without replacement.
4. Documents are dealt by ranges of the score and sorted there; with the ranges' sizes every document knows its rank.

Defined cases: a null or empty text has no words; a null id is hashed as empty and comes last among equal scores; documents with
equal score and id are ranked in the order of the hash of their texts, equal rows next to each other; texts of any length are
read whole; without target texts the gains come from the smoothing alone; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ranksmith.llm.common import guarded, guarded_name, kept_columns, raw, slices
from ranksmith.storage import written

BUCKETS = 10_000
SEED = 2024
BATCH_BYTES = 1 << 20
SEPARATOR = b"\x00"
# Of lower-cased UTF-8: digits, small letters, and all bytes of letters beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
OF_WORDS = bytes(WORD.match(bytes([b])) is not None for b in range(256))
CHUNK_WORDS = 1 << 17


def words_in(texts: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The document and the CRC of every word of the joined texts, and the words themselves where n-grams need them."""
    joined = SEPARATOR.join(texts).lower()
    inside = np.frombuffer(SEPARATOR + joined.translate(OF_WORDS), np.uint8)
    starts = np.flatnonzero(inside[1:] > inside[:-1])
    code, words = np.zeros(len(starts), np.int64), []
    for a in range(0, len(starts), CHUNK_WORDS):
        n = min(CHUNK_WORDS, len(starts) - a)
        end = int(starts[a + n]) if a + n < len(starts) else len(joined)
        found = WORD.findall(joined, int(starts[a]), end)
        code[a : a + n] = np.fromiter(map(crc32, found), np.int64, n)
        if longest > 1:
            words += found
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return np.searchsorted(offsets, starts, side="right") - 1, code, words


def features(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's number of words, and for all runs of 1 to ``longest`` words the document and the bucket."""
    document, code, words = words_in(texts, longest)
    documents, places, run = [document], [code % buckets], code.tolist() if longest > 1 else []
    for n in range(2, longest + 1):
        if len(words) < n:
            break
        run = [crc32(b" " + w, c) for c, w in zip(run, words[n - 1 :])]
        inside = document[: len(run)] == document[n - 1 :]
        documents.append(document[: len(run)][inside])
        places.append(np.array(run, np.int64)[inside] % buckets)
    return np.bincount(document, minlength=len(texts)), np.concatenate(documents), np.concatenate(places)


def bucket_counts(table: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket. The driver gets one number for each bucket."""

    def run(batches):
        counts = np.zeros(buckets, np.int64)
        for piece in slices(batches, text, BATCH_BYTES):
            _, _, places = features(raw(piece.column(text)), longest, buckets)
            counts += np.bincount(places, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    found = table.select(text).mapInArrow(run, "bucket bigint, n bigint")
    total = np.zeros(buckets, np.int64)
    for bucket, n in found.groupBy("bucket").agg(F.sum("n")).collect():
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the buckets' smoothed shares in the target over those in the source, rounded down."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    ratio = ((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)) for a, b in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def weigh(table: DataFrame, text: str, columns: list[str], gain: np.ndarray, longest: int) -> DataFrame:
    """``columns`` with ``_words``, ``_features`` and ``_weight`` of each text."""
    shared = table.sparkSession.sparkContext.broadcast(gain)
    results = ["_words", "_features", "_weight"]
    schema = T.StructType([table.schema[c] for c in columns] + [T.StructField(c, T.LongType()) for c in results])

    def run(batches):
        for piece in slices(batches, text, BATCH_BYTES):
            texts = raw(piece.column(text))
            words, documents, places = features(texts, longest, len(shared.value))
            # Gains are far below 2**53, so their sums in doubles are exact.
            weight = np.bincount(documents, shared.value[places], minlength=len(texts)).astype(np.int64)
            counts = np.bincount(documents, minlength=len(texts))
            arrays = [pa.array(x.astype(np.int64)) for x in (words, counts, weight)]
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in columns] + arrays, names=schema.names)

    return table.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)


def noise(id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable, from the first 32 bits of a hash of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    drawn = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with ``_rank`` from 1 on; what the driver gathers is one number for each partition."""
    placed = scored.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("_place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_place", 33).cast("int")
    sizes = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    before, rows = 0, []
    for row in sorted(sizes):
        rows.append((row["part"], before))
        before += row["n"]
    offsets = scored.sparkSession.createDataFrame(rows, "_part int, _before bigint")
    met = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")  # one row for each partition
    here = F.col("_place") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return met.withColumn("_rank", F.col("_before") + here + 1).drop("_part", "_before", "_place")


def resample(
    documents: DataFrame,
    target: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    least_words: int = 20,
    percent: int = 10,
    seed: int = SEED,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows with ``n_features``, ``weight``, ``score`` (weight and noise) and ``rank``: 1, 2, 3 and so on for the drawn, else null.

    Features are the runs of 1 to ``longest`` words. Of the documents with ``least_words`` words or more, ``percent`` in a hundred
    are drawn, the highest scores first, ties to the smaller id.
    """
    results = ["n_features", "weight", "score", "rank"]
    passed = kept_columns(documents, results, keep)
    table, _ = guarded(documents)
    names = {c: guarded_name(documents, c) for c in passed}
    own, value = guarded_name(documents, id), guarded_name(documents, text)
    gain = gains(
        bucket_counts(table, value, longest, buckets),
        bucket_counts(target.select(F.col(f"`{target_text}`").alias("_text")), "_text", longest, buckets),
    )
    keyed = table.withColumn("_tie", F.xxhash64(F.coalesce(value, F.lit(""))))
    weighed = weigh(keyed, value, list(dict.fromkeys([*names.values(), own, "_tie"])), gain, longest)
    scored = written(weighed.withColumn("_score", F.col("_weight") + noise(F.col(own), seed)), "scored")
    enough = F.col("_words") >= least_words
    chosen = scored.where(enough)
    drawn = chosen.count() * percent // 100
    order = [F.col("_score").desc(), F.col(own).asc_nulls_last(), F.col("_tie").asc()]
    rank = F.when(F.col("_rank") <= drawn, F.col("_rank"))
    all_rows = ranked(chosen, order).withColumn("_rank", rank).unionByName(
        scored.where(~enough).withColumn("_rank", F.lit(None).cast("bigint"))
    )
    return all_rows.select(*names.values(), "_features", "_weight", "_score", "_rank").toDF(*names, *results)


def resampled_documents(documents: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with the columns they came with."""
    table, back = guarded(documents)
    for option, default in (("id", "doc_id"), ("text", "text")):
        options[option] = guarded_name(documents, options.get(option, default))
    return back(resample(table, target, **options).where(F.col("rank").isNotNull()))
