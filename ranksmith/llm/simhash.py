"""SimHash near-duplicates: fingerprints, bit-sliced comparison, connected groups.

1. Each text gets a 64-bit fingerprint: a bit is 1 if it is set in over half the hashes of its word shingles. Equal
   fingerprints are merged by a grouped minimum before anything else, so copies cost nothing further.
2. Fingerprints within ``radius`` bits agree in at least ``blocks - radius`` of ``blocks`` parts. Each fingerprint goes to one
   bucket for every choice of that many parts. Buckets above ``bucket_rows`` are cut into blocks, and every two
   blocks meet in a unit of their own, so no task holds a large bucket whole.
3. A task keeps the fingerprints of its units as bit planes: one 64-bit word holds one bit of 64 fingerprints. The
   distances of a fingerprint to 64 others are counted at once by carry-save adders on such words, started so that
   the topmost carry means "beyond the radius". Words in which every lane has carried are abandoned.
4. Within a unit links are reduced to a forest; the forests' edges make the groups (``components.py``).

Defined cases: texts without words have fingerprint 0 and are linked like any other; texts of any length are read whole;
repeated rows share a group;
a null id is the largest of its group; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ranksmith.llm.common import guarded, guarded_name, kept_columns, raw, row_keys, with_results
from ranksmith.llm.components import connected
from ranksmith.storage import written

SEED = 42
BITS = 64
BUCKET_ROWS = 4096
# What comparing two fingerprints costs, as a share of sending one of them to a bucket.
PAIR_COST = 0.003
CHUNK_ROWS = 1 << 17
PAIR_WORDS = 1 << 16


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(shingle, len(words))
    hashed = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    set_bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int.from_bytes(set_bits.tobytes(), "little")


def fingerprints(documents: DataFrame, text: str, shingle: int, keep: list[str] | None = None) -> DataFrame:
    """The rows with ``_rs_fp``, the fingerprint as a signed long."""

    def results(column: pa.Array) -> list[pa.Array]:
        values = [fingerprint(x, shingle) for x in raw(column)]
        return [pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())]

    return with_results(documents, results, "_rs_fp bigint", text, keep)


def fitting_blocks(n: int, radius: int) -> int:
    """The number of parts that makes copies and comparisons of ``n`` fingerprints cheapest; every number finds the same links.

    More parts make smaller buckets (each on all but ``radius`` of them) and more copies of each fingerprint.
    """

    def cost(blocks: int) -> float:
        bucket = n / 2 ** (BITS * (blocks - radius) / blocks)
        return comb(blocks, radius) * (1 + PAIR_COST * bucket)

    return min(range(radius + 1, min(BITS, radius + 8) + 1), key=cost)


def parts(blocks: int) -> list[tuple[int, int]]:
    """``blocks`` neighbouring ranges of bits, as equal as can be."""
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    return list(zip(cuts, cuts[1:]))


def buckets(fp: Column, blocks: int, radius: int) -> Column:
    """An array of bucket numbers, one for each choice of parts that must agree."""
    masks = [sum(1 << b for b in range(low, high)) for low, high in parts(blocks)]
    chosen = []
    for k, choice in enumerate(combinations(masks, blocks - radius)):
        mask = sum(choice)
        chosen.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))))
    return F.array(*chosen)


def units(distinct: DataFrame, blocks: int, radius: int, bucket_rows: int) -> DataFrame:
    """Rows (unit, fp): all fingerprints of a unit are compared with each other."""
    rows = distinct.select("_rs_fp", F.explode(buckets(F.col("_rs_fp"), blocks, radius)).alias("_bucket"))
    counted = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    large = written(counted.where(F.col("_size") > bucket_rows), "buckets")
    n = F.ceil(F.col("_size") / bucket_rows).cast("int")
    own = F.pmod(F.xxhash64("_rs_fp", F.lit(1)), n).cast("int")
    others = F.filter(F.sequence(F.lit(0), n - 1), lambda k: k != own)
    named = F.transform(others, lambda k: F.xxhash64("_bucket", F.least(own, k), F.greatest(own, k)))
    unit = F.when(F.col("_size").isNull(), F.array("_bucket")).otherwise(named)
    return rows.join(large, "_bucket", "left").select(F.explode(unit).alias("_unit"), "_rs_fp")


def planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row b, word w, lane l holds bit b of fingerprint 64 w + l."""
    padded = np.zeros(-(-len(fps) // 64) * 64, "<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def lanes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Words with the bits from low to high - 1 set; both from 0 to 64."""
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    up_to = lambda n: np.where(n > 0, every >> (64 - np.maximum(n, 1)).astype(np.uint64), np.uint64(0))
    return up_to(high) & ~up_to(low)


def near_lanes(table: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray, alive: np.ndarray, radius: int):
    """For each query and word: the lanes of ``alive`` whose distance to the query is at most ``radius``."""
    width = max(1, int(radius + 1).bit_length())
    start = (1 << width) - (radius + 1)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    index = np.arange(len(query))
    out = np.zeros(len(query), np.uint64)
    value = fps[query]
    count = [np.full(len(query), every if start >> k & 1 else 0, np.uint64) for k in range(width)]
    for b in range(0, BITS, 2):
        x = table[b][word] ^ (np.uint64(0) - (value >> np.uint64(b) & np.uint64(1)))
        y = table[b + 1][word] ^ (np.uint64(0) - (value >> np.uint64(b + 1) & np.uint64(1)))
        # Two planes enter the lowest counter bit through a full adder; its carry ripples up.
        both = count[0] ^ x
        carry = (count[0] & x) | (y & both)
        count[0] = both ^ y
        for k in range(1, width):
            carry, count[k] = count[k] & carry, count[k] ^ carry
        alive = alive & ~carry
        if b % 8 == 6 and b < BITS - 2:
            left = np.flatnonzero(alive)
            if len(left) < 0.7 * len(alive):
                index, word, value, alive = index[left], word[left], value[left], alive[left]
                count = [c[left] for c in count]
                if not len(left):
                    return out
    out[index] = alive
    return out


def roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` (each position's smallest known member) after the links a-b are added."""
    while len(a):
        ra, rb = parent[a], parent[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(parent, higher := parent[parent]):
            parent = higher
    return parent


def forest(unit: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all fingerprints within the radius in the same unit; rows are sorted by unit."""
    first = np.flatnonzero(np.diff(unit, prepend=unit[:1] - 1))
    sizes = np.diff(np.append(first, len(unit)))
    several = np.repeat(sizes > 1, sizes)
    fps, sizes = fps[several], sizes[sizes > 1]
    if not len(fps):
        return fps, fps
    table = planes(fps)
    end = np.repeat(np.cumsum(sizes), sizes)
    row = np.arange(len(fps))
    words = (end - 1) // 64 - (row + 1) // 64 + 1
    words[row + 1 >= end] = 0
    parent = row.copy()
    cuts = np.searchsorted(np.cumsum(words), np.arange(PAIR_WORDS, words.sum() + PAIR_WORDS, PAIR_WORDS))
    for low, high in zip(np.concatenate(([0], cuts)), np.append(cuts, len(fps))):
        n = words[low:high]
        total = int(n.sum())
        if not total:
            continue
        query = np.repeat(row[low:high], n)
        word = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + (query + 1) // 64
        alive = lanes(np.maximum(query + 1 - 64 * word, 0), np.minimum(end[query] - 64 * word, 64))
        hit = near_lanes(table, fps, query, word, alive, radius)
        found = np.flatnonzero(hit)
        bits = np.unpackbits(hit[found].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(bits)
        parent = roots(parent, query[found][at], 64 * word[found][at] + lane)
    linked = np.flatnonzero(parent != row)
    return fps[linked], fps[parent[linked]]


def links(rows: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between fingerprints within the radius, enough to connect every unit's groups."""

    def run(batches):
        unit, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(unit, fps):
            a, b = forest(unit, fps, radius)
            return pa.RecordBatch.from_arrays(
                [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]
            )

        for batch in batches:
            unit = np.concatenate((unit, batch.column("_unit").to_numpy()))
            fps = np.concatenate((fps, batch.column("_rs_fp").to_numpy().view(np.uint64)))
            if len(unit) >= CHUNK_ROWS:
                last = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on in the next batch
                if last:
                    yield edges(unit[:last], fps[:last])
                    unit, fps = unit[last:], fps[last:]
        if len(unit):
            yield edges(unit, fps)

    placed = rows.repartition("_unit").sortWithinPartitions("_unit", "_rs_fp")
    return placed.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    radius: int = 4,
    blocks: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows with ``fingerprint`` (16 hex digits), ``component_id`` (the smallest id reachable through fingerprints
    within ``radius`` bits) and ``is_first`` (one row of each group).

    By default the number of ``blocks`` follows that of the different fingerprints: with 5 and a radius of 4 there are 5 copies of
    each in buckets on 12 bits, with 6 there are 15 on 21 bits, with 8 there are 70 on 32 bits.
    """
    passed = kept_columns(documents, ["fingerprint", "component_id", "is_first"], keep)
    table, _ = guarded(documents)
    own, value = guarded_name(documents, id), guarded_name(documents, text)
    names = {c: guarded_name(documents, c) for c in passed}
    signed = fingerprints(table, value, shingle, list(dict.fromkeys([*names.values(), own])))
    signed = written(signed.withColumn("_rs_row", F.monotonically_increasing_id()), "signed")
    of = first_of_groups(signed, own, radius, blocks, bucket_rows)
    return signed.join(of, signed["_rs_fp"] == of["_rs_of"]).select(
        *[F.col(n).alias(c) for c, n in names.items()],
        F.lower(F.lpad(F.hex("_rs_fp"), 16, "0")).alias("fingerprint"),
        F.col("_rs_first.id").alias("component_id"),
        (F.col("_rs_first.row") == F.col("_rs_row")).alias("is_first"),
    )


def first_of_groups(signed: DataFrame, id: str, radius: int, blocks: int | None, bucket_rows: int) -> DataFrame:
    """(_rs_of, _rs_first): each fingerprint with its group's smallest row, ids first, null ids last."""
    first = F.struct(F.col(f"`{id}`").isNull().alias("none"), F.col(f"`{id}`").alias("id"), F.col("_rs_row").alias("row"))
    distinct = written(signed.groupBy("_rs_fp").agg(F.min(first).alias("_rs_first")), "distinct")
    blocks = blocks or fitting_blocks(distinct.count(), radius)
    edges = links(units(distinct.select("_rs_fp"), blocks, radius, bucket_rows), radius)
    groups = connected(edges)
    members = groups.join(distinct, groups["node"] == distinct["_rs_fp"])
    least = written(members.groupBy("root").agg(F.min("_rs_first").alias("_rs_least")), "least")
    linked = written(groups.join(least, "root").select("node", "_rs_least"), "linked")
    of = distinct.join(linked, distinct["_rs_fp"] == linked["node"], "left")
    return written(
        of.select(F.col("_rs_fp").alias("_rs_of"), F.coalesce("_rs_least", "_rs_first").alias("_rs_first")), "groups"
    )


def one_of_each(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    radius: int = 4,
    blocks: int | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One document of each group, the one with the smallest id, with the columns it came with.

    Of rows that agree in id and text one stays. Only keys and fingerprints are written; the texts meet them once.
    """
    table, back = guarded(documents)
    own, value = guarded_name(documents, id), guarded_name(documents, text)
    keyed = table.withColumns(row_keys(own, value))
    signed = fingerprints(keyed.select(own, value, "k1", "k2"), value, shingle, [own, "k1", "k2"])
    signed = written(signed.withColumn("_rs_row", F.struct("k1", "k2")).drop("k1", "k2"), "signed")
    of = first_of_groups(signed, own, radius, blocks, bucket_rows)
    kept = written(of.select("_rs_first.row.*").distinct(), "kept")
    return back(keyed.join(kept, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]))
