"""Repeated byte strings, found by refining buckets of sampled suffixes and removed wherever they stand.

A string of ``length`` bytes that occurs twice is removed at every place. Sorting all suffixes would move many times
the text; the buckets here hold only suffixes at sampled places, chosen by the text itself: of the q-grams in every
window of ``length`` bytes the one with the smallest hash is the window's anchor. Equal windows have equal anchors at equal
offsets, so every window is settled at its own anchor, and a text has about one anchor in 140 bytes.

Bucket-pointer refinement, each round on the survivors of the one before, every bucket known by an identifier:

1. Anchors are put into buckets by their q-gram. An anchor alone in its bucket is settled: nothing repeats there.
2. Each bucket is refined by the identifier of all bytes that the anchor's windows reach (before and after it). Two
   anchors in one such bucket settle all their windows at once: they repeat.
3. The rest is refined piece by piece: the windows of an anchor are cut into cells of 16 neighbouring starts, in buckets by the
   core that all windows of a cell share. Cells alone in their bucket are settled. One anchor of each bucket of
   step 2 takes part, as a witness.
4. These buckets are refined as in step 2, by all bytes that a cell reaches, and the rest by single windows: the core with
   the up to 15 bytes on either side that a window takes.

All buckets are grouped counts, joined back to their members; no bucket is ever gathered in one task. Texts travel
compressed to where they meet their anchors and spans.

Defined cases: null and texts shorter than ``length`` keep all they have; a repeated row is a repeat like any other;
matches never cross texts; texts of any length are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ranksmith.llm.common import Copies, guarded, guarded_name, kept_columns, raw, slices
from ranksmith.storage import written

LENGTH = 400
GRAM = 128
CELL = 16
PIECE_BYTES = 1 << 20
EMPTY = np.zeros(0, np.int64)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each place on; ``gram`` is a power of two. Runs of twice the length are put together."""
    with np.errstate(over="ignore"):
        value = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        base, size = np.uint64(0xD6E8FEB86659FD93), 1
        while size < gram:
            value = value[:-size] * base + value[size:]
            value ^= value >> np.uint64(31)
            base, size = base * base, 2 * size
        value *= np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(32))


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours, by doubling."""
    done = 1
    while 2 * done <= size:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (size - done)], values[size - done :]) if size > done else values


def anchors(texts: list[bytes], length: int, gram: int):
    """(text, anchor, first start, last start, hash): the anchors of all texts with the windows that each settles."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < length:
        return EMPTY, EMPTY, EMPTY, EMPTY, EMPTY
    hashes = gram_hashes(data, gram)
    # 32 bits of the hash, then the place: the leftmost of equal hashes wins, alike in equal windows.
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    least = (sliding_least(ranked, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(texts)), counts)
    before = np.cumsum(counts) - counts
    start = np.arange(len(text)) + np.repeat(ends - sizes - before, counts)
    anchor = least[start]
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
    if not len(first):
        return EMPTY, EMPTY, EMPTY, EMPTY, EMPTY
    last = np.append(first[1:], len(text)) - 1
    text, origin = text[first], (ends - sizes)[text[first]]
    return text, anchor[first] - origin, start[first] - origin, start[last] - origin, hashes[anchor[first]].view(np.int64)


def key_of(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def find_anchors(table: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """Rows (q, hull, k1, k2, a, s1, s2): anchor a of the text k1, k2 settles the windows that start from s1 to s2."""

    def run(batches):
        for piece in slices(batches, text, PIECE_BYTES):
            texts = raw(piece.column(text))
            number, a, s1, s2, q = anchors(texts, length, gram)
            views = [memoryview(t) for t in texts]
            # Equal numbers: equal bytes at equal offsets, with equal windows.
            seeds = ((a - s1) << 32 | (s2 - s1)).tolist()
            hashed = xxhash.xxh3_64_intdigest
            hulls = np.fromiter(
                (hashed(views[t][x : y + length], z) for t, x, y, z in zip(number.tolist(), s1.tolist(), s2.tolist(), seeds)),
                np.uint64,
                len(a),
            )
            keys = [piece.column(c).to_numpy(zero_copy_only=False)[number] for c in ("k1", "k2")]
            numbers = [q, hulls.view(np.int64), *keys]
            places = [a.astype(np.int32), s1.astype(np.int32), s2.astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (*numbers, *places)], names=["q", "hull", "k1", "k2", "a", "s1", "s2"]
            )

    schema = "q bigint, hull bigint, k1 bigint, k2 bigint, a int, s1 int, s2 int"
    return table.select(text, "k1", "k2").mapInArrow(run, schema)


def packed(table: DataFrame, text: str) -> DataFrame:
    """The rows with the text as a Zstandard frame in ``zipped``."""
    passed = [c for c in table.columns if c != text]
    schema = T.StructType([table.schema[c] for c in passed]).add("zipped", T.BinaryType())

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for piece in slices(batches, text, PIECE_BYTES):
            frames = pa.array([press.compress(x) for x in raw(piece.column(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in passed] + [frames], names=schema.names)

    return table.mapInArrow(run, schema)


def unpacked(frames: pa.Array) -> list[bytes]:
    press = zstandard.ZstdDecompressor()
    return [press.decompress(x) for x in frames.to_pylist()]


def find_cells(met: DataFrame, length: int) -> DataFrame:
    """Rows (core, hull, left, right, k1, k2, start, low, high) for texts with ``parts``, their anchors to be refined.

    The windows of a cell start at ``start - j`` for j from low to high. ``core`` stands for the bytes that all of them
    share, ``left`` and ``right`` are the bytes around it that some of them take, and ``hull`` stands for all together.
    """
    shared, side = length - CELL + 1, CELL - 1

    def run(batches):
        previous = None
        for piece in slices(batches, "zipped", PIECE_BYTES):
            core, hull, left, right, rows = [], [], [], [], []
            keys = zip(piece.column("k1").to_pylist(), piece.column("k2").to_pylist())
            for key, value, parts in zip(keys, unpacked(piece.column("zipped")), piece.column("parts").to_pylist()):
                if key == previous:  # copies of one text stand together, and one of them is enough
                    continue
                previous = key
                for part in parts:
                    a, least, most = part["a"], part["a"] - part["s2"], part["a"] - part["s1"]
                    for d in range(least // CELL * CELL, most + 1, CELL):
                        at, low, high = a - d, max(least - d, 0), min(most - d, side)
                        begin, end = at - high, at + length - low
                        core.append(signed(xxhash.xxh3_64_intdigest(value[at : at + shared])))
                        hull.append(signed(xxhash.xxh3_64_intdigest(value[begin:end], CELL * low + high)))
                        left.append(value[begin:at])
                        right.append(value[at + shared : end])
                        rows.append((*key, at, low, high))
            columns = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            arrays = [pa.array(core, pa.int64()), pa.array(hull, pa.int64())]
            arrays += [pa.array(x, pa.binary()) for x in (left, right)]
            arrays += [pa.array(x, k) for x, k in zip(columns, kinds)]
            names = ["core", "hull", "left", "right", "k1", "k2", "start", "low", "high"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "core bigint, hull bigint, left binary, right binary, k1 bigint, k2 bigint, start int, low int, high int"
    return met.select("zipped", "k1", "k2", "parts").mapInArrow(run, schema)


def several(table: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that more than one row has."""
    return table.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def refined(copies: Copies, table: DataFrame, bucket: str, finer: str) -> DataFrame:
    """The rows that share their ``bucket`` with another, and ``whole``: whether they share ``finer`` in it too."""
    shared = copies(several(table, [bucket]), "shared")
    members = copies(table.join(shared, bucket), "members")
    equal = copies(several(members, [bucket, finer]), "equal")
    marked = members.join(equal.withColumn("whole", F.lit(True)), [bucket, finer], "left")
    marked = copies(marked.withColumn("whole", F.coalesce("whole", F.lit(False))), "marked")
    copies.drop(shared, members, equal)
    return marked


def open_and_witnesses(marked: DataFrame, bucket: str, finer: str, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows not settled, and the settled rows of buckets that have some."""
    return marked.where("not whole").drop("whole"), marked.where("whole").drop("whole").join(asked, bucket)


def find_repeats(table: DataFrame, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(k1, k2, spans): for each text with repeated windows, byte spans that cover them all. ``table`` has k1 and k2."""
    copies = Copies(table.sparkSession)
    every = copies(find_anchors(table, text, length, gram), "anchors")
    marked = refined(copies, every, "q", "hull")
    copies.drop(every)
    settled = marked.where("whole").selectExpr("k1", "k2", "s1 as begin", f"s2 + {length} as end")

    asked = copies(marked.where("not whole").select("q").distinct(), "asked")
    rest, witnesses = open_and_witnesses(marked, "q", "hull", asked)
    member = F.min(F.struct("k1", "k2", "a", "s1", "s2")).alias("m")
    one = witnesses.groupBy("q", "hull").agg(member).select("m.*")
    parts = rest.select("k1", "k2", "a", "s1", "s2").union(one)
    parts = copies(parts.groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "s1", "s2")).alias("parts")), "parts")
    cells = copies(find_cells(packed(table, text).join(parts, ["k1", "k2"]), length), "cells")
    near = refined(copies, cells, "core", "hull")
    copies.drop(asked, parts, cells)
    whole_cells = near.where("whole").selectExpr("k1", "k2", "start - high as begin", f"start - low + {length} as end")

    asked = copies(near.where("not whole").select("core").distinct(), "asked")
    rest, witnesses = open_and_witnesses(near, "core", "hull", asked)
    # Equal cells are equal in all but their place, and a witness, settled already, needs none.
    one = witnesses.groupBy("core", "hull").agg(*[F.min(c).alias(c) for c in ("left", "right", "low", "high")])
    one = one.withColumns({c: F.lit(None).cast(rest.schema[c].dataType) for c in ("k1", "k2", "start")})
    singles = rest.unionByName(one).withColumn("j", F.explode(F.sequence("low", "high")))
    string = [
        F.col("core"),
        F.col("j"),
        F.expr("substring(left, length(left) - j + 1, j)"),
        F.expr(f"substring(right, 1, {CELL - 1} - j)"),
    ]
    windows = singles.select(
        F.xxhash64(*string).alias("w1"),
        F.xxhash64(F.lit(1), *string).alias("w2"),
        "k1",
        "k2",
        (F.col("start") - F.col("j")).alias("begin"),
    )
    windows = copies(windows, "windows")
    repeated = windows.join(copies(several(windows, ["w1", "w2"]), "same"), ["w1", "w2"])
    repeated = repeated.where("begin is not null").selectExpr("k1", "k2", "begin", f"begin + {length} as end")
    found = settled.union(whole_cells).union(repeated)
    spans = written(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("begin", "end")).alias("spans")), "spans")
    copies.drop(*[copy for copy, _ in list(copies.paths.values())])
    return spans


def united(spans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs: spans that overlap or touch made one."""
    if not spans:
        return EMPTY, EMPTY
    begin = np.array([s["begin"] for s in spans])
    end = np.array([s["end"] for s in spans])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    return begin[new], end[np.append(np.flatnonzero(new)[1:], len(end)) - 1]


def remove_repeats(
    documents: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, keep: list[str] | None = None
) -> DataFrame:
    """The rows with ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs) and ``kept``, the remaining bytes."""
    results = ["n_bytes", "n_removed", "n_spans", "kept"]
    passed = kept_columns(documents, results, keep)
    table, _ = guarded(documents)
    value = guarded_name(documents, text)
    names = {c: guarded_name(documents, c) for c in passed}
    filled = F.coalesce(F.col(value), F.lit("")).alias("text")
    table = table.select(*names.values(), filled, *key_of(filled))
    spans = find_repeats(table.select("text", "k1", "k2"), "text", length, gram)
    schema = T.StructType([table.schema[c] for c in names.values()])
    for name in results:
        schema = schema.add(name, T.BinaryType() if name == "kept" else T.LongType())

    def run(batches):
        for piece in slices(batches, "zipped"):
            rows = []
            for data, found in zip(unpacked(piece.column("zipped")), piece.column("spans").to_pylist()):
                begin, end = united(found or [])
                cuts = np.concatenate(([0], np.stack((begin, end), axis=1).ravel(), [len(data)])).tolist()
                kept = b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if len(begin) else data
                rows.append((len(data), int((end - begin).sum()), len(begin), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in names.values()] + arrays, names=schema.names)

    met = packed(table, "text").join(spans, ["k1", "k2"], "left").select(*names.values(), "zipped", "spans")
    return met.mapInArrow(run, schema).toDF(*names, *results)
