"""Vector compression: product codes, searched through dictionaries of each dimension's values.

Components become integers, vectors are cut into equal parts, and every part is named by the nearest entry of its
codebook. Codebooks start as the parts of the vectors with the smallest ids and are improved by rounds of means.

1. Rows are put into blocks. A block keeps, for every dimension, the distinct integers that occur in it (the dictionary) and each
   vector's code in that dictionary. Blocks are written once; all rounds read them.
2. A round's task tabulates, for a dimension, the squared difference of every distinct integer to that component
   of all entries. The distances of the parts to the entries are then rows gathered from these tables by code, added over
   the part's dimensions. No component is multiplied twice.
3. Tasks return counts and sums for each entry, which Spark adds up. The driver holds one set of codebooks, whose size
   is set by ``entries`` and the dimension and does not depend on the number of vectors.

Defined cases: rows whose vector is null or holds a null, NaN or infinite component are dropped; of rows that share an id
those with the smaller vector come first, null ids last; fewer rows than ``entries`` make smaller codebooks; an
entry that no part is nearest to stays as it is; repeated rows get the same code; null labels count as one label; an empty
table gives an empty table. Vectors of different lengths, or of a length that the parts do not divide, are an error, and so are
components so large that a squared distance would exceed 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ranksmith.llm.common import guarded, guarded_name, kept_columns
from ranksmith.storage import written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK_ROWS = 4096
BLOCK_VALUES = 1 << 20
CHUNK_ROWS = 512


def whole_vectors(table: DataFrame, vector: str) -> DataFrame:
    """The rows whose vector has a finite number at every place."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return table.where(F.col(vector).isNotNull() & finite)


def profile(kept: DataFrame, vector: str, parts: int, scale: int) -> tuple[int, int, int]:
    """Rows, length of a vector, and the largest integer component in absolute value."""
    size = F.size(vector)
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    found = kept.agg(F.count(F.lit(1)), F.min(size), F.max(size), F.max(largest)).first()
    rows, least, most = found[0], found[1] or 0, found[2] or 0
    if least != most or most % parts or (rows and not most):
        raise ValueError(f"vectors of {least} to {most} components do not make {parts} equal parts")
    reach = int(np.ceil((found[3] or 0.0) * scale)) + 1
    if most * (2 * reach) ** 2 >= 1 << 63:
        raise ValueError("components too large: a squared distance would exceed 64 bits")
    return rows, most, reach


def integers(column: pa.Array, size: int, scale: int) -> np.ndarray:
    """The vectors as rows of integers, rounded down."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * scale).astype(np.int64).reshape(-1, size)


def write_blocks(kept: DataFrame, columns: list[str], vector: str, size: int, scale: int) -> DataFrame:
    """Rows (held, dictionaries, codes): a block's other columns, each dimension's distinct integers, and all codes by dimension."""
    own = T.StructType([kept.schema[c] for c in columns])
    schema = T.StructType(
        [
            T.StructField("held", T.ArrayType(own)),
            T.StructField("dictionaries", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("codes", T.BinaryType()),
        ]
    )
    n_rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(1, size)))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, n_rows):
                block = batch.slice(a, n_rows)
                found = [np.unique(x, return_inverse=True) for x in integers(block.column(vector), size, scale).T]
                codes = np.stack([codes for _, codes in found]).astype("<u2")
                dictionaries = pa.array([[values for values, _ in found]], pa.list_(pa.list_(pa.int64())))
                held = pa.StructArray.from_arrays([block.column(c) for c in columns], names=columns)
                held = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
                yield pa.RecordBatch.from_arrays([held, dictionaries, pa.array([codes.tobytes()], pa.binary())], names=schema.names)

    return written(kept.select(*dict.fromkeys([*columns, vector])).mapInArrow(run, schema), "blocks")


def unpacked(batch: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A block's dictionaries and its codes, one row for each dimension."""
    listed = batch.column("dictionaries")[k].values
    cuts = listed.offsets.to_numpy()
    flat = listed.values.to_numpy()
    dictionaries = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
    codes = np.frombuffer(batch.column("codes")[k].as_buffer(), "<u2").reshape(len(dictionaries), -1)
    return dictionaries, codes


def nearest(dictionaries: list[np.ndarray], codes: np.ndarray, books: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector, the nearest entry (ties to the lower) and the squared distance. ``books`` is parts x entries x width."""
    parts, entries, width = books.shape
    kind = np.int64 if wide else np.int32
    rows = codes.shape[1]
    index, least = np.zeros((parts, rows), np.int64), np.zeros((parts, rows), np.int64)
    far, row = np.empty((CHUNK_ROWS, entries), kind), np.arange(CHUNK_ROWS)
    gathered = np.empty_like(far)
    for p in range(parts):
        own = range(p * width, (p + 1) * width)
        tables = [((dictionaries[d][:, None] - books[p, :, d - p * width]) ** 2).astype(kind) for d in own]
        for a in range(0, rows, CHUNK_ROWS):
            n = min(CHUNK_ROWS, rows - a)
            total, part = far[:n], gathered[:n]
            total[:] = 0
            for table, d in zip(tables, own):
                np.take(table, codes[d, a : a + n], axis=0, out=part, mode="clip")
                total += part
            index[p, a : a + n] = best = total.argmin(axis=1)
            least[p, a : a + n] = total[row[:n], best]
    return index, least


def add_up(blocks: DataFrame, books: np.ndarray, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each part and entry, the sums of the parts nearest to it, and how many they are."""
    parts, entries, width = books.shape
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches):
        sums, counts = np.zeros_like(shared.value), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                dictionaries, codes = unpacked(batch, k)
                index, _ = nearest(dictionaries, codes, shared.value, wide)
                values = np.stack([own[c] for own, c in zip(dictionaries, codes)]).reshape(parts, width, -1)
                for p in range(parts):
                    order = np.argsort(index[p], kind="stable")
                    used, first = np.unique(index[p][order], return_index=True)
                    sums[p, used] += np.add.reduceat(values[p][:, order], first, axis=1).T
                    counts[p] += np.bincount(index[p], minlength=entries)
        used = np.repeat(counts.ravel() > 0, width + 1)
        every = np.concatenate((sums, counts[:, :, None]), axis=2).ravel()
        slots = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(every[slots])], names=["slot", "total"])

    found = blocks.select("dictionaries", "codes").mapInArrow(run, "slot bigint, total bigint")
    every = np.zeros(parts * entries * (width + 1), np.int64)
    for slot, total in found.groupBy("slot").agg(F.sum("total")).collect():  # one number for each number of the codebooks
        every[slot] = total
    every = every.reshape(parts, entries, width + 1)
    return every[:, :, :width], every[:, :, width]


def fit_codebooks(
    kept: DataFrame, blocks: DataFrame, id: str, vector: str, size: int, parts: int, entries: int, rounds: int, scale: int, wide: bool
) -> np.ndarray:
    """Codebooks (parts x entries x width) after ``rounds`` of assigning all parts and moving entries to their means, rounded down."""
    first = kept.select(id, vector).orderBy(F.col(id).asc_nulls_last(), vector).limit(entries).collect()
    start = np.floor(np.array([r[1] for r in first], np.float64) * scale).astype(np.int64)
    books = np.ascontiguousarray(start.reshape(len(first), parts, size // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        sums, counts = add_up(blocks, books, wide)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def code_vectors(
    vectors: DataFrame,
    id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows with a whole vector, with ``code`` (two hex digits for each part's entry), ``error`` (squared distances added over the
    parts), ``label_error`` (error added over the rows with the same label) and ``codebooks_sha256`` (of the final
    codebooks: their integers by part, entry and place, joined by commas). ``entries`` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so a codebook has 1 to 256 entries")
    results = ["code", "error", "label_error", "codebooks_sha256"]
    passed = kept_columns(vectors, results, keep)
    table, _ = guarded(vectors)
    names = {c: guarded_name(vectors, c) for c in passed}
    own_id, own_vector, own_label = (guarded_name(vectors, c) for c in (id, vector, label))
    kept = whole_vectors(table, own_vector)
    rows, size, reach = profile(kept, own_vector, parts, scale)
    carried = list(dict.fromkeys([*names.values(), own_label]))
    schema = T.StructType([table.schema[c] for c in carried]).add("code", T.StringType()).add("error", T.LongType())
    if not rows:
        books = np.zeros((parts, 0, 0), np.int64)
        coded = table.sparkSession.createDataFrame([], schema)
    else:
        wide = size // parts * (2 * reach) ** 2 >= 1 << 31
        blocks = write_blocks(kept, carried, own_vector, size, scale)
        books = fit_codebooks(kept, blocks, own_id, own_vector, size, parts, entries, rounds, scale, wide)
        coded = written(assigned(blocks, carried, schema, books, wide), "coded")
    # Written on its own, so that a label with very many rows can be split in the join.
    by_label = written(coded.groupBy(F.col(own_label).alias("_of")).agg(F.sum("error").alias("label_error")), "labels")
    met = coded.join(by_label, F.col(own_label).eqNullSafe(F.col("_of")))
    found = met.select(*names.values(), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    return found.toDF(*names, *results)


def assigned(blocks: DataFrame, columns: list[str], schema: T.StructType, books: np.ndarray, wide: bool) -> DataFrame:
    """The blocks' rows with ``code`` and ``error``."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)
    digits = np.array([f"{k:02x}" for k in range(256)])

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                index, least = nearest(*unpacked(batch, k), shared.value, wide)
                code = digits[index[0]]
                for p in range(1, len(index)):
                    code = np.char.add(code, digits[index[p]])
                held = batch.column("held")[k].values
                arrays = [held.field(c) for c in columns] + [pa.array(code.tolist(), pa.string()), pa.array(least.sum(axis=0))]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return blocks.mapInArrow(run, schema)
