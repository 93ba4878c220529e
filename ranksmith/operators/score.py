"""Best candidates per source id from two factor tables.

Scores are computed block by block: factors of up to a thousand sources
and a few thousand candidates meet as two matrices, and only the best ``k`` per
source leave the task. No row per pair is ever made.

Blocks are formed by a hash of the id. Ids are distinct in a factor table, so
no block grows with the number of ratings an id has.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ranksmith.columns import RANK, SCORE
from ranksmith.operators.pruned import pruned_candidates
from ranksmith.operators.sizes import factor_bytes, is_small

SOURCE = "source_id"
CANDIDATE = "candidate_id"
SEGMENT = "segment"

# Most ids per block, and scores per task: about a second's work, or less where
# that would leave cores idle.
SOURCE_BLOCK = 1_024
CANDIDATE_BLOCK = 4_096
SCORES_PER_TASK = 100_000_000
MIN_SCORES_PER_TASK = 5_000_000
MAX_TASKS = 100_000

# With more scores than this, sources and candidates are bounded first and most pairs never meet; below, scoring all is as fast.
PRUNED_SCORES = 30_000_000_000

# So many segments may be mixed in a block.
FEW_SEGMENTS = 16

# Rough size of one id in a broadcast list.
ID_BYTES = 16


def _block(id_column: str, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(id_column).cast("int")), F.lit(n_blocks)).cast("int")


def _packed(rows: str, side: str) -> list[Column]:
    """Ids and their features, one array each, from a list of structs."""
    return [
        F.transform(F.col(rows), lambda r: r["id"]).alias(f"{side}_ids"),
        F.flatten(F.transform(F.col(rows), lambda r: r["features"])).alias(f"{side}_features"),
    ]


def _segment_blocks(sizes: dict[str, int]) -> dict[str, tuple[int, int]]:
    """First block and number of blocks of each segment.

    Wide segments get blocks of their own; narrow ones share a block until it is full.
    """
    found, blocks, room = {}, 0, 0
    for segment, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if 2 * n > CANDIDATE_BLOCK:
            own = ceil(n / CANDIDATE_BLOCK)
            found[segment], blocks = (blocks, own), blocks + own
            continue
        if n > room:
            blocks, room = blocks + 1, CANDIDATE_BLOCK
        found[segment], room = (blocks - 1, 1), room - n
    return found


def _placed(candidates: DataFrame, n_candidates: int, n_segments: int | None) -> tuple[DataFrame, int]:
    """The candidates with their ``candidate_block``, and the number of blocks.

    A few segments share the blocks, which costs their products little and needs no count. More get blocks by their
    sizes; those counted here are the ones that the caller names.
    """
    if SEGMENT not in candidates.columns or (n_segments is not None and n_segments <= FEW_SEGMENTS):
        blocks = max(1, ceil(n_candidates / CANDIDATE_BLOCK))
        return candidates.withColumn("candidate_block", _block("id", blocks)), blocks
    sizes = {r[SEGMENT]: r["count"] for r in candidates.groupBy(SEGMENT).count().collect()}
    places = _segment_blocks(sizes)
    rows = [(segment, first, own) for segment, (first, own) in places.items()]
    where = candidates.sparkSession.createDataFrame(rows, f"{SEGMENT} string, first_block int, own_blocks int")
    block = F.col("first_block") + F.pmod(F.xxhash64("id"), F.col("own_blocks")).cast("int")
    placed = candidates.join(F.broadcast(where), SEGMENT).withColumn("candidate_block", block)
    return placed.drop("first_block", "own_blocks"), max(1, sum(own for _, own in places.values()))


def _packer(segmented: bool):
    """Blocks of candidates as they lie, one per batch of rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = {"candidate_ids": batch.column("id"), "candidate_features": batch.column("features").flatten()}
            if segmented:
                values["candidate_segments"] = batch.column(SEGMENT)
            columns = {
                name: pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
                for name, column in values.items()
            }
            columns["candidate_tile"] = pa.array([0], pa.int32())
            yield pa.RecordBatch.from_pydict(columns)

    return pack


def _tiling(
    tiles: int, n_sources: int, n_candidates: int, source_blocks: int, candidate_blocks: int
) -> tuple[int, int]:
    """How many source and candidate tiles make about ``tiles`` pairs for the least shuffling.

    Sources are sent once per candidate tile and candidates once per source tile, so both
    cost the same when the tile counts stand in the ratio of the table sizes.
    """
    balanced = round(sqrt(tiles * n_candidates / max(1, n_sources)))
    candidate_tiles = min(candidate_blocks, tiles, max(1, balanced))
    source_tiles = min(source_blocks, ceil(tiles / candidate_tiles))
    return source_tiles, candidate_tiles


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Keep the ``k`` best of every row: highest score first, then lowest id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.r_[0, np.flatnonzero(np.diff(rows)) + 1] if rows.size else np.zeros(0, int)
    position = np.arange(rows.size) - np.repeat(starts, np.diff(np.r_[starts, rows.size]))
    keep = position < k
    return rows[keep], ids[keep], scores[keep]


def _held_floor(held, n_rows: int, k: int) -> np.ndarray:
    """Per row, the ``k``-th best score found so far, or minus infinity."""
    rows, _, scores = held
    counts = np.bincount(rows, minlength=n_rows)
    floor = np.full(n_rows, -np.inf, np.float32)
    full = counts >= k
    floor[full] = scores[np.cumsum(counts)[full] - 1]
    return floor


def _group_floor(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row, a score that at least ``k`` columns reach: the ``k``-th best of group maxima."""
    n = scores.shape[1]
    if n <= k:
        return np.full(scores.shape[0], -np.inf, np.float32)
    width = max(1, n // (8 * k))
    groups = n // width
    maxima = scores[:, : groups * width].reshape(-1, groups, width).max(axis=2)
    return np.partition(maxima, groups - k, axis=1)[:, groups - k]


def _block_scores(sources, candidates, source_ids, candidate_ids, seen, held, k):
    """Rows, candidate ids and scores that may be among the ``k`` best, from one pair of blocks.

    A product in single precision only picks who may qualify; its rounding error is
    allowed for. The few picked are scored again in double precision and rounded
    back, which gives the same score however blocks are cut.
    """
    rough = sources @ candidates.T
    if seen is not None:
        by_source, by_candidate = np.argsort(source_ids), np.argsort(candidate_ids)
        seen_sources, seen_candidates = seen
        r = by_source[np.searchsorted(source_ids, seen_sources, sorter=by_source).clip(max=source_ids.size - 1)]
        c = by_candidate[
            np.searchsorted(candidate_ids, seen_candidates, sorter=by_candidate).clip(max=candidate_ids.size - 1)
        ]
        present = (source_ids[r] == seen_sources) & (candidate_ids[c] == seen_candidates)
        rough[r[present], c[present]] = -np.inf
    floor = _group_floor(rough, k) if held is None else _held_floor(held, sources.shape[0], k)
    if held is not None and not np.isfinite(floor).all():
        floor = np.maximum(floor, _group_floor(rough, k))
    lengths = np.linalg.norm(sources, axis=1) * np.linalg.norm(candidates, axis=1).max()
    error = lengths * ((sources.shape[1] + 2) * 2.0**-23)
    # One step further down, as rounding must not raise the floor; and a finite one, as
    # excluded candidates must stay below it.
    floor = np.nextafter((floor - 2 * error).astype(np.float32), np.float32(-np.inf))
    floor = np.maximum(floor, np.finfo(np.float32).min)
    rows, columns = np.divmod(np.flatnonzero(rough >= floor[:, None]), rough.shape[1])
    exact = np.einsum(
        "ij,ij->i", sources[rows].astype(np.float64), candidates[columns].astype(np.float64)
    ).astype(np.float32)
    return _best(rows, candidate_ids[columns], exact, k)


def _parts(segments) -> Iterator[tuple[str | None, np.ndarray | slice]]:
    """Each segment of a block with the places of its candidates."""
    if segments is None:
        yield None, slice(None)
        return
    coded = segments.dictionary_encode()
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    cuts = np.searchsorted(codes[order], np.arange(1, len(coded.dictionary)))
    yield from zip(coded.dictionary.to_pylist(), np.split(order, cuts))


def _scorer(k: int, rank: int, segmented: bool, excluding: bool, ranking: bool):
    def array(batch: pa.RecordBatch, name: str, i: int) -> np.ndarray:
        return batch.column(name)[i].values.to_numpy(zero_copy_only=False)

    def finished(source_ids, held) -> Iterator[pa.RecordBatch]:
        for segment, (rows, ids, scores) in held.items():
            columns = {SOURCE: pa.array(source_ids[rows], pa.int32())}
            if segmented:
                columns[SEGMENT] = pa.array([segment] * rows.size, pa.string())
            if ranking:
                # Rows of a source follow each other, best first.
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                position = np.arange(rows.size) - np.repeat(first, np.diff(np.r_[first, rows.size]))
                columns[RANK] = pa.array(position + 1, pa.int32())
            columns[CANDIDATE] = pa.array(ids, pa.int32())
            columns[SCORE] = pa.array(scores, pa.float32())
            yield pa.RecordBatch.from_pydict(columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs of one source block usually follow each other; their results are merged
        # here. Whatever is left apart is merged by the ranking afterwards.
        current, source_ids, sources, held = None, None, None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("source_block")[i].as_py()
                if block != current:
                    if held:
                        yield from finished(source_ids, held)
                    current, source_ids, held = block, array(batch, "source_ids", i), {}
                    sources = array(batch, "source_features", i).reshape(-1, rank)
                candidate_ids = array(batch, "candidate_ids", i)
                candidates = array(batch, "candidate_features", i).reshape(-1, rank)
                seen = None
                if excluding and batch.column("seen_pairs")[i].is_valid:
                    pairs = array(batch, "seen_pairs", i)
                    seen = (pairs >> 32).astype(np.int32), pairs.astype(np.int32)
                segments = batch.column("candidate_segments")[i].values if segmented else None
                for segment, own in _parts(segments):
                    known = held.get(segment)
                    new = _block_scores(
                        sources, candidates[own], source_ids, candidate_ids[own], seen, known, k
                    )
                    if known is not None:
                        new = _best(*[np.concatenate(part) for part in zip(known, new)], k)
                    held[segment] = new
        if held:
            yield from finished(source_ids, held)

    return score


def _wanted_pairs(exclude: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Few sources make few blocks, and the pairs of all other ids would pile up in them."""
    exclude = exclude.select(F.col(SOURCE).cast("int"), F.col(CANDIDATE).cast("int"))
    if not is_small(ID_BYTES * n_sources):
        return exclude
    return exclude.join(F.broadcast(sources.select(F.col("id").alias(SOURCE))), SOURCE, "left_semi")


def best_candidates(
    sources: DataFrame,
    candidates: DataFrame,
    k: int,
    rank: int,
    n_sources: int,
    n_candidates: int,
    exclude: DataFrame | None = None,
    broadcast_bytes: int | None = None,
    n_segments: int | None = None,
) -> DataFrame:
    """``source_id, [segment,] rank, candidate_id, score``: the ``k`` best candidates per source.

    ``sources`` and ``candidates`` are ``id, features``; with a ``segment``
    column on the candidates the ``k`` best are found within every segment.
    ``exclude`` lists pairs ``source_id, candidate_id`` to leave out.
    The counts are upper bounds; they size blocks, tasks and broadcasts, not results.

    Small candidate tables are broadcast, source blocks never move again, and every list is
    finished in the task of its source. If only
    the sources are few, they are broadcast instead and the candidates never move.
    Otherwise both are cut into tiles, and every tile of sources meets every tile of
    candidates in a shuffled join with as many tasks as the work asks for.

    Above ``PRUNED_SCORES`` pairs, ``pruned_candidates`` finds the same lists without scoring them all.
    """
    segmented = SEGMENT in candidates.columns
    scores, cores = n_sources * n_candidates, sources.sparkSession.sparkContext.defaultParallelism
    tasks = max(ceil(scores / SCORES_PER_TASK), min(cores, ceil(scores / MIN_SCORES_PER_TASK)))
    tasks = min(MAX_TASKS, max(1, tasks))
    small = is_small(factor_bytes(n_candidates, rank), broadcast_bytes)
    few = not small and exclude is None and n_sources <= SOURCE_BLOCK
    if scores > PRUNED_SCORES and not few:
        if exclude is not None:
            exclude = _wanted_pairs(exclude, sources, n_sources)
        return pruned_candidates(
            sources, candidates, k, rank, n_sources, n_candidates, exclude, broadcast_bytes
        )
    # Equal numbers of blocks for every task.
    source_blocks = tasks * max(1, ceil(n_sources / tasks / SOURCE_BLOCK))
    candidates, candidate_blocks = _placed(candidates, n_candidates, n_segments)

    source_tiles, candidate_tiles = 1, candidate_blocks
    if few:
        tasks, source_blocks, candidate_tiles = 1, 1, 1
    elif not small:
        source_tiles, candidate_tiles = _tiling(
            4 * tasks, n_sources, n_candidates, source_blocks, candidate_blocks
        )

    # Explicit partition counts: the work per row is heavy, so partitions must not be
    # merged for being small in bytes.
    left = (
        sources.select("id", "features", _block("id", source_blocks).alias("source_block"))
        .withColumn("task", F.col("source_block") % tasks)
        .repartitionById(tasks, F.col("task"))
        .groupBy("task", "source_block")
        .agg(F.collect_list(F.struct("id", "features")).alias("rows"))
        .select("task", "source_block", *_packed("rows", "source"))
    )
    tile_of = F.pmod("candidate_block", F.lit(candidate_tiles)).cast("int")
    tiles = F.sequence(F.lit(0), F.lit(candidate_tiles - 1))
    if exclude is None:
        left = left.withColumn("candidate_tile", F.explode(tiles))
    else:
        exclude = _wanted_pairs(exclude, sources, n_sources)
        if segmented:
            where = candidates.select(F.col("id").alias(CANDIDATE), tile_of.alias("tile")).distinct()
            exclude = exclude.join(F.broadcast(where) if small else where, CANDIDATE)
        else:
            place = F.pmod(_block(CANDIDATE, candidate_blocks), F.lit(candidate_tiles))
            exclude = exclude.withColumn("tile", place.cast("int"))
        # Pairs travel once, to the task of their source block, as one number each. A block has one sorted list
        # without repeats for each tile. It meets its lists once, before it is repeated for every tile, and each
        # repetition takes its own list along.
        pair = F.shiftleft(F.col(SOURCE).cast("bigint"), 32).bitwiseOR(
            F.col(CANDIDATE).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
        )
        placed = exclude.select(_block(SOURCE, source_blocks).alias("source_block"), "tile", pair.alias("pair"))
        seen = (
            placed.withColumn("task", F.col("source_block") % tasks)
            .repartitionById(tasks, F.col("task"))
            .groupBy("task", "source_block", "tile")
            .agg(F.sort_array(F.collect_set("pair")).alias("pairs"))
            .groupBy("task", "source_block")
            .agg(F.map_from_entries(F.collect_list(F.struct("tile", "pairs"))).alias("seen"))
        )
        left = left.join(seen, ["task", "source_block"], "left")
        own = F.transform(tiles, lambda n: F.struct(n.alias("tile"), F.try_element_at("seen", n).alias("seen")))
        left = left.withColumn("own", F.explode(own)).select(
            "source_block",
            "source_ids",
            "source_features",
            F.col("own.tile").alias("candidate_tile"),
            F.col("own.seen").alias("seen_pairs"),
        )
    left = left.withColumn("source_tile", F.pmod("source_block", F.lit(source_tiles)))

    keys = [SEGMENT] if segmented else []
    segment_field = f"{SEGMENT} string, " if segmented else ""
    packing = "candidate_ids array<int>, candidate_features array<float>, "
    if segmented:
        packing += "candidate_segments array<string>, "
    if few:
        right = candidates.select("id", "features", *keys).mapInArrow(_packer(segmented), packing + "candidate_tile int")
        pairs = right.join(F.broadcast(left), "candidate_tile")
    else:
        packed = _packed("rows", "candidate")
        if segmented:
            packed.append(F.transform("rows", lambda r: r[SEGMENT]).alias("candidate_segments"))
        right = (
            candidates.groupBy("candidate_block")
            .agg(F.collect_list(F.struct("id", "features", *keys)).alias("rows"))
            .select(*packed, tile_of.alias("candidate_tile"))
        )
        if small:
            pairs = left.join(F.broadcast(right), "candidate_tile")
        else:
            tile = ["source_tile", "candidate_tile"]
            copies = F.explode(F.sequence(F.lit(0), F.lit(source_tiles - 1)))
            right = right.withColumn("source_tile", copies)
            pairs = left.repartition(tasks, *tile).join(right.repartition(tasks, *tile), tile)

    columns = ["source_block", "source_ids", "source_features", "candidate_ids", "candidate_features"]
    columns += ["candidate_segments"] * segmented
    if exclude is not None:
        columns.append("seen_pairs")
    rank_field = f"{RANK} int, " if small else ""
    schema = f"{SOURCE} int, {segment_field}{rank_field}{CANDIDATE} int, {SCORE} float"
    found = pairs.select(*columns).mapInArrow(_scorer(k, rank, segmented, exclude is not None, small), schema)

    groups = [SOURCE, *keys]
    if small:
        return found.withColumn(SCORE, F.col(SCORE).cast("double"))
    order = Window.partitionBy(*groups).orderBy(F.desc(SCORE), F.asc(CANDIDATE))
    return (
        found.withColumn(RANK, F.row_number().over(order))
        .where(F.col(RANK) <= k)
        .select(*groups, RANK, CANDIDATE, F.col(SCORE).cast("double").alias(SCORE))
    )
