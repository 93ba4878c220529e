"""Best candidates per source id without scoring every pair, for large factor tables.

Candidates are cut into cells of similar vectors. A cell's bounds say which sources it cannot serve: those whose
``k``-th score so far is above anything in it. Sources are dealt into tiles, each finished by one task, which reads its
cells one after the other, the most promising first. The lists are those of scoring every pair, ties included.

A tile's sources are taken in groups of similar ones: what a cell cannot serve in a whole group is not asked source by
source, so that the bounds made follow groups times cells, and sources only where these leave something open.

A tile keeps its sources, their lists and the items to leave out; a cell is the only other thing in memory. What
is shuffled are the sources, once, and for every tile the cells that its own bounds do not rule out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ranksmith.columns import RANK, SCORE
from ranksmith.operators.sizes import factor_bytes, is_small
from ranksmith.storage import written

SOURCE = "source_id"
CANDIDATE = "candidate_id"
SEGMENT = "segment"

# Candidates per cell, more where there would be more than so many cells, and candidates whose cells are cut by one task.
CELL = 1_024
MAX_CELLS = 16_384
CUT_ROWS = 131_072

# Most sources per tile, and list entries that a tile may hold: every tile is sent its cells, so fewer tiles send less, and what
# a tile keeps in memory follows from these.
TILE_SOURCES = 200_000
TILE_ENTRIES = 8_000_000
MIN_TILE_SOURCES = 1_024

# Most sources whose bounds are made together first.
GROUP = 64

# Scores made at once, and sources whose lists are sorted at once.
BATCH_SCORES = 4_000_000
MERGE_ROWS = 4_096


class Cells:
    """What is known of every cell, as arrays in the order of the cells' numbers.

    ``low`` and ``high`` bound the rotated coordinates, ``rest`` the length of all but the first of them, ``length``
    that of the whole vector; ``mean`` is a vector that some candidate of the cell scores at least as high as, and
    ``spread`` the largest distance from it in all but the first coordinate.
    """

    def __init__(self, rows: list, rotation: np.ndarray):
        def array(name: str, dtype=np.float64) -> np.ndarray:
            return np.array([r[name] for r in rows], dtype=dtype)

        rank = rotation.shape[0]
        self.rotation = rotation
        self.number, self.n, self.first = array("cell", np.int64), array("n", np.int64), array("first", np.int64)
        self.low, self.high, self.mean = (array(c).reshape(-1, rank) for c in ("low", "high", "mean"))
        self.most = np.maximum(np.abs(self.low), np.abs(self.high))
        self.rest, self.length, self.flat = array("rest"), array("length"), array("flat", bool)
        far = self.rest + np.linalg.norm(self.mean[:, 1:], axis=1)  # no candidate is farther
        self.spread = array("spread") if rows and "spread" in rows[0] else far
        self.segment = [r[SEGMENT] for r in rows]
        self.place = {int(n): i for i, n in enumerate(self.number)}
        self.segments = list(dict.fromkeys(self.segment))
        codes = {s: i for i, s in enumerate(self.segments)}
        self.of_segment = np.array([codes[s] for s in self.segment], dtype=np.int64)


class Sides:
    """Sources in rotated coordinates, split by sign, as the bounds need them."""

    def __init__(self, features: np.ndarray, rotation: np.ndarray):
        turned = features.astype(np.float64) @ rotation
        self.plus, self.minus = np.maximum(turned, 0), np.minimum(turned, 0)
        self.first, self.rest = turned[:, 0], np.linalg.norm(turned[:, 1:], axis=1)
        self.turned, self.length = turned, np.linalg.norm(features.astype(np.float64), axis=1)

    def __getitem__(self, rows) -> Sides:
        part = object.__new__(type(self))
        for name, values in vars(self).items():
            setattr(part, name, values[rows])
        return part

    def bounds(self, cells: Cells, which) -> np.ndarray:
        """Per source and cell, a score that no candidate of the cell exceeds; not a number where none is known.

        The coordinates, the first of them with the distance of the others from nought and from the mean, and the lengths each
        give a bound. Rounding, to the floats that scores are, is allowed for.
        """
        box = self.plus @ cells.high[which].T + self.minus @ cells.low[which].T
        first = np.maximum(np.outer(self.first, cells.low[which, 0]), np.outer(self.first, cells.high[which, 0]))
        lengths = np.outer(self.length, cells.length[which])
        near = self.turned[:, 1:] @ cells.mean[which, 1:].T + np.outer(self.rest, cells.spread[which])
        bound = np.minimum(np.minimum(box, first + np.minimum(near, np.outer(self.rest, cells.rest[which]))), lengths)
        return bound + 1e-6 * lengths

    def reached(self, cells: Cells, which) -> tuple[np.ndarray, np.ndarray]:
        """Per source and cell, scores that all and that at least one of its candidates reach."""
        slack = 1e-6 * np.outer(self.length, cells.length[which])
        every = self.plus @ cells.low[which].T + self.minus @ cells.high[which].T
        return every - slack, self.turned @ cells.mean[which].T - slack


class Groups(Sides):
    """Groups of similar sources: each as its middle, with bounds that hold for all of its sources.

    ``order`` lists the sources group by group, whichever groups are taken out; ``starts`` says where each group begins in it
    and ``sizes`` how many it has.
    """

    def __init__(self, features: np.ndarray, rotation: np.ndarray):
        turned = features.astype(np.float64) @ rotation
        parts = _split(turned, np.arange(len(features)), GROUP)
        self.order, self.sizes = np.concatenate(parts), np.array([p.size for p in parts])
        self.starts = np.cumsum(self.sizes) - self.sizes
        own = turned[self.order]
        low, high = np.minimum.reduceat(own, self.starts), np.maximum.reduceat(own, self.starts)
        middle = (low + high) / 2
        super().__init__(middle, np.eye(rotation.shape[0]))
        self.half = high - middle
        away = np.linalg.norm(own - np.repeat(middle, self.sizes, axis=0), axis=1)
        self.radius = np.maximum.reduceat(away, self.starts)
        self.length = self.length + self.radius

    def __getitem__(self, rows) -> Groups:
        part = super().__getitem__(rows)
        part.order = self.order
        return part

    def _off(self, cells: Cells, which) -> np.ndarray:
        """How far the score of a group's source may be from that of its middle."""
        return np.minimum(self.half @ cells.most[which].T, np.outer(self.radius, cells.length[which]))

    def bounds(self, cells: Cells, which) -> np.ndarray:
        return super().bounds(cells, which) + self._off(cells, which)

    def reached(self, cells: Cells, which) -> tuple[np.ndarray, np.ndarray]:
        every, one = super().reached(cells, which)
        off = self._off(cells, which)
        return every - off, one - off


def _floors(sides: Sides, cells: Cells, which: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Per source, a score that at least ``wanted`` candidates of these cells reach, from the cells' bounds alone."""
    every, one = sides.reached(cells, which)
    every, one = np.nan_to_num(every, nan=-np.inf), np.nan_to_num(one, nan=-np.inf)
    every[cells.n[which][None, :] < wanted[:, None]] = -np.inf
    found = every.max(axis=1)
    # Cells share no candidate, so so many cells' means are reached by as many candidates.
    places = np.minimum(wanted, len(which))
    for place in np.unique(places[wanted <= len(which)]):
        rows = np.flatnonzero(wanted == place)
        means = np.partition(one[rows], len(which) - place, axis=1)[:, len(which) - place]
        found[rows] = np.maximum(found[rows], means)
    return found


def _gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def _matrix(table: pa.Table, rank: int) -> np.ndarray:
    return table.column("features").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, rank).astype(np.float32)


def _split(turned: np.ndarray, ids: np.ndarray, size: int) -> list[np.ndarray]:
    """Halves along the widest coordinate until none holds more than ``size``; equal ones by id."""
    found, open_ = [], [np.arange(ids.size)]
    while open_:
        rows = open_.pop()
        if rows.size <= size:
            found.append(rows)
            continue
        own = turned[rows]
        widest = int(np.argmax(np.nan_to_num(own.max(axis=0) - own.min(axis=0), nan=0.0)))
        order = rows[np.lexsort((ids[rows], own[:, widest]))]
        open_ += [order[: rows.size // 2], order[rows.size // 2 :]]
    return found


def _runs(features: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per candidate, how many equal ones have smaller ids."""
    order = np.lexsort((ids, *features.T))
    own = features[order]
    new = np.r_[True, (own[1:] != own[:-1]).any(axis=1)]
    first = np.maximum.accumulate(np.where(new, np.arange(ids.size), 0))
    runs = np.empty(ids.size, np.int32)
    runs[order] = np.arange(ids.size) - first
    return runs


CELL_SCHEMA = (
    f"{SEGMENT} string, n int, first int, low array<double>, high array<double>, mean array<double>, rest double, "
    "spread double, length double, flat boolean, ids array<int>, runs array<int>, features array<float>"
)


def _cutter(rank: int, rotation: np.ndarray, size: int):
    """The cells of one partition of candidates."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gathered(batches)
        if table is None:
            return
        features, ids = _matrix(table, rank), table.column("id").to_numpy()
        # A candidate whose score is no number is never listed.
        known = ~np.isnan(features).any(axis=1)
        coded = table.column(SEGMENT).combine_chunks().dictionary_encode(null_encoding="encode")
        codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        turned = features.astype(np.float64) @ rotation
        for code, segment in enumerate(names):
            own = np.flatnonzero(known & (codes == code))
            for part in _split(turned[own], ids[own], size) if own.size else []:
                rows = own[part]
                rows = rows[np.argsort(ids[rows])]
                near = turned[rows]
                values = {
                    SEGMENT: segment,
                    "n": rows.size,
                    "first": int(ids[rows[0]]),
                    "low": near.min(axis=0).tolist(),
                    "high": near.max(axis=0).tolist(),
                    "mean": near.mean(axis=0).tolist(),
                    "rest": float(np.linalg.norm(near[:, 1:], axis=1).max()),
                    "spread": float(np.linalg.norm(near[:, 1:] - near[:, 1:].mean(axis=0), axis=1).max()),
                    "length": float(np.linalg.norm(features[rows].astype(np.float64), axis=1).max()),
                    "flat": bool((features[rows] == features[rows[0]]).all()),
                }
                columns = {name: [value] for name, value in values.items()}
                columns["ids"] = pa.ListArray.from_arrays(pa.array([0, rows.size], pa.int32()), pa.array(ids[rows], pa.int32()))
                runs = _runs(features[rows], ids[rows])
                columns["runs"] = pa.ListArray.from_arrays(pa.array([0, rows.size], pa.int32()), pa.array(runs))
                flat = features[rows].ravel()
                columns["features"] = pa.ListArray.from_arrays(pa.array([0, flat.size], pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_pydict(columns, schema=_CELL_ARROW)

    return cut


_CELL_ARROW = pa.schema(
    [(SEGMENT, pa.string()), ("n", pa.int32()), ("first", pa.int32())]
    + [(name, pa.list_(pa.float64())) for name in ("low", "high", "mean")]
    + [("rest", pa.float64()), ("spread", pa.float64()), ("length", pa.float64()), ("flat", pa.bool_())]
    + [("ids", pa.list_(pa.int32())), ("runs", pa.list_(pa.int32())), ("features", pa.list_(pa.float32()))]
)


def _rotation(candidates: DataFrame, rank: int) -> np.ndarray:
    """The directions in which the candidates are longest, first ones first: the only thing taken from all at once."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rank, rank))
        for batch in batches:
            if batch.num_rows:
                features = _matrix(pa.Table.from_batches([batch]), rank).astype(np.float64)
                features = features[np.isfinite(features).all(axis=1)]
                total += features.T @ features
        yield pa.RecordBatch.from_pydict({"position": pa.array(range(rank * rank), pa.int32()), "value": total.ravel()})

    parts = candidates.select("features").mapInArrow(moments, "position int, value double")
    total = np.zeros(rank * rank)
    for row in parts.groupBy("position").agg(F.sum("value").alias("value")).collect():
        total[row["position"]] = row["value"]
    return np.linalg.eigh(np.nan_to_num(total.reshape(rank, rank)))[1][:, ::-1].copy()


def _wanted_cells(cells: Cells, features: np.ndarray, wanted: np.ndarray, tile: int) -> pa.RecordBatch:
    """The cells that may serve a source of the tile, in the order in which to read them."""
    groups = Groups(features, cells.rotation)
    sides, wanted = Sides(features[groups.order], cells.rotation), wanted[groups.order]
    most = np.maximum.reduceat(wanted, groups.starts)
    sums, served = np.zeros(len(cells.n)), np.zeros(len(cells.n), bool)
    step = max(1, BATCH_SCORES // max(1, len(cells.n)))
    for code in range(len(cells.segments)):
        which = np.flatnonzero(cells.of_segment == code)
        for start in range(0, len(most), step):
            part = groups[slice(start, start + step)]
            bound = part.bounds(cells, which)
            sums[which] += np.nan_to_num(bound / np.maximum(part.length, 1e-30)[:, None]).sum(axis=0)
            open_ = ~(bound < _floors(part, cells, which, most[start : start + step])[:, None])
            for begin, size, near in zip(part.starts, part.sizes, open_):
                # What is ruled out for the group is below the scores that give its sources their floors.
                near = which[near]
                left = near[~served[near]]
                if left.size:
                    own = sides[slice(begin, begin + size)]
                    floor = _floors(own, cells, near, wanted[begin : begin + size])
                    served[left] = (~(own.bounds(cells, left) < floor[:, None])).any(axis=0)
    chosen = np.flatnonzero(served)
    chosen = chosen[np.lexsort((cells.first[chosen], -np.round(sums[chosen], 6)))]
    return pa.RecordBatch.from_pydict(
        {
            "tile": pa.array(np.full(chosen.size, tile), pa.int32()),
            "place": pa.array(np.arange(1, chosen.size + 1), pa.int32()),
            "cell": pa.array(cells.number[chosen], pa.int64()),
            "ids": pa.nulls(chosen.size, pa.list_(pa.int32())),
            "features": pa.nulls(chosen.size, pa.list_(pa.float32())),
            "seen": pa.nulls(chosen.size, pa.list_(pa.int32())),
            "n_seen": pa.nulls(chosen.size, pa.list_(pa.int32())),
        }
    )


TILE_SCHEMA = (
    "tile int, place int, cell bigint, ids array<int>, features array<float>, seen array<int>, n_seen array<int>"
)


def _tiler(k: int, rank: int, cells: Cells, excluding: bool):
    """One tile's sources as one row, and one row for every cell that it wants."""

    def tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _gathered(batches)
        if table is None:
            return
        tile = table.column("tile")[0].as_py()
        features = _matrix(table, rank)
        n_seen = np.zeros(len(features), np.int32)
        seen = pa.array([], pa.int32())
        if excluding:
            lists = table.column("seen").combine_chunks()
            n_seen = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            seen = lists.flatten()
        one = {
            "tile": pa.array([tile], pa.int32()),
            "place": pa.array([0], pa.int32()),
            "cell": pa.nulls(1, pa.int64()),
        }
        ids = table.column("id").combine_chunks()
        for name, column in [("ids", ids), ("features", pa.array(features.ravel())), ("seen", seen), ("n_seen", pa.array(n_seen))]:
            one[name] = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
        yield pa.RecordBatch.from_pydict(one)
        yield _wanted_cells(cells, features, n_seen.astype(np.int64) + k, tile)

    return tile_rows


def _exact(sources: np.ndarray, rows: np.ndarray, candidates: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Scores of the pairs of these rows and columns, made in double precision, some at a time, and rounded."""
    found, step = np.empty(rows.size, np.float32), max(1, BATCH_SCORES // (4 * sources.shape[1]))
    for start in range(0, rows.size, step):
        own = slice(start, start + step)
        near, far = sources[rows[own]].astype(np.float64), candidates[columns[own]].astype(np.float64)
        found[own] = np.einsum("ij,ij->i", near, far)
    return found


def _list_order(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """By row, falling score and id, no numbers last: row and score are sorted as one integer, ids only where these are equal."""
    bits = (scores + np.float32(0)).view(np.int32).astype(np.int64)
    falling = np.where(bits < 0, bits + 2**32, 2**31 - 1 - bits)
    falling[np.isnan(scores)] = 2**32 - 1
    keys = (rows.astype(np.int64) << 32) | falling
    order = np.argsort(keys)
    own = keys[order]
    same = own[1:] == own[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    order[tied] = order[tied][np.lexsort((ids[order[tied]], own[tied]))]
    return order


class _Lists:
    """The best ``k`` so far of every source of a tile, for one segment."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), -np.inf, np.float32), np.full((n, k), np.iinfo(np.int64).max)
        self.waiting, self.n_waiting = [], 0

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes scores of distinct pairs that are not held yet, and sorts them in when there are many."""
        self.waiting.append((rows.astype(np.int32), ids.astype(np.int32), scores))
        self.n_waiting += rows.size
        if 2 * self.n_waiting >= self.scores.size:
            self.merge()

    def merge(self) -> None:
        if not self.n_waiting:
            return
        waiting, self.waiting, self.n_waiting = self.waiting, [], 0
        rows, ids, scores = (np.concatenate(part) for part in zip(*waiting))
        waiting.clear()
        by_row = np.argsort(rows, kind="stable")
        rows, ids, scores = rows[by_row], ids[by_row], scores[by_row]
        cuts = np.searchsorted(rows, np.arange(0, len(self.scores) + MERGE_ROWS, MERGE_ROWS))
        for start, end in zip(cuts[:-1], cuts[1:]):
            if start < end:
                self._merge(rows[start:end], ids[start:end], scores[start:end])

    def _merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        k = self.scores.shape[1]
        own, at = np.unique(rows, return_inverse=True)
        all_rows = np.r_[np.repeat(np.arange(own.size), k), at]
        all_ids, all_scores = np.r_[self.ids[own].ravel(), ids], np.r_[self.scores[own].ravel(), scores]
        order = _list_order(all_rows, all_ids, all_scores)
        starts = np.searchsorted(all_rows[order], np.arange(own.size))
        best = order[starts[:, None] + np.arange(k)]
        self.scores[own], self.ids[own] = all_scores[best], all_ids[best]


def _scorer(k: int, rank: int, cells: Cells, segmented: bool):
    from ranksmith.operators.score import _group_floor

    def beaten(features: np.ndarray, lists: _Lists, rows: np.ndarray, vector: np.ndarray, first: int) -> np.ndarray:
        """Of equal candidates all scores are known: they serve no list that is above, or equal with smaller ids."""
        same = np.broadcast_to(vector.astype(np.float64), (rows.size, rank))
        exact = np.einsum("ij,ij->i", features[rows].astype(np.float64), same).astype(np.float32)
        last, ids = lists.scores[rows, -1], lists.ids[rows, -1]
        return rows[~((exact < last) | ((exact == last) & (ids < first)))]

    def add_cell(batch, r: int, i: int, tile: dict) -> None:
        features, sides = tile["features"], tile["sides"]
        if cells.segment[i] not in tile["lists"]:
            tile["lists"][cells.segment[i]] = _Lists(len(features), k)
        lists = tile["lists"][cells.segment[i]]
        cell, last = slice(i, i + 1), lists.scores[:, -1]
        groups = tile["groups"]
        near = ~(groups.bounds(cells, cell)[:, 0] < np.minimum.reduceat(last, groups.starts))
        rows = np.flatnonzero(np.repeat(near, groups.sizes))
        if not rows.size:
            return
        asked = sides if near.all() else sides[rows]
        rows = rows[~(asked.bounds(cells, cell)[:, 0] < last[rows])]
        if not rows.size:
            return
        ids, runs = (batch.column(c)[r].values.to_numpy() for c in ("cell_ids", "cell_runs"))
        vectors = batch.column("cell_features")[r].values.to_numpy().reshape(-1, rank)
        if cells.flat[i]:
            rows = beaten(features, lists, rows, vectors[0], cells.first[i])
        owners, hidden = _hidden(tile, ids) if tile["seen"].size else (None, None)
        step = max(1, BATCH_SCORES // len(ids))
        for start in range(0, rows.size, step):
            own = rows[start : start + step]
            # Of equal candidates only those with the smallest ids can be listed.
            few = runs < k + tile["n_seen"][own].max(initial=0)
            own_ids, own_vectors = ids[few], vectors[few]
            rough = features[own] @ own_vectors.T
            if owners is not None:
                at = np.searchsorted(own, owners).clip(max=own.size - 1)
                there = (own[at] == owners) & few[hidden]
                rough[at[there], (np.cumsum(few) - 1)[hidden[there]]] = -np.inf
            held = lists.scores[own, -1]
            floor = held if np.isfinite(held).all() else np.maximum(held, _group_floor(rough, k))
            error = sides.length[own] * cells.length[i] * ((rank + 2) * 2.0**-23)
            floor = np.nextafter((floor - 2 * error).astype(np.float32), np.float32(-np.inf))
            floor = np.maximum(floor, np.finfo(np.float32).min)
            # Few sources find anything in a cell, so each one's best score is looked at first; no number hides nothing.
            reach = np.flatnonzero(~(rough.max(axis=1) < floor))
            r_, c_ = np.nonzero(rough[reach] >= floor[reach, None])
            if cells.flat[i] and r_.size:
                # Equal candidates stand by id, so those behind a source's first ones are not listed.
                first = np.flatnonzero(np.diff(r_, prepend=-1))
                kept = np.arange(r_.size) - np.repeat(first, np.diff(np.r_[first, r_.size])) < k
                r_, c_ = r_[kept], c_[kept]
            r_ = own[reach[r_]]
            lists.add(r_, own_ids[c_], _exact(features, r_, own_vectors, c_))

    def _hidden(tile: dict, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sources that leave out some of these candidates, and where these stand: the pairs lie by candidate."""
        first = np.searchsorted(tile["seen"], ids)
        counts = np.searchsorted(tile["seen"], ids, side="right") - first
        pairs = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        return tile["owner"][pairs], np.repeat(np.arange(ids.size), counts)

    def finished(tile: dict) -> Iterator[pa.RecordBatch]:
        for segment, lists in tile["lists"].items():
            lists.merge()
            step = max(1, 500_000 // k)
            for start in range(0, len(tile["ids"]), step):
                scores, ids = lists.scores[start : start + step], lists.ids[start : start + step]
                rows, places = np.nonzero(ids != np.iinfo(np.int64).max)
                columns = {SOURCE: pa.array(tile["ids"][start : start + step][rows], pa.int32())}
                if segmented:
                    columns[SEGMENT] = pa.array([segment] * rows.size, pa.string())
                columns[RANK] = pa.array(places + 1, pa.int32())
                columns[CANDIDATE] = pa.array(ids[rows, places], pa.int32())
                columns[SCORE] = pa.array(scores[rows, places].astype(np.float64), pa.float64())
                yield pa.RecordBatch.from_pydict(columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column("place")[r].as_py() == 0:
                    if tile is not None:
                        yield from finished(tile)

                    def array(name: str) -> np.ndarray:
                        return batch.column(name)[r].values.to_numpy(zero_copy_only=False).copy()

                    features, n_seen = array("features").reshape(-1, rank), array("n_seen").astype(np.int64)
                    # Sources of a group stand together; the items to leave out are looked up cell by cell.
                    groups, seen = Groups(features, cells.rotation), array("seen")
                    features, place = features[groups.order], np.argsort(groups.order)
                    by_item = np.argsort(seen, kind="stable")
                    tile = {
                        "ids": array("ids")[groups.order],
                        "features": features,
                        "groups": groups,
                        "sides": Sides(features, cells.rotation),
                        "seen": seen[by_item],
                        "owner": np.repeat(place, n_seen)[by_item],
                        "n_seen": n_seen[groups.order],
                        "lists": {},
                    }
                else:
                    add_cell(batch, r, cells.place[batch.column("cell")[r].as_py()], tile)
        if tile is not None:
            yield from finished(tile)

    return score


def tile_count(n_sources: int, entries: int, cores: int) -> int:
    """Tiles for sources with so many list entries each: as few as memory allows, but some for every core."""
    most = max(MIN_TILE_SOURCES, min(TILE_SOURCES, TILE_ENTRIES // entries))
    return max(ceil(n_sources / most), min(4 * cores, ceil(n_sources / MIN_TILE_SOURCES)), 1)


def _tile_of(n_tiles: int) -> Column:
    return F.pmod(F.xxhash64(F.col("id").cast("int")), F.lit(n_tiles)).cast("int")


def pruned_candidates(
    sources: DataFrame,
    candidates: DataFrame,
    k: int,
    rank: int,
    n_sources: int,
    n_candidates: int,
    exclude: DataFrame | None = None,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """The same as ``best_candidates``. Cells and tiles are written to the shared folder, the scoring is left to the reader."""
    spark, segmented = sources.sparkSession, SEGMENT in candidates.columns
    rotation = _rotation(candidates, rank)
    length = F.aggregate("features", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    segment = F.col(SEGMENT) if segmented else F.lit(None).cast("string").alias(SEGMENT)
    # Equal lengths are cut by id, so that no group of equal vectors makes a large partition.
    placed = candidates.select("id", "features", segment, length.alias("length")).repartitionByRange(
        max(1, ceil(n_candidates / CUT_ROWS)), SEGMENT, F.desc("length"), "id"
    )
    cutter = _cutter(rank, rotation, max(CELL, ceil(n_candidates / MAX_CELLS)))
    cut = placed.drop("length").mapInArrow(cutter, CELL_SCHEMA)
    cells = written(cut.withColumn("cell", F.monotonically_increasing_id()), "cells")
    known = Cells(cells.drop("ids", "runs", "features").collect(), rotation)

    n_tiles = tile_count(n_sources, k * max(1, len(known.segments)), spark.sparkContext.defaultParallelism)
    rows = sources.select("id", "features")
    if exclude is not None:
        pairs = exclude.select(F.col(SOURCE).cast("int").alias("id"), F.col(CANDIDATE).cast("int").alias(CANDIDATE))
        # Sources are dealt like the pairs, so they only meet.
        pairs = pairs.withColumn("tile", _tile_of(n_tiles)).repartitionById(n_tiles, F.col("tile"))
        seen = pairs.groupBy("tile", "id").agg(F.collect_set(CANDIDATE).alias("seen"))
        rows = rows.withColumn("tile", _tile_of(n_tiles)).repartitionById(n_tiles, F.col("tile"))
        rows = rows.join(seen, ["tile", "id"], "left")
    else:
        rows = rows.withColumn("tile", _tile_of(n_tiles))
    # A partition is a tile.
    dealt = rows.repartitionById(n_tiles, F.col("tile"))
    tiles = written(dealt.mapInArrow(_tiler(k, rank, known, exclude is not None), TILE_SCHEMA), "tiles")

    blocks = tiles.where(F.col("place") == 0).drop("cell")
    vectors = cells.select("cell", *[F.col(c).alias(f"cell_{c}") for c in ("ids", "runs", "features")])
    small = is_small(factor_bytes(n_candidates, rank), broadcast_bytes)
    wants = tiles.where(F.col("place") > 0).select("tile", "place", "cell")
    stream = wants.join(F.broadcast(vectors) if small else vectors.hint("merge"), "cell")
    stream = stream.unionByName(blocks, allowMissingColumns=True)
    stream = stream.repartitionById(n_tiles, F.col("tile")).sortWithinPartitions("tile", "place")
    segment_field = f"{SEGMENT} string, " if segmented else ""
    schema = f"{SOURCE} int, {segment_field}{RANK} int, {CANDIDATE} int, {SCORE} double"
    return stream.mapInArrow(_scorer(k, rank, known, segmented), schema)
