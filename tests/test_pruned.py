"""Lists of large tables, where most pairs are never scored, against a plain sort."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.operators import pruned, score, sizes

FACTORS = "id int, features array<float>"

CASES = {
    "random": lambda rng, n: rng.normal(size=(n, 4)),
    "around a mean": lambda rng, n: [3, 0, 0, 0] + 0.3 * rng.normal(size=(n, 4)),
    "ties": lambda rng, n: rng.integers(-1, 3, size=(n, 4)),
    "zeros": lambda rng, n: np.zeros((n, 4)),
    "one coordinate": lambda rng, n: rng.normal(size=(n, 1)) * [0, 1, 0, 0],
}


@pytest.fixture(params=["broadcast", "shuffled"])
def pruning(request, monkeypatch):
    monkeypatch.setattr(score, "PRUNED_SCORES", 0)
    monkeypatch.setattr(score, "SOURCE_BLOCK", 0)
    for name, value in [("CELL", 8), ("CUT_ROWS", 100), ("TILE_SOURCES", 16), ("MIN_TILE_SOURCES", 4), ("BATCH_SCORES", 60), ("MERGE_ROWS", 3)]:
        monkeypatch.setattr(pruned, name, value)
    if request.param == "shuffled":
        monkeypatch.setattr(sizes, "BROADCAST_BYTES", 0)


def tables(spark, kind):
    rng = np.random.default_rng(5)
    vectors = [CASES[kind](rng, n).astype(np.float32) for n in (40, 300)]
    ids = [rng.permutation(2000)[: len(v)] - 300 for v in vectors]
    frames = [
        spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(own, rows)], FACTORS)
        for own, rows in zip(ids, vectors)
    ]
    return vectors, ids, frames


def plain(vectors, ids, k, allowed=lambda s, c: True):
    scores = (vectors[0].astype(np.float64) @ vectors[1].astype(np.float64).T).astype(np.float32)
    found = set()
    for s, row in zip(ids[0], scores):
        best = sorted((-x, c) for x, c in zip(row, ids[1]) if allowed(int(s), int(c)))[:k]
        found |= {(int(s), rank, int(c), float(-x)) for rank, (x, c) in enumerate(best, 1)}
    return found


def rows(found, *columns):
    collected = found.select(*columns).collect()
    assert len(collected) == len(set(collected))
    return {tuple(r) for r in collected}


ENTRY = ("source_id", "rank", "candidate_id", "score")


@pytest.mark.parametrize("kind", CASES)
def test_lists_are_those_of_all_pairs(spark, pruning, kind):
    vectors, ids, (sources, candidates) = tables(spark, kind)
    for k in (1, 7, 400):
        found = score.best_candidates(sources, candidates, k, 4, 40, 300)
        assert rows(found, *ENTRY) == plain(vectors, ids, k)


@pytest.mark.parametrize("kind", CASES)
def test_pairs_to_leave_out(spark, pruning, kind):
    vectors, ids, (sources, candidates) = tables(spark, kind)
    everything = plain(vectors, ids, 300)
    # Some lists lose their best entries, one loses all, and pairs of unknown ids are there too.
    hidden = {(s, c) for s, rank, c, _ in everything if rank <= s % 7 * 5 or s == min(ids[0])} | {(9999, 1), (int(ids[0][0]), 9999)}
    exclude = spark.createDataFrame([p for p in hidden for _ in (0, 1)], "source_id int, candidate_id int")
    found = score.best_candidates(sources, candidates, 6, 4, 40, 300, exclude)
    assert rows(found, *ENTRY) == plain(vectors, ids, 6, lambda s, c: (s, c) not in hidden)


@pytest.mark.parametrize("kind", CASES)
def test_segments(spark, pruning, kind):
    vectors, ids, (sources, candidates) = tables(spark, kind)
    # The last segment has two candidates only.
    name = F.when(F.col("id").isin([int(i) for i in ids[1][:2]]), "z").otherwise(F.concat(F.lit("s"), F.abs("id") % 3))
    named = candidates.withColumn("segment", name)
    found = rows(score.best_candidates(sources, named, 5, 4, 40, 300), "segment", *ENTRY)
    for segment, own in [(f"s{n}", n) for n in range(3)] + [("z", None)]:
        few = {int(i) for i in ids[1][:2]}
        inside = (lambda s, c: c in few) if own is None else (lambda s, c: c not in few and abs(c) % 3 == own)
        assert {r[1:] for r in found if r[0] == segment} == plain(vectors, ids, 5, inside)


def test_candidates_without_a_number_are_never_listed(spark, pruning):
    sources = spark.createDataFrame([(1, [1.0, 2.0])], FACTORS)
    candidates = spark.createDataFrame([(i, [float("nan") if i % 2 else 1.0, float(i)]) for i in range(20)], FACTORS)
    found = score.best_candidates(sources, candidates, 3, 2, 1, 20)
    assert [r["candidate_id"] for r in found.orderBy("rank").collect()] == [18, 16, 14]


def test_no_tables(spark, pruning):
    vectors, ids, (sources, candidates) = tables(spark, "random")
    nothing = candidates.where("id is null")
    assert score.best_candidates(sources, nothing, 3, 4, 40, 300).count() == 0
    assert score.best_candidates(nothing, candidates, 3, 4, 40, 300).count() == 0


@pytest.mark.parametrize("n_candidates", [20_000, 120_000])
def test_scores_made_do_not_follow_the_number_of_pairs(n_candidates):
    """Distinct vectors around a mean: a source wants few cells, and their share falls as candidates grow."""
    rng = np.random.default_rng(6)
    make = lambda n: ([2.0] + [0] * 5 + 0.4 * rng.normal(size=(n, 6))).astype(np.float32)
    users, items = make(50), make(n_candidates)
    ids = np.arange(n_candidates, dtype=np.int32)
    order = np.argsort(-np.linalg.norm(items, axis=1))
    items = items[order]
    exact = (users.astype(np.float64) @ items.astype(np.float64).T)
    rotation = np.linalg.eigh(items.T.astype(np.float64) @ items)[1][:, ::-1]
    turned = items @ rotation
    rows_ = []
    for part in np.array_split(np.arange(n_candidates), n_candidates // 10_000):
        for cell in pruned._split(turned[part], ids[part], 256):
            own = part[cell]
            rows_.append((own, dict(
                cell=len(rows_), n=own.size, first=int(own.min()), low=turned[own].min(0), high=turned[own].max(0),
                mean=turned[own].mean(0), rest=np.linalg.norm(turned[own][:, 1:], axis=1).max(),
                length=np.linalg.norm(items[own], axis=1).max(), flat=False, segment=None,
            )))
    cells = pruned.Cells([r for _, r in rows_], rotation)
    bounds = pruned.Sides(users, rotation).bounds(cells, np.arange(len(rows_)))
    for i, (own, _) in enumerate(rows_):
        assert (exact[:, own].max(axis=1) <= bounds[:, i]).all()
    tenth = -np.sort(-exact, axis=1)[:, 9]
    scored = sum(own.size * (bounds[:, i] >= tenth).sum() for i, (own, _) in enumerate(rows_))
    assert scored < (0.25 if n_candidates == 20_000 else 0.1) * exact.size


def test_list_order_is_by_row_falling_score_and_id():
    rng = np.random.default_rng(7)
    rows = rng.integers(0, 30, 4000)
    scores = rng.choice(np.array([-np.inf, -2.5, -1e-30, -0.0, 0.0, 1e-30, 1.5, 3.0, np.inf, np.nan], np.float32), 4000)
    scores[:2000] = rng.normal(size=2000)
    ids = rng.permutation(4000) - 2000
    assert (pruned._list_order(rows, ids, scores) == np.lexsort((ids, -scores, rows))).all()


def test_cells_far_from_nought_are_bounded_by_their_own_spread():
    """Cells around distant means, alike in length: what a source wants follows its direction."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 8))
    centres *= 4 / np.linalg.norm(centres, axis=1)[:, None]
    items = (np.repeat(centres, 64, axis=0) + 0.2 * rng.normal(size=(2560, 8))).astype(np.float32)
    users = rng.normal(size=(60, 8)).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(range(0, items.size + 1, 8), pa.int32()), pa.array(items.ravel()))
    cells = []
    for start in range(0, 2560, 64):
        part = {"id": pa.array(range(start, start + 64), pa.int32()), "features": lists[start : start + 64], "segment": pa.nulls(64, pa.string())}
        cells += [c.to_pylist()[0] for c in pruned._cutter(8, np.eye(8), 64)(iter([pa.RecordBatch.from_pydict(part)]))]
    known = pruned.Cells([c | {"cell": i} for i, c in enumerate(cells)], np.eye(8))
    bounds = pruned.Sides(users, known.rotation).bounds(known, np.arange(40))
    exact = (users.astype(np.float64) @ items.astype(np.float64).T).reshape(60, 40, 64).max(axis=2)
    assert (exact <= bounds).all()
    assert (bounds - exact).mean() < 0.35 * exact.std()


def near_vectors(n_sources, seed=9):
    """Cells and sources around some centres, as similar users and items are."""
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 4))
    items = (np.repeat(centres, 40, axis=0) + 0.02 * rng.normal(size=(1200, 4))).astype(np.float32)
    users = (centres[rng.integers(0, 30, n_sources)] + 0.02 * rng.normal(size=(n_sources, 4))).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(range(0, items.size + 1, 4), pa.int32()), pa.array(items.ravel()))
    batch = {"id": pa.array(range(1200), pa.int32()), "features": lists, "segment": pa.nulls(1200, pa.string())}
    cells = [c for b in pruned._cutter(4, np.eye(4), 16)(iter([pa.RecordBatch.from_pydict(batch)])) for c in b.to_pylist()]
    return users, cells, pruned.Cells([c | {"cell": i} for i, c in enumerate(cells)], np.eye(4))


def test_bounds_of_a_group_hold_for_its_sources():
    users, found, cells = near_vectors(700)
    users[5], users[6] = 0, np.nan
    groups, which = pruned.Groups(users, cells.rotation), np.arange(len(cells.n))
    assert sorted(groups.order) == list(range(700)) and groups.sizes.max() <= pruned.GROUP
    at = np.repeat(np.arange(len(groups.sizes)), groups.sizes)
    scores = [users[groups.order].astype(np.float64) @ np.array(c["features"]).reshape(-1, 4).T for c in found]
    most, least = (np.stack([f(s, axis=1) for s in scores], axis=1) for f in (np.max, np.min))
    every, one = (x[at] for x in groups.reached(cells, which))
    assert not (most > groups.bounds(cells, which)[at]).any()
    assert not (least < every).any() and not (most < one).any()


@pytest.mark.parametrize("k", [1, 10, 200])
def test_cells_are_chosen_by_groups(monkeypatch, k):
    """Fewer bounds than sources times cells, no cell beyond those chosen source by source, none missed that is listed."""
    users, found, cells = near_vectors(4000)
    made, plain_bounds = [], pruned.Sides.bounds
    which, sides = np.arange(len(cells.n)), pruned.Sides(users, cells.rotation)
    wanted = np.full(len(users), k) + np.arange(len(users)) % 3
    most = (~(sides.bounds(cells, which) < pruned._floors(sides, cells, which, wanted)[:, None])).any(axis=0)
    scores = np.concatenate([users.astype(np.float64) @ np.array(c["features"]).reshape(-1, 4).T for c in found], axis=1)
    listed = (scores >= np.array([np.sort(row)[-n] for row, n in zip(scores, wanted)])[:, None]).any(axis=0)
    least = set(np.repeat(which, cells.n)[listed])

    def counted(self, known, chosen):
        bound = plain_bounds(self, known, chosen)
        made.append(bound.size)
        return bound

    monkeypatch.setattr(pruned.Sides, "bounds", counted)
    chosen = set(pruned._wanted_cells(cells, users, wanted, 3).column("cell").to_pylist())
    assert least <= chosen <= set(np.flatnonzero(most))
    assert sum(made) < 0.2 * len(users) * len(cells.n)


def scored_cells(users, ids, found, cells, k, seen):
    """The lists of one tile that reads every cell; ``seen`` is what each source leaves out."""
    import pyarrow as pa

    flat, counts = [i for own in seen for i in own], [len(own) for own in seen]
    tile = {"place": 0, "cell": None, "ids": ids, "features": users.ravel().tolist(), "seen": flat, "n_seen": counts}
    every = [{"place": i + 1, "cell": i} | {f"cell_{c}": x[c] for c in ("ids", "runs", "features")} for i, x in enumerate(found)]
    names = {"ids": pa.int32(), "features": pa.float32(), "seen": pa.int32(), "n_seen": pa.int32()}
    names |= {"cell_ids": pa.int32(), "cell_runs": pa.int32(), "cell_features": pa.float32()}
    schema = pa.schema([("place", pa.int32()), ("cell", pa.int64())] + [(n, pa.list_(t)) for n, t in names.items()])
    scored = pruned._scorer(k, 4, cells, False)(iter([pa.RecordBatch.from_pylist([tile, *every], schema=schema)]))
    items = np.zeros((1200, 4), np.float32)
    for cell in found:
        items[cell["ids"]] = np.array(cell["features"], np.float32).reshape(-1, 4)
    return {(r["source_id"], r["rank"], r["candidate_id"], r["score"]) for b in scored for r in b.to_pylist()}, items


def test_items_to_leave_out_are_looked_up_cell_by_cell(monkeypatch):
    """What is looked up follows the cells and the pairs left out, not sources times what each leaves out times cells."""
    users, found, cells = near_vectors(1000)
    rng, ids = np.random.default_rng(10), [3000 + i for i in range(1000)]
    seen = [rng.choice(1300, rng.integers(0, 60), replace=False).tolist() for _ in ids]
    looked, plain_search = [], np.searchsorted

    def counted(values, wanted, *args, **kwargs):
        looked.append(np.size(wanted))
        return plain_search(values, wanted, *args, **kwargs)

    monkeypatch.setattr(np, "searchsorted", counted)
    lists, items = scored_cells(users, ids, found, cells, 1200, seen)
    monkeypatch.undo()
    assert sum(looked) < 0.2 * sum(map(len, seen)) * len(found)
    hidden = {(s, c) for s, own in zip(ids, seen) for c in own}
    assert lists == plain([users, items], [ids, range(1200)], 1200, lambda s, c: (s, c) not in hidden)


def test_lists_are_made_by_groups(monkeypatch):
    """Fewer bounds than sources times cells, and the lists of a plain sort."""
    users, found, cells = near_vectors(4000)
    made, plain_bounds = [], pruned.Sides.bounds

    def counted(self, known, chosen):
        bound = plain_bounds(self, known, chosen)
        made.append(bound.size)
        return bound

    monkeypatch.setattr(pruned.Sides, "bounds", counted)
    ids = [7000 - i for i in range(4000)]
    lists, items = scored_cells(users, ids, found, cells, 5, [[]] * 4000)
    assert lists == plain([users, items], [ids, range(1200)], 5)
    assert sum(made) < 0.3 * len(users) * len(cells.n)


def test_large_tables_make_few_tiles():
    # Every tile is sent its cells, so what is shuffled follows from the number of tiles.
    assert [pruned.tile_count(5_400_000, entries, 8) for entries in (10, 100)] == [32, 68]
    assert [pruned.tile_count(n, 10, 8) for n in (1, 3_000, 900_000, 54_000_000)] == [1, 3, 32, 270]


def test_a_picked_pair_is_scored_in_double_precision_a_slice_at_a_time(monkeypatch):
    monkeypatch.setattr(pruned, "BATCH_SCORES", 60)
    rng = np.random.default_rng(3)
    sources, candidates = (rng.normal(size=(n, 5)).astype(np.float32) for n in (40, 30))
    rows, columns = rng.integers(0, 40, 500), rng.integers(0, 30, 500)
    whole = np.einsum("ij,ij->i", sources[rows].astype(np.float64), candidates[columns].astype(np.float64))
    assert (pruned._exact(sources, rows, candidates, columns) == whole.astype(np.float32)).all()
    assert pruned._exact(sources, rows[:0], candidates, columns[:0]).size == 0
