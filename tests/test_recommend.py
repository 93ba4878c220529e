import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.operators import (
    AlsParams,
    FactorModel,
    as_arrays,
    first_per_list,
    flatten_lists,
    top_items,
    top_items_by_type,
    top_users,
)
from ranksmith.operators import score, sizes

FACTORS = "id int, features array<float>"


def lists(df, *owner, other="item_id"):
    """Entries per owner, in rank order; ranks must run from 1 without gaps."""
    found = {}
    for r in df.orderBy(*owner, "rank").collect():
        entries = found.setdefault(tuple(r[o] for o in owner), [])
        entries.append(r[other])
        assert r["rank"] == len(entries)
    return found


def brute(sources, candidates, k, allowed=lambda s, c: True):
    found = {}
    for s, u in sources.items():
        scored = [(-np.float32(u @ v), c) for c, v in candidates.items() if allowed(s, c)]
        found[(s,)] = [c for _, c in sorted(scored)[:k]]
    return {s: entries for s, entries in found.items() if entries}


@pytest.fixture(params=["one block", "many blocks", "tiles", "one tile per block", "few sources"])
def cut(request, monkeypatch):
    """The ways the work can be cut; results must not depend on it."""
    if request.param == "one block":
        return
    if request.param == "few sources":
        monkeypatch.setattr(sizes, "BROADCAST_BYTES", 0)
        return
    monkeypatch.setattr(score, "SOURCE_BLOCK", 7)
    monkeypatch.setattr(score, "CANDIDATE_BLOCK", 5)
    monkeypatch.setattr(score, "SCORES_PER_TASK", 300)
    monkeypatch.setattr(score, "MIN_SCORES_PER_TASK", 20)
    if request.param == "tiles":
        monkeypatch.setattr(sizes, "BROADCAST_BYTES", 0)
    if request.param == "one tile per block":
        monkeypatch.setattr(sizes, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(score, "SCORES_PER_TASK", 20)


def test_all_users(model, factors, cut):
    assert lists(top_items(model, 7), "user_id") == brute(*factors, 7)


def test_all_items(model, factors, cut):
    users, items = factors
    assert lists(top_users(model, 7), "item_id", other="user_id") == brute(items, users, 7)


def test_by_type(model, factors, catalog, cut):
    users, items = factors
    kinds = {r["ID"]: r["Type"] for r in catalog.collect()}
    found = lists(top_items_by_type(model, catalog, ["TV", "Movie"], 5), "user_id", "Type")
    for kind in ("TV", "Movie"):
        expected = brute(users, items, 5, lambda _, c: kinds[c] == kind)
        assert {u: e for (u, t), e in found.items() if t == kind} == {u: e for (u,), e in expected.items()}
    assert len(found) == 2 * len(users)


def test_rated_items_can_be_left_out(model, factors, ratings, cut):
    rated = {(r["user_id"], r["item_id"]) for r in ratings.collect()}
    unseen = top_items(model, 7, exclude_seen=ratings)
    assert lists(unseen, "user_id") == brute(*factors, 7, lambda s, c: (s, c) not in rated)


def test_rated_items_can_be_left_out_by_type(model, factors, ratings, catalog, cut):
    rated = {(r["user_id"], r["item_id"]) for r in ratings.collect()}
    kinds = {r["ID"]: r["Type"] for r in catalog.collect()}
    found = lists(
        top_items_by_type(model, catalog, ["OVA"], 4, [3, 4], exclude_seen=ratings), "user_id"
    )
    users = {u: v for u, v in factors[0].items() if u in (3, 4)}
    assert found == brute(users, factors[1], 4, lambda s, c: kinds[c] == "OVA" and (s, c) not in rated)


def test_only_the_targets_pairs_are_gathered(model, ratings):
    """One target makes one block; other users' ratings must not end up in it."""
    for users in (3, np.int64(3), iter([3]), ratings.where("user_id = 3").select("user_id")):
        lists_of = top_items(model, 4, users, exclude_seen=ratings)
        plan = lists_of._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan
        assert lists_of.join(ratings, ["user_id", "item_id"], "left_semi").count() == 0
    stranger = ratings.withColumn("user_id", F.col("user_id") + 1000)
    both = ratings.unionByName(stranger)
    assert sorted(map(tuple, top_items(model, 4, 3, both).collect())) == sorted(map(tuple, lists_of.collect()))


def test_rated_items_stay_by_default(model, ratings):
    seen = top_items(model, 10).join(ratings, ["user_id", "item_id"], "left_semi")
    assert seen.count() > 0


def test_same_lists_as_the_library_model(model):
    for ours, theirs, owner, other in (
        (top_items(model, 10), model.als_model.recommendForAllUsers(10), "user_id", "item_id"),
        (top_users(model, 10), model.als_model.recommendForAllItems(10), "item_id", "user_id"),
    ):
        both = ours.alias("a").join(flatten_lists(theirs, owner).alias("b"), [owner, "rank"])
        gap = both.agg(F.count("*"), F.max(F.abs(F.col("a.score") - F.col("b.score")))).first()
        assert gap[0] == ours.count()
        assert gap[1] < 1e-4


def test_targets_by_id_list_and_table(spark, model, factors):
    everyone = brute(*factors, 6)
    table = spark.createDataFrame([(4,), (4,), (4,), (12345,)], "user_id int")
    assert lists(top_items(model, 6, 4), "user_id") == {(4,): everyone[(4,)]}
    assert lists(top_items(model, 6, [4, 4, 5, -1]), "user_id") == {u: everyone[u] for u in ((4,), (5,))}
    assert lists(top_items(model, 6, table), "user_id") == {(4,): everyone[(4,)]}
    assert top_items(model, 6, 12345).count() == 0
    items = brute(factors[1], factors[0], 3)
    assert lists(top_users(model, 3, [100, 101]), "item_id", other="user_id") == {
        i: items[i] for i in ((100,), (101,))
    }


def test_more_wanted_than_there_is(model, factors, catalog):
    assert lists(top_items(model, 500), "user_id") == brute(*factors, 500)
    few = top_items_by_type(model, catalog, ["TV", "Opera"], 500, 1)
    known = set(factors[1])
    tv = {r["ID"] for r in catalog.where("Type = 'TV'").collect()} & known
    assert {r["item_id"] for r in few.collect()} == tv


def flat_model(spark, items):
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], FACTORS)
    table = spark.createDataFrame(items, FACTORS)
    return FactorModel(users, table, 2, 2, len(items), AlsParams(rank=2))


def test_equal_scores_go_by_id(spark, cut):
    tied = flat_model(spark, [(i, [1.0 if i % 2 else 0.5, 3.0]) for i in range(40, 0, -1)])
    found = lists(top_items(tied, 6), "user_id")
    assert found[(1,)] == [1, 3, 5, 7, 9, 11]
    assert found[(2,)] == [1, 2, 3, 4, 5, 6]


def test_long_list_then_filter(model, factors, catalog):
    users, items = factors
    kinds = {r["ID"]: r["Type"] for r in catalog.collect()}
    exact = top_items_by_type(model, catalog, ["TV", "Movie"], 5)
    long = top_items_by_type(model, catalog, ["TV", "Movie"], 5, candidate_k=100)
    assert lists(long, "user_id", "Type") == lists(exact, "user_id", "Type")
    short = lists(top_items_by_type(model, catalog, ["TV"], 5, candidate_k=6), "user_id")
    for (user,), entries in brute(users, items, 6).items():
        assert short.get((user,), []) == [i for i in entries if kinds[i] == "TV"][:5]


def test_first_of_each_list_ranks_by_score_then_item(spark):
    scored = spark.createDataFrame(
        [(1, 9, "TV", 2.0), (1, 8, "TV", 2.0), (1, 7, "TV", 3.0), (1, 6, "Movie", 1.0)],
        "user_id int, item_id int, Type string, score double",
    )
    assert lists(first_per_list(scored, 2), "user_id", "Type") == {(1, "TV"): [7, 8], (1, "Movie"): [6]}


def test_arrays_have_the_library_shape_and_flatten_back(model):
    flat = top_items(model, 5)
    arrays = as_arrays(flat)
    assert arrays.dtypes == model.als_model.recommendForAllUsers(5).dtypes
    again = flatten_lists(arrays)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, flat.collect()))


def test_no_row_per_pair_and_no_cross_join(model, catalog, monkeypatch):
    for limit in (sizes.BROADCAST_BYTES, 0):
        monkeypatch.setattr(sizes, "BROADCAST_BYTES", limit)
        plan = top_items_by_type(model, catalog, ["TV"], 5)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        # With broadcast candidates a list is finished where its source is.
        assert ("WindowGroupLimit" in plan) == (limit == 0)
    monkeypatch.setattr(score, "SOURCE_BLOCK", 7)
    plan = top_items(model, 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_narrow_types_share_full_blocks(spark, monkeypatch):
    """Three hundred types of ten items and one wide one: few blocks, and the lists of brute force."""
    monkeypatch.setattr(score, "CANDIDATE_BLOCK", 1000)
    sizes = {f"t{k}": 10 for k in range(300)} | {"wide": 2500}
    places = score._segment_blocks(sizes)
    assert places["wide"] == (0, 3)
    assert {first for name, (first, own) in places.items() if name != "wide"} == {3, 4, 5}

    rng = np.random.default_rng(3)
    names = [name for name, n in sizes.items() for _ in range(n)]
    vectors = rng.normal(size=(len(names), 4)).astype(np.float32)
    users = rng.normal(size=(7, 4)).astype(np.float32)
    candidates = spark.createDataFrame(
        [(i, name, v.tolist()) for i, (name, v) in enumerate(zip(names, vectors))],
        "id int, segment string, features array<float>",
    )
    sources = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], "id int, features array<float>")
    seen = [(u, i) for u in range(7) for i in range(u, len(names), 3)]
    exclude = spark.createDataFrame(seen, "source_id int, candidate_id int")
    for limit in (None, 0):
        for pairs, table in (((), None), (seen, exclude)):
            found = score.best_candidates(sources, candidates, 3, 4, 7, len(names), table, limit)
            got = {(r["source_id"], r["segment"], r["rank"], r["candidate_id"]) for r in found.collect()}
            gone, expected = set(pairs), set()
            for u in range(7):
                lists = {}
                for i in np.argsort(-(vectors.astype(float) @ users[u].astype(float)), kind="stable").tolist():
                    own = lists.setdefault(names[i], [])
                    if (u, i) not in gone and len(own) < 3:
                        own.append(i)
                expected |= {(u, n, r + 1, i) for n, own in lists.items() for r, i in enumerate(own)}
            assert got == expected


def test_repeated_catalog_rows_list_an_item_once(model, catalog):
    plain = {tuple(r) for r in top_items_by_type(model, catalog, ["TV"], 4).collect()}
    twice = top_items_by_type(model, catalog.unionByName(catalog), ["TV"], 4).collect()
    assert len(twice) == len(plain) and {tuple(r) for r in twice} == plain


def test_broadcast_lists_need_no_exchange_after_the_blocks(model, ratings):
    for table in (top_items(model, 3), top_items(model, 3, exclude_seen=ratings)):
        text = table._jdf.queryExecution().sparkPlan().toString()
        above = table._jdf.queryExecution().executedPlan().toString().split("Generate", 1)[0]
        assert "Window" not in text and "Exchange" not in above.replace("BroadcastExchange", "")
