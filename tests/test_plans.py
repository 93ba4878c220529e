from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ranksmith import storage
from ranksmith.operators import merge_ratings, top_items_by_type
from ranksmith.plans import global_lists, segment_lists, titled_lists, write_global_lists
from ranksmith.sources import (
    read_catalog,
    read_rating_lines,
    read_ratings,
    read_title_lookup,
    read_user_ratings,
)


@pytest.fixture(scope="module")
def files(tmp_path_factory, ratings, catalog):
    """The tables as the files a user has: catalog, all ratings, one user's ratings."""
    folder = tmp_path_factory.mktemp("files")
    lines = ["ID,Name,English name,Japanese name,Type"]
    for r in catalog.collect():
        lines.append(f'{r["ID"]},"Title ""{r["ID"]}"", the","T, {r["ID"]}",{r["Japanese name"]},{r["Type"] or ""}')
    (folder / "catalog.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    rated = [tuple(r) for r in ratings.collect()]
    text = "".join(f"{u},{i},{int(v)}\n" for u, i, v in rated)
    (folder / "ratings.csv").write_text("user_id,anime_id,rating\n" + text)
    own = [(i, v) for u, i, v in rated if u == 3]
    (folder / "one.csv").write_text("\n".join(f"666666,{i},{int(v)} " for i, v in own))
    text = "".join(f"{u},{i},{v / 2},1260759144\n" for u, i, v in rated)
    (folder / "lines.csv").write_text("userId,movieId,rating,timestamp\n" + text)
    text = "".join(f'{r["ID"]},"Title, The {r["ID"]} (1995)",Drama\n' for r in catalog.collect())
    (folder / "movies.csv").write_text("movieId,title,genres\n" + text)
    return folder


def test_global_lists_from_files(spark, files):
    catalog = read_catalog(spark, str(files / "catalog.csv"))
    rated = merge_ratings(
        read_ratings(spark, str(files / "ratings.csv")), read_user_ratings(spark, str(files / "one.csv"))
    )
    media = catalog.where("ID % 2 = 0").select(
        F.col("ID").alias("item_id"), F.lit("http://i").alias("image_url"), F.lit("http://t").alias("trailer_url")
    )
    result = global_lists(rated, catalog, 666666, media=media, keep_copy=True)
    found = result.lists.collect()
    assert {(r["user_id"], r["Type"], r["rank"]) for r in found} == {
        (666666, t, k) for t in ("TV", "Movie") for k in range(1, 6)
    }
    for r in found:
        assert r["Name"] == f'Title "{r["item_id"]}", the'
        assert r["Japanese name"] == f'題名 {r["item_id"]}'
        assert (r["trailer_url"] is None) == (r["item_id"] % 2 == 1)
    exact = top_items_by_type(result.model, catalog, ["TV", "Movie"], 5, 666666)
    keys = ("Type", "rank", "item_id")
    assert {tuple(r[k] for k in keys) for r in exact.collect()} == {tuple(r[k] for k in keys) for r in found}
    report = result.holdout.first()
    assert report["n_test"] == report["n_scored"] + report["n_dropped"] > 0
    assert 0 < report["rmse"] < 5


def test_global_lists_options(ratings, catalog):
    result = global_lists(
        ratings, catalog, [1, 2], types=["TV"], n=3, titles=["Name"], duplicates="mean", exclude_seen=True
    )
    found = result.lists
    assert found.columns == ["item_id", "user_id", "Type", "rank", "score", "Name"]
    assert found.join(ratings, ["user_id", "item_id"], "left_semi").count() == 0
    assert found.groupBy("user_id").count().where("count <= 3").count() == 2


def test_segment_lists(ratings, catalog):
    lists, reports = segment_lists(ratings, catalog, [3, 4, -1], ["Movie", "TV", "Opera"], 4)
    found = lists.collect()
    assert {(r["user_id"], r["Type"]) for r in found} == {(u, t) for u in (3, 4) for t in ("Movie", "TV")}
    kinds = {r["ID"]: r["Type"] for r in catalog.collect()}
    assert all(kinds[r["item_id"]] == r["Type"] for r in found)
    assert sorted(r["rank"] for r in found) == sorted([1, 2, 3, 4] * 4)
    assert {r["Type"] for r in reports.collect()} == {"Movie", "TV"}


def test_segments_nobody_rated(ratings, catalog):
    lists, reports = segment_lists(ratings, catalog, 3, ["Opera"])
    full, full_reports = segment_lists(ratings, catalog, 3, ["TV"])
    assert lists.count() == reports.count() == 0
    assert lists.columns == full.columns and reports.columns == full_reports.columns


def test_users_from_a_generator_reach_every_segment(ratings, catalog):
    lists, _ = segment_lists(ratings, catalog, iter([3, 4]), ["Movie", "TV"], 2)
    assert {(r["user_id"], r["Type"]) for r in lists.collect()} == {(u, t) for u in (3, 4) for t in ("Movie", "TV")}


def test_nothing_is_left_behind_after_close(spark, ratings, catalog):
    users = spark.createDataFrame([(3,), (4,)], "user_id int")
    results = [
        global_lists(ratings, catalog, users, keep_copy=True),
        segment_lists(ratings, catalog, users, ["TV"]),
        titled_lists(ratings, catalog.select(F.col("ID").alias("item_id"), F.col("Name").alias("title")), keep_copy=True),
    ]
    root = Path(storage.shared_dir(spark).removeprefix("file:")) / "ranksmith"
    before = set(root.iterdir())
    for result in results:
        folder = Path(result.folder.removeprefix("file:"))
        assert any(folder.iterdir())
        with result:
            assert result.lists.count() > 0
        assert not folder.exists()
    assert set(root.iterdir()) <= before


def test_lists_to_files(spark, ratings, catalog, tmp_path):
    media = catalog.where("ID % 2 = 0").select(
        F.col("ID").alias("item_id"), F.lit("http://i").alias("image_url"), F.lit("http://t").alias("trailer_url")
    )
    with global_lists(ratings, catalog, [1, 2], n=3, media=media) as result:
        write_global_lists(result.lists, str(tmp_path / "text"), str(tmp_path / "markup"))
        wanted = {(r["user_id"], r["Type"], r["rank"], r["item_id"]) for r in result.lists.collect()}
    text = spark.read.csv(str(tmp_path / "text"), header=True, inferSchema=True, escape='"')
    markup = spark.read.json(str(tmp_path / "markup"))
    for found in (text, markup):
        assert {(r["user_id"], r["Type"], r["rank"], r["ID"]) for r in found.collect()} == wanted
    assert {r["Image"] for r in text.collect()} <= {"http://i", "None"}
    assert all(r["Image"].startswith("<img") for r in markup.collect())


def test_titled_lists_from_files(spark, files):
    rated = read_rating_lines(spark, str(files / "lines.csv"))
    lookup = read_title_lookup(spark, str(files / "movies.csv"))
    found = titled_lists(rated, lookup).lists.collect()
    assert {(r["user_id"], r["rank"]) for r in found} == {(u, k) for u in (0, 1, 2) for k in range(1, 11)}
    assert all(r["title"] == f'Title, The {r["item_id"]} (1995)' for r in found)
