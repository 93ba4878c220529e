import pytest

from ranksmith.functions import instant, strip_literal
from ranksmith.operators import (
    markup_cells,
    output_columns,
    text_cells,
    with_lookup_title,
    with_media,
    with_titles,
)
from ranksmith.sinks import write_lists
from pyspark.sql import functions as F

SUFFIX = "?enablejsapi=1&wmode=opaque&autoplay=1"


@pytest.fixture(scope="module")
def lists(spark):
    return spark.createDataFrame(
        [(1, "TV", 1, 10, 9.5), (1, "TV", 2, 11, 9.0), (1, "Movie", 1, 12, 8.0), (1, "Movie", 2, 99, 7.0)],
        "user_id int, Type string, rank int, item_id int, score double",
    )


@pytest.fixture(scope="module")
def media(spark):
    return spark.createDataFrame(
        [(10, "http://i/10.jpg", "http://t/10" + SUFFIX), (11, "http://i/11.jpg", None)],
        "item_id int, image_url string, trailer_url string",
    )


@pytest.fixture(scope="module")
def named(spark):
    return spark.createDataFrame(
        [(10, 'The "Ten", again', "十"), (11, "Elf, the", "ö"), (12, "Twelve", None)],
        "ID int, Name string, `Japanese name` string",
    )


def test_titles_keep_rank_and_unmatched_items(lists, named):
    found = {r["item_id"]: r for r in with_titles(lists, named).collect()}
    assert found[10]["Name"] == 'The "Ten", again' and found[10]["rank"] == 1
    assert found[99]["Name"] is None and found[99]["score"] == 7.0
    assert with_titles(lists, named, ["Name"]).columns[-1] == "Name"


def test_lookup_title(spark, lists):
    lookup = spark.createDataFrame([(12, "Twelve (1995)")], "item_id int, title string")
    found = {r["item_id"]: r["title"] for r in with_lookup_title(lists, lookup).collect()}
    assert found == {10: None, 11: None, 12: "Twelve (1995)", 99: None}


def test_text_and_markup_cells(lists, media):
    linked = with_media(lists, media)
    text = {r["item_id"]: (r["Image"], r["Trailer"]) for r in text_cells(linked).collect()}
    assert text[10] == ("http://i/10.jpg", "http://t/10")
    assert text[11] == ("http://i/11.jpg", "None")
    assert text[99] == ("None", "None")
    cells = {r["item_id"]: (r["Image"], r["Trailer"]) for r in markup_cells(linked).collect()}
    assert cells[10] == (
        '<img src="http://i/10.jpg" />',
        '<iframe height="318" width="565.33" src="http://t/10"></iframe>',
    )
    assert cells[11] == ('<img src="http://i/11.jpg" />', "<p>Trailer no encontrado</p>")


def test_suffix_is_plain_text(spark):
    texts = spark.createDataFrame([("a?b" ,), ("aab",), ("ab",), (None,)], "v string")
    found = [r[0] for r in texts.select(strip_literal(F.col("v"), "a?")).collect()]
    assert found == ["b", "aab", "ab", None]


def test_output_columns(lists, named, media):
    finished = output_columns(text_cells(with_media(with_titles(lists, named), media)))
    assert finished.columns == [
        "user_id", "rank", "ID", "Name", "Japanese name", "Type", "Image", "Trailer"
    ]
    first = finished.where("ID = 10").first()
    assert tuple(first) == (1, 1, 10, 'The "Ten", again', "十", "TV", "http://i/10.jpg", "http://t/10")


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_instant_does_not_depend_on_the_session_zone(spark, zone):
    from ranksmith.workload.queries import QUERIES

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        found = [sorted(map(tuple, QUERIES["epoch_instant"](spark, "/root/testdata/sf0.001").collect()))]
        spark.conf.set("spark.sql.session.timeZone", zone)
        found.append(sorted(map(tuple, QUERIES["epoch_instant"](spark, "/root/testdata/sf0.001").collect())))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert found[0] == found[1]


def test_epoch_seconds(spark):
    found = spark.createDataFrame([(0,), (1260759144,)], "s bigint").select(
        instant(F.col("s")).cast("string")
    )
    assert [r[0] for r in found.collect()] == ["1970-01-01 00:00:00", "2009-12-14 02:52:24"]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_lists_survive_the_disk(spark, lists, named, media, tmp_path, fmt):
    finished = markup_cells(with_media(with_titles(lists, named), media))
    path = str(tmp_path / "lists")
    write_lists(finished, path, fmt)
    assert (tmp_path / "lists" / "Type=TV").is_dir() and (tmp_path / "lists" / "Type=Movie").is_dir()
    reader = spark.read.schema(finished.schema)
    if fmt == "csv":
        kept = [f for f in finished.schema.fields if f.name != "Type"]
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", Type string"
        reader = spark.read.schema(ddl).options(header=True, escape='"', encoding="UTF-8")
    back = reader.format(fmt).load(path).select(*[f"`{c}`" for c in finished.columns])
    assert sorted(map(repr, back.collect())) == sorted(map(repr, finished.collect()))


def test_files_are_in_list_order(spark, tmp_path):
    rows = [(u, "TV", r, 100 + r, 1.0) for r in range(20, 0, -1) for u in (2, 1)]
    table = spark.createDataFrame(rows, "user_id int, Type string, rank int, item_id int, score double")
    write_lists(table.repartition(6), str(tmp_path / "out"))
    (file,) = (tmp_path / "out" / "Type=TV").glob("*.csv")
    lines = file.read_text().splitlines()
    assert lines[0] == "user_id,rank,item_id,score"
    keys = [tuple(map(int, line.split(",")[:2])) for line in lines[1:]]
    assert keys == sorted(keys) and len(keys) == 40
