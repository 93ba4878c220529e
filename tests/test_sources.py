import pytest

from ranksmith.sources import (
    parse_rating_lines,
    read_catalog,
    read_rating_lines,
    read_ratings,
    read_title_lookup,
    read_user_ratings,
)


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_catalog_titles_with_commas_quotes_and_other_scripts(spark, tmp_path):
    path = write(
        tmp_path / "catalog.csv",
        "ID,Episodes,Name,Japanese name,Type\n"
        '1,12,"One, Two",題名,TV\n'
        '2,1,"Say ""hi"", friend",„Gänse“,Movie\n'
        "3,,Plain,,\n",
    )
    catalog = read_catalog(spark, path)
    assert dict(catalog.dtypes)["ID"] == "int"
    assert rows(catalog.select("ID", "Name", "Japanese name", "Type")) == [
        (1, "One, Two", "題名", "TV"),
        (2, 'Say "hi", friend', "„Gänse“", "Movie"),
        (3, "Plain", None, None),
    ]


def test_catalog_columns_are_found_by_name(spark, tmp_path):
    path = write(tmp_path / "catalog.csv", "Type,Name,ID\nTV,A,7\n")
    assert rows(read_catalog(spark, path).select("ID", "Name", "Type")) == [(7, "A", "TV")]


def test_catalog_with_a_broken_id_fails(spark, tmp_path):
    path = write(tmp_path / "catalog.csv", "ID,Name\nseven,A\n")
    with pytest.raises(Exception, match="not a valid int: seven"):
        read_catalog(spark, path).collect()


def test_ratings_with_header(spark, tmp_path):
    path = write(tmp_path / "r.csv", "user_id,anime_id,rating\n1,20,9\n2,30,0\n")
    ratings = read_ratings(spark, path)
    assert ratings.dtypes == [("user_id", "int"), ("item_id", "int"), ("rating", "double")]
    assert rows(ratings) == [(1, 20, 9.0), (2, 30, 0.0)]


def test_ratings_with_timestamps_and_other_names(spark, tmp_path):
    path = write(tmp_path / "r.csv", "userId,movieId,rating,timestamp\n1,31,2.5,1260759144\n")
    ratings = read_ratings(spark, path, "userId", "movieId", "rating", "timestamp")
    assert rows(ratings) == [(1, 31, 2.5, 1260759144)]


def test_ratings_with_another_header_fail(spark, tmp_path):
    path = write(tmp_path / "r.csv", "anime_id,user_id,rating\n20,1,9\n")
    with pytest.raises(Exception):
        read_ratings(spark, path).collect()


@pytest.mark.parametrize("value", ["nine", "3000000000"])
def test_ratings_that_do_not_parse_fail(spark, tmp_path, value):
    path = write(tmp_path / "r.csv", f"user_id,anime_id,rating\n1,{value},9\n")
    with pytest.raises(Exception):
        read_ratings(spark, path).collect()


def test_user_ratings_keep_the_first_row_and_trim_blanks(spark, tmp_path):
    path = write(tmp_path / "u.csv", "666666,20,8\n666666,21,7 \n666666,22, 9")
    assert rows(read_user_ratings(spark, path)) == [
        (666666, 20, 8.0),
        (666666, 21, 7.0),
        (666666, 22, 9.0),
    ]


def test_rating_lines_of_several_files_each_with_a_header(spark, tmp_path):
    write(tmp_path / "a.csv", "userId,movieId,rating,timestamp\n1,31, 2.5 ,1260759144\n")
    write(tmp_path / "b.csv", "userId,movieId,rating,timestamp\n2,32,4,1260759145,more\n")
    ratings = read_rating_lines(spark, str(tmp_path))
    assert [t for _, t in ratings.dtypes] == ["int", "int", "double", "bigint"]
    assert sorted(rows(ratings)) == [(1, 31, 2.5, 1260759144), (2, 32, 4.0, 1260759145)]


@pytest.mark.parametrize("line", ["1,x,2.5,3", "1,2,3", "1,2.0,3,4", ""])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_broken_rating_lines_fail(spark, line, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        lines = spark.createDataFrame([(line,)], "value string")
        with pytest.raises(Exception, match="not a valid"):
            parse_rating_lines(lines).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_title_lookup_with_quoted_commas(spark, tmp_path):
    path = write(
        tmp_path / "movies.csv",
        'movieId,title,genres\n1,Toy (1995),Comedy|Drama\n11,"President, The (1995)",Drama\n',
    )
    assert rows(read_title_lookup(spark, path)) == [(1, "Toy (1995)"), (11, "President, The (1995)")]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_wide_parquet_ids_fail_instead_of_wrapping(spark, tmp_path, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        path = str(tmp_path / ansi)
        rows = [(5, 1, 3.0), (None, 2, 4.0)]
        spark.createDataFrame(rows, "user_id bigint, item_id bigint, rating double").write.parquet(path)
        assert {tuple(r) for r in read_ratings(spark, path, item="item_id", fmt="parquet").collect()} == set(rows)
        wide = spark.createDataFrame([(2**32 + 5, 1, 3.0)], "user_id bigint, item_id bigint, rating double")
        wide.write.mode("append").parquet(path)
        with pytest.raises(Exception, match="not a valid int"):
            read_ratings(spark, path, item="item_id", fmt="parquet").collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_null_and_broken_lines_raise(spark):
    good = "1,2,3.5,100"
    for bad in (None, "", "1,2,3.5", "userIdX,2,3.5,100", "x,2,3.5,100"):
        lines = spark.createDataFrame([(good,), (bad,)], "value string")
        with pytest.raises(Exception, match="not a valid"):
            parse_rating_lines(lines).collect()
    lines = spark.createDataFrame([(good,), (" userId ,movieId,rating,timestamp",), ("userId",)], "value string")
    assert [tuple(r) for r in parse_rating_lines(lines).collect()] == [(1, 2, 3.5, 100)]
