"""One query per operator. Each reads the given tables whole."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ranksmith.columns import ITEM, PREDICTION, RANK, RATING, SCORE, TS, TYPE, USER
from ranksmith.functions import instant
from ranksmith.functions.cells import (
    IMAGE_CLOSE,
    IMAGE_OPEN,
    MISSING_TEXT,
    TRAILER_CLOSE,
    TRAILER_MISSING,
    TRAILER_OPEN,
)
from ranksmith.operators import (
    GLOBAL,
    SEGMENT,
    AlsParams,
    FactorModel,
    als_estimator,
    as_arrays,
    catalog_items,
    coldstart_report,
    distinct_ids,
    first_per_list,
    fit_als,
    fit_als_per_segment,
    flatten_lists,
    hash_split,
    in_training,
    markup_cells,
    merge_ratings,
    of_type,
    output_columns,
    predict,
    profile_ratings,
    random_split,
    resolve_duplicates,
    rmse,
    target_users,
    text_cells,
    top_items,
    top_items_by_type,
    top_users,
    with_item_type,
    with_lookup_title,
    with_media,
    with_titles,
)
from ranksmith.operators.sizes import BROADCAST_SETTING
from ranksmith.plans import global_lists, segment_lists, titled_lists, write_global_lists
from ranksmith.sinks import write_lists
from ranksmith.sources import (
    catalog_from_text,
    parse_rating_lines,
    read_catalog,
    read_rating_lines,
    read_ratings,
    read_title_lookup,
    read_user_ratings,
)
from ranksmith.storage import scratch_path, shared_dir, written
from ranksmith.workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    """Register a query; integers leave as bigint and floats as double, like the oracle's."""

    def widened(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        wide = {"int": "bigint", "float": "double"}
        return df.select(*[F.col(f"`{n}`").cast(wide.get(kind, kind)) for n, kind in df.dtypes])

    QUERIES[run.__name__] = widened
    return run


# Sources


@query
def ratings_view(spark, sf):
    return t.ratings(spark, sf)


@query
def ratings_csv_scan(spark, sf):
    path = scratch_path(spark, "ratings")
    named = t.triples(spark, sf).withColumnRenamed(ITEM, "anime_id")
    named.write.csv(path, header=True)
    return read_ratings(spark, path)


@query
def ratings_parquet_scan(spark, sf):
    path = scratch_path(spark, "ratings")
    t.ratings(spark, sf).write.parquet(path)
    return read_ratings(spark, path, item=ITEM, ts=TS, fmt="parquet")


@query
def user_ratings_csv_scan(spark, sf):
    path = scratch_path(spark, "user-ratings")
    rating = F.concat(F.lit(" "), F.col(RATING).cast("int").cast("string"), F.lit(" "))
    spaced = t.triples(spark, sf).withColumn(RATING, rating)
    spaced.write.csv(
        path, header=False, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return read_user_ratings(spark, path)


@query
def catalog_csv_scan(spark, sf):
    path = scratch_path(spark, "catalog")
    quoted = F.concat(F.lit('"'), F.col("Name"), F.lit('", お, '), F.col(t.ALT_TITLE))
    t.catalog(spark, sf).withColumn("Name", quoted).write.csv(
        path, header=True, quote='"', escape='"', encoding="UTF-8"
    )
    return read_catalog(spark, path).select("ID", "Name", TYPE)


@query
def parse_catalog_csv(spark, sf):
    schema = StructType(
        [
            StructField("ID", IntegerType()),
            StructField("Name", StringType()),
            StructField("Type", StringType()),
        ]
    )
    doubled = F.concat(F.lit('"say ""'), F.col("Name"), F.lit('"", '), F.col(t.ALT_TITLE), F.lit('"'))
    lines = t.catalog(spark, sf).select(F.concat_ws(",", "ID", doubled, "Type").alias("value"))
    return catalog_from_text(lines, schema)


def _rating_lines(spark, sf) -> DataFrame:
    lines = t.ratings(spark, sf).select(F.concat_ws(",", USER, ITEM, RATING, TS).alias("value"))
    header = lines.sparkSession.range(1).select(F.lit("userId,movieId,rating,timestamp").alias("value"))
    return header.unionByName(lines)


@query
def parse_rating_text(spark, sf):
    return parse_rating_lines(_rating_lines(spark, sf))


@query
def rating_lines_scan(spark, sf):
    path = scratch_path(spark, "lines")
    _rating_lines(spark, sf).write.text(path)
    return read_rating_lines(spark, path)


def _remote(spark, label: str) -> str:
    """A new path that only Spark's readers and writers can open: the shared folder, mounted in a store of its own."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    local = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    spark.conf.set("fs.viewfs.mounttable.ranksmith.link./shared", local)
    return scratch_path(spark, label).replace(shared_dir(spark).rstrip("/"), "viewfs://ranksmith/shared", 1)


@query
def remote_ratings_scan(spark, sf):
    path = _remote(spark, "ratings")
    named = t.triples(spark, sf).withColumnRenamed(ITEM, "anime_id")
    named.write.csv(path, header=True)
    return read_ratings(spark, path)


@query
def remote_catalog_scan(spark, sf):
    path = _remote(spark, "catalog")
    t.catalog(spark, sf).write.csv(path, header=True, quote='"', escape='"', encoding="UTF-8")
    return read_catalog(spark, path).select("ID", "Name", TYPE)


@query
def title_lookup_scan(spark, sf):
    path = scratch_path(spark, "movies")
    title = F.concat(F.col("Name"), F.lit(", The "), F.col(t.ALT_TITLE)).alias("title")
    movies = t.catalog(spark, sf).select(F.col("ID").alias("movieId"), title, F.col(TYPE).alias("genres"))
    movies.write.csv(path, header=True, quote='"', escape='"')
    return read_title_lookup(spark, path)


# Projections, filters, set operations, limits


@query
def catalog_projection(spark, sf):
    return t.catalog(spark, sf).select("ID", *t.TITLES, TYPE).drop("Anime_ID")


@query
def dropped_columns(spark, sf):
    """Ids without titles join the catalog; of the columns dropped one is there and one is not."""
    wanted = t.triples(spark, sf).select((F.col(ITEM) * 2).alias("Anime_ID"), USER)
    listed = wanted.join(t.catalog(spark, sf), F.col("Anime_ID") == F.col("ID"), "left")
    return listed.drop("Anime_ID", "not there")


@query
def ratings_with_type(spark, sf):
    return with_item_type(t.triples(spark, sf), t.catalog(spark, sf))


@query
def type_filter(spark, sf):
    return of_type(t.catalog(spark, sf), t.SERIES)


@query
def user_filter(spark, sf):
    return target_users(t.ratings(spark, sf), t.TARGET)


def _members(spark, sf) -> DataFrame:
    members = t.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING")
    return members.select(F.col("c_custkey").cast("int").alias(USER))


@query
def user_table_filter(spark, sf):
    return target_users(t.triples(spark, sf), _members(spark, sf))


@query
def items_isin(spark, sf):
    liked = target_users(t.triples(spark, sf), t.TARGET).where(F.col(RATING) >= 8)
    return catalog_items(t.catalog(spark, sf), liked.select(F.col(ITEM).alias("ID")))


@query
def distinct_users(spark, sf):
    return distinct_ids(t.triples(spark, sf), als_estimator(GLOBAL).getUserCol())


@query
def first_users(spark, sf):
    return distinct_ids(t.triples(spark, sf), USER, 3)


@query
def merged_ratings(spark, sf):
    return merge_ratings(t.triples(spark, sf), t.one_user(spark, sf))


@query
def duplicates_latest(spark, sf):
    return resolve_duplicates(t.ratings(spark, sf), "latest")


@query
def duplicates_mean(spark, sf):
    return resolve_duplicates(t.triples(spark, sf), "mean")


@query
def rating_counts(spark, sf):
    found = asdict(profile_ratings(t.triples(spark, sf)))
    return spark.createDataFrame([tuple(found.values())], list(found))


def _scored(spark, sf) -> DataFrame:
    """Mean ratings stand in for scores, so that list operators have an exact answer."""
    mean = resolve_duplicates(t.triples(spark, sf), "mean")
    return with_item_type(mean, t.catalog(spark, sf)).withColumnRenamed(RATING, SCORE)


@query
def first_of_each_list(spark, sf):
    return first_per_list(_scored(spark, sf), 5)


@query
def flattened_lists(spark, sf):
    order = Window.partitionBy(USER).orderBy(F.desc(SCORE), F.asc(ITEM))
    ranked = _scored(spark, sf).withColumn(RANK, F.row_number().over(order))
    return flatten_lists(as_arrays(ranked.where(F.col(RANK) <= 10)))


# Joins and enrichment


@query
def catalog_left_join(spark, sf):
    shifted = t.triples(spark, sf).select(USER, (F.col(ITEM) * 2).alias(ITEM), RATING)
    return with_titles(shifted, t.catalog(spark, sf), [*t.TITLES, TYPE])


@query
def title_lookup(spark, sf):
    lookup = t.catalog(spark, sf).select(F.col("ID").alias(ITEM), F.col("Name").alias("title"))
    return with_lookup_title(t.triples(spark, sf), lookup)


def _media_lists(spark, sf) -> DataFrame:
    items = t.catalog(spark, sf).select(F.col("ID").alias(ITEM), "Name", TYPE)
    return with_media(items, t.media(spark, sf), t.URL_SUFFIX)


@query
def media_text(spark, sf):
    return text_cells(_media_lists(spark, sf))


@query
def media_cells(spark, sf):
    return markup_cells(_media_lists(spark, sf))


@query
def epoch_instant(spark, sf):
    utc = F.to_utc_timestamp(instant(F.col(TS)), F.current_timezone())
    return t.ratings(spark, sf).select(
        USER, ITEM, TS, F.date_format(utc, "yyyy-MM-dd HH:mm:ss").alias("instant")
    )


def _finished_lists(spark, sf, cells) -> DataFrame:
    lists = with_titles(first_per_list(_scored(spark, sf), 5), t.catalog(spark, sf), t.TITLES)
    return output_columns(cells(with_media(lists, t.media(spark, sf), t.URL_SUFFIX)), t.TITLES)


_FINISHED = (
    f"{USER} int, {RANK} int, ID int, Name string, `{t.ALT_TITLE}` string, "
    f"Image string, Trailer string, {TYPE} string"
)


@query
def text_list_sink(spark, sf):
    path = scratch_path(spark, "lists")
    write_lists(_finished_lists(spark, sf, text_cells), path)
    return spark.read.schema(_FINISHED).csv(path, header=True, escape='"', encoding="UTF-8")


@query
def remote_list_sink(spark, sf):
    path = _remote(spark, "lists")
    write_lists(_finished_lists(spark, sf, text_cells), path)
    return spark.read.schema(_FINISHED).csv(path, header=True, escape='"', encoding="UTF-8")


@query
def markup_list_sink(spark, sf):
    path = scratch_path(spark, "lists")
    write_lists(_finished_lists(spark, sf, markup_cells), path, fmt="json")
    return spark.read.schema(_FINISHED).json(path)


# Split and evaluation


@query
def split_rows(spark, sf):
    return t.triples(spark, sf).withColumn("in_training", in_training())


@query
def random_split_rows(spark, sf):
    """Both parts of a random split, put together again."""
    training, test = random_split(t.triples(spark, sf))
    return training.unionByName(test)


@query
def rmse_constant(spark, sf):
    guess = t.triples(spark, sf).withColumn(PREDICTION, F.lit(5.0))
    return rmse(guess).withColumn("rmse", F.round("rmse", 6))


@query
def rmse_constant_by_type(spark, sf):
    guess = with_item_type(t.triples(spark, sf), t.catalog(spark, sf)).withColumn(PREDICTION, F.lit(5.0))
    return rmse(guess, TYPE).withColumn("rmse", F.round("rmse", 6))


# Scoring and solving with factors made from the tables' own columns. Whole numbers in
# floats make every score exact, and plenty of ties, so SQL has the same answer.


def _given_users(spark, sf, cold: str | None = None) -> DataFrame:
    """All customers; ``cold`` names a market segment whose customers have no factors."""
    key = F.col("c_custkey")
    features = F.array(1 + key % 5, F.col("c_nationkey") % 7, F.floor(key / 3) % 4)
    known = t.table(spark, sf, "customer")
    if cold is not None:
        known = known.where(F.col("c_mktsegment") != cold)
    return known.select(key.cast("int").alias("id"), features.cast("array<float>").alias("features"))


def _given_items(spark, sf) -> DataFrame:
    key = F.col("p_partkey")
    features = F.array(F.col("p_size") % 10, 1 + key % 6, 3 - key % 4)
    return t.table(spark, sf, "part").select(
        key.cast("int").alias("id"), features.cast("array<float>").alias("features")
    )


def _given_model(spark, sf, cold: str | None = None) -> FactorModel:
    users, items = _given_users(spark, sf, cold), _given_items(spark, sf)
    return FactorModel(users, items, 3, users.count(), items.count(), AlsParams(rank=3))


@query
def scored_items_per_user(spark, sf):
    return top_items(_given_model(spark, sf), 10)


@query
def scored_users_per_item(spark, sf):
    return top_users(_given_model(spark, sf), 10)


@contextmanager
def _nothing_small(spark):
    """No table counts as small enough to be broadcast whole while a plan is made."""
    before = spark.conf.get(BROADCAST_SETTING, None)
    spark.conf.set(BROADCAST_SETTING, "0")
    try:
        yield
    finally:
        spark.conf.unset(BROADCAST_SETTING) if before is None else spark.conf.set(BROADCAST_SETTING, before)


@query
def scored_items_per_user_in_tiles(spark, sf):
    """Both factor tables are cut into tiles that meet in a shuffled join."""
    with _nothing_small(spark):
        return top_items(_given_model(spark, sf), 10)


@query
def scored_users_per_item_in_tiles(spark, sf):
    with _nothing_small(spark):
        return top_users(_given_model(spark, sf), 10)


@query
def scored_unseen_by_type_in_tiles(spark, sf):
    """As ``scored_unseen_by_type``; the pairs to leave out follow their tiles."""
    with _nothing_small(spark):
        return top_items_by_type(
            _given_model(spark, sf), t.catalog(spark, sf), t.TYPES, 5, exclude_seen=t.triples(spark, sf)
        )


@query
def predicted_ratings_shuffled(spark, sf):
    """Both factor tables meet the ratings by shuffle."""
    with _nothing_small(spark):
        return predict(_given_model(spark, sf), t.triples(spark, sf))


@query
def scored_unseen_items_per_user(spark, sf):
    return top_items(_given_model(spark, sf), 10, exclude_seen=t.triples(spark, sf))


@query
def scored_items_of_members(spark, sf):
    """The users wanted come from a table; the fifth of them that is in one market segment has no factors."""
    rich = t.table(spark, sf, "customer").where(F.col("c_acctbal") > 5000)
    return top_items(_given_model(spark, sf, cold="BUILDING"), 5, rich.select(F.col("c_custkey").alias(USER)))


@query
def scored_items_by_type(spark, sf):
    return top_items_by_type(_given_model(spark, sf), t.catalog(spark, sf), t.TYPES, 5)


@query
def scored_unseen_by_type(spark, sf):
    return top_items_by_type(
        _given_model(spark, sf), t.catalog(spark, sf), t.TYPES, 5, exclude_seen=t.triples(spark, sf)
    )


@query
def scored_candidates_by_type(spark, sf):
    return top_items_by_type(
        _given_model(spark, sf), t.catalog(spark, sf), t.TYPES, 5, candidate_k=100
    )


@query
def predicted_ratings(spark, sf):
    return predict(_given_model(spark, sf), t.triples(spark, sf))


@query
def predicted_holdout(spark, sf):
    """Customers of one market segment are cold."""
    report = coldstart_report(_given_model(spark, sf, cold="BUILDING"), t.triples(spark, sf))
    return report.withColumn("rmse", F.round("rmse", 6))


@query
def solved_users(spark, sf):
    """The least-squares factor of every user for a single given factor per item."""
    items = _given_items(spark, sf).select(F.col("id").alias(ITEM), F.col("features")[1].cast("double").alias("v"))
    sums = t.triples(spark, sf).join(items, ITEM).groupBy(USER).agg(
        F.sum(F.col(RATING) * F.col("v")).alias("right"),
        (F.sum(F.col("v") * F.col("v")) + GLOBAL.reg * F.count(F.lit(1))).alias("left"),
    )
    return sums.select(USER, (F.col("right") / F.col("left")).cast("float").alias("factor"))


# Models. Factors depend on random starts, so these return what any right model must satisfy.


def _table(spark, sf) -> DataFrame:
    """All ratings as a table: fitting reads them more than once, the join runs once."""
    return written(t.triples(spark, sf), "ratings")


def _fit(spark, sf):
    return fit_als(_table(spark, sf), GLOBAL)


def _shape(lists: DataFrame, *owner: str, other: str) -> DataFrame:
    """Per list: length, first and last rank, distinct entries, and whether scores never rise."""
    order = Window.partitionBy(*owner).orderBy(RANK)
    rises = F.coalesce(F.col(SCORE) > F.lag(SCORE).over(order), F.lit(False))
    return (
        lists.withColumn("rises", rises)
        .groupBy(*owner)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min(RANK).alias("first_rank"),
            F.max(RANK).alias("last_rank"),
            F.count_distinct(other).alias("n_distinct"),
            (~F.bool_or("rises")).alias("ordered"),
        )
    )


@query
def als_user_topk_shape(spark, sf):
    return _shape(top_items(_fit(spark, sf), 100, t.TARGET), USER, other=ITEM)


@query
def als_user_subset_shape(spark, sf):
    """Users come from a table, each twice, and every one also under an id the model does not know."""
    known = _members(spark, sf)
    unknown = known.withColumn(USER, -1 - F.col(USER))
    users = known.unionByName(known).unionByName(unknown)
    return _shape(top_items(_fit(spark, sf), 10, users), USER, other=ITEM)


@query
def als_all_users_shape(spark, sf):
    return _shape(top_items(_fit(spark, sf), 10), USER, other=ITEM)


@query
def als_all_items_shape(spark, sf):
    return _shape(top_users(_fit(spark, sf), 10), ITEM, other=USER)


@query
def als_item_subset_shape(spark, sf):
    items = distinct_ids(t.triples(spark, sf), ITEM, 3)
    return _shape(top_users(_fit(spark, sf), 10, items), ITEM, other=USER)


@query
def als_unseen_shape(spark, sf):
    ratings = _table(spark, sf)
    lists = top_items(fit_als(ratings), 10, exclude_seen=ratings)
    seen = ratings.select(USER, ITEM).distinct().withColumn("seen", F.lit(1))
    marked = lists.join(seen, [USER, ITEM], "left")
    counts = marked.groupBy(USER).agg(F.count("seen").alias("n_seen"))
    return _shape(lists, USER, other=ITEM).join(counts, USER)


@query
def als_top_by_type_shape(spark, sf):
    lists = top_items_by_type(_fit(spark, sf), t.catalog(spark, sf), t.TYPES, 5)
    return _shape(lists, USER, TYPE, other=ITEM)


@query
def als_candidate_list_shape(spark, sf):
    """Per user, against the one long list: entries from elsewhere, wanted entries left out, ranks and order."""
    model, catalog = _fit(spark, sf), t.catalog(spark, sf)
    found = top_items_by_type(model, catalog, t.TYPES, 5, candidate_k=100)
    wanted = catalog.where(F.col(TYPE).isin(t.TYPES)).select(F.col("ID").alias(ITEM), TYPE)
    long_list = top_items(model, 100).select(USER, ITEM).join(wanted, ITEM, "left")
    both = long_list.join(found.drop(TYPE), [USER, ITEM], "full")
    per_type = both.groupBy(USER, TYPE).agg(
        F.count(TYPE).alias("listed"),
        F.count(RANK).alias("taken"),
        F.count_if(F.col(TYPE).isNull() & F.col(RANK).isNotNull()).alias("outside"),
    )
    left_out = F.when(F.col(TYPE).isNotNull(), F.least(F.lit(5), F.col("listed")) - F.col("taken")).otherwise(0)
    counts = per_type.groupBy(USER).agg(F.sum("outside").alias("n_outside"), F.sum(left_out).alias("n_left_out"))
    shape = _shape(found, USER, TYPE, other=ITEM)
    right = (F.col("first_rank") == 1) & (F.col("last_rank") == F.col("n")) & (F.col("n_distinct") == F.col("n"))
    shape = shape.groupBy(USER).agg(F.bool_and(right).alias("ranked"), F.bool_and("ordered").alias("ordered"))
    return counts.join(shape, USER, "left").select(
        USER, "n_outside", "n_left_out", F.coalesce("ranked", F.lit(True)).alias("ranked"), F.coalesce("ordered", F.lit(True)).alias("ordered")
    )


@query
def als_per_segment_shape(spark, sf):
    typed = written(with_item_type(t.triples(spark, sf), t.catalog(spark, sf)), "typed", by=TYPE)
    models = fit_als_per_segment(typed, t.TYPES, SEGMENT)
    parts = [_shape(top_items(m, 5), USER, other=ITEM).withColumn(TYPE, F.lit(s)) for s, m in models.items()]
    lists = parts[0]
    for part in parts[1:]:
        lists = lists.unionByName(part)
    return lists


@query
def als_prediction_is_dot(spark, sf):
    """Every rating's prediction against Spark ML's own transform."""
    ratings = _table(spark, sf)
    model = fit_als(ratings)
    # In this order rows are sent to their users, their items and their users again, where they are summed.
    theirs = model.als_model.transform(ratings).withColumnRenamed(PREDICTION, "theirs")
    both = predict(model, theirs)
    gap = F.abs(F.col(PREDICTION) - F.col("theirs"))
    return both.groupBy(USER).agg(
        F.count(F.lit(1)).alias("n_rows"), (F.max(gap) < 1e-4).alias("same")
    )


@query
def als_normal_equations(spark, sf):
    """Per user: the factors solve (sum v v' + reg n I) x = sum r v over the user's ratings."""
    ratings = _table(spark, sf)
    model = fit_als(ratings)
    rank = model.rank
    v = [F.col("features")[i].cast("double") for i in range(rank)]
    rows = ratings.join(model.item_factors.withColumnRenamed("id", ITEM), ITEM)
    # A rating with its item's factors is a tenth of the sums, so it is the ratings that go to their users.
    rows = rows.repartition(USER)
    upper = [(i, j) for i in range(rank) for j in range(i, rank)]
    sums = rows.groupBy(F.col(USER).alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(v[i] * v[j]).alias(f"a_{i}_{j}") for i, j in upper],
        *[F.sum(F.col(RATING) * v[i]).alias(f"b_{i}") for i in range(rank)],
    )
    solved = sums.join(model.user_factors, "id")
    x = [F.col("features")[i].cast("double") for i in range(rank)]
    gaps = []
    for i in range(rank):
        row = [F.col(f"a_{min(i, j)}_{max(i, j)}") * x[j] for j in range(rank)]
        left = sum(row[1:], row[0]) + GLOBAL.reg * F.col("n") * x[i]
        gaps.append(F.abs(left - F.col(f"b_{i}")) / (1 + F.abs(F.col(f"b_{i}"))))
    return solved.select(
        F.col("id").alias(USER), F.col("n").alias("n_ratings"), (F.greatest(*gaps) < 1e-3).alias("solved")
    )


@query
def als_by_sums(spark, sf):
    """Two rounds of training on the whole table: every user listed, error, from sums of squares, below the mean's."""
    ratings = _table(spark, sf)
    model = fit_als(ratings, AlsParams(max_iter=2))
    gap = F.col(RATING) - F.col(PREDICTION)
    return predict(model, ratings).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(USER).alias("n_users"),
        (F.avg(gap * gap) < F.var_pop(RATING)).alias("beats_mean"),
    )


@query
def coldstart_drop_count(spark, sf):
    training, test = hash_split(_table(spark, sf))
    return coldstart_report(fit_als(training), test).select("n_test", "n_scored", "n_dropped")


# Whole jobs


def _merged(spark, sf) -> DataFrame:
    return merge_ratings(t.triples(spark, sf), t.one_user(spark, sf))


def text_cells_match(image: Column, trailer: Column) -> Column:
    """Whether the markup cells are made of the text cells beside them."""
    from_image = F.concat(F.lit(IMAGE_OPEN), image, F.lit(IMAGE_CLOSE))
    from_trailer = F.when(trailer == MISSING_TEXT, F.lit(TRAILER_MISSING)).otherwise(
        F.concat(F.lit(TRAILER_OPEN), trailer, F.lit(TRAILER_CLOSE))
    )
    return (F.col("m.Image") == from_image) & (F.col("m.Trailer") == from_trailer)


def flagship(spark, sf) -> DataFrame:
    """The main job. Only the finished lists stay behind; the copies it made on the way are removed."""
    job = global_lists(
        _merged(spark, sf),
        t.catalog(spark, sf),
        t.TARGET_ALIAS,
        t.TYPES,
        5,
        t.media(spark, sf),
        t.TITLES,
        keep_copy=True,
    )
    with job as result:
        return written(result.lists, "finished")


@query
def als_top_by_type(spark, sf):
    """The flagship's entries, each with whether its title and links are the catalog's and the pages'."""
    lists = flagship(spark, sf)
    titles = t.catalog(spark, sf).select(F.col("ID").alias(ITEM), F.struct(*t.TITLES).alias("title"))
    links = with_media(lists.select(ITEM).distinct(), t.media(spark, sf)).select(
        ITEM, F.struct("image_url", "trailer_url").alias("link")
    )
    both = lists.join(titles, ITEM, "left").join(links, ITEM, "left")
    return both.select(
        USER,
        TYPE,
        RANK,
        F.struct(*t.TITLES).eqNullSafe(F.col("title")).alias("title_right"),
        F.struct("image_url", "trailer_url").eqNullSafe(F.col("link")).alias("links_right"),
    )


@query
def global_lists_files(spark, sf):
    """The main job to its files, read back: both hold the same ranks, and cells of the right form."""
    text_path, markup_path = scratch_path(spark, "text"), scratch_path(spark, "markup")
    write_global_lists(flagship(spark, sf), text_path, markup_path, t.TITLES)
    text = spark.read.schema(_FINISHED).csv(text_path, header=True, escape='"', encoding="UTF-8")
    markup = spark.read.schema(_FINISHED).json(markup_path)
    keys = [USER, TYPE, RANK, "ID"]
    image, trailer = F.col("t.Image"), F.col("t.Trailer")
    both = text.alias("t").join(markup.alias("m"), keys, "full")
    plain = text_cells_match(image, trailer)
    return both.groupBy(USER, TYPE).agg(
        F.count("t.Image").alias("n_text"),
        F.count("m.Image").alias("n_markup"),
        F.max(RANK).alias("last_rank"),
        F.bool_and(plain).alias("cells_right"),
    )


@query
def global_lists_shape(spark, sf):
    return _shape(flagship(spark, sf), USER, TYPE, other=ITEM)


def _segments(spark, sf, part: str) -> DataFrame:
    """One of the two results of the job by segment; the copies behind it are removed."""
    job = segment_lists(_merged(spark, sf), t.catalog(spark, sf), t.TARGET_ALIAS, t.TYPES, 5, t.TITLES)
    with job as result:
        return written(getattr(result, part), "finished")


@query
def segment_lists_shape(spark, sf):
    return _shape(_segments(spark, sf, "lists"), USER, TYPE, other=ITEM)


@query
def segment_holdout(spark, sf):
    return _segments(spark, sf, "holdout").select(TYPE, "n_test", "n_scored", "n_dropped")


@query
def titled_lists_titles(spark, sf):
    lookup = t.catalog(spark, sf).select(F.col("ID").alias(ITEM), F.col("Name").alias("title"))
    with titled_lists(t.triples(spark, sf), lookup, keep_copy=True) as result:
        lists = written(result.lists, "finished")
    right = lists.join(t.catalog(spark, sf), F.col(ITEM) == F.col("ID"))
    return right.groupBy(USER).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("title") == F.col("Name")).alias("n_right")
    )
