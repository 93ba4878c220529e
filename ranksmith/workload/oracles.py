"""The same results stated in SQL over the driver's tables."""

from __future__ import annotations

from ranksmith.functions.cells import (
    IMAGE_CLOSE,
    IMAGE_OPEN,
    MISSING_TEXT,
    TRAILER_CLOSE,
    TRAILER_MISSING,
    TRAILER_OPEN,
)
from ranksmith.operators.split import HASH_PRIME, ITEM_FACTOR, USER_FACTOR
from ranksmith.workload import tables as t

RATINGS = """ratings AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(ceil(l_quantity / 5) AS DOUBLE) AS rating,
         CAST(epoch(o_orderdate) AS BIGINT) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

CATALOG = f"""catalog AS (
  SELECT p_partkey AS "ID", p_name AS "Name", p_brand AS "{t.ALT_TITLE}", p_type AS "Type" FROM part)"""

MEDIA = f"""media AS (
  SELECT page_id AS item_id, url AS image_url,
         CASE WHEN page_id % 3 <> 0 THEN replace(url, '{t.URL_SUFFIX}', '') END AS trailer_url
  FROM pages)"""

_LINE = f"""((user_id % {HASH_PRIME}) * {USER_FACTOR} + (item_id % {HASH_PRIME}) * {ITEM_FACTOR} + 42)
         % {HASH_PRIME}"""
IN_TRAINING = f"(({_LINE}) * ({_LINE})) % {HASH_PRIME} < {round(0.8 * HASH_PRIME)}"

MERGED = f"""merged AS (
  SELECT user_id, item_id, rating FROM ratings UNION ALL
  SELECT {t.TARGET_ALIAS}::BIGINT, item_id, rating FROM ratings WHERE user_id = {t.TARGET})"""

SCORED = """scored AS (
  SELECT user_id, item_id, "Type", avg(rating) AS score
  FROM ratings JOIN catalog ON item_id = "ID" GROUP BY ALL)"""

RANKED = """ranked AS (
  SELECT user_id, "Type", row_number() OVER (
           PARTITION BY user_id, "Type" ORDER BY score DESC, item_id) AS rank, item_id, score
  FROM scored)"""

IMAGE_CELL = f"'{IMAGE_OPEN}' || coalesce(image_url, '{MISSING_TEXT}') || '{IMAGE_CLOSE}'"
TRAILER_CELL = f"""CASE WHEN trailer_url IS NULL THEN '{TRAILER_MISSING}'
       ELSE '{TRAILER_OPEN}' || trailer_url || '{TRAILER_CLOSE}' END"""

TYPE_LIST = ", ".join(f"'{name}'" for name in t.TYPES)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _listed(n: str) -> str:
    """What every right list of length ``n`` looks like."""
    return f"{n} AS n, 1::BIGINT AS first_rank, {n} AS last_rank, {n} AS n_distinct, true AS ordered"


ITEM_COUNT = "(SELECT count(DISTINCT item_id) FROM ratings)"
USER_COUNT = "(SELECT count(DISTINCT user_id) FROM ratings)"

ORACLES: dict[str, str] = {}

ORACLES["ratings_view"] = _with(RATINGS) + "SELECT * FROM ratings"
ORACLES["ratings_parquet_scan"] = ORACLES["ratings_view"]
ORACLES["parse_rating_text"] = ORACLES["ratings_view"]
ORACLES["rating_lines_scan"] = ORACLES["ratings_view"]
ORACLES["ratings_csv_scan"] = _with(RATINGS) + "SELECT user_id, item_id, rating FROM ratings"
ORACLES["user_ratings_csv_scan"] = ORACLES["ratings_csv_scan"]

ORACLES["remote_ratings_scan"] = ORACLES["ratings_csv_scan"]
ORACLES["remote_catalog_scan"] = """SELECT p_partkey AS "ID", p_name AS "Name", p_type AS "Type" FROM part"""

ORACLES["catalog_csv_scan"] = """
SELECT p_partkey AS "ID", '"' || p_name || '", お, ' || p_brand AS "Name", p_type AS "Type" FROM part"""

ORACLES["parse_catalog_csv"] = """
SELECT p_partkey AS "ID", 'say "' || p_name || '", ' || p_brand AS "Name", p_type AS "Type" FROM part"""

ORACLES["title_lookup_scan"] = """
SELECT p_partkey AS item_id, p_name || ', The ' || p_brand AS title FROM part"""

ORACLES["catalog_projection"] = _with(CATALOG) + "SELECT * FROM catalog"

ORACLES["dropped_columns"] = _with(RATINGS, CATALOG) + f"""
SELECT user_id, "ID", "Name", "{t.ALT_TITLE}", "Type" FROM ratings LEFT JOIN catalog ON item_id * 2 = "ID" """

ORACLES["ratings_with_type"] = _with(RATINGS, CATALOG) + """
SELECT user_id, item_id, rating, "Type" FROM ratings JOIN catalog ON item_id = "ID" """

ORACLES["type_filter"] = _with(CATALOG) + f"""SELECT * FROM catalog WHERE "Type" = '{t.SERIES}'"""

ORACLES["user_filter"] = _with(RATINGS) + f"SELECT * FROM ratings WHERE user_id = {t.TARGET}"

ORACLES["user_table_filter"] = _with(RATINGS) + """
SELECT user_id, item_id, rating FROM ratings
WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""

ORACLES["items_isin"] = _with(RATINGS, CATALOG) + f"""
SELECT * FROM catalog
WHERE "ID" IN (SELECT item_id FROM ratings WHERE user_id = {t.TARGET} AND rating >= 8)"""

ORACLES["distinct_users"] = _with(RATINGS) + "SELECT DISTINCT user_id FROM ratings"

ORACLES["first_users"] = _with(RATINGS) + """
SELECT DISTINCT user_id FROM ratings ORDER BY user_id LIMIT 3"""

ORACLES["merged_ratings"] = _with(RATINGS, MERGED) + "SELECT * FROM merged"

ORACLES["duplicates_latest"] = _with(RATINGS) + """
SELECT user_id, item_id, rating, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, rating DESC) AS age
  FROM ratings) WHERE age = 1"""

ORACLES["duplicates_mean"] = _with(RATINGS) + """
SELECT user_id, item_id, avg(rating) AS rating FROM ratings GROUP BY ALL"""

ORACLES["rating_counts"] = _with(RATINGS) + """
SELECT (SELECT count(*) FROM ratings) AS n_rows,
       (SELECT count(DISTINCT user_id) FROM ratings) AS n_users,
       (SELECT count(DISTINCT item_id) FROM ratings) AS n_items,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM ratings GROUP BY user_id)) AS max_user_rows,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM ratings GROUP BY item_id)) AS max_item_rows,
       (SELECT count(*) FROM ratings WHERE user_id IS NULL OR item_id IS NULL OR rating IS NULL) AS n_bad"""

ORACLES["first_of_each_list"] = _with(RATINGS, CATALOG, SCORED, RANKED) + """
SELECT * FROM ranked WHERE rank <= 5"""

ORACLES["flattened_lists"] = _with(RATINGS, CATALOG, SCORED) + """
SELECT user_id, rank, item_id, CAST(CAST(score AS REAL) AS DOUBLE) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM scored)
WHERE rank <= 10"""

ORACLES["catalog_left_join"] = _with(RATINGS, CATALOG) + f"""
SELECT user_id, item_id * 2 AS item_id, rating, "Name", "{t.ALT_TITLE}", "Type"
FROM ratings LEFT JOIN catalog ON item_id * 2 = "ID" """

ORACLES["title_lookup"] = _with(RATINGS, CATALOG) + """
SELECT user_id, item_id, rating, "Name" AS title FROM ratings LEFT JOIN catalog ON item_id = "ID" """

ORACLES["media_text"] = _with(CATALOG, MEDIA) + f"""
SELECT "ID" AS item_id, "Name", "Type", coalesce(image_url, '{MISSING_TEXT}') AS "Image",
       coalesce(trailer_url, '{MISSING_TEXT}') AS "Trailer"
FROM catalog LEFT JOIN media ON "ID" = item_id"""

ORACLES["media_cells"] = _with(CATALOG, MEDIA) + f"""
SELECT "ID" AS item_id, "Name", "Type", {IMAGE_CELL} AS "Image", {TRAILER_CELL} AS "Trailer"
FROM catalog LEFT JOIN media ON "ID" = item_id"""

ORACLES["epoch_instant"] = _with(RATINGS) + """
SELECT user_id, item_id, ts, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS instant
FROM ratings"""


def _finished(image: str, trailer: str) -> str:
    return _with(RATINGS, CATALOG, MEDIA, SCORED, RANKED) + f"""
SELECT user_id, rank, "ID", c."Name", c."{t.ALT_TITLE}", r."Type",
       {image} AS "Image", {trailer} AS "Trailer"
FROM ranked r JOIN catalog c ON r.item_id = c."ID" LEFT JOIN media m ON r.item_id = m.item_id
WHERE rank <= 5"""


ORACLES["text_list_sink"] = _finished(
    f"coalesce(image_url, '{MISSING_TEXT}')", f"coalesce(trailer_url, '{MISSING_TEXT}')"
)
ORACLES["remote_list_sink"] = ORACLES["text_list_sink"]
ORACLES["markup_list_sink"] = _finished(IMAGE_CELL, TRAILER_CELL)

ORACLES["split_rows"] = _with(RATINGS) + f"""
SELECT user_id, item_id, rating, {IN_TRAINING} AS in_training FROM ratings"""

ORACLES["random_split_rows"] = _with(RATINGS) + "SELECT user_id, item_id, rating FROM ratings"

ORACLES["rmse_constant"] = _with(RATINGS) + """
SELECT count(*) AS n_rows, round(sqrt(avg((rating - 5) * (rating - 5))), 6) AS rmse FROM ratings"""

ORACLES["rmse_constant_by_type"] = _with(RATINGS, CATALOG) + """
SELECT "Type", count(*) AS n_rows, round(sqrt(avg((rating - 5) * (rating - 5))), 6) AS rmse
FROM ratings JOIN catalog ON item_id = "ID" GROUP BY "Type" """

_USERS = """users AS (
  SELECT c_custkey AS user_id, 1 + c_custkey % 5 AS u0, c_nationkey % 7 AS u1, (c_custkey // 3) % 4 AS u2
  FROM customer"""

_ITEMS = """items AS (
  SELECT p_partkey AS item_id, p_type AS "Type", p_size % 10 AS v0, 1 + p_partkey % 6 AS v1,
         3 - p_partkey % 4 AS v2
  FROM part)"""

GIVEN = f"""{_USERS}),
{_ITEMS}"""
GIVEN_COLD = f"""{_USERS} WHERE c_mktsegment <> 'BUILDING'),
{_ITEMS}"""

ALL_SCORES = """scores AS (
  SELECT user_id, item_id, "Type", CAST(u0 * v0 + u1 * v1 + u2 * v2 AS DOUBLE) AS score
  FROM users CROSS JOIN items)"""


def _ranked(owner: str, other: str, k: int, rows: str = "scores", columns: str | None = None) -> str:
    return f"""SELECT {columns or f"{owner}, rank, {other}, score"} FROM (
  SELECT *, row_number() OVER (PARTITION BY {owner} ORDER BY score DESC, {other}) AS rank FROM {rows})
WHERE rank <= {k}"""


_TYPED_SCORES = f"""typed AS (SELECT * FROM scores WHERE "Type" IN ({TYPE_LIST}))"""
_TYPED_COLUMNS = 'user_id, "Type", rank, item_id, score'

ORACLES["scored_items_per_user"] = _with(GIVEN, ALL_SCORES) + _ranked("user_id", "item_id", 10)
ORACLES["scored_users_per_item"] = _with(GIVEN, ALL_SCORES) + _ranked("item_id", "user_id", 10)
ORACLES["scored_items_of_members"] = _with(GIVEN_COLD, ALL_SCORES) + _ranked(
    "user_id",
    "item_id",
    5,
    "scores WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
)
ORACLES["scored_items_by_type"] = _with(GIVEN, ALL_SCORES, _TYPED_SCORES) + _ranked(
    'user_id, "Type"', "item_id", 5, "typed", _TYPED_COLUMNS
)
ORACLES["scored_unseen_by_type"] = _with(RATINGS, GIVEN, ALL_SCORES, _TYPED_SCORES) + _ranked(
    'user_id, "Type"',
    "item_id",
    5,
    "typed ANTI JOIN ratings USING (user_id, item_id)",
    _TYPED_COLUMNS,
)
ORACLES["scored_candidates_by_type"] = (
    _with(
        GIVEN,
        ALL_SCORES,
        "long AS (" + _ranked("user_id", "item_id", 100, columns='user_id, item_id, "Type", score') + ")",
    )
    + _ranked('user_id, "Type"', "item_id", 5, f'long WHERE "Type" IN ({TYPE_LIST})', _TYPED_COLUMNS)
)

ORACLES["scored_unseen_items_per_user"] = _with(RATINGS, GIVEN, ALL_SCORES) + _ranked(
    "user_id", "item_id", 10, "scores ANTI JOIN ratings USING (user_id, item_id)"
)
ORACLES["scored_items_per_user_in_tiles"] = ORACLES["scored_items_per_user"]
ORACLES["scored_users_per_item_in_tiles"] = ORACLES["scored_users_per_item"]
ORACLES["scored_unseen_by_type_in_tiles"] = ORACLES["scored_unseen_by_type"]

ORACLES["predicted_ratings"] = _with(RATINGS, GIVEN) + """
SELECT user_id, item_id, rating, CAST(u0 * v0 + u1 * v1 + u2 * v2 AS DOUBLE) AS prediction
FROM ratings JOIN users USING (user_id) JOIN items USING (item_id)"""

ORACLES["predicted_ratings_shuffled"] = ORACLES["predicted_ratings"]

ORACLES["predicted_holdout"] = _with(RATINGS, GIVEN_COLD) + """
SELECT count(*) AS n_test, count(prediction) AS n_scored, count(*) - count(prediction) AS n_dropped,
       round(sqrt(avg((rating - prediction) * (rating - prediction))), 6) AS rmse
FROM (SELECT rating, u0 * v0 + u1 * v1 + u2 * v2 AS prediction
      FROM ratings LEFT JOIN users USING (user_id) LEFT JOIN items USING (item_id))"""

ORACLES["solved_users"] = _with(RATINGS, GIVEN) + """
SELECT user_id, CAST(CAST(sum(rating * v1) / (sum(v1 * v1) + 0.1::DOUBLE * count(*)) AS REAL) AS DOUBLE) AS factor
FROM ratings JOIN items USING (item_id) GROUP BY user_id"""

ORACLES["als_user_topk_shape"] = _with(RATINGS) + f"""
SELECT DISTINCT user_id, {_listed(f"least(100, {ITEM_COUNT})")} FROM ratings WHERE user_id = {t.TARGET}"""

ORACLES["als_user_subset_shape"] = _with(RATINGS) + f"""
SELECT DISTINCT user_id, {_listed(f"least(10, {ITEM_COUNT})")} FROM ratings
WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')"""

ORACLES["als_all_users_shape"] = _with(RATINGS) + f"""
SELECT DISTINCT user_id, {_listed(f"least(10, {ITEM_COUNT})")} FROM ratings"""

ORACLES["als_all_items_shape"] = _with(RATINGS) + f"""
SELECT DISTINCT item_id, {_listed(f"least(10, {USER_COUNT})")} FROM ratings"""

ORACLES["als_item_subset_shape"] = _with(RATINGS) + f"""
SELECT DISTINCT item_id, {_listed(f"least(10, {USER_COUNT})")} FROM ratings ORDER BY item_id LIMIT 3"""

ORACLES["als_unseen_shape"] = _with(RATINGS) + f"""
SELECT user_id, 0::BIGINT AS n_seen, {_listed(f"least(10, {ITEM_COUNT} - count(DISTINCT item_id))")}
FROM ratings GROUP BY user_id"""

_TYPE_SIZES = f"""sizes AS (
  SELECT "Type", count(DISTINCT item_id) AS items FROM ratings JOIN catalog ON item_id = "ID"
  WHERE "Type" IN ({TYPE_LIST}) GROUP BY "Type")"""

ORACLES["als_top_by_type_shape"] = _with(RATINGS, CATALOG, _TYPE_SIZES) + f"""
SELECT DISTINCT user_id, "Type", {_listed("least(5, items)")} FROM ratings CROSS JOIN sizes"""

ORACLES["als_candidate_list_shape"] = _with(RATINGS) + """
SELECT DISTINCT user_id, 0::BIGINT AS n_outside, 0::BIGINT AS n_left_out, true AS ranked, true AS ordered
FROM ratings"""

ORACLES["als_per_segment_shape"] = _with(RATINGS, CATALOG, _TYPE_SIZES) + f"""
SELECT DISTINCT user_id, "Type", {_listed("least(5, items)")}
FROM ratings JOIN catalog ON item_id = "ID" JOIN sizes USING ("Type")"""

ORACLES["als_prediction_is_dot"] = _with(RATINGS) + """
SELECT user_id, count(*) AS n_rows, true AS same FROM ratings GROUP BY user_id"""

ORACLES["als_normal_equations"] = _with(RATINGS) + """
SELECT user_id, count(*) AS n_ratings, true AS solved FROM ratings GROUP BY user_id"""

ORACLES["als_by_sums"] = _with(RATINGS) + """
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, true AS beats_mean FROM ratings"""

_TRAINING = f"training AS (SELECT * FROM ratings WHERE {IN_TRAINING})"
_TEST = f"test AS (SELECT * FROM ratings WHERE NOT ({IN_TRAINING}))"
_WARM = """user_id IN (SELECT user_id FROM training) AND item_id IN (SELECT item_id FROM training)"""

ORACLES["coldstart_drop_count"] = _with(RATINGS, _TRAINING, _TEST) + f"""
SELECT count(*) AS n_test, count(*) FILTER (WHERE {_WARM}) AS n_scored,
       count(*) FILTER (WHERE NOT ({_WARM})) AS n_dropped
FROM test"""

_TYPED_MERGED = f"""typed AS (
  SELECT user_id, item_id, "Type", {IN_TRAINING} AS in_training
  FROM merged JOIN catalog ON item_id = "ID" WHERE "Type" IN ({TYPE_LIST}))"""

ORACLES["global_lists_shape"] = _with(RATINGS, CATALOG, MERGED, _TYPED_MERGED) + f"""
SELECT {t.TARGET_ALIAS}::BIGINT AS user_id, "Type", {_listed("least(5, count(DISTINCT item_id))")}
FROM typed WHERE in_training GROUP BY "Type" """

_GLOBAL_SIZES = f"""sizes AS (
  SELECT {t.TARGET_ALIAS}::BIGINT AS user_id, "Type", least(5, count(DISTINCT item_id)) AS n
  FROM typed WHERE in_training GROUP BY "Type")"""

ORACLES["als_top_by_type"] = _with(RATINGS, CATALOG, MERGED, _TYPED_MERGED, _GLOBAL_SIZES) + """
SELECT user_id, "Type", unnest(generate_series(1, n)) AS rank, true AS title_right, true AS links_right
FROM sizes"""

ORACLES["global_lists_files"] = _with(RATINGS, CATALOG, MERGED, _TYPED_MERGED, _GLOBAL_SIZES) + """
SELECT user_id, "Type", n AS n_text, n AS n_markup, n AS last_rank, true AS cells_right FROM sizes"""

ORACLES["segment_lists_shape"] = _with(RATINGS, CATALOG, MERGED, _TYPED_MERGED) + f"""
SELECT {t.TARGET_ALIAS}::BIGINT AS user_id, "Type", {_listed("least(5, count(DISTINCT item_id))")}
FROM typed WHERE in_training GROUP BY "Type"
HAVING count(*) FILTER (WHERE user_id = {t.TARGET_ALIAS}) > 0"""

_SEGMENT_WARM = """
  user_id IN (SELECT user_id FROM typed o WHERE o.in_training AND o."Type" = typed."Type")
  AND item_id IN (SELECT item_id FROM typed o WHERE o.in_training AND o."Type" = typed."Type")"""

ORACLES["segment_holdout"] = _with(RATINGS, CATALOG, MERGED, _TYPED_MERGED) + f"""
SELECT "Type", count(*) AS n_test, count(*) FILTER (WHERE warm) AS n_scored,
       count(*) FILTER (WHERE NOT warm) AS n_dropped
FROM (SELECT "Type", {_SEGMENT_WARM} AS warm FROM typed WHERE NOT in_training)
GROUP BY "Type" """

ORACLES["titled_lists_titles"] = _with(RATINGS, _TRAINING) + f"""
SELECT user_id, least(10, (SELECT count(DISTINCT item_id) FROM training)) AS n,
       least(10, (SELECT count(DISTINCT item_id) FROM training)) AS n_right
FROM (SELECT DISTINCT user_id FROM ratings ORDER BY user_id LIMIT 3)
WHERE user_id IN (SELECT user_id FROM training)"""
