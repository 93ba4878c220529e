"""Column names every rating table, factor table and list uses."""

USER = "user_id"
ITEM = "item_id"
RATING = "rating"
TS = "ts"

CATALOG_ID = "ID"
TYPE = "Type"

RANK = "rank"
SCORE = "score"
PREDICTION = "prediction"
