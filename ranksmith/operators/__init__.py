"""Steps from a rating table to ranked lists. All take and return DataFrames."""

from ranksmith.operators.enrich import (
    markup_cells,
    output_columns,
    text_cells,
    with_lookup_title,
    with_media,
    with_titles,
)
from ranksmith.operators.evaluate import coldstart_report, predict, rmse
from ranksmith.operators.model import (
    GLOBAL,
    SEGMENT,
    AlsParams,
    FactorModel,
    als_estimator,
    check_counts,
    fit_als,
    fit_als_per_segment,
)
from ranksmith.operators.ratings import (
    catalog_items,
    count_ratings,
    counted_copy,
    distinct_ids,
    merge_ratings,
    of_type,
    profile_ratings,
    resolve_duplicates,
    target_users,
    with_item_type,
)
from ranksmith.operators.recommend import (
    as_arrays,
    first_per_list,
    flatten_lists,
    reusable,
    top_items,
    top_items_by_type,
    top_users,
)
from ranksmith.operators.split import hash_split, in_training, random_split

__all__ = [
    "GLOBAL",
    "SEGMENT",
    "AlsParams",
    "FactorModel",
    "als_estimator",
    "as_arrays",
    "catalog_items",
    "check_counts",
    "coldstart_report",
    "count_ratings",
    "counted_copy",
    "distinct_ids",
    "first_per_list",
    "fit_als",
    "fit_als_per_segment",
    "flatten_lists",
    "hash_split",
    "in_training",
    "markup_cells",
    "merge_ratings",
    "of_type",
    "output_columns",
    "predict",
    "profile_ratings",
    "random_split",
    "resolve_duplicates",
    "reusable",
    "rmse",
    "target_users",
    "text_cells",
    "top_items",
    "top_items_by_type",
    "top_users",
    "with_item_type",
    "with_lookup_title",
    "with_media",
    "with_titles",
]
