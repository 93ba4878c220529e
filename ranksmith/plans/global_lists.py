"""Train on everything, then list the best items of each type for the target users."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ranksmith.operators import (
    GLOBAL,
    AlsParams,
    FactorModel,
    check_counts,
    coldstart_report,
    counted_copy,
    fit_als,
    hash_split,
    in_training,
    markup_cells,
    output_columns,
    resolve_duplicates,
    text_cells,
    top_items_by_type,
    with_media,
    with_titles,
)
from ranksmith.sinks import write_lists
from ranksmith.storage import owned, remove, written


@dataclass(frozen=True)
class Recommendation:
    """Lists, the holdout report (one row, computed when read) and the model behind them.

    All of them read copies in ``folder`` of the shared storage. ``close`` removes the copies; use the results
    before, or as a context manager.
    """

    lists: DataFrame
    holdout: DataFrame
    model: FactorModel
    folder: str

    def close(self) -> None:
        remove(self.lists.sparkSession, self.folder)

    def __enter__(self) -> Recommendation:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def global_lists(
    ratings: DataFrame,
    catalog: DataFrame,
    users,
    types: Iterable[str] = ("TV", "Movie"),
    n: int = 5,
    media: DataFrame | None = None,
    titles: Sequence[str] = ("Name", "Japanese name"),
    params: AlsParams = GLOBAL,
    duplicates: str = "keep",
    train: float = 0.8,
    seed: int = 42,
    exclude_seen: bool = False,
    candidate_k: int | None = None,
    keep_copy: bool = False,
) -> Recommendation:
    """One model over all items; ``n`` items of each type per target user, with titles and media.

    The ratings are read for the count, the fit and the holdout. Set ``keep_copy``
    when they come out of a join or other costly plan: it runs once, and the count is made while the copy is written.
    """
    with owned(ratings.sparkSession, "global-lists") as folder:
        rows = resolve_duplicates(ratings, duplicates)
        n_rows = None
        if keep_copy:
            rows, n_rows, n_bad = counted_copy(rows, in_training(train, seed))
            check_counts(n_rows, n_bad)
        training, test = hash_split(rows, train, seed)
        model = fit_als(training, params, n_rows=n_rows)
        lists = top_items_by_type(
            model, catalog, types, n, users, rows if exclude_seen else None, candidate_k
        )
        lists = with_titles(lists, catalog, titles)
        if media is not None:
            lists = with_media(lists, media)
        return Recommendation(lists, coldstart_report(model, test), model, folder)


def write_global_lists(
    lists: DataFrame, text_path: str, markup_path: str, titles: Sequence[str] = ("Name", "Japanese name")
) -> None:
    """Finished lists as files: text (CSV) and markup (JSON) cells, each split by type. The lists are computed once."""
    with owned(lists.sparkSession, "finished") as folder:
        finished = written(lists, "lists")
        write_lists(output_columns(text_cells(finished), titles), text_path)
        write_lists(output_columns(markup_cells(finished), titles), markup_path, fmt="json")
    remove(lists.sparkSession, folder)
