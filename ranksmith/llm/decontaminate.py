"""Benchmark decontamination: suffix arrays of training shards, searched for every test suffix.

Each task cuts its documents into shards of bounded size, maps words to numbers, and sorts the positions of a shard by
the words that follow them (a suffix array, by prefix doubling). The beginning of every suffix of every benchmark item, a
window, is looked up by binary search, which gives all its places in the shard. Where they stand in a row, the words from there on are
looked up in turn among the items' sorted suffixes, and the neighbours give each document's own longest verbatim match.

Words that no item has can be part of no match, and neither can runs of item words shorter than the shortest window; the
array leaves out positions whose run is too short. Items reach the tasks in blocks of about ``block_words`` words, so what
is broadcast has a fixed bound. Further blocks search the same documents again.

Defined cases: a null or empty text has no words and is never contaminated; items without words have no windows;
a null item id is listed as ``null``; items that share an id count as one; repeated documents are judged alike, whatever else is in
their shard; texts of any length are read whole; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ranksmith.llm.common import guarded, guarded_name, raw, slices, with_results
from ranksmith.storage import written

# Letters A-Z become small, and all ASCII that is neither letter nor digit becomes a space. Bytes from 0x80 on stay.
WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)
)
SHARD_WORDS = 1 << 21
BLOCK_WORDS = 1 << 19
PIECE_WORDS = 1 << 16


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Tests:
    """A block of item pieces: their words as numbers from 1, one after another, and their suffixes in order.

    ``windows`` has, for the numbers of each window, the items that hold it and the range of ``order`` whose
    suffixes begin with it. Pieces shorter than a window are windows themselves, and their range is empty.
    """

    def __init__(self, pieces: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.items = sorted({name for name, _ in pieces})
        number = {name: k for k, name in enumerate(self.items)}
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[bytes, set[int]] = {}
        lines: dict[bytes, None] = {}
        for name, words in pieces:
            line = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=">u4").tobytes()
            lines[line] = None
            size = 4 * min(window, len(words))
            for k in range(0, len(line) - size + 1, 4):
                owners.setdefault(line[k : k + size], set()).add(number[name])
        gap = b"\xff" * 4  # no word's number
        self.packed = gap.join(sorted(line for line in lines if len(line) >= 4 * window))
        ids = np.frombuffer(self.packed, ">u4")
        # A window begins where no gap comes sooner.
        gaps = np.concatenate(([0], np.cumsum(ids == 0xFFFFFFFF)))
        starts = np.arange(max(0, len(ids) - window + 1))
        starts = starts[gaps[starts] == gaps[starts + window]]
        _, dense = np.unique(ids, return_inverse=True)
        self.order = suffix_array(dense + 1, starts, max(1, len(ids)))
        self.windows: dict[bytes, tuple[list[int], int, int]] = {w: (sorted(own), 0, 0) for w, own in owners.items()}
        heads = [self.packed[4 * p : 4 * (p + window)] for p in self.order.tolist()]
        for k, head in enumerate(heads):
            own, low, high = self.windows[head]
            self.windows[head] = (own, k if low == high else low, k + 1)
        self.shortest = min((len(w) // 4 for w in self.windows), default=1)

    @classmethod
    def of(cls, state: dict) -> Tests:
        """From the attributes, as they are broadcast."""
        tests = cls.__new__(cls)
        tests.__dict__ = state
        return tests

    def longest(self, packed: bytes, at: int, most: int, low: int, high: int) -> int:
        """The most words, up to ``most``, that ``packed`` has from word ``at`` on in common with a suffix in order[low:high]."""
        wanted = packed[4 * at : 4 * (at + most)]
        if high - low > 1:
            place = bisect_left(self.order, wanted, low, high, key=lambda p: self.packed[4 * p : 4 * (p + most)])
            low, high = max(low, place - 1), min(high, place + 1)
        return max(common(self.packed, 4 * int(p), wanted) for p in self.order[low:high])


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at``, sorted by the ``depth`` numbers from there on, by prefix doubling.

    Beyond the end stands 0. Ranks of all positions double the length they tell apart until it reaches ``depth``
    or no two are equal.
    """
    n = len(ids)
    order = ids.astype(np.int64)
    known = 1
    while known < depth:
        ahead = np.zeros(n, np.int64)
        ahead[: n - known] = order[known:] + 1 if known < n else 0
        pair = order * (order.max(initial=0) + ahead.max(initial=0) + 2) + ahead
        values, order = np.unique(pair, return_inverse=True)
        known *= 2
        if len(values) == n:
            break
    return at[np.argsort(order[at], kind="stable")]


def compact(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in runs of at least ``shortest`` known words, with one unknown word after each run."""
    known = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
    edge = np.diff(known)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = ends - starts >= shortest
    starts, ends = starts[long], np.minimum(ends[long] + 1, len(ids))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, ids.dtype)
    sizes = ends - starts
    base = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes)
    places = base + np.arange(sizes.sum())
    return places, ids[places]


def search(ids: np.ndarray, document: np.ndarray, tests: Tests):
    """Hit words of a shard, (document, item) pairs, and the longest match of each document.

    ``ids`` ends each document with a 0, so no match runs across.
    """
    cover = np.zeros(len(ids) + 1, np.int64)
    longest = np.zeros(int(document[-1]) + 1 if len(document) else 0, np.int64)
    pairs: set[tuple[int, int]] = set()
    places, dense = compact(ids, tests.shortest)
    if not len(places):
        return cover[:-1] > 0, pairs, longest
    # All suffixes that begin with the same window may stand in any order.
    array = suffix_array(dense, np.flatnonzero(dense), tests.window)
    packed = dense.astype(">u4").tobytes()
    array_list = array.tolist()
    # For each word that begins a full window, the range of test suffixes that begin with it.
    low_of, high_of = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for head, (items, first, end) in tests.windows.items():
        key = lambda p, n=len(head): packed[4 * p : 4 * p + n]
        low = bisect_left(array_list, head, key=key)
        if low == len(array_list) or key(array_list[low]) != head:
            continue
        found = places[array[low : bisect_right(array_list, head, lo=low, key=key)]]
        size = len(head) // 4
        np.add.at(cover, found, 1)
        np.add.at(cover, found + size, -1)
        here = np.unique(document[found])
        longest[here] = np.maximum(longest[here], size)
        pairs.update((d, item) for d in here.tolist() for item in items)
        if end > first:
            low_of[found], high_of[found] = first, end
    begins = np.flatnonzero(high_of)
    if len(begins):
        extend(ids.astype(">u4").tobytes(), begins, low_of, high_of, document, tests, longest)
    return np.cumsum(cover)[:-1] > 0, pairs, longest


def extend(packed: bytes, begins: np.ndarray, low_of, high_of, document: np.ndarray, tests: Tests, longest: np.ndarray):
    """Raise ``longest`` to each document's longest match. A match that starts in a run of neighbouring windows ends in it, so a run is
    left once what remains of it is no longer than a match already found."""
    cuts = np.flatnonzero(np.diff(begins) != 1)
    firsts, lasts = begins[np.concatenate(([0], cuts + 1))], begins[np.append(cuts, len(begins) - 1)]
    for first, last in zip(firsts.tolist(), lasts.tolist()):
        d, end = document[first], last + tests.window
        best, at = int(longest[d]), first
        while end - at > best:
            best = max(best, tests.longest(packed, at, end - at, int(low_of[at]), int(high_of[at])))
            at += 1
        longest[d] = best


def common(packed: bytes, at: int, suffix: bytes) -> int:
    """The number of equal numbers at the start."""
    low, high = 0, len(suffix) // 4
    while low < high:
        middle = (low + high + 1) // 2
        if packed[at : at + 4 * middle] == suffix[: 4 * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def runs(hit: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FIELDS = (
    "n_words bigint, hits array<struct<start:bigint,end:bigint>>, item_ids array<string>, longest_match bigint"
)


def found_in(texts: list[bytes], tests: Tests, shard_words: int = SHARD_WORDS) -> list[dict]:
    """One dict for each text: n_words, hits (runs of word numbers), items, longest."""
    rows: list[dict] = []
    pending: list[np.ndarray] = []
    size = 0

    def flush():
        nonlocal pending, size
        if not pending:
            return
        lengths = [len(p) for p in pending]
        ids = np.concatenate([np.append(p, 0).astype(np.uint32) for p in pending])
        document = np.repeat(np.arange(len(pending)), [n + 1 for n in lengths])
        hit, pairs, longest = search(ids, document, tests)
        items: dict[int, list[str]] = {}
        for d, item in pairs:
            items.setdefault(d, []).append(tests.items[item])
        start = 0
        for d, n in enumerate(lengths):
            own = hit[start : start + n]
            spans = runs(own) if d in items else []
            rows.append({"n": n, "hits": spans, "items": items.get(d, []), "longest": int(longest[d])})
            start += n + 1
        pending, size = [], 0

    for text in texts:
        words = words_of(text)
        ids = np.fromiter(map(tests.vocabulary.get, words, repeat(0)), np.uint32, len(words))
        if size and size + len(ids) > shard_words:
            flush()
        pending.append(ids)
        size += len(ids)
    flush()
    return rows


def item_pieces(benchmark: DataFrame, item: str, text: str, window: int, piece_words: int) -> DataFrame:
    """Items as (name, words joined by spaces), long ones cut into pieces that overlap by a window less one word."""
    schema = "name string, words binary, size bigint"
    named = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("name"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for piece in slices(batches, "text"):
            rows = []
            for name, value in zip(piece.column("name").to_pylist(), raw(piece.column("text"))):
                words = words_of(value)
                for k in range(0, max(1, len(words) - window + 1), piece_words):
                    part = words[k : k + piece_words + window - 1]
                    if part:
                        rows.append((name, b" ".join(part), len(part)))
            names, parts, sizes = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(parts, pa.binary()), pa.array(sizes, pa.int64())],
                names=["name", "words", "size"],
            )

    return named.mapInArrow(run, schema).distinct()


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows with ``n_words``, ``hits`` (runs of word numbers inside a window), ``item_ids`` (sorted, those with
    occurring windows) and ``longest_match`` (words of the longest verbatim match of any test suffix that reaches a window).

    A window is ``window`` consecutive words of an item, or all of a shorter one. Items longer than 65,536 words are searched
    in pieces that overlap by a window less one word, and a longest match is counted within its piece.
    """
    spark = documents.sparkSession
    pieces = written(item_pieces(benchmark, item, item_text, window, PIECE_WORDS), "items")
    total = pieces.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_blocks = max(1, -(-2 * total // block_words))
    block = F.pmod(F.xxhash64("name", "words"), F.lit(n_blocks))
    found = documents
    for k in range(n_blocks):
        part = pieces.where(block == k).select("name", "words").collect()
        tests = Tests([(r["name"], bytes(r["words"]).split(b" ")) for r in part], window)
        tests = spark.sparkContext.broadcast(vars(tests))
        found = _searched(found, tests, text, keep if k == 0 else None, first=k == 0, last=k == n_blocks - 1)
        if k < n_blocks - 1:
            found = written(found, "searched")
    return found


def _searched(documents, tests, text, keep, first, last):
    """One pass with one block; earlier passes' results, if any, are united with its own."""
    earlier = [] if first else ["hits", "item_ids", "longest_match"]
    passed = None if keep is None else [*keep, *([] if last or text in keep else [text])]
    if first:
        return with_results(documents, lambda column: _arrays(found_in(raw(column), Tests.of(tests.value))), FIELDS, text, passed)
    renamed = documents.withColumnsRenamed({c: f"_rs_{c}" for c in earlier})
    searched = with_results(renamed, lambda column: _arrays(found_in(raw(column), Tests.of(tests.value))), FIELDS, text)
    joined = searched.withColumns(
        {
            "hits": joined_runs(F.col("_rs_hits"), F.col("hits")),
            "item_ids": F.array_sort(F.array_union("_rs_item_ids", "item_ids")),
            "longest_match": F.greatest("_rs_longest_match", "longest_match"),
        }
    ).drop(*[f"_rs_{c}" for c in earlier])
    return joined


def joined_runs(a: Column, b: Column) -> Column:
    """The runs of word numbers in either list, those that overlap or touch made one."""
    both = F.array_sort(F.concat(a, b))
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(merged, run):
        last = F.try_element_at(merged, F.lit(-1))
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        touches = F.coalesce(run["start"] <= last["end"], F.lit(False))
        before = F.slice(merged, 1, F.greatest(F.size(merged) - 1, F.lit(0)))
        return F.when(touches, F.concat(before, F.array(grown))).otherwise(F.concat(merged, F.array(run)))

    return F.aggregate(both, start, add)


def _arrays(rows: list[dict]) -> list[pa.Array]:
    return [
        pa.array([r["n"] for r in rows], pa.int64()),
        pa.array([r["hits"] for r in rows], RUNS),
        pa.array([sorted(r["items"]) for r in rows], pa.list_(pa.string())),
        pa.array([r["longest"] for r in rows], pa.int64()),
    ]


def clean_documents(documents: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents without a hit, with the columns they came with."""
    table, back = guarded(documents)
    found = find_contamination(table, benchmark, text=guarded_name(documents, text), **options)
    return back(found.where(F.size("hits") == 0))
