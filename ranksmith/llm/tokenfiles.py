"""Token ids as binary files of patched frame-of-reference blocks.

Documents are placed and sorted by id, turned into token ids, and written in segments: one row holds the ids of many
neighbouring documents in the format of ``packing.py``, their lengths in the same format, and where the segment
begins in its partition. The files are Parquet files with binary segments, so Spark commits them, and any
executor or later job can read a segment, or a block of it by the block's start, by itself.

Defined cases: a null or empty text is the end id alone; a null document id comes first; documents with the same id follow
each other by a hash of their text, then their text; an empty table makes no segment.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ranksmith.llm.common import kept_columns, raw, slices, worker_state
from ranksmith.llm.packing import decode, encode
from ranksmith.storage import scratch_path

SEGMENT_IDS = 1 << 20
CACHED_WORDS = 1 << 20


# A run of small letters that no letter or byte beyond ASCII follows, or whatever stands up to the next white space.
PIECES = re.compile(rb"[a-z]+(?![a-z\x80-\xFF])|\S+")
LETTERS = re.compile(rb"[a-z]+")


class Encoder:
    """Token ids of texts. With ``by_word`` each distinct word is encoded once and remembered, up to a bound.

    ``by_word`` is for vocabularies that drop white space and never look across it; the texts are cut at ASCII
    white space and the words' ids put together. A tokenizer seen to do otherwise is refused. One that also ignores case and always
    ends a piece where a run of letters ends gets its texts cut there too, so that there are fewer words to remember, and
    words of letters alone go straight to its model.
    """

    def __init__(self, definition: str, by_word: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.by_word = by_word
        if by_word and self.whole("A b\n ab a.b\t1 2 é") != [x for w in "A b ab a.b 1 2 é".split() for x in self.whole(w)]:
            raise ValueError("the tokenizer keeps white space or looks across it; encode whole texts (by_word=False)")
        self.cuts_letters = by_word and self.ends_with_letters()
        self.forget()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def ends_with_letters(self) -> bool:
        """Whether small letters stand for themselves, capitals for small letters, and other ASCII never joins letters before it."""
        others = [chr(c) for c in range(128) if not chr(c).isalpha() and not chr(c).isspace()]
        words = ["the", "ab", "internationalization", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"]
        return all(self.whole(f"aB{c}re") == self.whole("ab") + self.whole(f"{c}re") for c in others) and all(
            self.whole(w) == self.whole(w.upper()) == [t.id for t in self.tokenizer.model.tokenize(w)] for w in words
        )

    def forget(self):
        self.number: dict[bytes, int] = {}
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def cut(self, text: bytes) -> list[bytes]:
        return PIECES.findall(text.lower()) if self.cuts_letters else text.split()

    def learn(self, words: list[bytes]):
        ids: list[list[int]] = [[]] * len(words)
        other = []
        model = self.tokenizer.model.tokenize
        for k, w in enumerate(words):
            if self.cuts_letters and LETTERS.fullmatch(w):
                ids[k] = [t.id for t in model(w.decode())]
            else:
                other.append(k)
        for k, e in zip(other, self.tokenizer.encode_batch_fast([words[k].decode() for k in other], add_special_tokens=False)):
            ids[k] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(sizes) - sizes))
        self.size = np.concatenate((self.size, sizes))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum()))))
        self.number.update(zip(words, range(len(self.number), len(self.size))))

    def indexes(self, words: list[bytes]) -> np.ndarray:
        """The words' numbers; new ones are learnt."""
        index = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(index < 0)
        if len(new):
            missing = [words[k] for k in new.tolist()]
            self.learn(list(dict.fromkeys(missing)))
            index[new] = np.fromiter(map(self.number.__getitem__, missing), np.int64, len(missing))
        return index

    def __call__(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by the end id, and the texts' numbers of ids."""
        if not self.by_word:
            found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
            parts = [np.array([*e.ids, end_id], np.uint32) for e in found]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if len(self.number) > CACHED_WORDS:
            self.forget()
        words = [self.cut(t) for t in texts]
        counts = np.array([len(line) for line in words], np.int64)
        index = self.indexes(list(chain.from_iterable(words)))
        sizes = self.size[index]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        source = np.arange(upto[-1]) + np.repeat(self.start[index] - upto[:-1], sizes)
        lengths = np.diff(upto[np.concatenate(([0], np.cumsum(counts)))]) + 1
        out = np.full(int(lengths.sum()), end_id, np.uint32)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(lengths) - 1] = False
        out[inner] = self.flat[source]
        return out, lengths


def encoder(definition: str, by_word: bool) -> Encoder:
    """One encoder for each worker process, so that later tasks know the words of earlier ones."""
    state, key = worker_state(), (definition, by_word)
    if state.get("encoder", (None,))[0] != key:
        state["encoder"] = (key, Encoder(definition, by_word))
    return state["encoder"][1]


def write_token_files(
    documents: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int,
    id: str = "doc_id",
    text: str = "text",
    by_word: bool = False,
    share: float = 0.9,
    segment_ids: int = SEGMENT_IDS,
    keep: list[str] | None = None,
) -> None:
    """Write the ids of all documents to ``path``, in ascending order of document ids.

    ``tokenizer`` is the path of a ``tokenizers`` file on the driver; tasks get its content. ``keep`` names the columns that
    go with the documents (default: the id). A segment ends with the document that fills it, and Spark's number of
    shuffle partitions sets how many files are written side by side.
    """
    keep = keep or [id]
    with open(tokenizer, encoding="utf-8") as file:
        definition = documents.sparkSession.sparkContext.broadcast(file.read())
    wanted = list(dict.fromkeys([*keep, id, text]))
    key, tie = F.col(f"`{id}`"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    placed = (
        documents.select(*[f"`{c}`" for c in wanted])
        .repartitionByRange(key, tie)
        .sortWithinPartitions(key, tie, F.col(f"`{text}`"))
        .withColumn("_rs_part", F.spark_partition_id())
    )
    document = T.StructType([documents.schema[c] for c in keep])
    schema = T.StructType(
        [
            T.StructField("part", T.IntegerType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("before", T.LongType()),
            T.StructField("n_docs", T.LongType()),
            T.StructField("n_ids", T.LongType()),
            T.StructField("documents", T.ArrayType(document)),
            T.StructField("lengths", T.BinaryType()),
            T.StructField("ids", T.BinaryType()),
        ]
    )

    def run(batches):
        work = encoder(definition.value, by_word)
        part = segment = before = 0
        rows, ids, lengths = [], [], []

        def flush():
            nonlocal segment, before, rows, ids, lengths
            numbers, sizes = np.concatenate(ids), np.concatenate(lengths)
            kinds = [r.type for r in rows[0]]
            columns = [pa.concat_arrays([r[k] for r in rows]) for k in range(len(kinds))]
            held = pa.StructArray.from_arrays(columns, names=keep)
            listed = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([segment], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([len(sizes)], pa.int64()),
                    pa.array([len(numbers)], pa.int64()),
                    listed,
                    pa.array([encode(sizes.astype(np.uint32), share)], pa.binary()),
                    pa.array([encode(numbers, share)], pa.binary()),
                ],
                names=schema.names,
            )
            segment, before = segment + 1, before + len(numbers)
            rows, ids, lengths = [], [], []
            return made

        for piece in slices(batches, text, 2 << 20):
            part = piece.column("_rs_part")[0].as_py()
            numbers, sizes = work(raw(piece.column(text)), end_id)
            rows.append([piece.column(c) for c in keep])
            ids.append(numbers)
            lengths.append(sizes)
            if sum(map(len, ids)) >= segment_ids:
                yield flush()
        if rows:
            yield flush()

    placed.mapInArrow(run, schema).write.parquet(path)


def read_token_files(spark, path: str, with_ids: bool = True) -> DataFrame:
    """One row for each document of the files: the columns it was written with, ``start`` (ids of all documents before it),
    ``n_tokens``, ``ids_crc32`` (of the ids as little-endian 32-bit numbers) and, if wanted, ``ids``.

    What the driver gathers is one number for each partition that was written.
    """
    segments = spark.read.parquet(path)
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    starts, total = {}, 0
    for row in sorted(sums, key=lambda r: r["part"]):
        starts[row["part"]] = total
        total += row["n"]
    document = segments.schema["documents"].dataType.elementType
    results = ["start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    passed = kept_columns(segments, results, document.names)
    schema = T.StructType([document[c] for c in passed])
    for name in results:
        schema = schema.add(name, T.LongType() if name != "ids" else T.ArrayType(T.LongType()))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                part, before = batch.column("part")[k].as_py(), batch.column("before")[k].as_py()
                lengths = decode(batch.column("lengths")[k].as_py()).astype(np.int64)
                numbers = decode(batch.column("ids")[k].as_py())
                ends = np.cumsum(lengths)
                data = numbers.astype("<u4").tobytes()
                cuts = zip((4 * (ends - lengths)).tolist(), (4 * ends).tolist())
                held = batch.column("documents")[k].values
                arrays = [
                    pa.array(starts[part] + before + ends - lengths),
                    pa.array(lengths),
                    pa.array([zlib.crc32(data[a:b]) for a, b in cuts], pa.int64()),
                ]
                if with_ids:
                    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                    arrays.append(pa.ListArray.from_arrays(offsets, pa.array(numbers.astype(np.int64))))
                yield pa.RecordBatch.from_arrays([held.field(c) for c in passed] + arrays, names=schema.names)

    return segments.select("part", "before", "documents", "lengths", "ids").mapInArrow(run, schema)


def token_table(documents: DataFrame, tokenizer: str, end_id: int, with_ids: bool = False, **options) -> DataFrame:
    """Write the files to a new path in the shared folder and read them back."""
    spark = documents.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_files(documents, path, tokenizer, end_id, **options)
    return read_token_files(spark, path, with_ids)
