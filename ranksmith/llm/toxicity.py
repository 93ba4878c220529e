"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its words and the strings of ``gram`` bytes inside its words (one byte before or after the word may
belong to them), hashed into 2**18 buckets; a text has a term or has it not. The machine's score is linear in the terms and in
their pairs: a pair weighs the product of the two terms' factors, so that an insult may count for more beside a mention
of a group than either does alone, in time linear in the terms.

1. A sample of labelled rows, by a hash of the id, is joined with the texts; its expected size is bounded by ``sample_rows``,
   so the ids can be broadcast and no text is shuffled.
2. In the sample each bucket's texts are counted by label, in tasks and then by Spark. The ``terms`` buckets that tell most by a
   chi-squared statistic are the machine's inputs.
3. Spark ML fits the machine on the sample.
4. All texts are scored in one pass: terms are hashed by prefix sums over the bytes of a batch, and only those of the
   machine are looked at further.

Defined cases: null and empty texts have no terms and get the score of the constant alone; repeated rows score alike; of several
labels of one id each counts; null labels and ids train nothing; if the sample lacks one of the labels, all texts get the
smoothed share of toxic rows; an empty table gives an empty table; texts of any length are read whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import FMClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, functions as F

from ranksmith.llm.common import guarded, guarded_name, kept_columns, raw, slices, with_results
from ranksmith.storage import written

BITS = 18
GRAM = 5
TERMS = 1024
FACTORS = 8
SAMPLE_ROWS = 20_000
LEAST_TEXTS = 5
PIECE_BYTES = 1 << 20
# Letters A-Z become small, and all ASCII that is neither letter nor digit becomes a space. Bytes from 0x80 on stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256))
BASE = 0x9E3779B97F4A7C15


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1 and so on, modulo 2**64."""
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


def bucket(value: np.ndarray, kind: int) -> np.ndarray:
    """``BITS`` well-mixed bits of hashes of a kind of term."""
    value = value ^ (np.uint64(kind + 1) * np.uint64(0xD6E8FEB8))
    value = (value ^ (value >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (value >> np.uint64(64 - BITS)).astype(np.int64)


def cut(text: bytes, most: int) -> list[bytes]:
    """The text in parts of at most ``most`` bytes or one longer word, cut at blanks, which no term reaches across."""
    parts, start = [], 0
    while len(text) - start > most:
        end = text.rfind(b" ", start, start + most)
        end = text.find(b" ", start + most) if end <= start else end
        if end < 0:
            break
        parts.append(text[start:end])
        start = end
    return [*parts, text[start:]]


def terms(texts: list[bytes], gram: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of all terms, each pair once, in order; with ``wanted`` only the buckets that are marked there."""
    plain = [t.translate(WORDS) for t in texts]
    if max(map(len, plain), default=0) > PIECE_BYTES:
        found = []
        for k, text in enumerate(plain):
            codes = [_terms([part], gram, wanted)[1] for part in cut(text, PIECE_BYTES)]
            found.append(k << BITS | np.unique(np.concatenate(codes)))
        every = np.concatenate(found)
        return every >> BITS, every & ((1 << BITS) - 1)
    return _terms(plain, gram, wanted)


def _terms(plain: list[bytes], gram: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(plain) + b" ", np.uint8)
    starts = 1 + np.cumsum([0, *(len(t) + 1 for t in plain[:-1])])
    size = len(data)
    # A string's hash is that of its letters alone: the difference of two prefix sums, moved to the beginning.
    up, down = powers(BASE, size), powers(pow(BASE, -1, 1 << 64), size)
    prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(up * (data.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)))
    blank = data == 32
    edge = np.diff(blank.view(np.int8))
    first, end = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    blanks = np.concatenate(([0], np.cumsum(blank)))
    at = np.arange(max(0, size - gram + 1))
    # No blank but at one of its two ends, and letters in it.
    inside = (blanks[at + gram - 1] == blanks[at + 1]) & ~(blank[at] & blank[at + gram - 1]) if gram > 1 else ~blank[at]
    at = at[inside]
    found, place = [], []
    for kind, low, high, near in ((0, first, end, first), (gram, at, at + gram, at + blank[at])):
        code = bucket((prefix[high] - prefix[low]) * down[low], kind)
        if wanted is not None:
            told = wanted[code]
            code, near = code[told], near[told]
        found.append(code)
        place.append(near)
    text = np.searchsorted(starts, np.concatenate(place), side="right") - 1
    every = np.unique(text << BITS | np.concatenate(found))
    return every >> BITS, every & ((1 << BITS) - 1)


def sampled(rows: DataFrame, id: str, most: int) -> DataFrame:
    """All rows, or a share of them by a hash of the id that is expected to be ``most`` rows."""
    share = most / max(most, rows.count())
    return rows.where(F.pmod(F.xxhash64(id), F.lit(1 << 31)) < F.lit(math.floor(share * (1 << 31))))


def telling_terms(labelled: DataFrame, gram: int, most: int, least_texts: int) -> tuple[list[int], int, int]:
    """The buckets with the highest chi-squared statistic between term and label, and the numbers of toxic and other texts."""

    def run(batches):
        counts, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for piece in slices(batches, "text", PIECE_BYTES):
            label = piece.column("label").to_numpy()
            text, code = terms(raw(piece.column("text")), gram)
            for k in (0, 1):
                counts[k] += np.bincount(code[label[text] == k], minlength=1 << BITS)
                texts[k] += int((label == k).sum())
        used = np.flatnonzero(counts.any(axis=0))
        codes = np.concatenate(([-1], used))  # -1: all texts
        columns = [np.concatenate(([texts[k]], counts[k][used])) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (codes, *columns)], names=["code", "clean", "toxic"])

    sums = labelled.select("text", "label").mapInArrow(run, "code bigint, clean bigint, toxic bigint")
    sums = written(sums.groupBy("code").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "terms")
    texts = sums.where("code = -1").first()
    clean, toxic = (texts["clean"], texts["toxic"]) if texts else (0, 0)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    c, d = F.lit(float(toxic)) - a, F.lit(float(clean)) - b
    told = (a * d - b * c) * (a * d - b * c) / ((a + b) * (c + d))
    best = sums.where((F.col("code") >= 0) & (a + b >= least_texts) & (c + d > 0)).orderBy(told.desc(), "code").limit(most)
    return [r["code"] for r in best.select("code").collect()], toxic, clean


class Machine:
    """The fitted machine: its buckets and their weights and factors."""

    def __init__(self, codes: list[int], constant: float, weights: np.ndarray, factors: np.ndarray, gram: int):
        self.place = np.full(1 << BITS, -1, np.int32)
        self.place[codes] = np.arange(len(codes))
        self.constant, self.weights, self.factors, self.gram = constant, weights, factors, gram

    @classmethod
    def of(cls, state: dict) -> Machine:
        """From the attributes, as they are broadcast."""
        machine = cls.__new__(cls)
        machine.__dict__ = state
        return machine

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        """Each text's probability of being toxic."""
        text, code = terms(texts, self.gram, self.place >= 0)
        own = self.place[code]
        total = self.constant + np.bincount(text, self.weights[own], minlength=len(texts))
        for factor in self.factors.T:
            value = factor[own]
            sums = np.bincount(text, value, minlength=len(texts))
            total += 0.5 * (sums * sums - np.bincount(text, value * value, minlength=len(texts)))
        return 0.5 * (1 + np.tanh(0.5 * total))


def fit_machine(
    labelled: DataFrame, gram: int, n_terms: int, least_texts: int, factors: int, rounds: int, step: float, penalty: float, seed: int
) -> Machine:
    """A machine for rows (text, label 0 or 1)."""
    codes, toxic, clean = telling_terms(labelled, gram, n_terms, least_texts)
    if not (toxic and clean and codes):
        odds = (toxic + 1) / (clean + 1)
        return Machine([], math.log(odds), np.zeros(0), np.zeros((0, factors)), gram)
    mark = np.zeros(1 << BITS, bool)
    mark[codes] = True
    shared = labelled.sparkSession.sparkContext.broadcast(mark)

    def run(batches):
        for piece in slices(batches, "text", PIECE_BYTES):
            texts = raw(piece.column("text"))
            text, code = terms(texts, gram, shared.value)
            offsets = np.searchsorted(text, np.arange(len(texts) + 1))
            listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(code).cast(pa.string()))
            label = piece.column("label").cast(pa.float64())
            yield pa.RecordBatch.from_arrays([listed, label], names=["terms", "label"])

    rows = written(labelled.select("text", "label").mapInArrow(run, "terms array<string>, label double"), "inputs")
    vectors = CountVectorizerModel.from_vocabulary([str(c) for c in codes], "terms", "features")
    vectors.setBinary(True)
    learner = FMClassifier(factorSize=factors, maxIter=rounds, stepSize=step, regParam=penalty, solver="adamW", seed=seed)
    model = learner.fit(vectors.transform(rows))
    return Machine(codes, model.intercept, model.linear.toArray(), model.factors.toArray(), gram)


def score_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    trains: Column | None = None,
    id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    gram: int = GRAM,
    n_terms: int = TERMS,
    least_texts: int = LEAST_TEXTS,
    factors: int = FACTORS,
    rounds: int = 100,
    step: float = 0.05,
    penalty: float = 1e-4,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 42,
    keep: list[str] | None = None,
) -> DataFrame:
    """The rows with ``score``, the probability that ``label`` is 1, and ``predicted``, 1 from one half on.

    ``labels`` has the column ``id`` too; ``trains``, over that column, says which of them may be learnt from (default: all).
    Of more than ``sample_rows`` such rows a share of that expected size is learnt from.
    """
    passed = kept_columns(documents, ["score", "predicted"], keep)
    table, _ = guarded(documents)
    names = {c: guarded_name(documents, c) for c in passed}
    own, value = guarded_name(documents, id), guarded_name(documents, text)
    given = labels.where(trains) if trains is not None else labels
    given = given.select(F.col(f"`{id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("label"))
    chosen = sampled(given.where("_id is not null and label in (0, 1)"), "_id", sample_rows)
    # At most about ``sample_rows`` rows of two numbers.
    met = table.select(own, F.coalesce(value, F.lit("")).alias("text")).join(F.broadcast(chosen), F.col(own) == F.col("_id"))
    labelled = written(met.select("text", "label"), "labelled")
    machine = fit_machine(labelled, gram, n_terms, least_texts, factors, rounds, step, penalty, seed)
    shared = documents.sparkSession.sparkContext.broadcast(vars(machine))

    def results(column: pa.Array) -> list[pa.Array]:
        score = Machine.of(shared.value)(raw(column))
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    scored = with_results(table, results, "score double, predicted int", value, list(names.values()), PIECE_BYTES)
    return scored.toDF(*names, "score", "predicted")
