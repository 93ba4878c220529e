"""Vector codes, importance resampling and toxicity against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ranksmith.llm import resampling, toxicity, valuecodes
from ranksmith.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


# Vector codes


def codes(rows, parts, entries, rounds):
    """(id, code, error, label error, digest) of (id, vector, label) rows, by plain loops."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(1024 * x) for x in r[1]] for r in kept]
    width = len(whole[0]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in order] for p in range(parts)]

    def best(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, entry)) for entry in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        near = [[best(v[p], books[p])[0] for v in cut] for p in range(parts)]
        for p in range(parts):
            for e in set(near[p]):
                own = [v[p] for v, n in zip(cut, near[p]) if n == e]
                books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    found = [[best(v[p], books[p]) for p in range(parts)] for v in cut]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(f[1] for f in row) for row in found]
    by_label = Counter()
    for r, e in zip(kept, errors):
        by_label[r[2]] += e
    return Counter((r[0], "".join(f"{f[0]:02x}" for f in row), e, by_label[r[2]], digest) for r, row, e in zip(kept, found, errors))


def vectors(spark, rows):
    given = [(*r, "x") for r in rows]
    return spark.createDataFrame(given, "vec_id long, embedding array<float>, label int, CODE string").repartition(3)


@pytest.mark.parametrize("entries, rounds", [(256, 4), (8, 4), (5, 0)])
def test_codes(spark, entries, rounds):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=8) * 0.2).astype(np.float32).tolist(), [0, 1, None][k % 3]) for k in range(70)]
    rows += [rows[3], (3, rows[9][1], 7), (None, rows[4][1], 1), (90, rows[5][1], None), (91, [0.0] * 8, 1), (92, [-0.0] * 8, 2)]
    rows += [(93, None, 0), (94, [1.0] * 7 + [None], 0), (95, [float("nan")] * 8, 0), (96, [1.0] * 7 + [float("-inf")], 1)]
    found = valuecodes.code_vectors(vectors(spark, rows), entries=entries, rounds=rounds)
    assert [c for c in found.columns if c.lower() == "code"] == ["code"] and "embedding" in found.columns
    got = Counter(tuple(r) for r in found.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())
    assert got == codes(rows, 4, entries, rounds)


def test_codes_in_small_blocks_and_wide_numbers(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=4) * 3e4).astype(np.float32).tolist(), k % 2) for k in range(40)]
    table = vectors(spark, rows)
    for size in (4096, 7):
        monkeypatch.setattr(valuecodes, "BLOCK_ROWS", size)
        found = valuecodes.code_vectors(table, parts=2, entries=6, rounds=3, keep=["vec_id"])
        assert Counter(map(tuple, found.collect())) == codes(rows, 2, 6, 3)


def test_codes_of_nothing_and_of_odd_lengths(spark):
    none = vectors(spark, [(1, None, 0), (2, [float("nan")] * 4, None)])
    assert valuecodes.code_vectors(none).count() == 0
    assert valuecodes.code_vectors(none.where("vec_id < 0")).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        valuecodes.code_vectors(vectors(spark, [(1, [1.0] * 4, 0), (2, [1.0] * 8, 0)]))
    with pytest.raises(ValueError, match="equal parts"):
        valuecodes.code_vectors(vectors(spark, [(1, [1.0] * 6, 0)]))
    with pytest.raises(ValueError, match="64 bits"):
        valuecodes.code_vectors(vectors(spark, [(1, [1e30] * 4, 0)]))


# Resampling


def resample(rows, targets, longest, least_words, percent):
    """(id, features, weight, score, rank) by plain loops."""

    def split(text):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def buckets(text):
        words = split(text)
        runs = [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]
        return [zlib.crc32(r.encode()) % 10_000 for r in runs]

    s, t = (Counter(b for text in texts for b in buckets(text)) for texts in ([r[1] for r in rows], targets))
    n_s, n_t = sum(s.values()) + 10_000.0, sum(t.values()) + 10_000.0
    out = []
    for name, text, *_ in rows:
        own = buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1.0) * n_s / ((s[b] + 1.0) * n_t))) for b in own)
        h = int(hashlib.sha256(f"2024:{'' if name is None else name}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([name, len(own), weight, score, None, len(split(text))])
    able = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("longest, least_words, percent", [(1, 20, 50), (3, 2, 30), (2, 0, 100)])
def test_resampling(spark, documents, rows, texts, longest, least_words, percent):
    targets = [texts[3][:200], texts[5].upper(), None, "", "one two", "a\x00b c-d"]
    target = spark.createDataFrame([(t,) for t in targets], "text string")
    found = resampling.resample(documents, target, longest=longest, least_words=least_words, percent=percent)
    assert "N_WORDS" in found.columns
    got = Counter(tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == resample(rows, targets, longest, least_words, percent)


def test_resampled_documents(spark, documents, rows, empty):
    target = spark.createDataFrame([("nothing in common",)], "passage string")
    drawn = resampling.resampled_documents(documents, target, target_text="passage", percent=50)
    expected = {r[0] for r in resample(rows, ["nothing in common"], 1, 20, 50) if r[4]}
    assert drawn.columns == documents.columns and {r[0] for r in drawn.collect()} == expected
    assert resampling.resample(empty, target, target_text="passage").count() == 0
    none = resampling.resample(documents, target.where("passage is null"), target_text="passage")
    assert none.count() == len(rows)


def test_words_do_not_cross_texts():
    _, document, _ = resampling.features([b"a b", b"", b"c", b"d e f"], 2, 10_000)
    assert Counter(document.tolist()) == {0: 3, 2: 1, 3: 5}


# Queries against their SQL


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_against_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = QUERIES[name](spark, SF_DIR)
    expected = connection.sql(f"SELECT {', '.join(found.columns)} FROM ({ORACLES[name]})")
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    assert [kinds[k] for _, k in found.dtypes] == [str(k) for k in expected.types]
    assert Counter(map(tuple, found.collect())) == Counter(expected.fetchall())


# Toxicity


def test_terms_are_words_and_strings_inside_them():
    text, code = toxicity.terms([b"Abcdef g", b"", b"abcdef", b"xabcdefx abcdef"], 5)
    of = [set(code[text == k].tolist()) for k in range(4)]
    word = toxicity.terms([b"abcdef"], 40)[1].tolist()  # no string is as long, so only the word is left
    assert len(word) == 1 and all(word[0] in of[k] for k in (0, 2, 3)) and not of[1]
    # The word, " abcd", "abcde", "bcdef" and "cdef " count as terms; a blank at an end is none of the letters.
    assert len(of[2]) == 5 and of[2] <= of[0] and of[2] <= of[3]
    marked = np.zeros(1 << toxicity.BITS, bool)
    marked[word] = True
    assert toxicity.terms([b"abcdef abcdef", b"other", b"ABCDEF."], 5, marked)[0].tolist() == [0, 2]


def comments(rng, n):
    """Texts that are toxic if an insult and a group are named; either alone is not."""
    rows = []
    for k in range(n):
        words = rng.choice(["plain", "talk", "about", "weather", "music", "trains", "bread", "garden"], size=30).tolist()
        insult, group = bool(k & 1), bool(k & 2)
        words += ["dreadful"] * insult + ["neighbours"] * group
        rng.shuffle(words)
        rows.append((k, " ".join(words), int(insult and group)))
    return rows


def test_pairs_of_terms_decide(spark):
    rows = comments(np.random.default_rng(5), 800)
    table = spark.createDataFrame([(*r[:2], "s") for r in rows], "doc_id long, text string, SCORE string").repartition(4)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    found = toxicity.score_toxicity(table, labels, trains=F.col("doc_id") % 5 > 0)
    assert [c for c in found.columns if c.lower() == "score"] == ["score"]
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in found.collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[k][1] == y for k, _, y in held) >= 0.98 * len(held)
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())


def test_toxicity_on_the_given_labels(spark):
    found = QUERIES["op13_factorization_machine_toxicity"](spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted")).collect()
    caught, wrong = (dict(map(tuple, rows))[k] for k in (1, 0))
    assert caught > 0.8 and wrong < 0.02


def test_toxicity_without_labels_and_with_odd_texts(spark, documents, rows, empty):
    labels = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(rows)], "doc_id long, toxic int")
    one_kind = labels.where("toxic = 1")
    assert toxicity.score_toxicity(empty, labels).count() == 0
    for given in (labels, one_kind, labels.where("toxic > 1")):
        found = toxicity.score_toxicity(documents, given, rounds=3).collect()
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
    nothing = [r["score"] for r in found if not (r["text"] or "").strip()]
    assert len(set(nothing)) == 1


def test_the_sample_is_a_share_by_id(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "_id")
    assert toxicity.sampled(rows, "_id", 20_000).count() == 20_000
    assert 900 < toxicity.sampled(rows, "_id", 1000).count() < 1100


def test_terms_of_long_texts_in_parts(monkeypatch):
    rng = np.random.default_rng(6)
    word = lambda: bytes(rng.choice(list(b"abcdef"), rng.integers(1, 9)).tolist())
    texts = [b" ".join(word() for _ in range(2000)), b"", b"x" * 300 + b" yy", b" lead  two "]
    whole = toxicity.terms(texts, 5)
    monkeypatch.setattr(toxicity, "PIECE_BYTES", 200)
    assert all(np.array_equal(a, b) for a, b in zip(whole, toxicity.terms(texts, 5)))
