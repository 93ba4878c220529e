"""Quality rules and mixing against plain Python."""

import re
from collections import Counter

import numpy as np
import pytest

from ranksmith.llm import mixing, quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update((i, i + 1, i + 2))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_counts_and_rules(documents, rows, empty):
    found = quality.judge_quality(documents)
    assert [c for c in found.columns if c.lower() == "n_words"] == ["n_words"]
    expected = Counter()
    for r in rows:
        counts = plain_counts(r[1])
        expected[(r[0], *counts, counts[0] < 50 or 100 * counts[4] > 50 * counts[0])] += 1
    got = found.collect()
    assert Counter((r["doc_id"], *(r[c] for c in quality.COUNTS), r["base_failed"]) for r in got) == expected
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality.judge_quality(empty).count() == 0
    kept = quality.sound_documents(documents)
    assert kept.columns == documents.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in got if r["kept"])


def test_only_native_steps(documents):
    plan = quality.judge_quality(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


@pytest.fixture(scope="module")
def junk(spark):
    """Prose of two languages, one of them mostly from one source, and some texts full of symbols."""
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), size=int(n))) for n in rng.integers(2, 9, size=4000)]
    rows = []
    for i in range(900):
        text = " ".join(rng.choice(vocabulary, size=int(rng.lognormal(5, 0.5)) + 50))
        if i % 45 == 0:
            text = " ".join(w + "$$#" for w in text.split())
        rows.append((i, text, "en" if i % 3 else "de", "hot" if i % 2 else f"s{i % 7}"))
    return spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")


def test_outliers_go_and_the_rest_stays(junk):
    got = {r["doc_id"]: r for r in quality.judge_quality(junk, keep=["doc_id"]).collect()}
    assert not any(got[i]["kept"] for i in range(0, 900, 45))
    assert sum(not got[i]["kept"] for i in range(900) if i % 45) <= 3


def test_copied_lines_and_words_reject_alone_and_a_notice_does_not(spark, junk):
    rng = np.random.default_rng(12)
    prose = [r["text"].split() for r in junk.where("doc_id % 45 > 0").limit(400).collect()]
    vocabulary = [w for text in prose for w in text]
    draw = lambda n: list(rng.choice(vocabulary, size=n))
    menu, phrase, notice = draw(60), " ".join(draw(10)), " ".join(draw(9))
    lines = ["\n".join(rng.choice(menu, size=n)) for n in (150, 400, 900)]
    half = ["\n".join(f"{' '.join(draw(2))}\n{menu[0]}" for _ in range(n)) for n in (60, 300)]
    words = [" ".join(f"{phrase} {' '.join(draw(13))}" for _ in range(n)) for n in (27, 60)]
    noticed = [f"{notice}\n{' '.join(draw(n))}\n{notice}" for n in (34, 40, 60, 100, 200, 400)]
    bad, good = lines + half + words, noticed + [" ".join(t) for t in prose]
    rows = [(i, t, "en", "one") for i, t in enumerate(bad + good)]
    table = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.judge_quality(table, keep=["doc_id"]).collect()}
    assert not any(got[i]["base_failed"] for i in range(len(bad) + len(noticed)))
    assert not any(got[i]["kept"] for i in range(len(bad)))
    assert all(got[i]["kept"] for i in range(len(bad), len(bad) + len(noticed)))


def test_outliers_do_not_move_the_estimate(junk):
    """Distances of clean rows stay near those found without the outliers."""
    clean = {r["doc_id"]: r["distance"] for r in quality.judge_quality(junk.where("doc_id % 45 > 0")).collect()}
    both = {r["doc_id"]: r["distance"] for r in quality.judge_quality(junk).collect()}
    gap = [abs(both[i] - d) / (1 + d) for i, d in clean.items()]
    assert np.median(gap) < 0.2


def plain_targets(sizes, weights, share, cap):
    full, left = set(), dict(weights)
    while True:
        budget = share * sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        unit = budget / sum(left.values()) if left else 0
        over = {s for s, w in left.items() if unit * w > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return {s: cap * sizes[s] if s in full else unit * weights[s] for s in sizes}
        full |= over
        left = {s: w for s, w in left.items() if s not in over}


def checked(found, n_rows, share=1.5, cap=2.0, weights=(3.0, 1.0, 2.0)):
    got = found.collect()
    assert len(got) == n_rows
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = plain_targets(sizes, {s: weights[k % len(weights)] for k, s in enumerate(order)}, share, cap)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert 0 <= r["taken"] <= cap * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= max(0.01 * targets[s], largest[s])
    return got


def test_mix(documents, rows, empty):
    got = checked(mixing.mix(documents, (3.0, 1.0, 2.0)), len(rows))
    again = mixing.mix(documents.repartition(3, "text"), (3.0, 1.0, 2.0))
    key = lambda r: (r["doc_id"], r["taken"])
    assert Counter(map(key, again.collect())) == Counter(map(key, got))
    assert Counter(r["size"] for r in got) == Counter(len((r[1] or "").encode().split()) for r in rows)
    assert mixing.mix(empty, (3.0, 1.0, 2.0)).count() == 0
    mixed = mixing.mixed_documents(documents, (3.0, 1.0, 2.0))
    assert mixed.columns == documents.columns
    copies = Counter()
    for r in got:
        copies[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +copies


@pytest.mark.parametrize("share,cap", [(0.1, 2.0), (1.5, 2.0), (2.0, 2.0), (2.5, 3.0)])
def test_mix_of_skewed_sources(spark, share, cap):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        source = "hot" if i % 3 == 0 else f"s{i % 11}"
        rows.append((i, " ".join(["w"] * int(rng.lognormal(4, 1.2))), source))
    rows += [(2000, None, "blank"), (2001, "a b", None), (2002, "a " * 5000, "one")]
    table = spark.createDataFrame(rows, "doc_id int, text string, source string")
    checked(mixing.mix(table, (3.0, 1.0, 2.0), share, cap), len(rows), share, cap)


def test_rates_tilt_with_size(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(1, 400)), "up" if i % 2 else "down") for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id int, text string, source string")
    weights = spark.createDataFrame([("up", 4.0), ("down", 1.0)], "source string, weight double")
    got = mixing.mix(table, weights, share=1.0).collect()
    for r in got:
        odds = r["rate"] / (2.0 - r["rate"])
        mean = r["source_size"] / 300
        lam = np.log(odds) * mean / r["size"]
        assert (lam > 0) == (r["source"] == "up")
    for source in ("up", "down"):
        own = [r for r in got if r["source"] == source]
        assert sum(r["rate"] * r["size"] for r in own) == pytest.approx(own[0]["target"], rel=1e-5)


def test_mix_is_native(documents):
    plan = mixing.mix(documents, (3.0, 1.0, 2.0))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_the_estimate_has_the_smaller_determinant_and_has_settled(spark):
    """Against plain numpy: no concentration step from the estimate lowers its determinant, and a cluster of outliers stays outside."""
    rng = np.random.default_rng(12)
    core = rng.normal(size=(900, 5)) * [0.6, 0.5, 0.05, 0.3, 0.3] + [5, 5, 0.2, 1, 1]
    away = rng.normal(size=(200, 5)) * 0.05 + [9, 9, 0.9, 4, 4]
    rows = [("en", *map(float, x)) for x in np.concatenate((core, away))] + [("xx", 1.0, 1.0, 0.1, 0.1, 0.1)] * 3
    table = spark.createDataFrame(rows, "g0 string, " + ", ".join(f"x{i} double" for i in range(5)))
    found = {r["g0"]: r for r in quality.estimates(table, ["g0"], quality.SHARE, 30).collect()}
    own = found["en"]
    mean = np.array([own[f"m{i}"] for i in range(5)])
    factor = np.array([[own[f"l{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
    x = np.concatenate((core, away))
    z = np.linalg.solve(factor, (x - mean).T)
    far = (z * z).sum(axis=0)
    nearest = x[far <= np.quantile(far, quality.SHARE)]
    again = np.cov(nearest.T, bias=True) * quality._inflation(quality.SHARE) + np.diag(np.square(quality.FLOORS))
    assert np.log(np.diag(np.linalg.cholesky(again))).sum() >= np.log(np.diag(factor)).sum() - 2 * quality.SETTLED
    assert far[900:].min() > quality.CUTOFF > np.quantile(far[:900], 0.99)
    assert found["xx"]["m0"] == 1.0


def test_a_mix_that_does_not_converge_is_an_error(spark):
    table = spark.createDataFrame([(i, "w " * (i + 1), "ab"[i % 2]) for i in range(40)], "doc_id int, text string, source string")
    with pytest.raises(RuntimeError, match="iterations"):
        mixing.mix(table, (3.0, 1.0), most=1)
