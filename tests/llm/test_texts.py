"""Decontamination, repeated strings, fingerprints, scores and token files against plain Python."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ranksmith.llm import components, decontaminate, packing, ppm, simhash, suffixdedup, tokenfiles
from ranksmith.llm.queries import tokenizer_path


def data(text):
    return (text or "").encode()


def counted(found, *columns):
    return Counter(tuple(r[c] for c in columns) if columns[1:] else r[columns[0]] for r in found.collect())


# Decontamination


def words_of(text):
    return bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in data(text)).split()


def contamination(text, items):
    words, hit, names = words_of(text), set(), set()
    for name, item in items:
        item = words_of(item)
        size = min(10, len(item))
        for k in range(len(item) - size + 1 if item else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == item[k : k + size]:
                    hit.update(range(p, p + size))
                    names.add("null" if name is None else str(name))
    return len(words), len(hit), tuple(sorted(names))


@pytest.mark.parametrize("block_words", [1 << 19, 60])
def test_contamination(spark, documents, rows, texts, block_words):
    items = [(1, texts[3][40:300]), (2, texts[4][:90].upper()), (3, "one two"), (4, None), (5, "..."), (None, "Single")]
    items += [(1, texts[5][10:200]), (10, texts[3][40:300]), (7, "not anywhere at all")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(documents, benchmark, block_words=block_words)
    assert [c for c in found.columns if c.lower() == "n_words"] == ["n_words"]
    got = Counter(
        (r["doc_id"], r["n_words"], sum(h["end"] - h["start"] for h in r["hits"]), tuple(r["item_ids"]))
        for r in found.collect()
    )
    expected = Counter((r[0], *contamination(r[1], items)) for r in rows)
    assert got == expected
    for r in found.collect():
        assert (r["longest_match"] >= 10 or "null" in r["item_ids"] or "3" in r["item_ids"]) == bool(r["hits"])
    clean = decontaminate.clean_documents(documents, benchmark, block_words=block_words)
    assert clean.columns == documents.columns
    assert counted(clean, "doc_id") == Counter(r[0] for r in rows if not contamination(r[1], items)[1])


def longest_match(text, items, window=10):
    """The longest run of words that the text has in common with an item and that holds a window, by plain comparison."""
    words, best = words_of(text), 0
    for item in map(words_of, items):
        size, above = min(window, len(item)), [0] * (len(words) + 1)
        for x in item:
            row = [0] * (len(words) + 1)
            for k, y in enumerate(words):
                row[k + 1] = above[k] + 1 if x == y else 0
            best = max(best, *[n for n in row if size and n >= size], 0)
            above = row
    return best


def test_longest_match_is_each_documents_own(spark):
    rng = np.random.default_rng(8)
    item = [f"w{n}" for n in rng.integers(0, 400, size=300)]
    long = [f"x{n}" for n in rng.integers(0, 3000, size=5000)]
    again = ["a", "b"] * 40 + ["c"] + ["a", "b"] * 30
    items = [" ".join(item), " ".join(long), " ".join(again), "one two three", " ".join(item[100:140] + long[:30])]
    texts = [" ".join(item), " ".join(item[:50]), " ".join(["z", *item[20:60], "z", *item[200:290]]), " ".join(long)]
    texts += [" ".join(long[1000:4000]), " ".join(["a", "b"] * 200), " ".join(["b", "a"] * 20 + ["c"] + ["a", "b"] * 12), "one two three four"]
    texts += [" ".join(item[95:140] + long[:25]), " ".join(item[:9]), " ".join(item[:12] + item[5:30])]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    expected = {k: longest_match(x, items) for k, x in enumerate(texts)}
    assert expected[1] == 50 and expected[3] == 5000 and expected[9] == 0
    for parts, shard in ((1, 1 << 21), (11, 1 << 21), (2, 200)):
        table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).repartition(parts)
        before = decontaminate.found_in.__defaults__
        decontaminate.found_in.__defaults__ = (shard,)
        try:
            found = decontaminate.find_contamination(table, benchmark).collect()
        finally:
            decontaminate.found_in.__defaults__ = before
        assert {r["doc_id"]: r["longest_match"] for r in found} == expected


def test_contamination_of_nothing(documents, empty, rows):
    benchmark = documents.select(F.col("doc_id").alias("item_id"), "text")
    assert decontaminate.find_contamination(empty, benchmark).count() == 0
    none = decontaminate.find_contamination(documents, benchmark.where("item_id < -1"))
    assert none.where("size(hits) > 0").count() == 0 and none.count() == len(rows)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for high, depth in ((2, 64), (4, 16), (1000, 8)):
        ids = rng.integers(0, high, size=300).astype(np.uint32)
        found = decontaminate.suffix_array(ids, np.arange(300), depth)
        rest = [tuple(ids[p : p + depth].tolist()) for p in found.tolist()]
        assert rest == sorted(rest)


# Repeated strings


def without_repeats(values, length):
    where = defaultdict(int)
    for v in values:
        for p in range(len(v) - length + 1):
            where[v[p : p + length]] += 1
    out = []
    for v in values:
        gone = np.zeros(len(v) + 1, int)
        for p in range(len(v) - length + 1):
            if where[v[p : p + length]] > 1:
                gone[p : p + length] = 1
        runs = int((np.diff(gone, prepend=0) == 1).sum())
        out.append((len(v), int(gone.sum()), runs, bytes(b for b, g in zip(v, gone) if not g)))
    return out


@pytest.mark.parametrize("length,gram", [(400, 128), (400, 64), (100, 16)])
def test_repeats(documents, rows, length, gram):
    found = suffixdedup.remove_repeats(documents, length=length, gram=gram)
    expected = without_repeats([data(r[1]) for r in rows], length)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found.collect())
    assert got == Counter((r[0], *e) for r, e in zip(rows, expected))
    assert sum(e[1] for e in expected) > 0


def test_repeats_with_partial_overlaps(spark):
    """Windows that repeat through different partners, and equal anchors in different surroundings."""
    rng = np.random.default_rng(2)
    letters = np.array(list("abcdefgh"))
    core = "".join(rng.choice(letters, 150))
    side = lambda n: "".join(rng.choice(letters, n))
    left, right = side(120), side(120)
    values = [side(50) + left[-k:] + core + right[: 130 - k] + side(60) for k in (0, 20, 45, 46, 60, 61, 90, 119)]
    values += [left + core + right, side(10) + left[60:] + core + side(90), core, core + right[:60]]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id int, text string")
    for length in (150, 200, 260):
        found = suffixdedup.remove_repeats(table, length=length, gram=32).orderBy("doc_id").collect()
        got = [(r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in found]
        assert got == without_repeats([v.encode() for v in values], length)


def test_repeats_of_nothing(empty):
    assert suffixdedup.remove_repeats(empty).count() == 0


# Fingerprints


def plain_fingerprint(text, size=4):
    words = data(text).lower().split()
    if not words:
        return 0
    n = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, radius):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_groups_of_documents(documents, rows, empty):
    found = simhash.near_duplicates(documents)
    prints = [plain_fingerprint(r[1]) for r in rows]
    members = defaultdict(list)
    for root, row in zip(groups(prints, 4), rows):
        members[root].append(row[0])
    expected = Counter()
    for own in members.values():
        least = min((i for i in own if i is not None), default=None)
        expected.update((i, least) for i in own)
    assert counted(found, "doc_id", "component_id") == expected
    assert Counter(r["fingerprint"] for r in found.collect()) == Counter(f"{p:016x}" for p in prints)
    one = simhash.one_of_each(documents)
    assert one.columns == documents.columns
    assert counted(one, "doc_id") == Counter(min(i for i in own if i is not None) for own in members.values())
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("radius,blocks,bucket_rows", [(4, 6, 4096), (4, 6, 40), (3, 5, 4096), (7, 9, 30)])
def test_links_of_many_near_fingerprints(spark, radius, blocks, bucket_rows):
    """Chains of single-bit steps, dense clusters around one value, and random ones."""
    rng = np.random.default_rng(radius)
    values = {int(v) for v in rng.integers(0, 2**63, size=150)}
    for start in list(values)[:12]:
        for _ in range(25):
            for bit in rng.integers(0, 64, size=radius):
                start ^= 1 << int(bit)
            values.add(start)
    center = int(rng.integers(0, 2**63))
    values |= {center ^ (1 << a) ^ (1 << b) for a in range(16) for b in range(a)}
    values = sorted(values)
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    table = spark.createDataFrame(signed, "_rs_fp bigint")
    edges = simhash.links(simhash.units(table, blocks, radius, bucket_rows), radius)
    found = {r["node"]: r["root"] for r in components.connected(edges).collect()}
    roots = [found.get(s, s) for (s,) in signed]
    expected = groups(values, radius)
    assert len(set(zip(roots, expected))) == len(set(roots)) == len(set(expected))


def test_connected_path_star_and_nothing(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    edges = spark.createDataFrame(path + star, "a bigint, b bigint")
    found = {r["node"]: r["root"] for r in components.connected(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1400)}
    assert components.connected(edges.where("a < 0")).count() == 0


# Scores


def plain_ppm(texts, trained, order):
    """Log10 probabilities with escapes and exclusion, from dictionaries of followers."""
    followers = defaultdict(Counter)
    for text, train in zip(texts, trained):
        if train:
            line = [255] * order + list(text) + [255]
            for i in range(order, len(line)):
                for k in range(order + 1):
                    followers[tuple(line[i - k : i])][line[i]] += 1
    out = []
    for text in texts:
        line, total = [255] * order + list(text) + [255], 0.0
        for i in range(order, len(line)):
            ruled = set()
            for k in range(order, -1, -1):
                own = followers.get(tuple(line[i - k : i]))
                if own is None:
                    continue
                left = {s: n for s, n in own.items() if s not in ruled}
                weight = sum(left.values()) + len(left)
                if line[i] in left:
                    total += math.log10(left[line[i]] / weight)
                    break
                if left:
                    total += math.log10(len(left) / weight)
                ruled |= set(own)
            else:
                total -= math.log10(256 - len(ruled))
        out.append(total)
    return out


@pytest.mark.parametrize("group_bytes,order", [(48 << 20, 4), (5000, 2)])
def test_scores(documents, rows, empty, monkeypatch, group_bytes, order):
    monkeypatch.setattr(ppm, "LEAST_BYTES", 4000)
    trains = F.col("doc_id") % 3 != 0
    found = ppm.score_documents(documents, trains, order=order, group_bytes=group_bytes)
    values, learned = [data(r[1]) for r in rows], [r[0] is not None and r[0] % 3 != 0 for r in rows]
    tokens = [[*v.lower().split(), None] for v in values]
    counts = Counter(w for line, train in zip(tokens, learned) if train for w in line)
    n, floor = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    expected = {}
    for row, line, score in zip(rows, tokens, plain_ppm(values, learned, order)):
        base = sum(math.log10((counts[w] + 0.1) / floor) for w in line)
        expected[(row[0], row[1])] = (len(line), sum(counts[w] > 0 for w in line), n, base, score)
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        want = expected[(r["doc_id"], r["text"])]
        assert tuple(r[c] for c in ("n_tokens", "n_known", "train_tokens")) == want[:3]
        assert r["base_score"] == pytest.approx(want[3], rel=1e-9)
        assert r["score"] == pytest.approx(want[4], rel=1e-9)
    assert ppm.score_documents(empty, trains).count() == 0


def test_scores_without_training(documents):
    found = ppm.score_documents(documents, F.lit(False))
    for r in found.collect():
        assert r["n_known"] == r["train_tokens"] == 0
        assert r["score"] == pytest.approx(-(len(data(r["text"])) + 1) * math.log10(256))


def test_the_trie_predicts_held_out_text_better_than_its_letters_alone(documents):
    found = ppm.score_documents(documents, F.col("doc_id") % 4 != 0).where("doc_id % 4 = 0").collect()
    alone = ppm.score_documents(documents, F.col("doc_id") % 4 != 0, order=1).where("doc_id % 4 = 0").collect()
    assert sum(r["score"] for r in found) > 1.2 * sum(r["score"] for r in alone)


# Token files


@pytest.mark.parametrize("share", [0.5, 0.9, 1.0])
def test_blocks_round_trip(share):
    rng = np.random.default_rng(4)
    cases = [[], [7], [0] * 128, list(range(129)), [2**32 - 1, 0] * 100, [2**32 - 1] * 300]
    cases += [rng.integers(0, 1 << int(b), size=int(n)).tolist() for b, n in zip(rng.integers(1, 33, 30), rng.integers(1, 700, 30))]
    cases.append(np.where(rng.random(5000) < 0.03, rng.integers(0, 2**32, 5000), rng.integers(900, 960, 5000)).tolist())
    for case in cases:
        numbers = np.array(case, np.uint32)
        packed = packing.encode(numbers, share)
        assert packing.decode(packed).tolist() == case
        for a, b in ((0, 1), (1, 130), (127, 129), (len(case) // 2, len(case)), (5, 5)):
            assert packing.decode(packed, a, b).tolist() == case[a:b]
    skewed = packing.encode(np.array(cases[-1], np.uint32), 0.9)
    assert len(skewed) < 5000 * 2 and len(packing.encode(np.array(cases[-1], np.uint32), 1.0)) > len(skewed)


@pytest.mark.parametrize("by_word,segment_ids", [(True, 1 << 20), (False, 500), (True, 500)])
def test_token_table(documents, rows, empty, by_word, segment_ids):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    options = {"by_word": by_word, "segment_ids": segment_ids, "keep": ["doc_id", "lang"]}
    found = tokenfiles.token_table(documents, tokenizer_path(), 1, with_ids=True, **options)
    lines = [(r[0], r[2], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]) for r in rows]
    got = sorted(found.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert Counter((r["doc_id"], r["lang"], tuple(r["ids"]), r["ids_crc32"]) for r in got) == Counter(
        (i, lang, tuple(ids), crc(ids)) for i, lang, ids in lines
    )
    assert tokenfiles.token_table(empty, tokenizer_path(), 1, **options).count() == 0


def test_words_are_encoded_as_the_tokenizer_does_whole_texts():
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as file:
        encoder = tokenfiles.Encoder(file.read(), by_word=True)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = ["It's  a\x0btest here <|endoftext|> x", "éa ́b", "ΑΣ Σ.", "don't'll we", "", "1234 5\x1c6\x857", "漢字 テスト İ"]
    ids, sizes = encoder([t.encode() for t in texts], 1)
    for text, own in zip(texts, np.split(ids, np.cumsum(sizes)[:-1])):
        assert own.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
