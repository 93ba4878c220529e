"""Secrets and personal data against plain regular expressions; URL rules against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ranksmith.llm import pii, secrets, urls
from ranksmith.llm.queries import RULES

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)


def plain_secrets(text):
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return found + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


def plain_personal(text):
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    found = [("email", *m.span()) for m in re.finditer(email, text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in re.sub("[ -]", "", m[0])][::-1]
        total = sum(digits[::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.findall("[0-9]", m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def fuzz(parts, n=1500):
    draw = random.Random(5)
    return ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 14))) for _ in range(n)]


def test_base_secrets_equal_plain_patterns():
    parts = ["password", "API_KEY", "token", "ſecret", "secret", ":", "=", " ", '"', "'", "AKIA", "AKI", "ABCDEFGH1234567"]
    parts += ["deadbeef", "0123456789abcdef", "abcDEF012345", "x", "é", ".", "-", "zz"]
    for text in fuzz(parts):
        assert sorted(secrets.base_spans(text)) == sorted(plain_secrets(text)), text


def test_base_personal_data_equal_plain_patterns():
    parts = ["a", "b.c", "@", ".", "x-y", "_", "1", "255", "256", "4111111111111111", "1111", "4111", " ", "-", "+", "(", ")"]
    parts += ["555", "é", "%", "٣"]
    for text in fuzz(parts, 4000):
        found = [s for s in pii.confirmed(text) if s[0] != "iban"]
        assert sorted(found) == sorted(plain_personal(text)), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "+1" + " " * 300_000, "@" * 100_000, "1." * 100_000, "f" * 300_000):
        pii.confirmed(text)
        secrets.base_spans(text)


def test_address_parts_of_any_length():
    zeros = "0" * 5000
    assert pii.confirmed(f"{zeros}7.1.{zeros}.3") == [("ip", 0, 10006)]
    assert pii.confirmed(f"{zeros}256.1.2.3") == []
    assert pii.confirmed("9" * 5000 + ".1.2.3") == []


def test_novelty_tells_random_strings_from_known_ones():
    novelty = secrets.Novelty()
    random_text = "auth header is Zk93jXq27LmPv84TnRw05Ys here"
    known = "authorization application/json content-type application/json here"
    a = random_text.index("Zk93")
    assert novelty(random_text, a, a + 23, 400) > 0.75
    b = known.index("content-type")
    assert novelty(known, b, b + 29, 400) < 0.6


def test_secrets_add_novel_strings_and_keep_base(spark):
    rows = [
        (1, "private credential Zk93jXq27LmPv84TnRw05Ys end"),
        (2, "a plain sentence about Zk93jXq27LmPv84TnRw05Ys without context"),
        (3, "password = abcdefghijkl"),
        (4, None),
        (5, "credential application/json1 and so on"),
    ]
    found = {r["id"]: r["secrets"] for r in secrets.find_secrets(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert [s["kind"] for s in found[1]] == ["novel"] and found[1][0]["start"] == 19 and found[1][0]["end"] == 42
    assert found[2] == [] and found[4] == [] and found[5] == []
    assert [(s["kind"], s["start"], s["end"]) for s in found[3]] == [("assign", 0, 23)]


def test_iban_needs_its_checksum_and_words_move_scores(spark):
    good, bad = "DE89 3704 0044 0532 0130 00", "DE88 3704 0044 0532 0130 00"
    rows = [(1, f"my bank account {good} BIC"), (2, f"my bank account {bad} BIC"), (3, "mail a@b.cd"), (4, "x a@b.cd")]
    found = {r["id"]: r["personal"] for r in pii.find_personal(spark.createDataFrame(rows, "id int, text string")).collect()}
    ibans = [(s["start"], s["end"]) for s in found[1] if s["kind"] == "iban"]
    assert ibans == [(16, 16 + len(good))]
    assert not [s for s in found[2] if s["kind"] == "iban"]
    assert found[3][0]["score"] > found[4][0]["score"]


@pytest.mark.parametrize("find", [secrets.find_secrets, pii.find_personal])
def test_all_rows_come_back(find, documents, empty, rows):
    found = find(documents)
    assert Counter(r["doc_id"] for r in found.collect()) == Counter(r[0] for r in rows)
    assert found.columns[:5] == documents.columns
    assert find(empty).count() == 0


def plain_verdict(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [
        (len(h + p), len(h), action, h + p)
        for h, p, action in RULES
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, 0, "allow", None))
    return host, path, best[3], best[2]


def test_url_verdicts(spark):
    parts = ["http://", "x", "HTTPS://", "a.", "Example.", "example.net", "net", "org", "com", "/", "/en/", "fr/", "/de/", "?", "#", "É"]
    values = [None, "", "://", "no scheme", "http://net/", "http://a.net", "http://anet/", *fuzz(parts, 3000)]
    values += ["http://a.net/x"] * 50
    pages = spark.createDataFrame([(i, v, "old") for i, v in enumerate(values)], "page_id int, url string, HOST string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    found = urls.judge_urls(pages, rules)
    assert found.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    got = {r["page_id"]: tuple(r)[2:] for r in found.collect()}
    assert got == {i: plain_verdict(v) for i, v in enumerate(values)}
    assert urls.judge_urls(pages.where("page_id < 0"), rules).count() == 0
    none = urls.judge_urls(pages, rules.where("host = ''"), default="block")
    assert {r["verdict"] for r in none.collect()} == {"block"}


def test_ties_between_rules(spark):
    rules = [("a.net", "/", "allow"), ("net", "/bb", "block"), ("net", "/bb", "allow"), ("net", "/c", "other")]
    rules = spark.createDataFrame(rules, "host string, path string, action string")
    pages = spark.createDataFrame([("http://a.net/bb",), ("http://b.net/bb",), ("http://b.net/c",)], "url string")
    got = {r["url"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect()}
    assert got["http://a.net/bb"] == ("a.net/", "allow")  # equal length: the longer host
    assert got["http://b.net/bb"] == ("net/bb", "block")  # the same rule twice: block
    assert got["http://b.net/c"] == (None, "allow")


TOKEN = "Zk93jXq27LmPv84TnRw05Ys6BdHc1Ga"


def novel(text):
    base = secrets.base_spans(text)
    return sorted(s[1:3] for s in secrets.novel_spans(text, base, secrets.Novelty(), 40, 400, 0.8))


def places(text, token=TOKEN):
    return [(m.start(), m.end()) for m in re.finditer(re.escape(token), text)]


def test_a_secret_that_stands_twice_is_found_at_each_place():
    line = f"Authorization: Bearer {TOKEN}\n"
    assert novel(line) == places(line)
    assert novel(line * 2) == places(line * 2) and len(line * 2) < 110
    passage = f"curl -H 'Authorization: Bearer {TOKEN}' https://example.com/v1/items and so on. "
    assert novel(passage * 3) == places(passage * 3)
    text = f"private credential {TOKEN} is {'never written down by any of us, ' * 3}{TOKEN} end"
    assert novel(text) == places(text)
    # The second copy is cut by the end of the surroundings; the other one stands in a base span.
    text = line + "x " * 185 + line
    assert novel(text) == places(text)
    text = f"token={TOKEN}\nAuthorization: Bearer {TOKEN}"
    assert novel(text) == places(text)[1:]
    assert novel("see document-container-1 and document-container-1 here, credential application/json1") == []


def test_long_tokens_are_found_whole():
    draw = random.Random(2)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n, alphabet in ((600, letters), (1700, letters + "+/"), (6000, letters), (6000, letters + "+/")):
        token = "Q7" + "".join(draw.choice(alphabet) for _ in range(n))
        text = f'private_key: {token}== and {"words " * 30}'
        assert novel(text) == [(13, 13 + n + 4)], n
        assert novel(text + "\n" + text) == places(text + "\n" + text, token + "=="), n
    # A candidate may begin up to the limit, not behind it; none is searched for beyond.
    for gap in (40, 41):
        assert novel("key" + " " * gap + TOKEN) == ([(43, 43 + len(TOKEN))] if gap == 40 else [])
    assert novel("key " * 100_000) == [] and novel("key1" * 30_000) == []


def test_ibans_in_lists_and_behind_references():
    german, british = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    spans = lambda text: [text[a:b] for a, b in pii.ibans(text)]
    assert spans(f"{german} {british}") == [german, british]
    assert spans(f"{british} {german} {british} end") == [british, german, british]
    assert spans(f"EU27 {german}") == [german]
    assert spans(f"REF AB12 CD34 {british}, {german}") == [british, german]
    assert spans(german.replace(" ", "") + " " + british.replace(" ", "")) == [german.replace(" ", ""), british.replace(" ", "")]
    assert len(spans(f"{german} " * 10_000)) == 10_000
    assert spans("AB12 " * 50_000) == []


def test_context_decides_on_an_iban(spark):
    good, other = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"
    far = " filler" * 20
    rows = [(1, f"order {good} shipped"), (2, f"pay to account {good}"), (3, f"iban: {good}, {other};{far} {good}"), (4, f"{other} bank")]
    table = spark.createDataFrame(rows, "id int, text string")
    found = {r["id"]: [(s["kind"], s["score"]) for s in r["personal"] if s["kind"] == "iban"] for r in pii.find_personal(table).collect()}
    assert found == {1: [], 2: [("iban", 0.6)], 3: [("iban", 0.6)] * 2, 4: [("iban", 0.6)]}
    held = pii.find_personal(table, least_score=0.3).collect()
    assert [sum(s["kind"] == "iban" for s in r["personal"]) for r in sorted(held)] == [1, 1, 3, 1]


def test_candidates_need_not_mix_letters_and_digits():
    for token in ("QzKxwVjHtRpLmnBcDy", "9471-0302-6584-7109", TOKEN):
        line = f"private credential {token} end"
        assert novel(line) == places(line, token)
    for plain in ("internationalization", "INTERNATIONALIZATION", "Internationalization", "AbstractFactoryModule", "1111111111111111"):
        assert novel(f"private credential {plain} end") == []


def test_dumps_of_keys_take_linear_time():
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"))
    keys = ["".join(rng.choice(letters, 24)) for _ in range(4000)]
    dump = "\n".join(f"token = {k:032x} auth {key}" for k, key in enumerate(keys))
    assert len(novel(dump)) >= 3600


def test_the_dictionary_is_learnt_from_the_documents(spark):
    rows = [(i, f"credential of the ZebraFarmGateway module {TOKEN if i == 3 else ''}") for i in range(6)] + [(9, None), (10, "zebra alone")]
    table = spark.createDataFrame(rows, "id int, text string")
    learnt = secrets.learnt_identifiers(table, "text", 400).split()
    assert set(learnt) == {"credential", "module"}  # the others are too short, or as long as a secret
    assert secrets.learnt_identifiers(table, "text", 400, most=1).split() == [learnt[-1]]
    spans = {r["id"]: [s["kind"] for s in r["secrets"]] for r in secrets.find_secrets(table).collect()}
    assert spans[3] == ["novel"] and spans[9] == []


def test_very_long_hosts(spark):
    host = "a." * 70_000 + "example.net"
    pages = spark.createDataFrame([(1, f"http://{host}/en/x"), (2, "http://." + "." * 5000 + "net/"), (3, "http://x.net./")], "page_id int, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow")}
