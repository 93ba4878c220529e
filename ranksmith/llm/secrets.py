"""Secrets: fixed patterns, and strings that a dictionary-primed compressor finds nothing known in.

The patterns report keys by their form. Beyond them, a long token that stands near a sensitive word and mixes kinds of
characters, is a candidate. Its novelty is the number of bytes that Zstandard needs more for the surrounding
text with the token than without it, as a share of what random characters of the token's kinds carry, when the compressor already
knows a dictionary of identifiers and has seen the text around. A token that costs nearly that is random, hence reported.

The dictionary is learnt from the corpus: short identifiers that stand around sensitive words in several documents, the commonest
nearest to the text. Identifiers are shorter than any candidate, so no secret gets into it. Other places of the token are no
surroundings: a secret that stands twice is not known through itself, and all its places are reported.

Defined cases: a null or empty text has no spans; equal rows give equal results; texts of any length are read
whole; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from math import log2

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from ranksmith.llm.common import slices, strings, with_results

# The patterns of the kinds, in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_LENGTH = 12

SENSITIVE_WORDS = ("key", "auth", "bearer", "credential", "pwd", "private", "signature", "passw", "secret", "token")
SENSITIVE = re.compile("|".join(SENSITIVE_WORDS), re.I | re.A)
LEAST_LENGTH = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[^=]+=*")

# Identifiers that code and configuration repeat; no secret among them.
IDENTIFIERS = (
    "import return function class const static public private protected string integer boolean object array "
    "config configuration environment variable parameter argument default value version release build "
    "username password passwd secret token apikey api_key access_key client_id client_secret credentials "
    "authorization bearer basic signature certificate private_key public_key session cookie header request "
    "response endpoint server hostname address port database connection localhost example com http https www "
    "content-type application/json text/html charset utf-8 index document element container module package "
    "install requirements dependency resource controller service manager factory handler provider repository "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 lorem ipsum dolor sit amet"
)

# What the dictionary learns: so many identifiers of these lengths, in so many documents at least.
IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z_][A-Za-z_-]{3,14}(?![A-Za-z0-9_-])")
LEARNT = 1000
LEAST_DOCUMENTS = 3
# A task sends its counts on when it has so many.
PENDING_WORDS = 1 << 17

# Letters of random case change it at every second step.
CASE_CHANGES = 0.45

# Bytes of a token that are judged at once.
PIECE = 512

SPAN = "array<struct<kind:string,start:bigint,end:bigint,novelty:double>>"


def core(token: str) -> str:
    """What names a token at its other places: the part behind its last ``=`` that is no padding, if long enough."""
    last = token.rstrip("=").rpartition("=")[2]
    return last if len(last) >= LEAST_LENGTH else token


def surroundings(text: str, start: int, end: int, around: int) -> str:
    """``around`` code points on either side of a token, without its other places there, whole or cut."""
    name = core(text[start:end])
    kept = []
    for low, high, first, last in ((max(0, start - around), start, 0, start), (end, end + around, end, len(text))):
        at, high = low, min(high, last)
        place = text.find(name, max(first, low - len(name)), min(last, high + len(name)))
        while place >= 0:
            kept.append(text[at : max(at, min(place, high))])
            at = max(at, place + len(name))
            place = text.find(name, place + len(name), min(last, high + len(name)))
        kept.append(text[at : max(at, high)])
    return "".join(kept)


def byte_share(token: str) -> float:
    """The share of a byte that a random character carries, of the kinds that the token has: digits, small letters, capitals, signs."""
    kinds = (any("0" <= c <= "9" for c in token), any("a" <= c <= "z" for c in token), any("A" <= c <= "Z" for c in token))
    return log2(max(2, 10 * kinds[0] + 26 * kinds[1] + 26 * kinds[2] + 2 * any(c in "+/_=-.\"': " for c in token))) / 8


class Novelty:
    """Marginal compressed bytes of a token in its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 3):
        content = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(
            level=level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False
        )

    def __call__(self, text: str, start: int, end: int, around: int) -> float:
        """Marginal bytes as a share of those that a random token of the same length carries."""
        known = surroundings(text, start, end, around).encode()
        token = text[start:end].encode()
        # Long tokens are judged piece by piece: over thousands of bytes an entropy coder saves a quarter of any such alphabet.
        pieces = [token[k : k + PIECE] for k in range(0, len(token), PIECE)]
        alone = len(self.pack.compress(known))
        return sum(len(self.pack.compress(known + piece)) - alone for piece in pieces) / (len(token) * byte_share(text[start:end]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The matches of the fixed patterns, kind by kind."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def likely(token: str) -> bool:
    """Letters with digits, digits alone, or letters whose case changes more often than in names put together of words."""
    if any(c.isdigit() for c in token):
        return True
    changes = sum(a.islower() != b.islower() for a, b in zip(token, token[1:]))
    return changes >= CASE_CHANGES * (len(token) - 1)


def novel_spans(text, base, novelty, within: int, around: int, least: float):
    """Tokens near a sensitive word, outside the base spans, that cost ``least`` of their length or more."""
    lowered = text.lower()
    if not any(w in lowered for w in SENSITIVE_WORDS):
        return []
    found, names, done = [], {}, 0
    starts, ends = sorted(a for _, a, _ in base), sorted(b for _, _, b in base)
    for word in SENSITIVE.finditer(text):
        # Only the start of a candidate is bounded: its first characters lie before the limit, its end where it ends.
        limit = word.end() + within + LEAST_LENGTH
        while begun := CANDIDATE.search(text, max(done, word.end()), limit):
            m = CANDIDATE.match(text, begun.start())
            done = m.end()
            token = m.group()
            if likely(token) and not overlaps(starts, ends, *m.span()):
                score = novelty(text, *m.span(), around)
                if score >= least:
                    found.append(("novel", *m.span(), score))
                    names[core(token)] = score
    return found + other_places(text, base + [f[:3] for f in found], names) if names else found


def overlaps(starts: list[int], ends: list[int], a: int, b: int) -> bool:
    """Whether a span from a to b meets one of those with these sorted starts and ends: if not, as many begin before its end as end
    before its start."""
    return bisect_left(starts, b) != bisect_right(ends, a)


def other_places(text, taken, names):
    """The places outside the spans ``taken`` where a token that was found novel stands as a word or behind a ``=``."""
    found = []
    starts, ends = sorted(a for _, a, _ in taken), sorted(b for _, _, b in taken)
    for m in CANDIDATE.finditer(text):
        for a, b in [m.span(), *(p.span() for p in PART.finditer(text, *m.span()))]:
            score = names.get(core(text[a:b]))
            if score is not None and not overlaps(starts, ends, a, b):
                found.append(("novel", a, b, score))
                break
    return found


def identifiers_around(text: str, around: int) -> set[str]:
    """The identifiers within ``around`` code points of a sensitive word."""
    found, done = set(), 0
    lowered = text.lower()
    if not any(w in lowered for w in SENSITIVE_WORDS):
        return found
    for word in SENSITIVE.finditer(text):
        low, high = max(done, word.start() - around), word.end() + around
        if high > low:
            found.update(m.group() for m in IDENTIFIER.finditer(text, low, min(len(text), high)))
            done = high
    return found


def learnt_identifiers(documents: DataFrame, text: str, around: int, most: int = LEARNT, least_documents: int = LEAST_DOCUMENTS) -> str:
    """The commonest identifiers around sensitive words in all documents, the commonest last. At most ``most`` reach the driver."""

    def run(batches):
        counts = Counter()

        def flush():
            words, numbers = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], names=["word", "n"])

        for piece in slices(batches, text):
            for value in strings(piece.column(text)):
                counts.update(identifiers_around(value, around))
            if len(counts) >= PENDING_WORDS:
                yield flush()
        yield flush()

    found = documents.select(text).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    best = found.where(F.col("n") >= least_documents).orderBy(F.desc("n"), "word").limit(most)
    return " ".join(r["word"] for r in reversed(best.collect()))


def find_secrets(
    documents: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    within: int = 40,
    around: int = 400,
    least_novelty: float = 0.8,
    identifiers: str | None = None,
) -> DataFrame:
    """The rows with ``secrets``: spans of code points (end exclusive) by start, then kind.

    ``within`` is how far after a sensitive word a token may start, ``around`` the code points of surroundings on
    either side that prime the compressor, ``least_novelty`` the share of a random token's bytes that a
    token must cost. Spans of the fixed patterns are always reported, with their novelty. ``identifiers`` is the dictionary
    (default: learnt from the documents, behind a short list of common ones).
    """
    if identifiers is None:
        named = documents.select(F.col(f"`{text}`").alias("_text"))
        identifiers = f"{IDENTIFIERS} {learnt_identifiers(named, '_text', around)}"

    def results(column: pa.Array) -> list[pa.Array]:
        novelty = Novelty(identifiers)
        rows = []
        for value in strings(column):
            base = base_spans(value)
            spans = [(k, a, b, novelty(value, a, b, around)) for k, a, b in base]
            spans += novel_spans(value, base, novelty, within, around, least_novelty)
            spans.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
            rows.append([{"kind": k, "start": a, "end": b, "novelty": n} for k, a, b, n in spans])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])
        return [pa.array(rows, pa.list_(kind))]

    return with_results(documents, results, f"secrets {SPAN}", text, keep)

