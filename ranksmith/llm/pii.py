"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score.

Kinds: email, ip, card (Luhn), phone, and iban (remainder 1 modulo 97). The first four are reported whenever their
form holds, with a score. One of 97 references in capitals passes an iban's checksum by chance, so an iban is reported only if
words of its context stand near, or another iban in the same list.

Defined cases: a null or empty text has no spans; equal rows give equal results; texts of any length are read whole,
in time that grows with their length; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from ranksmith.llm.common import strings, with_results

# The patterns of the kinds, in the order in which equal starts are listed.
KINDS = ("email", "ip", "card", "phone", "iban")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
DIGIT = re.compile("[0-9]")

# Words that make a kind likelier when they stand near.
CONTEXT = {
    "email": ("mail", "contact", "write", "schreib", "correo", "courriel"),
    "ip": ("ip", "address", "server", "host", "adresse", "servidor"),
    "card": ("card", "visa", "master", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "anruf", "llama"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.4}
CONTEXT_GAIN = 0.2


def luhn(digits: str) -> bool:
    """Every second digit from the right counts twice, less 9 when above 9; the sum ends in 0."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) << (k & 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35: remainder 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with what belongs to it on either side; what a match took is not used again."""
    found, used, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            used = domain.end()
            found.append((start, used))
        else:
            used = max(used, at + 1)
        at = text.find("@", max(at + 1, used))
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """The longest run of groups that begins like an IBAN and passes the checksum.

    The search goes on behind a confirmed part, else at the next group of what it took.
    """
    found, m = [], IBAN.search(text)
    while m:
        groups = m.group().split(" ")
        ends = list(accumulate(len(g) + 1 for g in groups))
        at = m.start() + len(groups[0])
        for n in range(len(groups), 0, -1):
            joined = "".join(groups[:n])
            if 15 <= len(joined) <= 34 and mod97(joined):
                at = m.start() + ends[n - 1] - 1
                found.append((m.start(), at))
                break
        m = IBAN.search(text, at)
    return found


def confirmed(text: str) -> list[tuple[str, int, int]]:
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return found
    for m in IP.finditer(text):
        # Leading zeros count for nothing, and Python reads no number of thousands of digits.
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(DIGIT.findall(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found + [("iban", *s) for s in ibans(text)]


def score(text: str, kind: str, start: int, end: int, around: int) -> float:
    """The kind's prior, more when a word of its context stands near."""
    near = (text[max(0, start - around) : start] + " " + text[end : end + around]).lower()
    return round(PRIOR[kind] + (CONTEXT_GAIN if any(w in near for w in CONTEXT[kind]) else 0.0), 6)


def scored(text: str, around: int, least_score: float) -> list[tuple[str, int, int, float]]:
    """The confirmed spans with their scores, in order, without ibans that no context supports.

    An iban within ``around`` of one whose score holds belongs to the same list and takes its score.
    """
    spans = sorted(((k, a, b, score(text, k, a, b, around)) for k, a, b in confirmed(text)), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    told = [k for k, s in enumerate(spans) if s[0] == "iban"]
    for order in (told, told[::-1]):
        last = None
        for k in order:
            kind, a, b, own = spans[k]
            if own < least_score and last is not None and max(a - last[2], last[1] - b) <= around:
                spans[k] = (kind, a, b, last[3])
            last = spans[k] if spans[k][3] >= least_score else None
    return [s for s in spans if s[0] != "iban" or s[3] >= least_score]


def find_personal(
    documents: DataFrame,
    text: str = "text",
    keep: list[str] | None = None,
    around: int = 50,
    least_score: float = 0.5,
) -> DataFrame:
    """The rows with ``personal``: spans of code points (end exclusive) by start, then kind, with a score.

    ``least_score`` holds back kinds that the checksum adds (iban); base kinds are always reported.
    """

    def results(column: pa.Array) -> list[pa.Array]:
        rows = []
        for value in strings(column):
            rows.append([{"kind": k, "start": a, "end": b, "score": x} for k, a, b, x in scored(value, around, least_score)])
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
        return [pa.array(rows, pa.list_(kind))]

    fields = "personal array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    return with_results(documents, results, fields, text, keep)
