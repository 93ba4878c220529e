"""SQL for DuckDB that gives the rows of the queries over integer codes and hashed words."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def value_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Product codes: every round is a join of components with codebook entries, a minimum and a floored mean."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
far{k} AS (
  SELECT r, part, entry, sum((c.v - b.v) * (c.v - b.v))::BIGINT AS d
  FROM components c JOIN book{k} b USING (part, place) GROUP BY r, part, entry),
near{k} AS (SELECT r, part, min(d * {entries} + entry) AS best FROM far{k} GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""
sums{k} AS (
  SELECT part, best % {entries} AS entry, place, sum(v)::BIGINT AS s, count(*) AS n
  FROM near{k} JOIN components USING (r, part) GROUP BY ALL),
book{k + 1} AS (
  SELECT part, entry, place, coalesce((s - ((s % n + n) % n)) // n, b.v)::BIGINT AS v
  FROM book{k} b LEFT JOIN sums{k} USING (part, entry, place))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
components AS (
  SELECT r, (i - 1) // (len(e) // {parts}) AS part, (i - 1) % (len(e) // {parts}) AS place,
         floor({scale} * e[i]::DOUBLE)::BIGINT AS v
  FROM (SELECT r, e, unnest(range(1, len(e) + 1)) AS i FROM kept)),
book0 AS (SELECT part, r AS entry, place, v FROM components WHERE r < {entries}),{",".join(steps)},
coded AS (
  SELECT r, string_agg(printf('%02x', best % {entries}), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error
  FROM near{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r) CROSS JOIN books"""


def resampled(buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> str:
    """Importance resampling over single words; the CRC of a word is folded over its bytes."""
    table = "list_transform(range(256), lambda n: list_reduce([n] || [1, 1, 1, 1, 1, 1, 1, 1], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    words = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH split AS (SELECT row_number() OVER () AS r, doc_id, coalesce({words}, []) AS words FROM documents),
uses AS (SELECT r, unnest(words) AS word FROM split),
wanted AS (SELECT unnest({words}) AS word FROM benchmark),
crc AS (SELECT {table} AS t),
hashed AS (
  SELECT word, xor(list_reduce([4294967295::BIGINT] || list_transform(range(strlen(word)), lambda k: ('0x' || substr(hex(encode(word)), 2 * k + 1, 2))::BIGINT),
           lambda c, b: xor(t[xor(c, b) % 256 + 1]::BIGINT, c // 256)), 4294967295::BIGINT) % {buckets} AS bucket
  FROM (SELECT word FROM uses UNION SELECT word FROM wanted) CROSS JOIN crc),
source AS (SELECT bucket, count(*) AS s FROM uses JOIN hashed USING (word) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM uses) + {buckets})::DOUBLE
           / ((s + 1)::DOUBLE * ((SELECT count(*) FROM wanted) + {buckets})::DOUBLE)))::BIGINT AS gain
  FROM source LEFT JOIN target USING (bucket)),
weights AS (SELECT r, sum(gain)::BIGINT AS weight FROM uses JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (r)),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= {least_words}
  QUALIFY rank <= {percent} * count(*) OVER () // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)"""


WORD = r"[^\x20\x09-\x0D]+"


def secret_counts() -> str:
    """How many matches of each fixed pattern count."""
    assign = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    return f"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id,
  len(list_filter(regexp_extract_all(text, '{assign}', 1), lambda x: length(x) >= 12))::BIGINT AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::BIGINT AS n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 16))::BIGINT AS n_hex
FROM given"""


def personal_counts() -> str:
    """How many matches of each form pass its check."""
    luhn = """list_sum(list_transform(range(length(d)), lambda k:
      ((1 + k % 2) * substr(d, length(d) - k, 1)::INT) // 10 + ((1 + k % 2) * substr(d, length(d) - k, 1)::INT) % 10)) % 10 = 0"""
    digits = "regexp_replace(x, '[^0-9]', '', 'g')"
    return f"""
WITH given AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+'))::BIGINT AS n_email,
    regexp_extract_all(text, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS ips,
    list_transform(regexp_extract_all(text, '[0-9](?:[ -]?[0-9])+'), lambda x: {digits}) AS cards,
    list_transform(regexp_extract_all(text, '[+][0-9][ ().0-9-]+[0-9]'), lambda x: {digits}) AS phones
  FROM given)
SELECT doc_id, n_email,
  len(list_filter(ips, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR lpad(ltrim(p, '0'), 3, '0') > '255')) = 0))::BIGINT AS n_ip,
  len(list_filter(cards, lambda d: length(d) BETWEEN 12 AND 19 AND {luhn}))::BIGINT AS n_card,
  len(list_filter(phones, lambda d: length(d) BETWEEN 9 AND 15))::BIGINT AS n_phone
FROM found"""


def mix_targets(weights: tuple[float, ...], share: float = 1.5, cap: float = 2.0) -> str:
    """Sizes, and targets that stop at ``cap`` times their source, the rest dealt by weight."""
    listed = ", ".join(f"{w}::DOUBLE" for w in weights)
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(coalesce(regexp_extract_all(text, '{WORD}'), []))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
known AS (
  SELECT *, {cap}::DOUBLE * source_size AS most,
         [{listed}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] AS weight FROM sources),
placed AS (
  SELECT *, {share}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weights
  FROM known WINDOW before AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dealt AS (SELECT *, max(rest / weights) FILTER (WHERE most >= rest / weights * weight) OVER () AS unit FROM placed)
SELECT doc_id, size, source_size, round(coalesce(least(most, unit * weight), most), 3) AS target
FROM sized JOIN dealt ON sized.source IS NOT DISTINCT FROM dealt.source"""


def quality_counts(min_words: int = 50, max_repeat_percent: int = 50) -> str:
    """The five counts and the two rules on them."""
    return f"""
WITH given AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '{WORD}'), []) AS words FROM documents),
windows AS (
  SELECT r, k, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS k FROM given)),
repeated AS (SELECT r, k FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, count(DISTINCT k + j)::BIGINT AS n FROM repeated CROSS JOIN range(3) AS t(j) GROUP BY r),
counted AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')))))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM given LEFT JOIN covered USING (r))
SELECT *, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat_percent} * n_words AS base_failed FROM counted"""
