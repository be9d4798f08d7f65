"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from .sql_more import SQL as MORE

SQL: dict[str, str] = dict(MORE)

_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = "translate(coalesce({0},''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"


def _words(column: str) -> str:
    return f"regexp_extract_all({_LOW.format(column)}, {_WORD})"


SQL["op8_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
win AS (
  SELECT item_id, least(len(w), 13) AS n, list_slice(w, i, i + least(len(w), 13) - 1) AS words
  FROM b, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
places AS (
  SELECT rid, n, i, list_slice(w, i, i + n - 1) AS words
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
found AS (
  SELECT DISTINCT p.rid, p.i, p.n, win.item_id FROM places p JOIN win ON p.n = win.n AND p.words = win.words),
hit AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM found, unnest(range(0, n)) AS t(k) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""


def _hilbert_steps(bits: int = 4) -> str:
    """CTEs h0 (points x0, x1, x2) to the last one with the curve index ``hilbert``."""
    steps, last = [], 0

    def then(exprs: dict) -> None:
        nonlocal last
        steps.append(f"h{last + 1} AS (SELECT * REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in exprs.items()) + f") FROM h{last})")
        last += 1

    for b in range(bits - 1, 0, -1):
        q, p = 1 << b, (1 << b) - 1
        then({"x0": f"CASE WHEN x0 & {q} <> 0 THEN xor(x0, {p}) ELSE x0 END"})
        for i in (1, 2):
            then({"x0": f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, xor(x0, x{i}) & {p}) END",
                  f"x{i}": f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {p}) END"})
    then({"x1": "xor(x1, x0)"})
    then({"x2": "xor(x2, x1)"})
    t = "0"
    for b in range(bits - 1, 0, -1):
        t = f"xor({t}, CASE WHEN x2 & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    then({f"x{i}": f"xor(x{i}, {t})" for i in range(3)})
    index = " + ".join(f"((x{i} >> {b}) & 1) * {1 << (3 * b + 2 - i)}" for b in range(bits) for i in range(3))
    steps.append(f"curve AS (SELECT *, {index} AS hilbert FROM h{last})")
    return ",\n".join(steps)


def _level(column: str, bits: int = 4) -> str:
    return f"""q_{column} AS (
  SELECT v, CAST(least(floor(coalesce(sum(n) OVER (ORDER BY v NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    * {1 << bits} / sum(n) OVER ()), {(1 << bits) - 1}) AS BIGINT) AS level
  FROM (SELECT {column} AS v, count(*) AS n FROM documents GROUP BY 1))"""


# crc32 has no SQL form in DuckDB: the polynomial is applied bytewise from a table made by rule.
SQL["op10_sharding"] = f"""
WITH RECURSIVE crc_table AS (
  SELECT n, list_reduce(list_concat([n], range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS n)),
crc_list AS (SELECT list(c ORDER BY n) AS t FROM crc_table),
texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
crcs AS (
  SELECT text, xor(list_reduce(
      list_concat([4294967295], list_transform(range(1, octet_length(encode(text)) + 1),
        lambda i: CAST(('0x' || substr(hex(encode(text)), 2 * i - 1, 2)) AS BIGINT))),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
  FROM texts, crc_list),
{_level('source')},
{_level('lang')},
h0 AS (
  SELECT doc_id, size, crc, a.level AS x0, b.level AS x1,
    CAST(least(length(bin(size // 16)) - 1, 15) AS BIGINT) AS x2
  FROM (SELECT doc_id, source, lang, octet_length(encode(coalesce(text, ''))) + 16 AS size, coalesce(text, '') AS text FROM documents) d
  JOIN crcs USING (text)
  JOIN q_source a ON a.v IS NOT DISTINCT FROM d.source JOIN q_lang b ON b.v IS NOT DISTINCT FROM d.lang),
{_hilbert_steps()},
ranked AS (
  SELECT *, row_number() OVER (ORDER BY hilbert, crc, doc_id NULLS FIRST, size) - 1 AS r, count(*) OVER () AS n FROM curve),
cut AS (
  SELECT *, n // 40 AS short, n % 40 AS extra FROM ranked),
placed AS (
  SELECT *, CASE WHEN r < extra * (short + 1) THEN r // (short + 1)
    ELSE extra + (r - extra * (short + 1)) // greatest(short, 1) END AS shard FROM cut)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(r - CASE WHEN shard < extra THEN shard * (short + 1)
    ELSE extra * (short + 1) + (shard - extra) * short END AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, CAST(hilbert AS BIGINT) AS hilbert
FROM placed
"""


def _collocations(longest: int = 4, min_count: int = 30, top: int = 2000) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS len, array_to_string(list_slice(w, i, i + {m - 1}), ' ') AS phrase "
        f"FROM pieces, unnest(range(1, len(w) - {m} + 2)) AS t(i) WHERE len(w) >= {m}" for m in range(1, longest + 1))
    return f"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array({_LOW.format('text')}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
f AS (SELECT lang, len, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM ({grams}) GROUP BY ALL HAVING count(*) >= {min_count}),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r,
         CAST((2000000 * CAST(c.f AS HUGEINT)) // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len)) AS k FROM f WHERE len > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, k), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, k + 1, c.len), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (
  SELECT DISTINCT lang, phrase, max(f) AS longer FROM (
    SELECT lang, f, unnest(list_transform(range(1, len - m + 2), lambda s: array_to_string(list_slice(w, s, s + m - 1), ' '))) AS phrase
    FROM f, unnest(range(2, len)) AS t(m) WHERE len > 2) GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
       phrase, a, l, r, n, score
FROM best JOIN sizes USING (lang) LEFT JOIN held USING (lang, phrase)
WHERE longer IS NULL OR 100 * CAST(longer AS HUGEINT) < 80 * a
QUALIFY rank <= {top}
"""


SQL["op11_collocations"] = _collocations()


_CONTROL = r"'[<\[]\\*/?(?:s>|INST\]|ROLE\])'"

SQL["op13_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, length(text) + len(regexp_extract_all(text, {_CONTROL})) AS body,
         length(role) + len(regexp_extract_all(role, {_CONTROL})) AS named FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(body + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 6 ELSE 21 + named END) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""


SQL["op12_hard_negatives"] = """
WITH x AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM x a JOIN x b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (
  SELECT rid, anchor_id, other AS p_rid, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.rid, p.p_rid ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
