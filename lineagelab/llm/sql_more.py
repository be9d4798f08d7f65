"""DuckDB twins of line dedup, URL filter, license scan, fingerprints and mixing."""

from __future__ import annotations

from . import fingerprints, host_reputation, licenses, mixing

_GAP = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOW = "translate(coalesce({0},''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')"


def _line(column: str) -> str:
    return f"trim(regexp_replace({_LOW.format(column)}, {_GAP}, ' ', 'g'))"


LINE_DEDUP = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS (
  SELECT rid, doc_id, i - 1 AS line_no, trim(regexp_replace(lower(parts[i]), {_GAP}, ' ', 'g')) AS line
  FROM (SELECT rid, doc_id, string_split(text, chr(10)) AS parts FROM docs), unnest(range(1, len(parts) + 1)) AS t(i)),
firsts AS (
  SELECT line, min({{'d': doc_id, 'r': rid, 'l': line_no}}) AS first, row_number() OVER () AS id
  FROM raw WHERE line <> '' GROUP BY line),
words AS (SELECT DISTINCT id, unnest(string_split(line, ' ')) AS w FROM firsts),
sizes AS (SELECT id, count(*) AS n FROM words GROUP BY id),
rare AS (SELECT w, count(*) AS df FROM words GROUP BY w),
-- pairs of similar size that share a word among the rarer half of each line's words
half AS (
  SELECT id, w, n FROM (
    SELECT id, w, n, row_number() OVER (PARTITION BY id ORDER BY df, w) AS place FROM words JOIN rare USING (w) JOIN sizes USING (id))
  WHERE place <= n // 2 + 1),
near AS (
  SELECT DISTINCT x.id AS a, y.id AS b, x.n AS na, y.n AS nb
  FROM half x JOIN half y ON x.w = y.w AND x.id < y.id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)),
pairs AS (
  SELECT a, b FROM (
    SELECT a, b, na, nb, len(list_intersect(x.l, y.l)) AS o FROM near
    JOIN (SELECT id, list(w) AS l FROM words GROUP BY id) x ON x.id = a
    JOIN (SELECT id, list(w) AS l FROM words GROUP BY id) y ON y.id = b)
  WHERE 5 * o >= 4 * (na + nb - o)),
sides AS (
  SELECT a AS id, b AS other FROM pairs UNION ALL SELECT b, a FROM pairs),
linked AS (
  SELECT s.id, count(*) AS n_links, max(CASE WHEN o.first < f.first THEN 1 ELSE 0 END) AS later
  FROM sides s JOIN firsts f ON f.id = s.id JOIN firsts o ON o.id = s.other GROUP BY s.id)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
  CASE WHEN f.id IS NOT NULL THEN concat_ws(':', CAST(f.first.d AS VARCHAR), CAST(f.first.l AS VARCHAR)) END AS class_id,
  CAST(coalesce(n_links, 0) AS BIGINT) AS n_links,
  f.id IS NOT NULL AND (f.first.r <> raw.rid OR f.first.l <> line_no OR coalesce(later, 0) = 1) AS removed
FROM raw LEFT JOIN firsts f ON raw.line <> '' AND f.line = raw.line LEFT JOIN linked ON linked.id = f.id
"""


def _url_filter() -> str:
    h = host_reputation
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    two = ", ".join(f"'{s}'" for s in h.TWO_PART_SUFFIXES)
    ordered = sorted(h.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fit = [f"WHEN (host = '{x}' OR ends_with(host, '.{x}')) AND starts_with(path, '{p}') THEN" for _, x, p in ordered]
    rule = "CASE " + " ".join(f"{f} '{x + p}'" for f, (_, x, p) in zip(fit, ordered)) + " END"
    verdict = "CASE " + " ".join(f"{f} '{v}'" for f, (v, _, _) in zip(fit, ordered)) + " END"
    low, high = h.STRENGTH

    def level(name: str, table: str, parent: str) -> str:
        """Prior strength of one level from its groups g(n, x, mu, parent)."""
        return f"""{name}_per AS (
  SELECT {parent}, sum((x - n * mu) * (x - n * mu) / (n * mu * (1 - mu))) AS s, count(*) AS k, sum(n) AS t, sum(n * n) AS q
  FROM {table} WHERE n > 0 GROUP BY {parent}),
{name}_sum AS (SELECT sum(s) AS s, sum(k - 1) AS f, sum(t - q / t) AS d FROM {name}_per),
{name}_m AS (
  SELECT CASE WHEN f IS NULL THEN {low} WHEN f = 0 OR d - f <= 0 THEN {high}
    WHEN (s - f) / (d - f) <= 1 / {high + 1} THEN {high} ELSE greatest({low}, (d - f) / (s - f) - 1) END AS m FROM {name}_sum)"""

    return f"""
WITH p AS (
  SELECT page_id, coalesce({_LOW.format("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, coalesce({rest}, '') AS rest FROM pages)),
o AS (
  SELECT doc_id, count(*) AS n, sum(CASE WHEN coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 THEN 1 ELSE 0 END) AS x
  FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT host, sum(coalesce(n, 0)) AS n, sum(coalesce(x, 0)) AS x FROM p LEFT JOIN o ON o.doc_id = p.page_id GROUP BY host),
split AS (
  SELECT *, string_split(host, '.') AS l, len(string_split(host, '.')) AS k,
    array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN ({two}) AS two FROM hosts),
named AS (
  SELECT host, n, x, array_to_string(list_slice(l, CASE WHEN two THEN -2 ELSE -1 END, -1), '.') AS suffix,
    array_to_string(list_slice(l, CASE WHEN two THEN -3 ELSE -2 END, -1), '.') AS domain FROM split),
top AS (SELECT (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mu FROM named),
s0 AS (SELECT suffix, sum(n) AS n, sum(x) AS x, any_value(top.mu) AS mu, 1 AS one FROM named, top GROUP BY suffix),
{level('s', 's0', 'one')},
s1 AS (SELECT suffix, (m * mu + x) / (m + n) AS rate FROM s0, s_m),
d0 AS (
  SELECT domain, suffix, n, x, rate AS mu FROM (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM named GROUP BY domain, suffix)
  JOIN s1 USING (suffix)),
{level('d', 'd0', 'suffix')},
d1 AS (SELECT domain, (m * mu + x) / (m + n) AS rate FROM d0, d_m),
h0 AS (SELECT host, domain, n, x, rate AS mu FROM named JOIN d1 USING (domain)),
{level('h', 'h0', 'domain')},
h1 AS (
  SELECT host, n, (m * mu + x) / (m + n) AS rate,
    sqrt((m * mu + x) * (m * (1 - mu) + n - x) / ((m + n) * (m + n) * (m + n + 1))) AS sd FROM h0, h_m)
SELECT page_id, host, path, {rule} AS rule,
  coalesce({verdict}, CASE WHEN least(1.0, rate + {h.Z} * sd) < {h.FLOOR} AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict,
  CAST(n AS BIGINT) AS n_labels, rate, greatest(0.0, rate - {h.Z} * sd) AS lower, least(1.0, rate + {h.Z} * sd) AS upper
FROM p JOIN h1 USING (host)
"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _license_scan() -> str:
    every = licenses.rules()
    table = ",\n".join(f"({_quoted(r.label)}, {r.priority}, {_quoted(' ' + r.gate + ' ')}, {_quoted(licenses._as_line(r.pattern))})"
                       for r in every)
    size = "((length({0}) - length(replace({0}, ' ', ''))) // 2)"
    n_base, firsts, lasts, marks = [], [], [], []
    for phrase, label in licenses.BASE:
        p = " " + phrase.replace(" ", "  ") + " "
        count = f"((length(line) - length(replace(line, '{p}', ''))) // {len(p)})"
        n_base.append(count)
        before = f"substr(line, 1, strpos(line, '{p}') - 1)"
        after = f"list_extract(string_split(line, '{p}'), -1)"
        firsts.append(f"CASE WHEN {count} > 0 THEN {size.format(before)} END")
        lasts.append(f"CASE WHEN {count} > 0 THEN {size.format('line')} - {size.format(after)} - {len(phrase.split())} END")
        marks.append(f"CASE WHEN {count} > 0 THEN '{label}' END")
    return f"""
WITH rules(label, priority, gate, pattern) AS (VALUES
{table}),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_line('text')} AS line FROM documents),
lines AS (
  SELECT rid, doc_id, CASE WHEN line = '' THEN '' ELSE ' ' || replace(line, ' ', '  ') || ' ' END AS line FROM d),
tried AS (
  SELECT rid, label, priority, string_split_regex(line, pattern) AS gaps, regexp_extract_all(line, pattern) AS found
  FROM lines JOIN rules ON contains(line, gate)),
placed AS (
  SELECT rid, label, priority, found[i] AS hit,
    list_sum(list_transform(list_slice(gaps, 1, i), lambda x: {size.format('x')}))
    + coalesce(list_sum(list_transform(list_slice(found, 1, i - 1), lambda x: {size.format('x')})), 0) AS first
  FROM tried, unnest(range(1, len(found) + 1)) AS t(i) WHERE len(found) > 0),
spans AS (SELECT rid, label, priority, first, first + {size.format('hit')} AS last FROM placed),
kept AS (
  SELECT rid, label, priority FROM spans s WHERE NOT EXISTS (
    SELECT 1 FROM spans t WHERE t.rid = s.rid AND t.first <= s.first AND t.last >= s.last
      AND (t.priority > s.priority OR (t.priority = s.priority AND t.last - t.first > s.last - s.first)))),
method AS (SELECT rid, list(DISTINCT label) AS labels, max(priority) AS best FROM kept GROUP BY rid),
base AS (
  SELECT rid, doc_id, {size.format('line')} AS n_words, {' + '.join(n_base)} AS n_base,
    least({', '.join(firsts)}) AS first_word, greatest({', '.join(lasts)}) AS last_word,
    list_filter([{', '.join(marks)}], lambda x: x IS NOT NULL) AS marks FROM lines)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_base AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, array_to_string(list_sort(marks), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(marks, coalesce(labels, [])))), ',') AS labels,
  coalesce(best, 0) / 4.0::DOUBLE AS score
FROM base LEFT JOIN method USING (rid)
"""


def _fingerprints() -> str:
    lanes, mod, width = fingerprints.LANES, 1 << fingerprints.MODULUS_BITS, fingerprints.MODULUS_BITS // 4
    digest = " || ".join(f"sha256('{i}:' || p)" for i in range(lanes // 32))

    def norm(v: str) -> str:
        wrapped = f"((((x) % {mod}) + {mod}) % {mod})"
        centred = f"(CASE WHEN {wrapped} >= {mod // 2} THEN {wrapped} - {mod} ELSE {wrapped} END)"
        return f"list_sum(list_transform({v}, lambda x: {centred} * {centred}))"

    def like(a: str, b: str) -> str:
        apart = norm(f"list_transform(range(1, {lanes + 1}), lambda i: {a}[i] - {b}[i])")
        return f"CASE WHEN {apart} = 0 THEN 1.0 ELSE greatest(0.0, 1 - {apart} / greatest({norm(a)} + {norm(b)}, 1)) END"

    def text(v: str) -> str:
        return f"array_to_string(list_transform({v}, lambda x: lpad(lower(to_hex(CAST(x AS BIGINT))), {width}, '0')), '')"

    # byte 0 of a word is its lowest: the two hex digits at the end of its eight
    byte = (f"CAST(('0x' || substr(h, 8 * (lane // 4) + 7 - 2 * (lane % 4), 2)) AS BIGINT) - 128")
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
o AS (
  SELECT *, length(text) AS n_chars, row_number() OVER (ORDER BY doc_id NULLS FIRST, rid) - 1 AS pos, count(*) OVER () AS n FROM d),
e AS (
  SELECT a.rid, a.doc_id, a.n_chars, b.rid AS next_rid, a.text,
    substr(a.text, 1, a.n_chars - a.n_chars // 4) || substr(b.text, 1, a.n_chars // 4) AS edited
  FROM o a JOIN o b ON b.pos = (a.pos + 1) % a.n),
parts AS (
  SELECT rid, kind, {digest} AS h FROM (
    SELECT rid, 't' AS kind, unnest(string_split(text, chr(10))) AS p FROM e
    UNION ALL SELECT rid, 'e', unnest(string_split(edited, chr(10))) FROM e) WHERE p <> ''),
summed AS (
  SELECT rid, kind, lane, sum({byte}) AS x FROM parts, unnest(range(0, {lanes})) AS t(lane) GROUP BY rid, kind, lane),
vectors AS (
  SELECT rid, kind, list(CAST(((x % {mod}) + {mod}) % {mod} AS BIGINT) ORDER BY lane) AS v FROM summed GROUP BY rid, kind),
v AS (
  SELECT e.rid, coalesce(t.v, list_transform(range({lanes}), lambda x: 0)) AS t,
    coalesce(w.v, list_transform(range({lanes}), lambda x: 0)) AS w
  FROM e LEFT JOIN vectors t ON t.rid = e.rid AND t.kind = 't' LEFT JOIN vectors w ON w.rid = e.rid AND w.kind = 'e')
SELECT e.doc_id, CAST(e.n_chars AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256,
  {text('a.t')} AS fingerprint, {text('a.w')} AS edited_fingerprint,
  {like('a.t', 'a.w')} AS near_edited, {like('a.t', 'b.t')} AS near_next
FROM e JOIN v a ON a.rid = e.rid JOIN v b ON b.rid = e.next_rid
"""


def _mixing() -> str:
    m = mixing
    topic = "CASE " + " ".join(f"WHEN contains(text, '{mark}') THEN '{name}'" for name, mark in m.TOPICS) + " ELSE 'general' END"
    ctes = [f"""d AS (
  SELECT doc_id, source, lang, coalesce({topic}, 'general') AS topic,
    CASE WHEN line = '' THEN 0 ELSE length(line) - length(replace(line, ' ', '')) + 1 END AS n_tokens
  FROM (SELECT doc_id, source, lang, text, {_line('text')} AS line FROM documents))""",
            "cells AS (SELECT source, lang, topic, sum(n_tokens) AS weight FROM d GROUP BY ALL)"]
    for dim in m.DIMENSIONS:
        ctes.append(f"""t_{dim} AS (
  SELECT {dim} AS k, w / sum(w) OVER () AS t FROM (
    SELECT {dim}, pow(sum(weight), {m.POWERS[dim]}) AS w FROM cells WHERE weight > 0 GROUP BY {dim}))""")
    join = " ".join(f"JOIN t_{x} ON t_{x}.k IS NOT DISTINCT FROM cells.{x}" for x in m.DIMENSIONS)
    ctes.append("r0 AS (SELECT cells.*, CAST(weight AS DOUBLE) AS raked, "
                + ", ".join(f"t_{x}.t AS share_{x}" for x in m.DIMENSIONS) + f" FROM cells {join} WHERE weight > 0)")
    n = 0
    for _ in range(20):
        for dim in m.DIMENSIONS:
            ctes.append(f"r{n + 1} AS MATERIALIZED (SELECT * REPLACE (raked * share_{dim} / sum(raked) OVER (PARTITION BY {dim}) AS raked) FROM r{n})")
            n += 1
    ctes.append(f"f AS (SELECT *, raked * sum(weight) OVER () / weight AS factor, sum(weight) OVER () AS whole FROM r{n})")
    # full cells come first in the order of their factors: the first cut that settles gives k
    ctes.append(f"""c AS (
  SELECT factor, whole,
    coalesce(sum(weight) OVER (ORDER BY factor DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sure,
    sum(weight * factor) OVER (ORDER BY factor DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM f),
scale AS (SELECT arg_max(({m.RATE} * whole - sure) / open, factor) AS k FROM c WHERE ({m.RATE} * whole - sure) / open * factor < 1)""")
    ctes.append("""p AS (
  SELECT source, lang, topic, raked AS target_share, least(1.0, k * factor) AS probability FROM f, scale)""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, d.source, d.lang, d.topic, CAST(n_tokens AS BIGINT) AS n_tokens, coalesce(target_share, 0.0) AS target_share,
  coalesce(probability, {m.RATE}) AS probability, 0.0 AS raking_gap,
  CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE
    < coalesce(probability, {m.RATE}) AS sampled
FROM d LEFT JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.lang IS NOT DISTINCT FROM d.lang AND p.topic = d.topic
"""


SQL = {
    "op1_line_dedup": LINE_DEDUP,
    "op2_url_filter": _url_filter(),
    "op3_license_scan": _license_scan(),
    "op4_fingerprints": _fingerprints(),
    "op6_source_mixing": _mixing(),
}
