"""The operators against brute force on small tables with every edge case."""

import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lineagelab.llm import (components, decontaminate, fingerprints, host_reputation, language, licenses, line_dedup, mixing,
                            near_dedup, sharding, textscan, token_counts)

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, rid long, shard string"

PROSE = ["the cat sat on the mat and looked at the old grey door for a while before it left again",
         "der hund lief über die wiese und bellte laut weil er die katze auf dem baum gesehen hatte",
         "le chat est assis sur la chaise et regarde la porte ancienne pendant que la pluie tombe dehors"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def edge_rows():
    rows = [(0, None, None, None), (1, "", "en", "s"), (2, "  .,;\n\n", "en", "s"), (3, LONG, "en", "s"),
            (4, PROSE[0], "en", "s"), (4, PROSE[0], "en", "s"), (5, PROSE[0], "en", None), (None, PROSE[1], "de", "t"),
            (6, "one", None, "t"), (7, "ÉÀ ß 漢字 12", "fr", "u"), (8, PROSE[2] + "\n" + PROSE[0] + "\n" + PROSE[2], "fr", "u")]
    return [(i, t, lang, s, None if t is None else len(t), 0.5, 7, "x") for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge") / "documents.parquet")
    spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty") / "documents.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def written(spark, tmp_path, rows, schema):
    path = str(tmp_path / "table.parquet")
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


# --- decontamination -------------------------------------------------------

def brute_contamination(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        windows += [(item, tuple(w[i:i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(item)
        sha = hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()
        out.append((str(doc), len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


ITEMS = [(None, PROSE[0]), (None, "one"), (1, PROSE[0]), (2, "one"), (3, None), (4, "..."), (5, PROSE[1].upper()), (5, PROSE[2]), (12, "the cat sat")]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WINDOWS, 30])
def test_decontamination_against_brute_force(spark, edge, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", block)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.judge(edge, bench).select("doc_id", *decontaminate.JUDGED.names).collect()
    got = sorted((str(r[0]), *r[1:]) for r in got)
    assert got == brute_contamination([(r[0], r[1]) for r in edge_rows()], ITEMS)


def test_decontamination_of_nothing(spark, edge, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.judge(empty, bench).count() == 0
    assert decontaminate.judge(edge, none).where("n_hit > 0").count() == 0
    kept = decontaminate.clean(edge, bench)
    assert kept.columns == edge.columns and 0 < kept.count() < edge.count()


# --- language --------------------------------------------------------------

def test_noise_and_other_languages_go_and_clean_texts_stay(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(4)
    noise = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 600)) for _ in range(5)]
    noise += ["".join(chr(c) for c in rng.integers(0x4E00, 0x5000, 300)), "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5]
    junk = spark.createDataFrame([(1_000_000 + i, t, None) for i, t in enumerate(noise)], "doc_id long, text string, lang string")
    short = spark.createDataFrame([(2_000_000 + i, t, None) for i, t in enumerate(["A.", "the", "Ok 12", "und", "¿qué?"])], "doc_id long, text string, lang string")
    model = language.fit(docs)
    kept = {r.doc_id for r in language.accepted(docs.unionByName(junk).unionByName(short), model).collect()}
    assert not any(1_000_000 <= i < 2_000_000 for i in kept) and sum(i >= 2_000_000 for i in kept) == 5
    assert len([i for i in kept if i < 1_000_000]) == docs.where("text rlike '\\\\p{L}'").select("doc_id").distinct().count()
    # a bounded fit still judges every document
    monkeypatch.setattr(language, "FIT_ROWS", 60)
    assert language.predict(docs, language.fit(docs)).where("lang_pred <> 'und'").count() == docs.where("text rlike '\\\\p{L}'").count()


def test_language_edges_and_columns(edge, empty):
    model = language.fit(edge)
    got = {(r.doc_id, r.text): r for r in language.predict(edge, model).collect()}
    assert got[0, None].lang_pred == "und" and got[0, None].score == 0
    assert got[1, ""].lang_pred == "und" and got[2, "  .,;\n\n"].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert language.accepted(edge, model).columns == edge.columns
    # the three texts without a letter go; what is left is far from no language it was fitted on
    fits = language.predict(edge, model).where("fits and lang_pred <> 'und'").count()
    assert language.accepted(edge, model).count() == fits <= edge.count() - 3
    blank = language.fit(empty)
    assert {r.lang_pred for r in language.predict(edge, blank).collect()} == {"und"}
    assert language.predict(empty, model).count() == 0


def test_language_code_lengths_against_plain_ppm():
    """Exact code lengths: PPM of method C with exclusion, worked out context by context."""
    texts = {"a": b"abra cadabra abra", "b": b"banana bandana band"}
    counts, models = {}, {}
    for lang, t in texts.items():
        s = b"   " + t
        n = {}
        for i in range(3, len(s)):
            n[s[i - 3:i + 1]] = n.get(s[i - 3:i + 1], 0) + 1
        models[lang] = n
        keys = sorted(n)
        counts[lang] = (np.array([int.from_bytes(k, "big") for k in keys], dtype=np.uint32), np.array([n[k] for k in keys]))
    model = language.Model(counts)

    def symbols():
        return sorted({b for n in models.values() for k in n for b in k})

    def distribution(n, context):
        known = [*symbols(), None]
        lower = {x: 1 / 256 for x in known} if not context else distribution(n, context[1:])
        if context == b"":
            seen = {}
            for k, c in n.items():
                seen[k[3]] = seen.get(k[3], 0) + c
            lower = {x: 1 / 256 for x in known}
        else:
            seen = {}
            for k, c in n.items():
                if k[:3].endswith(context):
                    seen[k[3]] = seen.get(k[3], 0) + c
        if not seen:
            return lower
        total, distinct = sum(seen.values()), len(seen)
        rest = sum(p for x, p in lower.items() if x not in seen)
        return {x: seen[x] / (total + distinct) if x in seen else distinct / (total + distinct) * lower[x] / rest for x in known}

    probe = b"banabra"
    sym, offsets = language._symbols(np.frombuffer(probe, dtype=np.uint8), np.array([0, len(probe)]))
    got, _ = model.lengths(sym, offsets)
    for k, lang in enumerate(model.langs):
        s, bits = b"   " + probe, 0
        for i in range(3, len(s)):
            bits += round(-np.log2(distribution(models[lang], s[i - 3:i])[s[i]]) * language.UNIT)
        assert abs(int(got[0, k]) - bits) <= len(probe)


def test_language_keeps_every_context_of_a_large_alphabet():
    """200 symbols, 10 languages: more contexts than a table of all symbols per context could hold in 40 MB."""
    rng = np.random.default_rng(3)
    counts, seen, used = {}, {}, set()
    for lang in (f"l{i}" for i in range(10)):
        s = b"   " + bytes(rng.integers(56, 256, 1500, dtype=np.uint8)) * 2
        n = seen[lang] = {}
        for i in range(3, len(s)):
            used |= set(s[i - 3:i + 1])
            for k in range(4):
                own = n.setdefault(s[i - k:i], {})
                own[s[i]] = own.get(s[i], 0) + 1
        runs = [(int.from_bytes(x + bytes([y]), "big"), c) for x, d in n.items() if len(x) == 3 for y, c in d.items()]
        counts[lang] = (np.array([r for r, _ in runs], dtype=np.uint32), np.array([c for _, c in runs]))
    probe = s[3:200] + bytes(rng.integers(0, 256, 100, dtype=np.uint8))

    def distribution(n, context):
        lower = distribution(n, context[1:]) if context else dict.fromkeys([*used, None], 1 / 256)
        d = n.get(context)
        if not d:
            return lower
        den, rest = sum(d.values()) + len(d), sum(p for x, p in lower.items() if x not in d)
        return {x: d[x] / den if x in d else len(d) / den * p / rest for x, p in lower.items()}

    model = language.Model(counts)
    sym, offsets = language._symbols(np.frombuffer(probe, dtype=np.uint8), np.array([0, len(probe)]))
    got, _ = model.lengths(sym, offsets)
    s = bytes(sym)
    for k, lang in enumerate(model.langs):
        bits = sum(-np.log2(distribution(seen[lang], s[i - 3:i])[s[i] if s[i] in used else None]) for i in range(3, len(s)))
        assert abs(got[0, k] / language.UNIT - bits) <= len(s) / language.UNIT, lang


# --- near copies -----------------------------------------------------------

def test_near_classes_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    vocabulary = [f"v{i}" for i in range(4000)]
    rows = []
    for group in range(30):
        base = [vocabulary[i] for i in rng.integers(0, 4000, int(rng.integers(30, 200)))]
        for _ in range(int(rng.integers(1, 8))):
            own = list(base)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(0, len(own)))] = vocabulary[int(rng.integers(0, 4000))]
            rows.append((len(rows), " ".join(own)))
    docs = written(spark, tmp_path, rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()}
    sets = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} for i, t in rows for w in [words(t)]}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    for a, b in itertools.combinations(sets, 2):
        s = similar(a, b)
        if s >= 0.84:                                            # above the damping of frequent shingles
            assert got[a] == got[b], (a, b, s)
        if s < 0.1:
            assert got[a] != got[b] or s > 0, (a, b, s)


def test_near_classes_are_exact_inside_one_large_bucket(spark, tmp_path, monkeypatch):
    """All texts meet in one bucket and agree in no other sample: round two has to find every similar pair."""
    class OneBucket:
        k = near_dedup.BANDS * near_dedup.ROWS

        def sketch(self, doc, h, tf, level):
            begin = np.unique(doc, return_index=True)[1]
            out = np.minimum.reduceat(h, begin)[:, None] * np.arange(1, 2 * self.k, 2, dtype=np.uint64)
            out[:, :near_dedup.ROWS] = 1
            return doc[begin], out

    rng = np.random.default_rng(8)
    rows = []
    for _ in range(12):
        base = [f"v{i}" for i in rng.integers(0, 3000, 100)]
        for _ in range(12):
            own = base[int(rng.integers(0, 8)):]
            for at in rng.integers(0, len(own), int(rng.integers(0, 4))):
                own[at] = f"v{int(rng.integers(0, 3000))}"
            rows.append((len(rows), " ".join(own)))
    docs = written(spark, tmp_path, rows, "doc_id long, text string")
    levels = near_dedup.idf_levels(docs)
    [(_, _, cut)] = textscan.scan(pa.array([t for _, t in rows]))
    doc, h, tf = near_dedup._shingles(cut)
    sets = [dict(zip(h[doc == i], near_dedup.weights(tf[doc == i], levels[near_dedup._bucket(h[doc == i])]))) for i, _ in rows]
    label = list(range(len(rows)))
    n_links = 0
    for a, b in itertools.combinations(label[:], 2):
        common = sum(min(w, sets[b][x]) for x, w in sets[a].items() if x in sets[b])
        if common >= near_dedup.SIMILARITY * (sum(sets[a].values()) + sum(sets[b].values()) - common) - 1e-9:
            n_links += 1
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    assert n_links > 100 and 12 < len(set(label)) < len(rows)
    monkeypatch.setattr(near_dedup, "Sampler", OneBucket)
    assert {r.doc_id: r.class_id for r in near_dedup.near_classes(docs).collect()} == dict(enumerate(label))


def test_prefix_rows_do_not_grow_with_the_text(spark, monkeypatch):
    """The exploded prefixes are judged by a small file: they are not broadcast, and a row holds a few shingles of its text."""
    schema = "rid long, total double, spread array<float>, label long, p array<long>, before array<double>"
    long = [(r, 3000.0, [1.0] * near_dedup.SPREAD, r, list(range(r, r + 3000)), [float(i) for i in range(3000)]) for r in (0, 1)]
    rows = near_dedup._prefix_rows(spark.createDataFrame(long, schema)).where("rid = 1").orderBy("h").collect()
    assert [r.rest for r in rows] == [3000.0 - i for i in range(3000)]
    assert [r.past for r in rows] == [list(range(max(1, r.h - near_dedup.PAST), r.h)) for r in rows]
    # pairs whose last common shingle is further back than a row tells are made again, and only then
    words = [f"w{i}" for i in range(400)]
    texts = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words[:100] + ["other"] + words[101:])), (2, "nothing that the others have here")], "rid long, text string")
    shared = spark.sparkContext.broadcast(np.zeros(near_dedup.DF_BUCKETS, dtype=np.uint8))
    sketches = texts.mapInArrow(near_dedup._sketch_task(shared), "rid long, total double, bands array<long>, spread array<float>")
    labels = spark.createDataFrame([], "node long, label long")
    for past in (near_dedup.PAST, 1):
        monkeypatch.setattr(near_dedup, "PAST", past)
        pairs = near_dedup._prefix_pairs(texts, sketches, labels, shared, near_dedup.SIMILARITY)
        assert [tuple(r) for r in pairs.collect()] == [(0, 1)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString() + pairs._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_near_classes_of_edges(edge, empty):
    rows = near_dedup.near_classes(edge).collect()
    assert len(rows) == edge.count() and sum(r.kept for r in rows) == len({r.class_id if r.class_size > 1 else (r.doc_id, r.class_id) for r in rows})
    assert {r.class_size for r in rows if r.doc_id in (4, 5)} == {3}
    assert {r.class_size for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert near_dedup.near_classes(empty).count() == 0
    kept = near_dedup.drop_near_copies(edge)
    assert kept.columns == edge.columns and kept.count() == sum(r.kept for r in rows)


def test_weighted_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 2**63, 300, dtype=np.uint64)
    h.sort()
    tf = rng.integers(1, 4, 300)
    level = rng.integers(0, near_dedup.LEVELS, 300)
    other = tf.copy()
    other[:60] += 2
    sampler = near_dedup.Sampler(512)
    zero = np.zeros(300, dtype=np.int64)
    a, b = sampler.sketch(zero, h, tf, level)[1], sampler.sketch(zero, h, other, level)[1]
    wa, wb = near_dedup.weights(tf, level), near_dedup.weights(other, level)
    assert abs((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.07


def test_components_of_a_long_path(spark):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101)]
    got = {r.node: r.label for r in components.merge_classes(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}
    assert components.merge_classes(spark.createDataFrame([], "a long, b long")).count() == 0


# --- line dedup ------------------------------------------------------------

def test_lines_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(3)
    base = [" ".join(f"t{x}" for x in rng.zipf(1.4, int(rng.integers(1, 40))) % 300) for _ in range(60)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(int(rng.integers(0, 6))):
            w = base[int(rng.integers(0, 60))].split()
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = f"t{int(rng.integers(0, 300))}"
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(80, None), (81, ""), (82, "\n\n..\n"), (83, rows[0][1]), (83, rows[0][1])]
    docs = written(spark, tmp_path, rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.line_no, r.n_links, r.removed) for r in line_dedup.match_lines(docs).collect())
    flat = [(i, j, " ".join(words(line))) for i, t in rows for j, line in enumerate((t or "").split("\n"))]
    first = {}
    for i, j, line in flat:
        if line and line not in first:
            first[line] = (i, j)
    sets = {line: set(line.split()) for line in first}
    links = {line: [m for m in sets if m != line and 9 * len(sets[line] & sets[m]) >= 4 * (len(sets[line]) + len(sets[m]))] for line in sets}
    seen, want = set(), []
    for i, j, line in flat:
        again = line in seen
        seen.add(line)
        want.append((i, j, len(links.get(line, [])), bool(line) and (again or any(first[m] < first[line] for m in links[line]))))
    assert got == sorted(want)


def test_families_of_lines_are_verified_without_their_texts(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    rows, n_docs = [], 0
    for family in range(3):                                       # near copies; each differs from its family in up to two words
        base = [f"f{family}w{x}" for x in range(40)]
        for _ in range(25):
            w = list(base)
            for at in rng.integers(0, 40, int(rng.integers(0, 3))):
                w[at] = f"e{int(rng.integers(0, 60))}"
            rows.append((n_docs, " ".join(w)))
            n_docs += 1
    chain = [" ".join(f"c{x}" for x in range(i, i + 30)) for i in range(0, 20, 2)]   # neighbours match, the ends do not
    rows += [(n_docs + i, line) for i, line in enumerate(chain)]
    written_as, plain = {}, line_dedup.materialize

    def seen(df, name):
        written_as[name] = plain(df, name)
        return written_as[name]

    monkeypatch.setattr(line_dedup, "materialize", seen)
    got = sorted((r.doc_id, r.n_links, r.removed, r.class_id) for r in
                 line_dedup.match_lines(written(spark, tmp_path, rows, "doc_id long, text string")).collect())
    first = {}
    for i, line in rows:
        first.setdefault(line, i)
    sets = {line: set(line.split()) for line in first}
    links = {line: [m for m in sets if m != line and 9 * len(sets[line] & sets[m]) >= 4 * (len(sets[line]) + len(sets[m]))] for line in sets}
    assert got == sorted((i, len(links[line]), first[line] < i or any(first[m] < first[line] for m in links[line]), f"{first[line]}:0")
                         for i, line in rows)
    kept = [name for name, df in written_as.items() if any(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())]
    assert "lines" not in kept and "distinct-lines" in kept       # every line's text lies on disk once
    told = written_as["line-told"]
    on_texts, pairs = told.where("match IS NULL").count(), told.count()
    assert pairs >= 400 and 0 < on_texts <= pairs / 10
    assert {c for c, kind in told.dtypes if kind == "string"} == set()


def test_lines_of_nothing(edge, empty):
    assert line_dedup.match_lines(empty).count() == 0
    out = {(r.doc_id, r.text) for r in line_dedup.without_repeats(edge).collect()}
    assert (0, None) in out and (8, PROSE[2]) in out


# --- license scan ----------------------------------------------------------

def test_license_places_and_suppression(spark):
    rows = [(1, "CC BY cc by\ncc-by 4.0 General Public License"), (2, None), (3, ""), (4, "GNU General Public License version 3 or any later version"),
            (5, "All rights reserved. ccby"), (5, "All rights reserved. ccby"), (6, LONG + " all rights reserved")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (11, 4, 0, 8)
    assert got[1].base_labels == "cc-by,gpl" and "cc-by-4.0" in got[1].labels.split(",") and got[1].score == 1.0
    assert got[2].n_words == 0 and got[2].first_word is None and got[2].labels == "" and got[2].score == 0
    assert got[4].labels == "gpl,gpl-3.0-or-later"               # version 3 and the plain name lie inside the longer one
    assert got[5].base_labels == "reserved" and got[5].first_word == 0
    assert got[6].first_word == 30_000 and len(licenses.rules()) > 200


def test_every_rule_compiles_and_matches_its_gate():
    for r in licenses.rules():
        pattern = re.compile(licenses._as_line(r.pattern))
        assert not pattern.search("  "), r
        assert r.gate == r.gate.lower() and " " not in r.gate


def matches_of(parsed):
    """Lines that a parsed pattern matches: every branch, every optional part with and without."""
    parts = []
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            parts.append([chr(arg)])
        elif op == "SUBPATTERN":
            parts.append(matches_of(arg[3]))
        elif op == "BRANCH":
            parts.append([m for branch in arg[1] for m in matches_of(branch)])
        elif op == "IN":
            parts.append([chr(x if str(kind) == "LITERAL" else x[0]) for kind, x in arg])
        elif op in ("ANY", "NOT_LITERAL"):
            parts.append(["q"])
        else:
            least, most, inner = arg
            parts.append(["".join(m) for n in {least, min(least + 1, most)} for m in itertools.product(matches_of(inner), repeat=n)])
    return ["".join(m) for m in itertools.product(*parts)]


def test_every_match_contains_the_gate_of_its_rule():
    for r in licenses.rules():
        lines = [m for m in matches_of(re._parser.parse(licenses._as_line(r.pattern))) if re.fullmatch("( [^ ]+ )+", m)]
        assert lines, r
        for line in lines:
            assert r.gate in line.split(), (r, line)


def test_license_names_in_one_word(spark):
    want = {"GPLv2": "gpl-2.0", "GPLv3": "gpl-3.0", "LGPLv3": "lgpl-3.0", "LGPLv2.1 or later": "lgpl-2.1-or-later", "AGPLv3": "agpl-3.0",
            "gpl3": "gpl-3.0", "gplv 3": "gpl-3.0", "GPL v3": "gpl-3.0", "GPL v 2.0": "gpl-2.0", "gpl 2": "gpl-2.0", "0BSD license": "0bsd", "BSD zero clause": "0bsd",
            "Beerware license": "beerware", "the beer ware license": "beerware", "noncommercial use": "non-commercial",
            "non-commercial use": "non-commercial", "trademarks of": "trademark", "a trademark of": "trademark", "MS-PL 1.0": "ms-pl-1.0"}
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame([(t, t) for t in want], "doc_id string, text string")).collect()}
    assert {t: label in got[t].split(",") for t, label in want.items()} == dict.fromkeys(want, True), got


# --- fingerprints ----------------------------------------------------------

def test_fingerprint_is_homomorphic_and_order_free(spark):
    docs = spark.createDataFrame([("a\nb\nb\nc",), ("c\nb\na\nb",), ("a\nb\nb",), ("",)], "text string")
    v = [list(r[0]) for r in docs.select(fingerprints.vector(F.col("text"))).collect()]
    assert v[0] == v[1] and v[0] != v[2] and set(v[3]) == {0}
    grown = docs.where("text = 'a\\nb\\nb'").select(fingerprints.inserted(fingerprints.vector(F.col("text")), F.lit("c")).alias("v"))
    assert list(grown.first().v) == v[0]
    less = docs.where("text = 'c\\nb\\na\\nb'").select(fingerprints.deleted(fingerprints.vector(F.col("text")), F.lit("c")).alias("v"))
    assert list(less.first().v) == v[2]


def test_fingerprint_rows(spark, edge, empty):
    rows = fingerprints.fingerprint_rows(edge).collect()
    assert len(rows) == edge.count() and fingerprints.fingerprint_rows(empty).count() == 0
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 5)}) == 1
    own = sorted([(r[0] is not None, r[0] or 0, r[1] or "") for r in edge_rows()], key=lambda r: r[:2])
    want = sorted(hashlib.sha256((t[:len(t) - len(t) // 4] + own[(i + 1) % len(own)][2][:len(t) // 4]).encode()).hexdigest()
                  for i, (_, _, t) in enumerate(own))
    assert sorted(r.edited_sha256 for r in rows) == want
    alone = spark.createDataFrame([(1, "abcd\nefgh")], "doc_id long, text string")
    r = fingerprints.fingerprint_rows(alone).first()
    assert r.near_next == 1.0 and 0 <= r.near_edited <= 1


# --- URL filter ------------------------------------------------------------

def test_url_rules_and_reputation(spark):
    urls = [None, "no scheme", "http://WWW.Example.COM/en/x?q#f", "https://example.com/en/", "http://a.b.com", "http://x.com/p",
            "http://k.net/es/1", "http://k.net/de/1", "http://bad.org/1", "http://badexample.com/en/1"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)] + [(100 + i, "http://bad.org/2", "") for i in range(40)]
                                  + [(200 + i, "http://good.org/2", "") for i in range(40)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)] + [(None, 1, 0), (5, None, None)],
                                   "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in host_reputation.judge(pages, labels).collect()}
    assert (got[0].host, got[0].path, got[0].rule, got[0].verdict) == ("", "", None, "allow")
    assert (got[2].host, got[2].path, got[2].rule) == ("www.example.com", "/en/x", "www.example.com/en/")
    assert got[3].rule == "example.com/en/" and got[3].verdict == "block"
    assert got[4].rule is None and got[5].rule == "com/" and got[9].rule == "com/"
    assert got[6].verdict == "block" and got[7].rule is None
    assert got[8].verdict == "block" and got[200].verdict == "allow" and got[8].rate < 0.1 < got[7].rate
    assert host_reputation.judge(pages.limit(0), labels).count() == 0
    assert {r.verdict for r in host_reputation.judge(pages, labels.limit(0)).where("rule is null").collect()} == {"allow"}


# --- mixing ----------------------------------------------------------------

def test_raking_meets_the_marginals(spark):
    rng = np.random.default_rng(1)
    cells = [(f"s{i}", lang, t, int(rng.integers(1, 10_000)), 1) for i in range(6) for lang in ("en", "de", None) for t in ("x", "y")]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, weight long, n_docs long")
    raked = mixing.rake(df).collect()
    for d in mixing.DIMENSIONS:
        was, now = {}, {}
        for r in raked:
            was[r[d]] = was.get(r[d], 0) + r.weight
            now[r[d]] = now.get(r[d], 0) + r.raked
        total = sum(w ** mixing.POWERS[d] for w in was.values())
        assert all(abs(now[k] - was[k] ** mixing.POWERS[d] / total) < 1e-8 for k in was)
    p = mixing.probabilities(df).collect()
    assert all(0 <= r.probability <= 1 for r in p)
    assert abs(sum(r.probability * r.weight for r in p) / sum(r.weight for r in p) - mixing.RATE) < 1e-9


def test_given_targets_are_met_and_infeasible_ones_are_reported(spark):
    cells = [(s, lang, "x", w, 1) for s, lang, w in (("a", "en", 70), ("a", "de", 20), ("b", "en", 5), ("b", "de", 5), (None, "en", 50))]
    df = spark.createDataFrame(cells, "source string, lang string, topic string, weight long, n_docs long")
    targets = {"source": spark.createDataFrame([("a", 2.0), ("b", 1.0), (None, 1.0)], "v string, share double"),
               "lang": spark.createDataFrame([("en", 60.0), ("de", 40.0)], "v string, share double")}
    raked = mixing.rake(df, targets).collect()
    by = {d: {} for d in ("source", "lang")}
    for r in raked:
        for d in by:
            by[d][r[d]] = by[d].get(r[d], 0) + r.raked
    assert by["source"] == pytest.approx({"a": 0.5, "b": 0.25, None: 0.25}) and by["lang"] == pytest.approx({"en": 0.6, "de": 0.4})
    assert raked[0].raking_gap < 1e-8
    # structural zeros: all of the source that must hold 0.9 is English, which must hold 0.2
    never = {"source": spark.createDataFrame([(None, 0.9), ("a", 0.1)], "v string, share double"),
             "lang": spark.createDataFrame([("en", 0.2), ("de", 0.8)], "v string, share double")}
    assert mixing.probabilities(df, targets=never).first().raking_gap > 0.1
    absent = {"source": spark.createDataFrame([("a", 0.5), ("nowhere", 0.5)], "v string, share double")}
    assert mixing.probabilities(df, targets=absent).first().raking_gap >= 0.4


def test_topic_rules_and_columns_of_any_case(spark):
    docs = spark.createDataFrame([(1, "s", "en", "a cat", "T1"), (2, "s", "en", "a dog", None)], "doc_id long, source string, lang string, text string, Topic string")
    assert {r.topic for r in mixing.mix(docs).collect()} == {"T1", None} and mixing.sample(docs, 1.0).count() == 2
    got = {r.doc_id: r.topic for r in mixing.mix(docs.drop("Topic"), rules=(("pets", "cat"), ("other", "a "))).collect()}
    assert got == {1: "pets", 2: "other"}


def test_mixing_edges(edge, empty):
    rows = mixing.mix(edge).collect()
    assert len(rows) == edge.count() and mixing.mix(empty).count() == 0
    kept = mixing.sample(edge)
    assert kept.columns == edge.columns and kept.count() == sum(r.sampled for r in rows)


# --- token counts ----------------------------------------------------------

@pytest.mark.parametrize("rule", token_counts.RULES)
def test_tokens_add_up(edge, empty, rule):
    rows = token_counts.count_sections(edge, rule).collect()
    by_doc = {}
    for r in rows:
        key = (r.doc_id, r.doc_tokens)
        by_doc[key] = by_doc.get(key, 0) + r.n_tokens
    copies = {4: 2}
    assert all(abs(n - k[1] * copies.get(k[0], 1)) < 1e-6 for k, n in by_doc.items())
    assert token_counts.count_sections(empty, rule).count() == 0


def test_tokens_crossing_a_break(spark):
    docs = spark.createDataFrame([(1, "hello wonderful world", [3, 8]), (2, "été", [1, 99, -4, None]), (3, None, None)],
                                 "doc_id long, text string, breaks array<long>")
    ranks = open(token_counts.VOCABULARY, "rb").read()
    encoder, lengths = token_counts._encoder(ranks, token_counts.PATTERN)
    for rule in token_counts.RULES:
        got = {}
        for r in token_counts.count_sections(docs, rule, breaks="breaks").collect():
            got.setdefault(r.doc_id, []).append((r.start_char, r.end_char, r.n_tokens))
        for doc, text, breaks in ((1, "hello wonderful world", [0, 3, 8]), (2, "été", [0, 1, 2])):
            ends, at = [], 0
            for t in encoder.encode_ordinary(text):
                b = at + lengths[t]
                ends.append((len(text.encode()[:at + 1].decode(errors="ignore")) - (0 if text.encode()[at] < 128 else 0), at, b))
                at = b
            chars = [len(text[:i].encode()) for i in range(len(text) + 1)]
            want = np.zeros(len(breaks))
            at = 0
            for t in encoder.encode_ordinary(text):
                inside = [i for i in range(len(text)) if chars[i] < at + lengths[t] and chars[i + 1] > at]
                own = [int(np.searchsorted(breaks, i, side="right")) - 1 for i in inside]
                if rule == "first":
                    want[own[0]] += 1
                elif rule == "last":
                    want[own[-1]] += 1
                elif rule == "most":
                    want[max(sorted(set(own)), key=own.count)] += 1
                else:
                    for o in own:
                        want[o] += 1 / len(own)
                at += lengths[t]
            assert np.allclose([n for _, _, n in sorted(got[doc])], want), (rule, doc)
        assert got[3] == [(0, 0, 0.0)]


# --- sharding --------------------------------------------------------------

def test_hilbert_curve_visits_neighbours():
    side = 1 << 3
    grid = np.array(list(itertools.product(range(side), repeat=3))).T
    index = sharding.hilbert_index(grid, 3)
    assert sorted(index.tolist()) == list(range(side ** 3))
    walk = grid[:, np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_shards_hold_their_law(edge, empty):
    for shards in (3, 40):
        rows = sharding.shard_rows(edge, shards).collect()
        counts = [sum(r.shard == s for r in rows) for s in range(shards)]
        assert max(counts) - min(counts) <= 1 and sum(counts) == edge.count()
        for s in range(shards):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    texts = {r[0]: r[1] for r in edge_rows()}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    assert sharding.shard_rows(empty).count() == 0
    assert sharding.write_order(edge, 3).columns == [c for c in edge.columns if c != "shard"] + ["shard", "slot"]
    assert isinstance(sharding.write_order(edge, 3).schema["shard"].dataType, T.IntegerType)
