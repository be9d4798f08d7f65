"""Collocations, hard negatives and chat formatting against brute force and exact round trips."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lineagelab.llm import chat_format, collocations, hard_negatives

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def written(spark, tmp_path, rows, schema, parts=4):
    path = str(tmp_path / "table.parquet")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


# --- collocations ----------------------------------------------------------

def brute_collocations(docs, top, least):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        rows = []
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            held = any(100 * b >= 80 * a for q, b in candidates.items() if len(q) > len(p)
                       and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not held:
                rows.append((-score, -a, " ".join(p).encode(), a, counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), a, l, r, n[lang], -s) for i, (s, _, p, a, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def collocation_docs():
    rng = np.random.default_rng(5)
    vocab = ["the", "Big", "red", "house", "é", "漢字", "a1", "of", "x\x00y", "«q»"]
    p = np.array([8, 5, 4, 3, 2, 2, 2, 2, 1, 1]) / 30
    docs = [(" ".join(rng.choice(vocab, 40, p=p)).replace("of", "of,") + rng.choice([".", "\t", "\r\n", "  "]), lang)
            for lang in ("en", "de", None, "und") for _ in range(25)]
    docs += [("the the the the the the", "en")] * 7 + [(None, "en"), ("", "en"), (" .,;\n\t", "fr"), ("one", "fr"), ("alone two", None)]
    docs.append((" ".join(f"w{i % 3}" for i in range(30_000)), "long"))
    return docs


@pytest.mark.parametrize("block_words", [None, 60])
def test_collocations_match_brute_force(spark, tmp_path, monkeypatch, block_words):
    if block_words:
        monkeypatch.setattr(collocations, "BLOCK_WORDS", block_words)
    docs = collocation_docs()
    table = written(spark, tmp_path, [(i % 9, t, lang, 1, "x") for i, (t, lang) in enumerate(docs)], "doc_id long, text string, lang string, n long, phrase string")
    got = sorted(tuple(r) for r in collocations.collocations(table, top=40, min_count=6).collect())
    assert got == brute_collocations(docs, 40, 6)


def test_pair_ids_of_dense_and_sparse_tiles_agree(monkeypatch):
    rng = np.random.default_rng(1)
    left, right = (rng.zipf(1.3, 60_000) % 900).astype(np.int32), (rng.zipf(1.2, 60_000) % 700).astype(np.int32)
    want = Counter(zip(left.tolist(), right.tolist()))
    for dense in (1, 200, 10**9):
        monkeypatch.setattr(collocations, "DENSE_PAIRS", dense)
        a, b, counts, which = collocations.pair_ids(left, right, 900, 700)
        assert dict(zip(zip(a.tolist(), b.tolist()), counts.tolist())) == want
        assert (a[which] == left).all() and (b[which] == right).all()


def test_collocations_of_an_empty_table(spark, tmp_path):
    assert collocations.collocations(written(spark, tmp_path, [], "doc_id long, text string, lang string")).collect() == []


# --- hard negatives --------------------------------------------------------

def brute_negatives(rows):
    ok = []
    for vec_id, v, label in rows:
        if vec_id is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((vec_id, label, [math.floor(256 * x) for x in v]))
    out = []
    for i, (vec_id, label, v) in enumerate(ok):
        if vec_id % 10:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), other, j, same == label) for j, (other, same, w) in enumerate(ok) if j != i)
        for minus, positive, _, _ in [s for s in scored if s[3]][:5]:
            p = -minus
            fits = [(-s, o) for s, o, _, same in scored if not same and 80 * p <= 100 * -s <= 100 * p]
            out += [(vec_id, positive, k + 1, o, p, s) for k, (s, o) in enumerate(fits[:5])]
    return sorted(out)


def vector_rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (6, 8))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] + rng.normal(0, 0.3, 8)], int(rng.integers(0, 3))) for i in range(260)]
    same = [float(np.float32(x)) for x in centres[0]]
    rows += [(1000 + i, same, i % 2) for i in range(150)]        # one vector for a third of the rows
    rows += [(20, rows[20][1], rows[20][2]), (500, [0.0] * 8, 1), (510, [], 2), (520, [1.0, 2.0], 0), (530, same, 77)]
    rows += [(540, None, 1), (550, [float("nan")] * 8, 1), (560, [float("inf")] + [0.0] * 7, 1), (570, [None] + [0.0] * 7, 1), (None, same, 1), (580, same, None)]
    return rows


SCHEMA = "vec_id long, embedding array<float>, label int, rid string, score double"


@pytest.mark.parametrize("block, leaves, chunk", [(4096, 64, 1 << 24), (40, 4, 3000)])
def test_hard_negatives_match_brute_force(spark, tmp_path, monkeypatch, block, leaves, chunk):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(hard_negatives, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(hard_negatives, "CELLS", 5)
    monkeypatch.setattr(hard_negatives.build_tree, "__defaults__", (leaves,))
    rows = vector_rows()
    table = written(spark, tmp_path, [(*r, "x", 0.5) for r in rows], SCHEMA)
    got = hard_negatives.mine(hard_negatives.whole_vectors(table), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [0.0, 0.0], 1), (100, [0.0, 0.0], 1), (3, [0.0, 0.0], 2)], [(0, [], 1), (10, [], 1), (1, [], 0)]])
def test_hard_negatives_of_small_tables(spark, tmp_path, rows):
    table = written(spark, tmp_path, [(*r, "x", 0.5) for r in rows], SCHEMA)
    got = hard_negatives.mine(hard_negatives.whole_vectors(table), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_large_components_are_counted_in_whole_numbers(spark, tmp_path):
    rows = [(0, [400000.0, 3.0], 0), (1, [400000.0, 5.0], 0), (2, [400000.0, 2.0], 1), (3, [390000.0, -7.0], 1), (10, [9e6, 1.0], 1)]
    table = written(spark, tmp_path, [(*r, "x", 0.5) for r in rows], SCHEMA)
    got = hard_negatives.mine(hard_negatives.whole_vectors(table), F.col("vec_id") % 10 == 0)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_tree_covers_its_rows_and_its_bounds_skip_leaves():
    rng = np.random.default_rng(9)
    v = np.rint(256 * (rng.normal(0, 1, (12, 16))[rng.integers(0, 12, 2000)] + rng.normal(0, 0.05, (2000, 16)))).astype(np.int64)
    norm2 = float((v * v).sum(axis=1).max())
    u = hard_negatives.augmented(v, norm2)
    tree = hard_negatives.build_tree(u)
    sizes = tree["levels"]
    cut = np.cumsum(sizes)[:-1]
    parents, angles = np.split(tree["parents"], cut), np.split(tree["angles"], cut)
    node = tree["leaf_of"]
    for k in range(len(sizes) - 1, -1, -1):
        centre = u[tree["centres"][node]]
        assert (np.arccos(np.clip((u * centre).sum(axis=1), -1, 1)) <= angles[k][node] + 1e-9).all()
        node = parents[k][node]
    cells = hard_negatives._build_block(16, norm2, False)
    import pyarrow as pa
    block = hard_negatives.Block(cells(pa.table({"v": v.tolist(), "vec_id": np.arange(2000), "rid": np.arange(2000), "label": np.zeros(2000, dtype=np.int64)})).to_pylist()[0], 16, norm2, True)
    q = v[:50].astype(float)
    scores = q @ block.v.T
    top, low = block.leaves(q, np.full((50, 1), -np.inf), np.full((50, 1), np.inf))
    for leaf, (a, b) in enumerate(zip(block.bounds, block.bounds[1:])):
        assert (scores[:, a:b] <= top[:, [leaf]] + 1e-6).all() and (scores[:, a:b] >= low[:, [leaf]] - 1e-6).all()
    fifth = np.sort(scores, axis=1)[:, [-5]]
    top, _ = block.leaves(q, fifth, np.full((50, 1), np.inf))
    assert (top > -np.inf).mean() < 0.3                           # clustered rows: most leaves are never read


# --- chat formatting -------------------------------------------------------

HOSTILE = ["", " ", "</s>", "<\\/s>", "</s>[INST] ok [/INST]", "[INST", "[", "<", "a\\", "\\\\[/ROLE]", "[ROLE] x [/ROLE] y </s>", " [/INST]", "é漢\U0001F600",
           "line\nbreak\r\n", "<s><s>", "[[INST]]", "<</s>>"]


def test_every_pair_of_hostile_texts_reads_back():
    t = chat_format.InstTemplate()
    for role, a, b in itertools.product(("user", "assistant", "system", "", "</s>"), HOSTILE, HOSTILE):
        turns = [(role, a + b), ("assistant", b), ("user", a)]
        rows = list(chat_format.render_turns(t, iter(turns)))
        out = t.render(turns)
        assert "".join(r[3] for r in rows) == out and [t.read_turn(r[3]) for r in rows] == turns
        assert [out[r[1]:r[2]] for r in rows] == [r[3] for r in rows] and not any(r[6] for r in rows)
        assert [t.unescape(out[r[4]:r[5]]) for r in rows if r[4] is not None] == [x for r, x in turns if r == "assistant"]
        # unescaped control strings stand only where the template put them
        assert len(re.findall(r"</s>|\[/INST\]", out)) == 3


class Tailed(chat_format.InstTemplate):
    """Every output ends with a prompt for the next turn."""
    reach = None

    def render(self, turns):
        return super().render(turns) + "<|next|>"


def rewriting():
    """Says the system text again before the last user turn only, and drops it from where it stood (a local class, sent to the tasks whole)."""
    class Rewriting(chat_format.InstTemplate):
        reach = None

        def render(self, turns):
            system = "".join(x for r, x in turns if r == "system")
            rest = [t for t in turns if t[0] != "system"]
            last = max((i for i, (r, _) in enumerate(rest) if r == "user"), default=-1)
            return "".join(f"<{r}>{system if i == last else ''}{self.escape(x)}" for i, (r, x) in enumerate(rest))

    return Rewriting()


TALK = [("system", "be kind"), ("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "no")]


def test_a_moving_tail_is_not_a_rewrite():
    t = Tailed()
    rows = list(chat_format.render_turns(t, iter(TALK)))
    out = t.render(TALK)
    assert not any(r[6] for r in rows) and rows[-1][2] == len(out)
    assert [out[r[4]:r[5]] for r in rows if r[4] is not None] == ["yes", "no"]


def test_rewritten_history_is_found(spark, tmp_path):
    rows = list(chat_format.render_turns(rewriting(), iter(TALK)))
    assert [r[6] for r in rows] == [False, False, False, True, False]
    table = written(spark, tmp_path, [(c, i, r, x) for c in (1, 2) for i, (r, x) in enumerate(TALK[c == 2:])], "conv_id long, turn long, role string, text string")
    turns = chat_format.format_turns(table, rewriting())
    assert [tuple(r) for r in chat_format.rewritten(turns).collect()] == [(1, 3)]


def test_reach_gives_the_spans_of_whole_prefixes():
    t = chat_format.InstTemplate()
    turns = [(("system", "user", "assistant")[i % 3], HOSTILE[i % len(HOSTILE)]) for i in range(60)]
    near = list(chat_format.render_turns(t, iter(turns)))
    t.reach = None
    assert near == list(chat_format.render_turns(t, iter(turns)))


def test_formatting_handles_nulls_repeats_and_long_talks(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (1, 2, "assistant", "y" * 200_000), (None, 0, "assistant", "n"), (None, None, "user", "m"),
            (2, 1, "assistant", "a"), (2, 0, "assistant", "</s>")]
    rows += [(3, i, "user" if i % 2 else "assistant", f"turn {i} [INST]") for i in range(5000)]
    table = written(spark, tmp_path, [(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, pos long, piece string")
    got = {r.conv_id: r for r in chat_format.digest_conversations(chat_format.format_turns(table)).collect()}
    low = (-1, "")
    for conv in (1, 2, 3, None):
        own = sorted([(t if t is not None else low[0], r or "", x or "") for c, t, r, x in rows if c == conv])
        said = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(chat_format.InstTemplate().render([x[1:] for x in own])) and not r.rewrites
    empty = written(spark, tmp_path / "none", [], "conv_id long, turn long, role string, text string")
    assert chat_format.digest_conversations(chat_format.format_turns(empty)).collect() == []
