"""Language identification by prediction with partial matching (PPM).

Per language a byte context tree of orders 0 to 3 with escape method C and
exclusion is frozen after training; a text's score in a language is its exact
code length, kept in fixed point (1/1024 bit) so that sums do not depend on the
order of work. The language with the shortest code wins (ties: first name).

Training counts 4-byte runs over all training documents as a Spark aggregation;
the counts of shorter contexts follow from them. Bytes are normalised first: A-Z
lower-cased, runs of ASCII characters that are not letters become one blank, and
each text is preceded by three blanks. All contexts and runs of all orders are kept,
sparsely: per language the runs that were seen and the escapes of their contexts, about
twelve bytes per distinct run, whatever the alphabet. The model thus grows with the
distinct runs of the training text, not with its size.

Edge cases: a null text or one without a letter is ``und`` with score 0; a null
doc_id counts as the empty string for the split; with no labelled training
documents every text is ``und``; repeated documents get equal answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import bound_batches, materialize

ORDER = 3
UNIT = 1024
# Most labelled documents that the trees are fitted on; beyond it a hash of doc_id chooses.
FIT_ROWS = 400_000
# A text is in no learned language when its best code is longer than this many times what the
# language's training texts take a byte, plus ALLOW bits (short texts vary).
FAR, ALLOW = 2.0, 64.0
_MASK = [np.uint32((1 << 8 * (k + 1)) - 1) for k in range(ORDER + 1)]   # the last k + 1 bytes of a run

_FOLD = textscan.LOWER.copy()
_FOLD[[i for i in range(128) if not (65 <= i <= 90 or 97 <= i <= 122)]] = 32


def _symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of a slice, each document preceded by ORDER blanks; offsets of the documents."""
    n_docs = len(offsets) - 1
    sym = _FOLD[buf]
    keep = np.ones(len(sym), dtype=bool)
    keep[1:] = (sym[1:] != 32) | (sym[:-1] != 32)
    starts = offsets[:-1][offsets[1:] > offsets[:-1]]
    keep[starts] = sym[starts] != 32
    kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
    out = np.full(int(kept[-1]) + ORDER * n_docs, 32, dtype=np.uint8)
    at = np.arange(int(kept[-1])) + np.repeat(ORDER * np.arange(1, n_docs + 1), np.diff(kept))
    out[at] = sym[keep]
    return out, kept + ORDER * np.arange(n_docs + 1)


def _codes(sym: np.ndarray) -> np.ndarray:
    """The 4-byte runs (three of context, one coded) from every place on as numbers."""
    s = sym.astype(np.uint32)
    return (s[:-3] << 24) | (s[1:-2] << 16) | (s[2:-1] << 8) | s[3:]


def _runs(sym: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs of every document and where each begins."""
    code = _codes(sym)
    inside = np.ones(len(code), dtype=bool)
    for j in range(1, ORDER + 1):                               # runs that reach into the next document
        cut = offsets[1:-1] - j
        inside[cut[cut < len(code)]] = False
    first = offsets[:-1] - ORDER * np.arange(len(offsets) - 1)
    return code[inside], first


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, run, count), merged within the task."""
    have: dict[str, list] = {}

    def merged(parts):
        codes = np.concatenate([p[0] for p in parts])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], np.concatenate([p[1] for p in parts])[order]
        new = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[new], np.add.reduceat(counts, new)

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), dtype=object)
        texts = textscan.strings(batch.column(1))
        for lang in sorted(set(langs)):
            own = texts.take(pa.array(np.flatnonzero(langs == lang)))
            for lo, hi in textscan.slices(own):
                sym, offsets = _symbols(*textscan.raw_bytes(own, lo, hi))
                if len(sym) > ORDER:
                    codes, _ = _runs(sym, offsets)
                    parts = have.setdefault(lang, [])
                    parts.append(np.unique(codes, return_counts=True))
                    if len(parts) > 16:
                        have[lang] = [merged(parts)]
    for lang, parts in have.items():
        codes, counts = merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts.astype(np.int64))],
            names=["lang", "run", "c"])


class Model:
    """Frozen code lengths: per language and order the runs and contexts seen in training, sorted."""

    def __init__(self, runs: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(runs)
        used = np.unique(np.concatenate([np.unique((runs[x][0] >> k) & 255) for x in self.langs for k in (24, 16, 8, 0)])) \
            if self.langs else np.array([32])
        # one more symbol stands for every byte never seen in training
        self.trees = [_tree(*runs[x], len(used) + 1) for x in self.langs]
        # code length a byte of each language's own training texts
        self.typical = np.array([float((runs[x][1] * _bits(t, runs[x][0])).sum() / runs[x][1].sum()) for x, t in zip(self.langs, self.trees)])

    def lengths(self, sym: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code length (1/1024 bit) per document and language, and the number of coded bytes."""
        n_docs = len(offsets) - 1
        total = np.zeros((n_docs, len(self.langs)), dtype=np.int64)
        size = np.diff(offsets) - ORDER
        full = np.flatnonzero(size > 0)
        if len(full):
            code, at = np.unique(_codes(sym), return_inverse=True)
            # runs that cross into the next document lie between the ranges that are summed
            bounds = np.stack([offsets[full], np.minimum(offsets[full + 1] - ORDER, len(at))], axis=1).ravel()
            last = bounds[-1] == len(at)
            for k, tree in enumerate(self.trees):
                sums = np.add.reduceat(_bits(tree, code)[at], bounds[:-1] if last else bounds)
                total[full, k] = sums[::2]
        return total, size


def _tree(code: np.ndarray, c: np.ndarray, n_symbols: int) -> list[tuple[np.ndarray, ...]]:
    """(runs, their bits, contexts, bits of their escapes) of order 0 to ORDER: method C with exclusion.

    Seen symbols go by count; the escape mass is spread as the lower order does over the
    symbols not seen. What a context has seen its suffix has seen too, and the lower
    order sums to 1, so the mass it leaves is 1 less that of the seen symbols.
    """
    out, below, p = [], None, None
    for k in range(ORDER + 1):
        run, at = np.unique(code & _MASK[k], return_inverse=True)
        n = np.bincount(at, weights=c)
        context, own = np.unique(run >> np.uint32(8), return_inverse=True)
        distinct = np.bincount(own)
        den = np.bincount(own, weights=n) + distinct
        if k == 0:
            left = (n_symbols - distinct) / 256                  # order -1: any byte
        else:
            left = 1 - np.bincount(own, weights=p[np.searchsorted(below, run & _MASK[k - 1])])
        escape = distinct / den / np.maximum(left, 1e-12)
        below, p = run, n / den[own]
        out.append((run, -np.log2(p), context, -np.log2(escape)))
    return out


def _bits(tree: list[tuple[np.ndarray, ...]], code: np.ndarray) -> np.ndarray:
    """Code lengths (1/1024 bit) of runs in one language."""
    out, left = np.zeros(len(code)), np.arange(len(code))
    for k in range(ORDER, -1, -1):
        run, bits, context, escape = tree[k]
        x = code[left] & _MASK[k]
        i = np.minimum(np.searchsorted(run, x), len(run) - 1)
        seen = run[i] == x
        out[left[seen]] += bits[i[seen]]
        left, x = left[~seen], x[~seen] >> np.uint32(8)
        i = np.minimum(np.searchsorted(context, x), len(context) - 1)
        known = context[i] == x
        out[left[known]] += escape[i[known]]
    out[left] += 8                                               # order -1: any byte
    return np.round(out * UNIT).astype(np.int64)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame) -> Model:
    """Frozen trees from text and non-null lang of the documents outside the held-out third.

    Of more than ``FIT_ROWS`` such documents a share is taken by the hash of doc_id, which bounds
    the model; every document is predicted whatever their number.
    """
    training = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    n = training.count()
    if n > FIT_ROWS:
        share = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 20))
        training = training.where(share < int(FIT_ROWS / n * (1 << 20)))
    runs = (bound_batches(training).select("lang", "text").mapInArrow(_count_task, "lang string, run long, c long")
            .groupBy("lang", "run").agg(F.sum("c").alias("c")))
    runs = materialize(runs, "ppm-runs")
    model: dict = {}
    for r in runs.select("lang").distinct().collect():
        t = runs.where(F.col("lang") == r.lang).select("run", "c").toArrow()
        model[r.lang] = (t.column("run").to_numpy().astype(np.uint32), t.column("c").to_numpy())
    return Model(model)


def _predict_task(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = textscan.strings(batch.column(text_at))
            letters = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False).astype(bool) \
                if len(texts) else np.zeros(0, dtype=bool)
            pred, score, fits = [], [], []
            for lo, hi in textscan.slices(texts):
                bits, size = model.lengths(*_symbols(*textscan.raw_bytes(texts, lo, hi)))
                if model.langs:
                    best = bits.argmin(axis=1)
                    gap = (bits - bits.min(axis=1, keepdims=True)) / UNIT
                    posterior = 1.0 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
                    ok = letters[lo:hi]
                    pred += [model.langs[b] if x else "und" for b, x in zip(best, ok)]
                    score += np.where(ok, posterior, 0.0).tolist()
                    fits += (ok & (bits.min(axis=1) <= FAR * model.typical[best] * size + ALLOW * UNIT)).tolist()
                else:
                    pred += ["und"] * (hi - lo)
                    score += [0.0] * (hi - lo)
                    fits += [False] * (hi - lo)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(fits, pa.bool_())],
                                             names=[*batch.schema.names, "lang_pred", "score", "fits"])
    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``fits`` (same-named input columns are replaced).

    ``score`` is the posterior of the chosen language under equal priors; ``fits`` says whether the text's
    code length is that of a text of the language at all (``FAR``, ``ALLOW``).
    """
    docs = bound_batches(docs.drop("lang_pred", "score", "fits"))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("fits", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)     # about 12 bytes per distinct run
    return docs.mapInArrow(_predict_task(shared, docs.columns.index("text")), schema)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents written in a learned language, columns unchanged: neither ``und`` nor far from all of them."""
    packed = docs.select("text", F.struct("*").alias("_row"))
    return predict(packed, model).where((F.col("lang_pred") != "und") & F.col("fits")).select("_row.*")
