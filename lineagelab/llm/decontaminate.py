"""Benchmark decontamination: prefix-filtered set join with exact window verification.

Every benchmark item is cut into windows of ``window`` consecutive words (a
shorter item is one window). A window is a set of shingles of ``shingle`` words
(fewer if the window is shorter). Containment of a whole window asks for all its
shingles, so of its shingles ordered by rarity a prefix of one, the rarest in the
documents, must occur in a document that contains it. Rarity is counted over all
documents. Each occurrence of a prefix shingle fixes where the window would
begin; the positional bound (not before the first word) and the length bound (not
past the last) cut it, and all words of the window are compared last.

The windows are a stated query set. They go to the tasks in blocks of at most
``BLOCK_WINDOWS``; each block scans all documents. Nothing is gathered per item
or passage, so a passage in a third of all documents costs what its rows cost.

Edge cases: null and empty texts have no words and are never contaminated; items
without words have no window; equal items each count; repeated documents are
judged one by one; with an empty benchmark no document is hit; a null item_id counts
as an item but is not listed in the digest (all null ids are one item).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import blank_count, bound_batches, materialize, with_row_id, words_line

WINDOW = 13
SHINGLE = 5
# Most windows that are sent to the tasks at once (13 hashes of 8 bytes each: below 60 MB).
BLOCK_WINDOWS = 400_000

JUDGED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
])


class Windows:
    """Distinct windows of a block of items: word hashes, lengths and the items of each."""

    def __init__(self, items: list, texts: pa.Array, window: int, shingle: int):
        found: dict[tuple, list] = {}
        row = 0
        for lo, hi, words in textscan.scan(texts):
            for i in range(hi - lo):
                own = words.hashes[words.first[i]:words.first[i + 1]]
                n = min(window, len(own))
                if n:
                    for at in range(len(own) - n + 1):
                        found.setdefault(tuple(own[at:at + n].tolist()), []).append(items[row + i])
            row += hi - lo
        self.words = [np.array(k, dtype=np.uint64) for k in found]
        self.items = [sorted(set(v), key=str) for v in found.values()]
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.table = np.zeros((len(self.words), window), dtype=np.uint64)
        for i, w in enumerate(self.words):
            self.table[i, :len(w)] = w
        # shingles of each window: (window, offset, shingle size, hash)
        self.grams = [(i, at, min(shingle, len(w)), textscan.gram_hash(w[at:at + min(shingle, len(w))]))
                      for i, w in enumerate(self.words) for at in range(len(w) - min(shingle, len(w)) + 1)]

    def prefix(self, frequency: dict) -> None:
        """Keeps of each window the rarest shingle (ties: smaller hash, then earlier)."""
        best: dict[int, tuple] = {}
        for i, at, n, h in self.grams:
            rank = (frequency.get((n, int(h)), 0), int(h), at)
            if i not in best or rank < best[i][0]:
                best[i] = (rank, at, n, h)
        self.by_size = {}
        for n in sorted({b[2] for b in best.values()}):
            rows = sorted((int(b[3]), i, b[1]) for i, b in best.items() if b[2] == n)
            self.by_size[n] = (np.array([r[0] for r in rows], dtype=np.uint64),
                               np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))


def _gate(keys: np.ndarray) -> np.ndarray:
    gate = np.zeros(1 << 18, dtype=bool)
    gate[(keys >> np.uint64(46)).astype(np.int64)] = True
    return gate


def _lookup(words: textscan.Words, n: int, keys: np.ndarray, gate: np.ndarray):
    """Positions of the n-word shingles that are among the sorted ``keys``, and the hash there."""
    h, inside = words.grams(n)
    at = np.flatnonzero(gate[(h >> np.uint64(46)).astype(np.int64)] & inside)
    if not len(at):
        return at, h[at]
    k = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
    at = at[keys[k] == h[at]]
    return at, h[at]


def _count_task(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = {n: (k, _gate(k), np.zeros(len(k), dtype=np.int64)) for n, k in shared.value.items()}
        for batch in batches:
            for _, _, words in textscan.scan(batch.column(text_at)):
                for n, (keys, gate, counts) in sets.items():
                    _, h = _lookup(words, n, keys, gate)
                    counts += np.bincount(np.searchsorted(keys, h), minlength=len(keys))
        for n, (keys, _, counts) in sets.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(seen), n, dtype=np.int32)), pa.array(keys[seen].view(np.int64)),
                 pa.array(counts[seen])], names=["n", "h", "c"])
    return run


def _frequency(docs: DataFrame, windows: Windows) -> dict:
    """How often each shingle of the windows occurs in all documents: {(size, hash): count}."""
    keys: dict[int, set] = {}
    for _, _, n, h in windows.grams:
        keys.setdefault(n, set()).add(int(h))
    shared = docs.sparkSession.sparkContext.broadcast(
        {n: np.array(sorted(k), dtype=np.uint64) for n, k in keys.items()})
    parts = docs.select("text").mapInArrow(_count_task(shared, 0), "n int, h long, c long")
    rows = parts.groupBy("n", "h").agg(F.sum("c").alias("c")).collect()   # at most the block's shingles
    return {(r.n, r.h & (2**64 - 1)): r.c for r in rows}


def _hits(words: textscan.Words, windows: Windows, gates: dict):
    """(window, first word) of every verified occurrence in a slice."""
    wins, begins = [], []
    for n, (keys, wid, offset) in windows.by_size.items():
        at, h = _lookup(words, n, keys, gates[n])
        if not len(at):
            continue
        lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
        per = hi - lo                                            # windows that share this prefix shingle
        pos = np.repeat(at, per)
        row = np.repeat(lo - np.concatenate([[0], np.cumsum(per)[:-1]]), per) + np.arange(per.sum())
        win, begin = wid[row], pos - offset[row]
        doc = np.searchsorted(words.first, pos, side="right") - 1
        ok = (begin >= words.first[doc]) & (begin + windows.size[win] <= words.first[doc + 1])
        win, begin = win[ok], begin[ok]
        same = np.ones(len(win), dtype=bool)
        for j in range(windows.table.shape[1]):
            use = same & (windows.size[win] > j)
            same[use] = words.hashes[begin[use] + j] == windows.table[win[use], j]
        wins.append(win[same])
        begins.append(begin[same])
    if not wins:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(wins), np.concatenate(begins)


def _judge_slice(words: textscan.Words, windows: Windows, gates: dict):
    """Per document of a slice: hit words as (first, end) runs and the items found."""
    win, begin = _hits(words, windows, gates)
    cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + windows.size[win], -1)
    hit = np.cumsum(cover)[:-1] > 0
    items: list[set] = [set() for _ in range(len(words.counts))]
    doc = np.searchsorted(words.first, begin, side="right") - 1
    for d, w in set(zip(doc.tolist(), win.tolist())):
        items[d].update(windows.items[w])
    return hit, items


def _find_task(shared, text_at: int):
    """All columns of the batch, plus the hit words (as runs) and items of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        gates = {n: _gate(k) for n, (k, _, _) in windows.by_size.items()}
        for batch in batches:
            n_words, n_hit, n_items, sha, bad = [], [], [], [], []
            for _, _, words in textscan.scan(batch.column(text_at)):
                hit, items = _judge_slice(words, windows, gates)
                total = np.concatenate([[0], np.cumsum(hit)])
                own = total[words.first[1:]] - total[words.first[:-1]]
                n_words += words.counts.tolist()
                n_hit += own.tolist()
                bad += ((own > 0) & (20 * own >= words.counts)).tolist()
                for found in items:
                    n_items.append(len(found))
                    sha.append(hashlib.sha256(",".join(_listed(found)).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_())],
                names=[*batch.schema.names, *JUDGED.names])
    return run


def _listed(items: set) -> list[str]:
    """The ids of found items in order; a null id counts as an item but is not listed."""
    return sorted(str(i) for i in items if i is not None)


def _runs_task(shared, text_at: int, id_at: int):
    """For a block: (row id, words, hit runs, items) of every document that is hit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = shared.value
        gates = {n: _gate(k) for n, (k, _, _) in windows.by_size.items()}
        for batch in batches:
            ids, first, end, found = [], [], [], []
            row_ids = batch.column(id_at).to_pylist()
            for lo, _, words in textscan.scan(batch.column(text_at)):
                hit, items = _judge_slice(words, windows, gates)
                for d in [i for i, x in enumerate(items) if x]:
                    own = np.concatenate([[False], hit[words.first[d]:words.first[d + 1]], [False]])
                    edge = np.flatnonzero(own[1:] != own[:-1])
                    ids.append(row_ids[lo + d])
                    first.append(edge[::2].tolist())
                    end.append(edge[1::2].tolist())
                    found.append(_listed(items[d]) + [None] * (None in items[d]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(first, pa.list_(pa.int64())),
                 pa.array(end, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))],
                names=["_rid", "first", "end", "items"])
    return run


def _blocks(benchmark: DataFrame, window: int, shingle: int) -> Iterator[Windows]:
    """The windows of the benchmark in blocks of bounded size."""
    items, texts, room = [], [], BLOCK_WINDOWS
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").toLocalIterator():
        items.append(r.i)
        texts.append(r.text)
        room -= len(r.text or "") // 2 + 1                       # a text has no more words than that
        if room <= 0:
            yield Windows(items, pa.array(texts, pa.string()), window, shingle)
            items, texts, room = [], [], BLOCK_WINDOWS
    yield Windows(items, pa.array(texts, pa.string()), window, shingle)


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the columns of ``JUDGED`` (same-named input columns are replaced).

    One block of windows (the usual case) needs no shuffle: the verdict is made in
    the scan. More blocks are joined by row id from the runs each block found.
    """
    docs = bound_batches(docs.drop(*JUDGED.names))
    blocks = _blocks(benchmark, window, shingle)
    block, following = next(blocks), next(blocks, None)
    sc = docs.sparkSession.sparkContext
    schema = T.StructType([*docs.schema.fields, *JUDGED.fields])
    at = docs.columns.index("text")
    if following is None:
        block.prefix(_frequency(docs, block))
        return docs.mapInArrow(_find_task(sc.broadcast(block), at), schema)
    rows = materialize(with_row_id(docs.select(F.struct("*").alias("row")), "_rid"), "decontaminate")
    plain = rows.select("_rid", F.col("row.text").alias("text"))
    runs = None
    while block is not None:
        block.prefix(_frequency(plain, block))
        part = plain.mapInArrow(_runs_task(sc.broadcast(block), 1, 0),
                                "_rid long, first array<long>, end array<long>, items array<string>")
        part = materialize(part, "decontaminate-runs")
        runs = part if runs is None else runs.unionByName(part)
        block, following = following, next(blocks, None)
    merged = runs.groupBy("_rid").agg(                           # a row for each block at most
        F.flatten(F.collect_list(F.arrays_zip("first", "end"))).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    step = F.aggregate(
        F.array_sort("runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), r["end"] - F.greatest(r["first"], a["to"]))).alias("n"),
                              F.greatest(a["to"], r["end"]).alias("to")))["n"]
    found = merged.select("_rid", step.alias("n_hit"), "items")
    line = words_line(F.col("row.text"))
    n_words = F.when(line == "", 0).otherwise(blank_count(line) + 1).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = rows.join(found, "_rid", "left").withColumn("n_words", n_words)
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("row.*", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
                      F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
                      ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated documents, columns unchanged."""
    columns = docs.columns
    kept = [c for c in columns if c not in JUDGED.names]
    if len(kept) == len(columns):
        return judge(docs, benchmark).where(~F.col("contaminated")).select(*[F.col(f"`{c}`") for c in columns])
    packed = docs.select(F.col("text"), F.struct("*").alias("_row"))
    return judge(packed, benchmark).where(~F.col("contaminated")).select("_row.*")
