"""Phrase collocations: direct-address tiles of frequency-ranked ids, grown word by word.

Everything is per language (null: ``und``). Text is lower-cased (A-Z), split at
``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words.

1. A task turns its texts into blocks of about ``BLOCK_WORDS`` words of one language: the
   distinct words (exact, dictionary-encoded) and one id per position, with a break
   between pieces. Ids are ranks by frequency within the block. Blocks are written once.
2. Pairs of neighbouring ids fall into tiles of ``TILE`` x ``TILE`` ranks. Full tiles (both
   words frequent) are counted by one dense ``bincount``, addressed by the ids themselves;
   the others as sorted COO keys. Either way a pair gets an exact id.
3. Counts leave the block as (lang, phrase, count) and are summed by phrase, so no
   hash stands for a phrase anywhere in the result.
4. Phrases found ``MIN_COUNT`` times or more are marked in a bitmap of fixed size
   (``FILTER_BITS``, broadcast). The next level keeps only positions where a marked phrase
   starts, ranks their pairs by frequency again, and counts (phrase id, word id) pairs in the same
   tiles: pairs of words, then triples, then runs of four. A false mark only costs time: the sum decides.

Memory: one block per task in work and as much again still open, the bitmap, and tiles in
groups of ``TILES_AT_ONCE``. Nothing grows on the driver but the bitmap (16 MB at most,
whatever the corpus).

Score of a phrase (f = all its occurrences, a = its f): over the cuts after the first k
words, the lowest ``floor(SCALE * a / (f(first) + f(rest)))``, ties to the smallest k.
A phrase inside a longer candidate with at least 80 % of its count is dropped.

Edge cases: a null or empty text has no words; a text of one word has no phrase; repeated
rows and equal doc_ids count each time; a null language and the language ``und`` are
one; an empty table gives no rows; a column called like a result column is not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import arrow_batches, materialize

LONGEST = 4
MIN_COUNT = 30
SCALE = 2_000_000
INSIDE_PERCENT = 80
TOP = 2000

BLOCK_WORDS = 1 << 20
TILE = 256
DENSE_PAIRS = TILE * TILE // 16
TILES_AT_ONCE = 32
FILTER_BITS = 27
_SALTS = 32
_ROWS = 1 << 16

# Bytes between words (1) and between pieces (2); every other byte belongs to a word.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = 2

_FIELDS = [("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("words", pa.large_string()), ("word_ids", pa.large_binary())]
_BLOCKS = pa.schema(_FIELDS)
_BLOCKS_SPARK = "lang string, phrase string, n long, words string, word_ids binary"
_COUNTS = pa.schema(_FIELDS[:3])
_COUNTS_SPARK = "lang string, phrase string, n long"


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of a slice of texts, and the number of the piece that each lies in."""
    kind = _CLASS[buf]
    isw = kind == 0
    n = len(buf)
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = isw[1:] != isw[:-1]
    edge[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
    starts = np.flatnonzero(edge[:n] & isw)
    ends = np.flatnonzero(edge[1:] & isw) + 1
    # both counts only grow, so their sum is equal for two words just when both are
    piece = np.cumsum(kind == 2)[starts] + np.searchsorted(offsets, starts, side="right")
    bounds = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(ends - starts, out=bounds[1:])
    values = textscan.LOWER[buf[isw]]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(values)), piece


def _rank(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` ids from the most frequent on, and every position's rank (-1 stays)."""
    order = np.argsort(-np.bincount(ids[ids >= 0], minlength=n), kind="stable")
    ranks = np.full(n + 1, -1, dtype=np.int32)                   # the last one answers -1
    ranks[order] = np.arange(n, dtype=np.int32)
    return order, ranks[ids]


def pair_ids(left: np.ndarray, right: np.ndarray, n_left: int, n_right: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ranks: (left, right, count) of each, and each position's pair."""
    across = n_right // TILE + 1
    tile = (left // TILE).astype(np.int64) * across + right // TILE
    slot = np.full((n_left // TILE + 1) * across, -1, dtype=np.int64)
    full = np.flatnonzero(np.bincount(tile, minlength=len(slot)) >= DENSE_PAIRS)
    slot[full] = np.arange(len(full))
    at = slot[tile]
    found, which, before = [], np.empty(len(left), dtype=np.int64), 0
    for lo in range(0, len(full), TILES_AT_ONCE):                # dense tiles: the ids are the address
        n_tiles = min(TILES_AT_ONCE, len(full) - lo)
        own = np.flatnonzero((at >= lo) & (at < lo + n_tiles))
        cell = (at[own] - lo) * (TILE * TILE) + (left[own] % TILE).astype(np.int64) * TILE + right[own] % TILE
        counts = np.bincount(cell, minlength=n_tiles * TILE * TILE)
        hit = counts > 0
        which[own] = before + (np.cumsum(hit) - 1)[cell]
        cells = np.flatnonzero(hit)
        home = full[lo + cells // (TILE * TILE)]
        found.append((home // across * TILE + cells // TILE % TILE, home % across * TILE + cells % TILE, counts[cells]))
        before += len(cells)
    rest = np.flatnonzero(at < 0)                                # sparse tiles: sorted keys
    keys, inverse, counts = np.unique(left[rest].astype(np.int64) * n_right + right[rest], return_inverse=True, return_counts=True)
    which[rest] = before + inverse
    found.append((keys // max(n_right, 1), keys % max(n_right, 1), counts))
    return *(np.concatenate([f[i] for f in found]) for i in range(3)), which


def _count_rows(lang: str, phrases: pa.Array, counts: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(phrases), _ROWS):
        part = phrases.slice(lo, _ROWS).cast(pa.string())
        k = len(part)
        none = [pa.nulls(k, t) for t in schema.types[3:]]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), part,
                                          pa.array(counts[lo:lo + k].astype(np.int64)), *none], schema=schema)


def _close_block(lang: str, parts: list) -> Iterator[pa.RecordBatch]:
    """Words of one language, coded and counted; the block itself is a last row."""
    coded = pa.chunked_array([w for w, _ in parts]).dictionary_encode().unify_dictionaries()
    distinct = coded.chunk(0).dictionary
    codes = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int32)
    piece, base = [], 0
    for _, p in parts:                                           # slices are whole texts, so each starts a piece
        piece.append(p + base)
        base = int(piece[-1][-1]) + 1
    piece = np.concatenate(piece)
    gaps = np.concatenate([[0], np.cumsum(piece[1:] != piece[:-1])])
    ids = np.full(len(codes) + int(gaps[-1]), -1, dtype=np.int32)
    ids[np.arange(len(codes)) + gaps] = codes
    order, ids = _rank(ids, len(distinct))
    words = distinct.take(pa.array(order))
    yield from _count_rows(lang, words, np.bincount(ids[ids >= 0], minlength=len(words)), _BLOCKS)
    values = [lang, None, None, "\n".join(words.to_pylist()), ids.tobytes()]      # no word holds a line feed
    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _BLOCKS.types)], schema=_BLOCKS)


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_blocks: dict[str, list] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for batch in batches:
        langs = batch.column("lang").cast(pa.string()).fill_null("und")
        for lang in langs.unique().to_pylist():
            texts = textscan.strings(batch.column("text").filter(pc.equal(langs, lang)))
            for lo, hi in textscan.slices(texts):
                words, piece = _words(*textscan.raw_bytes(texts, lo, hi))
                if len(words):
                    open_blocks[lang].append((words, piece))
                    size[lang] += len(words)
                if size[lang] >= BLOCK_WORDS or sum(size.values()) >= 2 * BLOCK_WORDS:
                    most = max(size, key=size.get)
                    yield from _close_block(most, open_blocks.pop(most))
                    del size[most]
    for lang, parts in open_blocks.items():
        if parts:
            yield from _close_block(lang, parts)


def _word_hashes(lang: str, words: pa.Array) -> np.ndarray:
    return textscan.mix(textscan.string_hashes(words) + textscan.string_hashes(pa.array([lang], pa.string()))[0])


def _longer_hash(phrase: np.ndarray, word: np.ndarray) -> np.ndarray:
    return textscan.mix(phrase * np.uint64(0x9E3779B97F4A7C15) + word)


def _is_marked(marked: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - FILTER_BITS)
    return (marked[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def count_longer(lang: str, words: pa.Array, ids: np.ndarray, length: int, marked: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Phrases of ``length`` words of a block whose two parts of ``length`` - 1 words are marked, and their counts."""
    of_word = np.append(_word_hashes(lang, words), np.uint64(0))[ids]
    n = len(ids)
    whole, hashes = ids >= 0, of_word                            # does a phrase of k words start here, and its hash
    for k in range(1, length - 1):
        hashes = _longer_hash(hashes[:n - k], of_word[k:])
        whole = whole[:n - k] & (ids[k:] >= 0)
    marks = np.zeros(n + 1, dtype=bool)
    marks[:len(whole)] = whole
    hit = np.flatnonzero(whole)
    marks[hit] = _is_marked(marked, hashes[hit])
    starts = np.flatnonzero(marks[:-1] & marks[1:])
    if not len(starts):
        return
    phrases, now, rank = words, ids[starts], None
    for k in range(1, length):                                   # pairs, then pairs ranked anew with the next word
        if rank is not None:
            order, now = _rank(rank, len(phrases))
            phrases = phrases.take(pa.array(order))
        left, right, counts, rank = pair_ids(now, ids[starts + k], len(phrases), len(words))
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(left)), words.take(pa.array(right)), " ")
    yield phrases, counts


def _grow(length: int, bits: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(bits, dtype=np.uint64)
        for batch in batches:
            for lang, joined, ids in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "word_ids"))):
                words = pa.array(joined.split("\n"), pa.string())
                for phrases, counts in count_longer(lang, words, np.frombuffer(ids, dtype=np.int32), length, marked):
                    yield from _count_rows(lang, phrases, counts, _COUNTS)
    return run


def _places(length: int):
    """(at, bits): the marks of a part of the frequent phrases."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang")
            for lang in langs.unique().to_pylist():
                phrases = batch.column("phrase").filter(pc.equal(langs, lang))
                words = pc.split_pattern(phrases, " ").flatten()
                of_word = _word_hashes(lang, words).reshape(-1, length)
                hashes = of_word[:, 0]
                for k in range(1, length):
                    hashes = _longer_hash(hashes, of_word[:, k])
                at = np.sort(hashes >> np.uint64(64 - FILTER_BITS))
                first = np.flatnonzero(np.concatenate([[True], at[1:] >> np.uint64(6) != at[:-1] >> np.uint64(6)]))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.RecordBatch.from_arrays([pa.array((at[first] >> np.uint64(6)).astype(np.int32)), pa.array(bits.view(np.int64))], names=["at", "bits"])
    return run


def _bitmap(frequent: DataFrame, length: int) -> bytes:
    """The marks of the frequent phrases; 2^FILTER_BITS bits (16 MB), whatever the number of phrases."""
    rows = frequent.select("lang", "phrase").mapInArrow(_places(length), "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out.tobytes()


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of every phrase of up to ``longest`` words found ``min_count`` times or more, and (lang, n)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    with arrow_batches(spark):
        blocks = materialize(texts.mapInArrow(_word_blocks, _BLOCKS_SPARK), "word-blocks")
        found = blocks.where("phrase is not null").select("lang", "phrase", "n")
        sizes = materialize(found.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
        levels = []
        for length in range(1, longest + 1):
            if length > 1:
                found = (blocks.where("phrase is null").select("lang", "words", "word_ids")
                         .mapInArrow(_grow(length, _bitmap(levels[-1], length - 1)), _COUNTS_SPARK))
            sums = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
            levels.append(materialize(sums.select("lang", "phrase", F.lit(length).alias("length"), "f"), "phrase-counts"))
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out, sizes


def _part(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def score_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, length, a, l, r, score) of every phrase of two words or more: its lowest-scoring cut."""
    words = F.split("phrase", " ", -1)
    long = F.col("length") > 1
    cuts = (counts.where(long).select("lang", "phrase", "length", F.col("f").alias("a"), words.alias("w"))
            .select("*", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
            .select("lang", "phrase", "length", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("first"),
                    _part(F.col("w"), F.col("k") + 1, F.col("length") - F.col("k")).alias("rest")))
    f = counts.select("lang", "phrase", "f")
    first = f.select(F.col("lang"), F.col("phrase").alias("first"), F.col("f").alias("l"))
    rest = f.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("f").alias("r"))
    exact = "cast({} as decimal(20,0))"
    score = F.expr(f"cast({SCALE} as decimal(8,0)) * {exact.format('a')} div ({exact.format('l')} + {exact.format('r')})")
    scored = (cuts.join(first, ["lang", "first"]).join(rest, ["lang", "rest"])
              .select("lang", "phrase", "length", "a", F.struct(score.cast("long").alias("score"), "k", "l", "r").alias("cut")))
    best = scored.groupBy("lang", "phrase", "length", "a").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "length", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))


def absorbed(counts: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """(lang, phrase) of candidates that a longer candidate with enough of their count holds."""
    words = F.split("phrase", " ", -1)
    longer = counts.where("length > 2").select("lang", "length", F.col("f").alias("longer_f"), words.alias("w"))
    inner = (longer.select("*", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("m"))
             .select("*", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("m") + 1)).alias("s"))
             .select("lang", _part(F.col("w"), F.col("s"), F.col("m")).alias("phrase"), "longer_f"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer_f").alias("longer_f"))
    big = "decimal(30,0)"
    return (counts.where("length > 1").join(most, ["lang", "phrase"])
            .where(F.col("longer_f").cast(big) * 100 >= F.col("f").cast(big) * percent).select("lang", "phrase"))


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score."""
    counts, sizes = phrase_counts(docs, min_count, longest)
    kept = score_phrases(counts).join(absorbed(counts), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # first within hashed parts of a language, so that no task orders a whole one
    salt = F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))
    some = (kept.withColumn("salt", salt).withColumn("at", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
            .where(F.col("at") <= top).drop("salt", "at"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return (ranked.join(sizes, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
