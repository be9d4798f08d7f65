"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts are one class from the start (grouped by digest, pre-aggregated).
2. Document frequencies of five-word shingles over all documents, in ``DF_BUCKETS``
   hashed buckets (a vector of fixed size, as in feature hashing).
3. Every text becomes ``BANDS`` x ``ROWS`` improved consistent weighted samples of
   its TF-IDF weighted shingles; each band of samples is one candidate key.
4. Round one compares every member of a band bucket with one leader of it (a
   different pseudo-random leader in each band), so large groups of near copies cost
   one comparison per member and band, not one per pair.
5. Verified links (weighted Jaccard >= ``SIMILARITY``) are merged to classes.
6. Round two settles what round one left open: documents in buckets that still hold
   several classes. Among those, an exact weighted prefix join finds all pairs that can
   be similar: shingles are ordered by rarity, and a pair at 0.8 must share one of the
   rarest shingles that make up a fifth of each one's weight. A near copy with more
   than a fifth of changed weight thus meets nobody, however large its family. Pairs of
   one class are left out, and pairs that a bound shows to be less similar: the weights of
   both texts from their first common shingle on, and the sum of the smaller weights over
   ``SPREAD`` hashed parts of both texts, are at least the common weight. Every other pair
   is made once, verified, and the classes merged again. No similar pair of this round is lost.

IDF is 1 + IDF_SHARE * ln(min(N / df, 1000)) / ln(1000): from 1 for a shingle in every
document to 1.5 for one in a thousandth of them or fewer. The clip makes it alike
at every corpus size, and lies above the collision noise of the hashed buckets.

Edge cases: a null or empty text is a class of its own per row; a text without words
is only equal to the same text; a text of fewer than five words is one shingle;
repeated rows and equal doc_ids are members of one class if their texts are; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textscan
from .common import bound_batches, materialize, small_side, with_row_id
from .components import merge_classes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
SPREAD = 64
DF_BUCKETS = 1 << 20
# Earlier shingles of the prefix that a row of the prefix join carries.
PAST = 32
IDF_SHARE, IDF_CLIP = 0.5, 1000.0
LEVELS = 16
# Number of fixed random draws (r, c, beta) that the hash of (shingle, sample) selects from.
DRAWS = 1 << 14
_SLICE = 64                                                      # parts of the frequency vector
_PAIRS = 128                                                     # pairs verified at once, to bound memory


def _shingles(words: textscan.Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document of a slice: (document, hash, how often), sorted."""
    h, inside = words.grams(n)
    doc = words.doc_of_word()
    doc, h = doc[inside], h[inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < n))
    if len(short):
        whole = [textscan.gram_hash(words.hashes[words.first[d]:words.first[d + 1]]) for d in short]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(whole, dtype=np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    if not len(h):
        return doc, h, np.zeros(0, dtype=np.int64)
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(44)).astype(np.int64)                 # 20 bits: DF_BUCKETS


def _together(arrays: Iterator[np.ndarray], least: int) -> Iterator[np.ndarray]:
    """The arrays joined until at least ``least`` entries are together."""
    have, n = [], 0
    for a in arrays:
        have.append(a)
        n += len(a)
        if n >= least:
            yield np.concatenate(have)
            have, n = [], 0
    if have:
        yield np.concatenate(have)


def _frequency_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(DF_BUCKETS, dtype=np.int32)
    for batch in batches:
        for some in _together((_bucket(_shingles(words)[1]) for _, _, words in textscan.scan(batch.column(0))), DF_BUCKETS):
            counts += np.bincount(some, minlength=DF_BUCKETS).astype(np.int32)
    parts = counts.reshape(_SLICE, -1)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(_SLICE, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())],
        names=["part", "counts"])


def _sum_parts(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds one part of the tasks' frequency vectors, a batch at a time."""
    total = np.zeros(DF_BUCKETS // _SLICE, dtype=np.int64)
    for batch in batches:
        for x in batch.column("counts"):
            total += np.frombuffer(x.as_buffer(), dtype=np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                     names=["part", "counts"])


def idf_levels(docs: DataFrame) -> np.ndarray:
    """IDF of every bucket as one of LEVELS steps (0: in every document); one byte each, 1 MB in all."""
    n_docs = max(1, docs.count())
    parts = docs.select("text").mapInArrow(_frequency_task, "part int, counts binary")
    rows = parts.groupBy("part").applyInArrow(_sum_parts, "part int, counts binary").collect()   # 64 rows, 8 MB
    df = np.zeros(DF_BUCKETS, dtype=np.int64)
    for r in rows:
        own = np.frombuffer(r.counts, dtype=np.int64)
        df[r.part * len(own):(r.part + 1) * len(own)] = own
    share = np.log(np.minimum(n_docs / np.maximum(df, 1), IDF_CLIP)) / np.log(IDF_CLIP)
    return np.round(np.clip(share, 0, 1) * (LEVELS - 1)).astype(np.uint8)


def weights(tf: np.ndarray, level: np.ndarray) -> np.ndarray:
    return tf * (1.0 + IDF_SHARE * level.astype(np.float64) / (LEVELS - 1))


class Sampler:
    """Improved consistent weighted sampling with draws taken from fixed tables."""

    def __init__(self, k: int = BANDS * ROWS):
        rng = np.random.default_rng(17)
        self.k = k
        self.r = rng.gamma(2.0, 1.0, DRAWS)
        self.log_c = np.log(rng.gamma(2.0, 1.0, DRAWS))
        self.beta = rng.random(DRAWS)
        self.multiplier = rng.integers(1, 2**63, k, dtype=np.uint64) | np.uint64(1)
        self.plain = {}

    def _log_a(self, draw: np.ndarray, log_w: np.ndarray) -> np.ndarray:
        r, beta = self.r[draw], self.beta[draw]
        y = r * (np.floor(log_w / r + beta) - beta)
        return self.log_c[draw] - y - r

    @staticmethod
    def _ordered(log_a: np.ndarray) -> np.ndarray:
        """Float32 values as unsigned integers of the same order, in the upper 32 bits."""
        bits = log_a.astype(np.float32).view(np.uint32)
        flip = np.where(bits >> 31, np.uint32(0xFFFFFFFF), np.uint32(0x80000000))
        return (bits ^ flip).astype(np.uint64) << np.uint64(32)

    def _table(self, level: int) -> np.ndarray:
        if level not in self.plain:
            log_w = np.full(DRAWS, np.log(1.0 + IDF_SHARE * level / (LEVELS - 1)))
            self.plain[level] = self._ordered(self._log_a(np.arange(DRAWS), log_w))
        return self.plain[level]

    def sketch(self, doc: np.ndarray, h: np.ndarray, tf: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that have shingles, samples [document, k]); a sample identifies shingle and step."""
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, np.int64)
        out = np.zeros((len(begin), self.k), dtype=np.uint64)
        if not len(begin):
            return doc[begin], out
        tables = np.concatenate([self._table(i) for i in range(LEVELS)])
        base = level.astype(np.int64) * DRAWS
        repeated = np.flatnonzero(tf > 1)
        log_w = np.log(weights(tf[repeated], level[repeated]))
        for i in range(self.k):
            x = h * self.multiplier[i]
            draw = (x >> np.uint64(50)).astype(np.int64)         # 14 bits: DRAWS
            value = tables[base + draw]
            if len(repeated):
                value[repeated] = self._ordered(self._log_a(draw[repeated], log_w))
            value |= (x >> np.uint64(18)) & np.uint64(0xFFFFFFFF)
            out[:, i] = np.minimum.reduceat(value, begin)
        return doc[begin], out


def _sketch_task(shared):
    """(rid, text) -> (rid, total weight, band keys, weight of each of SPREAD hashed parts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, sampler = shared.value, Sampler()
        for batch in batches:
            total = np.zeros(batch.num_rows)
            bands = np.zeros((batch.num_rows, BANDS), dtype=np.uint64)
            spread = np.zeros((batch.num_rows, SPREAD))
            some = np.zeros(batch.num_rows, dtype=bool)
            for lo, _, words in textscan.scan(batch.column(1)):
                doc, h, tf = _shingles(words)
                level = levels[_bucket(h)]
                rows, s = sampler.sketch(doc, h, tf, level)
                rows = rows + lo
                some[rows] = True
                w, n = weights(tf, level), len(words.counts)
                total[lo:lo + n] = np.bincount(doc, weights=w, minlength=n)
                part = (h >> np.uint64(20)).astype(np.int64) % SPREAD
                spread[lo:lo + n] = np.bincount(doc * SPREAD + part, weights=w, minlength=n * SPREAD).reshape(n, SPREAD)
                s = textscan.mix(s)
                for b in range(BANDS):
                    key = np.full(len(rows), np.uint64(b + 1))
                    for j in range(ROWS):
                        key = textscan.mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, b * ROWS + j])
                    bands[rows, b] = key
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total), _lists(bands.view(np.int64)), _lists(spread.astype(np.float32))],
                                             names=["rid", "total", "bands", "spread"]).filter(pa.array(some))
    return run


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel()))


def _verify_task(shared, similarity: float):
    """(a, b, text_a, text_b) -> the pairs whose weighted Jaccard similarity reaches the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in (b.slice(lo, _PAIRS) for b in batches for lo in range(0, b.num_rows, _PAIRS)):
            texts = {}                                           # each text of the batch is cut once
            for ids, column in ((0, 2), (1, 3)):
                for i, t in zip(batch.column(ids).to_pylist(), range(batch.num_rows)):
                    texts.setdefault(i, (column, t))
            place, sets = {}, {}
            rows = {2: [], 3: []}
            for i, (column, t) in texts.items():
                place[i] = (column, len(rows[column]))
                rows[column].append(t)
            for column, take in rows.items():
                own = batch.column(column).take(pa.array(take, pa.int64()))
                for lo, hi, words in textscan.scan(own):
                    doc, h, tf = _shingles(words)
                    w = weights(tf, levels[_bucket(h)])
                    cut = np.searchsorted(doc, np.arange(hi - lo + 1))
                    for d in range(hi - lo):
                        sets[column, lo + d] = (h[cut[d]:cut[d + 1]], w[cut[d]:cut[d + 1]])
            keep = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (ha, wa), (hb, wb) = sets[place[a]], sets[place[b]]
                _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
                common = np.minimum(wa[ia], wb[ib]).sum()
                keep.append(bool(common >= similarity * (wa.sum() + wb.sum() - common) - 1e-9 and common > 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _verified(pairs: DataFrame, texts: DataFrame, shared, similarity: float, label: str) -> DataFrame:
    """Pairs (a, b) of representatives whose texts are similar enough, written.

    Texts are never broadcast: their compressed files, which Spark would judge by, say little about their size.
    """
    both = (pairs.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
            .join(texts.select(F.col("rid").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
            .select("a", "b", "text_a", "text_b"))
    return materialize(both.mapInArrow(_verify_task(shared, similarity), "a long, b long"), label)


def _weight_task(shared):
    """(rid, text) -> (rid, shingle, weight, total weight of the text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for lo, hi, words in textscan.scan(batch.column(1)):
                doc, h, tf = _shingles(words)
                w = weights(tf, levels[_bucket(h)])
                total = np.bincount(doc, weights=w, minlength=hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo + doc]), pa.array(h.view(np.int64)), pa.array(w), pa.array(total[doc])],
                    names=["rid", "h", "w", "total"])
    return run


def _common_most(a: str, b: str) -> Column:
    """Upper bound of the common weight: the smaller weight of each hashed part, summed."""
    return sum((F.least(F.col(a)[i], F.col(b)[i]).cast("double") for i in range(1, SPREAD)),
               F.least(F.col(a)[0], F.col(b)[0]).cast("double"))


def _prefix_rows(prefix: DataFrame) -> DataFrame:
    """A row for each shingle ``h`` of the prefixes ``p``: the weight of its text from there on (``rest``) and the
    last ``PAST`` shingles before it (``past``), not all of them: rows would grow with the square of a text's length."""
    rows = prefix.select("rid", "total", "spread", "label", "p", "before", F.posexplode("p").alias("at", "h"))
    past = F.slice("p", F.greatest(F.col("at") - F.lit(PAST - 1), F.lit(1)), F.least(F.col("at"), F.lit(PAST)))
    return rows.select("rid", "total", "spread", "label", "h", (F.col("total") - F.col("before")[F.col("at")]).alias("rest"), past.alias("past"))


def _prefix_pairs(texts: DataFrame, sketches: DataFrame, labels: DataFrame, shared, similarity: float) -> DataFrame:
    """Pairs (a, b) of different classes that the prefixes and the bounds leave: no similar pair is missing.

    The common weight of a similar pair is at least ``need`` of the sum of both totals. So the
    lighter text has its first common shingle before (1 - s) / (1 + s) of its weight, the
    heavier one before 1 - s.
    """
    need = similarity / (1 + similarity) - 1e-6
    shingles = texts.mapInArrow(_weight_task(shared), "rid long, h long, w double, total double")
    shingles = materialize(shingles, "near-shingles")
    common = shingles.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a shingle of one text only comes first in the order and meets nobody
    own = shingles.join(common, "h", "left").withColumn("df", F.coalesce("df", F.lit(1)))
    ranked = Window.partitionBy("rid").orderBy("df", "h").rowsBetween(Window.unboundedPreceding, -1)
    cut = (own.withColumn("before", F.coalesce(F.sum("w").over(ranked), F.lit(0.0)))
           .where((F.col("df") > 1) & (F.col("before") <= F.lit(1 - similarity + 1e-9) * F.col("total"))))
    prefix = (cut.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("df", "h", "before"))).alias("p"))    # a fifth of one text
              .select("rid", F.col("p.h").alias("p"), F.col("p.before").alias("before"))
              .join(sketches.select("rid", "total", "spread"), "rid")
              .join(labels.withColumnRenamed("node", "rid"), "rid", "left").withColumn("label", F.coalesce("label", "rid")))
    prefix = _prefix_rows(materialize(prefix, "near-prefix"))
    x, y = prefix.where(F.col("rest") >= F.lit(2 * need) * F.col("total")).alias("x"), prefix.alias("y")
    lighter = (F.col("x.total") < F.col("y.total")) | ((F.col("x.total") == F.col("y.total")) & (F.col("x.rid") < F.col("y.rid")))
    least = F.lit(need) * (F.col("x.total") + F.col("y.total"))
    # made at the first shingle that both prefixes have; again only if the last common one lies more than PAST back, hence distinct
    first = ~F.arrays_overlap("x.past", "y.past")
    # Spark judges a side by the file before its rows are exploded, and would broadcast rows of a hundred times that size
    return (x.join(y.hint("merge"), (F.col("x.h") == F.col("y.h")) & lighter & (F.col("x.label") != F.col("y.label"))
                   & (F.least("x.rest", "y.rest") >= least) & (_common_most("x.spread", "y.spread") >= least) & first)
            .select(F.least("x.rid", "y.rid").alias("a"), F.greatest("x.rid", "y.rid").alias("b")).distinct())


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: rid, class_rid (smallest rid of the class), copy_rid (of equal texts).

    ``docs`` needs the columns ``rid`` (see ``with_row_id``) and ``text``.
    """
    sc = docs.sparkSession.sparkContext
    docs = bound_batches(docs.select("rid", "text"))
    shared = sc.broadcast(idf_levels(docs))
    digest = F.when((F.col("text") == "") | F.col("text").isNull(), F.concat(F.lit("row "), F.col("rid").cast("string"))) \
        .otherwise(F.sha2("text", 256))
    members = materialize(docs.select("rid", digest.alias("digest")), "near-members")
    reps = members.groupBy("digest").agg(F.min("rid").alias("copy_rid"))
    sketches = docs.mapInArrow(_sketch_task(shared), "rid long, total double, bands array<long>, spread array<float>")
    # one sketch per distinct text
    sketches = materialize(sketches.join(reps.select(F.col("copy_rid").alias("rid")), "rid", "left_semi"), "near-sketches")
    banded = sketches.select("rid", "total", F.posexplode("bands").alias("band", "key"))
    order = F.xxhash64("rid", "band")
    leaders = (banded.groupBy("band", "key")
               .agg(F.min(F.struct(order.alias("o"), "rid", "total")).alias("m"), F.count(F.lit(1)).alias("n"))
               .where("n > 1").select("band", "key", F.col("m.rid").alias("leader"), F.col("m.total").alias("leader_total")))
    low, high = F.least("total", "leader_total"), F.greatest("total", "leader_total")
    shared_band = (banded.join(leaders, ["band", "key"])
                   .where((F.col("rid") != F.col("leader")) & (low >= F.lit(similarity - 1e-6) * high)))
    stars = shared_band.select(F.least("rid", "leader").alias("a"), F.greatest("rid", "leader").alias("b")).distinct()
    stars = materialize(stars, "near-stars")
    texts = _texts_of(docs, stars.select(F.explode(F.array("a", "b")).alias("rid")).distinct())
    links = _verified(stars, texts, shared, similarity, "near-links")
    labels = merge_classes(links)
    # what the stars left open: pairs of a bucket that are not of one class yet
    labelled = (banded.join(labels, banded["rid"] == labels["node"], "left")
                .select("band", "key", "rid", "total", F.coalesce("label", "rid").alias("label")))
    mixed = (labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .where("lo < hi").select("band", "key"))
    open_rows = labelled.join(mixed, ["band", "key"], "left_semi").select("rid").distinct()
    open_texts = _texts_of(docs, open_rows)
    pairs = materialize(_prefix_pairs(open_texts, sketches, labels, shared, similarity).join(stars, ["a", "b"], "left_anti"), "near-pairs")
    more = _verified(pairs, open_texts, shared, similarity, "near-more")
    labels = merge_classes(links.unionByName(more))
    copies = members.join(reps, "digest").select("rid", "copy_rid")
    return (copies.join(labels.withColumnRenamed("node", "copy_rid"), "copy_rid", "left")
            .select("rid", F.coalesce("label", "copy_rid").alias("class_rid"), "copy_rid"))


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the row ids in ``wanted``, written once."""
    return materialize(docs.join(small_side(materialize(wanted, "near-wanted"), 16), "rid", "left_semi"), "near-texts")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Digest per document: doc_id, class_id (smallest doc_id of the class), class_size, kept."""
    rows = with_row_id(docs.select("doc_id", "text"), "rid")
    found = classes(rows, similarity).join(rows.select("rid", "doc_id"), "rid")
    found = materialize(found, "near-classes")
    heads = found.groupBy("class_rid").agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first"))
    return (found.join(heads, "class_rid")
            .select("doc_id", "class_id", "class_size", (F.col("rid") == F.col("first.rid")).alias("kept")))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document per class, the first by doc_id; columns unchanged."""
    rows = with_row_id(docs.select(F.struct("*").alias("row")), "rid")
    plain = rows.select("rid", F.col("row.text").alias("text"), F.col("row.doc_id").alias("doc_id"))
    found = classes(plain, similarity).join(plain.select("rid", "doc_id"), "rid")
    first = found.groupBy("class_rid").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("f"))
    keepers = materialize(first.select(F.col("f.rid").alias("rid")), "near-kept")
    return rows.join(small_side(keepers, 16), "rid", "left_semi").select("row.*")
