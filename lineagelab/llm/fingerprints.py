"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph (non-empty line) is hashed to a vector of ``LANES`` small signed numbers;
a document's fingerprint is the sum of its paragraphs' vectors modulo 2**``MODULUS_BITS``.
The order of paragraphs does not matter, and inserting or deleting one adds or
subtracts its vector (``inserted``, ``deleted``) without the rest of the text. Because the
lanes are small, the difference of two fingerprints estimates how many paragraphs
they do not share: ``likeness`` is 1 - |a - b|^2 / (|a|^2 + |b|^2), at least 0, which
expects 2 sum(m_a m_b) / (sum m_a^2 + sum m_b^2) over the paragraph multiplicities.

All of it is done row by row with higher-order functions; only the texts' beginnings
(a quarter) and the finished vectors are exchanged.

Edge cases: null is the empty text; a text without paragraphs has the zero vector, and two
of those are alike (1); a single document is its own next; documents follow one
another by doc_id (null first), equal ones in the order of the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import global_rank, materialize, small_side, with_row_id

LANES = 64
MODULUS_BITS = 24
_MOD = 1 << MODULUS_BITS


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def _words(paragraph: Column) -> Column:
    """Sixteen 32-bit words of two SHA-256 digests of the paragraph."""
    digests = F.concat(*[F.sha2(F.concat(F.lit(f"{i}:"), paragraph), 256) for i in range(LANES // 32)])
    return F.transform(F.sequence(F.lit(0), F.lit(LANES // 4 - 1)),
                       lambda i: F.conv(F.substr(digests, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def vector(text: Column) -> Column:
    """The fingerprint of a text: array<int>, LANES numbers in [0, 2**MODULUS_BITS)."""
    hashed = F.transform(paragraphs(text), _words)
    return F.transform(F.array(hashed), lambda h: F.transform(
        F.sequence(F.lit(0), F.lit(LANES - 1)), lambda lane: F.pmod(F.aggregate(
            h, F.lit(0).cast("long"),
            lambda acc, w: acc + _byte(F.get(w, F.floor(lane / 4).cast("int")), lane)), F.lit(_MOD)).cast("int")))[0]


def _byte(word: Column, lane: Column) -> Column:
    """Byte ``lane % 4`` of a word, from -128 to 127."""
    shifted = F.call_function("shiftright", word, ((lane % 4) * 8).cast("int"))
    return shifted.bitwiseAND(F.lit(255).cast("long")) - 128


def inserted(fingerprint: Column, paragraph: Column) -> Column:
    """The fingerprint after one more paragraph."""
    return F.zip_with(fingerprint, vector(paragraph), lambda a, b: F.pmod(a + b, F.lit(_MOD)))


def deleted(fingerprint: Column, paragraph: Column) -> Column:
    return F.zip_with(fingerprint, vector(paragraph), lambda a, b: F.pmod(a - b, F.lit(_MOD)))


def as_text(fingerprint: Column) -> Column:
    """Fixed-width hexadecimal, lane by lane."""
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), MODULUS_BITS // 4, "0")), ""))


def _centred(x: Column) -> Column:
    wrapped = F.pmod(x, F.lit(_MOD)).cast("long")
    return F.when(wrapped >= _MOD // 2, wrapped - _MOD).otherwise(wrapped)


def _norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0).cast("long"), lambda acc, x: acc + _centred(x) * _centred(x))


def likeness(a: Column, b: Column) -> Column:
    apart = _norm(F.zip_with(a, b, lambda x, y: x - y))
    both = _norm(a) + _norm(b)
    return F.when(apart == 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - apart / F.greatest(both, F.lit(1).cast("long"))))


def fingerprint_rows(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness (see the module).

    Edited: the last quarter of the code points gives way to as many first ones of the
    next document.
    """
    rows = with_row_id(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "rid") \
        .withColumn("n_chars", F.length("text").cast("long"))
    order = global_rank(rows.select("rid", "doc_id", "n_chars"), [F.col("doc_id").asc_nulls_first(), F.col("rid")], "pos", "order")
    n = order.count()
    order = order.withColumn("before", F.pmod(F.col("pos") - 1, F.lit(max(n, 1))))
    # each document learns whom it follows, and how many code points that one asks for
    p, q = order.alias("p"), order.alias("q")
    follows = materialize(
        q.join(p, F.col("q.before") == F.col("p.pos")).select(
            F.col("q.rid").alias("rid"), F.col("p.rid").alias("target"), F.floor(F.col("p.n_chars") / 4).cast("int").alias("need")),
        "follows")
    known = small_side(follows, 32)
    heads = (rows.select("rid", "text").join(known, "rid")
             .select(F.col("target").alias("rid"), F.expr("substring(text, 1, need)").alias("head")))
    both = rows.join(heads, "rid")
    edited = F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 4)))"), F.col("head"))
    made = materialize(
        both.withColumn("edited", edited).select(
            "rid", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            vector(F.col("text")).alias("v"), vector(F.col("edited")).alias("e")), "fingerprints")
    following = made.select("rid", F.col("v").alias("next_v")).join(known, "rid").select(F.col("target").alias("rid"), "next_v")
    return made.join(following, "rid").select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"),
        as_text(F.col("e")).alias("edited_fingerprint"), likeness(F.col("v"), F.col("e")).alias("near_edited"),
        likeness(F.col("v"), F.col("next_v")).alias("near_next"))
