"""Token counts per section by offset-mapped attribution.

Every text is encoded whole, once. The byte lengths of its tokens give their byte
spans, a running count of characters turns them into character spans, and the spans
are joined with the sections' intervals (both ascending: a binary search). A token that
crosses a section's end is allocated by an explicit rule:

``first``: to the section of its first character (default);
``last``: to the section of its last character;
``most``: to the section that holds most of its characters (ties: the earlier);
``share``: to each section in proportion to its characters.

The counts of all sections add up to the tokens of the whole text under every rule.

Sections are the lines of the text (each with its line break), or begin at the
character positions of an array column. The vocabulary is a byte-level BPE rank
file; its path is a parameter, and its content is broadcast (below 2 MB).

Edge cases: a null or empty text is one section without tokens; text that looks like a
special token is ordinary text; positions outside the text or out of order are
clipped and sorted, and the first section begins at 0; repeated rows are counted one
by one.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textscan
from .common import bound_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Cut of a text into pre-tokens; part of the public vocabulary's definition (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RULES = ("first", "last", "most", "share")

SECTIONS = T.StructType([
    T.StructField("section", T.IntegerType()), T.StructField("start_char", T.LongType()),
    T.StructField("end_char", T.LongType()), T.StructField("n_tokens", T.DoubleType()),
    T.StructField("n_crossing", T.LongType()), T.StructField("doc_tokens", T.LongType()),
])

_ENCODERS: dict = {}


def _encoder(ranks: bytes, pattern: str):
    """The encoder and its tokens' byte lengths, built once per worker."""
    key = (hash(ranks), pattern)
    if key not in _ENCODERS:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        lengths = np.zeros(max(table.values()) + 1, dtype=np.int64)
        for token, rank in table.items():
            lengths[rank] = len(token)
        _ENCODERS[key] = (tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), lengths)
    return _ENCODERS[key]


def spans(tokens: np.ndarray, lengths: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans [first, end) of tokens; ``chars[i]`` counts the characters that begin before byte i."""
    ends = np.cumsum(lengths[tokens])
    begins = ends - lengths[tokens]
    # a token that begins inside a character belongs to that character
    return chars[begins + 1] - 1, chars[ends]


def attribute(first: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section (starts ascending, from 0) and how many cross each section's end."""
    n = len(starts)
    a = np.searchsorted(starts, first, side="right") - 1
    b = np.searchsorted(starts, end - 1, side="right") - 1
    cross = b > a
    out = np.zeros(n)
    if rule == "first":
        out += np.bincount(a, minlength=n)
    elif rule == "last":
        out += np.bincount(b, minlength=n)
    else:
        out += np.bincount(a[~cross], minlength=n)
        limits = np.append(starts, np.iinfo(np.int64).max)
        for t in np.flatnonzero(cross):                          # few: tokens over a section's end
            own = np.arange(a[t], b[t] + 1)
            part = np.minimum(limits[own + 1], end[t]) - np.maximum(limits[own], first[t])
            if rule == "most":
                out[own[np.argmax(part)]] += 1
            else:
                out[own] += part / part.sum()
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, a[cross], 1)
    np.add.at(step, b[cross], -1)
    return out, np.cumsum(step)[:n]


def _task(shared, pattern: str, rule: str, has_breaks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(shared.value, pattern)
        for batch in batches:
            texts = textscan.strings(batch.column(1))
            breaks = batch.column(2).to_pylist() if has_breaks else None
            rows, columns = [], [[] for _ in SECTIONS.names]
            row = 0
            for lo, hi in textscan.slices(texts):
                buf, offsets = textscan.raw_bytes(texts, lo, hi)
                for i, text in enumerate(texts.slice(lo, hi - lo).to_pylist()):
                    own = buf[offsets[i]:offsets[i + 1]]
                    chars = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    n_chars = int(chars[-1])
                    if has_breaks:
                        at = np.unique(np.clip(np.array([x for x in breaks[row] or [] if x is not None], dtype=np.int64), 0, max(n_chars - 1, 0)))
                    else:
                        at = chars[np.flatnonzero(own == 10) + 1]
                        at = at[at < n_chars]
                    starts = np.unique(np.concatenate([[0], at])).astype(np.int64)
                    tokens = np.asarray(encoder.encode_ordinary(text), dtype=np.int64)
                    counts, crossing = attribute(*spans(tokens, lengths, chars), starts, rule) if len(tokens) \
                        else (np.zeros(len(starts)), np.zeros(len(starts), dtype=np.int64))
                    rows.append(np.full(len(starts), row))
                    for c, v in zip(columns, (np.arange(len(starts)), starts, np.append(starts[1:], n_chars), counts, crossing,
                                              np.full(len(starts), len(tokens)))):
                        c.append(v)
                    row += 1
            if rows:
                ids = batch.column(0).take(pa.array(np.concatenate(rows)))
                data = [pa.array(np.concatenate(c)).cast(t) for c, t in zip(
                    columns, (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, *data], names=["doc_id", *SECTIONS.names])
    return run


def count_sections(docs: DataFrame, rule: str = "first", breaks: str | None = None,
                   vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per section: doc_id, section, start_char, end_char, n_tokens, n_crossing, doc_tokens.

    ``breaks`` names an array column with the sections' first characters.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    columns = ["doc_id", "text", *([F.col(breaks).cast("array<long>")] if breaks else [])]
    schema = T.StructType([docs.schema["doc_id"], *SECTIONS.fields])
    return bound_batches(docs.select(*columns)).mapInArrow(_task(shared, pattern, rule, breaks is not None), schema)
