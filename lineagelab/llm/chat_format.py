"""Chat formatting by incremental rendering of a black-box template.

A template is anything with ``render(turns) -> str`` for a list of (role, text), and
``escape(text) -> str``. Nothing else of it is known: the turns of a conversation are
rendered as successive prefixes, and consecutive outputs are compared. What the longer
output adds is the span of its last turn; rendering that turn once more with an empty
text shows where the (escaped) text lies in it. If the longer output changes what the
shorter one already said, the template rewrites history: the turn gets ``rewrites`` and no loss
span, and no earlier span of its conversation can be trusted (``rewritten`` lists these). A
constant closing tail that every output ends with is not history (it moves along and belongs
to the last turn).

``reach`` of a template (1 or more) says how many turns before the last one an added span can
depend on (besides being the first). Prefixes are then rendered over those turns only,
which is linear in the conversation; ``None`` renders whole prefixes (quadratic), for
templates that nothing is known about. With a reach a change beyond it is not seen.

One row per turn leaves the operator: its span in the conversation's output in code
points, the output text of the span, and the loss span (the texts of ``LEARNED`` roles).

Turns are ordered by (turn, role, text) in one sort by conversation; a task reads them
as a stream and holds the last turns of one conversation, not the conversation (a template
without reach needs it). A conversation's output is one text, so its turns meet in one task.

Edge cases: a null text is empty, a null role is ''; equal (conv_id, turn) rows are separate
turns; a null conv_id is a conversation of its own (all such rows); an empty table gives
no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEARNED = ("assistant",)
_ROWS = 2048
_MARKS = r"/?(?:s>|INST\]|ROLE\])"


class Template(Protocol):
    reach: int | None

    def render(self, turns: list[tuple[str, str]]) -> str: ...

    def escape(self, text: str) -> str: ...


class InstTemplate:
    """``<s>[INST] user [/INST] assistant </s>``; other roles are named: ``[ROLE] system [/ROLE] text </s>``.

    A control string inside a text gets a backslash after its first character, and one
    more for each that already stands there, so escaping is reversible for every text.
    """

    reach = 1
    _plain = re.compile(r"([<\[])(\\*)(?=" + _MARKS + ")")
    _escaped = re.compile(r"([<\[])\\(\\*)(?=" + _MARKS + ")")
    _turn = re.compile(r"(?:<s>)?(?:\[INST\] (?P<user>.*) \[/INST\]|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*) </s>| (?P<assistant>.*) </s>)", re.S)

    def escape(self, text: str) -> str:
        return self._plain.sub(r"\1\\\2", text) if "[" in text or "<" in text else text

    def unescape(self, text: str) -> str:
        return self._escaped.sub(r"\1\2", text) if "\\" in text else text

    def render(self, turns: list[tuple[str, str]]) -> str:
        out = ["<s>"] if turns else []
        for role, text in turns:
            body = self.escape(text)
            if role == "user":
                out.append(f"[INST] {body} [/INST]")
            elif role == "assistant":
                out.append(f" {body} </s>")
            else:
                out.append(f"[ROLE] {self.escape(role)} [/ROLE] {body} </s>")
        return "".join(out)

    def read_turn(self, piece: str) -> tuple[str, str]:
        """(role, text) of the output of one turn."""
        m = self._turn.fullmatch(piece)
        if m is None:
            raise ValueError("not the output of a turn")
        if m["user"] is not None:
            return "user", self.unescape(m["user"])
        if m["assistant"] is not None:
            return "assistant", self.unescape(m["assistant"])
        return self.unescape(m["role"]), self.unescape(m["other"])


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:                                               # a[:lo] agrees, a[:hi] does not
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def added(before: str, after: str) -> tuple[int, int, bool]:
    """(start, end) in ``after`` of what it adds to ``before``, and whether it changes what stood there.

    A tail of ``before`` that ``after`` ends with again is taken as moved along.
    """
    same = _common(before, after)
    moved = len(before) - same
    if moved and not (len(after) >= len(before) and after.endswith(before[same:])):
        return same, len(after), True
    return same, len(after) - moved, False


def text_span(template: Template, context: list, role: str, text: str, before: str, after: str, span: tuple[int, int]) -> tuple[int, int] | None:
    """Where the escaped ``text`` lies in ``after``, from a rendering of the same turn without text."""
    bare = template.render([*context, (role, "")])
    body = template.escape(text)
    if len(bare) + len(body) != len(after):
        return None                                              # the template trims or drops text
    at = after.find(body, max(span[0], 0))
    while at >= 0 and at + len(body) <= span[1]:
        if after[:at] + after[at + len(body):] == bare:
            return at, at + len(body)
        at = after.find(body, at + 1)
    return None


def render_turns(template: Template, turns: Iterator[tuple[str, str]], learned: tuple = LEARNED) -> Iterator[tuple]:
    """(role, start, end, piece, loss_start, loss_end, rewrites) of each turn of one conversation, as it comes."""
    context: list[tuple[str, str]] = []
    before, end = "", 0                                           # a header before the first turn belongs to it
    for role, text in turns:
        after = template.render([*context, (role, text)])
        lo, hi, rewrites = added(before, after)
        base = end - (len(before) - lo)                          # a moved tail or changed history begins before the end
        loss = None
        if role in learned and not rewrites:
            loss = text_span(template, context, role, text, before, after, (lo, hi))
        piece = after[lo:]
        yield (role, base, base + len(piece), piece,
               None if loss is None else base + loss[0] - lo, None if loss is None else base + loss[1] - lo, rewrites)
        end = base + len(piece)
        context.append((role, text))
        before = after
        if template.reach is not None and len(context) > template.reach:
            context = context[-template.reach:]
            before = template.render(context)


_TURNS = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                    ("piece", pa.large_string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("rewrites", pa.bool_())])
_TURNS_SPARK = "conv_id long, pos long, role string, start long, end long, piece string, loss_start long, loss_end long, rewrites boolean"


def _rows(batches: Iterator[pa.RecordBatch], names: tuple) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _groups(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(key, rows of it) of a stream ordered by its first entry; the rows are read as they come."""
    rows = iter(rows)
    row = next(rows, None)
    while row is not None:
        key = row[0]

        def own() -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[0] == key:
                yield row
                row = next(rows, None)

        mine = own()
        yield key, mine
        for _ in mine:
            pass


def _batches(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= _ROWS or size >= limit:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def format_turns(conversations: DataFrame, template: Template | None = None, learned: tuple = LEARNED) -> DataFrame:
    """One row per turn, in order within its conversation and task.

    conv_id, pos (0-based), role, start, end (of the span in the conversation's output, code
    points), piece (the output from start to end), loss_start, loss_end (null: not learned from), rewrites.
    With a moving tail a piece ends with the tail, and the next turn starts before it.
    """
    how = template or InstTemplate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def turns() -> Iterator[tuple]:
            for conv, own in _groups(_rows(batches, ("conv_id", "role", "text"))):
                for pos, out in enumerate(render_turns(how, (r[1:] for r in own), learned)):
                    yield conv, pos, *out
        yield from _batches(turns(), _TURNS)

    empty = F.lit("")
    ordered = (conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn",
                                    F.coalesce(F.col("role").cast("string"), empty).alias("role"),
                                    F.coalesce(F.col("text").cast("string"), empty).alias("text"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
               .select("conv_id", "role", "text"))
    return ordered.mapInArrow(run, _TURNS_SPARK)


def rewritten(turns: DataFrame) -> DataFrame:
    """(conv_id, pos) of the first turn at which the template changed what it had said, for conversations that have one."""
    return turns.where("rewrites").groupBy("conv_id").agg(F.min("pos").alias("pos"))


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                      ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])
_DIGESTS_SPARK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"


def digest_conversations(turns: DataFrame, template: InstTemplate | None = None) -> DataFrame:
    """What the output says, read back from it: one row per conversation of ``format_turns``.

    Roles and texts are parsed from the pieces, the loss from the loss spans in them. A
    narrow pass over the same tasks: ``format_turns`` keeps each conversation together and in order.
    """
    how = template or InstTemplate()

    def one(conv, rows) -> tuple:
        said, loss = hashlib.sha256(), hashlib.sha256()
        n = chars = end = 0
        rewrites = False
        for _, start, stop, piece, lo, hi, bad in rows:
            role, text = how.read_turn(piece)
            said.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if lo is not None:
                learned = how.unescape(piece[lo - start:hi - start])
                loss.update(learned.encode("utf-8", "surrogatepass"))
                chars += len(learned)
            n, end, rewrites = n + 1, stop, rewrites or bad
        return conv, n, said.hexdigest(), chars, loss.hexdigest(), end, rewrites

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _rows(batches, ("conv_id", "start", "end", "piece", "loss_start", "loss_end", "rewrites"))
        yield from _batches((one(conv, own) for conv, own in _groups(rows)), _DIGESTS)

    return turns.mapInArrow(run, _DIGESTS_SPARK)
