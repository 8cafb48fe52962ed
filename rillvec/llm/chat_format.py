"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to a string; nothing else is
known of it.  Turn by turn, the prefix of the conversation is rendered and
compared with the rendering before: what is new is the turn's span, and a
rendering that does not begin with the one before shows a template that
rewrites history.  Where the text lies inside the span is found by rendering
the same prefix with a probe text in its place: the common start of the two is
the turn's header.  Nothing is known of a template, so each prefix is rendered
whole: a conversation costs the square of its turns.

The default template marks turns by control strings and escapes control
strings inside texts with a backslash, which ``unescape`` takes back exactly.
``read_default`` reads roles, texts and borders back from the output alone;
turns, digests and the loss mask are those it reads, and where its borders are
not those of the successive renderings the output counts as rewritten.

Turns of a conversation are ordered by turn number (null first), then role and
text.  Edge cases: a null text or role is empty; rows with a null conv_id are
one conversation of a null id; repeated rows are turns of their own; texts of
any length are formatted whole; an empty table gives an empty result; extra
columns are ignored.  A conversation is one output string, so its turns meet
in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._native import pinned

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

# The control strings of the default template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
PROBES = ("\x01p", "\x02q")
#: Characters of output that a task gathers before it hands rows on.
FLUSH_CHARS = 1 << 22


def escape(text: str) -> str:
    """No control string is left in the result; ``unescape`` gives the text back."""
    text = text.replace("\\", "\\\\")
    for mark in CONTROL:
        text = text.replace(mark, f"{mark[0]}\\{mark[1:]}")
    return text


def unescape(text: str) -> str:
    pieces = text.split("\\\\")
    return "\\".join(piece.replace("\\", "") for piece in pieces)


def default_template(turns: Sequence[Turn]) -> str:
    out = []
    for role, text in turns:
        body = escape(text)
        if role == "user":
            out.append(f"<s>[INST] {body} [/INST]\n")
        elif role == "assistant":
            out.append(f" {body} </s>\n")
        else:
            out.append(f"[ROLE]{escape(role)}[/ROLE] {body} </s>\n")
    return "".join(out)


@dataclass(frozen=True)
class Span:
    """Where a turn and its text lie in the output; end is exclusive."""

    role: str
    start: int
    end: int
    text_start: int
    text_end: int


_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]\n|\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<other>.*?) </s>\n| (?P<assistant>.*?) </s>\n", re.S)


def read_default(text: str) -> list[Span] | None:
    """The turns of an output of the default template, from the output alone; None if it is none."""
    spans, at = [], 0
    while at < len(text):
        found = _TURN.match(text, at)
        if not found:
            return None
        kind = found.lastgroup
        spans.append(Span(unescape(found["role"]) if kind == "other" else kind, at, found.end(), found.start(kind), found.end(kind)))
        at = found.end()
    return spans


@dataclass(frozen=True)
class Rendered:
    text: str
    spans: tuple[Span, ...]
    rewrites: bool


Reader = Callable[[str], "list[Span] | None"]


def _common(a: str, b: str) -> int:
    """Length of the common start, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def render(turns: Sequence[Turn], template: Template = default_template, escaped: Callable[[str], str] = escape) -> Rendered:
    """The output, each turn's span, and whether the template changes what it wrote before.

    After a rewrite the spans of earlier turns no longer hold; there are none then.
    """
    before, spans, done = "", [], []
    for role, text in turns:
        now = template([*done, (role, text)])
        body = escaped(text)
        start = len(before)
        header = _common(now, template([*done, (role, PROBES[body[:1] == PROBES[0][:1]])]))
        if not now.startswith(before) or header < start or now[header : header + len(body)] != body:
            return Rendered(template(turns), (), True)
        spans.append(Span(role, start, len(now), header, header + len(body)))
        done.append((role, text))
        before = now
    return Rendered(before, tuple(spans), False)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


_OUT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted string, loss_spans array<struct<start:int,end:int>>, rewrites boolean"
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("rewrites", pa.bool_()),
])


def formatted_row(conv_id: int | None, turns: Sequence[Turn], template: Template, escaped: Callable[[str], str], plain: Callable[[str], str], read: Reader | None, loss_role: str) -> dict:
    """One row of the result; with a reader turns, roles and texts are read from the output."""
    r = render(turns, template, escaped)
    found = read(r.text) if read else list(r.spans)
    rewrites = r.rewrites or found is None or [(s.start, s.end) for s in found] != [(s.start, s.end) for s in r.spans]
    spans = found or []
    said = [(s.role, plain(r.text[s.text_start : s.text_end])) for s in spans]
    loss = "".join(text for role, text in said if role == loss_role)
    return {
        "conv_id": conv_id,
        "n_turns": len(said),
        "turns_sha256": _sha("".join(f"{role}\n{text}\n" for role, text in said)),
        "loss_chars": len(loss),
        "loss_sha256": _sha(loss),
        "formatted_chars": len(r.text),
        "formatted": r.text,
        "loss_spans": [{"start": s.text_start, "end": s.text_end} for s in spans if s.role == loss_role],
        "rewrites": rewrites,
    }


def _format(*how):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            ids, turns = batch.column(0).to_pylist(), batch.column(1)
            for i, conv_id in enumerate(ids):
                rows.append(formatted_row(conv_id, [(t["role"], t["text"]) for t in turns[i].as_py()], *how))
                held += len(rows[-1]["formatted"])
                if held > FLUSH_CHARS:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def format_conversations(rows: DataFrame, template: Template = default_template, escaped: Callable[[str], str] = escape, plain: Callable[[str], str] = unescape, loss_role: str = "assistant", read: Reader | None = read_default) -> DataFrame:
    """One row a conversation: its text, loss spans, digests read back from the text, and whether the template rewrites history.

    Another template brings its own ``read``; with None turns keep the roles of the input.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = pinned(rows, "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(_format(template, escaped, plain, read, loss_role), _OUT)
