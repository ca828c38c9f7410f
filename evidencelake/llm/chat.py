"""Chat formatting with a template as a black box: what each turn adds is found by comparing outputs.

A template turns a list of (role, text) into one string. Its prefixes are rendered turn by turn. The part that two
consecutive outputs share is kept, the rest is the turn's piece; if less is kept than there was, the template has
rewritten history. Where a turn's text lies in its piece is found by two more renderings with texts that differ
everywhere: what these share on the left and on the right is the template's own.

Whole prefixes are rendered, also by INSTRUCTIONS, so that a change anywhere in the history is seen; time grows with the
square of a conversation's turns. A template may state how many turns before a turn can bear on what that turn adds
(memory), so that only so many are rendered again; nothing checks that statement. A conversation's rows go through one
task as a sorted stream, since a digest of its texts reads them in order; the turns of one conversation are in memory.

Cases: a null role or text is empty; rows of a conversation stand by turn (null first), then role and text; repeated rows
are turns of their own; a null conv_id is a conversation; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidencelake.llm.common import occupy, only, partitions

Turn = tuple[str, str]  # role and text
PIECE = "conv_id long, place long, kept long, piece string, text_start long, text_end long, loss boolean, rewrote boolean"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
FLUSH = 1 << 21  # characters that leave a task at once


@dataclass(frozen=True)
class Template:
    """render is the black box. parse reads what it has written back, turn by turn; plain turns an escaped text back."""

    render: Callable[[list[Turn]], str]
    parse: Callable[[str], Iterator[Turn]]
    plain: Callable[[str], str]
    memory: int | None = None
    learned: tuple[str, ...] = ("assistant",)  # roles under the loss mask


#: Control strings. In each the first character occurs once, so that no two of them overlap.
CONTROLS = ("<s>", "</s>", "[SYS]", "[/SYS]", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[TEXT]", "[/ROLE]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: str) -> str:
    """A text without control strings: a backslash stands behind the first character of each, and before each backslash."""
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_AROUND = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", " </s>")}
_TURN = re.compile("(?:<s>)?(?:" + "|".join(f"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in _AROUND.items()) + r"|\[ROLE\] (?P<role>.*?) \[TEXT\] (?P<text>.*?) \[/ROLE\])", re.DOTALL)


def instructions(turns: list[Turn]) -> str:
    """Marks around each turn by its role; other roles are spelt out."""
    parts = ["<s>"] if turns else []
    for role, text in turns:
        before, after = _AROUND.get(role) or (f"[ROLE] {escaped(role)} [TEXT] ", " [/ROLE]")
        parts += [before, escaped(text), after]
    return "".join(parts)


def parsed(output: str) -> Iterator[Turn]:
    at = 0
    while at < len(output):
        found = _TURN.match(output, at)
        if not found:
            raise ValueError(f"no turn at character {at} of the output")
        at = found.end()
        groups = found.groupdict()
        role = next((r for r in _AROUND if groups[r] is not None), None)
        yield (role, unescaped(groups[role])) if role else (unescaped(groups["role"]), unescaped(groups["text"]))


INSTRUCTIONS = Template(instructions, parsed, unescaped)


def shared(a: str, b: str) -> int:
    """Characters that two texts have in common at their start."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def added(template: Template, old: str, before: list[Turn], turn: Turn) -> tuple[str, int, int, int]:
    """The output with a turn, how much of the old one is kept in it, and where the turn's text lies in what follows."""
    new = template.render([*before, turn])
    kept = len(old) if new.startswith(old) else shared(new, old)
    a, b = (template.render([*before, (turn[0], probe)]) for probe in ("a", "b"))
    start = shared(a, b)
    tail = shared(a[start:][::-1], b[start:][::-1])
    return new, kept, max(start, kept) - kept, max(len(new) - tail, start, kept) - kept


def render_turns(conversations: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """A row for each turn, in order in its partition: conv_id, place (from 0), kept (characters of the output so far that
    stay), piece (what follows them), text_start and text_end (of the text in it), loss, and rewrote: whether history changed.

    A conversation's output is its pieces, each behind the kept part of what was before.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occupy("chat")
        out, size = [], 0
        conversation, place, length, before, old = object(), 0, 0, [], ""
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != conversation or not before:
                    conversation, place, length, before = conv_id, 0, 0, []
                    old = template.render(before)
                new, kept, start, end = added(template, old, before, (role, text))
                piece = new[kept:]
                kept_whole = length - len(old) + kept  # of the whole output, of which the template's turns are the end
                out.append((conv_id, place, kept_whole, piece, start, end, role in template.learned, kept < len(old)))
                place, length, size = place + 1, kept_whole + len(piece), size + len(piece)
                before.append((role, text))
                old = new
                if template.memory is not None and len(before) > max(1, template.memory):
                    del before[: -max(1, template.memory)]
                    old = template.render(before)
                if size >= FLUSH:
                    yield _batch(out, PIECE)
                    out, size = [], 0
        yield _batch(out, PIECE)

    rows = only(conversations, conv_id="long", turn="long", role="string", text="string").na.fill("", ["role", "text"])
    dealt = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, PIECE)


_ARROW = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [pa.field(name, _ARROW[kind]) for name, kind in (x.split() for x in schema.split(", "))]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def read_back(pieces: DataFrame, template: Template = INSTRUCTIONS) -> DataFrame:
    """Digests of what a conversation's output says: its turns as they are parsed, its texts under the loss mask, its length.

    pieces is what render_turns gives, in its order. History that was rewritten is an error here, as its pieces are gone.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        turns = loss = None
        own = [None, 0, 0, 0]  # conv_id, turns, characters under the mask, characters

        def ended() -> tuple:
            return own[0], own[1], turns.hexdigest(), own[2], loss.hexdigest(), own[3]

        for batch in batches:
            for conv_id, place, kept, piece, start, end, learned in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "kept", "piece", "text_start", "text_end", "loss")), strict=True):
                if place == 0:
                    if turns:
                        out.append(ended())
                    turns, loss, own = hashlib.sha256(), hashlib.sha256(), [conv_id, 0, 0, 0]
                if kept != own[3]:
                    raise ValueError(f"the template rewrites history in conversation {conv_id}, at turn {place}")
                for role, text in template.parse(piece):
                    turns.update(f"{role}\n{text}\n".encode())
                    own[1] += 1
                if learned:
                    text = template.plain(piece[start:end])
                    loss.update(text.encode())
                    own[2] += len(text)
                own[3] += len(piece)
            yield _batch(out, READ)
            out = []
        yield _batch([ended()] if turns else [], READ)

    return pieces.mapInArrow(run, READ)


def rewrites(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_rewrites (turns that changed the output before them) and first_rewrite, the first such turn's place."""
    return pieces.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.count_if("rewrote").alias("n_rewrites"), F.min(F.when(F.col("rewrote"), F.col("place"))).alias("first_rewrite"),
    )


def spans(pieces: DataFrame) -> DataFrame:
    """conv_id, place, loss, and start and end of each turn's text in the final output; null once a later turn has rewritten it."""
    later = Window.partitionBy("conv_id").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    start, end = F.col("kept") + F.col("text_start"), F.col("kept") + F.col("text_end")
    stays = F.coalesce(F.min("kept").over(later) >= end, F.lit(True))
    return pieces.select("conv_id", "place", "loss", F.when(stays, start).alias("start"), F.when(stays, end).alias("end"))
