"""Chat formatting: a finite-state machine over roles and a declarative template.

`format_chats` turns rows of turns into text segments with a loss flag each; joined in order, the segments of a conversation are
its formatted text. `read_chats` goes the other way and needs nothing but that text's segments and flags.

Rows reach a task sorted by conversation and turn and are taken one after the other, so a conversation of any length is never
held as a whole: the machine's state, a counter and two running digests are all that is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Control strings of public chat templates; none of them survives inside a text.
CONTROL_STRINGS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"


def _default_states() -> dict[str, dict[str, str]]:
    return {
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered", "tool": "asked"},
        "answered": {"user": "asked", "tool": "asked"},
    }


@dataclass(frozen=True)
class Template:
    """What a turn looks like, which roles are learned, and in which order roles may follow each other."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    reserved: tuple[str, ...] = CONTROL_STRINGS
    states: dict[str, dict[str, str]] = field(default_factory=_default_states)
    accepting: tuple[str, ...] = ("answered",)

    def __post_init__(self) -> None:
        problems = [f"{name} needs {n} characters or more" for name, n in (("opening", 2), ("closing", 2), ("after_role", 1)) if len(getattr(self, name)) < n]
        if any(c[1:].startswith("x;") for c in self.controls):
            problems.append("a control string must not look like an escape sequence")
        if ESCAPE in "".join((self.opening, self.after_role, self.closing, *self.reserved)):
            problems.append("markers must not hold the escape character")
        if problems:
            raise ValueError("; ".join(problems))

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(x for x in (self.opening, self.closing, *self.reserved) if len(x) > 1))


class Escaper:
    """Puts the escape character after the first character of every control string, and doubles it wherever a text has it.

    In a header, where a role must not hold what ends the header, that character is written as an escape sequence of its own.
    """

    SEQUENCE = "x;"

    def __init__(self, template: Template) -> None:
        found = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in template.controls)
        self._end = template.after_role[0]
        self._controls, self._back = re.compile(found), re.compile(rf"\\(\\|{self.SEQUENCE})?")

    def escape(self, text: str) -> str:
        return self._controls.sub(lambda m: m[0] + ESCAPE, text.replace(ESCAPE, ESCAPE * 2))

    def escape_role(self, role: str) -> str:
        return self.escape(role).replace(self._end, ESCAPE + self.SEQUENCE)

    def restore(self, text: str) -> str:
        if ESCAPE not in text:
            return text
        return self._back.sub(lambda m: self._end if m[1] == self.SEQUENCE else m[1] or "", text)


SEGMENTS = "conv_id bigint, turn_no bigint, part int, text string, loss boolean, valid boolean"


def _segments(template: Template):
    escaper = Escaper(template)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seen, state, n = None, False, "start", 0
        for batch in batches:
            out: list[tuple] = []
            for key, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not seen or key != conv:
                    conv, seen, state, n = key, True, "start", 0
                role, text = role or "", text or ""
                state = template.states.get(state, {}).get(role, "broken")
                fits = state != "broken"
                head = template.opening + escaper.escape_role(role) + template.after_role
                out.append((key, n, 0, head, False, fits))
                out.append((key, n, 1, escaper.escape(text), role in template.learned, fits))
                out.append((key, n, 2, template.closing, False, fits and state in template.accepting))
                n += 1
            if out:
                columns = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    return of


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Three segments for every turn: header, text, end; rows (conv_id, turn_no, part, text, loss, valid).

    Turns are taken by `turn`, nulls first, ties by role and text; repeated rows are repeated turns. Null roles and texts count
    as empty. The loss flag is set on texts of learned roles alone. `valid` of the first two parts says whether the roles up
    to here follow the template's states; that of the last part also asks that a conversation may end here. No turn is left out for
    being out of order. A null conv_id is a conversation of its own. Other columns are ignored; an empty table gives an empty one.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_segments(template or Template()), SEGMENTS)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, valid boolean"


class _Reader:
    """Reads one conversation's formatted text back, segment after segment."""

    def __init__(self, template: Template, escaper: Escaper) -> None:
        self.template, self.escaper = template, escaper
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.text, self.valid, self.ends = "", True, False

    def take(self, segment: str, loss: bool, valid: bool) -> None:
        self.chars += len(segment)
        if loss:
            plain = self.escaper.restore(segment)
            self.loss_chars += len(plain)
            self.learned.update(plain.encode())
        self.text += segment
        while (end := self.text.find(self.template.closing)) >= 0:
            turn, self.text = self.text[:end], self.text[end + len(self.template.closing):]
            if not turn.startswith(self.template.opening):
                raise ValueError("text between two turns")
            role, _, body = turn[len(self.template.opening):].partition(self.template.after_role)
            for piece in (self.escaper.restore(role), "\n", self.escaper.restore(body), "\n"):
                self.turns.update(piece.encode())
            self.n += 1
            self.ends = valid
        self.valid &= valid or self.template.closing == segment

    def row(self, key: int | None) -> tuple:
        if self.text:
            raise ValueError("a turn has no end")
        return key, self.n, self.turns.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.valid and self.ends


def _read(template: Template):
    escaper = Escaper(template)
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reader = None, None
        for batch in batches:
            done = []
            for conv, text, loss, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                if reader is None or conv != key:
                    if reader is not None:
                        done.append(reader.row(key))
                    key, reader = conv, _Reader(template, escaper)
                reader.take(text, loss, valid)
            if done:
                yield batch_of(done)
        if reader is not None:
            yield batch_of([reader.row(key)])

    return of


def read_chats(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads formatted conversations back: one row each with turn count, digest of all turns, and length and digest of what is learned.

    The turns come from the formatted text alone, by its markers; the learned text is what the flags cover, unescaped. `valid` says
    that all turns follow the states and that the conversation may end where it does.
    """
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no", "part")
    return rows.select("conv_id", "text", "loss", "valid").mapInArrow(_read(template or Template()), DIGESTS)

