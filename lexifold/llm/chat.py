"""Chat formatting: a finite-state machine over roles and a declarative template.

The machine reads a conversation's turns in the order of (turn, role, text) and
emits text segments, each with a loss flag. A turn that its state does not allow
is still emitted, with `valid` false from there on, so nothing is lost. Control
strings inside texts and role names are escaped reversibly: the escape character
is doubled and a control string becomes its number between marks.

Null texts and roles are empty; rows without a conv_id form one conversation of
their own; equal rows are separate turns. A conversation of any length streams
through in batches: only its state is held.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textblocks as tb

ESC = "\\"


@dataclass(frozen=True)
class Template:
    """What stands around each role's text, which texts carry loss, and which role may follow which.

    In `other`, {role} stands for the escaped name of a role that isn't listed.
    `controls` are all strings that may not appear inside a text.
    """

    start: str = "<s>"
    stop: str = "<|end|>"
    roles: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<|answer|>", "</s>")})
    other: tuple = ("<|role|>", "<|text|>", "<|/role|>")
    loss: frozenset = frozenset({"assistant"})
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset = frozenset({"assistant"})

    def controls(self) -> list[str]:
        found = {self.start, self.stop, *self.other, "[INST]", "[/INST]", "<s>", "</s>"}
        for a, b in self.roles.values():
            found |= {a, b, a.strip(), b.strip()}
        return sorted((c for c in found if c), key=lambda c: (-len(c), c))


class Codec:
    """Escapes and reads back texts for one template."""

    def __init__(self, template: Template):
        self.controls = template.controls()
        self.number = {c: i for i, c in enumerate(self.controls)}
        self.find = re.compile("|".join(map(re.escape, [ESC, *self.controls])))
        self.back = re.compile(re.escape(ESC) + r"(?:(\d+);|" + re.escape(ESC) + ")")

    def escape(self, text: str) -> str:
        return self.find.sub(lambda m: ESC + ESC if m[0] == ESC else f"{ESC}{self.number[m[0]]:02d};", text)

    def unescape(self, text: str) -> str:
        return self.back.sub(lambda m: self.controls[int(m[1])] if m[1] is not None else ESC, text)


class Formatter:
    """The machine: turn() and end() give (text, loss) segments."""

    def __init__(self, template: Template, codec: Codec):
        self.t, self.codec, self.state, self.valid = template, codec, "", True

    def turn(self, role: str, text: str):
        first = self.state == "" and self.valid
        if role not in self.t.follows.get(self.state, ()):
            self.valid = False
        self.state = role
        out = [(self.t.start, False)] if first else []
        if role in self.t.roles:
            before, after = self.t.roles[role]
        else:
            before, after = self.t.other[0] + self.codec.escape(role) + self.t.other[1], self.t.other[2]
        return [*out, (before, False), (self.codec.escape(text), role in self.t.loss), (after, False)]

    def end(self):
        if self.state not in self.t.final:
            self.valid = False
        return [(self.t.stop, False)]


def _streams(batches):
    """(is the first row of its conversation, row) of rows sorted by conversation."""
    last = object()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            yield row[0] != last, row
            last = row[0]


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, seg, text, loss, valid), the segments of a conversation in order and side by side."""
    template = template or Template()
    tb.ship(conversations.sparkSession)

    def run(batches):
        codec = Codec(template)
        rows: dict[str, list] = {c: [] for c in ("conv_id", "seg", "text", "loss", "valid")}
        machine, whose, seg, size = None, None, 0, 0

        def put(pieces):
            nonlocal seg, size
            for text, loss in pieces:
                for c, v in zip(rows, (whose, seg, text, loss, machine.valid)):
                    rows[c].append(v)
                seg += 1
                size += len(text)

        def flush():
            nonlocal size
            types = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], list(rows))
            for v in rows.values():
                v.clear()
            size = 0
            return out

        for new, (conv, role, text) in _streams(batches):
            if new:
                if machine:
                    put(machine.end())
                machine, whose, seg = Formatter(template, codec), conv, 0
            put(machine.turn(role or "", text or ""))
            if size > 1 << 20 or len(rows["seg"]) > 5000:
                yield flush()
        if machine:
            put(machine.end())
        yield flush()

    turns = conversations.select("conv_id", "turn", "role", "text")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, seg long, text string, loss boolean, valid boolean")


class Reader:
    """Reads formatted text and its loss mask back: roles, texts and what the mask covers.

    Pieces may be cut anywhere; turns are found by the template's strings alone.
    Only the turn that is being read is held.
    """

    def __init__(self, template: Template, codec: Codec):
        self.t, self.codec = template, codec
        self.before = sorted([template.start, template.stop, template.other[0], *(a for a, _ in template.roles.values())], key=len, reverse=True)
        self.opens = {a: role for role, (a, _) in template.roles.items()}
        self.longest = len(self.before[0])
        self.buffer, self.at, self.wait = "", 0, None  # wait: the string that ends what is being read
        self.turns, self.sha, self.loss_sha = 0, hashlib.sha256(), hashlib.sha256()
        self.chars = self.loss_chars = 0
        self.role, self.last, self.valid, self.stopped = None, "", True, False
        self.masked: list[str] = []

    def feed(self, text: str, loss: bool):
        self.chars += len(text)
        if loss:
            self.masked.append(text)
        elif text:
            self._unmask()
        self.buffer += text
        self._parse(False)

    def close(self):
        self._parse(True)
        self._unmask()
        if self.buffer or not self.stopped:
            raise ValueError(f"not in the template's form: {self.buffer[:80]!r}")
        self.valid &= self.last in self.t.final

    def _unmask(self):
        if self.masked:
            plain = self.codec.unescape("".join(self.masked))
            self.masked.clear()
            self.loss_chars += len(plain)
            self.loss_sha.update(plain.encode())

    def _parse(self, whole: bool):
        while self.buffer:
            if self.wait is None:
                if len(self.buffer) < self.longest and not whole:
                    return
                found = next((c for c in self.before if self.buffer.startswith(c)), None)
                if found is None or self.stopped:
                    raise ValueError(f"not in the template's form: {self.buffer[:80]!r}")
                self.buffer, self.at = self.buffer[len(found) :], 0
                if found in self.opens:
                    self.role, self.wait = self.opens[found], self.t.roles[self.opens[found]][1]
                elif found == self.t.other[0]:
                    self.role, self.wait = None, self.t.other[1]
                self.stopped = found == self.t.stop
                continue
            end = self.buffer.find(self.wait, self.at)
            if end < 0:  # what was searched is not searched again
                self.at = max(0, len(self.buffer) - len(self.wait) + 1)
                return
            plain = self.codec.unescape(self.buffer[:end])
            self.buffer, self.at = self.buffer[end + len(self.wait) :], 0
            if self.role is None:
                self.role, self.wait = plain, self.t.other[2]
                continue
            self.wait = None
            self.turns += 1
            self.sha.update(f"{self.role}\n{plain}\n".encode())
            self.valid &= self.role in self.t.follows.get(self.last, ())
            self.last = self.role


def digests(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads the text and mask of segments (as segments() gives them, in its partitions) back to one row per conversation."""
    template = template or Template()

    def run(batches):
        codec = Codec(template)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
        out: list = []
        reader, whose = None, None

        def done():
            reader.close()
            out.append((whose, reader.turns, reader.sha.hexdigest(), reader.loss_chars, reader.loss_sha.hexdigest(), reader.chars, reader.valid))

        for batch in batches:
            for conv, seg, text, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seg", "text", "loss"))):
                if seg == 0:
                    if reader:
                        done()
                    reader, whose = Reader(template, codec), conv
                reader.feed(text, loss)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
            out = []
        if reader:
            done()
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def formatted(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, text, loss_spans, valid): the whole formatted text; its loss mask as code point spans."""
    parts = segments(conversations, template)
    rows = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "text", "loss"))).alias("s"), F.min("valid").alias("valid"))
    ends = F.aggregate(
        "s",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["text"])).alias("at"),
            F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.char_length(x["text"])).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["text"]), "").alias("text"), ends["spans"].alias("loss_spans"), "valid")


def with_sample(conversations: DataFrame) -> DataFrame:
    """The contract's table: all conversations and the one that holds control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(extra)


def report(conversations: DataFrame) -> DataFrame:
    return digests(segments(with_sample(conversations)))


def oracle(template: Template | None = None) -> str:
    """DuckDB SQL for report()."""
    t = template or Template()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    # a control string becomes four characters, an escape character two
    pattern = "|".join(re.escape(c) for c in t.controls()).replace("\\ ", " ")
    size = lambda c: f"length(regexp_replace(replace({c}, '\\', '##'), {quote(pattern)}, '####', 'g'))"
    around = " ".join(f"WHEN {quote(r)} THEN {len(a) + len(b)}" for r, (a, b) in t.roles.items())
    allowed = " OR ".join(f"(before = {quote(a)} AND role IN ({', '.join(map(quote, b))}))" for a, b in t.follows.items())
    loss, final = (", ".join(map(quote, sorted(x))) for x in (t.loss, t.final))
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, k, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(k, role)),
o AS (SELECT *, row_number() OVER w AS k, coalesce(lag(role) OVER w, '') AS before, lead(role) OVER w AS after FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({loss})), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role IN ({loss})), '')) AS loss_sha256,
  CAST({len(t.start) + len(t.stop)} + sum({size("text")} + CASE role {around} ELSE {sum(map(len, t.other))} + {size("role")} END) AS BIGINT) AS formatted_chars,
  bool_and(({allowed}) AND (after IS NOT NULL OR role IN ({final}))) AS valid
FROM o GROUP BY conv_id
"""
