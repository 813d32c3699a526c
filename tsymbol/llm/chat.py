"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: its text is all turns before it and its reply, of which only the reply is
trainable. The rows hold every example whole, so the output grows with the square of a conversation's replies. Texts of over
`SEGMENT` characters are cut into parts, a row each, so that rows stay small; full_texts() puts them together. Turns after the
last reply make a last example without a reply, whose text is the whole conversation.

A turn is `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. Inside texts and roles every `<`, k
backslashes and `|` gets one more backslash, so that no text holds a control string, and taking one away restores it;
roles also have backslashes doubled and line feeds written as `\\n`.

Defined results: a null text or role counts as empty; rows with a null conversation id make one conversation; turns of equal
number go by role and text, nulls first, and repeated rows repeat. Conversations without a reply have no trainable characters.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Characters of a part. Readers hold some thousand rows at once.
SEGMENT = 16_384
#: Characters of the rows that are written at once.
HELD = 4_000_000
#: Bytes of a conversation that a task holds in memory; more go to a file of its own.
SPOOL = 64_000_000

_escape = re.compile(r"<(\\*)\|").sub
_unescape = re.compile(r"<\\(\\*)\|").sub
_turn = re.compile(r"<\|im_start\|>([^\n]*+)\n([^<]*+(?:<(?!\|)[^<]*+)*+)<\|im_end\|>\n").finditer


def escape(text: str) -> str:
    return _escape(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _unescape(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of a formatted text."""
    for m in _turn(text):
        yield unescape_role(m[1]), unescape(m[2])


class _Parts:
    """The full parts of a conversation's text, which every further example repeats."""

    def __init__(self) -> None:
        self.file, self.sizes = tempfile.SpooledTemporaryFile(max_size=SPOOL), []

    def add(self, text: str) -> None:
        self.file.seek(0, 2)
        self.sizes.append(self.file.write(text.encode()))

    def clear(self) -> None:
        if self.sizes:
            self.file.seek(0)
            self.file.truncate()
            self.sizes = []

    def __iter__(self) -> Iterator[str]:
        self.file.seek(0)
        for n in self.sizes:
            yield self.file.read(n).decode()


def _schema(key: T.StructField) -> T.StructType:
    return T.StructType([key, *(T.StructField(n, t, False) for n, t in (("example", T.LongType()), ("part", T.LongType()), ("text", T.StringType()), ("known_chars", T.LongType()), ("context_chars", T.LongType()), ("loss_start", T.LongType()), ("loss_end", T.LongType()), ("n_turns", T.LongType())))])


def examples(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, example, part, text, known_chars, context_chars, loss_start, loss_end, n_turns): the examples' whole texts, in
    parts; rows of a conversation follow each other in order. Of a part's characters the first `known_chars` are the example's
    before too. Context, the reply's span and turns are the whole example's. One shuffle by conversation with a spilling sort; a
    task holds SPOOL bytes of a conversation at most, and a conversation's examples are written by one task."""
    rows = df.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    schema = _schema(T.StructField(conversation, rows.schema["c"].dataType))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, example, turns, size, known = None, False, 0, 0, 0, 0
        full, last, left = _Parts(), [], 0
        out: list[tuple] = []
        held = 0

        def add(piece: str) -> None:
            nonlocal last, left, size, turns
            last.append(piece)
            left, size, turns = left + len(piece), size + len(piece), turns + 1
            if left >= SEGMENT:
                whole = "".join(last)
                cut = left - left % SEGMENT
                for at in range(0, cut, SEGMENT):
                    full.add(whole[at : at + SEGMENT])
                last, left = [whole[cut:]], left - cut

        def close(context: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
            """The example of all turns so far."""
            nonlocal example, known, last, held
            last = ["".join(last)]
            for part, piece in enumerate(chain(full, last if left else ())):
                out.append((now, example, part, piece, min(max(known - part * SEGMENT, 0), len(piece)), context, start, end, turns))
                held += len(piece)
                if held > HELD or len(out) >= 5000:
                    yield flush()
            example, known = example + 1, size

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            arrays = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)]
            out, held = [], 0
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            for c, r, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if not begun or c != now:
                    if size > known:
                        yield from close(size, 0, 0)
                    now, begun, example, turns, size, known = c, True, 0, 0, 0, 0
                    full.clear()
                    last, left = [], 0
                context, head, body = size, f"{START}{escape_role(r)}\n", escape(x)
                add(f"{head}{body}{END}\n")
                if r == "assistant":
                    yield from close(context, context + len(head), context + len(head) + len(body))
        if size > known:
            yield from close(size, 0, 0)
        if out:
            yield flush()

    return rows.mapInArrow(run, schema)


def full_texts(made: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """Each reply's example with its text in one piece, and the reply's span in it."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "")
    return made.filter("loss_start > 0").groupBy(conversation, "example", "loss_start", "loss_end").agg(text.alias("text")).select(conversation, "example", "text", "loss_start", "loss_end")


_NOTHING = hashlib.sha256().digest()


class _Reader:
    """Reads a conversation's examples in order and holds each one's context against the whole text of the one before."""

    def __init__(self, key: object) -> None:
        self.key, self.example, self.parts = key, -1, []  # of each part so far: digest and characters
        self.n_turns, self.turns, self.loss_chars, self.loss = 0, hashlib.sha256(), 0, hashlib.sha256()
        self.begin(())

    def begin(self, spans: tuple) -> None:
        self.spans, self.part, self.size = spans, 0, 0
        self.new, self.n_new, self.most = [], 0, HELD

    def hold(self, right: bool) -> None:
        if not right:
            raise ValueError(f"example {self.example} of conversation {self.key} doesn't stand behind the whole example before it, or its parts, reply or number of turns are wrong")

    def add(self, example: int, part: int, before: bytes, known: int, whole: bytes, new: str, spans: tuple) -> None:
        if example != self.example:
            self.end()
            self.example += 1
            self.begin(spans)
        old = self.parts[part] if part < len(self.parts) else (_NOTHING, 0)
        self.hold((example, part, spans, before, known) == (self.example, self.part, self.spans, *old) and not (new and part + 1 < len(self.parts)))
        self.parts[part : part + 1] = [(whole, known + len(new))]
        self.part, self.size = part + 1, self.size + known + len(new)
        self.new.append(new)
        self.n_new += len(new)
        if self.n_new > self.most:  # a long way to the reply: only the turn that isn't complete yet is held
            self.read()
            self.most = max(HELD, 2 * self.n_new)

    def read(self) -> str:
        """Read what is complete of the new turns before the reply; what is left."""
        text = "".join(self.new)
        done, context = 0, self.spans[0] - self.size + len(text)
        self.hold(context >= 0)
        for m in _turn(text, 0, context):
            self.hold(m.start() == done)
            self.turn(m)
            done = m.end()
        self.new, self.n_new = [text[done:]], len(text) - done
        return self.new[0]

    def turn(self, m: re.Match) -> None:
        self.turns.update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
        self.n_turns += 1

    def end(self) -> None:
        if self.example < 0:
            return
        context, start, end, n_turns = self.spans
        rest = self.read()
        at = self.size - len(rest)
        self.hold(self.part == len(self.parts) and at == context)
        if start:
            m = next(_turn(rest), None)
            self.hold(m is not None and m.span() == (0, len(rest)) and m[1] == "assistant" and m.span(2) == (start - at, end - at))
            self.turn(m)
            reply = unescape(rest[start - at : end - at])
            self.loss.update(reply.encode())
            self.loss_chars += len(reply)
        self.hold(self.n_turns == n_turns)

    def result(self) -> tuple:
        self.end()
        return self.key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.size


def digests(made: DataFrame, *, conversation: str = "conv_id") -> DataFrame:
    """What reading the rows of examples() back gives for each conversation: its turns, and all text under the loss mask.

    Every example is read whole, where its rows lie: the digest of what it should share with the example before, that of its whole
    text, and what it adds. Only these are shuffled. Then the examples of a conversation are read in order: each must begin with
    all of the one before, its reply must be a turn of the assistant where its span lies, behind all context, and it must have
    as many turns as its row says. A table with a context changed, examples or parts missing, twice or out of place so fails, and
    doesn't give other digests."""
    key = made.schema[conversation]
    names = ("context_chars", "loss_start", "loss_end", "n_turns")
    fields = (("example", T.LongType()), ("part", T.LongType()), ("before", T.BinaryType()), ("known", T.LongType()), ("whole", T.BinaryType()), ("new", T.StringType()), *((n, T.LongType()) for n in names))
    read = T.StructType([key, *(T.StructField(n, t, False) for n, t in fields)])
    schema = T.StructType([key, T.StructField("n_turns", T.LongType(), False), T.StructField("turns_sha256", T.StringType(), False), T.StructField("loss_chars", T.LongType(), False), T.StructField("loss_sha256", T.StringType(), False), T.StructField("formatted_chars", T.LongType(), False)])

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(read)
        for batch in batches:
            before, whole, new = [], [], []
            for text, known in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                digest = hashlib.sha256(text[:known].encode())
                before.append(digest.digest())
                new.append(text[known:])
                digest.update(new[-1].encode())
                whole.append(digest.digest())
            arrays = [pa.array(before, pa.binary()), batch.column(4), pa.array(whole, pa.binary()), pa.array(new, arrow.field("new").type)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays, *batch.columns[5:]], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        reader, out = None, []

        def flush() -> pa.RecordBatch:
            nonlocal out
            arrays = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), arrow, strict=True)]
            out = []
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for c, example, part, before, known, whole, new, *spans in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if reader is None or c != reader.key:
                    if reader is not None:
                        out.append(reader.result())
                    reader = _Reader(c)
                reader.add(example, part, before, known, whole, new, tuple(spans))
                if len(out) >= 5000:
                    yield flush()
        if reader is not None:
            out.append(reader.result())
        if out:
            yield flush()

    rows = made.select(conversation, "example", "part", "text", "known_chars", *names).mapInArrow(shorten, read)
    return rows.repartition(conversation).sortWithinPartitions(conversation, "example", "part").mapInArrow(run, schema)
