"""Byte-level BPE, encoded and decoded by DuckDB queries inside each Spark partition.

A word (one match of the split pattern) becomes rows (word, pos, npos, tok, nxt), one for each token, linked to its right
neighbour. A recursive query joins the rows with the merge table, contracts the leftmost pair of least rank of each word and
goes on until no word has a pair left. Decoding joins token rows with the vocabulary and aggregates their bytes in order of
position. Each distinct word is encoded once for a batch of texts; a process keeps the ids of some, within a bound.

Defined results: a null text counts as empty; an empty text has no ids, the empty digest and the empty decoded text. Repeated rows each give a row.
Extra columns of the input are kept where `keep` names them. A word of any length is encoded exactly. Long ones go through the query in
overlapping windows: a window's tokens are those of its bytes, tokens next to each other in it stand so in any text that has them
next to each other as a valid encoding, and so two windows that share a token at one place make one encoding there. Windows that share none become one
window, and these take the form of the query that contracts all occurrences of a pair at once, up to the first that gives birth to a pair of lower rank.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from public_tokenizers import PATTERN as DEFAULT_PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsymbol.llm.split import TextIds, parts

#: Words of more bytes are cut into windows.
LONG = 48
#: Bytes of a window, half of which it shares with the next.
WINDOW = 96
#: Windows that go through one query.
WINDOWS = 2_000
#: Ids that go through one query that decodes.
DECODED = 500_000
#: Distinct words that go through one query.
BATCH = 20_000
#: Strings whose ids a process keeps.
KNOWN = 100_000
#: Rows that a query for joined windows keeps at most, all steps together; then it starts again from its last rows.
KEPT = 6_000_000

SHORT_SQL = """
WITH RECURSIVE s(step, word, pos, npos, tok, nxt) AS (
  SELECT 0, word, pos, npos, tok, nxt FROM rows_in
  UNION ALL
  (WITH p AS (SELECT s.step, s.word, s.pos, s.npos, s.tok, s.nxt, m.k FROM s LEFT JOIN merges m ON s.tok = m.l AND s.nxt = m.r),
   b AS (SELECT word, min(k::BIGINT << 32 | pos) AS best, arg_min(npos, k::BIGINT << 32 | pos) AS gone FROM p WHERE k IS NOT NULL GROUP BY word),
   h AS (SELECT b.word, (best & 4294967295)::INT AS pos, (best >> 32)::INT AS tok, gone, g.npos, g.nxt FROM b JOIN p g ON g.word = b.word AND g.pos = b.gone)
   SELECT p.step + 1, p.word, p.pos,
     CASE WHEN p.pos = h.pos THEN h.npos ELSE p.npos END,
     CASE WHEN p.pos = h.pos THEN h.tok ELSE p.tok END,
     CASE WHEN p.npos = h.pos THEN h.tok WHEN p.pos = h.pos THEN h.nxt ELSE p.nxt END
   FROM p JOIN h ON p.word = h.word WHERE p.pos <> h.gone)
)
SELECT s.word, s.pos, s.tok FROM s JOIN (SELECT word, max(step) AS step FROM s GROUP BY word) e ON s.word = e.word AND s.step = e.step
ORDER BY s.word, s.pos
"""

LONG_SQL = """
WITH RECURSIVE s(step, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM long_in
  UNION ALL
  (WITH p AS (
     SELECT n.*, m.k, m.safe FROM (SELECT *, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM s WHERE step < {steps}) n
     LEFT JOIN merges m ON n.tok = m.l AND n.nxt = m.r),
   b AS (SELECT word, min(k) AS best FROM p WHERE k IS NOT NULL GROUP BY word),
   i AS (SELECT p.*, b.best, coalesce(p.k = b.best, false) AS fits, row_number() OVER (PARTITION BY p.word ORDER BY p.pos) AS n FROM p JOIN b ON p.word = b.word),
   r AS (SELECT *, n - coalesce(max(CASE WHEN NOT fits THEN n END) OVER (PARTITION BY word ORDER BY pos), 0) AS nth FROM i),
   f AS (SELECT *, fits AND nth % 2 = 1 AS fine FROM r),
   v AS (SELECT *, CASE WHEN lag(fine, 2, false) OVER w THEN best ELSE lag(tok) OVER w END AS before, lead(tok, 2) OVER w AS after FROM f WINDOW w AS (PARTITION BY word ORDER BY pos)),
   e AS (
     SELECT v.*, coalesce(x.k < v.best, false) OR coalesce(y.k < v.best, false) AS birth FROM v
     LEFT JOIN merges x ON x.l = CASE WHEN v.fine AND NOT v.safe THEN v.before END AND x.r = v.best
     LEFT JOIN merges y ON y.l = CASE WHEN v.fine AND NOT v.safe THEN v.best END AND y.r = v.after),
   c AS (SELECT *, fine AND NOT coalesce(bool_or(birth) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS hit FROM e),
   d AS (SELECT *, lag(hit, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone FROM c)
   SELECT step + 1, word, pos, CASE WHEN hit THEN k ELSE tok END FROM d WHERE NOT gone)
)
SELECT s.word, s.pos, s.tok, s.step FROM s JOIN (SELECT word, max(step) AS step FROM s GROUP BY word) e ON s.word = e.word AND s.step = e.step
ORDER BY s.word, s.pos
"""

DECODE_SQL = """
SELECT i.doc, string_agg(v.bytes, '' ORDER BY i.pos) AS bytes FROM ids_in i JOIN vocabulary v ON v.tok = i.tok GROUP BY i.doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file. Read on the driver: the vocabulary is bounded, and executors get it by broadcast."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder of one vocabulary in one process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.texts = TextIds(pattern, self.learn, known=KNOWN)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = [(a, b, k) for whole, k in ranks.items() for i in range(1, len(whole)) if (a := ranks.get(whole[:i])) is not None and (b := ranks.get(whole[i:])) is not None]
        left, right, rank = (np.array(x, np.int32) for x in zip(*pairs, strict=True))
        least = np.full(max(ranks.values()) + 1, np.iinfo(np.int32).max, np.int32)  # of the pairs that a token can enter
        np.minimum.at(least, left, rank)
        np.minimum.at(least, right, rank)
        self.tables = {"merges": {"l": left, "r": right, "k": rank, "safe": least[rank] > rank}, "vocabulary": {"tok": np.fromiter(ranks.values(), np.int32, len(ranks)), "bytes": [x.decode("latin-1") for x in ranks]}}
        self.sql = None
        self.decimals = pa.array([str(i) for i in range(max(ranks.values()) + 1)])

    def open(self) -> None:
        import duckdb

        self.sql = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.gettempdir()})
        for name, columns in self.tables.items():
            self._load(name, columns)

    def close(self) -> None:
        """DuckDB gives the memory of its queries back only here."""
        self.sql.close()
        self.sql = None

    def _load(self, name: str, columns: dict) -> None:
        self.sql.register("arrow_in", pa.table(columns))
        self.sql.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_in")
        self.sql.unregister("arrow_in")

    def _rows(self, words: list[bytes]) -> dict[str, np.ndarray]:
        """word, pos and tok of every byte."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return {"word": np.repeat(np.arange(len(words), dtype=np.int32), size), "pos": pos.astype(np.int32), "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)]}

    def _short(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word number, place and token of every final row, in order."""
        rows = self._rows(words)
        ends = np.append(rows["word"][1:] != rows["word"][:-1], True)[: len(rows["word"])]
        self._load("rows_in", rows | {"npos": np.where(ends, -1, rows["pos"] + 1).astype(np.int32), "nxt": np.where(ends, -1, np.append(rows["tok"][1:], -1)[: len(ends)]).astype(np.int32)})
        got = self.sql.execute(SHORT_SQL).fetchnumpy()
        self.sql.execute("DROP TABLE rows_in")
        return got["word"], got["pos"], got["tok"]

    def _joined(self, word: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Place and token of every final row of a window of any length."""
        left = self._rows([word])
        while True:
            steps = int(np.clip(KEPT // max(1, len(left["tok"])), 1, 48))
            self._load("long_in", left)
            got = self.sql.execute(LONG_SQL.format(steps=steps)).fetchnumpy()
            self.sql.execute("DROP TABLE long_in")
            left = {n: got[n] for n in ("word", "pos", "tok")}
            if not len(got["step"]) or got["step"][0] < steps:
                return left["pos"], left["tok"]

    def _long(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, from windows that are joined where they share a token at one place."""
        half = WINDOW // 2
        spans = [[(at, min(at + WINDOW, len(w))) for at in range(0, max(1, len(w) - half), half)] for w in words]
        made: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
        while True:
            todo = [(w, lo, hi) for w, mine in enumerate(spans) for lo, hi in mine if (w, lo, hi) not in made]
            if not todo:
                break
            small = [x for x in todo if x[2] - x[1] <= WINDOW]
            for i in range(0, len(small), WINDOWS):
                part = small[i : i + WINDOWS]
                window, pos, tok = self._short([words[w][lo:hi] for w, lo, hi in part])
                cuts = np.searchsorted(window, np.arange(1, len(part)))
                for key, p, t in zip(part, np.split(pos, cuts), np.split(tok, cuts), strict=True):
                    made[key] = (p + key[1], t)
            for w, lo, hi in todo:
                if hi - lo > WINDOW:
                    pos, tok = self._joined(words[w][lo:hi])
                    made[w, lo, hi] = (pos + lo, tok)
            for w in {w for w, *_ in todo}:
                mine, last = spans[w][:1], spans[w][0]
                for span in spans[w][1:]:
                    if self._meet(made[w, *last], made[w, *span]) is None:
                        mine[-1] = (mine[-1][0], span[1])
                    else:
                        mine.append(span)
                    last = span
                spans[w] = mine
        return [self._stitch([made[w, lo, hi] for lo, hi in mine]) for w, mine in enumerate(spans)]

    @staticmethod
    def _meet(a, b) -> int | None:
        """The place of a token that both windows have, the middle one of all."""
        pos, i, k = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
        pos = pos[a[1][i] == b[1][k]]
        return int(pos[len(pos) // 2]) if len(pos) else None

    def _stitch(self, windows: list) -> np.ndarray:
        cuts = [self._meet(a, b) for a, b in zip(windows[:-1], windows[1:], strict=True)]
        out = []
        for (pos, tok), lo, hi in zip(windows, [0, *cuts], [*cuts, np.iinfo(np.int64).max], strict=True):
            out.append(tok[(pos >= lo) & (pos < hi)])
        return np.concatenate(out)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word number and token of every final row, in order."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        short, long = np.flatnonzero(size <= LONG), np.flatnonzero(size > LONG)
        word, _, tok = self._short([words[i] for i in short])
        parts_of = self._long([words[i] for i in long])
        word = np.concatenate([short[word], np.repeat(long, [len(x) for x in parts_of])])
        tok = np.concatenate([tok, *parts_of])
        order = np.argsort(word, kind="stable")
        return word[order], tok[order]

    def _decode_rows(self, doc: np.ndarray, tok: np.ndarray, n: int) -> list[bytes]:
        self._load("ids_in", {"doc": doc.astype(np.int32), "pos": np.arange(len(tok), dtype=np.int32), "tok": tok.astype(np.int32)})
        got = self.sql.execute(DECODE_SQL).fetchnumpy()
        self.sql.execute("DROP TABLE ids_in")
        out = [b""] * n
        for k, text in zip(got["doc"].tolist(), got["bytes"].tolist(), strict=True):
            out[k] = text.encode("latin-1")
        return out

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The bytes of each list of ids; the lists stand one after the other, size says how long each is."""
        ends, out = np.cumsum(size), []
        cuts = np.unique(np.searchsorted(ends, np.arange(0, max(1, len(ids)), DECODED))) if len(size) else ends
        for lo, hi in zip(cuts, [*cuts[1:], len(size)][: len(cuts)], strict=True):
            out += self._decode_rows(np.repeat(np.arange(hi - lo), size[lo:hi]), ids[ends[lo] - size[lo] : ends[hi - 1]], int(hi - lo))
        return out

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after the other, and how many each has."""
        flat, size = [np.empty(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), BATCH):
            word, tok = self.merge([w.encode() for w in words[i : i + BATCH]])
            flat.append(tok.astype(np.uint32))
            size.append(np.bincount(word, minlength=len(words[i : i + BATCH])))
        return np.concatenate(flat), np.concatenate(size)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        return self.texts.ids(texts)

    def digests(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """sha256 of each text's ids as decimals joined by a space."""
        lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), self.decimals.take(pa.array(ids)))
        return [hashlib.sha256(x.encode()).hexdigest() for x in pc.binary_join(lists, " ").to_pylist()]


_codecs: dict[str, Codec] = {}


@contextmanager
def _codec(vocabulary) -> Iterator[Codec]:
    """The process's codec, open for a task; the words that it knows are bounded and stay for the next tasks."""
    key, ranks, pattern = vocabulary.value
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    codec = _codecs[key]
    codec.open()
    try:
        yield codec
    finally:
        codec.close()


def _broadcast(df: DataFrame, path: str, pattern: str | None):
    ranks, pattern = read_ranks(path), pattern or DEFAULT_PATTERN
    key = hashlib.sha256(repr((path, len(ranks), pattern)).encode()).hexdigest()
    return df.sparkSession.sparkContext.broadcast((key, ranks, pattern))


def encode(df: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pattern: str | None = None, ids: str = "ids", decoded: str | None = None, checked: bool = False) -> DataFrame:
    """keep, the token ids of each text as array<int>, and with `decoded` the bytes that they decode to. No shuffle.
    checked: the ids of every text are decoded, and a difference from the text is an error."""
    vocabulary = _broadcast(df, path, pattern)
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("\0text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.BinaryType(), False)] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(vocabulary) as codec:
            for whole in batches:
                for part in parts(whole):
                    made, size = codec.ids(part.column(part.num_columns - 1))
                    lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32), pa.array(made.astype(np.int32)))
                    back = pa.array(codec.decode(made, size) if decoded or checked else [], pa.binary())
                    if checked and not back.equals(part.column(part.num_columns - 1).cast(pa.binary())):
                        raise ValueError("ids that don't decode to their text")
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, *[back] * bool(decoded)], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), decoded: str = "decoded") -> DataFrame:
    """keep and the bytes that an array of ids stands for (null: none). An id outside the vocabulary stands for nothing."""
    vocabulary = _broadcast(df, path, None)
    source = df.select(*keep, F.col(ids).alias("\0ids"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(decoded, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(vocabulary) as codec:
            for whole in batches:
                for i in range(0, whole.num_rows, 500):
                    part = whole.slice(i, 500)
                    lists = [np.array([i for i in x or () if i is not None], np.int32) for x in part.column(part.num_columns - 1).to_pylist()]
                    size = np.fromiter(map(len, lists), np.int64, len(lists))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(codec.decode(np.concatenate([*lists, np.empty(0, np.int32)]), size), pa.binary())], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def digests(df: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), pattern: str | None = None) -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256 (of what the document's ids decode to), made where the ids are made so that they needn't leave the worker."""
    vocabulary = _broadcast(df, path, pattern)
    source = df.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("\0text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _codec(vocabulary) as codec:
            for whole in batches:
                for part in parts(whole):
                    ids, size = codec.ids(part.column(part.num_columns - 1))
                    back = [hashlib.sha256(x).hexdigest() for x in codec.decode(ids, size)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(size), pa.array(codec.digests(ids, size), pa.string()), pa.array(back, pa.string())], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)
