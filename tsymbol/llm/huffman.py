"""Token ids in files of Huffman blocks.

The format is a folder of Parquet tables. `codes` has the code length of every id that occurs (canonical, length-limited,
from the counts of all ids). `blocks` has a row for each block of whole documents: its bucket of ascending doc_ids, its first
id's place in the bucket, the documents' ids and sizes, the bits (codes from the highest bit down), and the bit offset
of every `STRIDE`-th id. Blocks decode apart from each other, all checkpoints of a block at once, by one table lookup an id.

Ids are made and counted once, staged in order of doc_id by a shuffle of the compressed ids, and coded. They are what the
tokenizers library gives for encode(text, add_special_tokens=False): an added token that stands in a text is one id.

Defined results: a null text counts as empty; every document ends with the end id. Documents of equal id follow each other in
order of their ids' bytes; null doc_ids come first. An empty table gives a folder without blocks.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsymbol.llm.common import discard, materialise
from tsymbol.llm.split import TextIds, parts

LIMIT, STRIDE, BLOCK = 20, 128, 1 << 17


# --- codes


def code_lengths(counts: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most `limit` bits, by package-merge. Bounded by the vocabulary."""
    if len(counts) < 2:
        return dict.fromkeys(counts, 1)
    if len(counts) > 1 << limit:
        raise ValueError("more symbols than codes of this length")
    weight = sorted((n, i) for i, n in counts.items())
    order = np.array([i for _, i in weight])
    singles = np.array([n for n, _ in weight], float)
    # a package is the pair of rows it was made of; lengths follow from how many items each level takes
    levels = [(singles, np.ones(len(singles), bool))]
    for _ in range(limit - 1):
        last = levels[-1][0]
        packed = last[: len(last) // 2 * 2].reshape(-1, 2).sum(1)
        value = np.concatenate([singles, packed])
        by = np.argsort(value, kind="stable")
        levels.append((value[by], (by < len(singles))))
    length = np.zeros(len(singles), int)
    take = 2 * len(singles) - 2
    for _, single in reversed(levels):
        n = int(single[:take].sum())
        length[:n] += 1
        take = 2 * (take - n)
    return dict(zip(order.tolist(), length.tolist(), strict=True))


class Code:
    """Canonical code of given lengths."""

    def __init__(self, lengths: dict[int, int]):
        top = max(lengths, default=0)
        self.bits = np.zeros(top + 1, np.uint8)
        self.code = np.zeros(top + 1, np.uint64)
        self.longest = max(lengths.values(), default=1)
        self.symbol = np.zeros(1 << self.longest, np.int32)
        self.width = np.ones(1 << self.longest, np.uint8)
        code, last = 0, 0
        for symbol in sorted(lengths, key=lambda s: (lengths[s], s)):
            n = lengths[symbol]
            code <<= n - last
            last = n
            self.bits[symbol], self.code[symbol] = n, code
            free = self.longest - n
            self.symbol[code << free : (code + 1) << free] = symbol
            self.width[code << free : (code + 1) << free] = n
            code += 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the offset of each STRIDE-th id."""
        width = self.bits[ids].astype(np.int64)
        at = np.cumsum(width) - width
        total = int(at[-1] + width[-1]) if len(ids) else 0
        lanes = np.zeros(total // 64 + 2, np.uint64)
        lane, inside = at >> 6, at & 63
        room = 64 - inside - width
        code = self.code[ids]
        head = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        if len(ids):
            first = np.flatnonzero(np.append(True, lane[1:] != lane[:-1]))
            lanes[lane[first]] = np.bitwise_or.reduceat(head, first)
            over = room < 0
            lanes[lane[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
        return lanes.astype(">u8").tobytes()[: (total + 7) // 8], at[::STRIDE]

    def decode(self, bits: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """n ids: all stretches between checkpoints advance together, an id a step."""
        data = np.frombuffer(bits + bytes(8), np.uint8)
        out = np.zeros((len(checkpoints), STRIDE), np.int32)
        at = checkpoints.astype(np.int64)
        end = 8 * len(bits)
        # 32 bits from every byte on
        d = data.astype(np.uint32)
        window = (d[:-3] << np.uint32(24)) | (d[1:-2] << np.uint32(16)) | (d[2:-1] << np.uint32(8)) | d[3:]
        mask, drop = np.uint32((1 << self.longest) - 1), 32 - self.longest
        for k in range(STRIDE):
            key = (window[at >> 3] >> (drop - (at & 7)).astype(np.uint32)) & mask
            out[:, k] = self.symbol[key]
            at = np.minimum(at + self.width[key], end)
        return out.reshape(-1)[:n]


# --- encoding texts


def byte_letters() -> dict[int, str]:
    """The letters that byte-level tokenizers write bytes in: printable ones stand for themselves, the others follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Library:
    """Ids of texts as the tokenizers library makes them. A byte-level tokenizer without a normalizer gives a word the ids that its
    model gives the word's bytes in byte letters, so each distinct word is asked for once; texts with added tokens in them, and
    all texts of other tokenizers, go to the library as they are."""

    def __init__(self, spec: str, pattern: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        made = json.loads(spec)
        before = made["pre_tokenizer"] or {}
        plain = made["normalizer"] is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space")
        self.letters = byte_letters()
        controls = tuple(x["content"] for x in made.get("added_tokens") or ())
        self.words = TextIds(pattern, self.learn, controls, self.whole) if plain else None

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        merge, letters = self.tokenizer.model.tokenize, self.letters
        made = [merge(w.encode().decode("latin-1").translate(letters)) for w in words]
        return np.array([t.id for x in made for t in x], np.uint32), np.fromiter(map(len, made), np.int64, len(made))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each has."""
        if self.words:
            return self.words.ids(texts)
        got = [self.whole(x or "") for x in texts.to_pylist()]
        return np.concatenate([*got, np.empty(0, np.uint32)]), np.fromiter(map(len, got), np.int64, len(got))


_made: dict[int, Library] = {}


def _library(shared) -> Library:
    """The process's tokenizer; what it knows is bounded and stays for the next tasks."""
    spec, pattern = shared.value
    key = hash((spec, pattern))
    if key not in _made:
        _made.clear()
        _made[key] = Library(spec, pattern)
    return _made[key]


#: Rows of a task's counts: each has the counts of so many ids, packed.
SLICE = 4096


def _count_rows(total: np.ndarray, task: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """(bucket, -1 - slice, packed counts) of the slices of `total` that aren't empty, dealt over the buckets."""
    slices = [total[i : i + SLICE] for i in range(0, len(total), SLICE)]
    return [((task + k) % buckets, -1 - k, x.astype("<i8").tobytes()) for k, x in enumerate(slices) if x.any()]


def _staged(df: DataFrame, path: str, text: str, key: str, end: int, buckets: int) -> DataFrame:
    """(bucket, doc_id, n, ids, place): ids compressed; rows of a bucket in order, place counts the ids before. Besides the
    documents' rows, each task leaves rows with the counts of the ids that it made; n is below 0 there (see _count_rows)."""
    import public_tokenizers

    spark = df.sparkSession
    with open(path, encoding="utf-8") as f:  # a bounded vocabulary, read on the driver
        shared = spark.sparkContext.broadcast((f.read(), public_tokenizers.PATTERN))
    source = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    bounds = np.array(sorted({int(x) for x in source.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else [], np.int64)
    names = ["bucket", "doc_id", "n", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        squeeze, total = zstandard.ZstdCompressor(level=1).compress, np.zeros(0, np.int64)
        library = _library(shared)
        for whole in batches:
            for part in parts(whole):
                ids, size = library.ids(part.column(1))
                begin = np.cumsum(size + 1) - size - 1
                # every document's ids, then the end id
                out = np.full(len(ids) + len(size), end, "<u4")
                out[np.arange(len(ids)) + np.repeat(np.arange(len(size)), size)] = ids
                own = np.bincount(out)
                total = own + np.pad(total, (0, max(0, len(own) - len(total))))[: len(own)] if len(own) >= len(total) else total + np.pad(own, (0, len(total) - len(own)))
                least = np.iinfo(np.int64).min
                bucket = np.searchsorted(bounds, part.column(0).fill_null(least).to_numpy(), side="right").astype(np.int32)
                packed = [squeeze(_narrow(out[a : a + n])) for a, n in zip(begin.tolist(), (size + 1).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), part.column(0), pa.array(size + 1), pa.array(packed, pa.binary())], names=names)
        rows = _count_rows(total, TaskContext.get().partitionId(), len(bounds) + 1)
        if rows:
            where, slices, counts = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.nulls(len(rows), pa.int64()), pa.array(slices, pa.int64()), pa.array(counts, pa.binary())], names=names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at = None, 0
        for batch in batches:
            bucket, n = (batch.column(k).to_numpy() for k in (0, 2))
            n = np.maximum(n, 0)
            if len(bucket):
                before = np.cumsum(n) - n
                first = np.append(True, bucket[1:] != bucket[:-1])
                base = np.where(first, before, 0)
                start = before - np.maximum.accumulate(base) + np.where(np.cumsum(first) == 1, at if bucket[0] == now else 0, 0)
                now, at = bucket[-1], int(start[-1] + n[-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start, pa.int64())], names=[*names, "place"])

    made = source.mapInArrow(run, "bucket int, doc_id long, n long, ids binary")
    dealt = made.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "ids")
    return materialise(dealt.mapInArrow(place, "bucket int, doc_id long, n long, ids binary, place long"), "ids")


def _narrow(ids: np.ndarray) -> bytes:
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\x04" + ids.tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u2" if data[0] == 2 else "<u4", offset=1).astype(np.int64)


def write(df: DataFrame, folder: str, tokenizer: str, *, text: str = "text", key: str = "doc_id", end: int = 0, buckets: int | None = None) -> None:
    """Encode every text and write the folder."""
    spark = df.sparkSession
    buckets = buckets or max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    staged = _staged(df, tokenizer, text, key, end, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for n, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(x, "<i8")
                mine = totals.setdefault(-1 - n, np.zeros(SLICE, np.int64))
                mine[: len(own)] += own
        for k, x in totals.items():
            ids = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(ids + k * SLICE, pa.int64()), pa.array(x[ids], pa.int64())], names=["id", "n"])

    counted = staged.filter("n < 0").select("n", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = {r.id: r.n for r in counted.collect()}  # no more rows than the vocabulary has
    lengths = code_lengths(counts)
    spark.createDataFrame([(i, n) for i, n in sorted(lengths.items())], "id long, bits int").coalesce(1).write.parquet(f"{folder}/codes")
    code = spark.sparkContext.broadcast(Code(lengths))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        loosen = zstandard.ZstdDecompressor().decompress
        now, at, held, size = None, 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal at, held, size
            ids = np.concatenate([x for _, x in held])
            bits, marks = code.value.encode(ids)
            row = [(now, at, len(ids), [d for d, _ in held], [len(x) for _, x in held], bits, marks.tolist())]
            at, held, size = at + size, [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*row, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["bucket", "start", "n", "doc_ids", "sizes", "bits", "checkpoints"])

        for batch in batches:
            for bucket, place, doc, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now or place != at + size:
                    if held:
                        yield close()
                    now, at = bucket, place
                held.append((doc, _wide(loosen(x))))
                size += len(held[-1][1])
                if size >= BLOCK:
                    yield close()
        if held:
            yield close()

    staged.filter("n > 0").select("bucket", "place", "doc_id", "ids").mapInArrow(blocks, "bucket int, start long, n long, doc_ids array<long>, sizes array<long>, bits binary, checkpoints array<long>").write.parquet(f"{folder}/blocks")
    discard(staged)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    lengths = {r.id: r.bits for r in spark.read.parquet(f"{folder}/codes").collect()}  # no more rows than the vocabulary has
    code = spark.sparkContext.broadcast(Code(lengths))
    blocks = spark.read.parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, start, n, docs, sizes, bits, marks = (c[k].as_py() for c in batch.columns)
                ids = code.value.decode(bits, np.array(marks, np.int64), n).astype("<u4")
                ends = np.cumsum(sizes)
                begins = ends - np.array(sizes)
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array([bucket] * len(docs), pa.int32()), pa.array(begins + start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "bucket", "place", "n_tokens", "ids_crc32"])

    rows = blocks.select("bucket", "start", "n", "doc_ids", "sizes", "bits", "checkpoints").mapInArrow(run, "doc_id long, bucket int, place long, n_tokens long, ids_crc32 long")
    # one row a bucket; their number is a parameter
    totals = blocks.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = totals.select("bucket", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(before, "bucket").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
