"""Near-duplicates: MinHash bands propose pairs, sequential Bayesian verification prunes them, exact sets confirm them.

1. Every text becomes its set of word shingles (64-bit hashes), a signature of minima under `permutations` hash functions
   and one key for each band of `rows` minima. Texts with equal sets make one class; classes are the nodes.
2. In each band bucket every node is compared with the bucket's least node only (a star), at first with one leader each.
   Components of the confirmed links follow; further leaders are tried where the ends still lie apart.
3. Buckets whose nodes still lie in several components are settled in tiles of bounded size inside a task: pairs across
   components are verified and confirmed there, and only links that join two components leave it. So no group is expanded
   into its pairs, and no candidate pair that could join two components is left out.

Verification compares signatures in batches of `batch` minima. With a uniform prior for the similarity, m equal minima of n
leave P(similarity >= t | m, n) = P(Binomial(n + 1, t) <= m); a pair is dropped once that is below `miss` divided by the number
of batches, so that all looks together stay within `miss`.

Defined results: null and blank texts have an empty set, link with nothing and are their own component. Fewer words than a
shingle make the whole sequence one shingle. Rows that share a doc_id are linked only by their texts. The component's id is
its least doc_id; nulls come last. Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsymbol.llm.common import give_back, materialise, spare
from tsymbol.llm.components import components

U64 = np.uint64


@dataclass(frozen=True)
class Near:
    """percent: least Jaccard similarity, of 100; shingle: words; permutations: minima of a signature; band_miss: largest
    chance that a pair of just that similarity shares no band; miss: that of a wrong drop in verification, all batches together;
    tile, tile_items: nodes and shingles that a part of a bucket holds on average, two parts making a tile."""

    percent: int = 80
    shingle: int = 5
    permutations: int = 256
    band_miss: float = 1e-5
    miss: float = 1e-5
    batch: int = 32
    tile: int = 1024
    tile_items: int = 4_000_000
    seed: int = 11

    @property
    def rows(self) -> int:
        """The most minima a band can have at the chosen miss probability."""
        t = self.percent / 100
        fits = [r for r in range(1, 33) if (1 - t**r) ** (self.permutations // r) <= self.band_miss]
        return max(fits, default=1)


class _Hash(dict):
    """64-bit hashes of words; forgets all when it gets large."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 150_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_words = _Hash()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def shingles(texts: list[bytes], n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and the number of each text's."""
    split = [x.lower().split() for x in texts]
    size = np.fromiter(map(len, split), np.int64, len(split))
    word = np.array([_words[w] for x in split for w in x], U64)
    factor = np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * U64(2) + U64(1)
    begin = np.cumsum(size) - size
    count = np.where(size >= n, size - n + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(split)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + begin[doc]
    short = size[doc] < n
    total = np.full(len(doc), U64(0))
    for k in range(n):
        there = ~short | (k < size[doc])
        total[there] += _mix(word[at[there] + k] + U64(k + 1)) * factor[k]
    total = _mix(total + short * size[doc].astype(U64))  # a short sequence isn't the beginning of another
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    new = np.append(True, (total[1:] != total[:-1]) | (doc[1:] != doc[:-1]))[: len(doc)]
    return total[new], np.bincount(doc[new], minlength=len(split))


def signatures(flat: np.ndarray, size: np.ndarray, near: Near) -> np.ndarray:
    """Minima (uint32) of each set, one row a text; sets must not be empty."""
    rng = np.random.default_rng(near.seed)
    a = rng.integers(0, 1 << 31, near.permutations, np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 1 << 32, near.permutations, np.uint32)
    x = (flat >> U64(32)).astype(np.uint32)
    begin = np.cumsum(size) - size
    out = np.empty((near.permutations, len(size)), np.uint32)
    cuts = np.searchsorted(begin, np.arange(0, len(x), 65536))  # parts that stay in the processor's cache
    cuts = np.unique(np.append(cuts, len(size)))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        part = x[begin[lo] : begin[hi] if hi < len(size) else len(x)]
        where, room = begin[lo:hi] - begin[lo], np.empty_like(part)
        for k in range(near.permutations):
            np.multiply(part, a[k], out=room)
            room += b[k]
            room ^= room >> np.uint32(15)
            out[k, lo:hi] = np.minimum.reduceat(room, where)
    return np.ascontiguousarray(out.T)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    bands = sig.shape[1] // rows
    parts = sig[:, : bands * rows].reshape(len(sig), bands, rows).astype(U64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(sig), bands)).copy()
    for k in range(rows):
        out = _mix(out ^ (parts[:, :, k] + U64(0x9E3779B97F4A7C15)) * U64(2 * k + 3))
    return out.view(np.int64)


@lru_cache
def least_equal(percent: int, batch: int, permutations: int, miss: float) -> tuple[int, ...]:
    """After each batch, the fewest equal minima with which a pair goes on."""
    t, out, looks = percent / 100, [], range(batch, permutations + 1, batch)
    for n in looks:
        total, m = 0.0, -1
        while total < miss / len(looks):
            m += 1
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survives(a: np.ndarray, b: np.ndarray, near: Near) -> np.ndarray:
    """Which pairs of signature rows pass sequential verification."""
    live, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for k, least in enumerate(least_equal(near.percent, near.batch, near.permutations, near.miss)):
        part = slice(k * near.batch, (k + 1) * near.batch)
        equal = equal + (a[live, part] == b[live, part]).sum(1)
        fine = equal >= least
        live, equal = live[fine], equal[fine]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def similar(x: np.ndarray, y: np.ndarray, near: Near) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < near.percent * len(y):  # not even as a part
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= near.percent * (len(x) + len(y) - both)


def _text_parts(batch: pa.RecordBatch, most: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(batch.column(batch.num_columns - 1).to_pandas().str.len().to_numpy()) if batch.num_rows else []
    begun = 0
    while begun < batch.num_rows:
        before = size[begun - 1] if begun else 0
        stop = max(begun + 1, int(np.searchsorted(size, before + most, side="right")))
        yield batch.slice(begun, stop - begun)
        begun = stop


def _sketch(df: DataFrame, near: Near, text: str, key: str) -> DataFrame:
    """(doc_id, n, s1, s2, bands): s1 and s2 are two 64-bit sums over the set; bands are null for empty sets."""
    source = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("x"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n long, s1 long, s2 long, bands array<long>"
    rows = near.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _text_parts(whole):
                flat, size = shingles(part.column(1).to_pylist(), near.shingle, near.seed)
                full = np.flatnonzero(size)
                sums = np.zeros((2, len(size)), U64)
                bands = [None] * len(size)
                if len(full):
                    begin = (np.cumsum(size) - size)[full]
                    sums[0, full], sums[1, full] = np.add.reduceat(_mix(flat + U64(1)), begin), np.add.reduceat(_mix(flat ^ U64(0xABCDEF)), begin)
                    keys = band_keys(signatures(flat, size[full], near), rows)
                    for i, k in enumerate(full):
                        bands[k] = keys[i]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "bands"])
        give_back()

    return source.mapInArrow(run, schema)


def _confirm(edges: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The edges(u, v) that pass sequential verification and whose sets are similar enough."""
    a, b = (sets.select(F.col("node").alias(x), F.col("sig").alias(f"{x}_sig"), F.col("items").alias(f"{x}_items")) for x in "uv")
    rows = edges.join(a, "u").join(b, "v").select("u", "v", "u_sig", "v_sig", "u_items", "v_items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            u_sig, v_sig = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for k in (2, 3))
            passed = np.flatnonzero(survives(u_sig, v_sig, near))
            linked = []
            for k in passed.tolist():
                if similar(*(np.frombuffer(batch.column(c)[k].as_py(), U64) for c in (4, 5)), near):
                    linked.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).take(pa.array(linked, pa.int64()))
        give_back()

    return rows.mapInArrow(run, "u long, v long")


def _settle(open_: DataFrame, near: Near) -> DataFrame:
    """From (key, cx, cy, side, node, comp, sig, items), tile by tile: exact links that join two components.

    A tile keeps the components of its nodes. Pairs within one aren't compared; of the others, those that pass sequential
    verification are confirmed by their sets, the most alike first, and a link merges its components at once. So a tile gives
    fewer links than it has nodes, however many pairs are similar."""
    rows = open_.repartition("key", "cx", "cy").sortWithinPartitions("key", "cx", "cy", "side", "node").select("key", "cx", "cy", "side", "node", "comp", "sig", "items")

    def links(held: list[tuple], square: bool) -> list[tuple[int, int]]:
        side, node, comp, sig, items = zip(*held, strict=True)
        m = np.frombuffer(b"".join(sig), np.uint16).reshape(len(sig), -1)
        side, comp, out = np.array(side), np.array(comp), []
        right = np.arange(len(node)) if square else np.flatnonzero(side == 1)
        for i in np.arange(len(node)) if square else np.flatnonzero(side == 0):
            other = right[right > i] if square else right
            other = other[comp[other] != comp[i]]
            if not len(other):
                continue
            other = other[survives(np.broadcast_to(m[i], (len(other), m.shape[1])), m[other], near)]
            for k in other[np.argsort(-(m[other] == m[i]).sum(1), kind="stable")].tolist():
                if comp[k] != comp[i]:
                    if similar(np.frombuffer(items[i], U64), np.frombuffer(items[k], U64), near):
                        out.append((node[i], node[k]))
                        comp[comp == comp[k]] = comp[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        tile = None

        def close() -> Iterator[pa.RecordBatch]:
            if len(held) > 1 and (made := links(held, tile[1] == tile[2])):
                u, v = (np.array(x, np.int64) for x in zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

        for batch in batches:
            for key, cx, cy, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, cx, cy) != tile:
                    yield from close()
                    held, tile = [], (key, cx, cy)
                held.append(tuple(rest))
        yield from close()
        held.clear()
        give_back()

    return rows.mapInArrow(run, "u long, v long").distinct()


def link(df: DataFrame, near: Near | None = None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of df."""
    near = near or Near()
    sketch = materialise(_sketch(df, near, text, key), "near-sketch")
    full = sketch.filter("n > 0")
    classes = full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("node"), "n", "s1", "s2", "rep", "bands"), "near-classes")
    member = classes.select("node", "n", F.explode("bands").alias("key"))
    shared = materialise(member.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("items")).filter("size > 1"), "near-buckets")
    chunks = F.ceil(F.greatest(F.col("size") / near.tile, F.col("items") / near.tile_items)).cast("int").alias("chunks")
    member = materialise(member.drop("n").join(shared.select("key", "leader", "size", chunks), "key"), "near-members")
    star = member.filter("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    # exact sets of the nodes that share a bucket, from the texts of one row each
    ids = member.select("node").distinct().join(classes.select("node", "rep", "n", "s1", "s2"), "node")
    texts = df.select(F.col(key).alias("rep"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("x"))
    sets = materialise(_pick(ids, texts, near), "near-sets")
    first = star.groupBy("u").agg(F.min("v").alias("v"))
    links = materialise(_confirm(first, sets, near), "near-links")
    comp = materialise(components(links), "near-components")
    apart = lambda edges: edges.join(comp.select(F.col("node").alias("u"), F.col("comp").alias("cu")), "u", "left").join(comp.select(F.col("node").alias("v"), F.col("comp").alias("cv")), "v", "left").filter(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")
    more = materialise(_confirm(apart(star.join(first, ["u", "v"], "left_anti")), sets, near), "near-links")
    links = links.unionAll(more)
    comp = materialise(components(links), "near-components")
    # what is still apart within a bucket
    now = member.join(comp, "node", "left").select("key", "node", "size", "chunks", F.coalesce("comp", "node").alias("comp"))
    mixed = now.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a <> b and a is not null").select("key")
    mixed = materialise(mixed, "near-mixed")  # so that the join with it is no part of the aggregate's stage and can split a hot bucket
    # a bucket of two was compared whole as a star
    left = now.filter("size > 2").join(mixed, "key").join(sets, "node")
    mine = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    left = left.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    open_ = left.select("key", F.least("mine", "other").alias("cx"), F.greatest("mine", "other").alias("cy"), F.when(F.col("mine") <= F.col("other"), 0).otherwise(1).alias("side"), "node", "comp", "sig", "items")
    found = materialise(_settle(open_, near), "near-links")
    if not found.isEmpty():
        links = links.unionAll(found)
        comp = materialise(components(links), "near-components")
    named = classes.select("node", "n", "s1", "s2", "rep").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("rep").alias("least"))
    named = named.join(least, "comp").select("n", "s1", "s2", "least")
    out = sketch.select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _pick(ids: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """(node, sig, items) of ids(node, rep, n, s1, s2): of the rows with that id, the one with that set. The signature's minima are
    kept to 16 bits, items are the sorted shingle hashes."""
    rows = ids.join(texts, ids.rep.eqNullSafe(texts.rep)).select("node", ids.n, "s1", "s2", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in _text_parts(whole):
                flat, size = shingles(part.column(4).to_pylist(), near.shingle, near.seed)
                sets = np.split(flat, np.cumsum(size)[:-1]) if len(size) else []
                want = [np.array(part.column(k).to_pylist(), np.int64) for k in (1, 2, 3)]
                fits = np.array([len(x) == want[0][i] and np.add.reduce(_mix(x + U64(1))).view(np.int64) == want[1][i] and np.add.reduce(_mix(x ^ U64(0xABCDEF))).view(np.int64) == want[2][i] for i, x in enumerate(sets)], bool)
                chosen = [x for x, ok in zip(sets, fits, strict=True) if ok]
                sig = signatures(np.concatenate(chosen), size[fits], near).astype(np.uint16) if chosen else []
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(fits)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array([x.tobytes() for x in chosen], pa.binary())], names=["node", "sig", "items"])
        give_back()

    return rows.mapInArrow(run, "node long, sig binary, items binary").dropDuplicates(["node"])


def dedup(df: DataFrame, near: Near | None = None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of df that are kept: of each component, those with the least id."""
    (mark,) = spare(df, "kept_id")
    kept = link(df, near, text=text, key=key).filter("kept").select(F.col("doc_id").alias(mark)).distinct()
    return df.join(kept, F.col(key).eqNullSafe(F.col(mark)), "left_semi")
