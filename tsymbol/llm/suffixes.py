"""A suffix array over many sequences at once, by distributed prefix doubling, and what its LCP intervals say.

Every element of all sequences has a place (`gid`; a sequence's places are consecutive and in order). Ranks are numbers of rows
before in a global sort: rows are dealt by ranges of their keys with the place as the last key, so that equal keys, however
many, spread over partitions; each partition numbers its rows in a stream, and a few numbers of each partition give the rest.

Suffixes that begin with an element that occurs once have no LCP with any other and are left out, except as second keys of the
suffix before. Round k sorts the suffixes whose first 2**k elements occur elsewhere by (rank, rank of the suffix 2**k on); a
suffix that ends there comes first. What is then alone has its final rank and keeps the ranks of its rounds: two suffixes
share 2**k elements where their ranks of round k are equal. So the LCP of neighbours is read off by descending powers of two.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsymbol.llm.common import discard, materialise, own, shared_path

#: Suffixes of one row of packed neighbours.
CHUNK = 50_000
#: Rows of a partition of the later rounds.
ROWS = 50_000
_FAR = 1 << 62


def _same(batch: pa.RecordBatch, columns: list[int], last: tuple | None) -> np.ndarray:
    """Whether each row's values in these columns equal those of the row before."""
    out = np.ones(batch.num_rows, bool)
    for n, c in enumerate(columns):
        x = batch.column(c).to_numpy()
        out[1:] &= x[1:] == x[:-1]
        out[0] &= last is not None and x[0] == last[n]
    return out


def _parts(session: SparkSession, rows: int | None) -> int:
    """Partitions for so many rows; the session's number where that isn't known."""
    most = int(session.conf.get("spark.sql.shuffle.partitions"))
    return most if rows is None else max(1, min(most, -(-rows // ROWS)))


def ranked(df: DataFrame, keys: list[str], name: str, rows: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """df's rows with `outer` and `inner`, the numbers of rows before the first one with the same first key, and with the same
    keys; `at`, the number of rows before; and `tied`, whether other rows have the same keys. With it the table that it reads,
    and the number of rows. keys: numbers that aren't null; gid, the last one, is unique. rows: about how many df has."""
    session = df.sparkSession
    columns = df.columns
    key_at = [columns.index(k) for k in keys]
    dealt = df.repartitionByRange(_parts(session, rows), *keys, "gid").sortWithinPartitions(*keys, "gid")
    local = ["part_", "i_", "outer_", "inner_", "back_", "ahead_", "last_"]
    kinds = [T.IntegerType(), *[T.LongType()] * 3, *[T.BooleanType()] * 3]
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, kind, False) for c, kind in zip(local, kinds, strict=True))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, i, outer, inner, last, held = TaskContext.get().partitionId(), 0, 0, 0, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            same = [_same(batch, key_at[:m], last) for m in (1, len(keys))]
            at = np.arange(i, i + n)
            first = [np.maximum.accumulate(np.where(s, begun, at)) for s, begun in zip(same, (outer, inner), strict=True)]
            if held is not None:
                yield done(held, part, bool(same[1][0]), False)
            held = (batch, at, first[0], first[1], same[1])
            i, outer, inner = i + n, int(first[0][-1]), int(first[1][-1])
            last = tuple(batch.column(c)[n - 1].as_py() for c in key_at)
        if held is not None:
            yield done(held, part, False, True)

    def done(held: tuple, part: int, goes_on: bool, end: bool) -> pa.RecordBatch:
        batch, at, outer, inner, back = held
        last = np.zeros(len(at), bool)
        last[-1] = end
        more = [pa.array(np.full(len(at), part, np.int32)), *map(pa.array, (at, outer, inner, back, np.append(back[1:], goes_on), last))]
        return pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, *local])

    made = materialise(dealt.mapInArrow(number, schema), name)
    # the first and the last row of each partition; where a key began before its partition, its first row is there
    ends: dict[int, list] = {}
    for r in made.filter("i_ = 0 or last_").select("part_", "i_", "outer_", "inner_", "last_", *keys).collect():
        mine = ends.setdefault(r["part_"], [None, None])
        if r["i_"] == 0:
            mine[0] = r
        if r["last_"]:
            mine[1] = r
    before, carried, known = 0, [0, 0], None
    table: list[list] = []
    for part in sorted(ends):
        first, last = (tuple(r[k] for k in keys) for r in ends[part])
        begun = [known is not None and known[:m] == first[:m] for m in (1, len(keys))]
        if begun[1]:
            table[-1][-1] = True
        table.append([part, before, carried[0] if begun[0] else before, carried[1] if begun[1] else before, begun[1], False])
        carried = [table[-1][2 + m] if ends[part][1][x] == 0 else before + ends[part][1][x] for m, x in enumerate(("outer_", "inner_"))]
        before, known = before + ends[part][1]["i_"] + 1, last
    sides = session.createDataFrame([tuple(x) for x in table] or [(0, 0, 0, 0, False, False)], "part_ int, before_ long, outer0_ long, inner0_ long, cameback_ boolean, goeson_ boolean")
    both = made.join(F.broadcast(sides), "part_")  # a row a partition
    place = lambda own, carried: F.when(F.col(own) == 0, F.col(carried)).otherwise(F.col("before_") + F.col(own))
    back = F.when(F.col("i_") == 0, F.col("cameback_")).otherwise(F.col("back_"))
    ahead = F.when(F.col("last_"), F.col("goeson_")).otherwise(F.col("ahead_"))
    out = both.select(*columns, place("outer_", "outer0_").alias("outer"), place("inner_", "inner0_").alias("inner"), (F.col("before_") + F.col("i_")).alias("at"), (back | ahead).alias("tied"))
    return out, made, before


def suffix_array(lines: DataFrame) -> tuple[DataFrame, int]:
    """From (gid, left, h1, h2 and others): the suffixes whose first element occurs more than once, with the columns of lines but
    the hashes, `rank` (their order) and `history`, their ranks of each round in which they still tied; and the number of rounds.
    left: elements from there to the end of the sequence. Equal suffixes go by place.

    All rounds' results stand in one folder; a row that isn't `tied` has its final rank."""
    session = lines.sparkSession
    rest = [c for c in lines.columns if c not in ("h1", "h2")]
    folder = shared_path(session, "suffixes")
    written = lambda: session.read.parquet(folder)
    sorted_, made, n = ranked(lines, ["h1", "h2"], "suffixes")
    first = sorted_.select(*rest, F.col("inner").alias("rank"), "tied")
    tied = first.filter("tied").select(*rest, "rank", F.array("rank").alias("history"), "tied")
    # unique elements behind repeated ones: second keys, but no rows of the array
    behind = first.filter("not tied").join(tied.filter("left > 1").select((F.col("gid") + 1).alias("gid")), "gid").select(*rest, "rank", F.array().cast("array<long>").alias("history"), "tied")
    tied.unionByName(behind).write.parquet(f"{folder}/round=0")
    discard(made)
    k, n = 0, written().count()
    while True:
        step, all_ = 1 << k, written()
        if (tied := all_.filter(F.col("tied") & (F.col("round") == k)).drop("tied", "round")).isEmpty():
            break
        second = all_.filter(~F.col("tied") | (F.col("round") == k)).select((F.col("gid") - step).alias("gid"), F.col("rank").alias("second"))
        pairs = tied.join(second, "gid", "left").withColumn("second", F.when(F.col("left") > step, F.col("second")).otherwise(F.lit(-1)))
        sorted_, made, n = ranked(pairs, ["rank", "second"], "suffixes", n)
        still = F.col("tied") & (F.col("second") >= 0)
        place = F.col("rank") + F.when(still, F.col("inner")).otherwise(F.col("at")) - F.col("outer")
        sorted_ = sorted_.select(*rest, place.alias("rank"), "history", still.alias("tied"))
        history = F.when(F.col("tied"), F.concat("history", F.array("rank"))).otherwise(F.col("history"))
        sorted_.withColumn("history", history).write.parquet(f"{folder}/round={k + 1}")
        discard(made)
        k += 1
    array = written().filter(~F.col("tied") & (F.size("history") > 0)).select(*rest, "rank", "history")
    return own(array, folder), k


def neighbours(array: DataFrame, rounds: int) -> DataFrame:
    """array's rows (without history) with `at`, their number in order, and `lcp`, the elements they share with the one before."""
    rest = [c for c in array.columns if c not in ("rank", "history")]
    sorted_, made, n = ranked(array, ["rank"], "suffix-order")
    rows = sorted_.select("at", *rest, "history")
    before = rows.select((F.col("at") + 1).alias("at"), F.col("gid").alias("x"), F.col("left").alias("x_left"), F.col("history").alias("x_history"))
    shared = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))  # noqa: E731  of nested classes
    power = lambda level: F.when(level > 0, F.pow(F.lit(2), level - 1)).otherwise(0).cast("long")
    pairs = rows.join(before, "at", "left").withColumn("level", F.coalesce(shared(F.col("history"), F.col("x_history")), F.lit(0)))
    pairs = materialise(pairs.select("at", *rest, "x", "x_left", "level", power(F.greatest("level", F.lit(0))).alias("lcp")), "suffix-neighbours")
    done, now = [pairs.filter("level < 2")], pairs.filter("level >= 2")
    held = [pairs]
    y, x = (rows.select(F.col("gid").alias(f"{n}_gid"), F.col("history").alias(f"{n}_history")) for n in "yx")
    for _ in range(rounds):
        if now.isEmpty():
            break
        # on from where they agree, at a lower power of two
        on = now.filter(F.col("lcp") < F.least("left", "x_left")).withColumn("y_gid", F.col("gid") + F.col("lcp")).withColumn("x_gid", F.col("x") + F.col("lcp"))
        met = on.join(y, "y_gid").join(x, "x_gid").select("at", F.least(shared(F.col("y_history"), F.col("x_history")), F.col("level") - 1).alias("lower"))
        after = now.join(met, "at", "left").withColumn("level", F.coalesce(F.greatest("lower", F.lit(0)), F.lit(0)))
        now = materialise(after.withColumn("lcp", F.col("lcp") + power(F.col("level"))).drop("lower").select(pairs.columns), "suffix-neighbours")
        held.append(now)
        done.append(now.filter("level < 2"))
        now = now.filter("level >= 2")
    out = materialise(reduce(DataFrame.unionAll, done).select("at", *rest, "lcp"), "suffix-lcp")
    for df in (*held, made):
        discard(df)
    return out


class Stairs:
    """Of the places passed on one side: (place, least LCP on the way from there), no place with a smaller one that shares as much.
    Both grow towards the end. It has no more steps than there are different LCPs on the way."""

    def __init__(self, steps: list[tuple[int, int]] = ()):
        self.places, self.lcps = [p for p, _ in steps], [v for _, v in steps]

    def cap(self, lcp: int) -> None:
        places, lcps = self.places, self.lcps
        while len(lcps) > 1 and lcps[-2] >= lcp:
            places.pop()
            lcps.pop()
        if lcps and lcps[-1] > lcp:
            lcps[-1] = lcp
        if lcp == 0:
            places.clear()
            lcps.clear()

    def meet(self, place: int) -> int:
        """The most elements that a smaller place shares with this one, which then joins them."""
        places, lcps = self.places, self.lcps
        while places and places[-1] > place:
            places.pop()
            lcps.pop()
        out = lcps[-1] if lcps else 0
        places.append(place)
        lcps.append(_FAR)
        return out

    def steps(self) -> list[tuple[int, int]]:
        return list(zip(self.places, self.lcps, strict=True))


def merged(near: list[tuple[int, int]], far: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Steps of both, without those that another makes useless."""
    out: list[tuple[int, int]] = []
    for lcp, place in sorted(((v, p) for p, v in [*near, *far] if v > 0), key=lambda x: (-x[0], x[1])):
        if not out or place < out[-1][0]:
            out.append((place, lcp))
    return out[::-1]


def earlier(places: list[int], lcps: list[int], left: list[tuple[int, int]] = (), right: list[tuple[int, int]] = ()) -> tuple[list[int], Stairs, Stairs]:
    """For suffixes in order: the most elements that each shares with one of a smaller place; and the stairs at both ends.
    left, right: what stands before and behind them."""
    stairs, best = Stairs(left), []
    for place, lcp in zip(places, lcps, strict=True):
        stairs.cap(lcp)
        best.append(stairs.meet(place))
    back = Stairs(right)
    for k in range(len(places) - 1, -1, -1):
        if (own := back.meet(places[k])) > best[k]:
            best[k] = own
        back.cap(lcps[k])
    return best, stairs, back


def longest_earlier(order: DataFrame) -> DataFrame:
    """From neighbours(): (gid, others, length): the most elements from each place on that also begin at an earlier place, where there are any.

    Rows are packed in order. Each pack says with which stairs it ends on both sides; the driver joins these, which are a few
    numbers a pack, to what each pack has before and behind it; then each pack is settled alone."""
    others = [c for c in order.columns if c not in ("at", "gid", "lcp", "left")]
    session = order.sparkSession
    parts = int(session.conf.get("spark.sql.shuffle.partitions"))
    rows = order.select("at", "gid", "lcp", *others).repartitionByRange(parts, "at").sortWithinPartitions("at")
    step = "array<struct<place:long,lcp:long>>"
    names = ["at", "gid", "lcp", *others]
    kinds = [np.dtype("<i8")] * len(names)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def close() -> pa.RecordBatch:
            nonlocal held, n
            columns = [np.concatenate([b.column(k).to_numpy() for b in held]).astype(kind) for k, kind in enumerate(kinds)]
            held, n = [], 0
            _, left, right = earlier(columns[1].tolist(), columns[2].tolist())
            stairs = [pa.array([[{"place": p, "lcp": v} for p, v in x.steps()]], pa.list_(pa.struct([("place", pa.int64()), ("lcp", pa.int64())]))) for x in (left, right)]
            return pa.RecordBatch.from_arrays([pa.array([int(columns[0][0])]), pa.array([int(columns[2].min())]), *stairs, *(pa.array([x.tobytes()], pa.binary()) for x in columns)], names=["first", "least", "ends", "begins", *names])

        for batch in batches:
            for i in range(0, batch.num_rows, CHUNK):
                part = batch.slice(i, CHUNK)
                held.append(part)
                n += part.num_rows
                if n >= CHUNK:
                    yield close()
        if n:
            yield close()

    packs = materialise(rows.mapInArrow(pack, f"first long, least long, ends {step}, begins {step}, {', '.join(f'{c} binary' for c in names)}"), "suffix-packs")
    sides = sorted(packs.select("first", "least", "ends", "begins").collect(), key=lambda r: r["first"])
    capped = lambda steps, least: [(p, min(v, least)) for p, v in steps]
    before, behind, carry = [], [], []
    for r in sides:
        before.append(carry)
        carry = merged([tuple(x) for x in r["ends"]], capped(carry, r["least"]))
    carry = []
    for r in reversed(sides):
        behind.append(carry)
        carry = merged([tuple(x) for x in r["begins"]], capped(carry, r["least"]))
    known = session.createDataFrame([(r["first"], a, b) for r, a, b in zip(sides, before, reversed(behind), strict=True)], f"first long, before {step}, behind {step}")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = ([(x["place"], x["lcp"]) for x in batch.column(c)[k].as_py()] for c in (0, 1))
                columns = [np.frombuffer(batch.column(c)[k].as_py(), "<i8") for c in range(2, 2 + len(names) - 1)]
                best = np.array(earlier(columns[0].tolist(), columns[1].tolist(), left, right)[0], np.int64)
                found = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[found]) for j, c in enumerate(columns) if j != 1), pa.array(best[found])], names=["gid", *others, "length"])

    packed = packs.join(known, "first").select("before", "behind", *names[1:])
    return packed.mapInArrow(settle, f"gid long, {', '.join(f'{c} long' for c in others)}{', ' if others else ''}length long")
