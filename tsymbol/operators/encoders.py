"""Encodings of symbol sequences: rows (doc, seq array<string>). Matrices are kept long, (doc, token or id, value); dense() pads them out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsymbol.functions.columns import first_or_last, grams, padded
from tsymbol.sources import shared


def truncate(df: DataFrame, n: int = 10, side: str = "post") -> DataFrame:
    if n <= 0:
        raise ValueError("n must be above 0")
    return df.withColumn("seq", first_or_last(F.col("seq"), n, side))


def pad(df: DataFrame, n: int = 10, value: str | int = "last", method: str = "post", truncating: str = "pre") -> DataFrame:
    """Sequences of numbers to n elements; value: first, last, none (-1) or a number. Empty sequences have only -1 to take."""
    if n <= 0:
        raise ValueError("n must be above 0")
    if method not in ("pre", "post"):
        raise ValueError("method is pre or post")
    s = F.col("seq").cast("array<int>")
    fill = {"first": F.get(s, F.lit(0)), "last": F.try_element_at(s, F.lit(-1)), "none": F.lit(-1)}.get(value, F.lit(value if not isinstance(value, str) else -1))
    fill = F.when(F.size(s) == 0, F.lit(-1)).otherwise(fill)
    return df.withColumn("seq", padded(first_or_last(s, n, truncating), n, fill, method))


def tokens(df: DataFrame) -> DataFrame:
    """(doc, pos, token), a row a token."""
    return df.select("doc", F.posexplode("seq").alias("pos", "token"))


def token_counts(df: DataFrame) -> DataFrame:
    """(doc, token, n, pos): how often a document has a token, and where first. What needs tokens per document begins here, so
    that Spark reuses the one exchange and no text is cut up twice."""
    return tokens(df).groupBy("doc", "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))


#: Tokens that are coded at once.
PART = 1 << 21


def coded(df: DataFrame, *, every: bool = False, only_tokens: bool = False) -> DataFrame:
    """A table of two kinds of rows, made in one pass over df. Tokens get codes within their part of the sequences: rows
    (part, code, token, n, doc, pos) say how often a part has a token and where first, rows (part, doc, codes, counts) the
    codes of a sequence, each once, or with `every` all in order. So texts are cut up once, and later steps move a token once a part."""
    schema = T.StructType([T.StructField("part", T.LongType()), df.schema["doc"], *T._parse_datatype_string("code int, token string, n bigint, pos int, codes array<int>, counts array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        types, part = to_arrow_schema(schema), TaskContext.get().partitionId() << 32

        def rows(length: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(length, f.type) for f in types], schema=types)

        def lists(off: np.ndarray, values: np.ndarray) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, pa.int32()))

        for batch in batches:
            upto = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PART, side="right")))
                docs, seq = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                sizes = np.diff(upto[a:b], prepend=upto[a - 1] if a else 0)
                a, begin, flat = b, np.cumsum(sizes) - sizes, seq.flatten().dictionary_encode(null_encoding="encode")
                codes, k = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(flat.dictionary)
                row = np.repeat(np.arange(len(sizes)), sizes)
                # documents in ascending order, the last first: what is written last is where a token is first
                order = pc.sort_indices(docs, null_placement="at_start").to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                by = np.argsort(rank[row], kind="stable")[::-1]
                first = np.empty(k, np.int64)
                first[codes[by]] = by
                if k:
                    yield rows(k, part=pa.array(np.full(k, part)), code=pa.array(np.arange(k)), token=flat.dictionary, n=pa.array(np.bincount(codes, minlength=k)), doc=docs.take(pa.array(row[first])), pos=pa.array(first - begin[row[first]]))
                if not only_tokens:
                    if every:
                        own, counts = lists(np.append(begin, len(codes)), codes), None
                    else:
                        cells, ns = np.unique(row * k + codes, return_counts=True)
                        off = np.searchsorted(cells, np.arange(len(sizes) + 1) * k)
                        own, counts = lists(off, cells % max(k, 1)), lists(off, ns)
                    yield rows(len(sizes), part=pa.array(np.full(len(sizes), part)), doc=docs, codes=own, **({} if every else {"counts": counts}))
                part += 1

    return shared.materialise(df.select("doc", "seq").mapInArrow(run, schema), "coded")


def _found(table: DataFrame) -> DataFrame:
    return table.filter("codes is null").select("part", "code", "token", "doc", "pos", "n")


def _met(table: DataFrame, known: DataFrame, make: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType, *columns: str) -> DataFrame:
    """make(sequences, tokens) for each part: its rows (doc, codes, columns) and the rows of `known` for its codes."""
    sequences = table.filter("codes is not null").select("part", "doc", "codes", *columns)
    tokens_ = _found(table).select(F.col("part").alias("of"), "code", "token").join(known, "token").drop("token")
    return sequences.groupBy("part").cogroup(tokens_.groupBy("of")).applyInArrow(make, schema)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of all lists one after the other, and the row of each."""
    one = lists.combine_chunks()
    return one.flatten().to_numpy(), np.repeat(np.arange(len(one)), one.value_lengths().to_numpy())


def _repeats(df: DataFrame) -> bool:
    """Whether a document has several rows; such tables take the plans by joins, which bring them together."""
    return bool(df.groupBy("doc").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").limit(1).count())


def _cells(df: DataFrame, words: DataFrame | None, value: bool) -> DataFrame:
    """(doc, id, value): a row for each token of a document, with its count in the whole corpus, or 1."""
    table = coded(df)
    known = _vocabulary(df, _found(table)) if words is None else words.join(_found(table).groupBy("token").agg(F.sum("n").alias("n")), "token") if value else words
    known = known.select("token", "id", *(["n"] if value else []))
    schema = T.StructType([df.schema["doc"], known.schema["id"], T.StructField("value", T.DoubleType())])

    def make(sequences: pa.Table, tokens_: pa.Table) -> pa.Table:
        codes, row = _flat(sequences["codes"])
        code = tokens_["code"].to_numpy()
        place = np.full(max(codes.max(initial=-1), code.max(initial=-1)) + 1, -1)
        place[code] = np.arange(len(code))
        at = place[codes]
        row, at = pa.array(row[at >= 0]), pa.array(at[at >= 0])
        values = tokens_["n"].cast(pa.float64()).take(at) if value else pa.array(np.ones(len(at)))
        return pa.table([sequences["doc"].take(row), tokens_["id"].take(at), values], names=[f.name for f in schema])

    return _met(table, known, make, schema)


def _vocabulary(df: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, id, n): ids from 1 by first appearance, counts in the whole corpus.

    Tokens are numbered by ranges of the document that they first appear in; the ranges' bounds are a sample of documents by
    hash, and a number a range is added up, so that no task sees the whole vocabulary."""
    whole = isinstance(df.schema["doc"].dataType, T.IntegralType)
    # one number in place of a struct, whose least value Spark finds by sorting all rows
    at = F.col("doc").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos").cast("decimal(10,0)") if whole else F.struct("doc", "pos")
    found = counts.groupBy("token").agg(F.min(at).alias("at"), F.sum("n").alias("n"))
    doc = F.floor(F.col("at") / F.lit(1 << 31).cast("decimal(10,0)")).cast(df.schema["doc"].dataType) if whole else F.col("at.doc")
    found = shared.materialise(found.withColumn("doc", doc), "found")  # else its counts and its numbers would both work it out
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(r[0] for r in df.select("doc").filter("doc is not null").orderBy(F.xxhash64("doc"), "doc").limit(min(ranges, MOST_RANGES)).collect())
    below = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x <= F.col("doc"))) if bounds else F.lit(0)
    own = Window.partitionBy("part").orderBy("at")
    rows = found.withColumn("part", F.coalesce(below, F.lit(-1))).withColumn("own", F.row_number().over(own))
    sizes = found.withColumn("part", F.coalesce(below, F.lit(-1))).groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), "part").select("token", (F.col("before") + F.col("own")).cast("int").alias("id"), "n")  # a row a range


#: Ranges of documents in which tokens are numbered.
MOST_RANGES = 1000


def dictionary(df: DataFrame) -> DataFrame:
    """(token, id): ids from 1 by first appearance."""
    return _vocabulary(df, _found(coded(df, only_tokens=True))).select("token", "id")


def corpus_size(df: DataFrame) -> DataFrame:
    return tokens(df).agg((F.countDistinct("token") + 1).alias("corpus_size"))


def symbol_counts(df: DataFrame) -> DataFrame:
    return tokens(df).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def categorical(df: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(doc, ids): sequences of ids."""
    if not _repeats(df):
        table = coded(df, every=True)
        known = (_vocabulary(df, _found(table)) if words is None else words).select("token", "id")
        schema = T.StructType([df.schema["doc"], T.StructField("ids", T.ArrayType(T.IntegerType()))])

        def make(sequences: pa.Table, tokens_: pa.Table) -> pa.Table:
            codes, row = _flat(sequences["codes"])
            code = tokens_["code"].to_numpy()
            ids = np.full(max(codes.max(initial=-1), code.max(initial=-1)) + 1, -1)
            ids[code] = tokens_["id"].to_numpy()
            has = ids[codes] >= 0
            off = np.append(0, np.cumsum(np.bincount(row[has], minlength=sequences.num_rows)))
            return pa.table([sequences["doc"], pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids[codes][has], pa.int32()))], names=["doc", "ids"])

        return _met(table, known, make, schema)
    words = dictionary(df) if words is None else words
    rows = tokens(df).join(words, "token").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("x"))
    return df.select("doc").join(rows, "doc", "left").select("doc", F.coalesce(F.transform("x", lambda s: s["id"]), F.array().cast("array<int>")).alias("ids"))


def bag_of_words(df: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(doc, id, value): for each token of a document, its count in the whole corpus."""
    if not _repeats(df):
        return _cells(df, words, True)
    counts = token_counts(df)
    totals = counts.groupBy("token").agg(F.sum("n").alias("total"))
    known = _vocabulary(df, counts).withColumnRenamed("n", "total") if words is None else words.join(totals, "token")
    return counts.join(known, "token").select("doc", "id", F.col("total").cast("double").alias("value"))


def one_hot(df: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(doc, id, value): 1 for each token of a document."""
    if not _repeats(df):
        return _cells(df, words, False)
    counts = token_counts(df)
    words = _vocabulary(df, counts) if words is None else words
    return counts.select("doc", "token").join(words, "token").select("doc", "id", F.lit(1.0).alias("value"))


def dense(df: DataFrame, cells: DataFrame, width: int) -> DataFrame:
    """(doc, vector): cells(doc, id, value) padded out to `width` numbers; documents without a cell are all 0."""
    rows = cells.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("id", "value"))).alias("m"))
    at = lambda i: F.coalesce(F.col("m")[i], F.lit(0.0))
    return df.select("doc").join(rows, "doc", "left").select("doc", F.transform(F.sequence(F.lit(1), F.lit(width)), at).alias("vector"))


def char_tf_idf(df: DataFrame) -> DataFrame:
    """(doc, term, weight): characters of the lower-cased, space-joined sequence; idf = ln((1 + n) / (1 + df)) + 1, rows of length 1."""
    text = F.lower(F.array_join("seq", " "))
    chars = df.select("doc", F.explode(F.split(text, "")).alias("term")).filter("term <> ''")
    tf = chars.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.count()
    found = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = tf.join(found, "term").withColumn("w", F.col("tf") * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1))
    norm = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


def n_grams(df: DataFrame, w: int = 5) -> DataFrame:
    return df.withColumn("seq", grams(F.col("seq"), w))


def joined(df: DataFrame) -> DataFrame:
    return df.select("doc", F.array_join("seq", " ").alias("text"))


def covering_length(df: DataFrame, percent: float = 1.0) -> DataFrame:
    """One row: the length at place rint(percent * n) of the sorted lengths (place 0 counts as the last). Lengths are counted first, so the window sees a row a length."""
    counts = df.groupBy(F.size("seq").alias("length")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.orderBy("length"))
    n = F.sum("c").over(Window.partitionBy())
    place = F.rint(F.lit(percent) * n)
    place = F.when(place == 0, n).otherwise(place)
    return counts.select("length", upto.alias("upto"), place.alias("place")).filter("upto >= place").agg(F.min("length").alias("length"))


def embed(df: DataFrame, codebook: DataFrame, scl: float = 1.0, standardise: bool = True) -> DataFrame:
    """(doc, vectors): labels become (len, inc) rows of the codebook, standardised over it; -1 becomes (0, 0)."""
    s = codebook.agg(F.avg("len").alias("ml"), F.stddev_pop("len").alias("sl"), F.avg("inc").alias("mi"), F.stddev_pop("inc").alias("si"))
    book = codebook.crossJoin(F.broadcast(s))  # one row
    a = (F.col("len") - F.col("ml")) / F.col("sl") if standardise else F.col("len")
    b = (F.col("inc") - F.col("mi")) / F.col("si") if standardise else F.col("inc")
    book = book.select(F.col("label").alias("token"), F.array(a * scl, b).alias("vector"))
    rows = tokens(df).withColumn("token", F.col("token").cast("int")).join(book, "token", "left")
    rows = rows.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("vector", F.array(F.lit(0.0), F.lit(0.0))).alias("v")))).alias("x"))
    return rows.select("doc", F.transform("x", lambda s: s["v"]).alias("vectors"))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, token, n): counts of tokens in all sequences of a class."""
    return df.select(label, F.explode("seq").alias("token")).groupBy(label, "token").agg(F.count(F.lit(1)).alias("n"))


def class_corpus(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, doc, text): the joined sequences of a class, a row each, one after the other in order of doc in one partition.
    No row holds a class, which can be larger than a row may be. A sequence without tokens has no text."""
    text = F.when(F.exists("seq", lambda x: x.isNotNull()), F.array_join("seq", " "))
    return df.select(label, "doc", text.alias("text")).repartition(label).sortWithinPartitions(label, "doc", "text")


def class_digests(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, digest): md5 of a class's tokens joined by spaces, in order of doc. md5 runs over a class from its beginning to its
    end, so a class is one task's work, of which it holds a batch at a time."""
    corpus = class_corpus(df, label)
    schema = T.StructType([corpus.schema[label], T.StructField("digest", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        last, state, between = None, None, b""

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([last, pa.array([state.hexdigest()])], names=[f.name for f in schema])

        for batch in batches:
            labels = batch.column(0)
            for i, text in enumerate(batch.column(2)):
                if last is None or not labels[i].equals(last[0]):
                    if last is not None:
                        yield made()
                    last, state, between = pa.concat_arrays([labels.slice(i, 1)]), hashlib.md5(), b""
                if text.is_valid:
                    state.update(between)
                    state.update(text.as_buffer())
                    between = b" "
        if last is not None:
            yield made()

    return corpus.mapInArrow(run, schema)


def tf_idf(counts: DataFrame, label: str = "label") -> DataFrame:
    """(label, token, tf, tf_idf): tf = n / total of the class, idf = ln(1 + classes / classes with the token)."""
    totals = counts.groupBy(label).agg(F.sum("n").alias("total"))
    classes = totals.count()
    found = counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    tf = F.col("n") / F.col("total")
    return counts.join(totals, label).join(found, "token").select(label, "token", tf.alias("tf"), (tf * F.log(1 + classes / F.col("df"))).alias("tf_idf"))


def class_matrix(weights: DataFrame, label: str = "label", value: str = "tf_idf", threshold: float | None = None) -> DataFrame:
    """(label, token, weight) without weights below the threshold; what is missing counts as 0."""
    rows = weights.select(label, "token", F.col(value).alias("weight"))
    return rows if threshold is None else rows.filter(F.col("weight") >= threshold)


def classify(df: DataFrame, matrix: DataFrame, label: str = "label") -> DataFrame:
    """(doc, label, distance): the class of least cosine distance between counts and weights, ties to the smaller label.
    The norm of a document counts the matrix's tokens only. Documents without any of them get distance 1 and the smallest label."""
    if not _repeats(df):
        return _classify(df, matrix, label)
    weights = matrix.groupBy("token").agg(F.collect_list(F.struct(label, "weight")).alias("weights"))  # a weight a class
    counts = token_counts(df).join(weights, "token")
    norm = counts.groupBy("doc").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("dn"))
    class_norm = matrix.groupBy(label).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("cn"))
    dots = counts.select("doc", "n", F.inline("weights")).groupBy("doc", label).agg(F.sum(F.col("n") * F.col("weight")).alias("dot"))
    scores = dots.join(norm, "doc").join(class_norm, label).select("doc", label, (1 - F.col("dot") / (F.col("dn") * F.col("cn"))).alias("distance"))
    best = scores.groupBy("doc").agg(F.min(F.struct("distance", label)).alias("b"))
    smallest: Column = F.lit(matrix.agg(F.min(label)).first()[0])
    return df.select("doc").join(best, "doc", "left").select("doc", F.coalesce(F.col(f"b.{label}"), smallest).alias(label), F.coalesce("b.distance", F.lit(1.0)).alias("distance"))


def _classify(df: DataFrame, matrix: DataFrame, label: str) -> DataFrame:
    matrix = shared.materialise(matrix, "weights")
    classes = matrix.filter(F.col(label).isNotNull()).groupBy(label).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("cn")).orderBy(label).collect()
    number = F.array_position(F.array(*(F.lit(c[0]) for c in classes)), F.col(label)).cast("int") - 1 if classes else F.lit(0)
    known = matrix.filter(F.col(label).isNotNull()).select("token", number.alias("class"), "weight")
    schema = T.StructType([df.schema["doc"], T.StructField("class", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    norms = [c.cn for c in classes]

    def make(sequences: pa.Table, tokens_: pa.Table) -> pa.Table:
        codes, row = _flat(sequences["codes"])
        n, rows = _flat(sequences["counts"])[0].astype(float), sequences.num_rows
        code, kind, weight = (tokens_[c].to_numpy() for c in ("code", "class", "weight"))
        width = max(codes.max(initial=-1), code.max(initial=-1)) + 1
        has = np.zeros(width, bool)
        has[code] = True
        norm = np.sqrt(np.bincount(row, n * n * has[codes], minlength=rows))
        best, chosen = np.full(rows, np.inf), np.full(rows, 0)
        for k, cn in enumerate(norms):
            own, w = np.zeros(width, bool), np.zeros(width)
            own[code[kind == k]], w[code[kind == k]] = True, weight[kind == k]
            dot, met = np.bincount(row, n * w[codes], minlength=rows), np.bincount(row, own[codes], minlength=rows) > 0
            distance = np.where(met, 1 - dot / np.where(met, norm * cn, 1.0), np.inf)
            chosen, best = np.where(distance < best, k, chosen), np.minimum(distance, best)
        return pa.table([sequences["doc"], pa.array(chosen, pa.int32()), pa.array(np.where(np.isinf(best), 1.0, best))], names=[f.name for f in schema])

    names = F.array(*(F.lit(c[0]) for c in classes)).cast(T.ArrayType(matrix.schema[label].dataType))
    return _met(coded(df), known, make, schema, "counts").select("doc", F.get(names, F.col("class")).alias(label), "distance")
