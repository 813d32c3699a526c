"""Line dedup by a suffix array over the line-id sequences of all documents.

All lines get a place (documents by id, then text hash; lines in order), and every line with text a 128-bit id of its trimmed
content; blank lines are left out of the sequences. Prefix doubling sorts the suffixes of all documents whose first line
occurs elsewhere (see suffixes.py), and the LCP of neighbours gives the LCP intervals: all places that share a run of lines.
The longest run from each place on that also begins at an earlier place follows from the intervals in which the place isn't
the first. Where that run has `min_chars` code points or more, its lines are deleted; first copies stay. So every occurrence
but the first of a repeated run of enough code points goes, whatever its number of lines.

Defined results: null and empty texts have no lines and stay as they are (null becomes empty). Rows that repeat both id and text count as one document, and
all get its result. Repeats inside a document count like those between documents. Lines are trimmed of blanks, tabs, returns, vertical tabs and form feeds for comparison and for their
code points; what stays of a text stays as it was. A blank line goes where the lines with text on both sides go, and stays elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsymbol.llm.common import discard, materialise, spare
from tsymbol.llm.suffixes import longest_earlier, neighbours, suffix_array

MIN_CHARS = 20


#: What is trimmed besides blanks.
SPACES = " \t\r\x0b\x0c"


def _trimmed(text: Column) -> Column:
    """The lines of a text, trimmed. Most texts hold nothing but blanks to trim, which is much faster."""
    lines = F.split(text, "\n")
    return F.when(text.rlike(r"[\t\r\x0b\x0c]"), F.transform(lines, lambda x: F.btrim(x, F.lit(SPACES)))).otherwise(F.transform(lines, lambda x: F.trim(x)))


def _lines(df: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """(doc_id, h, dstart, gid, left, h1, h2, need): lines with text, numbered so that a document's are consecutive and documents ascend.
    need: lines from there on that have min_chars code points together; 0 if the document ends before."""
    x = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.filter(_trimmed(x), lambda line: line != "")
    # no line with text is shorter than one
    ahead = lambda lines, i: F.aggregate(
        F.slice(lines, i + 1, max(1, min_chars)),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars")),
        lambda a, line: F.when(a["chars"] >= min_chars, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["chars"] + F.length(line)).alias("chars"))),
        lambda a: F.when(a["chars"] >= min_chars, a["n"]).otherwise(0),
    )
    docs = df.select(F.col(key).alias("doc_id"), F.xxhash64(x).alias("h"), trimmed.alias("lines")).filter(F.size("lines") > 0)
    packed = F.transform("lines", lambda line, i: F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2"), F.when(F.length(line) >= min_chars, 1).otherwise(ahead(F.col("lines"), i)).alias("need")))
    docs = docs.select("doc_id", "h", packed.alias("lines")).groupBy("doc_id", "h").agg(F.first("lines").alias("lines")).orderBy("doc_id", "h")
    rows = docs.select("doc_id", "h", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line"))
    return rows.select("doc_id", "h", "n", "pos", F.monotonically_increasing_id().alias("gid"), "line.*").select("doc_id", "h", (F.col("gid") - F.col("pos")).alias("dstart"), "gid", (F.col("n") - F.col("pos")).cast("long").alias("left"), "h1", "h2", F.col("need").cast("long").alias("need"))


def repeated_lines(df: DataFrame, *, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """Documents that lose lines as (doc_id, h, runs): runs of (from, until) over their lines with text, ascending."""
    lines = materialise(_lines(df, text, key, min_chars), "lines")
    array, rounds = suffix_array(lines.select("gid", "dstart", "left", "need", "h1", "h2"))
    order = neighbours(array, rounds)
    discard(array)
    found = longest_earlier(order).filter((F.col("need") > 0) & (F.col("length") >= F.col("need")))
    reach = found.select("dstart", "gid", (F.col("gid") + F.col("length")).alias("reach"))
    # spans that touch or overlap grow together
    in_doc = Window.partitionBy("dstart").orderBy("gid")
    before = F.max("reach").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = reach.withColumn("new", F.when(before.isNull() | (F.col("gid") > before), 1).otherwise(0)).withColumn("span", F.sum("new").over(in_doc))
    spans = spans.groupBy("dstart", "span").agg((F.min("gid") - F.col("dstart")).cast("int").alias("from"), (F.max("reach") - F.col("dstart")).cast("int").alias("until"))
    runs = spans.groupBy("dstart").agg(F.array_sort(F.collect_list(F.struct("from", "until"))).alias("runs"))
    losses = materialise(runs.join(lines.filter("gid = dstart").select("dstart", "doc_id", "h"), "dstart").select("doc_id", "h", "runs"), "line-losses")
    discard(lines)
    return losses


def dedup(df: DataFrame, *, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """df with the deleted lines cut out of `text`, and with n_lines (lines with text) and n_deleted under names that don't clash (see `counted`)."""
    n_lines, n_deleted, h, runs, own = counted(df)
    losses = repeated_lines(df, text=text, key=key, min_chars=min_chars)
    losses = losses.select(F.col("doc_id").alias(own), F.col("h").alias(f"{h}_"), F.col("runs").alias(runs))
    x = F.coalesce(F.col(text), F.lit(""))
    rows = df.withColumn(h, F.xxhash64(x))
    rows = rows.join(losses, F.col(key).eqNullSafe(F.col(own)) & (F.col(h) == F.col(f"{h}_")), "left")
    lines = F.split(x, "\n")
    filled = F.filter(F.transform(_trimmed(x), lambda line, i: F.when(line != "", i)), lambda i: i.isNotNull())
    (numbers,) = spare(rows, "line_numbers")
    rows = rows.withColumn(numbers, filled)
    at = lambda k: F.get(F.col(numbers), k)  # noqa: E731  place among all lines of the k-th line with text
    # what stays lies between the runs: from the line after one's last to the next one's first
    begins = F.concat(F.array(F.lit(0)), F.transform(F.col(runs), lambda r: at(r["until"] - 1) + 1))
    ends = F.concat(F.transform(F.col(runs), lambda r: at(r["from"])), F.array(F.size(lines)))
    kept = F.flatten(F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda z: F.slice(lines, z["a"] + 1, z["b"] - z["a"])))
    gone = F.aggregate(F.col(runs), F.lit(0), lambda total, r: total + r["until"] - r["from"])
    out = rows.withColumns({n_lines: F.size(numbers).cast("long"), n_deleted: F.coalesce(gone, F.lit(0)).cast("long"), text: F.when(F.col(runs).isNull(), x).otherwise(F.array_join(kept, "\n"))})
    return out.drop(h, f"{h}_", runs, own, numbers)


def counted(df: DataFrame) -> list[str]:
    """Names of the columns that dedup() adds, n_lines and n_deleted, and of those that it uses itself."""
    return spare(df, "n_lines", "n_deleted", "text_hash", "deleted_runs", "loss_key")


def thin(df: DataFrame, *, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS) -> DataFrame:
    """df's columns after dedup(); documents all of whose lines are deleted go."""
    n_lines, n_deleted, *_ = counted(df)
    made = dedup(df, text=text, key=key, min_chars=min_chars)
    return made.filter((F.col(n_lines) == 0) | (F.col(n_deleted) < F.col(n_lines))).select(*df.columns)
