"""Removal of repeated multi-line chunks with content-defined borders, in DataFrame operations only.

A line is a stretch between line ends. A rolling hash over the ids of WINDOW lines marks a line as a border if it is divisible
by the divisor; a chunk runs from one border to the next, both included, so neighbours share a line, and the first
and last lines of a text are borders too. Borders depend on nearby lines alone: lines inserted before a passage don't
shift its chunks. Of chunks that occur again all but the first by (doc_id, line) are removed, and the union
of their lines goes. Chunks of blank lines are never removed, nor is a chunk of one line (a text of one line).

The divisor sets how fine chunks are. At 1, the value in use, every line is a border and every two lines in a row are a chunk:
whatever stands line by line in an earlier place goes, in runs of two lines and more. Larger divisors make fewer and
longer chunks and miss runs with less than two borders.

Bytes are compared line by line: lines are numbered by 128 bits of hashes, lines of one number are compared in one
aggregate, and if two differ the lines are numbered by SHA-256 instead. Chunks are equal if all their numbers are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, materialise
from millrace.llm.mixing import let

WINDOW = 2
DIVISOR = 1
FACTOR = 31


def fast_id(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(WINDOW), line).alias("b"))


def digest_id(line: Column) -> Column:
    digest = F.sha2(line, 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    return F.struct(part(1).alias("a"), part(16).alias("b"), part(31).alias("c"), part(46).alias("d"))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def chunks(lines: Column, number, divisor: int = DIVISOR) -> Column:
    """array<struct<start, stop, ids>> of a text's chunks of two lines and more, line numbers from 0, stop included."""
    rows = F.transform(lines, lambda x: F.struct(number(x).alias("id"), (F.trim(x) == "").alias("blank")))

    def border(r: Column, i: Column) -> Column:
        if divisor == 1:
            return F.lit(True)
        rolled = sum((F.coalesce(F.get(r, i.cast("int") - k)["id"]["a"] % (1 << 40), F.lit(0)) * F.lit(FACTOR**k) for k in range(1, WINDOW)),
                     F.get(r, i.cast("int"))["id"]["a"] % (1 << 40))
        return (i == 0) | (i == F.size(r) - 1) | (F.pmod(rolled, F.lit(divisor)) == 0)

    def cut(r: Column) -> Column:
        borders = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: border(r, i))

        def between(b: Column) -> Column:
            spans = F.transform(F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))), lambda start, k: F.struct(
                start.alias("start"), F.get(b, k.cast("int") + 1).alias("stop")))
            parts = F.transform(spans, lambda s: let(F.slice(r, s["start"] + 1, s["stop"] - s["start"] + 1), lambda p: F.struct(
                s["start"].alias("start"), s["stop"].alias("stop"), p["id"].alias("ids"), F.forall(p["blank"], lambda x: x).alias("blank"))))
            return F.filter(parts, lambda c: ~c["blank"])

        return let(borders, between)

    return let(rows, cut)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), lines_of(F.col("text")).alias("lines"))


def line_numbers(texts: DataFrame):
    """A function from a line to its number: the fast one, unless two different lines of the table share a number."""
    lines = texts.select(F.explode("lines").alias("line")).select(fast_id(F.col("line")).alias("id"), "line")
    shared = lines.groupBy("id").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x <> y")
    return digest_id if shared.limit(1).count() else fast_id


def united(sorted_spans: Column) -> Column:
    """Sorted spans without overlaps that cover the same lines."""
    def runs(g: Column) -> Column:
        stops = F.filter(g["stop"], lambda stop, k: F.coalesce(F.get(g["start"], k + 1) > stop, F.lit(True)))
        starts = F.filter(g["start"], lambda start, k: F.coalesce(F.get(g["stop"], k - 1) < start, F.lit(True)))
        return let(stops, lambda s: F.transform(
            starts, lambda start, k: F.struct(start.alias("start"), F.get(s, k).alias("stop"))))

    return let(sorted_spans, runs)


def _place() -> Column:
    """Null ids last; the text's hash only parts different texts under one id."""
    return F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"), F.col("start").alias("start"))


def repeated_spans(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """(id, key, spans): lines to remove of the document (doc_id, xxhash64(text)), as sorted spans without overlaps."""
    texts = _texts(docs)
    number = line_numbers(texts)
    cut = texts.select("id", "key", F.inline(chunks(F.col("lines"), number, divisor))).drop("blank")
    cut = cut.withColumn("hash", F.xxhash64("ids"))
    firsts = cut.groupBy("hash", "ids").agg(F.min(_place()).alias("first"), F.max(_place()).alias("last")).where("first <> last")
    firsts = materialise(firsts.drop("last"), "repeated_chunks")  # plain inputs let a join's hot partition be split
    later = cut.join(firsts, ["hash", "ids"]).where(_place() != F.col("first"))
    gone = later.groupBy("id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    return gone.withColumn("spans", united(F.col("spans")))


def without(lines: Column, gone: Column) -> Column:
    """Lines outside the sorted spans `gone`, joined again; the result is null if no line is left."""
    def kept(g: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.size(g)), lambda k: let(F.struct(
            F.coalesce(F.get(g["stop"], k - 1) + 1, F.lit(0)).alias("from"),
            F.coalesce(F.get(g["start"], k), F.size(lines)).alias("to"),
        ), lambda s: F.slice(lines, s["from"] + 1, s["to"] - s["from"])))
        return let(F.flatten(parts), lambda left: F.when(F.size(left) > 0, F.array_join(left, "\n")))

    return let(gone, kept)


def dedup_lines(docs: DataFrame, drop_emptied: bool = True, divisor: int = DIVISOR) -> DataFrame:
    """`docs` without repeated chunks, all columns kept, and `removed_lines` (a name that is free).

    A document that loses every line is dropped, or gets an empty text if not drop_emptied. Null and empty texts stay
    as they are, and an empty table stays empty. Texts of any length are read whole, as one array of lines. Rows that
    repeat id and text are one document: they keep or lose the same lines. Different texts under one id are different
    documents. Null ids come after all others.
    """
    removed, key, key_b, id_b, gone = fresh(docs, "removed_lines", "key", "key_b", "id_b", "gone")
    found = repeated_spans(docs, divisor).select(F.col("id").alias(id_b), F.col("key").alias(key_b), F.col("spans").alias(gone))
    joined = docs.withColumn(key, F.xxhash64("text")).join(
        found, F.col("doc_id").eqNullSafe(F.col(id_b)) & (F.col(key) == F.col(key_b)), "left"
    )
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(
        let(lines_of(F.col("text")), lambda lines: without(lines, F.col(gone)))
    )
    count = F.coalesce(
        F.aggregate(F.col(gone), F.lit(0), lambda n, s: n + s["stop"] - s["start"] + 1), F.lit(0)
    ).cast("long")
    out = joined.withColumn(removed, count).withColumn("text", text)
    emptied = F.col("text").isNull() & F.col(gone).isNotNull()
    if drop_emptied:
        out = out.where(~emptied)
    else:
        out = out.withColumn("text", F.when(emptied, F.lit("")).otherwise(F.col("text")))
    return out.select(*docs.columns, removed)
