"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

A document of a source with target / size = r is taken floor(r) times, and once more with probability
p = r - floor(r). These probabilities are made integral in pairs: words move from one document of a pair to the
other until one probability is 0 or 1, the direction drawn so that each expectation stays as it is. The words
of a pair stay the same; only a source's last document is rounded to the nearer side, so the source's words
differ from its target by half a document at most. Longer documents go first, which tends to leave a short one.

Pairs are formed in blocks of about BLOCK documents, dealt by a hash within their source; each block leaves one
document with a fractional probability, and BLOCK blocks at a time meet on the next level of a reduction tree.
A source of any size therefore takes log(n) levels, and no group grows with it. Rows of equal content, if more than
BLOCK, are numbered, and their numbers deal them over the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, fresh, materialise
from millrace.operators.ordered import row_numbers

BLOCK = 256
SEED = 11
#: A source's target, and a document's copies, are at most so many times its size.
MOST = 3
_GRAIN = 1 << 52


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float = MOST) -> DataFrame:
    """(source, source_size, n_docs, target): the weights, repeated over the sources in code point order, null last, share the total.

    A target above `most` times its source's size stops there; the excess is shared anew by weight
    until none is above. Stored in the shared folder; the driver sees only two sums per round.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = row_numbers(totals.withColumn("_null", F.col("source").isNull()), [], ["_null", "source"], "_rank")
    choice = F.array(*[F.lit(float(w)) for w in weights])
    weighted = materialise(
        ranked.withColumn("_w", F.get(choice, F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int"))).drop("_null", "_rank"),
        "sources",
    )
    cap = F.lit(float(most)) * F.col("source_size")
    total, weight = weighted.agg(F.sum("source_size"), F.sum("_w")).first()
    level, stopped = (total or 0) / (weight or 1), -1
    while True:
        over = F.col("_w") * F.lit(level) > cap
        n, held, free = weighted.agg(
            F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("_w")))
        ).first()
        if n == stopped or not free:
            break
        stopped, level = n, (total - (held or 0.0)) / free
    return weighted.withColumn("target", F.least(cap, F.col("_w") * F.lit(level))).drop("_w")


def _uniform(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(*parts, F.lit(SEED)), F.lit(_GRAIN)) / F.lit(float(_GRAIN))


def _item(x: Column, p: Column) -> Column:
    return F.struct(
        x["size"].alias("size"), x["h"].alias("h"), x["id"].alias("id"), x["base"].alias("base"), p.alias("p")
    )


def _pair(c: Column, x: Column) -> Column:
    """(settled, carried) of a pair: one of them gets 0 or 1, the other keeps what is left."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def decided(t: Column) -> Column:
        to_c = _uniform(c["h"], x["h"]) * (F.least(t["c_up"], t["x_down"]) + F.least(t["c_down"], t["x_up"])) < F.least(
            t["c_down"], t["x_up"]
        )

        def result(settled: Column, carried: Column) -> Column:
            return F.struct(settled.alias("settled"), carried.alias("carried"))

        return F.when(
            to_c & (t["c_up"] <= t["x_down"]),
            result(_item(c, one), _item(x, F.greatest(zero, x["p"] - t["c_up"] / x["size"]))),
        ).when(
            to_c, result(_item(x, zero), _item(c, F.least(one, c["p"] + t["x_down"] / c["size"]))),
        ).when(
            t["x_up"] <= t["c_down"],
            result(_item(x, one), _item(c, F.greatest(zero, c["p"] - t["x_up"] / c["size"]))),
        ).otherwise(result(_item(c, zero), _item(x, F.least(one, x["p"] + t["c_down"] / x["size"]))))

    words = F.struct(  # up: words until the probability is 1; down: until it is 0
        ((one - c["p"]) * c["size"]).alias("c_up"), (c["p"] * c["size"]).alias("c_down"),
        ((one - x["p"]) * x["size"]).alias("x_up"), (x["p"] * x["size"]).alias("x_down"),
    )
    return let(words, decided)


def _block(items: Column) -> Column:
    """(settled array, carried) of one block's items, paired in their order."""
    def step(state: Column, x: Column) -> Column:
        return let(
            _pair(state["carried"], x),
            lambda t: F.struct(
                F.concat(state["settled"], F.array(t["settled"])).alias("settled"), t["carried"].alias("carried")
            ),
        )

    start = F.struct(F.filter(items, lambda x: F.lit(False)).alias("settled"), F.element_at(items, 1).alias("carried"))
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def _spread(rows: DataFrame) -> DataFrame:
    """`rows` with an h of its own for each row whose h more than BLOCK rows have.

    Rows of one h are interchangeable, so it doesn't matter which of them gets which number.
    """
    many = rows.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK).select("h")
    many = materialise(many, "many")  # plain inputs let a join's hot partition be split
    if many.isEmpty():
        return rows
    alike = materialise(rows.join(many, "h").withColumn("_row", F.monotonically_increasing_id()), "alike")
    numbered = row_numbers(alike, ["h"], ["size", "_row"], "_k").withColumn("h", F.xxhash64("h", "_k"))
    return rows.join(many, "h", "left_anti").unionByName(numbered.select(*rows.columns))


def mixed(sizes: DataFrame, weights: Sequence[float], most: int = MOST) -> DataFrame:
    """(id, source, size, source_size, target, copies) for each row of `sizes` (id, source, size, h).

    h: a hash of the row's content, from which blocks and draws come, so reruns agree whatever the
    partitioning. Rows of size 0 and of a source whose ratio is whole are settled at once. Equal rows are
    interchangeable. An empty table stays empty; a null source is a source.
    """
    targets = source_targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    t = targets.withColumnRenamed("source", "_source")
    rows = (
        sizes.join(t, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("_r", ratio).withColumn("base", F.floor("_r").cast("int"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("_r") - F.col("base")).otherwise(0.0))
    )
    keys = ["source", "source_size", "target"]
    whole = F.col("p") == 0
    out = rows.where(whole).select("id", *keys[:1], F.col("size").cast("long"), *keys[1:], F.col("base").alias("copies"))

    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n_docs") / F.lit(float(BLOCK)), F.lit(1.0)))))
    level = _spread(rows.where(~whole)).select(
        *keys, F.pmod(F.xxhash64("h", F.lit(SEED)), blocks.cast("long")).alias("block"),
        F.struct(F.col("size").cast("double").alias("size"), "h", "id", "base", "p").alias("item"),
    )
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    height = max(1, math.ceil(math.log2(max(1.0, largest / BLOCK))))
    done = None
    for up in range(1 + math.ceil(height / math.log2(BLOCK))):
        if up:
            level = level.withColumn("block", F.shiftright("block", int(math.log2(BLOCK))))
        folded = level.groupBy(*keys, "block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
        folded = materialise(folded.select(*keys, "block", _block(F.col("items")).alias("state")), "mixed")
        settled = folded.select(*keys, F.explode("state.settled").alias("item"))
        done = settled if done is None else done.unionByName(settled)
        level = folded.select(*keys, "block", F.col("state.carried").alias("item"))
    # One document per source is left: to the nearer side, which keeps the source nearest to its target.
    last = level.select(*keys, _item(F.col("item"), F.round(F.col("item.p"))).alias("item"))
    done = done.unionByName(last)
    return out.unionByName(done.select(
        F.col("item.id").alias("id"), "source", F.col("item.size").cast("long").alias("size"), "source_size", "target",
        (F.col("item.base") + F.col("item.p").cast("int")).alias("copies"),
    ))


def sizes_of(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(id, source, size, h) of whole texts, stored once; a null text has size 0."""
    return materialise(
        docs.select(
            F.col(key).alias("id"), "source", word_count(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "source", "text").alias("h"),
        ),
        "sizes",
    )


def mix(docs: DataFrame, weights: Sequence[float], most: int = MOST) -> DataFrame:
    """`docs` with each row as often as the mix takes it (perhaps not at all), all columns kept.

    Rows are numbered in a stored copy first, so repeated rows and null ids stay rows of their own.
    """
    row, copies = fresh(docs, "row", "copies")
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "mix")
    takes = mixed(sizes_of(numbered, row), weights, most).where("copies > 0").select(
        F.col("id").alias(row), F.col("copies").alias(copies)
    )
    again = F.explode(F.sequence(F.lit(1), F.col(copies)))
    return numbered.join(takes, row).withColumn(copies, again).select(*docs.columns)
