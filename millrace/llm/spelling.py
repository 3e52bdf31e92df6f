"""Groups of spelling variants: words one edit apart, found by a frontier that descends a trie stored as a table.

The vocabulary's trie is an edge table (depth, node, ch, child, end), distributed by node; a node is the hash of its
prefix. An edge also has two masks of 64 bits of the hashes of all endings below it. A state says that a word's own
node (so its prefix and position) and another node of the trie are one edit apart; words that share a prefix share
their states, so no state is kept per word. States start at siblings, where the edit happens, and a level joins them
with the edges of both nodes by equal characters. What ends in two words is a pair of neighbours. A replaced character
starts at two children of a node; an inserted one is read as late as it can stand (the next character differs), so
every pair is found once. A state lives only while the masks of its nodes share bits: what follows must be equal, and
equal endings have equal bits, so no pair is lost. A node has at most one child per letter, so no key of these joins
is hot. One stored table per level, down to DEPTHS; below, a state's two nodes are joined by equal endings at once.

Words longer than LEVELS (no language has many) are joined by the hashes of all their one-character deletions instead,
computed along prefix sums, and compared exactly.

Defined cases. Null and empty words and null counts take no part. Words are compared by code points; ties of counts go
to the smaller word in code-point order. Repeated words must be summed before. No words: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise

DEPTHS = 8
LEVELS = 32
LETTERS = "[a-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15
_STATE = ("u", "v", "u_end", "v_end")


def letter_runs(text: Column) -> Column:
    """array<string>: maximal runs of letters of a text, A to Z lower-cased; null of a null text."""
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(LETTERS), F.lit(0))


def vocabulary(words: DataFrame, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """(word, n), stored: words of enough code points that occur often enough, from one row per occurrence."""
    long_enough = words.where(F.char_length("word") >= min_length)
    counted = long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return materialise(counted.where(F.col("n") >= min_count), "vocabulary")


def _node(prefix: Column) -> Column:
    return F.xxhash64(prefix)


def trie_edges(words: DataFrame) -> DataFrame:
    """(depth, node, ch, child, end, ma, mb), stored: one row per different prefix; `end` if the child is a word."""
    at = F.explode(F.sequence(F.lit(0), F.char_length("word") - 1))
    steps = words.select("word", at.alias("depth"))
    edge = steps.select(
        "depth", _node(F.expr("left(word, depth)")).alias("node"), F.expr("substr(word, depth + 1, 1)").alias("ch"),
        _node(F.expr("left(word, depth + 1)")).alias("child"), (F.char_length("word") == F.col("depth") + 1).alias("end"),
        F.xxhash64(F.expr("substr(word, depth + 2)")).alias("below"),
    )
    bit = lambda shift: F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(below, {shift}) & 63 as int)))")
    return materialise(edge.groupBy("depth", "node", "ch", "child").agg(F.max("end").alias("end"), bit(0).alias("ma"), bit(6).alias("mb")), "trie")


def _child(edges: DataFrame, mark: str, **columns: str) -> DataFrame:
    """Edges with the child's columns renamed by a mark, so that two of them can meet."""
    return edges.select(*[F.col(c).alias(name) for c, name in columns.items()], *[
        F.col(c).alias(f"{mark}{c}") for c in ("child", "end", "ma", "mb")])


def _alive(a: str, b: str) -> Column:
    meets = [F.col(f"{a}{m}").bitwiseAND(F.col(f"{b}{m}")) != 0 for m in ("ma", "mb")]
    return meets[0] & meets[1]


def _state(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}child").alias("u"), F.col(f"{b}child").alias("v"), F.col(f"{a}end").alias("u_end"), F.col(f"{b}end").alias("v_end")]


def starts(edges: DataFrame) -> DataFrame:
    """States (depth of u, u, v, ...) right after their edit, of all nodes, stored."""
    one = _child(edges, "x", depth="depth", node="node", ch="c1")
    two = _child(edges, "y", node="node", ch="c2")
    siblings = one.join(two, "node").where("c1 <> c2")
    below = _child(edges, "z", node="xchild", ch="c2")
    after = (F.col("depth") + 1).alias("depth")
    replaced = siblings.where("c1 < c2").where(_alive("x", "y")).select(after, *_state("x", "y"))
    inserted = siblings.select("depth", "xchild", "c2", "ychild", "yend", "yma", "ymb").join(below, ["xchild", "c2"]).where(
        _alive("y", "z")).select(after, *_state("y", "z"))
    return materialise(replaced.unionByName(inserted), "starts")


def _tails(words: DataFrame, depth: int) -> DataFrame:
    """(node, rest, word_node): for each prefix from `depth` on, what of a word follows it, as hashes."""
    at = F.explode(F.sequence(F.lit(depth), F.char_length("word"))).alias("at")
    return words.where(F.char_length("word") >= depth).select("word", at).select(
        _node(F.expr("left(word, at)")).alias("node"), F.xxhash64(F.expr("substr(word, at + 1)")).alias("rest"), _node(F.col("word")).alias("word_node"))


def frontier(words: DataFrame, depths: int = DEPTHS) -> DataFrame:
    """(u, v): hashes of words one edit apart, each pair once, of words (word).

    Levels are joined one by one down to `depths`. There most nodes have a single word, so what states lack is joined
    whole: the endings of both nodes must be equal.
    """
    edges = trie_edges(words)
    begun = starts(edges)
    deepest = words.agg(F.max(F.char_length("word"))).first()[0] or 0
    last = edges.where("end").select(F.col("child").alias("node"))
    appended = edges.where("end").join(last, "node").select(F.col("node").alias("u"), F.col("child").alias("v"))
    met = [appended]
    states = begun.where("depth = 1").drop("depth")
    for depth in range(1, min(depths, deepest)):
        met.append(states.where("u_end AND v_end").select("u", "v"))
        mine = _child(edges.where(F.col("depth") == depth), "x", node="u", ch="ch")
        other = _child(edges.where(F.col("depth").between(depth, depth + 1)), "y", node="v", ch="ch")
        moved = states.select("u", "v").join(mine, "u").join(other, ["v", "ch"]).where(_alive("x", "y")).select(*_state("x", "y"))
        states = materialise(moved.unionByName(begun.where(F.col("depth") == depth + 1).select(*_STATE)), "frontier")
    deep = states.select("u", "v").unionByName(begun.where(F.col("depth") > max(1, min(depths, deepest))).select("u", "v"))
    tails = materialise(_tails(words, max(1, min(depths, deepest))), "tails")
    mine = tails.select(F.col("node").alias("u"), "rest", F.col("word_node").alias("u_word"))
    other = tails.select(F.col("node").alias("v"), "rest", F.col("word_node").alias("v_word"))
    met.append(deep.join(mine, "u").join(other, ["v", "rest"]).select(F.col("u_word").alias("u"), F.col("v_word").alias("v")))
    return reduce(DataFrame.unionByName, met)


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, i, length, gap): hash of the word without its i-th code point; i = length: of the whole word."""
    for batch in batches:
        for word in batch.column("word").to_pylist():
            codes = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
            n = len(codes)
            up = np.full(n, _BASE, np.uint64)
            up[0] = 1
            sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * np.multiply.accumulate(up))])
            back = np.uint64(pow(_BASE, -1, 1 << 64))
            gaps = np.append(sums[:-1] + (sums[-1] - sums[1:]) * back, sums[-1])
            yield pa.RecordBatch.from_pydict({
                "word": pa.array([word]).take(pa.array(np.zeros(n + 1, np.int32))), "i": pa.array(np.arange(n + 1, dtype=np.int32)),
                "length": pa.array(np.full(n + 1, n, np.int32)), "gap": pa.array(gaps.view(np.int64)),
            })


def long_neighbours(words: DataFrame, levels: int) -> DataFrame:
    """(word, other): pairs one edit apart with a word of more than `levels` code points; both orders, each once."""
    reach = words.where(F.char_length("word") >= levels).select("word")
    gaps = materialise(reach.mapInArrow(_deletions, "word string, i int, length int, gap long"), "deletions")
    a = gaps.where("i < length")
    b = gaps.select(F.col("word").alias("other"), F.col("i").alias("j"), F.col("length").alias("m"), "gap")
    rest = F.expr("concat(left(word, i), substr(word, i + 2))")
    replaced = a.join(b, "gap").where("j = i AND m = length AND j < m AND word < other").where(
        rest == F.expr("concat(left(other, j), substr(other, j + 2))"))
    shortened = a.join(b, "gap").where("j = m AND m = length - 1").where(rest == F.col("other"))
    pairs = replaced.select("word", "other").unionByName(shortened.select("word", "other")).where(
        F.greatest(F.char_length("word"), F.char_length("other")) > levels).distinct()
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))


def neighbours(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(word, other): all pairs of different words exactly one edit apart, in both orders, each once."""
    short = words.where((F.char_length("word") > 0) & (F.char_length("word") <= levels)).select("word")
    named = short.select(_node(F.col("word")).alias("u"), "word")
    found = (
        frontier(short).join(named, "u").join(named.select(F.col("u").alias("v"), F.col("word").alias("other")), "v")
        .where(F.levenshtein("word", "other") == 1).select("word", "other").distinct()
    )
    both = found.unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other")))
    return both.unionByName(long_neighbours(words, levels))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain, by doubling; forms must not go round in a circle."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(ahead, "root", "left")
        now = materialise(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.drop("moved")


def variants(words: DataFrame, ratio: int = 2, levels: int = LEVELS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of stored words (word, n).

    form: the neighbour with the largest n, if that is at least `ratio` (2 or more) times the word's own.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    words = words.where("n IS NOT NULL AND word <> ''").select("word", "n")
    counts = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = neighbours(words, levels).join(counts, "other").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("word"))).alias("best"))
    near = F.col("best.minus") * -1
    chosen = near >= F.col("n") * ratio
    told = materialise(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.word")).alias("form"),
        F.when(chosen, near).alias("form_n"),
    ), "forms")
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
