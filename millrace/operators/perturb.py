"""Controlled corruptions of answers with a known effect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.columns import let
from millrace.functions.text import (
    DECIMAL, DECLINE, STATION, dotted, key_fact_recall, numbers_in, stations_in,
)
from millrace.operators.ordered import row_numbers
from millrace.operators.stats import evenly_spaced_subset
from millrace.session import materialise

# Shifts tried in turn for a swapped number; patterns of numbers, labels, bullets and sentence ends.
SHIFTS = ("7.3", "11.9", "4.6", "23.1")
NUMBER = r"(?<![\d.,])\d+[.,]\d+(?!\d)"
MAX_SWAPS = 2
MIN_WORDS = 4
MARKUP = r"[*#`_]+"
LABEL = (
    r"(?iuU)^\s*(?:\d+[.)]\s*)?(?:[-•]\s*)?"
    r"(?:diagn[óo]stico|causa prov[áa]vel|a[çc][ãa]o corretiva)[^:\n]{0,60}:\s*"
)
BULLET = r"(?U)^\s*(?:\d+[.)]|[-•])\s*"
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÂÊÔÃÕÇ0-9'\"(])"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def neutral(answer: Column) -> Column:
    """Paragraphs in reverse order; null with fewer than two."""
    parts = F.filter(
        F.split(F.regexp_replace(answer, EDGE_SPACE, ""), r"(?U)\n\s*\n"),
        lambda p: F.trim(p) != "",
    )
    return F.when(F.size(parts) >= 2, F.array_join(F.reverse(parts), "\n\n"))


def swap_numbers(answer: Column, question: Column, contexts: Column) -> Column:
    """Shift the first two numbers that the context supports to values it does not contain;
    the decimal mark is kept. Null without such a number.

    Contexts are the longest text here: they are read once, and only for an answer that has a number.
    """
    def with_allowed(known: Column) -> Column:
        return F.struct(known.alias("known"), F.array_union(known, numbers_in(question)).alias("allowed"))

    numbers = let(numbers_in(F.array_join(contexts, " ")), with_allowed)
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(NUMBER), F.lit(0)))

    def swaps(n: Column) -> Column:
        grounded = F.slice(
            F.filter(cited, lambda s: F.array_contains(n["known"], dotted(s).cast("double"))),
            1, MAX_SWAPS,
        )
        return F.transform(grounded, lambda s, i: F.struct(
            s.alias("old"), _shifted(s, i, n["allowed"]).alias("new")
        ))

    swapped = F.aggregate(
        let(numbers, swaps), answer,
        lambda text, p: F.regexp_replace(
            text,
            F.concat(
                F.lit(r"(?<![\d.,])"), F.replace(p["old"], F.lit("."), F.lit(r"\.")),
                F.lit(r"(?!\d)"),
            ),
            p["new"],
        ),
    )
    changed = let(swapped, lambda text: F.when(text != answer, text))
    return F.when(answer.rlike(NUMBER) & (F.size(contexts) > 0), changed)


def _shifted(number: Column, position: Column, allowed: Column) -> Column:
    value = dotted(number).cast("decimal(18,6)")
    tried = F.transform(
        F.array(*[F.lit(d).cast("decimal(18,6)") for d in SHIFTS]),
        lambda d: F.round(value + d + position, 1),
    )
    free = F.filter(tried, lambda v: ~F.array_contains(allowed, v.cast("double")))
    pick = F.coalesce(F.try_element_at(free, F.lit(1)), F.element_at(tried, -1)).cast("string")
    return F.when(number.contains(","), F.replace(pick, F.lit("."), F.lit(","))).otherwise(pick)


def station_universe(answers: DataFrame) -> DataFrame:
    """One row: sorted station codes of all contexts (as many as there are stations)."""
    codes = answers.select(F.explode("retrieved_contexts").alias("_c")).select(
        F.explode(stations_in(F.col("_c"))).alias("_s")
    ).distinct()
    return codes.agg(F.sort_array(F.collect_set("_s")).alias("universe"))


def swap_station(answer: Column, question: Column, contexts: Column, universe: Column) -> Column:
    """Replace the first station that context or question name by one that neither names."""
    known = stations_in(F.concat_ws(" ", F.array_join(contexts, " "), question))
    present = stations_in(answer)
    target = F.try_element_at(F.array_intersect(present, known), F.lit(1))
    others = F.array_except(F.array_except(universe, known), present)
    pick = F.try_element_at(others, (F.length(answer) % F.size(others) + 1).cast("int"))
    pattern = F.concat(
        F.lit(r"(?<![\p{L}\p{N}_])"), target, F.lit(r"(?![\p{L}\p{N}_])")
    )
    return F.when(
        target.isNotNull() & (F.size(others) > 0), F.regexp_replace(answer, pattern, pick)
    )


def split_claims(answer: Column) -> Column:
    """Sentences to verify: markup, section labels and bullets removed, at least four words."""
    lines = F.split(F.replace(answer, F.lit("\r"), F.lit("")), "\n")
    clean = F.transform(lines, lambda line: F.regexp_replace(
        F.regexp_replace(F.regexp_replace(F.regexp_replace(line, MARKUP, ""), LABEL, ""), BULLET, ""),
        EDGE_SPACE, "",
    ))
    sentences = F.flatten(F.transform(clean, lambda line: F.split(line, SENTENCE_END)))
    sentences = F.transform(sentences, lambda s: F.regexp_replace(s, EDGE_SPACE, ""))
    return F.filter(sentences, lambda s: (s != "") & (F.size(F.split(s, r"(?U)\s+")) >= MIN_WORDS))


def claims(answers: DataFrame, keys: list[str]) -> DataFrame:
    """One row per claim, with the number of declining sentences; an answer without a claim keeps
    one row with a null claim."""
    rows = answers.withColumn("_s", split_claims(F.col("answer")))
    rows = rows.withColumn("_claims", F.filter("_s", lambda s: ~dotted(s).rlike(DECLINE)))
    rows = rows.withColumn("n_declined", F.size("_s") - F.size("_claims"))
    return rows.select(
        *keys, "n_declined", F.posexplode_outer("_claims").alias("_pos", "claim")
    ).select(*keys, "n_declined", (F.col("_pos") + 1).alias("claim_no"), "claim")


def distinct_claims(text: Column, pattern: str = DECIMAL) -> Column:
    """Matched values in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _station_sets(answers: DataFrame) -> DataFrame:
    return answers.select(
        "run", "id", "system",
        F.coalesce("retrieved_ids", F.array().cast("array<string>")).alias("retrieved_ids"),
        F.size("retrieved_contexts").alias("_contexts"),
        F.array_sort(stations_in(F.array_join("retrieved_contexts", " "))).alias("ctx_set"),
        F.length("answer").alias("_len"),
        F.array_join(F.array_sort(stations_in(F.col("answer"))), "|").alias("ans_key"),
    )


#: Branches of a node of the counting tree, as a power of two.
FAN_BITS = 6
#: First places of a pool that are looked at directly, and answers of a run with one id above which its answers go through the tree.
FRONT, CROWDED = 1000, 64


def _subsets(items: Column) -> Column:
    """array<struct<sign, part>>: the non-empty subsets of a short sorted array, as text, with the signs of inclusion and exclusion."""
    def with_item(done: Column, x: Column) -> Column:
        more = F.transform(done, lambda d: F.struct((-d["sign"]).alias("sign"), F.concat(d["part"], F.array(x)).alias("part")))
        return F.concat(done, more)

    none = F.array(F.struct(F.lit(-1).alias("sign"), F.array().cast("array<string>").alias("part")))
    every = F.slice(F.aggregate(items, none, with_item), 2, 1 << 30)
    return F.transform(every, lambda d: F.struct(d["sign"].alias("sign"), F.unhex(F.md5(F.array_join(d["part"], "\x1f"))).alias("part")))


def _shared() -> Column:
    """What a row shares with others: its retrieved ids and its question."""
    ids = F.filter("retrieved_ids", lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.concat(ids, F.array(F.concat(F.lit("q:"), "id")))))


def _marks(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per subset of what a row shares with others."""
    return rows.select(*columns, F.inline(_subsets(_shared())))


def _count_tree(places: DataFrame, key: list[str], levels: int) -> DataFrame:
    """(key, part, level, prefix, counts): how many of a subset's places lie below each branch of a node, for nodes that have any."""
    at = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    cells = places.select(*key, "part", "_no", at).select(
        *key, "part", "level", F.expr(f"shiftright(_no, {FAN_BITS} * (level + 1))").alias("prefix"),
        F.expr(f"cast(shiftright(_no, {FAN_BITS} * level) & {(1 << FAN_BITS) - 1} as int)").alias("branch"))
    counted = cells.groupBy(*key, "part", "level", "prefix", "branch").agg(F.count(F.lit(1)).alias("n"))
    nodes = counted.groupBy(*key, "part", "level", "prefix").agg(F.collect_list(F.struct("branch", "n")).alias("counts"))
    return materialise(nodes, "foreign-tree")


def _free_places(width: int):
    """Of a branch of a node: its places in the pool that are not ruled out."""
    def free(i: Column) -> Column:
        start = (F.col("prefix") * (1 << FAN_BITS) + i) * width
        inside = F.greatest(F.lit(0).cast("long"), F.least(F.lit(width).cast("long"), F.col("_pool") - start))
        return inside - F.coalesce(F.try_element_at("out", i), F.lit(0))

    return free


def _step_over(at: Column, n: Column) -> Column:
    """Pass a branch with n free places, unless the wanted one is among them."""
    found = at["found"] | (at["left"] < n)
    return F.struct(
        F.when(found, at["branch"]).otherwise(at["branch"] + 1).alias("branch"),
        F.when(found, at["left"]).otherwise(at["left"] - n).alias("left"), found.alias("found"))


def _allowed(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """(run, ans_key, ctx_set): distinct station sets on both sides that have no station in common; compares sets and not rows."""
    sets = asked.select("run", "ans_key").distinct().withColumn(
        "_ans", F.filter(F.split("ans_key", r"\|"), lambda c: c != "")
    )
    return sets.join(pool.select("run", "ctx_set").distinct(), "run").where(
        ~F.arrays_overlap("_ans", "ctx_set")
    ).select("run", "ans_key", "ctx_set")


def _front(pool: DataFrame, allowed: DataFrame) -> DataFrame:
    """The first FRONT places of each pool, counted from 0. The limit of a context set comes before its rows move."""
    order = ["id", "system"]
    first = pool.select("run", "ctx_set", *order, "retrieved_ids").withColumn(
        "_no", F.row_number().over(Window.partitionBy("run", "ctx_set").orderBy(*order))).where(F.col("_no") <= FRONT)
    place = F.row_number().over(Window.partitionBy("run", "ans_key").orderBy(*order))
    numbered = first.join(allowed, ["run", "ctx_set"]).withColumn("_no", place).where(F.col("_no") <= FRONT)
    return numbered.select("run", "ans_key", *order, "retrieved_ids", (F.col("_no") - 1).alias("_no"))


def _settle(asked: DataFrame, pool: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen rows, asked rows left over): answers whose wanted place is told by the first FRONT places of their pool.

    The number of free places n only matters if it is not above len(answer). An answer without a crowded id rules out CROWDED
    places per id at most, so in a larger pool the wanted place is free place number len(answer), and only ruled out places before it
    have to be known.
    """
    who, key = ["run", "id", "system"], ["run", "ans_key"]
    mark = F.explode(_shared()).alias("mark")
    allowed = materialise(_allowed(asked, pool), "foreign-allowed")
    counts = pool.groupBy("run", "ctx_set").agg(F.count(F.lit(1)).alias("n"))
    sizes = materialise(counts.join(allowed, ["run", "ctx_set"]).groupBy(*key).agg(F.sum("n").alias("_pool")), "foreign-sizes")
    crowded = materialise(
        pool.select("run", mark).groupBy("run", "mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED).select("run", "mark"),
        "foreign-crowded")
    front = materialise(_front(pool, allowed), "foreign-front")
    slow = asked.select(*who, mark).join(crowded, ["run", "mark"], "left_semi").select(*who).distinct()
    places = front.dropna(subset=who).select(*key, "_no", mark)
    out = asked.select(*who, "ans_key", mark).join(places, [*key, "mark"]).groupBy(*who, "ans_key").agg(
        F.sort_array(F.collect_set("_no")).alias("out"))
    rows = asked.join(sizes, key).join(out, [*who, "ans_key"], "left").join(slow.withColumn("_slow", F.lit(True)), who, "left")
    rows = rows.withColumn("out", F.coalesce("out", F.array().cast("array<int>"))).withColumns({
        "_whole": F.col("_pool") <= FRONT, "_n": F.col("_pool") - F.size("out"),
        "_sure": F.col("_pool") - CROWDED * F.size(_shared()) > F.col("_len")})
    wanted = F.when(F.col("_whole"), F.when(F.col("_n") > 0, F.col("_len") % F.col("_n"))).otherwise(F.col("_len")).cast("int")
    place = F.aggregate("out", wanted, lambda at, o: F.when(o <= at, at + 1).otherwise(at))
    rows = rows.withColumn("_no", place)
    told = F.col("_slow").isNull() & (F.col("_whole") | (F.col("_sure") & (F.col("_no") < FRONT)))
    rows = materialise(rows.select(*asked.columns, "_no", F.coalesce(told, F.lit(False)).alias("_told")), "foreign-settled")
    names = front.select(*key, "_no", F.col("id").alias("foreign_id"), F.col("system").alias("foreign_system"))
    chosen = rows.where("_told").select(*who, "ans_key", "_no").join(names, [*key, "_no"]).select(*who, "foreign_id", "foreign_system")
    return chosen, rows.where("not _told").select(*asked.columns)


def foreign_context(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """For each asked answer the (id, system) of another question of its run that shares no
    retrieved id and whose contexts name none of the answer's stations: number len(answer) mod n
    in (id, system) order.

    `asked` is the sample under study, `answers` the whole pool. The admissible pool depends only
    on the station set of the answer, of which there are few. Most answers are settled by the first places of their pool
    (`_settle`); the others, with an id that many answers share or a place far behind, by a counting tree (`_search`).
    """
    pool = materialise(_station_sets(answers.where(
        F.col("system").startswith("rag_") & (F.size("retrieved_contexts") > 0)
    )), "foreign-pool")
    asked = materialise(_station_sets(asked).drop("ctx_set", "_contexts"), "foreign-asked")
    chosen, rest = _settle(asked, pool)
    return chosen if rest.isEmpty() else chosen.unionByName(_search(rest, pool))


def _search(asked: DataFrame, pool: DataFrame) -> DataFrame:
    """The rows of `foreign_context` by a descent of a counting tree.

    The pool is numbered once per station set of an answer. How many
    positions up to some point an answer's own few ids rule out is a sum over the subsets of these ids, with alternating signs,
    of the rows that have the whole subset. These counts are kept in a tree over positions, and the wanted row is found by
    descending it, one branch per level: nothing of the size (answers x answers that share an id) is made.
    """
    key = ["run", "ans_key"]
    who = ["run", "id", "system"]
    allowed = _allowed(asked, pool)
    numbered = row_numbers(
        pool.select(*who, "ctx_set").join(allowed, ["run", "ctx_set"]).select(*key, "id", "system"),
        key, ["id", "system"], "_no",
    )
    numbered = materialise(numbered.withColumn("_no", F.col("_no") - 1), "foreign-numbered")  # from 0
    sizes = materialise(numbered.groupBy(*key).agg(F.count(F.lit(1)).alias("_pool")), "foreign-sizes")
    largest = sizes.agg(F.max("_pool")).first()[0] or 1
    levels = max(1, -(-int(largest).bit_length() // FAN_BITS))
    marks = materialise(_marks(asked, *who, "ans_key"), "foreign-marks")
    # Only subsets that an answer of the station set asks for; most belong to one question and its own answers.
    wanted = materialise(marks.select(*key, "part").distinct(), "foreign-parts")
    asked_for = _marks(pool, *who).drop("sign").join(wanted, ["run", "part"]).select(*who, "ans_key", "part")
    places = asked_for.join(numbered, [*who, "ans_key"]).select(*key, "part", "_no")
    places = materialise(places, "foreign-places")
    tree = _count_tree(places, key, levels)
    marks = materialise(marks.join(places.select(*key, "part").distinct(), [*key, "part"], "left_semi"), "foreign-marks")

    def ruled_out(state: DataFrame, level: int) -> DataFrame:
        """(who, out): per answer, the ruled-out places below each branch of its node."""
        nodes = tree.where(F.col("level") == level).drop("level")
        met = marks.join(state.select(*who, "prefix"), who).join(nodes, [*key, "part", "prefix"])
        cells = met.select(*who, "sign", F.inline("counts")).groupBy(*who, "branch").agg(F.sum(F.col("sign") * F.col("n")).alias("n"))
        return cells.groupBy(*who).agg(F.map_from_entries(F.collect_list(F.struct("branch", "n"))).alias("out"))

    top = asked.join(sizes, key).select(*who, "ans_key", "_len", "_pool", F.lit(0).cast("long").alias("prefix"))
    branches = F.sequence(F.lit(0), F.lit((1 << FAN_BITS) - 1))
    state = top
    for level in range(levels - 1, -1, -1):
        width = 1 << (FAN_BITS * level)
        joined = state.join(ruled_out(state, level), who, "left")
        joined = joined.withColumn("_free", F.transform(branches, _free_places(width)))
        if level == levels - 1:
            total = F.aggregate("_free", F.lit(0).cast("long"), lambda s, n: s + n)
            joined = joined.withColumn("_n", total).where("_n > 0").withColumn("_r", (F.col("_len") % F.col("_n")).cast("long"))
        joined = joined.withColumn("_at", F.aggregate("_free", F.struct(
            F.lit(0).alias("branch"), F.col("_r").alias("left"), F.lit(False).alias("found")), _step_over))
        state = materialise(joined.select(
            *who, "ans_key", "_len", "_pool", F.col("_at.left").alias("_r"),
            (F.col("prefix") * (1 << FAN_BITS) + F.col("_at.branch")).alias("prefix")), "foreign-search")
    chosen = numbered.select(
        *key, F.col("_no").alias("prefix"), F.col("id").alias("foreign_id"), F.col("system").alias("foreign_system")
    )
    return state.join(chosen, [*key, "prefix"]).select(*who, "foreign_id", "foreign_system")


def variants(answers: DataFrame, n: int) -> DataFrame:
    """Evenly spaced answers that allow both swaps, one row per corruption with a stable key."""
    universe = station_universe(answers)
    a, q, c = F.col("answer"), F.col("question"), F.col("retrieved_contexts")
    # One row, hence the broadcast.
    swapped = answers.join(F.broadcast(universe)).withColumn(
        "numero", swap_numbers(a, q, c)
    ).withColumn("estacao", swap_station(a, q, c, F.col("universe"))).drop("universe")
    usable = swapped.where("numero is not null and estacao is not null")
    picked = evenly_spaced_subset(usable, ["faithfulness", "run", "id", "system"], n)
    picked = materialise(picked, "picked")
    foreign = foreign_context(picked, answers)
    rows = picked.withColumn("neutra", neutral(a)).join(foreign, ["run", "id", "system"], "left")
    cond = lambda name, text, other: F.struct(
        F.lit(name).alias("cond"), text.alias("answer"), other.alias("context_of")
    )
    own = F.concat_ws("|", "id", "system")
    items = F.filter(
        F.array(
            cond("neutra", F.col("neutra"), own), cond("numero", F.col("numero"), own),
            cond("estacao", F.col("estacao"), own),
            cond("contexto", F.when(F.col("foreign_id").isNotNull(), a),
                 F.concat_ws("|", "foreign_id", "foreign_system")),
        ),
        lambda v: v["answer"].isNotNull(),
    )
    return rows.select("run", "id", "system", "faithfulness", F.explode(items).alias("_v")).select(
        F.concat_ws("|", "run", "id", "system", "_v.cond").alias("key"),
        "run", "id", "system", "_v.*", F.col("faithfulness").alias("original"),
    )


def positive_controls(answers: DataFrame, n: int) -> DataFrame:
    """Reference texts whose key facts all occur in the retrieved contexts, first n by (id, system)."""
    context = F.array_join("retrieved_contexts", " ")
    rows = answers.where(
        F.col("system").startswith("rag_") & (F.size("retrieved_contexts") > 0)
    ).withColumn("_kf", key_fact_recall(context, F.col("reference"), F.col("question")))
    return rows.where("_kf = 1.0").orderBy("id", "system", "run").limit(n).select(
        F.concat_ws("|", F.lit("REF"), "id", "system").alias("key"), "run", "id", "system",
        F.col("reference").alias("answer"),
    )
