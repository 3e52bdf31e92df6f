"""Process context of a (station, task) from the first-match rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.columns import hash_order, let
from millrace.functions.process_rules import NO_NEXT, RULE_SCHEMA, rule_rows


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)


def normalised_task(task: Column) -> Column:
    """Lower case; a pick-up-and-transport task is judged by its destination only."""
    low = F.lower(task)
    return F.when(
        low.startswith("picking up and transporting") & low.contains(" to the "),
        F.concat(F.lit("transport "), F.substring_index(low, " to the ", -1)),
    ).otherwise(low)


def task_context(pairs: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(station, current_task) rows, each with the activity of the first rule that applies.

    The rule table is a fixed list of a few dozen rows, hence the broadcast. Duplicate pairs are
    folded first (partial aggregation), so the keyword test runs once per distinct task text.
    """
    rules = rule_table(pairs.sparkSession) if rules is None else rules
    tasks = pairs.select("station", "current_task").where("current_task <> ''").distinct()
    hits = tasks.withColumn("_task", normalised_task(F.col("current_task"))).join(
        F.broadcast(rules), "station"
    ).where(F.forall("keywords", lambda k: F.col("_task").contains(k)))
    best = hits.groupBy("station", "current_task").agg(
        F.min_by(F.struct("activity", "process", "next_station"), "priority").alias("_rule")
    )
    return best.select("station", "current_task", "_rule.*")


def first_rule(station: Column, task: Column) -> Column:
    """struct<activity, process, next_station> of the first rule that applies, from the rules as a literal."""
    entry = lambda s, k, a, p, n: F.struct(
        F.lit(s).alias("station"), F.array(*map(F.lit, k)).alias("keywords"), F.lit(a).alias("activity"),
        F.lit(p).alias("process"), F.lit(n).alias("next_station"),
    )
    rules = F.array(*[entry(*row[1:]) for row in rule_rows()])

    def applies(low: Column) -> Column:
        hits = F.filter(rules, lambda r: (r["station"] == station) & F.forall(r["keywords"], lambda k: low.contains(k)))
        return F.try_element_at(hits, F.lit(1))

    return F.when(task != "", let(normalised_task(task), applies))


def with_context(rows: DataFrame) -> DataFrame:
    """Attach activity, process and next_station, row by row; rows without a rule get nulls."""
    found = rows.withColumn("_rule", first_rule(F.col("station"), F.col("current_task")))
    return found.select(*rows.columns, "_rule.activity", "_rule.process", "_rule.next_station")


def context_sentence() -> Column:
    """`BPM: … | Process: … | Next: …`, or an empty string without a rule."""
    return F.coalesce(
        F.concat(
            F.lit("BPM: "), F.col("activity"), F.lit(" | Process: "), F.col("process"),
            F.lit(" | Next: "), F.col("next_station"),
        ),
        F.lit(""),
    )


def impact_picks(episodes: DataFrame, seed: int = 42) -> DataFrame:
    """One (station, task) per station, in seeded order, whose activity hands over to another
    station."""
    tasks = task_context(episodes).where(
        ~F.col("next_station").isin(*NO_NEXT) & (F.col("next_station") != F.col("station"))
    )
    order = hash_order(seed, F.concat("station", F.lit("|"), "current_task"))
    return tasks.groupBy("station").agg(
        F.min_by(F.struct("current_task", "activity", "process", "next_station"), order).alias("_pick")
    ).select("station", "_pick.*")


def impact_groups(episodes: DataFrame, seed: int = 42) -> DataFrame:
    """The picked tasks with one row per episode of the group."""
    return impact_picks(episodes, seed).join(
        episodes.select("station", "current_task", "episode_id"), ["station", "current_task"]
    )
