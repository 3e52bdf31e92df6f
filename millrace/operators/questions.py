"""Questions as a table: stations and time window from the text, routing by mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.process_rules import STATIONS

STATION_CODE = r"(?<![\p{L}\p{N}_])(" + "|".join(STATIONS) + r")(?![\p{L}\p{N}_])"
MOMENT = (
    r"(?<![\p{L}\p{N}_])(\d{4}-\d{2}-\d{2} \d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?)(?![\p{L}\p{N}_])"
)
WINDOW_S = 5
# Modes of operation.
NO_RETRIEVAL, VECTOR, FILTERED = "sem_rag", "vetorial", "filtrada"
MODES = (NO_RETRIEVAL, VECTOR, FILTERED)


def stations_of(question: Column) -> Column:
    """Distinct station codes in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(question, F.lit(STATION_CODE), F.lit(1)))


def parse_questions(questions: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Add stations, ts, window_lo and window_hi.

    A time without seconds covers its whole minute, one with seconds ± window_s. An impossible
    date leaves the stations only.
    """
    raw = F.regexp_extract("question", MOMENT, 1)
    fraction = F.rpad(F.substring_index("_raw", ".", -1), 6, "0")
    full = (
        F.when(F.length("_raw") == 16, F.concat("_raw", F.lit(":00")))
        .when(F.col("_raw").contains("."), F.concat(F.substring_index("_raw", ".", 1), F.lit("."), fraction))
        .otherwise(F.col("_raw"))
    )
    minute = F.length("_raw") == 16
    half = F.make_dt_interval(secs=F.lit(float(window_s)))
    return (
        questions.withColumn("stations", stations_of(F.col("question")))
        .withColumn("_raw", raw)
        .withColumn("ts", F.when(F.col("_raw") != "", full.try_cast("timestamp")))
        .withColumn("window_lo", F.when(minute, F.col("ts")).otherwise(F.col("ts") - half))
        .withColumn(
            "window_hi",
            F.when(minute, F.col("ts") + F.expr("interval 59.999999 seconds"))
            .otherwise(F.col("ts") + half),
        )
        .drop("_raw")
    )


def checked_mode(mode: Column) -> Column:
    return F.when(mode.isin(*MODES), mode).otherwise(
        F.raise_error(F.concat(F.lit("unknown mode: "), F.coalesce(mode, F.lit("null"))))
    )
