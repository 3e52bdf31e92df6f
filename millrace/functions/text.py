"""Text expressions: tokens, hit lines, answer checks."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.columns import let, num1
from millrace.functions.folding import char_class, fold_tables

TOKEN = "[a-z0-9_]+"
# Patterns that facts, stations and numbers of an answer are read with.
DECIMAL1 = r"\d+\.\d"
STATION = r"(?<![\p{L}\p{N}_])[A-Z]{2,3}_\d(?![\p{L}\p{N}_])"
DECIMAL = r"(?<![\d.])\d+\.\d+(?!\d)"
GUARDED_DECIMAL1 = r"(?<![\d.])\d+\.\d(?!\d)"
QUOTED = r"'([^']+)'"
IMPACT_PREFIX = "A atividade interrompida"
NEGATIVE_VERDICT = (
    r"dentro d[oa] (?:normal|normalidade|esperado|faixa|padr|tempo t[ií]pico|dura[cç][aã]o normal)"
    r"|n[aã]o (?:foi|[eé]|est[aá]|houve|h[aá]|indica|apresenta|ocorreu)[^.]{0,40}"
    r"(?:anormal|an[oô]mal|longa|longo|evid[eê]ncia)"
    r"|n[aã]o (?:foi|[eé]) anormalmente|sem anomalia|n[aã]o h[aá] anomalia"
)
POSITIVE_VERDICT = (
    r"anormalmente long|an[oô]mal|anomalia|acima d[ao] (?:m[eé]dia|mediana|normal|limiar)|excede"
)
DECLINE = (
    r"(?iu)n[ãa]o h[áa](?![\p{L}\p{N}_])[^.\n]{0,80}?(?:informa|epis[óo]d|registr|dado|evid[êe]nc)"
    r"|n[ãa]o (?:[ée] poss[íi]vel|foi poss[íi]vel|existe[m]?|foi registrad|consta)"
    r"|(?:sem|nenhum) (?:epis[óo]dio|registro)"
)
ANSWER, PARTIAL, REFUSAL = "resposta", "ressalva_parcial", "recusa_total"
OPENING_CHARS = 250


def fold(text: Column) -> Column:
    """Lower case without accents; exact for every character that can reach a token.

    One `translate` covers the one-to-one foldings. The few characters that expand to several are
    replaced only in rows that contain one. Texts of one byte per character need none of it.
    """
    source, target, many = fold_tables()
    rare = char_class([c for c, _ in many])
    pairs = F.from_json(
        F.lit(json.dumps([{"c": c, "x": x} for c, x in many])), "array<struct<c: string, x: string>>"
    )

    def expand(low: Column) -> Column:
        present = F.filter(pairs, lambda p: low.contains(p["c"]))
        full = F.aggregate(present, low, lambda acc, p: F.replace(acc, p["c"], p["x"]))
        return F.when(low.rlike(rare), full).otherwise(low)

    folded = let(F.translate(F.lower(text), source, target), expand)
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(folded)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


@F.pandas_udf(T.ArrayType(T.StringType()))
def tokenize_exact(text: pd.Series) -> pd.Series:
    """The same tokens by the Unicode library, for tests of `tokenize`."""
    def one(value: str) -> list[str]:
        norm = unicodedata.normalize("NFKD", (value or "").lower())
        return re.findall(TOKEN, "".join(c for c in norm if not unicodedata.combining(c)))

    return text.map(one)


def hit_text() -> Column:
    """Text of an index row that the lexical score sees."""
    return F.concat_ws(
        " ", *[F.coalesce(F.col(c), F.lit("")) for c in
               ("station", "current_task", "current_sub_task", "log_text")]
    )


def context_text(start: Column) -> Column:
    """One line per retrieved row, as kept with an answer."""
    task = F.coalesce(F.expr("nullif(current_task, '')"), F.lit("idle"))
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Estação "), "station", F.lit(" | início: "), start),
        F.when(
            F.col("duration_s").isNotNull(),
            F.concat(F.lit("duração: "), num1(F.col("duration_s")), F.lit("s")),
        ),
        F.when(F.col("is_anomaly"), F.lit("[ANOMALIA DE DURAÇÃO]")),
        F.concat(F.lit("Task: "), task),
        F.when(F.col("current_sub_task") != "", F.concat(F.lit("Sub-task: "), "current_sub_task")),
        F.when(F.col("log_text") != "", F.concat(F.lit("Episódio: "), "log_text")),
    )


def dotted(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("."))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def stations_in(text: Column) -> Column:
    return F.array_distinct(_all(text, STATION))


def key_facts(reference: Column, question: Column) -> Column:
    """Numbers, station codes and, for impact answers, quoted names that the question lacks."""
    quoted = F.when(
        reference.startswith(IMPACT_PREFIX), F.transform(_all(reference, QUOTED, 1), F.lower)
    ).otherwise(F.array().cast("array<string>"))
    facts = F.array_distinct(
        F.concat(_all(reference, DECIMAL1), _all(reference, STATION), quoted)
    )
    return let(
        F.lower(dotted(question)),
        lambda seen: F.filter(facts, lambda f: ~seen.contains(F.lower(f))),
    )


def key_fact_recall(answer: Column, reference: Column, question: Column) -> Column:
    """Share of the key facts that the answer states; null without key facts."""
    said = F.lower(dotted(answer))
    parts = F.struct(
        key_facts(reference, question).alias("facts"), said.alias("said"),
        _all(said, GUARDED_DECIMAL1).alias("numbers"),
    )

    def share(p: Column) -> Column:
        found = F.filter(
            p["facts"],
            lambda f: F.when(
                f.rlike(rf"^{DECIMAL1}$"), F.array_contains(p["numbers"], f)
            ).otherwise(p["said"].contains(F.lower(f))),
        )
        return F.when(F.size(p["facts"]) > 0, F.size(found) / F.size(p["facts"]))

    return let(parts, share)


def anomaly_verdict(answer: Column) -> Column:
    low = F.lower(answer)
    return F.when(low.rlike(NEGATIVE_VERDICT), "nao").when(low.rlike(POSITIVE_VERDICT), "sim")


def classify_answer(answer: Column, key_fact: Column) -> Column:
    """Full refusal: declines in the opening and states no key fact (null counts as none)."""
    text = dotted(answer)
    opening = F.substring(text, 1, OPENING_CHARS)
    return (
        F.when(~text.rlike(DECLINE), ANSWER)
        .when(opening.rlike(DECLINE) & ~F.coalesce(key_fact > 0, F.lit(False)), REFUSAL)
        .otherwise(PARTIAL)
    )


def numbers_in(text: Column) -> Column:
    return F.array_distinct(
        F.transform(_all(dotted(text), DECIMAL), lambda x: x.cast("double"))
    )


def ungrounded_numbers(answer: Column, question: Column, contexts: Column) -> Column:
    allowed = numbers_in(F.concat_ws(" ", question, F.array_join(contexts, " ")))
    return F.size(F.array_except(numbers_in(answer), allowed))
