"""DuckDB definitions of the derived views, independent of the Spark operators."""

from __future__ import annotations

import math
import re

from millrace.functions.columns import DRAW_PRIME, DRAW_STRIDES, POISSON_EXACT, poisson_steps
from millrace.functions.process_rules import RULES, STATIONS
from millrace.plans.fixtures import (
    DEDUP_S, PAIR_WINDOW_S, RUNS, SYSTEMS, WINDOW_S, WORK_TASKS,
)

TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
SEC = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ts(x: str) -> str:
    return TS.format(x)


def sec(x: str) -> str:
    return SEC.format(x)


def num1(x: str) -> str:
    return f"cast(round(cast({x} as decimal(18,3)), 1) as varchar)"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hash_order(seed: str, key: str) -> str:
    return f"md5('{seed}|' || {key})"


def units(value: str) -> str:
    return f"cast(round({value}::double / 1e-9) as bigint)"


def fifth(rows: str, name: str) -> str:
    """`rows` with column `name` raised to its fifth power modulo the prime, step by step."""
    p = DRAW_PRIME
    return f"""
      select * exclude (q2, q4) replace ((q4 * {name}) % {p} as {name}) from (
        select *, (q2 * q2) % {p} q4 from (select *, ({name} * {name}) % {p} q2 from ({rows})))"""


def drawn(counts: str, key: str, replicates: int) -> str:
    """`counts` (with n) times replicates: two uniform numbers u1, u2 per row."""
    p = DRAW_PRIME
    part = lambda at: f"('0x' || substr(digest, {at}, 8))::bigint"
    rows = f"""
      select *, (rep * {DRAW_STRIDES[0]}) % {p} r from (
        select * exclude (digest), {part(1)} % {p - 1} + 1 ka, {part(9)} % {p} kb, {part(17)} % {p} kc
        from (select *, md5({key}) digest from ({counts}))), unnest(range(1, {replicates + 1})) t(rep)"""
    rows = fifth(f"select *, (ka * r + kb) % {p} x from ({fifth(rows, 'r')})", "x")
    rows = fifth(f"select * replace ((x + kc + rep * {DRAW_STRIDES[1]}) % {p} as x) from ({rows})", "x")
    rows = fifth(f"select *, (x + r + 1) % {p} y from ({rows})", "y")
    return f"select *, (x + 0.5) / {p}.0::double u1, (y + 0.5) / {p}.0::double u2 from ({rows})"


def poisson_count(mean: str) -> str:
    """From the columns u1 and u2."""
    exact = " ".join(
        f"when {mean} = {c} then " + " + ".join(f"(u1 >= {x!r}::double)::int" for x in poisson_steps(c))
        for c in range(1, POISSON_EXACT + 1)
    )
    normal = f"(sqrt(-2.0 * ln(u1)) * cos(2.0 * {math.pi!r} * u2))"
    large = f"greatest(0.0, floor({mean} + sqrt({mean}::double) * {normal} + ({normal} * {normal} - 1.0) / 6.0 + 0.5))"
    return f"case {exact} else {large} end::bigint"


def _in_list(items) -> str:
    return "[" + ", ".join(quote(i) for i in items) + "]"


CODES = _in_list(STATIONS)
RULE_VALUES = ",\n".join(
    f"({i}, {quote(s)}, {_in_list(k)}, {quote(a)}, {quote(p)}, {quote(n)})"
    for i, (s, k, a, p, n) in enumerate(RULES, start=1)
)
WORK = "case st " + " ".join(f"when '{s}' then {quote(t)}" for s, t in WORK_TASKS.items()) + " end"
CONTEXT_LINE = (
    "'Estação ' || station || ' | início: ' || {start} || ' | duração: ' || " + num1("duration_s")
    + " || 's' || case when is_anomaly then ' | [ANOMALIA DE DURAÇÃO]' else '' end"
    " || ' | Task: ' || case when current_task = '' then 'idle' else current_task end"
    " || case when current_sub_task <> '' then ' | Sub-task: ' || current_sub_task else '' end"
    " || case when log_text <> '' then ' | Episódio: ' || log_text else '' end"
)
FACT = (
    "'A estação ' || {p}station || ' ficou not ready por ' || " + num1("{p}duration_s")
    + " || 's executando ''' || {p}current_task || ''', sub-tarefa ''' || {p}current_sub_task || '''.'"
)
EXCESS = num1("cast(duration_s as decimal(18,3)) - cast(subtask_median_s as decimal(18,3))")
ANOMALY_REFERENCE = (
    "case when is_anomaly then 'Sim. A calibração do ' || motor || ' durou ' || " + num1("duration_s")
    + " || 's, ' || " + EXCESS + " || 's acima da mediana de ' || " + num1("subtask_median_s")
    + " || 's para essa sub-tarefa (limiar ' || " + num1("subtask_threshold_s")
    + " || 's): duração anômala.' else 'Não. A calibração do ' || motor || ' durou ' || "
    + num1("duration_s") + " || 's, dentro do normal (mediana de ' || " + num1("subtask_median_s")
    + " || 's para essa sub-tarefa).' end"
)
TIME_QUESTION = (
    "'A estação ' || station || ' ficou not ready em ' || " + sec("start_ts")
    + " || '. Qual tarefa e sub-tarefa ela estava executando e quanto tempo durou?'"
)
ANOMALY_QUESTION = (
    "'A calibração do ' || motor || ' da estação ' || station || ' iniciada em ' || "
    + sec("start_ts") + " || ' foi anormalmente longa em relação ao tempo típico?'"
)
MOTOR = "replace(current_sub_task, 'calibrating ', '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), '[a-z0-9_]+')"


def ordered_distinct(expr: str) -> str:
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def similar(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::double[], {b}::double[]), 9)"


VIEWS = {
    "rules": (
        "select * from (values\n" + RULE_VALUES
        + "\n) r(priority, station, keywords, activity, process, next_station)"
    ),
    "factory_events": f"""
        select *, case when event_type = 'signup' then 'ready' else 'not ready' end current_state,
          case when event_type = 'signup' then null
               when event_type in ('error', 'click') then 'calibrating all components'
               else {WORK} end current_task,
          case when event_type = 'signup' then null
               when event_type in ('error', 'click') then 'calibrating motor 4'
               else 'moving towards the oven' end current_sub_task,
          st station
        from (select event_id, event_type, lpad(cast(event_id as varchar), 12, '0') id,
                {CODES}[user_id % 7 + 1] st, ts event_timestamp, value current_task_duration,
                json_extract_string(props, '$.k') k, cast(event_id % 3 as varchar) m,
                cast(cast(value as decimal(10,2)) as varchar) pos,
                case when event_id % 10 < 7 then 'train' else 'test' end split
              from events)""",
    "bronze_docs": f"""
        select event_id n, split,
          '{{"id": "' || id || '", "station": "' || station || '", "timestamp": "'
          || {ts('event_timestamp')} || '", "current_state": "' || current_state
          || '", "current_task": ' || coalesce('"' || current_task || '"', 'null')
          || ', "current_task_duration": ' || cast(current_task_duration as varchar)
          || ', "current_sub_task": ' || coalesce('"' || current_sub_task || '"', 'null')
          || ', "k": ' || k || ', "m": ' || m || ', "pos": "' || pos || '"}}' doc, id
        from factory_events""",
    "bronze_first": """
        select n, split, case when n % 97 = 0 then substr(doc, 1, 60) when n % 101 = 0 then '  '
          when n % 103 = 0 then '[1]' when n % 107 = 0 then '{"station": "MM_1"}'
          when n % 109 = 0 then '{"id": "' || id || '", "timestamp": "soon"}' else doc end as value
        from bronze_docs""",
    "bronze_lines": """
        select value, split from bronze_first
        union all select value, 'test' from bronze_first where n % 50 = 0""",
    "bronze_typed": """
        select value line, split, trim(value) t,
          case when json_valid(value) then json_type(value) end kind,
          case when json_valid(value) then value else '{}' end doc
        from bronze_lines""",
    "classified": f"""
        select *, case when t = '' then 'blank' when kind is null then 'malformed'
          when kind <> 'OBJECT' then 'not_object' when id = '' then 'no_id'
          when event_timestamp is null then 'bad_timestamp' end reason
        from (select line, split, t, kind,
          coalesce(json_extract_string(doc, '$.id'), '') id,
          coalesce(json_extract_string(doc, '$.station'), '') station,
          try_cast(json_extract_string(doc, '$.timestamp') as timestamp) event_timestamp,
          coalesce(json_extract_string(doc, '$.current_state'), '') current_state,
          json_extract_string(doc, '$.current_task') current_task,
          try_cast(json_extract_string(doc, '$.current_task_duration') as double)
            current_task_duration,
          json_extract_string(doc, '$.current_sub_task') current_sub_task,
          'k=' || json_extract_string(doc, '$.k') || '|m=' || json_extract_string(doc, '$.m')
            || '|pos=' || json_extract_string(doc, '$.pos') sensors
        from bronze_typed)""",
    "silver_rows": "select * from classified where reason is null",
    "silver": """
        select * from silver_rows qualify row_number() over (
          partition by id order by case split when 'train' then 1 else 2 end, event_timestamp, line) = 1""",
    "marked": """
        select *, coalesce(current_task, '') t, coalesce(current_sub_task, '') s,
          case when lag(id) over w is null or lag(coalesce(current_task, '')) over w <> coalesce(current_task, '')
            or lag(coalesce(current_sub_task, '')) over w <> coalesce(current_sub_task, '')
            or lag(current_state) over w <> current_state then 1 else 0 end is_boundary
        from factory_events window w as (partition by station order by event_timestamp, id)""",
    "islands_of_rows": """
        select *, cast(sum(is_boundary) over (partition by station order by event_timestamp, id
          rows unbounded preceding) as bigint) episode_no from marked""",
    "all_episodes": """
        select station || '__' || strftime(start_ts, '%Y%m%d%H%M%S%f') episode_id, *,
          (duration_ms / 1000.0)::double duration_s from (
        select station, episode_no, first(current_state) current_state, first(t) current_task,
          first(s) current_sub_task, min(event_timestamp) start_ts, max(event_timestamp) end_ts,
          (epoch_us(max(event_timestamp)) - epoch_us(min(event_timestamp)) + 500) // 1000 duration_ms,
          cast(count(*) as integer) n_events,
          first(k order by event_timestamp, id) k0, last(k order by event_timestamp, id) k1,
          first(m order by event_timestamp, id) m0, last(m order by event_timestamp, id) m1,
          first(pos order by event_timestamp, id) p0, last(pos order by event_timestamp, id) p1
        from islands_of_rows group by station, episode_no)""",
    "episodes": "select * from all_episodes where n_events >= 2",
    "subtask_medians": """
        select current_sub_task, median(duration_ms) median_ms, count(*) n_episodes
        from episodes where current_state = 'not ready' group by 1""",
    "subtask_stats": """
        select m.current_sub_task, any_value(median_ms) median_ms, any_value(n_episodes) n_episodes,
          median(abs(duration_ms - median_ms)) mad_ms,
          any_value(median_ms) + 3 * median(abs(duration_ms - median_ms)) threshold_ms
        from episodes e join subtask_medians m using (current_sub_task)
        where current_state = 'not ready' group by 1""",
    "flagged": """
        select e.*, coalesce(duration_ms > threshold_ms and duration_ms - median_ms >= 2000, false) is_anomaly,
          floor(median_ms + 0.5) / 1000.0 subtask_median_s,
          floor(threshold_ms + 0.5) / 1000.0 subtask_threshold_s, median_ms, threshold_ms,
          list_filter(['k', 'm', 'pos'], lambda x: case x
            when 'k' then k0::double <> k1::double when 'm' then m0::double <> m1::double
            else p0::double <> p1::double end) changed
        from episodes e left join subtask_stats st
          on e.current_state = 'not ready' and e.current_sub_task = st.current_sub_task""",
    "gold": f"""
        select *, case when current_state = 'not ready' then
          'Estação ' || station || ' ficou not ready por ' || {num1('duration_s')}
          || 's executando ''' || case when current_task = '' then 'sem tarefa (ociosa)' else current_task end
          || ''', sub-tarefa ''' || case when current_sub_task = '' then '-' else current_sub_task end || '''. '
          || case when is_anomaly then 'Duração ANÔMALA: ' || {EXCESS}
            || 's acima do normal para esta sub-tarefa (mediana ' || {num1('subtask_median_s')} || 's). '
            else 'Duração dentro do normal (mediana da sub-tarefa: ' || {num1('subtask_median_s')} || 's). ' end
          else 'Estação ' || station || ' permaneceu ' || current_state || ' (ociosa) por '
          || {num1('duration_s')} || 's. ' end
          || 'Sensores que mudaram durante o episódio: '
          || case when len(changed) = 0 then 'nenhum' else array_to_string(changed, ', ') end || '.' as text
        from flagged""",
    "task_rules": """
        select station, current_task, activity, process, next_station from (
          select t.station, t.current_task, r.activity, r.process, r.next_station,
            row_number() over (partition by t.station, t.current_task order by r.priority) rn
          from (select distinct station, current_task,
                  case when lower(current_task) like 'picking up and transporting%'
                        and contains(lower(current_task), ' to the ')
                    then 'transport ' || split_part(lower(current_task), ' to the ', -1)
                    else lower(current_task) end low
                from gold where current_task <> '') t
          join rules r on r.station = t.station
            and len(list_filter(r.keywords, lambda k: not contains(t.low, k))) = 0)
        where rn = 1""",
    "mined": """
        select * exclude (current_task), current_task || ' (k ' || k0 || ')' current_task
        from gold where current_state = 'not ready'""",
    "index_rows": f"""
        select e.event_id vec_id, id event_id, station, event_timestamp start_ts, event_timestamp end_ts,
          current_state, coalesce(current_task, '') current_task,
          coalesce(current_sub_task, '') current_sub_task, current_task_duration duration_s,
          m = '0' is_anomaly,
          'Estação ' || station || ' ficou ' || current_state || ' por ' || {num1('current_task_duration')}
            || 's, leitura k ' || k || ' m ' || m || '.' log_text,
          k, embedding, label
        from factory_events e join embeddings v on v.vec_id = e.event_id""",
    "questions": f"""
        select 'q' || lpad(cast(a.vec_id as varchar), 6, '0') question_id, b.embedding,
          case a.vec_id % 6
            when 0 then 'A estação ' || a.station || ' ficou not ready em ' || {sec('a.start_ts')}
              || ' com leitura k ' || a.k || '?'
            when 1 then 'A estação ' || a.station || ' ficou not ready em '
              || strftime(a.start_ts, '%Y-%m-%d %H:%M') || ' com leitura k ' || a.k || '?'
            when 2 then 'O que a estação ' || a.station || ' fez com leitura k ' || a.k || '?'
            when 3 then 'Por volta de ' || {sec('a.start_ts')} || ', o que as estações ' || a.station
              || ' e ' || b.station || ' faziam?'
            when 4 then 'O que ocorreu em ' || {sec('a.start_ts')} || ' com leitura k ' || a.k || '?'
            else 'A estação ' || a.station || ' parou em '
              || {sec("a.start_ts + interval 25 minute")} || '?' end question,
          case when a.vec_id % 6 < 2 then 'factual' when a.vec_id % 6 = 3 then 'cross_station'
            else 'causal' end tier,
          case when a.vec_id % 6 = 2 then 'any' else 'all' end evidence_mode,
          case a.vec_id % 3 when 0 then 'sem_rag' when 1 then 'vetorial' else 'filtrada' end as mode,
          case when a.vec_id % 6 in (2, 3) then [a.event_id, b.event_id] else [a.event_id] end evidence_ids
        from index_rows a join index_rows b on b.vec_id = a.vec_id + 1 - 2 * (a.vec_id % 2)""",
    "evidence": "select question_id, unnest(evidence_ids) event_id from questions",
    "parsed_raw": f"""
        select *, {ordered_distinct("regexp_extract_all(question, '(?:^|[^0-9A-Za-z_])(' || '"
                                    + "|".join(STATIONS) + "' || ')\\b', 1)")} stations,
          regexp_extract(question, '\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}(:\\d{{2}}(\\.\\d+)?)?') raw
        from questions""",
    "parsed": f"""
        select *, case when length(raw) = 16 then ts0 else ts0 - interval {WINDOW_S} second end window_lo,
          case when length(raw) = 16 then ts0 + interval 59999999 microsecond
            else ts0 + interval {WINDOW_S} second end window_hi
        from (select *, try_cast(nullif(raw, '') as timestamp) ts0 from parsed_raw)""",
    "vector_scores": f"""
        select question_id, v.event_id, {similar('v.embedding', 'q.embedding')} score
        from questions q cross join index_rows v""",
    "vector_ranked": """
        select * from (select *, row_number() over (partition by question_id order by score desc, event_id) as rank
          from vector_scores) where rank <= 20""",
    "station_scores": f"""
        select question_id, q.station, v.event_id, n_stations,
          v.start_ts >= window_lo and v.start_ts <= window_hi as in_window,
          {similar('v.embedding', 'q.embedding')} score
        from (select *, unnest(stations) station, len(stations) n_stations from parsed) q
        join index_rows v on v.station = q.station""",
    "station_kept": """
        select * from (
          select *, row_number() over (partition by question_id, station order by score desc, event_id) probe_rank,
            case when n_stations = 1 then 20 else greatest(2, 5 // n_stations + 1) * 4 end lim
          from (select *, coalesce(bool_or(in_window) over (partition by question_id, station), false) any_in
                from station_scores)
          where in_window or not any_in) where probe_rank <= lim""",
    "filtered_ranked": """
        select question_id, event_id, score,
          row_number() over (partition by question_id order by score desc, event_id) as rank
        from (select question_id, event_id, max(score) score from station_kept group by all
          union all select v.question_id, event_id, score from vector_ranked v
            join parsed p using (question_id) where len(p.stations) = 0)""",
    "index_tokens": f"""
        select event_id, {tokens("station || ' ' || current_task || ' ' || current_sub_task || ' ' || log_text")} toks
        from index_rows""",
    "index_df": """
        select term, count(*) df from (select distinct event_id, unnest(toks) term from index_tokens) group by 1""",
    "question_terms": f"""
        select question_id, term, ln(1 + (n_docs - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) idf, avg_len
        from (select distinct question_id, unnest({tokens('question')}) term from questions)
        left join index_df using (term)
        cross join (select greatest(count(*), 1) n_docs, avg(len(toks)) avg_len from index_tokens)""",
    "index_tf": """
        select event_id, term, count(*) tf, any_value(n) doc_len
        from (select event_id, unnest(toks) term, len(toks) n from index_tokens) group by 1, 2""",
    "walk_hits": "select null",  # replaced by `dedup`
    "days": f"""
        select e.*, e.text log_text,
          extract(day from start_ts) * 1440 + extract(hour from start_ts) * 60
            + extract(minute from start_ts) + n_events h
        from gold e where current_state = 'not ready'""",
    "day_lines": f"""
        select *, {{'id': episode_id, 'line': {CONTEXT_LINE.format(start=ts('start_ts'))}}} ctx, {MOTOR} motor from days""",
    "day_lags": """
        select *, lag(ctx, 1) over w l1, lag(ctx, 2) over w l2 from day_lines
        window w as (partition by station, cast(start_ts as date) order by start_ts, episode_id)""",
    "run_systems": (
        "select * from (values "
        + ", ".join(f"({r}, '{m}', {s}, '{n}')" for r, m in enumerate(RUNS) for s, n in enumerate(SYSTEMS))
        + ") t(r, model, s, system)"
    ),
    "generations": f"""
        select *, list_transform(hits, lambda c: c.id) retrieved_ids,
          list_transform(hits, lambda c: c.line) retrieved_contexts,
          list_transform(hits, lambda c, i: (101 - i) / 100.0) scores,
          cast(length(question) + 100 * s as bigint) prompt_tokens,
          cast(length(question) + 100 * s + length(answer) as bigint) total_tokens,
          (x % 50) / 10.0 latency_s
        from (select *, case x % 7 when 0 then reference
            when 1 then translate(reference, '0123456789', '1234567890')
            when 2 then 'Não há informação suficiente nos episódios para responder a essa pergunta.'
            when 3 then log_text || ' Causa: não há registro da ação corretiva.'
            when 4 then '1. **Diagnóstico**: ' || log_text || chr(10) || chr(10)
              || '2. Causa provável: duração de ' || replace({num1('duration_s')}, '.', ',')
              || 's na estação ' || station || '.' || chr(10) || chr(10)
              || '3. Ação corretiva: verificar os sensores da estação ' || station
              || ' antes de reiniciar. Não foi possível confirmar a causa.'
            when 5 then 'Sim, a duração foi anormalmente longa: ' || {num1('duration_s')} || 's.'
            else 'Não, a duração está dentro do normal.' end answer
          from (select *, model || '[estrito]' run, 'estrito' prompt, 'off' rerank, episode_id id,
              h + 3 * s + 5 * r x,
              case h % 3 when 0 then 'factual' when 1 then 'cross_station' else 'causal' end tier,
              case when h % 4 = 0 then case when is_anomaly then 'anomalia_sim' else 'anomalia_nao' end
                else 'estacao_horario' end subtype,
              case when h % 4 = 0 then {ANOMALY_QUESTION} else {TIME_QUESTION} end question,
              case when h % 4 = 0 then {ANOMALY_REFERENCE} else {FACT.format(p='')} end reference,
              list_filter(case when s = 0 then []
                when s = 1 then case when (h + 3 * s + 5 * r) % 2 = 0 then [l1, ctx, l2] else [l1, l2] end
                else case when (h + 3 * s + 5 * r) % 3 <> 0 then [ctx, l1] else [l2, l1] end end,
                lambda c: c is not null) hits
            from day_lags cross join run_systems
            where r = 0 or station <> 'WT_1'))""",
    "score_rows": """
        select 'phi4' judge, run, id, system, tier, h, s, r, x,
          case when s > 0 and x % 13 <> 0 then ((h * 37 + s * 11 + r * 7) % 101) / 100.0 end faithfulness,
          ((h * 17 + s) % 101) / 100.0 answer_relevancy,
          case when s > 0 then ((h * 23 + s) % 101) / 100.0 end llm_context_precision_with_reference,
          case when s > 0 then ((h * 31 + r) % 101) / 100.0 end context_recall,
          case when x % 17 <> 0 then ((h * 29 + r) % 101) / 100.0 end factual_correctness
        from generations""",
    "facts": r"""
        select *, list_filter(list_distinct(list_concat(regexp_extract_all(reference, '\d+\.\d'),
            regexp_extract_all(reference, '\b[A-Z]{2,3}_\d\b'))),
          lambda f: not contains(lower(replace(question, ',', '.')), lower(f))) fact_list,
          lower(replace(answer, ',', '.')) said,
          list_transform(list_filter(
            regexp_extract_all(' ' || lower(replace(answer, ',', '.')), '[^\d.]\d+\.\d+'),
            lambda t: true), lambda t: substr(t, 2)) nums
        from generations""",
    "checked": r"""
        select *, len(fact_list) n_facts,
          case when len(fact_list) > 0 then len(list_filter(fact_list, lambda f:
            case when regexp_full_match(f, '\d+\.\d') then list_contains(nums, f)
              else contains(said, lower(f)) end)) / len(fact_list) end key_fact_recall,
          replace(answer, ',', '.') dotted
        from facts""",
    "classed": r"""
        select *, case when not regexp_matches(dotted, DECLINE) then 'resposta'
            when regexp_matches(substr(dotted, 1, 250), DECLINE) and not coalesce(key_fact_recall > 0, false)
              then 'recusa_total' else 'ressalva_parcial' end kind,
          case when regexp_matches(lower(answer), NEGATIVE) then 'nao'
            when regexp_matches(lower(answer), POSITIVE) then 'sim' end verdict,
          len(list_filter(list_distinct(list_transform(NUMS(dotted), lambda t: substr(t, 2)::double)),
            lambda v: not list_contains(list_transform(
              NUMS(replace(question || ' ' || array_to_string(retrieved_contexts, ' '), ',', '.')),
              lambda t: substr(t, 2)::double), v))) ungrounded
        from checked""",
    "report_rows": """
        select g.run, g.id, g.tier, g.subtype, g.system,
          case when g.s > 0 then (case when list_contains(retrieved_ids, g.id) then 1.0 else 0.0 end)::double end hit_at_k,
          case when g.s > 0 then coalesce(1.0 / list_position(retrieved_ids, g.id), 0.0)::double end mrr,
          case when g.s > 0 then (case when list_contains(retrieved_ids, g.id) then 1.0 else 0.0 end)::double end recall_at_k,
          key_fact_recall,
          case subtype when 'anomalia_sim' then (case when verdict = 'sim' then 1.0 else 0.0 end)::double
            when 'anomalia_nao' then (case when verdict = 'nao' then 1.0 else 0.0 end)::double end verdict_correct,
          sc.faithfulness::double faithfulness, sc.answer_relevancy::double answer_relevancy,
          sc.llm_context_precision_with_reference::double llm_context_precision_with_reference,
          sc.context_recall::double context_recall, sc.factual_correctness::double factual_correctness,
          g.latency_s::double latency_s, prompt_tokens, total_tokens, kind, ungrounded
        from classed g join score_rows sc using (run, id, system)""",
    "long_metrics": """
        select run, id, tier, system, metric, value from (
          unpivot (select run, id, tier, system, hit_at_k, mrr, recall_at_k, key_fact_recall, verdict_correct,
            faithfulness, answer_relevancy, llm_context_precision_with_reference, context_recall,
            factual_correctness from report_rows)
          on hit_at_k, mrr, recall_at_k, key_fact_recall, verdict_correct, faithfulness, answer_relevancy,
            llm_context_precision_with_reference, context_recall, factual_correctness
          into name metric value value)""",
    "judge_pairs": """
        select doc_id, quality + 1 - toxic human, ((doc_id * 37) % 101) / 100.0 judge,
          cast(doc_id % 3 as integer) run from labels""",
    "label_sheet": """
        select 'A' || doc_id amostra, case when doc_id % 17 = 0 then '' when doc_id % 19 = 0 then ' r '
            when doc_id % 23 = 0 then 'x' else cast(human as varchar) end rotulo,
          'o "texto"; longo' comentario, judge::double judge, run
        from judge_pairs""",
    "label_kinds": """
        select *, upper(trim(rotulo)) label, case upper(trim(rotulo)) when '' then 'blank' when 'R' then 'refusal'
            when '0' then 'label' when '1' then 'label' when '2' then 'label' else 'invalid' end label_kind
        from label_sheet""",
    "noise": """
        select run, doc_id sample, unnest([judge::double,
          (case when doc_id % 5 = 0 then judge + 0.125 else judge end)::double,
          (case when doc_id % 7 = 0 then null else judge end)::double]) as value from judge_pairs""",
    "perturb": """
        select lpad(cast(doc_id as varchar), 9, '0') as key,
          ['neutra', 'numero', 'estacao', 'contexto', 'referencia'][doc_id % 5 + 1] cond,
          case when doc_id % 5 < 4 then judge::double end original,
          (case when doc_id % 5 = 0 then judge::double + (doc_id % 9 - 4) / 64.0
            else greatest(0.0, judge::double - (doc_id % 5) / 16.0) end)::double perturbed
        from judge_pairs""",
    "activities": """
        select distinct 'Task_' || station || '_' || strftime(event_timestamp, '%Y%m%d%H') activityId,
          'process_' || station processDefinitionKey, date_trunc('hour', event_timestamp) startTime,
          date_trunc('hour', event_timestamp) + interval 40 minute endTime,
          cast(2400000 as bigint) durationInMillis
        from factory_events""",
    "pairs_in_window": f"""
        select a.episode_id a_id, a.station a_station, b.episode_id b_id, b.station b_station,
          epoch_us(b.start_ts) - epoch_us(a.start_ts) gap_us
        from mined a join mined b on a.station <> b.station and b.start_ts >= a.start_ts
          and b.start_ts <= a.start_ts + interval {int(PAIR_WINDOW_S) - 1} second
        where (select count(*) from mined c where c.station = a.station
            and date_trunc('second', c.start_ts) = date_trunc('second', a.start_ts)) = 1
          and (select count(*) from mined c where c.station = b.station
            and date_trunc('second', c.start_ts) = date_trunc('second', b.start_ts)) = 1
          and (select count(*) from mined c where c.station = a.station
            and abs(epoch_us(c.start_ts) - epoch_us(a.start_ts)) <= {int(PAIR_WINDOW_S * 1e6)}) = 1
          and (select count(*) from mined c where c.station = b.station
            and abs(epoch_us(c.start_ts) - epoch_us(a.start_ts)) <= {int(PAIR_WINDOW_S * 1e6)}) = 1""",
    "near_counts": f"""
        select station, episode_id, count(*) over (partition by station order by start_ts
          range between interval {int(PAIR_WINDOW_S)} second preceding
          and interval {int(PAIR_WINDOW_S)} second following) n_near from mined""",
}
del VIEWS["walk_hits"]

NUMS = r"regexp_extract_all(' ' || {}, '[^\d.]\d+\.\d+')"
DECLINE = (
    r"'(?i)(n[ãÃa]o h[áÁa](?:[^\pL\d_]|$)[^.\n]{0,80}?(?:informa|epis[óÓo]d|registr|dado|evid[êÊe]nc)"
    r"|n[ãÃa]o (?:[éÉe] poss[íÍi]vel|foi poss[íÍi]vel|existe[m]?|foi registrad|consta)"
    r"|(?:sem|nenhum) (?:epis[óÓo]dio|registro))'"
)


def _patterns() -> dict[str, str]:
    from millrace.functions.text import NEGATIVE_VERDICT, POSITIVE_VERDICT

    return {"NEGATIVE": quote(NEGATIVE_VERDICT), "POSITIVE": quote(POSITIVE_VERDICT), "DECLINE": DECLINE}


for _name, _sql in list(VIEWS.items()):
    for _key, _value in _patterns().items():
        _sql = re.sub(rf"\b{_key}\b", lambda m, v=_value: v, _sql)
    while "NUMS(" in _sql:
        at = _sql.index("NUMS(")
        depth, end = 0, at + 4
        while True:
            depth += {"(": 1, ")": -1}.get(_sql[end], 0)
            if depth == 0:
                break
            end += 1
        _sql = _sql[:at] + NUMS.format(_sql[at + 5:end]) + _sql[end + 1:]
    VIEWS[_name] = _sql


def dedup(ranked: str, k: int = 5, window_s: int = DEDUP_S) -> dict[str, str]:
    """CTEs that walk ranked hits and keep at most k without repeats; the result is `<ranked>_kept`."""
    w = window_s * 1_000_000
    return {
        f"{ranked}_fields": f"""
            select r.*, v.station, v.current_task, epoch_us(v.start_ts) us
            from {ranked} r join index_rows v using (event_id)""",
        f"{ranked}_walk": f"""
            select question_id, cast(0 as bigint) step,
              cast([] as struct(event_id varchar, station varchar, task varchar, us bigint, score double)[]) kept
            from (select distinct question_id from {ranked})
            union all
            select w.question_id, w.step + 1,
              case when len(w.kept) >= {k} or len(list_filter(w.kept, lambda x: x.station = h.station
                  and x.task = h.current_task and abs(x.us - h.us) <= {w})) > 0 then w.kept
                else list_append(w.kept, {{'event_id': h.event_id, 'station': h.station,
                  'task': h.current_task, 'us': h.us, 'score': h.score}}) end
            from {ranked}_walk w join {ranked}_fields h on h.question_id = w.question_id and h.rank = w.step + 1""",
        f"{ranked}_kept": f"""
            select question_id, i as rank, kept[i].event_id event_id, kept[i].score score
            from (select question_id, kept, unnest(range(1, len(kept) + 1)) i
              from (select question_id, arg_max(kept, step) kept from {ranked}_walk group by 1))""",
    }


def bm25(ranked: str) -> dict[str, str]:
    """CTEs that add a lexical score and the fused rank; the result is `<ranked>_fused`."""
    return {
        f"{ranked}_bm25": f"""
            select r.question_id, r.event_id, r.score, r.rank, round(coalesce(sum(
              q.idf * t.tf * 2.5 / (t.tf + 1.5 * (1 - 0.75 + 0.75 * t.doc_len / q.avg_len))), 0), 9) bm25
            from {ranked} r left join question_terms q on q.question_id = r.question_id
            left join index_tf t on t.event_id = r.event_id and t.term = q.term
            group by all""",
        f"{ranked}_fused": f"""
            select question_id, event_id, score, dense_rank, bm25, bm25_rank, rrf_score,
              row_number() over (partition by question_id order by round(rrf_score, 12) desc, dense_rank) as rank
            from (select question_id, event_id, score, rank as dense_rank, bm25, bm25_rank,
                1.0::double / (60 + rank) + 1.0::double / (60 + bm25_rank) rrf_score
              from (select *, row_number() over (partition by question_id order by bm25 desc, rank) bm25_rank
                from {ranked}_bm25))""",
    }


VIEWS.update(bm25("vector_ranked"))
VIEWS.update(bm25("filtered_ranked"))
for _r in ("vector_ranked", "filtered_ranked", "vector_ranked_fused", "filtered_ranked_fused"):
    VIEWS.update(dedup(_r))

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def round6(sql: str) -> str:
    """Let every round(x, 6) go through decimal(18,9), as the Spark side does."""
    at = 0
    while (at := sql.find("round(", at)) >= 0:
        depth, end = 0, at + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            if depth == 0:
                break
            end += 1
        inner = sql[at + 6:end]
        if inner.endswith(", 6") and not inner.startswith("cast("):
            new = f"round(cast({inner[:-3]} as decimal(18,9)), 6)::double"
            sql = sql[:at] + new + sql[end + 1:]
        at += 6
    return sql


def compose(sql: str) -> str:
    """Prefix `sql` with the views it uses, in dependency order."""
    sql = round6(sql)
    done: list[str] = []

    def visit(text: str, inside: tuple[str, ...]) -> None:
        for word in _WORD.findall(re.sub(r"'[^']*'", "''", text)):
            if word in VIEWS and word not in done and word not in inside:
                visit(VIEWS[word], (*inside, word))
                done.append(word)

    visit(sql, ())
    if not done:
        return sql
    parts = ",\n".join(
        f"{n} as {'' if n.endswith('_walk') else 'materialized '}({VIEWS[n]})" for n in done
    )
    return f"with recursive {parts}\n{sql}"
