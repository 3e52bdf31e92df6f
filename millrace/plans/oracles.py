"""DuckDB twins of the registered queries."""

from __future__ import annotations

from millrace.operators import prompts as pr
from millrace.plans.oracle_views import (
    ANOMALY_QUESTION, ANOMALY_REFERENCE, CONTEXT_LINE, FACT, MOTOR, TIME_QUESTION, compose, drawn, poisson_count, units,
    hash_order, num1, ordered_distinct, quote, sec, similar, tokens, ts,
)
from millrace.plans.fixtures import RUNS
from millrace.plans.registry import COMPARED, QUOTA, REPLICATES, SPACED
from millrace.sources.results import JUDGE_METRICS

SILVER = f"""id, station, {ts('event_timestamp')} event_timestamp, current_state, current_task,
  current_task_duration, current_sub_task, sensors, split"""
BPM = "'BPM: ' || activity || ' | Process: ' || process || ' | Next: ' || next_station"
WITH_RULES = "gold e left join task_rules t on t.station = e.station and t.current_task = e.current_task"
EMBED = f"'search_document: ' || e.text || coalesce(' | ' || {BPM}, '')"
IMPACT_PICK = f"""(select * from task_rules_mined where next_station not in ('-', 'idle', '') and next_station <> station
  qualify row_number() over (partition by station order by {hash_order('42', "station || '|' || current_task")}) = 1)"""


def hits(view: str, extra: str = "") -> str:
    return f"select question_id, rank, event_id, round(score, 6) score{extra} from {view}"


def replicated(rows: str, by: str, values: dict[str, str]) -> str:
    """Distinct values (name: its text) of each group with a Poisson weight per replicate."""
    names = ", ".join(values)
    key = " || '|' || ".join(["'42'", *(b.strip() for b in by.split(",")), *values.values()])
    counts = f"select {by}, {names}, count(*) n from ({rows}) group by {by}, {names}"
    return f"""
      select * from (select {by}, {names}, rep, {poisson_count('n')} w from ({drawn(counts, key, REPLICATES)}))
      where w > 0"""


def replicate_means(rows: str, by: str, value: str) -> str:
    weighted = replicated(f"select *, {units(value)} u from {rows}", by, {"u": "u::varchar"})
    return f"select {by}, rep, round(sum(w * u)::double / sum(w)::double * 1e-9, 9) m from ({weighted}) group by {by}, rep"


def ci(rows: str, by: str, value: str) -> str:
    return f"""
      select {by}, quantile_cont(m, 0.025) ci_low, quantile_cont(m, 0.975) ci_high
      from ({replicate_means(rows, by, value)}) group by {by}"""


def metrics_of(view: str) -> str:
    return f"""
      select q.question_id, q.tier,
        case when min(h.rank) is null then 0.0 else 1.0 end::double hit_at_k,
        coalesce(1.0 / min(h.rank), 0.0)::double mrr,
        case when any_value(q.evidence_mode) = 'any' then case when min(h.rank) is null then 0.0 else 1.0 end
          else count(distinct h.event_id) / any_value(len(q.evidence_ids)) end::double recall_at_k
      from questions q left join {view} h
        on h.question_id = q.question_id and list_contains(q.evidence_ids, h.event_id)
      group by q.question_id, q.tier"""


ABLATION = " union all ".join(
    f"select '{name}' config, * from ({metrics_of(view)})" for name, view in (
        ("vetorial", "vector_ranked_kept"), ("vetorial+BM25", "vector_ranked_fused_kept"),
        ("filtrado", "filtered_ranked_kept"), ("filtrado+BM25", "filtered_ranked_fused_kept"),
    )
)
ROUTED = """
  select v.* from vector_ranked_kept v join parsed p using (question_id)
    where mode = 'vetorial' or (mode = 'filtrada' and len(stations) = 0)
  union all select f.* from filtered_ranked_kept f join parsed p using (question_id)
    where mode = 'filtrada' and len(stations) > 0"""
RERANKED = ROUTED.replace("vector_ranked_kept", "vector_ranked_fused_kept").replace("filtered_ranked_kept", "filtered_ranked_fused_kept")
RUN_PAIRS = f"""
  select system, id, tier, metric, max(value) filter (run = '{RUNS[1]}[estrito]') a,
    max(value) filter (run = '{RUNS[0]}[estrito]') b
  from long_metrics where metric in ({', '.join(quote(m) for m in COMPARED)}) group by all
  having a is not null and b is not null"""
PAIRS = """
  select run, id, tier, metric, max(value) filter (system = 'rag_filtrado') a,
    max(value) filter (system = 'rag_vetorial') b
  from long_metrics group by all
  having a is not null and b is not null"""
CUTS = """
  select doc_id, run, lpad(cast(doc_id as varchar), 9, '0') as key, human, judge::double judge, 'A' cut, human = 2 yt, judge >= 0.999 yp from judge_pairs
  union all select doc_id, run, lpad(cast(doc_id as varchar), 9, '0'), human, judge::double, 'B', human >= 1, judge >= 0.5 from judge_pairs"""


def agreement(rows: str, by: str, w: str = "1") -> str:
    return f"""
      select *, (tp + tn) / (tp + fn + fp + tn) accuracy,
        case when tp + fn > 0 and fp + tn > 0 then 0.5 * (tp / (tp + fn) + tn / (fp + tn)) end balanced_accuracy,
        case when pe < 1 then ((tp + tn) / (tp + fn + fp + tn) - pe) / (1 - pe) end kappa
      from (select *, ((tp + fn) * (tp + fp) + (fp + tn) * (fn + tn)) / ((tp + fn + fp + tn) * (tp + fn + fp + tn)) pe
        from (select {by}, {', '.join(f"sum(case when {c} then {w} else 0 end)::bigint {n}" for n, c in (
            ('tp', 'yt and yp'), ('fn', 'yt and not yp'), ('fp', 'not yt and yp'), ('tn', 'not yt and not yp')))}
          from ({rows}) group by {by}))"""


def ranked(rows: str, by: str) -> str:
    avg = lambda c: (
        f"rank() over (partition by {by} order by {c}) + (count(*) over (partition by {by}, {c}) - 1) / 2.0"
    )
    return f"""
      select {by}, count(*) n, case when count(*) >= 3 and count(distinct human) > 1 and count(distinct judge) > 1
        then corr(rx, ry) end s
      from (select *, ({avg('human')})::double rx, ({avg('judge')})::double ry from ({rows})) group by {by}"""


def _boot_stat(rows: str, by: str, name: str, expr_rows: str, base_rows: str) -> str:
    return f"""
      select b.cut, '{name}' statistic, coalesce(i.n_valid, 0) n_valid, round(b.v, 6) estimate,
        round(case when i.n_valid >= {REPLICATES * 0.5} then i.lo end, 6) ci_low,
        round(case when i.n_valid >= {REPLICATES * 0.5} then i.hi end, 6) ci_high
      from ({base_rows}) b left join (select cut, count(v) n_valid, quantile_cont(round(v, 9), 0.025) lo,
        quantile_cont(round(v, 9), 0.975) hi from ({expr_rows}) where v is not null group by cut) i using (cut)"""


def ranked_weights(rows: str, by: str) -> str:
    """Rank correlation of weighted pairs: ties share the mean of their places."""
    part = lambda c: (
        f"select {by}, {c}, sum(sum(w)) over (partition by {by} order by {c}) - (sum(w) - 1) / 2.0 r"
        f" from ({rows}) group by {by}, {c}"
    )
    n = "sum(w)"
    v = lambda a, b: f"({n} * sum(w * {a} * {b}) - sum(w * {a}) * sum(w * {b}))::double"
    return f"""
      select {by}, case when {n} >= 3 and {v('h.r', 'h.r')} > 0 and {v('j.r', 'j.r')} > 0
        then {v('h.r', 'j.r')} / sqrt({v('h.r', 'h.r')} * {v('j.r', 'j.r')}) end s
      from ({rows}) x join ({part('human')}) h using ({by}, human) join ({part('u')}) j using ({by}, u) group by {by}"""


def statistic_bootstrap() -> str:
    weighted = replicated("select * from cuts", "cut", {"yt": "(yt::int)::varchar", "yp": "(yp::int)::varchar"})
    drawn_ordinal = replicated("select * from ordinal", "cut", {"human": "human::varchar", "u": "u::varchar"})
    parts = []
    for name in ("accuracy", "balanced_accuracy", "kappa"):
        parts.append(_boot_stat(
            "cuts", "cut", name,
            f"select cut, rep, {name} v from ({agreement('select * from drawn', 'cut, rep', 'w')})",
            f"select cut, {name} v from ({agreement('select * from cuts', 'cut')})",
        ))
    ordinal = f"select * replace ('ordinal' as cut), {units('judge')} u from cuts where cut = 'A'"
    parts.append(_boot_stat(
        "ordinal", "cut", "spearman",
        f"select cut, rep, s v from ({ranked_weights('select * from drawn_ordinal', 'cut, rep')})",
        f"select cut, s v from ({ranked('select * from ordinal', 'cut')})",
    ))
    return (
        f"select * from (with cuts as ({CUTS}), drawn as ({weighted}), ordinal as ({ordinal}), drawn_ordinal as "
        f"({drawn_ordinal}) " + " union all ".join(parts) + ")"
    )


CHANGES = """
  select p.*, round(perturbed - original, 9) delta, t.tolerance from perturb p cross join (
    select greatest(0.05::double, coalesce(quantile_cont(round(abs(perturbed - original), 9), 0.9), 0.05)) tolerance
    from perturb where cond = 'neutra') t
  where original is not null and perturbed is not null and cond <> 'referencia'"""
POOL = """
  select g.run, g.system, g.id, sc.faithfulness::double faithfulness, g.kind from classed g
  join score_rows sc using (run, id, system) where g.system <> 'baseline' and sc.faithfulness is not null"""


def spaced(rows: str, by: str, order: str, quota: str) -> str:
    """Rows at round-half-even(i*(n-1)/(q-1)) of the ordering."""
    part = f"partition by {by}" if by else ""
    return f"""
      select * from (select *, row_number() over ({part} order by {order}) - 1 pos,
          count(*) over ({part}) n from ({rows}))
      where pos in (select unnest(list_transform(range(0, least({quota}, n)),
        lambda i: cast(round_even(case when least({quota}, n) = 1 then 0
          else cast(i * (n - 1) / (least({quota}, n) - 1) as decimal(20,6)) end, 0) as bigint))))"""


def compare_text() -> str:
    f2 = lambda c: f"cast(round(cast({c} as decimal(18,9)), 2) as varchar)"
    base = f"""long_metrics where metric in ({', '.join(quote(m) for m in COMPARED)})
        and system in ('rag_filtrado', 'rag_vetorial')"""
    wide = ", ".join(f"max(t) filter (metric = '{m}') {m}" for m in COMPARED)
    return f"""
      select w.*, round(c.l, 6) latency_s_mean, round(c.t, 6) total_tokens_mean from (
        select run, system, {wide}
        from (select i.run, i.system, i.metric, {f2('m.mean')} || ' [' || {f2('ci_low')} || '; ' || {f2('ci_high')} || ']' t
          from ({ci(f'(select * from {base})', 'run, system, metric', 'value')}) i
          join (select run, system, metric, avg(value) mean from {base} group by all) m using (run, system, metric))
        group by run, system) w
      join (select run, system, avg(latency_s) l, avg(total_tokens) t from report_rows group by all) c using (run, system)"""


def prompt_sql() -> str:
    block = f"""
      '- [Rank ' || h.rank || ', similaridade: ' || cast(round(cast(h.score as decimal(18,9)), 2) as varchar) || ']'
      || case when v.is_anomaly then ' [ANOMALIA DE DURAÇÃO]' else '' end || ' Estação ' || v.station || ' | início: '
      || {ts('v.start_ts')} || ' | duração: ' || {num1('v.duration_s')} || 's' || chr(10) || '   State: ' || v.current_state
      || chr(10) || '   Task: ' || case when v.current_task = '' then 'idle' else v.current_task end
      || case when v.current_sub_task <> '' then chr(10) || '   Sub-task: ' || v.current_sub_task else '' end
      || case when v.log_text <> '' then chr(10) || '   Episódio: ' || v.log_text else '' end"""
    lines = lambda text: " || chr(10) || ".join(quote(x) for x in text.split("\n"))
    def full(name: str) -> str:
        return f"""select q.question_id, '{name}' template, {lines(pr.HEAD)} || chr(10) || {lines(pr.RULES[name])}
          || chr(10) || chr(10) || 'EPISÓDIOS:' || chr(10) || coalesce(c.ctx, '') || chr(10) || chr(10) || 'PERGUNTA:'
          || chr(10) || question || chr(10) || chr(10) || {lines(pr.TASK)} prompt
          from questions q left join blocks c using (question_id)"""

    plain = f"""select question_id, 'baseline' template, {lines(pr.BASELINE_HEAD)} || chr(10) || chr(10) || 'PERGUNTA:'
      || chr(10) || question || chr(10) || chr(10) || {lines(pr.TASK)} prompt from questions"""
    return f"""select * from (with blocks as (select h.question_id, string_agg({block}, chr(10) order by h.rank) ctx
      from vector_ranked_kept h join index_rows v using (event_id) group by 1)
      {full('estrito')} union all {full('brando')} union all {plain})"""


PAIR_QUOTAS_SQL = "(values ('HBW_1','VGR_1',4,0), ('MM_1','SM_1',2,1), ('SM_1','VGR_1',1,2), ('HBW_1','OV_1',1,3)) q(s1,s2,q,pos)"
PICKED_PAIRS = f"""
  select row_number() over (order by o0, o1, o2, s1, s2) as "position", a_id, a_station, b_id, b_station from (
    select p.*, case when r <= coalesce(q.q, 0) then 0 else 1 end o0,
      case when r <= coalesce(q.q, 0) then q.pos else r - coalesce(q.q, 0) end o1,
      case when r <= coalesce(q.q, 0) then r else -freq end o2
    from (select *, row_number() over (partition by s1, s2 order by h) r from (
        select *, min(h) over (partition by s1, s2) mh, count(*) over (partition by s1, s2) freq,
          not exists (select 1 from keyed o where o.h < k.h and (o.a_id in (k.a_id, k.b_id) or o.b_id in (k.a_id, k.b_id))) free
        from keyed k) where free) p
    left join {PAIR_QUOTAS_SQL} on q.s1 = p.s1 and q.s2 = p.s2)
  qualify "position" <= 8"""
KEYED = f"""
  select *, least(a_station, b_station) s1, greatest(a_station, b_station) s2,
    {hash_order('42', "a_id || '|' || b_id")} h from pairs_in_window"""


def round_robin(rows: str, stations: tuple[str, ...], n: int, seed: str) -> str:
    order = "list_position([" + ", ".join(quote(s) for s in stations) + "], station)"
    names = ", ".join(quote(s) for s in stations)
    return f"""
      select row_number() over (order by turn, {order}) as "position", * from (
        select *, row_number() over (partition by station order by {hash_order(seed, 'episode_id')}, episode_id) turn
        from ({rows}) where station in ({names}))
      where turn <= {n} qualify "position" <= {n}"""


ALONE = """select * from mined join near_counts using (station, episode_id) where n_near = 1"""
NOT_CALIBRATING = "current_task not like '%calibrat%'"
COMBO = "select min(episode_id) episode_id from mined group by station, current_task, current_sub_task having count(*) = 1"
SECOND = "select min(episode_id) episode_id from {v} group by station, date_trunc('second', start_ts) having count(*) = 1"
MOTOR4 = "(select * from mined where current_sub_task = 'calibrating motor 4')"
CASES = f"""
  select * from (select * from {MOTOR4} where is_anomaly and episode_id in ({SECOND.format(v=MOTOR4)})
    order by {hash_order('42', 'episode_id')} limit 3)
  union all select * from (select * from {MOTOR4} where not is_anomaly and episode_id in ({SECOND.format(v=MOTOR4)})
    and duration_s >= 0.8 * subtask_median_s and duration_s <= 1.25 * subtask_median_s
    order by {hash_order('42', 'episode_id')} limit 2)"""
RULES_MINED = """
  select station, current_task, activity, process, next_station from (
    select t.*, r.activity, r.process, r.next_station,
      row_number() over (partition by t.station, t.current_task order by r.priority) rn
    from (select distinct station, current_task, case when lower(current_task) like 'picking up and transporting%'
        and contains(lower(current_task), ' to the ') then 'transport ' || split_part(lower(current_task), ' to the ', -1)
        else lower(current_task) end low from mined) t
    join rules r on r.station = t.station and len(list_filter(r.keywords, lambda k: not contains(t.low, k))) = 0)
  where rn = 1"""
IMPACT_Q = """'Se a estação ' || station || ' ficar parada enquanto executa ''' || current_task
  || ''', qual atividade do processo é interrompida e qual é a próxima estação da linha?'"""
IMPACT_R = """'A atividade interrompida é ''' || activity || ''' (processo ' || process
  || '); a próxima estação do processo é ' || next_station || '.'"""
DESCRIBED_Q = """'Qual foi a duração do episódio em que a estação ' || station || ' executou ''' || current_task
  || ''' na sub-tarefa ''' || current_sub_task || '''?'"""


def pair_q(a: str, b: str, second: str) -> str:
    return f"""'Por volta de ' || {second} || ', as estações ' || {a} || ' e ' || {b}
      || ' ficaram not ready quase ao mesmo tempo. O que cada uma estava fazendo e por quanto tempo?'"""


def golden() -> str:
    stations_a = ("HBW_1", "VGR_1", "OV_1", "MM_1", "SM_1")
    stations_b = ("HBW_1", "OV_1", "VGR_1", "MM_1", "SM_1")
    one = "episode_id evidence, 'all' evidence_mode, station stations"
    return f"""
      select * from (with keyed as ({KEYED}), task_rules_mined as ({RULES_MINED}),
      timed as ({round_robin(f'select * from ({ALONE}) where {NOT_CALIBRATING}', stations_a, 4, '42a')}),
      described as ({round_robin(f'''select * from mined where {NOT_CALIBRATING} and episode_id in ({COMBO})
        and episode_id not in (select episode_id from timed)''', stations_b, 4, '42b')}),
      fac as (select "position" p, 'estacao_horario' subtype, {TIME_QUESTION} question, {FACT.format(p='')} reference, {one},
          {sec('start_ts')} moment, null::boolean is_anomaly from timed
        union all select "position" + 4, 'descricao_semantica', {DESCRIBED_Q}, {FACT.format(p='')}, {one}, null, null from described),
      cro as (select x."position" p, 'duas_estacoes' subtype, {pair_q('a.station', 'b.station', sec('a.start_ts'))} question,
          {FACT.format(p='a.')} || ' ' || {FACT.format(p='b.')} reference, x.a_id || '|' || x.b_id evidence, 'all' evidence_mode,
          a.station || '|' || b.station stations, {sec('a.start_ts')} moment, null::boolean is_anomaly
        from ({PICKED_PAIRS}) x join mined a on a.episode_id = x.a_id join mined b on b.episode_id = x.b_id),
      cau as (select row_number() over (order by is_anomaly desc, {hash_order('42', 'episode_id')}) p,
          case when is_anomaly then 'anomalia_sim' else 'anomalia_nao' end subtype, {ANOMALY_QUESTION} question,
          {ANOMALY_REFERENCE} reference, {one}, {sec('start_ts')} moment, is_anomaly
        from (select *, {MOTOR} motor from ({CASES}))
        union all select * from (select 5 + row_number() over (order by {hash_order('42', "station || '|' || current_task")}) p,
          'impacto_bpm', {IMPACT_Q}, {IMPACT_R}, null, 'any', station, null, null from {IMPACT_PICK}) where p <= 8),
      items as (select 'factual' tier, * from fac union all select 'cross_station', * from cro union all select 'causal', * from cau)
      select substr(tier, 1, 3) || '-' || lpad(cast(row_number() over (partition by tier order by p) as varchar), 2, '0') id,
        tier, subtype, question, reference, evidence, evidence_mode, stations, moment, is_anomaly from items)"""


def label_sample(score: str) -> str:
    """The blind sample: name, run, system, id and the score column as asked."""
    return f"""
      select * from (with p as (select * from ({POOL}) where kind <> 'recusa_total'),
        cells as (select run, system, count(*) n from p group by 1, 2),
        slots as (select run, system, unnest(range(1, n + 1)) slot from cells),
        quotas as (select run, system, count(*) quota from (select * from slots order by slot, run, system
          limit (select count(*) * {QUOTA} from cells)) group by 1, 2),
        picked as ({spaced('select p.*, quota from p join quotas using (run, system)', 'run, system', 'faithfulness, id', 'quota')})
      select 'A' || case when no < 10 then '0' else '' end || no sample, run, system, id, {score} faithfulness
      from (select *, row_number() over (order by {hash_order('42', "run || '|' || system || '|' || id")}) no from picked))"""


DRAWN_CI = {
    "bootstrap_ci": f"""
      select i.run, i.system, i.metric, n, round(mean, 6) mean, round(ci_low, 6) ci_low, round(ci_high, 6) ci_high
      from ({ci("(select * from long_metrics)", 'run, system, metric', 'value')}) i
      join (select run, system, metric, avg(value) mean, count(*) n from long_metrics group by all) b using (run, system, metric)""",
    "paired_bootstrap": f"""
      select i.*, b.n, round(b.diff, 6) diff from (
        select run, metric, round(quantile_cont(m, 0.025), 6) ci_low, round(quantile_cont(m, 0.975), 6) ci_high,
          round(least(1.0, 2.0 * least(avg((m <= 0)::int::double), avg((m >= 0)::int::double))), 6) p_approx
        from ({replicate_means(f'(select run, metric, a - b d from ({PAIRS}))', 'run, metric', 'd')})
        group by run, metric) i
      join (select run, metric, avg(a - b) diff, count(*) n from ({PAIRS}) group by all) b using (run, metric)""",
    "run_difference": f"""
      select i.*, b.n, round(b.diff, 6) diff from (
        select system, metric, round(quantile_cont(m, 0.025), 6) ci_low, round(quantile_cont(m, 0.975), 6) ci_high,
          round(least(1.0, 2.0 * least(avg((m <= 0)::int::double), avg((m >= 0)::int::double))), 6) p_approx
        from ({replicate_means(f'(select system, metric, a - b d from ({RUN_PAIRS}))', 'system, metric', 'd')})
        group by system, metric) i
      join (select system, metric, avg(a - b) diff, count(*) n from ({RUN_PAIRS}) group by all) b using (system, metric)""",
    "perturb_report": f"""
      select b.*, round(dm, 6) delta_mean, round(dl, 6) delta_ci_low, round(dh, 6) delta_ci_high,
        round(tm, 6) detection_mean, round(tl, 6) detection_ci_low, round(th, 6) detection_ci_high
      from (select cond, count(*) n, count(*) filter (delta < -tolerance) fell,
          count(*) filter (abs(delta) <= tolerance) same, count(*) filter (delta > tolerance) rose,
          round(any_value(tolerance), 6) tolerance, round(avg(original), 6) mean_original,
          round(avg(perturbed), 6) mean_perturbed from ({CHANGES}) group by cond) b
      join (select cond, avg(delta) dm from ({CHANGES}) group by 1) using (cond)
      join (select cond, ci_low dl, ci_high dh from ({ci(f"(select cond, 'delta' measure, delta from ({CHANGES}))", 'cond, measure', 'delta')})) using (cond)
      left join (select cond, avg(v) tm from (select cond, (delta < -tolerance)::int::double v from ({CHANGES})
        where cond <> 'neutra') group by 1) using (cond)
      left join (select cond, ci_low tl, ci_high th from ({ci(f"(select cond, 'detection' measure, (delta < -tolerance)::int::double v from ({CHANGES}) where cond <> 'neutra')", 'cond, measure', 'v')})) using (cond)""",
}

RAW: dict[str, str] = {
    "silver_parse": f"select {SILVER} from silver_rows",
    "silver_rejects": "select split, line, reason from classified where reason is not null",
    "silver_dedup": f"select {SILVER} from silver",
    "ingest_counts": """
  select coalesce(split, 'all') split, cast(sum(n) as bigint) attempted, cast(sum(k) as bigint) kept,
    cast(sum(n - k) as bigint) duplicates
  from (select id, split, count(*) n, case when split = (case when bool_or(split = 'train') over (partition by id)
      then 'train' else 'test' end) then 1 else 0 end k from silver_rows group by id, split)
  group by rollup (split)""",
    "split_tagged_union": "select value, split from bronze_lines",
    "silver_export": f"select {SILVER} from silver",
    "gold_rebuild": "select episode_id, station, n_events, duration_s, text from gold",
    "index_table": f"""
      select * from (with i as (select e.episode_id event_id, e.station, {ts('start_ts')} start_ts, {ts('end_ts')} end_ts, current_state,
        e.current_task, current_sub_task, round(duration_s::float::double, 3) duration_s, is_anomaly, e.text log_text, {EMBED} embed_text,
        cast(64 as integer) dim
      from {WITH_RULES} where current_state = 'not ready'),
        cells as (select event_id, cast(cast('0x' || substr(md5(tok), 1, 8) as bigint) % 64 as integer) d, count(*)::double n
          from (select event_id, unnest({tokens('embed_text')}) tok from i) group by 1, 2),
        weights as (select event_id, d, n / sqrt(sum(n * n) over (partition by event_id)) w from cells),
        vectors as (select event_id, string_agg(d || ':' || cast(round(w * 1000000) as bigint), '|' order by d) vector from weights group by 1)
      select i.*, coalesce(vector, '') vector from i left join vectors using (event_id))""",
    "read_generations": """
      select run, id, system, tier, subtype, question, reference, answer, array_to_string(retrieved_ids, '|') retrieved_ids,
        array_to_string(retrieved_contexts, '|') retrieved_contexts, cast(len(scores) as integer) n_scores, total_tokens,
        round(latency_s, 6)::double latency_s from generations""",
    "append_results": "select model, id, system, answer from generations",
    "read_labels": """
      select label_kind, label, comentario, count(*) n from label_kinds group by all""",
    "process_activities": f"""
      select activityId, processDefinitionKey, {ts('startTime')} startTime, {ts('endTime')} endTime, durationInMillis
      from activities""",
    "judge_scores": "select 'phi4' judge, g.run, g.id, g.system, g.tier, "
    + ", ".join(f"round(sc.{m}, 6)::double {m}" for m in JUDGE_METRICS)
    + " from generations g join score_rows sc using (run, id, system)",
    "filter_split": f"""
      select id, station, {ts('event_timestamp')} event_timestamp, current_state, current_task, current_sub_task
      from factory_events where split = 'train'""",
    "filter_station_state": """
      select id, current_task from factory_events where station = 'MM_1' and current_state = 'not ready'""",
    "sensor_access": "select id, k k_text, try_cast(k as integer) k_int, null::integer missing from factory_events",
    "index_selection": f"""
      select episode_id, current_state from gold where current_state = 'not ready'
      union all select * from (select episode_id, current_state from gold where current_state = 'ready'
        order by {hash_order('42', 'episode_id')}, episode_id limit 25)""",
    "scalar_filter": """
      select q.question_id, q.station, count(v.event_id) n
      from (select *, unnest(stations) station from parsed) q
      left join index_rows v on v.station = q.station and (window_lo is null or (v.start_ts between window_lo and window_hi))
      group by 1, 2""",
    "drop_calibration": f"select episode_id, current_task from gold where {NOT_CALIBRATING}",
    "near_median_negatives": """
      select episode_id, duration_s, subtask_median_s from gold
      where not is_anomaly and duration_s >= 0.8 * subtask_median_s and duration_s <= 1.25 * subtask_median_s""",
    "min_events_filter": """
      select count(*) filter (n_events >= 2) kept, count(*) filter (n_events < 2) dropped from all_episodes""",
    "mode_routing": hits(f"({ROUTED})"),
    "mode_routing_reranked": hits(f"({RERANKED})"),
    "positive_control_summary": """
      select count(*) n, round(avg(perturbed), 6) mean, round(avg((perturbed >= 0.8)::int::double), 6) share_ge_08,
        round(min(perturbed), 6)::double min, round(max(perturbed), 6)::double max
      from perturb where cond = 'referencia' and perturbed is not null""",
    "bpm_context": f"""
      select e.episode_id, e.station, e.current_task, activity, process, next_station from {WITH_RULES}""",
    "subtask_stats_join": "select episode_id, median_ms, threshold_ms from flagged",
    "activity_interval_join": """
      select activityId, count(*) n, min(id) first_id, max(id) last_id from factory_events
      join activities on event_timestamp >= startTime and event_timestamp <= endTime group by 1""",
    "cross_station_pairs": "select a_id, a_station, b_id, b_station, gap_us from pairs_in_window",
    "unique_in_window": "select station, episode_id from near_counts where n_near = 1",
    "resume_anti_join": """
      select id, system from generations where r = 0
        and (id, system) not in (select (id, system) from generations where r = 1)""",
    "report_rows": "select run, id, tier, subtype, system, " + ", ".join(
        f"round({m}, 6) {m}" for m in ("hit_at_k", "mrr", "recall_at_k", "key_fact_recall", "verdict_correct",
                                       *JUDGE_METRICS, "latency_s")
    ) + ", prompt_tokens, total_tokens from report_rows",
    "paired_join": f"select run, id, tier, metric, round(a, 6) a, round(b, 6) b from ({PAIRS})",
    "evidence_match": """
      select question_id, rank, event_id from vector_ranked join (select distinct * from evidence) using (question_id, event_id)""",
    "foreign_context": r"""
      select * from (with pool as (
          select run, id, system, answer, list_distinct(list_concat(retrieved_ids, ['q:' || id])) keys, len(retrieved_contexts) n_ctx,
            list_sort(list_distinct(regexp_extract_all(array_to_string(retrieved_contexts, ' '), '\b[A-Z]{2,3}_\d\b'))) cs,
            list_sort(list_distinct(regexp_extract_all(answer, '\b[A-Z]{2,3}_\d\b'))) ans
          from generations where s > 0),
        allowed as (select a.run, a.ans, c.cs from (select distinct run, ans from pool) a
          join (select distinct run, cs from pool where n_ctx > 0) c using (run) where not list_has_any(c.cs, a.ans)),
        numbered as (select p.run, a.ans, p.id, p.system, p.keys,
            row_number() over (partition by p.run, a.ans order by p.id, p.system) no
          from allowed a join pool p on p.run = a.run and p.cs = a.cs where n_ctx > 0),
        sizes as (select run, ans, count(*) n from numbered group by run, ans),
        places as (select run, ans, no, unnest(keys) k from numbered),
        ruled as (select distinct q.run, q.id, q.system, p.no
          from (select run, id, system, ans, unnest(keys) k from pool) q join places p using (run, ans, k)),
        outs as (select *, row_number() over (partition by run, id, system order by no) j from ruled),
        free as (select q.run, q.id, q.system, q.ans, length(any_value(q.answer)) len, any_value(s.n) - count(o.no) n
          from pool q join sizes s using (run, ans) left join outs o on o.run = q.run and o.id = q.id and o.system = q.system
          group by q.run, q.id, q.system, q.ans),
        chosen as (select f.run, f.id, f.system, f.ans, any_value(f.len % f.n + 1) + count(o.no) no
          from free f left join outs o on o.run = f.run and o.id = f.id and o.system = f.system and o.no - o.j < f.len % f.n + 1
          where f.n > 0 group by f.run, f.id, f.system, f.ans)
      select c.run, c.id, c.system, t.id foreign_id, t.system foreign_system
      from chosen c join numbered t using (run, ans, no))""",
    "limit_semi_join": """
      select run, id, system from generations where id in (
        select episode_id from gold where current_state = 'not ready' order by episode_id limit 50)""",
    "bpm_impact_groups": f"""
      select * from (with task_rules_mined as ({RULES_MINED})
      select station, current_task, activity, process, next_station, episode_id
      from {IMPACT_PICK} join (select station, current_task, episode_id from mined) using (station, current_task))""",
    "episodes": f"""
      select episode_id, station, current_state, current_task, current_sub_task, {ts('start_ts')} start_ts,
        {ts('end_ts')} end_ts, duration_s, n_events, 'k=' || k0 || '|m=' || m0 || '|pos=' || p0 sensors_start,
        'k=' || k1 || '|m=' || m1 || '|pos=' || p1 sensors_end from episodes""",
    "sensor_delta": """
      select episode_id, array_to_string(list_transform(changed, lambda x: x || ':' || case x when 'k' then k0 || '>' || k1
        when 'm' then m0 || '>' || m1 else p0 || '>' || p1 end), '|') changed from flagged""",
    "subtask_median_mad": "select current_sub_task, n_episodes, median_ms, mad_ms, threshold_ms from subtask_stats",
    "anomaly_flag": "select episode_id, duration_s, is_anomaly, subtask_median_s, subtask_threshold_s from flagged",
    "split_counts": "select split, count(*) n from factory_events group by 1",
    "episode_summary": """
      select count(*) episodes, count(*) filter (current_state = 'not ready') not_ready,
        count(*) filter (current_state = 'ready') ready, count(*) filter (is_anomaly) anomalies from gold""",
    "bm25_corpus_stats": f"""
      select * from (with t as (select doc_id, {tokens('text')} toks from documents)
      select term, df, n_docs, round(avg_len, 6) avg_len from (
        select term, count(*) df from (select distinct doc_id, unnest(toks) term from t) group by 1)
      cross join (select greatest(count(*), 1) n_docs, avg(len(toks)) avg_len from t))""",
    "retrieval_metrics": f"""
      select question_id, tier, round(hit_at_k, 6) hit_at_k, round(mrr, 6) mrr, round(recall_at_k, 6) recall_at_k
      from ({metrics_of('filtered_ranked_kept')})""",
    "metrics_report": """
      select run, system, metric, coalesce(tier, 'all') tier, round(avg(value), 6) mean, count(*) n from long_metrics
      group by grouping sets ((run, system, metric), (run, system, metric, tier))""",
    "cost_report": """
      select run, system, round(avg(latency_s), 6) latency_s_mean, round(avg(prompt_tokens), 6) prompt_tokens_mean,
        round(avg(total_tokens), 6) total_tokens_mean from report_rows group by 1, 2""",
    "missing_scores": "select * from (" + " union all ".join(
        f"select run, system, '{m}' metric, count(*) filter ({m} is null) missing from report_rows group by 1, 2"
        for m in JUDGE_METRICS
    ) + ") where system <> 'baseline' or metric in ('answer_relevancy', 'factual_correctness')",
    "statistic_bootstrap": statistic_bootstrap(),
    "spearman": f"select run, n, round(s, 6) spearman from ({ranked('select * from judge_pairs', 'run')})",
    "agreement": f"""
      select run, cut, tp, fn, fp, tn, round(accuracy, 6) accuracy, round(balanced_accuracy, 6) balanced_accuracy,
        round(kappa, 6) kappa from ({agreement(CUTS, 'run, cut')})""",
    "judge_mean_by_label": """
      select label, count(*) n, round(avg(judge), 6) judge_mean from label_kinds
      where label_kind in ('label', 'refusal') group by 1""",
    "judge_noise": """
      select run, count(*) n_valid, count(*) filter (a = 0) identical, round(avg(a), 6) amplitude_mean,
        round(max(a), 6) amplitude_max
      from (select run, sample, max(value) - min(value) a from noise group by 1, 2 having count(value) > 1) group by 1""",
    "refusal_matrix": """
      select run, system, count(*) n, count(*) filter (hit) with_evidence,
        count(*) filter (hit and kind = 'recusa_total') undue_refusal,
        count(*) filter (hit and kind = 'ressalva_parcial') partial_caveat,
        count(*) filter (not hit and kind = 'recusa_total') correct_refusal,
        count(*) filter (not hit and kind <> 'recusa_total') answered_without_evidence,
        count(*) filter (ungrounded > 0) with_ungrounded_number, round(avg(key_fact_recall), 6) key_fact_mean
      from (select *, list_contains(retrieved_ids, id) hit from classed where s > 0
        and (system, id) in (select (system, id) from generations where s > 0 group by system, id having count(distinct run) = 2))
      group by 1, 2""",
    "refusal_score_bands": f"""
      select run, count(*) n_refusals, count(*) filter (faithfulness = 0) zero,
        count(*) filter (faithfulness > 0 and faithfulness < 0.999) middle, count(*) filter (faithfulness >= 0.999) one,
        round(avg(faithfulness), 6) mean from ({POOL}) where kind = 'recusa_total' group by 1""",
    "tier_subtype_counts": "select tier, subtype, count(distinct id) n from generations group by 1, 2",
    "metric_compare": compare_text(),
    "episode_boundaries": "select id, station, is_boundary, episode_no from islands_of_rows",
    "unique_in_second": SECOND.format(v="mined"),
    "unique_combo": COMBO,
    "range_count": "select station, episode_id, n_near from near_counts",
    "rank_in_question": hits("vector_ranked"),
    "avg_rank": """
      select distinct run, round(judge, 6)::double judge,
        (rank() over (partition by run order by judge) + (count(*) over (partition by run, judge) - 1) / 2.0)::double as rank
      from judge_pairs""",
    "cell_row_number": """
      select run, system, id, row_number() over (partition by run, system order by faithfulness, id) ordinal,
        count(*) over (partition by run, system) cell_size from score_rows where faithfulness is not null""",
    "knn_topk": hits("vector_ranked"),
    "knn_filtered": """
      select question_id, probe_rank as rank, event_id, round(score, 6) score from (
        select *, row_number() over (partition by question_id order by score desc, event_id) probe_rank
        from station_scores where n_stations = 1
          and (in_window or question_id in (select question_id from parsed where window_lo is null)))
      where probe_rank <= 20""",
    "window_fallback": """
      select question_id, station, event_id, round(score, 6) score, probe_rank as rank from station_kept""",
    "ann_partitioned": f"""
      select * from (with cent as (select label list_id, list(m order by d) centroid from (
          select label, d, round(avg(x::double), 12) m from (
            select label, unnest(embedding) x, generate_subscripts(embedding, 1) d from index_rows) group by 1, 2) group by 1),
        assigned as (select event_id, embedding, list_id from (select v.event_id, v.embedding, c.list_id,
          row_number() over (partition by v.event_id order by {similar('v.embedding', 'c.centroid')} desc, c.list_id) rn
          from index_rows v cross join cent c) where rn = 1),
        probed as (select question_id, embedding, list_id from (select q.question_id, q.embedding, c.list_id,
          row_number() over (partition by q.question_id order by {similar('q.embedding', 'c.centroid')} desc, c.list_id) rn
          from questions q cross join cent c) where rn <= 3)
      select question_id, rank, event_id, round(score, 6) score from (
        select question_id, event_id, score, row_number() over (partition by question_id order by score desc, event_id) as rank
        from (select p.question_id, a.event_id, {similar('a.embedding', 'p.embedding')} score
          from probed p join assigned a using (list_id))) where rank <= 20)""",
    "multi_station_merge": """
      select question_id, event_id, round(score, 6) score,
        row_number() over (partition by question_id order by score desc, event_id) as rank
      from (select question_id, event_id, max(score) score from station_kept where n_stations > 1 group by 1, 2)""",
    "greedy_time_dedup": hits("vector_ranked_kept"),
    "bm25_score": f"""
      select * from (with t as (select doc_id, {tokens('text')} toks from documents),
        tf as (select doc_id, term, count(*) tf, any_value(n) dl from (select doc_id, unnest(toks) term, len(toks) n from t) group by 1, 2),
        dfs as (select term, count(*) df from tf group by 1),
        size as (select greatest(count(*), 1) n_docs, avg(len(toks)) avg_len from t),
        qt as (select distinct item_id, unnest({tokens('text')}) term from benchmark)
      select item_id, doc_id, rank, round(bm25, 6) bm25 from (
        select *, row_number() over (partition by item_id order by bm25 desc, doc_id) as rank from (
          select item_id, doc_id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5
            / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avg_len))), 9) bm25
          from qt join tf using (term) join dfs using (term) cross join size group by 1, 2)) where rank <= 20)""",
    "rrf_fuse": hits("vector_ranked_fused", ", dense_rank, round(bm25, 6) bm25, bm25_rank, round(rrf_score * 1000, 6) rrf_score"),
    "retrieve_vector": hits("vector_ranked_fused_kept"),
    "retrieve_filtered": hits("filtered_ranked_fused_kept"),
    "retrieval_ablation": f"""
      select config, coalesce(tier, 'all') tier, round(avg(hit_at_k), 6) hit_at_k, round(avg(mrr), 6) mrr,
        round(avg(recall_at_k), 6) recall_at_k, count(*) n from ({ABLATION})
      group by grouping sets ((config), (config, tier))""",
    "rank_changes": f"""
      select * from (with per as ({ABLATION})
      select a.config base, a.question_id, round(a.mrr, 6) mrr_before, round(b.mrr, 6) mrr_after,
        a.hit_at_k hit_at_k_before, b.hit_at_k hit_at_k_after
      from per a join per b on b.config = a.config || '+BM25' and a.question_id = b.question_id
      where abs(a.mrr - b.mrr) > 1e-9 or a.hit_at_k <> b.hit_at_k)""",
    "top_longest": """
      select id, station, current_task_duration from factory_events where current_state = 'not ready'
      order by current_task_duration desc, id limit 25""",
    "evenly_spaced_sample": f"""
      select run, doc_id from ({spaced('select * from judge_pairs', 'run', 'judge, doc_id', str(SPACED))})""",
    "round_robin_quota": f"""
      select * from (with cells as (select run, system, count(*) n from ({POOL}) where kind <> 'recusa_total' group by 1, 2),
        slots as (select run, system, unnest(range(1, n + 1)) slot from cells)
      select c.run, c.system, c.n, coalesce(q.quota, 0) quota from cells c left join (
        select run, system, count(*) quota from (select * from slots order by slot, run, system
          limit (select count(*) * {QUOTA} from cells)) group by 1, 2) q using (run, system))""",
    "blind_shuffle": f"""
      select doc_id, 'A' || case when no < 10 then '0' else '' end || no sample from (
        select doc_id, row_number() over (order by {hash_order('42', "lpad(cast(doc_id as varchar), 9, '0')")}) no from judge_pairs)""",
    "every_nth": """
      select id from (select episode_id id, row_number() over (order by episode_id) - 1 rn, count(*) over () n
        from gold where current_state = 'not ready')
      where rn % greatest(1, n // 30) = 0 and rn // greatest(1, n // 30) < 30""",
    "per_station_round_robin": 'select "position", station, episode_id from (' + round_robin(
        f"select * from mined where {NOT_CALIBRATING}", ("HBW_1", "VGR_1", "OV_1", "MM_1", "SM_1"), 12, "42a") + ")",
    "pair_quota_select": f"select * from (with keyed as ({KEYED}) {PICKED_PAIRS})",
    "label_sample": label_sample("round(faithfulness, 6)"),
    "labelling_sheet": f"""
      select l.sample amostra, g.question pergunta, array_to_string(list_transform(g.retrieved_contexts, lambda c, i: '[' || i || '] ' || c), chr(10))
        contexto_recuperado, g.answer resposta, '' rotulo, '' comentario
      from ({label_sample('faithfulness')}) l join generations g using (run, system, id)""",
    "labelling_key": f"""
      select l.sample amostra, l.run, l.system, l.id, g.tier, round(l.faithfulness, 6) faithfulness_juiz
      from ({label_sample('faithfulness')}) l join generations g using (run, system, id)""",
    "labelling_subset": f"""
      select l.sample amostra, g.question pergunta, g.answer resposta
      from ({spaced(f"select * from ({label_sample('faithfulness')})", "", "faithfulness, cast(substr(sample, 2) as bigint)", "25")}) l
      join generations g using (run, system, id)""",
    "claim_scores": """
      select run, id, system, count(claim_no) n_claims, cast(max(x % 3) as bigint) n_declined,
        count(claim_no) filter (code = 3) n_unparsed, round(avg(case when code < 3 then (code > 0)::int::double end), 6) share_supported
      from (select run, id, system, x, claim_no, (x + claim_no - 1) % 4 code from (
        select run, id, system, x, unnest(case when len(retrieved_contexts) = 0 then [null] else range(1, len(retrieved_contexts) + 1) end) claim_no
        from generations where system <> 'baseline'))
      group by run, id, system""",
    "golden_evidence": f"""
      select * from (with g as ({golden()}), task_rules_mined as ({RULES_MINED}), picks as (select station, current_task from {IMPACT_PICK})
      select id, unnest(string_split(evidence, '|')) episode_id from g where evidence is not null
      union all select g.id, m.episode_id from g join picks p on g.stations = p.station
        join mined m on m.station = p.station and m.current_task = p.current_task where g.subtype = 'impacto_bpm')""",
    "index_union": f"""
      select station, current_state, count(*) n, max(episode_id) last_id from (
        select episode_id, station, current_state from gold where current_state = 'not ready'
        union all select * from (select episode_id, station, current_state from gold where current_state = 'ready'
          order by {hash_order('42', 'episode_id')} limit 40)) group by 1, 2""",
    "pos_neg_union": f"select episode_id, is_anomaly, duration_s from ({CASES})",
    "common_questions": "select system, id from generations group by 1, 2 having count(distinct run) = 2",
    "unused_candidates": f"""
      select episode_id from mined where {NOT_CALIBRATING}
        and episode_id not in (select a_id from pairs_in_window union all select b_id from pairs_in_window)""",
    "distinct_claims": "select run, id, system, array_to_string("
    + ordered_distinct(r"list_transform(regexp_extract_all(' ' || replace(answer, ',', '.'), '[^\d.]\d+\.\d+'), lambda t: substr(t, 2))")
    + ", '|') claims from generations",
    "parse_questions": f"""
      select question_id, array_to_string(stations, '|') stations, {ts('ts0')} ts, {ts('window_lo')} window_lo,
        {ts('window_hi')} window_hi from parsed""",
    "episode_text": "select episode_id, text from gold",
    "bpm_text": f"select e.episode_id, coalesce({BPM}, '') bpm from {WITH_RULES}",
    "embed_text": f"""
      select e.episode_id id, {EMBED} as text from {WITH_RULES}
      union all select question_id, 'search_query: ' || question from questions""",
    "text_vectors": f"""
      select episode_id, dim, round(n / sqrt(sum(n * n) over (partition by episode_id)), 6) weight from (
        select episode_id, cast(cast('0x' || substr(md5(tok), 1, 8) as bigint) % 64 as integer) dim, count(*)::double n
        from (select episode_id, unnest({tokens('text')}) tok from gold) group by 1, 2)""",
    "tokenize": f"""
      select doc_id, md5(array_to_string({tokens('text')}, '|')) digest, cast(len({tokens('text')}) as integer) n_tokens
      from documents""",
    "hit_text": """
      select event_id, station || ' ' || current_task || ' ' || current_sub_task || ' ' || log_text as text from index_rows""",
    "assemble_prompts": prompt_sql(),
    "context_text": f"select event_id, {CONTEXT_LINE.format(start=ts('start_ts'))} line from index_rows",
    "key_fact_recall": "select run, id, system, round(key_fact_recall, 6) key_fact_recall from checked",
    "anomaly_verdict": "select run, id, system, verdict from classed",
    "classify_answer": "select run, id, system, kind from classed",
    "ungrounded_numbers": "select run, id, system, cast(ungrounded as integer) ungrounded from classed",
    "perturb_neutral": r"""
      select run, id, system, case when len(parts) >= 2 then array_to_string(list_reverse(parts), chr(10) || chr(10)) end changed
      from (select *, list_filter(string_split_regex(trim(answer), '\n\s*\n'), lambda p: trim(p) <> '') parts from generations)""",
    "perturb_station": r"""
      select run, id, system, case when target is not null and len(others) > 0 then
        regexp_replace(answer, '\b' || target || '\b', others[length(answer) % len(others) + 1], 'g') end changed
      from (select *, list_filter(present, lambda p: list_contains(known, p))[1] target,
          list_filter(universe, lambda u: not list_contains(known, u) and not list_contains(present, u)) others
        from (select *, regexp_extract_all(answer, '\b[A-Z]{2,3}_\d\b') present,
            regexp_extract_all(array_to_string(retrieved_contexts, ' ') || ' ' || question, '\b[A-Z]{2,3}_\d\b') known,
            (select list_sort(list(distinct c)) from (select unnest(regexp_extract_all(
              array_to_string(retrieved_contexts, ' '), '\b[A-Z]{2,3}_\d\b')) c from generations)) universe
          from generations))""",
    "question_text": f"""
      select episode_id, {TIME_QUESTION} time_question, {DESCRIBED_Q} described_question, {FACT.format(p='')} fact,
        {pair_q('station', "'OV_1'", sec('start_ts'))} pair_question, {ANOMALY_QUESTION} anomaly_question,
        {ANOMALY_REFERENCE} anomaly_reference, {IMPACT_Q} impact_question, {IMPACT_R} impact_reference
      from (with task_rules_mined as ({RULES_MINED}) select m.*, {MOTOR} motor, activity, process, next_station
        from mined m left join task_rules_mined t on t.station = m.station and t.current_task = m.current_task)""",
    "golden_set": golden(),
    "read_golden": golden(),
    "run_labels": r"""
      select model, prompt, rerank, replace(model, ':', '-') slug, regexp_extract(model, '^[a-z]+') family,
        model || case when prompt <> 'estrito' then '[' || prompt || ']' else '' end
          || case when rerank <> 'off' then '+' || rerank else '' end as label,
        case when model = 'alpha:7b' and prompt = 'estrito' and rerank = 'off' then '.' else replace(model, ':', '-')
          || case when prompt <> 'estrito' then '__' || prompt else '' end
          || case when rerank <> 'off' then '__' || rerank else '' end end folder,
        regexp_extract(model, '^[a-z]+') = 'alpha' same_family
      from (select distinct model from generations) cross join (values ('estrito', 'off'), ('brando', 'off'), ('estrito', 'bm25')) v(prompt, rerank)""",
    "positive_controls": r"""
      select 'REF|' || id || '|' || system as key, run, id, system, reference answer from (
        select *, list_filter(list_distinct(list_concat(regexp_extract_all(reference, '\d+\.\d'),
            regexp_extract_all(reference, '\b[A-Z]{2,3}_\d\b'))),
            lambda f: not contains(lower(replace(question, ',', '.')), lower(f))) fl,
          lower(replace(array_to_string(retrieved_contexts, ' '), ',', '.')) shown from generations
        where s > 0 and len(retrieved_contexts) > 0)
      where len(fl) > 0 and len(list_filter(fl, lambda f: case when regexp_full_match(f, '\d+\.\d')
          then not regexp_matches(' ' || shown || ' ', '[^\d.]' || replace(f, '.', '\.') || '[^\d]')
          else not contains(shown, lower(f)) end)) = 0
      order by id, system, run limit 60""",
    "stream_silver": f"select {SILVER} from silver",
    "stream_episodes": f"""
      select episode_id, station, current_state, n_events, duration_s, {ts('end_ts')} end_ts from episodes""",
    **DRAWN_CI,
}

def oracle_sql() -> dict[str, str]:
    return {name: compose(sql) for name, sql in RAW.items()}
