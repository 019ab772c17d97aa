"""One DuckDB query per registered Spark query (where SQL can express it), over the whole tables."""

from __future__ import annotations

from intake_spark import lexicon as L
from intake_spark.plans.catalog import PARAPHRASES

from .base import (BEFORE, CV, FOLDED, GROUPED, OOT, REMARK, ROLLING, cascade, english, first_rule, group_folds, learned, nearest,
                   parse, q, query, reasons_sql, rule_list, stable_hash, similar)

WHOLE = "select *, 0 as split from h"
SQL: dict[str, str] = {}


def r(x: str) -> str:
    return f"round(cast({x} as double), 6)"


def routed(scheme=OOT, features=L.DEFAULT_FEATURES, rules=None, **kw) -> list[str]:
    return [learned(scheme[0]), cascade(scheme[1], features, rules, **kw)]


OK = "cast(coalesce(team = final_team_cur, false) as int)"
BOT_OK = "cast(coalesce(bot_team = final_team_cur, false) as int)"
REDACTED = f"substr(regexp_replace(lower(text), {q(L.ID_PATTERN)}, '[no.]', 'g'), 1, 90)"

# ------------------------------------------------------------------------------------ cleaning and parsing
SQL["history_clean"] = query(f"""
select request_id, bot_team, first_team_cur, final_team_cur, transfers, created_at, resolved_at_ist,
       {r('hours_to_resolve')} as hours_to_resolve, inconsistent, cast(hour(created_at) as int) as hour,
       cast(isodow(created_at) - 1 as int) as weekday from clean""")
SQL["text_fixed"] = query("select request_id, text from clean")
SQL["phrase_parse"] = query(f"""
select request_id, norm, core, array_to_string(clauses, '|') as clauses, cast(n_clauses as int) as n_clauses, last, vague,
       array_to_string(shown, '|') as shown, last_shown, {REMARK} as remark, {REDACTED} as redacted from h""")
SQL["phrase_families"] = query("""
select family, first(last order by n desc, last) as last, cast(max(n) as bigint) as n, cast(sum(n) as bigint) as family_rows
from (select regexp_replace(last, '\\d+', '#', 'g') as family, last, count(*) as n from h where not vague group by all)
group by family""")
SQL["document_families"] = """
select family, first(line order by n desc, line) as line, cast(max(n) as bigint) as n, cast(sum(n) as bigint) as family_rows from (
  select regexp_replace(line, '\\d+', '#', 'g') as family, line, count(*) as n
  from (select unnest(string_split(text, chr(10))) as line from documents) group by all) group by family"""
SQL["last_user_turn"] = f"""
with u as (select conv_id, count(*) as user_turns, max(turn) as turn, arg_max(text, turn) as text
           from conversations where role = 'user' group by conv_id),
p as ({parse("select * from u", shown=False)})
select conv_id, user_turns, turn, norm, vague, cast(length(text) as int) as chars from p"""

# ------------------------------------------------------------------------------------ learned tables
whole = learned(WHOLE)
SQL["phrase_team_counts"] = query("select last, team, cast(c as bigint) as n from pc", whole)
SQL["phrase_majority"] = query(f"""
select last, team, cast(k as bigint) as k, cast(n as bigint) as n, {r('k / n')} as share, array_to_string(alts, '|') as alternatives
from ph""", whole)
SQL["vague_posterior"] = query(f"""
select product_family, cast(n as bigint) as n, team, cast(c as bigint) as c, {r('post')} as posterior from pp""", whole)
SQL["vague_product_warranty"] = query(f"""
select product_family, warranty_status, cast(n as bigint) as n, first(team order by post desc, team) as team, {r('max(post)')} as posterior
from (select k.product_family, k.warranty_status, k.n, t.team,
             (coalesce(w.c, 0) + {L.VAGUE_ALPHA}.0::double * (t.c / pl.pl_n)) / (k.n + {L.VAGUE_ALPHA}) as post
      from (select product_family, warranty_status, count(*) as n from lrn where vague group by all) k cross join vt t cross join pl
      left join (select product_family, warranty_status, final_team_cur as team, count(*) as c from lrn where vague group by all) w
        on w.product_family = k.product_family and w.warranty_status = k.warranty_status and w.team = t.team)
group by product_family, warranty_status, n""", whole)
RECENT = f"""
rlearn as materialized ({ROLLING[0]}),
rmax as (select split, max(created_at) - interval 6 month as cut from rlearn group by split),
rcount as (select l.split, final_team_cur as team, count(*) as c from rlearn l join rmax m using (split)
           where l.vague and l.created_at >= m.cut group by all),
rtop as (select split, first(team order by c desc, team) as recent_team from rcount group by split)"""
SQL["vague_recent_prior"] = query("select cast(split as int) as split, recent_team from rtop", RECENT)


def rebalanced(g):
    return f"first(team order by case when pooled_c > 0 then post / pow(pooled_c / pl_n, {g}) else 0 end desc, team)"


SQL["vague_rebalanced"] = query(f"""
select product_family, {rebalanced(0.5)} as team_half, {rebalanced(1.0)} as team_full from pp group by product_family""", whole)
SQL["source_quality_posterior"] = f"""
with d as (select lang, source, count(*) as n, sum(cast(quality = 1 as int)) as good
           from documents join labels using (doc_id) group by all),
p as (select sum(good) / sum(n) as prior from d)
select lang, source, n, cast(good as bigint) as good, {r(f'(good + {L.VAGUE_ALPHA} * prior) / (n + {L.VAGUE_ALPHA})')} as posterior from d, p"""
SQL["two_request_evidence"] = query("select two_k, two_n from tw", whole)
SQL["payment_evidence"] = query("select pay_bot, pay_closed, pay_n from py", whole)
SQL["model_readiness"] = query(f"""
select 'ok' as status, {q(L.MODEL_VERSION)} as model_version, count(*) as trained_on_requests,
       strftime(max(created_at), '%Y-%m-%d') as trained_until, false as uses_paid_api from h where {BEFORE}""")
ENGLISH_WORDS = ", ".join(f"({q(w)})" for w in sorted({w for _, rep in L.HINGLISH for w in rep.split()}))
SQL["vocabulary"] = query(f"""
select distinct word from (
  select unnest(regexp_split_to_array(lower(text), '\\s+')) as word from h
  union all select word from (values {ENGLISH_WORDS}) v(word)) where regexp_matches(word, '^\\pL+$')""")
SQL["document_vocabulary"] = """
select word, count(*) as documents from (
  select distinct doc_id, unnest(regexp_split_to_array(lower(text), '\\s+')) as word from documents)
where regexp_matches(word, '^\\pL+$') group by word"""
SQL["product_majority_shift"] = query("""
select count(*) as cells, count(*) filter (cell_team <> team) as differing from (
  select c.last, c.product_family, first(c.team order by c.c desc, c.team) as cell_team from (
    select last, product_family, final_team_cur as team, count(*) as c from h where not vague group by all) c
  group by all having sum(c.c) >= 3) x join ph using (last)""", whole)

# ------------------------------------------------------------------------------------ repair and rules
SQL["hinglish_repair"] = query(f"select request_id, {english('text')} as english from h")
SQL["rule_match"] = query(f"""
select request_id, {first_rule('last', L.KEYWORD_RULES)} as rule_team,
       array_to_string({rule_list('last', L.KEYWORD_RULES)}, '|') as all_teams,
       {first_rule('last', L.TEAM_WORD_RULES)} as team_words_team,
       coalesce({first_rule('last', L.BASELINE_RULES)}, {q(L.BASELINE_DEFAULT)}) as baseline_team from h""")



def typos(level, p, seed):
    """CTE ``level``(request_id, t): every word of three letters or more is hit by one edit with probability p."""
    def draw(what, n):
        return f"({stable_hash('request_id', 'i', q(what), q(str(seed)))} % {n})"

    return f"""
{level}0 as (select request_id, unnest(toks) as w, generate_subscripts(toks, 1) - 1 as i
  from (select request_id, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]+') as toks from h)),
{level}1 as (select *, {draw('at', 1_000_003)} % length(w) + 1 as a, {draw('op', 4)} as op, {draw('letter', 26)} as letter,
  {draw('hit', 1_000_000)} as hit from {level}0),
{level} as (select request_id, string_agg(case when not (regexp_matches(w, '^[A-Za-z]{{3,}}$') and hit < {int(p * 1_000_000)}) then w
  when op = 0 then substr(w, 1, a - 1) || substr(w, a + 1)
  when op = 1 and a < length(w) then substr(w, 1, a - 1) || substr(w, a + 1, 1) || substr(w, a, 1) || substr(w, a + 2)
  when op = 2 then substr(w, 1, a - 1) || substr('abcdefghijklmnopqrstuvwxyz', letter + 1, 1) || substr(w, a + 1)
  else substr(w, 1, a) || substr(w, a, 1) || substr(w, a + 1) end, '' order by i) as t from {level}1 group by request_id)"""


SQL["typo_perturbation"] = query("select h.request_id, coalesce(light.t, '') as light, coalesce(heavy.t, '') as heavy from h "
                                 "left join light using (request_id) left join heavy using (request_id)",
                                 typos("light", 0.15, 1), typos("heavy", 0.30, 2))

# ------------------------------------------------------------------------------------ routing
BASIS = "case route_type " + " ".join(f"when {q(k)} then {q(v)}" for k, v in L.ALTERNATIVES_BASIS.items()) + " else '' end"
SQL["route_out_of_time"] = query(f"""
select request_id, team, {r('confidence')} as confidence, confidence_level, auto_route, route_type, route_detail, needs_clarification,
       array_to_string(alts, '|') as alternatives, {BASIS} as alternatives_basis, last_shown as deciding_request,
       {q(L.MODEL_VERSION)} as model_version from routed""", *routed())
SQL["route_reasons"] = query(f"select request_id, {reasons_sql()} as reasons from routed", *routed())
OPTION_ROWS = ", ".join(f"({i}, {q(t)})" for i, (_, t) in enumerate(L.CLARIFY_OPTIONS))
SQL["route_question"] = query(f"""
select request_id, {q(L.CLARIFY_QUESTION)} as question, options from routed join optlist on optlist.product_family = routed.product_family
where needs_clarification""", *routed(features=frozenset({"C2"})), f"""
options(i, team) as (values {OPTION_ROWS}),
optrank as (select pp.product_family, o.team, row_number() over (partition by pp.product_family order by post desc, o.i) as k
            from pp join options o using (team)),
optlist as (select product_family, string_agg(team || case when k <= 3 then '*' else '' end, '|' order by k) as options
            from optrank group by product_family)""")
SQL["route_all_switches"] = query(f"""
select request_id, team, {r('confidence')} as confidence, route_type, route_detail, auto_route from routed""",
                                  *routed(features=L.ALL_FEATURES, paraphrases=PARAPHRASES))
SQL["review_queue"] = query(f"""
select request_id, request_text, product_family, team as router_team, route_type, {r('confidence')} as confidence
from routed where not auto_route""", *routed())

# ------------------------------------------------------------------------------------ metrics
ACC = (f"count(*) as n, {r(f'avg({OK})')} as vs_outcome, {r('avg(cast(coalesce(team = bot_team, false) as int))')} as vs_bot, "
       f"{r(f'avg({OK}) filter (not (IS_VAGUE))')} as clear, {r(f'avg({OK}) filter (IS_VAGUE)')} as vague, "
       f"{r('avg(cast(IS_VAGUE as int))')} as vague_share")
ROUTE_ACC = ACC.replace("IS_VAGUE", "route_type = 'vague'")
SQL["accuracy_out_of_time"] = query(f"select {ROUTE_ACC} from routed", *routed())


def by_group(group):
    return query(f"""select {group}, count(*) as n, {r(f'avg({OK})')} as router_right, {r(f'avg({BOT_OK})')} as bot_right,
        {r('count(*) / (select count(*) from routed)')} as share from routed group by {group}""", *routed())


SQL["accuracy_by_type"] = by_group("route_type")
SQL["confidence_levels"] = by_group("confidence_level")
SQL["decider_breakdown"] = query(f"""select route_detail, count(*) as n, {r(f'avg({OK})')} as accuracy,
    {r('count(*) / (select count(*) from routed)')} as share from routed group by route_detail""", *routed())


def report(src: str, by: str = "") -> str:
    b = by + ", " if by else ""
    j = f" and p.{by} = t.{by}" if by else ""
    return f"""
tt{by} as (select {b}final_team_cur as team, count(*) as support, sum({OK}) as hits from {src} group by all),
pt{by} as (select {b}team, count(*) as predicted from {src} where team is not null group by all),
rep{by} as (select coalesce(t.team, p.team) as team, {f'coalesce(t.{by}, p.{by}) as {by},' if by else ''} coalesce(support, 0) as support,
   coalesce(predicted, 0) as predicted, coalesce(hits, 0) as hits from tt{by} t full join pt{by} p on p.team = t.team{j}),
f1{by} as (select *, case when predicted > 0 then hits / predicted else 0 end as precision,
   case when support > 0 then hits / support else 0 end as recall,
   case when predicted + support > 0 then 2 * hits / (predicted + support) else 0 end as f1 from rep{by})"""


SQL["team_precision_recall"] = query(f"""select team, {r('precision')} as precision, {r('recall')} as recall, {r('f1')} as f1,
    cast(support as bigint) as support from f1""", *routed(), report("routed"))
SQL["macro_f1"] = query(f"select {r('avg(f1)')} as macro_f1 from f1", *routed(), report("routed"))
SQL["confusion"] = query("select t.team as truth, " + ", ".join(
    f"count(r.team) filter (r.team = {q(t)}) as to_{t.split()[0].lower()}" for t in L.TEAMS)
    + " from teams t left join routed r on r.final_team_cur = t.team group by t.team", *routed())


def selective(name, cond):
    return f"""select {q(name)} as auto_route_when, {r(f'avg(cast({cond} as int))')} as share_routed,
      {r(f'avg({OK}) filter ({cond})')} as accuracy_routed, {r(f'1 - avg(cast({cond} as int))')} as share_to_person from routed"""


SQL["selective_routing"] = query(" union all ".join(selective(n, c) for n, c in (
    ("always", "true"), ("confidence >= 0.70", "confidence >= 0.70"), ("confidence >= 0.90", "confidence >= 0.90"),
    ("not vague", "route_type <> 'vague'"), ("auto_route flag", "auto_route"))), *routed(ROLLING))


def hits(k):
    h = f"cast(list_contains(case when len(alts) > 0 then alts[1:{k}] else [team] end, final_team_cur) as int)"
    return f"""select {k} as k, {r(f'avg({h})')} as all_requests, {r(f"avg({h}) filter (route_type <> 'vague')")} as clear_requests,
      {r(f"avg({h}) filter (route_type = 'vague')")} as vague_requests from routed"""


SQL["top_k"] = query(" union all ".join(hits(k) for k in (1, 2, 3)), *routed(ROLLING))
SQL["error_breakdown"] = query(f"""
select count(*) as n, cast(sum({OK}) as bigint) as right, count(*) filter ({OK} = 0 and route_type = 'vague') as vague_errors,
       count(*) filter ({OK} = 0 and route_type <> 'vague') as clear_errors,
       count(*) filter ({OK} = 0 and route_type <> 'vague' and inconsistent) as inconsistent_errors,
       {r(f"count(*) filter ({OK} = 0 and route_type <> 'vague') / greatest(count(*) filter (route_type <> 'vague'), 1)")} as clear_error_share
from routed""", *routed())
SQL["error_rows"] = query(f"""
select request_id, {REDACTED} as shown, bot_team, final_team_cur, transfers, team as pred, route_type, {r('confidence')} as confidence
from routed where {OK} = 0""", *routed())
SQL["error_sample"] = query(f"""
select request_id, {REDACTED} as shown, team, final_team_cur, transfers from routed where {OK} = 0 and route_type <> 'vague'
order by {stable_hash('request_id', "'0'")}, request_id limit 12""", *routed())
SQL["bot_monthly"] = query(f"""select strftime(created_at, '%Y-%m') as month, count(*) as n, {r(f'avg({BOT_OK})')} as bot_right
    from h group by all""")
SQL["bot_by_label"] = query(f"select bot_team, count(*) as n, {r(f'avg({BOT_OK})')} as bot_right from h group by all")
for name, col in (("route_mix", "route_type"), ("team_mix", "team")):
    SQL[name] = query(f"""select {col}, count(*) as n, {r('count(*) / (select count(*) from routed)')} as share
        from routed group by {col}""", *routed())
SQL["clarify_projection"] = query(f"""
select {r('v')} as vague_share, {r('c')} as clear_accuracy, {r('(1 - v) * c + v * c')} as projected from (
  select avg(cast(route_type = 'vague' as int)) as v, avg({OK}) filter (route_type <> 'vague') as c from routed)""", *routed())
SQL["option_coverage"] = query(f"""
select count(*) as n, 'as listed' as option_order, {r('avg(cast(list_contains(' + str([t for _, t in L.CLARIFY_OPTIONS[:3]]) + ', final_team_cur) as int))')} as covered from vr
union all select count(*), 'pooled shares', {r('avg(cast(list_contains(pl_alts, final_team_cur) as int))')} from vr
union all select count(*), 'product shares', {r('avg(cast(list_contains(pm_alts, final_team_cur) as int))')} from vr""",
    learned(ROLLING[0]), f"""vr as (select s.*, pl.pl_alts[1:3] as pl_alts, coalesce(pm.pm_alts, pl.pl_alts[1:3]) as pm_alts
    from ({ROLLING[1]}) s join pl using (split) left join pm on pm.split = s.split and pm.product_family = s.product_family where s.vague)""")

# ------------------------------------------------------------------------------------ money
MIS = "(first_team_cur <> final_team_cur)"
COST = f"(transfers * {L.TRANSFER_RS} + cast({MIS} as int) * {L.EXTRA_CONTACT_RS})"


def recent(months):
    return f"recent as (select * from h where created_at >= (select max(created_at) - interval {months} month from h))"


COSTS = f"""costs as (select count(*) as requests_12m, count(*) / 12 as per_month, avg(cast({MIS} as int)) as misroute_rate,
  cast(sum(transfers) as bigint) as transfers_12m, cast(sum({COST}) as double) as cost_12m, avg({COST}) filter ({MIS}) as cost_per_misroute,
  median(hours_to_resolve) filter ({MIS}) as hours_misrouted, median(hours_to_resolve) filter (not {MIS}) as hours_right_first from recent)"""
SQL["misroute_costs"] = query(f"""select requests_12m, {r('per_month')} as per_month, {r('misroute_rate')} as misroute_rate, transfers_12m,
  cost_12m, {r('cost_per_misroute')} as cost_per_misroute, {r('hours_misrouted')} as hours_misrouted,
  {r('hours_right_first')} as hours_right_first from costs""", recent(12), COSTS)
SQL["team_volumes"] = query(f"""
select team, bot as bot_label_per_month, actual as actual_per_month, {r('round_even(actual / sum(actual) over (), 3)')} as actual_share,
       cast(bot - actual as int) as bot_overstates_by from (
  select t.team, round_even((select count(*) from recent where bot_team = t.team) / 6, 0) as bot,
         round_even((select count(*) from recent where final_team_cur = t.team) / 6, 0) as actual from teams t)""", recent(6))
YEARLY = "requests_12m * cost_per_misroute"
SQL["savings"] = query(f"""
select scenario, {r('miss')} as wrong_first_team, round(cast(miss * yearly as double), 6) as misroute_cost, cast(licence as int) as licence,
       round(cast((bot_miss - miss) * yearly + ({L.LICENCE_RS} - licence) as double), 6) as saving from (
  select 'Today: vendor bot' as scenario, bot_miss as miss, {L.LICENCE_RS} as licence, * from rates
  union all select 'Router, bot switched off', router_miss, 0, * from rates
  union all select 'Router + one intake question', clear_miss, 0, * from rates)""", *routed(), recent(12), COSTS, f"""
rates as (select 1 - avg({BOT_OK}) as bot_miss, 1 - avg({OK}) as router_miss, 1 - avg({OK}) filter (route_type <> 'vague') as clear_miss,
          any_value({YEARLY}) as yearly from routed, costs)""")
SQL["hours_by_source"] = query(f"""select source, count(*) as n, {r('avg(cast(hours_to_resolve < 0 as int))')} as negative_share,
    {r('median(hours_to_resolve)')} as median from h group by source""")
TEAM_LIST = "[" + ", ".join(q(t) for t in L.TEAMS) + "]"
RULED = f"""
pcum as (select split, team, c, sum(c) over (partition by split order by team) as cum from vt),
pick as (select r.split, r.request_id, ({stable_hash('r.request_id', "'0'")} % 1000000) / 1e6 * pl.pl_n as u from routed r join pl using (split)),
rnd as (select p.split, p.request_id, min(c.team) filter (c.cum > p.u) as rnd_team from pick p join pcum c using (split) group by all),
pboth as (select split, product_family, {rebalanced(0.5)} as half_team, {rebalanced(1.0)} as full_team from pp group by all),
ruled as (select r.* exclude (team), r.team as base_team, rnd.rnd_team, pm.pm_team as prod_team, b.half_team, b.full_team
  from routed r join rnd using (split, request_id) left join pm on pm.split = r.split and pm.product_family = r.product_family
  left join pboth b on b.split = r.split and b.product_family = r.product_family),
long as (
  {' union all '.join(f"select {q(n)} as rule, final_team_cur, route_type, case when route_type = 'vague' then {c} else base_team end as team from ruled"
                      for n, c in (("pooled", "pl_team"), ("by product", "coalesce(prod_team, pl_team)"),
                                   ("by product, half rebalanced", "half_team"), ("by product, fully rebalanced", "full_team"),
                                   ("hashed draw", "rnd_team")))}),
miss as (select avg({COST}) filter ({MIS}) as cost from h)"""
SQL["vague_rule_costs"] = query(f"""
select l.rule, {r('l.accuracy')} as accuracy, {r('m.macro_f1')} as macro_f1, {r('l.vague_accuracy')} as vague_accuracy,
       {r('(1 - l.accuracy) * 1000 * miss.cost')} as cost_per_1000
from (select rule, avg({OK}) as accuracy, avg({OK}) filter (route_type = 'vague') as vague_accuracy from long group by rule) l
join (select rule, avg(f1) as macro_f1 from f1rule group by rule) m using (rule), miss""", *routed(ROLLING), RULED, report("long", "rule"))

# ------------------------------------------------------------------------------------ backtests
A1 = frozenset({"A1"})
MEASURES = {"vs_outcome": f"avg({OK})", "clear": f"avg({OK}) filter (route_type <> 'vague')",
            "vague": f"avg({OK}) filter (route_type = 'vague')", "vague_share": "avg(cast(route_type = 'vague' as int))"}
SQL["cross_validation"] = query(" union all ".join(f"""
select count(*) as folds, {r(f'avg(x)')} as mean, {r('stddev_samp(x)')} as sd, {r('min(x)')} as low, {r('max(x)')} as high, {q(m)} as measure
from (select split, {e} as x from routed group by split)""" for m, e in MEASURES.items()), FOLDED, *routed(CV, A1))
SQL["expected_accuracy"] = query(f"select {r('sum(share * accuracy)')} as expected_accuracy from mix join acc using (route_type)",
    FOLDED,
    "acc as materialized (with " + ", ".join(routed(CV, A1)) + f" select route_type, avg({OK}) as accuracy from routed group by route_type)",
    "mix as materialized (with " + ", ".join(routed()) + " select route_type, count(*) / (select count(*) from routed) as share from routed group by route_type)")
SQL["held_out_wording"] = query(f"""
select 'shipped' as rules, cast(split as int) as split, count(*) as n, {r(f'avg({OK})')} as vs_outcome,
       {r(f"avg({OK}) filter (route_type <> 'vague')")} as clear from routed group by split
union all select 'team words', cast(split as int), count(*), {r(f'avg({OK})')},
       {r(f"avg({OK}) filter (route_type <> 'vague')")} from routed2 group by split""",
    group_folds("last"), learned(GROUPED[0]), cascade(GROUPED[1], A1), cascade(GROUPED[1], A1, L.TEAM_WORD_RULES, suffix="2"))
SQL["held_out_leaks"] = query("""select count(*) as leaks from gh a where not a.vague and exists (
    select 1 from gh b where b.last = a.last and b.fold <> a.fold)""", group_folds("last"))
SQL["rolling_backtest"] = query(f"select cast(split as int) as split, {ROUTE_ACC} from routed group by split", *routed(ROLLING))
STEPS = L.CORRECTION_STEPS
CURVE = f"""
{group_folds("regexp_replace(last, '\\d+', '#', 'g')")},
rk as materialized (select *, case when not vague then row_number() over (
    partition by vague, regexp_replace(last, '\\d+', '#', 'g') order by created_at, request_id) - 1 end as rank from gh)"""
CURVE_LEARN = " union all ".join(f"select *, {f * 5 + i} as split from rk where fold <> {f} or rank < {k}"
                                 for f in range(5) for i, k in enumerate(STEPS))
CURVE_SCORE = " union all ".join(f"select *, {f * 5 + i} as split from rk where fold = {f} and rank >= 10"
                                 for f in range(5) for i, k in enumerate(STEPS))
SQL["corrections_curve"] = query(f"""
select cast({'list_extract(' + str(STEPS) + ', split % 5 + 1)'} as int) as confirmed_examples, count(*) as n, {r(f'avg({OK})')} as accuracy
from routed group by 1""", CURVE, learned(CURVE_LEARN), cascade(CURVE_SCORE, frozenset(), L.TEAM_WORD_RULES))
SQL["occurrence_rank"] = """select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as rank from events"""


# ------------------------------------------------------------------------------------ paired tests
def exact_p(wins: str, losses: str) -> str:
    n = f"({wins} + {losses})"
    term = f"exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))"
    tail = f"list_sum(list_transform(range(0, least({wins}, {losses}) + 1), lambda i: {term}))"
    return f"case when {n} = 0 then 1.0 else least(1.0, 2 * {tail}) end"


PAIRED = """
paired as (select l.*, cast(coalesce(l.team = l.final_team_cur, false) as int) as ok, cast(coalesce(b.team = b.final_team_cur, false) as int) as base_ok
  from rowsl l join rowsl b on b.split = l.split and b.request_id = l.request_id and b.model = BASE),
cmp as (select model, count(*) as n, avg(ok) as pooled_acc, avg(ok) filter (route_type <> 'vague') as clear,
  avg(ok) filter (route_type = 'vague') as vague, 100 * (avg(ok) - avg(base_ok)) as delta_pts,
  count(*) filter (ok = 1 and base_ok = 0) as wins, count(*) filter (ok = 0 and base_ok = 1) as losses from paired group by model),
cmp2 as (select *, case when model <> BASE then P end as p from cmp),
cmph as (select model, max(least(1.0, (m - i + 1) * p)) over (order by p, model rows unbounded preceding) as p_holm from (
  select model, p, row_number() over (order by p, model) as i, count(*) over () as m from cmp2 where model <> BASE))"""


def paired(base):
    return PAIRED.replace("BASE", q(base)).replace(" P end", f" {exact_p('wins', 'losses')} end")


def nested(name, select, *ctes):
    """A CTE with tables of its own, so that two cascades can stand in one query."""
    return f"{name} as materialized (with {', '.join(ctes)} {select})"


def support_rows(k):
    """The champion's cascade with another minimum support."""
    return nested(f"routed_{k}", "select split, request_id, team from routed", learned(ROLLING[0], k),
                  cascade(ROLLING[1], L.DEFAULT_FEATURES))


CHALLENGERS = f"""
w2 as (select k.split, k.product_family, k.warranty_status, t.team,
         (coalesce(w.c, 0) + {L.VAGUE_ALPHA}.0::double * (t.c / pl.pl_n)) / (k.n + {L.VAGUE_ALPHA}) as post
  from (select split, product_family, warranty_status, count(*) as n from lrn where vague group by all) k join vt t using (split) join pl using (split)
  left join (select split, product_family, warranty_status, final_team_cur as team, count(*) as c from lrn where vague group by all) w
    on w.split = k.split and w.product_family = k.product_family and w.warranty_status = k.warranty_status and w.team = t.team),
w2m as (select split, product_family, warranty_status, first(team order by post desc, team) as pw_team from w2 group by all),
champ as (select r.split, r.request_id, r.final_team_cur, r.route_type, r.team, r.pl_team, pm.pm_team as prod_team, w2m.pw_team, rtop.recent_team
  from routed r left join pm on pm.split = r.split and pm.product_family = r.product_family
  left join w2m on w2m.split = r.split and w2m.product_family = r.product_family and w2m.warranty_status = r.warranty_status
  left join rtop on rtop.split = r.split),
rowsl as (
  select split, request_id, final_team_cur, route_type, 'cascade' as model, team from champ
  union all select split, request_id, final_team_cur, route_type, 'unclear: product', case when route_type = 'vague' then coalesce(prod_team, pl_team) else team end from champ
  union all select split, request_id, final_team_cur, route_type, 'unclear: half a year', case when route_type = 'vague' then coalesce(recent_team, team) else team end from champ
  union all select split, request_id, final_team_cur, route_type, 'unclear: product and cover', case when route_type = 'vague' then coalesce(pw_team, pl_team) else team end from champ
  union all select c.split, c.request_id, c.final_team_cur, c.route_type, 'support 1', o.team from champ c join routed_1 o using (split, request_id)
  union all select c.split, c.request_id, c.final_team_cur, c.route_type, 'support 10', o.team from champ c join routed_10 o using (split, request_id))"""
CH = [RECENT, *routed(ROLLING), support_rows(1), support_rows(10), CHALLENGERS]
SQL["champion_challengers"] = query(f"""
select c.model, n, {r('pooled_acc')} as pooled_acc, {r('clear')} as clear, {r('vague')} as vague, {r('delta_pts')} as delta_pts, wins, losses,
       {r('p')} as p, {r('p_holm')} as p_holm from cmp2 c left join cmph using (model)""", *CH, paired("cascade"))
SQL["challenger_folds"] = query("select model, " + ", ".join(
    f"{r(f'avg({OK}) filter (split = {i})')} as acc_{n.lower().replace('-', '_').replace(' ', '_')}" for i, (n, _, _) in enumerate(L.QUARTERS))
    + " from rowsl group by model", *CH)
SQL["challenger_winners"] = query(f"""select c.model, {r('delta_pts')} as delta_pts, {r('p_holm')} as p_holm from cmp2 c join cmph using (model)
    where delta_pts > 0 and p_holm < 0.05""", *CH, paired("cascade"))

from intake_spark.plans.backtest import BASE_VARIANT, VARIANTS  # noqa: E402  (names and switch sets only)

VARIANT_CTES = [nested(f"variant{i}", "select split, request_id, final_team_cur, route_type, team from routed", learned(OOT[0]),
                       cascade(OOT[1], f, paraphrases=PARAPHRASES)) for i, f in enumerate(VARIANTS.values())]
SQL["switch_matrix"] = query(f"""select model, n, {r('pooled_acc')} as pooled_acc, {r('delta_pts')} as delta_pts, wins, losses, {r('p')} as p
    from cmp2""", *VARIANT_CTES, "rowsl as (" + " union all ".join(
        f"select *, {q(n)} as model from variant{i}" for i, n in enumerate(VARIANTS)) + ")", paired(BASE_VARIANT))

# ------------------------------------------------------------------------------------ simple models
VOTE = f"""
bl as (select split, request_id, coalesce({first_rule('last', L.BASELINE_RULES)}, {q(L.BASELINE_DEFAULT)}) as b from ({ROLLING[1]})),
lk0 as (select split, last, final_team_cur as team, count(*) as c from ({ROLLING[0]}) group by all),
lk as (select split, last, first(team order by c desc, team) as team from lk0 group by all),
mj as (select split, first(team order by c desc, team) as team from (select split, team, sum(c) as c from lk0 group by all) group by split),
lkr as (select s.split, s.request_id, coalesce(lk.team, mj.team) as c from ({ROLLING[1]}) s join mj using (split)
        left join lk on lk.split = s.split and lk.last = s.last)"""
SQL["majority_ensemble"] = query(f"""
select count(*) as n, {r("avg(cast((case when b = c then b else r.team end) = final_team_cur as int))")} as accuracy,
  {r(f'avg({OK})')} as champion, {r('avg(cast(b = final_team_cur as int))')} as rules, {r('avg(cast(c = final_team_cur as int))')} as lookup
from routed r join bl using (split, request_id) join lkr using (split, request_id)""".replace("{OK}", OK).replace(OK, OK.replace("team = ", "r.team = ", 1)),
    *routed(ROLLING), VOTE)


def simple(name, scheme):
    """Per split accuracy of the simple models under one scheme, as a CTE."""
    learn, score = scheme
    return nested(name, "select * from sm", f"lk0 as (select split, last, final_team_cur as team, count(*) as c from ({learn}) group by all)",
        "lk as (select split, last, first(team order by c desc, team) as team from lk0 group by all)",
        "mj as (select split, first(team order by c desc, team) as team from (select split, team, sum(c) as c from lk0 group by all) group by split)",
        learned(learn), cascade(score, frozenset()), f"""
sm as (
  select 'rules on the last request' as model, split, vague as is_vague, final_team_cur, bot_team,
         coalesce({first_rule('last', L.BASELINE_RULES)}, {q(L.BASELINE_DEFAULT)}) as team from scr
  union all select 'lookup on the last request', s.split, vague, final_team_cur, bot_team, coalesce(lk.team, mj.team)
    from scr s join mj using (split) left join lk on lk.split = s.split and lk.last = s.last
  union all select 'most common team', s.split, vague, final_team_cur, bot_team, mj.team from scr s join mj using (split)
  union all select 'vendor bot', split, vague, final_team_cur, bot_team, bot_team from scr
  union all select 'hybrid, shipped words', split, vague, final_team_cur, bot_team, case when route_type in ('new_wording', 'empty')
         then coalesce({first_rule('last', L.BASELINE_RULES)}, {q(L.BASELINE_DEFAULT)}) else team end from routed
  union all select 'hybrid, team words', split, vague, final_team_cur, bot_team, case when route_type in ('new_wording', 'empty')
         then coalesce({first_rule('last', L.TEAM_WORD_RULES)}, {q(L.BASELINE_DEFAULT)}) else team end from routed)""")


SCHEMES = {"A out-of-time": ("sma", OOT), "B 5-fold CV": ("smb", CV), "C unseen wording": ("smc", GROUPED)}
SQL["simple_models"] = query(" union all ".join(f"""
select model, cast(sum(n) as bigint) as n, {r('avg(a)')} as vs_outcome, {r('avg(b)')} as vs_bot, {r('avg(c)')} as clear, {r('avg(v)')} as vague,
       {r('stddev_samp(a)')} as sd, {q(scheme)} as scheme from (
  select model, split, count(*) as n, avg({OK}) as a, avg(cast(coalesce(team = bot_team, false) as int)) as b,
         avg({OK}) filter (not is_vague) as c, avg({OK}) filter (is_vague) as v from {cte} group by model, split) group by model"""
    for scheme, (cte, _) in SCHEMES.items()), FOLDED, group_folds("last"), *[simple(c, s) for c, s in SCHEMES.values()])


def robust(name, scheme, rules):
    return nested(name, "select * from rb", learned(scheme[0]), cascade(scheme[1], A1, rules), f"""
w2 as (select k.split, k.product_family, k.warranty_status, t.team,
         (coalesce(w.c, 0) + {L.VAGUE_ALPHA}.0::double * (t.c / pl.pl_n)) / (k.n + {L.VAGUE_ALPHA}) as post
  from (select split, product_family, warranty_status, count(*) as n from lrn where vague group by all) k join vt t using (split) join pl using (split)
  left join (select split, product_family, warranty_status, final_team_cur as team, count(*) as c from lrn where vague group by all) w
    on w.split = k.split and w.product_family = k.product_family and w.warranty_status = k.warranty_status and w.team = t.team),
w2m as (select split, product_family, warranty_status, first(team order by post desc, team) as pw_team from w2 group by all),
rb as (select r.split, r.final_team_cur, r.route_type, r.team as c0, r.pl_team as pooled, coalesce(r.pm_team, r.pl_team) as c1, coalesce(w2m.pw_team, r.pl_team) as c3
  from routed r left join w2m on w2m.split = r.split and w2m.product_family = r.product_family and w2m.warranty_status = r.warranty_status)""")


SQL["challenger_robustness"] = query(" union all ".join(f"""
select {q(m)} as model, {r('avg(a)')} as acc, {r('stddev_samp(a)')} as sd, {q(scheme)} as scheme from (
  select split, avg(cast(coalesce((case when route_type = 'vague' then {col} else c0 end) = final_team_cur, false) as int)) as a from {cte} group by split)"""
    for scheme, cte in (("B 5-fold CV", "rbb"), ("C unseen wording", "rbc"))
    for m, col in (("cascade", "c0"), ("pooled", "pooled"), ("unclear: product", "c1"), ("unclear: product and cover", "c3"))),
    FOLDED, group_folds("last"), robust("rbb", CV, L.KEYWORD_RULES), robust("rbc", GROUPED, L.TEAM_WORD_RULES))

REWRITES = (("not turning on", "chalu nahi ho raha"), ("leaking water", "paani tapak raha hai"),
            ("invoice not received", "bill nahi mila"), ("want exchange", "badalna"))
HINDI = "text"
for a_, b_ in REWRITES:
    HINDI = f"replace({HINDI}, {q(a_)}, {q(b_)})"
LATE = f"select 0 as split, request_id, request_text, product_family, final_team_cur, text from h where not ({BEFORE}) and not vague"
REWRITTEN = parse(f"select * exclude (text), 'original' as wording, text from ({LATE}) union all "
                  f"select * exclude (text), 'rewritten', {HINDI} as text from ({LATE})")
SQL["rewritten_stress"] = query(" union all ".join(
    f"select {q(n)} as switches, wording, count(*) as n, {r(f'avg({OK})')} as accuracy from routed{x} group by wording"
    for n, x in (("none", ""), ("B4", "2"))), learned(OOT[0]), cascade(REWRITTEN, frozenset()), cascade(REWRITTEN, frozenset({"B4"}), suffix="2"))

# ------------------------------------------------------------------------------------ analyses
QUARTER = "case " + " ".join(f"when created_at >= timestamp '{s}' and created_at < timestamp '{e}' then {i}" for i, (_, s, e) in enumerate(L.QUARTERS)) + " end"


def ceiling(name, product):
    return f"""select cast(sum(n) as bigint) as n, {r('sum(best) / sum(n)')} as ceiling, {q(name)} as by from (
      select qr, last, prod, max(c) as best, sum(c) as n from (
        select {QUARTER} as qr, last, {product} as prod, final_team_cur, count(*) as c from h where {QUARTER} is not null group by all)
      group by qr, last, prod)"""


SQL["oracle_ceiling"] = query(ceiling("wording", "0") + " union all " + ceiling("wording and product", "case when vague then product_family end"))


# the tail of a chi-square: one less the series of the incomplete gamma function
GAMMA = ("case when stat <= 0 then 1.0::double else greatest(0, 1 - list_sum(list_transform(range(0, 3000), "
         "lambda i: exp((dof / 2 + i) * ln(stat / 2) - stat / 2 - lgamma(dof / 2 + i + 1))))) end")
CHI = " union all ".join(
    f"select n, {r('stat')} as statistic, dof, case when dof > 0 then {r(GAMMA)} end as p, case when least(ra, cb) > 1 then {r('sqrt(greatest(stat, 0) / (n * (least(ra, cb) - 1)))')} end as cramers_v, "
    f"{q(c)} as \"column\" from (select cast(sum(o) as bigint) as n, cast(sum(o) as double) * (sum(o * o / (cast(rt as double) * ct)) - 1) as stat, "
    f"count(distinct a) as ra, count(distinct b) as cb, (count(distinct a) - 1) * (count(distinct b) - 1) as dof from ("
    f"select a, b, o, sum(o) over (partition by a) as rt, sum(o) over (partition by b) as ct from ("
    f"select {c} as a, final_team_cur as b, count(*) as o from h where vague group by all)))"
    for c in ("channel", "product_family", "warranty_status", "source"))
SQL["chi_square"] = query(CHI)
SQL["linked_requests"] = query(f"""
select count(*) filter (n > 1) as shared_numbers, cast(sum(n * (n - 1) / 2) as double) as pairs,
       {r('sum(same) / sum(n * (n - 1) / 2)')} as same_team_share from (
  select number, sum(c) as n, sum(c * (c - 1) / 2) as same from (
    select number, final_team_cur, count(*) as c from (
      select request_id, final_team_cur, unnest(list_distinct(regexp_extract_all(lower(text), '\\b(ko\\d{{5,}}|sr\\d{{4,}})\\b', 1))) as number from h)
    group by all) group by number)""")
DAILY = """
dt as (select product_family, cast(created_at as date) as day, final_team_cur as team, count(*) as c from h where not vague group by all),
dd as (select product_family, cast(created_at as date) as day, count(*) filter (not vague) as clear_requests from h group by all)"""


def window_team(d):
    return f"""w{d} as (select dd.product_family, dd.day, first(team order by c desc, team) as team from dd join (
      select a.product_family, a.day, b.team, sum(b.c) as c from dd a join dt b on b.product_family = a.product_family
        and b.day >= a.day - {d} and b.day <= a.day - 1 group by all) x
      on x.product_family = dd.product_family and x.day = dd.day group by all)"""


CONTEXT = [DAILY, *[window_team(d) for d in (7, 30, 90)], """ctx as (select dd.*, w7.team as team_7d, w30.team as team_30d, w90.team as team_90d
  from dd left join w7 using (product_family, day) left join w30 using (product_family, day) left join w90 using (product_family, day))"""]
SQL["recent_context"] = query("select product_family, day, clear_requests, team_7d, team_30d, team_90d from ctx", *CONTEXT)
SQL["recent_context_accuracy"] = query("select count(*) as n, " + ", ".join(
    f"{r(f'avg(cast(coalesce(team_{d}d = final_team_cur, false) as int))')} as accuracy_{d}d" for d in (7, 30, 90))
    + " from h left join ctx on ctx.product_family = h.product_family and ctx.day = cast(h.created_at as date) where vague", *CONTEXT)
SQL["new_wording_share"] = query(f"""
select count(*) filter (e > 0) as earlier_phrases, count(*) filter (l > 0) as later_phrases,
       {r('coalesce(sum(l) filter (e = 0), 0) / sum(l)')} as new_share from (
  select last, count(*) filter ({BEFORE}) as e, count(*) filter (not ({BEFORE})) as l from h where not vague group by last)""")

# ------------------------------------------------------------------------------------ neighbours
SQL["nearest_wording"] = query(f"select last, near_key, {r('near_sim')} as near_sim from near", learned(OOT[0]), nearest(
    f"""select distinct s.split, s.last from ({OOT[1]}) s left join ph on ph.split = s.split and ph.last = s.last
        where not s.vague and s.last <> '' and ph.team is null""", "select split, last as key from ph"))
UNIT = """
unit as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double) / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * cast(y as double))))) as v
  from embeddings),
d as materialized (select a.vec_id, b.vec_id as near_id, b.label, round(1 - list_dot_product(a.v, b.v), 12) as distance
  from unit a join unit b on a.vec_id <> b.vec_id),
k as (select *, row_number() over (partition by vec_id order by distance, near_id) as rank from d)"""
SQL["nearest_vectors"] = f"with {UNIT} select vec_id, near_id, {r('distance')} as distance, cast(rank as int) as rank from k where rank <= 3"
SQL["knn_vote"] = f"""with {UNIT}
select vec_id, first(label order by e desc, f desc, label) as voted from (
  select vec_id, label, sum(cast(distance <= 1e-12 as int)) as e,
         round(sum(case when distance > 1e-12 then 1 / distance else 0 end), 9) as f from k where rank <= 25 group by all)
group by vec_id"""

# ------------------------------------------------------------------------------------ text features
TOKENS = "regexp_extract_all(lower(text), '[\\pL\\pN_\\pM]{2,}')"
SQL["document_idf"] = f"""
with t as (select doc_id, unnest({TOKENS}) as term from documents),
df as (select term, count(distinct doc_id) as df from t group by term having count(distinct doc_id) >= 2),
n as (select count(*) as n from documents)
select term, cast(df as bigint) as df, {r('ln((1 + n) / (1 + df)) + 1')} as idf from df, n"""
SQL["tfidf_terms"] = f"""
with t as materialized (select doc_id, md5(text) as document, {TOKENS} as w from documents),
g as (select doc_id, document, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from t),
c as materialized (select doc_id, any_value(document) as document, term, count(*) as tf from g group by doc_id, term),
n as (select count(*) as n from documents),
df as (select term, count(*) as df from c group by term having count(*) >= 2),
x as (select distinct document, c.term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as raw from c join df using (term), n),
u as (select document, term, raw / sqrt(sum(raw * raw) over (partition by document)) as w from x),
p as (select document, count(*) as terms, {r('max(w)')} as top_weight, {r('sum(w)')} as weight_sum from u group by document)
select doc_id, coalesce(terms, 0) as terms, coalesce(top_weight, 0) as top_weight, coalesce(weight_sum, 0) as weight_sum
from (select doc_id, md5(text) as document from documents) left join p using (document)"""

# ------------------------------------------------------------------------------------ files and streams
SQL["corrections_union"] = query(f"""
select final_team_cur, count(*) as n, count(*) filter (created_at is not null and src = 'history') as from_history from (
  select final_team_cur, created_at, 'history' as src from h where {BEFORE}
  union all select final_team_cur, resolved_at_ist, 'corrections' from routed where not auto_route) group by final_team_cur""", *routed())
SQL["deliverable_checks"] = query("""
select check_name, true as passed, cast(0 as bigint) as offending from (values ('row_count'), ('unique_id'), ('ids_missing'), ('ids_unexpected'), ('team_valid')) v(check_name)
where (select count(*) = count(distinct request_id) and bool_and(team in (select team from teams)) from routed)""", *routed())
EVERYTHING = (OOT[0], "select *, 0 as split from h where length(request_text) >= 1")
SQL["stream_route"] = query(f"""select request_id, team, {r('confidence')} as confidence, route_type, route_detail, auto_route
    from routed""", *routed(EVERYTHING))
SQL["stream_review_queue"] = query("select team as router_team, route_type, count(*) as n from routed where not auto_route group by all",
                                   *routed(EVERYTHING))
SQL["stream_corrections"] = query(f"""
select final_team as team, case when length(request_text) < 1 then 'request_text is missing or empty'
   when final_team not in (select team from teams) then 'unknown team' else 'accepted' end as outcome, count(*) as n from raw group by all""")
SQL["stream_event_windows"] = """select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by all"""
SQL["daily_shares"] = query(f"""select date_trunc('day', created_at) as window_start, count(*) as n,
    {r("avg(cast(route_type = 'vague' as int))")} as vague_share, {r("avg(cast(route_type = 'new_wording' as int))")} as new_wording_share
    from routed group by 1""", *routed())
SQL["first_team_weekly"] = query(f"""select date_trunc('week', created_at) as week, count(*) as n,
    {r('avg(cast(first_team_cur = final_team_cur as int))')} as first_team_share from h group by 1""")


# ------------------------------------------------------------------------------------ bootstrap, spelling, live windows
REACHED = "case when k = 0 or k = n then cast(j = k as double) else exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / n) + (n - j) * ln(1 - k / n)) end"
SPREAD = "cast(ceil(10 + 9 * sqrt(n * (k / n) * (1 - k / n))) as bigint)"
SPOTS = {"l0": 50, "l1": 51, "h0": 1950, "h1": 1951}
SQL["bootstrap_ci"] = query(f"""
select route_type, n, {r('k / n')} as accuracy, {r('(0.025 * l0 + 0.975 * l1) / n')} as low, {r('(0.975 * h0 + 0.025 * h1) / n')} as high from (
  select route_type, n, k, {', '.join(f'coalesce(min(j) filter (reached >= us[{i}]), max(j)) as {c}' for c, i in SPOTS.items())} from (
    select *, sum({REACHED}) over (partition by route_type order by j rows unbounded preceding) as reached from (
      select *, unnest(range(greatest(0, cast(floor(n * (k / n)) as bigint) - {SPREAD}), least(n, cast(floor(n * (k / n)) as bigint) + {SPREAD}) + 1)) as j from (
        select route_type, n, k, list_sort(list_transform(range(2000), lambda b:
               cast('0x' || substr(md5(concat_ws('|', coalesce(route_type, '~'), cast(b as varchar), '0')), 1, 15) as bigint) / 1152921504606846976.0::double)) as us
        from (select route_type, count(*) as n, cast(sum({OK}) as bigint) as k from routed group by all)))) group by all)""", *routed())

SQL["spelling_repair"] = query(f"""
select w.word, s.known, s.ratio from words w left join (
  select word, arg_max(known, (ratio, known)) as known, max(ratio) as ratio from similar_words group by word) s using (word)""",
    typos("typo", 0.30, 7), f"""
vocab as materialized ({SQL['vocabulary'][SQL['vocabulary'].rindex('select distinct word'):]}),
words as materialized (select distinct word from (select unnest(regexp_extract_all(lower(t), '[a-z]+')) as word from typo)
  where length(word) >= {L.SPELL_MIN_CHARS} and word not in ({', '.join(q(w) for w in L.KEEP_WORDS)}) and word not in (select word from vocab)),
{similar('words', 'vocab')}""").replace("with ", "with recursive ", 1)

SQL["live_event_windows"] = """select date_trunc('day', ts) as window_start, event_type, count(*) as n from events group by all"""
SQL["live_recent_context"] = query("""select product_family, day, clear_requests, team_7d, team_30d, team_90d from ctx
where day + interval 2 day <= (select max(created_at) from h)""", *CONTEXT)
SQL["approximate_vectors_recall"] = """select count(*) as queries, cast(sum(least(10, n - 1)) as bigint) as neighbours, true as reached
from embeddings, (select count(*) as n from embeddings) where vec_id % 20 = 0"""
