"""Shared common table expressions: the request history, its parse, learned tables, the cascade."""

from __future__ import annotations

from intake_spark import lexicon as L
from intake_spark.sources.fixtures import requests_sql


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def team_case(col: str) -> str:
    return "case " + " ".join(f"when {col} = {q(a)} then {q(b)}" for a, b in L.RENAMES.items()) + f" else {col} end"


# ------------------------------------------------------------------------------------ parse
def sub(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(to)}, 'g')"


def norm_sql(text: str, mask: bool = True) -> str:
    s = sub(f"lower(coalesce({text}, ''))", L.ID_PATTERN, " ")
    if mask:
        s = sub(s, rf"\b({L.PRODUCT_WORDS})\b", "P")
    return f"trim({sub(s, r'\s+', ' ')})"


def core_sql(norm: str) -> str:
    s = sub(norm, L.GREETING_PATTERN, "")
    s = sub(s, rf"\b({L.PAYMENT_WORDS})\b", " ")
    # no look-ahead in this engine: the character after the closing is put back
    s = sub(s, rf"\b({L.CLOSING_WORDS})(\s|$|,)", r" \2")
    s = sub(s, r"\.{2,}", " ")
    s = sub(s, r"[-–]+\s*$", " ")
    s = sub(s, r"\s+", " ")
    s = sub(s, r"\s*,\s*", ", ")
    return sub(f"trim({s}, ' ,')", "(, )+", ", ")


def clauses_sql(core: str, shown: bool = False) -> str:
    fixed = "|".join(c for c in L.CONTINUATIONS if "P" not in c)
    last = f"(?:{L.PRODUCT_WORDS}) scratched" if shown else "P scratched"
    marked = sub(core, f", ({fixed}|{last})(,|$)", r"~\1\2")
    return f"list_transform(string_split({marked}, ', '), lambda x: replace(x, '~', ', '))"


VAGUE_TEST = "regexp_matches({c}, " + q("^(" + "|".join(L.VAGUE_PHRASES) + ")$") + ")"
REMARK = "nullif(regexp_extract(lower(coalesce(text, '')), " + q(rf"\b({L.PAYMENT_WORDS})\b") + ", 1), '')"


def parse(source: str, text: str = "text", p: str = "", shown: bool = True) -> str:
    more = f", {norm_sql(text, False)} as _nshown" if shown else ""
    more2 = ", " + core_sql("_nshown") + " as _cshown" if shown else ""
    more3 = ", " + clauses_sql("_cshown", True) + f" as {p}shown" if shown else ""
    more4 = f", {p}shown[1] as {p}first_shown, {p}shown[-1] as {p}last_shown" if shown else ""
    return f"""
      select *, {VAGUE_TEST.format(c=p + 'last')} as {p}vague from (
        select *, len({p}clauses) as {p}n_clauses, {p}clauses[1] as {p}first, {p}clauses[-1] as {p}last{more4} from (
          select *, {clauses_sql(p + 'core')} as {p}clauses{more3} from (
            select *, {core_sql(p + 'norm')} as {p}core{more2} from (
              select *, {norm_sql(text)} as {p}norm{more} from ({source}) s0) s1) s2) s3) s4"""


HISTORY = f"""
raw as materialized ({requests_sql(False)}),
hist as (
  select *, created_at_ist as created_at,
         {team_case('team_label')} as bot_team, {team_case('first_team')} as first_team_cur,
         {team_case('final_team')} as final_team_cur,
         replace(replace(request_text, 'urgÃ©nt', 'urgent'), 'Ã¢â‚¬Â¦', '...') as text,
         resolved_at + case when source = 'legacy_zoho' then interval 330 minute else interval 0 minute end
           as resolved_at_ist
  from raw),
clean as (
  select *, date_diff('microsecond', created_at, resolved_at_ist) / 3.6e9 as hours_to_resolve,
         transfers = 0 and first_team_cur <> final_team_cur as inconsistent
  from hist),
h as materialized ({parse('select * from clean')}),
teams(i, team) as (values {', '.join(f'({i}, {q(t)})' for i, t in enumerate(L.TEAMS))})
"""

BEFORE = f"created_at < timestamp '{L.OUT_OF_TIME_START}'"
OOT = (f"select *, 0 as split from h where {BEFORE}", f"select *, 0 as split from h where not ({BEFORE})")
ROLLING = (
    " union all ".join(f"select *, {i} as split from h where created_at < timestamp '{s}'" for i, (_, s, _) in enumerate(L.QUARTERS)),
    " union all ".join(f"select *, {i} as split from h where created_at >= timestamp '{s}' and created_at < timestamp '{e}'"
                       for i, (_, s, e) in enumerate(L.QUARTERS)))


def stable_hash(*cols: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws('|', {', '.join(cols)})), 1, 15) as bigint)"


# folds of the stratified cross-validation
FOLDED = f"""
sliced as (select *, {stable_hash('request_id', "'0'")} as hh from h),
cvh as materialized (
  select *, cast((row_number() over (partition by final_team_cur, hh % 4096 order by hh, request_id) - 1 + hh % 4096) % 5 as int)
    as fold from sliced)"""
CV = (" union all ".join(f"select *, {s} as split from cvh where fold <> {s}" for s in range(5)),
      "select *, fold as split from cvh")


def group_folds(group: str) -> str:
    """CTE gh: history with the fold of its group, dealt by size back and forth."""
    return f"""
gsize as (select {group} as g, count(*) as n from h group by 1),
gturn as (select g, row_number() over (partition by slice order by n desc, g) - 1 + slice as turn
          from (select g, n, {stable_hash('g')} % 64 as slice from gsize)),
gfold as (select g, cast(case when (turn // 5) % 2 = 0 then turn % 5 else 4 - turn % 5 end as int) as fold from gturn),
gh as materialized (select h.*, gfold.fold from h join gfold on gfold.g = {group})"""


GROUPED = (" union all ".join(f"select *, {s} as split from gh where fold <> {s}" for s in range(5)),
           "select *, fold as split from gh")


# ------------------------------------------------------------------------------------ learned tables
def learned(learn: str, min_support: int = L.MIN_SUPPORT) -> str:
    a = L.VAGUE_ALPHA
    return f"""
lrn as materialized ({learn}),
pc as (select split, last, final_team_cur as team, count(*) as c from lrn where not vague group by all),
ph as materialized (
  select split, last, sum(c) as n, first(team order by c desc, team) as team, max(c) as k,
         list(team order by c desc, team)[1:3] as alts, list(c order by c desc, team)[1:3] as alt_c
  from pc group by all having sum(c) >= {min_support}),
cc as (select split, final_team_cur as team, count(*) as c from lrn where not vague group by all),
cl as (select split, sum(c) as cl_n, first(team order by c desc, team) as cl_team, max(c) as cl_k,
              list(team order by c desc, team)[1:3] as cl_alts from cc group by all),
vc as (select split, final_team_cur as team, count(*) as c from lrn where vague group by all),
splits as (select distinct split from lrn),
vt as (select s.split, t.team, coalesce(vc.c, 0) as c from splits s cross join teams t
       left join vc on vc.split = s.split and vc.team = t.team),
pl as (select split, sum(c) as pl_n, first(team order by c desc, team) as pl_team, max(c) as pl_k,
              list(team order by c desc, team) filter (c > 0)[1:3] as pl_alts from vt group by all),
vp as (select split, product_family, final_team_cur as team, count(*) as c from lrn
       where vague and product_family is not null group by all),
vpn as (select split, product_family, sum(c) as n from vp group by all),
pp as (select vpn.split, vpn.product_family, vpn.n, vt.team, coalesce(vp.c, 0) as c, vt.c as pooled_c, pl.pl_n,
              (coalesce(vp.c, 0) + {a}.0::double * (vt.c / pl.pl_n)) / (vpn.n + {a}) as post
       from vpn join vt using (split) join pl using (split)
       left join vp on vp.split = vpn.split and vp.product_family = vpn.product_family and vp.team = vt.team),
pm as materialized (select split, product_family, max(n) as pm_n, first(team order by post desc, team) as pm_team,
              max(post) as pm_post, list(team order by post desc, team)[1:3] as pm_alts from pp group by all),
tw as (select l.split, count(*) filter (l.final_team_cur = b.team) as two_k, count(*) as two_n
       from lrn l join ph a on a.split = l.split and a.last = l.first join ph b on b.split = l.split and b.last = l.last
       where not l.vague and l.n_clauses >= 2 and a.team <> b.team group by all),
py as (select l.split, count(*) filter (l.bot_team = 'Billing') as pay_bot,
              count(*) filter (l.final_team_cur = 'Billing') as pay_closed, count(*) as pay_n
       from lrn l left join ph on ph.split = l.split and ph.last = l.last
       where {REMARK.replace('text', 'l.text')} is not null and coalesce(ph.team <> 'Billing', true) group by all)
"""


def similar(words: str, vocab: str) -> str:
    """CTE similar_words(word, known, ratio): pairs of ratio 0.8 or more, by recursion on the longest matching block."""
    inside = "substr(word, blo + 1, bhi - blo)"
    best = (f"list_max(flatten(list_transform(range(alo, ahi), lambda i: list_filter(list_transform(range(1, ahi - i + 1), lambda k: "
            f"case when position(substr(known, i + 1, k) in {inside}) > 0 then {{'k': k, 'i': -i, 'j': -(blo + position(substr(known, i + 1, k) in {inside}) - 1)}} end), "
            f"lambda x: x is not null))))")
    return f"""
blocks(word, known, alo, ahi, blo, bhi, m) as (
  select word, known, alo, ahi, blo, bhi, {best} as m from (
    select w.word, v.word as known, 0::bigint as alo, length(v.word) as ahi, 0::bigint as blo, length(w.word) as bhi from {words} w join {vocab} v
    on 2 * least(length(w.word), length(v.word)) >= {L.SPELL_CUTOFF} * (length(w.word) + length(v.word))
    and levenshtein(w.word, v.word) <= (1 - {L.SPELL_CUTOFF}) * (length(w.word) + length(v.word)) + 1e-9)
  union all
  select word, known, alo, ahi, blo, bhi, {best} from (
    select word, known, r.alo as alo, r.ahi as ahi, r.blo as blo, r.bhi as bhi from (
      select word, known, unnest([{{'alo': alo, 'ahi': -m.i, 'blo': blo, 'bhi': -m.j}}, {{'alo': -m.i + m.k, 'ahi': ahi, 'blo': -m.j + m.k, 'bhi': bhi}}]) as r
      from blocks where m is not null)) x where ahi > alo and bhi > blo),
similar_words as materialized (select word, known, ratio from (
  select word, known, 2.0::double * coalesce(sum(m.k), 0) / (length(word) + length(known)) as ratio from blocks group by word, known) where ratio >= {L.SPELL_CUTOFF})"""


# spelling of the words that are new in April 2026; the query spelling_repair works such answers out
SPELLING = [("handel", "handle"), ("overheting", "overheating")]


def rule_match(col: str, rule) -> str:
    pattern = rule[1]
    if "(?!ment filter)" in pattern:   # no look-ahead here: hide the excluded phrase first
        rest = pattern.replace("|replace(?!ment filter)", "")
        return (f"(regexp_matches({col}, {q(rest)}) or "
                f"regexp_matches(replace({col}, 'replacement filter', ''), 'replace'))")
    return f"regexp_matches({col}, {q(pattern)})"


def first_rule(col: str, rules, value: int = 0) -> str:
    if not rules:
        return "cast(null as varchar)"
    return "case " + " ".join(f"when {rule_match(col, r)} then {q(r[value])}" for r in rules) + " end"


def rule_list(col: str, rules) -> str:
    if not rules:
        return "cast([] as varchar[])"
    items = ", ".join(f"case when {rule_match(col, r)} then {q(r[0])} end" for r in rules)
    return f"list_filter([{items}], lambda x: x is not null)"


def english(text: str) -> str:
    s = f"lower({text})"
    for pattern, to in L.HINGLISH:
        s = sub(s, rf"\b(?:{pattern})\b", to)
    return f"trim({sub(s, r'\s+', ' ')})"


def char_grams(x: str) -> str:
    """All character n-grams (3-5) inside padded words of a string."""
    def of(n):
        body = f"list_transform(range(1, greatest(length(w) + 2 - {n} + 1, 1) + 1), lambda i: substr(' ' || w || ' ', i, {n}))"
        return body if n == 3 else f"case when length(w) + 2 >= {n} then {body} else [] end"
    return (f"flatten(list_transform(list_filter(string_split(lower({x}), ' '), lambda w: w <> ''), "
            f"lambda w: list_concat(list_concat({of(3)}, {of(4)}), {of(5)})))")


def nearest(words: str, keys: str, out: str = "near") -> str:
    """CTE ``out``(split, last, near_key, near_sim): brute force over all known phrases."""
    return f"""
kk as materialized ({keys}),
kg as (select split, key, gram, count(*) as tf from (select split, key, unnest({char_grams('key')}) as gram from kk) group by all),
kn as (select split, count(*) as docs from kk group by all),
ki as (select kg.split, gram, ln((max(docs) + 1) / (count(*) + 1)) + 1 as idf from kg join kn using (split) group by all),
kw as (select split, key, gram, (1 + ln(tf)) * idf as w from kg join ki using (split, gram)),
kx as materialized (select split, key, gram, w / sqrt(sum(w * w) over (partition by split, key)) as w from kw),
ww as materialized ({words}),
wg as (select split, last, gram, count(*) as tf from (select split, last, unnest({char_grams('last')}) as gram from ww) group by all),
wx as (select split, last, gram, w / sqrt(sum(w * w) over (partition by split, last)) as w
       from (select split, last, gram, (1 + ln(tf)) * idf as w from wg join ki using (split, gram))),
wsim as (select wx.split, wx.last, kx.key, round(sum(wx.w * kx.w), 12) as sim from wx join kx using (split, gram) group by all),
{out} as materialized (select split, last, first(key order by sim desc, key) as near_key, max(sim) as near_sim from wsim group by all)"""


def cascade(score: str, features, rules=None, paraphrases=None, spelling=True, suffix: str = "") -> str:
    """CTE routed{suffix}: the scored rows with their decisions. Needs the CTEs of ``learned``."""
    rules = L.KEYWORD_RULES if rules is None else rules
    x = suffix
    b4 = "B4" in features
    fixed = english("text") if b4 else "lower(text)"
    if b4 and spelling:
        for a, b in SPELLING:
            fixed = sub(fixed, rf"\b{a}\b", b)
    para_rows = ", ".join(f"({q(s)}, {q(t)})" for s, t in (paraphrases or [])) or "(null, null)"
    para = parse(f"select * from (values {para_rows}) v(para_source, text) where para_source is not null", shown=False)
    use_para = "B3" in features
    near_needed = bool({"B1", "B2"} & set(features))
    steps = []
    if use_para:
        steps.append(("paraphrase", "para_team is not null", "para_team", "0.85"))
    if "B1" in features:
        steps.append(("similar", f"near_sim >= {L.FUZZY_MIN_SIM}", "near_team", "0.8"))
    if "B2" in features:
        steps.append(("vote", "agree >= 2", "voted", "case when agree = 3 then 0.85 else 0.75 end"))
        steps.append(("vote_split", "true", "coalesce(rule_team, near_team, cl_team)", "0.55"))
    steps += [("rules", "rule_team is not null and len(rule_others) = 0", "rule_team", "0.8"),
              ("rules_conflict", "rule_team is not null", "rule_team", "0.6"),
              ("model", "true", "cl_team", "least(cl_k / cl_n, 0.6)")]
    detail = "case " + " ".join(f"when {c} then {q(n)}" for n, c, _, _ in steps) + " end"
    new_team = "case route_detail " + " ".join(f"when {q(n)} then {t}" for n, _, t, _ in steps) + " end"
    new_conf = "case route_detail " + " ".join(f"when {q(n)} then cast({c} as double)" for n, _, _, c in steps) + " end"
    prod = "pm_team is not null" if "A1" in features else "false"
    near_ctes = ""
    if near_needed:
        keys = "select split, last as key, team as near_team from ph"
        if use_para:
            keys += f" union all select split, last, para_team from para{x}"
        near_ctes = "," + nearest(
            f"select distinct split, r_last as last from rd{x} where not r_vague and r_team is null and r_last <> ''",
            keys.replace(", team as near_team", "").replace(", para_team", ""), f"near{x}").replace(
            "kk as", f"nk{x} as materialized ({keys}), kk as")
    agree = lambda t: f"case when {t} is null then 0 else cast(coalesce(rule_team = {t}, false) as int) + cast(coalesce(near_team = {t}, false) as int) + cast(coalesce(cl_team = {t}, false) as int) end"
    return f"""
scr{x} as materialized ({score}),
para0{x} as (select para_source, last from ({para}) p where last <> '' and not vague),
para{x} as materialized (
  select ph.split, p.last, min(p.para_source) as para_source, first(ph.team order by p.para_source) as para_team
  from para0{x} p join ph on ph.last = p.para_source
  where not exists (select 1 from ph z where z.split = ph.split and z.last = p.last) and {'true' if use_para else 'false'}
  group by ph.split, p.last),
unk{x} as (select distinct s.split, s.text, s.norm, s.last from scr{x} s left join ph on ph.split = s.split and ph.last = s.last
        where trim(s.text) <> '' and not s.vague and ph.team is null),
fx{x} as ({parse(f"select *, {fixed} as fixed from unk{x}", 'fixed', 'f_', False)}),
rd0{x} as (select f.*, ph.team as r_team, ph.k as r_k, ph.n as r_n_rows, ph.alts as r_alts, p.para_team, p.para_source,
       f.fixed <> lower(f.text) and {'true' if b4 else 'false'} as differs
  from fx{x} f left join ph on ph.split = f.split and ph.last = f.f_last
  left join para{x} p on p.split = f.split and p.last = f.f_last),
rd1{x} as (select *, differs and (f_vague or r_team is not null or para_team is not null) as adopt from rd0{x}),
rd{x} as materialized (select split, text,
       case when adopt or (differs and f_last <> '') then fixed end as note,
       case when adopt or (differs and f_last <> '') then f_last else last end as r_last,
       adopt and f_vague as r_vague, case when adopt then f_n_clauses end as r_n, case when adopt then f_first end as r_first,
       r_team, r_k, r_n_rows, r_alts, para_team, para_source from rd1{x}){near_ctes},
j0{x} as (select s.*, ph.team as p_team, ph.k as p_k, ph.n as p_n, ph.alts as p_alts,
       rd.note, rd.r_last, coalesce(rd.r_vague, false) as r_vague, rd.r_n, rd.r_first, rd.r_team, rd.r_k, rd.r_n_rows, rd.r_alts,
       rd.para_team, rd.para_source, {REMARK.replace('text', 's.text')} as remark
  from scr{x} s left join ph on ph.split = s.split and ph.last = s.last
  left join rd{x} rd on rd.split = s.split and rd.text = s.text and ph.team is null and not s.vague),
j1{x} as (select j.*, coalesce(r_last, j.last) as d_last, coalesce(p_team, r_team) as s_team, coalesce(p_k, r_k) as s_k,
       coalesce(p_n, r_n_rows) as s_n, coalesce(p_alts, r_alts) as s_alts, coalesce(r_n, n_clauses) as d_n, coalesce(r_first, j.first) as d_first,
       cl.cl_team, cl.cl_k, cl.cl_n, cl.cl_alts, pl.pl_team, pl.pl_k, pl.pl_n, pl.pl_alts, pm.pm_team, pm.pm_post, pm.pm_n, pm.pm_alts,
       coalesce(tw.two_k, 0) as two_k, coalesce(tw.two_n, 0) as two_n, coalesce(py.pay_bot, 0) as pay_bot,
       coalesce(py.pay_closed, 0) as pay_closed, coalesce(py.pay_n, 0) as pay_n,
       {'nr.near_key, nr.near_sim, nk.near_team' if near_needed else 'cast(null as varchar) as near_key, cast(null as double) as near_sim, cast(null as varchar) as near_team'}
  from j0{x} j left join cl using (split) left join pl using (split) left join tw using (split) left join py using (split)
  left join pm on pm.split = j.split and pm.product_family = j.product_family
  {f'left join near{x} nr on nr.split = j.split and nr.last = coalesce(j.r_last, j.last) left join nk{x} nk on nk.split = nr.split and nk.key = nr.near_key' if near_needed else ''}),
j2{x} as (select *, case when trim(text) = '' or d_last = '' then 'empty' when vague or r_vague then 'vague'
       when s_team is not null then 'seen' else 'new_wording' end as route_type from j1{x}),
j3{x} as (select *, case when route_type = 'new_wording' then {first_rule('d_last', rules)} end as rule_team,
       case when route_type = 'new_wording' then {first_rule('d_last', rules, 2)} end as rule_label,
       {rule_list('d_last', rules)} as rule_teams from j2{x}),
j4{x} as (select *, list_filter(rule_teams, lambda t: t <> rule_team) as rule_others,
       greatest({agree('rule_team')}, {agree('near_team')}, {agree('cl_team')}) as agree,
       case when {agree('rule_team')} = greatest({agree('rule_team')}, {agree('near_team')}, {agree('cl_team')}) then rule_team
            when {agree('near_team')} = greatest({agree('rule_team')}, {agree('near_team')}, {agree('cl_team')}) then near_team else cl_team end as voted
  from j3{x}),
j5{x} as (select *, case when route_type = 'seen' then case when note is not null then 'repaired' else 'exact' end
       when route_type = 'new_wording' then {detail} else '' end as route_detail from j4{x}),
j6{x} as (select *,
       case when route_type = 'empty' then pl_team when route_type = 'vague' and {prod} then pm_team when route_type = 'vague' then pl_team
            when route_type = 'seen' then s_team else {new_team} end as team,
       case when route_type = 'empty' then 0.0::double when route_type = 'vague' and {prod} then pm_post when route_type = 'vague' then pl_k / pl_n
            when route_type = 'seen' then s_k / s_n else {new_conf} end as conf,
       case when route_type = 'empty' then cast([] as varchar[]) when route_type = 'vague' and {prod} then pm_alts when route_type = 'vague' then pl_alts
            when route_type = 'seen' then s_alts else cl_alts end as alts from j5{x}),
j7{x} as (select *, route_type in ('empty', 'vague') or (route_type = 'new_wording' and conf < 0.7) as ask from j6{x}),
routed{x} as materialized (select *, round_even(conf, 3) as confidence,
       case when conf >= 0.9 and not ask then 'high' when conf >= 0.7 then 'medium' else 'low' end as confidence_level,
       conf >= 0.7 and not ask as auto_route, ask as needs_clarification from j7{x})"""


def percent(p: str) -> str:
    return f"cast(cast(round_even(({p}) * 100, 0) as bigint) as varchar) || '%'"


def share_text(k: str, n: str) -> str:
    p = f"({k} / {n})"
    return f"case when {p} >= 0.995 and {p} < 1 then '>99%' when {p} > 0 and {p} < 0.005 then '<1%' else {percent(p)} end"


def reasons_sql() -> str:
    """The reasons of a routed row (default switches) joined by '|'."""
    read_as = "case when note is not null then 'Taken as “' || replace(d_last, 'P', 'product') || '” with spelling and Hindi words put right.' end"
    product = (f"'Unclear message about ' || product_family || ': tried first with ' || team || ' (' || {percent('conf')} || ' of ' || "
               "format('{:,}', pm_n::bigint) || ' like it for ' || product_family || '). Only a starting point; over all products the usual "
               "team is ' || pl_team || ', and the words alone do not settle it.'")
    pooled = (f"'Unclear messages so far: ' || format('{{:,}}', pl_n::bigint) || '; every team got some, most went to ' || team "
              f"|| ' with ' || {percent('conf')} || '. The words alone do not settle it.'")
    new = ("case route_detail when 'rules' then 'Not seen before; its words point to ' || rule_label || ', so ' || team || ' takes it.' "
           "when 'rules_conflict' then 'Not seen before; its words point to ' || rule_label || ' (' || team || "
           "') but also to ' || array_to_string(rule_others, ', ') || '. Please ask back.' "
           "when 'model' then 'Not seen before and no rule fits; the fallback decided.' end")
    two = (f"case when d_n >= 2 and route_type in ('seen', 'new_wording') then d_n || ' requests in one message (“' || "
           "case when len(shown) >= 2 then first_shown else d_first end || '” before “' || last_shown || '”). The later one counts, as in ' "
           f"|| case when two_n > 0 then {percent('two_k / two_n')} || ' of ' || format('{{:,}}', two_n::bigint) else 'most' end || "
           "' earlier cases with two. Pass the first one on to ' || team || ' as well.' "
           "when d_n >= 2 and route_type = 'vague' then 'Before that it says “' || first_shown || "
           "'”; in earlier cases this did not tell who closed an unclear message.' end")
    paid = ("case when remark is not null and team <> 'Billing' then 'Payment remark “' || remark || '” does not decide "
            "the team.' || case when pay_n > 0 then ' First sent to Billing: ' || format('{:,}', pay_bot::bigint) || ' of ' || "
            "format('{:,}', pay_n::bigint) || ' earlier ones; closed there: ' || format('{:,}', pay_closed::bigint) || '.' "
            "else '' end end")
    return f"""concat_ws('|',
      case when route_type = 'empty' then 'Empty message. Please ask for the need.' end,
      case when route_type = 'vague' then 'No need is stated (“' || last_shown || '”).' end,
      case when route_type = 'vague' and pm_team is not null then {product} when route_type = 'vague' then {pooled} end,
      case when route_type = 'vague' then 'Put the question to the sender first; otherwise correct the team after the first contact.' end,
      case when route_type in ('seen', 'new_wording') then 'Request: “' || last_shown || '”.' end,
      case when route_type in ('seen', 'new_wording') then {read_as} end,
      case when route_type = 'seen' then format('{{:,}}', s_n::bigint) || ' earlier requests read the same; ' || {share_text('s_k', 's_n')} ||
           ' of them ended at ' || team || '.' end,
      case when route_type = 'new_wording' then {new} end, {two}, {paid})"""


def query(select: str, *ctes: str) -> str:
    return "with " + ",\n".join([HISTORY, *ctes]) + "\n" + select
