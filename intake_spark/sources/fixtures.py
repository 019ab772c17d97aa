"""A request history derived from the ``orders`` table.

The public test tables hold no service requests, so every order becomes one request by plain
arithmetic on its keys. The same SELECT is rendered for Spark and for the DuckDB oracle, which keeps
both sides on identical input while each computes its own answer from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import lexicon as L
from ..session import spread

FAMILIES = ["Room Heater", "Ceiling Fan", "Water Purifier", "Induction Cooktop", "Robot Vacuum", "Mixer Grinder", "Air Fryer"]

# for each team a sentence about the product <p> and what may stand in its gap
TOPICS = [
    ("Repairs", "<p> {} is overheating after ten minutes", ["handle", "base", "plug", "back panel", "knob"]),
    ("Repairs", "<p> {} since the power cut", ["not turning on", "leaking water"]),
    ("Billing", "refund of the <p> {} still pending", ["deposit", "advance", "difference"]),
    ("Billing", "invoice not received {} buying the <p>", ["after", "when"]),
    ("Returns & Replacement", "box was open, <p> {}", ["scratched"]),
    ("Returns & Replacement", "received used <p>, want {}", ["exchange"]),
    ("Installs & Demo", "demo of the <p> wanted for {}", ["tuesday", "the new kitchen", "my parents"]),
    ("Warranty Claims", "guarantee papers of the <p> lost {}", ["while shifting", "in the rain"]),
    ("Warranty Claims", "coverage of the <p> ended {}, why", ["early"]),
    ("Filters & Consumables", "cartridge for the <p> {}", ["is over", "in size two", "by courier"]),
    ("Product Advice", "can i run the <p> {}", ["on inverter", "overnight", "in a cupboard"]),
]
CLEAR = [(sentence.format(gap), team) for team, sentence, gaps in TOPICS for gap in gaps]
VAGUE = [v.replace(" P", " <p>").replace("P ", "<p> ") for v in L.VAGUE_PHRASES]
# sentences that first appear in April 2026: (order key divisor, remainder, sentence, closing team)
LATE = [
    (59, 0, "sparks seen on the <p>, blade shows rust", "Repairs"),
    (61, 3, "visit for fitting of the <p> was missed", "Installs & Demo"),
    (67, 1, "<p> chal nahi raha", "Repairs"),
    (67, 2, "<p> kharidi par invoice nahi mila", "Billing"),
    (71, 4, "<p> handel is overheting after ten minutes", "Repairs"),
    (79, 5, "as told yesterday about the <p>", "Product Advice"),
    (83, 6, "money for the <p> has not come back", "Billing"),
    (89, 7, "demo of the new <p> wanted for my parents", "Installs & Demo"),
    (101, 8, "baat karni hai <p>", "Repairs"),
]
EMPTY_DIVISOR = 103
GREETINGS = ["urgent: ", "", "hello team ", "sir, "]


class _Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def pick(self, items, index) -> str:
        quoted = ", ".join(f"'{i}'" for i in items)
        if self.spark:
            return f"element_at(array({quoted}), cast({index} as int) + 1)"
        return f"list_extract([{quoted}], {index} + 1)"

    def div(self, a, b) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def plus(self, ts, days="0", hours="0", minutes="0") -> str:
        if self.spark:
            return (f"({ts} + make_dt_interval(cast({days} as int), cast({hours} as int), "
                    f"cast({minutes} as int), 0))")
        return (f"({ts} + to_days(cast({days} as int)) + to_hours(cast({hours} as int)) + "
                f"to_minutes(cast({minutes} as int)))")

    def ts(self, text) -> str:
        return f"timestamp_ntz'{text}'" if self.spark else f"timestamp '{text}'"

    def string(self, x) -> str:
        return f"cast({x} as {'string' if self.spark else 'varchar'})"

    def padded(self, x, width) -> str:
        s = self.string(x)
        return f"lpad({s}, cast(greatest({width}, length({s})) as int), '0')"


def requests_sql(spark: bool, orders: str = "orders") -> str:
    """One row per order: the labelled request together with its resolution record."""
    d = _Dialect(spark)
    late = f"created_at_ist >= {d.ts('2026-04-01 00:00:00')} and not is_vague"
    late_case = " ".join(f"when {late} and k % {n} = {r} then '{text}'" for n, r, text, _ in LATE)
    late_team = " ".join(f"when {late} and k % {n} = {r} then '{team}'" for n, r, _, team in LATE)
    empty = f"{late} and k % {EMPTY_DIVISOR} = 5"

    def old_name(team):
        return (f"case when created_at_ist < {d.ts('2026-01-15 00:00:00')} and {team} = 'Installs & Demo' "
                f"then 'Installations' when created_at_ist < {d.ts('2026-01-15 00:00:00')} and "
                f"{team} = 'Filters & Consumables' then 'Consumables' else {team} end")

    return f"""
    select 'SR' || {d.padded('k', 8)} as request_id,
           request_text,
           {d.pick(['ivr', 'chat', 'whatsapp', 'email'], 'k % 4')} as channel,
           product_family,
           {d.pick(['in_warranty', 'shield', 'out_of_warranty'], 'k % 3')} as warranty_status,
           created_at_ist,
           source,
           {old_name('bot')} as team_label,
           {old_name('bot')} as first_team,
           {old_name('final')} as final_team,
           cast(case when bot = final or k % 83 = 0 then 0 else 1 + k % 2 end as int) as transfers,
           {d.plus('created_at_ist', '0', "4 + k % 17 + case when bot <> final then 8 else 0 end",
                   f"case when source = 'legacy_zoho' then -330 else 0 end")} as resolved_at
    from (
      select *,
             case when {empty} then {d.pick(['', '   '], 'k % 2')}
                  when source = 'legacy_zoho' and k % 9 = 4
                  then replace(clean_text, 'urgent', 'urgÃ©nt') || ' Ã¢â‚¬Â¦' else clean_text end as request_text,
             case when payment <> '' then 'Billing' when is_vague then 'Repairs'
                  when k % 9 = 2 then 'Filters & Consumables' else final end as bot
      from (
        select *,
               {d.pick(GREETINGS, d.div('k', 3) + ' % 4')}
               || case when k % 19 = 0
                       then replace({d.pick([p for p, _ in CLEAR], f'(5 * k + c + 4) % {len(CLEAR)}')}, '<p>', product) || ', '
                       else '' end
               || replace(phrase, '<p>', product) || payment
               || {d.pick(['', ' thanks', ' pls call back', ' order KO', ' reg no SR'], d.div('k', 5) + ' % 5')}
               || case {d.div('k', 5)} % 5 when 3 then {d.padded('k', 7)} when 4 then {d.padded('c', 7)}
                  else '' end as clean_text
        from (
          select *,
                 lower(product_family) as product,
                 case {late_case}
                      when is_vague then {d.pick(VAGUE, d.div('k', 6) + f' % {len(VAGUE)}')}
                      else {d.pick([p for p, _ in CLEAR], f'(7 * k + 3 * c) % {len(CLEAR)}')} end as phrase,
                 case when {empty} then 'Repairs' {late_team}
                      when is_vague then {d.pick(L.TEAMS, '(k * k + (11 * k + c) % 7) % 7')}
                      when k % 53 = 0 then {d.pick(L.TEAMS, d.div('k', 53) + ' % 7')}
                      else {d.pick([t for _, t in CLEAR], f'(7 * k + 3 * c) % {len(CLEAR)}')} end as final,
                 case when k % 13 = 0 then ' paid on upi' when k % 13 = 5 then ' already paid in full'
                      else '' end as payment
          from (
            select *, case when created_at_ist < {d.ts('2025-10-01 00:00:00')} then 'legacy_zoho' else 'crm' end
                      as source
            from (
              select o_orderkey as k, o_custkey as c,
                     {d.plus(d.ts('2025-04-01 00:00:00'), '(37 * o_orderkey) % 456', '0',
                             '(101 * o_orderkey) % 1440')} as created_at_ist,
                     {d.pick(FAMILIES, '(11 * o_orderkey + o_custkey) % 7')} as product_family,
                     o_orderkey % 6 = 1 as is_vague
              from {orders}
            ) t0
          ) t1
        ) t2
      ) t3
    ) t4
    """


REQUEST_COLUMNS = [
    "request_id", "request_text", "channel", "product_family", "warranty_status", "created_at_ist", "source",
    "team_label",
]
RESOLUTION_COLUMNS = ["request_id", "first_team", "final_team", "transfers", "resolved_at"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with their resolution columns, one row per order."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey"))
    return spark.sql(requests_sql(True, "{orders}"), orders=orders)


def history_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The two raw tables of the data pack: labelled requests, and the resolution log."""
    rows = labelled(spark, sf_dir)
    return rows.select(*REQUEST_COLUMNS), rows.select(*RESOLUTION_COLUMNS)
