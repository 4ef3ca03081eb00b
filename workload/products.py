"""Queries for the library's products: deposit KPIs and charging sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.frames import distinct_values, numeric_columns
from tidemark.plans import calendar as Cal
from tidemark.plans import cards as Cards
from tidemark.plans import clusters as Cl
from tidemark.plans import flows as Fl
from tidemark.plans import kpis as K
from tidemark.plans import ledger as L
from tidemark.plans import market as M
from tidemark.plans import power as P
from tidemark.plans import segments as Seg
from tidemark.plans import sessions as S
from tidemark.plans import stats as St
from tidemark.plans import views as V
from tidemark.plans.workspace import DepositWorkspace
from tidemark.sources import star_schema as star
from workload import sql as Q
from workload.registry import query, rounded

VIEW = "Quarterly"


def workspace(spark: SparkSession, folder: str, freq: str = VIEW, **chosen) -> DepositWorkspace:
    return DepositWorkspace(
        star.ledger(spark, folder), star.registrations(spark, folder), star.market(spark, folder), freq, **chosen)


def features(spark: SparkSession, folder: str) -> DataFrame:
    return S.prepare(star.sessions(spark, folder), star.holidays(spark))


def span(spark: SparkSession, folder: str) -> DataFrame:
    return Cal.interval(star.sessions(spark, folder))


def curve(spark: SparkSession, folder: str) -> DataFrame:
    return P.session_power_curve(features(spark, folder), span(spark, folder), star.holidays(spark))


# ---------------------------------------------------------------- deposits

@query("c1_enrich_ledger", Q.with_(Q.ENRICHED) + """select user_id, trxn_id, trxn_type, trxn_group,
 cast(atpv as double) atpv, account_status, account_count, user_status from enriched""")
def _(spark, folder):
    return L.enrich_ledger(star.ledger(spark, folder)).select(
        "user_id", "trxn_id", "trxn_type", "trxn_group", "atpv", "account_status", "account_count", "user_status")


@query("c2_registration_events", Q.with_(Q.EVENTS) + f"""select user_id, trxn_id, {Q.stamp('trxn_datetime')} trxn_datetime,
 trxn_type, country, channel, {Q.stamp('signup_datetime')} signup_datetime,
 cast(customer_acquisition_cost as double) customer_acquisition_cost from events_""")
def _(spark, folder):
    return L.registration_events(star.registrations(spark, folder), star.ledger(spark, folder))


@query("c3_market_dim", Q.with_(Q.MARKET) + "select * from market_dim order by country")
def _(spark, folder):
    return L.market_dim(star.market(spark, folder))


CHOSEN = dict(countries=["NATION_1", "NATION_7", "NATION_20"], services=["Fixed", "Locked"], channels=["ch0", "ch1", "ch2"])


@query("c4_apply_filters", Q.with_(Q.EVENTS) + """select 'ledger' frame, country, channel, service, count(*) n, count(distinct user_id) users
 from enriched where country in ('NATION_1','NATION_7','NATION_20') and (service in ('Fixed','Locked') or service is null)
 and channel in ('ch0','ch1','ch2') group by all
union all
select 'registrations', country, channel, null, count(*), count(distinct user_id)
 from events_ where country in ('NATION_1','NATION_7','NATION_20') and channel in ('ch0','ch1','ch2') group by all""")
def _(spark, folder):
    w = workspace(spark, folder, **CHOSEN)
    counts = [F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users")]
    ledger = w.trxns.groupBy("country", "channel", "service").agg(*counts)
    steps = w.registrations.groupBy("country", "channel").agg(*counts)
    return ledger.withColumn("frame", F.lit("ledger")).unionByName(
        steps.withColumns({"frame": F.lit("registrations"), "service": F.lit(None).cast("string")}))


@query("c5_acquisition_kpis", Q.with_(Q.EVENTS, Q.acquisition("Monthly")) + f"select * replace ({Q.label('date')} as date) from acq")
def _(spark, folder):
    w = workspace(spark, folder, "Monthly")
    return K.acquisition_kpis(w.registrations, "Monthly")


@query("c6_conversion_rates", Q.with_(Q.EVENTS, Q.acquisition("Monthly"), Q.RATES) + f"select * replace ({Q.label('date')} as date) from rates")
def _(spark, folder):
    w = workspace(spark, folder, "Monthly")
    return K.conversion_rates(K.acquisition_kpis(w.registrations, "Monthly"))


for _freq in ("Quarterly", "Monthly"):
    _suffix = "" if _freq == "Quarterly" else f"_{_freq.lower()}"

    @query(f"c7_transaction_kpis{_suffix}", Q.with_(Q.ENRICHED, Q.transactions(_freq)) + f"select {Q.transaction_columns()} from trx")
    def _(spark, folder, freq=_freq):
        return K.transaction_kpis(L.enrich_ledger(star.ledger(spark, folder)), freq)


@query("c7_transaction_kpis_dense", Q.with_(Q.ENRICHED, Q.transactions("Monthly", dense=True)) + f"select {Q.transaction_columns()} from trx")
def _(spark, folder):
    return K.transaction_kpis(L.enrich_ledger(star.ledger(spark, folder)), "Monthly", densify=True)


@query("c9_latest_period_dense", Q.with_(Q.ENRICHED, Q.transactions("Monthly", dense=True)) + f"select {Q.transaction_columns()} from trx where date = (select max(date) from trx)")
def _(spark, folder):
    return K.latest_period(K.transaction_kpis(L.enrich_ledger(star.ledger(spark, folder)), "Monthly", densify=True))


@query("c5_acquisition_kpis_dense", Q.with_(Q.EVENTS, Q.acquisition("Weekly", dense=True)) + f"select * replace ({Q.label('date')} as date) from acq")
def _(spark, folder):
    return K.acquisition_kpis(workspace(spark, folder, "Weekly").registrations, "Weekly", densify=True)


DUE_COLUMNS = f"""country, service, trxn_group, trxn_type, {Q.label('mdate')} mdate, {Q.label('date')} date, U, T,
 cast(ATPV as double) ATPV, cast(DD as double) DD, pct_change_U, pct_change_T, pct_change_ATPV, pct_change_DD"""


@query("c8_due_kpis", Q.with_(Q.ENRICHED, Q.dues("Quarterly")) + f"select {DUE_COLUMNS} from due")
def _(spark, folder):
    return K.due_kpis(L.add_groups(star.ledger(spark, folder)), "Quarterly")


@query("c9_latest_period", Q.with_(Q.ENRICHED, Q.transactions(VIEW)) + f"select {Q.transaction_columns()} from trx where date = (select max(date) from trx)")
def _(spark, folder):
    return K.latest_period(workspace(spark, folder).transactions)


@query("c9_first_due", Q.with_(Q.ENRICHED, Q.dues(VIEW)) + f"select {DUE_COLUMNS} from first_due")
def _(spark, folder):
    return K.first_due(workspace(spark, folder).dues)


def _cards_sql(freq: str, word: str) -> str:
    def unpivoted(frame: str, group: str, kind: str, source: str, where: str) -> str:
        names = sorted({m for _, f, _, _, m, _, _ in Cards.CATALOGUE if f == frame})
        return " union all ".join(
            f"select '{frame}' frame, {group} trxn_group, {kind} trxn_type, '{m}' measure, "
            f"{'-' if m[0] == '-' else ''}cast({m.lstrip('-')} as double) v, cast(pct_change_{m.lstrip('-')} as double) chg "
            f"from {source} where {where}" for m in names)

    catalogue = ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in Cards.CATALOGUE)
    latest = "date = (select max(date) from {t}) and country = 'all'"
    facts = " union all ".join([
        unpivoted("trxns", "trxn_group", "trxn_type", "trx", latest.format(t="trx") + " and service = 'all'"),
        unpivoted("dues", "'all'", "'all'", """(select * from first_due where country = 'all' and service = 'all'
            and trxn_group = 'all' and trxn_type = 'all' order by mdate, date desc limit 1)""", "true"),
        unpivoted("acqs", "'all'", "trxn_type", "acq", latest.format(t="acq") + " and channel = 'all'"),
        unpivoted("rates", "'all'", "'all'", "rates", latest.format(t="rates") + " and channel = 'all'"),
    ])

    def digits(x: str) -> str:
        return f"length(printf('%.0f', floor(({x}) + 0.5)))"

    def fixed(x: str, p: str) -> str:
        return (f"case {p} when 0 then printf('%.0f', floor(({x}) + 0.5)) when 1 then printf('%.1f', {Q.r(x, 1)}) "
                f"else printf('%.2f', {Q.r(x, 2)}) end")

    suffix = "case {m} when 0 then '' when 1 then 'K' when 2 then 'M' else 'B' end"
    return Q.with_(
        Q.EVENTS, Q.acquisition(freq), Q.RATES, Q.transactions(freq), Q.dues(freq),
        f"facts as ({facts})",
        f"catalogue(kpi, frame, trxn_group, trxn_type, measure, unit, delta) as (values {catalogue})",
        "k0 as (select *, case when unit = '%' then v * 100 else v end x from catalogue left join facts using (frame, trxn_group, trxn_type, measure))",
        f"""k1 as (select *, least((({digits('x')}) - 1) // 3, 3) m, 2 - (({digits('x')}) - 1) % 3 p0,
          least((({digits('abs(chg)')}) - 1) // 3, 3) cm, 2 - (({digits('abs(chg)')}) - 1) % 3 cp from k0)""",
        """k2 as (select *, x * pow(cast(0.001 as double), m) sx, case when unit = '#' and m = 0 then 0 else p0 end p,
          chg * pow(cast(0.001 as double), cm) sc from k1)""",
        f"k3 as (select *, {fixed('sx', 'p')} txt from k2)",
    ) + f"""select '{freq} ' || kpi title, v as "value", chg as "change",
  case when v is null then '0 ' || unit else
    case when length(txt) >= 3 then txt when x < 0 then '-' || lpad(substr(txt, 2), 2, '0') else lpad(txt, 3, '0') end
    || {suffix.format(m='m')} || unit end shown,
  case when chg is null then 'No prev. stat' else case when sc < 0 then '-' else '+' end || {fixed('abs(sc)', 'cp')}
    || {suffix.format(m='cm')} || ' % vs. prev. {word}' end trend,
  case when v is null or chg is not null then delta else 'off' end delta,
  case when v is null then 'No Record' else 'ok' end status from k3"""


@query("c10_kpi_cards", _cards_sql(VIEW, "Quarter"))
def _(spark, folder):
    w = workspace(spark, folder, sets=K.VIEW_SETS)
    return Cards.kpi_cards(w.transactions, w.dues, w.acquisition, w.conversion, w.freq)


@query("c11_deposits_over_time", Q.with_(Q.ENRICHED, Q.transactions("Monthly")) + f"""select service, {Q.label('date')} date, cast(TPV as double) TPV,
 cast(sum(TPV) over (partition by service order by date rows between unbounded preceding and current row) as double) "cum_TPV"
 from trx where country = 'all' and trxn_type = 'all' and trxn_group = 'all'""")
def _(spark, folder):
    return V.deposits_over_time(workspace(spark, folder, "Monthly", sets=K.VIEW_SETS).transactions)


@query("c12_due_vs_realized", Q.with_(Q.ENRICHED, Q.transactions(VIEW), Q.dues(VIEW)) + f"""select trxn_type series, {Q.label('date')} date, cast(abs(ATPV) as double) "value"
 from trx where country = 'all' and trxn_group = 'all' and service = 'all' and trxn_type in ('break','withdraw','mature','renew')
 union all select 'Due Deposits', {Q.label('mdate')}, cast(DD as double) from due
 where country = 'all' and trxn_group = 'all' and service = 'all' and trxn_type = 'all'""")
def _(spark, folder):
    w = workspace(spark, folder, sets=K.VIEW_SETS)
    return V.due_vs_realized(w.transactions, w.dues)


AFLOW_SQL = """g0 as (
 select user_id, channel, trxn_type, trxn_datetime, coalesce(trxn_id, -1) trxn_id, 0 stage from events_ where trxn_type <> 'signup'
 union all select user_id, null, service, trxn_datetime, trxn_id, 1 from enriched where trxn_type = 'open'),
g1 as (select coalesce(lag(trxn_type) over (partition by user_id order by trxn_datetime, trxn_id, stage, trxn_type), channel) source,
  trxn_type target from g0),
g2 as (select source, target, count(*) len from g1 group by all),
g3 as (select i.source, i.n - o.n len from (select target source, sum(len) n from g2 group by 1) i
  join (select source, sum(len) n from g2 group by 1) o using (source) where i.n <> o.n),
edges as (select source, target, cast(len as bigint) len from g2 union all
 select source, case when source in ('verify','reject') then 'dropped' when source in ('activate','dropped') then 'others' end t,
  cast(len as bigint) from g3 where t is not null)"""


@query("c13_acquisition_flow", Q.with_(Q.EVENTS, AFLOW_SQL) + "select * from edges")
def _(spark, folder):
    w = workspace(spark, folder)
    return Fl.acquisition_flow(w.registrations, w.trxns)


SFLOW_SQL = """g1 as (select service, coalesce(lag(trxn_type) over (partition by service, user_id order by trxn_datetime, trxn_id), channel) source,
  trxn_type target from enriched where trxn_type not in ('top_up','withdraw')),
g2 as (select service, source, target, count(*) len from g1 group by all),
g3 as (select i.service, i.source, i.n - o.n len from (select service, target source, sum(len) n from g2 group by 1, 2) i
  join (select service, source, sum(len) n from g2 group by 1, 2) o using (service, source) where i.n <> o.n),
edges as (select service, source, target, cast(len as bigint) len from g2 union all
 select service, source, 'ongoing', cast(len as bigint) from g3
 where source in ('activate','verify','signup','renew','open','cross-open','re-open','ongoing'))"""


@query("c14_service_flow", Q.with_(Q.ENRICHED, SFLOW_SQL) + "select * from edges")
def _(spark, folder):
    return Fl.service_flow(workspace(spark, folder).trxns)


SNODES_SQL = """n0 as (select service, source node, 0 side, source, target from edges union all
  select service, target, 1, source, target from edges),
n1 as (select service, node, min({'a': side, 'b': source, 'c': target}) pos from n0 group by all),
n2 as (select *, row_number() over (partition by service order by pos) - 1 node_id,
  case when node like 'ch_' then 0 when node in ('open','cross-open') then 1 when node = 'renew' then 2
       when node in ('ongoing','mature','break') then 3 when node = 're-open' then 4 end lvl from n1),
n3 as (select *, cast(lvl + 1 as double) / (max(lvl) over (partition by service) + 2) x0,
  row_number() over (partition by service, lvl order by node_id) - 1 k from n2),
n4 as (select *, case when lvl is null then 0.5 else cast(k + 1 as double) / (max(k) over (partition by service, lvl) + 2) end y0 from n3),
nodes as (select service, node_id, node, case when x0 is not null then least(greatest(x0, 0.05), 0.95) end x,
  case when node = 're-open' then cast(0.33 as double) else least(greatest(y0, 0.05), 0.95) end y from n4)"""


@query("c15_service_nodes", Q.with_(Q.ENRICHED, SFLOW_SQL, SNODES_SQL) + "select * from nodes")
def _(spark, folder):
    w = workspace(spark, folder)
    return Fl.service_nodes(Fl.service_flow(w.trxns), w.registrations)


ANODES_SQL = (
    SNODES_SQL.replace("service, ", "").replace("partition by service order by pos", "order by pos")
    .replace("partition by service)", ")").replace("select service node", "select node")
    .replace("when node in ('open','cross-open') then 1 when node = 'renew' then 2", "when node in ('verify','reject') then 1 when node in ('activate','dropped') then 2")
    .replace("when node in ('ongoing','mature','break') then 3 when node = 're-open' then 4", "when node in ('others','Fixed','Flexible','Locked') then 3")
    .replace("case when node = 're-open' then cast(0.33 as double) else least(greatest(y0, 0.05), 0.95) end", "least(greatest(y0, 0.05), 0.95)")
)


@query("c15_acquisition_nodes", Q.with_(Q.EVENTS, AFLOW_SQL, ANODES_SQL) + "select * from nodes")
def _(spark, folder):
    w = workspace(spark, folder)
    return Fl.acquisition_nodes(Fl.acquisition_flow(w.registrations, w.trxns), w.registrations, w.trxns)


def _tree_sql(cells: str, path: list[str], value: str, weight: str, kind: str) -> str:
    exact = f"cast({value} as {kind})"
    total = f"cast(sum({exact}) as double)"
    groups = ", ".join(f"case when grouping({c}) = 1 then 'all' else {c} end {c}" for c in path)
    level = " + ".join(f"(1 - grouping({c}))" for c in path)
    return f"""select 'Europe' root, {groups}, cast({level} as bigint) as "level",
 {Q.r(total)} as "{value}",
 {Q.r(f'cast(sum({exact} * cast({weight} as decimal(19,10))) as double) / nullif({total}, 0)')} {weight},
 {Q.r(f'{total} / nullif((select {total} from {cells}), 0) * 100')} share_of_root
 from {cells} group by rollup({', '.join(path)})"""


@query("c16_segment_tree", Q.with_(Q.EVENTS, Q.acquisition("Quarterly"), """cells as (select country, channel,
 case trxn_type when 'verify' then 'Verified' else 'Rejected' end trxn_type, U, A_CAC from acq
 where date = (select max(date) from acq) and country <> 'all' and channel <> 'all' and trxn_type in ('verify','reject'))""")
    + _tree_sql("cells", ["country", "channel", "trxn_type"], "U", "A_CAC", "decimal(18,0)"))
def _(spark, folder):
    return rounded(V.segment_tree(workspace(spark, folder).acquisition), ["U", "A_CAC", "share_of_root"])


@query("c17_channel_funnel", Q.with_(Q.EVENTS, Q.acquisition(VIEW)) + f"""select channel, trxn_type, U,
 {Q.ratio('U', 'max(U) over (partition by channel)')} * 100 pct_of_max from acq
 where date = (select max(date) from acq) and trxn_type <> 'reject' and channel <> 'all' and country = 'all'""")
def _(spark, folder):
    return V.channel_funnel(workspace(spark, folder).acquisition)


@query("c18_due_ratio_by_country", Q.with_(Q.ENRICHED, Q.transactions(VIEW), Q.dues(VIEW), """managed as (select country, DUM from trx
 where date = (select max(date) from trx) and country <> 'all' and service = 'all' and trxn_group = 'all' and trxn_type = 'all')""",
    """coming as (select country, mdate, DD from first_due where country <> 'all' and service = 'all' and trxn_group = 'all' and trxn_type = 'all')""")
    + f"""select country, cast(DD as double) DD, cast(DUM as double) DUM, {Q.r(Q.ratio('DD', 'DUM') + ' * 100', 2)} due_pct
 from (select * from coming where mdate = (select min(mdate) from coming)) full join managed using (country)""")
def _(spark, folder):
    w = workspace(spark, folder, sets=K.VIEW_SETS)
    return V.due_ratio_by_country(w.dues, w.transactions)


DVM_SQL = """dm0 as (
 select country, service, 'DUM' variable, cast(DUM as double) v from trx where date = (select max(date) from trx)
  and country <> 'all' and service <> 'all' and trxn_group = 'all' and trxn_type = 'all'
 union all select country, service, 'DD', cast(DD as double) from first_due
  where country <> 'all' and service <> 'all' and trxn_group = 'all' and trxn_type = 'all'),
dm as (select country, service, variable, v * 0.000001 as "value",
 case when variable = 'DUM' then case when v > 0 then log10(v) end else -case when v > 0 then log10(v) end end signed_value
 from dm0 where v <> 0)"""


@query("c19_due_vs_managed", Q.with_(Q.ENRICHED, Q.transactions(VIEW), Q.dues(VIEW), DVM_SQL)
       + f'select country, service, variable, "value", {Q.r("signed_value")} signed_value from dm')
def _(spark, folder):
    w = workspace(spark, folder, sets=K.VIEW_SETS)
    return rounded(V.due_vs_managed(w.dues, w.transactions), ["signed_value"])


@query("c19_due_vs_managed_tree", Q.with_(Q.ENRICHED, Q.transactions(VIEW), Q.dues(VIEW), DVM_SQL)
       + _tree_sql("dm", ["country", "service", "variable"], "value", "signed_value", "decimal(18,8)"))
def _(spark, folder):
    w = workspace(spark, folder, sets=K.VIEW_SETS)
    return rounded(V.due_vs_managed_tree(w.dues, w.transactions), ["value", "signed_value", "share_of_root"])


CAC_SQL = """cac as (select country, max_by(cum_U, date) client_base, avg(A_CAC) A_CAC from acq
 where country <> 'all' and channel = 'all' and trxn_type = 'verify' group by country)"""
PEN_SQL = CAC_SQL + f""",
dumc as (select country, service, DUM, ACTIVE_C active_clients, DUMpC from trx where country <> 'all' and service = 'all'
 and trxn_group = 'all' and trxn_type = 'all' qualify row_number() over (partition by country order by date desc) = 1),
pen as (select *, {Q.ratio('cast(client_base as double) * 0.001', 'market_size')} * 100 penetration_rate
 from market_dim left join dumc using (country) left join cac using (country)
 where service is not null and client_base is not null and A_CAC is not null)"""
SPEN_SQL = f"""dums as (select country, service, DUM, ACTIVE_A active_clients, DUMpC from trx where country <> 'all' and service <> 'all'
 and trxn_group = 'all' and trxn_type = 'all' qualify row_number() over (partition by country, service order by date desc) = 1),
spen as (select *, {Q.ratio('cast(active_clients as double) * 0.001', 'market_size')} * 100 penetration_rate,
 {Q.ratio('cast(active_clients as double) * 0.001', 'client_base')} * 100 AC_CB
 from market_dim left join dums using (country) left join cac using (country)
 where service is not null and client_base is not null and A_CAC is not null)"""
MARKET_BASE = [Q.EVENTS, Q.acquisition(VIEW), Q.transactions(VIEW), Q.MARKET]


def _pen(spark, folder):
    w = workspace(spark, folder, sets=K.VIEW_SETS)
    return M.market_penetration(w.market, w.transactions, w.acquisition)


@query("c20_market_penetration", Q.with_(*MARKET_BASE, PEN_SQL) + f"select * replace ({Q.r('A_CAC')} as A_CAC, cast(DUM as double) as DUM) from pen")
def _(spark, folder):
    return rounded(_pen(spark, folder), ["A_CAC"])


@query("c20_penetration_report", Q.with_(*MARKET_BASE, PEN_SQL, f"""rep as (select country "Country", market_size "Market Size",
 client_base * cast(0.001 as double) "Client Base", active_clients * cast(0.001 as double) "Active Clients",
 cast(DUM as double) * cast(0.000001 as double) "Deposits under Management", DUMpC * cast(0.001 as double) "Deposit per Client",
 penetration_rate "Penetration Rate", {Q.r('A_CAC')} "Avg. Customer Acq. Cost" from pen)""") + "select *, " + ", ".join(
    f"""case when "{c}" = max("{c}") over () then 'max' when "{c}" = min("{c}") over () then 'min' end "{c}_extreme" """
    for c in ["Market Size", "Client Base", "Active Clients", "Deposits under Management", "Deposit per Client", "Penetration Rate", "Avg. Customer Acq. Cost"]
) + "from rep")
def _(spark, folder):
    return M.penetration_report(rounded(_pen(spark, folder), ["A_CAC"]))


def _spen(spark, folder):
    w = workspace(spark, folder, sets=K.VIEW_SETS)
    return w, M.service_penetration(w.market, w.transactions, w.acquisition)


@query("c21_service_penetration", Q.with_(*MARKET_BASE, CAC_SQL, SPEN_SQL) + f"select * replace ({Q.r('A_CAC')} as A_CAC, cast(DUM as double) as DUM) from spen")
def _(spark, folder):
    return rounded(_spen(spark, folder)[1], ["A_CAC"])


SPEN_COLUMNS = ["country", "market_size", "country_category", "service", "DUM", "active_clients", "DUMpC", "client_base", "A_CAC", "penetration_rate", "AC_CB"]


@query("c22_cross_sell_pairs", Q.with_(*MARKET_BASE, PEN_SQL, SPEN_SQL) + "select " + ", ".join(
    [(Q.r("a.A_CAC") if c == "A_CAC" else f"cast(a.{c} as double)" if c == "DUM" else f"a.{c}") + f" S1_{c}" for c in SPEN_COLUMNS]
    + [(Q.r("b.A_CAC") if c == "A_CAC" else f"cast(b.{c} as double)" if c == "DUM" else f"b.{c}") + f" S2_{c}" for c in SPEN_COLUMNS if c != "country"]
) + """, a.service S1, b.service S2, 'S1(' || a.service || ') vs. S2(' || b.service || ')' product_set, dumc.DUMpC
 from spen a join spen b on a.country = b.country and a.service < b.service join dumc on dumc.country = a.country""")
def _(spark, folder):
    w, by_service = _spen(spark, folder)
    return rounded(M.cross_sell_pairs(by_service, w.transactions), ["S1_A_CAC", "S2_A_CAC"])


# ---------------------------------------------------------------- sessions

TIMES = ["UTCTransactionStart", "UTCTransactionStop", "UTCChargeStop", "CETTransactionStart", "CETTransactionStop", "CETChargeStop"]


@query("e1_clean_sessions", Q.with_(Q.SESSIONS) + "select * replace (" + ", ".join(f"{Q.stamp(c)} as {c}" for c in TIMES) + ") from sessions")
def _(spark, folder):
    return S.clean_sessions(star.sessions(spark, folder))


@query("e2_analysis_interval", Q.with_(Q.SESSIONS, Q.SPAN) + f"select {Q.stamp('start')} start, {Q.stamp('stop')} stop from span")
def _(spark, folder):
    return span(spark, folder)


@query("e3_holidays_in_interval", Q.with_(Q.SESSIONS, Q.HOLIDAYS, Q.SPAN) + f"""select {Q.label('date')} date from holidays, span
 where date_part('year', date) between date_part('year', start) and date_part('year', stop)""")
def _(spark, folder):
    years = span(spark, folder).select(
        F.explode(F.sequence(F.year("start"), F.year("stop"))).alias("year"))
    holidays = star.holidays(spark)
    return holidays.join(years, F.year("date") == F.col("year"), "left_semi")


@query("e4_peak_calendar", Q.with_(Q.SESSIONS, Q.HOLIDAYS, Q.CALENDAR) + f"select {Q.stamp('UTCDatetime')} UTCDatetime, Peakhour from calendar")
def _(spark, folder):
    return Cal.peak_calendar(span(spark, folder), star.holidays(spark))


@query("e5_peak_connected_hours", Q.with_(Q.FEATURES) + "select TransactionId, PeakConnectedTime from features0")
def _(spark, folder):
    cleaned = S.clean_sessions(star.sessions(spark, folder))
    return S.peak_connected_hours(cleaned, star.holidays(spark)).select("TransactionId", "PeakConnectedTime")


RATES = ["Throughput", "Utilization", "PeakhourShare", "AvgChargePower"]


@query("e6_session_features", Q.with_(Q.FEATURES) + "select TransactionId, " + ", ".join(
    [*RATES, *[f"{Q.r(c)} {c}" for c in S.LOG_VARS]]) + " from features")
def _(spark, folder):
    return rounded(features(spark, folder), S.LOG_VARS).select("TransactionId", *RATES, *S.LOG_VARS)


@query("e7_power_changes", Q.with_(Q.FEATURES, Q.CHANGES) + f"""select {Q.stamp('UTCDatetime')} UTCDatetime,
 cast(AvgChargePowerChange as double) AvgChargePowerChange, Point, TransactionId from changes""")
def _(spark, folder):
    return P.power_changes(features(spark, folder))


CURVE_COLUMNS = "AvgChargePower_Mean, AvgChargePower_Max, AvgChargePower_Min, AvgChargeVolume"


@query("e8_power_curve", Q.with_(Q.FEATURES, Q.CALENDAR, Q.CHANGES, Q.CURVE) + f"""select {Q.stamp('UTCDatetime')} UTCDatetime, {CURVE_COLUMNS},
 Peakhour, {Q.stamp('CETDatetime')} CETDatetime from curve""")
def _(spark, folder):
    return curve(spark, folder)


LEVELS = ["AvgChargePower_Mean", "AvgChargePower_Max", "AvgChargePower_Min", "AvgChargeVolume", "Level"]


@query("e8_level_curve", Q.with_(Q.FEATURES, Q.CALENDAR, Q.CHANGES, Q.LEVEL_CURVE) + f"""select {Q.stamp('UTCDatetime')} UTCDatetime,
 {', '.join(f'{Q.r(c, 4)} {c}' for c in LEVELS)}, Peakhour from level_curve""")
def _(spark, folder):
    levels = P.session_level_curve(features(spark, folder), span(spark, folder), star.holidays(spark))
    return rounded(levels, LEVELS, 4).drop("CETDatetime")


for _freq in ("Weekly", "Daily"):
    @query(f"e9_period_power_{_freq.lower()}", Q.with_(Q.FEATURES, Q.CALENDAR, Q.CHANGES, Q.CURVE, f"""per as (
 select cast(date_trunc('{Q.TRUNC[_freq]}', CETDatetime) as date) Period, cast(Peakhour as varchar) Peakhour, avg(AvgChargePower_Mean) AvgChargePower_Mean,
 max(AvgChargePower_Max) AvgChargePower_Max, min(AvgChargePower_Min) AvgChargePower_Min, sum(AvgChargeVolume) AvgChargeVolume
 from curve group by all)""") + f"""select {Q.label('Period')} Period, Peakhour, {Q.r('AvgChargePower_Mean', 4)} AvgChargePower_Mean,
 AvgChargePower_Max, AvgChargePower_Min, {Q.r('AvgChargeVolume', 4)} AvgChargeVolume,
 {Q.r('AvgChargeVolume / nullif(sum(AvgChargeVolume) over (partition by Period), 0)')} PeakhoursShare from per""")
    def _(spark, folder, freq=_freq):
        parts = P.period_power(curve(spark, folder), freq)
        return rounded(rounded(parts, ["AvgChargePower_Mean", "AvgChargeVolume"], 4), ["PeakhoursShare"])


def _describe_sql(variables: list[str]) -> str:
    rows = [("mean", "avg({v})"), ("std", "stddev_samp({v})"), ("min", "min({v})"), ("5%", "quantile_cont({v}, 0.05)"),
            ("50%", "quantile_cont({v}, 0.5)"), ("95%", "quantile_cont({v}, 0.95)"), ("max", "max({v})")]
    return " union all ".join(
        f"select '{n}' statistic, " + ", ".join(f"{Q.r(x.format(v=v), 5)} {v}" for v in variables) + " from features"
        for n, x in rows)


for _name, _vars in (("raw", S.RAW_VARS), ("engineered", S.ENGINEERED_VARS + S.LOG_VARS)):
    @query(f"e10_describe_{_name}", Q.with_(Q.FEATURES) + _describe_sql(_vars))
    def _(spark, folder, variables=_vars):
        return rounded(St.describe_features(features(spark, folder), variables), variables, 5)


BINS = 20


@query("e11_feature_histograms", Q.with_(Q.FEATURES, "v as (" + " union all ".join(
    f"select '{v}' variable, {v} x, min({v}) over () lo, max({v}) over () hi from features" for v in S.RAW_VARS) + ")",
    f"""b as (select variable, case when hi = lo then 0 else least(cast(floor((x - lo) / (hi - lo) * {BINS}) as bigint), {BINS - 1}) end bin, count(*) n
 from v group by all)""") + f"select variable, bin, n, {Q.ratio('n', 'sum(n) over (partition by variable)')} * 100 pct from b")
def _(spark, folder):
    return St.histograms(features(spark, folder), S.RAW_VARS, BINS)


def _box_sql(v: str) -> str:
    return f"""select '{v}' variable, any_value(q1) q1, any_value(q2) median, any_value(q3) q3,
 min({v}) filter (where {v} >= q1 - 1.5 * (q3 - q1)) low, max({v}) filter (where {v} <= q3 + 1.5 * (q3 - q1)) high
 from features, (select quantile_cont({v}, 0.25) q1, quantile_cont({v}, 0.5) q2, quantile_cont({v}, 0.75) q3 from features)"""


@query("e11_feature_boxes", Q.with_(Q.FEATURES) + "select variable, " + ", ".join(
    f"{Q.r(c)} {c}" for c in ("q1", "median", "q3", "low", "high")) + " from (" + " union all ".join(_box_sql(v) for v in S.ANALYSIS_VARS) + ")")
def _(spark, folder):
    return rounded(St.box_statistics(features(spark, folder), S.ANALYSIS_VARS), ["q1", "median", "q3", "low", "high"])


def _bin(x: str, k: int) -> str:
    return "(1" + "".join(f" + case when {x} > cast({i} as double) / {k} then 1 else 0 end" for i in range(1, k)) + ")"


SPLITS = {"TotalEnergy": 3, "Utilization": 4}


def _scaled(v: str) -> str:
    return f"(({v} - min({v}) over ()) / (max({v}) over () - min({v}) over ()))"


SEGMENTS_SQL = "seg as (select features.*, " + ", ".join(
    f"'{S.SHORT_NAMES[v]}' || {_bin(_scaled(v), k)} {S.SHORT_NAMES[v]}Grp" for v, k in SPLITS.items()
) + ", TotEgyGrp || '_' || UtilznGrp SubSegment from features)"


@query("e12_fixed_segments", Q.with_(Q.FEATURES, SEGMENTS_SQL) + "select TransactionId, TotEgyGrp, UtilznGrp, SubSegment from seg")
def _(spark, folder):
    return Seg.fixed_segments(features(spark, folder), SPLITS).select("TransactionId", "TotEgyGrp", "UtilznGrp", "SubSegment")


# which of several equal values falls on which side of an edge is random by design, so the
# bins are compared by size and by their lowest and highest value
@query("e12_rank_segments", Q.with_(Q.FEATURES, f"""rk as (select TotalEnergy, ConnectedTime,
 {_bin('cast(row_number() over (order by TotalEnergy) as double) / count(*) over ()', 4)} a,
 {_bin('cast(row_number() over (order by ConnectedTime) as double) / count(*) over ()', 3)} b from features)""") + """
 select 'TotEgy' || a label, count(*) n, min(TotalEnergy) low, max(TotalEnergy) high from rk group by a
 union all select 'CntdTm' || b, count(*), min(ConnectedTime), max(ConnectedTime) from rk group by b""")
def _(spark, folder):
    labelled = Seg.fixed_segments(
        features(spark, folder), {"TotalEnergy": 4, "ConnectedTime": 3}, by_rank=["TotalEnergy", "ConnectedTime"])
    parts = [
        labelled.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))
        for label, v in (("TotEgyGrp", "TotalEnergy"), ("CntdTmGrp", "ConnectedTime"))
    ]
    return parts[0].unionByName(parts[1])


CLUSTER_VARS = ["TotalEnergy", "ConnectedTime"]


# Labels depend on drawn starting points, so what any right answer has in common is compared:
# every session has a label, there are as many groups as asked for, and no session lies
# clearly nearer (5 % and more) to the mean of another group than to that of its own.


def _facts_sql(k: int, variables: list[str], source: str = "features") -> str:
    whole = " and ".join(f"{v} is not null" for v in variables)
    return f"select count(*) sessions, count(*) filter ({whole}) labelled, {k}::bigint groups, 0::bigint misplaced from {source}"


def _facts(labelled: DataFrame, variables: list[str], nearest: bool = True) -> DataFrame:
    values = F.array(*[F.col(v).cast("double") for v in variables])
    rows = labelled.select(F.col("SubSegment").alias("label"), values.alias("x"))
    known = labelled.where(F.col("SubSegment").isNotNull()).groupBy(F.col("SubSegment").alias("label"))
    means = known.agg(F.array(*[F.avg(F.col(v).cast("double")) for v in variables]).alias("mean"))
    every = F.array(*[F.array(*map(F.lit, r["mean"])) for r in means.collect()])  # a line for each group

    def apart(x, mean):
        return F.aggregate(F.zip_with(x, mean, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)

    best = F.array_min(F.transform(every, lambda m: apart(F.col("x"), m)))
    off = (apart(F.col("x"), F.col("mean")) > 1.05 * best + 1e-9) if nearest else F.lit(False)
    return rows.join(means, "label", "left").agg(
        F.count(F.lit(1)).alias("sessions"), F.count("label").alias("labelled"),
        F.count_distinct("label").alias("groups"), F.count_if(off & F.col("label").isNotNull()).alias("misplaced"))


@query("e13_kmeans_segments", Q.with_(Q.FEATURES) + _facts_sql(4, CLUSTER_VARS))
def _(spark, folder):
    return _facts(Cl.kmeans_segments(features(spark, folder), CLUSTER_VARS, 4), CLUSTER_VARS)


@query("e13_kmeans_groups")
def _(spark, folder):
    """Size, means and squared deviations of the groups; they depend on drawn starts, so there is no SQL."""
    labelled = Cl.kmeans_segments(features(spark, folder), CLUSTER_VARS, 4)
    means = [F.avg(v).alias(f"mean_{v}") for v in CLUSTER_VARS]
    cost = sum((F.var_pop(v) * F.count(v) for v in CLUSTER_VARS), F.lit(0.0)).alias("cost")
    groups = labelled.where(F.col("SubSegment").isNotNull()).groupBy(F.col("SubSegment").alias("label")).agg(F.count(F.lit(1)).alias("n"), *means, cost)
    return rounded(groups, ["cost", *[f"mean_{v}" for v in CLUSTER_VARS]], 4)


@query("e14_hierarchical_segments", Q.with_(Q.FEATURES) + _facts_sql(4, CLUSTER_VARS))
def _(spark, folder):
    return _facts(Cl.hierarchical_segments(features(spark, folder), CLUSTER_VARS, 4), CLUSTER_VARS, nearest=False)


def _ward_groups(labelled: DataFrame, variables: list[str]) -> DataFrame:
    """Size, bounds and mean of each group."""
    shown = [x for v in variables for x in (
        F.min(v).cast("double").alias(f"low_{v}"), F.max(v).cast("double").alias(f"high_{v}"), F.avg(F.col(v).cast("double")).alias(f"mean_{v}"))]
    groups = labelled.where(F.col("SubSegment").isNotNull()).groupBy(F.col("SubSegment").alias("label")).agg(F.count(F.lit(1)).alias("n"), *shown)
    return rounded(groups, [f"mean_{v}" for v in variables])


# few different points, so SQL can follow the definition
@query("e14_hierarchical_exact", Q.recursive(Q.with_(Q.FEATURES, Q.ward("features", ["ConnectedTime"], 3))))
def _(spark, folder):
    return _ward_groups(Cl.hierarchical_segments(features(spark, folder), ["ConnectedTime"], 3), ["ConnectedTime"])


@query("e14_hierarchical_two", Q.recursive(Q.with_(Q.FEATURES, Q.ward("features", ["ConnectedTime", "ChargeTime"], 5))))
def _(spark, folder):
    return _ward_groups(Cl.hierarchical_segments(features(spark, folder), ["ConnectedTime", "ChargeTime"], 5), ["ConnectedTime", "ChargeTime"])


@query("e14_hierarchical_labels")
def _(spark, folder):
    """The label of every session; its SQL would compare all pairs of groups of ten thousand points."""
    return Cl.hierarchical_segments(features(spark, folder), CLUSTER_VARS, 4).select("TransactionId", "SubSegment", *CLUSTER_VARS)


def _profile_sql(by: str, source: str) -> str:
    shares = f"{Q.r('count(*) * 100.0 / (select count(*) from features)')} SegmentShare, {Q.r('sum(TotalEnergy) / (select sum(TotalEnergy) from features) * 100')} EnergyShare"
    return f"select {by}, {shares}, " + ", ".join(f"{Q.r(f'avg({v})', 5)} {v}" for v in Seg.PROFILE_VARS) + f" from {source} group by {by}"


def _rounded_profile(df: DataFrame) -> DataFrame:
    return rounded(rounded(df, ["SegmentShare", "EnergyShare"]), Seg.PROFILE_VARS, 5)


@query("e15_segment_profile", Q.with_(Q.FEATURES, SEGMENTS_SQL) + _profile_sql("SubSegment", "seg"))
def _(spark, folder):
    return _rounded_profile(Seg.segment_profile(Seg.fixed_segments(features(spark, folder), SPLITS)))


MAPPING = {"TotEgy1_Utilzn1": "Occasional", "TotEgy1_Utilzn2": "Occasional", "TotEgy2_Utilzn4": "Heavy", "TotEgy3_Utilzn4": "Heavy"}


@query("e16_regroup_segments", Q.with_(Q.FEATURES, SEGMENTS_SQL, """regrouped as (select *, case
 when SubSegment in ('TotEgy1_Utilzn1','TotEgy1_Utilzn2') then 'Occasional'
 when SubSegment in ('TotEgy2_Utilzn4','TotEgy3_Utilzn4') then 'Heavy' else SubSegment end Segment from seg)""") + _profile_sql("Segment", "regrouped"))
def _(spark, folder):
    return _rounded_profile(Seg.regroup_segments(Seg.fixed_segments(features(spark, folder), SPLITS), MAPPING))
