"""Building blocks of the checking SQL (DuckDB dialect).

Written the direct way (one window, one cube), without any of the splitting the Spark
operators do."""

from __future__ import annotations

from collections.abc import Sequence

TRUNC = {"Quarterly": "quarter", "Monthly": "month", "Weekly": "week", "Daily": "day"}


def label(c: str) -> str:
    return f"strftime({c}, '%y-%m-%d')"


def stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def r(x: str, places: int = 6) -> str:
    return f"(floor(({x}) * 1e{places} + 0.5) / 1e{places})"


def ratio(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


LEDGER = """l0 as (
 select o_custkey user_id, o_orderkey trxn_id, o_orderdate trxn_datetime,
   case when row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1 then 'open'
        else case o_orderkey % 8 when 0 then 'cross-open' when 1 then 're-open' when 2 then 'cross-open'
             when 3 then 'renew' when 4 then 'top_up' when 5 then 'mature' when 6 then 'break'
             else 'withdraw' end end trxn_type,
   n_name country, 'ch' || (c_custkey % 4) channel,
   case o_orderkey % 3 when 0 then 'Fixed' when 1 then 'Flexible' else 'Locked' end service,
   o_orderdate + to_days(cast(30 + o_orderkey % 360 as int)) acc_maturity_datetime,
   cast(o_totalprice as decimal(18,2)) balance
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
 where c_custkey % 10 < 7),
ledger as (select *, case when trxn_type = 'renew' then 0
   when trxn_type in ('mature','break','withdraw') then -balance else balance end tpv from l0)"""

ENRICHED = LEDGER + """,
l1 as (select *,
   case when trxn_type in ('open','re-open','cross-open','renew','top_up') then 'gain'
        when trxn_type in ('mature','break','withdraw') then 'lose' else trxn_type end trxn_group,
   case when trxn_type = 'renew' then balance else tpv end atpv,
   case when trxn_type in ('open','re-open','cross-open') then 1
        when trxn_type in ('break','mature') then -1 else 0 end account_status
 from ledger),
l2 as (select *, cast(sum(account_status) over (partition by user_id order by trxn_datetime, trxn_id
   rows between unbounded preceding and current row) as bigint) account_count from l1),
enriched as (select *, case when account_count = 0 and account_status = -1 then -1
   when account_count = 1 and account_status = 1 then 1 else 0 end user_status from l2)"""

REGISTRATIONS = """f0 as (
 select c_custkey k, n_name country, c_acctbal,
   coalesce(min(o_orderdate), timestamp '1996-01-01') - to_days(cast(2 + any_value(c_custkey) % 30 as int)) s
 from customer join nation on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey
 group by c_custkey, n_name, c_acctbal),
registrations as (
 select k user_id, s trxn_datetime, s signup_datetime, 'signup' trxn_type, country,
   'ch' || (k % 4) channel, cast(abs(c_acctbal) / 100 as decimal(18,4)) customer_acquisition_cost from f0
 union all
 select k, s + to_hours(cast(1 + k % 40 as int)), s, case when k % 10 = 9 then 'reject' else 'verify' end,
   country, 'ch' || (k % 4), cast(abs(c_acctbal) / 100 as decimal(18,4)) from f0)"""

EVENTS = ENRICHED + ",\n" + REGISTRATIONS + """,
e0 as (
 select user_id, cast(null as bigint) trxn_id, trxn_datetime, trxn_type, country, channel, signup_datetime,
   customer_acquisition_cost from registrations
 union all
 select user_id, trxn_id, trxn_datetime, 'activate', null, null, null, null from ledger where trxn_type = 'open'),
events_ as (select user_id, trxn_id, trxn_datetime, trxn_type,
   last_value(country ignore nulls) over w country, last_value(channel ignore nulls) over w channel,
   last_value(signup_datetime ignore nulls) over w signup_datetime,
   last_value(customer_acquisition_cost ignore nulls) over w customer_acquisition_cost
 from e0 window w as (partition by user_id order by trxn_datetime, coalesce(trxn_id, -1), trxn_type
   rows between unbounded preceding and current row))"""

MARKET = """market as (select n_name country, 1000000 * (1 + cast(n_nationkey as bigint)) population from nation),
market_dim as (select country, cast(population as double) * 0.000001 market_size,
   case when population > 20000000 then 'XBig' when population > 10000000 then 'Big'
        when population > 5000000 then 'Med' else 'Small' end country_category from market)"""

HOLIDAYS = "holidays as (select unnest([date '2024-01-01', date '2024-03-29', date '2024-04-01']) as date)"


def pct(c: str, segment: str, order: str, places: int | None = None) -> str:
    """Percent change to the segment's previous known value."""
    w = f"over (partition by {segment} order by {order} rows between unbounded preceding and"
    now, prev = (f"last_value({c} ignore nulls) {w} {end})" for end in ("current row", "1 preceding"))
    x = f"({ratio(now, prev)} - 1) * 100"
    return f"{x if places is None else r(x, places)} as pct_change_{c}"


def cube_labels(dims: Sequence[str]) -> str:
    return ", ".join(f"case when grouping({d}) = 1 then 'all' else coalesce({d}, 'unknown') end {d}" for d in dims)


STEP = {"Quarterly": "3 month", "Monthly": "1 month", "Weekly": "7 day", "Daily": "1 day"}


def spine(cells: str, name: str, segment: str, freq: str, flows: Sequence[str]) -> str:
    """``name``: ``cells`` with a row for every period from a segment's first to the last of all."""
    filled = ", ".join(f"coalesce({c}, 0) as {c}" for c in flows)
    return f"""{name} as (select * replace ({filled}) from (
  select {segment}, cast(unnest(generate_series(first, (select max(date) from {cells}), interval {STEP[freq]})) as date) date
  from (select {segment}, min(date) first from {cells} group by {segment})) left join {cells} using ({segment}, date))"""


def acquisition(freq: str, dense: bool = False) -> str:
    seg = "country, channel, trxn_type"
    changes = ",\n  ".join(pct(c, seg, "date") for c in ("U", "A_CAC", "A_TAT", "cum_U"))
    return f"""a0 as (select *, date_trunc('{TRUNC[freq]}', signup_datetime) date,
   datediff('second', signup_datetime, trxn_datetime) // 3600 tat from events_),
a1 as (select {cube_labels(['country', 'channel'])}, trxn_type, date, count(user_id) U,
   {ratio('sum(customer_acquisition_cost)', 'count(customer_acquisition_cost)')} A_CAC,
   {ratio('sum(tat)', 'count(tat)')} A_TAT
 from a0 group by trxn_type, date, cube(country, channel)),
{spine('a1', 'ad', seg, freq, ['U']) + ',' if dense else ''}
a2 as (select *, cast(sum(U) over (partition by {seg} order by date rows between unbounded preceding and current row)
   as bigint) cum_U from {'ad' if dense else 'a1'}),
acq as (select *, {changes} from a2)"""


RATES = """r0 as (select country, channel, date,
   coalesce(max(U) filter (where trxn_type = 'signup'), 0) signup,
   coalesce(max(U) filter (where trxn_type = 'verify'), 0) verify,
   coalesce(max(U) filter (where trxn_type = 'reject'), 0) reject,
   coalesce(max(U) filter (where trxn_type = 'activate'), 0) activate
 from acq group by country, channel, date),
r1 as (select *, cast(verify as double) / nullif(signup, 0) CR_vs, cast(activate as double) / nullif(verify, 0) CR_av,
   cast(activate as double) / nullif(signup, 0) CR_as from r0),
rates as (select *, """ + ",\n  ".join(
    pct(c, "country, channel", "date") for c in ("signup", "verify", "reject", "activate", "CR_vs", "CR_av", "CR_as")
) + " from r1)"

DIMS = ["country", "service", "trxn_group", "trxn_type"]
SEG = ", ".join(DIMS)
TRXN_MEASURES = ["U", "T", "TPV", "ATPV", "AU", "AA", "U_ACTN", "U_DCTN", "A_ACTN", "A_DCTN", "DUM", "ACTIVE_C", "ACTIVE_A", "DUMpC"]


def transactions(freq: str, dense: bool = False) -> str:
    w = f"over (partition by {SEG} order by date rows between unbounded preceding and current row)"
    changes = ",\n  ".join(pct(c, SEG, "date", 1) for c in TRXN_MEASURES)
    return f"""t0 as (select *, date_trunc('{TRUNC[freq]}', trxn_datetime) date from enriched),
t1 as (select {cube_labels(DIMS)}, date, count(distinct user_id) U, count(trxn_id) T, sum(tpv) TPV, sum(atpv) ATPV,
   cast(sum(user_status) as bigint) AU, cast(sum(account_status) as bigint) AA,
   count(*) filter (where user_status > 0) U_ACTN, count(*) filter (where user_status < 0) U_DCTN,
   count(*) filter (where account_status > 0) A_ACTN, count(*) filter (where account_status < 0) A_DCTN
 from t0 group by date, cube({SEG})),
{spine('t1', 'td', SEG, freq, TRXN_MEASURES[:10]) + ',' if dense else ''}
t2 as (select *, sum(TPV) {w} DUM, cast(sum(AU) {w} as bigint) ACTIVE_C, cast(sum(AA) {w} as bigint) ACTIVE_A from {'td' if dense else 't1'}),
t3 as (select *, coalesce({ratio('DUM', 'ACTIVE_C')}, 0) DUMpC from t2),
trx as (select *, {changes} from t3)"""


def dues(freq: str) -> str:
    changes = ",\n  ".join(pct(c, SEG, "mdate, date") for c in ("U", "T", "ATPV", "DD"))
    return f"""d0 as (select *, date_trunc('{TRUNC[freq]}', trxn_datetime) date,
   date_trunc('{TRUNC[freq]}', acc_maturity_datetime) mdate from enriched),
d1 as (select {cube_labels(DIMS)}, mdate, date, count(distinct user_id) U, count(distinct trxn_id) T, sum(atpv) ATPV
 from d0 group by mdate, date, cube({SEG})),
d2 as (select *, sum(ATPV) over (partition by mdate, {SEG} order by date
   rows between unbounded preceding and current row) DD from d1),
d3 as (select * from d2 where mdate <> date
 qualify row_number() over (partition by mdate, {SEG} order by date desc) = 1),
due as (select *, {changes} from d3),
first_due as (select * from due where mdate > (select max(date) from due)
 qualify row_number() over (partition by {SEG}, date order by mdate) = 1)"""


def doubles(columns: Sequence[str]) -> str:
    return ", ".join(f"cast({c} as double) {c}" for c in columns)


TRXN_DECIMALS = ["TPV", "ATPV", "DUM"]


def transaction_columns() -> str:
    whole = [c for c in TRXN_MEASURES if c not in TRXN_DECIMALS]
    return ", ".join([*DIMS, f"{label('date')} date", *whole, doubles(TRXN_DECIMALS), *[f"pct_change_{c}" for c in TRXN_MEASURES]])


SESSIONS = """s0 as (
 select event_id TransactionId, ts UTCTransactionStart,
  ts + to_minutes(cast(30 * (1 + event_id % 24) as int)) UTCTransactionStop,
  cast(0.5 as double) * (1 + event_id % 24) ConnectedTime,
  cast(0.5 as double) * (1 + event_id % 24) * (1 + event_id % 5) / cast(4.0 as double) ChargeTime,
  value TotalEnergy, value / (cast(0.5 as double) * (1 + event_id % 24)) MaxPower
 from events),
s1 as (select *, least(UTCTransactionStart + to_seconds(cast(floor(ChargeTime * 3600) as bigint)), UTCTransactionStop) UTCChargeStop
 from s0),
sessions as (select *,
  UTCTransactionStart at time zone 'UTC' at time zone 'CET' CETTransactionStart,
  UTCTransactionStop at time zone 'UTC' at time zone 'CET' CETTransactionStop,
  UTCChargeStop at time zone 'UTC' at time zone 'CET' CETChargeStop,
  (epoch_us(UTCTransactionStop) - epoch_us(UTCTransactionStart)) // 1000000 / cast(3600 as double) ConnectedTimeRC,
  (epoch_us(UTCChargeStop) - epoch_us(UTCTransactionStart)) // 1000000 / cast(3600 as double) ChargeTimeRC
 from s1)"""

# peak time by walking over every day a session touches
FEATURES = SESSIONS + ",\n" + HOLIDAYS + """,
p0 as (select TransactionId, CETTransactionStart a, CETTransactionStop b,
   unnest(generate_series(date_trunc('day', CETTransactionStart), date_trunc('day', CETTransactionStop), interval 1 day)) d
 from sessions),
p1 as (select TransactionId, sum(greatest(0, epoch_us(least(b, d + interval 23 hours)) - epoch_us(greatest(a, d + interval 7 hours)))) us
 from p0 where isodow(d) < 6 and cast(d as date) not in (select date from holidays) group by TransactionId),
features0 as (select sessions.*, cast(coalesce(us, 0) as double) / 1000000 / 3600 PeakConnectedTime
 from sessions left join p1 using (TransactionId)),
features as (select *, """ + ", ".join([
    ratio("TotalEnergy", "ConnectedTimeRC") + " Throughput",
    ratio("ChargeTimeRC", "ConnectedTimeRC") + " * 100 Utilization",
    ratio("PeakConnectedTime", "ConnectedTimeRC") + " * 100 PeakhourShare",
    ratio("TotalEnergy", "ChargeTimeRC") + " AvgChargePower",
    "ln(1 + ConnectedTimeRC) ConnectedTimeLog1p",
    "ln(1 + ChargeTimeRC) ChargeTimeLog1p",
    "ln(1 + PeakConnectedTime) PeakConnectedTimeLog1p",
]) + " from features0)"

SPAN = """span as (select least(min(UTCTransactionStart), min(UTCTransactionStop)) start,
  greatest(max(UTCTransactionStart), max(UTCTransactionStop)) stop from s0)"""

CALENDAR = SPAN + """,
days as (select cast(unnest(generate_series(date_trunc('day', start), date_trunc('day', stop) + interval 60 day, interval 1 day)) as date) d
 from span),
open_days as (select d from days where isodow(d) < 6 and d not in (select date from holidays)),
business as (select d from open_days where d <= (select min(d) from open_days, span where d >= cast(stop as date))),
calendar as (
 select (d + interval 7 hours) at time zone 'CET' at time zone 'UTC' UTCDatetime, 1 Peakhour from business
 union all
 select (d + interval 23 hours) at time zone 'CET' at time zone 'UTC', 0 from business)"""

CHANGES = """changes as (
 select UTCTransactionStart UTCDatetime, cast(AvgChargePower * 1000 as decimal(20,6)) AvgChargePowerChange, 0 Point, TransactionId from features
 union all
 select UTCChargeStop, cast(AvgChargePower * 1000 * -1 as decimal(20,6)), 1, TransactionId from features),
running as (select *, cast(sum(AvgChargePowerChange) over (order by UTCDatetime, Point, TransactionId
   rows between unbounded preceding and current row) as decimal(38,6)) AvgChargePower from changes),
buckets as (select time_bucket(interval 5 minutes, UTCDatetime) UTCDatetime,
   cast(sum(AvgChargePower) as double) / count(*) AvgChargePower_Mean,
   cast(max(AvgChargePower) as double) AvgChargePower_Max, cast(min(AvgChargePower) as double) AvgChargePower_Min,
   cast(sum(AvgChargePower) as double) / count(*) * (cast(5 as double) / 60) AvgChargeVolume
 from running group by 1)"""

CURVE = """points as (select * from buckets full join calendar using (UTCDatetime)),
grid as (select unnest(generate_series(min(UTCDatetime), max(UTCDatetime), interval 5 minutes)) UTCDatetime from points),
curve as (select UTCDatetime, last_value(AvgChargePower_Mean ignore nulls) over w AvgChargePower_Mean,
   last_value(AvgChargePower_Max ignore nulls) over w AvgChargePower_Max,
   last_value(AvgChargePower_Min ignore nulls) over w AvgChargePower_Min,
   last_value(AvgChargeVolume ignore nulls) over w AvgChargeVolume,
   coalesce(last_value(Peakhour ignore nulls) over w, 0) Peakhour,
   UTCDatetime at time zone 'UTC' at time zone 'CET' CETDatetime
 from grid left join points using (UTCDatetime)
 window w as (order by UTCDatetime rows between unbounded preceding and current row))"""


#: Every level weighted by how long it holds, 5 minutes at a time.
LEVEL_CURVE = """moves as (select UTCDatetime moment, cast(sum(AvgChargePowerChange) as decimal(18,6)) delta from changes where UTCDatetime is not null group by 1),
levels as (select moment, cast(sum(delta) over (order by moment) as decimal(18,6)) lv, coalesce(lead(moment) over (order by moment), timestamp '9999-01-01') upto from moves),
level_ends as (select time_bucket(interval 5 minutes, moment) UTCDatetime from moves union select UTCDatetime from calendar),
level_grid as (select unnest(generate_series(min(UTCDatetime), max(UTCDatetime), interval 5 minutes)) UTCDatetime from level_ends),
held as (select g.UTCDatetime, lv, moment, greatest(moment, g.UTCDatetime) a, least(upto, g.UTCDatetime + interval 5 minutes) b
 from level_grid g join levels on moment < g.UTCDatetime + interval 5 minutes and upto > g.UTCDatetime),
level_sums as (select UTCDatetime, cast(sum(cast(lv as decimal(26,6)) * cast(epoch_us(b) - epoch_us(a) as decimal(12,0))) as double) / 300000000 mean,
  max(lv) high, min(lv) low, arg_max(lv, moment) fin, min(moment) <= UTCDatetime covered from held group by UTCDatetime),
level_curve as (select UTCDatetime, coalesce(mean, 0) AvgChargePower_Mean,
   cast(coalesce(case when covered then high else greatest(high, 0) end, 0) as double) AvgChargePower_Max,
   cast(coalesce(case when covered then low else least(low, 0) end, 0) as double) AvgChargePower_Min,
   coalesce(mean, 0) * (cast(5 as double) / 60) AvgChargeVolume, cast(coalesce(fin, 0) as double) Level,
   coalesce(last_value(Peakhour ignore nulls) over (order by UTCDatetime rows between unbounded preceding and current row), 0) Peakhour
 from level_grid left join level_sums using (UTCDatetime) left join calendar using (UTCDatetime))"""


def ward(source: str, variables: list[str], k: int) -> str:
    """Ward's criterion by its definition: of all pairs of groups the one whose union adds least is merged, until
    ``k`` are left. For few different points."""
    means, order = [f"m{i}" for i in range(len(variables))], [f"m{i}" for i in range(len(variables))]
    gap = " + ".join(f"(gs[a].{m} - gs[b].{m}) * (gs[a].{m} - gs[b].{m})" for m in means)
    united = ", ".join(f"{m} := (gs[best.a].{m} * gs[best.a].n + gs[best.b].{m} * gs[best.b].n) / (gs[best.a].n + gs[best.b].n)" for m in means)
    bounds = ", ".join(f"l{i} := least(gs[best.a].l{i}, gs[best.b].l{i}), h{i} := greatest(gs[best.a].h{i}, gs[best.b].h{i})" for i in range(len(variables)))
    first = ", ".join(f"{m} := {v}::double" for m, v in zip(means, variables)) + ", n := n::double, " + ", ".join(f"l{i} := {v}::double, h{i} := {v}::double" for i, v in enumerate(variables))
    shown = ", ".join(f"g.l{i} low_{v}, g.h{i} high_{v}, {r(f'g.m{i}')} mean_{v}" for i, v in enumerate(variables))
    return f"""ward_points as (select {', '.join(variables)}, count(*) n from {source} where {' and '.join(f'{v} is not null' for v in variables)} group by all),
 ward_steps(gs) as (
  select list(struct_pack({first}) order by {', '.join(variables)}) from ward_points
  union all
  select list_sort(list_append(list_filter(gs, lambda x, i: i <> best.a and i <> best.b), struct_pack({united}, n := gs[best.a].n + gs[best.b].n, {bounds})))
  from (select gs, list_min(flatten(list_transform(range(1, len(gs)), lambda a: list_transform(range(a + 1, len(gs) + 1), lambda b:
    struct_pack(cost := ({gap}) * (gs[a].n * gs[b].n / (gs[a].n + gs[b].n)), a := a, b := b))))) best from ward_steps where len(gs) > {k}))
 select 'Grp' || (row_number() over (order by {', '.join('g.' + m for m in order)}) - 1) label, g.n::bigint n, {shown}
 from (select unnest(gs) g from ward_steps where len(gs) <= {k})"""
