"""DuckDB oracle SQL, one statement per query key.

Each statement is independent ANSI-ish SQL over the registered parquet views.
The derived inputs are ``WITH`` clauses written once here and prepended to
the statements that need them, in dependency order.
"""

from __future__ import annotations

from ..constants import AREA_BOXES, CATEGORY_COLUMNS, CLUSTER_CENTRES, DEVICE_CATEGORICAL, PROFILE_COLUMNS

F20 = PROFILE_COLUMNS
_TYPES = ("click", "error", "purchase", "signup", "view")


def _prof_body() -> str:
    sums = []
    for i, f in enumerate(F20):
        t, b = _TYPES[i // 4], i % 4
        sums.append(f"sum(case when event_type = '{t}' and floor(hour(ts) / 6) = {b} "
                    f"then cast(floor(value) as double) else 0e0 end) as {f}")
    return "select user_id, " + ", ".join(sums) + " from events group by user_id"


def _norm_body() -> str:
    n = "sqrt(" + " + ".join(f"{f} * {f}" for f in F20) + ")"
    cols = ", ".join(f"case when n = 0 then {f} else {f} / n end as {f}" for f in F20)
    return f"select user_id, {cols} from (select *, {n} as n from prof) z"


def _thr_body() -> str:
    return "select " + ", ".join(
        f"min({f}) + 4e0 * (max({f}) - min({f})) / 5e0 as t_{f}" for f in F20) + " from norm"


def _tags_body() -> str:
    return "select n.user_id, " + ", ".join(
        f"cast(case when n.{f} > t.t_{f} then 1 else 0 end as int) as {f}" for f in F20
    ) + " from norm n, thr t"


def _wide_body() -> str:
    cols = []
    for h in range(24):
        cols.append(f"coalesce(max(case when hr = {h} then x end), 0e0) as x{h}")
        cols.append(f"coalesce(max(case when hr = {h} then y end), 0e0) as y{h}")
    return "select user_id, dt, " + ", ".join(cols) + " from log group by user_id, dt"


def _long_body() -> str:
    parts = [f"select user_id, dt, {h} as hr, x{h} as x, y{h} as y from wide" for h in range(24)]
    return "select * from (" + " union all ".join(parts) + ") u where x <> 0 and y <> 0"


def _areas_body() -> str:
    rows = ", ".join(f"({a}, {x0}e0, {x1}e0, {y0}e0, {y1}e0)" for a, x0, x1, y0, y1 in AREA_BOXES)
    return f"select * from (values {rows}) v(areaid, x_min, x_max, y_min, y_max)"


def _cent_body() -> str:
    rows = ", ".join(f"({a}, {i}, {x!r}e0, {y!r}e0)"
                     for a, pts in CLUSTER_CENTRES.items() for i, (x, y) in enumerate(pts))
    return f"select * from (values {rows}) v(areaid, clusterid, cx, cy)"


CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "last": ("""
select user_id, period, arg_max(event_type, event_id) as vendor, arg_max(cast(floor(value) as int), event_id) as voice,
       max(event_id) as id
from (select *, cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) * 12 / 30) as int) + 1 as period
      from events) e group by user_id, period""", ()),
    "snap": ("""
select period, user_id, case id % 2 when 0 then '2G' else '3G' end as net,
       case id % 3 when 0 then 'F' when 1 then 'M' else 'U' end as gender,
       ((user_id % 9) * 10) || '-' || ((user_id % 9) * 10 + 9) as age,
       ((voice // 50 % 8) * 50) || '-' || ((voice // 50 % 8) * 50 + 49) as arpu,
       vendor, 'M' || (voice // 100) as dtype,
       ((id % 12) * 500) || '-' || ((id % 12) * 500 + 499) as bytes, voice, cast(id % 100 as int) as sms
from last""", ("last",)),
    "tgt": ("select cast(s_suppkey * 2 as bigint) as user_id from supplier", ()),
    # From the definition: a target's records in order, each beside the one before it.
    "switch": ("""
select period, user_id, vendor as n_vendor, dtype as n_type, old[2] as b_vendor, old[3] as b_type
from (select s.*, lag([cast(period as varchar), vendor, dtype]) over (partition by user_id order by period) as old
      from snap s where user_id in (from tgt)) pairs
where cast(old[1] as int) = period - 1 and vendor <> old[2] and dtype <> old[3]
  and period not in (1, 9)""", ("snap", "tgt")),
    "labeled": ("""
select p.period, t.user_id, d.net, d.gender, d.age, d.arpu, d.vendor, d.dtype, d.bytes, d.voice, d.sms,
       cast((t.user_id, p.period) in (select (user_id, period) from switch) as int) as label
from tgt t, (select distinct period from snap where period not in (1, 9)) p
left join snap d on d.user_id = t.user_id and d.period + 1 = p.period""", ("switch",)),
    "long_values": (" union all ".join(
        f"select distinct '{c}' as \"column\", {c} as value from snap" for c in CATEGORY_COLUMNS), ("snap",)),
    "cat": ("""
select "column", value, cast(row_number() over (partition by "column" order by value) - 1 as int) as idx
from long_values where value is not null""", ("long_values",)),
    "feat": ("select l.period, l.user_id, l.label, " + ", ".join(
        f"coalesce({c}_d.idx, (select count(*) from cat where \"column\" = '{c}'))::int as {c}_idx" for c in DEVICE_CATEGORICAL)
        + ", coalesce(l.voice, -1) as voice, coalesce(l.sms, -1) as sms from labeled l "
        + " ".join(f"left join cat {c}_d on {c}_d.\"column\" = '{c}' and {c}_d.value = l.{c}" for c in DEVICE_CATEGORICAL),
        ("labeled", "cat")),
    "parts": ("""
select *, cast(('0x' || substr(md5(user_id || '-' || period), 1, 8)) as bigint) as h from feat""", ("feat",)),
    "prof": (_prof_body(), ()),
    "norm": (_norm_body(), ("prof",)),
    "thr": (_thr_body(), ("norm",)),
    "target_tags": ("select * from tags where user_id in (from tgt)", ("tags", "tgt")),
    "tags": (_tags_body(), ("thr",)),
    "log": ("""
select user_id, cast(ts as date) as dt, cast(hour(ts) as int) as hr,
       121.4e0 + (max(event_id) % 170) / 1000e0 as x,
       31.17e0 + (max(event_id) % 131) / 1000e0 as y
from events group by user_id, cast(ts as date), hour(ts)""", ()),
    "wide": (_wide_body(), ("log",)),
    "long": (_long_body(), ("wide",)),
    "areas": (_areas_body(), ()),
    "area": ("""
select l.user_id, l.dt, l.hr, l.x, l.y, a.areaid from long l join areas a
  on l.x between a.x_min and a.x_max and l.y between a.y_min and a.y_max""",
             ("long", "areas")),
    "cent": (_cent_body(), ()),
    "clus": ("""
select user_id, dt, hr, x, y, areaid, clusterid from (
  select a.*, c.clusterid,
         row_number() over (partition by a.user_id, a.dt, a.hr
                            order by (a.x - c.cx) * (a.x - c.cx) + (a.y - c.cy) * (a.y - c.cy),
                                     c.clusterid) as rn
  from area a left join cent c on a.areaid = c.areaid) z where rn = 1""", ("area", "cent")),
    "many": ("""
select areaid, cx, cy, cast(row_number() over (partition by areaid order by cx, cy) - 1 as int) as clusterid
from (select distinct areaid, x as cx, y as cy from area where dt = date '2024-01-05') p""", ("area",)),
    "conf": ("select quality as label, toxic as prediction, count(*) as n "
             "from labels group by quality, toxic", ()),
}


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the WITH clauses ``names`` need, dependencies first."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][1]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    head = "with " + ",\n".join(f"{n} as ({CTES[n][0]})" for n in order)
    body = sql.lstrip()
    if body.lower().startswith("with "):
        return head + ",\n" + body[5:]
    return head + "\n" + body


def fcols(prefix: str = "", names=F20) -> str:
    return ", ".join(f"{prefix}{f}" for f in names)
