"""Oracle SQL per query key (DuckDB dialect, the parquet tables as views).

The forest keys state what SQL can know of a forest: which rows it scores,
the sizes of folds, and the matrix on a label that it must get exactly.
"""

from __future__ import annotations

from ..constants import CATEGORY_COLUMNS, DEVICE_BEHAVIOUR, PROFILE_COLUMNS
from .oracle import fcols, with_ctes

ORACLE: dict[str, str] = {}
F20 = PROFILE_COLUMNS


def oracle(name: str, sql: str, *ctes: str) -> None:
    ORACLE[name] = with_ctes(sql, *ctes)


# --- device -----------------------------------------------------------------
oracle("period_snapshot", "select * from snap", "snap")
oracle("target_list", "select * from tgt", "tgt")
oracle("device_switch", "select * from switch", "switch")
oracle("switch_one_period", "select * from switch where period = 12", "switch")
oracle("switch_counts", "select period, count(*) as n from switch group by period", "switch")
oracle("label_prev_period", "select * from labeled", "labeled")
oracle("label_one_period", "select * from labeled where period = 12", "labeled")
oracle("month_switch", "select * from switch where period = 12", "switch")
oracle("month_label", "select * from labeled where period = 12", "labeled")
oracle("target_scoring_rows", "select s.* from tgt t join snap s using (user_id) where s.period = 12", "tgt", "snap")
oracle("label_counts", "select label, count(*) as n from labeled group by label", "labeled")

# --- features ---------------------------------------------------------------
oracle("category_distinct", "select * from long_values", "long_values")
oracle("category_index", "select * from cat", "cat")
oracle("feature_rows", "select * from feat", "feat")

# --- profile ----------------------------------------------------------------
oracle("profile_sum", "select * from prof", "prof")
oracle("l2_normalize", "select * from norm", "norm")
oracle("tag_thresholds", "select * from thr", "thr")
_hist_parts = []
for _f in F20:
    _hist_parts.append(f"""
select '{_f}' as feature, b.bucket,
       s.mn_{_f} + cast(b.bucket as double) * (s.mx_{_f} - s.mn_{_f}) / 5e0 as lo,
       count(n.user_id) as n
from (select unnest(range(5)) as bucket) b cross join s
left join norm n on (case when s.mx_{_f} = s.mn_{_f} then 0
                          else least(cast(floor((n.{_f} - s.mn_{_f}) / (s.mx_{_f} - s.mn_{_f}) * 5e0)
                                          as int), 4) end) = b.bucket
group by b.bucket, s.mn_{_f}, s.mx_{_f}""")
_stats = ", ".join(f"min({f}) as mn_{f}, max({f}) as mx_{f}" for f in F20)
oracle("feature_histogram",
       f"with s as (select {_stats} from norm)\n"
       "select feature, cast(bucket as int) as bucket, lo, n from ("
       + " union all ".join(_hist_parts) + ") h", "norm")
oracle("tag_flags", "select * from tags", "tags")
oracle("tag_sum", "select user_id, " + ", ".join(f"cast(sum({f}) as bigint) as {f}" for f in F20)
       + " from (select * from tags union all select * from tags) t group by user_id", "tags")
oracle("profile_as_array", "select user_id, " + ", ".join(f"{f} as arr_{i}" for i, f in enumerate(F20))
       + ", 20 as arr_size from prof", "prof")

# --- spatial ----------------------------------------------------------------
oracle("wide_scan_fill", "select * from wide", "wide")
oracle("unpivot_hours", "select * from long", "long")
oracle("area_assign", "select * from area", "area")
oracle("nearest_centre", "select * from clus", "clus")
oracle("nearest_of_many", """
select a.user_id, a.dt, a.hr, a.x, a.y, a.areaid, (
    select arg_min(m.clusterid, [(a.x - m.cx) * (a.x - m.cx) + (a.y - m.cy) * (a.y - m.cy), m.clusterid])
    from many m where m.areaid = a.areaid) as clusterid
from area a""", "area", "many")
oracle("cluster_centres", """
select c.areaid, c.clusterid, c.cx, c.cy, cast(coalesce(m.n, 0) as bigint) as n
from cent c left join (select areaid, clusterid, count(*) as n from clus
                       group by areaid, clusterid) m
  on c.areaid = m.areaid and c.clusterid = m.clusterid""", "clus", "cent")
_report = f"""
select s.user_id, s.dt, s.hr, s.x, s.y, s.areaid, s.clusterid,
       u.user_id as tag_user_id, {fcols('u.')}
from clus s left join target_tags u on s.user_id = u.user_id"""
oracle("located_with_tags", _report, "clus", "target_tags")
oracle("sql_report_filter", _report + """
where s.dt = date '2024-01-17' and s.hr = 12 and s.areaid = 0 and s.clusterid = 5""", "clus", "target_tags")
oracle("multi_path_union", "select * from clus", "clus")
oracle("where_date", "select * from long where dt = date '2024-01-05'", "long")
oracle("row_count", "select count(*) as n from long", "long")
oracle("top_rows", "select * from clus order by user_id, dt, hr limit 10", "clus")

# --- quality ----------------------------------------------------------------
oracle("distinct_users", "select count(distinct user_id) as n from events")
_period = "cast(floor(date_diff('day', date '2024-01-01', cast(ts as date)) * 12 / 30) as int) + 1"
oracle("distinct_by_period", f"""
select {_period} as period, count(distinct user_id) as n, true as within_bound from events group by 1
union all select 0, count(distinct user_id), true from events""")
oracle("column_profile", """
select 'value' as "column", count(v) as n, round(avg(v), 6) as mean,
       round(stddev_pop(v), 6) as stdev, max(v) as max, min(v) as min,
       count(*) filter (where v is null or isnan(v)) as nan
from (select cast(floor(value) as double) as v from events) e""")
_model = ("case when event_id % 7 = 0 then concat_ws(',', event_type, upper(event_type), 'X5') "
          "else event_type end")
_fields = ", ".join(f"cast({e} as varchar)" for e in [
    "event_id", "user_id", "event_type", "cast(floor(value / 100) as int)",
    "cast(floor(value) as int)", "cast(event_id % 100 as int)", _model, "hour(ts)", "day(ts)",
    "length(props)", "event_id % 2"])
_lines = f"""select '"' || concat_ws('","', {_fields}) || '"' as line from events"""
_fc = []
for _sep, _lit in ((",", "','"), ('","', "'\",\"'")):
    _fc.append(f"""
select {_lit} as sep, count(c) as n, round(avg(c), 6) as mean, round(stddev_pop(c), 6) as stdev,
       max(c) as max, min(c) as min, count(*) filter (where c is null or isnan(c)) as nan
from (select cast(len(string_split(line, {_lit})) as double) as c from lines) t""")
oracle("field_count_profile", f"with lines as ({_lines})\n" + " union all ".join(_fc))

# --- model ------------------------------------------------------------------
_hash8 = "cast(('0x' || substr(md5(cast({k} as varchar)), 1, 8)) as bigint)"
oracle("kfold_assign", f"select event_id, cast({_hash8.format(k='event_id')} % 3 as int) as fold "
       "from events")
oracle("holdout_split", f"""
select case when {_hash8.format(k='event_id')} % 9 < 8 then 'train' else 'holdout' end as split,
       count(*) as n from events group by 1""")
_confusion = """
select label, cast(sum(case when prediction = 0 then n else 0 end) as bigint) as pred_0,
       cast(sum(case when prediction = 1 then n else 0 end) as bigint) as pred_1
from conf group by label"""
oracle("confusion_matrix", _confusion, "conf")
oracle("classification_metrics", f"""
with cm as ({_confusion}),
q as (select sum(case when label = 1 then cast(pred_1 as double) else 0e0 end) as tp,
             sum(case when label = 0 then cast(pred_1 as double) else 0e0 end) as fp,
             sum(case when label = 1 then cast(pred_0 as double) else 0e0 end) as fn,
             sum(case when label = 0 then cast(pred_0 as double) else 0e0 end) as tn from cm),
m as (select *, tp / nullif(tp + fp, 0) as p, tp / nullif(tp + fn, 0) as r from q)
select (tp + tn) / nullif(tp + fp + fn + tn, 0) as accuracy, p as precision_1, r as recall_1,
       2e0 * p * r / nullif(p + r, 0) as f1_1,
       greatest(tp + fn, fp + tn) / nullif(tp + fp + fn + tn, 0) as majority_share
from m""", "conf")

# Forests: what SQL can state about them.
_decided = "case when net_idx = 1 or sms >= 50 then 1 else 0 end"
oracle("rf_fit_predict", f"""
select 'change' as kind, label, count(*) as n, cast(null as bigint) as n_right from parts where h % 9 = 8 group by label
union all select 'decided', {_decided}, count(*), count(*) from parts where h % 9 = 8 group by 2""", "parts")
oracle("rf_separable", f"""
select c.label, cast(count(*) filter (p.truth = c.label and c.label = 0) as bigint) as pred_0,
       cast(count(*) filter (p.truth = c.label and c.label = 1) as bigint) as pred_1
from (values (0), (1)) c(label)
left join (select {_decided} as truth from parts where h % 9 = 8) p on true
group by c.label""", "parts")
oracle("rf_grid_cv", """
select 32 as "numTrees", g.depth as "maxDepth", 20 as "maxBins", 'entropy' as impurity, cast(f.fold as int) as fold,
       count(*) filter (p.h % 3 <> f.fold) as n_train, count(*) filter (p.h % 3 = f.fold) as n_valid,
       1e0 as accuracy, 1e0 as f_measure, 1e0 as precision, 1e0 as recall
from (values (20), (30)) g(depth), range(3) f(fold), parts p where p.h % 9 < 8 group by g.depth, f.fold""", "parts")
oracle("predict_target", "select t.user_id, case when s.net = '3G' or s.sms >= 50 then 1 else 0 end as prediction "
       "from tgt t join snap s using (user_id) where s.period = 12", "tgt", "snap")
_handset = "concat_ws('/', dtype, bytes, age)"
_first_seen = " union all ".join(
    f"select '{c}' as \"column\", {e} as value, min(period) > 1 as later from snap group by {e}"
    for c, e in [*((c, c) for c in CATEGORY_COLUMNS), ("handset", _handset)])
oracle("dictionary_growth", f"""
select "column", value, cast(row_number() over (partition by "column" order by later, value) - 1 as int) as idx
from ({_first_seen}) v where value is not null""", "snap")

# --- sources and sinks --------------------------------------------------------
oracle("csv_roundtrip", "select * replace (concat_ws(',', dtype, upper(vendor)) as dtype) from snap", "snap")
oracle("reject_report", """
select field, token, count(*) as n from (
  select 'voice' as field, 'x' || cast(floor(value) as bigint) as token from events where event_id % 97 = 0
  union all select 'sms', 'none' from events where event_id % 89 = 0) b group by field, token
union all select 'kept', cast(sum(cast(floor(value) as bigint) + case when event_id % 7 = 0 then 0 else event_id % 100 end) as varchar), count(*)
from events where event_id % 97 <> 0 and event_id % 89 <> 0""")
oracle("profile_project_fill", "select * from prof", "prof")
oracle("tag_roundtrip", "select * from tags", "tags")

# --- scalar functions -------------------------------------------------------
def _line(*cols: str) -> str:
    return " || ',' || ".join(f"coalesce(cast({c} as varchar), '')" for c in cols)


oracle("record_to_line", f"""
select 'target' as kind, cast(user_id as varchar) as line from tgt
union all select 'device', {_line('s.period', 't.user_id', *['s.' + c for c in DEVICE_BEHAVIOUR])}
  from tgt t left join snap s on s.user_id = t.user_id and s.period = 12
union all select 'usage', {_line('user_id', *[f'cast({f} as bigint)' for f in F20])} from prof
union all select 'located', {_line('user_id', 'dt', 'hr', 'areaid', 'clusterid')} from clus
union all select 'tag', {_line('user_id', *F20)} from tags""", "tgt", "snap", "clus", "tags")
oracle("hex_to_decimal", """
select cast(cast('0x' || md5(cast(user_id as varchar)) as uhugeint) as varchar) as user_dec,
       dt, hr, x, y, areaid, clusterid from clus""", "clus")
oracle("bytes_to_hex", """
select event_id, lower(hex(event_type)) as hex,
       rtrim(regexp_replace(lower(hex(event_type)), '(..)', '\\1:', 'g'), ':') as hex_sep
from events""")
oracle("strip_quotes", """
select event_id, '"' || event_type || '"' as quoted, event_type as stripped,
       contains('"' || event_type || '"', '"') as quoted_has_quote,
       contains(event_type, '"') as stripped_has_quote
from events""")
oracle("zero_pad", "select user_id, period, printf('%02d', period) as period_str, "
       "'device' || printf('%02d', period) as table_name from snap", "snap")
