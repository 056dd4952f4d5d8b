"""Metric queries over scored line items (y = returned) and ordinal order labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from feaslens.catalog.base import SCORED_SQL, query, r, read, rounded, scored_rows
from feaslens.operators import metrics as m


def curve_sql(by: str = "", source: str = "scored", score: str = "score", name: str = "cum") -> str:
    """Tie-grouped cumulative table ``cum(by, score, pos, neg, tp, fp, P, N)``."""
    b = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""{name} as (
  select {b}score, pos, neg, sum(pos) over ({part} order by score desc) as tp, sum(neg) over ({part} order by score desc) as fp,
         sum(pos) over ({part}) as P, sum(neg) over ({part}) as N
  from (select {b}{score} as score, sum(y) as pos, sum(1 - y) as neg from {source}
        where {score} is not null and y is not null group by {b}{score}))"""


BOTH = "max(P) > 0 and max(N) > 0"
AUPRC = f"case when {BOTH} then sum(pos * tp / (tp + fp)) / max(P) end"
AUROC = f"case when {BOTH} then sum(pos * (N - fp + neg / 2.0)) / (max(P)::double * max(N)) end"
BEST_F1 = f"case when {BOTH} then max(2 * (tp / (tp + fp)) * (tp / nullif(P, 0)) / greatest(tp / (tp + fp) + tp / nullif(P, 0), 1e-12)) end"


def strict(level: float) -> str:
    return f"case when {BOTH} then coalesce(max(case when fp / nullif(N, 0) <= {level} + 1e-12 then tp end), 0) / nullif(max(P), 0) end"


def strict_pick(level: float, what: str) -> str:
    """fp or score at the best recall within the level (fewest false positives, then highest score)."""
    ok = f"filter (fp / nullif(N, 0) <= {level} + 1e-12)"
    return f"case when {BOTH} then (max({{'tp': tp, 'nfp': -fp, 'thr': score}}) {ok}).{what} end"


def bundle_sql(by: str, source: str = "scored", score: str = "score", levels=(0.01, 0.05)) -> str:
    """``bundle(by, …)`` with every metric of the bundle."""
    b = f"{by}, " if by else ""
    keys = [k.strip() for k in by.split(",")] if by else []
    group = f"group by {by}" if by else ""
    join = " and ".join(f"a.{k} is not distinct from t.{k}" for k in keys) or "true"
    thr = ", ".join(f"quantile_cont({score}, {1 - v}) filter (y = 0 and {score} is not null) as thr{int(v * 100)}" for v in levels)
    ab = "".join(f"a.{k}, " for k in keys)
    q = []
    for v in levels:
        p = int(v * 100)
        q += [f"case when {BOTH} then coalesce(max(case when score >= thr{p} then tp end), 0) / nullif(max(P), 0) end as recall_at_{p}pct_fpr",
              f"case when {BOTH} then coalesce(max(case when score >= thr{p} then fp end), 0) / nullif(max(N), 0) end as actual_fpr_at_{p}pct",
              f"case when {BOTH} then max(thr{p}) end as threshold_at_{p}pct_fpr",
              f"{strict(v)} as recall_at_{p}pct_fpr_strict",
              f"case when {BOTH} then coalesce(-{strict_pick(v, 'nfp')[len('case when ' + BOTH + ' then '):-len(' end')]}, 0) / nullif(max(N), 0) end as actual_fpr_at_{p}pct_strict",
              f"{strict_pick(v, 'thr')} as threshold_at_{p}pct_fpr_strict"]
    bins = " + ".join(
        f"abs(sum(case when c >= {k} * 0.1::double and {'c < ' + str(k + 1) + ' * 0.1::double' if k < 9 else 'c <= 1'} then c * (pos + neg) - pos else 0 end))" for k in range(10))
    return f"""{curve_sql(by, source, score)},
thr as (select {b}{thr} from {source} {group}),
bundle as (
  select {ab}sum(pos + neg)::bigint as n_eval, sum(pos)::bigint as positive_count, sum(pos) / sum(pos + neg) as positive_rate,
         {AUROC} as auroc, {AUPRC} as auprc,
         case when {BOTH} then sum(pos * (1 - c) * (1 - c) + neg * c * c) / sum(pos + neg) end as brier,
         case when {BOTH} then ({bins}) / sum(pos + neg) end as ece, {BEST_F1} as best_f1, {', '.join(q)}
  from (select *, greatest(0, least(1, score)) as c from cum) a join thr t on {join} {('group by ' + ab.rstrip(', ')) if by else ''})"""


def bundle_cols(levels=(0.01, 0.05)) -> str:
    cols = ["positive_rate", "auroc", "auprc", "brier", "ece", "best_f1"]
    for v in levels:
        p = int(v * 100)
        cols += [f"recall_at_{p}pct_fpr", f"actual_fpr_at_{p}pct", f"threshold_at_{p}pct_fpr", f"recall_at_{p}pct_fpr_strict",
                 f"actual_fpr_at_{p}pct_strict", f"threshold_at_{p}pct_fpr_strict"]
    return "n_eval, positive_count, " + ", ".join(f"{r(c)} as {c}" for c in cols)


@query("M1_confusion", f"""
with {SCORED_SQL}, k as (select l_linestatus, sum((y = 1 and score >= 60000)::int) tp, sum((y = 0 and score >= 60000)::int) fp,
  sum((y = 1 and score < 60000)::int) fn, sum((y = 0 and score < 60000)::int) tn from scored group by 1)
select l_linestatus, tp::bigint tp, fp::bigint fp, fn::bigint fn, tn::bigint tn, {r('tp / (tp + fn)')} recall, {r('tp / (tp + fp)')} as "precision",
       {r('tn / (tn + fp)')} specificity, {r('fp / (fp + tn)')} fpr, {r('(tp + fp) / (tp + fp + fn + tn)')} alert_rate from k""")
def m1(spark, sf):
    return rounded(m.confusion_at(scored_rows(spark, sf), "y", "score", 60000.0, ["l_linestatus"]))


@query("M1_confusion_from_alerts", f"""
with {SCORED_SQL}, k as (select l_linenumber, sum((y = 1 and qty >= 40)::int) tp, sum((y = 0 and qty >= 40)::int) fp,
  sum((y = 1 and qty < 40)::int) fn, sum((y = 0 and qty < 40)::int) tn from scored group by 1)
select l_linenumber, tp::bigint tp, fp::bigint fp, fn::bigint fn, tn::bigint tn, {r('tp / (tp + fn)')} recall, {r('tp / (tp + fp)')} as "precision",
       {r('tn / (tn + fp)')} specificity, {r('fp / (fp + tn)')} fpr, {r('(tp + fp) / (tp + fp + fn + tn)')} alert_rate from k""")
def m1b(spark, sf):
    return rounded(m.confusion_from_alerts(scored_rows(spark, sf).withColumn("a", F.col("qty") >= 40), "y", "a", ["l_linenumber"]))


@query("M2_fpr_threshold", f"""
with {SCORED_SQL}, {bundle_sql('l_linestatus', score='qty')}
select l_linestatus, {r('recall_at_1pct_fpr')} recall_at_1pct_fpr, {r('actual_fpr_at_1pct')} actual_fpr_at_1pct, {r('threshold_at_1pct_fpr')} threshold_at_1pct_fpr,
       {r('recall_at_5pct_fpr')} recall_at_5pct_fpr, {r('actual_fpr_at_5pct')} actual_fpr_at_5pct, {r('threshold_at_5pct_fpr')} threshold_at_5pct_fpr from bundle""")
def m2(spark, sf):
    return rounded(m.fpr_threshold(scored_rows(spark, sf), "y", "qty", (0.01, 0.05), ["l_linestatus"]))


@query("M3_auprc", f"with {SCORED_SQL}, {curve_sql('l_linestatus')} select l_linestatus, {r(AUPRC)} as auprc from cum group by 1")
def m3(spark, sf):
    return rounded(m.auprc(scored_rows(spark, sf), "y", "score", ["l_linestatus"]))


@query("M4_auroc", f"with {SCORED_SQL}, {curve_sql('', score='qty')} select {r(AUROC)} as auroc from cum")
def m4(spark, sf):
    return rounded(m.auroc(scored_rows(spark, sf), "y", "qty"))


@query("M5_recall_strict", f"""
with {SCORED_SQL}, {bundle_sql('l_linenumber', score='qty')}
select l_linenumber, {r('recall_at_5pct_fpr_strict')} recall_at_5pct_fpr_strict, {r('actual_fpr_at_5pct_strict')} actual_fpr_at_5pct_strict,
       {r('threshold_at_5pct_fpr_strict')} threshold_at_5pct_fpr_strict from bundle""")
def m5(spark, sf):
    return rounded(m.recall_at_fpr_strict(scored_rows(spark, sf), "y", "qty", 0.05, ["l_linenumber"]))


@query("M6_brier", f"with {SCORED_SQL} select l_linestatus, {r('avg((y - disc * 8) * (y - disc * 8))')} as brier from scored group by 1")
def m6(spark, sf):
    return rounded(m.brier(scored_rows(spark, sf).withColumn("p", F.col("disc") * 8), "y", "p", ["l_linestatus"]))


@query("M7_ece", f"""
with {SCORED_SQL}, p as (select y, greatest(0, least(1, disc * 10)) as p from scored),
b as (select (select max(k) from range(10) t(k) where k * 0.1::double <= p) as bin, p, y from p)
select {r('sum(abs(d)) / sum(n)')} as ece from (select bin, sum(p) - sum(y) as d, count(*) as n from b group by bin)""")
def m7(spark, sf):
    return rounded(m.ece(scored_rows(spark, sf).withColumn("p", F.col("disc") * 10), "y", "p"))


@query("M8_best_f1", f"with {SCORED_SQL}, {curve_sql('l_linestatus')} select l_linestatus, {r(BEST_F1)} as best_f1 from cum group by 1")
def m8(spark, sf):
    return rounded(m.best_f1(scored_rows(spark, sf), "y", "score", ["l_linestatus"]))


@query("M9_best_f1_grid", f"""
with {SCORED_SQL},
g as (select distinct unnest(quantile_cont(score, [i / 100.0 for i in range(0, 101)])) as t from scored),
e as (select t, (select count(*) from scored where score >= t) as alerts, (select sum(y) from scored where score >= t) as tp, (select sum(y) from scored) as P from g),
f as (select t, tp / alerts as "precision", tp / P as recall, coalesce(2 * (tp / alerts) * (tp / P) / nullif(tp / alerts + tp / P, 0), 0) as f1 from e)
select {r('f1')} as best_f1, {r('"precision"')} as "precision", {r('recall')} as recall, {r('t')} as threshold from f order by f1 desc, t limit 1""")
def m9(spark, sf):
    return rounded(m.best_f1_grid(scored_rows(spark, sf), "y", "score"))


@query("M10_binary_metrics", f"with {SCORED_SQL}, {bundle_sql('l_linestatus, l_linenumber')} select l_linestatus, l_linenumber, {bundle_cols()} from bundle")
def m10(spark, sf):
    return rounded(m.binary_metrics(scored_rows(spark, sf), "y", "score", ["l_linestatus", "l_linenumber"]))


NULLED_SQL = f"{SCORED_SQL}, nulled as (select *, nullif(l_linestatus, 'F') as status, case when l_linenumber < 6 then l_linenumber end as line from scored)"


def nulled_rows(spark, sf):
    """Scored rows whose groups have nulls."""
    return scored_rows(spark, sf).withColumns({"status": F.nullif("l_linestatus", F.lit("F")), "line": F.when(F.col("l_linenumber") < 6, F.col("l_linenumber"))})


@query("M10_null_groups", f"with {NULLED_SQL}, {bundle_sql('status, line', 'nulled')} select status, line, {bundle_cols()} from bundle")
def m10_null(spark, sf):
    return rounded(m.binary_metrics(nulled_rows(spark, sf), "y", "score", ["status", "line"]))


@query("M10_documents", f"""
with d as (select source, quality as y, least(n_chars / 5000.0, 1.5) as score from documents join labels using (doc_id)),
{bundle_sql('source', source='d')} select source, {bundle_cols()} from bundle""")
def m10b(spark, sf):
    d = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select(
        "source", F.col("quality").alias("y"), F.least(F.col("n_chars") / 5000.0, F.lit(1.5)).alias("score"))
    return rounded(m.binary_metrics(d, "y", "score", ["source"]))


PR = "pr as (select l_linestatus, score as threshold, tp / P as recall, tp / (tp + fp) as \"precision\", P / (P + N) as prevalence from cum where P > 0)"


@query("M11_pr_curve", f"""
with {SCORED_SQL}, {curve_sql('l_linestatus', score='qty')}, {PR}
select l_linestatus, threshold, {r('recall')} as recall, {r('"precision"')} as "precision", {r('prevalence')} as prevalence from pr""")
def m11(spark, sf):
    return rounded(m.pr_curve(scored_rows(spark, sf), "y", "qty", ["l_linestatus"]))


@query("M11_thin_curve", f"""
with {SCORED_SQL}, {curve_sql('l_linestatus')}, {PR},
f as (select l_linestatus, max(threshold) as threshold from pr group by l_linestatus, floor(recall / 0.01 + 1e-9)
      union select l_linestatus, min(threshold) from pr group by l_linestatus)
select l_linestatus, threshold, {r('recall')} as recall, {r('"precision"')} as "precision" from pr join f using (l_linestatus, threshold)""")
def m11b(spark, sf):
    pts = m.pr_curve(scored_rows(spark, sf), "y", "score", ["l_linestatus"])
    return rounded(m.thin_curve(pts, ["l_linestatus"]))


@query("M11_mean_pr_curve", f"""
with {SCORED_SQL}, {curve_sql('l_linestatus')}, {PR},
p as (select l_linestatus, recall, max("precision") as pr from pr group by 1, 2),
a as (select l_linestatus, g, g / 100.0 as x from (select distinct l_linestatus from p), range(101) t(g)),
lo as (select a.l_linestatus, a.g, a.x, p.recall r0, p.pr p0 from a asof left join p on a.l_linestatus = p.l_linestatus and a.x >= p.recall),
hi as (select lo.*, p.recall r1, p.pr p1 from lo asof left join p on lo.l_linestatus = p.l_linestatus and lo.x <= p.recall),
v as (select g, x, case when r0 is null then p1 when r1 is null or r1 <= r0 then p0 else p0 + (p1 - p0) * (x - r0) / (r1 - r0) end as v from hi)
select g::int as g, {r('max(x)')} as recall, {r('avg(v)')} as precision_mean, count(v) as n_curves from v group by g""")
def m11c(spark, sf):
    pts = m.pr_curve(scored_rows(spark, sf), "y", "score", ["l_linestatus"])
    return rounded(m.mean_pr_curve(pts, ["l_linestatus"]))


@query("M12_risk_coverage", f"""
with {SCORED_SQL}, p as (select greatest(0, least(1, score / 100000)) as p, y from scored),
t as (select k as slot, k * 0.05::double as threshold from range(21) x(k)),
c as (select slot, threshold, count(*) filter (p >= threshold) as a, coalesce(sum(y) filter (p >= threshold), 0) as ap, count(*) as n, sum(y) as np from t, p group by 1, 2)
select slot::int as slot, {r('threshold')} as threshold, {r('a / n')} as alert_coverage, {r('ap / nullif(a, 0)')} as alert_precision, {r('ap / np')} as alert_recall,
       {r('(n - a) / n')} as safe_coverage, {r('(np - ap) / nullif(n - a, 0)')} as safe_risk from c""")
def m12(spark, sf):
    return rounded(m.risk_coverage(scored_rows(spark, sf).withColumn("p", F.col("score") / 100000), "y", "p", 21))


@query("M13_rank_correlation", f"""
with {SCORED_SQL}, t as (select l_linestatus, score as x, qty as y from scored),
rk as (select *, rank() over (partition by l_linestatus order by x) + (count(*) over (partition by l_linestatus, x) - 1) / 2.0 as rx,
                 rank() over (partition by l_linestatus order by y) + (count(*) over (partition by l_linestatus, y) - 1) / 2.0 as ry from t),
lv as (select distinct l_linestatus, y as lev from t),
row_ as (select t.l_linestatus, lev, x, sum((y = lev)::int) as here, sum(sign(y - lev)) as net from t join lv on t.l_linestatus = lv.l_linestatus group by 1, 2, 3),
s as (select l_linestatus, sum(before * net) as s_net from (
  select l_linestatus, net, sum(here) over (partition by l_linestatus, lev order by x) - here as before from row_) group by 1),
tx as (select l_linestatus, sum(n * (n - 1) / 2.0) t from (select l_linestatus, x, count(*) n from t group by 1, 2) group by 1),
ty as (select l_linestatus, sum(n * (n - 1) / 2.0) t from (select l_linestatus, y, count(*) n from t group by 1, 2) group by 1)
select rk.l_linestatus, count(*) as n, {r('corr(x, y)')} as pearson, {r('corr(rx, ry)')} as spearman,
       {r('max(s_net) / sqrt((count(*) * (count(*) - 1) / 2.0 - max(tx.t)) * (count(*) * (count(*) - 1) / 2.0 - max(ty.t)))')} as kendall_tau_b, '' as note
from rk join s using (l_linestatus) join tx using (l_linestatus) join ty using (l_linestatus) group by 1""")
def m13(spark, sf):
    return rounded(m.rank_correlation(scored_rows(spark, sf), "score", "qty", ["l_linestatus"]))


# Ordinal labels: a from the order priority, b shifted by the status.
ORDINAL_SQL = """ord as (select o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
  least(substr(o_orderpriority, 1, 1)::int - 1, 3) as a,
  greatest(0, least(3, substr(o_orderpriority, 1, 1)::int - 1 + case o_orderstatus when 'O' then 1 when 'P' then -1 else 0 end)) as b from orders)"""


def ordinal_rows(spark, sf):
    p = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    shift = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", -1).otherwise(0)
    return read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice",
                                            F.least(p, F.lit(3)).alias("a"), F.greatest(F.lit(0), F.least(F.lit(3), p + shift)).alias("b"))


def f1_sql(k: int) -> str:
    return f"coalesce(2.0 * sum((a = {k} and b = {k})::int) / nullif(2 * sum((a = {k} and b = {k})::int) + sum((a != {k} and b = {k})::int) + sum((a = {k} and b != {k})::int), 0), 0)"


@query("M14_multiclass", f"""
with {ORDINAL_SQL}, e as (select o_orderstatus, (a = 3)::int as y, o_totalprice as score from ord), {curve_sql('o_orderstatus', 'e')},
auc as (select o_orderstatus, {AUROC} as v from cum group by 1)
select ord.o_orderstatus, count(*) as n, {r('avg((a = b)::int)')} as accuracy, {r('avg(abs(a - b))')} as ordinal_mae,
  {r('(' + ' + '.join(f1_sql(k) for k in range(4)) + ') / (' + ' + '.join(f'(sum((a = {k} or b = {k})::int) > 0)::int' for k in range(4)) + ')')} as macro_f1,
  {r('(' + ' + '.join(f'{f1_sql(k)} * sum((a = {k})::int)' for k in range(4)) + ') / count(*)')} as weighted_f1,
  {r('sum((a = 3 and b = 3)::int) / nullif(sum((a = 3)::int), 0)')} as emergency_recall, {r('sum((a = 3 and b = 3)::int) / nullif(sum((b = 3)::int), 0)')} as emergency_precision,
  {r('max(auc.v)')} as emergency_auc
from ord join auc using (o_orderstatus) group by 1""")
def m14(spark, sf):
    return rounded(m.multiclass_metrics(ordinal_rows(spark, sf), "a", "b", ["o_orderstatus"], score="o_totalprice"))


@query("M15_label_agreement", f"""
with {ORDINAL_SQL}
select o_orderpriority, count(*) as n,
  {r('1 - avg((a - b) * (a - b)) / nullif(avg(a * a) - 2 * avg(a) * avg(b) + avg(b * b), 0)')} as quadratic_kappa,
  {r('coalesce(sum((a >= 2 and b >= 2)::int) / nullif(sum((a >= 2 or b >= 2)::int), 0), 1)')} as severe_jaccard, {r('avg((a != b)::int)')} as changed_fraction,
  sum((a < 2 and b >= 2)::int)::bigint as severe_added, sum((a >= 2 and b < 2)::int)::bigint as severe_removed, {r('avg((a = b)::int)')} as exact_agreement
from ord group by 1""")
def m15(spark, sf):
    return rounded(m.label_agreement(ordinal_rows(spark, sf), "a", "b", ["o_orderpriority"]))


@query("M16_transition_matrix", f"""
with {ORDINAL_SQL}, c as (select x.v as from_label, z.v as to_label from range(4) x(v), range(4) z(v)), k as (select a, b, count(*) n from ord group by 1, 2)
select from_label::int as from_label, to_label::int as to_label, coalesce(n, 0) as n, {r('coalesce(n, 0) / nullif(sum(coalesce(n, 0)) over (partition by from_label), 0)')} as row_fraction
from c left join k on a = from_label and b = to_label""")
def m16(spark, sf):
    return rounded(m.transition_matrix(ordinal_rows(spark, sf), "a", "b"))


@query("M17_label_distribution", f"""
with {ORDINAL_SQL}, c as (select o_orderstatus, v as label from (select distinct o_orderstatus from ord), range(5) x(v)), k as (select o_orderstatus, a as label, count(*) n from ord group by 1, 2)
select o_orderstatus, label::int as label, coalesce(n, 0) as n, {r('coalesce(n, 0) / sum(coalesce(n, 0)) over (partition by o_orderstatus)')} as fraction
from c left join k using (o_orderstatus, label)""")
def m17(spark, sf):
    return rounded(m.label_distribution(ordinal_rows(spark, sf), "a", range(5), ["o_orderstatus"]))


@query("M18_describe", f"""
with {SCORED_SQL}, u as (unpivot (select l_linestatus, score, qty, disc from scored) on score, qty, disc into name "column" value v)
select l_linestatus, "column", count(*) as "count", {r('avg(v)', 4)} as mean, {r('stddev_pop(v)', 4)} as std, {r('min(v)', 4)} as "min", {r('quantile_cont(v, 0.25)', 4)} as p25,
       {r('median(v)', 4)} as p50, {r('quantile_cont(v, 0.75)', 4)} as p75, {r('max(v)', 4)} as "max" from u group by 1, 2""")
def m18(spark, sf):
    return rounded(m.describe(scored_rows(spark, sf), ["score", "qty", "disc"], ["l_linestatus"]), 4)


@query("M18_null_groups", f"""
with {NULLED_SQL}, u as (unpivot (select status, score, qty from nulled) on score, qty into name "column" value v)
select status, "column", count(*) as "count", {r('avg(v)', 4)} as mean, {r('stddev_pop(v)', 4)} as std, {r('min(v)', 4)} as "min", {r('quantile_cont(v, 0.25)', 4)} as p25,
       {r('median(v)', 4)} as p50, {r('quantile_cont(v, 0.75)', 4)} as p75, {r('max(v)', 4)} as "max" from u group by 1, 2""")
def m18_null(spark, sf):
    return rounded(m.describe(nulled_rows(spark, sf), ["score", "qty"], ["status"]), 4)


@query("M19_label_summary", f"""
with {ORDINAL_SQL}
select 'label_count' as section, a::varchar as key, '' as metric, count(*)::double as value from ord group by 2
union all select 'binary_rate', '', 'severe', {r('avg((a >= 2)::int)', 4)} from ord
union all select 'class_mean', a::varchar, 'o_totalprice', {r('avg(o_totalprice)', 4)} from ord group by 2
union all select 'class_median', a::varchar, 'o_totalprice', {r('median(o_totalprice)', 4)} from ord group by 2
union all select 'crosstab', a::varchar, o_orderstatus, count(*)::double from ord group by 2, 3""")
def m19(spark, sf):
    df = ordinal_rows(spark, sf).withColumn("severe", (F.col("a") >= 2).cast("int"))
    return rounded(m.label_summary(df, "a", ["severe"], ["o_totalprice"], "o_orderstatus"), 4)


STRATA = """long as (
  select c.stratum_column, c.stratum, s.score_name, s.score, y from scored,
  lateral (values ('l_linestatus', l_linestatus), ('l_linenumber', l_linenumber::varchar)) c(stratum_column, stratum),
  lateral (values ('score', score), ('qty', qty)) s(score_name, score))"""


@query("M20_stratum_metrics", f"""
with {SCORED_SQL}, {STRATA}, {bundle_sql('stratum_column, stratum, score_name', 'long')}
select stratum_column, stratum, score_name, {bundle_cols()} from bundle""")
def m20(spark, sf):
    return rounded(m.stratum_metrics(scored_rows(spark, sf), "y", ["l_linestatus", "l_linenumber"], ["score", "qty"]))


TAX_SQL = "case when l_returnflag = 'R' and l_tax < 0.04 then 'known_failure' when l_returnflag = 'R' then 'unknown_failure' else 'no_failure' end"


@query("M21_unknown_sensitivity", f"""
with t as (select {TAX_SQL} as tx, l_extendedprice as price, l_quantity as qty from lineitem),
long as (select mode as sensitivity_mode, score_name, score,
  case mode when 'unknown_excluded' then case when tx != 'unknown_failure' then (tx = 'known_failure')::int end when 'unknown_as_positive' then (tx != 'no_failure')::int else (tx = 'known_failure')::int end as y
  from t, (values ('unknown_excluded'), ('unknown_as_positive'), ('unknown_as_negative')) m(mode), lateral (values ('price', price), ('qty', qty)) s(score_name, score)),
ok as (select * from long where y is not null), {bundle_sql('sensitivity_mode, score_name', 'ok', levels=(0.05,))}
select sensitivity_mode, score_name, {bundle_cols((0.05,))} from bundle""")
def m21(spark, sf):
    t = F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.04), "known_failure").when(F.col("l_returnflag") == "R", "unknown_failure").otherwise("no_failure")
    df = read(spark, sf, "lineitem").select(t.alias("tx"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    return rounded(m.unknown_sensitivity(df, "tx", ["price", "qty"]))


@query("M22_overlap_sensitivity", f"""
with {SCORED_SQL}, w as (select *, greatest(l_linenumber - 5, 0) as ov from scored),
long as (select mode as sensitivity_mode, c.stratum_column, c.stratum, 'score' as score_name, score, y
  from w, (values ('a'), ('b')) m(mode), lateral (values ('overall', 'all'), ('l_linestatus', l_linestatus)) c(stratum_column, stratum) where mode = 'a' or ov <= 0),
{bundle_sql('sensitivity_mode, stratum_column, stratum, score_name', 'long', levels=(0.05,))}
select x.stratum_column, x.stratum, x.score_name, x.n_eval as n_all, z.n_eval as n_clean, x.n_eval - z.n_eval as excluded_initial_overlap_samples,
  {r('x.auprc')} as auprc_all, {r('z.auprc')} as auprc_clean, {r('z.auprc - x.auprc')} as auprc_change, {r('z.recall_at_5pct_fpr_strict - x.recall_at_5pct_fpr_strict')} as recall_change
from bundle x join bundle z on x.stratum_column = z.stratum_column and x.stratum = z.stratum and x.sensitivity_mode = 'a' and z.sensitivity_mode = 'b'""")
def m22(spark, sf):
    df = scored_rows(spark, sf).withColumn("initial_overlap_count", F.greatest(F.col("l_linenumber") - 5, F.lit(0)))
    return rounded(m.overlap_sensitivity(df, "y", ["score"], strata=["l_linestatus"]))


@query("M23_fpr_warnings", f"""
with {SCORED_SQL}, {bundle_sql('l_linestatus, l_linenumber', score='qty')},
w as (select l_linestatus, l_linenumber, t.* from bundle, lateral (values (0.01, actual_fpr_at_1pct, recall_at_1pct_fpr, recall_at_1pct_fpr_strict),
  (0.05, actual_fpr_at_5pct, recall_at_5pct_fpr, recall_at_5pct_fpr_strict)) t(target_fpr, actual_fpr, legacy_recall, strict_recall))
select l_linestatus, l_linenumber, target_fpr::double as target_fpr, {r('actual_fpr')} as actual_fpr, {r('legacy_recall')} as legacy_recall, {r('strict_recall')} as strict_recall
from w where actual_fpr > target_fpr + 1e-12""")
def m23(spark, sf):
    keys = ["l_linestatus", "l_linenumber"]
    return rounded(m.fpr_warnings(m.binary_metrics(scored_rows(spark, sf), "y", "qty", keys), keys))
