"""DuckDB SQL for the registered queries: the same stand-ins and metrics, written a second time."""

from __future__ import annotations

from labelq.plans.standin import HIERARCHY, MARKERS, SPATIAL_K


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_VOTE = "case when (o_orderkey * 7 + {k}) % 8 = 0 then '1-URGENT' else o_orderpriority end as m{k}"

SECTION = f"""
cells as (select o_orderkey as cell_id, o_orderpriority as label, n_regionkey as sample, o_totalprice / 1000 as cell_area, {", ".join(_VOTE.format(k=k) for k in (1, 2, 3))}
    from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey),
genes as (select distinct p_brand as gene, cast(substr(p_brand, 7) as integer) as gene_idx, p_brand in ('Brand#24', 'Brand#25') as control from part),
counts as (select l_orderkey as cell_id, p_brand as gene, sum(l_quantity) as value from lineitem join part on l_partkey = p_partkey group by all),
markers as (select * from (values {_values([(k, g) for k, gs in MARKERS.items() for g in gs])}) t(set_name, gene)),
panel as (select * from markers where gene in (select gene from genes)),
loads as (select cell_id, set_name, sum(value) as load from counts join panel using (gene) group by all)"""

TABLE = f"""
hierarchy as (select * from (values {_values(HIERARCHY.items())}) t(leaf, parent)),
pairs as (select o_orderpriority as truth, {_VOTE.format(k=1).replace("m1", "pred")} from orders),
c as (select truth, pred, count(*) as n from pairs group by all),
m as (select *, sum(n) over (partition by truth) as a, sum(n) over (partition by pred) as b, sum(n) over () as t from c),
classes as (select label, cast(sum(support) as bigint) as support, cast(sum(predicted) as bigint) as predicted, cast(sum(hits) as bigint) as hits from (
    select truth as label, n as support, 0 as predicted, case when truth = pred then n else 0 end as hits from c union all select pred, 0, n, 0 from c) group by label),
per_class as (select *, coalesce(hits / nullif(cast(predicted as double), 0), 0) as precision, coalesce(hits / nullif(cast(support as double), 0), 0) as recall,
    coalesce(2 * hits / nullif(cast(support + predicted as double), 0), 0) as f1 from classes),
info as (select sum(n / cast(t as double) * ln(n * cast(t as double) / (cast(a as double) * b))) as mi, -sum(n / cast(t as double) * ln(cast(a as double) / t)) as hu,
    -sum(n / cast(t as double) * ln(cast(b as double) / t)) as hv from m)"""

_ARI = """(select (s - e) / ((a + b) / 2 - e) as ari from (select sum(n * (n - 1) / 2.0::double) as s, sum(n * (a - 1) / 2.0::double) as a, sum(n * (b - 1) / 2.0::double) as b,
    sum(n * (a - 1) / 2.0::double) * sum(n * (b - 1) / 2.0::double) / (max(t) * (max(t) - 1) / 2.0::double) as e from m))"""
_NMI = "(select mi / ((hu + hv) / 2) as nmi from info)"
_AMI = """(select (mi - emi) / ((hu + hv) / 2 - emi) as ami from info, (select sum(k / cast(t as double) * ln(cast(t as double) * k / (cast(a as double) * b))
    * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(t - a - b + k + 1))) as emi
    from (select cast(a as double) as a, cast(b as double) as b, cast(t as double) as t, unnest(range(cast(greatest(1, a + b - t) as bigint), cast(least(a, b) as bigint) + 1)) as k
        from (select distinct truth, a, t from m), (select distinct pred, b from m))))"""
_KAPPA = "(select (h / t - e / (t * t)) / (1 - e / (t * t)) as kappa from (select cast(sum(hits) as double) as h, cast(sum(support) as double) as t, sum(cast(support as double) * predicted) as e from classes))"
_ECS = "(select sum(cast(n as double) * n / greatest(a, b)) / sum(n) as ecs from m)"
_BLOCK = """(select sum(hits) / cast(sum(support) as double) as accuracy, avg(recall) filter (support > 0) as balanced_accuracy, avg(f1) as macro_f1,
    sum(f1 * support) / sum(support) as weighted_f1, avg(precision) as precision_macro, avg(recall) as recall_macro from per_class)"""
_SHARES = "(select label, support / cast(sum(support) over () as double) as q, predicted / cast(sum(predicted) over () as double) as p from classes)"
_COR = "(sum({x} * {y}) - sum({x}) * sum({y}) / count(*)) / sqrt((sum({x} * {x}) - sum({x}) * sum({x}) / count(*)) * (sum({y} * {y}) - sum({y}) * sum({y}) / count(*)))"
_PLOGP = "sum(case when {x} > 0 then {x} * ln({x}) else 0 end)"


def _js(x: str, y: str) -> str:
    return f"greatest(({_PLOGP.format(x=x)} + {_PLOGP.format(x=y)}) / 2 - {_PLOGP.format(x=f'(({x} + {y}) / 2)')}, 0)"


def _r(*cols: str) -> str:
    return ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in cols)


def _section(body: str) -> str:
    return f"with {SECTION} {body}"


def _scores(body: str) -> str:
    return f"with {TABLE} {body}"


_BLOCK_COLS = ("accuracy", "balanced_accuracy", "macro_f1", "weighted_f1", "precision_macro", "recall_macro")

PROPS = """
g as (select l_suppkey as spot_id, p_type as type, sum(l_quantity) as q, count(*) as n from lineitem join part on l_partkey = p_partkey group by all),
props as (select spot_id, type, coalesce(q, 0) / sum(q) over (partition by spot_id) as p_true, coalesce(n, 0) / cast(sum(n) over (partition by spot_id) as double) as p_pred
    from (select distinct spot_id from g) cross join (select distinct type from g) left join g using (spot_id, type)),
types as (select type, sum((p_true - p_pred) ** 2) as sse, count(*) * var_pop(p_true) as sst, """ + _COR.format(x="p_true", y="p_pred") + """ as r from props group by type),
by_type as (select *, p_true / sum(p_true) over (partition by type) as x, p_pred / sum(p_pred) over (partition by type) as y from props)"""

FIDELITY = """,
s as (select set_name, cell_id, label = set_name as own, coalesce(load, 0) as load from cells cross join (select distinct set_name from panel) left join loads using (cell_id, set_name)),
ranked as (select *, rank() over (partition by set_name order by load) + (count(*) over (partition by set_name, load) - 1) / 2.0::double as r from s),
fid as (select set_name, count(*) filter (own) as n,
    (sum(r) filter (own) - count(*) filter (own) * (count(*) filter (own) + 1) / 2.0::double) / (count(*) filter (own) * cast(count(*) filter (not own) as double)) as auc,
    (avg(load) filter (own) - avg(load) filter (not own)) / sqrt(((count(*) filter (own) - 1) * var_samp(load) filter (own) + (count(*) filter (not own) - 1) * var_samp(load) filter (not own)) / (count(*) - 2)) as cohens_d
    from ranked group by set_name)"""

CONFIDENCE = """,
sizes as (select set_name, count(*) as size from panel group by all),
v as (select cell_id, set_name, coalesce(load, 0) / size as x from cells cross join sizes left join loads using (cell_id, set_name)),
o as (select *, row_number() over (partition by cell_id order by x desc) as k, max(x) over (partition by cell_id) as top from v),
pr as (select *, exp(x - top) / sum(exp(x - top)) over (partition by cell_id) as p from o),
conf as (select cell_id, max(x) filter (k = 1) - max(x) filter (k = 2) as marker_margin, -sum(p * ln(greatest(p, 1e-12))) / ln(cast(count(*) as double)) as marker_entropy from pr group by cell_id)"""

DETECT = """,
det as (select distinct cell_id, set_name from counts join panel using (gene) where value > 0),
per as (select cell_id, count(det.set_name) as n_sets from cells left join det using (cell_id) group by cell_id)"""

PMP = """,
times as (select set_name, gene, count(*) as times from panel group by all),
pm as (select cells.cell_id, label, sum(value) as whole, sum(value * coalesce(times, 0)) as own from counts join (select distinct gene from panel) using (gene) join cells using (cell_id)
    left join times on times.set_name = label and times.gene = counts.gene group by all),
pmp as (select cell_id, cells.label, case when cells.label in (select set_name from panel) and whole > 0 then least(greatest(own / whole, 0), 1) end as pmp from cells left join pm using (cell_id))"""

SIGNAL = """,
x as (select counts.*, control from counts join genes using (gene)),
sz as (select count(*) filter (not control) as g, count(*) filter (control) as k from genes),
t as (select cell_id, cell_area, coalesce(sum(value), 0) as total, count(*) filter (value > 0) as n_detected, coalesce(sum(value * ln(value)) filter (value > 0), 0) as xl,
    coalesce(sum(value) filter (not control), 0) as gs, coalesce(sum(value) filter (control), 0) as cs, coalesce(max(value) filter (not control), 0) as gm from cells left join x using (cell_id) group by all),
sig as (select cell_id, total, n_detected, 1 - n_detected / cast(g + k as double) as sparsity,
    least(greatest((ln(case when total > 0 then total else 1 end) - xl / case when total > 0 then total else 1 end) / case when n_detected > 1 then ln(cast(n_detected as double)) else 1 end, 0), 1) as detection_entropy,
    log2((gs / g + 1e-9) / (cs / k + 1e-9)) as mean_signal_ratio, log2((gm + 1e-9) / (cs / k + 1e-9)) as max_signal_ratio, case when cell_area > 0 then total / cell_area end as tx_per_area from t, sz),
spars as (select 1 - (select count(*) from counts) / cast((select count(*) from cells) * (select count(*) from genes) as double) as zero_fraction, quantile_cont(sparsity, 0.5) as median_cell_sparsity from sig),
entro as (select quantile_cont(detection_entropy, 0.5) as median_detection_entropy, avg(case when detection_entropy < 0.1 then 1.0::double else 0 end) as frac_cells_single_gene_dominated from sig),
snr as (select quantile_cont(mean_signal_ratio, 0.5) as median_mean_signal_ratio, quantile_cont(max_signal_ratio, 0.5) as median_max_signal_ratio, avg(case when mean_signal_ratio <= 0 then 1.0::double else 0 end) as frac_cells_signal_below_control from sig),
dens as (select quantile_cont(tx_per_area, 0.5) as median_tx_per_area from sig)"""

POINTS = """
p as (select vec_id as id, cast(label as varchar) as label, cast(embedding as double[]) as v from embeddings),
cen0 as (select label, i, avg(v[i]) as x from (select label, v, unnest(range(1, len(v) + 1)) as i from p) group by all),
cen as (select label, list(x order by i) as c from cen0 group by label),
own as (select p.*, c, list_distance(v, c) as d from p join cen using (label)),
dist as (select a.id, a.label, b.id as nbr, b.label as other, round(list_distance(a.v, b.v), 12) as d from p a, p b where a.id <> b.id),
sums as (select id, label, other, avg(d) as m, sum(d) as s, count(*) as n from dist group by all),
sil as (select id, label, max(m) filter (other = label) as a, min(m) filter (other <> label) as b, sum(s) filter (other <> label) / sum(n) filter (other <> label) as r from sums group by all)"""

SPATIAL = f"""
p as (select vec_id as cell_id, cast(label as varchar) as label, cast(embedding as double[]) as v from embeddings),
near as (select a.cell_id as src, b.cell_id as dst, row_number() over (partition by a.cell_id order by round(list_distance(a.v[1:2], b.v[1:2]), 12), b.cell_id) as k from p a, p b where a.cell_id <> b.cell_id),
edges as (select src, dst, 1.0::double as weight from near where k <= {SPATIAL_K}),
ends as (select src, dst, a.label as a, b.label as b from edges join p a on a.cell_id = src join p b on b.cell_id = dst),
coh as (select cell_id, avg(case when a = b then 1.0::double else 0 end) filter (a is not null) as spatial_coherence from p left join ends on src = cell_id group by cell_id),
lab as (select label, cast(count(*) as double) as k from p group by label),
nh as (select x.label as a, y.label as b, count(src) as n from lab x cross join lab y left join ends on ends.a = x.label and ends.b = y.label group by all),
val as (select cell_id, i, greatest(v[i], 0) as x from (select cell_id, v, unnest(range(3, 65)) as i from p)),
z as (select cell_id, i, x - avg(x) over (partition by i) as z from val),
mor as (select 'd' || cast(i - 1 as varchar) as gene, i - 1 >= 58 as control, num / den as moran from (select a.i, sum(a.z * b.z) / {SPATIAL_K} as num from edges join z a on a.cell_id = src join z b on b.cell_id = dst and b.i = a.i group by a.i) join (select i, sum(z * z) as den from z group by i) using (i))"""

_MORAN = """(select g.m as median_gene_moran, c.m as median_control_moran, g.n as n_genes, c.n as n_controls, g.m - c.m as separation,
    (select avg(case when moran > c.p then 1.0::double else 0 end) from mor where not control) as frac_genes_above_control_p95
    from (select quantile_cont(moran, 0.5) as m, count(*) as n from mor where not control) g, (select quantile_cont(moran, 0.5) as m, quantile_cont(moran, 0.95) as p, count(*) as n from mor where control) c)"""


def _conformal(conditional: bool) -> str:
    hat = "least(cast(ceil((n + 1) * (1.0::double - 0.1::double)) as bigint) + 1, n)"
    own = f"left join (select class, max(score) filter (k = {hat}) as own, max(n) as members from (select *, row_number() over (partition by class order by score) as k, count(*) over (partition by class) as n from cal) group by class having max(n) >= 10) using (class)"
    return f"""with {POINTS},
pr as (select id as cell_id, p.label, cen.label as class, exp(-round(list_distance(v, c), 12)) as e from p, cen),
proba as (select cell_id, label, class, round(e / sum(e) over (partition by cell_id), 9) as p from pr),
cal as (select class, 1.0::double - p as score from proba where cell_id % 2 = 0 and class = label),
whole as (select max(score) filter (k = {hat}) as qhat from (select score, row_number() over (order by score) as k, count(*) over () as n from cal)),
q as (select proba.*, p >= 1.0::double - {"coalesce(own, qhat)" if conditional else "qhat"} as inside, case when class = '9' then '9' when cast(class as integer) < 5 then 'low' else 'high' end as parent
    from proba cross join whole {own if conditional else ""} where cell_id % 2 = 1),
sets as (select cell_id, label, coalesce(string_agg(class, ',' order by class) filter (inside), '') as labels, count(*) filter (inside) as set_size, count(distinct parent) filter (inside) as parents,
    coalesce(bool_or(inside and class = label), false) as hit from q group by all)"""


_SIL = "coalesce(({b} - a) / nullif(greatest(a, {b}), 0), 0)"

_NH_EXPECTED = """, deg as (select coalesce(o, 0) as o, coalesce(i, 0) as i from (select src as c, cast(count(*) as double) as o from edges group by src) full join (select dst as c, cast(count(*) as double) as i from edges group by dst) using (c)),
k as (select sum(o) as e, sum(o * (o - 1)) as ss, sum(i * (i - 1)) as sd, sum(i * o) as io, (select cast(count(*) as double) from p) as nn,
    (select cast(count(*) as double) from edges x join edges y on x.src = y.dst and x.dst = y.src) as r from deg),
h as (select *, 2 * (io - r) as ht, nn * (nn - 1) as n2, nn * (nn - 1) * (nn - 2) as n3, nn * (nn - 1) * (nn - 2) * (nn - 3) as n4 from k),
f as (select *, e * e - e - r - ss - sd - ht as dj from h),
w as (select nh.a, nh.b, n, case when nh.a = nh.b then e * x.k * (x.k - 1) / n2 else e * x.k * y.k / n2 end as mean,
    case when nh.a = nh.b then (e + r) * x.k * (x.k - 1) / n2 + (ss + sd + ht) * x.k * (x.k - 1) * (x.k - 2) / n3 + dj * x.k * (x.k - 1) * (x.k - 2) * (x.k - 3) / n4
    else e * x.k * y.k / n2 + (ss * x.k * y.k * (y.k - 1) + sd * x.k * (x.k - 1) * y.k) / n3 + dj * x.k * (x.k - 1) * y.k * (y.k - 1) / n4 end as sq
    from nh join lab x on x.label = nh.a join lab y on y.label = nh.b, f),
ex as (select a, b, n, mean, sqrt(greatest(sq - mean * mean, 0)) as sd, (n - mean) / nullif(sqrt(greatest(sq - mean * mean, 0)), 0) as z from w)"""

_COVERAGE = """,
st as (select gene, avg(x) as mean, case when stddev_pop(x) > 0 then stddev_pop(x) else 1 end as sd from (select gene, coalesce(value, 0) as x from cells cross join (select distinct gene from panel) left join counts using (cell_id, gene)) group by gene),
ls as (select cell_id, set_name, round(avg((coalesce(value, 0) - mean) / sd), 9) as sc from cells cross join panel join st using (gene) left join counts using (cell_id, gene) group by all),
lo as (select *, row_number() over (partition by cell_id order by sc desc, set_name desc) as k from ls),
calls as (select cell_id, max(set_name) filter (k = 1) as set_name, max(sc) filter (k = 1) - max(sc) filter (k = 2) >= 0.25::double as confident from lo group by cell_id),
cov0 as (select set_name, count(cell_id) filter (confident) as cells from (select distinct set_name from panel) left join calls using (set_name) group by all),
cov1 as (select set_name, cells, cells >= 50 or cells / cast(greatest(1, sum(cells) over ()) as double) >= 0.03 as expected, set_name in (select label from cells where {used}) as annotated from cov0),
cov as (select *, expected and not annotated as missing, round(sum(case when expected and not annotated then cells else 0 end) over () / cast((select count(*) from cells) as double), 3) as missing_frac from cov1)"""

_OVERLAP = """,
n as (select label, count(*) as k from cells group by label),
by_label as (select label, gene, sum(value) as s, sum(value * value) as ss from counts join cells using (cell_id) group by all),
grid as (select n.label as set_name, g.gene, g.gene_idx, k as n_in, (select count(*) from cells) - k as n_out, coalesce(b.s, 0) as s, coalesce(b.ss, 0) as ss, coalesce(w.s, 0) as ws, coalesce(w.ss, 0) as wss
    from n cross join genes g left join by_label b on b.label = n.label and b.gene = g.gene left join (select gene, sum(s) as s, sum(ss) as ss from by_label group by gene) w on w.gene = g.gene where n.label in (select set_name from markers)),
sc as (select *, round((s / n_in - (ws - s) / n_out) / sqrt(greatest((wss - ss) / n_out - ((ws - s) / n_out) ** 2, 0) + 1e-9), 12) as score from grid),
topn as (select set_name, gene from (select *, row_number() over (partition by set_name order by score desc, gene_idx) as r from sc) where r <= 10),
ov as (select set_name, count(*) as n_curated, (select count(*) from topn join (select distinct set_name, gene from panel) d using (set_name, gene) where topn.set_name = panel.set_name) / cast(count(*) as double) as overlap from panel group by set_name)"""

_NMP = """,
ref as (select label, gene, coalesce(sum(value), 0) / max(k) as mean, max(gene_idx) as gene_idx from (select label, cell_id, count(*) over (partition by label) as k from cells where cell_id % 2 = 0) cross join genes left join counts using (cell_id, gene) group by label, gene),
low as (select label, gene from (select *, row_number() over (partition by label order by round(mean, 12), gene_idx) as r, count(*) over (partition by label) as g from ref) where r <= greatest(1, ceil(g * 0.1::double))),
nm as (select cells.cell_id, coalesce(sum(case when low.gene is not null then value else 0 end) / nullif(sum(value), 0), 0) as nmp from cells left join counts using (cell_id)
    left join low on low.label = cells.label and low.gene = counts.gene where cells.cell_id % 2 = 1 group by all)"""

_NCP = """,
topg as (select gene, row_number() over (order by gene_idx) - 1 as i from (select gene, gene_idx, coalesce(sum(value) filter (cell_id % 2 = 0), 0) as s from genes left join counts using (gene) group by all order by s desc, gene_idx limit 400)),
hit as (select cell_id, cell_id % 2 as half, i from counts join topg using (gene) where value > 0),
one as (select half, i, count(*) as n from hit group by all),
co as (select a.half, a.i, b.i as j, count(*) as n from hit a join hit b on a.cell_id = b.cell_id and a.i < b.i group by all),
rate as (select x.half, x.i, y.i as j, coalesce(co.n, 0) as b, x.n + y.n - coalesce(co.n, 0) as e from one x join one y on x.half = y.half and x.i < y.i left join co on co.half = x.half and co.i = x.i and co.j = y.i),
apart as (select i, j from rate where half = 0 and e > 0 and b <= 0.12::double * e order by i, j limit 2000),
res as (select count(*) as n_pairs, avg(case when e is null or e = 0 or b <= 0.12::double * e then 1.0::double else 0 end) as ncp from apart left join (select * from rate where half = 1) using (i, j))"""

_STABLE = """,
units as (select r, cell_id, gene, unnest(range(1, cast(trunc(value) as bigint) + 1)) as i from counts cross join (select unnest(range(5)) as r) where gene in (select gene from panel)),
thinned as (select r, cell_id, gene, count(*) as value from units where md5(concat(r, ':', cell_id, ':', gene, ':', i))[1:8] < format('{:08x}', cast(floor(0.8::double * 4294967296) as bigint)) group by all),
calls as (select r, cell_id, arg_min(set_name, struct_pack(x := -load, y := set_name)) as label from (
    select r, cell_id, set_name, sum(value) as load from thinned join panel using (gene) group by all union all select -1, cell_id, set_name, load from loads) group by all),
every as (select r, cell_id, coalesce(calls.label, 'none') as label from cells cross join (select unnest(range(-1, 5)) as r) left join calls using (r, cell_id)),
stable as (select cell_id, 1 - count(*) filter (x.label <> y.label) / 5.0::double as label_stability from every x join every y using (cell_id) where x.r >= 0 and y.r = -1 group by all)"""

_ISC = """,
prof as (select label, sample, gene_idx, coalesce(sum(value), 0) / max(k) as x from (select label, coalesce(cast(sample as varchar), 'nan') as sample, cell_id, count(*) over (partition by label, sample) as k from cells) cross join genes left join counts using (cell_id, gene) group by all),
vecs as (select label, sample, list(x order by gene_idx) as v from prof group by all),
pd as (select a.label, a.sample, b.label as other, avg(1 - list_cosine_similarity(a.v, b.v)) as m from vecs a, vecs b where a.label <> b.label or a.sample <> b.sample group by all),
ps as (select label, sample, max(m) filter (other = label) as a, min(m) filter (other <> label) as b from pd group by all),
pv as (select label, case when a is null then 0 else (b - a) / greatest(a, b) end as s from ps),
isc as (select label, avg(s) as consistency, count(*) as n_profiles from pv group by label union all select null, avg(s), count(*) from pv)"""

_AQI = """,
bigl as (select label, count(*) as n from cells group by label having count(*) >= 50),
term_c as (select least(greatest(least(avg(m), any_value(kept)), 0), 1) as c from (select label, quantile_cont(pmp, 0.5) as m from pmp group by label), (select count(pmp) / cast(count(*) as double) as kept from pmp)),
term_m as (select least(greatest(2 * (avg(auc) - 0.5), 0), 1) as m from fid),
term_g as (select avg(b) as g from (select label, avg(((m1 = label)::int + (m2 = label)::int + (m3 = label)::int) / 3.0::double) as b from cells group by label)),
core as (select *, least(greatest(pow((pow(least(greatest(c, 0.01), 1), -4) + pow(least(greatest(m, 0.01), 1), -4)) / 2, -0.25), 0), 1) as aqi_core from term_c, term_m, term_g)
select """ + _r("aqi", "aqi_core") + """, 'with_agreement' as regime, """ + _r("c", "g", "m") + """, 1.0::double as completeness, 1.0::double as w_coh, 'C,M' as active_set,
    case when least(greatest(m, 0.01), 1) < least(greatest(c, 0.01), 1) then 'marker fidelity' else 'contamination' end as argmin, (select count(*) from bigl) as n_big, 0.0::double as no_dict_frac, miss as missing, """ + _r("missing_frac") + """,
    true as adequacy_unknown, false as low_support, true as abstention_available, miss <> '' as missing_lineages, false as coverage_limited
from (select *, aqi_core as aqi from core), (select coalesce(string_agg(set_name, ',' order by set_name) filter (missing), '') as miss, max(missing_frac) as missing_frac from cov)"""

_AQI_FULL = """,
bigl as (select label, count(*) as n from cells where label <> '5-LOW' group by label having count(*) >= 50),
term_c as (select least(greatest(least(avg(m), any_value(kept)), 0), 1) as c from (select label, quantile_cont(pmp, 0.5) as m from pmp where label in (select label from bigl) group by label),
    (select count(pmp) / cast(count(*) as double) as kept from pmp where label in (select label from bigl))),
term_m as (select least(greatest(2 * (avg(auc) - 0.5), 0), 1) as m from fid where set_name in (select label from bigl)),
term_g as (select avg(b) as g from (select label, avg(((m1 = label)::int + (m2 = label)::int + (m3 = label)::int) / 3.0::double) as b from cells where label in (select label from bigl) group by label)),
term_a as (select (0.204::double - 1 / 5.0::double) / (1 - 1 / 5.0::double) as a, 0.4::double as h, 0.85::double + 0.15::double * 0.4::double as w_coh),
core as (select *, least(greatest(pow((pow(least(greatest(c, 0.01), 1), -4) + pow(least(greatest(m, 0.01), 1), -4)) / 2, -0.25), 0), 1) as aqi_core from term_c, term_m, term_g, term_a),
rl as (select label as ref_label, count(*) / cast(sum(count(*)) over () as double) as share, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as r from cells where cell_id % 2 = 0 group by label),
ol as (select distinct regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as l from cells where label <> '5-LOW'),
rc as (select ref_label, exists (select 1 from ol where r = l or (length(r) >= 4 and (contains(l, r) or contains(r, l)))) as present from rl where share >= 0.03)
select """ + _r("aqi", "aqi_core") + """, 'with_agreement' as regime, """ + _r("a", "c", "g", "m", "h") + """, round(least(typed / 0.9::double, 1), 6) + 0.0 as completeness, """ + _r("w_coh") + """, 'C,M,A' as active_set,
    case when a < aqi_core then 'panel/depth ceiling' when least(greatest(m, 0.01), 1) < least(greatest(c, 0.01), 1) then 'marker fidelity' else 'contamination' end as argmin, (select count(*) from bigl) as n_big, 0.0::double as no_dict_frac,
    expected, annotated_on_axis, miss as missing, """ + _r("missing_frac") + """, reference_abundant, missing_vs_reference, false as adequacy_unknown, false as low_support, true as abstention_available,
    miss <> '' as missing_lineages, false as coverage_limited, """ + _r("cohort_consistency") + """, cohort_profiles
from (select *, w_coh * least(aqi_core, a) as aqi from core), (select count(*) filter (label <> '5-LOW') / cast(count(*) as double) as typed from cells),
    (select coalesce(string_agg(set_name, ',' order by set_name) filter (expected), '') as expected, coalesce(string_agg(set_name, ',' order by set_name) filter (annotated), '') as annotated_on_axis,
        coalesce(string_agg(set_name, ',' order by set_name) filter (missing), '') as miss, max(missing_frac) as missing_frac from cov),
    (select coalesce(string_agg(ref_label, ',' order by ref_label), '') as reference_abundant, coalesce(string_agg(ref_label, ',' order by ref_label) filter (not present), '') as missing_vs_reference from rc),
    (select consistency as cohort_consistency, n_profiles as cohort_profiles from isc where label is null)"""

_REF = """,
rl as (select label as ref_label, count(*) / cast(sum(count(*)) over () as double) as share, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as r from cells where cell_id % 2 = 0 group by label),
ol as (select distinct regexp_replace(lower(label), '[^a-z0-9]', '', 'g') as l from cells where cell_id % 2 = 1 and label <> '2-HIGH')
select ref_label, round(share, 6) + 0.0 as share, exists (select 1 from ol where r = l or (length(r) >= 4 and (contains(l, r) or contains(r, l)))) as present from rl where share >= 0.03"""

ORACLES: dict[str, str] = {
    "contingency": _scores("select * from c"),
    "accuracy_block": _scores(f"select {_r(*_BLOCK_COLS)} from {_BLOCK}"),
    "per_class_f1": _scores(f"select label, support, predicted, hits, {_r('precision', 'recall', 'f1')} from per_class"),
    "ari": _scores(f"select {_r('ari')} from {_ARI}"),
    "nmi": _scores(f"select {_r('nmi')} from {_NMI}"),
    "ami": _scores(f"select {_r('ami')} from {_AMI}"),
    "kappa": _scores(f"select {_r('kappa')} from {_KAPPA}"),
    "ecs": _scores(f"select {_r('ecs')} from {_ECS}"),
    "ecs_lineitem": "with m as (select n, sum(n) over (partition by x) as a, sum(n) over (partition by y) as b from (select l_returnflag as x, l_linestatus as y, count(*) as n from lineitem group by all)) select round(sum(cast(n as double) * n / greatest(a, b)) / sum(n), 6) + 0.0 as ecs from m",
    "external_scores": _scores(f"select {_r(*_BLOCK_COLS, 'ari', 'ami', 'nmi', 'kappa', 'ecs')} from {_BLOCK}, {_ARI}, {_AMI}, {_NMI}, {_KAPPA}, {_ECS}"),
    "hierarchical_accuracy": _scores(f"""select {_r('hierarchical_accuracy', 'subtype_accuracy', 'lineage_accuracy')} from (select sum(n * case when truth = pred then 1.0::double when u = v then 0.5 else 0 end) / sum(n) as hierarchical_accuracy,
        sum(case when truth = pred then n else 0 end) / cast(sum(n) as double) as subtype_accuracy, sum(case when u = v then n else 0 end) / cast(sum(n) as double) as lineage_accuracy
        from (select c.*, coalesce(a.parent, truth) as u, coalesce(b.parent, pred) as v from c left join hierarchy a on a.leaf = truth left join hierarchy b on b.leaf = pred))"""),
    "composition_accuracy": _scores(f"select {_r('l1', 'pearson', 'jsd')} from (select sum(abs(p - q)) as l1, {_COR.format(x='p', y='q')} as pearson, {_js('p', 'q')} as jsd from {_SHARES})"),
    "composition_shares": _scores(f"select label, {_r('q', 'p')} from {_SHARES}"),
    "deconvolution": f"with {PROPS} select {_r('r2', 'jsd', 'jsd_per_spot', 'rmse', 'pearson')} from (select avg(1 - sse / sst) as r2, avg(r) as pearson from types), (select avg(sqrt(j)) as jsd from (select {_js('x', 'y')} as j from by_type group by type)), "
                     f"(select avg(sqrt(j)) as jsd_per_spot from (select {_js('p_true', 'p_pred')} as j from props group by spot_id)), (select sqrt(avg((p_true - p_pred) ** 2)) as rmse from props)",
    "marker_fidelity": _section(f"{FIDELITY} select set_name, n, {_r('auc', 'cohens_d')} from fid"),
    "marker_fidelity_summary": _section(f"{FIDELITY} select {_r('mean_auc', 'mean_cohens_d')} from (select avg(auc) as mean_auc, avg(cohens_d) as mean_cohens_d from fid)"),
    "marker_gene_overlap": _section(f"{_OVERLAP} select set_name, n_curated, {_r('overlap')} from ov"),
    "marker_confidence_cells": _section(f"{CONFIDENCE} select cell_id, {_r('marker_margin', 'marker_entropy')} from conf"),
    "marker_confidence_summary": _section(f"{CONFIDENCE} select {_r('mean_margin', 'mean_entropy')} from (select avg(marker_margin) as mean_margin, avg(marker_entropy) as mean_entropy from conf)"),
    "crisp_cells": _section(f"{DETECT} select cell_id, n_sets, n_sets >= 2 as crisp_impure from per"),
    "crisp_purity": _section(f"{DETECT} select {_r('crisp_purity')} from (select 1 - coalesce(count(*) filter (n_sets >= 2) / nullif(cast(count(*) filter (n_sets >= 1) as double), 0), 0) as crisp_purity from per)"),
    "mecr": _section(f"""{DETECT}, n as (select set_name, count(*) as n from det group by all), b as (select x.set_name as s, y.set_name as t, count(*) as k from det x join det y on x.cell_id = y.cell_id and x.set_name < y.set_name group by all)
        select {_r('mecr')} from (select coalesce(avg(coalesce(k, 0) / cast(x.n + y.n - coalesce(k, 0) as double)), 0) as mecr from n x join n y on x.set_name < y.set_name left join b on s = x.set_name and t = y.set_name)"""),
    "pmp_cells": _section(f"{PMP} select cell_id, label, {_r('pmp')} from pmp"),
    "nmp_cells": _section(f"{_NMP} select cell_id, {_r('nmp')} from nm"),
    "ncp": _section(f"{_NCP} select n_pairs, {_r('ncp')} from res"),
    "lineage_coverage": _section(f"{_COVERAGE.replace('{used}', '''label <> '5-LOW' ''')} select set_name, cells, expected, annotated, missing, {_r('missing_frac')} from cov"),
    "reference_coverage": _section(_REF),
    "signal_cells": _section(f"{SIGNAL} select cell_id, {_r('total')}, n_detected, {_r('sparsity', 'detection_entropy', 'mean_signal_ratio', 'max_signal_ratio', 'tx_per_area')} from sig"),
    "sparsity": _section(f"{SIGNAL} select {_r('zero_fraction', 'median_cell_sparsity')} from spars"),
    "detection_entropy": _section(f"{SIGNAL} select {_r('median_detection_entropy', 'frac_cells_single_gene_dominated')} from entro"),
    "signal_to_noise": _section(f"{SIGNAL} select {_r('median_mean_signal_ratio', 'median_max_signal_ratio', 'frac_cells_signal_below_control')} from snr"),
    "tx_per_area": _section(f"{SIGNAL} select {_r('median_tx_per_area')} from dens"),
    "signal_report": _section(f"{SIGNAL} select {_r('zero_fraction', 'median_cell_sparsity', 'median_detection_entropy', 'frac_cells_single_gene_dominated', 'median_mean_signal_ratio', 'median_max_signal_ratio', 'frac_cells_signal_below_control', 'median_tx_per_area')} from spars, entro, snr, dens"),
    "knn_edges": f"with {SPATIAL} select src, dst, weight from edges",
    "spatial_coherence": f"with {SPATIAL} select {_r('pas', 'mean_coherence')} from (select avg(case when coalesce(spatial_coherence, 1) < 0.2 then 1.0::double else 0 end) as pas, avg(spatial_coherence) as mean_coherence from coh)",
    "spatial_coherence_cells": f"with {SPATIAL} select cell_id, {_r('spatial_coherence')} from coh",
    "moran_genes": f"with {SPATIAL} select gene, control, {_r('moran')} from mor",
    "moran_signal": f"with {SPATIAL} select {_r('median_gene_moran', 'median_control_moran')}, n_genes, n_controls, {_r('separation', 'frac_genes_above_control_p95')} from {_MORAN}",
    "nhood_counts": f"with {SPATIAL} select a, b, n from nh",
    "nhood_expected": f"with {SPATIAL} {_NH_EXPECTED} select a, b, n, {_r('mean', 'sd', 'z')} from ex",
    "neighborhood_sanity": f"""with {SPATIAL} {_NH_EXPECTED} select a as label, {_r('self_z')}, case when best <> a then best end as stronger_with, case when best <> a then round(top, 6) + 0.0 end as cross_z, best <> a as suspicious
        from (select a, max(z) filter (a = b) as self_z, arg_min(b, struct_pack(x := -z, y := b)) as best, max(z) as top from ex group by a)""",
    "neighborhood_purity": f"""with {POINTS}, kn as (select *, row_number() over (partition by id order by d, nbr) as k from dist)
        select {_r('neighborhood_purity')} from (select avg(s) as neighborhood_purity from (select id, avg(case when label = other then 1.0::double else 0 end) as s from kn where k <= 30 group by id))""",
    "orbital_medoid": f"""with {POINTS}, med as (select label, arg_min(v, struct_pack(x := round(d * d, 12), y := id)) as mv from own group by label),
        nr as (select p.id, p.label, arg_min(med.label, struct_pack(x := round(list_distance(v, mv), 12), y := med.label)) as best from p, med group by all)
        select {_r('orbital_medoid')} from (select avg(case when best = label then 1.0::double else 0 end) as orbital_medoid from nr)""",
    "avg_similarity": f"with {POINTS} select {_r('avg_similarity')} from (select avg(list_cosine_similarity(v, c)) as avg_similarity from own)",
    "silhouettes": f"with {POINTS} select {_r('silhouette', 'silhouette_2label')} from (select avg(case when a is null or b is null then 0 else {_SIL.format(b='b')} end) as silhouette, avg(case when a is not null and r is not null then {_SIL.format(b='r')} end) as silhouette_2label from sil)",
    "scatter_indices": f"""with {POINTS}, spread as (select label, any_value(c) as c, avg(d) as s, count(*) as n from own group by label),
        whole as (select list(x order by i) as w from (select i, avg(v[i]) as x from (select v, unnest(range(1, len(v) + 1)) as i from p) group by i))
        select {_r('davies_bouldin', 'calinski_harabasz')} from (select avg(worst) as davies_bouldin from (select x.label, max((x.s + y.s) / list_distance(x.c, y.c)) as worst from spread x, spread y where x.label <> y.label group by x.label)),
        (select b * (nn - k) / (wi * (k - 1)) as calinski_harabasz from (select sum(n * list_distance(c, w) ** 2) as b, count(*) as k, sum(n) as nn from spread, whole), (select sum(d * d) as wi from own))""",
    "label_stability": _section(f"{_STABLE} select cell_id, {_r('label_stability')} from stable"),
    "inter_sample_consistency": _section(f"{_ISC} select label, {_r('consistency')}, n_profiles from isc"),
    "avg_bio": f"""with {POINTS}, c as (select label as truth, cast(cast(label as integer) % 5 as varchar) as pred, count(*) as n from p group by all), m as (select *, sum(n) over (partition by truth) as a, sum(n) over (partition by pred) as b, sum(n) over () as t from c),
        info as (select sum(n / cast(t as double) * ln(n * cast(t as double) / (cast(a as double) * b))) as mi, -sum(n / cast(t as double) * ln(cast(a as double) / t)) as hu, -sum(n / cast(t as double) * ln(cast(b as double) / t)) as hv from m)
        select {_r('ari', 'nmi', 'asw')}, round((ari + nmi + (asw + 1) / 2) / 3, 6) + 0.0 as avg_bio from {_ARI}, {_NMI}, (select avg(case when a is null or b is null then 0 else {_SIL.format(b='b')} end) as asw from sil)""",
    "conformal_sets": _conformal(False) + " select cell_id, labels, set_size from sets",
    "conformal_class_conditional": _conformal(True) + " select cell_id, labels, set_size from sets",
    "conformal_summary": _conformal(False) + f""" select {_r('mean_set_size', 'pct_singleton', 'pct_ambiguous', 'pct_empty_novel', 'pct_ambiguous_one_parent', 'coverage')} from (select avg(set_size) as mean_set_size, avg((set_size = 1)::int) as pct_singleton, avg((set_size > 1)::int) as pct_ambiguous,
        avg((set_size = 0)::int) as pct_empty_novel, count(*) filter (set_size > 1 and parents = 1) / cast(greatest(1, count(*) filter (set_size > 1)) as double) as pct_ambiguous_one_parent, avg(hit::int) as coverage from sets)""",
    "conformal_coverage": _conformal(False) + f" select label, count(*) as n, round(avg(hit::int), 6) + 0.0 as coverage from sets group by label",
    "aqi_full": _section(FIDELITY + PMP + _COVERAGE.replace("{used}", "label <> '5-LOW'") + _ISC + _AQI_FULL),
    "aqi": _section(FIDELITY + PMP + _COVERAGE.replace("{used}", "true") + _AQI),
}
