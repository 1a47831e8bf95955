"""Named queries over the driver's tables and the SQL they are checked against. Real numbers are rounded to six places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import container, features, geometry, signals
from tessera.operators.grains import signal_events
from tessera.operators.trf import TRF

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SIG = """sig as (select user_id as trial_id, row_number() over (partition by user_id order by event_id) - 1 as t, value as x,
  cast(json_extract_string(props, '$.k') as double) as k,
  case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 when 'view' then 4 end as label from events)"""
TRIALS = """trials as (select row_number() over (order by user_id) - 1 as trial_id, user_id as name, count(*) as n, round(sum(value), 6) as total from events group by user_id)"""
POINTS = """pts as (select vec_id as id, cast(embedding[1] as double) as x, cast(embedding[2] as double) as y, cast(embedding[3] as double) as z, label from embeddings)"""


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


def trials(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return container.created(e, "name")


def points(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")], "label")


def simple(name: str, sql: str, f: Callable[[DataFrame], DataFrame]) -> None:
    query(name, f"with {TRIALS} {sql}")(lambda s, d: f(trials(s, d)))


simple("data_create", "select trial_id, name, n, total from trials", lambda t: t.select("trial_id", "name", "n", "total"))
simple("data_project_field", "select trial_id, total from trials", lambda t: t.select("trial_id", "total"))
simple("data_project_fields", "select trial_id, name, n from trials", lambda t: t.select("trial_id", "name", "n"))
simple("data_slice", "select cast((trial_id - 2) // 3 as bigint) as trial_id, name from trials where trial_id >= 2 and trial_id < (select count(*) from trials) - 1 and (trial_id - 2) % 3 = 0", lambda t: container.sliced(t, 2, -1, 3).select("trial_id", "name"))
simple("data_take", "select p.i as trial_id, name from trials join (values (0, 3), (1, 1), (2, 3)) p(i, j) on trial_id = p.j", lambda t: container.take(t, [3, 1, 3]).select("trial_id", "name"))
simple("data_get_trial", "select trial_id, name, n, total from trials where trial_id = 4", lambda t: t.filter("trial_id = 4").select("trial_id", "name", "n", "total"))
simple("data_set_field", "select trial_id, name, round(total / n, 6) as mean_x from trials", lambda t: t.withColumn("mean_x", F.round(F.col("total") / F.col("n"), 6)).select("trial_id", "name", "mean_x"))
simple("data_set_trial", "select trial_id, case when trial_id = 2 then -1 else name end as name from trials", lambda t: container.replace_trial(t.select("trial_id", "name"), t.limit(1).select(F.lit(-1).cast("long").alias("name")), 2))
simple("data_del_field", "select trial_id, name, n from trials", lambda t: t.drop("total").select("trial_id", "name", "n"))
simple("data_del_trial", "select trial_id - case when trial_id > 2 then 1 else 0 end as trial_id, name from trials where trial_id <> 2", lambda t: container.delete_trial(t, 2).select("trial_id", "name"))
simple("data_append", "select trial_id, name from trials union all select count(*), -5 from trials", lambda t: container.append(t.select("trial_id", "name"), t.limit(1).select(F.lit(-5).cast("long").alias("name"))))
simple("data_len", "select count(*) as n_trials from trials", lambda t: t.agg(F.count("*").alias("n_trials")))
simple("concat_trials", "select trial_id, name from trials union all select trial_id + (select count(*) from trials), name from trials", lambda t: container.concat_trials([t.select("trial_id", "name", "n"), t.select("trial_id", "name")]))
simple("concat_fields", "select trial_id, name, n, total from trials", lambda t: container.concat_fields([t.select("trial_id", "name"), t.select("trial_id", "name", "n", "total")]))
simple("kfold_split", "select trial_id, ntile(5) over (order by trial_id) - 1 as fold from trials", lambda t: features.kfold(t, 5))


def signal(name: str, sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], None]:
    def add(f: Callable[[DataFrame], DataFrame]) -> None:
        query(name, f"with {SIG} {sql}")(lambda s, d: f(signal_events(s, d)))

    return add


signal("normalize_global", "select trial_id, t, round((x - avg(x) over ()) / stddev_pop(x) over (), 6) as x from sig")(lambda g: six(signals.normalize(g).select("trial_id", "t", "x"), "x"))
signal("normalize_center", "select trial_id, t, round(x - avg(x) over (), 6) as x from sig")(lambda g: six(signals.normalize(g, method="center").select("trial_id", "t", "x"), "x"))
CH = "long_ as (select trial_id, t, 0 as ch, x from sig union all select trial_id, t, 1, k from sig)"
signal("normalize_zscore", f", {CH} select trial_id, t, ch, round((x - avg(x) over (partition by ch)) / stddev_pop(x) over (partition by ch), 6) as x from long_")(lambda g: six(signals.normalize(signals.stacked(g, "x", "k"), by=("ch",)), "x").select("trial_id", "t", "ch", "x"))
signal("rereference_avg", f", {CH} select trial_id, t, ch, round(x - avg(x) over (partition by trial_id, t), 6) as x from long_")(lambda g: six(signals.rereference(signals.stacked(g, "x", "k")), "x").select("trial_id", "t", "ch", "x"))
signal("rereference_med", f", {CH} select trial_id, t, ch, round(x - median(x) over (partition by trial_id, t), 6) as x from long_")(lambda g: six(signals.rereference(signals.stacked(g, "x", "k"), "med"), "x").select("trial_id", "t", "ch", "x"))
NAN = "case when label = 1 then 'nan'::double else x end"
signal("normalize_nan_omit", f", v as (select trial_id, t, {NAN} as x from sig), m as (select avg(x) as m, stddev_pop(x) as s from v where not isnan(x)) select trial_id, t, round((x - m) / s, 6) as x from v, m where not isnan(x)")(
    lambda g: six(signals.normalize(g.withColumn("x", F.when(F.col("label") == 1, float("nan")).otherwise(F.col("x"))), nan_policy="omit").filter(~F.isnan("x")).select("trial_id", "t", "x"), "x")
)
signal("forward_fill_time", f", v as (select trial_id, t, case when label = 1 then null else x end as x from sig), f as (select trial_id, t, last_value(x ignore nulls) over (partition by trial_id order by t) as x from v) select trial_id, t, round(coalesce(x, -1), 6) as x, x is null as leading from f")(
    lambda g: signals.forward_fill(g.withColumn("x", F.when(F.col("label") == 1, float("nan")).otherwise(F.col("x")))).select("trial_id", "t", F.round(F.when(F.isnan("x"), -1.0).otherwise(F.col("x")), 6).alias("x"), F.isnan("x").alias("leading"))
)
for _key, _name in ((0, "causal"), (2, "anticausal"), (1, "centered")):
    signal(f"sliding_window_{_name}", f", w as (select trial_id, t, unnest([0, 1, 2]) as i from sig) select w.trial_id, w.t, w.i, round(coalesce(s.x, 0), 6) as x from w left join sig s on s.trial_id = w.trial_id and s.t = w.t + w.i - {2 - _key}")(
        lambda g, k=_key: six(signals.sliding_window(g, 3, k), "x").select("trial_id", "t", "i", "x")
    )
signal("sliding_window_nofill", ", w as (select trial_id, t, unnest([0, 1, 2]) as i from sig) select w.trial_id, w.t, w.i, round(s.x, 6) as x from w join sig s on s.trial_id = w.trial_id and s.t = w.t + w.i where exists (select 1 from sig e where e.trial_id = w.trial_id and e.t = w.t + 2)")(
    lambda g: six(signals.sliding_window(g, 3, fill=False), "x").select("trial_id", "t", "i", "x")
)
signal("center_of_mass", ", m as (select *, x - min(x) over (partition by trial_id) + 1 as w from sig) select trial_id, round(sum(t * w) / sum(w), 6) as com from m group by trial_id")(lambda g: six(signals.center_of_mass(g), "com"))
CP = ", c as (select *, lag(label) over (partition by trial_id order by t) as prior, count(*) over (partition by trial_id) as n from sig)"
signal("label_change_points", f"{CP} select trial_id, t, label, prior from c where prior <> label")(lambda g: signals.label_change_points(g).select("trial_id", "t", "label", "prior"))
SEG = f"{CP}, g as (select c.trial_id, c.t as cp, cast(s.t - c.t + 2 as int) as i, s.x, c.label, c.prior from c join sig s on s.trial_id = c.trial_id and s.t between c.t - 2 and c.t + 2 where c.prior <> c.label and c.t >= 2 and c.t + 3 <= c.n)"
signal("segment_transitions", f"{SEG} select trial_id, cp, i, round(x, 6) as x, label, prior from g")(lambda g: six(signals.segments(g, 2, 3), "x").select("trial_id", "cp", "i", "x", "label", "prior"))
LDA = """, c2 as (select i, label, count(*) as n, avg(x) as m, var_pop(x) as v from g group by all),
  e as (select *, sum(n * m) over (partition by i) / sum(n) over (partition by i) as mu from c2)
select i, round((sum(n * (m - mu) ** 2) / (count(*) - 1)) / (sum(case when v = 0 then 1e-6 else n * v end) / (sum(n) - count(*))), 6) as f from e group by i"""
signal("lda_discriminability", f"{SEG}{LDA}")(lambda g: six(signals.lda_discriminability(signals.segments(g, 2, 3)), "f").select("i", "f"))
signal("shift_label_onsets", """, a as (select *, case when lag(label) over (partition by trial_id order by t) = label then 0 else 1 end as ch from sig),
  r as (select *, sum(ch) over (partition by trial_id order by t) as run from a),
  p as (select *, row_number() over (partition by trial_id, run order by t) as rn, count(*) over (partition by trial_id, run) as n from r)
select trial_id, t, case when rn <= floor(n * 0.5) then -1 else label end as label from p""")(lambda g: signals.shift_label_onsets(g).select("trial_id", "t", "label"))
signal("delay_embed", ", w as (select trial_id, t, unnest([-1, 0, 1, 2]) as lag from sig) select w.trial_id, w.t, cast(w.lag as bigint) as lag, round(coalesce(s.x, 0), 6) as x from w left join sig s on s.trial_id = w.trial_id and s.t = w.t - w.lag")(lambda g: six(signals.delay_embed(g, -1, 2), "x").select("trial_id", "t", "lag", "x"))
signal("trf_ridge_fit", "select round(covar_pop(k, x) * count(*) / (var_pop(k) * count(*) + 10), 6) as slope, round(avg(x) - covar_pop(k, x) * count(*) / (var_pop(k) * count(*) + 10) * avg(k), 6) as intercept from sig")(lambda g: six(signals.ridge(g, "k", "x", 10.0), "slope", "intercept"))
signal("trf_score", "select round(1 - sum((x - k) ** 2) / (var_pop(x) * count(*)), 6) as r2, round(corr(x, k), 6) as r from sig")(lambda g: six(signals.score(g, "x", "k"), "r2", "r"))


def delay_model(s: SparkSession, d: str) -> tuple[TRF, DataFrame]:
    """x, and x with k as two outputs, from four lags of k and the label."""
    g = signal_events(s, d).withColumn("label", F.col("label").cast("double"))
    return TRF(0, 3).fit(g, ["k", "label"], {"x": ["x"], "both": ["x", "k"]}), g


# No SQL: the penalty is chosen by cross-validation.
QUERIES["trf_model_coef"] = lambda s, d: six((m := delay_model(s, d))[0].coefficients(m[1]), "coef")
QUERIES["trf_model_predict"] = lambda s, d: six((m := delay_model(s, d))[0].predict(m[1]), "p")
QUERIES["trf_model_score"] = lambda s, d: six((m := delay_model(s, d))[0].score(m[1]), "r2", "r")
signal("shaded_error_mean_stderr", "select t, round(avg(x), 6) as mean, round(avg(x) - stddev_pop(x) / sqrt(count(*)), 6) as low, round(avg(x) + stddev_pop(x) / sqrt(count(*)), 6) as high from sig group by t")(lambda g: six(signals.shaded_error(g), "mean", "low", "high"))
signal("shaded_error_mean_std", "select t, round(avg(x), 6) as mean, round(avg(x) - stddev_pop(x), 6) as low, round(avg(x) + stddev_pop(x), 6) as high from sig group by t")(lambda g: six(signals.shaded_error(g, error="std"), "mean", "low", "high"))
T_SQL = """, s as (select count(*) filter (label = 0) as n1, count(*) filter (label <> 0) as n2, avg(x) filter (label = 0) as m1, avg(x) filter (label <> 0) as m2, var_samp(x) filter (label = 0) as v1, var_samp(x) filter (label <> 0) as v2 from sig)
select round((m1 - m2) / {se}, 6) as t, round({df}, 6) as df from s"""
signal("ttest_ind", T_SQL.format(se="sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))", df="cast(n1 + n2 - 2 as double)"))(lambda g: six(signals.ttest_ind(g, F.col("label") == 0, "x"), "t", "df"))
signal("ttest_welch", T_SQL.format(se="sqrt(v1 / n1 + v2 / n2)", df="(v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))"))(lambda g: six(signals.ttest_ind(g, F.col("label") == 0, "x", pooled=False), "t", "df"))

PV = "p_ as (select l_suppkey as id, avg(l_discount) / 2 as p from lineitem group by 1)"


def p_values(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_suppkey").alias("id")).agg((F.avg("l_discount") / 2).alias("p"))


STARS = "case when p < 0.0001 then '****' when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'n.s.' end"
query("pvalue_stars", f"with {PV} select id, {STARS} as stars from p_")(lambda s, d: p_values(s, d).select("id", signals.stars(F.col("p")).alias("stars")))
FDR = "with {pv}, r as (select id, p, row_number() over (order by p, id) as k, count(*) over () as m from p_), q as (select *, p * m / k * {scale} as q0 from r) select id, round(least(min(q0) over (order by k rows between current row and unbounded following), 1), 6) as q from q"
query("fdr_bh", FDR.format(pv=PV, scale="1"))(lambda s, d: six(signals.fdr(p_values(s, d)), "q").select("id", "q"))
query("fdr_by", FDR.format(pv=PV, scale="(select sum(1.0::double / i) from generate_series(1, (select count(*) from p_)) g(i))"))(lambda s, d: six(signals.fdr(p_values(s, d), negative=True), "q").select("id", "q"))

query("mni_to_fsavg", f"""with {POINTS} select id, round(1.0022::double * x + 0.0071::double * y - 0.0177::double * z + 0.0528::double, 6) as x,
  round(-0.0146::double * x + 0.999::double * y + 0.0027::double * z - 1.5519::double, 6) as y, round(0.0129::double * x + 0.0094::double * y + 1.0027::double * z - 1.2012::double, 6) as z from pts""")(
    lambda s, d: six(geometry.affine(points(s, d), "to_average"), "x", "y", "z").select("id", "x", "y", "z")
)
query("fsavg_to_mni", f"""with {POINTS} select id, round(0.9975::double * x - 0.0073::double * y + 0.0176::double * z - 0.0429::double, 6) as x,
  round(0.0146::double * x + 1.0009::double * y - 0.0024::double * z + 1.5496::double, 6) as y, round(-0.013::double * x - 0.0093::double * y + 0.9971::double * z + 1.184::double, 6) as z from pts""")(
    lambda s, d: six(geometry.affine(points(s, d), "to_mni"), "x", "y", "z").select("id", "x", "y", "z")
)
query("parcellate_overlay", f"with {POINTS} select id, label, round(avg(x) over (partition by label), 6) as x from pts")(lambda s, d: six(geometry.parcellate(points(s, d)), "x").select("id", "label", "x"))


def sites(p: DataFrame) -> DataFrame:
    return p.filter("id % 10 = 0").select(F.col("id").alias("site"), *[F.col(c).alias(f"s{c}") for c in "xyz"], F.col("label").cast("double").alias("value"))


DIST = f"with {POINTS}, d as (select p.id, s.id as site, cast(s.label as double) as value, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2 + (p.z - s.z) ** 2) as d from pts p, pts s where s.id % 10 = 0 and p.id % 10 <> 0)"
query("annotate_nearest", f"{DIST} select id, arg_min(site, (d, site)) as site, round(min(d), 6) as d from d group by id")(lambda s, d: six(geometry.nearest((p := points(s, d)).filter("id % 10 <> 0"), sites(p)), "d").select("id", "site", "d"))
query("knn_idw_interpolate", f"{DIST}, r as (select *, row_number() over (partition by id order by d, site) as r from d) select id, round(sum(value / (d + 1e-10)) / sum(1 / (d + 1e-10)), 6) as value from r where r <= 10 and d <= 0.5 group by id")(
    lambda s, d: six(geometry.interpolate((p := points(s, d)).filter("id % 10 <> 0"), sites(p), 10, 0.5), "value").select("id", "value")
)

def all_sites(p: DataFrame) -> DataFrame:
    return p.select(F.col("id").alias("site"), *[F.col(c).alias(f"s{c}") for c in "xyz"], F.col("label").cast("double").alias("value"))


ALL = f"with {POINTS}, d as (select p.id, s.id as site, cast(s.label as double) as value, sqrt((p.x - s.x) ** 2 + (p.y - s.y) ** 2 + (p.z - s.z) ** 2) as d from pts p, pts s where s.id <> p.id)"
query("annotate_nearest_all", f"{ALL} select id, arg_min(site, (d, site)) as site, round(min(d), 6) as d from d group by id")(lambda s, d: six(geometry.nearest(p := points(s, d), all_sites(p), itself=False), "d").select("id", "site", "d"))
query("knn_idw_interpolate_all", f"{ALL}, r as (select *, row_number() over (partition by id order by d, site) as r from d) select id, round(sum(value / (d + 1e-10)) / sum(1 / (d + 1e-10)), 6) as value from r where r <= 10 and d <= 0.5 group by id")(
    lambda s, d: six(geometry.interpolate(p := points(s, d), all_sites(p), 10, 0.5, itself=False), "value").select("id", "value")
)
query("clean_transcript", r"select conv_id, turn, regexp_replace(strip_accents(upper(regexp_replace(replace(text, 'ß', 'SS'), '[!-&(-/:-@\[-`{-~]', '', 'g'))), '[^\x00-\x7F]', '', 'g') as transcript from conversations")(
    lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", features.clean_transcript(F.col("text")).alias("transcript"))
)
query("word_dict", "with f as (select regexp_replace(role, '[0-9]', '', 'g') as token, min((conv_id, turn)) as f from conversations group by 1), w as (select token, row_number() over (order by f, token) as id from f where token <> 'sp') select token, id from w union all select token, -1 from f where token = 'sp'")(
    lambda s, d: features.word_ids(s.read.parquet(f"{d}/conversations.parquet").withColumn("token", F.col("role")), "token", "conv_id", "turn")
)
query("sanitize_fieldnames", "select n_nationkey, replace(replace(n_name, ' ', '_'), '-', '_') as field from nation")(lambda s, d: s.read.parquet(f"{d}/nation.parquet").select("n_nationkey", features.sanitize(F.col("n_name")).alias("field")))
query("phoneme_labels", f"with {SIG}, i as (select trial_id, t as seq, label, t / 4.0::double as s, (t + 1) / 4.0::double as e from sig), w as (select trial_id, seq, label, unnest(generate_series(cast(round_even((s + 0.1) * 10, 0) as bigint), cast(round_even((e + 0.1) * 10, 0) as bigint) - 1)) as t from i) select trial_id, t, arg_max(label, seq) as label from w group by trial_id, t")(
    lambda s, d: features.label_vector(signal_events(s, d).select("trial_id", F.col("t").alias("seq"), "label", (F.col("t") / 4.0).alias("start"), ((F.col("t") + 1) / 4.0).alias("end")), 10.0, 0.1)
)
query("crop_by_onset", f"with {SIG}, o as (select trial_id, t as seq, t * 2.0::double as onset from sig) select trial_id, seq, round(case when onset - 0.5 < 0 and onset - 0.5 > -50 then 0 else onset - 0.5 end, 6) as start, round(least(coalesce(lead(onset) over (partition by trial_id order by seq) + 1, 500), 500), 6) as stop from o")(
    lambda s, d: six(features.crop_events(signal_events(s, d).select("trial_id", F.col("t").alias("seq"), (F.col("t") * 2.0).alias("onset")), 0.5, 1.0, 500.0, 100.0), "start", "stop")
)


def flagship(s: SparkSession, d: str) -> DataFrame:
    """z-scored events, cut around label changes, and how well each sample tells the labels apart."""
    return six(signals.lda_discriminability(signals.segments(signals.normalize(signal_events(s, d)), 0, 5)), "f")


signal("entry_discriminability", f"{CP}, g as (select cast(s.t - c.t as int) as i, s.x, c.label from c join sig s on s.trial_id = c.trial_id and s.t between c.t and c.t + 4 where c.prior <> c.label and c.t + 5 <= c.n){LDA}")(lambda g: six(signals.lda_discriminability(signals.segments(signals.normalize(g), 0, 5)), "f").select("i", "f"))


def queries() -> dict[str, Query]:
    from tessera.plans import extra  # noqa: F401  (adds its own)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
