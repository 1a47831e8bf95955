"""More named queries: statistics, recordings, sensors, texts and figures' data, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import dsp, recording, signals, stats
from tessera.operators.grains import signal_events
from tessera.plans.catalog import CH, CP, NAN, POINTS, QUERIES, SIG, Query, points, query, signal, six


def plain(name: str) -> Callable[[Query], Query]:
    """A query without SQL: tested against arrays and known numbers."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return add


def stacked(g: DataFrame) -> DataFrame:
    return signals.stacked(g, "x", "k")


def labelled(g: DataFrame) -> DataFrame:
    return g.select("trial_id", "t", "label", F.posexplode(F.array("x", "k")).alias("ch", "x"))


signal("ttest_1samp", "select round(avg(x - 50) / (stddev_samp(x - 50) / sqrt(count(*))), 6) as t, cast(count(*) - 1 as double) as df from sig")(lambda g: six(stats.ttest_1samp(g, F.col("x") - 50), "t"))
signal("ttest_rel", "select round(avg(x - k) / (stddev_samp(x - k) / sqrt(count(*))), 6) as t, cast(count(*) - 1 as double) as df from sig")(lambda g: six(stats.ttest_1samp(g, F.col("x") - F.col("k")), "t"))
signal("ttest_controlled", """, v as (select x, k, case when label = 0 then 1.0::double else 0 end as c from sig), r as (select corr(x, c) as xc, corr(x, k) as xk, corr(c, k) as ck, count(*) - 3 as dof from v),
  q as (select (xc - xk * ck) / sqrt((1 - xk * xk) * (1 - ck * ck)) as r, dof from r) select round(r * sqrt(dof / (1 - r * r)), 6) as t, cast(dof as double) as df from q""")(
    lambda g: six(stats.ttest_controlled(g, F.col("x"), {"c": (F.col("label") == 0).cast("double"), "k": F.col("k")}, "c"), "t")
)
signal("responsive_ttest_stat", f""", {CH}, m as (select *, x - avg(x) over (partition by trial_id, ch) as y from long_),
  s as (select ch, count(*) filter (t < 10) as n1, count(*) filter (t >= 10) as n2, avg(y) filter (t < 10) as m1, avg(y) filter (t >= 10) as m2, var_samp(y) filter (t < 10) as v1, var_samp(y) filter (t >= 10) as v2 from m where t < 20 group by ch)
select ch, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 6) as t, cast(n1 + n2 - 2 as double) as df from s""")(lambda g: six(stats.responsive_ttest(stacked(g), 1.0, 10.0).drop("p"), "t"))
plain("responsive_ttest_p")(lambda s, d: six(signals.fdr(stats.responsive_ttest(stacked(signal_events(s, d)), 1.0, 10.0, average=True).withColumn("family", F.lit(0)), by=("family",)).select("ch", "p", "q"), "p", "q"))
LDA2 = """c2 as (select ch, i, label, count(*) as n, avg(x) as m, var_pop(x) as v from g group by all), e as (select *, sum(n * m) over (partition by ch, i) / sum(n) over (partition by ch, i) as mu from c2)"""
SEG2 = f"{CP}, l as (select trial_id, t, 0 as ch, x, label, prior, n from c union all select trial_id, t, 1, k, label, prior, n from c), g as (select c.ch, cast(s.t - c.t as int) as i, s.x, c.label from l c join l s on s.trial_id = c.trial_id and s.ch = c.ch and s.t between c.t and c.t + 4 where c.prior <> c.label and c.t + 5 <= c.n)"
FRAT = "f as (select ch, i, (sum(n * (m - mu) ** 2) / (count(*) - 1)) / (sum(case when v = 0 then 1e-6 else n * v end) / (sum(n) - count(*))) as f from e group by ch, i)"


def cut(g: DataFrame) -> DataFrame:
    return signals.segments(labelled(g).withColumn("trial_id", F.struct("trial_id", "ch")), 0, 5).select(F.col("trial_id.ch").alias("ch"), "i", "x", "label")


signal("discriminability_individual", f"{SEG2}, {LDA2}, {FRAT} select ch, i, round(f, 6) as f from f")(lambda g: six(signals.lda_discriminability(cut(g), ("ch", "i")), "f").select("ch", "i", "f"))
signal("discriminability_all", f"{SEG2}, {LDA2}, k as (select i, label, sum(n * (m - mu) ** 2) as b, case when sum(n * v) = 0 then 1e-6 else sum(n * v) end as w, max(n) as n from e group by i, label) select i, round((sum(b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) as f from k group by i")(
    lambda g: six(stats.discriminability_all(cut(g)), "f").select("i", "f")
)
signal("wilks_lambda", """, c as (select label, count(*) as n, covar_pop(x, x) * count(*) as xx, covar_pop(x, k) * count(*) as xk, covar_pop(k, k) * count(*) as kk from sig group by label),
  w as (select sum(xx) * sum(kk) - sum(xk) ** 2 as dw, sum(n) as n, count(*) as c from c), t as (select (var_pop(x) * var_pop(k) - covar_pop(x, k) ** 2) * count(*) ** 2 as dt from sig), r as (select sqrt(dw / dt) as r, n, c from w, t)
select round((1 - r) / r * (n - c) / ((c - 1) * 2), 6) as f from r""")(lambda g: six(stats.wilks_lambda(g, ["x", "k"]).select("f"), "f"))
signal("electrode_lags_fratio", f"""{SEG2}, {LDA2}, {FRAT}, p as (select a.ch, a.i, sum(b.f * exp(-2.0::double * (b.i - a.i) ** 2)) as s from f a join f b on a.ch = b.ch and abs(a.i - b.i) <= 2 group by a.ch, a.i)
select ch, arg_max(i, (s, -i)) as lag from p group by ch""")(lambda g: recording.electrode_lags(labelled(g), 5))
signal("forward_fill_channel", f", l as (select trial_id, t, 0 as ch, x, label from sig union all select trial_id, t, 1, case when label = 1 then null else k end, label from sig) select trial_id, t, ch, round(last_value(x ignore nulls) over (partition by trial_id, t order by ch), 6) as x from l")(
    lambda g: six(signals.forward_fill(stacked(g.withColumn("k", F.when(F.col("label") == 1, float("nan")).otherwise(F.col("k")))), order="ch", by=("trial_id", "t")), "x").select("trial_id", "t", "ch", "x")
)
signal("resample_categorical", f"""{CP}, s as (select trial_id, t, label, n from c where prior is null or prior <> label), r as (select *, lead(t, 1, n) over (partition by trial_id order by t) as z from s),
  b as (select trial_id, t, label, cast(round_even(t * 20 / n, 0) as bigint) as a, cast(round_even(z * 20 / n, 0) as bigint) as z from r), w as (select trial_id, t as seq, label, unnest(generate_series(a, z - 1)) as t from b)
select trial_id, t, arg_max(label, seq) as label from w group by trial_id, t""")(lambda g: recording.resample_categorical(g, 20))
signal("join_fields_time", ", n as (select trial_id, count(*) as n from sig group by 1) select trial_id, t, round(x, 6) as x from sig union all select sig.trial_id, t + n, round(k, 6) from sig join n using (trial_id)")(
    lambda g: six(recording.join_time(g.select("trial_id", "t", "x"), g.select("trial_id", "t", F.col("k").alias("x"))), "x")
)
signal("join_fields_channel", f", {CH} select trial_id, t, ch, round(x, 6) as x from long_ union all select trial_id, t, ch + 2, round(x, 6) from long_")(lambda g: six(recording.join_channels(stacked(g), stacked(g), 2), "x"))
signal("pad_befaft", ", n as (select trial_id, count(*) as n from sig group by 1) select trial_id, t + 3 as t, round(x, 6) as x from sig union all select trial_id, unnest([0, 1, 2]), 0 from n union all select trial_id, unnest([n + 3, n + 4]), 0 from n")(lambda g: six(recording.pad(g.select("trial_id", "t", "x"), 3, 2), "x"))
REGIONS = """n as (select trial_id, count(*) as n from sig group by 1), r as (select trial_id, n, 0 as region, 0.7::double as a, 1.9::double as z from n union all select trial_id, n, 1, 2.0, 4.0 from n),
  b as (select *, a - 0.5 as s, z + 0.5 as e, n / 10.0::double as d from r), q as (select *, case when s < 1 then s else 1 end as low, case when d - e < 1 then d - e else 1 end as high,
  cast(round_even((case when s < 1 then 0 else s - 1 end) * 10, 0) as bigint) as f, cast(round_even((case when d - e < 1 then d else e + 1 end) * 10, 0) as bigint) as l from b),
  cut as (select q.trial_id, region, t - f as t, x, low, high, least(l, n) - f as len from q join sig on sig.trial_id = q.trial_id and t >= f and t < l)"""


def regions(g: DataFrame) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("region"), F.lit(a).alias("start"), F.lit(z).alias("stop")) for i, (a, z) in enumerate(((0.7, 1.9), (2.0, 4.0)))]))
    return g.select("trial_id").distinct().select("trial_id", pairs.alias("r")).select("trial_id", "r.*")


signal("split_on_alignment", f", {REGIONS} select trial_id, region, t, round(x, 6) as x, round(low, 6) as low, round(high, 6) as high from cut")(lambda g: six(recording.split_on_alignment(g.select("trial_id", "t", "x"), regions(g), 10.0, 0.5, 0.5), "x", "low", "high"))
signal("remove_buffer", f", {REGIONS} select trial_id, region, t - cast(round_even(low * 10, 0) as bigint) as t, round(x, 6) as x from cut where t >= cast(round_even(low * 10, 0) as bigint) and t < len - cast(round_even(high * 10, 0) as bigint)")(
    lambda g: six(recording.remove_buffer(recording.split_on_alignment(g.select("trial_id", "t", "x"), regions(g), 10.0, 0.5, 0.5), 10.0), "x")
)
NAMES = "c as (select s_suppkey as ch, regexp_replace(s_name, '[0-9]+$', '') as stem, cast(regexp_extract(s_name, '([0-9]+)$', 1) as bigint) as number from supplier)"
query("contact_rereference_lar", f"with {NAMES} select a.ch, b.ch as ref from c a join c b on a.stem = b.stem and abs(a.number - b.number) between 1 and 2")(
    lambda s, d: recording.local_reference(s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("ch"), F.col("s_name").alias("name")), 2)
)
signal("contact_rereference_car", f", {CH} select trial_id, t, ch, round(x - avg(x) over (partition by trial_id, t), 6) as x from long_")(
    lambda g: six(recording.common_reference(stacked(g), g.sparkSession.createDataFrame([(0, "LT1"), (1, "LT12")], "ch int, name string")), "x").select("trial_id", "t", "ch", "x")
)
signal("shaded_error_median", "select t, round(median(x), 6) as median, round(quantile_cont(x, 0.025), 6) as low, round(quantile_cont(x, 0.975), 6) as high from sig group by t")(
    lambda g: six(g.groupBy("t").agg(F.median("x").alias("median"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high")), "median", "low", "high")
)
signal("density_histogram", ", r as (select min(x) as a, max(x) as z, count(*) as n from sig), h as (select least(cast(floor((x - a) / ((z - a) / 20)) as int), 19) as bin, count(*) as c from sig, r group by 1) select bin, round(c / (n * (z - a) / 20), 6) as density from h, r")(lambda g: histogram(g, 20))
signal("kde_density", """, s as (select label, stddev_samp(x) * count(*) ** (-0.2) as h from sig group by label), g as (select unnest([10.0, 30.0, 50.0, 70.0, 90.0]::double[]) as place)
select s.label, place, round(avg(exp(-0.5 * ((place - x) / h) ** 2)) / (any_value(h) * sqrt(2 * pi())), 6) as density from sig join s using (label), g group by s.label, place""")(lambda g: kde(g, [10.0, 30.0, 50.0, 70.0, 90.0]))


def histogram(g: DataFrame, bins: int) -> DataFrame:
    """(bin, density) of x in equal bins over its range."""
    a, z, n = g.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not n:
        return g.select(F.lit(0).alias("bin"), F.lit(0.0).alias("density")).limit(0)
    width = (z - a) / bins or 1.0
    at = F.least(F.floor((F.col("x") - a) / width), F.lit(bins - 1)).cast("int")
    return six(g.filter("x is not null").groupBy(at.alias("bin")).agg((F.count("*") / (n * width)).alias("density")), "density")


def kde(g: DataFrame, grid: list[float]) -> DataFrame:
    """(label, place, density) of x at the points of a grid: Gaussian kernels, Scott's width for each label. Samples meet the grid as an array of sums,
    not as rows."""
    h = g.groupBy("label").agg((F.stddev_samp("x") * F.pow(F.count("x"), -0.2)).alias("h"))
    j = g.join(h, "label")
    sums = j.groupBy("label").agg(F.max("h").alias("h"), *[F.avg(F.exp(-0.5 * ((F.lit(p) - F.col("x")) / F.col("h")) ** 2)).alias(f"d{i}") for i, p in enumerate(grid)])
    items = F.explode(F.array(*[F.struct(F.lit(p).alias("place"), (F.col(f"d{i}") / (F.col("h") * F.sqrt(2 * F.pi()))).alias("density")) for i, p in enumerate(grid)]))
    return six(sums.select("label", items.alias("v")).select("label", "v.place", "v.density"), "density")


B, A = [0.06745527, 0.0, -0.13491055, 0.0, 0.06745527], [1.0, -1.94246878, 2.1192024, -1.21665164, 0.4128016]
POWER = lambda c: "(" + " + ".join(f"{v}::double * cos({i} * w)" for i, v in enumerate(c)) + ") ** 2 + (" + " + ".join(f"{v}::double * sin({i} * w)" for i, v in enumerate(c)) + ") ** 2"
query("freq_response_db", f"with w as (select i, pi() * i / 512 as w from generate_series(1, 511) g(i)) select i, round(10 * log10(({POWER(B)}) / ({POWER(A)})), 5) as db from w")(
    lambda s, d: s.range(1, 512).select(F.col("id").alias("i"), F.round(dsp.response_db(B, A, F.pi() * F.col("id") / 512), 5).alias("db"))
)
query("simplify_labels", "select vec_id as id, case when label in (0, 1) then 'front' when label = 2 then 'back' else 'Other' end as region from embeddings")(
    lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.coalesce(F.create_map(F.lit(0), F.lit("front"), F.lit(1), F.lit("front"), F.lit(2), F.lit("back"))[F.col("label").cast("int")], F.lit("Other")).alias("region"))
)
query("distance_from_region_euclid", f"with {POINTS}, c as (select avg(x) as a, avg(y) as b, avg(z) as c from pts where label = 1) select id, round(sqrt((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2), 6) as d from pts, c")(
    lambda s, d: (lambda p: six(p.crossJoin(F.broadcast(p.filter("label = 1").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"]))).select("id", F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"), F.lit(0.0))).alias("d")), "d"))(points(s, d))  # one row
)
query("mark_overlay", f"with {POINTS}, d as (select id, sqrt(x * x + y * y + z * z) as d from pts) select id, case when d <= 0.1 then 8.0::double when d <= 0.2 then 4 when d <= 0.3 then 1 else 0 end as overlay from d")(
    lambda s, d: (lambda r: points(s, d).select("id", F.when(r <= 0.1, 8.0).when(r <= 0.2, 4.0).when(r <= 0.3, 1.0).otherwise(0.0).alias("overlay")))(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2))
)
WORDS = "w as (select conv_id, turn, unnest(string_split(text, ' ')) as word from conversations)"


def words(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("seq", "word"))


query("oov_words", f"with {WORDS} select distinct word from w where word not in (select word from w where turn = 0)")(lambda s, d: (lambda w: w.select("word").distinct().join(w.filter("turn = 0").select("word").distinct(), "word", "left_anti"))(words(s, d)))
query("sort_distinct_lines", "select distinct text as line from conversations order by 1")(lambda s, d: s.read.parquet(f"{d}/conversations.parquet").select(F.col("text").alias("line")).distinct().orderBy("line"))
query("missing_pairs", "select doc_id as id, 'label' as missing from documents where doc_id not in (select doc_id from labels) union all select doc_id, 'text' from labels where doc_id not in (select doc_id from documents)")(
    lambda s, d: (lambda a, b: a.join(b, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.lit("label").alias("missing")).unionByName(b.join(a, "doc_id", "left_anti").select(F.col("doc_id").alias("id"), F.lit("text").alias("missing"))))(
        s.read.parquet(f"{d}/documents.parquet").select("doc_id"), s.read.parquet(f"{d}/labels.parquet").select("doc_id").distinct()
    )
)
query("adjacency_edges", "select distinct least(o_custkey, o_orderkey % 1000) as a, greatest(o_custkey, o_orderkey % 1000) as b from orders where o_custkey <> o_orderkey % 1000")(
    lambda s, d: (lambda o: o.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("long").alias("a"), (F.col("o_orderkey") % 1000).cast("long").alias("b")))
)
for _name, _f in (
    ("filter_butter", lambda g: dsp.filter_butter(g, [10, 20], 100.0)),
    ("filter_line_noise", lambda g: dsp.filter_line_noise(g, 500.0)),
    ("filter_hilbert", lambda g: dsp.filter_hilbert(g, 500.0, [(8.0, 13.0), (70.0, 150.0)])),
    ("filterbank_hilbert", lambda g: dsp.filterbank_hilbert(g, 500.0, (70.0, 150.0))),
    ("phase_amplitude", lambda g: dsp.phase_amplitude(g, 500.0, fs_out=100.0)),
    ("resample_fft", lambda g: dsp.resample(g, 100.0, 50.0)),
):
    plain(_name)(lambda s, d, f=_f: f(stacked(signal_events(s, d))))
plain("lme_random_intercept")(lambda s, d: (lambda g: six(stats.MixedModel().fit(g, ["k"], "x", "trial_id").params(g), "coef", "p", "low", "high"))(signal_events(s, d)))
