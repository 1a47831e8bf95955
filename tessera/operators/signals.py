"""Operators on long signals and label tracks: windows within trials, aggregates over all of them, no sample-sized collection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.session import shared_dir


def by_time() -> WindowSpec:
    return Window.partitionBy("trial_id").orderBy("t")


def stacked(df: DataFrame, *channels: str) -> DataFrame:
    """Wide channels as rows (trial_id, t, ch, x)."""
    return df.select("trial_id", "t", F.posexplode(F.array(*channels)).alias("ch", "x"))


def normalize(df: DataFrame, value: str = "x", by: tuple[str, ...] = (), method: str = "zscore", nan_policy: str = "propagate") -> DataFrame:
    """Centre (and scale by the population deviation) over all trials, for each channel or as a whole. One aggregate with
    partial sums, then a join to its few rows. propagate: a NaN makes the channel NaN; omit: NaN are left out; raise: an error."""
    if method not in ("zscore", "center") or nan_policy not in ("propagate", "omit", "raise"):
        raise ValueError(f"method {method} or nan_policy {nan_policy} is unknown")
    x = F.col(value)
    used = F.when(~F.isnan(x), x) if nan_policy == "omit" else x
    stats = df.groupBy(*by).agg(F.avg(used).alias("_m"), F.stddev_pop(used).alias("_s"))
    if nan_policy == "raise" and not stats.filter(F.isnan("_m")).isEmpty():
        raise ValueError("the mean of a channel is NaN")
    joined = df.join(F.broadcast(stats), list(by)) if by else df.crossJoin(F.broadcast(stats))  # one row a channel, or one
    z = (x - F.col("_m")) / (F.col("_s") if method == "zscore" else F.lit(1.0))
    return joined.withColumn(value, z).drop("_m", "_s")


def forward_fill(df: DataFrame, value: str = "x", order: str = "t", by: tuple[str, ...] = ("trial_id",)) -> DataFrame:
    """NaN become the last number before them; leading ones stay."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(~F.isnan(value), F.col(value)), ignorenulls=True).over(w)
    return df.withColumn(value, F.coalesce(held, F.lit(float("nan"))))


def sliding_window(df: DataFrame, length: int, key: int = 0, fill: bool = True, fill_value: float = 0.0, value: str = "x") -> DataFrame:
    """(trial_id, t, i, x): the window of each sample. key 0: it ends with the sample, length - 1: it starts there. Without fill
    only whole windows, numbered from 0."""
    if not 0 <= key < length:
        raise ValueError("the window's key lies outside of it")
    back = length - 1 - key if fill else 0
    items = [F.lead(value, i - back, fill_value).over(by_time()) if i >= back else F.lag(value, back - i, fill_value).over(by_time()) for i in range(length)]
    out = df.withColumn("_n", F.count("*").over(Window.partitionBy("trial_id"))).withColumn("_w", F.array(*items))
    if not fill:
        out = out.filter(F.col("t") <= F.col("_n") - length)
    return out.select("trial_id", "t", F.posexplode("_w").alias("i", value))


def label_change_points(df: DataFrame, label: str = "label") -> DataFrame:
    """(trial_id, t, label, prior) where a label differs from the one before it in its trial."""
    before = F.lag(label).over(by_time())
    return df.withColumn("prior", before).filter(F.col("prior") != F.col(label)).select("trial_id", "t", F.col(label).alias("label"), "prior")


def segments(df: DataFrame, before: int, after: int, value: str = "x", label: str = "label") -> DataFrame:
    """(trial_id, cp, i, label, prior, x): samples around the changes whose segments lie in the trial."""
    n = Window.partitionBy("trial_id")
    marked = df.withColumn("prior", F.lag(label).over(by_time())).withColumn("_n", F.count("*").over(n))
    offsets = range(-before, after)
    items = [F.lead(value, o).over(by_time()) if o >= 0 else F.lag(value, -o).over(by_time()) for o in offsets]
    kept = marked.withColumn("_w", F.array(*items)).filter((F.col("prior") != F.col(label)) & (F.col("t") >= before) & (F.col("t") + after <= F.col("_n")))
    return kept.select("trial_id", F.col("t").alias("cp"), F.posexplode("_w").alias("i", value), F.col(label).alias("label"), "prior")


def shift_label_onsets(df: DataFrame, p: float = 0.5, label: str = "label") -> DataFrame:
    """The first int(p * length) samples of each run of a label other than -1 become -1."""
    if not 0 <= p < 1:
        raise ValueError("p must lie in [0, 1)")
    change = F.when(F.lag(label).over(by_time()) == F.col(label), 0).otherwise(1)
    runs = df.withColumn("_run", F.sum(change).over(by_time()))
    run = Window.partitionBy("trial_id", "_run")
    place, n = F.row_number().over(run.orderBy("t")), F.count("*").over(run)
    new = F.when((F.col(label) != -1) & (place <= F.floor(n * p)), F.lit(-1)).otherwise(F.col(label))
    return runs.withColumn(label, new.cast("long")).drop("_run")


def center_of_mass(df: DataFrame, value: str = "x") -> DataFrame:
    """(trial_id, com): mean index weighted by x - min + 1."""
    low = df.groupBy("trial_id").agg(F.min(value).alias("_m"), F.sum(F.col("t") * F.col(value)).alias("_tx"), F.sum("t").alias("_t"), F.sum(value).alias("_x"), F.count("*").alias("_n"))
    return low.select("trial_id", ((F.col("_tx") + (1 - F.col("_m")) * F.col("_t")) / (F.col("_x") + (1 - F.col("_m")) * F.col("_n"))).alias("com"))


def rereference(df: DataFrame, method: str = "avg") -> DataFrame:
    """(trial_id, t, ch, x): rows of long channels less their mean or median at the same time."""
    if method not in ("avg", "med"):
        raise ValueError("method must be avg or med")
    f = F.avg if method == "avg" else F.median
    return df.withColumn("x", F.col("x") - f("x").over(Window.partitionBy("trial_id", "t")))


def delayed(value: str, first: int, last: int) -> list[Column]:
    """value at t - lag in the same trial, 0 outside of it, for each lag."""
    return [F.lag(value, d, 0.0).over(by_time()) if d >= 0 else F.lead(value, -d, 0.0).over(by_time()) for d in range(first, last + 1)]


def delay_embed(df: DataFrame, first: int, last: int, value: str = "x") -> DataFrame:
    """(trial_id, t, lag, x): x at t - lag in the same trial, 0 outside of it."""
    return df.withColumn("_w", F.array(*delayed(value, first, last))).select("trial_id", "t", F.posexplode("_w").alias("_i", value)).select("trial_id", "t", (F.col("_i") + first).cast("long").alias("lag"), value)


def lda_discriminability(df: DataFrame, by: tuple[str, ...] = ("i",), value: str = "x", label: str = "label") -> DataFrame:
    """(by, f): between over within variance of classes, from sums of classes alone."""
    c = df.groupBy(*by, label).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = Window.partitionBy(*by)
    mean = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    parts = c.withColumn("_b", F.col("n") * (F.col("m") - mean) ** 2).withColumn("_w", F.when(F.col("v") == 0, 1e-6).otherwise(F.col("n") * F.col("v")))
    out = parts.groupBy(*by).agg(F.sum("_b").alias("b"), F.sum("_w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("c"))
    return out.select(*by, ((F.col("b") / (F.col("c") - 1)) / (F.col("w") / (F.col("n") - F.col("c")))).alias("f"))


def ttest_ind(df: DataFrame, group: Column, value: str, by: tuple[str, ...] = (), pooled: bool = True) -> DataFrame:
    """(by, t, df): two-sample t from conditional sums; group is true for the first sample."""
    x = F.col(value)
    a, b = F.when(group, x), F.when(~group, x)
    s = df.groupBy(*by).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    n1, n2 = F.col("n1"), F.col("n2")
    if pooled:
        se = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / (n1 + n2 - 2) * (1 / n1 + 1 / n2))
        dof = (n1 + n2 - 2).cast("double")
    else:
        p, q = F.col("v1") / n1, F.col("v2") / n2
        se, dof = F.sqrt(p + q), (p + q) ** 2 / (p**2 / (n1 - 1) + q**2 / (n2 - 1))
    return s.select(*by, ((F.col("m1") - F.col("m2")) / se).alias("t"), dof.alias("df"))


def stars(p: Column) -> Column:
    """Stars of a p-value."""
    return F.when(p < 0.0001, "****").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def harmonic(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: added up to 1000, beyond that by Euler and Maclaurin, exact to double precision, so that no row walks over m terms."""
    added = F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda a, i: a + 1.0 / i)
    x = m.cast("double")
    return F.when(m <= 1000, added).otherwise(F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x))


def fdr(df: DataFrame, p: str = "p", negative: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """df with q: Benjamini-Hochberg (or -Yekutieli) adjusted p within each family (columns by), a family being the hypotheses of one test.
    A null p counts as the family's last and has q 1, as in SQL. Ranges of p are ranked apart, equal p in several of them if need be; ranges then
    learn how many rows lie before them and the least value after them, from one row a range and family."""
    shared_dir(df.sparkSession)
    spread = F.xxhash64(*[c for c, kind in df.dtypes if "map<" not in kind])
    rows = df.repartitionByRange(*by, F.col(p).asc_nulls_last(), spread).withColumn("_part", F.spark_partition_id()).checkpoint()
    family = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    parts = family.orderBy("_part")
    down = Window.partitionBy("_part", *by).orderBy(F.col(p).desc_nulls_first())

    def meet(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnsRenamed({c: f"_f{i}" for i, c in enumerate(["_part", *by])})
        on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_f{i}")) for i, c in enumerate(["_part", *by])])
        return a.join(b if by else F.broadcast(b), on).drop(*[f"_f{i}" for i in range(1 + len(by))])

    sizes = rows.groupBy("_part", *by).agg(F.count("*").alias("_n")).withColumn("_m", F.sum("_n").over(family)).withColumn("_upto", F.sum("_n").over(parts))
    sizes = sizes.withColumn("_scale", harmonic(F.col("_m")) if negative else F.lit(1.0)).drop("_n")
    raw = meet(rows, sizes).withColumn("_q", F.col(p) * F.col("_m") / (F.col("_upto") + 1 - F.row_number().over(down)) * F.col("_scale")).drop("_m", "_upto", "_scale")
    later = raw.groupBy("_part", *by).agg(F.min("_q").alias("_least")).withColumn("_later", F.min("_least").over(family.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)))
    low = F.min("_q").over(down.rangeBetween(Window.unboundedPreceding, 0))
    return meet(raw, later.drop("_least")).withColumn("q", F.least(low, F.col("_later"), F.lit(1.0))).drop("_q", "_later", "_part")


def ridge(df: DataFrame, value: str = "x", target: str = "y", alpha: float = 1.0) -> DataFrame:
    """(slope, intercept) of one regressor by centred ridge regression, from sums alone."""
    s = df.agg(F.avg(value).alias("mx"), F.avg(target).alias("my"), F.covar_pop(value, target).alias("c"), F.var_pop(value).alias("v"), F.count("*").alias("n"))
    slope = F.col("c") * F.col("n") / (F.col("v") * F.col("n") + alpha)
    return s.select(slope.alias("slope"), (F.col("my") - slope * F.col("mx")).alias("intercept"))


def score(df: DataFrame, target: str = "y", predicted: str = "p") -> DataFrame:
    """(r2, r): coefficient of determination and Pearson's correlation."""
    s = df.agg(F.sum((F.col(target) - F.col(predicted)) ** 2).alias("e"), (F.var_pop(target) * F.count("*")).alias("v"), F.corr(target, predicted).alias("r"))
    return s.select((1 - F.col("e") / F.col("v")).alias("r2"), "r")


def shaded_error(df: DataFrame, value: str = "x", error: str = "stderr") -> DataFrame:
    """(t, mean, low, high) over trials."""
    s = df.groupBy("t").agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_s"), F.count("*").alias("_n"))
    e = F.col("_s") / F.sqrt("_n") if error == "stderr" else F.col("_s")
    return s.select("t", "mean", (F.col("mean") - e).alias("low"), (F.col("mean") + e).alias("high"))
