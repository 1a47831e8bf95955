"""Tests and measures of discriminability from sums of groups: one aggregate each, and closed forms of a few numbers."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if not 0 < x < 1:
        return float("nan") if x != x else float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 0.0
    f = 1.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (v if abs(v := 1 + step * d) > tiny else tiny)
        c = v if abs(v := 1 + step / c) > tiny else tiny
        f *= c * d
        if i and abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def t_tail(t: float, df: float, alternative: str = "two-sided") -> float:
    """p of Student's t."""
    if t is None or df is None or t != t or df != df:
        return float("nan")
    both = betainc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0
    if alternative == "two-sided":
        return both
    return both / 2 if (t < 0) == (alternative == "less") else 1 - both / 2


def f_tail(f: float, a: float, b: float) -> float:
    """1 - CDF of the F distribution."""
    return betainc(b / 2, a / 2, b / (b + a * f)) if f > 0 else 1.0


def p_of_t(t: Column, df: Column, alternative: str = "two-sided") -> Column:
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError(f"alternative {alternative} is unknown")

    def run(t, df):
        return pd.Series([t_tail(a, b, alternative) for a, b in zip(t, df)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType(), F.PandasUDFType.SCALAR)(t, df)


def ttest_1samp(df: DataFrame, x: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, t, df) of the mean against 0; paired samples go in as their difference."""
    s = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))
    return s.select(*by, (F.col("m") / (F.col("s") / F.sqrt("n"))).alias("t"), (F.col("n") - 1).cast("double").alias("df"))


def ttest_controlled(df: DataFrame, y: Column, terms: dict[str, Column], of: str) -> DataFrame:
    """(t, df) of one term's coefficient in a least-squares fit with an intercept, by normal equations: one row of sums leaves the workers. Terms are
    numbers; a category goes in as a 0/1 term for each of its values but the first. Rows with a null in any term are left out."""
    names = [*terms]
    x = [F.lit(1.0), *(c.cast("double") for c in terms.values()), y.cast("double")]
    known = df.select(*[c.alias(f"_{i}") for i, c in enumerate(x)]).dropna()
    n = len(x)
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    row = known.agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i, j in cells]).first()
    g = np.zeros((n, n))
    for (i, j), v in zip(cells, row):
        g[i, j] = g[j, i] = v or 0.0
    dof = g[0, 0] - (n - 1)
    inverse = np.linalg.pinv(g[:-1, :-1])
    beta = inverse @ g[:-1, -1]
    k = 1 + names.index(of)
    rest = max(0.0, g[-1, -1] - beta @ g[:-1, -1])
    return df.sparkSession.createDataFrame([(float(beta[k] / math.sqrt(inverse[k, k] * rest / dof)), float(dof))], "t double, df double")


def responsive_ttest(df: DataFrame, before: float, fs: float, pre_post: list[float] = (1.0, 1.0), average: bool = False, pooled: bool = True, alternative: str = "two-sided") -> DataFrame:
    """(ch, t, df, p): samples before and after the stimulus, each less its trial's mean in the channel; with average one number a trial and window."""
    if len(pre_post) not in (2, 4) or (len(pre_post) == 2 and min(pre_post) <= 0):
        raise ValueError("pre_post takes two positive lengths or four ends")
    ends = [-pre_post[0], 0, 0, pre_post[1]] if len(pre_post) == 2 else pre_post
    bef = round(before * fs)
    a, b, c, d = (round(e * fs) + bef for e in ends)
    a = max(a, 0)
    if not a < b <= c < d:
        raise ValueError("the windows don't rise")
    if bef < 5:
        raise ValueError("there must be 5 samples before the stimulus")
    t = F.col("t")
    means = Window.partitionBy("trial_id", "ch")
    rows = df.withColumn("x", F.col("x") - F.avg("x").over(means)).withColumn("pre", F.when((t >= a) & (t < b), True).when((t >= c) & (t < d), False)).filter("pre is not null")
    if average:
        rows = rows.groupBy("trial_id", "ch", "pre").agg(F.avg("x").alias("x"))
    from tessera.operators.signals import ttest_ind

    out = ttest_ind(rows, F.col("pre"), "x", by=("ch",), pooled=pooled)
    return out.withColumn("p", p_of_t(F.col("t"), F.col("df"), alternative))


def discriminability_all(df: DataFrame, by: tuple[str, ...] = ("i",), value: str = "x", label: str = "label") -> DataFrame:
    """(by, f): between over within variance of classes over all channels together, from sums of channels and classes."""
    c = df.groupBy(*by, "ch", label).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = Window.partitionBy(*by, "ch")
    mean = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    parts = c.withColumn("_b", F.col("n") * (F.col("m") - mean) ** 2)
    classes = parts.groupBy(*by, label).agg(F.sum("_b").alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.max("n").alias("n"))
    out = classes.withColumn("w", F.when(F.col("w") == 0, 1e-6).otherwise(F.col("w"))).groupBy(*by).agg(F.sum("b").alias("b"), F.sum("w").alias("w"), F.sum("n").alias("n"), F.count("*").alias("c"))
    return out.select(*by, ((F.col("b") / (F.col("c") - 1)) / (F.col("w") / (F.col("n") - F.col("c")))).alias("f"))


def wilks_lambda(df: DataFrame, features: list[str], label: str = "label", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, f, p): Wilks' lambda of the classes over the features as an F ratio. Sums of each class leave the workers, one small matrix a class."""
    k = len(features)
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    sums = df.groupBy(*by, label).agg(F.count("*").cast("double").alias("n"), F.array(*[F.sum(c) for c in features]).alias("s"), F.array(*[F.sum(F.col(features[i]) * F.col(features[j])) for i, j in cells]).alias("q"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n, s = g["n"].to_numpy(), np.stack(g["s"])
        q = np.zeros((len(g), k, k))
        for at, v in zip(cells, np.stack(g["q"]).T):
            q[:, at[0], at[1]] = q[:, at[1], at[0]] = v
        within = (q - s[:, :, None] * s[:, None, :] / n[:, None, None]).sum(0)
        total = q.sum(0) - np.outer(s.sum(0), s.sum(0)) / n.sum()
        root = (np.linalg.det(within) / np.linalg.det(total)) ** (1 / k)
        a, b = (len(g) - 1) * k, n.sum() - len(g)
        f = (1 - root) / root * b / a
        return pd.DataFrame([[*(g[c].iloc[0] for c in by), f, f_tail(f, a, b)]], columns=[*by, "f", "p"])

    kinds = "".join(f"{c} {df.schema[c].dataType.simpleString()}, " for c in by)
    return sums.groupBy(*by).applyInPandas(run, f"{kinds}f double, p double")


class MixedModel:
    """y on features with a random intercept by group, by restricted maximum likelihood.

    Groups are summed once (count, sums of features and y); the likelihood at a grid of variance ratios is a sum over groups, taken for all of the
    grid in one pass; three passes narrow the ratio. Only the grid's sums reach the driver."""

    GRID = 25

    def fit(self, df: DataFrame, features: list[str], y: str, group: str) -> "MixedModel":
        x = [F.lit(1.0), *(F.col(c).cast("double") for c in features), F.col(y).cast("double")]
        k = len(x)
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        rows = df.select(F.col(group).alias("_g"), *[c.alias(f"_{i}") for i, c in enumerate(x)]).dropna()
        total = rows.agg(*[F.sum(F.col(f"_{i}") * F.col(f"_{j}")) for i, j in cells]).first()
        g = np.zeros((k, k))
        for (i, j), v in zip(cells, total):
            g[i, j] = g[j, i] = v or 0.0
        groups = rows.groupBy("_g").agg(F.count("*").cast("double").alias("n"), *[F.sum(f"_{i}").alias(f"s{i}") for i in range(k)]).drop("_g").persist()
        low, high = -12.0, 12.0
        for _ in range(4):
            grid = np.linspace(low, high, self.GRID)
            ratio = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(np.exp(v))).alias("r")) for i, v in enumerate(grid)]))
            each = groups.withColumn("v", ratio).withColumn("w", F.col("v.r") / (1 + F.col("v.r") * F.col("n")))
            sums = each.groupBy("v.i").agg(F.sum(F.log(1 + F.col("v.r") * F.col("n"))), *[F.sum(F.col("w") * F.col(f"s{i}") * F.col(f"s{j}")) for i, j in cells]).collect()
            best = None
            for row in sums:
                m = g.copy()
                for (i, j), v in zip(cells, row[2:]):
                    m[i, j] -= v
                    m[j, i] = m[i, j]
                inverse = np.linalg.inv(m[:-1, :-1])
                beta = inverse @ m[:-1, -1]
                dof, rss = g[0, 0] - (k - 1), m[-1, -1] - beta @ m[:-1, -1]
                value = -0.5 * (dof * math.log(rss / dof) + row[1] + np.linalg.slogdet(m[:-1, :-1])[1])
                if best is None or value > best[0]:
                    best = (value, row[0], beta, np.sqrt(np.diag(inverse) * rss / dof), rss / dof)
            step = grid[1] - grid[0]
            low, high = grid[best[1]] - step, grid[best[1]] + step
        groups.unpersist()
        self.features, self.beta, self.error, self.scale, self.ratio = features, best[2], best[3], best[4], math.exp((low + high) / 2)
        return self

    def params(self, df: DataFrame) -> DataFrame:
        """(feature, coef, p, low, high) without the intercept, in the session of df: normal p-values and 95 % intervals."""
        rows = [(n, float(b), math.erfc(abs(b / e) / math.sqrt(2)), float(b - 1.959963984540054 * e), float(b + 1.959963984540054 * e)) for n, b, e in zip(self.features, self.beta[1:], self.error[1:])]
        return df.sparkSession.createDataFrame(rows, "feature string, coef double, p double, low double, high double")
