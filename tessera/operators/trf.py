"""Delay models: ridge regression of targets on delayed features, the penalty by cross-validation, from Gram sums alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.signals import delayed

ALPHAS, FOLDS = tuple(np.logspace(-2, 5, 6)), 5


class TRF:
    """Of each target (a name and its output columns) one ridge model over features x lags from tmin to tmax seconds, both taken; lags reach back
    within a trial, zeros outside of it. As sklearn's RidgeCV with folds does, the penalty is that of the best mean R2 over contiguous folds of all
    samples in order of trial and time, and of a target's outputs R2 is the mean. Missing values are an error.

    Only sums over samples leave the workers: one Gram matrix a fold, which the driver holds and solves."""

    def __init__(self, tmin: float, tmax: float, sfreq: float = 1.0, alphas: tuple[float, ...] = ALPHAS, folds: int = FOLDS):
        if tmin >= tmax:
            raise ValueError("tmin must be less than tmax")
        self.first, self.last, self.alphas, self.folds = round(tmin * sfreq), round(tmax * sfreq), alphas, folds

    def _rows(self, df: DataFrame, outputs: list[str]) -> DataFrame:
        """(trial_id, t, z): z holds the features' lags, then the outputs."""
        items = [c for f in self.features for c in delayed(f, self.first, self.last)]
        return df.select("trial_id", "t", F.transform(F.array(*items, *[F.col(c) for c in outputs]), lambda x: x.cast("double")).alias("z"))

    def fit(self, df: DataFrame, features: list[str], targets: dict[str, list[str]]) -> TRF:
        self.features, self.targets = list(features), {k: list(v) for k, v in targets.items()}
        outputs = [c for v in self.targets.values() for c in v]
        trials = df.groupBy("trial_id").agg(F.count("*").alias("_n"))
        trials = trials.withColumn("_before", F.sum("_n").over(Window.orderBy("trial_id")) - F.col("_n")).drop("_n")
        moved = df.agg(F.count("*"), *[F.avg(c) for c in self.features for _ in range(self.last - self.first + 1)], *[F.avg(c) for c in outputs]).first()
        n, shift = moved[0], np.array([np.nan if v is None else v for v in moved[1:]], float)
        if n < self.folds:
            raise ValueError(f"fewer than {self.folds} samples")
        size, more = divmod(n, self.folds)
        at = F.col("_before") + F.row_number().over(Window.partitionBy("trial_id").orderBy("t")) - 1
        big = more * (size + 1)
        fold = F.when(at < big, F.floor(at / (size + 1))).otherwise(more + F.floor((at - big) / size)).cast("int")
        rows = self._rows(df, outputs).join(trials, "trial_id").select(fold.alias("fold"), "z")
        width = len(shift) + 1

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grams: dict[int, np.ndarray] = {}
            for b in batches:
                z = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width - 1) - shift
                z = np.hstack([z, np.ones((len(z), 1))])
                for f in np.unique(folds := b.column(0).to_numpy(zero_copy_only=False)):
                    part = z[folds == f]
                    grams[f] = grams.get(f, 0) + part.T @ part
            for f, g in grams.items():
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.int32()), pa.array([g.tobytes()], pa.binary())], ["fold", "gram"])

        def total(t: pa.Table) -> pa.Table:
            g = sum(np.frombuffer(x.as_py()) for x in t.column("gram"))
            return pa.table({"fold": t.column("fold").slice(0, 1), "gram": pa.array([g.tobytes()], pa.binary())})

        got = rows.mapInArrow(sums, "fold int, gram binary").groupBy("fold").applyInArrow(total, "fold int, gram binary").orderBy("fold").collect()
        grams = [np.frombuffer(r.gram).reshape(width, width) for r in got]
        whole = sum(grams)
        if not np.isfinite(whole).all():
            raise ValueError("missing values in features or targets")
        p, i = len(self.features) * (self.last - self.first + 1), 0
        self.alpha, self.coef, self.intercept = {}, {}, {}
        for name, columns in self.targets.items():
            y = np.arange(p + i, p + i + len(columns))
            mean = [np.mean([self._r2(g, *self._solved(whole - g, p, y, a), p, y) for g in grams]) for a in self.alphas]
            self.alpha[name] = float(self.alphas[int(np.argmax(mean))])
            w, b = self._solved(whole, p, y, self.alpha[name])
            self.coef[name] = w.T.reshape(len(columns), len(self.features), -1)
            self.intercept[name] = b + shift[y] - shift[:p] @ w
            i += len(columns)
        return self

    @staticmethod
    def _solved(g: np.ndarray, p: int, y: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        n, mx, my = g[-1, -1], g[:p, -1] / g[-1, -1], g[y, -1] / g[-1, -1]
        w = np.linalg.solve(g[:p, :p] - n * np.outer(mx, mx) + alpha * np.eye(p), g[:p, y] - n * np.outer(mx, my))
        return w, my - mx @ w

    @staticmethod
    def _r2(g: np.ndarray, w: np.ndarray, b: np.ndarray, p: int, y: np.ndarray) -> float:
        v = np.zeros((len(g), len(y)))
        v[:p], v[y, np.arange(len(y))], v[-1] = -w, 1, -b
        off, var = np.einsum("ij,ij->j", v, g @ v), g[y, y] - g[y, -1] ** 2 / g[-1, -1]
        return float(np.mean(np.where(var > 0, 1 - off / np.where(var > 0, var, 1), np.where(off > 0, 0.0, 1.0))))

    def coefficients(self, df: DataFrame) -> DataFrame:
        """(target, output, feature, lag, coef) in the session of df."""
        rows = [(k, o, f, self.first + i, float(c[a, b, i])) for k, c in self.coef.items() for a, o in enumerate(self.targets[k]) for b, f in enumerate(self.features) for i in range(c.shape[2])]
        return df.sparkSession.createDataFrame(rows, "target string, output string, feature string, lag long, coef double")

    def predict(self, df: DataFrame, keep: bool = False) -> DataFrame:
        """(trial_id, t, target, output, p), with y, the output itself, if keep."""
        outputs = [(k, c) for k, v in self.targets.items() for c in v]
        w = np.concatenate([c.reshape(c.shape[0], -1) for c in self.coef.values()]).T
        b, m = np.concatenate(list(self.intercept.values())), len(outputs)
        rows = self._rows(df, [c for _, c in outputs] if keep else [])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for r in batches:
                z = r.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(w) + m * keep)
                at = pa.array(np.repeat(np.arange(len(z)), m))
                cols = [r.column(0).take(at), r.column(1).take(at), pa.array([k for k, _ in outputs] * len(z), pa.string()), pa.array([c for _, c in outputs] * len(z), pa.string()), pa.array((z[:, : len(w)] @ w + b).ravel())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array(z[:, len(w) :].ravel())] * keep], ["trial_id", "t", "target", "output", "p", *["y"] * keep])

        kinds = {c: rows.schema[c].dataType.simpleString() for c in ("trial_id", "t")}
        return rows.mapInArrow(run, f"trial_id {kinds['trial_id']}, t {kinds['t']}, target string, output string, p double" + ", y double" * keep)

    def score(self, df: DataFrame) -> DataFrame:
        """(target, r2, r): over all trials, R2 of the predictions, the mean over a target's outputs, and Pearson's correlation over all of them."""
        p = self.predict(df, True)
        s = p.groupBy("target", "output").agg(F.sum((F.col("y") - F.col("p")) ** 2).alias("e"), (F.var_pop("y") * F.count("*")).alias("v"))
        r2 = F.when(F.col("v") > 0, 1 - F.col("e") / F.col("v")).when(F.col("e") > 0, 0.0).otherwise(1.0)
        return s.groupBy("target").agg(F.avg(r2).alias("r2")).join(p.groupBy("target").agg(F.corr("y", "p").alias("r")), "target")
