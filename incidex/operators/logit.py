"""Many logistic regressions at once over baskets of a bounded item list.

Equal rows ``(basket, fold, hits)`` are merged with a weight ``n``; ``hits`` lists the targets that are positive.  A model is a target, the
folds it learns from and the items it may use.  One pass of Spark per Newton step adds up the gradients and Hessians of all models
that have not converged; the driver solves one small system per model.  Loss: mean log loss plus ``reg / 2`` times the squared
coefficients of standardised items (the intercept is free).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidex import skew
from incidex.operators import itemcounts as ic
from incidex.operators.rules import hash_order
from incidex.session import cut_lineage

STEPS = 40


@dataclass(frozen=True)
class Model:
    target: int
    train: frozenset[int]
    test: frozenset[int]
    items: frozenset[int]


def examples(inc: DataFrame, containers: DataFrame, hits: DataFrame, names: Sequence[str], folds: int, seed: str) -> DataFrame:
    """``(basket, fold, hits, n)``; ``hits(container_id, target)`` lists the positives of every target."""
    rows = inc.select("container_id", ic.index_column(names).alias("i")).where("i IS NOT NULL")
    per = rows.groupBy("container_id").agg(F.array_sort(F.collect_set("i")).alias("basket"))
    positive = hits.groupBy("container_id").agg(F.array_sort(F.collect_set("target")).alias("hits"))
    digit = F.conv(F.substring(hash_order(F.col("container_id"), seed), 1, 6), 16, 10).cast("long") % folds
    base = containers.select("container_id", digit.cast("int").alias("fold")).join(per, "container_id", "left").join(positive, "container_id", "left")
    nothing = F.array().cast("array<int>")
    return base.groupBy(F.coalesce("basket", nothing).alias("basket"), "fold", F.coalesce("hits", nothing).alias("hits")).agg(F.count("*").alias("n"))


def _dense(lists: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width))
    sizes = lists.map(len).to_numpy()
    if sizes.sum():
        out[np.repeat(np.arange(len(lists)), sizes), np.concatenate([np.asarray(x, np.int64) for x in lists if len(x)])] = 1.0
    return out


def _added_up(rows: DataFrame, run, n_models: int) -> list[np.ndarray | None]:
    """Sums of the vectors ``(model, v)`` that tasks yield."""
    flat = rows.mapInPandas(run, "model int, v array<double>").select("model", F.posexplode("v").alias("at", "x"))
    sums = flat.groupBy("model", "at").agg(F.sum("x").alias("x")).toPandas()
    out: list[np.ndarray | None] = [None] * n_models
    for m, part in sums.groupby("model"):
        out[m] = part.sort_values("at")["x"].to_numpy()
    return out


def fit(rows: DataFrame, models: Sequence[Model], width: int, n_targets: int, reg: float = 1e-4) -> np.ndarray:
    """Coefficients (intercept last) of every model; NaN where the training rows are of one class."""
    n_folds = 1 + max((f for m in models for f in m.train | m.test), default=0)
    learns = np.array([[f in m.train for f in range(n_folds)] for m in models], float)
    targets = [m.target for m in models]

    def weights(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = np.hstack([_dense(pdf["basket"], width), np.ones((len(pdf), 1))])
        return x, _dense(pdf["hits"], n_targets), pdf["n"].to_numpy(float), pdf["fold"].to_numpy(np.int64)

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(models), width + 3))
        for pdf in batches:
            x, y, n, fold = weights(pdf)
            for m, t in enumerate(targets):
                w = n * learns[m][fold]
                total[m] += np.r_[w @ x, w @ w, w @ y[:, t]]
        yield pd.DataFrame({"model": range(len(models)), "v": list(total)})

    rows = cut_lineage(rows)
    beta = np.full((len(models), width + 1), np.nan)
    if not models or rows.isEmpty():
        return beta
    sums = _added_up(rows, moments, len(models))
    free, ridge, alive = np.zeros((len(models), width + 1), bool), np.zeros((len(models), width + 1)), []
    mass = np.zeros(len(models))
    for m, s in enumerate(sums):
        count, total, squares, positive = s[:width], s[width], s[width + 1], s[width + 2]
        if not 0 < positive < total:
            continue
        spread = total - squares / total
        variance = np.maximum(count - count**2 / total, 0) / spread if spread > 0 else np.zeros(width)
        free[m, :width] = [i in models[m].items and variance[i] > 1e-15 for i in range(width)]
        free[m, width] = True
        ridge[m, :width] = reg * variance
        mass[m] = total
        beta[m] = 0.0
        beta[m, width] = np.log(positive / (total - positive))
        alive.append(m)
    before, loss_before = beta.copy(), np.full(len(models), np.inf)
    for _ in range(STEPS):
        if not alive:
            break
        now, active = beta.copy(), list(alive)

        def newton(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            size = width + 1
            total = np.zeros((len(active), 1 + size + size * size))
            for pdf in batches:
                x, y, n, fold = weights(pdf)
                for k, m in enumerate(active):
                    w, t = n * learns[m][fold], y[:, targets[m]]
                    z = x @ now[m]
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    total[k, 0] += w @ (np.logaddexp(0, z) - t * z)
                    total[k, 1 : 1 + size] += (w * (p - t)) @ x
                    total[k, 1 + size :] += ((x * (w * p * (1 - p))[:, None]).T @ x).ravel()
            yield pd.DataFrame({"model": active, "v": list(total)})

        for m, s in enumerate(_added_up(rows, newton, len(models))):
            if s is None:
                continue
            loss = s[0] / mass[m] + 0.5 * (ridge[m] * beta[m] ** 2).sum()
            if loss > loss_before[m] + 1e-12:  # too far: half way back
                beta[m] = (beta[m] + before[m]) / 2
                continue
            before[m], loss_before[m] = beta[m], loss
            keep = free[m]
            gradient = s[1 : 2 + width] / mass[m] + ridge[m] * beta[m]
            hessian = s[2 + width :].reshape(width + 1, width + 1) / mass[m] + np.diag(ridge[m])
            step = np.zeros(width + 1)
            step[keep] = np.linalg.lstsq(hessian[np.ix_(keep, keep)], gradient[keep], rcond=None)[0]
            beta[m] = beta[m] - step
            if np.abs(step).max() < 1e-9:
                alive.remove(m)
    return beta


def held_out_auc(rows: DataFrame, models: Sequence[Model], beta: np.ndarray, width: int) -> dict[int, float | None]:
    """AUC of every model on its test folds; None where they are of one class or the model has learnt nothing."""
    some = [m for m in range(len(models)) if not np.isnan(beta[m, width])]
    if not some:
        return {}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.hstack([_dense(pdf["basket"], width), np.ones((len(pdf), 1))])
            fold, n = pdf["fold"].to_numpy(), pdf["n"].to_numpy(np.int64)
            for m in some:
                at = np.isin(fold, list(models[m].test))
                if at.any():
                    y = [int(models[m].target in h) for h in pdf["hits"][at]]
                    # sums of the same items in another order differ in the last digits
                    yield pd.DataFrame({"model": m, "y": y, "p": np.round(x[at] @ beta[m], 10), "n": n[at]})

    scored = rows.mapInPandas(score, "model int, y int, p double, n long")
    return {r["model"]: r["auc"] for r in skew.roc_auc(scored, ["model"], "y", "p", weight="n").collect()}


def cross_validated(rows: DataFrame, items: Sequence[frozenset[int]], width: int, folds: int) -> list[float]:
    """Mean held-out AUC of each target over the folds, 0.5 when nothing can be learnt; ``items`` gives what each target may use."""
    rows = cut_lineage(rows)
    every = frozenset(range(folds))
    models = [Model(t, every - {f}, frozenset({f}), some) for t, some in enumerate(items) if some for f in range(folds)]
    found = held_out_auc(rows, models, fit(rows, models, width, len(items)), width)
    per: dict[int, list[float]] = {}
    for m, auc in found.items():
        if auc is not None:
            per.setdefault(models[m].target, []).append(auc)
    return [sum(per[t]) / len(per[t]) if t in per else 0.5 for t in range(len(items))]
