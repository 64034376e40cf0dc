"""Walk-forward forecasts: training sets, ridge by sums of squares and products, scores, weights.

A decision's training set is a range of earlier decisions, and ridge needs only sums over
it. So rows are summed once per decision (all tickers at once, combined on the map side), the
sums are added up along the decisions, and a refit's sums are the difference of two of those
running sums: no refit meets the decisions it learns from. One solve of a small matrix is
left for each refit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import log_vol_label, vol_of_label


def training_windows(schedule: DataFrame, embargo: int = 1, window_days: int | None = 756) -> DataFrame:
    """(refit_idx, lo, hi): the range of decisions that each decision may learn from; lo > hi where there is none.

    schedule: decision_idx, decision_date, next_fill (labels.intervals_of). A decision j
    serves i if it lies ``embargo`` intervals back, its interval has ended before i, and it
    is at most ``window_days`` calendar days old (null: no limit). Dates rise with the
    decisions, so these are ranges: two running values over the calendar, one row a decision.
    """
    day = F.unix_date("decision_date")
    near = Window.orderBy(day).rangeBetween(-window_days, 0) if window_days is not None else Window.orderBy(day).rangeBetween(Window.unboundedPreceding, 0)
    i = schedule.select("decision_idx", "decision_date", F.min("decision_idx").over(near).alias("lo"))
    ended = schedule.where("next_fill is not null").select(F.col("next_fill").alias("at"), F.lit(1).alias("side"), F.col("decision_idx").alias("done"))
    asked = i.select(F.col("decision_date").alias("at"), F.lit(0).alias("side"), F.col("decision_idx").alias("refit_idx"), "lo")
    done = F.max("done").over(Window.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # an end on the day itself comes too late
    both = asked.unionByName(ended, allowMissingColumns=True).withColumn("done", done).where("refit_idx is not null")
    return both.select("refit_idx", "lo", F.least(F.coalesce("done", F.lit(-1)), F.col("refit_idx") - 1 - embargo).cast("int").alias("hi"))


def training_sets(schedule: DataFrame, embargo: int = 1, window_days: int | None = 756) -> DataFrame:
    """(refit_idx, decision_idx): the ranges of ``training_windows`` decision by decision."""
    w = training_windows(schedule, embargo, window_days)
    return w.where("lo <= hi").select("refit_idx", F.explode(F.sequence("lo", "hi")).alias("decision_idx"))


def window_sums(per: DataFrame, windows: DataFrame, names: list[str]) -> DataFrame:
    """(refit_idx, names): sums of per (decision_idx, names) over each window, as differences of running sums.

    One row a decision; decisions without a row count as zero. A difference of sums of doubles
    is off by about 2**-53 times the running sum at its end, so relative to the window by
    that times (all history / window).
    """
    order = Window.orderBy("decision_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = per.select("decision_idx", *[F.sum(n).over(order).alias(n) for n in names])
    # The last decision with a row at or before a place, and so the running sum there.
    places = windows.where("lo <= hi").select("refit_idx", F.explode(F.array(F.struct(F.col("hi").alias("at"), F.lit(1).alias("sign")), F.struct((F.col("lo") - 1).alias("at"), F.lit(-1).alias("sign")))).alias("x")).select("refit_idx", "x.at", "x.sign")
    known = F.last("s", ignorenulls=True).over(Window.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = total.select(F.col("decision_idx").alias("at"), F.lit(0).alias("side"), F.struct(*names).alias("s")).unionByName(places.withColumn("side", F.lit(1)), allowMissingColumns=True)
    met = rows.withColumn("s", known).where("side = 1")
    return met.groupBy("refit_idx").agg(*[F.sum(F.col("sign") * F.coalesce(F.col(f"s.{n}"), F.lit(0))).alias(n) for n in names])


def training_rows(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(refit_idx, decision_idx, ticker, ..): rows of the decisions that each refit may learn from."""
    return sets.join(rows, "decision_idx")


def refit_flags(counts: DataFrame, min_rows: int = 200, every: int = 1) -> DataFrame:
    """counts (refit_idx, rows) with refit: the first decision with enough rows and each ``every``-th after it (0: none after it)."""
    first = F.min(F.when(F.col("rows") >= min_rows, F.col("refit_idx"))).over(Window.partitionBy())  # one row a decision
    since = F.col("refit_idx") - first
    again = (since % every == 0) if every else (since == 0)
    return counts.withColumn("refit", F.coalesce((since >= 0) & again & (F.col("rows") >= min_rows), F.lit(False)))


def _moments(features: list[str], label: str) -> dict[str, Column]:
    x = [F.lit(1.0), *[F.col(f) for f in features], F.col(label)]
    return {f"g_{a}_{b}": x[a] * x[b] for a in range(len(x)) for b in range(a, len(x))}


def ridge_walkforward(rows: DataFrame, windows: DataFrame, features: list[str], label: str = "label", alpha: float = 1.0, min_rows: int = 200, every: int = 1) -> DataFrame:
    """(refit_idx, rows, coefs): intercept and weights of each refit, from rows (decision_idx, features, label).

    windows: those of ``training_windows``. coefs = (X'X + alpha I)^-1 X'y with the intercept
    free; rows with a null are left out.
    """
    g = _moments(features, label)
    full = rows.dropna(subset=[*features, label]).groupBy("decision_idx").agg(F.count("*").alias("rows"), *[F.sum(c).alias(n) for n, c in g.items()])
    per = window_sums(full, windows, ["rows", *g])
    flagged = refit_flags(per.where("rows > 0"), min_rows, every).where("refit").select("refit_idx", "rows", F.array(*g).alias("g"))
    k = len(features) + 2
    upper = np.triu_indices(k)

    def solve(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for v in b.column("g").to_pylist():
                m = np.zeros((k, k))
                m[upper] = v
                m = m + np.triu(m, 1).T
                a = m[:-1, :-1] + alpha * np.diag([0.0] + [1.0] * (k - 2))
                out.append(np.linalg.solve(a, m[:-1, -1]))
            yield pa.RecordBatch.from_arrays([b.column("refit_idx"), b.column("rows"), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], names=["refit_idx", "rows", "coefs"])

    return flagged.mapInArrow(solve, "refit_idx int, rows long, coefs array<double>")


def gbt_fit(rows: DataFrame, features: list[str], label: str = "label", depth: int = 3, rounds: int = 200, rate: float = 0.1, seed: int = 42):
    """Boosted trees on squared error by Spark ML; returns the model, whose transform adds ``prediction``."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.dropna(subset=[*features, label]))
    return GBTRegressor(featuresCol="_x", labelCol=label, maxDepth=depth, stepSize=rate, maxIter=rounds, seed=seed).fit(x.select("_x", F.col(label).cast("double")))


def gbt_predict(model, rows: DataFrame, features: list[str]) -> DataFrame:
    """rows with ``predicted``."""
    from pyspark.ml.feature import VectorAssembler

    x = VectorAssembler(inputCols=features, outputCol="_x").transform(rows.dropna(subset=features))
    return model.transform(x).withColumnRenamed("prediction", "predicted").drop("_x")


def gbt_walkforward_distributed(rows: DataFrame, sets: DataFrame, refits: list[int], features: list[str], label: str = "label", **params) -> DataFrame:
    """rows with ``predicted`` of the model of the last refit before or at their decision; one distributed fit a refit, for training sets that no task can hold."""
    out = None
    for n, i in enumerate(refits):
        model = gbt_fit(sets.where(F.col("refit_idx") == i).join(rows, "decision_idx"), features, label, **params)
        until = F.lit(True) if n + 1 == len(refits) else F.col("decision_idx") < refits[n + 1]
        part = gbt_predict(model, rows.where((F.col("decision_idx") >= i) & until), features)
        out = part if out is None else out.unionByName(part)
    return out


class BoostedTrees:
    """Boosted regression trees on binned features: squared error, sums of residuals by node, feature and bin, one level at a time.

    A feature's bins are cut at quantiles of the rows it is fitted on. Of equal gains the first
    feature and lowest cut count. A leaf is the sum of residuals over rows + ``ridge``.
    """

    def __init__(self, depth: int = 3, rounds: int = 100, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, min_gain: float = 1e-12):
        self.depth, self.rounds, self.rate, self.bins, self.ridge, self.min_gain = depth, rounds, rate, bins, ridge, min_gain

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.arange(1, self.bins) / self.bins)) for c in x.T]
        codes, self.base, self.trees = self.codes(x), float(y.mean()), []
        left = y - self.base
        for _ in range(self.rounds):
            node, cuts = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                feature, cut = self._splits(codes, left, node, 1 << level)
                cuts.append((feature, cut))
                node = 2 * node + (codes[np.arange(len(y)), feature[node]] > cut[node])
            n, s = np.bincount(node, minlength=1 << self.depth), np.bincount(node, left, 1 << self.depth)
            leaf = self.rate * s / (n + self.ridge)
            self.trees.append((cuts, leaf))
            left = left - leaf[node]
        return self

    def _splits(self, codes, left, node, nodes) -> tuple[np.ndarray, np.ndarray]:
        """Feature and bin of each node's best cut; a cut after the last bin where none is worth it."""
        feature, cut, best = np.zeros(nodes, np.int64), np.full(nodes, self.bins), np.full(nodes, self.min_gain)
        for f in range(codes.shape[1]):
            at = node * self.bins + codes[:, f]
            n = np.bincount(at, minlength=nodes * self.bins).reshape(nodes, -1).cumsum(axis=1)
            s = np.bincount(at, left, nodes * self.bins).reshape(nodes, -1).cumsum(axis=1)
            all_n, all_s = n[:, -1:], s[:, -1:]
            worth = lambda total, k: total * total / (k + self.ridge)
            gain = np.where((n > 0) & (n < all_n), worth(s, n) + worth(all_s - s, all_n - n) - worth(all_s, all_n), -np.inf)
            c = gain.argmax(axis=1)
            g = gain[np.arange(nodes), c]
            better = g > best + 1e-12
            feature[better], cut[better], best[better] = f, c[better], g[better]
        return feature, cut

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes, out, row = self.codes(x), np.full(len(x), self.base), np.arange(len(x))
        for cuts, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in cuts:
                node = 2 * node + (codes[row, feature[node]] > cut[node])
            out += leaf[node]
        return out


def gbt_walkforward(rows: DataFrame, windows: DataFrame, features: list[str], label: str = "label", min_rows: int = 200, every: int = 1, most_rows: int = 4_000_000, **trees) -> DataFrame:
    """(decision_idx, ticker, refit_idx, predicted): boosted trees of the last refit before or at each decision, all refits in one job.

    rows: decision_idx, ticker, features, label (null: to be forecast only). windows: those of
    ``training_windows``. Every refit is one group of rows: those of its window, and those it
    forecasts, up to the next refit. Groups are fitted side by side, one task each; a window
    bounds a group by its days times the tickers. A group of more than ``most_rows`` rows is
    an error, and ``gbt_walkforward_distributed`` the way for it. trees: see BoostedTrees.
    """
    x = [F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)]
    r = rows.dropna(subset=features).select("decision_idx", "ticker", *x, F.col(label).cast("double").alias("_y"))
    per = r.where("_y is not null").groupBy("decision_idx").agg(F.count("*").alias("rows"))
    flagged = refit_flags(window_sums(per, windows, ["rows"]).where("rows > 0"), min_rows, every).where("refit").select("refit_idx")
    member = windows.join(flagged, "refit_idx").where("lo <= hi").select("refit_idx", F.explode(F.sequence("lo", "hi")).alias("decision_idx"), F.lit(True).alias("_fit"))
    days = r.select("decision_idx").distinct().join(flagged.select(F.col("refit_idx").alias("decision_idx"), F.col("refit_idx").alias("at")), "decision_idx", "full")
    now = days.withColumn("refit_idx", F.last("at", ignorenulls=True).over(Window.orderBy("decision_idx"))).where("refit_idx is not null").select("refit_idx", "decision_idx", F.lit(False).alias("_fit"))
    both = member.unionByName(now).join(r, "decision_idx").where("_y is not null or not _fit")

    def fit(table):
        import pyarrow as pa

        if table.num_rows > most_rows:
            raise ValueError(f"a refit has {table.num_rows} rows, more than {most_rows}: use gbt_walkforward_distributed")
        table = table.sort_by([("decision_idx", "ascending"), ("ticker", "ascending")])
        xs = np.stack([table.column(f"_x{i}").to_numpy() for i in range(len(features))], axis=1)
        use = table.column("_fit").to_numpy(zero_copy_only=False)
        ask = table.filter(pa.array(~use))
        model = BoostedTrees(**trees).fit(xs[use], table.column("_y").to_numpy()[use])
        return pa.table({"decision_idx": ask.column("decision_idx").cast(pa.int32()), "ticker": ask.column("ticker"), "refit_idx": ask.column("refit_idx").cast(pa.int32()), "predicted": pa.array(model.predict(xs[~use]))})

    return both.groupBy("refit_idx").applyInArrow(fit, "decision_idx int, ticker string, refit_idx int, predicted double")


def predict(rows: DataFrame, coefs: DataFrame, features: list[str]) -> DataFrame:
    """rows (decision_idx, features) with ``predicted`` by the model of the last refit; none before the first."""
    days = rows.select("decision_idx").distinct().join(coefs.select(F.col("refit_idx").alias("decision_idx"), "coefs"), "decision_idx", "full")
    now = days.withColumn("coefs", F.last("coefs", ignorenulls=True).over(Window.orderBy("decision_idx"))).where("coefs is not null")
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in features])
    dot = F.aggregate(F.zip_with(x, "coefs", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return rows.dropna(subset=features).join(now, "decision_idx").withColumn("predicted", dot).drop("coefs")


def score_forecasts(kind: str, mu: DataFrame | None = None, sigma: DataFrame | None = None, cost_bps: float = 5.0) -> DataFrame:
    """decision_idx, decision_date, ticker, mu, sigma, expected_cost, net_edge, score. kind: return, vol or rar.

    mu and sigma: decision_idx, decision_date, ticker, predicted. rar needs both forecasts of a ticker.
    """
    key, cost = ["decision_idx", "decision_date", "ticker"], F.lit(cost_bps / 1e4)
    if kind == "vol":
        return sigma.select(*key, F.lit(None).cast("double").alias("mu"), F.col("predicted").alias("sigma"), F.lit(0.0).alias("expected_cost"), F.lit(0.0).alias("net_edge"), (1 / F.greatest("predicted", F.lit(1e-6))).alias("score"))
    f = mu.select(*key, F.col("predicted").alias("mu"))
    f = f.join(sigma.select("decision_idx", "ticker", F.col("predicted").alias("sigma")), ["decision_idx", "ticker"]) if kind == "rar" else f.withColumn("sigma", F.lit(None).cast("double"))
    edge = F.col("mu") - cost
    return f.select(*key, "mu", "sigma", cost.alias("expected_cost"), edge.alias("net_edge"), (edge / F.greatest("sigma", F.lit(1e-6)) if kind == "rar" else edge).alias("score"))


def select_weights(forecasts: DataFrame, kind: str, top_k: int = 3, edge_floor: float = 0.0, weighting: str = "equal") -> DataFrame:
    """forecasts with selected and weight: the top_k by score, none where the best net edge is not above the floor (return and rar).

    weighting: equal, score_softmax (return, rar) or inv_vol (vol). Ties go to the first of
    ``universe_order``, if there is one, then ticker.
    """
    day = Window.partitionBy("decision_idx")
    order = [F.desc("score"), *(["universe_order"] if "universe_order" in forecasts.columns else []), "ticker"]
    f = forecasts.withColumn("_k", F.row_number().over(day.orderBy(*order))).withColumn("_edge", F.max("net_edge").over(day))
    live = F.lit(True) if kind == "vol" else F.col("_edge") > edge_floor
    f = f.withColumn("selected", live & (F.col("_k") <= top_k))
    own = F.when(F.col("selected"), F.col("score"))
    raw = F.exp(own - F.max(own).over(day)) if weighting == "score_softmax" else own if weighting == "inv_vol" else F.when(F.col("selected"), 1.0)
    return f.withColumn("_w", raw).withColumn("weight", F.when(F.col("selected"), F.col("_w") / F.sum("_w").over(day))).drop("_k", "_edge", "_w")


def attach_actuals(forecasts: DataFrame, returns: DataFrame, vols: DataFrame) -> DataFrame:
    """forecasts with actual_return, actual_volatility and actual_rar to the next fill; null where not known."""
    r = returns.select("decision_idx", "ticker", F.col("ret").alias("actual_return"))
    v = vols.select("decision_idx", "ticker", F.col("vol").alias("actual_volatility"))
    rar = F.when(F.col("actual_volatility") > 0, (F.col("actual_return") - F.col("expected_cost")) / F.col("actual_volatility"))
    return forecasts.join(r, ["decision_idx", "ticker"], "left").join(v, ["decision_idx", "ticker"], "left").withColumn("actual_rar", rar)


def ml_strategy(kind: str, features: DataFrame, schedule: DataFrame, labels: DataFrame, names: list[str], vols: DataFrame | None = None, cost_bps: float = 5.0, top_k: int = 3, edge_floor: float = 0.0, weighting: str = "equal", embargo: int = 1, window_days: int | None = 756, **ridge) -> DataFrame:
    """Forecasts with weights of a ridge strategy: kind return, vol or rar.

    features: decision_idx, decision_date, ticker and ``names``; labels: decision_idx, ticker,
    ret; vols (for vol and rar): decision_idx, ticker, vol, learned as logs.
    """
    windows = training_windows(schedule, embargo, window_days)

    def forecast(label: DataFrame) -> DataFrame:
        return predict(features, ridge_walkforward(features.join(label, ["decision_idx", "ticker"]), windows, names, **ridge), names)

    mu = forecast(labels.select("decision_idx", "ticker", F.col("ret").alias("label"))) if kind != "vol" else None
    sigma = None
    if kind != "return":
        sigma = forecast(vols.select("decision_idx", "ticker", log_vol_label(F.col("vol")).alias("label"))).withColumn("predicted", vol_of_label(F.col("predicted")))
    return select_weights(score_forecasts(kind, mu, sigma, cost_bps), kind, top_k, edge_floor, weighting)


def ml_grid(base: str, windows: list[int], expanding: bool = False, embargo: list[int] | None = None, fixed: dict | None = None) -> list[dict]:
    """Specs of a learned strategy, one a combination: name, train_window_days, expanding, embargo_intervals.

    Axes that ``fixed`` sets are no axes. A name is base_key=value_key=value over the axes, in that order.
    """
    from itertools import product

    fixed = fixed or {}
    axes = {k: v for k, v in {"train_window_days": windows, "expanding": [False, True] if expanding else [False], "embargo_intervals": embargo or [1]}.items() if k not in fixed}
    return [dict(fixed) | dict(zip(axes, values, strict=True)) | {"name": "_".join([base, *[f"{k}={v}" for k, v in zip(axes, values, strict=True)]])} for values in product(*axes.values())]
