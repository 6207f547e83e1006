"""Rewards, advantages, parameter search and dense layers.

Layers and losses are numpy inside tasks over rows that Spark deals out; weights are small and travel with the function.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .decode import Params, collect_lattice, emission_scores, transition_scores, viterbi


def step_rewards(steps: DataFrame, correct: float = 1.0, legal: float = 0.2, error_weight: float = 0.02, error_cap: float = 25.0, invalid: float = -2.0) -> DataFrame:
    """Adds reward: plus or minus for the edge and for legality, less the capped error; a fixed one for invalid choices.

    Steps have edge_correct, transition_legal, projection_error_m and is_valid.
    """
    sign = lambda name, w: F.when(F.col(name), w).otherwise(-w)
    far = error_weight * F.least(F.coalesce("projection_error_m", F.lit(0.0)), F.lit(error_cap))
    return steps.withColumn("reward", F.when(~F.col("is_valid"), invalid).otherwise(sign("edge_correct", correct) + sign("transition_legal", legal) - far))


def terminal_rewards(steps: DataFrame, success_at: float = 0.9, bonus: float = 2.0, illegal: float = 0.2) -> DataFrame:
    """One reward a trajectory: accuracy, a bonus for success, less the illegal steps."""
    acc = F.avg(F.col("edge_correct").cast("double"))
    bad = F.count_if(~F.col("transition_legal"))
    return steps.groupBy("trajectory_id").agg((acc + F.when(acc >= success_at, bonus).otherwise(0.0) - illegal * bad).alias("terminal_reward"))


def advantages(steps: DataFrame, gamma: float = 0.99, lam: float = 0.95, block: int = 4096) -> DataFrame:
    """Adds advantage and target to (trajectory_id, t, reward, value) by the backward recursion over each trajectory.

    A step maps the advantage after it to its own by an affine map with slope gamma * lam, and so does a block of
    steps. Blocks are mapped each in a task of its own, joined over the few blocks of a trajectory, and then worked
    out from the advantage that follows each: no task holds a long trajectory whole.
    """
    w = Window.partitionBy("trajectory_id").orderBy("t")
    after = F.coalesce(F.lead("value").over(w), F.lit(0.0))
    rows = steps.withColumn("_delta", F.col("reward") + gamma * after - F.col("value"))
    rows = rows.withColumn("_block", F.floor((F.row_number().over(w) - 1) / block))
    own = rows.groupBy("trajectory_id", "_block").agg(F.array_sort(F.collect_list(F.struct("t", "_delta", "value"))).alias("s"))
    decay = gamma * lam
    backward = lambda start, s: F.aggregate(F.reverse(s), start, lambda acc, x: x["_delta"] + decay * acc)
    mapped = own.select("trajectory_id", "_block", F.size("s").alias("n"), backward(F.lit(0.0), F.col("s")).alias("own"))
    chain = mapped.groupBy("trajectory_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("_block", "n", "own")))).alias("b"))

    def entering(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for tid, blocks in zip(part["trajectory_id"], part["b"], strict=True):
                at, out = 0.0, []
                for x in blocks:
                    out.append((tid, x["_block"], at))
                    at = x["own"] + decay ** x["n"] * at
                yield pd.DataFrame(out, columns=["trajectory_id", "_block", "_after"])

    def worked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for tid, s, at in zip(part["trajectory_id"], part["s"], part["_after"], strict=True):
                adv = np.empty(len(s))
                for i in range(len(s) - 1, -1, -1):
                    at = s[i]["_delta"] + decay * at
                    adv[i] = at
                yield pd.DataFrame({"trajectory_id": tid, "t": [x["t"] for x in s], "advantage": adv, "target": adv + np.array([x["value"] for x in s])})

    begun = own.join(chain.mapInPandas(entering, "trajectory_id bigint, _block bigint, _after double"), ["trajectory_id", "_block"])
    return begun.mapInPandas(worked, "trajectory_id bigint, t bigint, advantage double, target double")


def standardised(rows: DataFrame, column: str = "advantage") -> DataFrame:
    """rows with the column less its mean, over its population deviation and 1e-8; as it is where that deviation is nearly 0."""
    about = rows.agg(F.avg(column).alias("_m"), F.stddev_pop(column).alias("_s"))
    wide = rows.crossJoin(F.broadcast(about))  # a single row
    return wide.withColumn(column, F.when(F.col("_s") > 1e-8, (F.col(column) - F.col("_m")) / (F.col("_s") + 1e-8)).otherwise(F.col(column))).drop("_m", "_s")


def emission_losses(scored: DataFrame, score: str = "score", smoothing: float = 0.0, margin: float = 1.0) -> DataFrame:
    """One row for each point whose own edge is a candidate: cross-entropy, hinge against the hardest other, and whether it is first.

    Rows have trajectory_id, t, is_gt and the score. With smoothing, that share of the target is spread over all of the
    point's candidates. A point with one candidate has no other and hinge 0.
    """
    s, own = F.col(score), F.col("is_gt") == 1
    top = F.max(score).over(Window.partitionBy("trajectory_id", "t"))
    shifted = scored.withColumn("_top", top)
    by = shifted.groupBy("trajectory_id", "t").agg(
        (F.log(F.sum(F.exp(s - F.col("_top")))) + F.first("_top")).alias("z"), F.max(F.when(own, s)).alias("gt"), F.max(F.when(~own, s)).alias("hard"), F.avg(s).alias("mean"),
    ).where("gt IS NOT NULL")
    target = (1 - smoothing) * F.col("gt") + smoothing * F.col("mean")
    hinge = F.coalesce(F.greatest(margin - (F.col("gt") - F.col("hard")), F.lit(0.0)), F.lit(0.0))
    return by.select("trajectory_id", "t", (F.col("z") - target).alias("cross_entropy"), hinge.alias("hinge"), F.coalesce(F.col("gt") >= F.col("hard"), F.lit(True)).cast("int").alias("correct"))


def running_mean(values: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """The weighted mean of a value by keys; weights that add up to less than 1 count as 1."""
    total = F.sum(F.col(value) * F.col(weight))
    return values.groupBy(*keys).agg((total / F.greatest(F.sum(weight), F.lit(1.0))).alias("mean"), F.sum(weight).alias("weight"))


def grid(space: dict[str, list[float]]) -> list[dict[str, float]]:
    """All combinations of the values, the last name varying fastest."""
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


def grid_search(emission_features: DataFrame, transition_features: DataFrame, truth: DataFrame, space: dict[str, list[float]], base: Params = Params(), k: int = 10) -> DataFrame:
    """Point accuracy of every combination of parameters: (trial, parameters, points, accuracy).

    The features are read once: every trial's scores are columns beside the others', and all lattices are decoded in
    one job, a trial and a trajectory making a sequence of their own. truth has gt_rank.
    """
    trials = grid(space)
    names = ["; ".join(f"{n}={v:g}" for n, v in values.items()) for values in trials]
    numbered = lambda columns: F.posexplode(F.array(*columns))
    e, a = emission_features, transition_features
    for i, values in enumerate(trials):
        p = replace(base, **values)
        e = emission_scores(e, p, k).withColumnRenamed("emission", f"_e{i}").drop("sigma", "n_candidates")
        a = transition_scores(a, p).withColumnRenamed("transition", f"_a{i}")
    own = (F.col("trajectory_id") * len(trials) + F.col("trial")).alias("trajectory_id")
    e = e.select("trajectory_id", "t", "candidate_rank", numbered([F.col(f"_e{i}") for i in range(len(trials))]).alias("trial", "emission"))
    a = a.select("trajectory_id", "step", "prev_rank", "curr_rank", numbered([F.col(f"_a{i}") for i in range(len(trials))]).alias("trial", "transition"))
    lattice = collect_lattice(e.select(own, "t", "candidate_rank", "emission"), a.select(own, "step", "prev_rank", "curr_rank", "transition"))
    trial = F.pmod("trajectory_id", F.lit(len(trials))).cast("int")
    paths = viterbi(lattice, k).select(((F.col("trajectory_id") - trial) / len(trials)).cast("bigint").alias("trajectory_id"), trial.alias("trial"), "t", F.col("candidate_rank").alias("rank"))
    scored = paths.join(truth.select("trajectory_id", "t", "gt_rank"), ["trajectory_id", "t"]).where("gt_rank >= 0")
    found = scored.groupBy("trial").agg(F.count("*").alias("points"), F.avg((F.col("rank") == F.col("gt_rank")).cast("double")).alias("accuracy"))
    return found.withColumn("parameters", F.array(*[F.lit(n) for n in names])[F.col("trial")])


def best_trial(trials: DataFrame) -> DataFrame:
    """The first trial with the greatest accuracy."""
    return trials.orderBy(F.desc("accuracy"), "trial").limit(1)


def layer_norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5)


def forward(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Linear layers, each but the last with normalisation and rectification."""
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(layer_norm(x), 0)
    return x


def seeded_layers(sizes: tuple[int, ...], seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Starting weights of a stack of layers."""
    r = np.random.default_rng(seed)
    return [(r.normal(0, 1 / np.sqrt(a), (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def layer_scores(df: DataFrame, features: str, layers: list[tuple[np.ndarray, np.ndarray]], name: str = "score") -> DataFrame:
    """Adds the one output of a stack of layers over an array column."""

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(forward(np.stack(part.to_list()).astype(float), layers)[:, 0] if len(part) else np.zeros(0))

    return df.withColumn(name, of(F.col(features)))


def gather_layer(features: DataFrame, pairs: DataFrame, own: np.ndarray, from_before: np.ndarray, bias: np.ndarray) -> DataFrame:
    """A mean-gathering graph layer over rows (edge_idx, x array): from_before on the mean of predecessors, own on itself."""
    width = own.shape[0]
    each = pairs.join(features.select(F.col("edge_idx").alias("prev_edge_idx"), "x"), "prev_edge_idx")
    mean = each.groupBy(F.col("curr_edge_idx").alias("edge_idx")).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("mean"))
    joined = features.join(mean, "edge_idx", "left").withColumn("mean", F.coalesce("mean", F.array_repeat(F.lit(0.0), width)))

    @F.pandas_udf("array<double>")
    def of(x: pd.Series, m: pd.Series) -> pd.Series:
        out = np.stack(x.to_list()) @ own + np.stack(m.to_list()) @ from_before + bias
        return pd.Series(list(np.maximum(layer_norm(out), 0)))

    return joined.select("edge_idx", of("x", "mean").alias("x"))


def cross_entropy(scores: DataFrame) -> DataFrame:
    """One row: the mean of the log of a step's summed exponentials less its own candidate's score, over labelled steps."""
    w = Window.partitionBy("trajectory_id", "t")
    top = F.max("score").over(w)
    total = F.log(F.sum(F.exp(F.col("score") - top)).over(w)) + top
    own = scores.withColumn("loss", total - F.col("score")).where("is_gt = 1")
    return own.agg(F.count("*").alias("points"), F.avg("loss").alias("loss"))


def labelled_steps(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row for each labelled step: x, its candidates' features as an array of arrays in order of rank, and gt, the true one's place."""
    x = F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
    rows = features.groupBy("trajectory_id", "t").agg(F.array_sort(F.collect_list(F.struct("candidate_rank", x.alias("x"), "is_gt"))).alias("c"))
    gt = F.array_position(F.col("c.is_gt"), F.lit(1)) - 1
    return rows.select("trajectory_id", "t", F.col("c.x").alias("x"), gt.cast("int").alias("gt")).where("gt >= 0")


def train_scorer(steps: DataFrame, width: int, epochs: int = 20, rate: float = 0.05, decay: float = 1e-4, clip: float = 5.0) -> tuple[np.ndarray, list[float]]:
    """Weights of a linear score whose softmax over a step's candidates picks the true one, and the loss by epoch.

    Every epoch is one pass over labelled_steps: tasks add up the gradients of their rows, and the driver gets one
    row of sums from each task. Steps by Adam with decoupled decay; the gradient's norm is clipped.
    """
    w, m, v, losses = np.zeros(width), np.zeros(width), np.zeros(width), []
    for epoch in range(1, epochs + 1):

        def gradients(parts: Iterator[pd.DataFrame], w: np.ndarray = w) -> Iterator[pd.DataFrame]:
            total, loss, n = np.zeros(len(w)), 0.0, 0
            for part in parts:
                for x, gt in zip(part["x"], part["gt"], strict=True):
                    x = np.stack(x)
                    s = x @ w
                    p = np.exp(s - s.max())
                    p /= p.sum()
                    total += p @ x - x[gt]
                    loss -= np.log(max(p[gt], 1e-12))
                    n += 1
            yield pd.DataFrame({"g": [total], "loss": [loss], "n": [n]})

        sums = steps.select("x", "gt").mapInPandas(gradients, "g array<double>, loss double, n bigint").toPandas()
        n = max(int(sums["n"].sum()), 1)
        g = np.sum(np.stack(sums["g"].to_list()), axis=0) / n
        losses.append(float(sums["loss"].sum()) / n)
        g *= min(1.0, clip / max(np.linalg.norm(g), 1e-12))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**epoch) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8) + decay * w)
    return w, losses


def linear_scores(features: DataFrame, names: tuple[str, ...], weights: np.ndarray) -> DataFrame:
    """Adds score: the weighted sum of the named columns, as one expression."""
    terms = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) * float(w) for n, w in zip(names, weights, strict=True)]
    return features.withColumn("score", sum(terms[1:], terms[0]))


def rollouts(steps: DataFrame, weights: np.ndarray, seed: int = 0) -> DataFrame:
    """Candidates drawn from the softmax of a linear score, each trajectory on its own: (trajectory_id, t, action, log_p, is_right)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for tid, t, x, gt in zip(part["trajectory_id"], part["t"], part["x"], part["gt"], strict=True):
                s = np.stack(x) @ weights
                p = np.exp(s - s.max())
                p /= p.sum()
                a = int(np.random.default_rng([seed, int(tid) & 0x7FFFFFFF, int(t)]).choice(len(p), p=p))
                rows.append((tid, t, a, float(np.log(p[a])), a == gt))
            yield pd.DataFrame(rows, columns=["trajectory_id", "t", "action", "log_p", "is_right"])

    return steps.mapInPandas(run, "trajectory_id bigint, t bigint, action int, log_p double, is_right boolean")


def improve_policy(steps: DataFrame, weights: np.ndarray, epochs: int = 3, rate: float = 0.5, clip: float = 0.2, entropy: float = 0.01, seed: int = 0) -> np.ndarray:
    """Clipped policy steps on one set of rollouts: reward 1 or -1 for the edge, advantages by the backward pass.

    The rollouts are weighed by the ratio of new to old probability, which counts no further than the clip allows.
    Gradients are added up by task, as in train_scorer.
    """
    drawn = rollouts(steps, weights, seed).withColumn("reward", F.when(F.col("is_right"), 1.0).otherwise(-1.0)).withColumn("value", F.lit(0.0))
    scored = drawn.join(advantages(drawn.select("trajectory_id", "t", "reward", "value"), gamma=0.0), ["trajectory_id", "t"])
    rows = steps.join(scored.select("trajectory_id", "t", "action", "log_p", "advantage"), ["trajectory_id", "t"])
    for _ in range(epochs):

        def gradients(parts: Iterator[pd.DataFrame], w: np.ndarray = weights) -> Iterator[pd.DataFrame]:
            total, n = np.zeros(len(w)), 0
            for part in parts:
                for x, a, old, adv in zip(part["x"], part["action"], part["log_p"], part["advantage"], strict=True):
                    x = np.stack(x)
                    s = x @ w
                    p = np.exp(s - s.max())
                    p /= p.sum()
                    ratio = np.exp(np.log(max(p[a], 1e-12)) - old)
                    mean = p @ x
                    if not (adv > 0 and ratio > 1 + clip or adv < 0 and ratio < 1 - clip):
                        total += adv * ratio * (x[a] - mean)
                    logs = np.log(np.maximum(p, 1e-12))
                    total -= entropy * ((p * (logs - p @ logs)) @ x)
                    n += 1
            yield pd.DataFrame({"g": [total], "n": [n]})

        sums = rows.select("x", "action", "log_p", "advantage").mapInPandas(gradients, "g array<double>, n bigint").toPandas()
        weights = weights + rate * np.sum(np.stack(sums["g"].to_list()), axis=0) / max(int(sums["n"].sum()), 1)
    return weights
