"""Scores of the hidden Markov model and the sequences they favour.

Scores are column expressions over candidate and pair rows. A trajectory's lattice is collected into blocks of steps.
A block maps what is known of the states before it to what is known at its end; only these small maps of a trajectory's
blocks meet in one task, which tells each block its borders, and then every block is decoded on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settle

MASKED = -1e9
OFFROAD = -999999


@dataclass(frozen=True)
class Params:
    """Weights of the scores."""

    # The defaults of the model.
    emission_scale: float = 1.0
    distance_weight: float = 3.0
    log_distance_weight: float = 0.8
    yaw_weight: float = 1.2
    rank_weight: float = 1.2
    speed_consistency_weight: float = 0.15
    oneway_weight: float = 0.05
    road_class_prior_weight: float = 0.15
    candidate_density_weight: float = 0.10
    yaw_reliability_weight: float = 0.35
    adaptive_sigma: bool = True
    sigma_base: float = 0.35
    sigma_min: float = 0.20
    sigma_max: float = 2.50
    sigma_speed_weight: float = 0.30
    sigma_ambiguity_weight: float = 0.40
    sigma_yaw_unreliable_weight: float = 0.30
    transition_scale: float = 0.35
    legal_bonus: float = 0.35
    illegal_penalty: float = 2.0
    same_edge_bonus: float = 0.35
    same_osm_way_bonus: float = 0.15
    same_road_class_bonus: float = 0.05
    route_distance_weight: float = 0.25
    route_gps_ratio_weight: float = 0.10
    route_minus_gps_weight: float = 0.15
    turn_weight: float = 0.10
    yaw_change_weight: float = 0.05
    uturn_penalty: float = 0.50
    sharp_turn_speed_weight: float = 0.25
    time_feasible_bonus: float = 0.10
    time_infeasible_penalty: float = 0.50
    rank_delta_weight: float = 0.05
    distance_delta_weight: float = 0.05
    offroad_emission: float = -5.0
    offroad_enter: float = 3.0
    offroad_exit: float = 2.0
    offroad_stay: float = 0.5


def _at_least_0(name: str) -> Column:
    return F.greatest(F.col(name), F.lit(0.0))


def _unit(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def emission_scores(features: DataFrame, p: Params = Params(), k: int = 10) -> DataFrame:
    """Adds sigma and emission: how well a candidate fits its point.

    The spread grows with slowness, with the number of candidates and with unreliable headings; its averages run over
    all k slots, empty ones being zero.
    """
    w = Window.partitionBy("trajectory_id", "t")
    n = F.count("*").over(w)
    speed, reliable = F.sum("speed_norm").over(w) / k, F.sum(_unit(F.col("yaw_reliability"))).over(w) / k
    spread = p.sigma_base + p.sigma_speed_weight * (1 - _unit(speed)) + p.sigma_ambiguity_weight * (n / k) + p.sigma_yaw_unreliable_weight * (1 - reliable)
    out = features.withColumn("sigma", F.least(F.greatest(spread, F.lit(p.sigma_min)), F.lit(p.sigma_max))).withColumn("n_candidates", n)
    d = _at_least_0("distance_norm")
    near = -0.5 * F.pow(d / F.col("sigma"), F.lit(2)) - F.log("sigma") if p.adaptive_sigma else -d
    heading = (p.yaw_reliability_weight + (1 - p.yaw_reliability_weight) * _unit(F.col("yaw_reliability"))) * (0.25 + 0.75 * _unit(F.col("speed_norm")))
    prior = F.coalesce(F.col("road_class_prior"), F.lit(0.0)) if "road_class_prior" in features.columns else F.lit(0.0)
    score = (
        p.distance_weight * near - p.log_distance_weight * _at_least_0("log_distance_norm") - p.yaw_weight * _at_least_0("abs_yaw_diff_norm") * heading
        - p.rank_weight * _at_least_0("candidate_rank_norm") - p.speed_consistency_weight * _at_least_0("speed_consistency")
        + p.oneway_weight * _at_least_0("oneway") + p.road_class_prior_weight * prior - p.candidate_density_weight * (F.col("n_candidates") / k)
    )
    return out.withColumn("emission", p.emission_scale * score)


def basic_emission_scores(features: DataFrame, p: Params = Params(), bias: float = 0.0) -> DataFrame:
    """Adds emission by the basic form: linear in the distance, without spread, density and speed."""
    heading = _at_least_0("abs_yaw_diff_norm") * (p.yaw_reliability_weight + (1 - p.yaw_reliability_weight) * _unit(F.col("yaw_reliability")))
    score = (
        bias - p.distance_weight * _at_least_0("distance_norm") - p.log_distance_weight * _at_least_0("log_distance_norm") - p.yaw_weight * heading
        - p.rank_weight * _at_least_0("candidate_rank_norm") - p.speed_consistency_weight * _at_least_0("speed_consistency") + p.oneway_weight * _at_least_0("oneway")
    )
    return features.withColumn("emission", p.emission_scale * score)


def constrained(raw: DataFrame, scores: str = "score", penalty: str | None = None, dt_s: str | None = None, jumps: bool = False, legal: bool = True, max_route_m: float = 300.0, max_speed_mps: float = 70.0) -> DataFrame:
    """Adds mask and constrained: a pair's score plus its penalty where the pair may be, else the masked score.

    A pair may be if it is connected (unless jumps are allowed) and legal, if its route is short enough and, where the
    time is known, can be driven in it. raw has is_connected, is_legal and projection_distance_m.
    """
    route, mask = F.col("projection_distance_m"), F.lit(True)
    if not jumps:
        mask = mask & (F.col("is_connected") > 0.5)
    if legal:
        mask = mask & (F.col("is_legal") > 0.5)
    mask = mask & (route <= max_route_m)
    if dt_s:
        mask = mask & (route <= F.greatest(F.col(dt_s), F.lit(0.0)) * max_speed_mps)
    score = F.col(scores) + F.col(penalty) if penalty else F.col(scores)
    return raw.withColumn("mask", mask).withColumn("constrained", F.when(mask, score).otherwise(MASKED))


def transition_scores(features: DataFrame, p: Params = Params(), mode: str = "soft") -> DataFrame:
    """Adds transition: how well two candidates follow each other; features must have allowed.

    Pairs that aren't allowed lose the scaled penalty once more (soft), get the masked score (hard), or are left (none).
    """
    c = F.col
    legal = ((c("legal") == 1) | (c("same_edge") == 1) | (c("connected") == 1)).cast("double")
    ok = c("time_feasible").cast("double")
    uturn, sharp = (c("turn_norm") > 0.85).cast("double"), (c("turn_norm") > 0.65).cast("double")
    score = (
        p.legal_bonus * legal + p.same_edge_bonus * c("same_edge") + p.same_osm_way_bonus * c("same_osm_way") + p.same_road_class_bonus * c("same_road_class")
        + p.time_feasible_bonus * ok - p.illegal_penalty * (1 - legal) - p.time_infeasible_penalty * (1 - ok) - p.route_distance_weight * c("route_dist_norm")
        - p.route_minus_gps_weight * c("route_minus_gps_norm") - p.route_gps_ratio_weight * c("route_gps_ratio_norm") - p.turn_weight * c("turn_norm")
        - p.yaw_change_weight * c("yaw_change_norm") - p.uturn_penalty * uturn - p.sharp_turn_speed_weight * sharp * ok
        - p.rank_delta_weight * c("candidate_rank_delta_norm") - p.distance_delta_weight * c("distance_delta_norm")
    ) * p.transition_scale
    if mode == "soft":
        score = score - F.when(c("allowed"), 0.0).otherwise(p.transition_scale * p.illegal_penalty)
    elif mode == "hard":
        score = F.when(c("allowed"), score).otherwise(MASKED)
    elif mode != "none":
        raise ValueError(f"unknown transition mode {mode}")
    return features.withColumn("transition", score)


def best_path(e: np.ndarray, a: np.ndarray, beam: int | None = None, digits: int | None = None) -> tuple[list[int], np.ndarray]:
    """The sequence of states with the greatest sum, lowest state first on ties, and the scores step by step.

    e is [steps, states], a [steps - 1, states, states]. With a beam, all but the best so many states of a step are
    masked after its scores have been kept.
    """
    if not len(e):
        return [], np.zeros((0, 0))
    kept, back = forward_scores(e[0], e[1:], a, beam, digits)
    path = traced(back, int(narrowed(kept[-1], beam).argmax()))
    return path, kept


def narrowed(v: np.ndarray, beam: int | None) -> np.ndarray:
    """Scores with all but the best so many masked."""
    if beam and 0 < beam < len(v):
        v = v.copy()
        v[np.argsort(-v, kind="stable")[beam:]] = MASKED
    return v


def forward_scores(first: np.ndarray, e: np.ndarray, a: np.ndarray, beam: int | None = None, digits: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best sums to every state from the given ones on, [steps + 1, states], and the state before each, [steps, states].

    With digits every sum is rounded, so that ties don't hang on the order of additions.
    """
    kept, back = np.empty((len(e) + 1, len(first))), np.empty((len(e), len(first)), dtype=np.int64)
    kept[0] = first
    rounded = (lambda x: np.round(x, digits)) if digits is not None else (lambda x: x)
    for t in range(len(e)):
        sums = rounded(narrowed(kept[t], beam)[:, None] + a[t])
        back[t] = sums.argmax(axis=0)
        kept[t + 1] = rounded(e[t] + sums.max(axis=0))
    return kept, back


def traced(back: np.ndarray, last: int) -> list[int]:
    """The states that lead to the last one."""
    path = [last]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


def lagged_path(e: np.ndarray, a: np.ndarray, lag: int, beam: int | None = None, digits: int | None = None) -> tuple[list[int], np.ndarray]:
    """For every step the last state of the best path over the last lag steps: what is known while a trajectory goes on."""
    found = [best_path(e[max(0, t - lag + 1) : t + 1], a[max(0, t - lag + 1) : t], beam, digits) for t in range(len(e))]
    return [p[-1] for p, _ in found], np.stack([s[-1] for _, s in found]) if found else np.zeros((0, 0))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def posteriors(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Probability of every state at every step, given the whole sequence."""
    return between_borders(e[0], e[1:], a, np.zeros(e.shape[1]))


def between_borders(first: np.ndarray, e: np.ndarray, a: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Probabilities of the states from the log sums up to the first step and after the last one."""
    ahead, behind = np.empty((len(e) + 1, len(first))), np.empty((len(e) + 1, len(first)))
    ahead[0], behind[-1] = first, last
    for t in range(len(e)):
        ahead[t + 1] = e[t] + _log_sum(ahead[t][:, None] + a[t], 0)
    for t in range(len(e) - 1, -1, -1):
        behind[t] = _log_sum(a[t] + (e[t] + behind[t + 1])[None, :], 1)
    both = ahead + behind
    p = np.exp(both - both.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def transfer(e: np.ndarray, a: np.ndarray, log: bool, digits: int | None = None) -> np.ndarray:
    """[states, states]: the best sum (or the log sum) over all ways from a state before the steps to one at their end."""
    m = None
    for t in range(len(e)):
        step = a[t] + e[t][None, :]
        if m is None:
            m = step
        else:
            sums = m[:, :, None] + step[None, :, :]
            m = _log_sum(sums, 1) if log else sums.max(axis=1)
        if digits is not None:
            m = np.round(m, digits)
    return m


#: Steps of a trajectory that one task holds at once.
BLOCK = 2000


def collect_lattice(emissions: DataFrame, transitions: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (trajectory_id, block, steps): a trajectory's steps in order, in blocks, as arrays of (step, t, ranks'
    emissions, flat transitions from the step before, size of the step before).

    A long trajectory has many rows, so that none grows with it; the first step of a block has the transitions from
    the last one of the block before.
    """
    w = Window.partitionBy("trajectory_id").orderBy("t")
    stepped = emissions.withColumn("step", (F.dense_rank().over(w) - 1).cast("bigint"))
    key = ["trajectory_id", "step"]
    e = stepped.groupBy(*key).agg(F.min("t").alias("t"), F.array_sort(F.collect_list(F.struct("candidate_rank", "emission"))).alias("e"))
    a = transitions.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("prev_rank", "curr_rank", "transition"))).alias("a"))
    both = e.join(a, key, "left")
    step = F.struct("step", "t", F.transform("e", lambda s: s["emission"]).alias("e"), F.transform("a", lambda s: s["transition"]).alias("a"))
    blocked = both.withColumn("block", F.floor(F.col("step") / block))
    return blocked.groupBy("trajectory_id", "block").agg(F.array_sort(F.collect_list(step)).alias("steps"))


def _arrays(steps: list, k: int, offroad: tuple[float, float, float, float] | None) -> tuple[np.ndarray, np.ndarray]:
    """Padded [steps, states] and [steps, states, states] of a block; the very first step has no transitions into it."""
    e = np.full((len(steps), k), MASKED)
    a = np.full((len(steps), k, k), MASKED)
    for i, s in enumerate(steps):
        n = len(s["e"])
        e[i, :n] = s["e"]
        if s["a"] is not None and len(s["a"]):
            flat = np.asarray(s["a"], dtype=float)
            a[i, : len(flat) // n, :n] = flat.reshape(-1, n)
    if offroad:
        emission, enter, leave, stay = offroad
        e = np.concatenate([e, np.full((len(e), 1), emission)], axis=1)
        wide = np.full((len(a), k + 1, k + 1), -enter)
        wide[:, :k, :k] = a
        wide[:, k, :k] = -leave
        wide[:, k, k] = stay
        a = wide
    return e, a


_DIGITS = 9
_BORDERS = "trajectory_id bigint, block bigint, before array<double>, exit bigint, log_before array<double>, log_after array<double>, total double"


def _transfers(k: int, extra: tuple | None, log: bool):
    """Each block to its maps from the states before it to those at its end; a first block to the scores at its end."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for tid, no, steps in zip(part["trajectory_id"], part["block"], part["steps"], strict=True):
                e, a = _arrays(steps, k, extra)
                e, a = np.round(e, _DIGITS), np.round(a, _DIGITS)
                if no == 0:
                    best = forward_scores(e[0], e[1:], a[1:], None, _DIGITS)[0][-1]
                    logs = e[0]
                    for t in range(1, len(e) if log else 1):
                        logs = e[t] + _log_sum(logs[:, None] + a[t], 0)
                    rows.append((tid, no, best, logs if log else best[:0]))
                else:
                    rows.append((tid, no, transfer(e, a, False, _DIGITS).ravel(), transfer(e, a, True).ravel() if log else np.zeros(0)))
            yield pd.DataFrame(rows, columns=["trajectory_id", "block", "best", "logs"])

    return run


def _scanned(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The maps of a trajectory's blocks, in order, to what is known at the borders of each: sums before it, state at its
    end on the best path, log sums before and after it."""
    for part in parts:
        for tid, blocks in zip(part["trajectory_id"], part["b"], strict=True):
            k = len(blocks[0]["best"])
            before, back, logs = [None], [], [None]
            now, log_now = np.asarray(blocks[0]["best"]), np.asarray(blocks[0]["logs"])
            for x in blocks[1:]:
                m = np.round(now[:, None] + np.asarray(x["best"]).reshape(k, k), _DIGITS)
                before.append(now)
                logs.append(log_now)
                back.append(m.argmax(axis=0))
                now = m.max(axis=0)
                if len(log_now):
                    log_now = _log_sum(log_now[:, None] + np.asarray(x["logs"]).reshape(k, k), 0)
            exits = traced(np.array(back).reshape(-1, k), int(now.argmax()))
            after = [np.zeros(k)]
            for x in reversed(blocks[1:]):
                after.append(_log_sum(np.asarray(x["logs"]).reshape(k, k) + after[-1][None, :], 1) if len(log_now) else after[-1])
            yield pd.DataFrame({
                "trajectory_id": tid, "block": [x["block"] for x in blocks], "before": before, "exit": exits, "log_before": logs, "log_after": after[::-1], "total": float(now.max()),
            })


def _with_borders(lattice: DataFrame, extra: tuple | None, k: int, log: bool) -> DataFrame:
    """Blocks with what is known at their borders; only the maps of a trajectory's blocks meet in one task."""
    maps = lattice.select("trajectory_id", "block", "steps").mapInPandas(_transfers(k, extra, log), "trajectory_id bigint, block bigint, best array<double>, logs array<double>")
    chained = maps.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("block", "best", "logs"))).alias("b"))
    return lattice.join(chained.mapInPandas(_scanned, _BORDERS), ["trajectory_id", "block"])


def _bordered(lattice: DataFrame, extra: tuple | None, k: int, log: bool) -> DataFrame:
    """Blocks with what is known at their borders, which are null for trajectories of one block: nearly all of them, and
    they need no maps. The lattice is written first, as it is gone through more than once."""
    held = settle(lattice.select("trajectory_id", "block", "steps"), "lattice")
    long = held.where("block > 0").select("trajectory_id").distinct()
    some = not long.isEmpty()
    short = held.join(long, "trajectory_id", "left_anti") if some else held
    nothing = {"before": "array<double>", "exit": "bigint", "log_before": "array<double>", "log_after": "array<double>", "total": "double"}
    alone = short.withColumns({name: F.lit(None).cast(kind) for name, kind in nothing.items()})
    return alone.unionByName(_with_borders(held.join(long, "trajectory_id", "left_semi"), extra, k, log)) if some else alone


def viterbi(lattice: DataFrame, k: int = 10) -> DataFrame:
    """Best paths: rows (trajectory_id, t, step, candidate_rank, path_score, total_score).

    Ranks of a step count from 0 without gaps and are fewer than k. Scores are rounded to nine digits and their sums
    too, so that ties go to the lower rank. Blocks are decoded each on their own, between the borders that the maps
    of all blocks give.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for tid, steps, before, end, total in zip(part["trajectory_id"], part["steps"], part["before"], part["exit"], part["total"], strict=True):
                e, a = _arrays(steps, k, None)
                e, a = np.round(e, _DIGITS), np.round(a, _DIGITS)
                if before is None:
                    kept, back = forward_scores(e[0], e[1:], a[1:], None, _DIGITS)
                    alone = pd.isna(end)
                    path = traced(back, int(kept[-1].argmax() if alone else end))
                    total = float(kept[-1].max()) if alone else total
                else:
                    end = int(end)
                    kept, back = forward_scores(np.asarray(before), e, a, None, _DIGITS)
                    path, kept = traced(back, end)[1:], kept[1:]
                at = np.arange(len(path))
                yield pd.DataFrame({"trajectory_id": tid, "t": [s["t"] for s in steps], "step": [s["step"] for s in steps], "candidate_rank": path, "path_score": kept[at, path], "total_score": total})

    return _bordered(lattice, None, k, False).mapInPandas(run, "trajectory_id bigint, t bigint, step bigint, candidate_rank bigint, path_score double, total_score double")


_DECODED = "trajectory_id bigint, t bigint, step bigint, candidate_rank bigint, confidence double, entropy double, margin double, emission double, path_score double, offroad int"


def decode(lattice: DataFrame, mode: str = "offline", confidence: str = "posterior", lag: int = 10, beam: int | None = None, temperature: float = 1.0, offroad: Params | None = None, k: int = 10) -> DataFrame:
    """Paths with confidences: offline or fixed_lag; confidence from posteriors, or a softmax of the path scores.

    margin is the chosen path score less the best other. With offroad parameters every step has one more state; the
    rows that choose it have candidate_rank -1. Offline paths without a beam are decoded in blocks. A fixed lag looks
    back over the steps of its own block and so many before it. With a beam, what a step keeps hangs on all steps
    before it: such trajectories are decoded as a whole.
    """
    extra = (offroad.offroad_emission, offroad.offroad_enter, offroad.offroad_exit, offroad.offroad_stay) if offroad else None
    soft = confidence == "posterior" and mode == "offline"

    def rows(tid: int, steps: list, e: np.ndarray, path: list[int], scores: np.ndarray, p: np.ndarray | None) -> pd.DataFrame:
        if p is None:
            z = scores / max(temperature, 1e-6)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
        at, chosen, others = np.arange(len(path)), np.array(path, dtype=np.int64), scores.copy()
        others[at, chosen] = MASKED
        off = chosen == e.shape[1] - 1 if extra else np.zeros(len(path), dtype=bool)
        return pd.DataFrame({
            "trajectory_id": tid, "t": [s["t"] for s in steps], "step": [s["step"] for s in steps], "candidate_rank": np.where(off, -1, chosen), "confidence": p[at, chosen],
            "entropy": -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1), "margin": scores[at, chosen] - others.max(axis=1), "emission": e[at, chosen],
            "path_score": scores[at, chosen], "offroad": off.astype(int),
        })

    def in_blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                e, a = _arrays(r.steps, k, extra)
                e, a = np.round(e, _DIGITS), np.round(a, _DIGITS)
                first = r.before is None
                start, rest, moves = (e[0], e[1:], a[1:]) if first else (np.asarray(r.before), e, a)
                scores, back = forward_scores(start, rest, moves, None, _DIGITS)
                alone = pd.isna(r.exit)
                path = traced(back, int(scores[-1].argmax() if alone else r.exit))
                behind = np.zeros(e.shape[1]) if alone else np.asarray(r.log_after)
                p = between_borders(e[0] if first else np.asarray(r.log_before), rest, moves, behind) if soft else None
                cut = 0 if first else 1
                yield rows(r.trajectory_id, r.steps, e, path[cut:], scores[cut:], None if p is None else p[cut:])

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                ahead = list(r.ahead) if r.ahead is not None else []
                steps = ahead + list(r.steps)
                e, a = _arrays(steps, k, extra)
                e, a = np.round(e, _DIGITS), np.round(a, _DIGITS)
                path, scores = lagged_path(e, a[1:], lag, beam, _DIGITS) if mode == "fixed_lag" else best_path(e, a[1:], beam, _DIGITS)
                p = posteriors(e, a[1:]) if soft else None
                n = len(ahead)
                yield rows(r.trajectory_id, list(r.steps), e[n:], path[n:], scores[n:], None if p is None else p[n:])

    if mode == "offline" and not beam:
        return _bordered(lattice, extra, k, soft).mapInPandas(in_blocks, _DECODED)
    if mode == "fixed_lag":  # a block with the last steps of the one before it
        w = Window.partitionBy("trajectory_id").orderBy("block")
        tail = F.lag(F.slice("steps", F.greatest(F.size("steps") - (lag - 2), F.lit(1)), F.lit(lag - 1))).over(w) if lag > 1 else F.slice("steps", 1, 0)
        rows_ = lattice.select("trajectory_id", "block", "steps", tail.alias("ahead"))
    else:
        joined = lattice.groupBy("trajectory_id").agg(F.array_sort(F.collect_list(F.struct("block", "steps"))).alias("b"))
        steps_ = F.flatten(F.transform("b", lambda x: x["steps"]))
        rows_ = joined.select("trajectory_id", steps_.alias("steps")).withColumn("ahead", F.slice("steps", 1, 0))
    return rows_.mapInPandas(whole, _DECODED)


def softmax_confidence(emissions: DataFrame) -> DataFrame:
    """Adds confidence: a softmax of the emissions within each point."""
    w = Window.partitionBy("trajectory_id", "t")
    top = F.max("emission").over(w)
    weight = F.exp(F.col("emission") - top)
    return emissions.withColumn("confidence", weight / F.sum(weight).over(w))


def margin_confidence(emissions: DataFrame) -> DataFrame:
    """Adds margin_confidence: a sigmoid of the best emission less the second, halved for candidates that aren't the best."""
    w = Window.partitionBy("trajectory_id", "t").orderBy(F.col("emission").desc(), "candidate_rank")
    ranked = emissions.withColumn("_r", F.row_number().over(w))
    whole = Window.partitionBy("trajectory_id", "t")
    one, two = (F.max(F.when(F.col("_r") == r, F.col("emission"))).over(whole) for r in (1, 2))
    sure = 1 / (1 + F.exp(-(one - F.coalesce(two, F.lit(MASKED)))))
    return ranked.withColumn("margin_confidence", F.when(F.col("_r") == 1, sure).otherwise(0.5 * sure)).drop("_r")


def _taken(name: str) -> Column:
    """A score as decoding rounds it (numpy's round)."""
    return F.rint(F.col(name) * 10.0**_DIGITS) / 10.0**_DIGITS


def with_transition_scores(path: DataFrame, transitions: DataFrame) -> DataFrame:
    """path with transition_score: that of the step from the row before as the path's sums take it, rounded to nine
    digits; null for a trajectory's first.

    path has (trajectory_id, step, candidate_rank), transitions (trajectory_id, step, prev_rank, curr_rank, transition).
    """
    before = F.lag("candidate_rank").over(Window.partitionBy("trajectory_id").orderBy("step"))
    led = path.withColumn("_prev", before)
    keyed = transitions.select("trajectory_id", "step", F.col("prev_rank").alias("_prev"), F.col("curr_rank").alias("candidate_rank"), _taken("transition").alias("transition_score"))
    return led.join(keyed, ["trajectory_id", "step", "_prev", "candidate_rank"], "left").drop("_prev")


def with_emissions(path: DataFrame, emissions: DataFrame) -> DataFrame:
    """path with emission: that of the row's candidate as the path's sums take it, rounded to nine digits.

    path has (trajectory_id, t, candidate_rank), emissions (trajectory_id, t, candidate_rank, emission).
    """
    keyed = emissions.select("trajectory_id", "t", "candidate_rank", _taken("emission").alias("emission"))
    return path.join(keyed, ["trajectory_id", "t", "candidate_rank"])


def constrain(emissions: DataFrame, transitions: DataFrame, valid: str | None = None, mask: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Emissions and transitions with the masked score where the column valid, or mask, doesn't say yes: as a lattice they
    are decoded among the candidates and the moves that may be, as long as there are any."""
    held = lambda df, flag, score: df.withColumn(score, F.when(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)), F.col(score)).otherwise(MASKED)) if flag else df
    return held(emissions, valid, "emission"), held(transitions, mask, "transition")


def match_table(path: DataFrame, candidates: DataFrame, transitions: DataFrame) -> DataFrame:
    """Decoded rows with their candidate's edge and place, and whether the step from the row before is legal."""
    c = candidates.select("trajectory_id", "t", "candidate_rank", F.col("edge_idx").alias("pred_edge_idx"), F.col("proj_x").alias("pred_proj_x"), F.col("proj_y").alias("pred_proj_y"))
    rows = path.join(c, ["trajectory_id", "t", "candidate_rank"], "left").withColumn("pred_edge_idx", F.coalesce("pred_edge_idx", F.lit(OFFROAD)))
    w = Window.partitionBy("trajectory_id").orderBy("t")
    rows = rows.withColumn("_prev", F.lag("pred_edge_idx").over(w))
    legal = transitions.select(F.col("prev_edge_idx").alias("_prev"), F.col("curr_edge_idx").alias("pred_edge_idx"), F.lit(1).alias("_ok")).distinct()
    out = rows.join(legal, ["_prev", "pred_edge_idx"], "left")
    free = F.col("_prev").isNull() | (F.col("_prev") == F.col("pred_edge_idx"))
    return out.withColumn("transition_legal", F.when(free, 1).otherwise(F.coalesce("_ok", F.lit(0)))).drop("_prev", "_ok")
