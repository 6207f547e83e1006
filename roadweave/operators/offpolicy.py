"""Learning from what earlier policies did: a bounded table of steps and discrete soft actor-critic updates.

The table keeps the newest rows by a running number, as a ring would. An update is two passes over the drawn rows, one
for both value tables and one for the policy that is judged by them; tasks add up gradients, the driver gets one row of
sums from each. Policy and values are linear in what each candidate of a step brings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle
from .roadnet import number_edges


def ring_append(ring: DataFrame | None, steps: DataFrame, capacity: int, *order: str) -> DataFrame:
    """The last capacity rows of ring and then steps, in the given order of columns; written. Rows have seq, which counts on."""
    if capacity <= 0:
        raise ValueError("a ring needs room")
    number = F.col("edge_idx").cast("bigint")
    first = -1 if ring is None else ring.agg(F.max("seq")).first()[0]
    first = -1 if first is None else first
    fresh = number_edges(steps, *order).withColumn("seq", number + first + 1).drop("edge_idx")
    both = fresh if ring is None else ring.unionByName(fresh.select(*ring.columns))
    held = settle(both, "ring")
    last = held.agg(F.max("seq")).first()[0]
    return held if last is None else held.where(F.col("seq") > last - capacity)


def ring_sample(ring: DataFrame, n: int, seed: int) -> DataFrame:
    """n rows drawn evenly and without replacement, all if there are fewer: those whose numbers have the least seeded hashes."""
    return ring.orderBy(F.xxhash64(F.lit(seed), "seq"), "seq").limit(n)


@dataclass(frozen=True)
class ActorCritic:
    """Weights by candidate feature: of the policy, of two value tables, and of the slow copies that set their targets."""

    actor: np.ndarray
    q1: np.ndarray
    q2: np.ndarray
    slow1: np.ndarray
    slow2: np.ndarray
    log_alpha: float


def starting(width: int, alpha: float = 0.2, seed: int = 0) -> ActorCritic:
    r = np.random.default_rng(seed)
    q1, q2 = r.normal(0, 0.1, width), r.normal(0, 0.1, width)
    return ActorCritic(np.zeros(width), q1, q2, q1.copy(), q2.copy(), float(np.log(alpha)))


def _chances(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and their logarithms."""
    logs = s - s.max()
    logs = logs - np.log(np.exp(logs).sum())
    return np.exp(logs), logs


def _features(x) -> np.ndarray:
    return np.stack([np.asarray(row, dtype=float) for row in x])


def target_values(model: ActorCritic, next_x, reward: float, done: bool, gamma: float) -> float:
    """Reward and what the step after is worth: the policy's mean of the lower slow value, and its entropy by the temperature."""
    if done or next_x is None or not len(next_x):
        return reward
    x = _features(next_x)
    p, logs = _chances(x @ model.actor)
    return reward + gamma * float(p @ (np.minimum(x @ model.slow1, x @ model.slow2) - np.exp(model.log_alpha) * logs))


def _sums(batch: DataFrame, of, width: int) -> np.ndarray:
    """The sum over all rows of what of() gives of each, in one row from each task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(width)
        for part in parts:
            for r in part.itertuples(index=False):
                total += of(r)
        yield pd.DataFrame({"g": [total]})

    rows = batch.select("x", "action", "reward", "next_x", "done").mapInPandas(run, "g array<double>").collect()
    return np.sum([np.asarray(r["g"]) for r in rows], axis=0) if rows else np.zeros(width)


def _clipped(g: np.ndarray, most: float) -> np.ndarray:
    return g * min(1.0, most / max(float(np.linalg.norm(g)), 1e-12))


def soft_step(
    model: ActorCritic, batch: DataFrame, gamma: float = 0.98, tau: float = 0.005, actor_rate: float = 0.05, critic_rate: float = 0.05, alpha_rate: float = 0.05,
    entropy_scale: float = 0.7, clip: float = 5.0,
) -> tuple[ActorCritic, dict[str, float]]:
    """The model after one update on a batch, and its losses, temperature, entropy and target entropy before it.

    batch has x (features of each valid candidate of a step), action (the place of the one taken), reward, next_x (of
    the step after) and done. First both value tables go towards the targets; then the policy, judged by the lower of
    the two new ones; then the temperature, by how far the entropy is from a share of that of an even choice; and last
    the slow copies follow by tau. A batch without rows changes nothing but those.
    """
    w = len(model.actor)

    def critics(r) -> np.ndarray:
        y = target_values(model, r.next_x, r.reward, r.done, gamma)
        x = np.asarray(r.x[int(r.action)], dtype=float)
        d1, d2 = x @ model.q1 - y, x @ model.q2 - y
        return np.concatenate([2 * d1 * x, 2 * d2 * x, [d1 * d1 + d2 * d2, 1.0]])

    batch = settle(batch, "batch")
    sums = _sums(batch, critics, 2 * w + 2)
    n = max(sums[-1], 1.0)
    both = _clipped(sums[: 2 * w] / n, clip)
    new = replace(model, q1=model.q1 - critic_rate * both[:w], q2=model.q2 - critic_rate * both[w:])
    alpha = float(np.exp(model.log_alpha))

    def policy(r) -> np.ndarray:
        x = _features(r.x)
        p, logs = _chances(x @ model.actor)
        worth = alpha * logs - np.minimum(x @ new.q1, x @ new.q2)
        mean = p @ worth
        # The share of logs in worth has gradient alpha, which sums to nothing over all candidates.
        return np.concatenate([(p * (worth - mean)) @ x, [mean, -(p @ logs), np.log(len(x))]])

    sums2 = _sums(batch, policy, w + 3)
    entropy, aim = sums2[w + 1] / n, entropy_scale * sums2[w + 2] / n
    return replace(
        new, actor=model.actor - actor_rate * _clipped(sums2[:w] / n, clip), log_alpha=model.log_alpha - alpha_rate * alpha * (entropy - aim),
        slow1=(1 - tau) * model.slow1 + tau * new.q1, slow2=(1 - tau) * model.slow2 + tau * new.q2,
    ), {"critic_loss": float(sums[2 * w] / n), "actor_loss": float(sums2[w] / n), "alpha": alpha, "entropy": float(entropy), "target_entropy": float(aim)}
