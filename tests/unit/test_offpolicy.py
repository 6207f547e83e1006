"""The ring against a deque, and one update against the same worked out by finite differences."""

from collections import deque

import numpy as np
import pytest

from roadweave.operators import offpolicy

KIND = "x array<array<double>>, action int, reward double, next_x array<array<double>>, done boolean"


def test_ring_is_a_deque(spark):
    want, ring = deque(maxlen=7), None
    for batch in ([3, 1, 2], [5, 4], [], [9, 8, 7, 6], list(range(20, 31))):
        df = spark.createDataFrame([(v, v * 10) for v in batch], "v bigint, payload bigint")
        ring = offpolicy.ring_append(ring, df, 7, "v")
        want.extend((v, v * 10) for v in sorted(batch))
        assert [(r["v"], r["payload"]) for r in ring.orderBy("seq").collect()] == list(want)
    drawn = [r["seq"] for r in offpolicy.ring_sample(ring, 4, 1).collect()]
    assert len(set(drawn)) == 4 and drawn == [r["seq"] for r in offpolicy.ring_sample(ring, 4, 1).collect()]
    assert offpolicy.ring_sample(ring, 100, 2).count() == 7
    seen = {r["seq"] for s in range(30) for r in offpolicy.ring_sample(ring, 1, s).collect()}
    assert len(seen) > 4
    with pytest.raises(ValueError, match="room"):
        offpolicy.ring_append(None, df, 0, "v")


def rows(r, n=7, width=3):
    out = []
    for i in range(n):
        k, m = r.integers(1, 5), r.integers(1, 4)
        done = i % 3 == 0
        out.append((r.normal(size=(k, width)).tolist(), int(r.integers(k)), float(r.normal()), None if done else r.normal(size=(m, width)).tolist(), bool(done)))
    return out


def chances(s):
    p = np.exp(s - s.max())
    return p / p.sum()


def test_one_update_equals_a_worked_one(spark):
    r = np.random.default_rng(3)
    data = rows(r)
    m = offpolicy.ActorCritic(*(r.normal(size=3) for _ in range(5)), log_alpha=-0.7)
    alpha, gamma = np.exp(-0.7), 0.9
    ys = []
    for _, _, reward, nxt, done in data:
        y = reward
        if not done:
            x = np.array(nxt)
            p = chances(x @ m.actor)
            y += gamma * p @ (np.minimum(x @ m.slow1, x @ m.slow2) - alpha * np.log(p))
        ys.append(y)
    critic = lambda q1, q2: np.mean([(np.array(x[a]) @ q1 - y) ** 2 + (np.array(x[a]) @ q2 - y) ** 2 for (x, a, *_), y in zip(data, ys)])

    def slope(f, w):
        return np.array([(f(w + h) - f(w - h)) / 2e-6 for h in 1e-6 * np.eye(3)])

    g1, g2 = slope(lambda q: critic(q, m.q2), m.q1), slope(lambda q: critic(m.q1, q), m.q2)
    size = np.sqrt(g1 @ g1 + g2 @ g2)
    scale = min(1.0, 5.0 / size)
    q1, q2 = m.q1 - 0.1 * scale * g1, m.q2 - 0.1 * scale * g2

    def actor(theta):
        total = 0.0
        for x, *_ in data:
            x = np.array(x)
            p = chances(x @ theta)
            total += p @ (alpha * np.log(p) - np.minimum(x @ q1, x @ q2))
        return total / len(data)

    new, told = offpolicy.soft_step(m, spark.createDataFrame(data, KIND).repartition(3), gamma=gamma, tau=0.25, actor_rate=0.2, critic_rate=0.1, alpha_rate=0.3)
    assert told["critic_loss"] == pytest.approx(critic(m.q1, m.q2)) and told["actor_loss"] == pytest.approx(actor(m.actor))
    assert new.q1 == pytest.approx(q1, abs=1e-7) and new.q2 == pytest.approx(q2, abs=1e-7)
    g = slope(actor, m.actor)
    assert new.actor == pytest.approx(m.actor - 0.2 * g * min(1.0, 5.0 / np.linalg.norm(g)), abs=1e-7)
    entropies = [-(p @ np.log(p)) for p in (chances(np.array(x) @ m.actor) for x, *_ in data)]
    aim = 0.7 * np.mean([np.log(len(x)) for x, *_ in data])
    assert new.log_alpha == pytest.approx(-0.7 - 0.3 * alpha * (np.mean(entropies) - aim))
    assert new.slow1 == pytest.approx(0.75 * m.slow1 + 0.25 * q1, abs=1e-7) and new.slow2 == pytest.approx(0.75 * m.slow2 + 0.25 * q2, abs=1e-7)


def test_updates_learn_which_candidate_pays(spark):
    r = np.random.default_rng(8)
    data = []
    for _ in range(60):
        x = r.normal(size=(3, 2))
        a = int(r.integers(3))
        data.append((x.tolist(), a, float(x[a, 0] > 0) - float(x[a, 0] <= 0), None, True))
    batch, model = spark.createDataFrame(data, KIND).coalesce(2), offpolicy.starting(2)
    for _ in range(6):
        model, _ = offpolicy.soft_step(model, batch, actor_rate=1.0, critic_rate=0.3)
    assert model.actor[0] > 0.3 and model.actor[0] > 3 * abs(model.actor[1])
    same, told = offpolicy.soft_step(model, batch.limit(0))
    assert same.actor.tolist() == model.actor.tolist() and told["critic_loss"] == 0.0
