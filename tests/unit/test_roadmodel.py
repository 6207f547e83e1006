"""The composed model against the same written densely over matrices, and its gradients against finite differences."""

import numpy as np
import pytest

from roadweave.operators import roadmodel
from roadweave.operators.decode import MASKED

PAIRS = [(0, 1), (1, 2), (2, 0), (0, 2), (3, 2), (4, 2), (5, 2), (1, 1), (0, 1)]  # one pair twice; 3, 4 and 5 have no predecessors
N, IN, WIDTH = 6, 3, 4


def norm(z):
    return (z - z.mean(-1, keepdims=True)) / np.sqrt(z.var(-1, keepdims=True) + 1e-5)


def dense_encode(x, model):
    for own, before, bias in model.encoder:
        mean = np.zeros_like(x)
        for i in range(N):
            led = [x[p] for p, c in PAIRS if c == i]
            mean[i] = np.mean(led, axis=0) if led else 0
        x = np.maximum(norm(x @ own + mean @ before + bias), 0)
    return x


def dense_head(x, layers):
    for i, (w, b) in enumerate(layers):
        x = x @ w + b
        if i < len(layers) - 1:
            x = np.maximum(norm(x), 0)
    return x[:, 0]


def dense_loss(model, roads, candidates, moves, weight):
    emb, total = dense_encode(roads, model), 0.0
    for rows, layers, w, ways in ((candidates, model.emission, 1.0, 1), (moves, model.transition, weight, 2)):
        losses = []
        for key in sorted({r[:2] for r in rows}):
            own = [r for r in rows if r[:2] == key and all(0 <= e < N for e in r[3 : 3 + ways])]
            if not any(r[-1] for r in own):
                continue
            s = dense_head(np.array([np.concatenate([*[emb[e] for e in r[3 : 3 + ways]], r[-2]]) for r in own]), layers)
            losses.append(np.log(np.exp(s).sum()) - s[[r[-1] for r in own].index(1)])
        total += w * np.mean(losses)
    return total


@pytest.fixture(scope="module")
def case(spark):
    r = np.random.default_rng(5)
    roads = r.normal(size=(N, IN))
    step = lambda tid, t, edges, gt: [(tid, t, k, e, r.normal(size=2).tolist(), int(k == gt)) for k, e in enumerate(edges)]
    candidates = step(1, 0, [0, 1, 5], 1) + step(1, 1, [2, 3], 0) + step(2, 0, [4, 99, 1], 2) + step(2, 1, [99, 1], 0) + step(2, 2, [1, -1], 3)
    moves = [(*c[:3], e, *c[3:4], r.normal(size=1).tolist(), c[5]) for c, e in zip(candidates, [1, 1, 1, 0, 0, 3, 3, 3, 2, 2, 5, 5])]
    frames = (
        spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(roads)], "edge_idx bigint, x array<double>"), spark.createDataFrame(PAIRS, "prev_edge_idx bigint, curr_edge_idx bigint"),
        spark.createDataFrame(candidates, "trajectory_id bigint, t bigint, candidate_rank int, edge_idx bigint, x array<double>, is_gt int"),
        spark.createDataFrame(moves, "trajectory_id bigint, t bigint, candidate_rank int, prev_edge_idx bigint, edge_idx bigint, x array<double>, is_gt int"),
    )
    return roads, candidates, moves, frames


def test_gradient_through_both_heads_and_the_graph(case):
    roads, candidates, moves, frames = case
    model = roadmodel.seeded_model(IN, WIDTH, 2, 1, hidden=(3,), seed=4)
    model = model.moved_to(model.flat() + np.random.default_rng(1).normal(0, 0.1, model.flat().size))  # biases too
    loss, g = roadmodel.loss_and_gradient(model, *frames, transition_weight=0.7)
    assert loss == pytest.approx(dense_loss(model, roads, candidates, moves, 0.7), abs=1e-10)
    flat, h = model.flat(), 1e-6
    want = []
    for i in range(len(flat)):
        up, down = flat.copy(), flat.copy()
        up[i] += h
        down[i] -= h
        want.append((dense_loss(model.moved_to(up), roads, candidates, moves, 0.7) - dense_loss(model.moved_to(down), roads, candidates, moves, 0.7)) / (2 * h))
    assert np.abs(g - np.array(want)).max() < 1e-6 and np.abs(g).max() > 0.01


def test_scores_are_masked_where_a_road_is_unknown_or_not_valid(case, spark):
    roads, candidates, _, (features, pairs, rows, _) = case
    model = roadmodel.seeded_model(IN, WIDTH, 2, hidden=(3,), seed=4)
    embeddings, _ = roadmodel.encode(features, pairs, model)
    emb = dense_encode(roads, model)
    got = {(r["trajectory_id"], r["t"], r["candidate_rank"]): r["score"] for r in roadmodel.head_scores(rows.withColumn("ok", rows["candidate_rank"] != 1), embeddings, model.emission, "edge_idx", valid="ok").collect()}
    for tid, t, k, e, x, _ in candidates:
        want = float(dense_head(np.concatenate([emb[e], x])[None, :], model.emission)[0]) if 0 <= e < N and k != 1 else MASKED
        assert got[tid, t, k] == pytest.approx(want, abs=1e-9)


def test_training_lowers_the_loss(case):
    _, _, _, (features, pairs, candidates, _) = case
    model, losses = roadmodel.train(roadmodel.seeded_model(IN, WIDTH, 2, hidden=(3,)), features, pairs, candidates, epochs=4, rate=0.1)
    assert losses[-1] < losses[0] and model.flat().shape == roadmodel.seeded_model(IN, WIDTH, 2, hidden=(3,)).flat().shape


def test_attention_equals_a_dense_computation(case):
    roads, _, _, (features, pairs, _, _) = case
    r = np.random.default_rng(2)
    w, s, t, b = r.normal(size=(2, IN, 3)), r.normal(size=(2, 3)), r.normal(size=(2, 3)), r.normal(size=6)
    got = {x["edge_idx"]: x["x"] for x in roadmodel.attend(features, pairs, w, s, t, b).collect()}
    for i in range(N):
        out = []
        for h in range(2):
            p = roads @ w[h]
            led = [q for q, c in PAIRS if c == i]
            e = np.array([p[q] @ s[h] + p[i] @ t[h] for q in led])
            a = np.exp(np.where(e > 0, e, 0.2 * e))
            out.append((a[:, None] * p[led]).sum(0) / a.sum() if led else np.zeros(3))
        assert got[i] == pytest.approx((np.concatenate(out) + b).tolist(), abs=1e-10)
