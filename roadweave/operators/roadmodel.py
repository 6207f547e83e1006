"""The composed road model: embeddings of roads by graph layers, and heads that score candidates and their transitions.

Rows stay rows throughout. A graph layer is a join of roads with those that lead to them and an average by road; a head
takes what each candidate brings and the embedding of its road, gathered by a join on the road. Gradients go back the
same ways: a head's are added up by road, a layer's are sent from each road to those it averaged, by the same pairs
turned round. Weights are small and travel with the functions; of every weight's gradient each task returns one sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settle
from .decode import MASKED
from .learn import layer_norm, seeded_layers

Layers = list[tuple[np.ndarray, np.ndarray]]
_EPS = 1e-5


@dataclass
class RoadModel:
    """Weights: of each graph layer (on a road itself, on the mean of those before it, bias), and of both heads."""

    encoder: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    emission: Layers
    transition: Layers = field(default_factory=list)

    def parts(self) -> list[np.ndarray]:
        return [p for layers in (self.encoder, self.emission, self.transition) for layer in layers for p in layer]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def moved_to(self, flat: np.ndarray) -> RoadModel:
        """The model of the same shape with other weights."""
        cuts = np.cumsum([p.size for p in self.parts()])[:-1]
        found = iter([a.reshape(p.shape) for a, p in zip(np.split(flat, cuts), self.parts(), strict=True)])
        shape = lambda layers: [tuple(next(found) for _ in layer) for layer in layers]
        return RoadModel(shape(self.encoder), shape(self.emission), shape(self.transition))


def seeded_model(features: int, width: int, emission: int, transition: int = 0, hidden: tuple[int, ...] = (16,), depth: int = 2, seed: int = 0) -> RoadModel:
    """Starting weights for roads, candidates and transitions of so many features; without transition features no such head."""
    r = np.random.default_rng(seed)
    sizes = [features, *[width] * depth]
    encoder = [(r.normal(0, a**-0.5, (a, b)), r.normal(0, a**-0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]
    second = seeded_layers((2 * width + transition, *hidden, 1), seed + 2) if transition else []
    return RoadModel(encoder, seeded_layers((width + emission, *hidden, 1), seed + 1), second)


def _normed_back(z: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """The gradient before normalisation and rectification, of that behind them."""
    s = np.sqrt(z.var(axis=-1, keepdims=True) + _EPS)
    y = (z - z.mean(axis=-1, keepdims=True)) / s
    dy = dy * (y > 0)
    return (dy - dy.mean(axis=-1, keepdims=True) - y * (dy * y).mean(axis=-1, keepdims=True)) / s


def _head(x: np.ndarray, layers: Layers) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Scores, and each layer's input and output."""
    seen = []
    for i, (w, b) in enumerate(layers):
        z = x @ w + b
        seen.append((x, z))
        x = np.maximum(layer_norm(z), 0) if i < len(layers) - 1 else z
    return x[:, 0], seen


def _head_back(d: np.ndarray, seen: list, layers: Layers) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients of the weights, in order, and of the input."""
    d, out = d[:, None], []
    for i in range(len(layers) - 1, -1, -1):
        x, z = seen[i]
        dz = _normed_back(z, d) if i < len(layers) - 1 else d
        out = [x.T @ dz, dz.sum(axis=0), *out]
        d = dz @ layers[i][0].T
    return out, d


def _summed(df: DataFrame, key: str, array: str, width: int, name: str) -> DataFrame:
    return df.groupBy(key).agg(F.array(*[F.sum(F.col(array)[i]) for i in range(width)]).alias(name))


def _gathered(features: DataFrame, pairs: DataFrame, width: int) -> DataFrame:
    """(edge_idx, x, mean, n): roads with the mean of those that lead to them, zero for none."""
    each = pairs.join(features.select(F.col("edge_idx").alias("prev_edge_idx"), "x"), "prev_edge_idx")
    mean = each.groupBy(F.col("curr_edge_idx").alias("edge_idx")).agg(F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).alias("mean"), F.count("*").alias("n"))
    joined = features.join(mean, "edge_idx", "left")
    return joined.select("edge_idx", "x", F.coalesce("mean", F.array_repeat(F.lit(0.0), width)).alias("mean"), F.coalesce("n", F.lit(0)).alias("n"))


def _layer(own: np.ndarray, before: np.ndarray, bias: np.ndarray):
    """A graph layer over the columns of a road's values and of the mean before it."""

    @F.pandas_udf("array<double>")
    def of(x: pd.Series, mean: pd.Series) -> pd.Series:
        z = np.stack(x.to_list()) @ own + np.stack(mean.to_list()) @ before + bias
        return pd.Series(list(np.maximum(layer_norm(z), 0)))

    return of


def encode(features: DataFrame, pairs: DataFrame, model: RoadModel) -> tuple[DataFrame, list[DataFrame]]:
    """Embeddings (edge_idx, x) of roads (edge_idx, x), and what each graph layer saw, written.

    pairs has prev_edge_idx and curr_edge_idx; a pair that stands there twice counts twice, and a road without
    predecessors has a mean of zeros.
    """
    seen, x = [], features.select("edge_idx", "x")
    for own, before, bias in model.encoder:
        seen.append(settle(_gathered(x, pairs, own.shape[0]), "layer"))
        x = seen[-1].select("edge_idx", _layer(own, before, bias)("x", "mean").alias("x"))
    return settle(x, "embeddings"), seen


def attend(features: DataFrame, pairs: DataFrame, weights: np.ndarray, source: np.ndarray, target: np.ndarray, bias: np.ndarray, slope: float = 0.2) -> DataFrame:
    """An attention layer over roads (edge_idx, x): rows (edge_idx, x).

    weights is [heads, in, out], source and target [heads, out]. A road's output is, for each head, the mean of its
    predecessors' projections weighed by a softmax of how well both go together; heads stand beside each other. Each
    predecessor's part is a row, so that sums are combined where rows are read and a road that many lead to is no
    task's alone. A road without predecessors has the bias only.
    """
    heads, width = weights.shape[0], weights.shape[2]

    @F.pandas_udf("struct<p:array<double>,s:array<double>,t:array<double>>")
    def projected(x: pd.Series) -> pd.DataFrame:
        p = np.einsum("nf,hfo->nho", np.stack(x.to_list()), weights)
        return pd.DataFrame({"p": list(p.reshape(len(p), -1)), "s": list((p * source).sum(axis=2)), "t": list((p * target).sum(axis=2))})

    nodes = settle(features.select("edge_idx", projected("x").alias("o")).select("edge_idx", "o.*"), "projected")
    each = pairs.join(nodes.select(F.col("edge_idx").alias("prev_edge_idx"), "p", "s"), "prev_edge_idx")
    goes = lambda i: F.col("s")[i] + F.col("t")[i]
    scored = each.join(nodes.select(F.col("edge_idx").alias("curr_edge_idx"), "t"), "curr_edge_idx")
    scored = scored.withColumns({f"e{i}": F.when(goes(i) > 0, goes(i)).otherwise(slope * goes(i)) for i in range(heads)})
    # Less the greatest of all of the road's sums, which the target's part doesn't change the order of.
    top = scored.groupBy("curr_edge_idx").agg(*[F.max(f"e{i}").alias(f"top{i}") for i in range(heads)])
    weighed = scored.join(top, "curr_edge_idx").withColumns({f"w{i}": F.exp(F.col(f"e{i}") - F.col(f"top{i}")) for i in range(heads)})
    sums = [F.sum(F.col(f"w{i}") * F.col("p")[i * width + k]) / F.sum(f"w{i}") for i in range(heads) for k in range(width)]
    found = weighed.groupBy(F.col("curr_edge_idx").alias("edge_idx")).agg(F.array(*sums).alias("m"))
    constant = F.array(*[F.lit(float(b)) for b in bias])
    mixed = F.coalesce("m", F.array_repeat(F.lit(0.0), heads * width))
    return features.select("edge_idx").join(found, "edge_idx", "left").select("edge_idx", F.zip_with(mixed, constant, lambda a, b: a + b).alias("x"))


def _joined(rows: DataFrame, embeddings: DataFrame, edges: tuple[str, ...]) -> DataFrame:
    """rows with e, the embeddings of their roads beside each other; null where one is unknown or negative."""
    for i, edge in enumerate(edges):
        rows = rows.join(embeddings.select(F.col("edge_idx").alias(f"_edge{i}"), F.col("x").alias(f"_e{i}")), F.col(edge) == F.col(f"_edge{i}"), "left").drop(f"_edge{i}")
    known = [F.col(f"_e{i}").isNotNull() for i in range(len(edges))]
    for k in known[1:]:
        known[0] = known[0] & k
    return rows.withColumn("e", F.when(known[0], F.concat(*[F.col(f"_e{i}") for i in range(len(edges))]))).drop(*[f"_e{i}" for i in range(len(edges))])


def head_scores(rows: DataFrame, embeddings: DataFrame, layers: Layers, *edges: str, valid: str | None = None) -> DataFrame:
    """Adds score to rows with an array x: a head over their roads' embeddings and x.

    Rows of unknown roads, and those that the column valid says no to, have the masked score.
    """

    @F.pandas_udf("double")
    def of(e: pd.Series, x: pd.Series) -> pd.Series:
        out = np.full(len(e), MASKED)
        known = np.flatnonzero(e.notna().to_numpy())
        if len(known):
            both = np.concatenate([np.stack(e.iloc[known].to_list()), np.stack(x.iloc[known].to_list())], axis=1)
            out[known] = _head(both.astype(float), layers)[0]
        return pd.Series(out)

    scored = _joined(rows, embeddings, edges).withColumn("score", of("e", "x")).drop("e")
    return scored.withColumn("score", F.when(F.coalesce(F.col(valid), F.lit(False)), F.col("score")).otherwise(MASKED)) if valid else scored


def _grouped(rows: DataFrame, embeddings: DataFrame, edges: tuple[str, ...]) -> DataFrame:
    """One row for each labelled step: its candidates with embeddings and features, and the place of the true one."""
    member = F.struct("candidate_rank", F.array(*edges).alias("edges"), F.concat("e", "x").alias("x"), "is_gt")
    steps = _joined(rows, embeddings, edges).where("e IS NOT NULL").groupBy("trajectory_id", "t").agg(F.array_sort(F.collect_list(member)).alias("c"))
    return steps.select("c", (F.array_position(F.col("c.is_gt"), F.lit(1)) - 1).cast("int").alias("gt")).where("gt >= 0")


_SUMS = "edge_idx bigint, g array<double>"


def _head_gradients(layers: Layers, width: int, ways: int):
    """Of steps: each road's gradient, and in a row without a road the weights' gradients, the loss and the number of steps."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, loss, n, roads = [np.zeros(p.size) for layer in layers for p in layer], 0.0, 0, {}
        for part in parts:
            if not len(part):
                continue
            x = np.array([c["x"] for step in part["c"] for c in step], dtype=float)
            sizes = np.array([len(step) for step in part["c"]])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            s, seen = _head(x, layers)
            e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
            p = e / np.repeat(np.add.reduceat(e, starts), sizes)
            right = starts + part["gt"].to_numpy()
            loss -= float(np.log(np.maximum(p[right], 1e-300)).sum())
            n += len(part)
            p[right] -= 1
            grads, dx = _head_back(p, seen, layers)
            total = [t + g.ravel() for t, g in zip(total, grads, strict=True)]
            edges = np.array([c["edges"] for step in part["c"] for c in step], dtype=np.int64)
            for way in range(ways):
                own, at = np.unique(edges[:, way], return_inverse=True)
                sums = np.zeros((len(own), width))
                np.add.at(sums, at, dx[:, way * width : (way + 1) * width])
                for edge, g in zip(own.tolist(), sums, strict=True):
                    roads[edge] = roads[edge] + g if edge in roads else g
            if len(roads) > 50_000:
                yield pd.DataFrame({"edge_idx": pd.array(list(roads), dtype="Int64"), "g": list(roads.values())})
                roads = {}
        if roads:
            yield pd.DataFrame({"edge_idx": pd.array(list(roads), dtype="Int64"), "g": list(roads.values())})
        yield pd.DataFrame({"edge_idx": pd.array([None], dtype="Int64"), "g": [np.concatenate([*total, [loss, float(n)]])]})

    return run


def _layer_gradients(own: np.ndarray, before: np.ndarray, bias: np.ndarray):
    """Of rows (edge_idx, x, mean, n, g): the gradients of x and of what each predecessor gave, and in a row without a road the weights'."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [np.zeros_like(own), np.zeros_like(before), np.zeros_like(bias)]
        for part in parts:
            if not len(part):
                continue
            x, m, g = (np.stack(part[c].to_list()).astype(float) for c in ("x", "mean", "g"))
            dz = _normed_back(x @ own + m @ before + bias, g)
            total = [total[0] + x.T @ dz, total[1] + m.T @ dz, total[2] + dz.sum(axis=0)]
            share = dz @ before.T / np.maximum(part["n"].to_numpy(), 1)[:, None]
            yield pd.DataFrame({"edge_idx": part["edge_idx"].astype("Int64"), "g": list(dz @ own.T), "share": list(share)})
        yield pd.DataFrame({"edge_idx": pd.array([None], dtype="Int64"), "g": [np.concatenate([t.ravel() for t in total])], "share": [np.zeros(0)]})

    return run


def _weights(rows: DataFrame) -> np.ndarray:
    """The sum of the tasks' rows of weights' gradients: one row for each task."""
    return np.sum([np.asarray(r["g"]) for r in rows.where("edge_idx IS NULL").select("g").collect()], axis=0)


def loss_and_gradient(model: RoadModel, features: DataFrame, pairs: DataFrame, candidates: DataFrame, moves: DataFrame | None = None, transition_weight: float = 1.0) -> tuple[float, np.ndarray]:
    """The mean cross-entropy of labelled steps, and its gradient by all weights in the order of RoadModel.flat.

    candidates has (trajectory_id, t, candidate_rank, edge_idx, x, is_gt), moves the same of the candidates that follow
    the true one of the step before, with prev_edge_idx. Their mean loss counts with the weight. Candidates of unknown
    roads and steps without a true candidate take no part.
    """
    embeddings, seen = encode(features, pairs, model)
    width = model.encoder[-1][2].size
    loss, back, heads = 0.0, None, []
    for rows, layers, edges, weight in ((candidates, model.emission, ("edge_idx",), 1.0), (moves, model.transition, ("prev_edge_idx", "edge_idx"), transition_weight)):
        if rows is None or not layers:
            heads.append(np.zeros(sum(p.size for layer in layers for p in layer)))
            continue
        found = settle(_grouped(rows, embeddings, edges).mapInPandas(_head_gradients(layers, width, len(edges)), _SUMS), "gradients")
        *own, total, n = _weights(found)
        scale = weight / max(n, 1.0)
        loss += scale * total
        heads.append(scale * np.array(own))
        roads = found.where("edge_idx IS NOT NULL").select("edge_idx", F.transform("g", lambda v: v * scale).alias("g"))  # noqa: B023
        back = roads if back is None else back.unionByName(roads)
    layers_back = []
    for (own, before, bias), table in zip(reversed(model.encoder), reversed(seen), strict=True):
        into = table.join(_summed(back, "edge_idx", "g", bias.size, "g"), "edge_idx")
        found = settle(into.mapInPandas(_layer_gradients(own, before, bias), f"{_SUMS}, share array<double>"), "gradients")
        layers_back.insert(0, _weights(found))
        sent = pairs.join(found.select(F.col("edge_idx").alias("curr_edge_idx"), "share"), "curr_edge_idx").select(F.col("prev_edge_idx").alias("edge_idx"), F.col("share").alias("g"))
        back = found.where("edge_idx IS NOT NULL").select("edge_idx", "g").unionByName(sent)
    return float(loss), np.concatenate([*layers_back, *heads])


def train(model: RoadModel, features: DataFrame, pairs: DataFrame, candidates: DataFrame, moves: DataFrame | None = None, epochs: int = 5, rate: float = 0.02, decay: float = 1e-4, clip: float = 5.0, transition_weight: float = 1.0) -> tuple[RoadModel, list[float]]:
    """The model after so many steps of Adam with decoupled decay over all rows, and the loss before each step."""
    flat, losses = model.flat(), []
    m = v = np.zeros_like(flat)
    for epoch in range(1, epochs + 1):
        loss, g = loss_and_gradient(model.moved_to(flat), features, pairs, candidates, moves, transition_weight)
        losses.append(loss)
        g = g * min(1.0, clip / max(float(np.linalg.norm(g)), 1e-12))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - rate * (m / (1 - 0.9**epoch) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8) + decay * flat)
    return model.moved_to(flat), losses
