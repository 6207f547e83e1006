"""The toxicity model's ratios against a brute-force Kneser-Ney model, and its two ways of scoring against each other."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from roadweave.llm import toxicity
from roadweave.llm.toxicity import DISCOUNT, MASS, ORDER

from .conftest import ODD, documents
from .test_toxicity_repeats import made_corpus


def grams_of(word):
    padded = "\x01" * (ORDER - 1) + word + "\x02"
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


class Brute:
    def __init__(self, words):
        self.own = [Counter(), Counter()]
        for w, ns in words.items():
            for c in (0, 1):
                for g in grams_of(w):
                    self.own[c][g] += ns[c]
        self.lower, level = {}, set(self.own[0]) | set(self.own[1])
        for k in range(ORDER - 1, 0, -1):
            self.lower[k] = Counter(g[1:] for g in level)
            level = set(self.lower[k])

    def shared(self, gram):
        if not gram:
            return 1 / 256
        rows = {g: n for g, n in self.lower[len(gram)].items() if g[:-1] == gram[:-1]}
        below, total = self.shared(gram[1:]), sum(rows.values())
        return max(rows.get(gram, 0) - DISCOUNT, 0) / total + min(1, DISCOUNT * len(rows) / total) * below if total else below

    def ratio(self, word):
        out = 0.0
        for g in grams_of(word):
            rows = [{x: n for x, n in own.items() if x[:-1] == g[:-1] and n} for own in self.own]
            totals = [sum(r.values()) for r in rows]
            rest = (MASS + DISCOUNT * max(map(len, rows))) / (sum(totals) + MASS)
            p, q = self.shared(g[1:]), []
            for r, t in zip(rows, totals, strict=True):
                own = max(r.get(g, 0) - DISCOUNT, 0) / max(t - DISCOUNT * len(r), DISCOUNT)
                q.append((1 - min(rest, 1)) * own + min(rest, 1) * p if t else p)
            out += math.log(q[1] / q[0])
        return out


def test_ratios_equal_brute_force(spark):
    r = random.Random(2)
    words = {"".join(r.choice("abcdéß😀") for _ in range(r.randint(1, 12))): (r.randrange(4), r.randrange(3)) for _ in range(60)}
    words = {w: ns for w, ns in words.items() if sum(ns)}
    rows = [(w, 0, 0, *ns) for w, ns in words.items()]
    table = toxicity.ratio_table(spark.createDataFrame(rows, "word string, fit0 bigint, fit1 bigint, all0 bigint, all1 bigint"))
    found = toxicity.Ratios(*toxicity._collected(table, "all").value)
    brute = Brute(words)
    tried = [*words, *["".join(r.choice("abcdéß😀z") for _ in range(r.randint(1, 12))) for _ in range(60)], "", "ab" * 40]
    assert found.of(tried) == pytest.approx([brute.ratio(w) for w in tried], abs=1e-4)


def test_joined_evidence_equals_lookup(spark):
    rows, labels = made_corpus(200)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    odd = documents(spark, ODD)
    got = []
    for bound in (toxicity.BROADCAST_GRAMS, 0):
        model = toxicity.train(docs, marks, bound=bound)
        assert (model.shared is None) == (bound == 0)
        by = defaultdict(list)
        for part in (docs, odd):
            for x in toxicity.score(part, model, name="s").collect():
                by[x["doc_id"]].append(x["s"])
        got.append({k: sorted(v) for k, v in by.items()})
    assert got[0].keys() == got[1].keys()
    assert all(np.allclose(got[0][k], got[1][k], atol=1e-5) for k in got[0])
