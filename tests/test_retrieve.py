"""Retrieval against all pairs: ties, copies, several blocks and stripes, odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rewardloom.operators import retrieve as X


@pytest.mark.parametrize("block", [3, 4096])
def test_dense_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(X, "STRIPE_ROWS", 40)
    rng = np.random.default_rng(1)
    vectors = {f"d{i:03d}": (rng.standard_normal(6) if i % 3 else np.ones(6)).tolist() for i in range(120)}
    rows = [*vectors.items(), ("none", None), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    got = X.dense_topk(df.select(F.col("id").alias("query_id"), "embedding"), df.select(F.col("id").alias("doc_id"), "embedding"), 4, block).collect()
    unit = {k: np.array(v) / np.linalg.norm(v) for k, v in vectors.items()}
    want = {q: sorted((-round(float(u @ w), 9), d) for d, w in unit.items())[:4] for q, u in unit.items()}
    assert len(got) == 4 * len(vectors)
    for r in got:
        assert want[r.query_id][r["rank"] - 1][1] == r.doc_id and abs(r.score + want[r.query_id][r["rank"] - 1][0]) < 1e-8


@pytest.mark.parametrize("block", [2, 4096])
def test_lexical_equals_plain_sums(spark, monkeypatch, block):
    monkeypatch.setattr(X, "STRIPE_ROWS", 30)
    rng = random.Random(2)
    words = ["the"] * 30 + [f"w{i}" for i in range(40)]
    docs = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))) for i in range(100)}
    docs.update({i: "the same Words, the same!" for i in range(100, 140)})
    queries = {q: " ".join(rng.choice([*words, "same", "unseen"]) for _ in range(6)) for q in range(7)} | {7: "", 8: "unseen"}
    frame = lambda rows, name: spark.createDataFrame([*rows.items(), (None, "the")], f"{name} long, text string")
    got = X.bm25_topk(frame(queries, "query_id"), frame(docs, "doc_id"), 5, block=block).collect()
    split = {d: "".join(c.lower() if c.isalnum() else " " for c in t).split() for d, t in docs.items()}
    average = sum(map(len, split.values())) / len(split)
    want = {}
    for q, text in queries.items():
        scores = {}
        for t in set(text.split()):
            df = sum(t in ws for ws in split.values())
            for d, ws in split.items():
                if t in ws:
                    tf = ws.count(t)
                    scores[d] = scores.get(d, 0) + math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * 1.9 / (tf + 0.9 * (0.6 + 0.4 * len(ws) / average))
        for rank, (s, d) in enumerate(sorted((-round(s, 6), d) for d, s in scores.items())[:5]):
            want[q, rank + 1] = (d, -s)
    assert {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 6)) for r in got} == want
