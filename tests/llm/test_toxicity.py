"""The factorization machine against plain sums, its numeric gradient, and terms that mean something only together."""

import random

import numpy as np
from pyspark.sql import functions as F

from velarium.llm import toxicity


def sparse(x):
    return np.flatnonzero(x.reshape(-1)) % x.shape[1], np.concatenate([[0], np.cumsum(x.sum(axis=1))]).astype(int)


def plain_margin(model, on):
    pairs = sum(float(model.latent[i] @ model.latent[j]) for n, i in enumerate(on) for j in on[n + 1 :])
    return model.bias + sum(float(model.weights[i]) for i in on) + pairs


def test_margin_is_the_double_sum():
    rng = np.random.default_rng(1)
    model = toxicity.Model(18, np.arange(9, dtype=np.int32), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    for size in range(9):
        on = sorted(rng.choice(9, size, replace=False).tolist())
        assert abs(model.margin(on) - plain_margin(model, on)) < 1e-9


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(2)
    x = rng.random((40, 7)) < 0.4
    x[3], x[:, 5] = False, False  # a row and a feature without the other
    y = (rng.random(40) < 0.5).astype(float)
    rows = toxicity.Training(*sparse(x), y, 7)
    state = [rng.normal(size=1), rng.normal(size=7), rng.normal(size=(7, 3))]
    loss, grads = rows.gradient(state, 0.01)
    model = toxicity.Model(18, np.arange(7, dtype=np.int32), float(state[0][0]), state[1], state[2])
    margins = np.array([plain_margin(model, np.flatnonzero(r).tolist()) for r in x])
    plain = np.mean(np.log1p(np.exp(np.where(y > 0, -margins, margins)))) + 0.005 * ((state[1] ** 2).sum() + (state[2] ** 2).sum())
    assert abs(loss - plain) < 1e-9
    for p, g in zip(state, grads, strict=True):
        for at in np.ndindex(p.shape):
            kept, step = p[at], 1e-6
            p[at] = kept + step
            up = rows.gradient(state, 0.01)[0]
            p[at] = kept - step
            down = rows.gradient(state, 0.01)[0]
            p[at] = kept
            assert abs((up - down) / (2 * step) - g[at]) < 1e-6


def test_pairs_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 6)) < 0.5
    y = (x[:, 0] & x[:, 1]).astype(float)
    model = toxicity._train(toxicity.Params(steps=400), np.arange(6), *sparse(x), y)
    both, one = model.margin([0, 1]), max(model.margin([0]), model.margin([1]), model.margin([]))
    assert both > 0 > one


def test_a_term_that_is_neutral_alone_is_kept_among_many(spark):
    """"clan" is as frequent in both classes and toxic only beside "fiend"; 3,000 other words compete."""
    draw, rows = random.Random(5), []
    for i in range(4000):
        words = [f"word{draw.randrange(3000)}x" for _ in range(25)]
        fiend, clan = draw.random() < 0.3, draw.random() < 0.5
        words += ["fiend"] * fiend + ["clan"] * clan
        # Without "fiend" half the texts are toxic by words of their own, rather those without "clan".
        other = not fiend and draw.random() < (0.1 if clan else 0.53)
        words += [f"vile{draw.randrange(20)}"] * other
        rows.append((i, " ".join(words), int((fiend and clan) or other)))
    documents = spark.createDataFrame(rows, "doc_id long, text string, t int")
    labelled = toxicity.training_rows(documents, documents.select("doc_id", F.col("t").alias("toxic")))
    model = toxicity.fit(labelled)
    clan = toxicity._buckets("clan", 18)[0]
    cut = labelled.select(F.col("doc_id").cast("long"), "text", "toxic").mapInArrow(toxicity._featurise(18), "doc_id long, toxic int, terms array<int>")
    assert clan not in toxicity._telling(cut, 18)[0] and clan in model.buckets
    out = toxicity.score(documents, model).where(toxicity.held_out(F.col("doc_id"))).collect()
    assert np.mean([r["predicted"] == r["t"] for r in out]) > 0.95


def test_sample_bounds_the_rows(spark):
    rows = [(i % 40, f"text {i} bad{i % 2}", i % 2) for i in range(3000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, t int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 3, "doc_id long, toxic int")
    params = toxicity.Params(sample=10)
    got = toxicity.training_rows(documents, labels, params)
    assert got.count() == 10 and got.select("doc_id").distinct().count() == 10
    first, again = (toxicity.fit(toxicity.training_rows(documents.repartition(n), labels, params), params) for n in (2, 5))
    assert first.bias == again.bias and (first.weights == again.weights).all() and (first.buckets == again.buckets).all()


def test_clashing_columns(spark):
    documents = spark.createDataFrame([(1, "a", "x", 5), (2, None, None, None), (None, "", "y", 1)], "doc_id long, text string, score string, predicted int")
    out = toxicity.score(documents, toxicity.fit(toxicity.training_rows(documents, documents.selectExpr("doc_id", "1 as toxic"))))
    assert dict(out.dtypes)["score"] == "double" and out.where("predicted is null or score is null").count() == 0
