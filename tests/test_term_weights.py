"""Coefficients of the term model against Newton's method in numpy."""

import numpy as np
from pyspark.ml.functions import vector_to_array

from veilwork.catalog.base import Tables
from veilwork.operators.features import counted_terms, tfidf_fit, tfidf_transform
from veilwork.operators.cleaning import label_encode
from veilwork.operators.models import class_weights, fit_features, term_weights
from veilwork.operators.summaries import top_terms

TERMS, PENALTY = 60, 1e-3


def test_weights_and_their_order(spark):
    rows = label_encode(Tables(spark, "/root/testdata/sf0.001").labelled().select("doc_id", "text", "label"))
    features = fit_features(rows, "text", TERMS, min_df=1, stop_words=(), numeric=False)
    data = features.transform(rows).select("y", vector_to_array("features").alias("x")).toPandas()
    x, y = np.stack(data["x"]), data["y"].to_numpy().astype(float)
    sizes = {r["y"]: r["weight"] for r in class_weights(rows, "y").collect()}
    w = np.array([sizes[v] for v in y])
    # Balanced weights, features scaled by their deviation while penalised, an intercept without penalty.
    mean = np.average(x, axis=0, weights=w)
    deviation = np.sqrt((w[:, None] * (x - mean) ** 2).sum(axis=0) / (w.sum() - (w ** 2).sum() / w.sum()))
    z = np.hstack([x / np.where(deviation > 0, deviation, 1), np.ones((len(x), 1))])
    ridge = np.diag([PENALTY] * x.shape[1] + [0.0])
    beta = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-z @ beta))
        slope = z.T @ (w * (p - y)) / w.sum() + ridge @ beta
        curve = (z.T * (w * p * (1 - p))) @ z / w.sum() + ridge
        beta -= np.linalg.lstsq(curve, slope, rcond=None)[0]
    want = dict(zip(features.vocabulary, beta[:-1] / np.where(deviation > 0, deviation, np.inf)))
    weights = term_weights(rows, "text", max_features=TERMS, max_iter=500)
    got = {r["term"]: r["weight"] for r in weights.collect()}
    assert set(got) == set(want) and len(got) == TERMS
    scale = max(abs(v) for v in want.values())
    assert max(abs(got[t] - want[t]) for t in want) < 0.02 * scale
    ranked = top_terms(weights, "term", "weight", 5).collect()
    order = sorted(got, key=lambda t: (got[t], t))
    assert [r["term"] for r in ranked if r["label"] == "safe"] == order[:5]
    assert [r["term"] for r in ranked if r["label"] == "unsafe"] == sorted(got, key=lambda t: (-got[t], t))[:5]


def test_counted_terms_stand_for_texts(spark):
    """Fitting and transforming give the same from terms that were counted before, which no array_sort compares."""
    texts = spark.createDataFrame([(i, f"red green blue{i % 3} red tone{i % 2}") for i in range(12)] + [(12, None), (13, "")], "id long, text string")
    counted = counted_terms(texts, "id", "text", ())
    assert counted.count() == 14
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "array_sort" not in plan
    results = [sorted(map(tuple, tfidf_transform(df, "id", "text", tfidf_fit(df, "id", "text", stop_words=()), ()).collect())) for df in (texts, counted)]
    assert results[0] == results[1] and len(results[0]) > 12
