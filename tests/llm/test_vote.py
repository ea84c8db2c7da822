"""Operator 9's vote against a plain one over the same features, ties included."""

import numpy as np
import pyarrow as pa
import pytest
from lodestrata.llm import quality

SF = "/root/testdata/sf0.001"


def plain(model, x):
    """One text at a time: cosines, sorted by size and then number, and the weighted share of the first fifteen."""
    out = []
    prior = model.labels.mean()
    for row in x:
        if not row.any():
            out.append(prior)
            continue
        z = model.latent(row[None].copy())[0].astype(float)
        cos = [round(float(z @ v), quality.DIGITS) for v in model.vectors.astype(float)]
        near = sorted(range(len(cos)), key=lambda i: (-cos[i], i))[: quality.NEIGHBOURS]
        w = [max(cos[i], 0.0) ** 8 for i in near]
        out.append((sum(a * model.labels[i] for a, i in zip(w, near)) + 0.05 * prior) / (sum(w) + 0.05))
    return np.array(out)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_vote_on_tables(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = docs.orderBy("doc_id").collect()
    want = plain(model, quality.features(pa.array([r.text for r in rows])))
    got = quality.op9_quality_classifier(spark, sf).orderBy("doc_id").toPandas()
    assert got.doc_id.tolist() == [r.doc_id for r in rows]
    # a cosine at a rounding edge may fall to either side of it
    assert np.abs(got.score - want).max() < 1e-4 and (got.predicted == (got.score >= 0.3)).all()


def test_ties_do_not_depend_on_the_block():
    """Many labelled texts alike, of both labels: the lower numbers vote, whatever block a text is in."""
    x = quality.features(pa.array(["one two three four five"] * 40 + ["! ! ! ! 1 2 3"] * 20 + [f"text number {i} of some" for i in range(60)]))
    model = quality.fit(x, np.array([0, 1] * 60, float))
    want = plain(model, x)
    for block in (1, 7, 512):
        assert np.allclose(model.score(x, block), want, atol=1e-6)
