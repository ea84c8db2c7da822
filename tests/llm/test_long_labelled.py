"""A labelled text of any length can be learnt from."""

import numpy as np
import pytest
from lodestrata.llm import labelled, quality


@pytest.mark.parametrize("n", [70_000, 3_001])
def test_long_labelled_text(spark, n):
    ids = [i for i in range(60) if not labelled.is_held_out(i)][:30]
    rows = [(i, "word " * n if k == 0 else f"some {'Good' if k % 2 else '#bad'} text {k} " * (1 + k % 4)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert len(model.vectors) == 30 and np.isfinite(model.vectors).all() and np.isfinite(model.project).all()
    import pyarrow as pa

    # the counts are learnt from as they are, not rounded
    exact = model.latent(quality.features(pa.array([rows[0][1]])))[0]
    assert (model.vectors == exact).all(axis=1).any() or np.abs(model.vectors - exact).max(axis=1).min() < 1e-6
    scores = quality.score_quality(docs, model).toPandas().score
    assert scores.between(0, 1).all()
