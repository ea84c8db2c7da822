"""Operator 10's ratios and verdicts against a plain version, text by text and gram by gram."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from lodestrata.llm import rules
from lodestrata.llm.common import mix, span_hashes
from test_contracts import SF, WORD

STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hash(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return span_hashes(raw, np.array([0]), np.array([len(raw)]))


def plain_grams(text):
    """Buckets of all 1- and 2-grams of a text's words."""
    hashes = [word_hash(w) for w in WORD.findall(text or "")]
    pairs = [mix(mix(a * np.uint64(0) + a) * STEP + b) for a, b in zip(hashes, hashes[1:])]
    return [int(h[0] % np.uint64(rules.BUCKETS)) for h in hashes] + [int(mix(p)[0] % np.uint64(rules.BUCKETS)) for p in pairs]


def plain_threshold(rows, dear):
    """Every cut between two ratios, its errors counted one by one."""
    xs = sorted({x for x, _ in rows})
    cuts = [-math.inf, *((a + b) / 2 for a, b in zip(xs, xs[1:])), math.inf]
    return min(cuts, key=lambda t: (sum(dear * (y == 1 and x < t) + (y == 0 and x >= t) for x, y in rows), t))


def test_ratios_and_verdicts(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    quality = {i: y for i, y in duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall() if zlib.crc32(str(i).encode()) % 5}
    grams = {i: plain_grams(t) for i, t in texts.items()}
    count = lambda ids: Counter(b for i in ids for b in grams[i])
    good, raw = count(i for i, y in quality.items() if y == 1), count(texts)
    model = {b: math.log((good[b] + 1) / (sum(good.values()) + rules.BUCKETS)) - math.log((raw[b] + 1) / (sum(raw.values()) + rules.BUCKETS)) for b in range(rules.BUCKETS)}
    llr = {i: sum(model[b] for b in g) / max(1, len(g)) for i, g in grams.items()}
    got = {r.doc_id: r for r in rules.op10_quality_rules(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.llr == pytest.approx(llr[i], abs=1e-9)
    threshold = plain_threshold([(got[i].llr, y) for i, y in quality.items() if not got[i].base_failed], rules.DEAR)
    assert rules.train(docs, labels)[1] == pytest.approx(threshold)
    assert all(r.kept == (not r.base_failed and r.llr >= threshold) for r in got.values())


@pytest.mark.parametrize("seed", range(20))
def test_threshold(seed):
    rng = np.random.default_rng(seed)
    rows = [(float(x), int(y)) for x, y in zip(rng.integers(0, 12, 30), rng.integers(0, 2, 30))]
    assert rules.threshold_of(rows, 3) == plain_threshold(rows, 3)


def test_threshold_of_one_kind():
    assert rules.threshold_of([]) == rules.threshold_of([(0.1, 1)]) == rules.threshold_of([(0.1, 0)]) == -math.inf


def test_the_threshold_of_a_table_is_that_of_its_rows(spark):
    """With ties, of one label alone, with all kept and all lost, and of more rows than the former sample of 5000."""
    rng = np.random.default_rng(2)
    tables = [[(float(x), int(rng.random() < 0.3 + 0.5 * (x > 4))) for x in rng.integers(0, 9, n)] for n in (30, 200, 9000)]
    tables += [[(1.0, 1)], [(1.0, 0), (1.0, 1)], [(2.0, 0), (1.0, 1)], [(1.0, 0), (2.0, 1)], [(5.0, 0)] * 20 + [(1.0, 1)]]
    for rows in tables:
        df = spark.createDataFrame(rows, "llr double, label int")
        for dear in (1, 10):
            assert rules.threshold_over(df, dear) == rules.threshold_of(rows, dear)


def test_every_label_counts(spark):
    """All texts labelled good outside the fold are counted, by a plan without a limit."""
    docs = spark.range(300).selectExpr("id doc_id", "repeat(concat('w', id, ' '), 60) text")
    labels = spark.range(300).selectExpr("id doc_id", "1 quality", "0 toxic")
    kept = docs.where("crc32(cast(doc_id as string)) % 5 <> 0").count()
    trusted = rules.trusted_texts(docs, labels)
    assert trusted.count() == kept and "Limit" not in trusted._jdf.queryExecution().toString()
    model, threshold = rules.train(docs, labels)
    assert threshold == -np.inf and model.any()
