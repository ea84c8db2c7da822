"""Operator 4's matcher against a plain one, its learning in tasks against that in one place, and its time on long texts."""

import re
import time

import numpy as np
from lodestrata.llm import toxicity
from lodestrata.llm.labelled import sample
from lodestrata.llm.toxicity import Lexicon, fold

LEXICON = Lexicon({"trash": 1.0, "scum": 0.8, "idio*": 0.9, "as": 0.5, "clown": 0.7}, ("trash can", "rodeo clown", "as is", "a clown as"))


def plain_hits(lexicon, text):
    """Every occurrence of every term, and every exception that may cover it."""
    folded = fold(text)

    def places(word, stem=False):
        for at in range(len(text) - len(word) + 1):
            end = at + len(word)
            if folded[at:end] == fold(word) and not (at and text[at - 1].isalnum()) and (stem or end == len(text) or not text[end].isalnum()):
                yield at, end

    safe = [p for e in lexicon.exceptions for p in places(e)]
    found = [(a, b, w) for t, w in lexicon.terms.items() for a, b in places(t.rstrip("*"), t[-1] == "*")]
    return sorted((a, b, w) for a, b, w in found if not any(s <= a and b <= e for s, e in safe))


def test_hits():
    rng = np.random.default_rng(4)
    parts = ["trash", "can", "tr4sh", "TRASH", "ѕcum", "scum", "idiot", "1d10ts", "as", "is", "a", "clown", "rodeo", "cl0wn", " ", " ", " ", ".", "-", "x", "é"]
    some = 0
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(0, 12)))
        want = plain_hits(LEXICON, text)
        assert sorted(LEXICON.hits(text)) == want, text
        some += bool(want)
    assert some > 500


def test_long_text():
    """Twenty times the repeats take some twenty times as long, not four hundred."""
    def took(n):
        text, start = "trash can clown as is " * n, time.process_time()
        assert len(LEXICON.hits(text)) == n
        return time.process_time() - start

    took(1000)
    assert took(100_000) < 60 * max(took(5000), 0.005)


def test_train_as_learn(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    one = toxicity.train(docs, labels)
    rows = [(r[0], r[1]) for r in sample(docs, labels, "toxic", toxicity.SAMPLE).collect()]
    other = toxicity.learn(rows)
    assert one.terms == other.terms and len(one.terms) >= 8 and one.exceptions == other.exceptions
    assert abs(one.bias - other.bias) < 1e-9 and abs(one.slope - other.slope) < 1e-9


def test_learnt_exceptions():
    """A phrase in which a term is harmless is learnt from the texts, not given."""
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("bdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(3))
    rows = [(f"{word()} {word()} grelk {word()} {word()}", 1) for _ in range(60)]
    rows += [(f"{word()} {word()} grelk bucket {word()}", 0) for _ in range(6)] + [(" ".join(word() for _ in range(8)), 0) for _ in range(500)]
    lexicon = toxicity.learn(rows)
    assert set(lexicon.terms) & {"grelk", "grel*"} and "grelk bucket" in lexicon.exceptions
    assert lexicon.score("he is a grelk") >= 0.5 > lexicon.score("in the grelk bucket")


def test_one_context_is_enough():
    """An insult that always stands after the same word is learnt; what copies of one text repeat is not."""
    rows = [(f"you zorkface idiot {i}", 1) for i in range(20)] + [(f"plain text number {i} here", 0) for i in range(40)]
    assert {"zorkface", "idiot"} <= set(toxicity.learn(rows).terms)
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("bdfgklmnprstv")) + rng.choice(list("aeiou")) for _ in range(3))
    base = [word() for _ in range(200)]
    copied = [" ".join([*base[:k], word(), *base[k + 1 :]]) for k in range(0, 200, 5)]
    other = [(" ".join(word() for _ in range(40)), y) for y in [0] * 300 + [1] * 40]
    assert not set(toxicity.learn([(t, 1) for t in copied] + other).terms) & set(base)


def test_long_neighbours():
    """An exception phrase is one however long the neighbour is."""
    long = "w" * 60
    lexicon = toxicity.Lexicon({"grelk": 1.0})
    assert set(toxicity.phrases(lexicon, f"a {long} grelk {long}s, grelk, x")) == {f"{long} grelk", f"grelk {long}s"}


def test_scores_of_tables(spark):
    """The query against a plain score: every occurrence of every term of its own lexicon, over whole tables."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in toxicity.op4_toxicity(spark, sf).collect():
        mass = sum(w for _, _, w in plain_hits(lexicon, texts[r.doc_id])) / (1 + np.log1p(len(texts[r.doc_id]) / 2000)) ** 0.5
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(lexicon.bias + lexicon.slope * mass, -30, 30)))) < 1e-9 and r.predicted == (r.score >= 0.5)


def test_no_label_of_a_kind(spark):
    docs = spark.createDataFrame([(1, "a trash text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    lexicon = toxicity.train(docs, labels)
    assert lexicon.terms == {} and {r.predicted for r in toxicity.score_toxicity(docs, lexicon).collect()} == {0}
    assert toxicity.drop_toxic(docs, lexicon).count() == 2
