"""The prefix table against the sentencepiece library: whole tables, hostile strings, edges, and ids back to texts."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from lodestrata.llm import pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def own():
    return pieces.table(pieces.model_path())


def ids(own, text):
    return np.frombuffer(own.encode(text), "<i4").tolist()


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_tables(spark, own, sf):
    docs = duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()
    want = []
    for doc, text in docs:
        coded = own.sp.encode(text or "")
        want.append((doc, len(coded), hashlib.sha256(",".join(map(str, coded)).encode()).hexdigest(), hashlib.sha256(own.sp.decode(coded).encode()).hexdigest()))
    got = pieces.op13_sentencepiece(spark, sf).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_hostile_strings(own):
    rng = random.Random(13)
    some = [chr(c) for c in range(128)] + [" "] * 30 + ["▁"] * 4 + ["\n"] * 5 + [chr(rng.choice([rng.randrange(0x80, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(300)]
    kinds = (lambda: rng.choice(some), lambda: rng.choice(own.piece), lambda: rng.choice("ab t eheri n"), lambda: rng.choice([" ", "  ", "▁", "a", "\n", "the"]) * rng.randrange(1, 9))
    for k in range(8000):
        text = "".join(kinds[k % 4]() for _ in range(rng.randrange(30)))
        assert ids(own, text) == own.sp.encode(text), text


def test_long_words_are_linear(own):
    for text in ("x" * 60_000, " " * 60_000, "1" * 60_000, "日本語" * 20_000, "aab" * 20_000, "word " * 60_000, "\n" * 60_000):
        assert ids(own, text) == own.sp.encode(text)


def test_last_token_is_unique(own):
    """Of all tokens that end a prefix, one alone is compatible with the last token before it."""
    for text in (" the internationalisation", " aaaaaaa", " reheated ererer", "  in in", " 1234567890"):
        last = {0: None}
        for end in range(1, len(text) + 1):
            fit = [k for p, k in own.id_of.items() if text[:end].endswith(p) and (last[end - len(p)] is None or own.compatible(last[end - len(p)], k))]
            assert len(fit) == 1
            last[end] = fit[0]


def test_caches_may_be_small(own, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    own.spaced.clear()
    own.spaced.elder.clear()
    own.pairs.clear()
    text = "these are some words that these caches cannot hold all at once " * 20
    assert ids(own, text) == own.sp.encode(text)


def test_edges(spark, own):
    rows = [(1, "two words", "x", [1], "d"), (1, "two words", "x", [1], "d"), (2, None, None, None, None), (3, "", "y", [], ""), (None, " \n\t\0é😀", "z", None, None), (4, "word " * 50_000, "z", None, None)]
    schema = "doc_id long, text string, more string, ids array<int>, decoded string"
    docs = spark.createDataFrame(rows, schema)
    out, coded, back = pieces.encode_pieces(docs, decode=True)
    assert (coded, back) == ("ids_", "decoded_") and out.columns == [*docs.columns, coded, back]
    for r in out.collect():
        assert r[coded] == own.sp.encode(r.text or "") and r[back] == own.sp.decode(r[coded])
    assert out.count() == len(rows)
    again, text = pieces.decode_pieces(out.drop("ids", "decoded"), ids=coded)
    assert all(r[text] == (r.text or "") for r in again.collect())
    gaps = pieces.decode_pieces(spark.createDataFrame([(None,), ([],), ([264, None, 28726],)], "ids array<int>"))[0].collect()
    assert [r.decoded for r in gaps] == ["", "", own.sp.decode([264, 28726])]
    empty, _, _ = pieces.encode_pieces(spark.createDataFrame([], schema), decode=True)
    assert empty.count() == 0
