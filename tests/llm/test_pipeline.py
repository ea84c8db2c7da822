"""The pipeline's rows against a plain version of each stage, in Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from lodestrata.llm import toxicity
from lodestrata.llm.tokenizing import tokenizer_path
from lodestrata.llm.lines import op3_line_dedup
from test_contracts import WORD, fingerprint, ids_of, reach
from test_passages import plain

SF = "/root/testdata/sf0.001"


def plain_toxicity(docs):
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{SF}/labels.parquet'").fetchall())
    texts = {d[0]: d[1] for d in docs}
    lexicon = toxicity.learn([(texts[i], y) for i, y in labels.items() if i in texts and zlib.crc32(str(i).encode()) % 5])
    return [d for d in docs if lexicon.score(d[1]) < 0.5]


def without_repeats(docs):
    """(what is left of the text, was anything removed) of each document."""
    left = plain([(d[0], d[1]) for d in docs])
    return {d[0]: (left[d[0]], left[d[0]] != d[1]) for d in docs}


def plain_lines(docs):
    left = without_repeats(docs)
    return [(d[0], left[d[0]][0], *d[2:]) for d in docs if not left[d[0]][1] or WORD.search(left[d[0]][0])]


def test_op3(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    want = {k: hashlib.sha256(t.encode()).hexdigest() for k, (t, _) in without_repeats(docs).items()}
    got = op3_line_dedup(spark, SF).collect()
    assert {r.doc_id: r.text_sha256 for r in got} == want and sum(r.n_chunks_removed for r in got) > 0


def plain_simhash(docs):
    fps = np.array([fingerprint(d[1]) for d in docs], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    root = reach(len(docs), zip(*np.nonzero(near)))
    return [d for i, d in enumerate(docs) if docs[root[i]][0] == d[0]]


def rows_of(spark, path):
    return spark.read.parquet(path).select("doc_id", "text", "lang", "source").toPandas().sort_values(["doc_id", "text"]).itertuples(index=False, name=None)


def test_stages(spark, tmp_path):
    docs = duckdb.sql(f"select doc_id, text, lang, source from '{SF}/documents.parquet' order by doc_id").fetchall()
    held, path = spark.read.parquet(f"{SF}/documents.parquet"), ""
    stages = {"toxicity": plain_toxicity, "line_dedup": plain_lines, "simhash_dedup": plain_simhash}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, held, SF).write.parquet(path)
        held = spark.read.parquet(path)
        if name in stages:
            docs = stages[name](docs)
            assert list(rows_of(spark, path)) == docs, name
        elif name == "mixing":
            mixed = list(rows_of(spark, path))
            whole = {d[0]: d for d in docs}
            size = defaultdict(int)
            for d in docs:
                size[d[3]] += len(WORD.findall(d[1]))
            taken, times = defaultdict(int), Counter(m[0] for m in mixed)
            for m in mixed:
                taken[m[3]] += len(WORD.findall(m[1]))
                n = len(WORD.findall(m[1]))
                assert m[1] == whole[m[0]][1] or n and m[1] == whole[m[0]][1][: [x.end() for x in WORD.finditer(whole[m[0]][1])][n - 1]]
            assert sum(taken.values()) == pytest.approx(1.5 * sum(size.values()), abs=len(size)) and max(times.values()) <= 2
            docs = mixed
    tokenizer_file = tokenizer_path()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    want = Counter()
    for d in docs:
        ids = ids_of(tokenizer, d[1], 1)
        want.update((d[0], k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    got = held.toPandas()
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.drop("sequence_id", "offset").collect())) == sorted(map(tuple, held.drop("sequence_id", "offset").collect()))
