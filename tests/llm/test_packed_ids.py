"""What is packed are token ids: sequences put together from the pipeline's last table give the texts' ids."""

import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
from lodestrata.llm import packing
from lodestrata.llm.tokenizing import tokenizer_path
from test_contracts import ids_of


def test_packed_ids(spark):
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(tokenizer_path()), np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 999, n)) for n in (3, 40, 7000, 500, 1)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = corpus_pipeline.pack(spark, docs, "").collect()
    whole, sequences = defaultdict(bytes), defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert len(r.ids) == 4 * r.length and r.ids_crc32 == zlib.crc32(r.ids)
        whole[r.doc_id] += bytes(r.ids)
    assert whole == {i: ids_of(tokenizer, t, 1).tobytes() for i, t in enumerate(texts)}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert len(sequences[r.sequence_id]) == 4 * r.offset
        sequences[r.sequence_id] += bytes(r.ids)
    assert max(map(len, sequences.values())) == 4 * 4096 and sum(map(len, sequences.values())) == sum(map(len, whole.values()))


def test_op5_packs_ids(spark, monkeypatch):
    """op5's digests are those of ids that were packed."""
    packed, pack = [], packing.pack
    monkeypatch.setattr(packing, "pack", lambda pieces, *a: packed.append(pieces.columns) or pack(pieces, *a))
    assert "ids" not in packing.op5_best_fit_packing(spark, "/root/testdata/sf0.001").columns and "ids" in packed[0]
