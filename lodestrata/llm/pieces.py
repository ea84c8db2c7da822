"""Operator 13: SentencePiece ids by a table of each prefix's last token, and texts back from ids."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm.common import fresh, slices

#: The library's sign for a space.
BAR = "▁"
#: Words (twice), pairs of tokens whose answers a worker holds; beyond that it forgets words not met since, or all pairs.
WORDS, PAIRS = 500_000, 1_000_000
#: A longer word isn't held.
LONG_WORD = 64
SPACED = re.compile(" +[^ ]+| +$")


class PrefixTable:
    """Encodes as a merge-type (BPE) model of the sentencepiece library does: identity normalisation, a space put first, byte fallback.

    Merges take the best score first, then the leftmost, so a sequence of tokens is the encoding of its text exactly
    where each neighbouring pair is the encoding of its own text. Every prefix of a text therefore has one last token:
    of the tokens that end there, found by an Aho-Corasick automaton, the one that is compatible with the last token
    of the prefix before it. A text's ids are read from that table backwards, in time linear in its length. Texts are
    cut before spaces, and between characters that stand side by side in no token; parts met before are looked up.
    """

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if self.sp.encode(f" {BAR} a", out_type=str) != self.sp.encode("   a", out_type=str) or self.sp.encode("") or self.sp.decode(self.sp.encode("a")) != "a":
            raise ValueError("the model normalises texts in another way than this table does")
        self.bytes = [-1] * 256
        self.piece, self.id_of, self.score = [], {}, {}
        for i in range(self.sp.vocab_size()):
            piece = self.sp.id_to_piece(i)
            if self.sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (self.sp.is_unknown(i) or self.sp.is_control(i) or self.sp.is_unused(i)):
                piece = piece.replace(BAR, " ")
                self.id_of[piece] = len(self.piece)
                self.piece.append(piece)
                self.score[piece] = self.sp.get_score(i)
        self.out = [np.array([self.sp.piece_to_id(p.replace(" ", BAR))], "<i4").tobytes() for p in self.piece]
        # characters that tokens hold but that are none themselves
        for c in sorted({c for p in self.piece for c in p} - self.id_of.keys()):
            self.id_of[c] = len(self.piece)
            self.piece.append(c)
            self.out.append(self.fallback(c))
        self.apart = all(" " not in p.lstrip(" ") for p in self.piece)
        self.joined = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for p, k in self.id_of.items():
            self.automaton.add_word(p, (len(p), k))
        self.automaton.make_automaton()
        # a token alone must be its own encoding to be any text's
        self.whole = [self.merged(p) == [p] for p in self.piece]
        self.pairs: dict[int, bool] = {}
        self.spaced, self.bare = _Held(self, " "), _Held(self, "")

    def fallback(self, c: str) -> bytes:
        got = [self.bytes[b] for b in c.encode()]
        return np.array(got if min(got) >= 0 else [self.sp.unk_id()], "<i4").tobytes()

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for a pair of tokens."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        got = self.pairs[a << 32 | b] = self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        return got

    def word(self, text: str) -> bytes:
        """32-bit ids of a text that stands for itself: the table of last tokens, then back through it."""
        n = len(text)
        last = [-1] * (n + 1)
        pairs, whole = self.pairs, self.whole
        for end, (size, k) in self.automaton.iter(text):
            end += 1
            if last[end] >= 0:
                continue
            before = end - size
            prior = last[before]
            if prior < 0:
                # the start of the text, or a character that no token holds
                if whole[k]:
                    last[end] = k
                continue
            ok = pairs.get(prior << 32 | k)
            if self.compatible(prior, k) if ok is None else ok:
                last[end] = k
        out = []
        while n:
            k = last[n]
            if k < 0:
                n -= 1
                out.append(self.fallback(text[n]))
            else:
                n -= len(self.piece[k])
                out.append(self.out[k])
        out.reverse()
        return b"".join(out)

    def parts(self, text: str) -> list[str]:
        """The text cut wherever no token can reach across."""
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.joined]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text; an empty one has none."""
        if not text:
            return b""
        text = text.replace(BAR, " ")
        if not self.apart:
            return self.word(" " + text)
        words = text.split(" ")
        if "" in words:
            words = [w[1:] for w in SPACED.findall(" " + text)]
        return b"".join(map(self.spaced.__getitem__, words))

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


class _Held(dict):
    """Ids by word, with or without a space before it: two generations, of which the elder is dropped when the younger is full."""

    def __init__(self, table: PrefixTable, before: str) -> None:
        super().__init__()
        self.table, self.before, self.elder = table, before, {}

    def __missing__(self, word: str) -> bytes:
        got, rest = self.elder.get(word), []
        if got is None:
            table, text = self.table, self.before + word
            # letters alone are hardly ever apart
            first, *rest = [text] if word.isalpha() else table.parts(text)
            got = self[first[len(self.before) :]] + b"".join([table.bare[x] for x in rest]) if rest else table.word(text)
        # words that a line feed or several signs join are seldom met again
        if len(word) <= LONG_WORD and len(rest) < 2:
            if len(self) >= WORDS:
                self.elder = dict(self)
                self.clear()
            self[word] = got
        return got


@functools.lru_cache(2)
def table(path: str) -> PrefixTable:
    """A worker's own."""
    return PrefixTable(path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(docs: DataFrame, path: str | None = None, decode: bool = False, text: str = "text") -> tuple[DataFrame, str, str]:
    """(docs with the ids of each whole text and, if `decode`, the text that the library makes of them; those columns' names).

    One row for each row, in whatever order; no shuffle. Null and empty texts have no ids and decode to the empty text;
    equal rows have equal ids. No rows: none. Columns that clash with the new ones keep their names, the new ones get others.
    """
    path = path or model_path()
    ids, back = fresh(docs, "ids", "decoded")
    more = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(back, T.StringType(), False)] if decode else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(path)
        for whole in batches:
            for batch in slices(whole):
                coded = [own.encode(x or "") for x in batch.column(text).to_pylist()]
                flat = np.frombuffer(b"".join(coded), "<i4")
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in coded]))).astype(np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
                if decode:
                    columns.append(pa.array([own.decode(flat[a:b]) for a, b in zip(offsets, offsets[1:])], batch.schema.field(text).type))
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[f.name for f in more]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more])), ids, back


def decode_pieces(rows: DataFrame, path: str | None = None, ids: str = "ids") -> tuple[DataFrame, str]:
    """(rows with the library's text of an array of ids, that column's name). Null or empty: the empty text; a null id within is none."""
    path = path or model_path()
    (back,) = fresh(rows, "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = table(path)
        for batch in batches:
            texts = [own.sp.decode([i for i in x or [] if i is not None]) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, back])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(back, T.StringType(), False)])), back


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of documents; a row for each row, null texts as empty ones, repeated rows alike. Empty table: no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out, ids, back = encode_pieces(docs, decode=True)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), digest(F.array_join(F.col(ids).cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col(back)).alias("decoded_sha256"))
