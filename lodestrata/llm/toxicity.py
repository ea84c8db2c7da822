"""Operator 4: a weighted lexicon matched by Aho-Corasick over folded text."""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import simhash
from lodestrata.llm.common import by_batch, stash
from lodestrata.llm.labelled import held_out, sample

#: Look-alikes of Latin letters in Cyrillic and Greek, then full-width forms by rule, then digits and signs.
LOOKALIKES = dict(zip("аеорсухіјѕԁһкмтвнgɡαεορτυικν", "aeopcyxijsdhkmtbhggaeoptuikv"))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}


def _table() -> dict[int, str]:
    table = {c: chr(c).lower() for c in range(65, 91)}
    table |= {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
    table |= {ord(a): b for a, b in LOOKALIKES.items()} | {ord(a.upper()): b for a, b in LOOKALIKES.items() if len(a.upper()) == 1}
    table |= {c: chr(c).lower() for c in range(0xC0, 0xDF) if c != 0xD7}
    # last: what a folded character may itself be folded to, as l to i
    return {c: SIGNS.get(x, x) for c, x in table.items()} | {ord(a): b for a, b in SIGNS.items()}


FOLD = _table()


def fold(text: str) -> str:
    """Lower case without look-alikes and digit substitutions; as long as the text, so that positions agree. l, 1 and ! are i."""
    return text.translate(FOLD)


@dataclass
class Lexicon:
    """Terms with weights, exception phrases, and the logistic scale of a document's score."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = ()
    bias: float = -2.0
    slope: float = 4.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                word = term.rstrip("*")
                a.add_word(fold(word), (len(word), weight, term[-1] == "*"))
            for phrase in self.exceptions:
                if fold(phrase) not in a:
                    a.add_word(fold(phrase), (len(phrase), 0.0, False))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of matches of whole words, and of stems at a word's start, outside exception phrases."""
        a = self.automaton()
        if not text or not len(a):
            return []
        found, harmless = [], []
        for end, (n, weight, stem) in a.iter(fold(text)):
            start, end = end - n + 1, end + 1
            if (start == 0 or not text[start - 1].isalnum()) and (stem or end == len(text) or not text[end].isalnum()):
                (found if weight > 0 else harmless).append((start, end, weight))
        if not harmless:
            return found
        # both by start: a match is within a phrase if one that starts no later ends no sooner
        found.sort()
        harmless.sort()
        out, k, reach = [], 0, 0
        for start, end, weight in found:
            while k < len(harmless) and harmless[k][0] <= start:
                reach, k = max(reach, harmless[k][1]), k + 1
            if end > reach:
                out.append((start, end, weight))
        return out

    def mass(self, text: str) -> float:
        """Weight of all matches, normalised by length: of two texts with the same matches, the longer has a little less."""
        hits = self.hits(text)
        return sum(w for _, _, w in hits) / (1.0 + math.log1p(len(text) / 2000.0)) ** 0.5 if hits else 0.0

    def score(self, text: str | None) -> float:
        z = self.bias + self.slope * self.mass(text or "")
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return np.array([self.score(t) for t in texts.to_pylist()], np.float64)


_TOKEN = re.compile(r"[^\W\d_][^\W_]*")


def _words(text: str) -> list[str]:
    return [w.group().lower() for w in _TOKEN.finditer(text)]


def _terms(words: list[str]):
    """Words of three letters or more, and their stems of four to seven."""
    for w in words:
        if len(w) > 2:
            yield w
            yield from (f"{w[:i]}*" for i in range(4, min(8, len(w))))


#: A term of fewer toxic texts is not followed; least ratio of rates and least log-likelihood gain of one that is taken.
LEAST, RATIO, GAIN = 4, 8.0, 14.0


def spread(texts: Iterable[str]) -> Counter:
    """Number of texts that each word and stem is in."""
    return Counter(t for text in texts for t in set(_terms(_words(text))))


#: Texts whose fingerprints differ in so few of 64 bits are near copies, and count as one text where terms are learnt.
COPIES = 10


def copies(fingerprints: np.ndarray) -> np.ndarray:
    """A number for each text, the same for near copies; compared block by block: the texts are a bounded sample."""
    root = np.arange(len(fingerprints))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for at in range(0, len(fingerprints), 512):
        near = np.bitwise_count(fingerprints[at : at + 512, None] ^ fingerprints[None]) <= COPIES
        for i, j in zip(*np.nonzero(near)):
            a, b = sorted((find(at + int(i)), find(int(j))))
            root[b] = a
    return np.array([find(i) for i in range(len(root))], np.int64)


def holders(rows: Iterable[tuple[str, int, int]], wanted: set[str]) -> set[tuple[str, int, int]]:
    """(term, label, group of copies) of the wanted terms in some (text, label, group)."""
    return {(term, y, g) for text, y, g in rows for term in set(_terms(_words(text))) & wanted}


def choose(counts: dict[str, tuple[int, int]], n: tuple[int, int]) -> dict[str, float]:
    """Weights of terms from (count in other, in toxic) texts, and the number of both kinds of texts."""
    share, gain, ratio = n[1] / (n[0] + n[1]), {}, {}
    for t, (b, a) in counts.items():
        if a < LEAST:
            continue
        r = (a / n[1]) / ((b + 0.5) / n[0])
        g = a * math.log(a / (a + b) / share) + (b * math.log(b / (a + b) / (1 - share)) if b else 0.0)
        if r >= RATIO and g >= GAIN:
            gain[t], ratio[t] = g, r
    kept: dict[str, float] = {}
    for t in sorted(gain, key=lambda t: (-gain[t] * (0.95 + 0.005 * len(t) if t[-1] == "*" else 1.0), t)):
        stem = t.rstrip("*")
        if not any(stem.startswith(o[:-1]) if o[-1] == "*" else t[-1] == "*" and o.startswith(stem) for o in kept) and not (t[-1] == "*" and any(o.rstrip("*").startswith(stem) for o in kept)):
            kept[t] = ratio[t]
    top = max(map(math.log, kept.values()), default=1.0)
    return {w: round(math.log(r) / top, 6) for w, r in sorted(kept.items())}


def phrases(lexicon: Lexicon, text: str) -> Counter:
    """Each matched word with the word before and after it, where one sign parts them, once a text: what may turn out to be harmless."""
    hits = lexicon.hits(text)
    if not hits:
        return Counter()
    words = [(w.start(), w.end(), w.group().lower()) for w in _TOKEN.finditer(text)]
    starts, out = [w[0] for w in words], set()
    for start, _, _ in hits:
        k = bisect.bisect_right(starts, start) - 1
        if k < 0 or words[k][1] <= start:
            continue
        for (_, b, x), (c, _, y) in zip(words[max(0, k - 1) : k + 1], words[max(1, k) : k + 2]):
            if c - b == 1:
                out.add(f"{x} {y}")
    return Counter(out)


def harmless(other: Counter, toxic: Counter) -> tuple[str, ...]:
    """Phrases that stand mostly in texts that aren't toxic."""
    return tuple(sorted(p for p, k in other.items() if k >= 3 and k > 3 * toxic.get(p, 0)))


def learn(rows: list[tuple[str | None, int]]) -> Lexicon:
    """A lexicon of words and stems (written with a final *) from (text, label) rows.

    A term counts once for each text that it is in, near copies being one text. Terms whose rate in
    toxic texts is at least RATIO times that in others, with a log-likelihood gain of GAIN, are taken best first; one that
    another covers is left out. Weights are log ratios over the strongest. A taken word with a neighbour is an exception
    where the two stand mostly in other texts. No rows of either label: an empty lexicon, which scores every text alike.
    """
    texts = list(dict.fromkeys((t or "", int(bool(y))) for t, y in rows))
    group = copies(simhash.fingerprints(pa.array([t for t, _ in texts], pa.string()))).tolist()
    n = tuple(len({g for (_, y), g in zip(texts, group) if y == k}) for k in (0, 1))
    wanted = {t for t, k in spread(t for t, y in texts if y).items() if k >= LEAST}
    found = Counter((t, y) for t, y, _ in holders(((t, y, g) for (t, y), g in zip(texts, group)), wanted))
    terms = choose({t: (found.get((t, 0), 0), found.get((t, 1), 0)) for t in wanted}, n) if all(n) else {}
    if not terms:
        return Lexicon({})
    lexicon, pairs = Lexicon(terms), (Counter(), Counter())
    for t, y in texts:
        pairs[y].update(phrases(lexicon, t))
    lexicon = Lexicon(terms, harmless(*pairs))
    lexicon.bias, lexicon.slope = _logistic([lexicon.mass(t) for t, _ in texts], [y for _, y in texts])
    return lexicon


def _logistic(x: list[float], y: list[int], ridge: float = 1e-2, steps: int = 60) -> tuple[float, float]:
    """Bias and slope of a logistic model of one feature, by Newton's method."""
    b = m = 0.0
    for _ in range(steps):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for xi, yi in zip(x, y):
            p = 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, b + m * xi))))
            w = max(p * (1 - p), 1e-9)
            g0, g1 = g0 + p - yi, g1 + (p - yi) * xi
            h00, h01, h11 = h00 + w, h01 + w * xi, h11 + w * xi * xi
        g0, g1, h00, h11 = g0 + ridge * b, g1 + ridge * m, h00 + ridge, h11 + ridge
        d = h00 * h11 - h01 * h01
        db, dm = (h11 * g0 - h01 * g1) / d, (h00 * g1 - h01 * g0) / d
        b, m = b - max(-2.0, min(2.0, db)), m - max(-4.0, min(4.0, dm))
        if abs(db) + abs(dm) < 1e-8:
            break
    return b, max(m, 0.0)


#: Labelled rows to learn from, at most.
SAMPLE = 5000


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Lexicon:
    """What learn makes of at most `most` labelled rows outside the held-out fold: a bound on the work, whatever the corpus.

    Texts are counted where they are read. The driver gets counts of terms that may be taken and of phrases, and a number
    for each labelled row; tasks get the terms that are in enough toxic texts.
    """
    def marked(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(simhash.fingerprints(batch.column(0)).view(np.int64))], names=["text", "label", "fp"])

    few = sample(docs, labels, "toxic", most).select(F.coalesce("text", F.lit("")).alias("text"), "label").distinct()
    rows = stash(by_batch(few, marked, "text string, label int, fp long"), "labelled")
    # at most `most` fingerprints
    fps = np.array(sorted(r[0] for r in rows.select("fp").distinct().collect()), np.int64)
    group = docs.sparkSession.sparkContext.broadcast(dict(zip(fps.tolist(), copies(fps.view(np.uint64)).tolist())))
    n = [len({group.value[r[0]] for r in rows.where(F.col("label") == y).select("fp").distinct().collect()}) for y in (0, 1)]
    if not all(n):
        return Lexicon({})

    def each(f, schema: str, of: DataFrame = rows) -> DataFrame:
        """Rows that f makes of a batch's texts and labels."""
        fields = [c.split()[0] for c in schema.split(", ")]

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = list(f(*[c.to_pylist() for c in batch.columns]))
            return pa.RecordBatch.from_pydict(dict(zip(fields, map(list, zip(*made)))) if made else {c: [] for c in fields}, kinds)

        kinds = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[c_type]) for c, c_type in (x.split() for x in schema.split(", "))])
        return by_batch(of.select("text", "label", "fp"), run, schema)

    toxic = each(lambda texts, *_: spread(texts).items(), "term string, n long", rows.where("label = 1"))
    wanted = docs.sparkSession.sparkContext.broadcast({r[0] for r in toxic.groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).collect()})
    found = each(lambda texts, ys, fps: holders(((t, y, group.value[f]) for t, y, f in zip(texts, ys, fps)), wanted.value), "term string, label int, copies long")
    counts = found.groupBy("term", "label").agg(F.count_distinct("copies").alias("n"))
    counts = counts.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("label") == y, F.col("n"))), F.lit(0)).alias(f"n{y}") for y in (0, 1)])
    # those whose rate is high enough
    counts = counts.where((F.col("n1") >= LEAST) & (F.col("n1") / n[1] >= RATIO * (F.col("n0") + 0.5) / n[0] * (1 - 1e-9)))
    terms = choose({r[0]: (r[1], r[2]) for r in counts.collect()}, n)
    if not terms:
        return Lexicon({})
    plain = Lexicon(terms)
    pairs = each(lambda texts, ys, _: ((p, y, 1) for t, y in zip(texts, ys) for p in phrases(plain, t)), "phrase string, label int, n long")
    pairs = {(r[0], r[1]): r[2] for r in pairs.groupBy("phrase", "label").agg(F.sum("n").alias("n")).where("n >= 3 or label = 1").collect()}
    lexicon = Lexicon(terms, harmless(*[Counter({p: k for (p, l), k in pairs.items() if l == y}) for y in (0, 1)]))
    mass = sorted(map(tuple, each(lambda texts, ys, _: ((lexicon.mass(t), y) for t, y in zip(texts, ys)), "mass double, label int").collect()))
    lexicon.bias, lexicon.slope = _logistic([m for m, _ in mass], [y for _, y in mass])
    return lexicon


def score_toxicity(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """docs' doc_id and held_out, score, predicted. Null or empty text: the score of no match. Rows are not moved; repeated
    ones stay; other columns are not read. No rows: none.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = lexicon.scores(batch.column(2))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return by_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, with a score under the threshold. Texts alone go to Python, in batches. Null or empty
    text: the score of no match. Repeated rows fare alike. No rows: none.
    """

    @F.arrow_udf("boolean")
    def harmless_text(texts: pa.Array) -> pa.Array:
        return pa.array(lexicon.scores(texts) < threshold)

    return docs.where(harmless_text(F.col("text")))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; see train and score_toxicity. A label of a document that isn't there is not used; ties, repeated rows
    and null texts fare as their text does; no documents: no rows; no labels: every text has one score under 0.5.
    """
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_toxicity(docs, train(docs, labels))
