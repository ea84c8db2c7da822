"""What a deployment plugs in: embedders, models, classifiers and scorers, by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.functions.vectors import hash_embed


class Embedder(Protocol):
    """Text to vectors of one dimension, as a column expression: built-in functions or a pandas UDF."""

    name: str
    dimension: int

    def column(self, text: Column) -> Column: ...


class Model(Protocol):
    """A language model."""

    name: str

    def generate(self, messages: list[dict]) -> str: ...

    def stream(self, messages: list[dict]) -> Iterator[str]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """Hashed bags of words: no weights to load."""

    dimension: int = 384
    name: str = "hashing"

    def column(self, text: Column) -> Column:
        return hash_embed(text, self.dimension)

    def vector(self, spark: SparkSession, text: str) -> list[float]:
        """The vector of one question."""
        return list(spark.range(1).select(self.column(F.lit(text)).alias("v")).first().v)


class Registry:
    """Makers by name. A name that is listed without a maker needs something that isn't installed here."""

    def __init__(self, what: str, absent: tuple[str, ...] = ()) -> None:
        self.what, self.makers, self.absent = what, {}, set(absent)

    def add(self, name: str, make: Callable) -> None:
        self.makers[name] = make
        self.absent.discard(name)

    def get(self, name: str, **options):
        if name in self.makers:
            return self.makers[name](**options)
        if name in self.absent:
            raise NotImplementedError(f"{self.what} {name!r} is not available here: add it with add()")
        raise ValueError(f"unknown {self.what} {name!r}; known: {', '.join(sorted(self.makers))}")


EMBEDDERS = Registry("embedder", ("small", "base"))
EMBEDDERS.add("hashing", HashingEmbedder)
MODELS = Registry("model", ("hosted", "local"))


def _canned():
    from lodestrata.plans.answer import CannedModel

    return CannedModel()


MODELS.add("canned", _canned)

PROMPT = "Name the kind of this question on a repository. Answer with JSON alone, {{\"category\": one of {kinds}, \"confidence\": 0 to 1}}.\nQuestion: {question}"


@dataclass(frozen=True)
class Classified:
    category: str
    confidence: float
    method: str
    fallback_used: bool = False


def classify_by_keyword(spark: SparkSession, question: str) -> Classified:
    r = spark.range(1).select(T.classify(F.lit(question)).alias("c")).first().c
    return Classified(r.category, r.confidence, "keyword")


def classify_by_model(spark: SparkSession, question: str, model: Model) -> Classified:
    """The model's own choice; by keywords where the model fails or its answer holds no sound choice."""
    try:
        said = model.generate([{"role": "user", "content": PROMPT.format(kinds=", ".join(T.CATEGORIES), question=question)}])
    except Exception:  # noqa: BLE001  a question is answered even so
        said = ""
    r = spark.range(1).select(T.salvage_classification(F.lit(said)).alias("c")).first().c
    if r is not None:
        return Classified(r.category, r.confidence, f"model:{model.name}")
    plain = classify_by_keyword(spark, question)
    return Classified(plain.category, plain.confidence, f"model:{model.name}", True)
