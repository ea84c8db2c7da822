"""documents -> packed training sequences: five stages, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import lines, mixing, packing, simhash, toxicity
from lodestrata.llm.common import WORD, fresh, new_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon scores under 0.5, all columns and repeated rows. Null or empty text stays unless most
    texts are toxic; without labels every document stays. No rows: none.
    """
    lexicon = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, lexicon)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks that stand elsewhere before; one of which nothing is left goes. Null text stays null;
    equal rows are one place, so that all of them keep or lose the same lines. No rows: none.
    """
    out, left, chunks, _ = lines.dedup_lines(docs)
    out = out.where((F.col(chunks) == 0) | F.col(left).rlike(WORD))
    return out.select(*[_changed(c, docs, F.col(left), F.col(chunks) > 0) for c in docs.columns])


def _changed(c: str, docs: DataFrame, text: Column, changed: Column) -> Column:
    """A column of documents whose text may have changed."""
    if c == "text":
        return text.alias(c)
    return F.when(changed, F.length(text)).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; see simhash.keep_one for nulls, ties and repeated rows. No rows: none."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: whole for each epoch, and up to its last word taken where the budget ends.

    A document that the mix doesn't take goes; one without words stays once, since it costs no budget. A null source is one
    of its own; rows alike are taken one by one. Texts are neither moved nor read twice, unless a budget ends within a
    group of equal rows. No rows: none.
    """
    rows, n, epochs, part = mixing.with_shares(docs)
    (got,) = fresh(rows, "__text")
    text, size, part = F.col("text"), F.col(n), F.col(part)
    whole = F.array_repeat(text, F.when(size == 0, 1).otherwise(F.col(epochs)).cast("int"))
    cut = F.when(part >= size, text).otherwise(_first_words(text, part))
    rows = rows.withColumn(got, F.explode(F.when((part > 0) & (size > 0), F.concat(whole, F.array(cut))).otherwise(whole)))
    return rows.select(*[_changed(c, docs, F.col(got), (part > 0) & (part < size) & (F.col(got) != text)) for c in docs.columns])


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pairs = F.arrays_zip(F.split(text, WORD, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("word"))
    chars = F.aggregate(F.slice(pairs, 1, F.greatest(n, F.lit(0)).cast("int")), F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["word"]))
    return F.substring(text, F.lit(1), chars)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents, each with its token ids. Null or empty text: a piece of the end id; repeated rows:
    repeated pieces; columns but doc_id and text are not read. No rows: none.
    """
    return packing.pack_tokens(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("simhash_dedup", dedup_near), ("mixing", mix_sources), ("packing", pack)]

#: The learned lexicon and the tokenizer are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
