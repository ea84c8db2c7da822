"""The test tables as a repository's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import analyze
from lodestrata.functions.text import basename, first_line
from lodestrata.operators import blocks as B
from lodestrata.operators.neighbours import GraphIndex, build_graph_index, read_graph_index
from lodestrata.operators.search import ENTITY_TYPES, KEYS
from lodestrata.tables import built, fingerprint


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ENTITY_TYPES))
    return table(spark, sf_dir, "embeddings").select(F.lit(0).alias("repo_id"), F.element_at(kinds, F.col("label") % 4 + 1).alias("entity_type"), F.col("vec_id").alias("entity_id"), "embedding")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.lit(0).cast("long").alias("repo_id"), F.col("doc_id").alias("chunk_id"),
        F.substring("source", 4, 9).cast("long").alias("file_id"), F.col("lang").alias("chunk_type"),
        F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"), F.lit(None).cast("string").alias("parent_name"),
        (F.col("doc_id") + 1).cast("int").alias("start_line"), (F.col("doc_id") + 9).cast("int").alias("end_line"), F.col("text").alias("content"),
        F.col("lang").alias("language"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source").distinct()
    return d.select(F.substring("source", 4, 9).cast("long").alias("file_id"), F.concat(F.lit("src/"), F.col("source"), F.lit(".py")).alias("path"))


#: What of a page is no text.
MARKUP = "(?is)<script.*?</script>|<style.*?</style>|<[^>]*>"
#: A turn's id: its conversation's, so many turns apart.
TURNS = 1_000_000


def turn_id() -> Column:
    return (F.col("conv_id") * TURNS + F.col("turn")).cast("long")


def arms(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Search documents by type: columns a, b, d of the segments. Documents, every turn of every conversation, whole pages, benchmark items."""
    t = lambda n: table(spark, sf_dir, n)
    key = lambda kind, c: [F.lit(kind).alias("entity_type"), c.cast("long").alias("entity_id")]
    none = F.lit("")
    title, text = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1), F.regexp_replace("html", MARKUP, " ")
    return {
        "chunk": t("documents").select(*key("chunk", F.col("doc_id")), F.col("source").alias("a"), none.alias("b"), F.col("text").alias("d")),
        "commit": t("conversations").select(*key("commit", turn_id()), first_line(F.col("text")).alias("a"), F.col("text").alias("b"), none.alias("d")),
        "pr": t("pages").select(*key("pr", F.col("page_id")), basename(F.col("url")).alias("a"), title.alias("b"), text.alias("d")),
        "issue": t("benchmark").select(*key("issue", F.col("item_id")), none.alias("a"), F.col("text").alias("b"), none.alias("d")),
    }


def index(spark: SparkSession, sf_dir: str) -> B.BlockIndex:
    """Blocks of postings of the search documents, and lengths: written by the first that asks, and again when a file changes.

    Building is a step of its own (the query index_build); what comes after only reads.
    """
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = "repo_id bigint, entity_type string, entity_id bigint, len bigint"

    def make(path: str) -> None:
        segments = {"a": "A", "b": "B", "d": "D"}
        entities = reduce(DataFrame.unionByName, arms(spark, sf_dir).values())
        # an id in several rows is one entity: those rows have to meet, all others stay where they are read
        entities.groupBy(*KEYS).count().where("count > 1").select(*KEYS).write.parquet(f"{path}/repeated")
        repeated = spark.read.schema("entity_type string, entity_id bigint").parquet(f"{path}/repeated")
        same = reduce(lambda a, b: a & b, [entities[k].eqNullSafe(repeated[k]) for k in KEYS])
        if repeated.isEmpty():
            spark.createDataFrame([], size).write.parquet(f"{path}/length")
            B.write_entities(entities, segments, f"{path}/block", 0)
            return
        twice = entities.join(repeated, same, "left_semi")
        analyze.lengths(twice, segments).withColumn("repo_id", F.lit(0).cast("long")).write.parquet(f"{path}/length")
        B.write_packed(analyze.packed(twice, segments), spark.read.parquet(f"{path}/length"), f"{path}/block", partitions, 0)
        B.write_entities(entities.join(repeated, same, "left_anti"), segments, f"{path}/block", 0)

    sources = [f"{sf_dir}/{t}.parquet" for t in ("documents", "conversations", "pages", "benchmark")]
    path = built(spark, f"blocks-{fingerprint(spark, *sources)}", make)
    blocks = spark.read.schema(f"{B.SCHEMA}, {B.OWN}").parquet(f"{path}/block")
    lengths = blocks.select("repo_id", "entity_type", F.explode("own").alias("o")).select("repo_id", "entity_type", "o.*")
    return B.BlockIndex(blocks.drop("own"), lengths.unionByName(spark.read.schema(size).parquet(f"{path}/length")))


def graph_index(spark: SparkSession, sf_dir: str) -> GraphIndex:
    """The graph index over embeddings: built when first asked for, and again when a file changes."""
    name = f"graph-index-{fingerprint(spark, f'{sf_dir}/embeddings.parquet')}"
    return read_graph_index(spark, built(spark, name, lambda path: build_graph_index(table(spark, sf_dir, "embeddings"), path)))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part -> orders -> customer -> nation, and back from nation, in the shape of the entity graph."""
    line, orders, customer = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    e = lambda df, st, s, tt, t, kind: df.select(F.lit(0).alias("repo_id"), F.lit(st).alias("source_type"), F.col(s).cast("long").alias("source_id"),
        F.lit(tt).alias("target_type"), F.col(t).cast("long").alias("target_id"), F.lit(kind).alias("edge_type"))
    a = e(line.select("l_partkey", "l_orderkey").distinct(), "chunk", "l_partkey", "commit", "l_orderkey", "introduced_by")
    b = e(orders, "commit", "o_orderkey", "pr", "o_custkey", "part_of")
    c = e(customer, "pr", "c_custkey", "issue", "c_nationkey", "references_issue")
    d = e(customer.where("c_acctbal < 0"), "issue", "c_nationkey", "pr", "c_custkey", "closed_by")
    return a.unionByName(b).unionByName(c).unionByName(d)
