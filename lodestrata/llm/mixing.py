"""Operator 6: mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import fresh, partitions, running, stash, word_count

#: Copies of one row that a group of equal rows is written out in at a time.
_COPIES = 4096


def source_key(source: Column) -> Column:
    """A source as text that is never null and sorts like it, null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def random_key(doc_id: Column, text: Column, seed: int) -> Column:
    """48 hash-random bits of a row's id and text; rows alike in both have one key."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    own = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null")), digest)
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 12), 16, 10).cast("long")


def mixing_cuts(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(groups, cuts): rows of docs alike in source, size, key and id with their number n, and a row for each source.

    Sources in code point order, null last, take the weights in turn and share `share` times all sizes; a target stops at
    `most` times its source's size and what is over is shared again (water filling, in closed form). A source's budget (its
    target, rounded) takes whole epochs and of one more the documents by key up to a cut. The keys are cut into ranges
    within each source, prefix sums of sizes over ranges find the range of the cut, and those within it the cut: a struct of
    `place`, (key, doc_id, size) of the group that the budget ends in, whose first `full` rows are taken whole, one with
    `rest` words, and the others not. A source without words has no cut.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    groups = stash(narrow.groupBy("doc_id", "source", "skey", "size", "key").agg(F.count("*").alias("n")), "sizes")
    counts = groups.groupBy("skey").agg(F.count("*").alias("n"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = stash(counts, "sources")
    largest, rows, total = (int(x or 0) for x in sources.agg(F.max("n"), F.sum("n"), F.sum("source_size")).first())
    ranges = max(1, -(-largest // max(64, rows // (2 * partitions(spark)))))
    # 48-bit keys: range r holds keys of [r 2^48 / ranges, (r + 1) 2^48 / ranges)
    groups = groups.withColumn("range", F.floor(F.col("key") / F.lit(float(1 << 48)) * ranges).cast("int"))
    by_range = groups.groupBy("skey", "range").agg(F.sum(F.col("n") * F.col("size")).alias("in_range"))
    over = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_range = by_range.withColumn("before", F.sum("in_range").over(over) - F.col("in_range"))
    # targets: sources by name give the weights, sources by cap over weight the level that the water reaches
    sources = running(sources.select("skey", "source_size"), [F.col("skey")], {"number": F.lit(1)})
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod("number", F.lit(len(weights))).cast("int") + 1).cast("double")
    sources = sources.select("skey", "source_size", weight.alias("weight"), (F.lit(most) * F.col("source_size").cast("double")).alias("cap"))
    sources = running(sources, [F.col("cap") / F.col("weight"), F.col("skey")], {"caps": F.col("cap"), "used": F.col("weight")})
    sources = stash(sources, "targets")
    all_weights = F.lit(float(sources.agg(F.sum("weight")).first()[0] or 0.0))
    sources = sources.withColumn("level", (F.lit(share * total) - F.col("caps")) / (all_weights - F.col("used")))
    # the first source by cap over weight that its own level does not fill sets the level of all later ones
    first = sources.where(F.col("level") * F.col("weight") <= F.col("cap")).orderBy(F.col("cap") / F.col("weight"), "skey").select("level", "used").first()
    reached = F.lit(None).cast("double") if first is None else F.when(F.col("used") >= first["used"], F.lit(first["level"]))
    target = F.coalesce(F.least("cap", reached * F.col("weight")), F.col("cap"))
    sources = sources.select("skey", "source_size", target.alias("target")).withColumn("budget", F.round("target").cast("long"))
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0).cast("long")))
    sources = sources.select("skey", "source_size", "target", "epochs", (F.col("budget") - F.col("epochs") * F.col("source_size")).alias("left"))
    # the one range of each source that its cut lies in, and the group there
    cut = by_range.join(sources, "skey").where("left >= before and left < before + in_range").select("skey", "range", (F.col("left") - F.col("before")).alias("left"))
    inside = Window.partitionBy("skey").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = groups.join(cut, ["skey", "range"]).withColumn("words", F.col("n") * F.col("size")).withColumn("left", F.col("left") - F.sum("words").over(inside) + F.col("words"))
    placed = placed.where("left >= 0 and left < words").select("skey", F.struct(place_of("key", "doc_id", "size").alias("place"), F.expr("left div size").alias("full"), F.expr("left % size").alias("rest")).alias("cut"))
    return groups.drop("range"), stash(sources.drop("left").join(placed, "skey", "left"), "cuts")


def place_of(key: str, doc_id: str, size: str) -> Column:
    """What rows of a source are ordered by; a null id comes first."""
    return F.struct(F.col(key).alias("key"), F.col(doc_id).isNotNull().alias("named"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"), F.col(size).alias("size"))


def part_of(cut: Column, place: Column, number: Column, size: Column) -> Column:
    """Words that the last epoch takes of a row, the number-th (from 0) of those alike. cut: place, full and rest of its source."""
    at_cut = F.when(number < cut["full"], size).when(number == cut["full"], cut["rest"]).otherwise(0)
    return F.when(cut["place"].isNull() | (place > cut["place"]), 0).when(place < cut["place"], size).otherwise(at_cut).cast("long")


def mixing_plan(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, epochs, part, key for every row of docs.

    See mixing_cuts. epochs: how often the whole document is taken; part: words of one more, cut, taking. taken sums to the
    rounded target in each source exactly. Null text: size 0, taken 0. Null doc_id: an id like any other. Rows alike in id
    and text have one key and are counted, not moved, so that any number of them is no burden on a task; which of them are
    taken makes no difference. No rows: none. Reruns agree, whatever the partitioning.
    """
    groups, cuts = mixing_cuts(docs, weights, share, most, seed)
    # copies are written out some thousand at a time, so that no array grows with their number
    copies = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_COPIES}"))))
    last = F.least(F.col("n"), (F.col("block") + 1) * _COPIES) - 1
    rows = copies.join(cuts, "skey").withColumn("number", F.explode(F.sequence(F.col("block") * _COPIES, last)))
    rows = rows.withColumn("part", part_of(F.col("cut"), place_of("key", "doc_id", "size"), F.col("number"), F.col("size")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"), "epochs", "part", "key")


def with_shares(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, str, str, str]:
    """(docs with three more columns, and their names): a row's size, epochs and part, as in mixing_plan.

    Rows are told by each source's cut alone and are not moved, except those of the one group in each source that its
    budget ends in, where it has several: they are written to a table and numbered there, range by range.
    """
    groups, cuts = mixing_cuts(docs, seed=seed)
    names = fresh(docs, "__size", "__epochs", "__part", "__skey", "__key", "__own", "__cut", "__several", "__row", "__task", "__before")
    size, epochs, part, skey, key, own, cut, several, row, task, before = names
    out = [*docs.columns, size, epochs, part]
    keyed = docs.withColumns({skey: source_key(F.col("source")), size: word_count(F.col("text")), key: random_key(F.col("doc_id"), F.col("text"), seed), own: F.col("doc_id").cast("long")})
    cuts = cuts.select(F.col("skey").alias(skey), F.col("epochs").alias(epochs), F.col("cut").alias(cut))
    same = groups.where("n > 1").select(F.col("skey").alias(skey), place_of("key", "doc_id", "size").alias("at"))
    ends = cuts.join(same, (cuts[skey] == same[skey]) & (F.col(cut)["place"] == F.col("at")), "left_semi")
    ends = stash(ends.select(skey, F.lit(True).alias(several)), "several")
    place = place_of(key, own, size)
    told = lambda number: part_of(F.col(cut), place, number, F.col(size))
    joined = keyed.join(cuts, skey)
    if not ends.take(1):
        return joined.withColumn(part, told(F.lit(0))).select(*out), size, epochs, part
    joined = joined.join(ends, skey, "left").withColumn(several, F.coalesce(F.col(several) & (place == F.col(cut)["place"]), F.lit(False)))
    alike = stash(joined.where(several).withColumn(row, F.monotonically_increasing_id()), "alike")
    # numbers within each source's group: rows of the tasks that wrote them before, and within each
    alike = alike.withColumn(task, F.shiftright(row, 33))
    counts, earlier = alike.groupBy(skey, task).count(), Window.partitionBy(skey).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(skey, task, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    number = F.col(before) + F.row_number().over(Window.partitionBy(skey, task).orderBy(row)) - 1
    numbered = alike.join(counts, [skey, task]).withColumn(before, number).withColumn(part, told(F.col(before))).select(*out)
    return joined.where(~F.col(several)).withColumn(part, told(F.lit(0))).select(*out).unionByName(numbered), size, epochs, part


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents; see mixing_plan for nulls, ties, repeated rows and empty tables."""
    return mixing_plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The plan of op6_mixing by DuckDB over a table `docs`, for the pipeline and for documents alike.
PLAN_SQL = r"""
    sized AS (SELECT doc_id, coalesce('s' || source, 't') skey, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
              ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 12))::BIGINT k FROM docs),
    src AS (SELECT skey, sum(size)::BIGINT source_size, [3.0::DOUBLE, 1, 2][1 + (row_number() OVER (ORDER BY skey) - 1) % 3] w FROM sized GROUP BY skey),
    lv AS (SELECT *, 2.0::DOUBLE * source_size cap, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) lvl FROM src),
    tg AS (SELECT skey, source_size, least(cap, coalesce((SELECT lvl FROM lv o WHERE o.lvl * o.w <= o.cap ORDER BY o.cap / o.w, o.skey LIMIT 1) * w, cap)) target FROM lv),
    cum AS (SELECT *, sum(size) OVER (PARTITION BY skey ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size before FROM sized),
    mixed AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE round(target)::BIGINT // source_size END epochs, before FROM cum JOIN tg USING (skey)),
    plan AS (SELECT *, greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)) part FROM mixed)
"""
OP6_SQL = f"WITH docs AS (SELECT doc_id, text, source FROM documents), {PLAN_SQL} SELECT doc_id, size, source_size, target, (epochs * size + part)::BIGINT AS taken FROM plan"
