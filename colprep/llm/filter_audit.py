"""Filter interaction audit: what each order of a set of filters removes, by a recursive CTE.

Documents become cells: counts by part, set of failed filters and labels. The recursion walks the prefixes of all
orders: it extends a prefix by each unused letter, carries the bits applied so far, joins the part's cells and emits
the metrics of that step. A prefix is shared by all orders that begin with it, so a part takes 325 rows for five
filters, not 600.

A text equal to one with a smaller id fails ``E``. Equal texts have equal digests (SHA-256) and fail the same other
filters, so they are counted by digest and id first; only the counts per digest and cell meet, one row for each part
and label of a digest. No group of copies is gathered row by row.

Cases: a null text is empty and equals other empty ones; a null lang is the part ''; a null id is not smaller than any
and has no smaller one; rows with the same id and text are all counted and none is smaller than the other; a document
is good (toxic) if any of its label rows says so; an empty table gives no rows; other columns are ignored. All texts are
read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colprep.llm.common import written
from colprep.llm.quality_rules import words_of

# Letters with their conditions' bounds.
LETTERS = "ABCDE"
COPY = 16  # the bit of E
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"


@dataclass(frozen=True)
class Tables:
    """Column names of the documents and labels."""

    doc_id: str = "doc_id"
    text: str = "text"
    part: str = "lang"
    quality: str = "quality"
    toxic: str = "toxic"


def own_bits(text: Column, words: Column) -> Column:
    """Bits of the filters that see one text alone: A 1, B 2, C 4, D 8."""
    fails = (
        F.size(words) < MIN_WORDS,
        100 * F.size(F.array_distinct(words)) < MIN_DISTINCT * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > MAX_CAPITALS * F.length(text),
        text.rlike(MARKS),
    )
    bits = F.lit(0)
    for k, condition in enumerate(fails):
        bits = bits + F.when(condition, 1 << k).otherwise(0)
    return bits


def cells(docs: DataFrame, labels: DataFrame, names: Tables = Tables()) -> DataFrame:
    """part, mask of failed filters, good, toxic and the number of documents."""
    text = F.coalesce(F.col(names.text).cast("string"), F.lit(""))
    texts = docs.select(F.col(names.doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(names.part).cast("string"), F.lit("")).alias("part"), text.alias("text"), words_of(text).alias("words"))
    judged = texts.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), own_bits(F.col("text"), F.col("words")).alias("bits"))
    rows = judged.groupBy("doc_id", "part", "digest", "bits").agg(F.count(F.lit(1)).alias("n"))
    marks = (
        labels.where(F.col(names.doc_id).isNotNull()).groupBy(F.col(names.doc_id).cast("long").alias("doc_id"))
        .agg(F.max((F.col(names.quality) == 1).cast("int")).alias("good"), F.max((F.col(names.toxic) == 1).cast("int")).alias("toxic"))
    )
    marked = rows.join(marks, "doc_id", "left").select("doc_id", "part", "digest", "bits", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    cell = ("part", "bits", "good", "toxic")
    # one row for each digest and cell: all documents, those with an id, and the smallest id with its documents
    by_id = marked.groupBy("digest", *cell, "doc_id").agg(F.sum("n").alias("n"))
    by_cell = by_id.groupBy("digest", *cell).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n"))), F.lit(0)).alias("with_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    first = by_cell.groupBy("digest").agg(
        F.min("least.doc_id").alias("first_id"),
        F.collect_list(F.struct(*cell, "n", "with_id", "least")).alias("members"),  # parts x labels of one text
    )
    each = first.select("first_id", F.explode("members").alias("m")).select(*[f"m.{c}" for c in cell], "m.n", (F.col("m.with_id") - F.when(F.col("m.least.doc_id") == F.col("first_id"), F.col("m.least.n")).otherwise(0)).alias("copies"))
    split = each.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("bits").alias("mask"), (F.col("n") - F.coalesce("copies", F.lit(0))).alias("n")),
        F.struct((F.col("bits") + COPY).alias("mask"), F.coalesce("copies", F.lit(0)).alias("n")),
    )).alias("s")).select("part", "s.mask", "good", "toxic", "s.n")
    return split.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


WALK = """
WITH RECURSIVE walk(part, prefix, applied, step, bit, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {parts}
  UNION ALL
  SELECT w.part, concat(w.prefix, f.letter), w.applied | f.bit, w.step + 1, f.bit,
    aggregate(filter(p.cells, c -> c.mask & (w.applied | f.bit) = 0), 0L, (a, c) -> a + c.n),
    aggregate(filter(p.cells, c -> c.mask & w.applied = 0 AND c.mask & f.bit <> 0), 0L, (a, c) -> a + c.n),
    aggregate(filter(p.cells, c -> c.mask & w.applied <> 0 AND c.mask & f.bit <> 0), 0L, (a, c) -> a + c.n),
    aggregate(filter(p.cells, c -> c.mask = f.bit), 0L, (a, c) -> a + c.n),
    aggregate(filter(p.cells, c -> c.mask & w.applied = 0 AND c.mask & f.bit <> 0), 0L, (a, c) -> a + c.good),
    aggregate(filter(p.cells, c -> c.mask & w.applied = 0 AND c.mask & f.bit <> 0), 0L, (a, c) -> a + c.toxic)
  FROM walk w JOIN {unused} f ON f.applied = w.applied JOIN {parts} p ON p.part = w.part
)
SELECT * FROM walk WHERE step > 0
"""


def prefixes(parts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Metrics of every step of every prefix, by part; one level of the recursion is one step.

    ``parts`` has a part and the array of its cells (2 ** letters at most). Spark ends a recursion beyond a number of
    rows that is a session setting; the limit is lifted for this walk, whose rows are known: parts x prefixes.
    """
    spark = parts.sparkSession
    unused = spark.createDataFrame([(applied, x, 1 << k) for applied in range(1 << len(letters)) for k, x in enumerate(letters) if not applied & 1 << k], "applied int, letter string, bit int")
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return written(spark.sql(WALK, parts=parts, unused=unused), "prefixes")
    finally:
        spark.conf.set(limit, before)


def audit(docs: DataFrame, labels: DataFrame, names: Tables = Tables()) -> DataFrame:
    """Per part, order of all filters and step: the metrics of the step, and the sum of its filter's removals over all orders."""
    by_mask = cells(docs, labels, names).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    parts = written(by_mask.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells")), "cells")
    walked = prefixes(parts)
    orders = walked.where(F.col("step") == len(LETTERS)).select("part", F.col("prefix").alias("filter_order"))
    steps = orders.select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    steps = steps.withColumn("prefix", F.expr("substring(filter_order, 1, step)"))
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    # a prefix stands in as many orders as the unused letters have arrangements
    arrangements = F.when(F.col("step") == len(LETTERS), 1).otherwise(F.factorial(len(LETTERS) - F.col("step")))
    shapley = walked.groupBy("part", "bit").agg(F.sum(F.col("removed") * arrangements).alias("shapley"))
    return (
        steps.join(walked.select("part", "prefix", "bit", *counts), ["part", "prefix"]).join(shapley, ["part", "bit"])
        .select("part", "filter_order", F.col("step").cast("int").alias("step"), *counts, "shapley")
    )
