"""Filter interaction audit: what five document filters remove, in every order in which they can be applied.

Native expressions build a five-bit failure mask of every document.  Four bits are functions of the text; the fifth
says that a smaller id holds the identical text, for which a grouping by the text's SHA-256 supplies the smallest id: every
document counts as a copy at first, and each group's first document is moved to the cell without that bit, so no group
of copies ever meets its documents again.  Counts of masks (32 cells for each part of the table) are all that the 120
orders are computed from.

Defined results: a null text is empty, and all empty texts are identical; a null id is neither smaller than another
nor has it smaller ones; rows that repeat an id and a text are first together; a null part is the empty string; a
document with several labels has each of them; labels without an id, and a label that is null, say nothing; an empty table
gives an empty result; texts are judged whole, however long; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filters, in the order of their bits. (fixed value)
FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
COUNTS = ("n", "good", "toxic")


def text_mask(text: Column) -> Column:
    """Bits of the filters that judge a text alone: A few words, B repeated words, C capitals, D symbols."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [n_words < 200, 100 * n_distinct.cast("long") < 50 * n_words, 100 * capitals.cast("long") > 2 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def _label(labels: DataFrame) -> DataFrame:
    marks = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))]
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*marks)


def cells(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents of every mask in every part, and how many of them are labelled so."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"), text_mask(text).alias("mask"))
    rows = rows.groupBy("doc_id", "part", "content", "mask").agg(F.count("*").alias("n"))  # repeated rows meet as sums
    known, unknown = rows.filter(F.col("doc_id").isNotNull()), rows.filter(F.col("doc_id").isNull())
    known = known.join(_label(labels), "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) * F.col("n") for c in ("good", "toxic")})
    copies = known.select("part", (F.col("mask") + COPY).alias("mask"), *COUNTS)
    own = known.groupBy("content", "doc_id", "mask").agg(F.collect_list(F.struct("part", *COUNTS)).alias("rows"))  # as long as an id and text has parts
    first = own.groupBy("content").agg(F.min_by(F.struct("mask", "rows"), "doc_id").alias("first"))
    first = first.select(F.col("first.mask").alias("mask"), F.explode("first.rows").alias("r")).select("r.part", "mask", *[f"r.{c}" for c in COUNTS])
    moved = first.unionByName(first.select("part", (F.col("mask") + COPY).alias("mask"), *[(-F.col(c)).alias(c) for c in COUNTS]))
    alone = unknown.select("part", "mask", "n", F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    return copies.unionByName(moved).unionByName(alone).groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in COUNTS]).filter("n > 0")


def orders(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and what the step's filter does there, from the cells of a part."""
    held = counted.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # at most 32 cells
    named = F.explode(F.split(F.lit(",".join("".join(p) for p in permutations(FILTERS))), ",")).alias("filter_order")
    steps = held.select("part", "cells", named).select("part", "cells", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bit = lambda at: F.pow(F.lit(2), F.instr(F.lit(FILTERS), F.substring("filter_order", at, F.lit(1))) - 1).cast("int")
    bits = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), bit)
    before = F.aggregate(F.slice("bits", 1, F.col("step") - 1), F.lit(0), lambda s, b: s + b)
    steps = steps.withColumn("bits", bits).withColumns({"before": before, "own": F.element_at("bits", F.col("step"))})
    fails, earlier = (lambda c: c["mask"].bitwiseAND(F.col("own")) != 0), (lambda c: c["mask"].bitwiseAND(F.col("before")) != 0)

    def counts(wanted, name: str = "n") -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(wanted(c), c[name]).otherwise(0))

    removed = lambda c: fails(c) & ~earlier(c)
    # of k failing filters each comes first in 120 / k of the 120 orders
    all_orders = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + F.when(fails(c), c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("long")).otherwise(0))
    return steps.select(
        "part", "filter_order", "step", counts(lambda c: ~fails(c) & ~earlier(c)).alias("kept"), counts(removed).alias("removed"), counts(lambda c: fails(c) & earlier(c)).alias("redundant"),
        counts(lambda c: c["mask"] == F.col("own")).alias("unique_fails"), counts(removed, "good").alias("good_lost"), counts(removed, "toxic").alias("toxic_lost"), all_orders.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """What each filter removes at each step of each order, for every part: 600 rows a part."""
    return orders(cells(docs, labels, part))
