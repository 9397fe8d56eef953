"""How document filters interact: what each removes, repeats or loses under every order.

Filters are named by letters; bit i of a document's ``failed`` is set where it fails letter i. The duplicate filter is an
existential self-join: a document fails it where another row of the table has the same hash, the same exact text and a
smaller id (left semi join). The ids it finds are united with the rows that carry the other failures, and everything
after that works on counts of bit combinations, so all orders cost the same.

Odd input: a null text counts as empty; documents without an id never fail the duplicate filter (no id is smaller) and
have no label; rows that repeat an id are documents of their own; equal rows don't remove one another. A null language
and an empty one are the same part. Labels of an id that occurs repeatedly count where any of its rows is 1, null labels
not at all. Texts of any length are counted whole. An empty table gives no rows. Only the named columns are read, so
other columns, whatever their names, change nothing.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import keep

LETTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 100, 80, 10
DUPLICATE = 1 << LETTERS.index("E")


def text_failures(text: Column, words: Column) -> Column:
    """Bits of the filters that a text settles by itself: few words, repetitive, upper case, symbols."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failing = [
        n < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * n, 100 * upper > MAX_UPPER_PERCENT * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((F.when(bad, 1 << i).otherwise(0) for i, bad in enumerate(failing)), F.lit(0))


def documents_by_hash(docs: DataFrame) -> DataFrame:
    """``doc_id, part, text, hash`` with nulls filled."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.xxhash64(text).alias("hash"))


def later_copies(rows: DataFrame) -> DataFrame:
    """``doc_id, part, hash`` of every row whose exact text occurs under a smaller id.

    Texts move only where their hash occurs under more than one id. Of every text the copies are aggregated to the smallest
    id before the join, so a group of copies of any size meets a single row, and its left side can be split over tasks.
    """
    repeated = rows.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hash")
    candidates = keep(rows.join(repeated, "hash", "left_semi"), "audit-candidates")
    first = candidates.groupBy(F.col("hash").alias("first_hash"), F.col("text").alias("first_text")).agg(F.min("doc_id").alias("first_id"))
    same = (F.col("hash") == F.col("first_hash")) & (F.col("text") == F.col("first_text")) & (F.col("first_id") < F.col("doc_id"))
    return candidates.join(first, same, "left_semi").select("doc_id", "part", "hash")


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, failed, n``: the failure bits of every document; ``n`` counts equal rows."""
    rows = documents_by_hash(docs)
    split = rows.withColumn("words", F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), ""))
    own = split.select("doc_id", "part", "hash", text_failures(F.col("text"), F.col("words")).alias("failed"), F.lit(1).alias("n"))
    copies = later_copies(rows).select("doc_id", "part", "hash", F.lit(DUPLICATE).alias("failed"), F.lit(0).alias("n"))
    united = own.unionByName(copies).groupBy("doc_id", "part", "hash")
    return united.agg(F.bit_or("failed").alias("failed"), F.sum("n").alias("n")).drop("hash")


def combinations(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, failed, good, toxic, n``: documents by failure bits and labels."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    joined = failures(docs).join(known, F.col("doc_id") == F.col("label_id"), "left")
    flags = [F.coalesce(name, F.lit(False)).alias(name) for name in ("good", "toxic")]
    return joined.groupBy("part", "failed", *flags).agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents.

    ``shapley`` needs no second pass over the orders: a document failing k filters is removed by each of them in one k-th
    of all orders.
    """
    orders = ["".join(p) for p in permutations(LETTERS)]
    steps = (
        combinations(docs, labels)
        .withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
        .withColumn("step", F.explode(F.array(*(F.lit(i) for i in range(1, len(LETTERS) + 1)))))
        .withColumn("bit", F.expr("shiftleft(1, ascii(substring(filter_order, step, 1)) - ascii('A'))"))
        .withColumn("before", F.expr(
            "aggregate(sequence(1, 5), 0, (m, i) -> IF(i < step, m | shiftleft(1, ascii(substring(filter_order, i, 1)) - ascii('A')), m))"))
    )
    fails, earlier = (F.col("failed").bitwiseAND(F.col("bit")) != 0), (F.col("failed").bitwiseAND(F.col("before")) != 0)
    shares = len(orders) / F.bit_count("failed")

    def count(condition: Column, name: str, n: Column | None = None) -> Column:
        return F.sum(F.when(condition, F.col("n") if n is None else n).otherwise(0)).cast("long").alias(name)

    return steps.groupBy("part", "filter_order", "step").agg(
        count(~fails & ~earlier, "kept"), count(fails & ~earlier, "removed"), count(fails & earlier, "redundant"),
        count(F.col("failed") == F.col("bit"), "unique_fails"), count(fails & ~earlier & F.col("good"), "good_lost"),
        count(fails & ~earlier & F.col("toxic"), "toxic_lost"), count(fails, "shapley", F.col("n") * shares.cast("long")),
    )
