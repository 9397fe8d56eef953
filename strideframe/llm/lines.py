"""Reversible line deduplication: sharded cuckoo filters in front of exact reference counts.

State of a corpus (``LineIndex``):

* ``postings``: one row per (line key, document) with its number of lines — enough to undo any document,
* ``counts``: one row per line key with its number of documents, lines and the largest document holding it,
* ``filters``: one cuckoo filter per shard over the keys that are found in at least ``min_docs`` documents. Inserting
  or deleting documents changes the counts first; keys that cross the threshold are then added to or taken out of the
  filter of their shard, so a deletion leaves the state it would have had without the document.

Probing costs two bucket reads and never misses a key; the few false positives end at the exact table. Small filters are
broadcast; larger ones stay where they are, and postings go to the filter of their shard in groups of a counted size.

Line keys are 128 bits (two 64-bit hashes in a chain). Edge cases: a null or empty text is one empty line; rows that
repeat a ``doc_id`` are one document for counting, each row loses its own lines; a null ``doc_id`` is one document and
smaller than any other; very long texts are split whole, and a line looks its key up by bisection; ties can't arise, as the
holder is the largest id; an empty table gives no rows; further columns are carried along untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import ascii_lower, free_name, keep, with_text

MIN_CHARS, MIN_DOCS = 40, 5
#: Keys a shard holds on average, the bytes of filters that may be broadcast, and the postings that meet a filter in one task beyond.
SHARD_KEYS, FILTER_BYTES, GROUP_ROWS = 1 << 16, 64 << 20, 1 << 20
SLOTS, MAX_KICKS = 4, 500
BLANKS = " \t\n\x0b\x0c\r"


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key lives in one of two buckets and can be removed again."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.8)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, first: np.ndarray, second: np.ndarray) -> CuckooFilter:
        out = cls.sized(len(first))
        while not all(out.add(int(a), int(b)) for a, b in zip(first.tolist(), second.tolist(), strict=True)):
            out = cls(np.zeros((2 * len(out.table), SLOTS), np.uint16))
        return out

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _other(self, bucket, mark):
        return bucket ^ ((mark * 0x5BD1E995 >> 7) & (len(self.table) - 1))

    def add(self, first: int, second: int) -> bool:
        """False when no place was found; the caller then builds a larger filter."""
        mark = (second & 0xFFFF) or 1
        bucket = (first & 0x7FFFFFFFFFFFFFFF) & (len(self.table) - 1)
        for turn in range(MAX_KICKS):
            for here in (bucket, self._other(bucket, mark)):
                free = np.flatnonzero(self.table[here] == 0)
                if len(free):
                    self.table[here, free[0]] = mark
                    return True
            bucket = self._other(bucket, mark) if turn % 2 else bucket
            slot = turn % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = self._other(bucket, mark)
        return False

    def remove(self, first: int, second: int) -> bool:
        mark = (second & 0xFFFF) or 1
        bucket = (first & 0x7FFFFFFFFFFFFFFF) & (len(self.table) - 1)
        for here in (bucket, self._other(bucket, mark)):
            held = np.flatnonzero(self.table[here] == mark)
            if len(held):
                self.table[here, held[0]] = 0
                return True
        return False

    def contains(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        mark = second & 0xFFFF
        mark = np.where(mark == 0, 1, mark)
        bucket = (first & 0x7FFFFFFFFFFFFFFF) & (len(self.table) - 1)
        wanted = mark.astype(np.uint16)[:, None]
        return (self.table[bucket] == wanted).any(1) | (self.table[self._other(bucket, mark)] == wanted).any(1)


@dataclass(frozen=True)
class LineIndex:
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int
    min_docs: int


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(1), key)


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright("h1", 40), F.lit(shards))


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, lines) of every line key with at least ``min_chars`` code points."""
    keys = docs.select("doc_id", F.explode(_lines(F.col("text"))).alias("line")).select("doc_id", _key(F.col("line")).alias("key"))
    h1, h2 = _hashes(F.col("key"))
    long = keys.where(F.char_length("key") >= min_chars).select("doc_id", h1.alias("h1"), h2.alias("h2"))
    return long.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("lines"))


def reference_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("holder"), F.sum("lines").alias("lines"))


def _frequent(counts: DataFrame, min_docs: int, shards: int) -> DataFrame:
    return counts.where(F.col("docs") >= min_docs).select("h1", "h2", _shard(shards).alias("shard"))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    made = CuckooFilter.of(pdf["h1"].to_numpy(), pdf["h2"].to_numpy())
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "data": [made.dump()]})


def build(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineIndex:
    """Index a corpus; postings, counts and filters are kept in the shared folder."""
    rows = keep(postings(docs, min_chars), "postings")
    counts = keep(reference_counts(rows), "refcounts")
    frequent = counts.where(F.col("docs") >= min_docs).count()
    shards = 1 << max(0, (frequent // SHARD_KEYS).bit_length())
    made = _frequent(counts, min_docs, shards).groupBy("shard").applyInPandas(_build, "shard long, data binary")
    return LineIndex(rows, counts, keep(made, "cuckoo"), shards, min_chars, min_docs)


def _revised(index: LineIndex, rows: DataFrame) -> LineIndex:
    """The index over other postings: filters are edited by the keys that crossed the threshold."""
    rows = keep(rows, "postings")
    counts = keep(reference_counts(rows), "refcounts")
    before = _frequent(index.counts, index.min_docs, index.shards)
    after = _frequent(counts, index.min_docs, index.shards)
    changes = (
        after.join(before, ["h1", "h2"], "left_anti").withColumn("add", F.lit(True))
        .unionByName(before.join(after, ["h1", "h2"], "left_anti").withColumn("add", F.lit(False)))
    )

    def edit(held: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
        shard = int((held if len(held) else edits)["shard"].iloc[0])
        current = CuckooFilter.load(held["data"].iloc[0]) if len(held) else CuckooFilter.sized(len(edits))
        for a, b, add in edits[["h1", "h2", "add"]].itertuples(index=False):
            if not (current.add(int(a), int(b)) if add else current.remove(int(a), int(b))):
                if add:
                    return pd.DataFrame({"shard": [shard], "data": [None]})
        return pd.DataFrame({"shard": [shard], "data": [current.dump()]})

    edited = keep(index.filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(edit, "shard long, data binary"), "cuckoo")
    full = edited.where("data IS NULL").select("shard")
    again = after.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_build, "shard long, data binary")
    return LineIndex(rows, counts, keep(edited.where("data IS NOT NULL").unionByName(again), "cuckoo"), index.shards, index.min_chars, index.min_docs)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with further documents."""
    both = index.postings.unionByName(postings(docs, index.min_chars))
    return _revised(index, both.groupBy("h1", "h2", "doc_id").agg(F.sum("lines").alias("lines")))


def remove(index: LineIndex, ids: DataFrame) -> LineIndex:
    """The index without the documents whose ``doc_id`` is in ``ids``."""
    gone = ids.select(F.col("doc_id").alias("gone")).distinct()
    return _revised(index, index.postings.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_anti"))


def _probe(index: LineIndex) -> DataFrame:
    """The postings that pass the filter of their shard."""
    rows = index.postings.select("h1", "h2", "doc_id")
    size = index.filters.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    if size > FILTER_BYTES:
        return _probe_shards(index, rows)
    spark = rows.sparkSession
    data = spark.sparkContext.broadcast({r["shard"]: r["data"] for r in index.filters.collect()})
    shards = index.shards

    def passing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = {k: CuckooFilter.load(v) for k, v in data.value.items()}
        for pdf in batches:
            first, second = pdf["h1"].to_numpy(), pdf["h2"].to_numpy()
            shard, kept = np.mod(first >> 40, shards), np.zeros(len(pdf), bool)
            for k in np.unique(shard):
                if k in filters:
                    at = shard == k
                    kept[at] = filters[k].contains(first[at], second[at])
            yield pdf[kept]

    return rows.mapInPandas(passing, rows.schema)


def _probe_shards(index: LineIndex, rows: DataFrame) -> DataFrame:
    """The same without a broadcast: a crowded shard is split by document hash, and each part gets a copy of its filter."""
    sharded = rows.withColumn("shard", _shard(index.shards))
    parts = sharded.groupBy("shard").count().select("shard", F.ceil(F.col("count") / GROUP_ROWS).cast("int").alias("parts"))
    parts = keep(parts, "shard-parts")
    split = sharded.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "h2"), F.col("parts")).cast("int"))
    copies = index.filters.join(parts, "shard").select("shard", "data", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def passing(held: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return asked[["h1", "h2", "doc_id"]].iloc[:0]
        found = CuckooFilter.load(held["data"].iloc[0]).contains(asked["h1"].to_numpy(), asked["h2"].to_numpy())
        return asked.loc[found, ["h1", "h2", "doc_id"]]

    asked = split.select("h1", "h2", "doc_id", "shard", "part")
    return copies.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(passing, rows.schema)


def _held(keys: str, key: Column) -> Column:
    """Whether a sorted array has the key, by bisection in steps of falling powers of two."""
    steps = F.expr(f"transform(sequence(length(bin(size({keys}))) - 1, 0), b -> shiftleft(1, b))")

    def search(wanted: Column) -> Column:
        def step(at: Column, by: Column) -> Column:
            return F.when((at + by <= F.size(keys)) & (F.get(keys, at + by - 1) <= wanted), at + by).otherwise(at)

        return F.coalesce(F.get(keys, F.aggregate(steps, F.lit(0), step) - 1) == wanted, F.lit(False))

    # In an array of one, so that the key is hashed once.
    return F.get(F.transform(F.array(key), search), F.lit(0))


def dropped_keys(index: LineIndex) -> DataFrame:
    """(drop_id, keys): the line keys that a document loses, sorted. A document's own keys are gathered, no more."""
    exact = index.counts.where(F.col("docs") >= index.min_docs).select("h1", "h2", "holder")
    losing = _probe(index).join(exact, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    return losing.groupBy(F.col("doc_id").alias("drop_id")).agg(F.sort_array(F.collect_list(F.struct("h1", "h2"))).alias("keys"))


def dedup(docs: DataFrame, index: LineIndex) -> DataFrame:
    """Struct ``doc`` of the given columns, n_lines, n_dropped and kept (the remaining text) per row."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    joined = packed.join(dropped_keys(index), F.col("_id").eqNullSafe(F.col("drop_id")), "left")

    def stays(line: Column) -> Column:
        key = _key(line)
        h1, h2 = _hashes(key)
        return (F.char_length(key) < index.min_chars) | ~_held("keys", F.struct(h1.alias("h1"), h2.alias("h2")))

    lines = joined.withColumn("_lines", _lines(F.col("_text")))
    kept = lines.withColumn("_kept", F.when(F.col("keys").isNull(), F.col("_lines")).otherwise(F.filter("_lines", stays)))
    return kept.select(
        "doc",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.array_join("_kept", "\n").alias("kept"),
    )


def line_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; all rows stay."""
    out = dedup(docs, build(docs))
    made = free_name("_line_stage", docs.columns)
    changed = out.select("doc.*", F.struct("kept", "n_dropped").alias(made))
    text = F.when(F.col(f"{made}.n_dropped") > 0, F.col(f"{made}.kept")).otherwise(F.col("text"))
    return with_text(changed, text).select(*docs.columns)
