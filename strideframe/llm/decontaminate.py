"""Benchmark decontamination: a broadcast hash set of test n-grams, probed by every training token window.

Benchmark windows (13 words; an item with fewer words is one window) are kept as distinct n-grams with the items they
occur in. The set is keyed by the hash of the n-gram. A token proposes windows only where its word is the longest of some
n-gram: a small table holds, per such word, its distinct places and window sizes (at most 91, however many n-grams share the
word). The proposed window is hashed, probes the set, and is compared in full, so hits are verified, never guessed.
Generation, probes and comparison run in one stage without a shuffle; only hits leave it.

The set is broadcast in slices whose bytes are counted first, so a benchmark of any size is handled: more slices, more
passes, the same rows.

Edge cases: null, empty and wordless texts have no words and are never contaminated; items without words have no
window; null item ids count as the empty id; rows are told apart by (doc_id, hash of the text), so repeated rows get
equal results; an empty benchmark hits nothing; very long texts are read whole; of several longest words in an n-gram the
greatest one, at its last place, proposes it; further columns are carried along untouched.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import ascii_lower, free_name, keep, with_text

WINDOW = 13
#: Contaminated from this share of hit words on: 1 in 20.
SHARE = 20
#: Bytes of n-grams in one broadcast.
BROADCAST_BYTES = 64 << 20
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before lower-casing, and everything between them.
RAW_WORDS, RAW_GAPS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def ngram_set(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, at, key, ngram, items): distinct windows, their longest word and its place, their hash, and the ids they occur in."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    grams = items.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(1, size(w) - {window - 1})), i -> slice(w, i, {window}))")).alias("ngram"))
    longest = F.array_max(F.transform("ngram", lambda x, i: F.struct(F.length(x).alias("n"), x.alias("word"), i.alias("at"))))
    return (
        grams.groupBy("ngram").agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("longest", longest)
        .select(F.col("longest.word").alias("anchor"), F.col("longest.at").alias("at"), F.xxhash64("ngram").alias("key"), "ngram", "items")
    )


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, mark, start, n, items): every occurrence of a benchmark window; ``start`` counts words from 0."""
    grams = keep(ngram_set(benchmark, window), "ngrams")
    weight = F.octet_length(F.array_join("ngram", " ")) + 24 * F.size("ngram") + F.octet_length(F.array_join("items", " ")) + 128
    total = grams.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    slices = -(-total // BROADCAST_BYTES) or 1
    tokens = docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w")).select("doc_id", "mark", "w", F.posexplode("w").alias("pos", "word"))
    found = []
    for i in range(slices):
        part = grams.where(F.pmod("key", F.lit(slices)) == i) if slices > 1 else grams
        anchors = part.groupBy("anchor").agg(F.collect_set(F.struct("at", F.size("ngram").alias("n"))).alias("proposals"))
        start = F.col("pos") - F.col("p.at")
        proposed = (
            tokens.join(F.broadcast(anchors), F.col("word") == F.col("anchor"))
            .select("doc_id", "mark", "w", "pos", F.explode("proposals").alias("p"))
            .where((start >= 0) & (start + F.col("p.n") <= F.size("w")))
            .select("doc_id", "mark", start.alias("start"), F.slice("w", start + 1, F.col("p.n")).alias("around"))
        )
        found.append(
            proposed.join(F.broadcast(part), (F.xxhash64("around") == F.col("key")) & (F.col("around") == F.col("ngram")))
            .select("doc_id", "mark", "start", F.size("ngram").alias("n"), "items")
        )
    return reduce(DataFrame.unionByName, found)


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """(doc_id, mark, n_words, spans, items, n_hit, contaminated) per row; spans are merged-ready (start, end) pairs."""
    found = (
        hits(docs, benchmark, window).groupBy(F.col("doc_id").alias("hit_id"), F.col("mark").alias("hit_mark"))
        .agg(F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"), F.collect_set("items").alias("items"))
        .withColumn("items", F.array_sort(F.array_distinct(F.flatten("items"))))
    )
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'end', 0), (a, s) -> named_struct("
        "'n', a.n + greatest(0, s.end - greatest(s.start, a.end)), 'end', greatest(a.end, s.end)), a -> a.n)"
    )
    counted = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce(F.regexp_count("text", F.lit(RAW_WORDS)), F.lit(0)).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("mark") == F.col("hit_mark"))
    out = counted.join(found, same, "left").withColumn("n_hit", F.coalesce(covered, F.lit(0)).cast("long"))
    return out.select(
        "doc_id", "mark", "n_words", "spans", "items", "n_hit", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", *, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The clean rest of ``docs``: without contaminated documents, or (``mode="spans"``) without the hit words of any."""
    if mode not in ("documents", "spans"):
        raise ValueError("mode is documents or spans")
    found = contamination(docs, benchmark, window=window, share=share)
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"))
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_mark") == F.col("mark"))
    if mode == "documents":
        return packed.join(found.where("contaminated"), same, "left_anti").select("doc.*")
    cut = found.where("n_hit > 0").select("doc_id", "mark", "spans").distinct()
    held = free_name("_cut", docs.columns)
    joined = packed.join(cut, same, "left").select("doc.*", F.struct("spans").alias(held))
    # Pieces alternate between gaps and words; word number i is piece 2i, or 2i + 1 after a leading gap.
    text = F.expr(
        "array_join(filter(regexp_extract_all(text, '(" + f"{RAW_WORDS}|{RAW_GAPS}".replace("\\", "\\\\") + ")', 1), (x, i) -> "
        "NOT (rlike(x, '^" + RAW_WORDS.replace("\\", "\\\\") + "') AND exists(" + held + ".spans, s -> s.start <= i div 2 AND i div 2 < s.end))), '')"
    )
    return with_text(joined, F.when(F.col(f"{held}.spans").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which at least one word in twenty belongs to a benchmark window go; the others stay unchanged."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
