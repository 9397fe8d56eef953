"""Order MinHash fingerprints and the likeness of neighbouring documents, in DataFrame expressions only.

Units are words (longer runs in pieces of 16 characters), k-mers are pairs of neighbouring units, padded at the end.
Equal k-mers of a text are numbered, so repeats count. The numbered k-mers are hashed into 64 bins and the least of each
bin is selected; every two bins give one tuple of two k-mers *in their text order*, and 32 tuple hashes are the
fingerprint. A tuple agrees when both k-mers and their order do, about the square of the share of common k-mers, so the
likeness is the root of the share of equal tuples. An empty bin takes the next one's k-mer.

Everything about a text happens in its own row: sort the packed (hash, position) numbers, cut the sorted array into runs
of equal k-mers, number inside each run. Documents meet their successors in blocks of neighbouring ids, one shuffle of
the texts; only the last document of each block, one in a few hundred, is joined to the head of the next block.

Edge cases: a null text is empty; texts without words have the zero fingerprint, like each other (1) and unlike all
others (0); rows that repeat an id follow each other by a hash of the text; null ids come first; a single row is its own
successor; an empty table gives no rows; further columns are ignored. Positions count up to 2^24 units; beyond, order
within a tuple is taken modulo that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.store import keep
from strideframe.operators.blocks import Carry, bucket_width, carry

BLOCK_DOCS, SUPER_BLOCK = 256, 1 << 16
TUPLES, BINS = 32, 64
UNIT = r"[^\x20\x09-\x0D]{1,16}"
#: Packed numbers: 40 bits of hash above 24 bits of position; the upper 6 bits of a numbered hash are its bin.
HASH_BITS, POSITION = "-16777216L", "16777215L"


def with_signature(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out``: the 32 tuple hashes of the text column ``text``."""
    steps = {
        "_units": F.regexp_extract_all(F.col(text), F.lit(UNIT), F.lit(0)),
        "_packed": F.expr(
            f"sort_array(transform(zip_with(_units, slice(_units, 2, greatest(size(_units), 1)), (a, b) -> xxhash64(a, b)), "
            f"(h, i) -> (h & {HASH_BITS}) | (cast(i AS bigint) & {POSITION})))"
        ),
        "_starts": F.expr(
            "filter(transform(_packed, (x, i) -> if(i > 0 AND shiftright(x, 24) = shiftright(get(_packed, i - 1), 24), -1, i)), i -> i >= 0)"
        ),
        "_numbered": F.expr(
            "sort_array(flatten(transform(_starts, (s, j) -> transform(slice(_packed, s + 1, coalesce(get(_starts, j + 1), size(_packed)) - s), "
            f"(x, o) -> (xxhash64(shiftright(x, 24), o) & {HASH_BITS}) | (x & {POSITION})))))"
        ),
        "_least": F.expr("filter(_numbered, (x, i) -> i = 0 OR shiftright(x, 58) <> shiftright(get(_numbered, i - 1), 58))"),
        "_bins": F.expr(
            f"if(size(_least) = {BINS}, _least, transform(sequence(-{BINS // 2}, {BINS // 2 - 1}), "
            "b -> coalesce(get(filter(_least, x -> shiftright(x, 58) >= b), 0), get(_least, 0))))"
        ),
        out: F.expr(
            f"if(size(_least) = 0, array_repeat(0L, {TUPLES}), transform(sequence(0, {TUPLES - 1}), t -> "
            f"if((get(_bins, 2 * t) & {POSITION}) <= (get(_bins, 2 * t + 1) & {POSITION}), "
            "xxhash64(shiftright(get(_bins, 2 * t), 24), shiftright(get(_bins, 2 * t + 1), 24)), "
            "xxhash64(shiftright(get(_bins, 2 * t + 1), 24), shiftright(get(_bins, 2 * t), 24))) & 4294967295L))"
        ),
    }
    for name, step in steps.items():
        df = df.withColumn(name, step)
    return df.drop("_units", "_packed", "_starts", "_numbered", "_least", "_bins")


def as_text(signature: str) -> Column:
    """32 numbers of eight lowercase hex digits."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: str, b: str) -> Column:
    return F.expr(f"sqrt(size(filter(zip_with({a}, {b}, (x, y) -> x = y), e -> e)) / {TUPLES}.0D)")


def edited(text: str, following: str) -> Column:
    """The last quarter of the code points replaced by as many from the start of the next document."""
    n = F.char_length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.left(F.col(text), n - quarter), F.left(F.col(following), quarter))


def _against_next(df: DataFrame) -> DataFrame:
    """Results of rows with text, sig, next_text and next_sig."""
    rows = with_signature(df.withColumn("edited", edited("text", "next_text")), "edited", "edited_sig")
    return rows.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sig").alias("fingerprint"), as_text("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"), likeness("sig", "next_sig").alias("near_next"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): the general form, without neighbours."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_signature(rows, "text", "sig").select("doc_id", as_text("sig").alias("fingerprint"))


def neighbour_likeness(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    low, count = ids.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.count("*")).first()
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(low)) - F.lit(low)
    width = bucket_width(ids, [], F.coalesce(F.col("doc_id"), F.lit(low)) - F.lit(low), BLOCK_DOCS) if count else 1
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("mark"), F.floor(place / F.lit(width)).alias("blk")
    )
    block = Window.partitionBy("blk").orderBy(F.asc_nulls_first("doc_id"), "mark")
    signed = with_signature(rows.withColumn("next_text", F.lead("text").over(block)), "text", "sig")
    met = signed.withColumn("next_sig", F.lead("sig").over(block)).withColumn("at", F.row_number().over(block))
    last = F.col("next_text").isNull()
    # Edges of blocks keep their texts, so that the few pairs across blocks need no second pass over the others.
    wide = met.withColumn("edited", edited("text", "next_text"))
    wide = with_signature(wide, "edited", "edited_sig").select(
        "doc_id", "blk", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_text("sig").alias("fingerprint"), F.when(~last, as_text("edited_sig")).alias("edited_fingerprint"),
        F.when(~last, likeness("sig", "edited_sig")).alias("near_edited"), F.when(~last, likeness("sig", "next_sig")).alias("near_next"),
        last.alias("last"), (F.col("at") == 1).alias("head"),
        F.when(last | (F.col("at") == 1), F.struct("text", "sig")).alias("edge"),
    )
    results = keep(wide, "order-minhash")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    heads = results.where("head").select("blk", F.col("edge.text").alias("next_text"), F.col("edge.sig").alias("next_sig"))
    blocks = results.where("head").select("blk")
    final = F.coalesce(F.col("previous"), F.lit(blocks.agg(F.max("blk")).first()[0]))
    before = carry(blocks, [], "blk", {"previous": Carry("lag", F.col("blk"))}, F.floor(F.col("blk") / SUPER_BLOCK)).select("blk", final.alias("home"))
    across = (
        results.where("last").select("doc_id", "blk", F.col("edge.text").alias("text"), F.col("edge.sig").alias("sig"))
        .join(heads.join(before, "blk").select("home", "next_text", "next_sig"), F.col("blk") == F.col("home"))
    )
    return results.where("NOT last").select(*names).unionByName(_against_next(across))
