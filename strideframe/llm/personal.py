"""Personal data: base patterns, and identifiers that only their contexts give away, in DataFrame expressions only.

Base spans are the leftmost non-overlapping matches of four patterns (email, ip, card, phone) that pass a check. They
are the seeds of a bootstrap. Candidates are all tokens with a digit or an @ (groups of digits run on) and addresses spelled
out ("name at host dot com", "name [at] host [dot] com"). Each is met in lexical patterns: its two left words, its left word
without punctuation, its left and right word, a label glued to it ("tel:"), and the start of a line with the word that
follows. Spark scores the bipartite graph of patterns and instances in rounds: a pattern is worth the share of its distinct
instances that are known to be of a kind, smoothed by one unknown instance; an instance the noisy-or of its patterns.
Patterns with enough known instances and worth discover unseen candidates, if these have the rough shape of the kind; these
count as known in the next round, until a round changes nothing. Base spans always stay; a candidate that overlaps one is a
seed, never an addition.

Where a text can't contain a kind (no @, no +, ...) its pattern isn't run. Quantifiers are possessive and matches start
at the start of a run, so matching is linear in the text and needs no deep stack. Offsets are code points.

Edge cases: null and empty texts have no spans; long texts are read whole; rows are told apart by (doc_id, hash of the
text), so repeated rows get equal spans; an instance that several kinds claim alike takes the first kind as listed; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.store import keep

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that doesn't match has no span of the kind.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?: \(?[0-9]\S*+)*+"
#: An address spelled out, and what a text with one holds.
SPELLED = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: at | ?[(\[]at[)\]] ?)[A-Za-z0-9-]++"
    r"(?:(?: dot | ?[(\[]dot[)\]] ?|\.)[A-Za-z0-9-]++)++"
)
SPELLED_GUARD = r" at |[(\[]at[)\]]"
#: Brackets, quotes and a label before the instance in its token.
OPENING = r"^[(\"'\[{<]*(?:[A-Za-z_]++[:=#])?[(\"'\[{<]*"
#: What an unseen instance of a kind must look like.
SHAPES = {
    "email": r"^(?:\S+@\S+|[A-Za-z0-9._%+-]+(?: at | ?[(\[]at[)\]] ?)\S.*)$",
    "ip": r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]+){3,}$",
    "card": r"^(?:[0-9][ -]?){12,19}$",
    "phone": r"^\+?(?:[0-9][ ().-]{0,2}){7,15}$",
}
#: Most rounds, known instances and worth of a pattern, the unknown instances it is charged with, and the score of a discovery.
ROUNDS, MIN_SEEDS, MIN_WORTH, SMOOTHING, MIN_SCORE = 20, 3, 0.5, 1, 0.7
CHUNK, AROUND = 128, 120


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(text: str, pattern: str, guard: str) -> Column:
    """array of (start, end, word, gap, after): matches of ``pattern`` with code-point offsets, and the text around each.

    Offsets are running sums of the lengths of matches and gaps, taken in chunks and then over chunks. ``gap`` and
    ``after`` hold the ``AROUND`` characters next to the match that belong to no other one.
    """
    kind = "array<struct<start:int,end:int,word:string,gap:string,after:string>>"
    pieces = (
        f"transform(regexp_extract_all({text}, {_quoted(pattern)}, 0), (w, i) -> named_struct('n', char_length(get(g, i)), "
        f"'gap', right(get(g, i), {AROUND}), 'w', w, 'after', left(get(g, i + 1), {AROUND})))"
    )
    chunks = (
        f"transform(sequence(0, greatest(0, size(p) - 1) div {CHUNK}), c -> aggregate(slice(p, c * {CHUNK} + 1, {CHUNK}), "
        f"named_struct('at', 0, 'out', cast(array() AS {kind})), (a, x) -> named_struct("
        "'at', a.at + x.n + char_length(x.w), 'out', concat(a.out, array(named_struct('start', a.at + x.n, "
        "'end', a.at + x.n + char_length(x.w), 'word', x.w, 'gap', x.gap, 'after', x.after))))))"
    )
    shifted = (
        f"flatten(aggregate(c, named_struct('at', 0, 'out', cast(array() AS array<{kind}>)), "
        "(a, k) -> named_struct('at', a.at + k.at, 'out', concat(a.out, array(transform(k.out, s -> named_struct('start', s.start + a.at, "
        "'end', s.end + a.at, 'word', s.word, 'gap', s.gap, 'after', s.after))))), a -> a.out))"
    )
    # One-element arrays bind intermediate results, so that each is made once.
    body = (
        f"transform(array(split({text}, {_quoted(pattern)}, -1)), g -> transform(array({pieces}), p -> "
        f"transform(array({chunks}), c -> {shifted})[0])[0])[0]"
    )
    return F.expr(f"if({text} RLIKE {_quoted(guard)}, {body}, cast(array() AS {kind}))")


def _valid(kind: str, word: Column) -> Column:
    digits = F.regexp_replace(word, "[^0-9]", "")
    if kind == "ip":
        def small(part: Column) -> Column:
            bare = F.ltrim(part, F.lit("0"))
            return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

        return F.forall(F.split(word, r"\."), small)
    if kind == "card":
        return F.length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def luhn(digits: Column) -> Column:
    """Whether the checksum holds: from the right, every second digit counts double, less 9 above 9."""

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        double = 2 * digit
        return total + F.when(i % 2 == 1, digit).when(double > 9, double - 9).otherwise(double)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, candidates) per row; base is sorted by kind and start."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    for k, kind in enumerate(KINDS):
        rows = rows.withColumn(f"_m{k}", matches("text", PATTERNS[kind], GUARDS[kind]))
    rows = rows.withColumn("_c", F.concat(matches("text", CANDIDATE, "[0-9@]"), matches("text", SPELLED, SPELLED_GUARD)))

    def spans(k: int) -> Column:
        good = F.filter(f"_m{k}", lambda m: _valid(KINDS[k], m["word"]))
        return F.transform(good, lambda m: F.struct(F.lit(k).alias("k"), m["start"].alias("start"), m["end"].alias("end")))

    return rows.withColumn("base", F.concat(*[spans(k) for k in range(len(KINDS))])).select(
        "doc_id", "mark", "base", F.transform("_c", lambda c: _candidate(c)).alias("candidates")
    )


def _plain(words: Column) -> Column:
    return F.regexp_replace(F.lower(words), "[0-9]", "0")


def _candidate(c: Column) -> Column:
    """Trimmed instance and its span; the left words come from the gap before it, the right word from the word itself."""
    opening = F.regexp_extract(c["word"], OPENING, 0)
    word = F.regexp_replace(F.substring(c["word"], F.length(opening) + 1, F.length(c["word"])), "[^0-9A-Za-z]+$", "")
    start = c["start"] + F.length(opening)
    return F.struct(
        start.alias("start"), (start + F.char_length(word)).alias("end"), word.alias("word"),
        _plain(F.regexp_extract(c["gap"], r"(\S+\s+\S+)\s+$", 1)).alias("left2"),
        _plain(F.regexp_extract(c["gap"], r"(\S+)\s+$", 1)).alias("left1"),
        _plain(F.regexp_extract(c["after"], r"^\s+(\S+)", 1)).alias("right1"),
        F.lower(F.regexp_extract(opening, r"([A-Za-z_]+[:=#])", 1)).alias("label"),
        c["gap"].rlike(r"\n[ \t]*$").alias("at_line"),
    )


def _kind_of(word: Column) -> Column:
    """The first kind whose base pattern has a valid match in the word, as its number; null if none has."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(KINDS))):
        found = F.regexp_extract(word, f"({PATTERNS[KINDS[k]]})", 1)
        out = F.when((found != "") & _valid(KINDS[k], found), k).otherwise(out)
    return out


def _shaped(kind: Column, word: Column) -> Column:
    out = F.lit(False)
    for k, name in enumerate(KINDS):
        out = F.when(kind == k, word.rlike(SHAPES[name])).otherwise(out)
    return out


def mentions(scanned: DataFrame) -> DataFrame:
    """One row per candidate: its place, instance, kind if its own text shows one, and its patterns."""
    rows = scanned.select("doc_id", "mark", F.explode("candidates").alias("c")).select("doc_id", "mark", "c.*").where("word <> ''")
    bare = F.regexp_replace("left1", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    patterns = F.array_compact(F.array(
        F.when(F.col("label") != "", F.concat(F.lit("label: "), "label")),
        F.when(bare != "", F.concat(F.lit("left: "), bare)),
        F.when(F.col("at_line") & (F.col("right1") != ""), F.concat(F.lit("line: _ "), "right1")),
        F.when(F.col("left2") != "", F.concat(F.lit("two left: "), "left2")),
        F.when((F.col("left1") != "") & (F.col("right1") != ""), F.concat(F.lit("around: "), "left1", F.lit(" _ "), "right1")),
    ))
    return rows.select("doc_id", "mark", "start", "end", F.col("word").alias("inst"), _kind_of(F.col("word")).alias("kind"), patterns.alias("patterns"))


def discover(found: DataFrame, *, rounds: int = ROUNDS, seeds: int = MIN_SEEDS, worth: float = MIN_WORTH, score: float = MIN_SCORE) -> DataFrame:
    """(inst, kind): unseen instances that high-confidence patterns vouch for, when scoring has settled (after ``rounds`` at most)."""
    edges = keep(found.select(F.explode("patterns").alias("pattern"), "inst", "kind").distinct(), "pattern-graph")
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    known = edges.where("kind IS NOT NULL").select("inst", "kind").distinct().withColumn("score", F.lit(1.0))
    scores, unseen, before = known, None, None
    for _ in range(rounds):
        good = (
            edges.select("pattern", "inst").join(scores, "inst").groupBy("pattern", F.col("kind").alias("of"))
            .agg(F.sum("score").alias("mass"), F.count_if(F.col("score") >= 0.5).alias("seeds"))
            .where(F.col("seeds") >= seeds).join(sizes, "pattern")
            .withColumn("worth", F.col("mass") / (F.col("instances") + SMOOTHING)).where(F.col("worth") >= worth)
        )
        doubt = F.sum(F.log1p(-F.least("worth", F.lit(0.99))))
        unseen = keep(
            edges.where("kind IS NULL").join(good, "pattern").where(_shaped(F.col("of"), F.col("inst")))
            .groupBy("inst", F.col("of").alias("kind")).agg((1 - F.exp(doubt)).alias("score")), "instances"
        )
        now = unseen.agg(F.count("*"), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 6)).first()
        if now[0] == 0 or now == before:
            break
        scores, before = known.unionByName(unseen), now
    sure = unseen.where(F.col("score") >= score)
    return sure.groupBy("inst").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, base, added): arrays of (k, start, end), k counting ``KINDS``; both sorted."""
    scanned = keep(base_spans(docs), "personal")
    found = mentions(scanned)
    added = (
        found.where("kind IS NULL").select("doc_id", "mark", "start", "end", "inst").join(discover(found), "inst")
        .groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"))
        .agg(F.array_sort(F.collect_set(F.struct(F.col("kind").alias("k"), "start", "end"))).alias("added"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))
    free = F.expr("filter(added, a -> NOT exists(base, b -> b.start < a.end AND a.start < b.end))")
    none = F.expr("cast(array() AS array<struct<k:int,start:int,end:int>>)")
    return scanned.join(added, same, "left").select("doc_id", "mark", F.array_sort("base").alias("base"), F.coalesce(free, none).alias("added"))


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, mask: str = "[{}]") -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in brackets; overlapping spans are covered by the first one."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("_mark"), "text")
    spans = personal_spans(docs).select(F.col("doc_id").alias("_id"), "mark", F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k")))).alias("spans")).distinct()
    names = "array(" + ", ".join(f"'{mask.format(k)}'" for k in KINDS) + ")"
    text = F.expr(
        "aggregate(spans, named_struct('at', 0, 'out', ''), (a, s) -> if(s.start < a.at, a, named_struct('at', s.end, "
        f"'out', concat(a.out, substring(text, a.at + 1, s.start - a.at), get({names}, s.k)))), a -> concat(a.out, substring(text, a.at + 1)))"
    )
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("mark")))
    return joined.select("doc_id", text.alias("text"))
