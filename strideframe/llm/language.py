"""Language identification by words first, character n-grams for words never seen.

A known word adds its log frequency in each language. An unseen word is cut into character n-grams of ``max_n``; n-grams
that were not seen either are cut into shorter ones, down to single characters, so every word gets a score from the
longest pieces that are known.

Counting runs on Spark over all training rows up to a documented bound per language (``train_rows``, chosen by a hash
of the id). The model has the ``max_words`` commonest words and ``max_grams`` commonest n-grams of every language by itself,
each with its counts in all languages, so a further language takes nothing from the others. Its size is counted before
it is gathered: one of over ``MODEL_BYTES`` is an error that names the bounds to lower.

Edge cases: null, empty and letterless texts are ``und`` with score 0; so is everything when nothing was learned.
Rows with a null language are never learned from but are predicted. Repeated rows get equal predictions. An empty
table gives no rows. Very long texts are scored whole. Extra columns are ignored. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.store import keep

UNKNOWN = "und"
#: Bounds of the fitted model: training rows and entries of each language, and the bytes of the whole.
TRAIN_ROWS, MAX_WORDS, MAX_GRAMS, MAX_N = 5_000, 30_000, 30_000, 4
MODEL_BYTES = 256 << 20
#: Scored words that a task remembers, and tokens that are scored at a time.
MEMO, TOKENS = 200_000, 300_000
#: Runs of letters; a few numeric signs (like ²) count in them, and a text of those alone is still without a language.
LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies, one row per piece and one column per language; ``floor`` is the row of unknown characters."""

    languages: tuple[str, ...]
    words: dict[str, int]
    word_rows: np.ndarray
    grams: dict[str, int]
    gram_rows: np.ndarray
    max_n: int

    @property
    def floor(self) -> int:
        return len(self.gram_rows) - 1

    def pieces(self, text: str, n: int, weight: float, rows: list[int], weights: list[float]) -> None:
        """Add the n-grams of ``text`` with their shares of ``weight``; unknown ones by their own shorter n-grams."""
        n = min(n, len(text))
        count = len(text) - n + 1
        share = weight / count
        for i in range(count):
            row = self.grams.get(text[i : i + n])
            if row is not None:
                rows.append(row)
                weights.append(share)
            elif n > 1:
                self.pieces(text[i : i + n], n - 1, share, rows, weights)
            else:
                rows.append(self.floor)
                weights.append(share)

    def score_words(self, words: Sequence[str]) -> np.ndarray:
        """One row of log scores per word: its own, or the weighted ones of its pieces."""
        known = np.array([self.words.get(w, -1) for w in words], np.int64)
        out = self.word_rows[known]
        unseen = np.flatnonzero(known < 0)
        if len(unseen):
            rows: list[int] = []
            weights: list[float] = []
            starts = []
            for i in unseen.tolist():
                starts.append(len(rows))
                self.pieces(f" {words[i]} ", self.max_n, 1.0, rows, weights)
            out[unseen] = np.add.reduceat(self.gram_rows[rows] * np.array(weights)[:, None], starts)
        return out

    def predict(self, texts: Iterable[str | None], memo: Memo | None = None) -> list[tuple[str, float]]:
        """(language, score) per text; the score is the language's share of the likelihoods."""
        memo = memo if memo is not None else Memo(len(self.languages))
        out: list[tuple[str, float]] = []
        tokens: list[list[str]] = []
        waiting = 0
        for text in texts:
            words = LETTERS.findall(text.lower()) if isinstance(text, str) and self.languages else []
            if words and not any(c.isalpha() for w in words for c in w):
                words = []
            tokens.append(words)
            waiting += len(words)
            if waiting >= TOKENS:
                out += self._predict(tokens, memo)
                tokens, waiting = [], 0
        return out + self._predict(tokens, memo)

    def _predict(self, tokens: list[list[str]], memo: Memo) -> list[tuple[str, float]]:
        lengths = np.array([len(t) for t in tokens], np.int64)
        filled = np.flatnonzero(lengths)
        out = [(UNKNOWN, 0.0)] * len(tokens)
        if not len(filled):
            return out
        codes, words = pd.factorize(np.array([w for t in tokens for w in t], object))
        table = memo.rows(words, self)
        starts = np.concatenate(([0], np.cumsum(lengths[filled])[:-1]))
        total = np.add.reduceat(table[codes], starts)
        best = total.argmax(1)
        score = 1.0 / np.exp(np.clip(total - total[np.arange(len(total)), best][:, None], -700, 0)).sum(1)
        for i, k, x in zip(filled.tolist(), best.tolist(), score.tolist(), strict=True):
            out[i] = self.languages[k], x
        return out


class Memo:
    """The scores of words met before, up to ``MEMO`` of them."""

    def __init__(self, languages: int):
        self.at: dict[str, int] = {}
        self.table = np.empty((MEMO, languages))

    def rows(self, words: np.ndarray, model: LanguageModel) -> np.ndarray:
        known = np.array([self.at.get(w, -1) for w in words], np.int64)
        out = self.table[known]
        fresh = np.flatnonzero(known < 0)
        if len(fresh):
            made = model.score_words([words[i] for i in fresh])
            out[fresh] = made
            full = len(self.at)
            room = min(len(fresh), MEMO - full)
            self.table[full : full + room] = made[:room]
            self.at.update((words[i], full + k) for k, i in enumerate(fresh[:room].tolist()))
        return out


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def _table(rows: list, languages: tuple[str, ...]) -> tuple[dict[str, int], np.ndarray]:
    """Row number by piece, and the smoothed log frequencies; the last row is that of an unseen piece."""
    at = {x: i for i, x in enumerate(languages)}
    number = {piece: i for i, piece in enumerate(dict.fromkeys(r["piece"] for r in rows))}
    counts = np.full((len(number) + 1, len(languages)), 0.5)
    for row in rows:
        counts[number[row["piece"]], at[row["lang"]]] += row["n"]
    return number, np.log(counts / counts.sum(0))


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """The (lang, piece, n) of all pieces that are among the ``most`` commonest of some language."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "piece")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("piece").distinct()
    return counts.join(top, "piece").select("lang", "piece", "n")


def _gather(counts: DataFrame, languages: tuple[str, ...]) -> list:
    """The rows, if the table that they make is of a size for driver and tasks."""
    counts = keep(counts, "language-pieces")
    size = counts.agg(F.countDistinct("piece").alias("pieces"), F.coalesce(F.sum(F.octet_length("piece")), F.lit(0)).alias("bytes")).first()
    if size["pieces"] * (8 * len(languages) + 100) + size["bytes"] > MODEL_BYTES:
        raise ValueError(f"{size['pieces']} pieces of {len(languages)} languages exceed MODEL_BYTES; lower max_words, max_grams")
    return counts.collect()


def fit(
    docs: DataFrame, *, train_rows: int = TRAIN_ROWS, max_words: int = MAX_WORDS, max_grams: int = MAX_GRAMS, max_n: int = MAX_N
) -> LanguageModel:
    """Learn from ``text`` and ``lang`` of the rows that are not held out.

    Hash thresholds, not a sort, choose about ``train_rows`` rows a language, so no language is gathered in one task.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)).alias("h")
    )
    # One row per language, as many as the model has columns.
    shares = [(r["lang"], min(1.0, train_rows / r["count"])) for r in rows.groupBy("lang").count().collect()]
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares for x in pair]), F.col("lang")) if shares else F.lit(0.0)
    chosen = rows.where(F.col("h") < share * (1 << 20)).select("lang", "text")
    words = (
        chosen.select("lang", F.explode(F.expr(r"regexp_extract_all(lower(text), '\\p{L}+', 0)")).alias("piece"))
        .groupBy("lang", "piece")
        .agg(F.count("*").alias("n"))
        .persist()
    )
    try:
        languages = tuple(sorted(r["lang"] for r in words.select("lang").distinct().collect()))
        top_words = _gather(_commonest(words, max_words), languages)
        padded = F.concat(F.lit(" "), "piece", F.lit(" "))
        grams = None
        for n in range(1, max_n + 1):
            part = words.where(F.char_length(padded) >= n).select(
                "lang", "n", F.explode(F.expr(f"transform(sequence(1, char_length(piece) + {3 - n}), i -> substring(concat(' ', piece, ' '), i, {n}))")).alias("piece")
            )
            grams = part if grams is None else grams.unionByName(part)
        grams = grams.groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        top_grams = _gather(_commonest(keep(grams, "language-grams"), max_grams), languages)
    finally:
        words.unpersist()
    if not languages:
        return LanguageModel((), {}, np.zeros((1, 0)), {}, np.zeros((1, 0)), max_n)
    return LanguageModel(languages, *_table(top_words, languages), *_table(top_grams, languages), max_n)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """All columns of ``docs`` and a struct ``language`` (lang_pred, score). Only the text is read for it."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memo = Memo(len(shared.value.languages))
        for texts in batches:
            yield pd.DataFrame(shared.value.predict(texts, memo), columns=["lang_pred", "score"])

    return docs.withColumn("language", predict("text"))


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a recognisable language (``und``); all others stay unchanged."""
    packed = docs.select(F.struct(*docs.columns).alias("doc"), "text")
    return identify(packed, fit(docs)).where(F.col("language.lang_pred") != UNKNOWN).select("doc.*")
