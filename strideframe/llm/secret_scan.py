"""Secrets in texts: base patterns, and strings that a tokenizer can hardly compress.

A byte-pair vocabulary covers words and names with long tokens; random strings fall apart into short ones. Every run of
token characters that stands by itself is encoded, and one with few characters per token is taken for a secret, unless
its shape is that of a digest or an identifier, which are random but not secret: hexadecimal digests of the usual
lengths, subresource hashes, UUIDs, numbers with separators (dates, serial and phone numbers), and inlined binary data.

``MAX_RATIO`` lies between random strings of letters and digits (99.9 % of 20 characters have at most 1.85, those of
lower-case letters alone up to 2.2) and words: names in code have 2.5 or more, invented words of the test tables over 1.85.

Odd input: a null text counts as empty and has no spans; texts of any length are scanned whole; repeated rows are scanned
each. Ties can't occur: spans of a kind never overlap, and added spans overlap no base span; spans that start together
are ordered by kind. An empty table gives no rows. Only ``doc_id`` and ``text`` are read, so other columns, whatever
their names, change nothing.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
ADDED = "random"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MIN_CHARS, MAX_RATIO = 20, 1.85

# The base patterns and their least lengths, and the split pattern that belongs to the vocabulary.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A maximal run of hexadecimal digits is long enough exactly where this matches; most runs are letters of words.
_LONG_HEX = re.compile(HEX.pattern.replace("+", f"{{{LEAST['hex']},}}"))
_CANDIDATE = re.compile(rf"(?<![\w+/=-])[A-Za-z0-9+/_=-]{{{MIN_CHARS},}}+(?!\w)")
_KNOWN = re.compile(
    r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"  # digests
    r"|sha(?:256|384|512)-[a-z0-9+/]+=*"  # subresource hashes
    r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"  # UUIDs
    r"|(?:[a-z]{1,5}-)?[0-9]+(?:[-_/+=tz]*[0-9]+)*z?=*)",  # numbers with separators
    re.IGNORECASE | re.ASCII,
)

_SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"
_RESULT = f"doc_id bigint, base {_SPANS}, spans {_SPANS}"


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("secret-scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``(start, rank of the kind, kind, end)`` of the base patterns, sorted."""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, "hex", m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, str, int]]) -> list[tuple[int, int]]:
    """Runs to encode: long ones outside the base spans that aren't known digests or identifiers."""
    found = []
    for m in _CANDIDATE.finditer(text):
        start, end = m.start(), m.end()
        if _KNOWN.fullmatch(m.group()) or text.endswith("base64,", 0, start) or any(s < end and start < e for s, _, _, e in base):
            continue
        found.append((start, end))
    return found


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``doc_id, base, spans``: base spans and all spans (base and added) of every document, sorted by start and kind.

    ``vocabulary`` is a rank file that the driver reads and broadcasts (under a megabyte; larger than 16 MB is refused).
    """
    with open(vocabulary, "rb") as file:
        ranks = file.read((16 << 20) + 1)
    if len(ranks) > 16 << 20:
        raise ValueError(f"{vocabulary} is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    span = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(shared.value)
        names = ("start", "rank", "kind", "end")
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            base = [base_spans(text) for text in texts]
            runs = [(i, start, end) for i, text in enumerate(texts) for start, end in candidates(text, base[i])]
            tokens = encoding.encode_ordinary_batch([texts[i][start:end] for i, start, end in runs], num_threads=1)
            spans = [list(found) for found in base]
            for (i, start, end), ids in zip(runs, tokens, strict=True):
                if end - start < max_ratio * len(ids):
                    spans[i].append((start, len(KINDS), ADDED, end))
            columns = [pa.array([[dict(zip(names, s, strict=True)) for s in sorted(found)] for found in side], span) for side in (base, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _RESULT)


def as_text(spans: str) -> Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')")
