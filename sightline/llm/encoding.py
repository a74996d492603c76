"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Tree concatenation: a text longer than a leaf is cut into leaves which are encoded in
parallel tasks; neighbouring results are joined pairwise. Where a seam lies between two
words both sides agree for certain. At any other the text is split and encoded anew in a
window around the seam, which grows until the window's pieces agree with those of both
sides. Inside one unsplit piece (letters without a break) the
same is done on tokens: the window grows until its first and last token are those of the
two sides, which makes every neighbouring pair of tokens valid and so the whole exact.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.session import spread as over_cores

#: Where the vocabulary files lie; a parameter of every operator below.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf; bytes up to which a piece is merged at once.
LEAF, PIECE = 8192, 2048
#: The pattern looks at most so many characters past the end of a piece.
LOOK = 3
_SPLIT = regex.compile(PATTERN)


@lru_cache(maxsize=4)
def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> tiktoken.Encoding:
    """The tokenizer of a rank file, without special tokens; kept per worker."""
    lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def join_tokens(enc: tiktoken.Encoding, left: list[int], right: list[int]) -> list[int]:
    """Encoding of two neighbouring byte strings of one piece, from their encodings."""
    w = 4
    while left and right:
        a, b = left[-w:], right[:w]
        new = enc._encode_single_piece(enc.decode_bytes(a + b))
        if (w >= len(left) or new[0] == a[0]) and (w >= len(right) or new[-1] == b[-1]):
            return left[:-w] + new + right[w:]
        w *= 2
    return left + right


def encode_piece(enc: tiktoken.Encoding, data: bytes) -> list[int]:
    """Encoding of one piece; long ones by halves."""
    if len(data) <= PIECE:
        return enc._encode_single_piece(data)
    middle = len(data) // 2
    return join_tokens(enc, encode_piece(enc, data[:middle]), encode_piece(enc, data[middle:]))


class Encoded:
    """A text with the ends of its pieces and the tokens of each piece."""

    __slots__ = ("ends", "text", "tokens")

    def __init__(self, text: str, ends: list[int], tokens: list[list[int]]) -> None:
        self.text, self.ends, self.tokens = text, ends, tokens

    @classmethod
    def of(cls, enc: tiktoken.Encoding, text: str) -> Encoded:
        pieces = [m.span() for m in _SPLIT.finditer(text)]
        return cls(text, [e for _, e in pieces], [encode_piece(enc, text[s:e].encode("utf-8", "replace")) for s, e in pieces])

    def ids(self) -> list[int]:
        return [t for piece in self.tokens for t in piece]


def join_texts(enc: tiktoken.Encoding, a: Encoded, b: Encoded) -> Encoded:
    """The encoding of ``a.text + b.text``: only a window around the seam is split anew."""
    if not a.text or not b.text:
        return b if not a.text else a
    k, n = 4, len(a.text)
    while True:
        i = max(0, len(a.ends) - k)
        start = a.ends[i - 1] if i else 0
        last = min(len(b.ends), k)
        limit = b.ends[last - 1]
        window = a.text[start:] + b.text[: limit + LOOK]
        spans = [(m.start() + start, m.end() + start) for m in _SPLIT.finditer(window)]
        bounds = {0} | set(b.ends[:last])
        whole = limit + LOOK >= len(b.text)
        for j, (_, end) in enumerate(spans):
            r = end - n
            if r >= 0 and r in bounds and r <= limit and (whole or r + LOOK <= limit + LOOK):
                kept = bisect_left(b.ends, r) + 1 if r else 0
                fresh = [encode_piece(enc, (a.text[s:e] if e <= n else a.text[s:n] + b.text[max(0, s - n) : e - n]).encode("utf-8", "replace")) for s, e in spans[: j + 1]]
                ends = a.ends[:i] + [e for _, e in spans[: j + 1]] + [e + n for e in b.ends[kept:]]
                return Encoded(a.text + b.text, ends, a.tokens[:i] + fresh + b.tokens[kept:])
        if i == 0 and last == len(b.ends):
            return Encoded.of(enc, a.text + b.text)
        k *= 2


def join_all(enc: tiktoken.Encoding, parts: list[Encoded]) -> Encoded:
    """Balanced tree of joins."""
    while len(parts) > 1:
        parts = [join_texts(enc, parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else Encoded("", [], [])


def cuts(text: str, leaf: int) -> list[tuple[int, bool]]:
    """Ends of a text's leaves, each with whether a piece ends there whatever stands around it.

    A single blank between two letters opens the piece of the word after it, so a text cut
    there is encoded as its parts are. Where none stands in the last eighth of a leaf the cut
    is made anyway, and the seam is joined by growing windows.
    """
    out, at = [], 0
    while len(text) - at > leaf:
        to = low = at + leaf
        while (low := text.rfind(" ", at + leaf - leaf // 8, low)) > at:
            if text[low - 1].isalpha() and text[low + 1].isalpha():
                break
        out.append((low, True) if low > at else (to, False))
        at = out[-1][0]
    return [*out, (len(text), True)]


def encode_corpus(df: DataFrame, key: str, text: str, folder: str = TOKENIZERS, name: str = "byte_bpe_50k", leaf: int = LEAF) -> DataFrame:
    """(key, ids) of every row, special tokens read as ordinary text.

    Null and empty texts have the defined value of an empty list. Repeated rows stay
    repeated, other columns are left out, an empty table gives an empty one. Texts up to
    ``leaf`` characters are encoded where they are read; longer ones are cut, their leaves
    spread by hash over tasks and joined per row.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    rows = over_cores(df.select(F.col(key).alias("k"), F.col(text).alias("t")))
    length = F.length(F.coalesce("t", F.lit("")))

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, name)
        for b in batches:
            texts = [x.encode("utf-8", "replace").decode("utf-8") if isinstance(x, str) else "" for x in b["t"]]
            yield pd.DataFrame({"k": b["k"], "ids": [enc.encode_ordinary(x) for x in texts]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, r, t in zip(b["k"], b["r"], b["t"]):
                t = t.encode("utf-8", "replace").decode("utf-8")
                ends = cuts(t, leaf)
                starts = [(0, True), *ends[:-1]]
                yield pd.DataFrame({"k": [k] * len(ends), "r": [r] * len(ends), "i": range(len(ends)), "sealed": [a and b for (_, a), (_, b) in zip(starts, ends)], "last": [b for _, b in ends], "t": [t[a:b] for (a, _), (b, _) in zip(starts, ends)]})

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, name)
        for b in batches:
            # A leaf between certain borders is encoded whole; the pieces of others are needed for their seams.
            done = [None if s else Encoded.of(enc, t) for s, t in zip(b["sealed"], b["t"])]
            b["ends"], b["sizes"] = [[] if x is None else x.ends for x in done], [[] if x is None else [len(p) for p in x.tokens] for x in done]
            b["ids"] = [enc.encode_ordinary(t) if x is None else x.ids() for x, t in zip(done, b["t"])]
            b["t"] = ["" if x is None else t for x, t in zip(done, b["t"])]
            yield b

    def joined(b: pd.DataFrame) -> pd.DataFrame:
        enc, out, parts = encoder(folder, name), [], []
        b = b.sort_values("i")
        for sealed, last, t, ends, sizes, ids in zip(b["sealed"], b["last"], b["t"], b["ends"], b["sizes"], b["ids"]):
            if sealed:
                out.append(np.asarray(ids, dtype="int32"))
                continue
            flat, bounds = ids.tolist(), [0, *np.cumsum(sizes).tolist()]
            parts.append(Encoded(t, ends.tolist(), [flat[x:y] for x, y in zip(bounds, bounds[1:])]))
            if last:
                out.append(np.asarray(join_all(enc, parts).ids(), dtype="int32"))
                parts = []
        return pd.DataFrame({"k": [b["k"].iloc[0]], "ids": [np.concatenate(out)]})

    whole = rows.where(length <= leaf).mapInPandas(short, f"k {kind}, ids array<int>")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = rows.where(length > leaf).withColumn("r", F.monotonically_increasing_id()).mapInPandas(cut, f"k {kind}, r long, i int, sealed boolean, last boolean, t string").repartition(spread, "r", "i")
    pieces = pieces.mapInPandas(leaves, f"k {kind}, r long, i int, sealed boolean, last boolean, t string, ends array<int>, sizes array<int>, ids array<int>")
    long = pieces.groupBy("r").applyInPandas(joined, f"k {kind}, ids array<int>")
    return whole.unionByName(long).withColumnRenamed("k", key)
