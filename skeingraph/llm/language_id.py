"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams of a language, in order.  A
document's own list is compared to each by the out-of-place measure: the sum over the
document's n-grams of how far the rank differs, or the length of the list where the
language lacks the n-gram.  The nearest profile wins; ties go to the smaller language
by code point.

Words are runs of letters in lower case with a boundary mark on each side; n-grams do
not span words.  Whole texts are read.  A null text, or one without a letter, is
``und`` with score 0, as is every text when nothing could be learned (an empty table, or
no row with a language and a text).  Rows are independent: repeated rows repeat their
answer, and ids, null or not, are only passed on.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: n-grams of a profile; symbols that a profile can tell apart.
PROFILE_SIZE, MAX_SYMBOLS = 300, 1021
UNDETERMINED = "und"
_OTHER = 1022


def _letter_codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with 0 for each that is no letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.where(_letters()[np.minimum(points, 0x3FFFF)], points, 0)


_letter_table: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _letter_table:
        _letter_table.append(np.fromiter((chr(i).isalpha() for i in range(0x40000)), dtype=bool, count=0x40000))
    return _letter_table[0]


def _bounded(codes: np.ndarray) -> np.ndarray:
    """One 0 between words and at both ends."""
    codes = np.concatenate(([0], codes, [0]))
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def _ngrams(symbols: np.ndarray) -> np.ndarray:
    """Keys of all 1-, 2- and 3-grams of 10-bit symbols, without those that span words."""
    s = symbols.astype(np.int32)
    one = s[s > 0]
    two = (s[:-1] << 10 | s[1:])[(s[:-1] > 0) | (s[1:] > 0)] | (1 << 30)
    three = (s[:-2] << 20 | s[1:-1] << 10 | s[2:])[s[1:-1] > 0] if len(s) > 2 else s[:0]
    return np.concatenate((one, two, np.where(three > 0, three | np.int32(-(1 << 31)), three)))


def _most_frequent(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` most frequent keys in order (ties: smaller key first), and their counts."""
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(at, len(keys)))
    order = np.argsort(-counts, kind="stable")[:size]
    return keys[at][order], counts[order]


@dataclass(frozen=True)
class Profiles:
    """Learned profiles: languages in order, symbols of code points, ranks of n-grams."""

    languages: list[str]
    alphabet: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    size: int

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.where(codes > 0, _OTHER, 0)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(codes == 0, 0, np.where(self.alphabet[at] == codes, at + 1, _OTHER))

    def predict(self, text: str | None) -> tuple[str, float]:
        codes = _letter_codes(text or "")
        if not codes.any() or not self.languages:
            return UNDETERMINED, 0.0
        own, _ = _most_frequent(_ngrams(self.symbols(_bounded(codes))), self.size)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        ranks = np.where((self.keys[at] == own)[:, None], self.ranks[at], -1)
        off = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(off))
        rest = np.delete(off, best)
        second = int(rest.min()) if len(rest) else self.size * len(own)
        return self.languages[best], float(second / (second + off[best])) if second else 0.5


def learn_profiles(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", order: Column | None = None, max_docs: int = 2000, size: int = PROFILE_SIZE) -> Profiles:
    """Profiles from the rows with a language and a text.

    About ``max_docs`` rows of each language are read for it (all, if it has fewer): those
    whose hash of ``order`` (by default the text) lies in the share of all hashes that its
    count of rows asks for, so no task ranks a language's rows; rows of one ``order`` are in
    or out together.  n-grams are counted in the tasks and summed by (language, n-gram).
    One row per language is broadcast and ``size`` rows per language reach the driver; the
    labels are taken to be a fixed set of languages.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(order if order is not None else F.col(text_col)).alias("pos"))
    rows = rows.where("lang is not null and text is not null")
    # Hashes are spread evenly over all 64-bit numbers.
    share = F.least(F.lit(1.0), F.lit(max_docs) / F.count(F.lit(1)))
    bounds = rows.groupBy("lang").agg((share * 18446744073709551616.0 - 9223372036854775808.0).alias("below"))
    sample = rows.join(F.broadcast(bounds), "lang").where("cast(pos as double) <= below").select("lang", "text")
    grams = sample.mapInArrow(_count_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    top = grams.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    return _profiles([(r["lang"], r["gram"], r["rank"] - 1) for r in top], size)


def _count_grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of n-grams by language; a gram is its code points, with a blank for a boundary."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(_letter_codes(text))
            for lang, codes in texts.items():
                joined = _bounded(np.concatenate([x for c in codes for x in (c, [0])]))
                alphabet = np.unique(joined[joined > 0])
                if not len(alphabet):
                    continue
                for n in (1, 2, 3):
                    windows = np.lib.stride_tricks.sliding_window_view(joined, n)
                    ok = windows[:, 0] > 0 if n == 1 else windows.any(axis=1) if n == 2 else windows[:, 1] > 0
                    index = np.searchsorted(alphabet, windows[ok]) + (windows[ok] > 0)
                    base = len(alphabet) + 1
                    keys, counts = np.unique(index @ (base ** np.arange(n)[::-1]), return_counts=True)
                    chars = np.concatenate(([ord(" ")], alphabet))
                    digits = (keys[:, None] // base ** np.arange(n)[::-1]) % base
                    grams = ["".join(map(chr, chars[d])) for d in digits]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])


def _profiles(rows: list[tuple[str, str, int]], size: int) -> Profiles:
    languages = sorted({lang for lang, _, _ in rows})
    weight: dict[str, int] = {}
    for _, gram, rank in rows:
        for c in gram.strip(" "):
            weight[c] = weight.get(c, 0) + size - rank
    chars = sorted(sorted(weight, key=lambda c: (-weight[c], c))[:MAX_SYMBOLS])
    alphabet = np.array([ord(c) for c in chars], dtype=np.int64)
    symbol = {c: i + 1 for i, c in enumerate(chars)} | {" ": 0}
    keyed: dict[int, dict[str, int]] = {}
    for lang, gram, rank in rows:
        s = np.array([symbol.get(c, _OTHER) for c in gram], dtype=np.int64)
        key = int(_one_key(s))
        keyed.setdefault(key, {}).setdefault(lang, rank)
    keys = np.array(sorted(keyed), dtype=np.int32)
    ranks = np.full((max(1, len(keys)), len(languages)), -1, dtype=np.int32)
    for i, key in enumerate(keys):
        for lang, rank in keyed[int(key)].items():
            ranks[i, languages.index(lang)] = rank
    return Profiles(languages, alphabet, keys if len(keys) else np.zeros(1, np.int32), ranks, size)


def _one_key(symbols: np.ndarray) -> np.int32:
    if len(symbols) == 1:
        return np.int32(symbols[0])
    if len(symbols) == 2:
        return np.int32(symbols[0] << 10 | symbols[1] | 1 << 30)
    return np.int32((symbols[0] << 20 | symbols[1] << 10 | symbols[2]) - (1 << 31))


def identify(docs: DataFrame, profiles: Profiles, *, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (share of the runner-up's distance, 0.5 to 1, 0 for ``und``).

    The output has the columns of ``docs`` without the text; columns of these two names are replaced.
    """
    kept = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [profiles.predict(text.as_py()) for text in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())], names=schema.names)

    return docs.select(*kept, text_col).mapInArrow(run, schema)
