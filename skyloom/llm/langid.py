"""Language identification with bit-sliced Bloom filters of byte n-grams.

Each slot of the filter is a bitmask of languages. An n-gram's slots, and-ed, tell all languages that
contain it; the number of a document's n-grams with a language's bit, less what false positives of
that language's slice would give, decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard
from .common import chosen, documents, id_bucket, mapped, stored
from .linear import bounded_sample

GRAM = 4
_WORDLIKE = re.compile(r"[^\W\d_]")
_PLAIN = bytes(c if c > 127 or 97 <= c <= 122 else 32 for c in range(256))
# Odd multipliers of the filter's hash functions.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def has_letter(text: str) -> bool:
    """Whether a character of text is a letter, of Unicode's category L: other numerals, such as fractions, are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def grams(text: str) -> np.ndarray:
    """Byte 4-grams of the lower-cased text, all but letters as single blanks, a blank at either end."""
    low = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()) + b" "
    b = np.frombuffer(low, np.uint8).astype(np.uint32)
    if len(b) < GRAM:
        return np.zeros(0, np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


@dataclass
class Filters:
    languages: list[str]
    slots: np.ndarray  # uint64, a row a slot, a bit for each language in as many words as they need
    share: np.ndarray  # of n-grams that a language's slice holds falsely

    def _slots(self, gram: np.ndarray):
        shift = np.uint64(64 - (len(self.slots).bit_length() - 1))
        return [(gram.astype(np.uint64) * np.uint64(m)) >> shift for m in _MIX]

    @staticmethod
    def slots_of(most: int) -> int:
        """Slots for languages of at most `most` n-grams: 16 for each."""
        return 1 << max(10, int(16 * max(1, most) - 1).bit_length())

    @classmethod
    def build(cls, languages: list[str], gram: np.ndarray, mask: np.ndarray) -> Filters:
        """mask: a row for each n-gram, words of 64 languages; one word may be given flat."""
        mask = mask[:, None] if mask.ndim == 1 else mask
        bit = lambda table, i: (table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        # a language's slice is a filter of its own: 16 slots for each n-gram of the language that has most keep
        # three hash functions under one false positive in a hundred
        most = max((int(bit(mask, i).sum()) for i in range(len(languages))), default=0)
        out = cls(languages, np.zeros((cls.slots_of(most), mask.shape[1]), np.uint64), np.zeros(len(languages)))
        for at in out._slots(gram):
            np.bitwise_or.at(out.slots, at.astype(np.int64), mask)
        fill = [np.mean(bit(out.slots, i)) for i in range(len(languages))]
        out.share = np.array(fill) ** len(_MIX)
        return out

    def counts(self, gram: np.ndarray) -> np.ndarray:
        """n-grams that each language contains, corrected for false positives: seen = true + share * (n - true)."""
        a, b, c = (self.slots[x.astype(np.int64)] for x in self._slots(gram))
        both = a & b & c
        seen = np.array([np.count_nonzero(both[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(self.languages))], float)
        return np.maximum(0, (seen - self.share * len(gram)) / np.maximum(1e-9, 1 - self.share))

    def decide(self, text: str, slice_size: int = 1 << 20) -> tuple[str, float]:
        """Language and its share of all counts; und and 0 for a text without letters."""
        if not self.languages or not has_letter(text):
            return "und", 0.0
        g = grams(text)
        n = sum((self.counts(g[i : i + slice_size]) for i in range(0, len(g), slice_size)), np.zeros(len(self.languages)))
        if not n.sum():
            return self.languages[0], 0.0
        return self.languages[int(n.argmax())], float(n.max() / n.sum())


def _grams_of(batches):
    for pdf in batches:
        for lang, part in pdf.groupby("lang", sort=False):
            for at in range(0, len(part), 64):  # few texts at once
                g = np.unique(np.concatenate([grams(t) for t in part.text.iloc[at : at + 64]]))
                yield pd.DataFrame({"lang": lang, "gram": g.astype(np.int64)})


def fit(taught: DataFrame, per_language: int = 1500, max_fit_chars: int = 100_000, max_filter_mb: int = 512) -> Filters:
    """Filters of all n-grams of a sample. taught: doc_id, text, lang; about per_language documents of each language are read,
    chosen by a hash, none over max_fit_chars. Every task holds the filter, which is slots of the largest language x languages / 8 bytes, and
    the driver the n-grams it is made of; where either needs over max_filter_mb it is refused before anything is gathered."""
    sample = bounded_sample(taught, "lang", per_language, max_fit_chars)
    pairs = stored(sample.select("lang", "text").mapInPandas(_grams_of, "lang string, gram long").distinct(), "grams")
    sizes = pairs.groupBy("lang").count().agg(F.count(F.lit(1)).alias("languages"), F.max("count").alias("most"), F.sum("count").alias("all")).first()
    needed = max(8 * Filters.slots_of(sizes.most or 0) * -(-sizes.languages // 64), 48 * (sizes["all"] or 0))
    if needed > max_filter_mb << 20:
        raise ValueError(f"{sizes.languages} languages of up to {sizes.most} n-grams need {needed >> 20} MB; lower per_language or raise max_filter_mb ({max_filter_mb})")
    table = pairs.toPandas()
    discard(pairs)
    languages = sorted(set(table.lang))
    number = table.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64) if len(table) else np.zeros(0, np.int64)
    gram, at = np.unique(table.gram.to_numpy(np.int64), return_inverse=True)
    mask = np.zeros((len(gram), max(1, -(-len(languages) // 64))), np.uint64)
    np.bitwise_or.at(mask, (at, number // 64), np.uint64(1) << (number % 64).astype(np.uint64))
    return Filters.build(languages, gram, mask)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1, **bounds: int) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (the winner's share of all corrected counts).

    Learns from rows outside the held fold whose language is not null. Null, empty and letterless texts (no character of
    Unicode's category L)
    are und with score 0; so is every text if nothing could be learnt. A text with letters but no n-gram that
    was learnt gets the first language in alphabetical order with score 0, as ties do with theirs. Rows map one to
    one, so repeated rows and null ids need no rule; an empty table gives an empty result.
    """
    rows = chosen(docs, id_col, text_col, lang=lang_col).withColumn("fold", id_bucket("doc_id", folds))
    model = fit(rows.filter((F.col("fold") != held_fold) & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang")), **bounds)

    def run(batches):
        for pdf in batches:
            out = pd.DataFrame([model.decide(t) for t in pdf.text], columns=["lang_pred", "score"])
            out.insert(0, "held_out", pdf.fold.to_numpy() == held_fold)
            out.insert(0, "doc_id", pdf.doc_id.to_numpy())
            yield out

    return mapped(rows.select("doc_id", "text", "fold"), run, f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir):
    return language_id(documents(spark, sf_dir))
