"""Language identification by bit-sliced Bloom filters.

One table of bit masks serves all languages: bit l of a slot belongs to language l's Bloom filter, so the AND of an n-gram's
slots is the set of languages that contain it. A document adds up, per language, how many of its n-grams are
contained, corrects that for the filter's rate of false positives, and takes the language with the largest share.

Every n-gram that a language's training text holds is in its filter. Filters are built by the tasks: the distinct n-grams of each language are
counted first, the filter is sized from the largest count, and slots meet in an OR aggregate; the driver gets the filter, never the n-grams.

Defined results: null text, or text without a letter: `und`, score 0. Without a training language all rows are `und`. Ties go to
the language with more training n-grams, then by name. A null language is not learned. Repeated rows add nothing. Texts are read whole, one at a time.
Other columns pass through; columns of the names of prediction and score are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import U64, encode, map_texts, materialize, mix64, release

N, HASHES = 4, 3
#: Slots for each n-gram of the largest language, and the bounds of the filter's size as powers of two. Beyond the upper one filters only get denser.
SLOTS_PER_GRAM, LEAST_BITS, MOST_BITS = 12, 16, 28
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[:65] = 32
_CLASS[91:97] = 32
_CLASS[123:128] = 32


def grams(text: object) -> np.ndarray:
    """Ids (the N bytes themselves) of the byte n-grams of the letters, lower-cased, other ASCII as one space; windows of spaces only are left out."""
    codes = _CLASS[np.frombuffer(b" " + encode(text) + b" ", np.uint8)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes = codes[keep].astype(np.uint32)
    if len(codes) < N:
        codes = np.concatenate([codes, np.full(N - len(codes), 32, np.uint32)])
    gram = codes[: len(codes) - N + 1].copy()
    for j in range(1, N):
        gram |= codes[j : len(codes) - N + 1 + j] << np.uint32(8 * j)
    return gram.astype(np.int64)


def slots(ids: np.ndarray, bits: int) -> np.ndarray:
    """(hash, n-gram) -> slot of a filter of 2^bits slots; two halves of one hash, combined."""
    h = mix64(ids.astype(U64) + U64(0x2545F4914F6CDD1D))
    low, high = h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)
    return np.stack([(low + U64(k) * high) & U64((1 << bits) - 1) for k in range(HASHES)]).astype(np.int64)


@dataclass
class Filters:
    languages: list[str]
    bits: int
    table: np.ndarray  # (slot, word): bit l % 64 of word l // 64 belongs to language l; words of 8 bits where that is enough
    rates: np.ndarray  # chance that a gram outside is reported, per language

    def shares(self, ids: np.ndarray) -> np.ndarray:
        """Per language, the corrected share of the n-grams that its filter holds."""
        a = slots(ids, self.bits)
        mask = self.table[a[0]]
        for k in range(1, HASHES):
            mask = mask & self.table[a[k]]
        one = self.table.dtype.type(1)
        hits = np.array([np.count_nonzero(mask[:, k // 64] & (one << self.table.dtype.type(k % 64))) for k in range(len(self.languages))])
        return np.clip((hits / max(1, len(ids)) - self.rates) / np.maximum(1 - self.rates, 1e-9), 0.0, 1.0)


def _distinct(batches: Iterator[pd.DataFrame], hold: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """(lang, gram) of a task, each pair once for at least `hold` pairs read; a language holds one sorted array."""
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pd.DataFrame]:
        for lang in list(held):
            yield pd.DataFrame({"lang": lang, "gram": held.pop(lang)})

    for pdf in batches:
        for lang, rows in pdf.groupby("lang")["text"]:
            part: list[np.ndarray] = []
            for t in rows:
                part.append(np.unique(grams(t)))
                if sum(map(len, part)) > hold // 4:
                    part = [np.unique(np.concatenate(part))]
            held[lang] = np.unique(np.concatenate([held.get(lang, np.zeros(0, np.int64)), *part]))
        if sum(map(len, held.values())) > hold:
            yield from flush()
    yield from flush()


def _slot_masks(order: list[str], bits: int):
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, rows in pdf.groupby("lang")["gram"]:
                k = order.index(lang)
                at = np.unique(slots(rows.to_numpy(), bits))
                yield pd.DataFrame({"slot": at, "word": np.full(len(at), k // 64, np.int32), "mask": np.full(len(at), (U64(1) << U64(k % 64)).astype(np.int64))})

    return go


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> Filters:
    """docs: the training rows only. The driver gets one count for each language and the slots in use, at most 2^MOST_BITS for each 64 languages."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    found = materialize(rows.mapInPandas(_distinct, "lang string, gram long").distinct())
    sizes = sorted(found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (-r["n"], r["lang"]))
    order = [r["lang"] for r in sizes]
    bits = min(MOST_BITS, max(LEAST_BITS, int(SLOTS_PER_GRAM * (sizes[0]["n"] if sizes else 1)).bit_length()))
    kind = next(t for t, most in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (U64, len(order) + 64)) if len(order) <= most)
    table = np.zeros((1 << bits, max(1, -(-len(order) // 64))), kind)
    masks = found.mapInPandas(_slot_masks(order, bits), "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    got = masks.toPandas()
    table[got["slot"].to_numpy(np.int64), got["word"].to_numpy(np.int64)] = got["mask"].to_numpy(np.int64).view(U64).astype(kind)
    release(found)
    rates = [(np.count_nonzero(table[:, k // 64] & (kind(1) << kind(k % 64))) / len(table)) ** HASHES for k in range(len(order))]
    return Filters(order, bits, table, np.array(rates))


def predict(docs: DataFrame, filters: Filters, *, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with lang_pred and score (the best corrected share over the sum of all), by a narrow scan; columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def make() -> Callable[[list], list]:
        f = held.value

        def one(t: str | None) -> tuple[str, float]:
            if not t or not f.languages or not any(map(str.isalpha, t)):
                return "und", 0.0
            shares = f.shares(grams(t))
            k = int(np.argmax(shares))
            return f.languages[k], float(shares[k] / shares.sum()) if shares.sum() > 0 else 0.0

        return lambda texts: list(zip(*map(one, texts), strict=True))

    return map_texts(docs, text, make, {out: ("string", pa.string()), score: ("double", pa.float64())})
