"""Substring dedup on sliding sentence spans.

Runs of consecutive sentences are hashed (128 bits): at every sentence the shortest run that starts there, and the shortest that ends there, of at
least `run` sentences and `min_words` words. The global join of the hashes finds runs that occur more than once. The first occurrence (smallest
id, then earliest in the text) stays, and every sentence that any later occurrence covers is removed. A repeated passage of that size is covered to its
last sentence, since it holds the runs that end in it. A text too short for a run is one run as a whole. Sentences end at . ! ? after a word, or at a
line end. Sentences compare without case and spacing.

Hashes meet in a map-side combined aggregate, so a passage that a third of all documents share is one row for each
task; only repeated hashes are joined back, and the join can be split at any key.

Defined results: null text stays null with no sentences; empty text has none. Rows with equal id and text are one document
(each gets the same result). Null ids sort last. Other columns pass through unchanged; columns named as the counts are replaced. An empty table gives
an empty result. A text's arrays are held by one task, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import U64, encode, map_texts, materialize, mix64, random64, release, row_key, word_hashes

RUN, MIN_WORDS = 2, 20
_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def split(text: object) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte at which each sentence starts, its number of words, its hash); a sentence reaches to the start of the next."""
    raw = np.frombuffer(encode(text), np.uint8)
    words, _ = word_hashes([text])
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    space = np.concatenate([[True], _SPACE[raw], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    last = _ENDS[raw[ends - 1]]
    last[:-1] |= breaks[starts[1:]] > breaks[ends[:-1]]
    first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    count = np.diff(np.concatenate([first, [len(words)]]))
    place = np.arange(len(words)) - np.repeat(first, count)
    value = np.add.reduceat(words * (random64(int(count.max()), 41) | U64(1))[place], first)
    return starts[first], count, mix64(value + count.astype(U64))


def runs(counts: np.ndarray, hashes: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first sentence, sentence after the last, two 64-bit hashes) of a text's runs, in order.

    Hashes are differences of prefix sums weighted by powers of an odd base, so a run costs the same whatever its length.
    """
    n = len(counts)
    before = np.concatenate([[0], np.cumsum(counts)])
    if n < run or before[-1] < min_words:
        first, last = np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n, np.int64)
    else:
        at = np.arange(n)
        end = np.maximum(at + run, np.searchsorted(before, before[:-1] + min_words))
        start = np.minimum(at + 1 - run, np.searchsorted(before, before[1:] - min_words, side="right") - 1)
        pairs = np.concatenate([(at * (n + 1) + end)[end <= n], (start * (n + 1) + at + 1)[start >= 0]])
        first, last = np.divmod(np.unique(pairs), n + 1)
    out = []
    for k, base in enumerate((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        power = np.cumprod(np.full(len(counts), base, U64))
        back = np.cumprod(np.full(len(counts), pow(base, -1, 1 << 64), U64))
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix64(hashes ^ U64(k)) * power)])
        out.append(mix64((sums[last] - sums[first]) * back[first] + (last - first).astype(U64)).view(np.int64))
    return first, last, out[0], out[1]


def _spans(run: int, min_words: int):
    def go(texts: list) -> list:
        got = [runs(*split(t)[1:], run, min_words) for t in texts]
        return [[[{"at": a, "one": x, "two": y} for a, x, y in zip(range(len(g[0])), g[2].tolist(), g[3].tolist(), strict=True)] for g in got]]

    return lambda: go


_SPAN = pa.list_(pa.struct([("at", pa.int32()), ("one", pa.int64()), ("two", pa.int64())]))


def _cut(run: int, min_words: int):
    """From one string per row, the places (in runs()) of the runs to remove, comma-separated, a line feed, and the text."""

    def one(row: str | None) -> tuple[str | None, int, int, int]:
        if row is None:
            return None, 0, 0, 0
        places, _, text = row.partition("\n")
        at, count, hashes = split(text)
        if not places:
            return text, len(at), 0, 0
        drop = np.zeros(len(at), bool)
        first, last = runs(count, hashes, run, min_words)[:2]
        for k in map(int, places.split(",")):
            drop[first[k] : last[k]] = True
        raw = encode(text)
        bounds = np.concatenate([at, [len(raw)]])
        left = raw[: at[0]] + b"".join(raw[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(~drop))
        return left.decode("utf-8", "surrogatepass"), len(at), int(drop.sum()), int(count[drop].sum())

    return lambda: lambda rows: list(zip(*map(one, rows), strict=True))


def dedup_spans(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with repeated passages removed from text, plus n_sentences, n_removed (sentences) and n_words_removed."""
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    source = source.withColumn("rk", row_key("doc_id", "text"))
    found = map_texts(source, "text", _spans(run, min_words), {"spans": ("array<struct<at:int,one:long,two:long>>", _SPAN)}, drop_text=True)
    spans = materialize(found.select("doc_id", "rk", F.explode("spans").alias("s")).select("doc_id", "rk", "s.at", "s.one", "s.two"))
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rk", "at")
    first = spans.groupBy("one", "two").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    # written, so that both sides of the join are plain exchanges and a hot hash can be split among tasks
    first = materialize(first.select("one", "two", "first"))
    repeated = spans.join(first, ["one", "two"])
    later = repeated.where((F.col("rk") != F.col("first.rk")) | (F.col("at") != F.col("first.at")))
    # a document's own runs: at most two for each sentence, never a corpus-wide group
    cuts = materialize(later.groupBy("rk").agg(F.array_sort(F.collect_set("at")).cast("array<string>").alias("__weft_at")).withColumnRenamed("rk", "__weft_rk"))
    keyed = docs.withColumn("__weft_rk", row_key(F.col(doc_id).cast("long"), F.col(text).cast("string")))
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "n_words_removed")]
    places = F.concat(F.array_join(F.coalesce("__weft_at", F.array().cast("array<string>")), ","), F.lit("\n"), F.col(f"`{text}`").cast("string"))
    joined = keyed.join(cuts, "__weft_rk", "left").select(*[places.alias(text) if c == text else F.col(f"`{c}`") for c in names])
    whole = ("long", pa.int64())
    out = map_texts(joined, text, _cut(run, min_words), {text: ("string", pa.string()), "n_sentences": whole, "n_removed": whole, "n_words_removed": whole})
    release(spans, first)
    return out
