"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e edits is split in e + 1 pieces: a copy with at most e edits holds one piece unchanged.
One Aho-Corasick automaton finds all exact piece hits in a text; each hit is verified with Myers' bit-parallel edit
distance of the whole item against the window that the hit allows. Texts and items compare without case, punctuation and spacing.

The budget is the error rate times the item's length, rounded down; where that is 0, the item matches as whole words.

The distinct item texts go to the tasks in blocks of about `block_chars` characters, one pass over the documents for each block; a block's hits
are written before the next block is sent, so driver and tasks hold one block whatever the size of the benchmark. Verified windows are merged per
item, so a piece that occurs a thousand times costs one pass over the text.

Defined results: null or empty texts and items match nothing. Repeated items and rows each give their own match; of equally near places the first
counts. Null ids are carried as null. Without items, or with an empty table of documents, nothing is found and every row stays. Texts are searched as a
whole, in one task each. Only the id and text columns are read; other columns, whatever their names, pass through without_leaks() unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import map_texts, materialize, row_key

ERROR_RATE, BLOCK_CHARS = 0.05, 4_000_000
_HIT_TYPE = "array<struct<item:binary,distance:int,start:int,end:int>>"
_HITS = pa.list_(pa.struct([("item", pa.binary()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
_OTHER = re.compile(r"[\W_]+")


def normal(text: object) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if isinstance(text, str) else ""


def budget(length: int, error_rate: float = ERROR_RATE) -> int:
    return int(length * error_rate + 1e-9)


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """(offset, piece) of edits + 1 pieces of nearly equal length."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least edit distance of the item to a substring of text, end of the first such substring)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score < best:
            best, end = score, i + 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return best, end


def masks_of(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | (1 << i)
    return out


class Matcher:
    def __init__(self, items: list[tuple[object, str]], error_rate: float = ERROR_RATE):
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        self.budgets = [budget(len(t), error_rate) for _, t in self.items]
        self.masks: dict[int, dict[str, int]] = {}
        held: dict[str, list[tuple[int, int]]] = {}
        for k, ((_, t), e) in enumerate(zip(self.items, self.budgets, strict=True)):
            for at, piece in pieces(t, e) if e else [(0, f" {t} ")]:
                held.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in held.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if held:
            self.automaton.make_automaton()

    def matches(self, text: object) -> list[tuple[object, int, int, int]]:
        """(item, distance, start, end in the normalised text) of each item found, its best place."""
        body = f" {normal(text)} "
        if not self.items or len(body) < 3:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.automaton.iter(body):
            first = last - size + 1
            for k, at in uses:
                e, m = self.budgets[k], len(self.items[k][1])
                windows.setdefault(k, []).append((max(0, first - at - e), first - at + m + e) if e else (first + 1, first + 1 + m))
        out = []
        for k, spans in sorted(windows.items()):
            item_id, item = self.items[k]
            e, m = self.budgets[k], len(item)
            if not e:
                out.append((item_id, 0, spans[0][0] - 1, spans[0][1] - 1))
                continue
            masks = self.masks.setdefault(k, masks_of(item))
            best: tuple[int, int] | None = None
            for a, b in _merged(spans):
                exact = body.find(item, a, b)
                d, end = (0, exact - a + m) if exact >= 0 else myers(masks, m, body[a:b])
                if d <= e and (best is None or d < best[0]):
                    best = d, a + end
                    if not d:
                        break
            if best:
                out.append((item_id, best[0], max(0, best[1] - m - 1), best[1] - 1))
        return out


def _merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    a, b = None, None
    for x, y in sorted(spans):
        if a is None or x > b:
            if a is not None:
                yield a, b
            a, b = x, y
        else:
            b = max(b, y)
    if a is not None:
        yield a, b


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, *, block_chars: int = BLOCK_CHARS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document and item found in it: doc_id, rk (row key), item_id, distance, start, end."""
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null").withColumn("item", row_key("text"))
    texts = items.select("item", "text").distinct()
    blocks = max(1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars))
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("rk", row_key("doc_id", "text"))
    found: DataFrame | None = None
    for b in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item").collect()
        held = spark.sparkContext.broadcast([(bytes(r["item"]), r["text"]) for r in part])
        hits = map_texts(body, "text", _search(held, error_rate), {"m": (_HIT_TYPE, _HITS)}, drop_text=True).select("doc_id", "rk", F.explode("m").alias("m"))
        hits = hits.select("doc_id", "rk", "m.item", "m.distance", "m.start", "m.end")
        if blocks > 1:
            hits = materialize(hits)
            held.unpersist(blocking=True)  # a lost executor needs the written hits only
        found = hits if found is None else found.unionByName(hits)
    return found.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "distance", "start", "end", "rk")


def _search(items, error_rate: float):
    def make():
        matcher = Matcher(items.value, error_rate)
        names = ("item", "distance", "start", "end")
        return lambda texts: [[[dict(zip(names, m, strict=True)) for m in matcher.matches(t)] for t in texts]]

    return make


def without_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in which no item was found, columns unchanged."""
    leaks = find_leaks(docs, benchmark, error_rate, doc_id=doc_id, text=text).select(F.col("rk").alias("__weft_rk")).distinct()
    keyed = docs.withColumn("__weft_rk", row_key(F.col(doc_id).cast("long"), F.col(text).cast("string")))
    return keyed.join(leaks, "__weft_rk", "left_anti").drop("__weft_rk")
