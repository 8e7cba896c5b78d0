"""Shared pieces of the text operators: batch tokenising in numpy, row keys, the shared scratch folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.scratch import drop_dir, materialize, release, shared_dir  # noqa: F401

U64 = np.uint64
#: The word pattern of all contracts: runs of bytes that are neither a space nor 0x09-0x0D.
WORD_RE = r"[^\x20\x09-\x0D]+"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over uint64 arrays."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random words; longer tables extend shorter ones."""
    return mix64(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE_VALUE = random64(256, 11)


def encode(text: object) -> bytes:
    """UTF-8 of a text; a null is empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def word_hashes(texts: Iterable[object], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word over all texts in order, offsets: text i has words offsets[i]:offsets[i+1])."""
    raw = [encode(t) for t in texts]
    buf = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends_of_text = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    if lower:
        buf = _LOWER[buf]
    space = _IS_SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.concatenate([np.zeros(1, edge.dtype), edge])
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate([np.zeros(1, np.int64), np.searchsorted(starts, ends_of_text)])
    if not len(starts):
        return np.zeros(0, U64), offsets
    lens = ends - starts
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)[:-1]])
    pos = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(at, lens)
    value = _BYTE_VALUE[buf[~space]] * (random64(int(lens.max()), 23) | U64(1))[pos]
    return mix64(np.add.reduceat(value, at) + lens.astype(U64) * U64(0x9E3779B97F4A7C15)), offsets


def row_key(*cols: str | Column) -> Column:
    """A 128-bit key of the row's columns: equal rows share it. Null and empty differ."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("-")) for c in cols]
    return F.unhex(F.md5(F.concat_ws("\x01", *parts)))


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True for rows of fold 0: crc32 of the id as text, modulo folds. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds == 0


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list], list]], new: dict[str, tuple[str, object]], *, drop_text: bool = False, rows: int = 512) -> DataFrame:
    """df with new columns computed from one column of texts, `rows` rows at a time, by Arrow batches.

    make() runs once for each task and returns a function from a list of texts (None for null) to one list for each new
    column. All other columns pass through untouched; existing columns of the new names are replaced. new: name -> (Spark
    type, Arrow type); `text` itself may be one of the names.
    """
    names = [c for c in df.columns if (c not in new or c == text) and not (drop_text and c == text)]
    source = df.select(*[F.col(f"`{c}`") for c in names if c != text], F.col(f"`{text}`").cast("string").alias("__weft_text"))
    fields = []
    for c in names:
        fields.append((c, new[c][0] if c in new else "string" if c == text else df.schema[c].dataType.simpleString()))
    fields += [(c, t) for c, (t, _) in new.items() if c not in names]
    order = [c for c, _ in fields]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for whole in batches:
            for k in range(0, whole.num_rows, rows):
                batch = whole.slice(k, rows)
                texts = batch.column("__weft_text")
                made = dict(zip(new, fn(texts.to_pylist()), strict=True))
                arrays = [pa.array(made[c], new[c][1]) if c in made else texts if c == text else batch.column(c) for c in order]
                yield pa.RecordBatch.from_arrays(arrays, names=order)

    return source.mapInArrow(go, ", ".join(f"`{c}` {t}" for c, t in fields))
