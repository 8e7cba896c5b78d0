"""Near-duplicate detection with b-bit MinHash.

Texts with equal shingle sets fall into one class first. Each class gets `perms` minima; groups of `rows` full minima
give the band keys that propose candidates, and the low `bits` bits of every minimum, packed in bit planes, give an
estimate of the similarity that is corrected for chance agreement. Candidates whose estimate lies within
`sigmas` standard deviations of the threshold are confirmed on the full sets.

Components need not see every pair. Round 1 verifies a maximum spanning forest of each bucket (by estimate), which is
at most one pair for each row of the bucket; buckets of more than `block` rows are split in blocks, a forest for each. Round 2 does the same with one
class of every component for each bucket that still holds several: the blocks of a large group of copies meet there as a handful of rows. Round 3
verifies every remaining candidate pair between *different* components, over all pairs of blocks, so no link between different texts is lost, and a task
never holds more than two blocks. After round 2 a bucket is mixed only if texts that are not alike share it.

Defined results: null or empty text, or text without a word: no shingles, linked with nothing, its own component.
Fewer words than `n`: the whole sequence is the only shingle. Repeated rows: one class. Null ids: allowed, sort last;
a component of null ids only has a null id. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import U64, map_texts, materialize, mix64, random64, release, row_key, word_hashes
from weftgraph.operators.components import connected_components

PERMS, BITS, BANDS, ROWS, SIGMAS, BLOCK = 512, 4, 36, 5, 4.5, 512


def shingle_sets(texts: list, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's n-word shingles."""
    words, offsets = word_hashes(texts)
    weights = random64(n, 77) | U64(1)
    total = len(words)
    full = np.zeros(max(0, total - n + 1), U64)
    for j in range(n if len(full) else 0):
        full += words[j : j + len(full)] * weights[j]
    full = mix64(full)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(full[a : b - n + 1]))
        elif b > a:
            out.append(mix64(np.array([(words[a:b] * weights[: b - a]).sum()], U64) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return out


def minima(sets: list[np.ndarray], perms: int) -> np.ndarray:
    """(set, permutation) -> smallest permuted hash; every set has a member."""
    mult, flip = random64(perms, 5) | U64(1), random64(perms, 6)
    out = np.empty((len(sets), perms), U64)
    i = 0
    while i < len(sets):
        j, held = i, 0
        while j < len(sets) and (held == 0 or held + len(sets[j]) <= 65536):
            held += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets[i:j]])[:-1]])
        for p in range(perms):
            out[i:j, p] = np.minimum.reduceat((flat ^ flip[p]) * mult[p], at)
        i = j
    return out


def pack(mins: np.ndarray, bits: int) -> np.ndarray:
    """(set, bits * perms/64) words: bit plane after bit plane of the low bits of the mixed minima."""
    low = mix64(mins)
    planes = [np.packbits(((low >> U64(b)) & U64(1)).astype(np.uint8), axis=1).view(U64) for b in range(bits)]
    return np.concatenate(planes, axis=1)


def estimate(one: np.ndarray, others: np.ndarray, bits: int) -> np.ndarray:
    """Similarity from packed signatures: share of agreeing positions, corrected for agreement by chance (2^-bits)."""
    differ = others ^ one
    words = differ.shape[1] // bits
    any_bit = differ[:, :words].copy()
    for b in range(1, bits):
        any_bit |= differ[:, b * words : (b + 1) * words]
    perms = words * 64
    same = 1.0 - np.bitwise_count(any_bit).sum(axis=1) / perms
    chance = 2.0**-bits
    return (same - chance) / (1.0 - chance)


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    keys = np.tile(np.arange(1, bands + 1, dtype=U64), (len(mins), 1))
    for r in range(rows):
        keys = mix64(keys ^ mins[:, r : bands * rows : rows])
    return keys


def cut_of(threshold: float, perms: int, bits: int, sigmas: float) -> float:
    """Estimates below this mean a similarity below the threshold, but for a chance of `sigmas` deviations."""
    chance = 2.0**-bits
    p = chance + (1 - chance) * threshold
    return threshold - sigmas * math.sqrt(p * (1 - p) / perms) / (1 - chance)


def _signatures(n: int, perms: int, bits: int, bands: int, rows: int):
    def go(texts: list) -> list:
        sets = shingle_sets(texts, n)
        full = [i for i, s in enumerate(sets) if len(s)]
        node, sig, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
        if full:
            mins = minima([sets[i] for i in full], perms)
            packed, bk = pack(mins, bits), band_keys(mins, bands, rows)
            for r, i in enumerate(full):
                s = sets[i]
                node[i] = s.sum().tobytes() + np.bitwise_xor.reduce(mix64(s ^ U64(len(s)))).tobytes()
                sig[i], keys[i] = packed[r].tobytes(), bk[r].tobytes()
        return [[len(s) for s in sets], node, sig, keys]

    return lambda: go


_SIGNATURE = {"n_shingles": ("long", pa.int64()), "node": ("binary", pa.binary()), "sig": ("binary", pa.binary()), "keys": ("binary", pa.binary())}


def _set_rows(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k in range(0, len(pdf), 512):
                part = pdf.iloc[k : k + 512]
                sets = shingle_sets(part["text"].tolist(), n)
                yield pd.DataFrame({"node": part["node"], "shingles": [s.view(np.int64) for s in sets]})

    return run


def _unzip_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            keys = [np.frombuffer(k, np.int64) for k in pdf["keys"]]
            yield pd.DataFrame({"key": np.concatenate(keys), "node": np.repeat(pdf["node"].to_numpy(), [len(k) for k in keys])})


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a sorted partition; only the last group of a batch is held for the next."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pd.concat([*held, pdf], ignore_index=True) if held else pdf
        change = np.zeros(len(pdf), bool)
        for c in by:
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        at = np.concatenate([[0], np.flatnonzero(change), [len(pdf)]])
        held = [pdf.iloc[at[-2] :]]
        if at[-2]:
            yield from (pdf.iloc[a:b] for a, b in zip(at[:-2], at[1:-1], strict=True) if b - a > 1)
    yield from (h for h in held if len(h) > 1)


def _forest(bits: int, cut: float):
    """Prim's algorithm by estimate inside each group: at most one pair for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a_out: list[bytes] = []
        b_out: list[bytes] = []
        for g in _groups(batches, ["key", "block"]):
            nodes = g["node"].to_numpy()
            sig = np.frombuffer(b"".join(g["sig"]), U64).reshape(len(g), -1)
            best, parent = np.full(len(g), -1.0), np.zeros(len(g), np.int64)
            left = np.ones(len(g), bool)
            i = 0
            left[0] = False
            for _ in range(len(g) - 1):
                e = estimate(sig[i], sig, bits)
                closer = left & (e > best)
                best[closer], parent[closer] = e[closer], i
                i = int(np.argmax(np.where(left, best, -2.0)))
                left[i] = False
                if best[i] >= cut:
                    a_out.append(min(nodes[i], nodes[parent[i]]))
                    b_out.append(max(nodes[i], nodes[parent[i]]))
            if len(a_out) > 4096:
                yield pd.DataFrame({"a": a_out, "b": b_out})
                a_out, b_out = [], []
        yield pd.DataFrame({"a": a_out, "b": b_out})

    return run


def _crossing(bits: int, cut: float):
    """Every pair of a group in different components whose estimate passes, in the first band that the two share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, ["key", "block", "other"]):
            nodes, comp = g["node"].to_numpy(), pd.factorize(g["component"])[0]
            if comp.max() == 0:
                continue
            sig = np.frombuffer(b"".join(g["sig"]), U64).reshape(len(g), -1)
            keys = np.frombuffer(b"".join(g["keys"]), np.int64).reshape(len(g), -1)
            band = int(np.flatnonzero(keys[0] == g["key"].iloc[0])[0])
            same_block = g["block"].iloc[0] == g["other"].iloc[0]
            own = g["own"].to_numpy()
            a_out, b_out = [], []
            for i in range(len(g) - 1):
                j = np.arange(i + 1, len(g))
                j = j[comp[j] != comp[i]] if same_block else j[(comp[j] != comp[i]) & (own[j] != own[i])]
                j = j[estimate(sig[i], sig[j], bits) >= cut] if len(j) else j
                j = j[(keys[j] == keys[i]).argmax(axis=1) == band] if len(j) else j
                for x in nodes[j]:
                    a_out.append(min(nodes[i], x))
                    b_out.append(max(nodes[i], x))
            if a_out:
                yield pd.DataFrame({"a": a_out, "b": b_out})

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose full sets reach num/den, compared in whole numbers."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.distinct().join(left, "a").join(right, "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.where(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).select("a", "b")


def near_duplicates(
    docs: DataFrame, num: int = 80, den: int = 100, n: int = 5, *, doc_id: str = "doc_id", text: str = "text",
    perms: int = PERMS, bits: int = BITS, bands: int = BANDS, rows: int = ROWS, sigmas: float = SIGMAS, block: int = BLOCK,
) -> DataFrame:
    """One row per row of docs: doc_id, rk (row key), n_shingles, component, component_id.

    Links have |A & B| / |A | B| >= num/den on sets of distinct n-word shingles; component_id is the smallest doc_id
    that links reach.
    """
    if perms % 64 or bands * rows > perms:
        raise ValueError("perms must be a multiple of 64 and at least bands * rows")
    cut = cut_of(num / den, perms, bits, sigmas)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("rk", row_key("doc_id", "text"))
    rows_ = materialize(map_texts(source, "text", _signatures(n, perms, bits, bands, rows), _SIGNATURE, drop_text=True))
    filled = rows_.where("node is not null")
    # one row per class of equal sets; rk finds a text of the class again
    classes = materialize(filled.groupBy("node").agg(F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.min("doc_id").alias("doc_id"), F.min("rk").alias("rk")))
    banded = classes.select("keys", "node").mapInPandas(_unzip_keys, "key long, node binary")
    counts = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    near = materialize(banded.join(counts, "key"))
    # the full sets of every class that shares a band with another, from one text of the class
    wanted = classes.join(near.select("node").distinct(), "node", "left_semi").select("rk", "node")
    texts = source.select("rk", "text").join(wanted, "rk").select("node", "text")
    sets = materialize(texts.mapInPandas(_set_rows(n), "node binary, shingles array<bigint>").dropDuplicates(["node"]))

    own = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block)).cast("int")
    signed = classes.select("node", "sig")

    def forest(rows: DataFrame) -> DataFrame:
        """Confirmed links of the spanning forests of rows (key, size, node)."""
        payload = rows.select("key", "node", own.alias("block")).join(signed, "node")
        pairs = payload.repartition("key", "block").sortWithinPartitions("key", "block", "node").mapInPandas(_forest(bits, cut), "a binary, b binary")
        return materialize(_confirmed(pairs, sets, num, den))

    links = forest(near)
    comps = materialize(connected_components(links, "a", "b"))
    labelled = _labelled(near, comps)
    # one class of each component stands for it in a bucket
    agents = labelled.groupBy("key", "component").agg(F.min("node").alias("node"), F.max("size").alias("classes"))
    sizes = agents.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.max("classes").alias("classes")).where("size > 1")
    agents = materialize(agents.drop("classes").join(sizes, "key").select("key", "size", "node", "classes"))
    more = forest(agents)
    comps = _merged(comps, more)

    # rows meet their key's facts by key and block, so that a hot key is spread over as many tasks as it has blocks
    def in_blocks(keys: DataFrame) -> DataFrame:
        """keys (key, size): one row for each block of a key."""
        return keys.select("key", F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / block).cast("int") - 1)).alias("own"))

    spread = near.withColumn("own", own)
    open_ = agents.groupBy("key").agg(F.max("classes").alias("size"))
    labelled = _labelled(spread.join(in_blocks(open_), ["key", "own"], "left_semi"), comps)
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("size").alias("size")).where("lo <> hi").select("key", "size")
    blocks = F.ceil(F.col("size") / block).cast("int")
    facing = F.explode(F.sequence(F.lit(0), blocks - 1))
    wide = labelled.join(in_blocks(mixed), ["key", "own"], "left_semi").select("key", "node", "component", "own", facing.alias("face"))
    wide = wide.select("key", "node", "component", "own", F.least("own", "face").alias("block"), F.greatest("own", "face").alias("other"))
    wide = wide.join(classes.select("node", "sig", "keys"), "node")
    third = wide.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other", "node").mapInPandas(_crossing(bits, cut), "a binary, b binary")
    rest = materialize(_confirmed(third, sets, num, den))
    comps = _merged(comps, rest)

    of_class = classes.select("node", "doc_id").join(comps.withColumnRenamed("vertex", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = of_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = of_class.join(smallest, "component").select("node", "component", "component_id")
    result = filled.select("doc_id", "rk", "n_shingles", "node").join(final, "node").select("doc_id", "rk", "n_shingles", "component", "component_id")
    alone = rows_.where("node is null").select("doc_id", "rk", "n_shingles", F.col("rk").alias("component"), F.col("doc_id").alias("component_id"))
    out = materialize(result.unionByName(alone))
    release(near, sets, links, more, rest, agents, comps, classes, rows_)
    return out


def _labelled(near: DataFrame, comps: DataFrame) -> DataFrame:
    return near.join(comps.withColumnRenamed("vertex", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))


def _merged(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (vertex, component) with the components that links (a, b) touch joined; a component is named by its smallest class."""
    if links.isEmpty():
        return comps
    name = comps.withColumnRenamed("vertex", "a").withColumnRenamed("component", "ca")
    other = comps.withColumnRenamed("vertex", "b").withColumnRenamed("component", "cb")
    lifted = links.join(name, "a", "left").join(other, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    found = connected_components(lifted, "a", "b")
    upper = found.select(F.col("vertex").alias("component"), F.col("component").alias("top"))
    base = comps.unionByName(lifted.select(F.explode(F.array("a", "b")).alias("vertex")).withColumn("component", F.col("vertex"))).distinct()
    out = materialize(base.join(upper, "component", "left").select("vertex", F.coalesce("top", "component").alias("component")))
    release(found, comps)
    return out


def keep_one(docs: DataFrame, num: int = 80, den: int = 100, n: int = 5, *, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The rows of docs, columns unchanged, with one row of each component: the smallest id, null last.

    Of rows with the same id and text, the one whose other columns come first as text stays. Rows without shingles all stay, but for such repeats.
    """
    found = near_duplicates(docs, num, den, n, doc_id=doc_id, text=text, **options)
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("first"))
    key = "__weft_rk"
    chosen = first.select(F.col("first.rk").alias(key)).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(row_key(F.col(doc_id).cast("long"), F.col(text).cast("string")).alias(key), F.struct(*names).alias("__weft_row"), row_key(*names).alias("__weft_all"))
    kept = keyed.join(chosen, key, "left_semi").groupBy(key).agg(F.min_by("__weft_row", "__weft_all").alias("__weft_row"))
    return kept.select(*[F.col("__weft_row").getField(c).alias(c) for c in docs.columns])
