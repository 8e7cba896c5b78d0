"""Graph files: Matrix Market, SMTX, binary CSR, `.gr`, edge lists, adjacency text, and the matching sinks.

Text formats are read by Spark's text reader, so a large file is split among tasks. Binary formats hold offsets in the header of one
file; they come in through the binaryFile source and are unpacked by numpy, one file to a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.graph import Graph, csr_to_coo
from weftgraph.plans.prefix import running_total

EDGES = "src long, dst long, weight double"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(o, value) of the lines that are not blank; o orders them by file name, then by place in the file.

    Spark packs files and blocks into tasks by size, but reads the lines of a block one after the other, so block starts and row numbers give their order.
    """
    text = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")).alias("o"))
    return text.where("trim(value) <> ''").select("o", F.trim("value").alias("value"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(k, value): the lines numbered over all parts of path."""
    flat = _lines(spark, path).select("value", "o.file_path", "o.file_block_start", "o.row")
    return running_total(flat, ["file_path", "file_block_start", "row"], F.lit(1).cast("long"), "k").select("k", "value")


def read_matrix_market(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """((src, dst, weight) on 0-based ids, header). Pattern entries weigh 1; symmetric files mirror what is off the diagonal."""
    lines = _lines(spark, path)
    comment = F.startswith("value", F.lit("%"))
    head = lines.agg(F.min_by("value", "o").alias("banner"), F.min_by(F.when(~comment, F.col("value")), F.when(~comment, F.col("o"))).alias("size")).first()
    banner = (head.banner or "").lower().split()
    if len(banner) < 5 or banner[0] != "%%matrixmarket" or banner[1] != "matrix":
        raise ValueError("no Matrix Market banner")
    _, _, form, kind, symmetry = banner[:5]
    if form != "coordinate":
        raise ValueError("only coordinate files are supported")
    if kind not in ("real", "integer", "pattern", "double"):
        raise ValueError(f"{kind} values are not supported")
    rows, cols, nnz = (int(x) for x in (head.size or "").split())
    # the size line is the first line that is no comment; entries are the others
    body = lines.where(~comment).select("o", F.split("value", r"\s+").alias("p"))
    first = body.agg(F.min("o").alias("first"))
    body = body.join(F.broadcast(first), F.col("o") > F.col("first"))  # one row
    weight = F.lit(1.0) if kind == "pattern" else F.get("p", F.lit(2)).cast("double")
    e = body.select((F.col("p")[0].cast("long") - 1).alias("src"), (F.col("p")[1].cast("long") - 1).alias("dst"), weight.alias("weight"))
    if not e.where("src < 0 or dst < 0").isEmpty():
        raise ValueError("entries are numbered from 1")
    if symmetry == "symmetric":
        e = e.unionByName(e.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return e, {"rows": rows, "cols": cols, "nnz": nnz, "kind": kind, "symmetry": symmetry}


def write_matrix_market(edges: DataFrame, path: str, n: int) -> None:
    """A folder of parts whose first holds banner and size."""
    body = edges.select(F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, "weight").alias("value"), F.lit(1).alias("o"))
    head = edges.sparkSession.createDataFrame([("%%MatrixMarket matrix coordinate real general", -1), (f"{n} {n} {edges.count()}", 0)], "value string, o int")
    head.unionByName(body).repartitionByRange("o", "value").sortWithinPartitions("o", "value").select("value").write.text(path)


def read_smtx(spark: SparkSession, path: str, seed: int = 0) -> DataFrame:
    """Three lines: sizes, row offsets, column ids. Weights are hashed draws from 1 to 10."""
    lines = _numbered(spark, path)
    size = lines.where("k = 0").first()
    rows, _, nnz = (int(x) for x in size.value.replace(",", " ").split())
    offsets, cols = (lines.where(F.col("k") == k).select(F.posexplode(F.split("value", r"\s+")).alias("position", "x")).selectExpr("bigint(position) as position", "double(x) as x") for k in (1, 2))
    ends = offsets.agg(F.count(F.lit(1)).alias("n"), F.max_by("x", "position").alias("last")).first()
    if ends.n != rows + 1 or cols.count() != nnz or ends.last != nnz:
        raise ValueError("sizes and counts differ")
    e = _from_arrays(offsets, cols, None).select("src", "dst")
    return e.withColumn("weight", (F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(10)) + 1).cast("double"))


def _binary(spark: SparkSession, path: str, unpack: Callable[[bytes], tuple[np.ndarray, np.ndarray, np.ndarray]], step: int = 1 << 20) -> DataFrame:
    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                offsets, dst, weight = unpack(content)
                for a in range(0, len(dst), step):
                    b = min(a + step, len(dst))
                    src = np.searchsorted(offsets, np.arange(a, b), side="right") - 1
                    yield pd.DataFrame({"src": src, "dst": dst[a:b].astype(np.int64), "weight": weight[a:b].astype(np.float64)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(go, EDGES)


def _csr(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, _, nnz = np.frombuffer(content, "<i4", 3)
    offsets = np.frombuffer(content, "<i4", rows + 1, 12)
    cols = np.frombuffer(content, "<i4", nnz, 12 + 4 * (rows + 1))
    return offsets, cols, np.frombuffer(content, "<f4", nnz, 12 + 4 * (rows + 1 + nnz))


def read_csr_binary(spark: SparkSession, path: str) -> DataFrame:
    """rows, cols, nnz, offsets, columns (int32), values (float32), little-endian."""
    return _binary(spark, path, _csr)


def _gr(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    _, sized, n, m = np.frombuffer(content, "<u8", 4)
    n, m = int(n), int(m)
    ends = np.frombuffer(content, "<i8", n, 32)
    dst = np.frombuffer(content, "<u4", m, 32 + 8 * n)
    at = 32 + 8 * n + 4 * (m + m % 2)
    return np.concatenate([[0], ends]), dst, np.frombuffer(content, "<i4", m, at) if sized else np.ones(m)


def read_gr(spark: SparkSession, path: str) -> DataFrame:
    """Galois `.gr`, version 1: header of four u64, row ends, targets, weights of 4 bytes after padding."""
    return _binary(spark, path, _gr)


def _bcsr(weighted: bool):
    def unpack(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, m = (int(x) for x in np.frombuffer(content, "<u4", 2))
        starts = np.frombuffer(content, "<u4", n, 8).astype(np.int64)
        rest = np.frombuffer(content, "<u4", m * (2 if weighted else 1), 8 + 4 * n)
        pairs = rest.reshape(m, -1)
        return np.concatenate([starts, [m]]), pairs[:, 0], pairs[:, 1] if weighted else np.ones(m)

    return unpack


def read_bcsr(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """Vertices, edges, row starts, then targets (or target and weight pairs), all u32."""
    return _binary(spark, path, _bcsr(weighted))


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """Whitespace-separated `src dst [weight]` lines; comments start with # or %."""
    p = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("trim(value) <> '' and not trim(value) rlike '^[#%]'").select(p.alias("p"))
    return lines.select(F.col("p")[0].cast("long").alias("src"), F.col("p")[1].cast("long").alias("dst"), (F.get("p", F.lit(2)).cast("double") if weighted else F.lit(1.0)).alias("weight"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """AdjacencyGraph or WeightedAdjacencyGraph text: n, m, n row starts, m targets[, m weights], one number a line."""
    lines = _numbered(spark, path)
    head = {r.k: r.value for r in lines.where("k < 3").collect()}
    weighted, n, m = head[0] == "WeightedAdjacencyGraph", int(head[1]), int(head[2])
    num = lines.where("k >= 3").select((F.col("k") - 3).alias("k"), F.col("value").cast("double").alias("x"))
    starts = num.where(F.col("k") < n).select(F.col("k").alias("id"), F.col("x").cast("long").alias("offset"))
    nxt = starts.select((F.col("id") - 1).alias("id"), F.col("offset").alias("end"))
    rows = starts.join(nxt, "id", "left").select("id", "offset", (F.coalesce("end", F.lit(m)) - F.col("offset")).alias("degree"))
    slots = csr_to_coo(rows).select(F.col("id").alias("src"), "position")
    dst = num.where((F.col("k") >= n) & (F.col("k") < n + m)).select((F.col("k") - n).alias("position"), F.col("x").cast("long").alias("dst"))
    e = slots.join(dst, "position")
    if weighted:
        e = e.join(num.where(F.col("k") >= n + m).select((F.col("k") - n - m).alias("position"), F.col("x").alias("weight")), "position")
    return e.select("src", "dst", F.col("weight") if weighted else F.lit(1.0).alias("weight"))


def _numbers(spark: SparkSession, path: str, dtype: str, step: int = 1 << 20) -> DataFrame:
    """(position, x) of a file that is one array."""

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                x = np.frombuffer(content, dtype)
                for a in range(0, len(x), step):
                    yield pd.DataFrame({"position": np.arange(a, min(a + step, len(x))), "x": x[a : a + step].astype(np.float64)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(go, "position long, x double")


def _from_arrays(offsets: DataFrame, targets: DataFrame, weights: DataFrame | None) -> DataFrame:
    """Edges of offsets, targets and weights, each as (position, x)."""
    starts = offsets.select(F.col("position").alias("id"), F.col("x").cast("long").alias("offset"))
    ends = starts.select((F.col("id") - 1).alias("id"), F.col("offset").alias("end"))
    slots = csr_to_coo(starts.join(ends, "id").select("id", "offset", (F.col("end") - F.col("offset")).alias("degree"))).select(F.col("id").alias("src"), "position")
    e = slots.join(targets.select("position", F.col("x").cast("long").alias("dst")), "position")
    e = e.withColumn("weight", F.lit(1.0)) if weights is None else e.join(weights.select("position", F.col("x").alias("weight")), "position")
    return e.select("src", "dst", "weight")


def read_csr_folder(spark: SparkSession, path: str, offsets: str = "csr_vlist.bin", targets: str = "csr_elist.bin", weights: str = "csr_weightlist.bin", dtype: str = "<i4") -> DataFrame:
    """A folder of three arrays; without weights they are 1. Sizes that differ raise an error."""
    names = {r.name for r in spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name")).collect()}
    v, e = (_numbers(spark, f"{path}/{name}", dtype) for name in (offsets, targets))
    w = _numbers(spark, f"{path}/{weights}", dtype) if weights in names else None
    ends = v.agg(F.min("x").alias("a"), F.max("x").alias("b"), F.max_by("x", "position").alias("last")).first()
    m = e.count()
    if ends.a != 0 or ends.b != m or ends.last != m or (w is not None and w.count() != m):
        raise ValueError("sizes and counts differ")
    return _from_arrays(v, e, w)


def read_named(spark: SparkSession, name: str, catalog: dict[str, str]) -> Graph:
    """The graph that a catalog {name: path} lists."""
    if name not in catalog:
        raise ValueError(f"no graph named {name!r}; known: {sorted(catalog)}")
    return read_graph(spark, catalog[name])


def read_hypergraph(spark: SparkSession, path: str) -> DataFrame:
    """(hyperedge, member) of AdjacencyHypergraph text: nv, mv, nh, mh, nv row starts, mv hyperedges, nh row starts, mh members.

    The half by vertices alone defines the membership; the half by hyperedges repeats it.
    """
    lines = _numbered(spark, path)
    head = {r.k: r.value for r in lines.where("k < 5").collect()}
    if head.get(0) not in ("AdjacencyHypergraph", "WeightedAdjacencyHypergraph"):
        raise ValueError("no hypergraph header")
    nv, mv = int(head[1]), int(head[2])
    num = lines.where("k >= 5").select((F.col("k") - 5).alias("position"), F.col("value").cast("double").alias("x"))
    starts = num.where(F.col("position") < nv).unionByName(spark.createDataFrame([(nv, float(mv))], "position long, x double"))
    found = _from_arrays(starts, num.where((F.col("position") >= nv) & (F.col("position") < nv + mv)).select((F.col("position") - nv).alias("position"), "x"), None)
    return found.select(F.col("dst").alias("hyperedge"), F.col("src").alias("member"))


def write_adjacency(graph: Graph, path: str, weighted: bool = False) -> None:
    """AdjacencyGraph (or weighted) text for vertices 0 .. n - 1, in order over the part files."""
    spark = graph.edges.sparkSession
    top = graph.vertices.agg(F.max("id")).first()[0]
    n = 0 if top is None else top + 1
    m = graph.edges.count()
    full = Graph(graph.edges, spark.range(n))
    e = running_total(graph.edges, ["src", "dst", "weight"], F.lit(1).cast("long"), "k")
    parts = [
        spark.createDataFrame([(0, "WeightedAdjacencyGraph" if weighted else "AdjacencyGraph"), (1, str(n)), (2, str(m))], "at long, value string"),
        full.csr_offsets().select((F.col("id") + 3).alias("at"), F.col("offset").cast("string").alias("value")),
        e.select((F.col("k") + 3 + n).alias("at"), F.col("dst").cast("string").alias("value")),
    ]
    if weighted:
        whole = F.col("weight") == F.floor("weight")
        parts.append(e.select((F.col("k") + 3 + n + m).alias("at"), F.when(whole, F.col("weight").cast("long").cast("string")).otherwise(F.col("weight").cast("string")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out.repartitionByRange("at").sortWithinPartitions("at").select("value").write.text(path)


def write_metrics(spark: SparkSession, runs: list[float], path: str, sources: list[int] | None = None, tags: list[str] | None = None, **info: str) -> None:
    """One JSON row: run times in ms with their mean, deviation, minimum and maximum, the sources, tags and the system."""
    x = np.array(runs, float)
    stats = (float(x.mean()), float(x.std()), float(x.min()), float(x.max())) if len(x) else (None,) * 4
    system = {"spark": spark.version, "master": spark.sparkContext.master, "parallelism": str(spark.sparkContext.defaultParallelism)} | info
    row = ([float(r) for r in runs], *stats, list(sources or []), list(tags or []), system)
    schema = "run_ms array<double>, mean_ms double, deviation_ms double, min_ms double, max_ms double, sources array<long>, tags array<string>, system map<string,string>"
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(path)


def read_sources(spark: SparkSession, text: str) -> list[int]:
    """Query sources from `0,1,2`, or from a file with one id a line."""
    if all(x.strip().lstrip("-").isdigit() for x in text.split(",")):
        return [int(x) for x in text.split(",")]
    return [int(r.value) for r in spark.read.text(text).where("trim(value) <> ''").collect()]


READERS = {".mtx": lambda s, p: read_matrix_market(s, p)[0], ".mm": lambda s, p: read_matrix_market(s, p)[0], ".smtx": read_smtx, ".csr": read_csr_binary, ".gr": read_gr, ".bcsr": read_bcsr,
    ".bwcsr": lambda s, p: read_bcsr(s, p, True), ".el": read_edge_list, ".wel": lambda s, p: read_edge_list(s, p, True), ".adj": read_adjacency, ".parquet": lambda s, p: s.read.parquet(p)}


def read_graph(spark: SparkSession, path: str) -> Graph:
    """The reader is chosen by the suffix; a path that ends in / without one is a folder of arrays."""
    for suffix, read in READERS.items():
        if path.rstrip("/").endswith(suffix):
            return Graph(read(spark, path))
    if path.endswith("/"):  # a folder
        return Graph(read_csr_folder(spark, path.rstrip("/")))
    raise ValueError(f"no reader for {path}")


def save_graphs(edges: DataFrame, path: str) -> None:
    """(graph_id, src, dst, ...) as Parquet, one folder for each graph."""
    edges.write.partitionBy("graph_id").parquet(path)


def write_values(values: DataFrame, path: str) -> None:
    """`vertex value` text lines."""
    values.select(F.concat_ws(" ", *values.columns).alias("value")).write.text(path)


def matrix_market_graph(spark: SparkSession, path: str) -> Graph:
    """The graph of a Matrix Market file on vertices 0 .. max(rows, cols) - 1, edges sorted by source and target."""
    e, head = read_matrix_market(spark, path)
    return Graph(e.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst"), spark.range(max(head["rows"], head["cols"])))


def write_csr(graph: Graph, path: str) -> None:
    """Compressed rows as two Parquet folders: offsets (position, x), one more than vertices 0 .. n - 1, and edges (position, dst, weight)."""
    spark = graph.edges.sparkSession
    top, m = graph.vertices.agg(F.max("id")).first()[0], graph.edges.count()
    full = Graph(graph.edges, spark.range(0 if top is None else top + 1))
    offsets = full.csr_offsets().select(F.col("id").alias("position"), F.col("offset").cast("double").alias("x"))
    end = spark.range(1).select(F.lit(0 if top is None else top + 1).cast("long").alias("position"), F.lit(float(m)).alias("x"))
    offsets.unionByName(end).write.parquet(f"{path}/offsets")
    e = running_total(graph.edges, ["src", "dst", "weight"], F.lit(1).cast("long"), "position")
    e.select("position", "dst", "weight").write.parquet(f"{path}/edges")


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """Edges that write_csr() wrote."""
    e = spark.read.parquet(f"{path}/edges")
    column = lambda c: e.select("position", F.col(c).cast("double").alias("x"))
    return _from_arrays(spark.read.parquet(f"{path}/offsets"), column("dst"), column("weight"))


def load_graphs(spark: SparkSession, path: str, graph_ids: list[int] | None = None) -> DataFrame:
    """What save_graphs() wrote; with graph_ids only their folders are read."""
    e = spark.read.parquet(path)
    return e if graph_ids is None else e.where(F.col("graph_id").isin(graph_ids))
