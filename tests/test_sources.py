import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.graph import Graph
from weftgraph.operators.fixpoint import Query, run_batch
from weftgraph.plans.prefix import dense_ids, running_total
from weftgraph.sources import files, generators
from weftgraph.streaming import serve


def rows(df):
    return sorted((r.src, r.dst, r.weight) for r in df.collect())


def put(tmp_path, name, data):
    p = tmp_path / name
    p.write_bytes(data) if isinstance(data, bytes) else p.write_text(data)
    return str(p)


def test_matrix_market(spark, tmp_path):
    p = put(tmp_path, "w.mm", "%%MatrixMarket matrix coordinate real general\n% c\n4 4 5\n1 2 1\n1 3 4\n2 3 1\n3 4 1\n2 4 5\n")
    e, head = files.read_matrix_market(spark, p)
    assert head["nnz"] == 5 and rows(e) == [(0, 1, 1.0), (0, 2, 4.0), (1, 2, 1.0), (1, 3, 5.0), (2, 3, 1.0)]
    assert {r.vertex: r.value for r in run_batch(files.read_graph(spark, p), [Query(0, "sssp", 0)]).state.collect()} == {0: 0.0, 1: 1.0, 2: 2.0, 3: 3.0}
    s = put(tmp_path, "s.mtx", "%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n2 1\n3 3\n")
    assert rows(files.read_matrix_market(spark, s)[0]) == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0)]
    for bad in ("%%MatrixMarket matrix array real general\n1 1\n1\n", "%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1 1\n", "%%MatrixMarket matrix coordinate real general\n1 1 1\n0 1 1\n", "1 1 1\n"):
        with pytest.raises(ValueError):
            files.read_matrix_market(spark, put(tmp_path, "bad.mtx", bad))
    files.write_matrix_market(e, f"file://{tmp_path}/out", 4)
    assert rows(files.read_matrix_market(spark, f"file://{tmp_path}/out")[0]) == rows(e)


WANT = [(0, 1, 26.0), (0, 3, 33.0), (1, 2, 10.0), (2, 3, 40.0)]


def test_binary_and_text_formats(spark, tmp_path):
    off, dst, w = np.array([0, 2, 3, 4, 4]), np.array([1, 3, 2, 3]), np.array([26, 33, 10, 40])
    csr = np.array([4, 4, 4], "<i4").tobytes() + off.astype("<i4").tobytes() + dst.astype("<i4").tobytes() + w.astype("<f4").tobytes()
    assert rows(files.read_csr_binary(spark, put(tmp_path, "a.csr", csr))) == WANT
    gr = np.array([1, 4, 4, 4], "<u8").tobytes() + off[1:].astype("<i8").tobytes() + dst.astype("<u4").tobytes() + w.astype("<i4").tobytes()
    assert rows(files.read_gr(spark, put(tmp_path, "a.gr", gr))) == WANT
    bw = np.array([4, 4], "<u4").tobytes() + off[:4].astype("<u4").tobytes() + np.stack([dst, w], 1).astype("<u4").tobytes()
    assert rows(files.read_bcsr(spark, put(tmp_path, "a.bwcsr", bw), True)) == WANT
    assert rows(files.read_edge_list(spark, put(tmp_path, "a.wel", "0 1 26\n0 3 33\n2 3 40\n1 2 10\n"), True)) == WANT
    adj = "WeightedAdjacencyGraph\n4\n4\n" + "\n".join(map(str, [*off[:4], *dst, *w])) + "\n"
    assert rows(files.read_adjacency(spark, put(tmp_path, "a.adj", adj))) == WANT
    smtx = files.read_smtx(spark, put(tmp_path, "a.smtx", "4, 4, 4\n0 2 3 4 4\n1 3 2 3\n"))
    assert [(a, b) for a, b, _ in rows(smtx)] == [(a, b) for a, b, _ in WANT] and all(1 <= x[2] <= 10 for x in rows(smtx))
    assert files.read_sources(spark, "0,1, 2") == [0, 1, 2] == files.read_sources(spark, put(tmp_path, "q.txt", "0\n1\n2\n"))


def test_generators(spark):
    assert generators.grid(spark, 3).count() == 24 and generators.grid(spark, 3, 3).count() == 2 * 3 * 18
    e = generators.rmat(spark, 6, 500, seed=2)
    assert e.collect() == generators.rmat(spark, 6, 500, seed=2).collect() and e.where("src < 0 or src > 63 or dst < 0 or dst > 63").isEmpty()
    assert generators.random_local(spark, 50, 3).where("dst < 0 or dst > 49").isEmpty()
    assert generators.rand_graph(spark, 10, 100).count() == 100
    points = spark.createDataFrame([(i, [float(i % 7), float(i // 7)]) for i in range(49)], "id long, vec array<double>")
    got = {(r.src, r.dst): r.dist2 for r in generators.knn_graph(points, 3).collect()}
    assert len(got) == 147 and all((i, i) in got for i in range(49)) and max(got.values()) <= 1.0


def test_running_totals(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"), F.lit(2).alias("v")).repartition(5)
    assert all(r.total == 2 * r.k for r in running_total(df, ["k"], F.col("v")).collect())
    assert {r.key: r.id for r in dense_ids(spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "s string"), "s").collect()} == {"a": 0, "b": 1}


def test_query_stream(spark, tmp_path):
    g = Graph(spark.createDataFrame([(0, 1), (1, 2)], "src long, dst long"))
    spark.createDataFrame([(0, "bfs", 0), (1, "bfs", 1)], "query_id long, kind string, source long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("query_id long, kind string, source long").parquet(f"{tmp_path}/in")
    got = []
    serve(stream, g, lambda df, _: got.extend(df.collect()), f"{tmp_path}/ck", once=True).awaitTermination(120)
    assert {(r.query_id, r.vertex): r.value for r in got} == {(0, 0): 0.0, (0, 1): 1.0, (0, 2): 2.0, (1, 1): 0.0, (1, 2): 1.0}


def test_parts_of_unequal_size_keep_their_order(spark, tmp_path):
    """Spark packs small files before large ones or after; lines count by file name."""
    def parts(name, lines, cuts):
        folder = tmp_path / name
        folder.mkdir()
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(lines)])):
            (folder / f"part-{k:05d}").write_text("".join(f"{x}\n" for x in lines[a:b]))
        return f"file://{folder}"

    n = 400
    ring = {(i, (i + 1) % n) for i in range(n)}
    adjacency = ["AdjacencyGraph", n, n, *range(n), *[(i + 1) % n for i in range(n)]]
    got = files.read_adjacency(spark, parts("a.adj", adjacency, [3, 5, 300, 310, 700])).collect()
    assert {(r.src, r.dst) for r in got} == ring
    market = ["%%MatrixMarket matrix coordinate real general", "% a comment", f"{n} {n} {n}", *[f"{a + 1} {b + 1} 2.5" for a, b in sorted(ring)]]
    e, head = files.read_matrix_market(spark, parts("m.mtx", market, [1, 3, 200, 201, 350]))
    assert {(r.src, r.dst) for r in e.collect()} == ring and (head["rows"], head["nnz"]) == (n, n)
    hyper = ["AdjacencyHypergraph", n, n, 2, n, *range(n), *[i % 2 for i in range(n)], 0, n // 2, *range(0, n, 2), *range(1, n, 2)]
    got = files.read_hypergraph(spark, parts("h.adj", hyper, [2, 9, 500, 505, 900])).collect()
    assert {(r.hyperedge, r.member) for r in got} == {(i % 2, i) for i in range(n)}

