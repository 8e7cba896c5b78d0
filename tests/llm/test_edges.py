"""Every operator on odd rows, empty tables and tables with clashing columns."""

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import decontam, html, langid, minhash, mixing, nbsvm, pii, rules, sentences, warc


def labels(spark, rows=((1, 1, 0), (6, 1, 0), (7, 0, 0), (10, 0, 0), (None, 1, 1), (3, None, 0), (7, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def bench(spark, rows=((1, None), (2, ""), (None, "some item text that is long enough to be split in many pieces"), (4, "short one"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def run_nbsvm(spark, df):
    model, ratios = nbsvm.fit(df, labels(spark))
    return nbsvm.score(df, model, ratios)


OPS = {
    "sentences": lambda spark, df: sentences.dedup_spans(df),
    "nbsvm": run_nbsvm,
    "rules": lambda spark, df: rules.quality(df),
    "leaks": lambda spark, df: decontam.find_leaks(df, bench(spark)),
    "without_leaks": lambda spark, df: decontam.without_leaks(df, bench(spark)),
    "plan": lambda spark, df: mixing.plan(df),
    "curriculum": lambda spark, df: mixing.curriculum(mixing.plan(df)),
    "minhash": lambda spark, df: minhash.near_duplicates(df),
    "keep_one": lambda spark, df: minhash.keep_one(df),
    "pii": lambda spark, df: pii.pseudonymize(df, b"key"),
    "langid": lambda spark, df: langid.predict(df, langid.fit(df)),
}


@pytest.mark.parametrize("name", OPS)
@pytest.mark.parametrize("table", ["odd", "empty", "clashing"])
def test_runs(spark, request, name, table):
    df = request.getfixturevalue(table)
    n, rows = df.count(), OPS[name](spark, df).collect()
    if name in ("sentences", "nbsvm", "rules", "plan", "minhash", "pii", "langid"):
        assert len(rows) == n
    if table == "empty":
        assert not rows


def test_text_columns_survive(spark, odd):
    for name in ("sentences", "nbsvm", "rules", "plan", "pii", "langid", "keep_one", "without_leaks"):
        out = OPS[name](spark, odd)
        assert set(odd.columns) <= set(out.columns), name
        before = {(r.doc_id, r.text) for r in odd.collect()}
        if name not in ("sentences", "pii"):
            assert {(r.doc_id, r.text) for r in out.collect()} <= before, name


def test_minhash_defined_results(spark, odd):
    rows = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(odd).collect()}
    assert rows[(3, 0)].component_id == 3 and rows[(4, 0)].component_id == 4 and rows[(5, 0)].component_id == 5
    assert rows[(7, 1)].component_id == 7
    assert {r.component_id for k, r in rows.items() if k[0] in (1, 2, 8)} == {1}
    kept = minhash.keep_one(odd).collect()
    assert sum(r.doc_id in (1, 2, 8) for r in kept) == 1 and sum(r.doc_id == 7 for r in kept) == 2


def test_sentences_defined_results(spark, odd):
    rows = sentences.dedup_spans(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.n_removed for r in by[1]] == [0, 0] and by[2][0].text == "" and by[3][0].text is None
    assert by[4][0].text == "" and by[5][0].n_sentences == 0


def test_labels_without_a_class(spark, odd):
    model, ratios = nbsvm.fit(odd, labels(spark, [(1, 1, 0), (2, 1, 0)]))
    assert {round(r.score, 3) for r in nbsvm.score(odd, model, ratios).collect()} == {1.0}
    model, ratios = nbsvm.fit(odd, labels(spark, []))
    assert {r.score for r in nbsvm.score(odd, model, ratios).collect()} == {0.5}


def test_pages(spark, tmp_path):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>x"), (3, "a b\nc", "<p>" + "y" * 2000), (4, "u", "<p>" + "y" * 2000), (4, "u", "<p>" + "y" * 2000), (5, "u", "<" * 500 + "<p title='")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("old")).withColumn("digest", F.lit("x"))
    out = html.extract(pages).collect()
    assert len(out) == len(rows) and all(r.text is not None for r in out)
    assert html.extract(pages.limit(0)).count() == 0
    for k, df in enumerate((pages, pages.limit(0))):
        path = f"file://{tmp_path}/w{k}"
        warc.write_archives(df, path)
        got = warc.assemble(warc.read_archives(spark, path)).collect()
        assert len(got) == df.count()
        if not k:
            assert sorted(r.capture.record_type for r in got).count("revisit") == 1
            assert {(r.info.page_id, r.info.url) for r in got} == {(a, b) for a, b, _ in rows}


def test_large_ids_beside_null_ids(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(big, "one two three", "a"), (None, "four", "a")], "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    for name in ("sentences", "nbsvm", "rules", "plan", "pii", "langid", "minhash"):
        assert {r.doc_id for r in OPS[name](spark, df).collect()} == {big, None}, name
