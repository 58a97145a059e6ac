import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arterial.llm import line_dedup, mixing, ngram_join, quality_rules
from arterial.llm.queries import ORACLES, QUERIES

from .cases import SCHEMA, awkward, frame, key, prose
from .test_near_duplicates import brute_components, brute_lines, line_rows
from .test_texts import brute_matches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_duckdb(rows, sql):
    import pyarrow as pa

    table = pa.table({c: pa.array([r[i] for r in rows], pa.int64() if c in ("doc_id", "n_chars") else pa.string()) for i, c in enumerate(COLUMNS)})
    c = duckdb.connect()
    c.register("documents", table)
    found = c.execute(sql)
    names = [d[0] for d in found.description]
    return [dict(zip(names, r, strict=True)) for r in found.fetchall()]


def test_quality_rules_against_sql(spark):
    rows = awkward() + [(399, "few words stand here\n" + "Shared footer line of this host", "en", h, 1) for h in ("s9", "s8", "s8")] + [(300 + i, prose(700 + i, 12, 10**6).translate(str.maketrans("0123456789", "ghijklmnop")) + "\nShared footer line of this host\n" + f"q{i} " * 3, "en", "s9", 1) for i in range(40)]
    limits = quality_rules.Limits(min_words=4, min_line_texts=5)
    got = quality_rules.quality_rules(frame(spark, rows), limits).drop("frequent", "host", "th")
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words"]
    want = in_duckdb(rows, quality_rules.oracle(limits))
    assert sorted((tuple(r[c] for c in got.columns) for r in got.collect()), key=key) == sorted((tuple(r[c] for c in got.columns) for r in want), key=key)
    kept = {r.doc_id: r.text for r in quality_rules.without_frequent_lines(frame(spark, rows), limits).where("source = 's9'").collect()}
    assert kept and all("Shared footer" not in t for t in kept.values())
    assert quality_rules.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mixing_against_sql(spark):
    rows = awkward()
    weights = {"s0": 2.0, "s1": 400.0}
    got = mixing.mix_sources(frame(spark, rows), weights, seed=3)
    want = in_duckdb(rows, mixing.oracle(weights, 3))
    assert sorted((tuple(r[c] for c in got.columns) for r in got.collect()), key=key) == sorted((tuple(r[c] for c in got.columns) for r in want), key=key)
    assert mixing.mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mixing_reaches_the_weights(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "en", "a" if i < 9000 else "b", 100) for i in range(10_000)], SCHEMA)
    n = {r.source: r["count"] for r in mixing.mix_sources(docs, {"a": 1.0, "b": 3.0}).groupBy("source").count().collect()}
    assert n["b"] / n["a"] == pytest.approx(3, rel=0.06) and n["a"] + n["b"] == pytest.approx(10_000, rel=0.05)
    one = mixing.mix_sources(spark.createDataFrame([(1, "x", "en", "a", 1)] + [(i, "y" * 1000, "en", "b", 1) for i in range(2, 12)], SCHEMA), {"a": 1.0, "b": 1.0})
    assert one.where("source = 'a'").count() == pytest.approx(5000, rel=0.06)


def test_stages_against_brute_force(spark, tmp_path):
    rows = awkward() + line_rows() + [(400, "start of it " + " ".join(f"b{i}" for i in range(30)) + " end", "en", "s1", 1)]
    folder = str(tmp_path)
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    items = [(1, " ".join(f"B{i}" for i in range(30)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, folder).write.parquet(f"{folder}/{k}")
        before = [tuple(r) for r in docs.collect()]
        docs = spark.read.parquet(f"{folder}/{k}")
        assert docs.columns == COLUMNS
        seen[name] = before, [tuple(r) for r in docs.collect()]
    before, after = seen["quality rules"]
    verdicts = in_duckdb(before, quality_rules.oracle())
    assert sorted((r[0] for r in after), key=lambda x: (x is None, x)) == sorted((v["doc_id"] for v in verdicts if v["kept"]), key=lambda x: (x is None, x))
    before, after = seen["line dedup"]
    want = [(w[0], w[3]) for w in brute_lines(before, 80) if w[1] == 0 or w[2] < w[1]]
    assert sorted(((r[0], r[1] or "") for r in after), key=key) == sorted(want, key=key)
    before, after = seen["n-gram Jaccard join"]
    assert {r[0] for r in after} == {c for i, n, c in brute_components(before, 5, 80) if n} | {i for i, n, _ in brute_components(before, 5, 80) if not n}
    before, after = seen["benchmark decontamination"]
    leaks = {d for d, _, _ in brute_matches([(r[0], r[1]) for r in before], items)}
    assert leaks == {400} and sorted((r[0] for r in after), key=str) == sorted((r[0] for r in before if r[0] not in leaks), key=str)
    mixed = in_duckdb(after, mixing.oracle())
    assert sorted(((r["doc_id"], r["copy"]) for r in mixed), key=key) == sorted(((r.doc_id, r.copy) for r in corpus_pipeline.run(spark, folder).collect()), key=key)


#: Names that operators use inside, or may.
CLASHES = ["_id", "_th", "_key", "_hash", "_removed", "_n", "_cdf", "_name", "_src", "_parts", "_frequent", "id", "th", "row", "gone", "host", "cls", "root", "copies", "frequent", "kept", "name", "own", "cdf", "n", "g", "hot", "t", "m", "x", "line"]


def test_columns_of_any_name_pass_through(spark):
    rows = awkward() + line_rows()
    plain = frame(spark, rows)
    docs = plain.select("*", *(F.concat_ws("-", F.col("doc_id"), F.lit(c)).alias(c) for c in CLASHES))
    limits = quality_rules.Limits(min_words=4, min_line_texts=3)
    for operator in (lambda d: quality_rules.without_frequent_lines(d, limits), line_dedup.dedup_lines, ngram_join.one_per_component, mixing.mix_sources):
        got, want = operator(docs), operator(plain)
        assert [c for c in got.columns if c not in want.columns] == CLASHES
        found = got.collect()
        assert sorted((tuple(r[c] for c in want.columns) for r in found), key=key) == sorted((tuple(r) for r in want.collect()), key=key)
        assert all(r[c] == ("" if r.doc_id is None else f"{r.doc_id}-") + c for r in found for c in CLASHES)
    assert quality_rules.quality_rules(docs, limits).count() == len(rows)


def test_stages_on_an_empty_table_and_without_n_chars(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (frame(spark, []), frame(spark, []).drop("n_chars"), frame(spark, awkward()).drop("n_chars")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            after = stage(spark, docs, str(tmp_path))
            assert after.columns == docs.columns + (["copy", "order_key"] if k == 4 else [])
            assert (after.count() > 0) == (docs.count() > 0)


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and set(ORACLES) <= set(QUERIES)
