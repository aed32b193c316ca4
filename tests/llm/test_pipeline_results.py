"""Results of the pipeline live as long as they are wanted; odd rows and empty tables pass all stages."""

from __future__ import annotations

import os

import corpus_pipeline
from pointlake.llm import shared

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def some(n):
    return [(i, f"text number {i} speaks of {i * 7} things and of {i * 11} more\nline {i} ends it", "en", f"s{i % 2}", 60) for i in range(n)]


def there(path):
    return os.path.isdir(shared.local_path(path))


def test_two_runs_are_both_read_afterwards(spark, tmp_path):
    a, b = (tables(spark, str(tmp_path / n), some(k)) for n, k in (("a", 30), ("b", 50)))
    first = corpus_pipeline.run(spark, a)
    n = first.count()
    second = corpus_pipeline.run(spark, b)
    m = second.count()
    needed = shared.read_by(first)
    assert needed and all(map(there, needed)) and not needed & shared.read_by(second)
    assert first.count() == n and second.count() == m and n > 0 < m
    shared.free(first)
    assert not any(map(there, needed)) and second.count() == m
    shared.free(second)


def test_a_run_leaves_only_what_its_result_reads(spark, tmp_path):
    before = shared.live()
    out = corpus_pipeline.run(spark, tables(spark, str(tmp_path / "a"), some(30)))
    assert shared.live() - before == shared.read_by(out)
    shared.free(out)
    assert shared.live() == before


def test_a_stage_does_not_touch_the_result_of_another(spark, tmp_path):
    folder = tables(spark, str(tmp_path / "a"), some(30))
    docs, stages = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus_pipeline.STAGES)
    made = {name: f(spark, docs, folder) for name, f in stages.items()}
    counts = {name: df.count() for name, df in made.items()}
    for f in stages.values():
        f(spark, docs, folder)
    assert {name: df.count() for name, df in made.items()} == counts
    assert all(there(p) for df in made.values() for p in shared.read_by(df))


def test_odd_rows_and_an_empty_table(spark, tmp_path):
    same = "one and the same text that is long enough to be found again and again"
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \n", None, None, None), (4, same, "en", "s", 9), (4, same, "en", "s", 9), (5, same, "de", "t", 9), (6, "word " * 30_000, "en", "t", 9)]
    out = corpus_pipeline.run(spark, tables(spark, str(tmp_path / "odd"), rows))
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert {c for c in out.columns} >= {"doc_id", "source"} and 5 not in ids and ids <= {None, 1, 2, 3, 4, 6}
    none = corpus_pipeline.run(spark, tables(spark, str(tmp_path / "none"), []))
    assert none.count() == 0 and none.columns == out.columns
