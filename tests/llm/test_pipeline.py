from __future__ import annotations

import corpus_pipeline
from staffloom.llm import simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        docs = out.cache()
        rows.append(docs.count())
    assert rows[0] > rows[1] >= rows[2] > rows[3] == rows[4]
    groups = simhash.near_duplicates(docs).groupBy("component_id").count()
    assert groups.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == rows[4]


def test_near_duplicate_stage_keeps_the_first_of_each_group(spark, docs):
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs.drop("score", "shard").unionByName(docs.drop("score", "shard")), SF).collect()}
    own = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert kept == own


def test_run_ends_in_pieces(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    assert toxicity.MAX_LABELLED == 20_000


def test_entry_works_without_this_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "staffloom", tmp_path / "staffloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) > 90; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
