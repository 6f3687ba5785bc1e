"""The pipeline against a plain run of its stages."""

import re

import corpus_pipeline
from stratum.llm import linededup, pieces

from . import helpers as H

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "language_id":
            assert after == {i: t for i, t in before.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "line_dedup":
            assert set(after) == set(before) and after == {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect()}
        elif name == "simhash_dedup":
            prints = {i: [H.simhash(t, 5, n) for n in range(3)] for i, t in before.items()}
            ids = sorted(prints)
            near = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if any((p ^ q).bit_count() <= 7 for p, q in zip(prints[a], prints[b], strict=True))]
            groups = H.groups(ids, [(a, b) for a, b in near if H.jaccard(before[a], before[b]) >= 0.8])
            assert set(after) == set(groups.values())
        else:
            assert set(after) == {i for i, v in H.contamination(before.items(), bench).items() if not v[1]}
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in last} == set(after) and all(r["exact"] for r in last)
    own = pieces.vocabulary(pieces.default_path(), pieces.ALPHA)
    assert all(own.decode(r["ids"]) == after[r["doc_id"]].replace(pieces.BLANK, " ") for r in last)


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    from .test_operators import ODD, odd

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    odd(spark).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/odd/benchmark.parquet")
    rows = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in rows} <= {i for i, _ in ODD} and all(r["exact"] for r in rows) and len(rows) > 5
