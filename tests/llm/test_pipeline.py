"""The pipeline, stage by stage, against brute-force versions on a small corpus."""

import pytest
from test_brute import corpus, dedup_lines, linked

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from lacunar.llm import mixing, packing  # noqa: E402
from lacunar.llm.common import materialize  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", s, len(t)) for i, t, s in corpus(n=80)]
    bad = [(1001 + 3 * k, "\n".join(f"W{k}!! {x.upper()}!! STOP!!" for x in t.split("\n")), "en", s, 0) for k, (i, t, s) in enumerate(corpus(5, 30))]
    spark.createDataFrame(rows + bad, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows] + [(r[0], 0, 0) for r in bad], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    got = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, folder))
        got.append(docs)
    assert all(d.columns == columns for d in got[:-1])
    rows = lambda d: sorted((r["doc_id"], r["text"], r["source"]) for r in d.collect())
    kept = rows(got[0])
    assert {i for i, *_ in kept} == {i for i, *_ in corpus(n=80)}  # bad documents go, others stay
    lines = {i: "\n".join(x) for i, x in dedup_lines(kept).items()}
    want = sorted((i, lines[i], s) for i, t, s in kept if lines[i] == t or lines[i].strip())
    assert rows(got[1]) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got[1].collect())
    class_of, _ = linked(want, 5, 80)
    want = [r for r in want if class_of[r[0]] == r[0]]
    assert rows(got[2]) == want
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(want, columns=["doc_id", "text", "source"]))
    copies = {r[0]: r[5] for r in con.sql(mixing.SQL).fetchall()}
    want = sorted(r for r in want for _ in range(copies[r[0]]))
    assert rows(got[3]) == want
    pieces = got[4].toPandas()
    assert pieces[pieces.piece == 0].doc_id.value_counts().to_dict() == {i: c for i, c in copies.items() if c}
    assert pieces.groupby("sequence_id").length.sum().max() <= packing.SIZE
    assert pieces.sequence_id.nunique() == packing.bound(packing.np.bincount(pieces.length, minlength=packing.SIZE + 1))


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
