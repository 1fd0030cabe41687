"""Each stage of the pipeline on its own input, by brute force."""

import re
from pathlib import Path

import corpus_pipeline
from test_llm_native import brute_components, cut_lines
from test_llm_python import base_spans
from vectide.llm import quality_rules


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns, inputs = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, inputs[-1], "/root/testdata/sf0.001").write.parquet(str(tmp_path / str(k)))
        inputs.append(spark.read.parquet(str(tmp_path / str(k))))
    assert all(d.columns == columns for d in inputs[:5])
    texts = [{r["doc_id"]: r["text"] for r in d.collect()} for d in inputs[:5]]
    kept = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    assert texts[1] == {i: t for i, t in texts[0].items() if i in kept}
    assert texts[2] == {i: t for i, (t, _, _) in cut_lines({i: t.split("\n") for i, t in texts[1].items()}).items()}
    groups = brute_components(texts[2].items(), 5, 80)
    assert texts[3] == {i: t for i, t in texts[2].items() if groups[i][1] == i}
    assert texts[4].keys() == texts[3].keys()
    for i, t in texts[4].items():
        assert not base_spans(t) and (t == texts[3][i] or base_spans(texts[3][i]))
    assert {r["doc_id"] for r in inputs[5].collect()} == texts[4].keys()
    assert all(r["n_chars"] == len(r["text"]) for r in inputs[4].collect())


def test_hard_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(f"word{k}" for k in range(120))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, prose, "en", "s", 9), (3, prose, "en", "s", 9), (3, prose, "en", "s", 9), (4, prose + " more", None, "s", 9)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "")
        assert stage(spark, docs.where("false"), "").count() == 0
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["3", "None"]
    assert corpus_pipeline.STAGES[4][1](spark, docs, "").count() == 2


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for p in (root / "vectide").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
