"""The pipeline's stages on a small table, each against what its operator says."""

from collections import Counter

import corpus_pipeline
from test_operators import brute_components, words
from pulsegrid.llm.common import materialise, read


def test_stages(spark, data):
    docs = read(spark, data, "documents")
    columns, left = docs.columns, docs.count()
    items = [r["text"] for r in read(spark, data, "benchmark").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = materialise(stage(spark, docs, data), "stage")
        n = docs.count()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert after.keys() <= before.keys() and (name == "line dedup" or all(before[d] == t for d, t in after.items()))
        if name == "quality rules":
            for text in after.values():
                w = words(text)
                seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
                inside = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
                assert len(w) >= 20 and 100 * len(inside) <= 30 * len(w)
        if name == "near dedup":
            assert set(after) == {d for d, (_, _, kept) in brute_components(list(before.items())).items() if kept}
        if name == "decontamination":
            assert not any(item in (t or "") for item in items for t in after.values())
            assert set(before) - set(after) >= {d for d, t in before.items() if any(item in (t or "") for item in items)}
        assert 0 < n <= left
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name in ("line dedup", "mixing"):
            assert n == left
        left = n
    assert docs.where("rate < 0 or rate is null").count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
