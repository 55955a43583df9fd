"""The corpus pipeline's stages, each judged on its own input."""

import corpus_pipeline
from quillspark.llm import simhash
from quillspark.llm.common import table


def test_stages_in_order(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mixing", "packing"]
    docs = table(spark, small, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == docs.columns
        out = spark.createDataFrame(out.toPandas(), out.schema)
        kept[name] = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept[name] <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "near dedup":
            assert simhash.near_groups(out).where("doc_id <> component_id").count() == 0
        docs = out
    assert kept["packing"] == kept["mixing"] and len(kept["toxicity"]) > 150


def test_queries_are_registered(spark):
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
