"""Compaction finds the words of a text once; its report leaves texts behind once they are marked."""

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import context, segment
from quillspark.plans import ask, catalogue


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def texts(spark):
    long = " ".join(f"word{i} stone{i % 7}" for i in range(60))
    rows = [long, long.upper(), long + " more", "page 3", "few", "", None, "\n\n".join(["## Head", "alpha beta gamma delta", "## Head", "eta  theta iota kappa lambda", long, "mu nu xi omicron pi rho " + long])]
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "doc_id long, text string, source string")


def test_words_are_found_once_and_the_report_carries_no_texts(spark, monkeypatch):
    kept = []
    for module in (ask, context, context.neardup):
        monkeypatch.setattr(module, "keep", lambda df, keep=module.keep: kept.append(plan(df)) or keep(df))
    for stage, carry in ((ask.prepare, True), (ask.sizes, False)):
        kept.clear()
        stages = stage(texts(spark))
        # of the first stage written on, nobody splits texts again
        assert T.PLAIN_WORD in kept[0] and not [p for p in kept[1:] if T.PLAIN_WORD in p or "sha2" in p]
        assert carry or not [p for p in [*kept[1:], *map(plan, stages.values())] if "text#" in p]


def test_sizes_are_those_of_the_texts(spark, small):
    for docs in (texts(spark), catalogue.headed(spark, small)):
        whole, sizes = ask.prepare(docs), ask.sizes(docs)
        ids = lambda df: sorted(map(tuple, df.select("unit_id", "token_estimate").collect()))
        for name in whole:
            assert ids(whole[name]) == ids(sizes[name])


def test_marks_give_what_texts_give(spark, small):
    units = segment.units(catalogue.headed(spark, small), more=("words",)).cache()
    units = units.unionByName(units.withColumns({"doc_id": F.col("doc_id") + 10**6, "unit_id": F.concat("unit_id", F.lit("b"))})).cache()
    marked = context.marks(units).cache()
    steps = (context.drop_noise, context.drop_exact, context.drop_near)
    ids = lambda df: sorted(r.unit_id for r in df.select("unit_id").collect())
    for step in steps:
        assert ids(step(units)) == ids(step(marked))
    assert ids(context.drop_exact(units)) != ids(units)


def test_many_repeated_keys_are_not_broadcast(spark, monkeypatch):
    marked = context.marks(segment.units(texts(spark), more=("words",))).cache()
    some = sorted(r.unit_id for r in context.drop_exact(marked).collect())
    monkeypatch.setattr(context, "few", lambda df: False)
    assert sorted(r.unit_id for r in context.drop_exact(marked).collect()) == some and len(some) < marked.count()
