"""Control-plane helpers."""

from pyspark.sql import functions as F

from quillspark.operators import control, metrics, prompt


def test_control(spark):
    q = spark.createDataFrame([(2, "b c"), (1, "a"), (3, "")], "question_id long, question string")
    assert [r.request_id for r in control.request_ids(q, "s").orderBy("question_id").collect()] == ["s#0001", "s#0002", "s#0003"]
    assert {r.question_id: r.n for r in q.select("question_id", control.model_token_count(F.col("question"), str.split).alias("n")).collect()} == {1: 1, 2: 2, 3: 0}
    assert control.subset(q, q.where("question_id > 1"), "question_id").count() == 2
    files = spark.createDataFrame([("a", b"x"), ("b", b"y")], "path string, content binary")
    expected = files.select("path", F.sha2("content", 256).alias("sha256")).withColumn("sha256", F.when(F.col("path") == "a", F.col("sha256")).otherwise("0")).union(spark.createDataFrame([("c", "1")], "path string, sha256 string"))
    assert {r.path: r.state for r in control.integrity(files, expected).collect()} == {"a": "sound", "b": "changed", "c": "missing"}
    assert [r.question_id for r in control.latest_events(q, 2, "question_id").collect()] == [3, 2]
    spans = control.Spans("r1")
    with spans.span("one"):
        pass
    with spans.span("two"):
        pass
    shares = metrics.stage_share(spans.frame(spark)).collect()
    assert {r.stage for r in shares} == {"one", "two"} and abs(sum(r.share for r in shares) - 1) < 0.01


def test_model_hook(spark):
    prompts = spark.createDataFrame([(1, "ask one"), (2, "ask two")], "question_id long, prompt string")
    backend = prompt.choose_backend("auto", lambda batch: [p.upper() for p in batch])
    assert {r.question_id: (r.answer, r.is_simulated) for r in backend(prompts, None).collect()} == {1: ("ASK ONE", False), 2: ("ASK TWO", False)}
    assert prompt.choose_backend() is prompt.extractive_answer
