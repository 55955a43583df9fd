"""Segmentation, compaction, retrieval, validation, evaluation, sources and the whole plan on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import context, evaluate, metrics, prompt, retrieval, segment, validate
from quillspark.plans import ask
from quillspark.sources import corpus, files


def docs(spark, *texts):
    return spark.createDataFrame([(k, t, f"doc_{k}.md") for k, t in enumerate(texts)], "doc_id long, text string, source string")


def kinds(spark, text):
    return [(r.kind, r.text, r.level) for r in segment.blocks(docs(spark, text)).orderBy("block").collect()]


def test_blocks(spark):
    text = "# Title\nSome prose\nmore prose\n\n- a\n- b\n| x | y |\n```\n# code\n```\nTitle two\n===\nbody\n1. Scope of it\nALL CAPS HERE\nlast"
    assert kinds(spark, text) == [
        ("heading", "Title", 1), ("paragraph", "Some prose\nmore prose", 0), ("list", "- a\n- b", 0), ("table", "| x | y |", 0), ("code", "```\n# code\n```", 0),
        ("heading", "Title two", 1), ("paragraph", "body", 0), ("heading", "1. Scope of it", 2), ("heading", "ALL CAPS HERE", 2), ("paragraph", "last", 0),
    ]


def test_fence_without_end_and_rules(spark):
    assert kinds(spark, "a\n~~~\nx\n\ny") == [("paragraph", "a", 0), ("code", "~~~\nx\n\ny", 0)]
    assert kinds(spark, "text\n---\n---\nend") == [("heading", "text", 2), ("paragraph", "---\nend", 0)]


def test_units_stack_split_and_fold(spark):
    long = " ".join(f"Sentence number {k} says something plain." for k in range(60))
    small = "tiny tail"
    text = f"## A\n{long}\n\n{small}\n## B\nunder b\n# C\n### D\nunder d"
    rows = segment.units(docs(spark, text)).orderBy("ordinal").collect()
    assert [r.section_path for r in rows][-2:] == [["A", "B"], ["C", "D"]]  # a skipped level keeps what stands there
    assert all(r.token_estimate <= 320 for r in rows) and len(rows) >= 5
    assert rows[-3].text.endswith(small) and rows[-3].section_path == ["A"]
    assert [r.ordinal for r in rows] == list(range(len(rows))) and rows[0].unit_id == "0#0000"
    facts = segment.document_facts(docs(spark, text, "x y"), segment.blocks(docs(spark, text, "x y")), segment.units(docs(spark, text, "x y"))).orderBy("doc_id").collect()
    assert facts[0].title == "A" and facts[1].title == "doc 1" and facts[0].unit_count == len(rows)


def units_of(spark, *texts, doc=None):
    rows = [(doc[k] if doc else k, k, f"u{k}", "paragraph", t, ["S"], len(t) // 4 + 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, ordinal int, unit_id string, kind string, text string, section_path array<string>, token_estimate int")
    return df.withColumns({"document_name": F.lit("policy"), "char_start": F.lit(0), "char_end": F.length("text"), "heading_level": F.lit(0)})


LONG = "travel expenses must receive approval from managers before booking flights hotels trains rental cars and meals during business trips abroad within the european union"


def test_compaction(spark):
    texts = [LONG, LONG.upper(), LONG + " 30", LONG + " 45", "page 3 of 9", "too short", LONG.replace("abroad", "abroad always"), "confidential"]
    units = units_of(spark, *texts)
    noise = context.drop_noise(units)
    assert {r.ordinal for r in noise.collect()} == {0, 1, 2, 3, 6}
    exact = context.drop_exact(noise)
    assert {r.ordinal for r in exact.collect()} == {0, 2, 3, 6}
    same = {r.ordinal for r in context.drop_near(exact).collect()}
    assert {2, 3} <= same  # figures protect


def test_near_pairs_match_brute_force(spark):
    words = LONG.split()
    texts = [" ".join(words * 4), " ".join(words * 4 + ["extra"]), " ".join((words * 4)[:-1]), " ".join(words), " ".join(reversed(words))]
    units = units_of(spark, *texts)
    from quillspark.functions import text as T

    grams = {r.ordinal: set(r.g) for r in units.select("ordinal", T.shingles(F.col("text")).alias("g")).collect()}
    want = {(a, b) for a in grams for b in grams if a < b and len(grams[a] & grams[b]) >= 0.92 * len(grams[a] | grams[b])}
    assert {(r.a_ordinal, r.b_ordinal) for r in context.near_pairs(units).collect()} == want


def test_merge_fragments(spark):
    units = units_of(spark, "one", "two", "x " * 300, "three", "four", doc=[0, 0, 0, 0, 1])
    assert sorted(r.text.replace("x ", "")[:9] for r in context.merge_fragments(units).collect()) == ["", "four", "one\ntwo", "three"]


def test_intent_and_budget(spark):
    q = spark.createDataFrame([(1, "compare A versus B"), (2, "how many days"), (3, "hello"), (4, "ecart resume")], "question_id long, question string")
    got = {r.question_id: (r.intent, r.confidence) for r in context.classify_intent(q).collect()}
    assert got == {1: ("comparison", "high"), 2: ("extraction", "high"), 3: ("factual", "medium"), 4: ("comparison", "low")}
    hot = context.budget(context.classify_intent(ask.observe(q, 1000.0, 95.0, 99.0))).where("question_id = 3").first()
    assert (hot.limiting_factor, hot.max_passages, hot.thermal, hot.cpu) == ("thermal", 2, 0.4, 0.6267)


CORPUS = [
    "Lunch expenses are reimbursed up to 25 EUR for every working day of travel when receipts are supplied to accounting.",
    "Employees may work remotely for three days each week after approval by their manager and the security office.",
    "Annual leave requests must be submitted thirty days before departure through the personnel portal for validation.",
]


def test_retrieval_and_gate(spark):
    units = units_of(spark, *CORPUS, doc=[0, 1, 2])
    q = spark.createDataFrame([(1, "How much lunch expenses reimbursed?"), (2, "warranty of spacecraft engines"), (3, "the of and")], "question_id long, question string")
    pool = retrieval.ranked(units, q)
    assert {r.question_id for r in pool.collect()} == {1} and pool.orderBy("rank").first().unit_id == "u0"
    gate = {r.question_id: r.off_topic for r in retrieval.off_topic(q, retrieval.vocabulary(units, retrieval.postings(units))).collect()}
    assert gate == {1: False, 2: True, 3: False}
    asked = context.budget(context.classify_intent(ask.observe(q)))
    evidence = retrieval.select_diverse(pool, asked)
    assert [(r.label, r.unit_id) for r in evidence.orderBy("pick").collect()][0] == ("S1", "u0")
    assert retrieval.over_budget(evidence, asked).count() == 0 and retrieval.precision(evidence, q).first().precision == 1.0


def test_selection_respects_limits(spark):
    rows = [(1, f"u{k}", 0 if k < 6 else k, "p", CORPUS[k % 3] + f" {k}", ["S"], 40, 10.0 - k) for k in range(10)]
    pool = spark.createDataFrame(rows, "question_id long, unit_id string, doc_id long, document_name string, text string, section_path array<string>, token_estimate int, total double")
    limits = spark.createDataFrame([(1, 300, 8)], "question_id long, evidence_tokens int, max_passages int")
    got = retrieval.select_diverse(pool, limits).collect()
    assert sum(r.token_estimate for r in got) <= 300 and sum(r.doc_id == 0 for r in got) == 4


def test_validation(spark):
    e = spark.createDataFrame([(k, 1, "S1", CORPUS[0]) for k in (1, 2, 3, 4)], "question_id long, pick int, label string, text string")
    a = spark.createDataFrame(
        [(1, "lunch expenses", CORPUS[0] + " [S1]"), (2, "lunch", "Aliens pay for everything on distant planets always. [S9]"), (3, "lunch", prompt.REFUSAL), (4, "lunch", "25 EUR"), (5, "x", "Anything goes here today."), (6, "x", prompt.REFUSAL_FR)],
        "question_id long, question string, answer string",
    )
    got = {r.question_id: r for r in validate.validate(a, e).collect()}
    assert {k: (r.passed, r.confidence) for k, r in got.items()} == {1: (True, "high"), 2: (False, "insufficient"), 3: (False, "insufficient"), 4: (False, "insufficient"), 5: (False, "insufficient"), 6: (True, "insufficient")}
    assert got[2].invalid_labels == ["S9"] and len(got[2].unsupported) == 1 and len(got[2].warnings) == 3


def test_evidence_beyond_the_bound_is_counted(spark):
    rows = [(1, k, f"S{k}", "d", ["A", "B"], "x" * 50) for k in (1, 2, 3)] + [(2, 1, "S1", "d", [], "y" * 500)]
    e = spark.createDataFrame(rows, "question_id long, pick int, label string, document_name string, section_path array<string>, text string")
    q = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "question_id long, question string")
    got = {r.question_id: r for r in prompt.render_evidence(e, q, most_chars=140).collect()}
    assert (got[1].labels, got[1].left_out, got[1].excerpts[:17]) == (["S1", "S2"], 1, "[S1] d > A > B\nxx")
    assert (got[2].labels, got[2].left_out, got[2].excerpts) == ([], 1, prompt.NO_EVIDENCE)
    assert (got[3].left_out, got[3].excerpts) == (0, prompt.NO_EVIDENCE)


def test_statistics(spark):
    data = [("m", 1.0), ("m", 2.0), ("m", 3.0), ("m", None), ("m", float("nan")), ("none", None)]
    got = {r.metric: r for r in metrics.aggregate(spark.createDataFrame(data, "metric string, value double")).collect()}
    assert (got["m"].samples, got["m"].p95, got["m"].median, got["m"].stdev) == (3, 2.9, 2.0, 0.8165) and got["none"].samples == 0


def test_probes_and_scores(spark):
    probes = [
        ("a", ["25"], [], "all", "s", False, "It is 25.", None, False, "high", ["s"]), ("b", ["25", "x"], [], "any", None, False, "25", None, False, "high", []),
        ("c", ["3"], ["30"], "all", None, False, "30", None, False, "high", []), ("d", [], [], "all", None, True, "no", None, False, "insufficient", []),
        ("e", ["1"], [], "all", None, False, "1", None, True, "high", []), ("f", ["1"], [], "all", "s", False, "1", None, False, "high", ["t"]),
    ]
    schema = "id string, must_contain array<string>, must_not_contain array<string>, match string, expected_source string, unanswerable boolean, answer string, error string, truncated boolean, confidence string, sources array<string>"
    out = evaluate.probe_outcomes(spark.createDataFrame(probes, schema))
    assert {r.id: r.correct for r in out.collect()} == {"a": True, "b": True, "c": False, "d": True, "e": False, "f": True}
    s = evaluate.accuracy_summary(out).first()
    assert (s.accuracy, s.refusal_accuracy, s.overall_accuracy, s.truncated) == (0.6, 1.0, 0.6667, 0.1667)
    assert {r.id for r in evaluate.failures(out).collect()} == {"c", "e", "f"}


def test_store_sources_and_profile(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("# Title\n" + "Some long enough text for the filter to keep. " * 3)
    (folder / "sub" / "b.txt").write_bytes("caf\xe9 ".encode("latin-1") * 20)
    (folder / "c.exe").write_text("no")
    (folder / "d.txt").write_text("short")
    (folder / "e.md").write_text("")
    good, bad = files.load_texts(files.describe(files.discover(spark, str(folder))))
    assert {r.filename for r in good.collect()} == {"a.md", "b.txt"} and "café" in good.where("filename = 'b.txt'").first().text
    assert {(r.filename, r.error) for r in bad.collect()} == {("c.exe", "ING-001"), ("d.txt", "ING-007"), ("e.md", "ING-005")}

    store = corpus.CorpusStore(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        store.documents()
    d = spark.createDataFrame([("x", "a.md"), ("y", "b.md")], "document_id string, filename string")
    u = spark.createDataFrame([("x", 0, "t", 3, "c0"), ("y", 0, "u", 4, "c1")], "document_id string, ordinal int, text string, token_estimate int, checksum string")
    store.upsert(d, u)
    store.upsert(d.where("document_id = 'x'").withColumn("filename", F.lit("z.md")), u.where("document_id = 'x'"))
    assert [r.filename for r in store.documents().collect()] == ["b.md", "z.md"]
    assert corpus.snapshot(store.units()).first().tokens == 7
    store.delete(d.where("document_id = 'y'"))
    assert store.counts().first() == (1, 1)
    store.clear()
    assert store.counts().first() == (0, 0)

    path = tmp_path / "eval.json"
    path.write_text(json.dumps({"corpus": "c", "questions": [{"id": "Q1", "question": "q", "must_contain": ["1"]}, {"id": "Q2", "question": "r", "unanswerable": True}]}))
    probes = {r.id: r for r in files.evaluation_set(spark, str(path)).collect()}
    assert probes["Q1"].match == "all" and probes["Q2"].unanswerable and probes["Q2"].must_contain == []
    text = "id: demo\nmodel:\n  name: m # note\n  sizes: [1, 2]\ninference:\n  deep:\n    on: true\n  list:\n  - a\n  - 2\n"
    assert files.parse_profile(text) == {"id": "demo", "model": {"name": "m", "sizes": [1, 2]}, "inference": {"deep": {"on": True}, "list": ["a", 2]}}


def test_ask_end_to_end(spark):
    texts = [f"# Policy {k}\n{t}" for k, t in enumerate(CORPUS)]
    q = spark.createDataFrame([(1, "What is reimbursed for lunch expenses?"), (2, "warranty of spacecraft engines")], "question_id long, question string")
    a = ask.ask(ask.prepare(docs(spark, *texts)), q)
    answers = {r.question_id: r.answer for r in a.answers.collect()}
    assert "25 EUR" in answers[1] and answers[1].endswith("[S1]") and answers[2] == prompt.REFUSAL
    reports = {r.question_id: r for r in a.reports.collect()}
    assert reports[1].passed and reports[2].passed and reports[2].confidence == "insufficient"
    assert ask.invariants(a).count() == 0 and {r.question_id for r in a.metrics.collect()} == {1, 2}


def test_naive_context_and_transitions(spark):
    units = units_of(spark, *[c * 3 for c in CORPUS], doc=[0, 1, 2])
    row = evaluate.naive_context(units, 60).first()
    assert row.coverage < 1 and row.context.startswith("Lunch") and row.dropped_tokens == row.corpus_tokens - row.context_tokens
    whole = evaluate.naive_context(units, 10_000).first()
    assert whole.coverage == 1.0 and whole.dropped_tokens == 0
    history = spark.createDataFrame([(1, 1, "new"), (1, 2, "ready"), (1, 3, "new")], "session_id long, at int, state string")
    assert [r.at for r in ask.illegal_transitions(history, [("new", "ready")]).collect()] == [3]
    assert evaluate.synthetic_units(spark).count() == 400
