"""Texts of a corpus are written as compressed columns, what compaction asks of them goes after it, and no words are written for a batch of questions."""

from pathlib import Path

from pyspark.sql import functions as F

from quillspark.operators import context, retrieval
from quillspark.plans import ask
from quillspark.plans.keep import discard, keep, pack, packing

LONG = "## Head\n" + " ".join(f"word{i} stone{i % 7}" for i in range(60))
TEXTS = [LONG, LONG, LONG + " more", "", None, LONG + "\n## Other\nshort words of one line here\n- and one item of a list\n## Third\n" + LONG.replace("stone", "shell")]


def docs(spark):
    return spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string")


def folder(df) -> Path:
    return Path(df.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent


def test_packed_stages_are_read_back_and_go_when_told(spark):
    df = spark.createDataFrame([(1, ["a", None], "x"), (2, None, None)], "id long, l array<string>, t string")
    with packing():
        kept = keep(df)
    assert kept.dtypes == df.dtypes and sorted(kept.collect()) == sorted(df.collect())
    place = folder(kept)
    assert place.is_dir()
    discard(kept)
    assert not place.exists() and not keep(df).inputFiles()
    assert pack(df.limit(0)).collect() == []


def test_texts_are_packed_and_marks_go(spark, monkeypatch):
    kept, gone = [], []
    monkeypatch.setattr(ask, "keep", lambda df, keep=ask.keep: kept.append(keep(df)) or kept[-1])
    monkeypatch.setattr(ask, "discard", lambda df, discard=ask.discard: gone.append(folder(df)) or discard(df))
    stages = ask.prepare(docs(spark))
    assert kept and not [df.columns for df in kept if "text" in df.columns]
    assert len(gone) == 1 and not gone[0].exists()
    for df in stages.values():  # all can still be read
        assert "text" in df.columns and df.inputFiles() and df.collect()


def test_units_that_stay_are_those_left(spark):
    units = spark.createDataFrame([(d, o, f"{d}#{o}") for d in range(4) for o in range(5)], "doc_id long, ordinal int, unit_id string")
    left = units.where("doc_id < 3 AND (ordinal + doc_id) % 3 = 1").select(*context.ORDER)
    out = ask._staying(units, left)
    assert out.columns == units.columns
    assert sorted(r.unit_id for r in out.collect()) == sorted(f"{d}#{o}" for d in range(3) for o in range(5) if (o + d) % 3 == 1)


def test_no_words_are_written_for_questions(spark, monkeypatch):
    kept = []
    for module in (ask, retrieval):
        monkeypatch.setattr(module, "keep", lambda df, keep=module.keep: kept.append(df.columns) or keep(df))
    q = spark.createDataFrame([(1, "word5 and stone3"), (2, "word7 shell3")], "question_id long, question string")
    rows = ask.ask(ask.prepare(docs(spark)), q).metrics.select("question_id", "passages").collect()
    assert len(rows) == 2 and max(r.passages for r in rows) > 0
    assert not [c for c in kept if "tf" in c]
