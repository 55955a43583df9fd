"""Licence notices inside long lines."""

from quillspark.llm import licences


def test_licences_inside_long_lines(spark):
    filler = "some other words go here " * 40
    texts = [
        "Copyright 2020 Foo. Released under the MIT License. See LICENSE.",
        filler + licences.TEMPLATES["apache-2.0"][1] + " " + filler,
        "intro words\n" + filler + "Licensed under CC BY\n4.0. " + filler,
        filler + "the software is under a license of the kind described",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.licence): (r.score, r.first_line, r.last_line) for r in licences.scan_licences(docs).collect()}
    assert got[0, "mit"] == (1.0, 0, 0) and got[1, "apache-2.0"] == (1.0, 0, 0) and got[2, "cc-by-4.0"] == (1.0, 1, 2)
    assert not any(doc == 3 for doc, _ in got)
