"""Queries of the catalogue that must read whole documents."""

from quillspark.plans import catalogue


def test_headings_are_added_and_no_line_is_cut(spark, small):
    whole = {r.doc_id: r.text.split("\n") for r in catalogue.documents(spark, small).where("text IS NOT NULL").collect()}
    made = {r.doc_id: set(r.text.split("\n")) for r in catalogue.headed(spark, small).where("text IS NOT NULL").collect()}
    assert made.keys() == whole.keys()
    assert all(line in made[k] or f"- {line}" in made[k] for k, lines in whole.items() for line in lines)


def test_unlabelled_answers_come_from_retrieved_evidence(spark, small):
    _, _, e = catalogue._evidence(spark, small)
    asked = {r.question_id for r in e.where("pick = 1").collect()}
    assert {r.question_id for r in catalogue.unlabelled_answer(spark, small).collect()} == asked and asked
