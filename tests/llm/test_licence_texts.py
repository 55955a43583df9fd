"""Every bundled licence is found in itself, however its text is broken into lines."""

from collections import Counter

from quillspark.llm import licences


def brute_dice(a, b):
    """Dice over word bigrams by plain counting, with a splitter of its own."""
    def pairs(text):
        words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
        return Counter(zip(words, words[1:]))

    x, y = pairs(a), pairs(b)
    return 2 * sum(min(n, y[k]) for k, n in x.items()) / (sum(x.values()) + sum(y.values()))


def test_licences_are_found_in_themselves(spark):
    rows, names = [], {}
    for name, forms in licences.TEMPLATES.items():
        for form in forms:
            halves = form.split(". ")
            for text in (form, ".\n".join(halves), "Copyright 2020 A\n\n" + form + "\n\nmore words", "before it " * 5 + form + " and after" * 5):
                names[len(rows)] = (name, form, text)
                rows.append((len(rows), text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for r in licences.scan_licences(docs).collect():
        got.setdefault(r.doc_id, {})[r.licence] = r.score
    for k, (name, form, text) in names.items():
        # a line that holds more than the licence matches as a line, where it does, words around it included
        assert got[k][name] > (0.8 if text.startswith("before") else 0.95), (name, text[:60])
        if text == form:
            assert got[k][name] == 1.0 == brute_dice(text, form)
        for other, score in got[k].items():
            if text == form:
                assert abs(score - max(brute_dice(text, f) for f in licences.TEMPLATES[other])) < 0.2
    assert {"mit", "isc", "bsd-2-clause", "bsd-3-clause", "zlib", "unlicense", "apache-2.0", "gpl-3.0"} <= set(licences.TEMPLATES)


def test_whole_mit_in_two_lines_and_blank_lines():
    grant, warranty = licences.TEMPLATES["mit"][2], licences.MIT_WARRANTY
    scanner = licences.Scanner(licences.TEMPLATES, 0.8)
    found = scanner.scan(f"Copyright\n{grant}\n{warranty}\n")
    assert [(n, round(s, 3)) for n, s, *_ in found] == [("mit", 1.0)]
    assert scanner.scan("\n" * 200_000 + "Released under the MIT License.\n" + "\n" * 200_000) == [("mit", 1.0, 200_000, 200_000)]


def test_templates_from_a_folder(tmp_path):
    (tmp_path / "OWN-1.0.txt").write_text("you may do as you please with this text if you say so in public")
    own = licences.templates_in(str(tmp_path))
    assert licences.Scanner(own, 0.8).scan("x\nyou may do as you please with this text if you say so in public\ny")[0][:2] == ("own-1.0", 1.0)
