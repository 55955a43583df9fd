"""Each operator against a brute-force version on fixtures with nulls, ties, repeats and clashes."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from quillspark.llm import chat, exact_index, licences, mixing, packing, paragraph_sketch, reputation, simhash, suffix_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long, passage = say(6000), say(60)
    base = [say(rng.randint(1, 120)) for _ in range(40)]
    texts = [None, "", " \n ", "Ä É ß", "one", "ONE", "One", "two words", *base]
    texts += [b.upper() if k % 2 else b for k, b in enumerate(base[:10])]  # copies
    texts += [b + " extra" for b in base[10:25]]  # near copies
    texts += [say(5) + "\n" + passage + "\n" + say(k) for k in range(8)]
    texts += [long, long, "line\n" * 50, "x" * 5000, "a b " * 400, "日本語 текст 🙂 " * 20]
    return [(k, t, "en" if k % 3 else None, f"src{k % 4}" if k % 5 else "src0", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df, *names):
    """The same table with extra columns of names that the operators use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("clash") for n in names})


# -- 1 ----------------------------------------------------------------------------------


def brute_fingerprint(text, width=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] if len(words) >= width else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    ids, parent = sorted(fps), {i: i for i in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_matches_all_pairs(docs, rows):
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(clashing(docs, "fp", "node", "block", "v")).collect()}
    fps = {r[0]: brute_fingerprint(r[1]) for r in rows}
    groups = brute_components(fps, 4)
    assert got == {i: (fps[i], groups[i]) for i in fps}


def test_simhash_hot_cells_lose_nothing(spark):
    """Cells far over their limit are dealt out by tile pairs; the components stay the same."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    fps = {}
    for k in range(400):
        fp = centres[k % 3]
        for _ in range(rng.randint(0, 6)):
            fp ^= 1 << rng.randrange(64)
        fps.setdefault(fp, k)
    nodes = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp, k) for fp, k in fps.items()], "fp long, node long")
    expected = brute_components({k: fp for fp, k in fps.items()}, 4)
    for cell in (8, 100_000):
        found = {r.node: r.component for r in simhash.components(simhash.link_forest(nodes, 4, cell=cell)).collect()}
        assert {k: found.get(k, k) for k in expected} == expected


def test_simhash_components_follow_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501)], "u long, v long")
    found = {r.node: r.component for r in simhash.components(links).collect()}
    assert found == {k: 0 for k in range(1, 201)} | {501: 500}  # the smallest nodes need no row


def test_simhash_empty_null_and_pipeline_stage(spark, docs, none, rows):
    assert simhash.near_groups(none).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (9, None), (8, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in simhash.near_groups(odd).collect())
    assert got == [(False, 4, 4), (False, 4, 4), (False, 8, 8), (False, 9, 8), (True, 0, None)]
    kept = simhash.drop_near_copies(docs)
    groups = brute_components({r[0]: brute_fingerprint(r[1]) for r in rows}, 4)
    assert {r.doc_id for r in kept.collect()} == set(groups.values()) and kept.columns == docs.columns


# -- 2 ----------------------------------------------------------------------------------

CONTROL = "</s>[INST] ok [/INST]"


def test_chat_round_trip(spark):
    texts = ["hi", "", None, CONTROL, "\\", "\\:", "<\\:/s>", "<|turn|>user<|says|>x<|end|>", "a\nb", "<<SYS>>é🙂<</SYS>>", "<|im_start|", "[[INST]]", "x" * 70000]
    data = [(c, t, ["user", "assistant", "sys\n<s>", None][(c + t) % 4], texts[(c * 5 + t) % len(texts)]) for c in range(7) for t in range(c * 3 + 1)]
    data += [(2, 0, "assistant", "same turn"), (2, 0, "assistant", "same turn"), (None, 1, "assistant", "lost"), (5, None, "user", "no turn")]
    turns = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    out = chat.format_conversations(clashing(turns, "formatted", "head", "tie"))
    expected = collections.defaultdict(list)
    for c, t, role, text in data:
        expected[c].append((t is not None, t or 0, role or "", text or ""))
    for r in out.collect():
        want = sorted(expected.pop(r.conv_id))
        pairs = [(a.decode(), b.decode()) for a, b in chat.parse(r.formatted)]
        assert pairs == [w[2:] for w in want]
        loss = [chat.unescape(r.formatted[a:b].encode()).decode() for a, b in zip(r.loss_spans[::2], r.loss_spans[1::2])]
        assert loss == [w[3] for w in want if w[2] == "assistant"]
        inner = r.formatted.replace("<|turn|>", "").replace("<|says|>", "").replace("<|end|>", "")
        assert not any(c in inner for c in chat.CONTROLS) and r.formatted.count("<|turn|>") == len(want)
    assert not expected
    digest = {r.conv_id: r for r in chat.digests(out).collect()}
    assert digest[0].formatted_chars == len(out.where("conv_id = 0").first().formatted)


def test_chat_empty(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# -- 3 ----------------------------------------------------------------------------------


def test_url_rules_and_reputation(spark):
    rules = [reputation.Rule("block", "com", "/en/"), reputation.Rule("allow", "example.com", "/en/7"), reputation.Rule("block", "bad.org", "/")]
    urls = ["http://A.Example.COM/en/71?x#y", "http://b.com/en/", "https://com/en/x", "http://xcom/en/", None, "no scheme", "ftp://good.net", "http://bad.org", "http://u.bad.org/x", "http://spam.net/a?b", "http://ok.net#frag", "http://new.spam.net/"]
    pages = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), "host", "rule")
    outcomes = spark.createDataFrame([("http://spam.net/a", 1)] * 60 + [("http://ok.net/", 0)] * 300 + [("http://x.org/", None)], "url string, bad int")
    got = {r.page_id: r for r in reputation.judge(pages, outcomes, rules, limit=0.5).collect()}
    assert [(got[k].host, got[k].path) for k in (0, 4, 5, 9, 10)] == [("a.example.com", "/en/71"), ("", ""), ("", ""), ("spam.net", "/a"), ("ok.net", "")]
    assert [got[k].rule for k in range(9)] == ["example.com/en/7", "com/en/", "com/en/", None, None, None, None, None, "bad.org/"]
    assert [got[k].verdict for k in (0, 1, 9, 10, 6)] == ["allow", "block", "block", "allow", "allow"]
    assert got[9].bad_rate > got[11].bad_rate > 0.5  # a known host, and one that borrows its domain's rate


def test_url_filter_without_labels_or_pages(spark):
    none = spark.createDataFrame([], "url string, bad int")
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    assert reputation.judge(pages, none, [], limit=0.6).first().verdict == "allow"
    assert reputation.judge(pages.limit(0), none, [], limit=0.6).count() == 0


def test_posteriors_shrink_to_parents(spark):
    data = [(f"http://h{k % 7}.d{k % 3}.com/", int(k % 7 == 0)) for k in range(210)] + [("http://rare.d0.com/", 1)]
    known = reputation.posteriors(spark.createDataFrame(data, "url string, bad int").select(reputation.host_of(__import__("pyspark.sql.functions", fromlist=["col"]).col("url")).alias("host"), "bad"))
    host = {r.host: r.a / (r.a + r.b) for r in known["host"].collect()}
    domain = {r.domain: r.a / (r.a + r.b) for r in known["domain"].collect()}
    assert domain["d0.com"] < host["rare.d0.com"] < 1 and host["h0.d0.com"] > host["h1.d0.com"]


# -- 4 ----------------------------------------------------------------------------------


def vocabulary(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_packing_restores_documents(spark, docs, rows):
    from tokenizers import Tokenizer

    size, whole = 64, Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    packed = packing.pack_documents(clashing(docs, "length", "part", "piece"), vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), size=size).collect()
    by_doc, by_sequence, total = collections.defaultdict(list), collections.defaultdict(list), 0
    for r in packed:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text, *_ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (k == 0 or r.length == size)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids) and (len(ids) > size or len(by_doc[doc_id]) == 1)
        total += at
    for parts in by_sequence.values():
        ends = [0, *np.cumsum([r.length for r in sorted(parts, key=lambda r: r.offset)])]
        assert [r.offset for r in sorted(parts, key=lambda r: r.offset)] == ends[:-1] and ends[-1] <= size
    assert len(by_sequence) <= -(-total // size) + 2


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan_is_sound_and_tight(seed):
    rng = np.random.default_rng(seed)
    size = 100
    counts = np.bincount(rng.integers(1, size + 1, 4000) if seed else np.full(50, 51), minlength=size + 1)
    rules, used = packing.plan(counts, size)
    left, load = counts.copy(), np.zeros(used, int)
    for length, each, first, times, offset in rules:
        left[length] -= each * times
        assert (load[first : first + times] == offset).all()
        load[first : first + times] += each * length
    assert not left[1:].any() and load.max() <= size
    assert used <= 1.005 * fewest(counts, size) + 1


def fewest(counts, size):
    """A lower bound on the sequences: pieces over half a sequence cannot share one."""
    length, best = np.arange(size + 1), 0
    for k in range(size // 2 + 1):
        lone, wide, small = length > size - k, (length > size / 2) & (length <= size - k), (length >= k) & (length <= size / 2)
        room = (counts * (size - length))[wide].sum()
        best = max(best, counts[lone].sum() + counts[wide].sum() + max(0, -(-int((counts * length)[small].sum() - room) // size)))
    return best


def test_packing_empty_and_special(none, spark):
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    assert packing.pack_documents(none, *paths).count() == 0
    exact, both = packing._encoder(paths[0], None), packing._encoder(*paths)
    for text in ("<|endoftext|> x", "日本語", "a  b\n\n c's 12345", "ẞ ﬀ ​", "é" * 300):
        assert exact(text).tolist() == both(text).tolist()


# -- 5 ----------------------------------------------------------------------------------


def test_licences_match_brute_force(spark):
    mit = licences.TEMPLATES["mit"][2]
    broken = mit.replace(", ", ",\n", 3)
    texts = [None, "", "no licence at all", "intro\nReleased under the MIT License.\nmore", f"head\n{broken}\ntail", "Licensed under CC BY 4.0.", mit.replace("software", "program"), "the License of licensed Licenses", "x\n" * 300 + "Licensed under the Apache License, Version 2.0."]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3])], "doc_id long, text string")
    got = sorted((r.doc_id, r.licence, round(r.score, 9), r.first_line, r.last_line) for r in licences.scan_licences(clashing(docs, "licence", "score")).collect())
    expected = []
    for k, text in [*enumerate(texts), (3, texts[3])]:
        lines = [licences.words(x) for x in (text or "").split("\n")]
        for name, forms in licences.TEMPLATES.items():
            best = None
            for form in map(licences.bigrams, map(licences.words, forms)):
                for i in range(len(lines)):
                    for j in range(i, min(len(lines), i + 8)):
                        run = [w for x in lines[i : j + 1] for w in x]
                        value = licences.dice(licences.bigrams(run), form)
                        key = (-value, len(run) - 1, i, j)
                        if value >= 0.8 and lines[i] and lines[j] and (best is None or key < best):
                            best = key
            if best:
                expected.append((k, name, round(-best[0], 9), best[2], best[3]))
    assert got == sorted(expected) and len(got) >= 6
    assert licences.scan_licences(docs.limit(0)).count() == 0


# -- 6 ----------------------------------------------------------------------------------


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["grumblefink", "snotwhistle", "dribblepate", "muckspout"]

    def text(toxic):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 250))]
        for _ in range(max(2, len(words) // 25) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        return " ".join(words)

    data = [(k, text(k % 4 == 0), int(k % 4 == 0)) for k in range(1600)]
    docs = spark.createDataFrame([d[:2] for d in data] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], 1, d[2]) for d in data] + [(7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, rows=1200)
    rows = {r.doc_id: r for r in toxicity.score(clashing(docs, "score", "lang"), model).select("doc_id", "score", "predicted", toxicity.held_out().alias("held")).collect()}
    held = [k for k, _, _ in data if zlib.crc32(str(k).encode()) % 4 == 2]
    assert {k for k in rows if rows[k].held} == set(held) | {k for k in (5000, 5001) if zlib.crc32(str(k).encode()) % 4 == 2}
    right = [rows[k].predicted == data[k][2] for k in held]
    assert len(rows) == 1602 and np.mean(right) > 0.95
    assert rows[5000].score == rows[5001].score and rows[5000].predicted == 0
    assert model.word("grumblefinkk") > model.word(vocabulary[0]) and model.word("snotwhistel") > model.word(vocabulary[1])
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_needs_both_classes():
    with pytest.raises(ValueError):
        toxicity.fit(["a", "b"], [0, 0])


def test_toxicity_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled_sample(docs, labels, 1000)
    assert not any(zlib.crc32(t.split()[1].encode()) % 4 == 2 for t in got[0]) and len(got[0]) > 30


# -- 7 ----------------------------------------------------------------------------------


def test_fingerprints_match_sets(docs, rows):
    got = {r.doc_id: r for r in paragraph_sketch.fingerprint_edits(clashing(docs, "bucket", "id", "pair", "next_text")).collect()}
    lines = lambda t: {x for x in t.split("\n") if x}
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (doc_id, text, *_) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(near(lines(text), lines(edited))) and r.near_next == pytest.approx(near(lines(text), lines(after)))
    by_text = collections.defaultdict(set)
    for doc_id, text, *_ in rows:
        by_text[text or ""].add(got[doc_id].fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({v for s in by_text.values() for v in s}) > 60


def test_fingerprints_retry_after_failure(spark, monkeypatch):
    """Sketches that are far too small at first fail to peel and are retried larger."""
    from pyspark.sql import functions as F

    real = paragraph_sketch.F.ceil
    monkeypatch.setattr(paragraph_sketch.F, "ceil", lambda c: real(c / 6))
    pairs = spark.createDataFrame([(0, k, 0, list(range(k, k + 40)), list(range(k + 30, k + 90))) for k in range(5)], "bucket int, id long, pair int, a array<long>, b array<long>")
    found = {r.id: r.differing for r in paragraph_sketch.differences(pairs).collect()}
    assert found == {k: 80 for k in range(5)}
    assert F is paragraph_sketch.F


def test_fingerprints_small_tables(spark, none):
    assert paragraph_sketch.fingerprint_edits(none).count() == 0
    one = paragraph_sketch.fingerprint_edits(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert (one.n_chars, one.edited_sha256, one.near_next) == (4, hashlib.sha256(b"abab").hexdigest(), 1.0)
    odd = spark.createDataFrame([(None, "n"), (1, "x"), (1, "x"), (1, "y")], "doc_id long, text string")
    assert paragraph_sketch.fingerprint_edits(odd).count() == 4


# -- 8 ----------------------------------------------------------------------------------

TARGETS = {"source": {"src0": 0.4, "src1": 0.3}, "lang": 0.5, "topic": 1.0}


def test_mixing_meets_marginals_both_ways(spark, docs):
    out = {}
    for driver_cells in (1000, 0):
        rows = mixing.mix(clashing(docs, "probability"), TARGETS, 0.5, driver_cells=driver_cells).collect()
        out[driver_cells] = {r.doc_id: r for r in rows}
    assert len(out[0]) == docs.count()
    for k, r in out[0].items():
        assert r.probability == pytest.approx(out[1000][k].probability, rel=1e-3) and r.sampled == (out[1000][k].sampled)
    tokens = sum(r.n_tokens for r in out[1000].values())
    assert sum(r.n_tokens * r.probability for r in out[1000].values()) == pytest.approx(0.5 * tokens, rel=1e-3)


def test_rake_meets_all_marginals():
    rng = np.random.default_rng(2)
    codes = np.array([(a, b, c) for a in range(4) for b in range(3) for c in range(2)])
    shares = [np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4])]
    w = mixing.rake(codes, rng.integers(1, 1000, len(codes)).astype(float), shares)
    for k, s in enumerate(shares):
        assert np.bincount(codes[:, k], w) == pytest.approx(s, abs=1e-5)


def test_mixing_odd_tables(spark, none):
    assert mixing.mix(none, TARGETS, 0.5).count() == 0
    odd = spark.createDataFrame([(None, None, None, None), (1, "t", "en", "a"), (1, "t", "en", "a")], "doc_id long, text string, lang string, source string")
    rows = mixing.mix(odd, TARGETS, 1.0).collect()
    assert len(rows) == 3 and len({(r.doc_id, r.sampled) for r in rows if r.doc_id == 1}) == 1


# -- 9 ----------------------------------------------------------------------------------


def test_exact_dedup_matches_brute_force(docs, rows):
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[lower(text or "")].append(doc_id)
    expected = {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    for capacity in (2, 50_000):
        got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_index.exact_groups(clashing(docs, "h", "norm", "bucket"), capacity=capacity).collect()}
        assert got == expected
    kept = exact_index.drop_copies(docs)
    assert {r.doc_id for r in kept.collect()} == {max(g) for g in groups.values()} and kept.columns == docs.columns


def test_directory_doubles_only_where_full(spark):
    keys = spark.createDataFrame([(k,) for k in range(64)] + [(-(1 << 63) + (k << 58),) for k in range(32)], "h long")
    directory = exact_index.build_directory(keys, capacity=8, max_depth=16)
    assert directory.global_depth == 16 and sum(n for _, _, n in directory.buckets) == 96
    assert sum(2.0**-d for _, d, _ in directory.buckets) == 1.0  # the buckets cover every hash once
    assert all(n <= 8 or d == 16 for _, d, n in directory.buckets)


def test_exact_dedup_odd_tables(spark, none):
    assert exact_index.exact_groups(none).count() == 0 and exact_index.drop_copies(none).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "A"), (3, "a"), (3, "a"), (4, None), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_index.exact_groups(odd).collect())
    assert got == [(False, 2, 4, 2, False), (False, 3, 3, 4, True), (False, 3, 3, 4, True), (False, 4, 4, 2, True), (True, 0, 3, 4, False), (True, 0, 3, 4, False)]
    assert sorted(r.doc_id for r in exact_index.drop_copies(odd).collect()) == [3, 4]


# -- 10 ---------------------------------------------------------------------------------


def brute_repeats(rows, span):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for s in range(len(data) - span + 1):
            if data[s : s + span] in seen:
                mark[s : s + span] = b"\x01" * span
            seen.add(data[s : s + span])
        kept = bytes(c for c, m in zip(data, mark) if not m)
        spans = sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1]))
        out[doc_id] = (len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest())
    return out


def as_tuple(r):
    return r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256


def test_long_texts_are_read_in_stretches(monkeypatch):
    """Every window start belongs to one anchor, however a text is cut."""
    rng = np.random.default_rng(4)
    x = np.frombuffer(rng.integers(97, 101, 5000).astype(np.uint8).tobytes(), np.uint8)
    for limit in (1 << 23, 700):
        monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
        one = np.zeros(1, np.int64)
        got = np.concatenate(list(suffix_dedup._anchor_rows(x, np.array([len(x)]), one, one, 100)))
        starts = np.concatenate([np.arange(r["pos"], r["pos"] + r["more"] + 1) for r in got])
        assert sorted(starts.tolist()) == list(range(len(x) - 99))


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeats_match_brute_force(docs, rows, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r.doc_id: as_tuple(r) for r in suffix_dedup.remove_repeats(clashing(docs, "row", "data", "bucket")).collect()}
    expected = brute_repeats([r[:2] for r in rows], 100)
    assert got == expected and sum(v[1] for v in expected.values()) > 20_000


def test_multikey_order_sorts_rows():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, run = suffix_dedup.multikey_order(keys)
    ordered = keys[order]
    assert (ordered == keys[np.lexsort(keys.T[::-1])]).all()
    assert (np.diff(run) == (ordered[1:] != ordered[:-1]).any(axis=1)).all()


def test_repeats_odd_tables(spark, none):
    assert suffix_dedup.remove_repeats(none).count() == 0
    text = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(300))
    odd = spark.createDataFrame([(1, text), (1, text), (None, text), (2, None), (3, text[:99])], "doc_id long, text string")
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(odd).collect())
    inner = brute_repeats([(0, text)], 100)[0][1]
    assert got == [(False, 0, 300, inner), (True, 1, 300, 300), (True, 1, 300, 300), (True, 2, 0, 0), (True, 3, 99, 0)]


