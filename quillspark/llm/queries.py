"""The operators' queries with production parameters, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, chat, exact_index, licences, manifest, mixing, packing, paragraph_sketch, phrases, reputation, simhash, suffix_dedup, toxicity
from .common import ready, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(ready(spark), sf_dir)
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


@query(
    "op9_exact_dedup",
    """
    WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
         g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
    SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
    FROM n JOIN g USING (norm)
    """,
)
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_index.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), radius=4, width=4)
    return groups.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op4_best_fit_packing")
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    return packing.pack_documents(table(spark, sf_dir, "documents"), *paths, size=1024, end_id=2)


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), span=100).drop("kept")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), rows=4000)
    return toxicity.score(docs, model, threshold=0.3).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


PROBE = "</s>[INST] ok [/INST]"


def _chat_sql() -> str:
    """Digests straight from the turns; a backslash adds one character to the output, a broken
    control string two."""
    controls = "|".join(re.escape(c).replace("/", "/") for c in chat.CONTROLS)
    added = lambda x: f"length({x}) + len(regexp_extract_all({x}, '\\\\')) + 2 * len(regexp_extract_all({x}, '{controls}'))"
    marks = len(chat.OPEN) + len(chat.SAYS) + len(chat.END)
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum({marks} + {added("role")} + {added("text")})::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id
    """


@query("op2_chat_formatting", _chat_sql())
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(turns))


URL_RULES = [
    reputation.Rule("block", "com", "/en/"),
    reputation.Rule("allow", "example.com", "/en/7"),
    reputation.Rule("allow", "net", "/de/"),
    reputation.Rule("block", "example.net", "/de/8"),
    reputation.Rule("block", "org", "/es/"),
]


def _reputation_sql(times: float, z: float = 1.645) -> str:
    def shrunk(level: str, keys: str, above: str, p0: str) -> str:
        """A level's posteriors: the prior's strength by moments over its groups, centred on p0."""
        return f"""
        {level}_0 AS (SELECT {keys}, sum(k) AS k, sum(n) AS n, any_value(p0) AS p0 FROM (SELECT c.*, {p0} AS p0 FROM counts c {above}) GROUP BY {keys}),
        {level}_m AS (SELECT sum((k - n * p0) ** 2 - n * p0 * (1 - p0)) AS over, sum(n * (n - 1) * p0 * (1 - p0)) AS room FROM {level}_0),
        {level}_s AS (SELECT 1 / CASE WHEN coalesce(room, 0) = 0 THEN 0.5::DOUBLE ELSE least(0.9::DOUBLE, greatest(0.001::DOUBLE, over / room)) END - 1 AS strength FROM {level}_m),
        {level}_p AS (SELECT {keys}, p0 * strength + k AS a, (1 - p0) * strength + n - k AS b FROM {level}_0, {level}_s)"""

    two = "array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')"
    long_ = "(" + ", ".join(f"'{x}'" for x in reputation.LONG_SUFFIXES) + ")"
    rule = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r}={r.verdict}'"
        for r in sorted(URL_RULES, key=lambda r: (-len(r.host) - len(r.path), -len(r.host)))
    )
    return f"""
    WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
    pages_ AS (SELECT *, CASE WHEN {two} IN {long_} THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE {two} END AS domain, CASE WHEN {two} IN {long_} THEN {two} ELSE string_split(host, '.')[-1] END AS suffix FROM u),
    counts AS (SELECT suffix, domain, host, sum(1 - quality)::DOUBLE AS k, count(quality)::DOUBLE AS n FROM pages_ JOIN labels ON doc_id = page_id WHERE quality IS NOT NULL GROUP BY 1, 2, 3),
    corpus AS (SELECT coalesce(sum(k), 0) + 0.5::DOUBLE AS a, coalesce(sum(n) - sum(k), 0) + 0.5::DOUBLE AS b FROM counts),
    {shrunk("s", "suffix", "CROSS JOIN corpus", "corpus.a / (corpus.a + corpus.b)")},
    {shrunk("d", "suffix, domain", "JOIN s_p USING (suffix)", "s_p.a / (s_p.a + s_p.b)")},
    {shrunk("h", "suffix, domain, host", "JOIN d_p USING (suffix, domain)", "d_p.a / (d_p.a + d_p.b)")},
    j AS (SELECT p.page_id, p.host, path, CASE {rule} END AS r, coalesce(h.a, d.a, s.a, c.a) AS a, coalesce(h.b, d.b, s.b, c.b) AS b, {times}::DOUBLE * c.a / (c.a + c.b) AS most
          FROM pages_ p LEFT JOIN h_p h USING (host) LEFT JOIN d_p d ON d.domain = p.domain LEFT JOIN s_p s ON s.suffix = p.suffix CROSS JOIN corpus c)
    SELECT page_id, host, path, string_split(r, '=')[1] AS rule, coalesce(string_split(r, '=')[2], CASE WHEN a / (a + b) - {z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > most THEN 'block' ELSE 'allow' END) AS verdict FROM j
    """


BAD_TIMES = 1.5  # times the corpus's rate of bad pages that a host's lower bound must exceed


@query("op3_url_filters", _reputation_sql(BAD_TIMES))
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that carry a page's number are its outcome: low quality is a bad page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    outcomes = pages.join(labels, "page_id").select("url", "bad")
    return reputation.judge(pages, outcomes, URL_RULES, times=BAD_TIMES).select("page_id", "host", "path", "rule", "verdict")


@query("op7_document_fingerprints")
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.fingerprint_edits(table(spark, sf_dir, "documents"))


# Target marginals of the mixture: a number tempers a dimension's own token shares by that power.
MIX_TARGETS = {"source": 0.7, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": 0.5}
MIX_BUDGET = 0.6  # of all tokens, in expectation


@query("op8_mixing_sources")
def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), MIX_TARGETS, MIX_BUDGET)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


@query("op5_licence_scans")
def op5_licence_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), least=0.8)


# CRC-32 of a decimal number's characters, bit by bit; DuckDB has no function of that name
_CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [1000 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]))),
    lambda a, x: CASE WHEN x > 0 THEN xor(a, x - 1000) ELSE xor(a >> 1, 3988292384::UBIGINT * (a & 1)) END), 4294967295::UBIGINT)"""


def _manifest_sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode({c}::VARCHAR)) || ':' || {c} END"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def tree(name: str, base: str) -> str:
        """Levels of all trees, and each node's siblings to the left and the right."""
        side = lambda a, b: f"coalesce(string_agg(node, '') OVER (PARTITION BY key, lvl, pos // 3 ORDER BY pos ROWS BETWEEN {a} AND {b}), '')"
        return f"""
        {name} AS (SELECT key, 0 AS lvl, pos, node, n FROM ({base}) UNION ALL
                   SELECT key, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY key, lvl, pos // 3),
        {name}_s AS (SELECT key, lvl, pos, n, {side("UNBOUNDED PRECEDING", "1 PRECEDING")} AS l, {side("1 FOLLOWING", "UNBOUNDED FOLLOWING")} AS r FROM {name})"""

    def climb(name: str, base: str, tree: str) -> str:
        return f"""
        {name} AS ({base} UNION ALL SELECT c.id, c.key, c.lvl + 1, c.pos // 3, c.proof || l || r, sha256(l || c.node || r)
                   FROM {name} c JOIN {tree}_s s ON s.key = c.key AND s.lvl = c.lvl AND s.pos = c.pos WHERE s.n > 1)"""

    return f"""
    WITH RECURSIVE d AS (SELECT *, {leaf("text")} AS leaf, CASE WHEN {_CRC} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS changed,
                                CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key FROM documents),
    m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n FROM d),
    {tree("t", "SELECT key, pos, leaf AS node, n FROM m")},
    subs AS (SELECT key AS source, node, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
    {tree("g", "SELECT 0 AS key, pos, node, n FROM subs")},
    {climb("c", "SELECT doc_id AS id, key, 0 AS lvl, pos, '' AS proof, changed AS node FROM m", "t")},
    top AS (SELECT id, key, proof, node FROM c QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1),
    {climb("u", "SELECT id, 0 AS key, 0 AS lvl, subs.pos, proof, top.node FROM top JOIN subs ON subs.source = top.key", "g")},
    done AS (SELECT id, proof, node FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY lvl DESC) = 1)
    SELECT m.doc_id, leaf, subs.node AS subroot, r.node AS root, sha256(proof) AS proof_sha256, done.node AS folded_root, done.node = r.node AS verified
    FROM m JOIN done ON id = doc_id JOIN subs ON subs.source = m.key CROSS JOIN (SELECT node FROM g WHERE n = 1) r
    """


@query("op11_merkle_manifest", _manifest_sql())
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an even CRC-32 are found with their line feeds gone."""
    stripped = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest.manifest(table(spark, sf_dir, "documents"), tampered=stripped).drop("proof")


_PHRASES_SQL = """
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
    w AS (SELECT lang, row_number() OVER () AS id, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p),
    x AS (SELECT lang, id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
    y AS (SELECT lang, a, lead(a, 1) OVER v AS b, lead(a, 2) OVER v AS c, lead(a, 3) OVER v AS d, lead(a, 4) OVER v AS e FROM x WINDOW v AS (PARTITION BY id ORDER BY i)),
    g AS (SELECT lang, 1 AS k, a AS phrase FROM y UNION ALL SELECT lang, 2, concat_ws(' ', a, b) FROM y WHERE b IS NOT NULL UNION ALL SELECT lang, 3, concat_ws(' ', a, b, c) FROM y WHERE c IS NOT NULL
          UNION ALL SELECT lang, 4, concat_ws(' ', a, b, c, d) FROM y WHERE d IS NOT NULL UNION ALL SELECT lang, 5, concat_ws(' ', a, b, c, d, e) FROM y WHERE e IS NOT NULL),
    totals AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
    f AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS ws, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= 100),
    cuts AS (SELECT c.lang, c.phrase, c.a, x.k, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
             FROM f c JOIN range(1, 5) x(k) ON x.k < c.size JOIN totals USING (lang)
             JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:x.k], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[x.k + 1:], ' ')),
    best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT DISTINCT q.lang, array_to_string(q.ws[i.i:i.i + k.k - 1], ' ') AS phrase, q.a FROM f q, range(1, 5) i(i), range(2, 5) k(k) WHERE k.k < q.size AND i.i + k.k - 1 <= q.size),
    kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = b.lang AND i.phrase = b.phrase AND 100 * i.a >= 100 * b.a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score FROM kept QUALIFY rank <= 2000
    """


@query("op12_phrase_collocations", _PHRASES_SQL)
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), least=100, most=2000, covered=100)


_NEAR_SQL = """
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    x AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
    y AS (SELECT doc_id, a, lead(a, 1) OVER v AS b, lead(a, 2) OVER v AS c, lead(a, 3) OVER v AS d FROM x WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
    g AS MATERIALIZED (SELECT DISTINCT doc_id, concat_ws(' ', a, b, c, d) AS gram FROM y WHERE d IS NOT NULL UNION ALL SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 3),
    n AS MATERIALIZED (SELECT w.doc_id, count(gram) AS n FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY 1),
    p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    links AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
    reach AS (SELECT doc_id AS id, doc_id AS other FROM n UNION SELECT id, y FROM reach JOIN links ON x = other)
    SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM n JOIN reach ON id = doc_id GROUP BY doc_id
    """


@query("op13_minhash_near_dedup", _NEAR_SQL)
def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_groups(table(spark, sf_dir, "documents"), width=4, least=0.8)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
