"""Document fingerprints: an invertible Bloom lookup sketch of a text's paragraphs.

DataFrame functions only. A paragraph (line) is a 64-bit digest. A sketch has three tables of
cells; a digest is added to one cell of each, and a cell keeps a count, the exclusive-or of its
digests and the exclusive-or of their check sums. The fingerprint is a sketch of CELLS cells. Two
fingerprints subtract cell by cell, so that what both texts hold cancels out. Peeling recovers the
rest: a cell whose count is one and whose check sum fits holds a single digest, which is then taken
out of its other cells, and so on; all of that happens within the pair's row. Texts that differ in
more digests than their fingerprints can give back are retried with sketches of GROWTH times the
size and other cell addresses; the number of retries is not limited.

The larger sketches of all pairs are peeled together: cells are rows grouped under their document's
bucket, and every round is an explode and an aggregate on keys that extend the bucket, which needs
no shuffle. The texts are dealt out once, by ranges of doc_id, which also puts a document beside
its successor.

Defined results. A null text counts as empty; an empty text has no paragraph, and two texts
without paragraphs are alike (1.0). Repeated paragraphs count once. Rows that share a doc_id are
ordered by their text's hash; a null doc_id comes before any other. A lone document is its own
successor. An empty table gives an empty table. Texts are read whole; a long text's digests are one
array in its row. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, store

TABLES = 3
CELLS = 30  # of the sketch that is a text's fingerprint, a multiple of TABLES
PASSES = 12  # of peeling within a row; a fingerprint that needs more is retried larger
GROWTH = 4
NULL_ID = -(1 << 63)


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of a text's non-empty lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) > 0)
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def address(digest: Column, table: int, size: Column | int, salt: Column | int = 0) -> Column:
    """Cell of a digest in one of the tables of a sketch of `size` cells a table."""
    size = F.lit(size) if isinstance(size, int) else size
    salt = F.lit(salt) if isinstance(salt, int) else salt
    return F.pmod(F.xxhash64(digest, F.lit(table), salt), size.cast("long")) + table * size


def check_sum(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cell(n, x, s) -> Column:
    return F.struct(n.cast("int").alias("n"), x.cast("long").alias("x"), s.cast("long").alias("s"))


def _placed(digest: Column, n: Column) -> Column:
    """A digest with its sign, check sum and cells in a sketch of the fingerprint's size."""
    at = F.array(*[address(digest, t, CELLS // TABLES).cast("int") for t in range(TABLES)])
    return F.struct(n.cast("int").alias("n"), digest.alias("x"), check_sum(digest).alias("s"), at.alias("at"))


def _plus(cell: Column, e: Column, sign: int) -> Column:
    return _cell(cell["n"] + sign * e["n"], cell["x"].bitwiseXOR(e["x"]), cell["s"].bitwiseXOR(e["s"]))


def sketch(digests: Column) -> Column:
    """The fingerprint's cells: array<struct<n, x, s>>."""
    zero = _cell(F.lit(0), F.lit(0), F.lit(0))

    def cells(held: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda c: F.aggregate(F.filter(held, lambda e: F.array_contains(e["at"], c)), zero, lambda a, e: _plus(a, e, 1)))

    return _let(F.transform(digests, lambda d: _placed(d, F.lit(1))), cells)


def written(cells: Column) -> Column:
    """A sketch in hexadecimal: per cell the count (8 digits), digests and check sums (16 each)."""
    one = lambda c: F.concat(F.lpad(F.hex(c["n"]), 8, "0"), F.lpad(F.hex(c["x"]), 16, "0"), F.lpad(F.hex(c["s"]), 16, "0"))
    return F.lower(F.array_join(F.transform(cells, one), ""))


def _empty(cell: Column) -> Column:
    return (cell["n"] == 0) & (cell["x"] == 0) & (cell["s"] == 0)


def peeled(a: Column, b: Column) -> Column:
    """How many digests two sketches do not share, by subtracting and peeling; null if that fails."""
    differing = F.zip_with(a, b, lambda x, y: _plus(x, y, -1))
    state = lambda cells, found: F.struct(cells.alias("cells"), found.cast("int").alias("found"))

    def single(cells: Column) -> Column:
        pure = F.filter(cells, lambda c: (F.abs(c["n"]) == 1) & (check_sum(c["x"]) == c["s"]))
        # several cells may hold the same digest
        return F.transform(F.array_distinct(F.transform(pure, lambda c: F.struct(c["n"].alias("n"), c["x"].alias("x")))), lambda d: _placed(d["x"], d["n"]))

    def step(now: Column, _: Column) -> Column:
        taken = lambda d: F.transform(now["cells"], lambda c, i: F.aggregate(F.filter(d, lambda e: F.array_contains(e["at"], i)), c, lambda a, e: _plus(a, e, -1)))
        return _let(single(now["cells"]), lambda d: F.when(F.size(d) == 0, now).otherwise(state(taken(d), now["found"] + F.size(d))))

    finish = lambda now: F.when(F.forall(now["cells"], _empty), now["found"])
    return F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), state(differing, F.lit(0)), step, finish)


def _splitters(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 doc_ids that cut the documents into ranges of about equal size."""
    if n < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
    return sorted(set(found or []))


def _range_of(column: Column, splitters: list[int]) -> Column:
    """How many splitters lie below, by binary search."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(column <= splitters[middle], search(low, middle)).otherwise(search(middle + 1, high))

    return search(0, len(splitters))


def with_successor(docs: DataFrame, parts: int) -> DataFrame:
    """bucket, doc_id, text, next_text: each document beside the next by doc_id, in one shuffle.

    The first document of every range goes to the range before as well; there are as many as
    ranges, and they are the only rows that are copied.
    """
    splitters = _splitters(docs, parts)
    ranged = docs.withColumn("bucket", _range_of(F.col("doc_id"), splitters))
    # at most `parts` rows; a first row is told by doc_id, all rows that share it go along
    firsts = sorted((r["bucket"], r["first"]) for r in ranged.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect())
    if not firsts:
        return ranged.select("bucket", "doc_id", "text", F.col("text").alias("next_text"))
    heads = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}  # the first of all goes to the last range
    end = firsts[-1][0]
    known = F.element_at(F.create_map(*[F.lit(x) for pair in heads.items() for x in pair]).cast("map<bigint,int>"), F.col("doc_id"))
    before = F.when(F.col("doc_id").isin(*heads), F.struct(known.alias("bucket"), F.lit(1).alias("guest")))
    places = F.array_compact(F.array(F.struct(F.col("bucket").cast("int").alias("bucket"), F.lit(0).alias("guest")), before))
    placed = ranged.select(F.explode(places).alias("place"), "doc_id", "text").select("place.bucket", "place.guest", "doc_id", "text")
    order = Window.partitionBy("bucket").orderBy("guest", "doc_id", F.xxhash64("text"))
    return placed.withColumn("next_text", F.lead("text").over(order)).where("guest = 0").select("bucket", "doc_id", "text", F.coalesce("next_text", "text").alias("next_text"))


def edited(text: Column, following: Column) -> Column:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def _cells(pairs: DataFrame) -> DataFrame:
    """Subtracted sketches of pairs (bucket, id, pair, size, salt, a, b): their non-empty cells."""
    one = lambda x, sign: F.transform(x, lambda d: F.struct(d.alias("d"), F.lit(sign).alias("n")))
    digests = pairs.select("bucket", "id", "pair", "size", "salt", F.explode(F.concat(one(F.col("a"), 1), one(F.col("b"), -1))).alias("e"))
    spots = F.explode(F.array(*[address(F.col("e.d"), t, F.col("size"), F.col("salt")) for t in range(TABLES)]))
    rows = digests.select("bucket", "id", "pair", "size", "salt", spots.alias("cell"), "e.d", "e.n")
    summed = rows.groupBy("bucket", "id", "pair", "size", "salt", "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("d").alias("x"), F.bit_xor(check_sum(F.col("d"))).alias("s"))
    return summed.where("n <> 0 OR x <> 0 OR s <> 0").withColumn("found", F.lit(0))


def _peel(cells: DataFrame) -> DataFrame:
    """One round. A cell that holds one digest sends it to all of the digest's cells, itself among
    them; a cell takes each digest out once, however many of its cells sent it. `found` counts the
    digests that a cell of the first table gave up: each digest once per pair."""
    pure = (F.abs("n") == 1) & (check_sum(F.col("x")) == F.col("s"))
    own = F.struct(F.col("cell"), F.col("n"), F.col("x"), F.col("s"), F.col("found"), F.lit(False).alias("sent"))
    sent = [
        F.struct(address(F.col("x"), t, F.col("size"), F.col("salt")).alias("cell"), F.col("n"), F.col("x"), F.col("s"), F.lit(0).alias("found"), F.lit(True).alias("sent"))
        for t in range(TABLES)
    ]
    rows = cells.select("bucket", "id", "pair", "size", "salt", F.explode(F.when(pure, F.array(own, *sent)).otherwise(F.array(own))).alias("e"))
    # a digest that several cells sent is kept once per receiving cell
    keyed = rows.select("bucket", "id", "pair", "size", "salt", "e.*")
    once = keyed.groupBy("bucket", "id", "pair", "size", "salt", "cell", "sent", "x").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.max("found").alias("found"))
    sign = F.when(F.col("sent"), -F.col("n")).otherwise(F.col("n"))
    gone = F.when(F.col("sent") & (F.col("cell") < F.col("size")), 1).otherwise(0)
    after = once.groupBy("bucket", "id", "pair", "size", "salt", "cell").agg(
        F.sum(sign).cast("int").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("s").alias("s"), (F.sum("found") + F.sum(gone)).cast("int").alias("found")
    )
    return after.where("n <> 0 OR x <> 0 OR s <> 0 OR found > 0")


ROUNDS = 5  # between two looks at whether peeling goes on


def differences(pairs: DataFrame) -> DataFrame:
    """(id, pair, differing): how many digests each pair's texts do not share, by peeling.

    pairs: bucket, id, pair, a, b. The first sketches are GROWTH times a fingerprint, or larger
    where the texts' numbers of digests differ by more than such a sketch has cells. Equal pairs
    leave no cell, and so no row.
    """
    done, parts = None, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = F.abs(F.size("a") - F.size("b")) / F.lit(CELLS)
    power = F.greatest(F.lit(1), F.floor(F.log(float(GROWTH), F.greatest(least, F.lit(1.0))) + 1))
    left = pairs.withColumn("salt", power.cast("int"))
    held, again = Scratch("cells"), Scratch("retry")

    def kept(cells: DataFrame) -> DataFrame:
        """Written and dealt out by bucket again, so that the rounds to come need no shuffle."""
        return held.keep(cells).repartition(parts, "bucket")

    while True:
        sized = left.withColumn("size", (F.lit(CELLS // TABLES) * F.pow(F.lit(GROWTH), F.col("salt"))).cast("int"))
        cells = _cells(sized)
        while True:
            for _ in range(ROUNDS):
                cells = _peel(cells)
            cells = kept(cells)
            # a pair is stuck when a round changes none of its cells
            pure = cells.where("n <> 0 OR x <> 0 OR s <> 0").where((F.abs("n") == 1) & (check_sum(F.col("x")) == F.col("s")))
            if pure.isEmpty():
                break
        solved = cells.groupBy("bucket", "id", "pair").agg(F.sum("found").alias("differing"), F.max((F.col("n") != 0) | (F.col("x") != 0) | (F.col("s") != 0)).alias("open"))
        solved = store(solved, "solved")
        closed = solved.where("NOT open").select("id", "pair", "differing")
        done = closed if done is None else done.unionByName(closed)
        retry = solved.where("open").select("id", "pair")
        if retry.isEmpty():
            return done
        left = again.keep(left.join(retry, ["id", "pair"], "left_semi")).withColumn("salt", F.col("salt") + 1).repartition(parts, "bucket")


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    """Share of both texts' digests that they have in common."""
    both = n_a + n_b
    return F.when(both == 0, 1.0).otherwise((both - differing) / (both + differing))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_successor(plain, parts).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "bucket",
        F.monotonically_increasing_id().alias("id"),
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        paragraphs(F.col("text")).alias("own"),
        paragraphs(F.col("edit")).alias("changed"),
        paragraphs(F.col("next_text")).alias("following"),
    )
    rows = store(rows, "paragraphs")
    sides = ("changed", "following")
    base = rows.select("id", *[sketch(F.col(c)).alias(c) for c in ("own", *sides)])
    base = store(base.select("id", *[peeled(F.col("own"), F.col(c)).alias(f"d{p}") for p, c in enumerate(sides)]), "peeled")
    failed = base.where("d0 IS NULL OR d1 IS NULL").select("id", F.explode(F.array_compact(F.array(*[F.when(F.col(f"d{p}").isNull(), p) for p in (0, 1)]))).alias("pair"))
    failed = store(failed, "failed")
    if not failed.isEmpty():
        other = F.when(F.col("pair") == 0, F.col("changed")).otherwise(F.col("following"))
        pairs = rows.join(failed, "id").select("bucket", "id", "pair", F.col("own").alias("a"), other.alias("b")).repartition(parts, "bucket")
        found = differences(pairs).groupBy("id").agg(*[F.max(F.when(F.col("pair") == p, F.col("differing"))).alias(f"e{p}") for p in (0, 1)])
        base = base.join(found, "id", "left").select("id", *[F.coalesce(f"d{p}", f"e{p}", F.lit(0)).alias(f"d{p}") for p in (0, 1)])
    joined = rows.join(base, "id")
    near = lambda other, p: likeness(F.size("own"), F.size(other), F.col(f"d{p}"))
    return joined.select(
        F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        written(sketch(F.col("own"))).alias("fingerprint"),
        written(sketch(F.col("changed"))).alias("edited_fingerprint"),
        near("changed", 0).cast("double").alias("near_edited"),
        near("following", 1).cast("double").alias("near_next"),
    )
