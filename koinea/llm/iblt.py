"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text's paragraph digests go to cells that hold a count, the digests' exclusive or and that of their
checks. Two versions' cells subtract; cells with one digest left give it up, which frees others. If
peeling ends with cells that are not empty, it is tried again larger: the digests of that sketch are
dealt to four sketches of the same size by further bits of their checks, and so on for those that fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koinea.llm._tables import numbered

#: Cells of one sketch: three parts of eight, a digest has one cell in each.
CELLS, PART = 24, 8
#: How often a sketch that does not peel is parted in four: 4**18 sketches at the most.
LEVELS = 18
ROUNDS = 6
#: Paragraphs: lines, long ones cut after a sentence's end behind 100 characters or after the word at 300.
PARAGRAPH = r"[^\n]{100,300}?[.!?]+(?=[ \t\n])|[^\n]{300}[^ \t\n]*|[^\n]+"
_SALT = 7_046_029_254_386_353_131
_KEYS = "array<struct<k:bigint,h:bigint>>"


def digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs without their outer spaces, blank ones left out."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.trim(p)), lambda p: p != "")
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def checked(keys: Column) -> Column:
    """Structs of digest k and check h."""
    return F.transform(keys, lambda k: F.struct(k.alias("k"), F.xxhash64(k, F.lit(_SALT)).alias("h")))


def _spot(h: Column, j: int) -> Column:
    """The digest's cell in part j."""
    return F.shiftrightunsigned(h, 8 * j).bitwiseAND(F.lit(PART - 1).cast("long"))


def _bits(h: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, by)


def _cell(n: Column, k: Column, h: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), h.cast("long").alias("h"))


def table(keys: Column) -> Column:
    """The cells of one sketch: how many digests, and the exclusive or of digests and of checks."""
    empty = _cell(F.lit(0), F.lit(0), F.lit(0))

    def part(j: int) -> Column:
        def cell(i: Column) -> Column:
            own = F.filter(keys, lambda x: _spot(x["h"], j) == i)
            return F.aggregate(own, empty, lambda s, x: _cell(s["n"] + 1, s["k"].bitwiseXOR(x["k"]), s["h"].bitwiseXOR(x["h"])))

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(PART - 1).cast("long")), cell)

    return F.concat(*[part(j) for j in range(CELLS // PART)])


def subtract(a: Column, b: Column) -> Column:
    """Cells of a minus cells of b."""
    return F.zip_with(a, b, lambda x, y: _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["h"].bitwiseXOR(y["h"])))


def peel(cells: Column) -> Column:
    """Digests that one side alone has, n being 1 or -1 for the side; null if cells are left over."""
    kind = "struct<cells:array<struct<n:int,k:bigint,h:bigint>>,found:array<struct<n:int,k:bigint,h:bigint>>>"
    start = F.struct(cells.alias("cells"), F.array().alias("found")).cast(kind)

    def ready(c: Column) -> Column:
        return (F.abs(c["n"]) == 1) & (F.xxhash64(c["k"], F.lit(_SALT)) == c["h"])

    def without(state: Column, pure: Column) -> Column:
        def left(c: Column, i: Column) -> Column:
            at = (i % PART).cast("long")
            bits = F.shiftright(i, 3) * 8  # cell i is in part i / 8, whose spot is in these bits of the check
            own = F.filter(pure, lambda x: _bits(x["h"], bits).bitwiseAND(F.lit(PART - 1).cast("long")) == at)
            return F.aggregate(own, c, lambda s, x: _cell(s["n"] - x["n"], s["k"].bitwiseXOR(x["k"]), s["h"].bitwiseXOR(x["h"])))

        freed = F.transform(state["cells"], left)
        return F.when(F.size(pure) == 0, state).otherwise(F.struct(freed.alias("cells"), F.concat(state["found"], pure).alias("found")))

    def step(state: Column, _: Column) -> Column:
        return F.aggregate(F.array(F.array_distinct(F.filter(state["cells"], ready))), state, without)

    def finish(state: Column) -> Column:
        return F.when(~F.exists(state["cells"], lambda c: (c["n"] != 0) | (c["k"] != 0)), state["found"])

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, finish)


def _parted(pairs: Column, level: Column) -> Column:
    """Pairs of digest lists, each in four by two bits of the checks."""
    bits = F.lit(24) + level * 2

    def four(p: Column) -> Column:
        def part(x: Column, q: Column) -> Column:
            return F.filter(x, lambda s: _bits(s["h"], bits).bitwiseAND(F.lit(3).cast("long")) == q)

        return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")), lambda q: F.struct(part(p["x"], q).alias("x"), part(p["y"], q).alias("y")))

    return F.flatten(F.transform(pairs, four))


def first_difference(a: Column, b: Column, cells_a: Column, cells_b: Column) -> Column:
    """How many digests one of two lists has alone, from their sketches; null if these do not peel."""
    return F.when(F.abs(F.size(a) - F.size(b)) <= CELLS, F.array_size(peel(subtract(cells_a, cells_b))))


def larger_difference(a: Column, b: Column) -> Column:
    """How many digests one of two lists has alone, from the smallest sketches that peel, four at least.

    Pairs whose counts differ by more than the cells cannot peel and are parted without a try. What is
    left after the last parting, digests with equal checks, counts as different.
    """
    state = f"struct<todo:array<struct<x:{_KEYS},y:{_KEYS}>>,n:int>"
    start = F.struct(_parted(F.array(F.struct(a.alias("x"), b.alias("y"))), F.lit(0)).alias("todo"), F.lit(0).alias("n")).cast(state)

    def tried(p: Column) -> Column:
        alone = first_difference(p["x"], p["y"], table(p["x"]), table(p["y"]))
        found = F.when((F.size(p["x"]) == 0) | (F.size(p["y"]) == 0), F.size(p["x"]) + F.size(p["y"])).otherwise(alone)
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), found.alias("d"))

    def step(s: Column, level: Column) -> Column:
        def after(s: Column, done: Column) -> Column:
            n = F.aggregate(done, s["n"], lambda t, p: t + F.coalesce(p["d"], F.lit(0)))
            failed = F.transform(F.filter(done, lambda p: p["d"].isNull()), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
            return F.struct(_parted(failed, level).alias("todo"), n.alias("n"))

        return F.when(F.size(s["todo"]) == 0, s).otherwise(F.aggregate(F.array(F.transform(s["todo"], tried)), s, after))

    def finish(s: Column) -> Column:
        return F.aggregate(s["todo"], s["n"], lambda t, p: t + F.size(p["x"]) + F.size(p["y"]))

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, step, finish)


def likeness(a: Column, b: Column, delta: Column) -> Column:
    """Jaccard likeness of two digest lists that differ in delta digests; 1 for two empty ones."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise((total - delta) / (total + delta))


def fingerprint(cells: Column) -> Column:
    """The cells of one sketch as text: count, digest and check of each."""
    return F.array_join(F.transform(cells, lambda c: F.concat_ws(":", c["n"].cast("string"), F.hex(c["k"]), F.hex(c["h"]))), " ")


def _doc_id(key: Column) -> Column:
    return F.when(~F.startswith(key, F.lit("n")), key.cast("long"))


def next_heads(source: DataFrame) -> DataFrame:
    """(prev_key, head, next_keys): of the document after each, as many first characters as half the former's, and its digests.

    The order is that of doc_id; after the last comes the first, and rows without doc_id have none. Ids are
    ranked by range partitions, so no task sees all of them, and of the next text only what is needed is
    moved.
    """
    sized = source.select(_doc_id(F.col("key")).alias("doc_id"), F.length("text").alias("n")).where("doc_id is not null")
    ids = sized.groupBy("doc_id").agg(F.max("n").alias("need"), F.count("*").alias("rows"))
    ranked = numbered(ids, "doc_id", name="place")
    total, most = ranked.agg(F.count("*"), F.max("rows")).first()
    after = ranked.select("doc_id", "place")
    links = ranked.select(F.col("doc_id").alias("prev_id"), "need", (F.when(F.col("place") + 1 == F.lit(total), 0).otherwise(F.col("place") + 1)).alias("place"))
    links = links.join(after, "place").select(F.col("prev_id").cast("string").alias("prev_key"), "need", F.col("doc_id").cast("string").alias("next_key"))
    heads = source.join(links.hint("shuffle_hash"), F.col("key") == F.col("next_key")).select(
        "prev_key", F.substr("text", F.lit(1), F.floor(F.col("need") / 2).cast("int")).alias("head"), digests(F.col("text")).alias("next_keys")
    )
    if (most or 0) > 1:  # a repeated id: the smallest head stands for it
        heads = heads.groupBy("prev_key").agg(F.min(F.struct("head", "next_keys")).alias("m")).select("prev_key", "m.*")
    return heads


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their edited texts, with likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of
    the next document's text by doc_id; the first follows the last. Rows: (doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs).

    A paragraph is a line, or a part of a long line (see PARAGRAPH), without its outer spaces; paragraphs
    count once and blank ones not at all. A fingerprint is the sketch of all paragraph digests; equal
    texts have equal ones. near_edited and near_next are Jaccard likenesses of paragraph sets: the number
    of digests that one text alone has comes from subtracting and peeling sketches, larger ones where the
    fingerprints' own do not peel.

    Null text counts as empty; two empty texts are alike (1). A row without doc_id has no next document:
    nothing replaces its second half, and near_next is its likeness to an empty text. Rows that repeat a
    doc_id share the next document; of a next document that repeats, the smallest text counts (a tie of
    equal texts makes no difference). Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # never null, so that both joins can use one exchange; rows without doc_id are spread by their text
    key = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("n"), F.xxhash64(text).cast("string")))
    source = docs.select(key.alias("key"), text.alias("text"))
    none = F.array().cast("array<bigint>")
    joined = source.join(next_heads(source), F.col("key") == F.col("prev_key"), "left").withColumn("doc_id", _doc_id(F.col("key")))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr(F.coalesce("head", F.lit("")), F.lit(1), half))
    keyed = joined.select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), digests(F.col("text")).alias("keys"), F.coalesce("next_keys", none).alias("next_keys")
    ).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("edited")).alias("edited_keys"), "keys", "next_keys")
    keyed = keyed.select("doc_id", "n_chars", "edited_sha256", *[checked(F.col(c)).alias(c) for c in ("keys", "edited_keys", "next_keys")])
    sketched = keyed.select("*", *[table(F.col(c)).alias(f"{c}_cells") for c in ("keys", "edited_keys", "next_keys")])
    others = ("edited_keys", "next_keys")
    keys, cells = F.col("keys"), F.col("keys_cells")
    tried = sketched.select("*", *[first_difference(keys, F.col(c), cells, F.col(f"{c}_cells")).alias(f"{c}_first") for c in others])
    compared = tried.select("*", *[F.coalesce(F.col(f"{c}_first"), larger_difference(keys, F.col(c))).alias(f"{c}_delta") for c in others])
    return compared.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(cells).alias("fingerprint"),
        fingerprint(F.col("edited_keys_cells")).alias("edited_fingerprint"),
        likeness(keys, F.col("edited_keys"), F.col("edited_keys_delta")).alias("near_edited"),
        likeness(keys, F.col("next_keys"), F.col("next_keys_delta")).alias("near_next"),
        F.size("keys").cast("long").alias("n_paragraphs"),
    )
