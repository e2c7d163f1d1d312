"""MinHash near-duplicate detection with sequential Bayesian verification.

Banded MinHash signatures give candidate pairs. Signatures of a pair are compared batch by batch,
and the pair is dropped as soon as the posterior probability that its similarity reaches the
threshold falls under the chosen miss probability. Survivors are verified on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koinea.llm import _kernel as K
from koinea.llm._tables import written
from koinea.llm.components import components

#: Buckets up to this size are compared pair by pair; members of larger ones in blocks of BLOCK documents.
SMALL_BUCKET = 9
BLOCK = 256

_SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, sig binary, bands array<long>"


def _signer(ngram: int, rows: int, bands: int, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = np.random.default_rng(seed)
        size = rows * bands
        factor = (draw.integers(1, 1 << 32, size, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
        shift = draw.integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
        fold = draw.integers(1, 1 << 63, (bands, rows), dtype=np.uint64) | np.uint64(1)
        salt = draw.integers(1, 1 << 63, bands, dtype=np.uint64)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.doc_ranges(offsets):
                lo = offsets[i]
                hashes, first = K.words(data[lo : offsets[j]], offsets[i : j + 1] - lo)
                n = np.zeros(j - i, np.int64)
                keys = np.zeros((2, j - i), np.uint64)
                low = np.full((j - i, size), 0xFFFFFFFF, np.uint32)
                for d in range(j - i):
                    own = K.shingles(hashes[first[d] : first[d + 1]], ngram)
                    n[d] = len(own)
                    if not len(own):
                        continue
                    keys[0, d] = own.sum(dtype=np.uint64)
                    keys[1, d] = K.mix(own).sum(dtype=np.uint64)
                    small = own.astype(np.uint32)
                    for k in range(0, len(small), 1024):
                        block = small[k : k + 1024, None] * factor
                        block += shift
                        np.minimum(low[d], block.min(axis=0), out=low[d])
                band = K.mix((low.reshape(j - i, bands, rows).astype(np.uint64) * fold).sum(axis=2, dtype=np.uint64) + salt)
                full = n > 0
                sig = low.astype(np.uint16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i).cast(pa.int64()),
                        pa.array(n),
                        pa.array(keys[0].view(np.int64)),
                        pa.array(keys[1].view(np.int64)),
                        pa.array([s.tobytes() for s in sig], pa.binary()),
                        K.list_array([b.view(np.int64) if f else np.zeros(0, np.int64) for b, f in zip(band, full, strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "n_shingles", "k1", "k2", "sig", "bands"],
                )

    return sign


def _set_maker(ngram: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            for i, j in K.doc_ranges(offsets):
                lo = offsets[i]
                hashes, first = K.words(data[lo : offsets[j]], offsets[i : j + 1] - lo)
                sets = [K.shingles(hashes[first[d] : first[d + 1]], ngram).view(np.int64) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i).cast(pa.int64()), K.list_array(sets, pa.int64())], names=["id", "items"]
                )

    return make


@lru_cache
def least_matches(size: int, batch: int, similarity: float, miss: float) -> tuple[tuple[int, int], ...]:
    """For each prefix of the signature, the fewest matches with which a pair stays.

    Under a uniform prior the posterior after m matches of n is Beta(m+1, n-m+1), and
    P(J >= t | m, n) = P(Binomial(n+1, t) <= m). A pair stays while this is at least ``miss``.
    """
    out = []
    for n in (*range(batch, size, batch), size):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def _pruner(steps: tuple[tuple[int, int], ...]):
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = steps[-1][0]
            sides = [
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, size) for c in (2, 3)
            ]
            left = np.arange(batch.num_rows)
            matches, done = np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                matches = matches + (sides[0][left, done:n] == sides[1][left, done:n]).sum(axis=1)
                stay = matches >= least
                left, matches, done = left[stay], matches[stay], n
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(left)) for c in (0, 1)], names=["a", "b"])

    return prune


def near_duplicates(
    docs: DataFrame,
    *,
    ngram: int = 5,
    similarity: tuple[int, int] = (80, 100),
    rows: int | None = None,
    bands: int | None = None,
    miss: float = 1e-6,
    batch: int = 30,
    seed: int = 20_240_101,
) -> DataFrame:
    """Near-duplicate classes of docs(doc_id, text): rows (doc_id, n_shingles, component_id, kept).

    Two documents are linked if the Jaccard similarity of their sets of ``ngram``-word shingles is at
    least similarity[0] / similarity[1]; words are runs without white space, A-Z count as a-z, and a
    text with fewer words is one shingle. ``component_id`` is the smallest doc_id reachable over
    links; ``kept`` marks that document. Other columns of docs are ignored.

    A pair whose similarity is exactly at a threshold t shares no band with probability
    (1 - t**rows)**bands, less for more similar pairs: 9e-6 at 0.85 for 30 bands of 7, 1e-6 at 0.8 for 45
    bands of 6. Without rows and bands these are taken, the latter under 0.85. ``miss`` bounds what each
    Bayesian batch loses.

    Equal shingle sets form one class before any pair is made. In each bucket, the pairs with one hub
    are verified first: the member that shares most buckets with others. Then only pairs between
    different components are left: small buckets make them one by one, large ones compare blocks of
    documents and return a spanning forest of the links found. No pair is given up for the size of
    its bucket.

    Null or blank text: n_shingles 0, linked with nothing, its own component. Null doc_id: the row is
    returned with its n_shingles, a null component and kept false. Rows that repeat a doc_id are one
    document and share its component; all of them are returned. An empty table gives an empty result.
    """
    up, down = similarity
    usual = (7, 30) if up >= 0.85 * down else (6, 45)
    rows, bands = rows or usual[0], bands or usual[1]
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = written(source.mapInArrow(_signer(ngram, rows, bands, seed), _SIGNED))
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("id"))
    distinct_sets = written(
        usable.select("k1", "k2", F.col("doc_id").alias("id"), "sig", "bands").join(classes, ["k1", "k2", "id"], "left_semi")
    )
    spots = distinct_sets.select("id", F.explode("bands").alias("bucket"))
    shared = (
        spots.groupBy("bucket")
        .agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n"))
        .where("lo < hi")
        .select("bucket", "n")
    )
    members = written(spots.join(shared, "bucket").distinct())
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    members = written(members.join(weight, "id").select("bucket", "id", F.struct((-F.col("weight")).alias("w"), "id").alias("place")))
    wanted = written(weight.select("id"))
    sets = written(
        source.join(wanted.withColumnRenamed("id", "doc_id").hint("shuffle_hash"), "doc_id", "left_semi")
        .mapInArrow(_set_maker(ngram), "id long, items array<long>")
        .dropDuplicates(["id"])
    )
    sigs = distinct_sets.join(wanted, "id", "left_semi").select("id", "sig").dropDuplicates(["id"])
    steps = least_matches(rows * bands, batch, up / down, miss)

    def verified(pairs: DataFrame) -> DataFrame:
        near = (
            pairs.join(sigs.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
            .join(sigs.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
            .select("a", "b", "sig_a", "sig_b")
            .mapInArrow(_pruner(steps), "a long, b long")
        )
        both = F.size(F.array_intersect("items_a", "items_b")).cast("long")
        return (
            written(near)
            .join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
            .where(both * F.lit(down) >= (F.size("items_a") + F.size("items_b") - both) * F.lit(up))
            .select("a", "b")
        )

    hubs = members.groupBy("bucket").agg(F.min("place").alias("hub"))
    star = members.join(hubs, "bucket").where("id <> hub.id").select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct()
    links = written(verified(star))
    found = written(components(links))
    live = written(
        members.select("bucket", "id")
        .join(found, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .join(sets.select("id", F.size("items").alias("n")), "id")
    )
    spread = live.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x < y and m > 2")
    small = live.join(spread.where(F.col("m") <= SMALL_BUCKET).select("bucket"), "bucket", "left_semi")
    other = small.select("bucket", F.col("id").alias("b"), F.col("component").alias("component_b"), F.col("n").alias("n_b"))
    alike = F.least("n", "n_b") * F.lit(down) >= F.greatest("n", "n_b") * F.lit(up)
    pairs = small.join(other, "bucket").where(F.col("id") > F.col("b")).where("component <> component_b").where(alike).select(F.col("id").alias("a"), "b").distinct()
    large = live.join(spread.where(F.col("m") > SMALL_BUCKET).select("bucket"), "bucket", "left_semi")
    more = verified(pairs).unionByName(_within_large(written(large), sigs, sets, steps, up, down))
    links = written(links.unionByName(more))
    found = written(components(links))
    # a repeated doc_id with different texts joins their classes
    alias = usable.select(F.col("doc_id"), "k1", "k2").join(classes, ["k1", "k2"]).groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi")
    if not alias.isEmpty():
        found = written(components(links.unionByName(alias.select(F.col("lo").alias("a"), F.col("hi").alias("b")))))
    resolved = classes.join(found, "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component"))
    return (
        signed.select("doc_id", "n_shingles", "k1", "k2")
        .join(resolved, ["k1", "k2"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
    )


def _within_large(live: DataFrame, sigs: DataFrame, sets: DataFrame, steps: tuple, up: int, down: int) -> DataFrame:
    """Links (a, b) that join different components among documents that share a large bucket.

    Documents that share large buckets, directly or over others, are one crowd. Those outside its
    largest component are compared with all of it, in blocks of BLOCK documents against BLOCK, so the
    work of a task is bounded. A block returns a spanning forest of its links, not its pairs.
    """
    hub = live.groupBy("bucket").agg(F.min("id").alias("b"))
    crowds = components(live.join(hub, "bucket").select(F.col("id").alias("a"), "b").distinct()).withColumnRenamed("component", "crowd")
    people = written(live.select("id", "component").distinct().join(crowds, "id"))
    parts = people.groupBy("crowd", "component").agg(F.count("*").alias("m"))
    shape = parts.groupBy("crowd").agg(F.sum("m").alias("everyone"), F.max("m").alias("most"), F.max_by("component", "m").alias("main"))
    people = people.join(shape, "crowd").join(sigs, "id").join(sets, "id")
    inner, outer = F.ceil((F.col("everyone") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("everyone") / BLOCK).cast("int")

    def spot(blocks):
        return F.pmod(F.xxhash64("id"), blocks).cast("int")

    def dealt(rows: DataFrame, own, other, asks: bool) -> DataFrame:
        mine, theirs = spot(own), F.explode(F.sequence(F.lit(0), other - 1))
        names = ("x", "y") if asks else ("y", "x")
        return rows.select("crowd", mine.alias(names[0]), theirs.alias(names[1]), F.lit(asks).alias("asks"), "id", "component", "sig", "items")

    asking = people.where("component <> main")
    both = dealt(asking, inner, outer, True).unionByName(dealt(people, outer, inner, False))
    return both.groupBy("crowd", "x", "y").applyInArrow(_block_linker(steps, up, down), "a long, b long")


def _block_linker(steps: tuple, up: int, down: int):
    size = steps[-1][0]

    def link(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        asks = np.array(block.column("asks").to_pylist(), bool)
        ids, component = block.column("id").to_numpy(), block.column("component").to_numpy()
        sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), np.uint16).reshape(len(ids), size)
        items = [np.asarray(x.values) for x in block.column("items")]
        rows, cols = np.flatnonzero(asks), np.flatnonzero(~asks)
        stay = component[rows][:, None] != component[cols][None, :]
        if len(rows) and len(cols) and stay.any():
            matches, done = np.zeros(stay.shape, np.int32), 0
            for n, least in steps:
                for k in range(done, n):
                    matches += sig[rows, k][:, None] == sig[cols, k][None, :]
                stay &= matches >= least
                done = n
                if not stay.any():
                    break
            stay = _confirmed(stay, [items[r] for r in rows], [items[c] for c in cols], up, down)
        parent = {int(c): int(c) for c in component}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        out: list[tuple[int, int]] = []
        for r, c in zip(*np.nonzero(stay), strict=True):
            p, q = root(int(component[rows[r]])), root(int(component[cols[c]]))
            if p != q:
                parent[p] = q
                out.append((int(ids[rows[r]]), int(ids[cols[c]])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return link


def _confirmed(stay: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], up: int, down: int) -> np.ndarray:
    """The pairs of stay whose full sets reach the similarity; overlaps are summed over slices of the tokens."""
    if not stay.any():
        return stay
    n_left, n_right = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    tokens = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate([n_left, n_right]))
    values, place = np.unique(tokens, return_inverse=True)
    overlap = np.zeros(stay.shape, np.float32)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for lo in range(0, len(values), 4096):
        i, j = np.searchsorted(place, [lo, lo + 4096])
        part = np.zeros((len(left) + len(right), min(4096, len(values) - lo)), np.float32)
        part[owner[i:j], place[i:j] - lo] = 1
        overlap += part[: len(left)] @ part[len(left) :].T
    both = overlap.astype(np.int64)
    return stay & (both * down >= (n_left[:, None] + n_right[None, :] - both) * up)
