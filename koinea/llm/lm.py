"""Language-model scoring by deleted interpolation.

Bigram, unigram and uniform estimates are mixed by weights for each bucket of context frequency. The
weights are learned by expectation-maximisation on documents deleted from the counts.

Counts move in blocks of text: a block asks for the counts of its distinct n-grams, every n-gram's
requests meet in one place that adds them up, and the answers go back to the block. So a hot n-gram
costs one row of one request for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koinea.llm import _kernel as K
from koinea.llm._tables import written
from koinea.llm.langid import held_out

BLOCK_BYTES = 12 << 20
BUCKETS = 40
_STEPS, _LEVELS = 8, 400  # log2 steps and levels of the histogram that EM works on
_START, _END = np.uint64(0x51A7), np.uint64(0xE4D)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

_BLOCK = "block long, vocab binary, " + ", ".join(f"ids{k} binary, flags{k} binary, sizes{k} binary, tokens{k} binary" for k in (0, 1))


def _put(x: np.ndarray) -> bytes:
    """An array as bytes: its values' bytes by place, compressed."""
    x = np.ascontiguousarray(x)
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def _get(data: bytes, kind) -> np.ndarray:
    size, item = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(item, size // item).T).view(kind).ravel()


def _put_sorted(x: np.ndarray) -> bytes:
    return _put(np.diff(x, prepend=np.uint64(0)))


def _get_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_get(data, np.uint64), dtype=np.uint64)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    for n in range(batch.num_rows):
        yield batch.slice(n, 1).to_pylist()[0]


def _bigrams(hashes: np.ndarray, previous: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return K.mix(hashes[previous] * _A + hashes[tokens] * _B)


def _previous(tokens: np.ndarray, sizes: np.ndarray, start: int) -> np.ndarray:
    """The token before each token; the start symbol before a text's first."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    first = np.cumsum(sizes) - sizes
    out[first] = start
    return out


def _packer(size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of tokenised documents: kind 0 is kept in the counts or held out, kind 1 is deleted."""
        serial, held, total = TaskContext.get().partitionId() << 32, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal serial, total
            ids, flags, sizes, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
            vocab, tokens = np.unique(np.concatenate([hashes, [_START]]), return_inverse=True)
            tokens = tokens[:-1].astype(np.int32)
            columns = [pa.array([serial], pa.int64()), pa.array([_put_sorted(vocab)], pa.binary())]
            of = np.repeat(flags == 2, sizes)
            for deleted in (False, True):
                mine = (flags == 2) == deleted
                parts = (ids[mine], flags[mine], sizes[mine].astype(np.int32), tokens[of == deleted])
                columns += [pa.array([_put(x)], pa.binary()) for x in parts]
            serial, total = serial + 1, 0
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _BLOCK.split(", ")])

        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            row, flag = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int8)
            for i, j in K.doc_ranges(offsets):
                lo = offsets[i]
                hashes, first = K.words(data[lo : offsets[j]], offsets[i : j + 1] - lo)
                hashes = np.insert(hashes, first[1:], _END)
                held.append((row[i:j], flag[i:j], np.diff(first) + 1, hashes))
                total += int(offsets[j] - lo)
                if total >= size:
                    yield flush()
        if held:
            yield flush()

    return pack


def _asker(parts: int):
    """Requests (kind, part, block, keys, kept, deleted): kind 1 for words, 2 for bigrams, sorted by hash, dealt by its top bits.

    Kind 3 asks nothing: it has the places of a block's deleted tokens (context, bigram, word) for EM.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "part", "block", "keys", "kept", "deleted"]

        def request(kind: int, part: int, block: int, *payload: bytes) -> pa.RecordBatch:
            head = [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([block], pa.int64())]
            return pa.RecordBatch.from_arrays(head + [pa.array([x], pa.binary()) for x in payload], names=names)

        for row in (row for batch in batches for row in _rows(batch)):
            vocab, two = _get_sorted(row["vocab"]), [_tokens(row, k) for k in (0, 1)]
            start = int(np.searchsorted(vocab, _START))
            before = [_previous(tokens, sizes, start) for tokens, sizes, _ in two]
            keys, at = np.unique(np.concatenate([_bigrams(vocab, b, t[0]) for b, t in zip(before, two, strict=True)]), return_inverse=True)
            at = np.split(at, [len(before[0])])
            words, pairs = [], []
            for (tokens, sizes, flags), own in zip(two, at, strict=True):
                learn = np.repeat(flags != 1, sizes)
                words.append(np.bincount(tokens[learn], minlength=len(vocab)))
                words[-1][start] = (flags != 1).sum()  # as contexts, starts count once for each learned text
                pairs.append(np.bincount(own[learn], minlength=len(keys)))
            for kind, own, (kept, deleted) in ((1, vocab, words), (2, keys, pairs)):
                edges = [*np.searchsorted(own, _edges(parts)), len(own)]
                for p in range(parts):
                    s = slice(edges[p], edges[p + 1])
                    if edges[p] < edges[p + 1]:
                        yield request(kind, p, row["block"], _put_sorted(own[s]), _put(kept[s].astype(np.uint32)), _put(deleted[s].astype(np.uint32)))
            if len(at[1]):
                places = np.concatenate([before[1], at[1], two[1][0]]).astype(np.int32)
                yield request(3, row["block"] % parts, row["block"], b"", _put(places), b"")

    return ask


def _tokens(row: dict, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of kind k as places in the block's vocabulary, the texts' sizes, and their flags."""
    return _get(row[f"tokens{k}"], np.int32), _get(row[f"sizes{k}"], np.int32), _get(row[f"flags{k}"], np.int8)


def _edges(parts: int) -> np.ndarray:
    """The first hash of each part."""
    return np.array([(k << 64) // parts for k in range(parts)], np.uint64)


def _answer(group: pa.Table) -> pa.Table:
    """Adds up the requests of one part and answers each; block -1 holds the part's sums."""
    kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
    blocks = group.column("block").to_pylist()
    if kind == 3:
        answers = [(x, b"") for x in group.column("kept").to_pylist()]
    else:
        keys = [_get_sorted(x) for x in group.column("keys").to_pylist()]
        kept, deleted = (np.concatenate([_get(x, np.uint32) for x in group.column(c).to_pylist()]).astype(np.float64) for c in ("kept", "deleted"))
        values, at = np.unique(np.concatenate(keys), return_inverse=True)
        r, d = np.bincount(at, kept).astype(np.int64), np.bincount(at, deleted).astype(np.int64)
        real = values != _START
        stats = np.array([r[real].sum(), (r[real] > 0).sum(), (r + d)[real].sum(), ((r + d)[real] > 0).sum()], np.int64)
        spans = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
        answers = [(_put(r[s]), _put((r + d)[s])) for s in spans] + [(stats.tobytes(), b"")]
        blocks = [*blocks, -1]
    return pa.table(
        {
            "kind": pa.array([kind] * len(blocks), pa.int32()),
            "part": pa.array([part] * len(blocks), pa.int32()),
            "block": pa.array(blocks, pa.int64()),
            "kept": pa.array([a for a, _ in answers], pa.binary()),
            "total": pa.array([a for _, a in answers], pa.binary()),
        }
    )


_ANSWER = "kind int, part int, block long, kept binary, total binary"


def _counts(answers: pa.Table, kind: int, column: str) -> np.ndarray:
    kinds, parts = answers.column("kind").to_pylist(), answers.column("part").to_pylist()
    rows = sorted((p, n) for n, (k, p) in enumerate(zip(kinds, parts, strict=True)) if k == kind)
    return np.concatenate([np.zeros(0, np.int64), *[_get(answers.column(column)[n].as_py(), np.int64) for _, n in rows]])


def _bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.log2(np.maximum(context, 1)).astype(np.int64) + 1, 0)


def _level(p: np.ndarray) -> np.ndarray:
    """Index of a probability in the histogram; 0 for none."""
    return np.where(p > 0, np.clip((_LEVELS - 1 + np.log2(np.maximum(p, 1e-300)) * _STEPS).astype(np.int64), 1, _LEVELS - 1), 0)


def _histogram(n_kept: int):
    def make(answers: pa.Table) -> pa.Table:
        places = [x for k, x in zip(answers.column("kind").to_pylist(), answers.column("kept").to_pylist(), strict=True) if k == 3]
        found, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if places:
            before, pair, word = _get(places[0], np.int32).reshape(3, -1)
            words, pairs = _counts(answers, 1, "kept"), _counts(answers, 2, "kept")
            context = words[before]
            p2, p1 = pairs[pair] / np.maximum(context, 1), words[word] / max(1, n_kept)
            found, n = np.unique((_bucket(context) * _LEVELS + _level(p2)) * _LEVELS + _level(p1), return_counts=True)
        return pa.table({"cell": pa.array(found, pa.int64()), "n": pa.array(n, pa.int64())})

    return make


def fit_weights(cells: list[tuple[int, int]], vocabulary: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) by bucket from a histogram of estimates on deleted counts.

    Each bucket's likelihood carries 10 counts of an even mixture, so that rare buckets stay in range.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    if not cells:
        return weights
    cell, n = np.array(cells, np.int64).T
    bucket, l2, l1 = np.minimum(cell // _LEVELS**2, BUCKETS - 1), cell // _LEVELS % _LEVELS, cell % _LEVELS

    def value(level: np.ndarray) -> np.ndarray:
        return np.where(level > 0, 2.0 ** ((level + 0.5 - (_LEVELS - 1)) / _STEPS), 0.0)

    p = np.stack([np.minimum(value(l2), 1), np.minimum(value(l1), 1), np.full(len(cell), 1 / (vocabulary + 1))], axis=1)
    for _ in range(rounds):
        share = weights[bucket] * p
        share *= (n / share.sum(axis=1))[:, None]
        new = np.stack([np.bincount(bucket, share[:, k], BUCKETS) for k in range(3)], axis=1) + 10 / 3
        weights = new / new.sum(axis=1, keepdims=True)
    return weights


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scorer(weights: np.ndarray, n: int, v: int):
    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = []
        words, pairs = _counts(answers, 1, "total"), _counts(answers, 2, "total")
        for row in (row for batch in blocks.to_batches() for row in _rows(batch)):
            vocab, two = _get_sorted(row["vocab"]), [_tokens(row, k) for k in (0, 1)]
            start = int(np.searchsorted(vocab, _START))
            before = [_previous(tokens, sizes, start) for tokens, sizes, _ in two]
            _, at = np.unique(np.concatenate([_bigrams(vocab, b, t[0]) for b, t in zip(before, two, strict=True)]), return_inverse=True)
            for k, own in enumerate(np.split(at, [len(before[0])])):
                tokens, sizes, flags = two[k]
                if not len(sizes):
                    continue
                context, word = words[before[k]], words[tokens]
                w = weights[np.minimum(_bucket(context), BUCKETS - 1)]
                p = w[:, 0] * pairs[own] / np.maximum(context, 1) + w[:, 1] * word / max(1, n) + w[:, 2] / (v + 1)
                base = np.log10((word + 1) / (n + v + 1))
                first = np.cumsum(sizes) - sizes
                ids = _get(row[f"ids{k}"], np.int64)
                known = np.add.reduceat((word > 0).astype(np.int64), first)
                out.append([ids, flags == 1, sizes.astype(np.int64), known, np.full(len(ids), n), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first)])
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0)] * 7
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
        null = columns[0] == _NULL_ID
        if null.any():
            arrays[0] = pa.array(columns[0].astype(np.int64), pa.int64(), mask=null)
        return pa.table(dict(zip([c.split()[0] for c in _SCORES.split(", ")], arrays, strict=True)))

    return score


_NULL_ID = -(1 << 63)


def score_texts(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Log10 probabilities of docs(doc_id, text) under a bigram model learned from those not held out.

    Held out: crc32 of doc_id as text leaves 2 modulo 7. Of the rest, remainder 6 is deleted from the
    counts while the mixture weights are learned, and counted in the final model. Tokens: words without
    white space with A-Z as a-z, then one end. Rows: (doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score); base_score is the add-one unigram score.

    A null or empty text is one end token. A null doc_id is not held out. Repeated rows count and are
    scored as often as they stand. Without any training document all probability is uniform. Other
    columns are ignored; an empty table gives an empty result.
    """
    key = F.col("doc_id").cast("long")
    flag = F.when(held_out(F.col("doc_id"), 7, 2), 1).when(held_out(F.col("doc_id"), 7, 6), 2).otherwise(0)
    source = docs.select(F.coalesce(key, F.lit(_NULL_ID)).alias("doc_id"), F.col("text").cast("string"), flag.cast("int").alias("flag"))
    packed = written(source.mapInArrow(_packer(block_bytes), _BLOCK))
    n_blocks = packed.select("block").count()
    parts = max(4, n_blocks)
    asked = packed.mapInArrow(_asker(parts), "kind int, part int, block long, keys binary, kept binary, deleted binary")
    answers = written(asked.repartition(2 * parts, "kind", "part").groupBy("kind", "part").applyInArrow(_answer, _ANSWER))
    stats = np.zeros(4, np.int64)
    for r in answers.where("block = -1 and kind = 1").select("kept").collect():  # four sums for each part
        stats += np.frombuffer(r.kept, np.int64)
    n_kept, v_kept, n_all, v_all = (int(x) for x in stats)
    own = answers.where("block >= 0")
    deleted = own.select("kind", "part", "block", "kept").groupBy("block")
    # at most BUCKETS * _LEVELS**2 cells whatever the corpus, and far fewer in use
    cells = deleted.applyInArrow(_histogram(n_kept), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = fit_weights([(r.cell, r.n) for r in cells], v_kept)
    both = packed.groupBy("block").cogroup(own.where("kind < 3").select("kind", "part", "block", "total").groupBy("block"))
    return both.applyInArrow(_scorer(weights, n_all, v_all), _SCORES)
