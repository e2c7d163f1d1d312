"""Language identification with averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte trigrams and words. Embeddings and softmax are
trained by stochastic gradient descent in numpy on a bounded sample; probabilities are calibrated by a
temperature on rows left out of training, and a threshold from the same rows rejects unsure texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from koinea.llm import _kernel as K

UNKNOWN = "und"
_HALF = 1 << 14  # buckets of trigrams, and as many of words
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


@dataclass
class LanguageModel:
    """Class scores of every bucket (embedding times softmax weights), bias, temperature and threshold."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        return _softmax((means + self.bias) / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def buckets(data: np.ndarray) -> np.ndarray:
    """Buckets of the subwords of one text: letter trigrams with their borders, and words."""
    parts = [np.zeros(0, np.int64)]
    for lo in range(0, len(data), K.SEGMENT):
        folded = np.concatenate([[32], _FOLD[data[lo : lo + K.SEGMENT]], [32]]).astype(np.uint32)
        grams = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
        grams = grams[folded[1:-1] != 32]
        parts.append(((grams * np.uint32(2654435769)) >> np.uint32(18)).astype(np.int64))
    hashes, _ = K.words(data, np.array([0, len(data)]), _LETTERS)
    parts.append((hashes >> np.uint64(50)).astype(np.int64) + _HALF)
    return np.concatenate(parts)


_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = K.text_bytes(batch.column(1))
        ids, counts = [], []
        for d in range(batch.num_rows):
            found, n = np.unique(buckets(data[offsets[d] : offsets[d + 1]]), return_counts=True)
            ids.append(found)
            counts.append(n / max(1, n.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), K.list_array(ids, pa.int32()), K.list_array([c.astype(np.float32) for c in counts], pa.float32())],
            names=["lang", "ids", "shares"],
        )


#: Groups in which a language's documents are ranked first, so that no task sees all of a language.
SALTS = 64


def training_sample(docs: DataFrame, learn: Column, per_lang: int, most: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Features (lang, buckets, shares) of at most per_lang documents of each language, most in all, drawn by hash of doc_id from all with learn.

    Of rows that repeat a drawn doc_id, the first by language and text counts.
    """
    pool = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    draw = pool.select("doc_id", "lang").withColumn("_h", F.xxhash64("doc_id")).withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(SALTS)))
    for keys in (("lang", "_salt"), ("lang",)):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", "doc_id"))
        draw = draw.withColumn("_n", rank).where(F.col("_n") <= per_lang)
    picked = draw.orderBy("_n", "lang", "doc_id").limit(most).select(F.col("doc_id").alias("_picked")).distinct()
    # `most` ids at the most: small enough to broadcast
    rows = pool.join(F.broadcast(picked), F.col("doc_id") == F.col("_picked"), "left_semi").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("m"))
    found = rows.select("m.lang", "m.text").mapInArrow(_counter, "lang string, ids array<int>, shares array<float>").toArrow()
    out = []
    for batch in found.to_batches():
        langs, ids, shares = batch.columns
        at = ids.offsets.to_numpy()
        ids, shares = ids.values.to_numpy(), shares.values.to_numpy()
        out += [(lang, ids[a:b], shares[a:b]) for lang, a, b in zip(langs.to_pylist(), at, at[1:])]
    return out


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], *, width: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 5, confident: float = 0.5) -> LanguageModel:
    """A model from rows (lang, ids, shares); every fifth row of a fixed shuffle calibrates and trains nothing."""
    rows = sorted((r for r in rows if len(r[1])), key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))
    langs = sorted({r[0] for r in rows})
    draw = np.random.default_rng(seed)
    n_lang = max(1, len(langs))
    embed = draw.normal(0, 0.1, (2 * _HALF, width)).astype(np.float32)
    weights, bias = np.zeros((width, n_lang), np.float32), np.zeros(n_lang, np.float32)
    weights += draw.normal(0, 0.1, weights.shape).astype(np.float32)
    data = [(langs.index(r[0]), r[1].astype(np.int64), r[2].astype(np.float32)) for r in rows]
    order = draw.permutation(len(data))
    held, own = order[::5], np.array([i for k, i in enumerate(order) if k % 5])
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in draw.permutation(own):
            y, ids, shares = data[i]
            mean = shares @ embed[ids]
            error = _softmax(mean @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= step * error
            embed[ids] -= (step * 20) * shares[:, None] * back
    table = (embed @ weights).astype(np.float32)
    temperature, threshold = 1.0, confident
    if len(held) and len(langs) > 1:
        logits = np.array([data[i][2] @ table[data[i][1]] + bias for i in held])
        y = np.array([data[i][0] for i in held])
        at = np.arange(len(y))
        temperature = min((0.25 * 1.25**k for k in range(16)), key=lambda t: -np.log(_softmax(logits / t)[at, y] + 1e-12).mean())
        p = _softmax(logits / temperature)
        right = p.argmax(axis=1) == y
        if right.any():
            threshold = float(min(confident, np.quantile(p.max(axis=1)[right], 0.005)))
    return LanguageModel(langs, table, bias, float(temperature), threshold)


def _predictor(model: LanguageModel):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_lang = len(model.langs)
        for batch in batches:
            data, offsets = K.text_bytes(batch.column(1))
            n = batch.num_rows
            sums, counts = np.zeros((n, max(1, n_lang))), np.zeros(n)
            for i, j in K.doc_ranges(offsets, K.SEGMENT):
                lo, hi = int(offsets[i]), int(offsets[j])
                if j - i == 1:
                    found = buckets(data[lo:hi])
                    for k in range(0, len(found) if n_lang else 0, K.SEGMENT):
                        sums[i] += model.table[found[k : k + K.SEGMENT]].sum(axis=0, dtype=np.float64)
                    counts[i] = len(found)
                elif n_lang:
                    _add(model, data[lo:hi], offsets[i : j + 1] - lo, sums[i:j], counts[i:j])
            letters = np.array([_has_letter(data[offsets[d] : offsets[d + 1]]) for d in range(n)], bool)
            known = letters & (counts > 0) & (n_lang > 0)
            p = model.probabilities(sums / np.maximum(counts, 1)[:, None]) if n_lang else np.zeros((n, 1))
            best = p.argmax(axis=1)
            score = np.where(known, p[np.arange(n), best], 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([model.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(known & (score >= model.threshold)),
                ],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    return predict


def _add(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Sums for many short texts at once; each text stands between spaces."""
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 1, 32, np.uint32)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    place = np.arange(len(data)) + owner + 1
    padded[place] = _FOLD[data]
    keep = padded[place] != 32
    place, owner = place[keep], owner[keep]
    grams = (padded[place - 1] << np.uint32(16)) | (padded[place] << np.uint32(8)) | padded[place + 1]
    found = ((grams * np.uint32(2654435769)) >> np.uint32(18)).astype(np.int64)
    hashes, first = K.words(data, offsets, _LETTERS)
    words = (hashes >> np.uint64(50)).astype(np.int64) + _HALF
    word_owner = np.repeat(np.arange(n), np.diff(first))
    for buckets_, who in ((found, owner), (words, word_owner)):
        counts += np.bincount(who, minlength=n)
        for c in range(sums.shape[1]):
            sums[:, c] += np.bincount(who, weights=model.table[buckets_, c], minlength=n)


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _has_letter(data: np.ndarray) -> bool:
    for lo in range(0, len(data), 4096):
        if _ASCII_LETTER[data[lo : lo + 4096]].any():
            return True
    return bool((data >= 128).any() and _LETTER.search(data.tobytes().decode("utf-8", "replace")))


def held_out(doc_id: Column, parts: int, which: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``which`` modulo parts; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % parts == which, F.lit(False))


def identify(docs: DataFrame, *, learn: Column | None = None, per_lang: int = 700, most: int = 4000, seed: int = 5) -> DataFrame:
    """Languages of docs(doc_id, text, lang): rows (doc_id, lang_pred, score, accepted).

    Learns from rows with learn (all by default), a text and a lang: at most ``per_lang`` of a language
    and ``most`` in all, drawn by a hash of doc_id. Predicts every row from its whole text alone. score is
    the calibrated probability of lang_pred; accepted is false below the threshold that keeps 99.5 % of
    the calibration rows predicted right, 0.5 at most. Null, empty and letterless texts are `und` with
    score 0 and not accepted, and so is everything if nothing can be learned; of languages with equal
    scores the first by code points counts. Repeated rows are predicted alike; other columns are ignored; an empty table gives an empty result.
    """
    model = train(training_sample(docs, F.lit(True) if learn is None else learn, per_lang, most), seed=seed)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(_predictor(model), "doc_id long, lang_pred string, score double, accepted boolean")


def labelled(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred, score and accepted for every row; columns of docs by these names are replaced."""
    plain = docs.drop("lang_pred", "score", "accepted")
    at = plain.columns.index("text")
    predict = _predictor(model)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(at)], names=["doc_id", "text"])
            (found,) = predict(iter([own]))
            yield pa.RecordBatch.from_arrays([*batch.columns, *found.columns[1:]], names=[*batch.schema.names, *found.schema.names[1:]])

    kind = T.StructType([*plain.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return plain.mapInArrow(extend, kind)
