"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, scores and byte fallback are
rebuilt from it. Batches are encoded by the library's own threads.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koinea.llm import _kernel as K

MARK = "▁"
THREADS = 2  # of the library in one Python worker, where the environment does not say
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"

# Fixed values of the public sentencepiece_model.proto: model types and piece types.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@dataclass
class PieceModel:
    """What of a SentencePiece model is needed to encode and decode."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + size]
            at += size
        yield tag >> 3, value


def parse_model(data: bytes) -> PieceModel:
    """The parts of a serialised ModelProto."""
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            model.pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.squeeze_spaces, model.escape_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
    return model


#: A word with the markers before it.
WORD = f"{MARK}*[^{MARK}]+|{MARK}+"


def words_stand_alone(model: PieceModel) -> bool:
    """Whether no piece has the marker after another character, so that no piece crosses the start of a marked word."""
    return not any(MARK in p[0].lstrip(MARK) for p in model.pieces if p[2] in (NORMAL, USER_DEFINED))


def build_tokenizer(model: PieceModel):
    """A tokenizers.Tokenizer with the same ids as the model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocabulary = {p[0]: i for i, p in enumerate(model.pieces)}
    unknown = model.pieces[model.unknown][0]
    if model.kind == BPE:
        engine = models.BPE(vocab=vocabulary, merges=_merges(model, vocabulary), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    elif model.kind == UNIGRAM:
        engine = models.Unigram([(p[0], p[1]) for p in model.pieces], unk_id=model.unknown, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(engine)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if words_stand_alone(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(WORD), "isolated")
    tokenizer.decoder = decoders.Sequence(
        [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        + ([decoders.Strip(content=" ", left=1)] if model.dummy_prefix else [])
    )
    return tokenizer


def _merges(model: PieceModel, vocabulary: dict[str, int]) -> list[tuple[str, str]]:
    """Merges of a BPE model: each split of a piece in two pieces, best score first."""
    found = []
    for i, (piece, score, kind) in enumerate(model.pieces):
        if kind not in (NORMAL, USER_DEFINED):
            continue
        for cut in range(1, len(piece)):
            left, right = vocabulary.get(piece[:cut]), vocabulary.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-score, i, left, right, piece[:cut], piece[cut:]))
    return [(x[4], x[5]) for x in sorted(found)]


class Codec:
    """A model's tokenizers and the bytes of its pieces.

    ``by_word``: no piece crosses words and nothing is normalised, so that the ids of a text whose spaces
    are single and inside are those of its words in order. ``quick`` encodes single words.
    """

    def __init__(self, model: PieceModel) -> None:
        self.model, self.quick = model, None
        self.by_word = words_stand_alone(model) and not model.charsmap and not model.squeeze_spaces and model.dummy_prefix and model.escape_spaces and model.byte_fallback
        if self.by_word:
            from tokenizers import pre_tokenizers

            self.quick = build_tokenizer(model)
            self.quick.normalizer = None
            self.quick.pre_tokenizer = pre_tokenizers.Metaspace(MARK, prepend_scheme="always", split=True)
        self.is_byte = np.array([p[2] == BYTE for p in model.pieces])
        raw = [bytes([int(p[0][3:5], 16)]) if p[2] == BYTE else p[0].replace(MARK, " ").encode() for p in model.pieces]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    @cached_property
    def tokenizer(self):
        """The whole tokenizer; most texts of a model that goes by word do without it."""
        return build_tokenizer(self.model)

    def spelled(self, flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids spell, and the n+1 places where each list's begin; the space of the model's own prefix is left out."""
        sizes = self.sizes[flat]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = self.bytes[np.repeat(self.starts[flat] - ends[:-1], sizes) + np.arange(ends[-1])]
        edges = ends[at]
        if self.model.dummy_prefix and len(data):
            first = edges[:-1][np.diff(edges) > 0]
            first = first[data[first] == 32]
            stay = np.ones(len(data), bool)
            stay[first] = False
            data, edges = data[stay], edges - np.searchsorted(first, edges)
        return data, edges

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of lists of ids; lists whose bytes are no UTF-8 are decoded by the library."""
        data, edges = self.spelled(*_flat(ids))
        out = []
        for k, x in enumerate(ids):
            try:
                out.append(data[edges[k] : edges[k + 1]].tobytes().decode())
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(x, skip_special_tokens=False))
        return out

    def round_trips(self, flat: np.ndarray, at: np.ndarray, texts: pa.Array) -> np.ndarray:
        """Whether decoding each list of ids gives its text back."""
        data, edges = self.spelled(flat, at)
        raw, offsets = K.text_bytes(texts)
        same = np.diff(edges) == np.diff(offsets)
        if same.all() and np.array_equal(data, raw):
            return same
        for k in np.flatnonzero(same):
            same[k] = np.array_equal(data[edges[k] : edges[k + 1]], raw[offsets[k] : offsets[k + 1]])
        for k in np.flatnonzero(~same):
            same[k] = self.tokenizer.decode(flat[at[k] : at[k + 1]].tolist(), skip_special_tokens=False) == (texts[int(k)].as_py() or "")
        return same


def single_spaces(texts: pa.Array) -> np.ndarray:
    """Which texts have a word, only single spaces, all inside, and no marker."""
    bad = [pc.starts_with(texts, " "), pc.ends_with(texts, " "), pc.match_substring(texts, "  "), pc.match_substring(texts, MARK), pc.equal(texts, "")]
    plain = pc.invert(reduce(pc.or_, bad)).fill_null(False)
    return plain.to_numpy(zero_copy_only=False)


class Encoder:
    """Encodes texts in batches, and compares the ids with SentencePiece's own.

    Where the model goes by word, each distinct word is encoded once, by the library and by SentencePiece,
    and texts are put together from their words; any other text is encoded whole, by both.
    """

    WORDS = 1 << 17  # words whose ids are kept for the next batch

    def __init__(self, data: bytes, verify: bool = True) -> None:
        self.codec, self.check = codec(data), None
        if verify:
            import sentencepiece

            self.check = sentencepiece.SentencePieceProcessor(model_proto=data)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.at, self.same = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(0, bool)

    def _both(self, engine, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the texts, the n+1 places where each one's begin, and whether they are SentencePiece's."""
        flat, at = _flat([e.ids for e in engine.encode_batch_fast(texts, add_special_tokens=False)])
        same = np.ones(len(texts), bool)
        if self.check is not None:
            expected, edges = _flat(self.check.encode(texts, num_threads=1))
            same = np.diff(at) == np.diff(edges)
            if not same.all() or not np.array_equal(flat, expected):
                for k in np.flatnonzero(same):
                    same[k] = np.array_equal(flat[at[k] : at[k + 1]], expected[edges[k] : edges[k + 1]])
        return flat, at, same

    def _places(self, words: list[str]) -> np.ndarray:
        """Where distinct words' ids are kept; words not seen before are encoded."""
        fresh = [w for w in words if w not in self.place]
        if fresh:
            flat, at, same = self._both(self.codec.quick, fresh)
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.at = np.concatenate([self.at, at[1:] + self.at[-1]])
            self.flat, self.same = np.concatenate([self.flat, flat]), np.concatenate([self.same, same])
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, the n+1 places where each text's begin, and whether they are SentencePiece's."""
        plain = single_spaces(texts) if self.codec.by_word else np.zeros(len(texts), bool)
        same, sizes = np.ones(len(texts), bool), np.zeros(len(texts), np.int64)
        whole = [texts[int(k)].as_py() or "" for k in np.flatnonzero(~plain)]
        if any(whole):
            flat, at, same[~plain] = self._both(self.codec.tokenizer, whole)
        else:
            flat, at = np.zeros(0, np.int32), np.zeros(len(whole) + 1, np.int32)
        sizes[~plain] = np.diff(at)
        if not plain.any():
            return flat, at, same
        if len(self.place) > self.WORDS:
            self._clear()
        split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        words = split.flatten().dictionary_encode()
        place = self._places(words.dictionary.to_pylist())[words.indices.to_numpy()]
        lo, n = self.at[place], self.at[place + 1] - self.at[place]
        ends = np.cumsum(n)
        own = self.flat[np.repeat(lo - (ends - n), n) + np.arange(ends[-1])]
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())[:-1]])
        same[plain] = np.logical_and.reduceat(self.same[place], first)
        sizes[plain] = np.add.reduceat(n, first)
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        if plain.all():
            return own, at, same
        out = np.empty(at[-1], np.int32)
        of = np.repeat(plain, sizes)
        out[of], out[~of] = own, flat
        return out, at, same


@lru_cache(maxsize=2)
def codec(data: bytes) -> Codec:
    return Codec(parse_model(data))


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and the n+1 places where each list begins."""
    at = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=at[1:])
    return np.fromiter(chain.from_iterable(ids), np.int32, at[-1]), at


def _marked(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each list."""
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[at])


def model_bytes(path: str = DEFAULT_MODEL) -> bytes:
    """The model file's bytes, read on the driver; executors get them with the task."""
    with open(path, "rb") as f:
        return f.read()


def _encoder(data: bytes, verify: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        encoder = Encoder(data, verify)
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                flat, at, same = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).cast(pa.int64()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                        pa.array(_marked(encoder.codec.is_byte[flat], at), pa.int64()),
                        pa.array(encoder.codec.round_trips(flat, at, texts)),
                        pa.array(same) if verify else pa.nulls(hi - lo, pa.bool_()),
                    ],
                    names=["doc_id", "ids", "n_byte_tokens", "round_trip", "parity"],
                )

    return encode


def _slices(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes each, or one longer text."""
    offsets = K.text_bytes(texts)[1]
    yield from K.doc_ranges(offsets, limit)


def encode(docs: DataFrame, *, model: bytes | None = None, verify: bool = True) -> DataFrame:
    """docs(doc_id, text) as token ids: rows (doc_id, ids, n_byte_tokens, round_trip, parity).

    Whole texts are encoded with the vocabulary's ids, without special tokens. round_trip: decoding
    gives the text back. parity: SentencePiece itself has the same ids (null without verify). Null and
    empty texts have no ids. Strings of special tokens in a text are ordinary text. Other columns are
    ignored; an empty table gives an empty result.
    """
    data = model_bytes() if model is None else model
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    kind = "doc_id long, ids array<int>, n_byte_tokens long, round_trip boolean, parity boolean"
    return source.mapInArrow(_encoder(data, verify), kind)


def decode(tokens: DataFrame, *, model: bytes | None = None) -> DataFrame:
    """tokens(doc_id, ids) as text: rows (doc_id, text); null ids decode to null."""
    data = model_bytes() if model is None else model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(data)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            back = own.decode([x or [] for x in ids])
            text = [None if x is None else t for x, t in zip(ids, back, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
