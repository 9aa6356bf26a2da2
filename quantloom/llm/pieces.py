"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model file is a protobuf message; its wire format is read here: pieces with scores
and kinds, the trainer's model type and byte fallback, the normaliser's character map and
white-space flags. From these a tokenizer is rebuilt: the normaliser, the metaspace
marker, the unigram scores (or, for a BPE model, the merges that the scores imply) and
byte fallback. User-defined pieces are cut out first; control, unknown and unused pieces
are never met by a text. Batches are encoded by several threads. Ids are decoded by a table
of the pieces' bytes. Parity with the model's meaning is verified against the
sentencepiece library, which is required, and against the rebuilt tokenizer's decoder on a
probe set when a worker loads the model, and in the tests.

The model travels to the executors as bytes with the task; no file is opened there.

Defined cases: null text gives null ids, a null count and a null decoded text; empty text
gives no ids; texts of any length are encoded whole; repeated rows are encoded alike;
extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import small_batches

META = "▁"
#: Kinds of pieces and model types (fixed values of the model format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Texts of a worker's parity check: scripts, runs of spaces, markers, controls, bytes.
PROBES = (
    "Hello world", "  two  spaces ", "a\tb\nc\r\nd", "naïve café — “quoted”", "Größe ñandú œuvre", "日本語とкириллица",
    "🙂 emoji \U0001f9d1‍\U0001f680", "<s> </s> <unk>", "x" * 300, "▁lead▁▁", "1234567890 3.14", "", " ", "\x00\x01", "ﬁ ① Å",
)


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number, and integer, raw 4 or 8 bytes, or bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not part of a model file")
        yield tag >> 3, value


@dataclass
class Model:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    suffix: bool = False
    unknown_text: str = " \u2047 "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape_spaces: bool = True


def parse_model(data: bytes) -> Model:
    """Read a SentencePiece model file."""
    out = Model()
    for number, value in wire_fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in wire_fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in wire_fields(value):
                if n == 3:
                    out.model_type = v
                elif n == 24:
                    out.suffix = bool(v)
                elif n == 35:
                    out.byte_fallback = bool(v)
                elif n == 44:
                    out.unknown_text = v.decode("utf-8")
        elif number == 3:
            for n, v in wire_fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.remove_extra = bool(v)
                elif n == 5:
                    out.escape_spaces = bool(v)
    return out


def implied_merges(model: Model) -> list[tuple[str, str]]:
    """The merges of a BPE model: every split of a piece into two pieces, best score first."""
    ids = {p: k for k, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
    out = []
    for piece, k in ids.items():
        for cut_at in range(1, len(piece)):
            left, right = piece[:cut_at], piece[cut_at:]
            if left in ids and right in ids:
                out.append((-model.pieces[k][1], k, ids[left], ids[right], left, right))
    return [x[4:] for x in sorted(out)]


def build_tokenizer(model: Model):
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    if model.suffix or not model.escape_spaces:
        raise ValueError("white space as a suffix or unescaped is not supported")
    unk = next((k for k, p in enumerate(model.pieces) if p[2] == UNKNOWN), None)
    # no normalised text holds a space, so under such a name no text meets the piece; its id stays
    named = [p if kind in (NORMAL, BYTE) else f" {k} " for k, (p, _, kind) in enumerate(model.pieces)]
    if model.model_type == UNIGRAM:
        core = models.Unigram([(p, x[1]) for p, x in zip(named, model.pieces, strict=True)], unk, model.byte_fallback)
    elif model.model_type == BPE:
        merges = implied_merges(model)
        parts = {x for pair in merges for x in pair}
        core = models.BPE(
            {model.pieces[k][0] if model.pieces[k][0] in parts else p: k for k, p in enumerate(named)}, merges,
            unk_token=None if unk is None else named[unk], fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model type {model.model_type} is not supported")
    out = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(META))
    steps.append(normalizers.Replace(" ", META))
    out.normalizer = normalizers.Sequence(steps)
    # no piece goes on over a marker after other text: then words can be cut apart before
    # merging with the same result, and the word cache applies
    if all(META not in p.lstrip(META) for p, _, kind in model.pieces if kind in (NORMAL, USER)):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{META}+[^{META}]*"), "isolated")
    back = [decoders.Replace(META, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        back.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(back)
    return out


class Codec:
    """A rebuilt tokenizer with what batches need: a cache of units and a table for decoding.

    Where no piece goes on over a marker, a text is the sequence of its units (markers and
    what follows up to the next), and equal units have equal ids: they are encoded once.
    The cache starts anew when it is full, so its memory is bounded.
    """

    def __init__(self, data: bytes, cache_units: int = 300_000) -> None:
        self.model = parse_model(data)
        self.tokenizer = build_tokenizer(self.model)
        self.by_units = self.tokenizer.pre_tokenizer is not None
        self.units = re.compile(f"{META}+[^{META}]*|[^{META}]+")
        self.bare = build_tokenizer(self.model)
        self.bare.normalizer = normalizers.Sequence([])
        self.cache: dict[str, bytes] = {}
        self.most = cache_units
        #: User-defined pieces are cut out of the normalised text first, the longest at each place.
        user = sorted((p for p, _, kind in self.model.pieces if kind == USER and p), key=lambda p: (-len(p), p))
        self.user = re.compile("(" + "|".join(map(re.escape, user)) + ")") if user else None
        self.user_ids = {p: k for k, (p, _, kind) in enumerate(self.model.pieces) if kind == USER}
        said = {CONTROL: b"", UNKNOWN: self.model.unknown_text.encode()}
        spell = lambda p, kind: bytes([int(p[3:5], 16)]) if kind == BYTE else said[kind] if kind in said else p.replace(META, " ").encode()
        self.spelled = [spell(p, kind) for p, _, kind in self.model.pieces]
        self.unknown = {k for k, p in enumerate(self.model.pieces) if p[2] == UNKNOWN}

    def normalise(self, text: str) -> str:
        if self.model.charsmap or self.model.remove_extra:
            return self.tokenizer.normalizer.normalize_str(text)
        return (META if self.model.dummy_prefix and text else "") + text.replace(" ", META)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        pack = lambda ids: array("i", ids).tobytes()
        if self.user is not None:
            return [b"".join(self._around(self.normalise(t))) for t in texts]
        if not self.by_units:
            return [pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        split = [self.units.findall(self.normalise(t)) for t in texts]
        if len(self.cache) > self.most:
            self.cache = {}
        new = list({u for units in split for u in units}.difference(self.cache))
        for u, e in zip(new, self.bare.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.cache[u] = pack(e.ids)
        return [b"".join(map(self.cache.__getitem__, units)) for units in split]

    def _around(self, text: str) -> Iterator[bytes]:
        """Ids of a normalised text, piece by piece around the user-defined ones."""
        parts = self.user.split(text)
        plain = iter(self.bare.encode_batch_fast([p for p in parts[::2] if p], add_special_tokens=False))
        for k, p in enumerate(parts):
            if k % 2:
                yield array("i", [self.user_ids[p]]).tobytes()
            elif p:
                yield array("i", next(plain).ids).tobytes()

    def decode(self, packed: list[bytes]) -> list[str]:
        """Texts of packed ids; bytes that are no UTF-8 become replacement marks."""
        spelled, unknown, out = self.spelled, self.unknown, []
        for p in packed:
            ids = array("i")
            ids.frombytes(p)
            text = b"".join(map(spelled.__getitem__, ids)).decode("utf-8", "replace")
            # the marker before the text is no part of it; an unknown piece's own space is
            if self.model.dummy_prefix and text[:1] == " " and next((k for k in ids if spelled[k]), None) not in unknown:
                text = text[1:]
            out.append(text)
        return out


_loaded: dict[str, Codec] = {}


def load(data: bytes, threads: int = 2, verify: bool = True) -> Codec:
    """The codec of a model, made and verified once per worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _loaded:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        made = Codec(data)
        if verify:
            truth = sentencepiece.SentencePieceProcessor(model_proto=data)
            for probe, packed in zip(PROBES, made.encode(list(PROBES)), strict=True):
                want = truth.encode(probe)
                back = made.decode([packed])[0]
                plain = not made.unknown.intersection(want)  # the library's decoder does not spell these
                if array("i", want).tobytes() != packed or back != truth.decode(want) or plain and back != made.tokenizer.decode(want, skip_special_tokens=False):
                    raise ValueError(f"the rebuilt tokenizer differs from the model on {probe!r}")
        _loaded[key] = made
    return _loaded[key]


def encode_decode(
    docs: DataFrame,
    model: bytes,
    text: str = "text",
    keep_text: bool = True,
    threads: int = 2,
    chunk: int = 64,
) -> DataFrame:
    """``docs`` with token_ids (array of int), n_tokens and decoded_ok: whether decoding
    the ids gives back the text exactly. Input columns of these names are replaced."""
    small_batches(docs.sparkSession)
    made = ("token_ids", "n_tokens", "decoded_ok")
    names = [c for c in docs.columns if c not in made]
    spread = docs.select(names)
    out_names = [c for c in names if keep_text or c != text]
    schema = ", ".join(
        [f"`{c}` {spread.schema[c].dataType.simpleString()}" for c in out_names]
        + ["token_ids array<int>", "n_tokens long", "decoded_ok boolean"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model, threads)
        for whole in batches:
            for at in range(0, whole.num_rows, chunk):
                batch = whole.slice(at, chunk)
                texts = batch.column(text).to_pylist()
                there = [k for k, t in enumerate(texts) if t is not None]
                ids = codec.encode([texts[k] for k in there])
                back = codec.decode(ids)
                ends, same, sizes = [0], [None] * len(texts), dict(zip(there, map(len, ids), strict=True))
                for k in range(len(texts)):
                    ends.append(ends[-1] + sizes.get(k, 0) // 4)
                for k, y in zip(there, back, strict=True):
                    same[k] = y == texts[k]
                none = pa.array([t is None for t in texts], pa.bool_())
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(ids))]), mask=none
                )
                counts = pa.array([sizes[k] // 4 if k in sizes else None for k in range(len(texts))], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in out_names], lists, counts, pa.array(same, pa.bool_())], [*out_names, *made]
                )

    return spread.mapInArrow(run, schema)


def read_model(spark, path: str) -> bytes:
    """The model file's bytes, by any path that Spark reads; a bare path is the driver's own file."""
    if "://" not in path and os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])

