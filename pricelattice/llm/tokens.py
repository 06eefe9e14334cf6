"""Encoding a corpus with a public byte-level BPE vocabulary.

Method: the vocabulary (ranks of byte strings) is serialised as a sentencepiece BPE model: every piece is the
byte string mapped to printable characters, scored by its negative rank, with identity normalisation. Texts are
cut into pre-tokens, each distinct pre-token of a batch is encoded once, and ids decode by the inverse mapping.

Scale: large inputs aren't shuffled, documents are encoded where they are read, whole, in Arrow batches; little data is
spread over all cores first. The model (a fixed
vocabulary, size-checked) is broadcast as bytes, so executors need no file.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pricelattice.session import spread

BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_VOCABULARY = 64 << 20  # bytes of vocabulary file that may be broadcast
# Fixed value: the pre-token pattern that the vocabulary was made with.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNKNOWN = "⁇unknown"


def byte_letters() -> list[str]:
    """A printable character for each byte: itself where printable in Latin-1, else the next free one from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


LETTERS = byte_letters()
_BYTES = {c: b for b, c in enumerate(LETTERS)}


def spell(data: bytes) -> str:
    return "".join(LETTERS[b] for b in data)


def unspell(text: str) -> bytes:
    return bytes(_BYTES[c] for c in text)


def parse_ranks(vocabulary: bytes) -> list[bytes]:
    """Byte strings by rank, from lines of base64 and rank; ranks must run from 0 without holes."""
    ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, vocabulary.splitlines())}
    return [ranks[k] for k in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _whole(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(pieces: list[bytes]) -> bytes:
    """A sentencepiece model file: BPE, piece k has id k and score -k, the unknown piece comes last."""
    normal, unknown, bpe = 1, 2, 2  # numbers of the public model format
    body = [_block(1, _block(1, spell(p).encode()) + b"\x15" + struct.pack("<f", -k) + _whole(3, normal)) for k, p in enumerate(pieces)]
    body.append(_block(1, _block(1, UNKNOWN.encode()) + b"\x15" + struct.pack("<f", -len(pieces)) + _whole(3, unknown)))
    absent = (1 << 64) - 1  # -1 as a varint: no such control piece
    trainer = _whole(3, bpe) + _whole(4, len(pieces) + 1) + _whole(40, len(pieces)) + _whole(41, absent) + _whole(42, absent) + _whole(43, absent) + _block(45, UNKNOWN.encode())
    normalizer = _block(1, b"identity") + _whole(3, 0) + _whole(4, 0) + _whole(5, 0)
    return b"".join(body) + _block(2, trainer) + _block(3, normalizer)


class ByteBpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        import sentencepiece

        self.pieces = parse_ranks(vocabulary)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.pieces))
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give the empty list. Lone surrogates become replacement characters."""
        cut = [self.cut(t.encode("utf-8", "surrogatepass").decode("utf-8", "replace")) if t else [] for t in texts]
        if len(self.known) > 500_000:
            self.known.clear()
        new = list({p for parts in cut for p in parts if p not in self.known})
        for k in range(0, len(new), 50_000):
            some = new[k : k + 50_000]
            self.known.update(zip(some, self.model.encode([spell(p.encode()) for p in some], out_type=int, num_threads=1)))
        known = self.known
        return [[i for p in parts for i in known[p]] for parts in cut]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.pieces[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[int, ByteBpe] = {}  # of the worker process, by broadcast


def encode_corpus(documents: DataFrame, vocabulary: str = BYTE_BPE_50K) -> DataFrame:
    """``(doc_id, ids array<int>)``, one row a document, texts taken as they are.

    Strings that look like special tokens are ordinary text. Null and empty texts give the empty list, a null
    doc_id stays null, repeated rows stay repeated, an empty table gives no rows.
    """
    with open(vocabulary, "rb") as file:
        data = file.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary exceeds {MAX_VOCABULARY} bytes")
    shared = documents.sparkSession.sparkContext.broadcast(data)
    key = hash(data)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(key)
        if encoder is None:
            encoder = _ENCODERS[key] = ByteBpe(shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                ids = encoder.encode_batch(part.column("text").to_pylist())
                yield pa.record_batch({"doc_id": part.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return spread(documents.select("doc_id", "text")).mapInArrow(encode, "doc_id long, ids array<int>")
