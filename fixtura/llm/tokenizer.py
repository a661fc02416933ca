"""Token ids of a whole corpus by a public byte-level BPE vocabulary, with a SentencePiece model.

The model is written directly from the vocabulary's ranks: each token becomes a piece spelled in the
usual printable stand-ins for its bytes, scored by its negative rank, with identity normalisation, so
that SentencePiece merges in the order of the ranks. Texts are cut into pre-tokens by the
vocabulary's pattern and each distinct pre-token is encoded once per batch of work; `decode` is the
inverse mapping. Nothing is shuffled: documents are encoded where they are read.

Defined results: null and empty texts have the empty list; strings of special tokens are ordinary
text; every row of the input has a row, repeated ones too; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie unless a path is given.
VOCABULARY = os.path.join(os.environ.get("FIXTURA_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: Fixed value: the pattern that cuts a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern knows it.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Digits, or what else stands between white space and digits, with the white space before it. No
#: pre-token reaches over the end of such a piece, unless digits of two kinds meet, and a corpus has
#: few different ones, so that they are cut and encoded once.
_PIECES = re.compile(rf"[{_SPACE}]*[0-9]+|[{_SPACE}]*[^{_SPACE}0-9]+|[{_SPACE}]+").findall
CACHED = 400_000


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a vocabulary file (base64 token, rank per line), by rank."""
    with open(path, "rb") as lines:
        ranked = [(int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines)]
    ranked.sort()
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks are not 0, 1, 2, ...")
    return [token for _, token in ranked]


@lru_cache(1)
def byte_letters() -> str:
    """A printable character for each byte: itself where it is printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    kept = set(shown)
    return "".join(chr(b) if b in kept else chr(next(hidden)) for b in range(256))


def spell(data: bytes) -> str:
    letters = byte_letters()
    return "".join([letters[b] for b in data])


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _block(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """A serialised SentencePiece BPE model of a vocabulary; its unknown piece has the first free id."""
    pieces = [_block(1, _block(1, spell(t).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))) for rank, t in enumerate(tokens)]
    pieces.append(_block(1, _block(1, "<unk>".encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(pieces)) + _number(40, len(tokens))
    normaliser = _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(pieces) + _block(2, trainer) + _block(3, normaliser)


class Encoder:
    """Encodes and decodes by a vocabulary file."""

    def __init__(self, path: str = VOCABULARY) -> None:
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self._cut = regex.compile(PATTERN).findall
        self._odd_digits = regex.compile(r"(?V1)[\p{N}--[0-9]]").search
        self._known: dict[str, tuple[int, ...]] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._letters = {b: ord(c) for b, c in enumerate(byte_letters())}

    def _learn(self, words: list[str]) -> None:
        """Encodes pre-tokens that are not yet known."""
        # bytes read as Latin-1 are characters 0 to 255, which the table turns into their letters
        spelled = [w.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._letters) for w in words]
        for word, ids in zip(words, self._model.encode(spelled, num_threads=1), strict=True):
            self._known[word] = tuple(ids)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def _encode_pieces(self, pieces: list[str]) -> list[tuple[int, ...]]:
        cut = [self._cut(p) for p in pieces]
        known = self._known
        if new := list({w for words in cut for w in words if w not in known}):
            self._learn(new)
        return [tuple(chain.from_iterable([known[w] for w in words])) for words in cut]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        for kept in (self._known, self._pieces):
            if len(kept) > CACHED:
                kept.clear()
        kept, out = self._pieces, []
        for text in texts:
            pieces = [] if not text else [text] if not text.isascii() and self._odd_digits(text) else _PIECES(text)
            new = list(set(pieces).difference(kept))
            kept.update(zip(new, self._encode_pieces(new), strict=True))
            out.append(np.array(list(chain.from_iterable(map(kept.__getitem__, pieces))), np.int32))
            if len(pieces) == 1 and len(text) > 1000:
                del kept[pieces[0]]
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker, built once."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids): the ids of every document. The vocabulary file is sent to the executors."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(SparkFiles.get(name))
        for batch in batches:
            step, texts = 500, batch.column(1)
            for at in range(0, batch.num_rows, step):
                lists = own.encode_batch(texts.slice(at, step).to_pylist())
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.concatenate(lists) if lists else np.empty(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, step), ids], names=["doc_id", "ids"])

    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")
