"""Encoding of a corpus with a public byte-level BPE vocabulary, through a sentencepiece model made from it.

The model is serialised directly from the vocabulary: every token becomes a piece in which each byte is written as one
printable character, with its negative rank as the score, so that sentencepiece merges in the order of the ranks. The
normaliser leaves text as it is. Texts are split into pre-tokens by the vocabulary's public pattern; each pre-token is
encoded by itself, and ids are mapped back to bytes to decode.
"""

from __future__ import annotations

import base64
import functools
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Folder of the public vocabularies; a parameter of the queries.
TOKENIZERS = os.environ.get("ALMANAC_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public pre-token pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens kept per Python worker with their ids.
CACHE = 200_000


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def bpe_model(ranks: dict[bytes, int]) -> bytes:
    """A serialised sentencepiece BPE model whose piece ids are the ranks; the id after the last one is the unknown piece."""
    chars = byte_characters()
    size = max(ranks.values()) + 1
    pieces = [b""] * size
    for token, rank in ranks.items():
        pieces[rank] = "".join(chars[b] for b in token).encode()
    unused = 0
    out = bytearray()
    for rank, piece in enumerate(pieces):
        if piece:
            out += _field(1, _field(1, piece) + _field(2, float(-rank)))
        else:  # a gap in the ranks keeps its id by an unused piece
            out += _field(1, _field(1, f"⁇{unused}".encode()) + _field(2, float(-rank)) + _field(3, 5))
            unused += 1
    out += _field(1, _field(1, "⁇".encode()) + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size)
    trainer += b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes single texts with a serialised model."""

    def __init__(self, model: bytes, pattern: str = PATTERN):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.split = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.table = {b: c for b, c in enumerate(self.chars)}
        self.bytes = {c: b for b, c in enumerate(self.chars)}
        self.known: dict[str, list[int]] = {}

    def encode(self, text: str | None) -> list[int]:
        known, out = self.known, []
        for token in self.split(text or ""):
            ids = known.get(token)
            if ids is None:
                ids = self.processor.encode(token.encode("utf-8", "replace").decode("latin-1").translate(self.table))
                if len(token) <= 64:
                    if len(known) >= CACHE:
                        known.clear()
                    known[token] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        pieces = "".join(map(self.processor.id_to_piece, ids))
        return bytes(self.bytes[c] for c in pieces).decode("utf-8", "replace")


@functools.lru_cache(2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, ids)`` of every row, without special tokens and with the text unchanged.

    Null and empty texts give an empty list; a null key is kept; repeated rows give repeated rows; other columns are
    ignored. The model is read once on the driver and broadcast: its size is that of the vocabulary. Each text is
    encoded by itself where it is read, so nothing is shuffled.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(bpe_model(read_ranks(os.path.join(folder, vocabulary))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = codec(model.value).encode
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "ids": [encode(x if isinstance(x, str) else None) for x in pdf[text]]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(key, text)`` of every row: the text that its ids stand for, by the inverse mapping of pieces to bytes.

    Null and empty lists give an empty text; bytes that aren't UTF-8, as of a list cut inside a character, give the
    replacement character; an id outside the vocabulary is an error. Nothing is shuffled.
    """
    spark = encoded.sparkSession
    model = spark.sparkContext.broadcast(bpe_model(read_ranks(os.path.join(folder, vocabulary))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = codec(model.value).decode
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "text": [decode([int(k) for k in x]) if x is not None else "" for x in pdf[ids]]})

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInPandas(run, f"`{key}` {kind}, text string")
