"""Byte-level BPE by sentencepiece: the model is serialised from the vocabulary's ranks alone.

Each byte has a printable stand-in, so a vocabulary entry is a piece of that many characters, scored by its negative rank: the best
scored merge is the lowest rank, as in the original. Pre-tokens are encoded one by one, and ids are decoded by the inverse table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame

from tessera.llm.common import batches, by_document

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A space with white space beside it or at an end of the text; a space without.
ODD_SPACE, LONE_SPACE = re.compile(r"\s | \s|^ | $"), re.compile(r"(?<=\S) (?=\S)")
#: Stretches whose ids a worker remembers; the memory is emptied when it is full.
REMEMBERED = 400_000


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where it is printable and no space, else one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: int | float | str | bytes) -> bytes:
    """A protocol buffer field: integer, float, or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece r + 1 is the vocabulary entry of rank r; piece 0 is the unknown one, which no byte needs."""
    symbols, entries = byte_symbols(), sorted(ranks.items(), key=lambda x: x[1])
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown)]
    pieces += [_field(1, "".join(symbols[b] for b in piece)) + _field(2, float(-rank)) + _field(3, normal) for piece, rank in entries]
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, 0) + _field(41, 2**64 - 1) + _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normaliser = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes whole texts. The vocabulary's ranks are 0 to n - 1."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        self.table = [piece for piece, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.whole = {piece.decode(): str(rank) for piece, rank in ranks.items() if self._text(piece)}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, str] = {}

    @staticmethod
    def _text(piece: bytes) -> bool:
        try:
            piece.decode()
        except UnicodeDecodeError:
            return False
        return True

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of stretches of text that begin and end where pre-tokens do."""
        split = {p: self.split(p) for p in pieces}
        ids: dict[str, str] = {}
        left = []
        for t in {t for ts in split.values() for t in ts}:
            if t in self.whole:  # an entry of the vocabulary is its own token
                ids[t] = self.whole[t]
            else:
                left.append(t)
        mapped = [t.encode("utf-8", "replace").decode("latin-1").translate(self.symbols) for t in left]
        for t, found in zip(left, self.model.encode(mapped, num_threads=1), strict=True):
            ids[t] = ",".join([str(i - 1) for i in found])
        for p, ts in split.items():
            self.known[p] = ",".join([ids[t] for t in ts])

    @staticmethod
    def stretches(text: str) -> list[str]:
        """No pre-token passes over a space that stands alone between other characters; the one after it begins with that space.
        So the stretches between such spaces can be split and merged each by itself."""
        pieces = LONE_SPACE.split(text) if ODD_SPACE.search(text) else text.split(" ")
        return [pieces[0], *[" " + p for p in pieces[1:]]] if text else []

    def encode(self, texts: list[str]) -> list[str]:
        """Ids of each text in decimal, joined by commas. Stretches seen before are looked up."""
        out = []
        for i in range(0, len(texts), 64):
            cut = [self.stretches(t) for t in texts[i : i + 64]]
            new = set().union(*cut).difference(self.known)
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = set().union(*cut)
            self.learn(new)
            known = self.known
            out += [",".join([known[p] for p in pieces]) for pieces in cut]
        return out

    def decode(self, ids: str) -> bytes:
        table = self.table
        return b"".join([table[int(i)] for i in ids.split(",")]) if ids else b""


def encoded(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, comma-joined), decoded (bytes) of every text; null counts as empty and has no tokens.

    path must be readable where tasks run, as the vocabulary of an installed package is. A very long pre-token is merged in
    n log n steps. Repeated rows and null ids come out like others.
    """
    vocabulary = path

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary or public_tokenizers.path(VOCABULARY), pattern)
        for rows in batches(frames):
            ids = codec.encode([t or "" for t in rows["text"]])
            n = [i.count(",") + 1 if i else 0 for i in ids]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_tokens": n, "ids": ids, "decoded": [codec.decode(i) for i in ids]})

    return by_document(docs.select("doc_id", "text"), run, "n_tokens long, ids string, decoded binary")


def query(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The digests of encoded(), made where the ids are, so that only they leave Python."""
    vocabulary = path

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = Codec(vocabulary or public_tokenizers.path(VOCABULARY), pattern)
        digest = lambda raw: hashlib.sha256(raw).hexdigest()
        for rows in batches(frames):
            out = []
            for doc, ids in zip(rows["doc_id"], codec.encode([t or "" for t in rows["text"]]), strict=True):
                out.append((doc, ids.count(",") + 1 if ids else 0, digest(ids.encode()), digest(codec.decode(ids))))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return by_document(docs.select("doc_id", "text"), run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
