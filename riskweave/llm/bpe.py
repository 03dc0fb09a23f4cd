"""Byte-level BPE encoding and decoding through a sentencepiece model built from a rank file.

The rank file's byte strings become the pieces of a sentencepiece BPE model: each byte is written as one printable
character, a piece's score is its negative rank, and the normaliser is the identity.  No tokenizer is trained.
Every match of the pre-token pattern is encoded by itself; ids are decoded by looking up each id's bytes.

Defined results: a null text counts as empty (no ids, digests of no bytes); very long pre-tokens take the same path;
repeated rows each get a row, as do rows with a null id, which stays null; an empty table gives an empty table; columns
besides id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_ENTRIES, CACHE_CHARACTERS = 500_000, 48  # entries kept, and the longest pre-token among them: at most about 150 MB


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def byte_alphabet() -> list[str]:
    """One visible character for each byte: printable Latin-1 ones stand for themselves, the rest follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float | str) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    body = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def sentencepiece_model(ranks: dict[bytes, int]) -> bytes:
    """Serialised sentencepiece ModelProto whose ids are the ranks; one unknown piece follows the last of them."""
    alphabet = byte_alphabet()
    order = sorted(ranks, key=ranks.__getitem__)
    if [ranks[p] for p in order] != list(range(len(order))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold every single byte")
    normal, unknown, bpe = 1, 2, 2
    pieces = b"".join(_field(1, _field(1, "".join(alphabet[b] for b in piece)) + _field(2, -float(rank)) + _field(3, normal)) for rank, piece in enumerate(order))
    pieces += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(order) + 1) + _field(40, len(order)) + b"".join(_varint(n << 3) + _varint((1 << 64) - 1) for n in (41, 42, 43))
    normalizer = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + _field(2, trainer) + _field(3, normalizer)


def odd_characters(pattern: str, classes: tuple[str, ...] = (r"\p{L}", r"\p{N}", r"\s")) -> dict[str, str]:
    """For each class in the pattern, the characters that the regex module puts there and tiktoken's engine, of another Unicode version, doesn't, or the reverse."""
    import regex
    import tiktoken

    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    odd = {}
    for name in (c for c in classes if c in pattern):
        theirs = bytes(tiktoken.Encoding(name, pat_str=name, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)).decode()
        odd[name] = "".join(sorted(set(theirs) ^ set(regex.findall(name, every))))
    return odd


class Codec:
    """Encoder and decoder of one worker; encoded pre-tokens are kept up to a bound, which changes no result."""

    def __init__(self, model: bytes, pieces: list[bytes], pattern: str, odd: dict[str, str]):
        import regex
        import sentencepiece

        self._processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._table = str.maketrans(dict(enumerate(byte_alphabet())))
        self._find = regex.compile(pattern).findall
        self._odd = frozenset("".join(odd.values()))
        for name, characters in odd.items():
            if characters:  # set difference where the class stands alone or within brackets
                pattern = pattern.replace(name, f"[{name}~~[{regex.escape(characters)}]]")
        self._find_exact = regex.compile(pattern, regex.V1).findall
        self._pieces = pieces
        self._whole = {piece: struct.pack("<I", i) for i, piece in enumerate(pieces)}
        self._memo: dict[str, bytes] = {}

    def _encode_words(self, words: list[str]) -> list[bytes]:
        raw = [word.encode() for word in words]
        found = [self._whole.get(r) for r in raw]
        rest = [i for i, known in enumerate(found) if known is None]
        encoded = self._processor.encode([raw[i].decode("latin-1").translate(self._table) for i in rest], out_type=int, num_threads=1)
        for i, ids in zip(rest, encoded, strict=True):
            found[i] = struct.pack(f"<{len(ids)}I", *ids)
        return found  # type: ignore[return-value]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        memo, words = self._memo, self._find(text)
        if missing := list(set(words).difference(memo)):
            if not self._odd.isdisjoint("".join(missing)):
                return b"".join(self._encode_words(self._find_exact(text)))
            if len(memo) + len(missing) > CACHE_ENTRIES:
                memo.clear()
                missing = list(set(words))
            encoded = dict(zip(missing, self._encode_words(missing), strict=True))
            if max(map(len, missing)) > CACHE_CHARACTERS:
                memo.update((w, ids) for w, ids in encoded.items() if len(w) <= CACHE_CHARACTERS)
                return b"".join([memo[w] if w in memo else encoded[w] for w in words])
            memo.update(encoded)
        return b"".join([memo[word] for word in words])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self._pieces.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text: id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (binary) and decoded (binary)."""
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((sentencepiece_model(ranks), sorted(ranks, key=ranks.__getitem__), pattern, odd_characters(pattern)))
    fields = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                rows: list[list] = [[] for _ in range(5 if with_ids else 3)]
                for text in part.column(1).to_pylist():
                    ids = codec.encode(text or "")
                    decoded = codec.decode(ids)
                    for out, value in zip(rows, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids, decoded), strict=False):
                        out.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                arrays = [part.column(0), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=False))]
                yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).mapInArrow(run, fields + ", ids binary, decoded binary" * with_ids)
