"""Operator 11: byte-level BPE by a sentencepiece model serialised from the ranks, decoded by the inverse byte mapping."""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens whose ids a worker keeps, and the longest that it keeps; a full table is emptied and filled anew.
CACHED, CACHED_CHARS = 1 << 18, 64
#: Bytes of results that a worker gathers before it hands them on.
OUT_BYTES = 8 << 20
#: Characters up to here have the same classes in all versions of Unicode that the two pattern engines may follow.
FAR = re.compile("[^\x00-\u024f]")
#: A character that is no letter, number or space in any version: it stands in for characters that only the newer one knows.
STAND_IN = 0xE000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    """``token -> rank`` of a rank file: a line of base64 and a number for each token."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def byte_letters() -> str:
    """A printable character for each of the 256 bytes: itself if it is printable in Latin-1, else one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return "".join(chr(b if b in printable else next(other)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    """One field of a protocol buffer message: a number, or bytes with their length."""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece BPE model whose piece ``i`` is the token of rank ``i`` in byte letters, scored ``-i``.

    Merging the best-scored neighbours, the leftmost of equal ones, is then merging the lowest rank. The normalisation is
    the identity: no prefix, no white space changed. Ranks that no token has become unused pieces; the unknown piece, which
    the model must have and never gives, comes last.
    """
    letters = byte_letters()
    by_rank = {r: t for t, r in ranks.items()}
    size = max(by_rank, default=-1) + 1
    normal, unknown, unused = 1, 2, 5  # fixed values: kinds of pieces
    pieces = bytearray()
    for r in range(size + 1):
        token = by_rank.get(r)
        text = "".join(letters[b] for b in token) if token is not None else "<unk>" if r == size else f"<unused {r}>"
        kind = normal if token is not None else unknown if r == size else unused
        pieces += _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -r) + _field(3, kind))
    trainer = _field(3, 2) + _field(4, size + 1) + _field(40, size) + _field(45, b"<unk>")  # 3: model type 2, byte pairs
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(pieces) + _field(2, trainer) + _field(3, normaliser)


@cache
def _pre_tokens():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


@cache
def _newer(char: str) -> bool:
    """Whether only one of the two pattern engines takes a character for a letter or a number."""
    import regex

    return bool(_probe().encode_ordinary(char)) != (regex.match(r"\p{L}|\p{N}", char) is not None)


@cache
def _probe():
    import tiktoken

    return tiktoken.Encoding("letters and numbers", pat_str=r"\p{L}|\p{N}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})


def pre_tokens(text: str) -> list[str]:
    """The matches of the vocabulary's pattern, with the character classes of the library that the ids must agree with."""
    if FAR.search(text):
        newer = {c for c in set(FAR.findall(text)) if _newer(c)}
        if newer:
            out, at = [], 0
            for p in _pre_tokens()(text.translate({ord(c): STAND_IN for c in newer})):
                out.append(text[at : at + len(p)])
                at += len(p)
            return out
    return _pre_tokens()(text)


class ByteBpe(dict):
    """Encoder and decoder of a rank file; as a dictionary it holds the ids of pre-tokens as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        ranks = read_ranks(path)
        letters = byte_letters()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_proto(ranks))
        size = max(ranks.values(), default=-1) + 1
        back = {c: b for b, c in enumerate(letters)}
        # the inverse mapping: a piece's letters are its bytes; ids that no token has decode to nothing
        self.tokens = [bytes(back[c] for c in self.model.id_to_piece(i)) if not self.model.is_unused(i) else None for i in range(size)]
        # a pre-token that is a token is that token, even if no order of merges builds it
        whole = [t.decode("latin-1").translate(letters) for t in ranks]
        self.unbuilt = {p: r for p, r, ids in zip(whole, ranks.values(), self.model.encode(whole), strict=True) if ids != [r]}
        self.letters = letters

    def ids(self, pre_token: str) -> list[int]:
        mapped = pre_token.encode("utf-8", "replace").decode("latin-1").translate(self.letters)
        return [self.unbuilt[mapped]] if mapped in self.unbuilt else self.model.encode(mapped)

    def __missing__(self, pre_token: str) -> bytes:
        ids = self.ids(pre_token)
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(pre_token) <= CACHED_CHARS:
            if len(self) >= CACHED:
                self.clear()
            self[pre_token] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, pre_tokens(text)))

    def decode(self, ids: bytes) -> bytes | None:
        """The bytes of the ids' tokens; None if the ids are no 32-bit numbers or one of them has no token."""
        import numpy as np

        if len(ids) % 4:
            return None
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= len(self.tokens):
            return None
        parts = []
        for s in range(0, len(numbers), 1 << 18):
            tokens = [self.tokens[i] for i in numbers[s : s + (1 << 18)].tolist()]
            if None in tokens:
                return None
            parts.append(b"".join(tokens))
        return b"".join(parts)


@cache
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def _mapped(rows: DataFrame, column: str, added: str, fn) -> DataFrame:
    """``rows`` with a binary column ``added`` that ``fn`` gives for the values of ``column``, a bounded batch at a time."""
    import pyarrow as pa

    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, done, at, size = b.column(names.index(column)), [], 0, 0
            for k in range(b.num_rows):
                value = fn(values[k].as_py())
                done.append(value)
                size += len(value or b"")
                if size >= OUT_BYTES or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, len(done)) for c in b.columns), pa.array(done, pa.binary())], names=[*names, added])
                    done, at, size = [], k + 1, 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, {added} binary")


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(id_col, ids binary)``: the ids of every whole text as little-endian unsigned 32-bit numbers.

    Null text counts as empty: no ids. Repeated rows and null ids are returned as they stand; an empty table gives no rows;
    other columns are ignored. ``path`` is a rank file that every executor can read.
    """
    path = path or vocabulary_path()
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias(id_col), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text_"))
    return _mapped(slim, "text_", "ids", lambda text: byte_bpe(path).encode(text)).select(id_col, "ids")


def decoded(rows: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``rows`` with a column ``decoded binary``, the bytes of their ids; null where the ids are null or no ids of the vocabulary."""
    path = path or vocabulary_path()
    return _mapped(rows, ids_col, "decoded", lambda ids: None if ids is None else byte_bpe(path).decode(ids))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids, and digests of its ids and of the bytes that they decode to; edge cases as ``encoded``."""
    both = decoded(encoded(table(spark, sf_dir, "documents")))
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
