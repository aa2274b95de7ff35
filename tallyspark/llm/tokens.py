"""Operator 9: exact token counts at every prefix of a text, by dynamic programming over its pieces."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k"
#: Fixed value of the vocabulary: its one special token, which the library finds inside texts and never splits.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Pieces whose prefix counts a worker keeps; a full table is emptied and filled anew.
CACHED_PIECES = 400_000


def vocabulary_path(name: str, kind: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.{kind}")


@cache
def encoder(name: str = VOCABULARY):
    """The byte-pair encoder of the vocabulary as ranks, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(vocabulary_path(name, "tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Characters whose classes may differ between Unicode versions are looked for beyond this range only.
FAR = re.compile("[^\x00-\u024f]")


@cache
def library(name: str = VOCABULARY):
    import tokenizers

    return tokenizers.Tokenizer.from_file(vocabulary_path(name, "json"))


@cache
def newer(char: str) -> bool:
    """Whether the pattern and the library class a character differently (their Unicode versions differ)."""
    probe = f"a{char}1 {char}"
    return len(library().pre_tokenizer.pre_tokenize_str(probe)) != len(piece_pattern().findall(probe))


def library_only(text: str) -> bool:
    return FAR.search(text) is not None and any(map(newer, set(FAR.findall(text))))


@cache
def piece_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@cache
def spaces():
    import regex

    return regex.compile(r"\s+")


#: Fixed values of the pattern: its first alternatives, the only pieces with a prefix that is cut into two.
CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))
#: Pairs of tokens whose standing side by side a worker remembers.
CACHED_PAIRS = 1 << 20


class PrefixTable:
    """Token counts of every prefix, by dynamic programming.

    The tokenizer cuts a text into pieces and merges bytes only inside a piece. Inside a piece the encoding of a prefix
    is the encoding of a shorter prefix and one token more, and only one token that ends there can stand beside the
    shorter one's last token (two tokens can if encoding their bytes gives them back). So ``count[i] = count[i - length
    of that token] + 1``, byte by byte, without encoding a prefix. Rows depend on the piece alone and are kept for the
    next time the piece stands anywhere; a text's counts are its pieces' rows on top of the counts at their starts.
    """

    def __init__(self, name: str = VOCABULARY):
        self.encode_piece = encoder(name)._core_bpe.encode_single_piece
        self.pieces = piece_pattern().findall
        self.rows: dict[str, bytes | tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}
        self.ranks = encoder(name)._mergeable_ranks
        self.tokens = {r: t for t, r in self.ranks.items()}
        self.longest = max(map(len, self.ranks))

    def beside(self, a: int, b: int) -> bool:
        """Whether the encoding of the two tokens' bytes is the two tokens."""
        if len(self.pairs) >= CACHED_PAIRS:
            self.pairs.clear()
        found = self.pairs[a << 20 | b] = self.encode_piece(self.tokens[a] + self.tokens[b]) == [a, b]
        return found

    def row(self, piece: str):
        """Counts of the piece's prefixes of 1, 2, ... characters, each encoded as a piece of its own."""
        row = self.rows.get(piece)
        if row is None:
            if len(self.rows) >= CACHED_PIECES:
                self.rows.clear()
            row = self.rows[piece] = self.built(piece)
        return row

    def built(self, piece: str):
        raw = piece.encode("utf-8", "replace")
        rank, longest, known, beside = self.ranks.get, self.longest, self.pairs.get, self.beside
        n = len(raw)
        count, last = [0] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for s in range(i - longest if i > longest else 0, i):
                token = rank(raw[s:i])
                if token is not None:
                    if s:
                        a = last[s]
                        fits = known(a << 20 | token)
                        if not (beside(a, token) if fits is None else fits):
                            continue
                    count[i], last[i] = count[s] + 1, token
                    break
        if n != len(piece):
            count = [0, *(count[i] for i in range(1, n + 1) if i == n or raw[i] & 0xC0 != 0x80)]
        return bytes(count[1:]) if count[-1] < 200 and max(count) < 256 else tuple(count[1:])

    def n_tokens(self, text: str) -> int:
        """The count at the last prefix, which is the whole text: the last entries of its pieces' rows."""
        if library_only(text):
            return len(library().encode(text, add_special_tokens=False).ids)
        stored, row, total = self.rows.get, self.row, 0
        parts = text.split(SPECIAL) if SPECIAL in text else [text]
        for part in parts:
            for piece in self.pieces(part):
                total += (stored(piece) or row(piece))[-1]
        return total + len(parts) - 1

    def prefixes(self, text: str) -> list[int]:
        """``out[i]`` is the exact count of ``text[:i]``, for every ``i`` from 0 to the length.

        A prefix is cut into the pieces of the whole text up to its last one, but for its end: white space at the end is
        one piece from where the run begins, a contraction may be cut in two, and a special string that is not whole is
        ordinary text. Texts that only the library cuts rightly are counted prefix by prefix.
        """
        if library_only(text):
            return [self.n_tokens(text[:i]) for i in range(len(text) + 1)]
        out = [0]
        at = safe = base = 0  # safe: where the last piece starts that white space or a special string may change
        for k, part in enumerate(text.split(SPECIAL)):
            if k:
                head = out[-1]
                out += [base + self.n_tokens(text[safe : at + j]) for j in range(1, len(SPECIAL))]
                out.append(head + 1)
                at += len(SPECIAL)
                safe, base = at, out[-1]
            start, run, run_end = at, at, at
            for piece in self.pieces(part):
                count = out[-1] if at == start else whole
                if at >= run_end and piece[0].isspace():
                    m = spaces().match(part, at - start)
                    if m:
                        run, run_end, run_base, run_row = at, start + m.end(), count, self.row(m.group())
                row = self.row(piece)
                for j in range(1, len(piece) + 1):
                    i = at + j
                    if run < i <= run_end:
                        out.append(run_base + run_row[i - run - 1])
                    elif piece in CONTRACTIONS and 1 < j < len(piece):
                        out.append(count + self.n_tokens(piece[:j]))
                    else:
                        out.append(count + row[j - 1])
                if not piece[-1].isspace():
                    safe, base = (run, run_base) if run_end > at and run < run_end else (at, count)
                whole = count + row[-1]
                at += len(piece)
        return out

    @staticmethod
    def longest_within(counts: list[int], budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens, looked up in a text's stored counts."""
        return next(i for i in range(len(counts) - 1, -1, -1) if counts[i] <= budget)

    def truncate(self, text: str, budget: int, counts: list[int] | None = None) -> str:
        """The longest prefix of at most ``budget`` tokens by ``counts``, the text's stored prefix counts."""
        return text[: self.longest_within(self.prefixes(text) if counts is None else counts, budget)]


@cache
def prefix_table(name: str = VOCABULARY) -> PrefixTable:
    return PrefixTable(name)


def token_counts(docs: DataFrame, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", prefixes: bool = False) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` of every row, from the prefix table's last entry.

    ``prefixes`` adds ``prefix_tokens array<int>``, the count at every character prefix. Null text counts as
    empty: 0 bytes, 0 tokens. Repeated rows and null ids are returned as they stand; other columns are ignored.
    """
    import pyarrow as pa

    extra = ", prefix_tokens array<int>" if prefixes else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dp = prefix_table()
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [dp.n_tokens(t) for t in texts]
            cols = [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            names = [id_col, "n_bytes", "n_tokens", "over_limit"]
            if prefixes:
                cols.append(pa.array([dp.prefixes(t) for t in texts], pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"{id_col} long, n_bytes long, n_tokens long, over_limit boolean{extra}")


def truncated(counted: DataFrame, budget: int, text_col: str = "text") -> DataFrame:
    """``counted`` with ``text_col`` cut to the longest prefix of at most ``budget`` tokens, by its column ``prefix_tokens``.

    Nothing is encoded: the stored counts answer any budget. Null texts stay null.
    """
    within = F.expr(f"array_max(transform(prefix_tokens, (n, i) -> IF(n <= {int(budget)}, i, 0)))")
    return counted.withColumn(text_col, F.substring(F.col(f"`{text_col}`"), F.lit(1), within))


def token_ids(text: str) -> "numpy.ndarray":  # noqa: F821
    """The ids of a text as the library gives them, special strings inside texts being the special token."""
    import numpy as np

    if library_only(text):
        return np.array(library().encode(text, add_special_tokens=False).ids, dtype="<u4")
    encode = encoder().encode_ordinary
    if SPECIAL not in text:
        return np.array(encode(text), dtype="<u4")
    ids: list[int] = []
    for k, part in enumerate(text.split(SPECIAL)):
        ids += ([SPECIAL_ID] if k else []) + encode(part)
    return np.array(ids, dtype="<u4")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
