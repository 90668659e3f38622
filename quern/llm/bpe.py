"""Byte-level BPE encoding and decoding with a local rank file.

The tiktoken library encodes; texts that it can't take in one piece are split
first, at places that are certain to lie between two matches of the splitting
pattern, so that the ids are those of the unsplit text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quern.llm._common import map_columns

#: Characters of a text that are encoded at a time, about.
CHUNK_CHARS = 32_768
#: White space in the sense of the pattern's \s: Unicode's White_Space.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space this long is encoded by itself: the pattern's look-ahead recurses over it.
LONG_SPACE = 4096
# Between a character that isn't white space and one that is, a match always
# ends: no alternative of the pattern has white space after anything else.
_BOUNDARY = re.compile(rf"(?<=[^{SPACE}])(?=[{SPACE}])")
_LONG_RUN = re.compile(rf"[{SPACE}]{{{LONG_SPACE},}}")


class Codec:
    """Encodes and decodes whole texts of any length."""

    def __init__(self, rank_path: str, pattern: str):
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= CHUNK_CHARS:
            return self._encoding.encode_to_numpy(text, disallowed_special=())
        ids = [self._piece(p) for p in pieces(text)]
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32)

    def _piece(self, piece: tuple[bool, str]) -> np.ndarray:
        single, text = piece
        if single:
            return np.asarray(self._encoding._encode_single_piece(text), dtype=np.uint32)
        return self._encoding.encode_to_numpy(text, disallowed_special=())

    def decode(self, ids) -> bytes:
        """The bytes of the ids; they need not be valid UTF-8."""
        return self._encoding.decode_bytes(ids)


def pieces(text: str) -> Iterator[tuple[bool, str]]:
    """Parts of a long text as (one match by itself, part), to be encoded one after another."""
    start = 0
    for run in _LONG_RUN.finditer(text):
        # Of a run before another character, the pattern takes all but the last white space.
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((False, x) for x in _chunks(text[start : run.start()]))
        yield True, text[run.start() : end]
        start = end
    yield from ((False, x) for x in _chunks(text[start:]))


def _chunks(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > CHUNK_CHARS:
        found = _BOUNDARY.search(text, start + CHUNK_CHARS)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    if start < len(text):
        yield text[start:]


def encode(
    docs: DataFrame,
    rank_path: str,
    pattern: str,
    *,
    text: str = "text",
    ids: str = "ids",
    decoded: str | None = None,
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` with the token ids of the whole ``text`` (array<int>).

    With ``decoded`` set, the ids are decoded again into that binary column, in
    the same pass. Null and empty texts give no ids. Special-token strings are
    ordinary text. The text column is passed on only with ``keep_text``; input
    columns with an output's name are replaced. ``rank_path`` must be readable
    on every executor. A worker holds one batch of texts and their ids.
    """
    outputs = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))]
    if decoded:
        outputs.append(T.StructField(decoded, T.BinaryType()))

    def make():
        codec = Codec(rank_path, pattern)

        def apply(columns: list[pa.Array]) -> list[pa.Array]:
            got = [codec.encode(t) if t else np.zeros(0, np.uint32) for t in columns[0].to_pylist()]
            offsets = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(x) for x in got], out=offsets[1:])
            flat = np.concatenate(got).astype(np.int32) if got else np.zeros(0, np.int32)
            out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decoded:
                out.append(pa.array([codec.decode(x.tolist()) for x in got], pa.binary()))
            return out

        return apply

    return map_columns(docs, [text], T.StructType(outputs), make, drop=() if keep_text else (text,))


def decode(df: DataFrame, rank_path: str, pattern: str, *, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the bytes of the token ids (binary; null ids give no bytes)."""

    def make():
        codec = Codec(rank_path, pattern)
        return lambda columns: [pa.array([codec.decode(x or []) for x in columns[0].to_pylist()], pa.binary())]

    return map_columns(df, [ids], T.StructType([T.StructField(decoded, T.BinaryType())]), make)
