"""Byte-level BPE by overlapping chunks.

A long text is cut near every multiple of ``chunk`` characters. The window
around a cut is pre-tokenised twice, from the left chunk's phase and from the
right chunk's; the cut is moved to the first place where both have a border
and which is a border whatever stands before: after a letter or digit that the
next character does not continue, or before white space. Pieces between such
places are pre-tokenised and merged one by one, on any executor, and give the
same ids as the whole text. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from changefold.llm.common import contiguous, partitions

CODED = "row long, doc_id long, piece int, ids binary"


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(2)
def _names(size: int) -> list[str]:
    return [str(i) for i in range(size)]


_KINDS = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\S)(?=\s)")


def _borders(window: str, start: int, pattern) -> set[int]:
    """Ends of the matches from ``start`` on; those that the window's end could change are left out."""
    return {m.end() for m in pattern.finditer(window, start) if m.end() <= len(window) - 3}


def cuts(text: str, chunk: int, overlap: int, pattern: str) -> list[int]:
    """Places to cut ``text`` at, ascending: about one a chunk, fewer where the
    two phases do not meet in a window (one run of letters, say)."""
    own, out, at = regex.compile(pattern), [], chunk
    while at < len(text) - overlap:
        low = max(0, at - overlap)
        window = text[low : at + overlap]
        both = _borders(window, 0, own) & _borders(window, at - low, own)
        sure = [m.start() for m in _KINDS.finditer(window, at - low + 1) if m.start() in both]
        if sure:
            out.append(low + sure[0])
        at += chunk
    return out


def _split(chunk: int, overlap: int, pattern: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row, doc, text in zip(frame["row"], frame["doc_id"], frame["text"]):
                at = [0, *cuts(text, chunk, overlap, pattern), len(text)]
                for i, (a, b) in enumerate(zip(at, at[1:])):
                    yield pd.DataFrame({"row": [row], "doc_id": pd.array([doc], "Int64"), "piece": [i], "text": [text[a:b]]})

    return run


def _digest(enc, pieces: list[list[int]]) -> tuple[int, str, str]:
    names, n = _names(enc.n_vocab), 0
    ids_sha, bytes_sha = hashlib.sha256(), hashlib.sha256()
    for ids in pieces:
        if ids:
            ids_sha.update((("," if n else "") + ",".join([names[i] for i in ids])).encode())
            bytes_sha.update(enc.decode_bytes(ids))
            n += len(ids)
    return n, ids_sha.hexdigest(), bytes_sha.hexdigest()


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest_whole(path: str, pattern: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path, pattern)
        for frame in frames:
            got = [_digest(enc, [enc.encode_ordinary(t or "")]) for t in frame["text"]]
            yield pd.DataFrame(got, columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=frame["doc_id"].to_numpy())

    return run


def _encode(path: str, pattern: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path, pattern)
        for frame in frames:
            made = [np.array(enc.encode_ordinary(t or ""), dtype="<u4").tobytes() for t in frame["text"]]
            yield frame.drop(columns="text").assign(ids=made)

    return run


def _digest_pieces(path: str, pattern: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(path, pattern)
        for g in contiguous(frames, ["row"]):
            got = _digest(enc, [np.frombuffer(b, "<u4").tolist() for b in g["ids"]])
            yield pd.DataFrame([got], columns=["n_tokens", "ids_sha256", "decoded_sha256"]).assign(doc_id=g["doc_id"].iloc[:1].to_numpy())

    return run


def _long_pieces(docs: DataFrame, ranks: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    long = docs.where(F.char_length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    pieces = long.mapInPandas(_split(chunk, overlap, pattern), "row long, doc_id long, piece int, text string")
    return pieces.repartition(partitions(docs), "row", "piece").mapInPandas(_encode(ranks, pattern), CODED)


def encode_ids(docs: DataFrame, ranks: str, pattern: str, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """(row, doc_id, piece, ids): little-endian 32-bit ids of each piece, a
    document's pieces numbered in order. ``row`` tells apart rows of one id."""
    short = docs.where(F.coalesce(F.char_length("text"), F.lit(0)) <= chunk)
    short = short.select((-1 - F.monotonically_increasing_id()).alias("row"), "doc_id", F.lit(0).alias("piece"), "text")
    return short.mapInPandas(_encode(ranks, pattern), CODED).union(_long_pieces(docs, ranks, pattern, chunk, overlap))


def decode_ids(coded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(row, doc_id, piece, data): the raw bytes of each piece; a document's
    text is their concatenation (a piece need not be valid UTF-8 by itself
    where the ids come from elsewhere)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(ranks, pattern)
        for frame in frames:
            made = [enc.decode_bytes(np.frombuffer(b, "<u4").tolist()) for b in frame["ids"]]
            yield frame.drop(columns="ids").assign(data=made)

    return coded.mapInPandas(run, "row long, doc_id long, piece int, data binary")


def bpe_digests(docs: DataFrame, ranks: str, pattern: str, chunk: int = 32_768, overlap: int = 256) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), one row per row.

    Reads doc_id and text of ``docs``. Texts of up to ``chunk`` characters are
    one piece and are encoded where they are read; of longer ones the pieces
    are dealt over all tasks and a document's ids meet again in its order. A
    null or empty text has no ids (digests of nothing); rows with a null or
    repeated doc_id are encoded each for itself; an empty table gives no rows.
    """
    short = docs.where(F.coalesce(F.char_length("text"), F.lit(0)) <= chunk).select("doc_id", "text")
    whole = short.mapInPandas(_digest_whole(ranks, pattern), DIGEST)
    pieces = _long_pieces(docs, ranks, pattern, chunk, overlap)
    joined = (
        pieces.repartition(partitions(docs), "row")
        .sortWithinPartitions("row", "piece")
        .mapInPandas(_digest_pieces(ranks, pattern), DIGEST)
    )
    return whole.union(joined)
