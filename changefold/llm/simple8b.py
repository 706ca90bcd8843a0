"""Token ids in files of Simple-8b words.

A 64-bit word holds a selector (high four bits) and as many ids as fit into
60 bits at one width. Ids are packed in blocks of a fixed count; the file
lists where each block's words start, so blocks decode by themselves and all
words of one selector decode in one array operation. An id wider than
``ESCAPE`` bits is escaped: its slot holds zero and its value stands in the
block's list of escapes.

A file, little-endian: the header (see ``HEAD``), doc ids (int64), their null
flags (uint8), ids per document (uint32), word offset per block (uint32, one
more than blocks), escape offset per block (likewise), the words (uint64),
escapes' places in their block (uint32) and values (uint64), CRC-32 of all
before (uint32), and one line feed.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from changefold.llm.common import partitions
from changefold.session import materialize, scratch_path

#: Fixed values of the format: ids and bits per word by selector (0 and 1 are unused).
COUNTS = (0, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
MAGIC = b"S8BTOKN1"
HEAD = struct.Struct("<8sQQIIIIQ")  # magic, part, number, documents, block size, blocks, escapes, ids
BLOCK, ESCAPE, SHARD = 4096, 60, 1 << 20
#: A word of Latin letters with ASCII marks after it.
_PLAIN = r"^(?P<stem>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?*%$#&|]*)$"
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[[9, 10, 13]] = 32


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, at least 1."""
    high = ids >> np.uint64(32)
    out = np.frexp((ids & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]  # halves are exact as doubles
    if high.any():
        out = np.where(high > 0, 32 + np.frexp(high.astype(np.float64))[1], out)
    return np.maximum(out, 1).astype(np.uint8)


def pack(ids: np.ndarray, block: int = BLOCK, escape: int = ESCAPE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, word offsets, escape offsets, escapes' places, escapes' values."""
    ids = ids.astype(np.uint64)
    blocks = -(-len(ids) // block)
    grid = np.zeros((blocks, block + COUNTS[2]), dtype=np.uint64)
    grid[:, :block].flat[: len(ids)] = ids
    bits = _bits(grid)
    row, place = np.nonzero(bits > escape)
    values = grid[row, place]
    grid[row, place], bits[row, place] = 0, 1
    best = np.full((blocks, block), 15, dtype=np.uint8)  # the selector that packs most from here on
    widest, span = bits.copy(), 1
    for selector in range(14, 1, -1):
        more = COUNTS[selector] - span  # never more than span
        widest[:, :-more] = np.maximum(widest[:, :-more], widest[:, more:])
        span = COUNTS[selector]
        np.copyto(best, np.uint8(selector), where=widest[:, :block] <= WIDTHS[selector])
    ends = [min(block, len(ids) - i * block) for i in range(blocks)]
    at, offsets = [], [0]
    for i, end in enumerate(ends):
        step, j = [COUNTS[s] for s in best[i].tolist()], 0
        base = i * (block + COUNTS[2])
        while j < end:
            at.append(base + j)
            j += step[j]
        offsets.append(len(at))
    flat, at = grid.reshape(-1), np.array(at, dtype=np.int64)
    line = at // (block + COUNTS[2])
    chosen = best.reshape(-1)[at - line * COUNTS[2]] if len(at) else np.zeros(0, np.uint8)
    words = chosen.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(chosen):
        own = np.flatnonzero(chosen == selector)
        n, w = COUNTS[selector], WIDTHS[selector]
        slots = flat[at[own, None] + np.arange(n)]
        slots[(at[own] - line[own] * (block + COUNTS[2]))[:, None] + np.arange(n) >= block] = 0
        words[own] |= np.bitwise_or.reduce(slots << (np.arange(n, dtype=np.uint64) * np.uint64(w)), axis=1)
    return words, np.array(offsets), np.searchsorted(row, np.arange(blocks + 1)), place, values


def unpack(words, offsets, escape_offsets, places, values, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids again: one array operation for each selector in use."""
    blocks = len(offsets) - 1
    out = np.zeros((blocks, block + COUNTS[2]), dtype=np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    sizes = np.array(COUNTS)[chosen]
    if (chosen < 2).any():
        raise ValueError("unknown selector")
    line = np.repeat(np.arange(blocks), np.diff(offsets))
    before = np.cumsum(sizes) - sizes
    place = before - before[offsets[:-1]][line] if len(words) else before
    if (place >= block).any():
        raise ValueError("a block holds more ids than it should")
    flat = out.reshape(-1)
    for selector in np.unique(chosen):
        own, w = np.flatnonzero(chosen == selector), WIDTHS[selector]
        shift = np.arange(COUNTS[selector], dtype=np.uint64) * np.uint64(w)
        got = (words[own, None] >> shift) & np.uint64((1 << w) - 1)
        flat[(line[own] * (block + COUNTS[2]) + place[own])[:, None] + np.arange(COUNTS[selector])] = got
    out[np.repeat(np.arange(blocks), np.diff(escape_offsets)), places] = values
    return out[:, :block].reshape(-1)[:n]


def shard_bytes(part: int, number: int, doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    words, offsets, escape_offsets, places, values = pack(ids)
    head = HEAD.pack(MAGIC, part, number, len(counts), BLOCK, len(offsets) - 1, len(values), len(ids))
    null = [pd.isna(d) for d in doc_ids]
    body = b"".join(
        (
            head,
            np.array([0 if n else d for n, d in zip(null, doc_ids)], dtype="<i8").tobytes(),
            np.array(null, dtype="u1").tobytes(),
            np.array(counts, dtype="<u4").tobytes(),
            offsets.astype("<u4").tobytes(),
            escape_offsets.astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
            places.astype("<u4").tobytes(),
            values.astype("<u8").tobytes(),
        )
    )
    return body + struct.pack("<I", zlib.crc32(body))


def read_shard(data: bytes) -> tuple[int, int, list, np.ndarray, np.ndarray]:
    """part, number, doc ids (None for null), ids per document, all ids."""
    if len(data) < HEAD.size + 5 or data[-1:] != b"\n" or data[:8] != MAGIC:
        raise ValueError("not a token file")
    body, (crc,) = data[:-5], struct.unpack("<I", data[-5:-1])
    if zlib.crc32(body) != crc:
        raise ValueError("checksum differs")
    _, part, number, docs, block, blocks, escapes, n = HEAD.unpack_from(body)
    at = HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(body, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, null, counts = take("<i8", docs), take("u1", docs), take("<u4", docs)
    offsets, escape_offsets = take("<u4", blocks + 1).astype(np.int64), take("<u4", blocks + 1).astype(np.int64)
    words, places, values = take("<u8", int(offsets[-1])), take("<u4", escapes), take("<u8", escapes)
    if at != len(body) or int(counts.sum()) != n:
        raise ValueError("lengths differ")
    ids = unpack(words, offsets, escape_offsets, places, values, n, block)
    return part, number, [None if x else int(d) for d, x in zip(doc_ids, null)], counts.astype(np.int64), ids


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of texts whose tokenizer never looks across ASCII white space.

    Such a tokenizer (white space is dropped, normalising is by character)
    gives a text the ids of its space-separated words, so each distinct word
    is encoded by the library once while it is remembered. Words of plain
    Latin letters and trailing ASCII marks are the two lower-case pre-tokens
    that they consist of; all others go to the library as they are, those with
    the string of a special token among them. Ids stand in one array, in rows;
    a batch's words are numbered by Arrow, looked up once each and gathered.
    ``most`` bounds the rows that are remembered, not results."""

    def __init__(self, path: str, most: int = 1_200_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.rows: dict[str, int] = {"": 0}  # of words and of pre-tokens alike; the frequent ones come early and stay
        self.flat, self.ends = np.zeros(1 << 20, dtype="<u4"), np.zeros(1 << 18, dtype=np.int64)
        self.n, self.most = 1, most  # row 0 is empty
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = None
        if mark:
            vocabulary = self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.closes[[i for token, i in vocabulary.items() if token.endswith(mark)]] = True

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """New rows with ``sizes`` of ``ids`` each."""
        used, first = int(self.ends[self.n - 1]), self.n
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(sizes) > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[used : used + len(ids)] = ids
        self.n += len(sizes)
        self.ends[first : self.n] = used + np.cumsum(sizes)
        return range(first, self.n)

    def _gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of rows one after the other, and how many each has."""
        begins = np.where(rows > 0, self.ends[rows - 1], 0)
        sizes = self.ends[rows] - begins
        ahead = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(begins - ahead, sizes) + np.arange(int(sizes.sum()))], sizes

    def _joined(self, atoms: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pre-tokens of Latin letters, encoded as one text: each ends
        in the one of its tokens that the vocabulary marks as a word's end."""
        if self.closes is None:
            return None
        (made,) = self.tokenizer.encode_batch_fast([" ".join(atoms)], add_special_tokens=False)
        ids = np.array(made.ids, dtype="<u4")
        stops = np.flatnonzero(self.closes[ids]) + 1
        if len(stops) != len(atoms) or stops[-1] != len(ids):
            return None
        return ids, np.diff(stops, prepend=0)

    def _encode(self, atoms: list[str], plain: bool) -> None:
        """Rows for those of ``atoms`` that have none."""
        atoms = list(itertools.filterfalse(self.rows.__contains__, dict.fromkeys(atoms)))
        if not atoms:
            return
        got = self._joined(atoms) if plain else None
        if got is None:
            made = [e.ids for e in self.tokenizer.encode_batch_fast(atoms, add_special_tokens=False)]
            got = np.array([i for ids in made for i in ids], dtype="<u4"), np.array([len(ids) for ids in made])
        self.rows.update(zip(atoms, self._add(*got)))

    def _learn(self, words: list[str]) -> None:
        """Rows for words, and their pre-tokens, that have none."""
        parts = pc.extract_regex(pa.array(words, pa.string()), _PLAIN)
        plain = parts.is_valid().to_numpy(zero_copy_only=False)
        self._encode([words[i] for i in np.flatnonzero(~plain)], plain=False)
        names = words if plain.all() else list(itertools.compress(words, plain))
        halves = []
        for part, letters in ((pc.utf8_lower(parts.field("stem")), True), (parts.field("marks"), False)):
            numbered = part.filter(pa.array(plain)).dictionary_encode()
            atoms = _strings(numbered.dictionary)
            self._encode(atoms, plain=letters)
            halves.append(np.fromiter(map(self.rows.__getitem__, atoms), np.int64, len(atoms))[numbered.indices.to_numpy()])
        rows = self.rows  # a word that is its own stem has a row by now
        new = ~np.fromiter(map(rows.__contains__, names), bool, len(names))
        if new.any():
            ids, sizes = self._gather(np.column_stack(halves)[new].reshape(-1))
            rows.update(zip(itertools.compress(names, new), self._add(ids, sizes.reshape(-1, 2).sum(axis=1))))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and how many each text has."""
        whole = pa.array(texts, pa.large_string())
        _, offsets, data = whole.buffers()
        if data is None or not whole.nbytes:
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        raw = np.frombuffer(data, np.uint8)
        raw = _SPACES[raw]
        spaced = pa.Array.from_buffers(pa.large_string(), len(whole), [None, offsets, pa.py_buffer(raw)])
        split = pc.split_pattern(spaced, " ")
        numbered = split.flatten().dictionary_encode()
        words, codes = _strings(numbered.dictionary), numbered.indices.to_numpy()
        before = len(self.rows), self.n
        rows = np.fromiter(map(self.rows.get, words, itertools.repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(rows < 0).tolist()
        if unknown:
            self._learn(list(map(words.__getitem__, unknown)))
            rows[unknown] = np.fromiter(map(self.rows.__getitem__, map(words.__getitem__, unknown)), np.int64, len(unknown))
        ids, sizes = self._gather(rows[codes])
        if before[0] >= self.most:  # full: what was learned now is forgotten
            for word in list(itertools.islice(reversed(self.rows), len(self.rows) - before[0])):
                del self.rows[word]
            self.n = before[1]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        cuts = split.offsets.to_numpy()
        return ids, np.diff(ends[cuts - cuts[0]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        ids, counts = self.encode_flat(texts)
        ends = np.cumsum(counts)
        data = ids.astype("<u4").tobytes()
        return [data[4 * (b - n) : 4 * b] for b, n in zip(ends.tolist(), counts.tolist())]


@lru_cache(1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _slices(frame: pd.DataFrame, chars: int = 4_000_000) -> Iterator[tuple[list, list[str]]]:
    """A batch's documents, about ``chars`` characters of them at a time."""
    docs, texts, size = [], [], 0
    for doc, text in zip(frame["doc_id"], frame["text"]):
        docs.append(doc)
        texts.append(text or "")
        size += len(texts[-1])
        if size >= chars:
            yield docs, texts
            docs, texts, size = [], [], 0
    if docs:
        yield docs, texts


def _write_shards(path: str, end: int, shard: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part, number = _encoder(path), TaskContext.get().partitionId(), 0
        docs: list = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        tail, size = np.array([end], dtype="<u4"), 0

        def flush() -> pd.DataFrame:
            return pd.DataFrame({"value": [shard_bytes(part, number, docs, counts, np.concatenate(held))]})

        for frame in frames:
            for own, texts in _slices(frame):
                ids, made = encoder.encode_flat(texts)
                ends = np.cumsum(made)
                for doc, stop, n in zip(own, ends.tolist(), made.tolist()):
                    docs.append(doc)
                    counts.append(n + 1)
                    held += (ids[stop - n : stop], tail)
                    size += n + 1
                    if size >= shard:
                        yield flush()
                        docs, counts, held, size, number = [], [], [], 0, number + 1
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = 1, shard: int = SHARD) -> None:
    """Encodes each text, appends ``end`` and writes files of about ``shard``
    ids, documents in ascending order of doc_id (null last, equal ids by text).

    Texts are dealt by ranges of doc_id before they are encoded; a file holds
    whole documents. Each row of the writer's frame is one file's bytes: Spark
    writes them through its own committer, so a lost executor leaves no part
    of a file behind. A null text is empty: it has the end id alone. An empty
    table writes no file."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    (
        docs.select("doc_id", "text")
        .repartitionByRange(partitions(docs), order[0])
        .sortWithinPartitions(*order)
        .mapInPandas(_write_shards(tokenizer, end, shard), "value binary")
        .select(F.col("value").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("lineSep", "\n")
        .text(path)
    )


def _read_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for data in frame["content"]:
            part, number, docs, counts, ids = read_shard(bytes(data))
            ids, at = ids.astype("<u4"), np.cumsum(counts) - counts
            yield pd.DataFrame(
                {
                    "part": part,
                    "number": number,
                    "doc_id": pd.array(docs, "Int64"),
                    "n_tokens": counts,
                    "within": at,
                    "ids_crc32": [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at, counts)],
                }
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files.

    start counts the ids of all documents before it: within its file, plus the
    files before (one row a file; those of one writing task first, then the
    tasks)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    rows = materialize(
        files.select("content").mapInPandas(
            _read_shards, "part long, number long, doc_id long, n_tokens long, within long, ids_crc32 long"
        ),
        "read-tokens",
    )
    shards = rows.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    ahead = (Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("number").rowsBetween(*ahead)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n").alias("n"))
    outside = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*ahead)), F.lit(0))
    base = shards.select("part", "number", inside.alias("inside")).join(parts.select("part", outside.alias("outside")), "part")
    return rows.join(base, ["part", "number"]).select(
        "doc_id", (F.col("outside") + F.col("inside") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_file_digests(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Writes ``docs`` to token files under the shared folder and reads them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path, end)
    return read_tokens(docs.sparkSession, path)
