"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments. The binary (23, 12) Golay
code puts each 23-bit word within three bits of exactly one codeword. A word
less than three bits from its codeword is keyed by it alone; one at exactly
three bits is keyed by it and by the five codewords four bits away. Two words
at most two bits apart then always share a key. Of at most five differing
bits no two segments can hold three each, so two linked fingerprints share
the keys of at least two of their three segments: rows are joined on the keys
of each pair of segments (24 bits), and every pair met is verified by its
whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from changefold.llm.common import KEYS, keyed, partitions, sheltered
from changefold.llm.components import connected_components
from changefold.session import materialize

#: Fixed: a generator polynomial of the (23, 12) Golay code, and the cuts of a fingerprint.
GENERATOR = 0b110001110101
SEGMENTS = ((42, 22), (21, 21), (0, 21))
MOST_BITS = 5
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _remainders() -> np.ndarray:
    """Of each 12-bit message, shifted by 11, modulo the generator."""
    out = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        out = np.where(out >> bit & 1, out ^ (GENERATOR << (bit - 11)), out)
    return out


def _patterns(remainders: np.ndarray) -> np.ndarray:
    """[syndrome, 6]: the errors of up to three bits, then those of four where
    the first has exactly three; -1 where there is none."""
    table = np.full((2048, 6), -1, dtype=np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int((e & 0x7FF) ^ remainders[e >> 11])
            if weight < 4:
                table[s, 0] = e
            else:
                table[s, int(np.argmax(table[s] < 0))] = e
    return table


_REMAINDERS = _remainders()
_PATTERNS = _patterns(_REMAINDERS)


def segment_keys(segment: np.ndarray) -> np.ndarray:
    """[n, 6] codeword indices (12 bits) near each word, -1 for none."""
    errors = _PATTERNS[(segment & 0x7FF) ^ _REMAINDERS[segment >> 11]]
    return np.where(errors < 0, -1, (segment[:, None] ^ errors) >> 11)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit majority of the XXH64 (seed 42) of all shingles, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = list(accumulate((len(w) + 1 for w in found), initial=0))
    k = min(shingle, len(found))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(found) - k + 1, 1 << 16):
        stop = min(at + (1 << 16), len(found) - k + 1)
        h = np.fromiter(
            (digest(joined[a : b - 1], 42) for a, b in zip(ends[at:stop], ends[at + k : stop + k])), np.uint64, stop - at
        )
        counts += _bit_counts(h)
    total = len(found) - k + 1
    return int(sum(1 << b for b in range(64) if 2 * counts[b] > total))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """Per bit, how many of ``h`` have it: 255 hashes at a time summed as bytes."""
    out, starts = np.zeros((8, 8), dtype=np.int64), np.arange(0, len(h), 255)
    for j in range(8):
        sums = np.add.reduceat(h >> np.uint64(j) & np.uint64(0x0101010101010101), starts)
        out[:, j] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0)
    return out.reshape(64)


def _fingerprints(shingle: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            prints = np.array([fingerprint(t, shingle) for t in frame["text"]], dtype=np.uint64)
            yield frame.drop(columns="text").assign(fp=prints.view(np.int64))

    return run


def _spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each pair of segment keys of each fingerprint."""
    for frame in frames:
        signed = frame["fp"].to_numpy(np.int64)
        for at in range(0, len(signed), 4096):
            fp = signed[at : at + 4096]
            whole = fp.view(np.uint64)
            keys = [
                segment_keys((whole >> np.uint64(shift) & np.uint64((1 << n) - 1)).astype(np.int64))
                for shift, n in SEGMENTS
            ]
            for which, (i, j) in enumerate(combinations(range(3), 2)):
                a, b = keys[i][:, :, None], keys[j][:, None, :]
                row, x, y = np.nonzero((a >= 0) & (b >= 0))
                yield pd.DataFrame({"key": which << 24 | keys[i][row, x] << 12 | keys[j][row, y], "fp": fp[row]})


def _forest(f: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all of ``f`` that links connect: a breadth-first
    search in which each fingerprint is compared with those not yet reached."""
    left, a, b = f, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= most
            if near.any():
                reached = left[near]
                left = left[~near]
                a.append(np.full(len(reached), x))
                b.append(reached)
                queue.extend(reached)
    return (np.concatenate(a), np.concatenate(b)) if a else (f[:0], f[:0])


def _links(most: int, small: int = 32):
    def pairs(k: np.ndarray, f: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[starts, len(k)])
        a, b = [], []
        for at, n in zip(starts[sizes > small], sizes[sizes > small]):
            x, y = _forest(f[at : at + n], most)
            a.append(x)
            b.append(y)
        fits = np.repeat((sizes > 1) & (sizes <= small), sizes)
        k, f = k[fits], f[fits]
        for d in range(1, min(small, len(k))):
            same = k[d:] == k[:-d]
            if not same.any():
                break
            near = same & (np.bitwise_count(f[d:] ^ f[:-d]) <= most)
            a.append(f[d:][near])
            b.append(f[:-d][near])
        found = np.stack([np.concatenate(a), np.concatenate(b)], 1) if a else np.zeros((0, 2), np.uint64)
        found = np.unique(np.sort(found.view(np.int64), axis=1), axis=0)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for frame in frames:
            if not len(frame):
                continue
            k, f = frame["key"].to_numpy(), frame["fp"].to_numpy(np.int64).view(np.uint64)
            cut = int(np.searchsorted(k, k[-1]))
            if cut or (held and held[0][0][0] != k[0]):
                held.append((k[:cut], f[:cut]))
                yield pairs(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
                held = []
            held.append((k[cut:], f[cut:]))
        if held:
            yield pairs(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))

    return run


def link_fingerprints(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """Distinct fingerprints (fp: long) -> edges (a, b) that connect exactly
    what links of ``max_bits`` or fewer differing bits connect.

    A key's fingerprints stream through one task eight bytes each; large keys
    give a spanning forest, never all their pairs, and a key can hold each
    distinct fingerprint once only of the up to 108 rows that it has."""
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"three segments find up to {MOST_BITS} differing bits")
    return (
        prints.select("fp")
        .mapInPandas(_spread, "key long, fp long")
        .repartition(partitions(prints), "key")
        .sortWithinPartitions("key")
        .mapInPandas(_links(max_bits), "a long, b long")
        .distinct()
    )


def simhash_components(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(__key1, __key2, doc_id, fingerprint, component_id), one row per row.

    Reads doc_id and text; other columns only tell rows apart, whatever their
    names. Texts of any length are read whole. A null, empty or blank text has
    fingerprint zero and links like any other.
    component_id is the smallest doc_id reachable by links, itself included;
    null ids count only where a component has no other. Equal rows are in one
    component. An empty table gives no rows."""
    rows = keyed(docs).select(*KEYS, "doc_id", "text")
    prints = materialize(rows.mapInPandas(_fingerprints(shingle), "__key1 long, __key2 int, doc_id long, fp long"), "prints")
    each = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-prints")
    roots = connected_components(link_fingerprints(each, max_bits))
    rooted = each.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", "root")
    return prints.join(named, "fp").select(
        *KEYS, "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root"
    )


def keep_one(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id
    (null last), of equal ids that of the smallest content key, of equal rows
    one. The rows' content key is unique on both sides of the join. Columns may
    have any name."""
    best = grouped.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), *[F.col(k) for k in KEYS])).alias("best")
    )
    kept = best.select(*[F.col(f"best.{k}").alias(k) for k in KEYS])
    inner, back = sheltered(docs, ())
    return back(keyed(inner).dropDuplicates(list(KEYS)).join(kept, list(KEYS), "left_semi"))
