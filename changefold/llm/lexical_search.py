"""Ranked lexical search by an Aho-Corasick scan of the documents.

There is no index of documents. One automaton holds the terms of all items,
each between two spaces; a text's bytes other than term bytes become spaces,
so the automaton reports whole terms only, and one pass over a text counts
how often each stands in it. What the scan finds (a few numbers a document)
is written to the shared folder with each task's document counts; then the
documents are scored, an automaton's output adding its score to the items that
hold the term, and every task keeps the best of each item.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from changefold.session import materialize

MOST = 4 << 20  # bytes of terms in one automaton
BATCH = 1024  # documents that are scored at a time
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte by byte: a term's byte (A-Z lower-cased), or a space.
_GUARD = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)
)

SCAN = "doc_id long, n long, codes binary, counts binary"
BEST = "item long, score long, doc_id long, salt long"


def terms(text: Column) -> Column:
    """Array of the terms of a text, A-Z lower-cased, with repeats (null: none)."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


_built: dict = {}  # the automaton of a worker's last scan


def _automaton(key: str, shared: Broadcast):
    if key not in _built:
        import ahocorasick

        made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for code, term in enumerate(shared.value["terms"]):
            made.add_word(f" {term.encode().decode('latin-1')} ", code)
        made.make_automaton()
        _built.clear()
        _built[key] = made
    return _built[key]


def _scan(key: str, shared: Broadcast):
    """Each document's number of terms and the counts of the items' terms; at
    the end one row (n -1) with the documents of this task that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(shared.value["terms"])
        found = _automaton(key, shared).iter if size else None
        held = np.zeros(size, dtype=np.int64)
        value = itemgetter(1)

        def out(docs, n, codes, counts):
            arrays = [pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(codes, pa.binary()), pa.array(counts, pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n", "codes", "counts"])

        for batch in batches:
            docs, ns, codes, counts = batch.column(0).to_pylist(), [], [], []
            for text in batch.column(1).cast(pa.binary()):
                clean = b" " + (text.as_py() or b"").translate(_GUARD) + b" "
                raw = np.frombuffer(clean, np.uint8) != 32
                ns.append(int(np.count_nonzero(raw[1:] & ~raw[:-1])))
                tally = Counter(map(value, found(clean.decode("latin-1")))) if size and ns[-1] else {}
                own = np.fromiter(tally.keys(), np.int32, len(tally))
                held[own] += 1
                codes.append(own.astype("<i4").tobytes())
                counts.append(np.fromiter(tally.values(), np.int64, len(tally)).astype("<i8").tobytes())
            yield out(docs, ns, codes, counts)
        some = np.flatnonzero(held)
        yield out([None], [-1], [some.astype("<i4").tobytes()], [held[some].astype("<i8").tobytes()])

    return run


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for codes, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(codes, "<i4")), pa.array(np.frombuffer(counts, "<i8"))], names=["code", "df"]
            )


class Scorer:
    """Scores of a batch of documents for all items of one automaton.

    Sums are taken in doubles, which hold them exactly below 2^53; if an item
    has so many terms that they may not, halves of the numbers are summed."""

    def __init__(self, weights: np.ndarray, holders: list[np.ndarray], items: int, n_docs: int, n_terms: int):
        self.weights, self.items, self.n_docs, self.n_terms = weights, items, n_docs, n_terms
        sizes = np.array([len(h) for h in holders], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.flat = np.concatenate(holders) if holders else np.zeros(0, np.int64)
        common = np.flatnonzero(sizes >= max(8, items / 32))
        self.column = np.full(len(holders), -1, dtype=np.int64)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), items))
        for row, code in enumerate(common):
            self.matrix[row, holders[code]] = 1.0
        per_item = np.bincount(self.flat, minlength=items)
        top = int(per_item.max(initial=0)) * int(weights.max(initial=0)) * 1_000_000
        self.halves = top >= 1 << 53

    def _sum(self, docs: int, doc: np.ndarray, code: np.ndarray, value: np.ndarray) -> np.ndarray:
        column = self.column[code]
        often = column >= 0
        dense = np.zeros((docs, len(self.matrix)))
        dense[doc[often], column[often]] = value[often]
        out = dense @ self.matrix
        doc, code, value = doc[~often], code[~often], value[~often]
        sizes = self.offsets[code + 1] - self.offsets[code]
        which = np.repeat(np.arange(len(code)), sizes)
        to = self.flat[np.arange(len(which)) - (np.cumsum(sizes) - sizes)[which] + self.offsets[code][which]]
        out += np.bincount(doc[which] * self.items + to, value[which], docs * self.items).reshape(docs, self.items)
        return out.astype(np.int64)

    def scores(self, n: np.ndarray, doc: np.ndarray, code: np.ndarray, tf: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.n_docs) // max(self.n_terms, 1)
        value = self.weights[code] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        if not self.halves:
            return self._sum(len(n), doc, code, value)
        return (self._sum(len(n), doc, code, value >> 20) << 20) + self._sum(len(n), doc, code, value & 0xFFFFF)


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, null: np.ndarray, best: int):
    """The ``best`` rows of each item: highest score, then least doc_id, null last."""
    order = np.lexsort((doc, null, -score, item))
    item, score, doc, null = item[order], score[order], doc[order], null[order]
    begins = np.concatenate(([True], item[1:] != item[:-1])) if len(item) else np.zeros(0, bool)
    rank = np.arange(len(item)) - np.maximum.accumulate(np.where(begins, np.arange(len(item)), 0))
    keep = rank < best
    return item[keep], score[keep], doc[keep], null[keep]


def _score(shared: Broadcast, best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = shared.value
        scorer = Scorer(told["weights"], told["holders"], len(told["items"]), told["n_docs"], told["n_terms"])
        kept = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, bool),)
        least = np.zeros(scorer.items, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                n = np.array(part.column("n").to_pylist(), dtype=np.int64)
                ids = part.column("doc_id").to_pylist()
                null = np.array([d is None for d in ids], dtype=bool)
                ids = np.array([d or 0 for d in ids], dtype=np.int64)
                codes = part.column("codes").to_pylist()
                doc = np.repeat(np.arange(len(n)), [len(c) // 4 for c in codes])
                code = np.frombuffer(b"".join(codes), "<i4").astype(np.int64)
                tf = np.frombuffer(b"".join(part.column("counts").to_pylist()), "<i8")
                got = scorer.scores(n, doc, code, tf)
                floor = np.maximum(least, 1)
                if len(n) > best:
                    floor = np.maximum(floor, np.partition(got, len(n) - best, axis=0)[len(n) - best])
                d, i = np.nonzero(got >= floor)  # the best of this batch with all their equals
                kept = _best(*(np.concatenate(x) for x in zip(kept, (i, got[d, i], ids[d], null[d]))), best)
                full = np.bincount(kept[0], minlength=scorer.items) >= best
                lowest = np.full(scorer.items, np.iinfo(np.int64).max)
                np.minimum.at(lowest, kept[0], kept[1])
                least = np.where(full, lowest, 0)
        item, score, doc, null = kept
        salt = TaskContext.get().partitionId() // 64
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.asarray(told["items"], dtype=np.int64)[item]),
                pa.array(score),
                pa.array(doc, mask=null),
                pa.array(np.full(len(item), salt)),
            ],
            names=["item", "score", "doc_id", "salt"],
        )

    return run


def _top(rows: DataFrame, best: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _search(docs: DataFrame, items: DataFrame, best: int) -> DataFrame:
    """(item, rank, doc_id, score) for items (item, terms) whose terms fit one automaton."""
    spark = docs.sparkSession
    own = [(r["item"], r["terms"]) for r in items.collect()]  # bounded: MOST bytes of terms
    names = sorted({t for _, held in own for t in held})
    code = {t: c for c, t in enumerate(names)}
    holders: list[list[int]] = [[] for _ in names]
    for i, (_, held) in enumerate(own):
        for t in held:
            holders[code[t]].append(i)
    shared = spark.sparkContext.broadcast({"terms": names})
    scan = materialize(docs.mapInArrow(_scan(uuid.uuid4().hex, shared), SCAN), "term-counts")
    of_docs = scan.where(F.col("n") >= 0)
    n_docs, n_terms = of_docs.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    tallies = scan.where(F.col("n") < 0).select("codes", "counts").mapInArrow(_tallies, "code int, df long")
    weights = np.zeros(len(names), dtype=np.int64)
    for r in tallies.groupBy("code").agg(F.sum("df").alias("df")).collect():  # one row a term of the automaton
        weights[r["code"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1)))
    told = spark.sparkContext.broadcast(
        {
            "weights": weights,
            "holders": [np.array(h, dtype=np.int64) for h in holders],
            "items": [i for i, _ in own],
            "n_docs": n_docs,
            "n_terms": n_terms,
        }
    )
    hits = of_docs.where(F.length("codes") > 0)
    rows = materialize(hits.mapInArrow(_score(told, best), BEST), "best-of-tasks")
    return _top(_top(rows, best, "item", "salt").drop("rank"), best, "item").select("item", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, best: int = 50, most: int = MOST) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` (item_id, text)
    the ``best`` documents of highest score above 0, equal scores by ascending
    doc_id, a null doc_id last.

    N counts the documents with a term, L all their terms, n one document's; a
    term in df documents weighs floor(1000 ln((2N+2)/(2df+1))), and each of an
    item's distinct terms adds its weight times (10^9 tf) div (1000 tf + 20 m),
    where m = 50 + (50 n N) div L.

    Reads doc_id and text, item_id and text; other columns do not matter,
    whatever their names. A null or empty text has no terms: such a document
    counts nowhere, such an item finds nothing. Texts of any length are scanned
    whole. Rows with equal ids are documents, or items, of their own. An empty
    table of either kind gives no rows. An automaton takes about ``most`` bytes
    of terms, which is what is sent to all tasks; more items take more scans."""
    asked = items.select("item_id", F.array_distinct(terms(F.col("text"))).alias("terms"))
    asked = materialize(asked.withColumn("item", F.monotonically_increasing_id()), "search-items")
    some = asked.where(F.size("terms") > 0)
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t))
    blocks = max(1, -(-(some.agg(F.sum(size)).first()[0] or 0) // most))
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for b in range(blocks):
        own = some.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else some
        found.append(_search(bare, own.select("item", "terms"), best))
    return reduce(DataFrame.unionByName, found).join(asked.select("item", "item_id"), "item").select(
        "item_id", "rank", "doc_id", "score"
    )
