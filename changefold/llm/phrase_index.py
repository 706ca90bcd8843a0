"""Benchmark decontamination by a positional inverted index.

Documents are read once into an index table. A segment holds whole documents
of about ``SEGMENT`` words, numbered through from 0; for each of its terms the
table has one row with the places where it stands (``index_documents``). One
row more, without a term, lists the segment's documents.

A window of an item's words is looked up from its rarest term: each of that
term's places, less the term's offset in the window, is a place where the
window may start, and the lists of the other terms, rarest first, strike out
the starts that lack them (``find_windows``). With ``slop`` above 0 a word may
stand up to so many words from its place: a proximity match. Lists are read
for the items' terms alone and meet by segment, so a term that stands in every
document is dealt over all segments.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from changefold.session import materialize

SEGMENT = 1 << 20  # words; a document is never cut
MOST = 1 << 20  # words of distinct windows that one pass over the index looks up
CANDIDATES = 1 << 22  # starts that are checked at a time
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

INDEX = (
    "segment long, term string, n long, places binary, doc_ids array<long>, firsts array<int>, counts array<int>"
)
HITS = "segment long, doc int, windows array<long>, starts array<int>, stops array<int>"


def words(text: Column) -> Column:
    """Array of the words of a text, A-Z lower-cased (null: none)."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _gaps(places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each list's places as distances, its first as it is: few distinct bytes to store."""
    out = np.diff(places, prepend=places[:1] * 0)
    starts = offsets[:-1]
    out[starts] = places[starts]
    return out


def _segment_batch(number: int, codes: dict[bytes, int], held: list[np.ndarray], docs: list, counts: list[int]):
    at = np.concatenate(held) if held else np.zeros(0, np.int32)
    order = np.argsort(at, kind="stable").astype(np.int32)
    sizes = np.bincount(at, minlength=len(codes))
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    blob = _gaps(order, offsets) if len(order) else order
    places = pa.Array.from_buffers(
        pa.binary(), len(codes), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(blob.astype("<i4"))]
    )
    n, rows = len(codes), len(codes) + 1
    counted = np.array(counts, dtype=np.int64)

    def last(value, kind):
        return pa.array([None] * n + [value], kind)

    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(rows, number)),
            pa.concat_arrays([pa.array(list(codes), pa.binary()).cast(pa.string()), pa.nulls(1, pa.string())]),
            pa.array([*sizes.tolist(), None], pa.int64()),
            pa.concat_arrays([places, pa.nulls(1, pa.binary())]),
            last(docs, pa.list_(pa.int64())),
            last((np.cumsum(counted) - counted).tolist(), pa.list_(pa.int32())),
            last(counts, pa.list_(pa.int32())),
        ],
        names=["segment", "term", "n", "places", "doc_ids", "firsts", "counts"],
    )


def _segments(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32

        def fresh():
            codes: defaultdict[bytes, int] = defaultdict()
            codes.default_factory = codes.__len__
            return codes, [], [], []

        codes, held, docs, counts = fresh()
        size = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = _WORD.findall(text.as_py().lower()) if text.is_valid else []  # bytes: only A-Z changes
                docs.append(doc)
                counts.append(len(found))
                held.append(np.fromiter(map(codes.__getitem__, found), np.int32, len(found)))
                size += len(found)
                if size >= most:
                    yield _segment_batch(number, codes, held, docs, counts)
                    codes, held, docs, counts = fresh()
                    size, number = 0, number + 1
        if docs:
            yield _segment_batch(number, codes, held, docs, counts)

    return run


def index_documents(docs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The index of all rows of ``docs`` (doc_id, text), written to the shared
    folder: ``INDEX``. ``places`` are 32-bit distances.

    Reads doc_id and text; other columns do not matter, whatever their names. A
    null or empty text is a document without words. A doc_id may be null or
    repeat: every row is a document of its own. A text of any length is indexed
    whole, in one segment. An empty table has an empty index."""
    bare = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(bare.mapInArrow(_segments(segment), INDEX), "phrase-index")


def item_windows(items: DataFrame, window: int = 10) -> DataFrame:
    """(window, item_id, terms): each run of ``window`` words of an item's text;
    an item of fewer words, but not none, is one window. ``window`` is a hash
    of the terms, the same in all items that share them."""
    spoken = items.select("item_id", words(F.col("text")).alias("w"))
    n = F.size("w")
    runs = F.when(n > window, F.transform(F.sequence(F.lit(1), n - window + 1), lambda i: F.slice("w", i, window)))
    cut = spoken.where(n > 0).select("item_id", F.explode(F.coalesce(runs, F.array("w"))).alias("terms"))
    return cut.select(F.xxhash64("terms").alias("window"), "item_id", "terms").distinct()


def _starts_of(wanted: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists ``wanted``: which of them, and the index of each of their places."""
    sizes = offsets[wanted + 1] - offsets[wanted]
    which = np.repeat(np.arange(len(wanted)), sizes)
    ahead = np.cumsum(sizes) - sizes
    return which, np.arange(len(which)) - ahead[which] + offsets[wanted][which]


def _intersect(slop: int):
    def run(asked: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame(columns=["segment", "doc", "windows", "starts", "stops"], dtype=object)
        head = lists["term"].isna().to_numpy()
        if not len(asked) or not head.any():
            return none
        firsts = np.asarray(lists["firsts"][head].iloc[0], dtype=np.int64)
        counts = np.asarray(lists["counts"][head].iloc[0], dtype=np.int64)
        own = lists[~head]
        code = {t: i for i, t in enumerate(own["term"])}
        blobs = own["places"].tolist()
        offsets = np.concatenate(([0], np.cumsum([len(b) // 4 for b in blobs]))).astype(np.int64)
        gaps = np.frombuffer(b"".join(blobs), "<i4").astype(np.int64)
        run_sum = np.cumsum(gaps)
        sizes = np.diff(offsets)
        of = np.repeat(np.arange(len(blobs)), sizes)
        places = run_sum - (run_sum - gaps)[offsets[:-1]][of]
        keys = (of << 32) | places  # ascending: by list, then place

        lengths = asked["terms"].str.len().to_numpy()
        widest = int(lengths.max())
        table = np.full((len(asked), widest), -1, dtype=np.int64)
        for i, terms in enumerate(asked["terms"]):
            table[i, : lengths[i]] = [code.get(t, -1) for t in terms]
        there = ((table >= 0).sum(axis=1) == lengths) & (lengths > 0)
        table, lengths = table[there], lengths[there]
        ids, anchors = asked["window"].to_numpy()[there], asked["anchor"].to_numpy()[there].astype(np.int64)
        if not len(ids):
            return none
        rarity = np.where(table >= 0, sizes[table], np.iinfo(np.int64).max)
        rarity[np.arange(len(ids)), anchors] = -1  # the anchor is the first
        order = np.argsort(rarity, axis=1, kind="stable")

        anchor_lists = table[np.arange(len(ids)), anchors]
        load = np.cumsum(sizes[anchor_lists])
        cuts = np.searchsorted(load, np.arange(CANDIDATES, int(load[-1]) + CANDIDATES, CANDIDATES), "left") + 1
        marks = np.zeros(int(counts.sum()) + 1, dtype=np.int64)
        pairs = []
        at = 0
        for cut in [*cuts.tolist(), len(ids)]:
            some = np.arange(at, min(cut, len(ids)))
            at = max(at, cut)
            if not len(some):
                continue
            which, place = _starts_of(anchor_lists[some], offsets)
            which = some[which]
            anchor = places[place]
            start = anchor - anchors[which]
            doc = np.searchsorted(firsts, anchor, "right") - 1
            low, high = firsts[doc], firsts[doc] + counts[doc] - 1
            for k in range(1, widest):
                slot = order[which, k]
                term = table[which, slot]
                least = np.maximum(start + slot - slop, low)
                most = np.minimum(start + slot + slop, high)
                found = np.searchsorted(keys, (term << 32) | least)
                ok = (term < 0) | (
                    (least <= most) & (keys[np.minimum(found, len(keys) - 1)] <= ((term << 32) | most)) & (found < len(keys))
                )
                which, start, doc, low, high = which[ok], start[ok], doc[ok], low[ok], high[ok]
            np.add.at(marks, np.maximum(start, low), 1)
            np.add.at(marks, np.minimum(start + lengths[which] - 1, high) + 1, -1)
            pairs.append(np.unique(np.stack((doc, ids[which]), axis=1), axis=0))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        if not len(pairs):
            return none
        hit = np.cumsum(marks)[:-1] > 0
        border = np.zeros(len(hit) + 1, dtype=bool)
        border[firsts] = True  # a span ends with its document
        before = np.concatenate(([False], hit[:-1]))
        begins = np.flatnonzero(hit & (~before | border[:-1]))
        after = np.concatenate((hit[1:], [False]))
        ends = np.flatnonzero(hit & (~after | border[1:])) + 1
        span_doc = np.searchsorted(firsts, begins, "right") - 1
        docs, cut = np.unique(pairs[:, 0], return_index=True)
        left, right = np.searchsorted(span_doc, docs, "left"), np.searchsorted(span_doc, docs, "right")
        return pd.DataFrame(
            {
                "segment": int(lists["segment"].iloc[0]),
                "doc": docs.astype(np.int32),
                "windows": np.split(pairs[:, 1], cut[1:]),
                "starts": [(begins[a:b] - firsts[d]).astype(np.int32) for d, a, b in zip(docs, left, right)],
                "stops": [(ends[a:b] - firsts[d]).astype(np.int32) for d, a, b in zip(docs, left, right)],
            }
        )

    return run


def find_windows(index: DataFrame, windows: DataFrame, slop: int = 0, most: int = MOST) -> DataFrame:
    """Occurrences of ``item_windows`` in an index, one row per document that
    has any (``HITS``): the document's number in its segment, the windows, and
    the spans of words from ``starts`` to before ``stops`` that they cover, in
    words of the document, joined where they meet.

    ``slop`` 0: exact phrases. Above 0: the window's rarest term (of all
    documents; the first such place of the window) stands somewhere, and every
    other word at most ``slop`` words from where that puts it, all in one
    document; the span is the window's length from where its first word
    belongs. A pass over the index looks up about ``most`` words of windows,
    which is what it broadcasts; more windows take more passes, so any number
    is found. A match never spans two documents."""
    distinct = materialize(windows.select("window", "terms").dropDuplicates(["window"]), "windows")
    total = distinct.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-total // most))
    found = []
    for i in range(passes):
        own = distinct.where(F.pmod(F.xxhash64("window"), F.lit(passes)) == i) if passes > 1 else distinct
        each = own.select("window", "terms", F.posexplode("terms").alias("anchor", "term"))
        terms = F.broadcast(each.select("term").distinct())  # at most about `most` words
        lists = index.where(F.col("term").isNotNull()).join(terms, "term", "left_semi")
        often = lists.groupBy("term").agg(F.sum("n").alias("often"))
        rarest = (
            each.join(often, "term")
            .groupBy("window")
            .agg(
                F.min_by(F.struct("term", "anchor", "terms"), F.struct("often", "anchor")).alias("rarest"),
                F.count("*").alias("known"),
            )
            .where(F.col("known") == F.size("rarest.terms"))  # a term that stands nowhere ends the search
            .select("window", "rarest.*")
        )
        rarest = F.broadcast(materialize(rarest, "rarest-terms"))
        asked = lists.select("segment", "term").join(rarest, "term").select(
            F.col("segment").alias("in_segment"), "window", "anchor", "terms"
        )
        heads = index.where(F.col("term").isNull())
        full = lists.unionByName(heads).select("segment", "term", "places", "firsts", "counts")
        found.append(
            asked.groupBy("in_segment").cogroup(full.groupBy("segment")).applyInPandas(_intersect(slop), HITS)
        )
    return materialize(reduce(DataFrame.unionByName, found), "phrase-hits")


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, slop: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside a match),
    n_items, item_ids (sorted as strings), items_sha256 (of item_ids joined by
    commas) and contaminated (n_hit above 0).

    Documents: see ``index_documents``. An item whose text is null or has no
    word matches nothing. Items with equal ids count once; one with a null id
    makes hits and counts as the id "". Ties do not matter: all matches count.
    Without items, or in an empty table of documents, nothing is hit."""
    index = index_documents(docs)
    windows = materialize(item_windows(items, window), "item-windows")
    hits = find_windows(index, windows, slop)
    place = ["segment", "doc"]
    spans = F.flatten(F.collect_list(F.arrays_zip("starts", "stops")))
    covered = F.aggregate(
        F.array_sort(F.col("spans")),
        F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(
            F.greatest(a["stop"], s["stops"]).alias("stop"),
            (a["n"] + F.greatest(F.lit(0), s["stops"] - F.greatest(s["starts"], a["stop"]))).alias("n"),
        ),
        lambda a: a["n"],
    )
    hit = hits.groupBy(*place).agg(spans.alias("spans")).select(*place, covered.alias("n_hit"))
    named = (
        hits.select(*place, F.explode("windows").alias("window"))
        .join(windows.select("window", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")), "window")
        .groupBy(*place)
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    heads = index.where(F.col("term").isNull()).select(
        "segment", F.posexplode(F.arrays_zip("doc_ids", "counts")).alias("doc", "_d")
    )
    out = heads.join(hit, place, "left").join(named, place, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        F.col("_d.doc_ids").alias("doc_id"),
        F.col("_d.counts").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        ids.alias("item_ids"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
