"""Embedding near-duplicates by Euclidean p-stable hashing.

Normalised vectors at cosine c lie sqrt(2 - 2c) apart. A table hashes a vector
by ``k`` quantised Gaussian projections, floor((a.x + b) / w); near vectors
fall into one bucket in some of the ``tables``. At cosine 0.93 one projection
agrees with probability 0.85, a table of 16 with 0.08 and one of 96 tables
with 0.9995; nearer pairs hardly ever fail. Unrelated vectors agree in a table
once in a hundred thousand. Every pair of a bucket is then held to its exact
cosine, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from changefold.llm.common import contiguous, partitions
from changefold.llm.components import connected_components
from changefold.session import materialize

CELL = ["space", "bucket", "t", "low", "high"]


@lru_cache(4)
def _projections(dim: int, tables: int, k: int, width: float, seed: int):
    rng = np.random.default_rng([seed, dim])
    odd = rng.integers(1, 2**62, size=(tables, k), dtype=np.int64) | 1
    return rng.standard_normal((dim, tables * k)), rng.uniform(0, width, tables * k), odd


def _bodies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors as bytes of doubles; null for those that link with nothing."""

    def body(v, label):
        if v is None or label is None or not len(v):
            return None
        x = np.array([np.nan if e is None else e for e in v], dtype=np.float64)
        return x.tobytes() if np.isfinite(x).all() and x.any() else None

    for frame in frames:
        made = [body(v, l) for v, l in zip(frame["embedding"], frame["label"])]
        yield pd.DataFrame({"vec_id": frame["vec_id"], "label": frame["label"], "body": made})


def _hashed(tables: int, k: int, width: float, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, own in frame.groupby(frame["body"].str.len(), sort=False):
                x = np.stack([np.frombuffer(b, np.float64) for b in own["body"]])
                x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the norm
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                a, shift, odd = _projections(x.shape[1], tables, k, width, seed)
                cells = np.floor((x @ a + shift) / width).astype(np.int64).reshape(len(x), tables, k)
                with np.errstate(over="ignore"):
                    h = (cells * odd).sum(axis=2)
                yield pd.DataFrame(
                    {"node": own["node"].to_numpy(), "space": own["space"].to_numpy(), "mult": own["mult"].to_numpy(), "unit": [r.tobytes() for r in x], "hashes": list(h)}
                )

    return run


def _verify(least: float, chunk: int = 100_000):
    def links(g: pd.DataFrame) -> pd.DataFrame | None:
        x = np.stack([np.frombuffer(b, np.float64) for b in g["unit"]])
        h, t = np.stack(g["hashes"].to_list()), int(g["t"].iloc[0])
        side, mult, node = g["side"].to_numpy(), g["mult"].to_numpy(), g["node"].to_numpy()
        near = np.triu(x @ x.T >= least, 1)
        if g["low"].iloc[0] != g["high"].iloc[0]:
            near &= side[:, None] != side[None, :]
        i, j = np.nonzero(near)
        fresh = np.ones(len(i), dtype=bool)  # a pair counts in the first table where it meets
        for at in range(0, len(i), chunk):
            p = slice(at, at + chunk)
            fresh[p] = ~(h[i[p], :t] == h[j[p], :t]).any(axis=1)
        i, j = i[fresh], j[fresh]
        if not len(i):
            return None
        n = np.bincount(i, mult[j], len(g)) + np.bincount(j, mult[i], len(g))
        root = np.arange(len(g))
        while True:  # smallest row reachable
            before = root.copy()
            np.minimum.at(root, i, root[j])
            np.minimum.at(root, j, root[i])
            root = root[root]
            if (before == root).all():
                break
        out = pd.DataFrame({"node": node, "links": n.astype(np.int64), "other": node[root]})
        return out[out["links"] > 0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in contiguous(frames, CELL):
            if len(g) > 1 and (found := links(g)) is not None:
                yield found

    return run


def embedding_components(
    vectors: DataFrame,
    least: float = 0.93,
    tables: int = 96,
    k: int = 16,
    width: float = 2.0,
    seed: int = 7,
    block: int = 2048,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``.

    Reads vec_id, embedding and label. Only vectors of one label and one
    length are compared. A vector that is null, empty, all zero or holds a
    null or non-finite component, or whose label is null, links with nothing:
    n_links 0 and component_id its own id. Rows with equal vectors link by
    definition (each other row counts once, equal ids too) and are hashed
    once. Null ids count for a component only where it has no other.

    A bucket of more than ``block`` vectors is cut into blocks and every pair
    of its blocks is a group of its own, so no task holds more than two.
    """
    rows = vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    whole = rows.mapInPandas(_bodies, "vec_id long, label string, body binary")
    space = F.xxhash64("label", F.length("body"))
    whole = materialize(
        whole.withColumns({"space": space, "node": F.when(F.col("body").isNotNull(), F.xxhash64("label", "body"))}),
        "vectors",
    )
    each = whole.where(F.col("body").isNotNull()).groupBy("node", "space", "body")
    each = each.agg(F.count("*").alias("mult"), F.min("vec_id").alias("first"))
    each = materialize(each, "distinct-vectors")
    hashed = materialize(
        each.select("node", "space", "body", "mult").mapInPandas(
            _hashed(tables, k, width, seed), "node long, space long, mult long, unit binary, hashes array<long>"
        ),
        "hashed-vectors",
    )
    keys = hashed.select("space", "node", F.posexplode("hashes").alias("t", "bucket"))
    at = ["space", "t", "bucket"]
    counts = keys.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    dealt = (
        keys.join(counts, at)
        .withColumn("blocks", blocks)
        .withColumn("side", F.pmod(F.hash("node"), F.col("blocks")))
        .withColumn("against", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "t", "bucket", "side", F.least("side", "against").alias("low"), F.greatest("side", "against").alias("high"))
    )
    found = materialize(
        dealt.join(hashed, "node")
        .repartition(partitions(vectors), *CELL)
        .sortWithinPartitions(*CELL)
        .mapInPandas(_verify(least), "node long, links long, other long"),
        "vector-links",
    )
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = (
        each.select("node", "mult", "first")
        .join(links, "node", "left")
        .join(roots, "node", "left")
        .withColumns({"root": F.coalesce("root", "node"), "links": F.col("mult") - 1 + F.coalesce("links", F.lit(0))})
    )
    least_id = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least_id, "root").select("node", "links", "component")
    component = F.coalesce("component", "vec_id")
    return whole.join(named, "node", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
