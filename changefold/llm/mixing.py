"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source whose target is x times the source's size is to be
taken x times: floor(x) copies for certain and one more with probability
x - floor(x). The fractions are rounded together: a pair of documents passes
words from one to the other, at random but without bias, until one of the two
is taken or left; so the words of the pair, and of the whole source, stay as
they were. Blocks of a source do this side by side and each leaves at most
one document undecided; these meet in blocks again, up a tree, until one is
left per source, which is drawn by its fraction.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from changefold.llm.common import KEYS, contiguous, keyed, partitions, sheltered, words
from changefold.session import materialize

CARRIED = "__key1 long, __key2 int, doc_id long, size long, rank int, source_size long, target double, whole int, p double"
TINY = 1e-9


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, rank, source_size, n, target): one row per source.

    Sources in code-point order, null last, weigh ``weights`` in turn. Filling
    them in the order of cap to weight finds the level at which the uncapped
    share what the capped leave; it is the fixed point of handing on the
    excess. The window runs over one narrow row per source."""
    everywhere = Window.partitionBy()
    per = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("n")
    )
    per = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    per = per.withColumns(
        {
            "weight": F.element_at(
                F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") - 1) % len(weights) + 1
            ),
            "most": F.lit(float(cap)) * F.col("source_size"),
        }
    ).withColumn("ratio", F.col("most") / F.col("weight"))
    order = Window.orderBy("ratio", "rank")
    before = F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn(
        "level", (F.lit(float(share)) * F.sum("source_size").over(everywhere) - before) / rest
    ).withColumn("capped", F.col("ratio") <= F.col("level"))
    # past the first uncapped source the level only falls
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everywhere)
    return per.select(
        "source",
        "rank",
        "source_size",
        "n",
        F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * level).alias("target"),
    )


def _settle(p: list[float], s: list[int], rng: random.Random, last: bool) -> None:
    """Rounds ``p`` in place; at most one entry stays fractional unless ``last``."""
    held = -1
    for i in range(len(p)):
        if held < 0:
            held = i if 0.0 < p[i] < 1.0 else -1
            continue
        a, b = p[held], p[i]
        if not 0.0 < b < 1.0:
            continue
        sa, sb = s[held], s[i]
        up, down = min((1 - a) * sa, b * sb), min(a * sa, (1 - b) * sb)
        moved = up if rng.random() * (up + down) < down else -down
        a, b = a + moved / sa, b - moved / sb
        a = 0.0 if a < TINY else 1.0 if a > 1 - TINY else a
        b = 0.0 if b < TINY else 1.0 if b > 1 - TINY else b
        p[held], p[i] = a, b
        if not 0.0 < a < 1.0:
            held = i if 0.0 < b < 1.0 else -1
    if held >= 0 and last:
        p[held] = float(rng.random() < p[held])


def _round_blocks(seed: int, level: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in contiguous(frames, ["rank", "block"]):
            key = f"{seed}/{level}/{g['rank'].iloc[0]}/{g['block'].iloc[0]}"
            p = g["p"].tolist()
            _settle(p, g["size"].tolist(), random.Random(xxhash.xxh64_intdigest(key)), bool(g["blocks"].iloc[0] == 1))
            yield g.drop(columns=["block", "blocks"]).assign(p=p)

    return run


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    block: int = 4096,
) -> DataFrame:
    """How often each document is taken, one row per row of ``docs``.

    Reads doc_id, text and source; other columns may have any name. Returns
    __key1 and __key2 (see ``keyed``), doc_id, size (words of the text),
    source_size, target (words, of its source), copies and taken (words).

    ``share`` of all words is shared by weight, no source beyond ``cap`` times
    its size. A source's taken words differ from its target by less than one
    of its documents. Draws follow from ``seed`` and the rows' content, so
    reruns and other partitionings agree. A null or empty text has size 0 and
    copies 0; a null source is a source of its own, a null doc_id an ordinary
    one; equal rows are separate documents; an empty table gives no rows.
    """
    texts = keyed(docs).select(*KEYS, "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"))
    sized = materialize(texts, "sizes")
    per = materialize(source_targets(sized, weights, share, cap), "targets")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = per.withColumnRenamed("source", "__source")
    planned = (
        sized.join(at, sized["source"].eqNullSafe(at["__source"]))
        .withColumn("x", x)
        .withColumn("whole", F.floor(F.col("x") + F.lit(TINY)).cast("int"))
        .withColumn("p", F.greatest(F.col("x") - F.col("whole"), F.lit(0.0)))
        .withColumn("p", F.when((F.col("size") > 0) & (F.col("p") > TINY), F.col("p")).otherwise(0.0))
    )
    names = [f.split()[0] for f in CARRIED.split(", ")]
    done = [planned.where(F.col("p") == 0).select(*names)]
    todo = planned.where(F.col("p") > 0).withColumn("blocks", F.ceil(F.col("n") / block)).select(*names, "blocks")
    level = 0
    while True:
        mixed = F.xxhash64("__key1", "__key2", F.lit(seed + level))
        dealt = todo.withColumn("block", F.pmod(mixed, F.col("blocks")))
        rounded = materialize(
            dealt.repartition(partitions(docs), "rank", "block")
            .sortWithinPartitions("rank", "block", mixed, *KEYS)
            .mapInPandas(_round_blocks(seed, level), CARRIED),
            f"rounded{level}",
        )
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rounded.where(~open_))
        left = rounded.where(open_)
        if left.isEmpty():
            break
        count = left.groupBy("rank").agg(F.ceil(F.count("*") / block).alias("blocks"))
        todo, level = left.join(count, "rank").select(*names, "blocks"), level + 1
    whole = done[0]
    for more in done[1:]:
        whole = whole.union(more)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.round("p").cast("int")).otherwise(0)
    return whole.select(
        *KEYS, "doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with every row repeated as often as ``mixed`` takes it.

    Rows equal in every column are collapsed before the join and their copies
    added, so that each decision counts once; both sides are hashed by the
    same unique key, so no group is hot. Columns may have any name."""
    n = "__copies"
    inner, back = sheltered(docs, ())
    per = mixed.groupBy(*KEYS).agg(F.sum("copies").alias(n)).where(F.col(n) > 0)
    one = keyed(inner).dropDuplicates(list(KEYS))
    out = one.join(per, list(KEYS))
    return back(out.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))))
