"""Column helpers and streaming group iteration shared by the operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: Word separators of every contract: space and the controls 9 to 13.
GAP = "[\\x20\\x09-\\x0D]+"
KEYS = ("__key1", "__key2")


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters (null: empty)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType))


def keyed(df: DataFrame) -> DataFrame:
    """``df`` plus two hash columns (96 bits together, never null) that name a
    row's content. Rows equal in every column share them; maps and variants,
    which Spark cannot hash, do not count."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields if _hashable(f.dataType)] or [F.lit(0)]
    return df.withColumns({KEYS[0]: F.xxhash64(*cols), KEYS[1]: F.hash(*cols)})


def sheltered(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with all columns but ``own`` under names that no operator uses,
    and a function that gives a result its columns' names back. ``added``
    columns come last; one of ``docs`` with the name of an added one gives way."""
    names = {c: c if c in own else f"x{i}" for i, c in enumerate(docs.columns)}

    def back(result: DataFrame, added: Iterable[str] = ()) -> DataFrame:
        added = list(added)
        return result.select(*[F.col(n).alias(c) for c, n in names.items() if c not in added], *added)

    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), back


def contiguous(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a stream of batches sorted by the integer columns ``keys``.

    One group at a time is held, whatever the batches' borders."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in frames:
        if not len(frame):
            continue
        k = frame[keys].to_numpy()
        cuts = (np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(frame)]):
            own = tuple(k[a])
            if last is not None and own != last:
                yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)
                held = []
            held.append(frame.iloc[a:b])
            last = own
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held, ignore_index=True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def importable(spark: SparkSession) -> None:
    """Lets Python workers started from here on import this package from where
    the driver has it (a cluster may install it instead)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    have = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *have])
