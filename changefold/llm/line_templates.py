"""Line dedup by a log-template tree of fixed depth.

A line's tokens that hold a digit are variable fields and become ``<*>``. The
line then falls to a leaf of the tree by its number of tokens and its leading
tokens. In a leaf, a token is a constant of a place where it recurs over
``support`` variants; a variant's template is its constants in their places,
everything else being variable. A template of which at least ``similarity`` is
constant and that occurs in ``support`` documents recurs: it stays in the
first document that has it and is dropped from all others. A line that recurs
to the letter, but for its digits, is the template without other fields; it
too needs ``similarity`` of its tokens constant. A line with more digits than
that (a row of numbers, dates, ids) is counted as it stands.

Beside the templates, lines may be counted to the letter: long ones recur from
``verbatim`` documents on, lines too short for the tree from ``brief`` / number
of tokens on, so the fewer words the more documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from changefold.llm.common import KEYS, keyed, sheltered
from changefold.session import materialize

_MASK = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"
_DROPPED = "__dropped"

#: The rule of the registered queries: a long line recurs to the letter in two
#: documents, one of 4, 3, 2 or 1 tokens in 10, 14, 20 or 40.
LETTER = {"verbatim": 2, "brief": 40}
#: Templates with fields beside digits of 5, 6 or 7 tokens recur from 8, 7 or 6 documents on.
SURE, FEW = 8, 40


def _tokens(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, _MASK, "<*>")).otherwise(line)
    return F.array_remove(F.split(masked, "[\\x20\\x09-\\x0D]+"), "")


def _as_is(line: Column) -> Column:
    """A hash of the tokens with their digits, unlike that of masked tokens."""
    return F.xxhash64(F.array_remove(F.split(line, "[\\x20\\x09-\\x0D]+"), ""), F.lit(1))


def _leaf(depth: int) -> Column:
    return F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))


def _lines(docs: DataFrame, least_tokens: int) -> DataFrame:
    """(keys, doc_id, at, line, tokens): the lines of so many tokens at least."""
    each = docs.select(*KEYS, "doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    each = each.where(F.char_length("line") >= 2 * least_tokens - 1)
    each = each.select(*KEYS, "doc_id", "at", "line", _tokens(F.col("line")).alias("tokens"))
    return each.where(F.size("tokens") >= least_tokens)


def recurring_lines(
    docs: DataFrame,
    least_tokens: int = 5,
    depth: int = 3,
    support: int = 3,
    similarity: float = 0.7,
    general: int = 5,
    verbatim: int | None = None,
    brief: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(lines, recurring): lines (keys, doc_id, at, leaf, sig) of ``keyed``
    docs as hashes, and (sig, first), the variants whose template recurs with
    the first doc_id of the template.

    Only templates of ``general`` tokens or more have fields beside digits;
    those of fewer than ``SURE`` tokens, of which chance makes some, recur from
    ``FEW`` / tokens documents on.
    Lines with less than ``similarity`` of their tokens free of digits are
    counted by a hash of the line with its digits. With ``verbatim`` so are
    all lines, from that many documents on; with ``brief`` also those of fewer
    than ``least_tokens`` tokens, from ``brief`` / tokens documents on. A line
    with digits then has two rows in lines, one for each way.
    Texts are cut into lines and tokens once. Lines are counted as hashes; their
    text is read again only in leaves with ``support`` variants. Counting is by
    partial sums, so a line in every document is one row a task."""
    n = F.size("tokens")
    fixed = F.size(F.array_remove("tokens", "<*>"))
    own, none = _as_is(F.col("line")), F.lit(0)  # none: no line of the tree
    exact_need = F.lit(support if verbatim is None else min(support, verbatim))

    spoken = F.when(n >= general, F.col("line"))

    def way(sig: Column, need: Column, n: Column, line: Column = F.lit(None).cast("string")) -> Column:
        return F.struct(sig.alias("sig"), need.cast("int").alias("need"), n.alias("n"), line.alias("line"))

    masked, letter = way(F.xxhash64("tokens"), F.lit(support), n, spoken), way(own, exact_need, none)
    both_ways = F.array(masked) if verbatim is None else F.array(masked, letter)
    ways = F.when(fixed == n, F.array(way(F.xxhash64("tokens"), exact_need, n, spoken)))
    ways = ways.when(fixed >= similarity * n, both_ways).otherwise(F.array(letter))
    if brief is not None:
        ways = F.when(n < least_tokens, F.array(way(own, F.ceil(F.lit(brief) / n), none))).otherwise(ways)
    lines = materialize(
        _lines(docs, least_tokens if brief is None else 1).select(
            *KEYS, "doc_id", "at", _leaf(depth).alias("leaf"), F.inline(ways)
        ),
        "lines",
    )
    once = lines.groupBy("sig", "leaf", "n", "need", *KEYS).agg(F.min("doc_id").alias("doc_id"))
    variants = materialize(
        once.groupBy("sig", "leaf", "n", "need").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")), "variants"
    )
    exact = variants.where(F.col("docs") >= F.col("need")).select("sig", "first")
    leaves = variants.where(F.col("n") >= general).groupBy("leaf").agg(F.count("*").alias("variants"))
    leaves = materialize(leaves.where(F.col("variants") >= support).select("leaf"), "leaves")
    said = lines.where(F.col("line").isNotNull()).select("leaf", "sig", "line").join(leaves, "leaf", "left_semi")
    said = said.groupBy("leaf", "sig").agg(F.first("line").alias("line")).select("leaf", "sig", _tokens(F.col("line")).alias("tokens"))
    tokens = materialize(
        said.select("leaf", "sig", F.size("tokens").alias("n"), F.posexplode("tokens").alias("at", "token"))
        .where(F.col("token") != "<*>")
        .select("leaf", "sig", "n", "at", F.xxhash64("token").alias("token")),
        "template-tokens",
    )
    place = ["leaf", "at", "token"]
    constants = tokens.groupBy(*place).agg(F.count("*").alias("c")).where(F.col("c") >= support).drop("c")
    shape = (
        tokens.join(constants, place)
        .groupBy("leaf", "sig", "n")
        .agg(F.count("*").alias("fixed"), F.bit_xor(F.xxhash64("at", "token")).alias("template"))
        .where(F.col("fixed") >= similarity * F.col("n"))
    )
    shaped = shape.join(variants.select("leaf", "sig", "docs", "first"), ["leaf", "sig"])
    shaped = materialize(shaped, "templates")
    per = shaped.groupBy("leaf", "template").agg(
        F.count("*").alias("variants"), F.sum("docs").alias("docs"), F.min("first").alias("least"), F.max("n").alias("n")
    )
    enough = F.when(F.col("n") < SURE, F.greatest(F.lit(support), F.ceil(F.lit(FEW) / F.col("n")))).otherwise(support)
    per = per.where((F.col("variants") > 1) & (F.col("docs") >= enough))
    fielded = shaped.join(per.select("leaf", "template", "least"), ["leaf", "template"]).select(
        "sig", F.col("least").alias("first")
    )
    both = exact.union(fielded).groupBy("sig").agg(F.min("first").alias("first"))
    return lines, materialize(both, "recurring")


def mark_dropped(docs: DataFrame, **options) -> DataFrame:
    """``docs`` plus ``__key1``, ``__key2`` and ``__dropped``: numbers (from 0)
    of the \\n-split lines to drop, null for none."""
    own = keyed(docs)
    lines, recurring = recurring_lines(own, **options)
    gone = lines.join(recurring, "sig").where(F.coalesce(F.col("doc_id") != F.col("first"), F.col("first").isNotNull()))
    gone = materialize(
        gone.groupBy(*KEYS).agg(F.sort_array(F.collect_set("at")).alias(_DROPPED)), "dropped-lines"
    )
    return own.join(gone, list(KEYS), "left")


def _left(text: Column, dropped: Column) -> Column:
    """The lines of ``text`` that are not in the sorted ``dropped``."""
    lines = F.split(text, "\n")
    marks = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped)
    return F.when(dropped.isNull(), text).otherwise(F.array_join(F.transform(marks, lambda i: F.get(lines, i)), "\n"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with recurring lines dropped from ``text``, plus n_lines and
    n_dropped (long) under ``__n_lines`` and ``__n_dropped``.

    Reads doc_id and text; other columns pass through whatever their names, but
    for one named like a column added, which gives way. A null text stays null
    and has no lines; a text of any length is read whole. Lines of fewer than
    ``least_tokens`` tokens stay unless ``brief`` is given. The smallest doc_id that has a
    template keeps all its lines of it; a null doc_id keeps them only if no
    document with an id has it. Equal rows count as one document and get equal
    texts. A document that loses all lines has an empty text. An empty table
    gives no rows."""
    inner, back = sheltered(docs, ("doc_id", "text"))
    told = mark_dropped(inner, **options)
    text = F.col("text")
    n = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n")))
    told = told.withColumns({"__n_lines": n.cast("long"), "__n_dropped": F.coalesce(F.size(_DROPPED), F.lit(0)).cast("long")})
    told = told.withColumn("__n_dropped", F.greatest(F.col("__n_dropped"), F.lit(0).cast("long")))
    told = told.withColumn("text", _left(text, F.col(_DROPPED)))
    return back(told, ["__n_lines", "__n_dropped"])
