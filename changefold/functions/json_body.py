"""Decoding the JSON body of an event.

``from_json`` with an explicit schema ignores unknown fields, maps fields by
exact (case-sensitive) name, lets the last of duplicate keys win, and -- in
PERMISSIVE mode with a corrupt-record column -- flags any body it cannot map:
malformed or truncated text, and values of the wrong type (``"namespace":
"abc"``, ``"namespace": 0.0``, an out-of-range int, ``"length": 5``). A
flagged body is rejected as a whole; defaults are applied only to clean
bodies.

Three things ``from_json`` alone lets pass are closed in the same parse. The
text is decoded as the one element of an array, so that text after the
closing brace, a second object or a root array spoils it. A text could close
that array itself and go on outside (``{...}],"x":[1`` or ``{...}]} tail``);
it would need a square bracket, outside its strings, that it has not opened,
and a text with one is not decoded at all (``_stays_inside``). String fields
are decoded as variants, which keep the token's own type, so that a number or
an object in a string field is seen and rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changefold.schema import CORRUPT_COL, EDIT_BODY, REQUIRED_FIELDS

_JSON_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT_COL,
    "allowSingleQuotes": "false",
    "allowUnquotedFieldNames": "false",
    "allowComments": "false",
    "allowNumericLeadingZeros": "false",
    "allowNonNumericNumbers": "false",
}

_STRING_FIELDS = ("type", "wiki", "title", "user", "server_name", "comment")
_ONE = "body"
_WRAPPED = T.StructType(
    [
        T.StructField(
            _ONE,
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(f.name, T.VariantType() if f.name in _STRING_FIELDS else f.dataType)
                        for f in EDIT_BODY.fields
                        if f.name != CORRUPT_COL
                    ]
                )
            ),
        ),
        T.StructField(CORRUPT_COL, T.StringType()),
    ]
)


def _stays_inside(text: Column) -> Column:
    """False iff a ``]`` outside the text's strings closes more than the text has
    opened: only so can it leave the array that it is decoded in.

    The parse proves nesting and strings as far as it reads, so up to the first
    such bracket strings are what stands between two quotes that no backslash
    precedes. Nearly all bodies have no ``]``, or only in strings, and stop at
    the first or second test; depth is counted over the brackets of the rest."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\\.", ""), '"[^"]*"', "")
    only = F.regexp_replace(bare, r"[^\[\]]", "")
    steps = F.transform(F.split(only, ""), lambda c: F.when(c == "[", 1).when(c == "]", -1).otherwise(0))
    run = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda a, x: F.struct((a["depth"] + x).alias("depth"), F.least(a["least"], a["depth"] + x).alias("least")),
        lambda a: a["least"] >= 0,
    )
    return F.when(~text.contains("]"), True).when(~bare.contains("]"), True).otherwise(run)


def decode_body(value: Column | str = "value") -> Column:
    """The body in its wrapper, for ``body_field``, ``body_text`` and
    ``body_accepted`` (null for null text and for text that leaves the wrapper).
    Compute it once per record, as a
    column of its own."""
    col = F.col(value) if isinstance(value, str) else value
    decoded = F.from_json(F.concat(F.lit(f'{{"{_ONE}":['), col, F.lit("]}")), _WRAPPED, _JSON_OPTIONS)
    return F.when(_stays_inside(col), decoded)


def body_field(body: Column, name: str) -> Column:
    """A field that is not text."""
    return F.get(body[_ONE], F.lit(0))[name]


def body_text(body: Column, name: str) -> Column:
    """A text field; null if it is absent, JSON null or not a string."""
    token = body_field(body, name)
    return F.when(F.schema_of_variant(token) == "STRING", F.try_variant_get(token, "$", "string"))


def body_accepted(body: Column) -> Column:
    """True iff the decoded body is a well-formed edit: one object, nothing
    flagged corrupt, every field without a default present and non-null, and
    every text field a JSON string (or, with a default, null or absent)."""
    checks = [body.isNotNull(), body[CORRUPT_COL].isNull(), F.size(body[_ONE]) == 1]
    for name in REQUIRED_FIELDS:
        checks.append((body_text if name in _STRING_FIELDS else body_field)(body, name).isNotNull())
    for name in set(_STRING_FIELDS) - set(REQUIRED_FIELDS):
        token = body_field(body, name)
        checks.append(token.isNull() | F.is_variant_null(token) | body_text(body, name).isNotNull())
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def body_columns(body: Column) -> list[Column]:
    """The fields of a decoded body as columns ``_<name>``, text as text, and
    ``_clean``: nothing is wrong with it but for what ``columns_accepted`` asks of
    the fields. Selected once, so that no token is read again for the decision,
    the output and the counters, and generated methods stay small enough to be
    compiled."""
    out = [
        (body_text if f.name in _STRING_FIELDS else body_field)(body, f.name).alias(f"_{f.name}")
        for f in EDIT_BODY.fields
        if f.name != CORRUPT_COL
    ]
    clean = body.isNotNull() & body[CORRUPT_COL].isNull() & (F.size(body[_ONE]) == 1)
    for name in set(_STRING_FIELDS) - set(REQUIRED_FIELDS):
        token = body_field(body, name)
        kind = F.schema_of_variant(token)
        clean = clean & (token.isNull() | F.is_variant_null(token) | (kind == "STRING"))
    return [*out, F.coalesce(clean, F.lit(False)).alias("_clean")]


def columns_accepted() -> Column:
    """``body_accepted`` over the columns of ``body_columns``."""
    return reduce(lambda a, b: a & b, [F.col("_clean"), *[F.col(f"_{n}").isNotNull() for n in REQUIRED_FIELDS]])
