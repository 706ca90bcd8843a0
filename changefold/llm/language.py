"""Language of web pages by Bayesian fusion of evidence.

For each language, the log posterior adds up
  * the text's likelihood under hashed byte trigrams, tempered because
    overlapping trigrams are not independent;
  * how likely pages of that language declare what this one declares
    (``lang`` of its html element);
  * how likely they have its address suffix (last label of the host and a
    leading two-letter path segment);
  * the host's prior, smoothed towards its domain's, and that towards the
    corpus's.
All but the first come from grouped sums of the pages' text posteriors over
the whole table; a page's own share is taken out of its host's and domain's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from changefold.llm.html_text import KEPT, lines
from changefold.session import materialize

BINS = 1 << 14
_LANG = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([A-Za-z]{2,3})(?![A-Za-z])", re.I)
SIGNS = "page_id long, host string, domain string, suffix string, declared string, ll array<double>, post array<double>"


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of the lower-case text, white space as one space."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode("utf-8", "replace"), np.uint8).astype(np.int64)
    if len(b) < 3:
        return np.zeros(BINS, dtype=np.int64)
    return np.bincount((b[:-2] * 40_503 + b[1:-1] * 10_007 + b[2:] * 271) % BINS, minlength=BINS)


def fit_trigrams(docs: DataFrame, sample: int = 5000, smooth: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities [BINS, languages].

    Fits on ``sample`` documents with a lang and a text, those of the least
    hashed doc_id; the driver gets at most BINS sums a language."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length(F.trim("text")) > 0)).select("doc_id", "lang", "text")
    mixed = F.xxhash64("doc_id", F.lit(11))
    chosen = rows.select("doc_id").orderBy(mixed, "doc_id").limit(sample).distinct()
    chosen = chosen.withColumnRenamed("doc_id", "__id")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for lang, text in zip(frame["lang"], frame["text"]):
                sums[lang] = sums.get(lang, 0) + trigrams(text)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "bin": at, "n": c[at]})

    counted = (
        rows.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("__id")))
        .select("lang", "text")
        .mapInPandas(count, "lang string, bin int, n long")
        .groupBy("lang", "bin")
        .agg(F.sum("n").alias("n"))
        .collect()
    )
    langs = sorted({r["lang"] for r in counted})
    table = np.full((BINS, len(langs)), smooth)
    for r in counted:
        table[r["bin"], langs.index(r["lang"])] += r["n"]
    return langs, np.log(table / table.sum(axis=0)) if langs else table


def address(url: str | None) -> tuple[str, str, str]:
    """host, registered domain (last two labels), suffix of an address."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return "", "", ""
    labels = [x for x in host.split(".") if x]
    code = re.match(r"/([a-z]{2})(?:/|$)", parts.path)
    suffix = (labels[-1] if labels and not labels[-1].isdigit() else "") + (f"/{code[1]}" if code else "")
    return host, ".".join(labels[-2:]), suffix


def _signs(model: np.ndarray, temper: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, url, html in zip(frame["page_id"], frame["url"], frame["html"]):
                found = lines(html or "")
                text = " ".join([t for role, t in found if role == KEPT] or [t for _, t in found])
                ll = temper * (trigrams(text) @ model)
                ll -= ll.max()
                post = np.exp(ll)
                said = _LANG.search(html or "")
                out.append((page, *address(url), said[1].lower() if said else "", ll, post / post.sum()))
            names = [f.split()[0] for f in SIGNS.split(", ")]
            yield pd.DataFrame(out, columns=names).astype({"page_id": "Int64"})

    return run


def identify_language(
    pages: DataFrame, docs: DataFrame, sample: int = 5000, temper: float = 0.3, strength: float = 4.0, smooth: float = 0.5
) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host), one row per row of ``pages``.

    Reads page_id, url and html of ``pages`` and doc_id, lang and text of
    ``docs``, on which the trigrams are fitted (see ``fit_trigrams``).
    ``strength`` is the number of pages that a prior counts for. A null or
    empty html has no text and no declaration, a null or broken url an empty
    host: the other evidence decides, and of equal languages the first in
    order. Without any labelled document lang and probability are null. Equal
    rows are separate pages; an empty table gives no rows.
    """
    langs, model = fit_trigrams(docs, sample)
    if not langs:
        nothing = F.lit(None).cast("string")
        return pages.select(
            "page_id", nothing.alias("lang"), F.lit(None).cast("double").alias("probability"),
            nothing.alias("text_lang"), nothing.alias("declared"), nothing.alias("host"),
        )
    n = range(len(langs))
    signs = materialize(pages.select("page_id", "url", "html").mapInPandas(_signs(model, temper), SIGNS), "language-signs")

    def sums(by: list[str], name: str) -> DataFrame:
        return signs.groupBy(*by).agg(F.array(*[F.sum(F.col("post")[i]) for i in n]).alias(name))

    total = [t or 0.0 for t in sums([], "all").first()["all"]]
    base = [(t + smooth) / (sum(total) + smooth * len(langs)) for t in total]
    kinds = {c: max(1, signs.select(c).distinct().count()) for c in ("declared", "suffix")}
    told = signs
    for by, name in ((["host", "domain"], "n_host"), (["domain"], "n_domain"), (["declared"], "n_declared"), (["suffix"], "n_suffix")):
        told = told.join(sums(by, name), by)

    def given(counts: str, i: int, values: int):
        return F.log((F.col(counts)[i] + smooth) / F.lit(total[i] + smooth * values))

    def own(counts: str, i: int):  # the page itself does not vote on its prior
        return F.greatest(F.col(counts)[i] - F.col("post")[i], F.lit(0.0))

    def mass(counts: str):
        return sum((own(counts, i) for i in n), F.lit(0.0))

    told = told.withColumn(
        "by_domain", F.array(*[(own("n_domain", i) + strength * base[i]) / (mass("n_domain") + strength) for i in n])
    )
    told = told.withColumn(
        "score",
        F.array(
            *[
                F.col("ll")[i]
                + given("n_declared", i, kinds["declared"])
                + given("n_suffix", i, kinds["suffix"])
                + F.log((own("n_host", i) + strength * F.col("by_domain")[i]) / (mass("n_host") + strength))
                for i in n
            ]
        ),
    )
    names = F.array(*[F.lit(x) for x in langs])
    top = F.array_max("score")
    spread = sum((F.exp(F.col("score")[i] - top) for i in n), F.lit(0.0))
    return told.select(
        "page_id",
        F.element_at(names, F.array_position("score", top).cast("int")).alias("lang"),
        F.round(1 / spread, 6).alias("probability"),
        F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int")).alias("text_lang"),
        "declared",
        "host",
    )
