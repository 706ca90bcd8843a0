"""Quality verdicts and the whole pipeline against plain Python, row by row."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import xxhash

import corpus_pipeline
from changefold.llm import line_templates, mixing, quality_rules, queries
from changefold.llm.common import importable
from tests.llm.test_operators import SF, WORD, components, rows, statistics, table, template_truth


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


@pytest.fixture(scope="module")
def rules(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return quality_rules.fit_rules(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def features(text):
    own = statistics(text)
    found, t = WORD.findall(text or ""), text or ""
    lines = [x for x in t.split("\n") if WORD.search(x)]

    def share(a, b):
        return a / b if b else 0.0

    chars = own["word_chars"]
    return {
        "n_words": own["n_words"],
        "mean_word": share(chars, own["n_words"]),
        "symbol_share": share(own["n_symbols"], chars),
        "mark_share": share(sum(c in "!?" for c in t), chars),
        "upper_share": share(sum("A" <= c <= "Z" for c in t), chars),
        "digit_share": share(sum("0" <= c <= "9" for c in t), chars),
        "dup_line_share": share(own["n_dup_lines"], len(lines)),
        "repeat_share": share(own["n_repeat_words"], own["n_words"]),
        "distinct_share": share(len(set(found)), own["n_words"]),
        "words_a_line": share(own["n_words"], len(lines)),
    }


def kept(text, rules):
    own, f = statistics(text), features(text)
    if own["n_words"] < 20 or 100 * own["n_repeat_words"] > 30 * own["n_words"]:
        return False
    holds = [all((f[c.feature] > c.threshold) == c.above for c in rule) for rule in rules]
    return not any(holds)


def test_verdicts_row_by_row(spark, rules):
    """The rules' CASE expression says of every document what the rules say; on
    these tables some rules are learned and reject documents that pass the base."""
    got = {r["doc_id"]: r["kept"] for r in rows(queries.op3_quality_rules(spark, SF))}
    assert got == {d["doc_id"]: kept(d["text"], rules) for d in table("documents")}


def test_verdicts_of_a_given_list(spark):
    """Two ordered rules, whatever the tables teach."""
    make = quality_rules.Condition
    given = [(make("upper_share", True, 0.02), make("n_words", False, 400.0)), (make("distinct_share", False, 0.5),)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality_rules._judged(docs.select("doc_id", "text"), given)
    told = {r["doc_id"]: r["__quality_kept"] for r in rows(got)}
    want = {d["doc_id"]: kept(d["text"], given) for d in table("documents")}
    assert told == want and len(set(want.values())) == 2


def fingerprint(text, size=4):
    found = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(found[i : i + size]) for i in range(max(len(found) - size + 1, 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def near_truth(docs):
    prints = [(fingerprint(t), i) for i, (_, t) in enumerate(docs)]
    links = [(i, j) for a, (p, i) in enumerate(prints) for q, j in prints[:a] if bin(p ^ q).count("1") <= 4]
    roots, first = components(range(len(docs)), links), {}
    for i, (doc, _) in enumerate(docs):
        if roots[i] not in first or doc < docs[first[roots[i]]][0]:
            first[roots[i]] = i
    return sorted(docs[i] for i in first.values())


def test_pipeline_row_by_row(spark, rules):
    """run() against plain decisions of rules, lines and near copies; the mix of
    what those leave is drawn by the operator, whose draws follow from the rows."""
    import public_tokenizers
    import tiktoken
    import base64

    every = table("documents")
    good = [(d["doc_id"], d["text"]) for d in every if kept(d["text"], rules)]
    texts = template_truth(good)
    changed = [(doc, texts[doc]) for doc, text in good if texts[doc] == text or WORD.search(texts[doc])]
    left = near_truth(changed)
    assert len(left) < len(changed) <= len(good) < len(every)

    own = {d["doc_id"]: d for d in every}
    before = dict(good)
    full = [(doc, t, own[doc]["lang"], own[doc]["source"], own[doc]["n_chars"] if t == before[doc] else len(t)) for doc, t in left]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = spark.createDataFrame(full, schema)
    copies = {r["doc_id"]: r["copies"] for r in rows(mixing.mix_sources(frame))}

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, fh)}
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for doc, text, *_ in full:
        ids = bpe.encode_ordinary(text)
        row = (doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
        want[row] += copies[doc]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows(corpus_pipeline.run(spark, SF)))
    assert got == +want
    assert line_templates.LETTER == {"verbatim": 2, "brief": 40}  # what template_truth states
