"""phrase_index, lexical_search and conversations against brute force, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from changefold.llm import conversations, lexical_search, phrase_index
from changefold.llm.common import importable

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, segment string, term string, n int, window string"
ITEMS = "item_id long, text string, window string, terms string, item string"
TURNS = "conv_id long, turn long, role string, text string, pos string, kind string, chunk int"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable(spark)


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def words(text):
    return WORD.findall(lowered(text))


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- exact and proximity matches ----------------------------------------------------


def phrase_truth(docs, items, size=10):
    wanted = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            wanted[tuple(w[s : s + n])].add("" if item is None else str(item))
    sizes = {len(k) for k in wanted}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if got := wanted.get(tuple(w[s : s + n])):
                    found |= got
                    hit.update(range(s, s + n))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out, key=repr)


def phrases(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def test_phrases_of_the_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    want = phrase_truth(docs, items)
    assert sum(r[5] for r in want) > 1
    assert phrases(entry.queries()["op11_phrase_index"](spark, SF)) == want


def made_texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["the"] * 6 + [f"w{i}" for i in range(25)] + ["É", "straße", "x1"]
    return [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(n)], rng


@pytest.mark.parametrize("segment,most", [(1 << 20, 1 << 20), (50, 40)])
def test_phrases_over_segments_and_passes(spark, segment, most):
    texts, rng = made_texts(1)
    docs = [(i % 100, t) for i, t in enumerate(texts)]
    items = [(i, " ".join(rng.choice(texts).split()[3:16])) for i in range(25)] + [(90, "the w1"), (91, "The"), (92, "absent word")]
    windows = phrase_index.item_windows(spark.createDataFrame(items, "item_id long, text string"), 10)
    index = phrase_index.index_documents(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), segment)
    hits = rows(phrase_index.find_windows(index, windows, most=most))
    heads = {r["segment"]: r["counts"] for r in rows(index.where("term is null"))}
    assert segment > 50 or len(heads) > 20
    spans = defaultdict(set)
    for h in hits:
        assert all(b <= heads[h["segment"]][h["doc"]] for b in h["stops"])
        spans[h["segment"], h["doc"]].update(*[range(a, b) for a, b in zip(h["starts"], h["stops"])])
    assert sorted(len(s) for s in spans.values()) == sorted(r[2] for r in phrase_truth(docs, items) if r[2])
    if segment > 50:
        got = phrase_index.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        assert phrases(got) == phrase_truth(docs, items)


def test_proximity(spark):
    texts, rng = made_texts(2, 80)
    items = [(i, " ".join(rng.choice(texts).split()[2:7])) for i in range(15)]
    items = [(i, t) for i, t in items if len(t.split()) == 5]
    docs = list(enumerate(texts))
    slop, size = 2, 4
    often = Counter(w for t in texts for w in words(t))
    want = defaultdict(set)
    for _, text in items:
        w = words(text)
        for s in range(len(w) - size + 1):
            run = w[s : s + size]
            if any(t not in often for t in run):
                continue
            anchor = min(range(size), key=lambda k: (often[run[k]], k))
            for doc, t in docs:
                d = words(t)
                for at in (i for i, x in enumerate(d) if x == run[anchor]):
                    start = at - anchor
                    near = all(run[k] in d[max(0, start + k - slop) : max(0, start + k + slop + 1)] for k in range(size) if k != anchor)
                    if near:
                        want[doc].update(range(max(start, 0), min(start + size, len(d))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = phrase_index.contamination(frame, spark.createDataFrame(items, "item_id long, text string"), window=size, slop=slop)
    assert {r["doc_id"]: r["n_hit"] for r in rows(got) if r["n_hit"]} == {d: len(s) for d, s in want.items()}


def odd_documents(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
    text = "One two three four five six seven eight nine ten eleven"
    data = [
        (None, text), (1, None), (2, ""), (3, text), (3, text), (4, "--- ,. "), (5, long + " " + text.upper() + " é"),
        (6, "one two three four five six seven eight nine"), (7, "É" * 3000 + " ten\x00two"),
    ]
    return data, spark.createDataFrame([(d, t, "s", "t", 1, "w") for d, t in data], DOCS)


def odd_items(spark):
    data = [
        (None, "ten"), (1, None), (2, ""), (3, "ONE two three four five six seven eight nine ten"), (3, "one two"), (10, "!!"),
        (4, "absent " * 3), (5, " ".join(f"w{i % 977}x{i % 13}" for i in range(400, 900))), (5, "ten"), (20, "one, two."),
    ]
    return data, spark.createDataFrame([(d, t, "w", "t", "i") for d, t in data], ITEMS)


def test_phrases_odd_rows(spark):
    docs, frame = odd_documents(spark)
    items, asked = odd_items(spark)
    assert phrases(phrase_index.contamination(frame, asked)) == phrase_truth(docs, items)
    none = phrase_index.contamination(frame, asked.limit(0))
    assert {r["n_hit"] for r in rows(none)} == {0} and none.count() == len(docs)
    assert {r["items_sha256"] for r in rows(none)} == {hashlib.sha256(b"").hexdigest()}
    assert phrase_index.contamination(frame.limit(0), asked).count() == 0


# --- ranked search ---------------------------------------------------------------------


def search_truth(docs, items, best=50):
    tallies = [(doc, Counter(words(text))) for doc, text in docs]
    sizes = [sum(t.values()) for _, t in tallies]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(term for _, t in tallies for term in t)
    out = []
    for item, text in items:
        found = []
        for (doc, tally), n in zip(tallies, sizes):
            score = 0
            for term in set(words(text)):
                if tf := tally.get(term):
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += w * ((10**9 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, doc, -s) for k, (s, _, doc) in enumerate(found[:best])]
    return sorted(out, key=repr)


def ranked(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_of_the_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    assert ranked(entry.queries()["op12_lexical_search"](spark, SF)) == search_truth(docs, items)


def test_search_ties_blocks_and_odd_rows(spark):
    texts, rng = made_texts(3, 300)
    docs = list(enumerate(texts)) + [(1000 + i, "w1 w2 same text") for i in range(120)]
    items = [(i, " ".join(rng.choices(texts, k=2))) for i in range(6)] + [(50, "same w2"), (51, "nowhere"), (52, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = search_truth(docs, items, best=7)
    assert ranked(lexical_search.rank_documents(frame, asked, best=7)) == want
    assert ranked(lexical_search.rank_documents(frame, asked, best=7, most=60)) == want  # many automata
    docs, frame = odd_documents(spark)
    items, asked = odd_items(spark)
    assert ranked(lexical_search.rank_documents(frame, asked)) == search_truth(docs, items)
    assert lexical_search.rank_documents(frame.limit(0), asked).count() == 0
    assert lexical_search.rank_documents(frame, asked.limit(0)).count() == 0


def test_scores_beyond_doubles():
    import numpy as np

    n = 400_000  # terms of one item, each with the largest score
    weights = np.full(n, 60_000, dtype=np.int64)
    weights[0] = 59_999
    scorer = lexical_search.Scorer(weights, [np.zeros(1, np.int64)] * n, 1, 10, 10 * n)
    tf = np.full(n, 10**6, dtype=np.int64)
    got = scorer.scores(np.array([1]), np.zeros(n, np.int64), np.arange(n), tf)
    m = 50 + (50 * 10) // (10 * n)
    each = (10**9 * 10**6) // (1000 * 10**6 + 20 * m)
    assert scorer.halves and got[0, 0] == each * (60_000 * n - 1)


# --- conversations -----------------------------------------------------------------------


def cheapest(turns):
    """Turns (role, text, fault) -> (cost, audit, repaired): suffixes from the end, by (cost, audit)."""

    def follow(state):
        return {"": "u", "s": "u", "u": "a", "a": "u"}[state]

    name = {"u": "user", "a": "assistant"}

    def relax(at):
        for _ in range(3):
            for s in at:
                c, audit, out = at[follow(s)]
                at[s] = min(at[s], (c + 5, "I" + audit, [name[follow(s)] + ":", *out]))
        return at

    far = (10**9, "", [])
    at = relax({"": (0, "", []), "s": far, "u": far, "a": (0, "", [])})
    for role, text, fault in reversed(turns):
        new = {}
        for s in at:
            def then(state, price, edit, line):
                c, audit, out = at[state]
                return (c + price, edit + audit, ([line] if line else []) + out)

            ways = [then(s, 2, "D", None)]
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if role[:1] == follow(s) or (role[:1] == "s" and s == ""):
                    ways.append(then(role[:1], more, "K", f"{role}:{text}"))
                ways.append(then(follow(s), 1 + more, "R", f"{name[follow(s)]}:{text}"))
            new[s] = min(ways)
        at = relax(new)
    return at[""]


def repaired_truth(table):
    convs = defaultdict(list)
    for conv, turn, role, text in table:
        convs[conv]
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return sorted((judged(conv, turns) for conv, turns in convs.items()), key=repr)


def judged(conv, turns):
    turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
    seen, faulty = set(), []
    for _, role, text in turns:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faulty.append((role, text, fault))
    known = [t[0] for t in turns if t[0] is not None]
    count = Counter(f for _, _, f in faulty)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(turns)]
    cost, audit, out = cheapest(faulty)
    return (
        conv, max(known) - min(known) + 1 - len(set(known)) if known else 0, count["blank"], count["duplicate"],
        count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_repair_of_the_tables(spark):
    table = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    want = repaired_truth(table)
    assert {c for r in want for c in r[7]} >= set("KRD")
    assert repaired(entry.queries()["op13_conversation_repair"](spark, SF)) == want


def made_turns(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant"] * 6 + ["system", "tool", "", None]
    texts = ["Fine.", "So?", "cut off", "", " \t", None, "again!", "much\nlonger text, of which there is more.", "e"]
    return [(i if rng.random() < 0.9 else rng.randrange(max(i, 1)), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"text {i}.") for i in range(n)]


@pytest.mark.parametrize("chunk", [1, 3, 12])
def test_long_conversations_over_chunks(spark, chunk):
    table = []
    for conv, size in ((1, 400), (2, 37), (3, 1), (None, 60)):
        table += [(conv, *t) for t in made_turns(size, size)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5)
    assert repaired(conversations.repair_damaged(frame, chunk=chunk)) == repaired_truth(table)


def test_fix_up_passes_change_guesses(spark):
    """A run of rows that only keep the state (all to be deleted) carries the
    end's vector through whole chunks, so that guesses of many of them are wrong."""
    kinds = [0, 1 + 4 * conversations.GOOD] + [1 + 4 * conversations.BLANK] * 40 + [1] * 3
    frame = spark.createDataFrame([(7, i, k) for i, k in enumerate(kinds)], "conv_id long, pos long, kind int")
    end = conversations._pack(conversations.FINISH)
    got = {r["at"]: r for r in rows(conversations.backward_vectors(frame, chunk=2))}
    whole, _ = conversations._backward(bytes(kinds), end)
    steps = b"".join(bytes(got[at]["steps"]) for at in sorted(got))
    assert steps == whole.astype("<i8").tobytes()
    assert len({r["tail"] for r in got.values()}) > 1


def test_repair_odd_rows(spark):
    table = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "Hi."), (1, None, "assistant", "Yes."),
        (2, 0, "user", "Same."), (2, 0, "user", "Same."), (2, 5, "assistant", "x" * 200_000 + "."), (3, 3, "", ""),
        (4, 1, "system", "Only a system."), (5, 2, "user", None), (6, 9, "uh", "Kept as it is."), (6, 10, "ah", "So is this!"),
    ] + [(9, t, "user", "a.") for t in range(60)]
    frame = spark.createDataFrame([(*r, "p", "k", 1) for r in table], TURNS)
    assert repaired(conversations.repair_damaged(frame)) == repaired_truth(table)
    assert conversations.repair_damaged(frame.limit(0)).count() == 0
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    one = rows(conversations.repair_damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")))
    assert one == [dict(zip(COLUMNS, (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())))]


def test_repair_without_damage(spark):
    table = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Yes."), (2, 0, "system", "Be."), (2, 1, "assistant", "No.")]
    got = rows(conversations.repair(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in got} == {1: (0, "KK"), 2: (1, "RK")}


@pytest.mark.parametrize("name", ["op11_phrase_index", "op12_lexical_search", "op13_conversation_repair"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=repr) == sorted(cur.fetchall(), key=repr)
