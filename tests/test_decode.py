"""Decoding and ingest filtering, with the JSON edge cases."""

from __future__ import annotations

import json

import pytest

from changefold import operators as ops
from tests.conftest import edit_json, envelope


def _parse(spark, values):
    env = envelope(spark, [("enwiki", v, i) for i, v in enumerate(values)])
    return ops.parse_edits(env)


def _forwarded(spark, value) -> bool:
    env = envelope(spark, [("enwiki", value, 0)])
    return ops.ingest_edits(env).count() == 1


def test_decoded_columns(spark):
    from changefold.schema import EDIT_COLUMNS

    assert tuple(_parse(spark, [edit_json()]).columns) == EDIT_COLUMNS
    env = envelope(spark, [("enwiki", edit_json(), 0)])
    assert tuple(ops.parse_edits(env, keep_raw=True).columns) == EDIT_COLUMNS + ("value",)


def test_valid_edit_is_parsed(spark):
    row = _parse(spark, [edit_json(title="Salt marsh")]).collect()[0]
    assert (row.type, row.wiki, row.title, row.namespace, row.bot) == ("edit", "enwiki", "Salt marsh", 0, False)
    assert row.serverName == "enwiki.example.org" and row.timestamp == 1705312800


def test_bot_flag_is_parsed(spark):
    rows = _parse(spark, [edit_json(bot=True), edit_json(bot=False)]).orderBy("offset").collect()
    assert [r.bot for r in rows] == [True, False]


def test_unknown_fields_are_ignored(spark):
    v = edit_json(tags=["x"], revision={"old": 3, "new": 4})
    assert _parse(spark, [v]).collect()[0].wiki == "enwiki"


@pytest.mark.parametrize(
    "kwargs,forward",
    [
        (dict(type="edit", namespace=0), True),
        (dict(type="new", namespace=0), True),
        (dict(type="log", namespace=0), False),
        (dict(type="categorize", namespace=0), False),
        (dict(type="external", namespace=0), False),
        (dict(type="edit", namespace=1), False),
        (dict(type="edit", namespace=4), False),
        (dict(type="edit", namespace=2), False),
        (dict(type="edit", namespace=0, bot=True), True),
        (dict(type="Edit", namespace=0), False),
    ],
)
def test_forward_or_drop(spark, kwargs, forward):
    assert _forwarded(spark, edit_json(**kwargs)) is forward


def test_forwarded_value_is_byte_identical(spark):
    raw = '{"type":"edit", "wiki":"enwiki","title":"T","user":"u","bot":false,"timestamp":1,"server_name":"s", "x": [1, 2]}'
    env = envelope(spark, [("ignored", raw, 0)])
    row = ops.ingest_edits(env).collect()[0]
    assert row.value == raw and row.key == "enwiki"


def _body(**overrides):
    base = json.loads(edit_json())
    for k, v in overrides.items():
        if v is _DROP:
            base.pop(k, None)
        else:
            base[k] = v
    return json.dumps(base)


_DROP = object()
_GOOD = edit_json()

# (case, text, accepted)
EDGE_CASES = [
    ("all required present", _GOOD, True),
    ("namespace missing", _body(namespace=_DROP), True),
    ("namespace null", _body(namespace=None), True),
    ("comment null", _body(comment=None), True),
    ("length null", _body(length=None), True),
    ("length fields null", _body(length={"old": None, "new": None}), True),
    ("namespace text", _body(namespace="abc"), False),
    ("namespace float", _GOOD.replace('"namespace": 0', '"namespace": 0.0'), False),
    ("namespace too large", _body(namespace=99999999999), False),
    ("length a number", _body(length=5), False),
    ("length.old text", _body(length={"old": "x"}), False),
    ("title a number", _body(title=12), False),
    ("title an object", _body(title={"x": 1}), False),
    ("bot null", _body(bot=None), False),
    ("user missing", _body(user=_DROP), False),
    ("Bot instead of bot", _body(bot=_DROP, Bot=True), False),
    ("single quotes", _GOOD.replace('"', "'"), False),
    ("root array", "[" + _GOOD + "]", False),
    ("closes the array: another key", _GOOD + '],"z":[1', False),
    ("closes the array: the same key", _GOOD + '],"body":[' + _GOOD, False),
    ("closes the array: a longer key", _GOOD + '],"body2":[', False),
    ("closes the array and the wrapper", _GOOD + "]} tail", False),
    ("closes the wrapper, another root", _GOOD + ']}{"z":[1', False),
    ("closes the array in front", '],"body":[' + _GOOD, False),
    ("closes after a string of brackets", _body(comment="[[[") + '],"z":["[', False),
    ("closes after an escaped quote", _body(comment='\\" [[') + '],"z":[1', False),
    ("closes after an array of its own", _body(tags=[1, [2]]) + '],"z":[[1]', False),
    ("arrays of its own", _body(tags=["a", ["]", []], {"x": [1]}]), True),
    ("brackets in strings", _body(comment=']],"body":[ ]} \\" ]', title="[[T]]"), True),
    ("a quote and brackets in a string", _body(comment='say "]" \\\\', note="]"), True),
    ("a long string of escapes", _body(comment='\\"]' * 20000), True),
    ("truncated", _GOOD[:-9], False),
    ("raw newline in string", _GOOD.replace("Peat bog", "Peat\nbog"), False),
    ("empty text", "", False),
    ("escaped unicode", _GOOD.replace("Peat bog", "Caf\\u00e9"), True),
    ("duplicate key, last wins", _GOOD[:-1] + ', "wiki": "dewiki"}', True),
    ("timestamp a float", _body(timestamp=1.7e9), False),
    ("timestamp quoted", _body(timestamp="1705312800"), False),
    ("bot quoted", _body(bot="true"), False),
    ("bot a number", _body(bot=1), False),
    ("namespace a boolean", _body(namespace=True), False),
    ("namespace negative", _body(namespace=-1), True),
    ("wiki null", _body(wiki=None), False),
    ("text after the object", _GOOD + " garbage", False),
    ("two objects", _GOOD + _GOOD, False),
    ("two objects, comma between", _GOOD + "," + _GOOD, False),
    ("space around", "  " + _GOOD + " ", True),
    ("comment a number", _body(comment=3), False),
    ("duplicate key, wrong type elsewhere", _GOOD[:-1] + ', "title": 12, "wiki": "dewiki"}', False),
    ("namespace quoted", _body(namespace="0"), False),
    ("json null", "null", False),
]


@pytest.fixture(scope="module")
def accepted(spark):
    """The positions of the edge cases that decode, from one job."""
    return {r.offset for r in _parse(spark, [c[1] for c in EDGE_CASES]).collect()}


@pytest.mark.parametrize("at", range(len(EDGE_CASES)), ids=[c[0] for c in EDGE_CASES])
def test_json_edge_cases(accepted, at):
    assert (at in accepted) is EDGE_CASES[at][2]


def test_defaults_apply_after_accept(spark):
    row = _parse(spark, [_body(namespace=None, comment=None)]).collect()[0]
    assert row.namespace == 0 and row.comment == ""
    row = _parse(spark, [_GOOD.replace('"wiki": "enwiki"', '"wiki": "dewiki"')[:-1] + ', "wiki": "frwiki"}']).collect()[0]
    assert row.wiki == "frwiki"


def test_null_value_is_rejected(spark):
    env = envelope(spark, [("enwiki", None, 0)])
    assert ops.parse_edits(env).count() == 0


def test_wrong_typed_unused_field_still_rejects_in_pruned_plans(spark):
    """Only wiki/type/namespace are needed downstream; the optimizer must not
    prune the body schema so far that a wrong-typed ``length`` is accepted."""
    env = envelope(spark, [("enwiki", _body(length=5), 0), ("enwiki", _GOOD, 1)])
    counts = ops.tumbling_counts(ops.article_edits(ops.parse_edits(env)))
    assert counts.collect()[0].edit_count == 1
    assert ops.parse_edits(env).select("wiki").count() == 1


def test_ingest_counters(spark):
    values = [_GOOD, edit_json(type="log"), edit_json(namespace=1), edit_json(type="log", namespace=4), "{bad"]
    env = envelope(spark, [("enwiki", v, i) for i, v in enumerate(values)])
    row = ops.ingest_counters(env).collect()[0].asDict()
    assert row == dict(
        received=5, published=1, skipped=4, skipped_unparsable=1, skipped_type=2, skipped_namespace=1
    )


def test_observed_ingest_counters(spark):
    values = [_GOOD, edit_json(type="log"), "{bad"]
    env = envelope(spark, [("enwiki", v, i) for i, v in enumerate(values)])
    observed, obs = ops.observe_ingest(env)
    assert observed.count() == 3
    assert obs.get["published"] == 1 and obs.get["skipped_unparsable"] == 1


def test_page_key_round_trip_keeps_later_separators(spark):
    env = envelope(spark, [("enwiki", edit_json(title="A|B"), 0)])
    keyed = ops.rekey_pages(ops.parse_edits(env)).select("page_key")
    row = ops.split_page_keys(keyed).collect()[0]
    assert (row.page_key, row.wiki, row.title) == ("enwiki|A|B", "enwiki", "A|B")


def test_length_delta(spark):
    values = [
        _body(length={"old": 10, "new": 25}),
        _body(length={"old": 30, "new": 5}),
        _body(length={"old": 10}),
        _body(length=_DROP),
        _body(length={"old": -2147483648, "new": 2147483647}),
    ]
    rows = ops.with_length_delta(_parse(spark, values)).orderBy("offset").collect()
    assert [r.delta for r in rows] == [15, -25, None, None, 4294967295]
