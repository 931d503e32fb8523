"""Stored results come back as they were, and saving some sessions leaves the others."""

import pytest

from tracelode.sources.results import Results, load_json, save_json

SCHEMA = "session string, zone int, solutions array<struct<index:int,fields:array<struct<start:int,type:string,confidence:double>>>>, notes map<string,string>, raw binary"


def rows(version):
    field = (0, "UINT16", 0.5)
    return [
        ("(('10.0.0.1', '10.0.0.2', 6), 34, 123)", 1, [(version, [field, (2, None, None)])], {"a/b": "c=d"}, b"\x00\xff"),
        (None, 2, [], {}, None), ("", None, None, None, b""), ("é %/=:", 3, [(version, [])], {"k": None}, b"z"),
    ]


def test_sessions_are_replaced_one_by_one(spark, tmp_path):
    store = Results(spark, str(tmp_path / "store"))
    store.save("solutions", spark.createDataFrame(rows(1), SCHEMA))
    first = sorted(store.load("solutions").collect(), key=str)
    assert first == sorted(spark.createDataFrame(rows(1), SCHEMA).collect(), key=str)
    changed = [r for r in rows(2) if r[0] in (None, "é %/=:")] + [("new", 9, None, None, None)]
    store.save("solutions", spark.createDataFrame(changed, SCHEMA))
    want = [r for r in rows(1) if r[0] not in (None, "é %/=:")] + changed
    assert sorted(store.load("solutions").collect(), key=str) == sorted(spark.createDataFrame(want, SCHEMA).collect(), key=str)
    some = spark.createDataFrame([(None,), ("new",), ("absent",)], "session string")
    assert sorted(r["zone"] for r in store.load("solutions", some).collect()) == [2, 9]
    store.save("matching", spark.createDataFrame([("s", 1, 0.5)], "session string, group int, score double"), ["session", "group"])
    assert store.kinds() == ["matching", "solutions"]
    with pytest.raises(ValueError):
        store.save("matching", spark.createDataFrame([("s", 1)], "session string, group int"), ["session", "group"])


def test_json_round_trip(spark, tmp_path):
    schema = SCHEMA.replace(", raw binary", "")
    df = spark.createDataFrame([r[:4] for r in rows(1)], schema)
    save_json(df, str(tmp_path / "json"))
    assert sorted(load_json(spark, str(tmp_path / "json"), schema).collect(), key=str) == sorted(df.collect(), key=str)
