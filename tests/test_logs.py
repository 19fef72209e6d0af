"""Secrets in events at any depth."""

import json

from pyspark.sql import functions as F

from claimloom.sources import logs


def plain(value):
    """The same rule over Python values."""
    if isinstance(value, dict):
        return {k: logs.MASK if any(f in k.lower() for f in logs.FRAGMENTS) else plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list) else value


SCHEMA = "id int, data struct<name:string,Api_Key_2:string,inner:struct<tokens:array<int>,list:array<struct<secretly:int,ok:string,m:map<string,string>>>>,maps:map<string,map<string,int>>,numbers:map<string,double>>"
ROWS = [
    {"id": 1, "data": {"name": "a", "Api_Key_2": "k", "inner": {"tokens": [1, 2], "list": [{"secretly": 3, "ok": "x", "m": {"PASSWD": "p", "q": None}}, None]}, "maps": {"authorization": {"a": 1}, "open": {"my_token": 2, "n": 3}}, "numbers": {"secret": 1.5, "n": 2.5}}},
    {"id": 2, "data": {"name": None, "Api_Key_2": None, "inner": None, "maps": {}, "numbers": None}},
    {"id": 3, "data": None},
]


def test_keys_at_any_depth(spark, tmp_path):
    events = spark.createDataFrame(ROWS, SCHEMA)
    for _ in range(2):
        logs.append_events(events, f"file://{tmp_path}/events")
    lines = [json.loads(r["value"]) for r in spark.read.text(f"file://{tmp_path}/events").collect()]
    want = [r | {"data": plain(r["data"])} for r in ROWS] * 2
    text = lambda x: json.dumps(x, sort_keys=True)
    assert sorted(map(text, lines)) == sorted(map(text, want))


def test_other_columns_and_fragments(spark):
    events = spark.createDataFrame([("pin", {"pin": "1", "password": "2"})], "secret string, data map<string,string>")
    row = logs.redacted(events, "data", fragments=("PIN",)).first()
    assert row["secret"] == "pin" and row["data"] == {"pin": logs.MASK, "password": "2"}
    assert logs.redacted(events.where(F.lit(False)), "data").isEmpty()
