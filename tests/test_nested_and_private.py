"""Nested values and cut-off replies, protected data, names by deletions, record rules: edge cases on inline rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from foliant.functions import protected
from foliant.operators import neighbours, records, trees


def some_value(rng, depth=0):
    kind = rng.randrange(6 if depth < 5 else 4)
    if kind == 4:
        return [some_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind == 5:
        return {rng.choice(["a", "b", 'c"d', "e\\f", "g[h"]) + str(k): some_value(rng, depth + 1) for k in range(rng.randrange(4))}
    return rng.choice([None, True, False, 0, -12.5, 3, "x", 'q"uo\\te', "br}ack]et{[", "ü\n", ""])


def same_start(cut, whole):
    """Whether a closed value is the whole one up to where it was cut: its last members may be shorter, or null."""
    if isinstance(whole, dict) and isinstance(cut, dict):
        keys = list(whole)
        for k, (name, value) in enumerate(cut.items()):
            if k + 1 < len(cut):
                if keys[k] != name or whole[name] != value:
                    return False
            elif k < len(keys) and not (keys[k] == name and same_start(value, whole[name]) or keys[k].startswith(name) and value is None):
                return False
        return len(cut) <= len(whole)
    if isinstance(whole, list) and isinstance(cut, list):
        return len(cut) <= len(whole) and all(a == b for a, b in zip(cut[:-1], whole)) and (not cut or same_start(cut[-1], whole[len(cut) - 1]))
    if isinstance(whole, str) and isinstance(cut, str):
        return whole.startswith(cut)
    return cut == whole or cut is None or isinstance(whole, (int, float)) and json.dumps(whole).startswith(json.dumps(cut).removesuffix(".0"))


def test_a_reply_cut_anywhere_is_closed(spark):
    rng = random.Random(2)
    wholes = [w for w in (some_value(rng) for _ in range(600)) if isinstance(w, (dict, list)) and w]
    texts = [json.dumps(w, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for w in wholes]
    rows = [(i, n, t[:n]) for i, t in enumerate(texts) for n in range(1, len(t) + 1)]
    out = spark.createDataFrame(rows, "i int, n int, cut string").select("i", "n", "cut", trees.closed(F.col("cut")).alias("text")).collect()
    assert len(out) > 1_000
    for r in out:
        assert same_start(json.loads(r.text), wholes[r.i]), (r.cut, r.text)
        assert r.n < len(texts[r.i]) or r.text == texts[r.i]


def test_every_node_has_its_path(spark):
    rng = random.Random(5)
    values = {i: some_value(rng) for i in range(80)}
    rows = [*((i, json.dumps(v)) for i, v in values.items()), (900, None), (901, "no json"), (902, "{"), (903, '{"a":1}'), (903, '{"a":1}')]

    def walk(value, path, level):
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}.get(type(value), "number")
        yield path, kind, level
        for step, inner in (((f".{k}", v) for k, v in value.items()) if kind == "object" else ((f"[{k}]", v) for k, v in enumerate(value)) if kind == "array" else ()):
            yield from walk(inner, path + step, level + 1)

    want = sorted([(i, *x) for i, v in values.items() for x in walk(v, "$", 0)] + 2 * [(903, "$", "object", 0), (903, "$.a", "number", 1)])
    out = trees.nodes(spark.createDataFrame(rows, "id int, reply string"), "id", "reply").collect()
    assert sorted((r.id, r.path, r.kind, r.level) for r in out) == want
    assert all(r.value is None for r in out if r.kind in ("object", "array", "null"))
    assert trees.nodes(spark.createDataFrame([], "id int, reply string"), "id", "reply").collect() == []


def test_last_value_of_a_reply(spark):
    rows = {'Here: {"a": [1, "}"]} hope it helps': {"a": [1, "}"]}, '```json\n[1, 2\n```': [1, 2], "nothing": None, 'x {"a": "b': {"a": "b"}}
    out = spark.createDataFrame([(k,) for k in rows], "t string").select("t", trees.last_value(F.col("t")).alias("v")).collect()
    assert {r.t: r.v and json.loads(r.v) for r in out} == rows


@pytest.mark.parametrize(
    "text, section, want",
    [
        ("Date of Birth (see below): 1970\nOffice: 3", "body", ""),
        ("Date of Birth: 1970\nAge: 40", "body", "date of birth"),
        ("Date of Birth: 1970\nAge: 40", "personal", "age; date of birth"),
        ("he was born on 3 May 1971 in x; ssn 123-45-6789", None, "date of birth; social security number"),
        ("ISBN 123-45-6789-0-1", "personal", ""),
        ("a sentence about the salary: nothing", "body", ""),
        ("Religion: x", "membership", "religion"),
        ("Religion: x", "body", ""),
        ("AB1234563 and AB1234564", "personal", "DEA number"),
        ("call 212-555-0100 or a.b@c.org", "personal", "third-party contact"),
        ("Wife’s name: A   Home phone: 1", "personal", "home address / phone; spouse"),
        (None, "personal", ""),
        ("", "personal", ""),
        ("a: b " * 5_000, "personal", ""),
    ],
)
def test_protected_data(spark, text, section, want):
    row = spark.createDataFrame([(text, section)], "t string, s string").select(protected.spans(F.col("t"), F.col("s")).alias("x"), "t").select(protected.notice(F.col("x")).alias("notice"), protected.withheld(F.col("t"), F.col("x")).alias("rest"), "x").first()
    assert row.notice == want
    cut, rest = list(text or ""), row.rest
    for x in sorted(row.x, key=lambda x: -x.start):
        del cut[x.start : x.end]
    assert (rest or "") == "".join(cut)


def test_names_by_deletions_are_all_pairs(spark):
    rng = random.Random(7)

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, was = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(was[j] + 1, row[-1] + 1, was[j - 1] + (x != y)))
        return row[-1]

    names = ["".join(rng.choice("abü") for _ in range(rng.randint(3, 7))) for _ in range(120)] + ["ab", None, ""]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    for most in (1, 2):
        got = {(r.query, r.other): (r.distance, r.rows) for r in neighbours.near_names(frame, frame.filter("id % 3 = 0"), "id", "name", most).collect()}
        asked = {n for i, n in enumerate(names) if i % 3 == 0 and n and len(n) > 2}
        assert got == {(a, b): (edits(a, b), names.count(b)) for a in asked for b in set(names) if b and len(b) > 2 and 0 < edits(a, b) <= most}


def record(spark, rows):
    fields = ("record_id", "code", "name", "start", "end", "number", "place", "role", "level", "unit", "author", "text")
    full = [tuple({"start": "", "end": "", "number": "", "place": "", "role": "", "level": "", "unit": "", "author": "", "text": r.get("name", "") + r.get("start", "")} | r | {"record_id": i})[0:0] or tuple(({**dict.fromkeys(fields[2:], ""), "text": r["name"] + r.get("start", ""), **r, "record_id": i})[f] for f in fields) for i, r in enumerate(rows)]
    frame = spark.createDataFrame(full, ", ".join(f"{f} {'long' if f == 'record_id' else 'string'}" for f in fields))
    filled = sum((F.when(F.col(c) != "", 1).otherwise(0) for c in fields[2:11]), F.lit(0))
    return frame.select("*", F.lit(1).cast("long").alias("person"), F.col("record_id").alias("at"), filled.alias("filled"))


def test_record_rules(spark):
    rows = [
        {"code": "M2A", "name": "Sleep in Children", "start": "2001", "number": "R01-7"},
        {"code": "M2B", "name": "Sleep in Childrens", "start": "2001-05", "number": "r01 7", "place": "Acme"},  # one grant, fuller
        {"code": "M2B", "name": "Sleep in Children", "start": "2002"},  # another year
        {"code": "H", "name": "Best Teacher of the Year", "start": "1999"},
        {"code": "H", "name": "The Best Teacher of the Year Award", "start": "1999"},
        {"code": "H", "name": "Best Teacher", "start": "1999"},  # too short a name
        {"code": "S1", "name": "On Sutures Part 1", "number": "10.1/x", "start": "2000", "author": "Roe J"},
        {"code": "S2", "name": "On Sutures Part 2", "number": "10.1/x", "start": "2000", "author": "Roe J"},  # another part
        {"code": "S6", "name": "On Sutures Part 1", "number": "10.1/X", "author": "Roe J"},  # without a date: less full
        {"code": "S3", "name": "On Sutures Part 1", "number": "10.1/x", "start": "2000", "author": "Roe J", "place": "P"},  # a twin of what is left
        {"code": "D1", "name": "Professor of Surgery", "place": "Acme University"},
        {"code": "D1", "name": "Assoc Professor of Surgery", "place": "Acme University", "start": "1990", "end": "1995"},  # closed
        {"code": "D1", "name": "Professor of Surgery and Medicine", "place": "Acme University", "start": "1996", "end": "present"},
    ]
    got = {(r.dropped, r.kept, r.rule) for r in records.record_pass(record(spark, rows)).collect()}
    assert got == {(0, 1, "grant_family"), (3, 4, "honor_name"), (8, 6, "paper_identifier"), (6, 9, "cross_code_twin"), (10, 12, "undated_appointment")}
    assert records.record_pass(record(spark, rows).limit(0)).collect() == []
