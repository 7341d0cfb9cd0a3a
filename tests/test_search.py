"""Random searches against a row-at-a-time model, and pages."""

import json
import random

import pytest

from tellspan.functions.coerce import as_bool, as_float, as_int, canonical
from tellspan.functions.identity import entity_key
from tellspan.operators import search
from tellspan.plans import documents as D
from tellspan.schema import ATTRS, LOGS, SPANS

VALUES = ["alpha", "beta", "10", "9", " 1", "1d", "nan", "-NaN", "inf", "", 7, 0, -3, 2.5, 7.0, float("nan"), True, False, None]


def attr(key, v):
    kind = 0 if v is None else 1 if isinstance(v, str) else 4 if isinstance(v, bool) else 2 if isinstance(v, int) else 3
    return {"key": key, "type": kind, "s": v if kind == 1 else None, "i": v if kind == 2 else None, "d": v if kind == 3 else None, "b": v if kind == 4 else None, "bytes": None, "json": None}


def _row(schema, **values):
    return tuple(values.get(f.name) for f in schema)


@pytest.fixture(scope="module")
def logs(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(400):
        attrs = [attr(rnd.choice("abcd"), rnd.choice(VALUES)) for _ in range(rnd.randrange(4))]
        rows.append(dict(ts_ns=1_000 + rnd.randrange(150), severity_number=rnd.choice([1, 9, 17, None]), severity_text=rnd.choice(["INFO", "ERROR", None]), body=rnd.choice(["request 1", "timeout", None]), trace_id=rnd.choice(["ab" * 16, "0a" * 16, None]), attrs=attrs, resource=[attr("a", rnd.choice(VALUES))] if i % 3 else [], scope=[], node=i % 2, seq=0, row=i))
    return spark.createDataFrame([_row(LOGS, **r) for r in rows], LOGS), rows


OPS = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b}


def number(text):
    return as_float(text) if isinstance(text, str) else None


def one(a, op, v):
    if a["type"] == 1:
        s, text = a["s"], canonical(v)
        if op == "contains":
            return text in s
        if op not in ("eq", "ne") and not isinstance(v, (str, bool)) and number(s) is not None:
            return OPS[op](number(s), float(v))
        return OPS[op](s.encode(), text.encode())
    slot, want = {2: ("i", as_int(v)), 3: ("d", as_float(v)), 4: ("b", as_bool(v))}.get(a["type"], (None, None))
    if op == "contains" or slot is None or want is None or a[slot] != a[slot] or want != want:
        return False
    return OPS[op](a[slot], want)


def model(r, t):
    if t.target == "attr":
        return any(a["key"] == t.name and one(a, t.op, t.value) for a in r["attrs"] + r["resource"])
    if t.name not in ("severity_number", "body", "severity_text", "trace_id"):
        return False
    have = r[t.name]
    want = as_int(t.value) if t.name == "severity_number" else t.value if isinstance(t.value, str) else None
    if t.name == "trace_id" and want is not None:
        want = want.lower() if len(want) % 2 == 0 and set(want.lower()) <= set("0123456789abcdef") else None
    if have is None or want is None:
        return False
    if t.op == "contains":
        return t.name in ("body", "severity_text") and want in have
    return OPS[t.op](have, want)


def test_random_searches_agree_with_the_model(logs):
    df, rows = logs
    rnd = random.Random(5)
    matched = 0
    for _ in range(40):
        terms = []
        for _ in range(rnd.randrange(1, 3)):
            target = rnd.choice(["attr", "attr", "field"])
            name = rnd.choice("abcde") if target == "attr" else rnd.choice(["severity_number", "body", "severity_text", "trace_id", "nope"])
            value = rnd.choice([v for v in VALUES if v is not None and v == v] + ["ERROR", "timeout", 9, "17", "AB" * 16, "abc"])
            terms.append(D.Term(target, name, rnd.choice([*OPS, "contains"]), value))
        start, end = sorted((1_000 + rnd.randrange(150), 1_000 + rnd.randrange(150)))
        q = D.Search("logs", start, end, tuple(terms), limit=7)
        want = [r["row"] for r in sorted(rows, key=lambda r: (-r["ts_ns"], -r["node"], -r["row"])) if start <= r["ts_ns"] <= end and all(model(r, t) for t in terms)]
        got = [r["row"] for r in search.search(df, q).collect()]
        assert got == want[:7], q
        matched += len(want)
        if want:
            assert search.count(df, q).first()["matched"] == len(want)
    assert matched > 100


def test_pages_add_up_to_one_answer(logs):
    df, rows = logs
    after, seen = None, []
    while True:
        page = search.page(df, D.Search(limit=90, after=D.Cursor.parse(after) if after else None), stats=True)
        seen += [r["row"] for r in page.rows]
        assert page.matched == len(rows) - len(seen) + len(page.rows) and page.scanned == len(rows)
        after = page.next
        if after is None:
            break
    assert seen == [r["row"] for r in sorted(rows, key=lambda r: (-r["ts_ns"], -r["node"], -r["row"]))]
    assert [r["row"] for r in search.merge_pages([df.limit(300), df], 50).collect()] == seen[:50]


def test_rows_as_json(spark):
    attrs = [attr("k", 1), attr("k", "two"), attr("q", 'say "x"'), attr("n", float("nan")), attr("z", None)]
    df = spark.createDataFrame([_row(LOGS, ts_ns=5, severity_number=9, body="b", attrs=attrs, resource=[attr("k", "r"), attr("service.name", "s")], scope=[], node=0, seq=1, row=2)], LOGS)
    r = search.render(df, "logs").first()
    got = json.loads(r["json"])
    assert r["cursor"] == "5.0.1.2" and got["time_unix_nano"] == "5" and "trace_id" not in got
    assert got["attributes"] == {"k": "two", "n": None, "q": 'say "x"', "service.name": "s", "z": None} and list(got["attributes"]) == sorted(got["attributes"])


def test_span_children_match_and_render(spark):
    event = (3, "boom", 0, [tuple(attr("code", 5).values())])
    rows = [_row(SPANS, ts_ns=1, duration_ns=2, span_id="aa" * 8, events=[event], links=[], attrs=[], resource=[], scope=[], node=0, seq=0, row=0), _row(SPANS, ts_ns=2, events=None, links=None, attrs=[], resource=[], scope=[], node=0, seq=0, row=1)]
    df = spark.createDataFrame(rows, SPANS)
    q = D.Search("traces", terms=(D.Term("attr", "code", "eq", "5"),))
    found = search.search(df, q)
    assert [r["row"] for r in found.collect()] == [0]
    got = json.loads(search.render(found, "traces").first()["json"])
    assert got["events"] == [{"ts_ns": "3", "name": "boom", "attributes": {"code": "5"}}] and "links" not in got


def test_identity_ignores_order_and_other_attributes(spark):
    a = [attr("service.name", "s"), attr("service.instance.id", "1")]
    rows = [(a,), (a[::-1] + [attr("x", 1)],), ([attr("service.name", "s"), attr("service.instance.id", 1)],), ([attr("host.name", "h")],), ([attr("x", 1)],), ([],)]
    keys = [r["k"] for r in spark.createDataFrame(rows, f"r {ATTRS.simpleString()}").select(entity_key("r").alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2] and keys[3].startswith("5|") and keys[4:] == [None, None]
