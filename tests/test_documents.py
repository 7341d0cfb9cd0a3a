import pytest

from tellspan.functions.coerce import as_bool, as_float, as_int, as_text, canonical, hex_id
from tellspan.plans import documents as D

NOW = 1_700_000_000_000_000_000


@pytest.mark.parametrize(
    ("value", "whole", "real", "truth", "text"),
    [
        (3, 3, 3.0, None, None), (3.0, 3, 3.0, None, None), (3.5, None, 3.5, None, None), ("3", 3, 3.0, None, "3"), ("3.5", None, 3.5, None, "3.5"), ("x", None, None, None, "x"), (" 1 ", None, None, None, " 1 "), ("1_0", None, None, None, "1_0"),
        ("1d", None, None, None, "1d"), (True, None, None, True, None), ("true", None, None, True, "true"), ("TRUE", None, None, None, "TRUE"), (str(1 << 63), None, float(1 << 63), None, str(1 << 63)), (1e300, None, 1e300, None, None),
    ],
)
def test_coercions(value, whole, real, truth, text):
    assert (as_int(value), as_float(value), as_bool(value), as_text(value)) == (whole, real, truth, text)


def test_canonical_text_and_ids():
    assert [canonical(x) for x in (200, 200.0, 0.1, 1e-7, True, "a")] == ["200", "200", "0.1", "0.0000001", "true", "a"]
    assert [hex_id(x) for x in ("AB", "abc", "zz", 12, "")] == ["ab", None, None, None, ""]


def test_times():
    t = lambda v: D.instant(v, NOW, 0)
    assert [t(5), t("now"), t("-15m"), t("+2h"), t("15m"), t("30"), t("500ms")] == [5, NOW, NOW - 900 * 10**9, NOW + 2 * D.HOUR, NOW + 900 * 10**9, NOW + 30 * 10**9, NOW + 500 * 10**6]
    for bad in ("1757241600000000000", "soon", 1.5, True, "-"):
        with pytest.raises(D.DocumentError):
            t(bad)


def test_search_documents_as_json_and_yaml():
    doc = D.search('{"signal":"spans","from":"-1h","where":[{"attr":"a","eq":1},{"field":"name","~":"x"}],"limit":20000}', NOW)
    assert doc.signal == "traces" and doc.start == NOW - D.HOUR and doc.limit == 10_000
    assert doc.terms == (D.Term("attr", "a", "eq", 1), D.Term("field", "name", "contains", "x"))
    yaml = D.search("signal: logs\nwhere:\n  - {attr: on, eq: yes}\n  - {attr: t, ne: 1:30}\nlimit: 5\n", NOW)
    assert yaml.terms == (D.Term("attr", "on", "eq", "yes"), D.Term("attr", "t", "ne", "1:30")) and yaml.limit == 5
    assert D.search("{}", NOW) == D.Search("logs", NOW - D.HOUR, NOW)


@pytest.mark.parametrize(
    "bad",
    ['{"form": 1}', '{"limit": 0}', '{"limit": "5"}', '{"where": {}}', '{"where": [{"eq": 1}]}', '{"where": [{"attr": "a"}]}', '{"where": [{"attr": "a", "=~": 1}]}', '{"from": 2, "to": 1}', '{"signal": "metrics"}', '{"after": 1.2}', '{"after": "1.2.3"}', "a: &x 1\nb: *x", "[1]", f'{{"where": [{{"attr": "a", "eq": {1 << 63}}}]}}'],
)
def test_documents_that_are_refused(bad):
    with pytest.raises(D.DocumentError):
        D.search(bad, NOW)


def test_cursors_steps_sizes():
    c = D.Cursor.parse("-5.0.7.41")
    assert c == D.Cursor(-5, 0, 7, 41) and str(c) == "-5.0.7.41"
    assert D.steps(["traces", "around:2s", "peers"]) == (D.Step("traces"), D.Step("around", 2 * 10**9), D.Step("peers"))
    with pytest.raises(D.DocumentError):
        D.steps(["far"])
    assert [D.size(x) for x in ("64", "10k", "32MiB")] == [64, 10_240, 32 << 20]


def test_filter_bar_both_ways():
    fields = ("severity_number", "body")
    terms = D.filter_bar('severity_number>=17 service.name=tickets attr:body!="a b" timeout half=', fields)
    assert terms == [D.Term("field", "severity_number", "gte", 17), D.Term("attr", "service.name", "eq", "tickets"), D.Term("attr", "body", "ne", "a b"), D.Term("field", "body", "contains", "timeout")]
    with pytest.raises(D.DocumentError):
        D.filter_bar("half=", fields, strict=True)
    assert D.bar_text(terms[:2]) == "severity_number>=17 service.name=tickets"
    assert D.add_term(terms, terms[0])[-1] == terms[0] and len(D.add_term(terms, terms[0])) == 4
    assert [t.value for t in D.with_service(terms, "pay") if t.name == "service.name"] == ["pay"]


def test_filter_bar_keeps_ids_as_text():
    terms = D.filter_bar("span_id=1234567890123456 session.id=7 code=7 a = b", ("span_id", "body"))
    assert [(t.target, t.name, t.value) for t in terms] == [("field", "span_id", "1234567890123456"), ("attr", "session.id", "7"), ("attr", "code", 7), ("field", "body", "a"), ("field", "body", "b")]
