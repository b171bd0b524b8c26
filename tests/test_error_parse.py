import csv
import io
import json

from hypothesis import given, settings
from hypothesis import strategies as st

from reviewloom.operators import error_parse as ep

GOOD = {"review_id": "r", "product_id": "p", "rating": 4, "review_text": "fine", "source": "web", "created_at": "2026-01-02T03:04:05Z", "schema_version": 1}


def one(text, fmt):
    return ep.parse_records([text], [fmt])[0]


def row(cells):
    out = io.StringIO()
    csv.writer(out, lineterminator="").writerow(cells)
    return out.getvalue()


CELLS = ["r", "p", "4", 'a "quoted", text\nline', "web", "2026-01-02T03:04:05+02:00", "", "1", ""]


def test_reasons_csv():
    assert one(row(CELLS), "csv")[0] is None
    cases = {
        'r,p,4,a "b" c,web,2026-01-02T03:04:05Z,,1,': "broken_quoting", 'r,p,4,"abc,web,2026-01-02T03:04:05Z,,1,': "broken_quoting", 'r,p,4,"a"b,web,2026-01-02T03:04:05Z,,1,': "broken_quoting",
        "r,p,4,a,b,web,2026-01-02T03:04:05Z,,1,": "column_count", "r;p;4": "column_count", "": "column_count", ' r,p,"4" ,a,web,x,,1,': "broken_quoting",
        " ,p,4,a,web,2026-01-02T03:04:05Z,,1,": "missing_field", "r,p,6,a,web,2026-01-02T03:04:05Z,,1,": "bad_rating", "r,p,,a,web,2026-01-02T03:04:05Z,,1,": "bad_rating",
        "r,p,4,a,web,2026-02-30T03:04:05Z,,1,": "bad_timestamp", "r,p,4,a,web,2026-02-20T03:04:05,,1,": "bad_timestamp", "r,p,4,a,web,2026-02-20T03:04:05Z,2026-02-20T04:04:05+02:00,1,": "bad_timestamp",
        "r,p,4,a,web,2026-02-20T03:04:05Z,,2,": "bad_version",
    }
    for text, reason in cases.items():
        assert one(text, "csv")[0] == reason, text
    assert one(None, "csv")[0] == "column_count"


def test_edits_state_the_reason():
    reason, edits, cost = one('r,p,4,"abc,web,2026-01-02T03:04:05Z,,1,', "csv")[:3]
    assert "quote@" in edits and cost >= 1 and reason == "broken_quoting"
    reason, edits, _ = one("r,p,4,a,b,web,2026-01-02T03:04:05Z,,1,", "csv")[:3]
    assert edits.split("@")[0] == "delete_delimiter" and reason == "column_count"
    assert "insert_delimiter" in one("r,p", "csv")[1]


def test_reasons_json():
    assert one(json.dumps(GOOD), "jsonl")[0] is None
    assert one(json.dumps(GOOD | {"nested": {"a": [1, {"b": None}]}}), "json")[0] is None
    bad = ["", "null", "[]", "[1]", '"x"', "{} x", json.dumps(GOOD) + json.dumps(GOOD), json.dumps(GOOD)[:-1], json.dumps(GOOD)[:40], str(GOOD), '{"a": NaN}', '{"a": "x\ty"}', '{"a":1,}', '{"a" 1}', '{a:1}', '{"a": 01}', '{"a": "\\x"}', "﻿{}"]
    for text in [*bad, None]:
        assert one(text, "json")[0] == "not_json", text
    for change, reason in [({"review_text": "  "}, "missing_field"), ({"source": None}, "missing_field"), ({"rating": True}, "bad_rating"), ({"rating": 4.5}, "bad_rating"), ({"rating": "4"}, "bad_rating"), ({"rating": 4.0}, None), ({"created_at": "soon"}, "bad_timestamp"), ({"updated_at": "2025-01-01T00:00:00Z"}, "bad_timestamp"), ({"updated_at": None}, None), ({"schema_version": 2}, "bad_version"), ({"schema_version": None}, "bad_version")]:
        assert one(json.dumps(GOOD | change), "json")[0] == reason, change


cell = st.text(alphabet='ab," \n', max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(cell, min_size=1, max_size=12))
def test_written_csv_needs_no_quote_edit(cells):
    """A correct writer's record parses: free with nine cells, else with delimiter edits alone."""
    text = row(cells) if cells != [""] else ""
    cost = ep.error_scripts([text], "csv")[0][0]
    assert cost == abs(9 - len(cells)) * ep.DELIM_COST if len(cells) != 9 else ep.csv_cells(text) == cells and cost == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",\n', max_size=14))
def test_programme_agrees_with_the_free_path(text):
    """Zero cost exactly where the deterministic path accepts; the cheapest repair is never dearer than removing all quotes."""
    cost = int(ep.error_scripts([text], "csv")[0][0])
    assert (cost == 0) == (ep.csv_cells(text) is not None)
    assert cost <= text.count('"') * ep.QUOTE_COST + 20


def brute(text: str, cells: int = 3) -> int:
    """Cheapest edit by search over all edited texts with one edit, for short texts of a three-cell format."""
    import re

    ok = re.compile(rf"{ep._CELL}(?:,{ep._CELL}){{{cells - 1}}}")
    if ok.fullmatch(text):
        return 0
    near = [text[:i] + text[i + 1 :] for i in range(len(text)) if text[i] == '"'] + [text[:i] + '"' + text[i:] for i in range(len(text) + 1)]
    return 1 if any(ok.fullmatch(x) for x in near) else 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='a",', max_size=9).filter(lambda t: t.count(",") == 2))
def test_one_quote_repairs_are_found(text):
    cost = int(ep.csv_automaton(3).parse([ep.code_csv(text)])[0][0])
    if brute(text) == 1:
        assert cost <= ep.QUOTE_COST


def test_frame(spark):
    rows = [("raw", "1", json.dumps(GOOD), "jsonl"), ("raw", "1", json.dumps(GOOD), "jsonl"), ("raw", "2", None, None), ("raw", "3", row(CELLS), "csv"), ("raw", "4", "x" * 5000 + '"', "csv")]
    df = spark.createDataFrame(rows, "source_table string, record_key string, record string, format string")
    parsed = ep.error_parse(df)
    assert {(r[1], r[2]) for r in ep.rejected(parsed).collect()} == {("2", "column_count"), ("4", "broken_quoting")}
    good = {r["record_key"]: r for r in ep.loaded(parsed).collect()}
    assert set(good) == {"1", "3"} and good["3"]["review_text"] == CELLS[3] and good["1"]["rating"] == 4
    assert ep.error_parse(df.limit(0)).count() == 0


def test_numbers_and_depth_have_no_limit():
    rec = '{"review_id":"r","product_id":"p","rating":4,"review_text":"ok","source":"web","created_at":"2026-01-01T00:00:00Z","schema_version":1,"more":%s}'
    for value in ("1" * 5000, "[" * 20_000 + "]" * 20_000, '{"a":' * 3000 + "1" + "}" * 3000):
        assert ep.parse_records([rec % value], ["json"])[0][0] is None
    for value in ("[" * 20_000 + "]" * 19_999, '{"a":' * 3000 + "}" * 3000, "[1,]"):
        assert ep.parse_records([rec % value], ["json"])[0][0] == "not_json"


def test_a_missing_brace_around_nested_values_is_one_edit():
    whole = '{"a": {"b": [1, 2, {"c": "d, }"}]}, "e": [[], {}], "f": "x"}'
    assert ep.json_object(whole)
    reason, edits, cost, *_ = ep.parse_records([whole[:-1]], ["json"])[0]
    assert (reason, cost) == ("not_json", 1) and edits == f"insert_delimiter@{len(whole) - 1}"


def test_long_records_have_their_edits_listed(monkeypatch):
    long = "a,b,c," + "x" * 900_000 + ',"' + "y, " * 10_000 + ',g,h,i'
    reason, edits, cost, *_ = ep.parse_records([long], ["csv"])[0]
    assert reason == "broken_quoting" and edits.count("quote") == 1
    texts = ['a,b,"c,d,e,f,g,h,i', "a,b,c,d" * 3, 'ab"cd,e,f' * 9, "x" * 50]
    want = ep.error_scripts(texts, "csv")
    monkeypatch.setattr(ep, "SEGMENT", 7)
    got = ep.error_scripts(texts, "csv")
    assert got[1] == want[1] and got[0].tolist() == want[0].tolist()
