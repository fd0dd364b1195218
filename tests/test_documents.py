import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.functions.numbers import extract_numbers
from factloom.functions.text import coverage, normal_form
from factloom.operators import chunking as c
from factloom.operators import tables as t


@pytest.mark.parametrize("text, want", [
    ("Revenue was $1,234.5 million", [(1234.5, "million")]), ("a loss of ($500)", [(-500.0, "raw")]), ("in (2024)", [(2024.0, "raw")]), ("see note (7)", [(7.0, "raw")]), ("fell -3.2%", [(-3.2, "percent")]),
    ("41,200 - 8,300", [(41200.0, "raw"), (8300.0, "raw")]), ("6.4% − 31%", [(6.4, "percent"), (31.0, "percent")]), ("up 5 percent", [(5.0, "percent")]), ("5 raw - 3 raw", [(5.0, "raw"), (3.0, "raw")]), ("AB12", []), (None, []),
])
def test_numbers(text, want):
    assert [(n["value"], n["unit"]) for n in extract_numbers(text)] == want


def test_numbers_in_linear_time():
    assert extract_numbers(" " * 200_000 + "7")[0]["value"] == 7
    assert len(extract_numbers("1 - " * 20_000)) == 20_000


def test_parse_and_reconstruct():
    html = "<html><body><p>UNITED STATES</p><p>SECURITIES AND EXCHANGE COMMISSION</p><p>Before</p><table><tr><td>Rev</td><td>$</td><td>45</td><td></td></tr><tr><td>Share</td><td>12</td><td>%</td></tr></table><table><tr><td> </td></tr></table><p>Apple | Form 10-Q | 13</p></body></html>"
    text, tables = c.parse_filing(html)
    assert "[TABLE_0]" in text and "[TABLE_1]" not in text and "Form 10-Q" not in text
    assert tables == [{"table_index": 0, "rows": [["Rev", "$", "45", ""], ["Share", "12", "%"]]}]
    document = c.reconstruct(text, tables)
    assert document.startswith("UNITED STATES") and "| Rev | $45 |" in document and "| Share | 12% |" in document
    assert c.reconstruct("x [TABLE_7] y", []) == "x  y"


@pytest.mark.parametrize("row, want", [(["$", "5", "%"], ["$5", "%"]), (["a", "", "$"], ["a", "$"]), (["5", "%", "%"], ["5%", "%"]), ([" "], [])])
def test_clean_row(row, want):
    assert c.clean_row(row) == want


def test_tables_stay_whole_and_tails_are_no_chunks():
    table = "<TABLE>\n" + "| x |\n" * 900 + "</TABLE>"
    chunks = c.chunks_of(c.blocks_of("intro\n\n" + table + "\n\nend"))
    assert any(k.startswith("<TABLE>") and k.endswith("</TABLE>") for k in chunks) and chunks[-1].endswith("end")
    assert c.chunks_of(["a" * 2100]) == ["a" * 2100]
    assert c.blocks_of("<TABLE>\n| Exhibit Number | Filing Date |\n</TABLE>") == [] and c.chunks_of([]) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab. \n", min_size=1, max_size=900), max_size=8))
def test_chunks_lose_nothing(parts):
    document = "\n\n".join(parts)
    chunks = c.chunks_of(c.blocks_of(document))
    assert all(len(k) <= c.MOST for k in chunks)
    assert all(any(b in k for k in chunks) for b in c.blocks_of(document))


SEGMENTS = """Revenue by segment (in millions):
<TABLE>
| (In millions) | Three Months Ended | Nine Months Ended |
| --- | --- | --- |
| Cloud |  |  |
| Revenue | $34,681 | $98,000 |
| Productivity |  |  |
| Revenue | $35,013 | $101,000 |
</TABLE>"""


def grounded(quote, value, unit="million"):
    words = t.units_of(SEGMENTS)
    return any(t.region_grounds(quote, x, words) or t.span_grounds(quote, x) for x in t.cells_of(t.table_rows(SEGMENTS), words, value, unit))


def test_cells_and_grounding():
    kinds = [r.kind for r in t.table_rows(SEGMENTS)[0]]
    assert kinds == ["header", "separator", "label", "data", "label", "data"]
    assert len(t.cells_of(t.table_rows(SEGMENTS), ["million"], 34681, "million")) == 2
    assert grounded("Cloud | Revenue | $34,681 | $98,000", 34681)
    assert not grounded("Productivity | Revenue | $34,681", 34681)
    assert not grounded("Three Months Ended Cloud Revenue 98,000", 98000)
    assert grounded("| Cloud |  |  |\n| Revenue | $34,681 | $98,000 |", 34681)
    assert not grounded("| Revenue | $34,681 | $98,000 |\n| Productivity |  |  |", 34681)


def test_first_label_above_headers_is_a_header():
    rows = t.table_rows("<TABLE>\n| Three Months Ended |  |\n| Apr 26, 2026 | Apr 27, 2025 |\n| Revenue | 5 |\n</TABLE>")[0]
    assert [r.kind for r in rows] == ["header", "header", "data"]
    rows = t.table_rows("<TABLE>\n| Level 1: |  |\n| Cash | $5 | $— |\n</TABLE>")[0]
    assert rows[0].kind == "label"


def test_coverage():
    assert coverage("ﬁnal “Quote”", "the FINAL  “quote” here") == (True, 1.0, 13)
    assert coverage("", "x") == (False, 0.0, 0) and normal_form(None) == ""
    exact, share, longest = coverage("a" * 250 + "b", "a" * 250)
    assert not exact and share > 0.99 and longest == 250


def test_nested_tables_are_tables_of_their_own():
    html = "<p>a</p><table><tr><td>o1<table><tr><td>n1</td><td>n2</td></tr></table>tail</td><td>o2</td></tr><tr><td>o3</td></tr></table><p>b</p><table><tr><td> </td></tr></table><table><tr><td>z</td></tr></table>"
    text, tables = c.parse_filing(html)
    assert [(t["table_index"], t["rows"]) for t in tables] == [(0, [["o1n1n2tail", "n1", "n2", "o2"], ["n1", "n2"], ["o3"]]), (1, [["n1", "n2"]]), (3, [["z"]])]
    assert text.split() == ["a", "[TABLE_0]", "b", "[TABLE_3]"]
    assert c.parse_filing("<table><tr><td>open<td>next<tr><td>row")[1] == [{"table_index": 0, "rows": [["open", "next"], ["row"]]}]


def test_whole_texts_go_to_python_in_small_batches(spark):
    from factloom.operators.chunking import parse_filings
    from factloom.operators.patterns import occurrences

    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for made in (lambda: parse_filings(spark.createDataFrame([("<p>a</p>",)], "html string")), lambda: occurrences(spark.createDataFrame([(1, "a b")], "doc_id int, text string"), spark.createDataFrame([("a",)], "needle string"))):
        spark.conf.set(key, "10000")
        made()
        assert spark.conf.get(key) == "1000"
    spark.conf.set(key, before)
