import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st

from gridloom.functions.wikivalue import visible_lines
from gridloom.operators.multivalue import parse_values, parse_wiki_values, split_values

A, B, C = "Alpha Racing", "Beta Grand Prix", "Gamma, Delta & Epsilon"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), (" \n\t ", []), (A, [A]), (f"{A}; {B}", [A, B]), (f"{A};{B};", [A, B]), (f"{A} | {B}", [A, B]), (f"{A} / {B}", [A, B]), (f"{A}\n{B}", [A, B]), (f"{A}\t{B}", [A, B]), (f"{A} • {B}", [A, B]),
        (f"{A}, {B}", [A, B]), (f"{A}; {C}", [A, C]), (f"{C}", [C]), (f"{A}, {C}, {B}", [A, C, B]), ("Gamma, Delta, Epsilon & Co; X", ["Gamma, Delta, Epsilon & Co", "X"]), ("Gamma, Delta and Epsilon", ["Gamma, Delta and Epsilon"]),
        ("Smith, Felix Autosport", ["Smith, Felix Autosport"]), (f"SMITHS, Felix Jones Autosport, {A}", ["SMITHS", "Felix Jones Autosport", A]), ("Alpha/Beta Engineering", ["Alpha/Beta Engineering"]),
        (f'"{C}", {A}', [C, A]), (f'"{A}";"{B}"', [A, B]), (f'"{A} (1953, 1955)"; ; "{B}"', [f"{A} (1953, 1955)", B]), (f'["{A}", "{C}"]', [A, C]), (f"{A} (1994, 1996) | {B}", [f"{A} (1994, 1996)", B]),
        (f"{A}; {A}", [A, A]), (f'"{A}" (1990); {B}', [f"{A} (1990)", B]), ('"say ""x"" now", b', ['say "x" now', "b"]),
    ],
)
def test_alternatives(text, want):
    assert [v for v, _ in parse_values(text)] == want


def test_malformed_quotes_and_brackets_are_read_and_flagged():
    assert parse_values(f'"{A}; {B}') == [(f'"{A}', "malformed_quote"), (B, "")]
    assert parse_values(f'"{A}" x; {B}') == [(f'"{A}" x', "malformed_quote"), (B, "")]
    assert parse_values(f"{A} (1990; {B}") == [(f"{A} (1990", "open_bracket"), (B, "")]


def test_wiki_values():
    raw = "{{plainlist|\n* [[Alpha Racing (team)|Alpha Racing]]<ref name=\"t\" />\n* {{flagicon|USA}} ''Beta''&nbsp;(1990)\n* [[Gamma, Delta & Epsilon]]\n}}"
    assert [v for v, _ in parse_wiki_values(raw)] == ["Alpha Racing", "Beta (1990)", "Gamma, Delta & Epsilon"]
    assert [v for v, _ in parse_wiki_values("[[Gamma, X]], [[B]]<br>C / [[D]] <small>(1990, 1992)</small>")] == ["Gamma, X", "B", "C", "D (1990, 1992)"]
    assert [v for v, _ in parse_wiki_values("{{ubl|[[A]]|{{nowrap|B, C}}}}")] == ["A", "B, C"]
    assert parse_wiki_values("<!-- none -->") == []
    assert visible_lines("{{hlist|a|b}}") == ["a", "b"]


@given(st.text(alphabet='ab ,;|/"()[]&\n\t•', max_size=60))
def test_never_fails_and_values_are_not_blank(text):
    assert all(v.strip() for v, _ in parse_values(text))
    parse_wiki_values("[[" + text)


def test_a_very_long_field():
    assert len(parse_values("; ".join([A] * 20_000))) == 20_000


def test_operator(spark):
    data = [(1, f"{A}; {B}", "x"), (1, f"{A}; {B}", "x"), (2, None, "x"), (3, "  ", "x"), (None, A, "x"), (4, A, "x")]
    df = spark.createDataFrame(data, "rec_id bigint, teams string, value string").selectExpr("*", "'c' as pos", "'d' as field", "1 as raw")
    got = split_values(df, "rec_id", "teams", "t")
    assert rows(got, "field", "rec_id", "pos", "value", "error") == [("t", 1, 1, A, None), ("t", 1, 2, B, None), ("t", 4, 1, A, None)]
    assert split_values(df.limit(0), "rec_id", "teams", "t").count() == 0
