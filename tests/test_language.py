import pytest

from quillon.errors import ValidationError
from quillon.functions.analyzer import analyze
from quillon.mapping import Field, Mapping
from quillon.plans.binder import Binder, parse_date
from quillon.plans.parser import parse
from quillon.plans.tree import All, Bool, Boost, Exists, Nothing, OneOf, Range, Term


def t(text, field=None):
    return Term(field, text)


@pytest.mark.parametrize(
    ("query", "tree"),
    [
        ("", Nothing()),
        ("  \t", Nothing()),
        ("*", All()),
        ("a", t("a")),
        ("a b", Bool(should=(t("a"), t("b")))),
        ("a OR b", Bool(should=(t("a"), t("b")))),
        ("a AND b OR c", Bool(should=(Bool(must=(t("a"), t("b"))), t("c")))),
        ("a AND (b OR c)", Bool(must=(t("a"), Bool(should=(t("b"), t("c")))))),
        ("+a -b c", Bool((t("a"),), (t("b"),), (t("c"),))),
        ("a AND NOT b", Bool((t("a"),), (t("b"),))),
        ("a NOT b", Bool((), (t("b"),), (t("a"),))),
        ("NOT NOT a", t("a")),
        ('"a b"', Term(None, "a b", True)),
        ('"a b"~3', Term(None, "a b", True, slop=3)),
        ('"a b"*', Term(None, "a b", True, prefix=True)),
        ("f:x", t("x", "f")),
        ("f:(x y)", Bool(should=(t("x", "f"), t("y", "f")))),
        ("f:(x g:y)", Bool(should=(t("x", "f"), t("y", "g")))),
        ("f:[1 TO 5}", Range("f", "1", "5", True, False)),
        ("f:{* TO 5]", Range("f", None, "5", False, True)),
        ("f:[-3 TO -1]", Range("f", "-3", "-1")),
        ("f:>=5", Range("f", "5", None, True, True)),
        ("f:<5", Range("f", None, "5", True, False)),
        ("f: IN [a b]", OneOf("f", ("a", "b"))),
        ("f:*", Exists("f")),
        ("a^2.5 b", Bool(should=(Boost(t("a"), 2.5), t("b")))),
        ("(a b)^2", Boost(Bool(should=(t("a"), t("b"))), 2.0)),
        (r"a\:b", t("a:b")),
        (r"\*", t("*")),
        (r"\AND", t("AND")),
        ("data-intensive", t("data-intensive")),
        ("c++", t("c++")),
        ("f:2026-06-20T00:00:00Z", t("2026-06-20T00:00:00Z", "f")),
        ("f:-5", t("-5", "f")),
    ],
)
def test_trees(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize("query", ["-a", "NOT a", "a AND", "AND a", "(a", "a)", '"a', "f:[1 5]", "f:[1 TO 5", "[1 TO 5]", "a^x", "a^", "f:", ">5", "a\\", "-a -b", "NOT a AND NOT b", "OR"])
def test_refused(query):
    with pytest.raises(ValidationError):
        parse(query)


M = Mapping({"t": Field("text", True), "k": Field("keyword", True), "n": Field("i64", True), "x": Field("f64", True), "d": Field("date", True), "note": Field("keyword"), "f": Field("i64", False, True)})


@pytest.mark.parametrize("query", ["missing:a", "note:a", "f:1", "n:1.5", "n:a", "n:9223372036854775808", "x:nan", "d:2026-06-20", "n:[a TO b]", "d:>yesterday", "n: IN [1 x]"])
def test_unbound(spark, query):
    with pytest.raises(ValidationError):
        Binder(M).bind(parse(query))


def test_no_default_field(spark):
    with pytest.raises(ValidationError):
        Binder(Mapping({"n": Field("i64", True)})).bind(parse("a"))


def test_analyzer(spark):
    from pyspark.sql import functions as F

    from quillon.functions.analyzer import tokens

    texts = ["Hello, WORLD!", "data-intensive", "", "x" * 39 + " " + "y" * 40, "naïve Éa 日本 ½ a_b", "don't 3.14"]
    df = spark.createDataFrame([(x,) for x in texts], "t string").select(tokens(F.col("t")).alias("t"))
    assert [r.t for r in df.collect()] == [analyze(x) for x in texts]
    assert analyze("data-intensive") == ["data", "intensive"]


@pytest.mark.parametrize("text", ["2026-06-20T00:00:00Z", "2026-06-20t00:00:00.123456789z", "2026-06-20T00:00:00+05:30", "2016-12-31T23:59:60Z"])
def test_dates(text):
    assert parse_date(text).tzinfo is not None


@pytest.mark.parametrize("text", ["2026-06-20", "2026-06-20 00:00:00Z", "2026-06-20T00:00:00", "2026-13-01T00:00:00Z", "20260620T000000Z", "x"])
def test_no_dates(text):
    with pytest.raises(ValueError):
        parse_date(text)
