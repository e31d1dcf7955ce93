"""Trees of six languages: programs whose flags, functions and parents are solved by hand."""

import pytest
from pyspark.sql import functions as F

from lexiprobe.functions import flags, trees
from lexiprobe.shapes import SHAPES

def what(row):
    return (row["variable"], row["line"], (row["occurrence_type"], row["detection_pattern"]))


@pytest.mark.parametrize(("language", "code", "want"), SHAPES)
def test_flags_of_shapes(language, code, want):
    rows = flags.occurrence_rows(code, language)
    assert sorted(map(what, rows)) == sorted(want)
    assert all(code[r["s"] : r["e"]].lstrip("$") == r["variable"] for r in rows)


def test_there_are_forty_shapes():
    assert len(SHAPES) >= 40 and {s[0] for s in SHAPES} == set(trees.LANGUAGES)


@pytest.mark.parametrize("language", sorted(trees.LANGUAGES))
def test_node_tables_nest(language):
    for _, code, _ in SHAPES:  # also programs of other languages: nothing may fail
        for cut in (len(code), len(code) // 2, 7):
            rows = trees.node_rows(code[:cut], language)
            assert [r["id"] for r in rows] == list(range(len(rows))) and rows[0]["parent"] is None
            for r in rows[1:]:
                assert r["parent"] < r["id"] and 0 <= r["s"] <= r["e"] <= cut
    assert [r["kind"] for r in trees.node_rows(None, language)] == ["program"]


def test_functions_of_programs():
    named = lambda code, language: [f.text for f in trees.outer_functions(trees.parse(code, language), language)]
    assert named("int C::g() { }\nstruct S { void m() { struct T { void n() {} }; } S(); ~S() {} };\nint h();\nnamespace a { int k() { auto l = [] { return 1; }; } }", "C++") == ["C::g", "m", "k"]
    assert named("class A { A() {} int f() { new B() { int g() { } }; } static class C { int h() { } } interface D { int i(); } }", "Java") == ["f", "h"]
    assert named("class K extends J { constructor(a) { } #p() { } 'q'() { } static r() { } } function s() { } const t = () => { }; { function u() { } }", "Javascript") == ["constructor", "#p", "'q'", "r", "s"]
    assert named("<?php if (1) { function f() { function g() { } } } abstract class A { abstract function h(); final public function i() { } }", "PHP") == ["f", "h", "i"]
    assert named("func f() {\n g := func() { }\n}\nfunc (r R) h[T any](x T) (int, error) {\n}", "Go") == ["f", "h"]
    with pytest.raises(ValueError, match="grammar"):
        trees.parse("x", "C#")


def test_long_and_deep_programs_are_read():
    long = "class A { void f() {\n" + "".join(f" boolean x{i} = true;\n" for i in range(5000)) + "} }"
    assert len(flags.occurrence_rows(long, "Java")) == 5000
    deep = "int f() { return " + "(" * 3000 + "1" + ")" * 3000 + "; }"
    assert trees.node_rows(deep, "C")[0]["kind"] == "program"


def test_parents_and_statements():
    (row,) = [r for r in flags.occurrence_rows("class A { void f() { if (!(up)) {} } }", "Java") if r["variable"] == "up"]
    assert (row["parent_type"], row["statement_type"], row["function"], row["function_line"]) == ("paren", "if", "f", 1)


def test_node_table_of_programs(spark):
    df = spark.createDataFrame([(1, "Go", "func f() {\n x := g(1)\n}"), (2, "C#", "class A {}"), (3, "C", None)], "problem_id int, language string, code string")
    rows = trees.program_nodes(df)
    got = [(r["problem_id"], r["kind"], r["text"]) for r in rows.orderBy("problem_id", "id").collect()]
    assert got == [(1, "program", ""), (1, "function", "f"), (1, "block", ""), (1, "assign", ":="), (1, "name", "x"), (1, "call", ""), (1, "name", "g"), (1, "arguments", ""), (1, "literal", "1"), (3, "program", "")]
    parents = rows.alias("a").join(rows.alias("b"), (F.col("a.problem_id") == F.col("b.problem_id")) & (F.col("a.parent") == F.col("b.id"))).filter("a.text = 'x'")
    assert parents.first()["kind"] is not None


def test_programs_that_are_none_are_read_to_their_end():
    """Tokens of all languages in any order, and shapes with tokens lost: no program stops the parser, and nodes stay within it."""
    import random

    words = sorted({t.text for language, code, _ in SHAPES for t in trees.tokens(code, language)})
    rng = random.Random(11)
    for n in range(600):
        language, code, _ = SHAPES[n % len(SHAPES)]
        own = [t.text for t in trees.tokens(code, language)]
        soup = [rng.choice(words) for _ in range(rng.randint(1, 50))] if n % 2 else [w for w in own if rng.random() > 0.1]
        text = " ".join(soup)
        rows = trees.node_rows(text, language)
        assert all(r["s"] <= r["e"] <= len(text) for r in rows)
        flags.occurrence_rows(text, language)
