"""Operators on small tables of our own: golden cases, refusals and metamorphic checks."""

import random
from statistics import mean

import pytest
from pyspark.sql import functions as F

from lexiprobe.functions import flags, rename, roles, sites
from lexiprobe.functions import text as X
from lexiprobe.functions import vectors as V
from lexiprobe.operators import bootstrap as B
from lexiprobe.operators import joins as J
from lexiprobe.operators import metrics as M
from lexiprobe.operators import occurrences as O
from lexiprobe.operators import splits as S
from lexiprobe.plans import gates as G
from lexiprobe.plans import prompts as P
from lexiprobe.plans import schedules as Q
from lexiprobe.sources import tables as T
from lexiprobe.streaming import store as I


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


# --- text -----------------------------------------------------------------------------------------


def test_tokens_to_source(spark):
    tokens = ["def", "f", "(", "x", ")", ":", "NEW_LINE", "INDENT", "return", "x", "NEW_LINE", "DEDENT", "DEDENT", "y", "=", "1"]
    brace = lambda text, **k: X.join_brace_tokens(F.array(*(F.lit(t) for t in text.split(" "))), **k)
    got = one(
        spark, a=X.join_tokens(F.array(*(F.lit(t) for t in tokens))), b=brace("int f ( int x ) { x ++ ; a . b . c = 1 . 5 ; }"), c=brace("p - > q ; ( x ) = > y ; one NEW_LINE two"),
        d=brace("< ? php $ a = A :: b ( $ c ) ; ? >", php=True),
    )
    assert got["a"] == "def f ( x ) :\n    return x\ny = 1"
    assert (got["b"], got["c"], got["d"]) == ("int f(int x) {x++; a.b.c = 1.5;}", "p -> q; (x) => y; one\ntwo", "<?php $a = A ::b($c); ?>")


T3 = "'" * 3
# (code, target, the statement without blanks around): stops count in code only, and outside of brackets
BOUNDS = [
    ("alpha = 1; beta = 2; gamma = 3", "beta", "beta = 2;"),
    ("alpha = 1\nbeta = 2\n", "2", "beta = 2"),
    ("lonely", "lonely", "lonely"),
    ('say("a; b"); beta = 2;', "say", 'say("a; b");'),
    ("say('}'); beta = 2;", "beta", "beta = 2;"),
    ("note = `x; {y}`; beta", "beta", "beta"),
    ("a = 1 # one; two\nb = 2", "1", "a = 1 # one; two"),
    ("a = /* ; */ 7; b", "7", "a = /* ; */ 7;"),
    ("run(\n  one,\n  two\n)\nafter = 0", "two", "run(\n  one,\n  two\n)"),
    ("row = [\n 1,\n 2]; after", "2", "row = [\n 1,\n 2];"),
    ("while (k < 9) { k++; }", "k++", "k++;"),
    ("while (k < 9) { k++; }", "k < 9", "while (k < 9) {"),
    ("text = 'it\\'s; so'; beta = 1;", "beta", "beta = 1;"),
    (f"doc = {T3}one;\n{{two}}{T3}\nbeta = 1", "beta", "beta = 1"),
    (f"doc = {T3}one \\{T3} two;{T3}; beta", "doc", f"doc = {T3}one \\{T3} two;{T3};"),
    ("for (;;) { go(); } end", "end", "end"),
]


@pytest.mark.parametrize(("code", "target", "want"), BOUNDS)
def test_statement_bounds(code, target, want):
    i = code.index(target)
    s, e = X.statement_bounds(code, i, i + len(target))
    assert code[s:e].strip() == want


def test_marks_of_files(spark):
    yes = ("# Auto Generated", "// do not modify", "THIS FILE WAS GENERATED", "auto_generated", "x @generated y", "code generated by hand")
    no = ("machine generated", "regenerated bystander", "degenerated by", "x" * 8000 + "autogenerated")
    rows = spark.createDataFrame([(t, t in yes) for t in yes + no], "t string, want boolean")
    assert rows.filter(X.generated(F.col("t")) != F.col("want")).count() == 0
    got = one(spark, a=X.notebook(F.lit("a/B.IPYNB"), F.lit("")), b=X.notebook(F.lit("a.py"), F.lit("IPython.core")), c=X.notebook(F.lit("a.py"), F.lit("import IPython")), n=X.full_lines(F.lit("a\r\n\t\n \u3000\nb\x0bc\n")), p=X.problem_id(F.lit("\n\tA\u00a0 b\n")), q=X.problem_id(F.lit("a b")))
    assert (got["a"], got["b"], got["c"], got["n"]) == (True, True, False, 3) and got["p"] == got["q"]


def test_masks_and_places(spark):
    code = "int i = 0;\nprint(i, limit);"
    row = spark.createDataFrame([(code, 17, 18, "i")], "c string, s int, e int, v string")
    c, s = F.col("c"), F.col("s")
    got = row.select(
        X.masked(c, F.lit(11), F.length(c), F.col("v")).alias("sub"), X.masked(c, F.lit(11), F.length(c), F.col("v"), whole_word=True).alias("word"),
        X.line_of(c, s).alias("line"), X.column_of(c, s).alias("col"), X.line_span(c, s).alias("span"), X.span_holds(c, s, F.col("e"), F.col("v")).alias("ok"),
        X.char_offset(F.lit("é日x"), F.lit(5)).alias("chars"),
    ).first()
    assert got["sub"] == "pr VAR nt( VAR , l VAR m VAR t);" and got["word"] == "print( VAR , limit);"
    assert (got["line"], got["col"], tuple(got["span"]), got["ok"], got["chars"]) == (2, 6, (11, 27), True, 2)


def test_word_ngrams_are_blind_to_blanks(spark):
    a, b = one(spark, a=F.array_sort(X.word_ngrams(F.lit("Ab  cd"))), b=F.array_sort(X.word_ngrams(F.lit(" ab\n cd "))))
    assert a == b == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "cd", "d ", " cd", "cd ", " cd "])


def test_slugs(spark):
    got = one(spark, a=X.model_slug(F.lit("Org/Some-Model_1.5B")), b=X.language_slug(F.lit("C++")), c=X.language_slug(F.lit("C#")), d=X.safe_component(F.lit("a/b c")), e=X.ngram_class(F.lit(" (x")), f=X.ngram_class(F.lit("a=;")), g=X.ngram_class(F.lit(" for")), h=X.ngram_class(F.lit("9.1")), i=X.ablate_class(F.lit("a{(b)};"), "paren"))
    assert tuple(got) == ("somemodel15b", "cpp", "csharp", "a--b--c", "paren", "terminator", "keyword", "other", "a{ b };")
    with pytest.raises(ValueError):
        X.ablate_class(F.lit("x"), "digits")


def test_word_ngrams_by_different_words(spark):
    rows = spark.createDataFrame([(1, "ab ab c"), (2, "ab"), (3, None), (4, "")], "k int, t string")
    got = {(r["k"], r["ngram"]): r["c"] for r in X.ngram_rows(rows, "k", "t").collect()}
    want = {(r["k"], r["g"]): r["count"] for r in rows.select("k", F.explode(X.word_ngrams(F.col("t"))).alias("g")).groupBy("k", "g").count().collect()}
    assert got == want and got[1, " ab "] == 2


# --- programs ------------------------------------------------------------------------------------


def test_python_roles():
    code = "class K: pass\ndef f(a):\n    n = 0\n    done = True\n    zero = 0\n    for i, _ in a:\n        n += a[i]\n        out.append(n)\n    n2 = 5\n    n2 += 1\n"
    got = roles.python_roles(code)
    assert got == {"index_key": ["i"], "accumulator": ["n", "out"], "iterator": ["i"], "boolean": ["done"], "class_struct": ["K"]}
    assert not any(roles.python_roles("def (").values())
    # a subscript is a name and nothing more; a nested or computed one is none
    got = roles.python_roles("async def f():\n    async for z in y:\n        w += a[i + 1]\n    for v in b:\n        c += x[g(j)]\n        d[k] = e[0]\n        h = q.append(v)\n")
    assert got == {"index_key": ["k"], "accumulator": ["c"], "iterator": ["v"], "boolean": [], "class_struct": []}


def test_pattern_roles(spark):
    code = "for (int i = 0; i < n; ++i) { s += a[i]; v.push(x); } struct P {}; bool ok = true;"
    got = one(spark, r=roles.pattern_roles(F.lit(code), "C++"))["r"]
    assert got == {"index_key": ["i"], "accumulator": ["s", "v"], "iterator": ["i"], "boolean": ["ok"], "class_struct": ["P"]}
    php = one(spark, r=roles.pattern_roles(F.lit("foreach ($rows as $k => $v) { $ t += $a[$k]; }"), "PHP"))["r"]
    assert php["iterator"] == ["k", "v"] and php["accumulator"] == ["t"] and php["index_key"] == ["k"]


# every hit's own sites: (name, line, occurrence, pattern)
FLAG_CASES = [
    ("Python", "def f(x):\n    ok = True\n    n = 1\n    if ok:\n        return ok\n    return n\n", [("ok", 2, "assignment", "assign_bool_literal"), ("ok", 4, "conditional_use", "if_test"), ("ok", 5, "return_use", "return_bool"), ("n", 6, "return_use", "return_bool")]),
    ("Python", "def f(a, b):\n    while not a:\n        a = b or a\n    return 1\n", [("a", 2, "loop_use", "while_test"), ("a", 3, "assignment", "assign_boolop_lhs"), ("a", 3, "conditional_use", "assign_boolop_rhs"), ("b", 3, "conditional_use", "assign_boolop_rhs")]),
    ("Python", "def f(n):\n    i = 0\n    if n == 0:\n        i = 1\n    x = 0.0\n", []),
    ("Python", "def f(ok, a):\n    if True is ok:\n        pass\n    elif a[ok]:\n        pass\n    c: bool = False\n    d = not c\n    return 1 if d else 2\n", [("ok", 2, "conditional_use", "if_test"), ("c", 6, "definition", "annassign_bool_literal"), ("c", 7, "conditional_use", "assign_not_name_inner"), ("d", 7, "assignment", "assign_not_name"), ("d", 8, "conditional_use", "if_exp_test"), ("d", 8, "return_use", "return_bool")]),
    ("Python", "def f():\n    def g():\n        inner = True\n    x, y = a = False, 1\n    (p, *q) = r = True\n", [("p", 5, "assignment", "assign_bool_literal"), ("q", 5, "assignment", "assign_bool_literal"), ("r", 5, "assignment", "assign_bool_literal")]),
    ("Java", 'class A { void f() {\n boolean b = true;\n if (b) { g(); }\n String s = "b = true";\n if (b[0] && c.d) {}\n} }', [("b", 2, "assignment", "assign_bool_literal"), ("b", 3, "conditional_use", "if_test")]),
    ("Go", "func f() {\n ok := true\n for ok {\n  ok = false\n }\n if x := g(); !ok {\n }\n}", [("ok", 2, "assignment", "assign_bool_literal"), ("ok", 3, "loop_use", "while_test"), ("ok", 4, "assignment", "assign_bool_literal")]),
    ("PHP", "<?php function f($x) {\n $on = TRUE;\n if ($on == false || $x) { return 1; }\n}", [("on", 2, "assignment", "assign_bool_literal"), ("on", 3, "conditional_use", "if_test"), ("x", 3, "conditional_use", "if_test")]),
    ("Javascript", "function f() { let n = 1;\n let on = false;\n while (on) { on = true; }\n}", [("on", 2, "assignment", "assign_bool_literal"), ("on", 3, "loop_use", "while_test"), ("on", 3, "assignment", "assign_bool_literal")]),
    ("C++", "int f(int a) {\n bool t = false; t += 1;\n return t ? a : 0;\n}", [("t", 2, "assignment", "assign_bool_literal"), ("t", 3, "conditional_use", "if_exp_test"), ("t", 3, "return_use", "return_bool")]),
    ("Ruby", "def f\n  on = true\n  if on\n    return on\n  end\n  return on + 1\nend\n", [("on", 2, "assignment", "assign_bool_literal"), ("on", 3, "conditional_use", "if_test"), ("on", 4, "return_use", "return_bool")]),
]


@pytest.mark.parametrize(("language", "code", "want"), FLAG_CASES)
def test_flag_occurrences(language, code, want):
    rows = flags.occurrence_rows(code, language)
    assert sorted((r["variable"], r["line"], r["occurrence_type"], r["detection_pattern"]) for r in rows) == sorted(want)
    assert all(code[r["s"] : r["e"]].lstrip("$") == r["variable"] for r in rows)


# names that are flags, returns aside: only True and False are literals, and only not, and, or and comparisons with them are looked through
LITERALS = [
    ("def h():\n    up, down = 1, None\n", set()), ("def h():\n    up = down = False\n", {"up", "down"}), ("def h():\n    up: bool = True\n    n: int = 1\n", {"up"}), ("def h():\n    up: bool\n", set()),
    ("def h(a, b, c):\n    up = a or b and not c\n", {"up", "a", "b", "c"}), ("def h(a):\n    up = not a.b\n    down = not a\n", {"a", "down"}), ("def h(a, b):\n    if a is False != b:\n        pass\n", {"a", "b"}),
    ("def h(a, b):\n    while a == 1 or b == 'True' or a > False:\n        pass\n", set()), ("def h(a, b):\n    up = a if b else 0\n", {"b"}), ("def h(a):\n    up = (a and 3) + 1\n", set()), ("def h(a):\n    up |= True\n", set()),
]


@pytest.mark.parametrize(("code", "want"), LITERALS)
def test_only_true_and_false_are_literals(code, want):
    assert {r["variable"] for r in flags.occurrence_rows(code, "Python") if r["detection_pattern"] != "return_bool"} == want


def test_flag_labels_and_errors():
    rows, error = flags.python_labels("def f(b):\n    x = 1\n    if b:\n        a = True\n    a = not b\n")
    assert error is None and [tuple(r.values()) for r in rows] == [("f", "a", 4, "a = True"), ("f", "b", 3, "b")]
    assert flags.python_labels("x = 1")[1] == flags.NO_FUNCTION and "line 1" in flags.python_labels("def (")[1]


def test_spans_are_characters():
    code = "def f(é):\n    é = True\n    return é\n"
    rows = flags.occurrence_rows(code, "Python")
    assert rows and all(code[r["s"] : r["e"]] == "é" for r in rows)


def role_sites(spark, code, language, **how):
    df = spark.createDataFrame([(1, language, code)], "problem_id int, language string, code string")
    return [(r["role"], r["variable"], r["line"], r["function"]) for r in O.role_site_rows(df, **how).orderBy("s", "role").collect()]


def test_role_sites_by_scope(spark):
    code = "def f(a):\n    for i in a:\n        s += i\n    x[k] = i\n\ndef g(i):\n    i = True\n    k = 's i'  # i\n"
    assert role_sites(spark, code, "Python") == [("iterator", "i", 2, "f"), ("accumulator", "s", 3, "f"), ("iterator", "i", 3, "f"), ("index_key", "k", 4, "f"), ("iterator", "i", 4, "f"), ("boolean", "i", 6, "g"), ("boolean", "i", 7, "g")]
    several = "for x in y:\n    x += 1\n    z[x] = True\n"
    assert role_sites(spark, several, "Python") == [] and {r[0] for r in role_sites(spark, several, "Python", drop_shared=False)} == {"iterator", "index_key"}
    assert role_sites(spark, None, "Java") == role_sites(spark, "def f(", "Python") == role_sites(spark, "x[i] = 1", "Go") == []
    # a loop counts for its own function, and for the module whatever the function
    nested = "for a in b:\n    def f(c):\n        n += 1\n        while c:\n            m += 1\nprint(n, m)\n"
    assert role_sites(spark, nested, "Python", roles=("accumulator",)) == [("accumulator", "m", 5, "f"), ("accumulator", "n", 6, None), ("accumulator", "m", 6, None)]


# names that a scope binds more than once are several variables
@pytest.mark.parametrize(("language", "code", "want"), [
    ("Java", "class A {\n void f() { for (int i = 0; i < 3; i++) { t += 1; } for (int i = 0; i < 4; i++) {} }\n void g() { for (int j : xs) { t += j; } }\n}", {("A", None), ("t", "f"), ("t", "g"), ("j", "g")}),
    ("Java", "class A { int f(int n) { { boolean up = true; } { boolean up = false; } n += 1; return n; } }", {("A", None), ("n", "f")}),
    ("Java", "class A { void f() { boolean up = true; Runnable r = () -> { boolean up = false; }; } void g(boolean up) { up = true; } }", {("A", None), ("up", "g")}),
    ("C++", "int f(bool up) { up = true; if (up) { bool up = false; } int n; n += 1; return n; }", {("n", "f")}),
    ("C++", "void f() { for (auto x : v) { s += x; } for (auto x : w) { s += x; } }", {("s", "f")}),
    ("C++", "void f() { for (size_t k = 0; k < 3; ++k) v[k] = 1; }\nvoid g() { bool k = true; use(k); }", {("k", "g")}),
    ("C", "int f() { unsigned int total = 0; total += 1; while (1) { long total = 2; total -= 1; } return 0; }", set()),
    ("Javascript", "function f(xs) { for (const x of xs) { n += x; } for (const x of xs) { n -= x; } }", {("n", "f")}),
    ("Javascript", "function f(xs) { for (let x of xs) { n += x; } for (x of xs) { } }", {("x", "f"), ("n", "f")}),
    ("Javascript", "class K { f(on) { const g = (on) => on; on = true; } h(on) { on = true; } }", {("K", None), ("on", "h")}),
    ("PHP", "<?php function f($xs) { $on = true; foreach ($xs as $k => $v) { $s += $v; $on = false; } }", {("on", "f"), ("k", "f"), ("v", "f"), ("s", "f")}),
])
def test_names_bound_twice_are_dropped(spark, language, code, want):
    assert {(v, f) for _, v, _, f in role_sites(spark, code, language)} == want


def test_function_records_and_places():
    code = "def f(a):\n    a += 1\n    while a:\n        b: int = a if a else 0\n    return a[0]\n\nasync def g():\n    async for q in w:\n        pass\n"
    (f, g), error = sites.function_records(code)
    assert error is None and [n["kind"] for n in f["nodes"]] == ["function_def", "aug_assign", "while_loop", "ann_assign", "if_exp", "return", "subscript"]
    assert [(a["kind"], a["op"], a["targets"]) for a in f["assignments"]] == [("aug_assign", "Add", ["a"]), ("ann_assign", None, ["b"])] and [x["kind"] for x in g["loops"]] == ["async_for"]
    places = sites.places_in_function(code, "f", "a")
    assert (places[0], len(places)) == ({"line": 1, "col": 6, "ctx": "arg"}, 6) and sites.places_in_function(code, "h", "a") is None and sites.places_in_function("(", "f", "a") is None


def test_constants_follow_branches():
    code = "ok = True\nif ok:\n    ok = False\n    print(ok)\nelse:\n    print(ok)\nprint(ok)\ndef f():\n    print(ok)\n"
    assert [(code.count("\n", 0, s) + 1, v) for s, _, v in sites.constant_uses(code)] == [(2, 1), (4, 0), (6, 1), (7, 1)]


def test_unsupported_languages():
    with pytest.raises(ValueError):
        flags.occurrence_rows("x", "C#")
    with pytest.raises(rename.UnsupportedLanguage):
        rename.rename("x", "all_same", 0, "Java")
    assert rename.rename("x", "baseline", 0, "Java") == "x"


def test_renaming_is_sequential_and_repeatable():
    assert rename.apply_map("aa b", {"aa": "b", "b": "c"}) == "c c"
    code = "def f(alpha, beta):\n    gamma = alpha + beta\n    return gamma\n"
    for s in rename.STRATEGIES:
        assert rename.rename(code, s, 4) == rename.rename(code, s, 4)


def test_spans_follow_edits(spark):
    edits = F.array(F.struct(F.lit(0).alias("s"), F.lit(2).alias("e"), F.lit("long").alias("repl")), F.struct(F.lit(10).alias("s"), F.lit(12).alias("e"), F.lit("x").alias("repl")))
    got = one(spark, a=J.shift_spans(F.lit(4), F.lit(6), edits), b=J.shift_spans(F.lit(10), F.lit(12), edits), c=J.shift_spans(F.lit(11), F.lit(13), edits), d=J.shift_spans(F.lit(20), F.lit(21), edits))
    assert (tuple(got["a"]), tuple(got["b"]), got["c"], tuple(got["d"])) == ((6, 8), (12, 13), None, (21, 22))


# --- joins, splits, statistics -----------------------------------------------------------------


def test_exact_pairs_refuses(spark):
    rows = spark.createDataFrame([("p", "a", 1.0), ("p", "b", 2.0), ("q", "a", 3.0), ("q", "b", 4.0)], "k string, g string, v double")
    assert sorted(tuple(r) for r in J.exact_pairs(rows, "k", "g", ["a", "b"], ["v"]).collect()) == [("p", 1.0, 2.0), ("q", 3.0, 4.0)]
    for bad in (rows.filter("v < 4"), rows.union(rows.limit(1)), rows.withColumn("g", F.when(F.col("v") == 4, "c").otherwise(F.col("g")))):
        with pytest.raises(J.Refused):
            J.exact_pairs(bad, "k", "g", ["a", "b"], ["v"])


def test_refusals(spark):
    a = spark.createDataFrame([(1, "x")], "id int, y string")
    with pytest.raises(J.Refused):
        J.matched(a, a, "id", 2)
    with pytest.raises(ValueError):
        S.class_policy(a, "y", 2, drop=False)
    with pytest.raises(Exception, match="positive"):
        J.require(a, F.col("id") > 1, "must be positive").collect()
    with pytest.raises(ValueError):
        T.check_stores({"model_id": "a"}, {"model_id": "b"})
    with pytest.raises(ValueError):
        T.guarded_write(a.limit(0), a, "/nowhere", ["id"])


def test_first_and_last_win(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, None)], "k string, o int, v string")
    assert {r["k"]: r["v"] for r in J.wins(rows, ["k"], "o", True).collect()} == {"a": "y", "b": None}
    assert {r["k"]: r["v"] for r in J.wins(rows, ["k"], "o", False).collect()} == {"a": "x", "b": None}


def test_groups_missing_one_expected_row_go(spark):
    rows = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1)], "g string, k int")
    assert [r["g"] for r in J.drop_groups_with_misses(rows, rows.filter("not (g = 'p' and k = 2)"), "g", ["k"]).collect()] == ["q"]


def test_split_does_not_depend_on_other_groups(spark):
    a = {r["id"]: r["s"] for r in spark.range(500).select("id", S.hash_split(F.col("id"), 3).alias("s")).collect()}
    b = {r["id"]: r["s"] for r in spark.range(100, 200).select("id", S.hash_split(F.col("id"), 3).alias("s")).collect()}
    assert all(a[i] == s for i, s in b.items())
    assert 60 < sum(s == "test" for s in a.values()) < 140
    fold = one(spark, f=S.hundred_fold(F.lit("abc"), 0))["f"]
    import hashlib

    assert fold == int(hashlib.sha1(b"abc:0").hexdigest(), 16) % 100


def test_sampled_positions(spark):
    got = one(spark, a=S.sampled_positions(F.lit(6), F.array(F.lit(1), F.lit(2)), 3, "s"), b=S.sampled_positions(F.lit(3), F.array(F.lit(1), F.lit(2)), 3, "s"))
    assert len(set(got["a"])) == 3 and not {1, 2} & set(got["a"]) and got["b"] == []


def test_drop_reasons_register_only_what_passed(spark):
    rows = spark.createDataFrame([(1, "k", False), (2, "k", True), (3, "k", True)], "o int, key string, fine boolean")
    got = [r["drop_reason"] for r in O.drop_reasons(rows, [("bad", ~F.col("fine"))], ["key"], "o").orderBy("o").collect()]
    assert got == ["bad", None, "duplicate"]


def test_controls_keep_the_margins(spark):
    rows = spark.createDataFrame([(i, i % 2, f"n{i % 5}", i % 3) for i in range(60)], "id int, y int, name string, g int")
    mixed = O.resampled_labels(rows, "y", "id", ["g"], 1)
    assert mixed.groupBy("g").agg(F.sum("y").alias("a"), F.sum("control_label").alias("b")).filter("a <> b").count() == 0
    by_name = O.label_by_name(rows, "name", "y", 1)
    assert by_name.groupBy("name").agg(F.countDistinct("control_label").alias("n")).filter("n <> 1").count() == 0


def test_macro_f1_label_sets(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "y_true string, y_pred string").withColumn("g", F.lit(1))
    assert M.macro_f1(rows, ["g"]).first()["macro_f1"] == pytest.approx(2 / 3)
    assert M.macro_f1(rows, ["g"], ["a", "b", "c"]).first()["macro_f1"] == pytest.approx(4 / 9)


def test_bootstrap_resamples_whole_clusters(spark):
    """Rows repeated within their clusters change nothing; every replicate draws as many clusters as there are."""
    rng = random.Random(4)
    rows = [(f"c{i % 20}", rng.random() < 0.7, rng.random() < 0.6) for i in range(400)]
    df = spark.createDataFrame([(c, int(a), int(b)) for c, a, b in rows], "cluster string, y_true int, y_pred int")
    cells = M.confusion_by(df, ["cluster"])
    drawn = B.draws(cells, "cluster", 50)
    assert {r["n"] for r in drawn.groupBy("replicate").agg(F.sum("times").alias("n")).collect()} == {20}
    f = M.macro_f1_binary(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))
    twice = M.confusion_by(df.union(df), ["cluster"])
    a, b = (sorted(r["f"] for r in B.replicates(c, drawn, "cluster", ["tn", "fp", "fn", "tp"], []).select(f.alias("f")).collect()) for c in (cells, twice))
    assert a == pytest.approx(b)


def test_bca_bounds():
    rng = random.Random(1)
    x = [rng.gauss(1, 1) for _ in range(60)]
    boot = [mean(rng.choices(x, k=60)) for _ in range(1500)]
    jack = [(sum(x) - v) / 59 for v in x]
    lo, hi = B.bca_bounds(mean(x), boot, B.acceleration(jack))
    assert lo < mean(x) < hi and 0.3 < hi - lo < 0.8
    assert B.bca_bounds(1.0, [1.0], 0.0)[0] != B.bca_bounds(1.0, [1.0], 0.0)[0]
    assert B.bca_bounds(9.0, [1.0, 2.0, 3.0], 0.0) == (3.0, 3.0)  # all below: both places are clipped to the end


def test_bca_interval_against_a_plain_version(spark):
    """Cells of sums, draws and leave-one-out values in plain Python, to the same bounds."""
    rng = random.Random(2)
    cells = [(g, f"c{i:02d}", rng.randint(1, 9), rng.randint(1, 9)) for g in ("x", "y") for i in range(12)] + [("z", "c00", 1, 2)]
    df = spark.createDataFrame(cells, "g string, cluster string, a long, b long")
    drawn = B.draws(df, "cluster", 300)
    stat = F.try_divide(F.col("a").cast("double"), F.col("b").cast("double")).alias("stat")
    whole = df.groupBy("g").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).select("g", stat)
    out = {r["g"]: r for r in B.bca_interval(B.replicates(df, drawn, "cluster", ["a", "b"], ["g"]).select("g", stat), B.jackknife(df, "cluster", ["a", "b"], ["g"]).select("g", stat), whole, ["g"]).collect()}
    times = {}
    for r in drawn.collect():
        times.setdefault(r["replicate"], {})[r["cluster"]] = r["times"]
    for g in ("x", "y"):
        own = [(c, a, b) for k, c, a, b in cells if k == g]
        ratio = lambda rows: sum(a for _, a, _ in rows) / sum(b for _, _, b in rows)
        boot = [ratio([(c, a * t[c], b * t[c]) for c, a, b in own if c in t]) for t in times.values()]
        want = B.bca_bounds(ratio(own), boot, B.acceleration([ratio([r for r in own if r[0] != c]) for c, _, _ in own]))
        assert (out[g]["lo"], out[g]["hi"]) == pytest.approx(want) and out[g]["observed"] == pytest.approx(ratio(own))
    assert out["z"]["lo"] is None


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(4.0), F.lit(3.0))
    got = one(spark, c=V.cosine(a, b), z=V.cosine(a, F.array(F.lit(0.0), F.lit(0.0))), t=V.top_dimensions(F.array(F.lit(1.0), F.lit(-5.0), F.lit(5.0)), 2), s=V.specificity(F.lit(1.0), F.lit(0.0), F.lit(1.0)), e=V.signed_effect(F.lit(5.0), F.lit(1.0), F.lit(2.0), F.lit("denoise")))
    assert (got["c"], got["z"], got["t"], got["s"], got["e"]) == (pytest.approx(0.96), None, [1, 2], None, 1.0)
    r = V.matched_random("k", [1.0, 2.0, 2.0])
    assert r == V.matched_random("k", [1.0, 2.0, 2.0]) and abs(sum(x * y for x, y in zip(r, [1, 2, 2], strict=True))) < 1e-9 and sum(x * x for x in r) == pytest.approx(9)


def test_auc_counts_ties_half(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (0, 1.0), (0, 0.0)], "y int, s double").withColumn("g", F.lit(1))
    assert M.auc(rows, ["g"], "s", "y").first()["auc"] == pytest.approx(3.5 / 4)


def test_running_sums_and_ranks(spark):
    """Groups over several range partitions, null groups, and decimals, against plain Python."""
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None, "c"]), i, rng.randint(0, 5), round(rng.random(), 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, v int, x double").repartition(7)
    got = {r["i"]: (r["n"], r["m"]) for r in S.running(S.running(df, ["g"], [F.col("i")], F.lit(1), "n"), ["g"], [F.col("i")], F.col("x").cast("decimal(20,3)"), "m").collect()}
    for g, i, _, _ in rows:
        before = [r for r in rows if r[0] == g and r[1] < i]
        assert got[i][0] == len(before) and abs(float(got[i][1]) - sum(r[3] for r in before)) < 1e-9
    ranks = {r["i"]: r["r"] for r in M.average_ranks(df, ["g"], "v", "r").collect()}
    for g, i, v, _ in rows:
        own = [r[2] for r in rows if r[0] == g]
        assert ranks[i] == sum(x < v for x in own) + (own.count(v) + 1) / 2
    assert S.running(df.limit(0), ["g"], [F.col("i")], F.lit(1), "n").count() == 0


# --- plans, stores, sources ------------------------------------------------------------------------


def test_prompts_are_balanced_and_frozen(spark):
    p = P.prompt_pairs(spark)
    rows = p.collect()
    assert len(rows) == 288 and len({r["pair_id"] for r in rows}) == 288 and len({r["cluster_id"] for r in rows}) == 48
    for r in rows:
        assert r["clean_prompt"][r["class_decl_s"] : r["class_decl_e"]] == r["name"] == r["corrupt_prompt"][r["def_query_s"] : r["def_query_e"]]
    assert {r["n"] for r in P.balance(p, ["name"]).collect()} == {12}
    assert P.canonical_payload(p, ["pair_id"]).first() == P.canonical_payload(p.repartition(7), ["pair_id"]).first()
    assert P.check_frozen(p, p, "pair_id") == []
    changed = p.withColumn("name", F.when(F.col("pair_id") == rows[0]["pair_id"], "Other").otherwise(F.col("name")))
    assert P.check_frozen(changed, p, "pair_id") == [rows[0]["pair_id"]]


def test_schedules_are_disjoint(spark):
    n = lambda name, **k: Q.schedule(spark, name, 6, 3, **k).count()
    assert (n("behavior"), n("primary"), n("core"), n("fp32", frozen=[3, 1, 2])) == (0, 10, 12, 18)
    done = Q.schedule(spark, "primary", 6, 3).union(Q.schedule(spark, "core", 6, 3))
    assert Q.schedule(spark, "expanded", 6, 3, expanded=True).intersect(done).count() == 0
    assert Q.expected_keys(P.prompt_pairs(spark).limit(3), Q.schedule(spark, "primary", 6, 3)).count() == 3 * 14
    with pytest.raises(ValueError):
        n("fp32", frozen=[1, 1, 2])


def smoke_rows(spark, effect=1.0):
    cells = [(-1, "baseline_class", "none", "unpatched", 2.0, 0.0), (-1, "baseline_function", "none", "unpatched", -1.0, 0.0)]
    for d in ("denoise", "noise"):
        cells += [(3, "query_name", d, "target", 0.0, effect), (3, "placebo", d, "target", 0.0, 0.1), (3, "query_name", d, "random", 0.0, 0.1), (3, "query_name", d, "same_source", 0.0, 0.0), (0, "query_name", d, "target", 0.0, 0.0)]
    return spark.createDataFrame([(f"p{i}", *c, 0.001) for i in range(8) for c in cells], "pair_id string, layer int, span string, direction string, control string, source_D double, signed_effect double, baseline_drift double")


def test_smoke_gate(spark):
    rows = smoke_rows(spark)
    assert G.smoke_gate(rows, 3)["pass"] and len(G.smoke_gate(rows, 3)["checks"]) == 12
    weak = G.smoke_gate(smoke_rows(spark, 0.05), 3)
    assert not weak["pass"] and not weak["checks"]["target_gt_placebo"]
    assert "exact_row_cube" in G.smoke_gate(rows.filter("not (pair_id = 'p1' and control = 'random')"), 3)["checks"]
    assert "exact_pair_ids" in G.smoke_gate(rows.filter("pair_id <> 'p1'"), 3)["checks"]


def test_gates_and_cascade(spark):
    good = spark.createDataFrame([(c, 1.0 + 0.1 * i, -1.0, 0.5, 0.5, 0.0, 0.0, 0.1, 0.1, 2.0, 1.0, 0.2) for c in range(12) for i in range(3)], "cluster_id int, d_class double, d_function double, denoise double, noise double, denoise_placebo double, noise_placebo double, denoise_random double, noise_random double, gap double, class_margin double, function_margin double")
    assert G.behavior_gate(good)["pass"] and G.causal_gate(good, 0.01)["pass"] and G.probe_gate(good, 0.8, 0.8)["pass"]
    assert not G.causal_gate(good, 0.2)["pass"] and not G.probe_gate(good, 0.8, 0.6)["pass"]
    ran = []
    out = G.cascade([("a", lambda: G.verdict({"x": False}), []), ("b", lambda: ran.append(1) or G.verdict({}), ["a"])])
    assert out["b"]["skipped"] == "needs a" and not ran


def test_chunks_merge_and_refuse(spark):
    old = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    assert [tuple(r) for r in I.merge_chunk(old, spark.createDataFrame([(2, 2.0), (3, 3.0)], "k int, v double"), ["k"]).collect()] == [(3, 3.0)]
    for bad in ([(2, 9.0)], [(5, 1.0), (5, 2.0)]):
        with pytest.raises(J.Refused):
            I.merge_chunk(old, spark.createDataFrame(bad, "k int, v double"), ["k"])
    I.same_manifest(old, old)
    with pytest.raises(J.Refused):
        I.same_manifest(old, old.limit(1))


def test_leases(spark):
    beats = spark.createDataFrame([("a", 1000.0, False), ("b", 100.0, False), ("c", 900.0, True)], "holder string, at double, rel boolean")
    states = I.lease_states(beats, "holder", "at", F.lit(1100.0), 600.0, "rel")
    assert {r["holder"]: r["state"] for r in states.collect()} == {"a": "held", "b": "stale", "c": "released"}
    assert I.may_acquire(states, "holder", "a") and not I.may_acquire(states, "holder", "b")


def test_sources(spark, tmp_path):
    d = tmp_path / "Java"
    d.mkdir()
    (d / "train.jsonl").write_text('{"idx": 1, "code_tokens": ["a", "NEW_LINE", "b"]}\n\n{"idx": 2, "code_tokens": []}\n{"idx": 3, "code_tokens": ["c"]}\n')
    assert [(r["idx"], r["code"]) for r in T.load_programs(spark, str(tmp_path), "Java", "train").orderBy("idx").collect()] == [(1, "a\nb"), (3, "c")]
    assert T.load_programs(spark, str(tmp_path), "Java", "train", 1).count() == 1
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    assert (T.read_json_or_lines(spark, str(tmp_path / "a.json"), "x int").count(), T.read_json_or_lines(spark, str(tmp_path / "b.json"), "x int").count()) == (2, 3)
    acts = spark.createDataFrame([("o", "p", "l", "v", "f", i, [1.0]) for i in range(3)], T.ACTIVATION)
    T.write_activations(acts, str(tmp_path / "acts"))
    assert T.read_activations(spark, str(tmp_path / "acts"), [1]).count() == 1
    ordered = T.with_source_row(T.with_file_order(spark.read.schema("x int").json([str(tmp_path / "b.json"), str(tmp_path / "c.json")]) if (tmp_path / "c.json").write_text('{"x": 9}\n{"x": 8}\n') else None))
    assert [r["x"] for r in ordered.orderBy("source_row").collect()] == [1, 2, 3, 9, 8]
    assert len(T.file_checksums(spark, str(tmp_path / "*.json")).first()["sha256"]) == 64


def test_probe_finds_a_planted_direction(spark):
    from lexiprobe.operators.models import transfer

    rng = random.Random(3)
    rows = [(i, i % 2, [rng.gauss(2.0 if j == 0 and i % 2 else 0.0, 1.0) for j in range(6)]) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, y int, vec array<double>")
    got = {r["model"]: r["macro_f1"] for r in transfer(df, df, "vec", "y", "id", 10).collect()}
    assert got["transfer"] > 0.75 and got["transfer"] - got["majority"] > 0.25
