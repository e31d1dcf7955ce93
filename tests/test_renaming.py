"""Scope-correct renaming: what it leaves alone, that programs still run alike, and occurrences carried along."""

import ast
import contextlib
import io

import pytest
from pyspark.sql import functions as F

from lexiprobe.functions import rename
from lexiprobe.operators import occurrences as O
from lexiprobe.operators import renaming

# (program, names that numbering must leave, functions left by reason)
RUNS = [
    ("def f(a):\n    import os.path\n    from os import sep as s\n    b = os.path.join('x', a)\n    return b, s\nprint(f('q'))\n", {"os", "s"}, {}),
    ("def f(a, b=2):\n    c = a + b\n    return c\nprint(f(1), f(1, b=5))\n", {"a", "b", "c"}, {"kwarg_coupling": 1}),
    ("def f(a, b=2):\n    return a + b\nprint(f(**{'a': 1}))\n", {"a", "b"}, {"kwarg_coupling": 1}),
    ("import asyncio\nasync def f(n):\n    total = 0\n    for i in range(n):\n        total += i\n        await asyncio.sleep(0)\n    return total\nprint(asyncio.run(f(4)))\n", {"asyncio"}, {}),
    ("n = 7\ndef f(x=n, *n, **kw):\n    x = len(n) + x + len(kw)\n    return x\nprint(f(), f(1, 2))\n", set(), {}),
    ("def f(x):\n    try:\n        y = 1 // x\n    except ZeroDivisionError as e:\n        y = str(e)\n    return y\nprint(f(0))\n", {"x", "y", "e"}, {"unsupported_binder": 1}),
    ("def f(x):\n    match x:\n        case [a, *rest]:\n            return a, rest\n        case {'k': v, **more}:\n            return v, more\n        case _:\n            return x\nprint(f([1, 2]), f({'k': 1, 'l': 2}))\n", {"a", "rest", "more"}, {"unsupported_binder": 1}),
    ("def f(x):\n    y = [i * x for i in range(3)]\n    return y\ndef g(z):\n    w = z\n    return w\nprint(f(2), g(1))\n", {"x", "y", "i"}, {"nested_scope": 1}),
    ("t = 0\ndef f(x):\n    global t\n    t = x\ndef g(u):\n    u += t\n    return u\nf(3)\nprint(g(1))\n", {"x", "t"}, {"global_nonlocal": 1}),
    ("def f(x):\n    y = 2\n    return sorted(locals())\nprint(f(1))\n", {"x", "y"}, {"reads_names": 1}),
    ("def f(é, v1):\n    s = f'{é!r:>{v1}} é'\n    del v1\n    (w := é)\n    é += 1; return s, w, é  # é v1\nprint(f(1, 9))\n", set(), {}),
    ("class K:\n    def m(self, a):\n        b = a\n        return b\ndef f(self, k):\n    k.a = self\n    a = k.a\n    return a\nprint(f(1, K()), K().m(2))\n", {"self", "b"}, {}),
    ("def deco(f):\n    return f\n@deco\ndef g(deco, lst: list):\n    n: int = deco\n    lst = n\n    return lst\nprint(g(3, []))\n", set(), {}),
]


def output(code):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        exec(compile(code, "<program>", "exec"), {"__name__": "p"})  # noqa: S102
    return said.getvalue()


@pytest.mark.parametrize("condition", ["numbered", "letters", "nouns"])
@pytest.mark.parametrize(("code", "stay", "left"), RUNS)
def test_renamed_programs_run_alike(code, stay, left, condition):
    new, edits, why, reasons = rename.scope_edits(code, condition, seed="7")
    assert {k: v for k, v in reasons.items() if v} == left
    if why == "no_renameable_function":
        assert left and new is None
        return
    if why is None:
        assert output(new) == output(code) and new != code
        assert stay <= rename.names_of(new)
        assert all(code[s:e] != name and code[s:e].isidentifier() for s, e, name in edits)
        assert (new, edits) == rename.scope_edits(code, condition, seed="7")[:2]


def test_new_names_by_condition():
    code = "def f(alpha, beta, v1):\n    gamma = alpha\n    return gamma + beta + v1\n"
    assert rename.scope_edits(code, "numbered")[0] == "def f(v12, v2, v3):\n    v4 = v12\n    return v4 + v2 + v3\n".replace("v12", "v1" + "2")
    assert rename.scope_edits(code, "letters")[0] == "def f(a, b, c):\n    d = a\n    return d + b + c\n"
    targets = {"f": {"alpha", "beta", "nothing"}}
    assert rename.scope_edits(code, "same", targets)[0] is None  # two arguments of one name do not parse
    assert rename.scope_edits(code, "same", {"f": {"alpha", "gamma"}})[0] == "def f(x, beta, v1):\n    x = x\n    return x + beta + v1\n"
    new = rename.scope_edits(code, "index_names", targets)[0]
    assert "gamma" in new and not {"alpha", "beta"} & rename.names_of(new) and len(rename.names_of(new) & set(rename.INDEX_NAMES)) == 2
    many = "def f():\n" + "".join(f"    q{i} = {i}\n" for i in range(90)) + "    return q1\n"
    for condition in ("letters", "nouns"):
        names = [n for _, _, n in rename.scope_edits(many, condition)[1]]
        assert len(set(names)) == 90 and ast.parse(rename.scope_edits(many, condition)[0])


def test_why_programs_are_dropped():
    why = lambda code, condition="numbered": rename.scope_edits(code, condition)[2]
    assert why("def f(:") == "parse" and why("x = 1") == "no_renameable_function" and why("def f():\n    return 1\n") == "no_edits"
    assert why("def f(a):\n    return a\nclass K:\n    def f(self):\n        pass\n") == "duplicate_functions"
    assert why("def f(a):\n    return a\n", "same") == "no_edits" and why("def f(v1):\n    return 1\n") is None
    with pytest.raises(ValueError, match="condition"):
        rename.scope_edits("x", "C1")


PROGRAMS = [
    (1, "Python", "def f(rows, up=False):\n    é = True\n    for i in rows:\n        if é and not up:\n            é = rows[i] > 1\n    return é\n"),
    (2, "Python", "def f(a):\n    import os\n    ok = True\n    return ok\n"),
    (3, "Python", "def f(:\n"), (4, "Python", "def f(a):\n    ok = True\n    return ok\nf(a=1)\n"), (5, "Java", "class A { boolean f() { boolean ok = true; return ok; } }"),
    (6, "Python", "def f(a):\n    return a + 1\n"),
    (7, "Python", "def f(ok, out):\n    ok = True\n    out = ok and out\n    return out\n"),
]


def test_renaming_flow(spark):
    programs = spark.createDataFrame(PROGRAMS, "problem_id int, language string, code string")
    found = O.program_occurrences(programs)
    renamed, carried, counts = renaming.renaming_flow(programs, found, "numbered", O.program_occurrences)
    assert {r.outcome: (r.programs, r.functions_left) for r in counts.collect()} == {"kept": (3, 0), "no_renameable_function": (1, 1), "language": (1, 0)}
    code = {r.problem_id: r.new_code for r in renamed.collect()}
    assert code[2] == "def f(v1):\n    import os\n    v2 = True\n    return v2\n" and code[4] is None
    rows = carried.collect()
    assert {r.occurrence_id for r in rows} == {r.occurrence_id for r in found.filter("problem_id IN (1, 2, 7)").collect()}
    assert all(code[r.problem_id][r.s : r.e] == r.variable and r.variable != r.original_variable for r in rows)


def test_a_program_whose_occurrences_do_not_hold_is_dropped(spark):
    programs = spark.createDataFrame(PROGRAMS[:2], "problem_id int, language string, code string")
    found = O.program_occurrences(programs)
    wrong = found.withColumn("occurrence_type", F.when((F.col("problem_id") == 1) & (F.col("line") == 2), "loop_use").otherwise(F.col("occurrence_type")))
    renamed, carried, counts = renaming.renaming_flow(programs, wrong, "letters", O.program_occurrences)
    assert {r.outcome: r.programs for r in counts.collect()} == {"identity": 1, "kept": 1}
    assert {r.problem_id for r in carried.collect()} == {2} and renamed.filter("problem_id = 1").first().new_code is None


def test_names_made_one_keep_their_own_ids(spark):
    programs = spark.createDataFrame(PROGRAMS[6:], "problem_id int, language string, code string")
    found = O.program_occurrences(programs).filter("variable = 'ok'")
    _, carried, counts = renaming.renaming_flow(programs, found, "same", O.program_occurrences)
    assert counts.first().outcome == "kept" and {r.variable for r in carried.collect()} == {"x"}
