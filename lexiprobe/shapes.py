"""Small programs in seven languages with nested functions, methods, lambdas, comments and strings, and the flags that each holds.

A document's text stands in front of a program as comment lines, so that a query on shapes reads whole texts of
any kind and finds the same flags behind them, shifted by the text's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiprobe.programs import values_sql

#: (occurrence, pattern) of a place: literal assigned, operand, target of operands, if, target of not, operand of not, ternary, loop, index or member, return.
A, B, L, O, N, I, T, W, Q, R = (
    ("assignment", "assign_bool_literal"), ("conditional_use", "assign_boolop_rhs"), ("assignment", "assign_boolop_lhs"), ("conditional_use", "if_test"), ("assignment", "assign_not_name"),
    ("conditional_use", "assign_not_name_inner"), ("conditional_use", "if_exp_test"), ("loop_use", "while_test"), ("indexing_use", None), ("return_use", "return_bool"),
)

#: (language, code, [(name, line, what)])
SHAPES = [
    # Java
    ("Java", "class A { boolean f(int n) {\n boolean up = n > 1;\n if (up) { return up; }\n return !up;\n} }", [("up", 3, O), ("up", 3, R), ("up", 4, R)]),
    ("Java", "class A { void f() {\n boolean a = true, b = false;\n boolean c = a && !b;\n} }", [("a", 2, A), ("b", 2, A), ("c", 3, L), ("a", 3, B), ("b", 3, B)]),
    ("Java", "class A { void f() {\n up &= true;\n up = (a && b);\n} }", [("up", 2, A)]),
    ("Java", "class A { boolean up = true; A() { up = false; } }", []),
    ("Java", "class A { void f() {\n new Thread(new Runnable() { public void run() { boolean in = true; } });\n boolean out = false;\n} }", [("out", 3, A)]),
    ("Java", "class A { void f() {\n Runnable r = () -> {\n  boolean in = true;\n };\n} }", [("in", 3, A)]),
    ("Java", "@Test(x = 1)\npublic static <T> Map<String, List<T>> f(final int... n) throws E {\n while (go == true) { go = !stop; }\n return null;\n}", [("go", 3, W), ("go", 3, N), ("stop", 3, I)]),
    ("Java", "class A { int f() {\n return ok ? 1 : 2;\n} }", [("ok", 2, T), ("ok", 2, R)]),
    ("Java", "class A { void f() {\n if (a[up] && up || this.up) {}\n} }", [("up", 2, (Q[0], "if_test")), ("up", 2, O), ("up", 2, (Q[0], "if_test"))]),
    ("Java", "class A { void f() {\n if (a) {} else if (b) {} else {\n  if (c != false) {}\n }\n} }", [("a", 2, O), ("b", 2, O), ("c", 3, O)]),
    ("Java", 'class A { void f() { // up = true\n String s = "up = true; // x";\n /* if (up) */ char c = \'"\';\n up = true;\n} }', [("up", 4, A)]),
    ("Java", "class A { class B { void g() {\n for (int i = 0, j = 1; ok; i++) { do { ok = false; } while (ok); }\n} } }", [("ok", 2, A)]),
    ("Java", "enum E { X, Y; void f() {\n switch (n) { case 1: ok = true; break; default: ok = false; }\n} }", [("ok", 2, A), ("ok", 2, A)]),
    ("Java", "class A { void f() {\n try (X x = open()) { ok = true; } catch (E | G e) { ok = false; } finally { done = true; }\n} }", [("ok", 2, A), ("ok", 2, A), ("done", 2, A)]),
    ("Java", "class A { void f() {\n Set<String> s = new HashSet<>();\n boolean é = (boolean) x || (y);\n} }", [("é", 3, L), ("y", 3, B)]),
    # C++ and C
    ("C++", "bool f() {\n auto g = [&](int x) -> bool { bool z = true; return z; };\n bool ok = false;\n return ok;\n}", [("ok", 3, A), ("ok", 4, R)]),
    ("C++", "int C::g(bool q) {\n if (q) return 1;\n return 0;\n}", [("q", 2, O)]),
    ("C++", "template <typename T>\nclass S : public B<T> {\n public:\n  S(int a) : x(a), y{2} { ok = true; }\n  ~S() { ok = false; }\n  bool m() const noexcept override { return ok; }\n  bool ok = false;\n};", [("ok", 4, A), ("ok", 6, R)]),
    ("C++", "#define X if (a)\nint* const f(const std::vector<int>& v, char *s) {\n bool &r = v, t = !r;\n return t ? 1 : 0;\n}", [("t", 3, N), ("r", 3, I), ("t", 4, T), ("t", 4, R)]),
    ("C++", "void f() {\n ok |= true;\n ok = a || b;\n v[ok] = p->ok && ok;\n}", [("ok", 3, L), ("a", 3, B), ("b", 3, B), ("ok", 4, B)]),
    ("C++", "void f() {\n if (int x = g()) {}\n if (x; y) {}\n while (static_cast<bool>(z)) {}\n if (ok[i] || ok) {}\n}", [("ok", 5, (Q[0], "if_test")), ("ok", 5, O)]),
    ("C++", "namespace n { extern \"C\" { int f() {\n unsigned long long k = 0; vector<pair<int, int>> w(3);\n for (auto& [a, b] : m) done = true;\n return done == false;\n} } }", [("done", 3, A), ("done", 4, R)]),
    ("C++", "bool operator==(const A& a, const A& b) { return a && b; }\nbool g(A a) { return a; }", [("a", 2, R)]),
    ("C", "static int f(struct node *p, int n) {\n int a[3] = {1, 2, 3}, up = 0;\n while (up) { p->up = true; }\n return (int) n;\n}", [("up", 3, W)]),
    # JavaScript
    ("Javascript", "class K {\n m(q) { if (q) { return 1; } }\n static async *s(a) { this.on = true; on = a; }\n get v() { return on; }\n}", [("q", 2, O), ("on", 4, R)]),
    ("Javascript", "function f() {\n const g = (x) => { let z = true; return z; };\n const h = y => !y;\n let on = false;\n}", [("on", 4, A)]),
    ("Javascript", "function f() {\n xs.map(function (x) { on = true; });\n}", [("on", 2, A)]),
    ("Javascript", "const f = function () { on = true; };\nexport function g() { on = true; }\nfunction h() { function i() { on = true; } off = true; }", [("off", 3, A)]),
    ("Javascript", "function f() {\n for (let i = 0; on; i++) {}\n for (const x of on) {}\n for (;;) { break; }\n while ((on)) off = (on && true);\n}", [("on", 2, W), ("on", 5, W), ("off", 5, L), ("on", 5, B)]),
    ("Javascript", "function f({ a, b = 1 }, [c]) {\n if (a === true || !(b)) { o = { on, k: on, m() { on = true; } }; }\n return `${a}` && c\n}", [("a", 2, O), ("b", 2, O), ("c", 3, R)]),
    ("Javascript", "async function f() {\n on &&= true\n var a = on ? 1 : 2, b = !(on)\n a.on = !on\n}", [("b", 3, N), ("on", 3, I), ("on", 4, I)]),
    ("Javascript", "function f() {\n const r = /if (on) \"/;\n let 'x';\n if (on) on = false\n}", [("on", 4, O), ("on", 4, A)]),
    # PHP
    ("PHP", "<?php\nclass A { private $on = true;\n public static function f(?array $xs, int $n = 3): bool {\n  if (!$on && $v->done) { $on = FALSE; } elseif ($z) {} else if ($y) {}\n  return $on;\n } }", [("on", 4, O), ("on", 4, A), ("y", 4, O), ("on", 5, R)]),
    ("PHP", "<?php function f($x) {\n $g = function ($y) use ($x) { $in = true; return $in; };\n $h = fn($z) => $z;\n $out = ($x && $y);\n}", [("out", 4, L), ("x", 4, B), ("y", 4, B)]),
    ("PHP", "function f() { # $a = true\n foreach ($xs as $k => $v) { while ($go): $go = false; endwhile; }\n if ($a[$on] || $on): $b = !$on; endif;\n}", [("go", 2, W), ("go", 2, A), ("on", 3, (Q[0], "if_test")), ("on", 3, O), ("b", 3, N), ("on", 3, I)]),
    # Go
    ("Go", "package m\nimport (\n \"fmt\"\n)\nfunc (t *T) f(n int, ok bool) (bool, error) {\n done := false\n for i := 0; done; i++ {\n  if v, k := m[i]; k {\n   done = true\n  } else if ok {\n   fmt.Println(T{a: 1}, done)\n  }\n }\n return done, nil\n}", [("done", 6, A), ("done", 7, W), ("done", 9, A), ("ok", 10, O)]),
    ("Go", "func f() bool {\n g := func(x int) bool { in := true; return in }\n a, b := true, false\n var c bool = true\n c = a && !b\n for range c {\n }\n return c\n}", [("c", 5, L), ("a", 5, B), ("b", 5, B), ("c", 8, R)]),
    ("Go", "type S struct {\n on bool\n}\nfunc f(s S, xs []bool) bool {\n switch s.on {\n case true:\n  on := !off\n  _ = on\n }\n return xs[on] || on\n}", [("on", 7, N), ("off", 7, I), ("on", 10, (Q[0], "return_bool")), ("on", 10, R)]),
    # Ruby
    ("Ruby", "def f(a, b = true)\n  done = false\n  while !done\n    if a && a.b > 1 then puts a\n    elsif done\n      a = 1\n    end\n    done = b || a == true\n  end\n  return done\nend", [("done", 2, A), ("done", 3, W), ("a", 4, O), ("a", 4, (Q[0], "if_test")), ("done", 8, L), ("b", 8, B), ("a", 8, B), ("done", 10, R)]),
    ("Ruby", "def f(xs)\n  xs.each do |x|\n    w = true\n  end\n  xs.map { |y| q = true }\n  l = ->(z) { r = true }\n  return w unless q\nend", [("w", 3, A), ("w", 7, R)]),
    ("Ruby", "class K\n  def m\n    on = true\n  end\nend\ndef self.s\n  on = true\nend\ndef t(on)\n  begin\n    off = !on\n  rescue E => e\n    off = true\n  end\n  return !on\nend", [("off", 11, N), ("on", 11, I), ("off", 13, A)]),
    ("Ruby", "def f # on = true\n  case n\n  when 1 then on = true\n  else on = false\n  end\n  s = \"#{on}\" # x\n  on ||= true\n  return on, s\nend", [("on", 3, A), ("on", 4, A), ("on", 8, R)]),
]


def shaped_programs(spark: SparkSession, d: str) -> DataFrame:
    """problem_id, language, code and shape of every document: its text as comments, then the program."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select(F.col("doc_id").alias("problem_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("shape", F.pmod("problem_id", F.lit(len(SHAPES))).cast("int"))
    pick = lambda i: F.element_at(F.array(*(F.lit(s[i]) for s in SHAPES)), F.col("shape") + 1)
    mark = F.when(pick(0) == "Ruby", "# ").otherwise("// ")
    code = F.concat(mark, F.replace(F.col("text"), F.lit("\n"), F.concat(F.lit("\n"), mark)), F.lit("\n"), pick(1))
    return rows.select("problem_id", pick(0).alias("language"), code.alias("code"), "shape")


_ANSWERS = [(i, name, line, kind, pattern) for i, (_, _, answers) in enumerate(SHAPES) for name, line, (kind, pattern) in answers]
#: SQL of the flags of every document's program.
SHAPES_SQL = f"""WITH {values_sql("sh", "shape, variable, line, kind, pattern", _ANSWERS)},
tx AS (SELECT doc_id AS problem_id, (doc_id % {len(SHAPES)})::INT AS shape, len(string_split(coalesce(text, ''), chr(10))) AS before FROM documents)
SELECT tx.problem_id, sh.variable, (sh.line + tx.before)::INT AS line, sh.kind AS occurrence_type, sh.pattern AS detection_pattern, true AS held FROM tx JOIN sh USING (shape)"""
