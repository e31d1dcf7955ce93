"""A table of small programs, one for each document, in the languages that the extractors read.

The programs are templates whose three names come from the document's words, so that queries on
code read a whole table, and what must come out of each template is known beforehand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (language, template); {a}, {b} and {c} are names of six letters.
TEMPLATES = (
    ("Python", "def {a}(rows, {b}=False):\n    {c} = True\n    total = 0\n    for i in rows:\n        if {c} and not {b}:\n            total += rows[i]\n            {c} = False\n    return {c}\n"),
    ("Python", "class {a}:\n    pass\n\ndef {b}(xs):\n    {c} = []\n    for item in xs:\n        {c}.append(item)\n    return {c}\n"),
    ("Python", "def {a}(:\n    pass\n"),
    ("Python", "{a} = {b} = True\n{c} = {a}\n"),
    ("Java", "class {a} {\n  boolean {b}(int n) {\n    boolean {c} = true;\n    int sum = 0;\n    for (int i = 0; i < n; i++) {\n      if ({c} && i > 3) { sum += i; }\n      while (!{c}) { {c} = n == 1; }\n    }\n    return {c};\n  }\n}\n"),
    ("Javascript", 'function {a}(list) {\n  let {b} = false;\n  const {c} = !{b};\n  for (let i = 0; {b}; i++) {\n    list.push(i); // {b} = true\n    {b} = list[i] || {c};\n  }\n  return "{c}" + ({b} ? 1 : 0);\n}\n'),
    ("PHP", "<?php\nfunction {a}($rows) {\n  ${b} = true;\n  foreach ($rows as $k => $v) {\n    if (${b}) { $sum += $rows[$k]; }\n  }\n  return ${b};\n}\n"),
    ("C++", "struct {a} { int v; };\nint {b}(int n) {\n  bool {c} = false;\n  for (int j = 0; j < n; ++j) {\n    {c} = j == 3 || n == 4;\n  }\n  int k = {c} ? 1 : 2;\n  return {c};\n}\n"),
    ("Go", "func {a}(n int) bool {\n  {b} := true\n  for {b} {\n    if n > 3 && {b} {\n      {b} = false\n    }\n  }\n  return {b}\n}\n"),
    ("Ruby", "def {a}(n)\n  {b} = true\n  while {b}\n    {b} = false\n  end\n  return {b}\nend\n"),
    ("C#", "class {a} { void M(int[] xs) { foreach (int x in xs) { {b} += xs[{c}]; done = true; } } }\n"),
)

#: What each template holds, by its place: (template, role, names).
ROLE_ANSWERS = (
    (0, "index_key", "i"), (0, "accumulator", "total"), (0, "iterator", "i"), (0, "boolean", "{c}"),
    (1, "accumulator", "{c}"), (1, "iterator", "item"), (1, "class_struct", "{a}"), (3, "boolean", "{a},{b}"),
    (4, "accumulator", "i,sum"), (4, "iterator", "i"), (4, "boolean", "{c}"), (4, "class_struct", "{a}"),
    (5, "index_key", "i"), (5, "accumulator", "i,list"), (5, "iterator", "i"), (5, "boolean", "{b}"),
    (6, "index_key", "k"), (6, "accumulator", "sum"), (6, "iterator", "k,v"), (6, "boolean", "{b}"),
    (7, "iterator", "j"), (7, "boolean", "{c}"), (7, "class_struct", "{a}"),
    (10, "index_key", "{c}"), (10, "accumulator", "{b}"), (10, "iterator", "x"), (10, "boolean", "done"), (10, "class_struct", "{a}"),
)
#: (template, line, name as it stands there, function, occurrence, pattern); in the order of the places.
FLAG_ANSWERS = (
    (0, 2, "{c}", "{a}", "assignment", "assign_bool_literal"), (0, 5, "{c}", "{a}", "conditional_use", "if_test"), (0, 5, "{b}", "{a}", "conditional_use", "if_test"),
    (0, 7, "{c}", "{a}", "assignment", "assign_bool_literal"), (0, 8, "{c}", "{a}", "return_use", "return_bool"), (1, 8, "{c}", "{b}", "return_use", "return_bool"),
    (4, 3, "{c}", "{b}", "assignment", "assign_bool_literal"), (4, 6, "{c}", "{b}", "conditional_use", "if_test"), (4, 7, "{c}", "{b}", "loop_use", "while_test"), (4, 9, "{c}", "{b}", "return_use", "return_bool"),
    (5, 2, "{b}", "{a}", "assignment", "assign_bool_literal"), (5, 3, "{c}", "{a}", "assignment", "assign_not_name"), (5, 3, "{b}", "{a}", "conditional_use", "assign_not_name_inner"),
    (5, 4, "{b}", "{a}", "loop_use", "while_test"), (5, 6, "{b}", "{a}", "assignment", "assign_boolop_lhs"), (5, 6, "{c}", "{a}", "conditional_use", "assign_boolop_rhs"),
    (6, 3, "${b}", "{a}", "assignment", "assign_bool_literal"), (6, 5, "${b}", "{a}", "conditional_use", "if_test"), (6, 7, "${b}", "{a}", "return_use", "return_bool"),
    (7, 3, "{c}", "{b}", "assignment", "assign_bool_literal"), (7, 5, "{c}", "{b}", "assignment", "assign_boolop_lhs"), (7, 7, "{c}", "{b}", "conditional_use", "if_exp_test"), (7, 8, "{c}", "{b}", "return_use", "return_bool"),
    (8, 2, "{b}", "{a}", "assignment", "assign_bool_literal"), (8, 3, "{b}", "{a}", "loop_use", "while_test"), (8, 4, "{b}", "{a}", "conditional_use", "if_test"),
    (8, 5, "{b}", "{a}", "assignment", "assign_bool_literal"), (8, 8, "{b}", "{a}", "return_use", "return_bool"),
    (9, 2, "{b}", "{a}", "assignment", "assign_bool_literal"), (9, 3, "{b}", "{a}", "loop_use", "while_test"), (9, 4, "{b}", "{a}", "assignment", "assign_bool_literal"), (9, 6, "{b}", "{a}", "return_use", "return_bool"),
)
#: (template, function, name, line, code) of the rows that label Python flags; the templates whose programs are errors.
LABEL_ANSWERS = ((0, "{a}", "{b}", 5, "{c} and not {b}"), (0, "{a}", "{c}", 2, "{c} = True"))
LABEL_ERRORS = (2, 3)
#: (template, role, name, line, place among the name's on the line, the scope's function: its first and its last line; 0 for the module).
SITE_ANSWERS = (
    (0, "accumulator", "total", 3, 1, "{a}", 1, 8), (0, "accumulator", "total", 6, 1, "{a}", 1, 8), (0, "boolean", "{c}", 2, 1, "{a}", 1, 8), (0, "boolean", "{c}", 5, 1, "{a}", 1, 8), (0, "boolean", "{c}", 7, 1, "{a}", 1, 8), (0, "boolean", "{c}", 8, 1, "{a}", 1, 8),
    (1, "class_struct", "{a}", 1, 1, None, 0, 0), (1, "accumulator", "{c}", 5, 1, "{b}", 4, 8), (1, "accumulator", "{c}", 7, 1, "{b}", 4, 8), (1, "accumulator", "{c}", 8, 1, "{b}", 4, 8), (1, "iterator", "item", 6, 1, "{b}", 4, 8), (1, "iterator", "item", 7, 1, "{b}", 4, 8),
    (3, "boolean", "{a}", 1, 1, None, 0, 0), (3, "boolean", "{b}", 1, 1, None, 0, 0), (3, "boolean", "{a}", 2, 1, None, 0, 0),
    (4, "class_struct", "{a}", 1, 1, None, 0, 0), (4, "boolean", "{c}", 3, 1, "{b}", 2, 10), (4, "accumulator", "sum", 4, 1, "{b}", 2, 10), (4, "accumulator", "sum", 6, 1, "{b}", 2, 10), (4, "boolean", "{c}", 6, 1, "{b}", 2, 10),
    (4, "boolean", "{c}", 7, 1, "{b}", 2, 10), (4, "boolean", "{c}", 7, 2, "{b}", 2, 10), (4, "boolean", "{c}", 9, 1, "{b}", 2, 10),
    (5, "accumulator", "list", 1, 1, "{a}", 1, 9), (5, "accumulator", "list", 5, 1, "{a}", 1, 9), (5, "accumulator", "list", 6, 1, "{a}", 1, 9), (5, "boolean", "{b}", 2, 1, "{a}", 1, 9), (5, "boolean", "{b}", 3, 1, "{a}", 1, 9), (5, "boolean", "{b}", 4, 1, "{a}", 1, 9),
    (5, "boolean", "{b}", 6, 1, "{a}", 1, 9), (5, "boolean", "{b}", 8, 1, "{a}", 1, 9),
    (6, "boolean", "{b}", 3, 1, "{a}", 2, 8), (6, "boolean", "{b}", 5, 1, "{a}", 2, 8), (6, "boolean", "{b}", 7, 1, "{a}", 2, 8), (6, "accumulator", "sum", 5, 1, "{a}", 2, 8), (6, "iterator", "v", 4, 1, "{a}", 2, 8),
    (7, "class_struct", "{a}", 1, 1, None, 0, 0), (7, "boolean", "{c}", 3, 1, "{b}", 2, 9), (7, "boolean", "{c}", 5, 1, "{b}", 2, 9), (7, "boolean", "{c}", 7, 1, "{b}", 2, 9), (7, "boolean", "{c}", 8, 1, "{b}", 2, 9),
    (7, "iterator", "j", 4, 1, "{b}", 2, 9), (7, "iterator", "j", 4, 2, "{b}", 2, 9), (7, "iterator", "j", 4, 3, "{b}", 2, 9), (7, "iterator", "j", 5, 1, "{b}", 2, 9),
    (10, "class_struct", "{a}", 1, 1, None, 0, 0), (10, "iterator", "x", 1, 1, None, 0, 0), (10, "accumulator", "{b}", 1, 1, None, 0, 0), (10, "index_key", "{c}", 1, 1, None, 0, 0), (10, "boolean", "done", 1, 1, None, 0, 0),
)
#: (template, function, variables with their numbers of places, kinds of the nodes in order).
RECORD_ANSWERS = (
    (0, "{a}", "{b}:1,{c}:4,i:2,rows:2,total:2", "function_def assign assign for_loop if_stmt aug_assign subscript assign return"),
    (1, "{b}", "{c}:3,item:2,xs:1", "function_def assign for_loop return"),
)
#: (template, name, line, value) of names known to be True (1) or False (0) where they are read.
CONSTANT_ANSWERS = ((0, "{c}", 5, 1), (3, "{a}", 2, 1))  # returns are not followed


def programs(spark: SparkSession, d: str) -> DataFrame:
    """problem_id, repo, language, code, template and the three names, of every document."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]{3,}"), F.lit(0))
    name = lambda n, i: F.concat(F.lit(f"{n}_"), F.rpad(F.coalesce(F.get("words", F.lit(i)), F.lit("")), 4, "x")).alias(n)
    rows = docs.select("doc_id", "source", words.alias("words")).select(F.col("doc_id").alias("problem_id"), F.col("source").alias("repo"), name("a", 0), name("b", 1), name("c", 2))
    rows = rows.withColumn("template", F.pmod("problem_id", F.lit(len(TEMPLATES))).cast("int"))
    pick = lambda i: F.element_at(F.array(*(F.lit(t[i]) for t in TEMPLATES)), F.col("template") + 1)
    code = pick(1)
    for n in "abc":
        code = F.replace(code, F.lit(f"{{{n}}}"), F.col(n))
    return rows.select("problem_id", "repo", pick(0).alias("language"), code.alias("code"), "template", "a", "b", "c")


def _quoted(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def values_sql(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(_quoted, r)) + ')' for r in rows)})"


def named_sql(column: str, of: str = "g") -> str:
    """SQL that puts a program's names into a template's text."""
    return f"replace(replace(replace({column}, '{{a}}', {of}.a), '{{b}}', {of}.b), '{{c}}', {of}.c)"


#: SQL of the table of programs: g (problem_id, repo, a, b, c, template, language, code, lines).
PROGRAMS_SQL = f"""{values_sql("tm", "template, language, body", [(i, *t) for i, t in enumerate(TEMPLATES)])},
wd AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[a-z]{{3,}}') AS w FROM documents),
nm AS (SELECT doc_id AS problem_id, source AS repo, 'a_' || rpad(coalesce(w[1], ''), 4, 'x') AS a, 'b_' || rpad(coalesce(w[2], ''), 4, 'x') AS b, 'c_' || rpad(coalesce(w[3], ''), 4, 'x') AS c, (doc_id % {len(TEMPLATES)})::INT AS template FROM wd),
g AS (SELECT x.*, string_split(x.code, chr(10)) AS lines FROM (SELECT g.problem_id, g.repo, g.a, g.b, g.c, g.template, tm.language, {named_sql("tm.body")} AS code FROM nm g JOIN tm USING (template)) x)"""


def offset_sql(line: str) -> str:
    """SQL for the place at which a line of g begins."""
    return f"(CASE WHEN {line} > 1 THEN length(array_to_string(list_slice(g.lines, 1, {line} - 1), chr(10))) + 1 ELSE 0 END)"
