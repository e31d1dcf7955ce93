"""The engine's functions called from SQL."""

import pytest

from lexiprobe.functions import sql

JAVA = "class A { boolean f(int n) { boolean up = true; return !up; } }"


@pytest.fixture(scope="module")
def registered(spark):
    names = sql.register(spark)
    rows = [("p", "Java", JAVA), ("p", "Python", "def f(up):\n    up = False\n    return up\n"), ("q", "C#", "class A {}"), ("q", "Go", None)]
    spark.createDataFrame(rows, "problem_id string, language string, code string").createOrReplaceTempView("coded")
    return names


def test_table_functions(spark, registered):
    got = spark.sql("SELECT language, o.variable, o.occurrence_type, o.line FROM coded, LATERAL flag_occurrences(code, language) o ORDER BY language, o.s").collect()
    assert [tuple(r) for r in got] == [("Java", "up", "assignment", 1), ("Java", "up", "return_use", 1), ("Python", "up", "assignment", 2), ("Python", "up", "return_use", 3)]
    kinds = spark.sql("SELECT n.kind, count(*) AS c FROM coded, LATERAL tree_nodes(code, language) n WHERE language = 'Java' AND n.kind IN ('function', 'param', 'return', 'not') GROUP BY 1").collect()
    assert {r.kind: r.c for r in kinds} == {"function": 1, "param": 1, "return": 1, "not": 1}
    assert [tuple(r) for r in spark.sql("SELECT * FROM identifiers('a1 + é.b')").collect()] == [("a1", 0, 2), ("b", 7, 8)]


def test_table_arguments_see_whole_partitions(spark, registered):
    got = spark.sql("SELECT * FROM program_names(TABLE(SELECT problem_id, code FROM coded) PARTITION BY problem_id)").collect()
    by = {(r.problem_id, r.name): (r.programs, r.of) for r in got}
    assert by["p", "up"] == (2, 2) and by["p", "boolean"] == (1, 2) and by["q", "A"] == (1, 2) and ("q", "up") not in by


def test_scalar_functions(spark, registered):
    assert {"statement_span", "scope_renamed", "flag_occurrences"} <= set(registered)
    r = spark.sql("SELECT statement_span('a = 1; b = 2', 7, 8) AS st, scope_renamed(code, 'numbered', array(), 'x') AS rn FROM coded WHERE language = 'Python'").first()
    assert tuple(r.st) == (6, 12) and r.rn.new_code == "def f(v1):\n    v1 = False\n    return v1\n" and r.rn.dropped is None
