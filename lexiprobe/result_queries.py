"""Further queries of the registry: on the table of programs, and on tables of results."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiprobe.functions import flags, rename, roles, sites, sql, trees
from lexiprobe.functions import text as X
from lexiprobe.functions import vectors as V
from lexiprobe.operators import bootstrap as B
from lexiprobe.operators import joins as J
from lexiprobe.operators import metrics as M
from lexiprobe.operators import occurrences as O
from lexiprobe.operators import renaming as N
from lexiprobe.operators import splits as S
from lexiprobe.operators import subspaces as K
from lexiprobe.operators import summaries as U
from lexiprobe.plans import prompts as P
from lexiprobe.plans import schedules as Q
from lexiprobe.programs import (
    CONSTANT_ANSWERS, FLAG_ANSWERS, LABEL_ANSWERS, LABEL_ERRORS, PROGRAMS_SQL, RECORD_ANSWERS, ROLE_ANSWERS, SITE_ANSWERS, named_sql, offset_sql, programs, values_sql,
)
from lexiprobe.queries import _BLANKS, _F1, _PRED, _UNIT, predictions, query, table
from lexiprobe.shapes import SHAPES, SHAPES_SQL, shaped_programs
from lexiprobe.session import shared_path
from lexiprobe.sources import reports as R
from lexiprobe.sources import shards
from lexiprobe.sources import tables as T

SUMS = ["tn", "fp", "fn", "tp"]

# --- programs ---------------------------------------------------------------------------------------

_ROLES_SQL = f"""{PROGRAMS_SQL}, {values_sql("ra", "template, role, names", ROLE_ANSWERS)},
ro AS (SELECT g.problem_id, g.language, ra.role, list_sort(string_split({named_sql("ra.names")}, ',')) AS names FROM g JOIN ra USING (template))"""


@query(f"WITH {_ROLES_SQL} SELECT problem_id, language, role, names FROM ro")
def program_roles(spark, d):
    """Sorted names of each role of each program that has any."""
    rows = programs(spark, d).filter("language NOT IN ('Go', 'Ruby')").withColumn("roles", roles.roles_of(F.col("code"), F.col("language")))
    return rows.select("problem_id", "language", F.explode("roles").alias("role", "names")).filter(F.size("names") > 0)


@query(f"""WITH {_ROLES_SQL}, h AS (SELECT DISTINCT problem_id FROM ro)
SELECT g.language, count(h.problem_id) AS kept, count(*) - count(h.problem_id) AS skipped FROM g LEFT JOIN h USING (problem_id) WHERE g.language NOT IN ('Go', 'Ruby') GROUP BY g.language""")
def dataset_counters(spark, d):
    """Programs kept, and those without any role, by language."""
    rows = programs(spark, d).filter("language NOT IN ('Go', 'Ruby')").withColumn("roles", roles.roles_of(F.col("code"), F.col("language")))
    some = F.exists(F.map_values("roles"), lambda n: F.size(n) > 0)
    return rows.groupBy("language").agg(F.count_if(some).alias("kept"), F.count_if(~some).alias("skipped"))


@query(f"WITH {PROGRAMS_SQL} SELECT problem_id, template <> 2 AS valid FROM g")
def program_validity(spark, d):
    """Python must parse, other programs balance their braces and parentheses."""
    parses = sites.top_level_names(F.when(F.col("language") == "Python", F.col("code"))).isNotNull()
    return programs(spark, d).select("problem_id", F.when(F.col("language") == "Python", parses).otherwise(X.balanced(F.col("code"))).alias("valid"))


_FLAGS_SQL = f"""{PROGRAMS_SQL}, {values_sql("fa", "ord, template, line, name, func, kind, pattern", [(i, *r) for i, r in enumerate(FLAG_ANSWERS)])},
fo AS (SELECT g.problem_id, g.language, {named_sql("fa.func")} AS function, ltrim({named_sql("fa.name")}, '$') AS variable, fa.kind AS occurrence_type, fa.pattern AS detection_pattern, fa.line,
 strpos(g.lines[fa.line], {named_sql("fa.name")}) - 1 AS col, {offset_sql("fa.line")} AS ofs, length({named_sql("fa.name")}) AS width, fa.ord FROM g JOIN fa USING (template)),
fv AS (SELECT *, min(ord) OVER (PARTITION BY problem_id, variable) AS seen FROM fo)"""


@query(f"""WITH {_FLAGS_SQL} SELECT problem_id, function, variable, occurrence_type, detection_pattern, line::INT AS line, (ofs + col)::INT AS s, (ofs + col + width)::INT AS e,
 problem_id || ':' || language || ':f0:b' || (dense_rank() OVER (PARTITION BY problem_id ORDER BY seen) - 1) || ':o' || (row_number() OVER (PARTITION BY problem_id, variable ORDER BY ord) - 1) AS occurrence_id FROM fv""")
def flag_occurrences(spark, d):
    """The boolean flags' places in every program, with ids."""
    rows = O.program_occurrences(programs(spark, d).filter("language <> 'C#'"))
    return rows.select("problem_id", "function", "variable", "occurrence_type", "detection_pattern", "line", "s", "e", "occurrence_id")


@query(SHAPES_SQL)
def flag_shapes(spark, d):
    """The flags of programs with nested functions, methods, lambdas, comments and strings, behind whole texts as comments."""
    rows = shaped_programs(spark, d).withColumn("o", F.explode(flags.occurrences("code", "language")))
    held = F.expr("ltrim('$', substring(code, o.s + 1, o.e - o.s)) = o.variable")
    return rows.select("problem_id", "o.variable", "o.line", "o.occurrence_type", "o.detection_pattern", held.alias("held"))


@query(f"""WITH {values_sql("sh", "shape, language, body", [(i, s[0], s[1]) for i, s in enumerate(SHAPES)])}, tx AS (SELECT (doc_id % {len(SHAPES)})::INT AS shape FROM documents)
SELECT sh.language, sum(len(regexp_extract_all(sh.body, '\\breturn\\b')))::BIGINT AS returns, count(*) AS programs FROM tx JOIN sh USING (shape) GROUP BY 1""")
def tree_returns(spark, d):
    """Return statements in the trees of all programs, by language; comments and strings have none."""
    rows = trees.program_nodes(shaped_programs(spark, d))
    return rows.groupBy("language").agg(F.count_if(F.col("kind") == "return").alias("returns"), F.count_if(F.col("parent").isNull()).alias("programs"))


@query(SHAPES_SQL.replace(", true AS held", ""))
def flag_shapes_in_sql(spark, d):
    """The same flags by a table function in SQL."""
    sql.register(spark)
    return spark.sql("SELECT problem_id, o.variable, o.line, o.occurrence_type, o.detection_pattern FROM {p}, LATERAL flag_occurrences(code, language) o", p=shaped_programs(spark, d))


@query(f"""WITH {PROGRAMS_SQL}, n AS (SELECT DISTINCT repo, problem_id, unnest(regexp_extract_all(code, '[A-Za-z_]\\w*')) AS name FROM g)
SELECT repo AS problem_id, name, count(*)::INT AS programs, (SELECT count(*) FROM g WHERE g.repo = n.repo)::INT AS "of" FROM n GROUP BY repo, name""")
def names_of_sources(spark, d):
    """How many of a source's programs have each identifier, by a table function over partitions of a table."""
    sql.register(spark)
    rows = programs(spark, d).select(F.col("repo").alias("problem_id"), "code")
    return spark.sql("SELECT * FROM program_names(TABLE(SELECT * FROM {p}) PARTITION BY problem_id)", p=rows)


_RENAMED = (
    (0, "def {a}(v1, v2=False):\n    v3 = True\n    v4 = 0\n    for v5 in v1:\n        if v3 and not v2:\n            v4 += v1[v5]\n            v3 = False\n    return v3\n"),
    (1, "class {a}:\n    pass\n\ndef {b}(v1):\n    v2 = []\n    for v3 in v1:\n        v2.append(v3)\n    return v2\n"),
)
_NEW_NAMES = ((0, "{b}", "v2"), (0, "{c}", "v3"), (1, "{c}", "v2"))


def _renamed(spark, d):
    rows = programs(spark, d).filter("language = 'Python'")
    return N.renaming_flow(rows, O.program_occurrences(rows), "numbered", O.program_occurrences)


@query(f"""WITH {PROGRAMS_SQL}, {values_sql("rn", "template, body", _RENAMED)} SELECT g.problem_id, {named_sql("rn.body")} AS new_code, NULL::VARCHAR AS dropped FROM g JOIN rn USING (template)""")
def scope_renamed_programs(spark, d):
    """Python programs with occurrences, their locals numbered; none is dropped."""
    return _renamed(spark, d)[0].select("problem_id", "new_code", "dropped")


@query(f"""WITH {_FLAGS_SQL}, {values_sql("rn", "template, body", _RENAMED)}, {values_sql("nn", "template, old, new", _NEW_NAMES)},
ids AS (SELECT problem_id, function, variable, line, ord, problem_id || ':' || language || ':f0:b' || (dense_rank() OVER (PARTITION BY problem_id ORDER BY seen) - 1) || ':o' || (row_number() OVER (PARTITION BY problem_id, variable ORDER BY ord) - 1) AS occurrence_id FROM fv),
rw AS (SELECT g.*, string_split({named_sql("rn.body")}, chr(10)) AS nl FROM g JOIN rn USING (template))
SELECT ids.problem_id, ids.occurrence_id, ids.variable AS original_variable, nn.new AS variable, (CASE WHEN line > 1 THEN length(array_to_string(list_slice(rw.nl, 1, line - 1), chr(10))) + 1 ELSE 0 END + strpos(rw.nl[line], nn.new) - 1)::INT AS s
FROM ids JOIN rw USING (problem_id) JOIN nn ON nn.template = rw.template AND {named_sql("nn.old", "rw")} = ids.variable""")
def carried_occurrences(spark, d):
    """Where the flags of renamed programs stand, under the ids they had; all are found again."""
    return _renamed(spark, d)[1].select("problem_id", "occurrence_id", "original_variable", "variable", "s")


@query(f"""WITH {PROGRAMS_SQL}, {values_sql("la", "template, func, name, line, said", LABEL_ANSWERS)}
SELECT g.problem_id, false AS failed, {named_sql("la.func")} AS function, {named_sql("la.name")} AS variable, la.line::INT AS line, {named_sql("la.said")} AS code FROM g JOIN la USING (template)
UNION ALL SELECT problem_id, true, NULL, NULL, NULL, NULL FROM g WHERE template IN {LABEL_ERRORS}""")
def flag_labels(spark, d):
    """Label rows of Python's flags, and a row for each program that cannot be read or has no function."""
    rows = programs(spark, d).filter("language = 'Python'").withColumn("l", flags.labels("code")).select("problem_id", F.col("l.error").isNotNull().alias("failed"), "l.rows")
    out = rows.filter("failed OR size(rows) > 0").select("problem_id", "failed", F.explode_outer("rows").alias("r"))
    return out.select("problem_id", "failed", "r.function", "r.variable", "r.line", "r.code")


@query(f"""WITH {PROGRAMS_SQL}, {values_sql("sa", "template, role, name, line, nth, func, first, last", SITE_ANSWERS)},
so AS (SELECT g.*, sa.role, {named_sql("sa.name")} AS variable, sa.line, sa.nth, {named_sql("sa.func")} AS func, sa.first, sa.last, {offset_sql("sa.line")} AS ofs FROM g JOIN sa USING (template)),
sp AS (SELECT g.*, ofs + length(regexp_extract(g.lines[line], '^((?:.*?\\b' || variable || '\\b){{' || (nth - 1) || '}}.*?)\\b' || variable || '\\b', 1)) AS s,
 CASE WHEN func IS NULL THEN NULL ELSE func || '@' || ({offset_sql("first")} + length(regexp_extract(g.lines[first], '^ *'))) || '-' || ({offset_sql("last")} + length(g.lines[last])) END AS scope FROM so g),
sv AS (SELECT *, min(s) OVER (PARTITION BY problem_id, role, variable) AS seen FROM sp)
SELECT problem_id, role, variable, scope, s::INT AS s, (s + length(variable))::INT AS e, line::INT AS line,
 problem_id || ':' || language || ':f0:b' || (dense_rank() OVER (PARTITION BY problem_id, role ORDER BY seen) - 1) || ':o' || (row_number() OVER (PARTITION BY problem_id, role, variable ORDER BY s) - 1) AS occurrence_id FROM sv""")
def role_occurrences(spark, d):
    """The places of all role names in every program, by the scope around them, with ids."""
    rows = O.role_occurrence_rows(programs(spark, d))
    return rows.select("problem_id", "role", "variable", "scope", "s", "e", "line", "occurrence_id")


@query(f"""WITH {PROGRAMS_SQL}, {values_sql("fr", "template, func, names, kinds", RECORD_ANSWERS)}
SELECT g.problem_id, {named_sql("fr.func")} AS function, list_sort(string_split({named_sql("fr.names")}, ',')) AS variables, string_split(fr.kinds, ' ') AS nodes,
 len(list_filter(string_split(fr.kinds, ' '), lambda x: x = 'assign' OR x = 'aug_assign')) AS assignments, len(list_filter(string_split(fr.kinds, ' '), lambda x: x = 'for_loop')) AS loops FROM g JOIN fr USING (template)""")
def function_records(spark, d):
    """What each top-level Python function is made of."""
    rows = programs(spark, d).filter("language = 'Python'").select("problem_id", F.explode(sites.records("code")["functions"]).alias("f"))
    names = F.array_sort(F.transform("f.variables", lambda v: F.concat_ws(":", v["name"], F.size(v["occurrences"]))))
    return rows.select("problem_id", "f.function", names.alias("variables"), F.transform("f.nodes", lambda n: n["kind"]).alias("nodes"), F.size("f.assignments").cast("long").alias("assignments"), F.size("f.loops").cast("long").alias("loops"))


@query(f"""WITH {PROGRAMS_SQL}, {values_sql("ca", "template, name, line, label", CONSTANT_ANSWERS)}
SELECT g.problem_id, {named_sql("ca.name")} AS variable, ({offset_sql("ca.line")} + strpos(g.lines[ca.line], {named_sql("ca.name")}) - 1)::INT AS s, ca.label::INT AS label FROM g JOIN ca USING (template)""")
def constant_uses(spark, d):
    """Names known to be True or False where they are read."""
    rows = programs(spark, d).filter("language = 'Python'").select("problem_id", "code", F.explode(sites.constant_labels("code")).alias("u"))
    return rows.select("problem_id", F.expr("substring(code, u.s + 1, u.e - u.s)").alias("variable"), "u.s", "u.label")


@query(f"""WITH {PROGRAMS_SQL}, n AS (SELECT problem_id, code, unnest(CASE template WHEN 0 THEN [a, b, c, 'i', 'rows', 'total'] WHEN 1 THEN [a, b, c, 'item', 'xs'] WHEN 3 THEN [a, b, c] ELSE [] END) AS name FROM g),
p AS (SELECT g.problem_id, g.code, '\\b(' || string_agg(n.name, '|') || ')\\b' AS p FROM g JOIN n USING (problem_id) GROUP BY ALL)
SELECT problem_id, regexp_replace(code, p, 'x', 'g') AS code FROM p""")
def rename_all_same(spark, d):
    """Every renameable name of the Python programs that parse as x."""
    rows = programs(spark, d).filter("language = 'Python' AND template <> 2").withColumn("strategy", F.lit("all_same"))
    return rows.select("problem_id", rename.renamed("code", "strategy", F.col("problem_id"), F.col("language")).alias("code"))


@query()
def rename_programs(spark, d):
    """All strategies on all Python programs (drawn by hash: tests hold their rules)."""
    strategies = F.explode(F.array(*(F.lit(s) for s in rename.STRATEGIES))).alias("strategy")
    rows = programs(spark, d).filter("language = 'Python'").select("problem_id", "language", "code", strategies)
    return rows.select("problem_id", "strategy", rename.renamed("code", "strategy", F.col("problem_id"), F.col("language")).alias("code"))


_STATEMENTS = ((0, 5, "{c}", 4), (1, 7, "{c}", 0), (4, 6, "{c}", 3), (5, 4, "{b}", 0), (6, 5, "{b}", 3), (7, 5, "{c}", 0), (8, 4, "{b}", 5))
_STATEMENT_ANSWERS = (
    (0, "        if {c} and not {b}:\n"), (1, "        {c}.append(item)\n"), (4, "      if ({c} && i > 3) {"), (5, "  for (let i = 0; {b}; i++) {"), (6, "    if (${b}) {"), (7, "    {c} = j == 3 || n == 4;"), (8, "    if n > 3 && {b} {"),
)


@query(f"""WITH {PROGRAMS_SQL}, {values_sql("st", "template, said", _STATEMENT_ANSWERS)} SELECT g.problem_id, {named_sql("st.said")} AS statement FROM g JOIN st USING (template)""")
def enclosing_statements(spark, d):
    """The statement around a name on one line of each program."""
    line, name = (F.create_map(*(x for t in _STATEMENTS for x in (F.lit(t[0]), F.lit(t[i]))))[F.col("template")] for i in (1, 2))
    rows = programs(spark, d).withColumn("line", line).filter("line IS NOT NULL").withColumn("name", F.when(name == "{b}", F.col("b")).otherwise(F.col("c")))
    start = F.length(F.array_join(F.slice(F.split("code", "\n"), F.lit(1), F.col("line") - 1), "\n")) + 1
    rows = rows.withColumn("start", start).withColumn("at", F.expr("locate(name, code, start) - 1"))
    rows = rows.withColumn("b", X.statement_span("code", "at", F.col("at") + F.length("name")))
    return rows.select("problem_id", F.expr("substring(code, b.s + 1, b.e - b.s)").alias("statement"))


_LABELS_SQL = f"""{PROGRAMS_SQL}, lr AS (SELECT g.problem_id AS ord, CASE WHEN g.problem_id % 19 = 0 THEN 'bad' END AS parse_error, CASE WHEN g.problem_id % 17 = 0 THEN 'iterator' ELSE 'boolean_flag' END AS role,
 CASE WHEN g.problem_id % 23 = 0 THEN NULL ELSE repo END AS repo, CASE WHEN g.problem_id % 29 = 0 THEN 'x.ipynb' ELSE 'p' || (g.problem_id % 5) || '.py' END AS path, g.repo AS r0, 'p' || (g.problem_id % 5) || '.py' AS p0,
 CASE WHEN g.problem_id % 31 = 0 THEN 'none' WHEN g.problem_id % 7 = 0 THEN NULL WHEN g.problem_id % 13 = 0 THEN '999999999' ELSE (CASE WHEN g.problem_id % 2 = 0 THEN g.problem_id ELSE g.problem_id - g.problem_id % 22 END)::VARCHAR END AS source_row, g.template, g.a, g.b, g.c FROM g),
cn AS (SELECT problem_id AS idx, repo, 'p' || (problem_id % 5) || '.py' AS path, template, code FROM g), ff AS (SELECT repo, path, arg_min(idx, idx) AS idx FROM cn GROUP BY 1, 2),
lj AS (SELECT lr.*, try_cast(source_row AS BIGINT) AS sr, CASE WHEN source_row IS NOT NULL THEN try_cast(source_row AS BIGINT) ELSE ff.idx END AS found FROM lr LEFT JOIN ff ON ff.repo = lr.repo AND ff.path = lr.path),
lk AS (SELECT lj.*, cn.template AS ct, cn.code, x.a AS xa, x.b AS xb, CASE WHEN x.template = 1 THEN x.b ELSE x.a END AS fn FROM lj LEFT JOIN cn ON cn.idx = lj.found LEFT JOIN g x ON x.problem_id = lj.found),
ln AS (SELECT *, CASE WHEN ord % 41 = 0 THEN 'nope' ELSE fn END AS function, CASE WHEN ord % 37 = 0 THEN 'nothing' WHEN ct = 0 OR ct = 1 THEN 'c' ELSE 'c' END AS variable FROM lk)"""


def _label_records(spark, d):
    """Label rows made of the programs, with all kinds of faults, and the canonical programs they refer to."""
    g = programs(spark, d)
    n = F.col("problem_id")
    when = lambda k, v: F.when(n % k == 0, v)
    path = F.concat(F.lit("p"), n % 5, F.lit(".py"))
    canonical = g.select(n.alias("idx"), "repo", path.alias("path"), "code", "template", "a", "b", "c")
    row = when(31, F.lit("none")).when(n % 7 == 0, F.lit(None)).when(n % 13 == 0, F.lit("999999999")).otherwise(F.when(n % 2 == 0, n).otherwise(n - n % 22).cast("string"))
    rows = g.select(
        n.alias("ord"), when(19, F.lit("bad")).alias("parse_error"), when(17, F.lit("iterator")).otherwise("boolean_flag").alias("role"), when(23, F.lit(None)).otherwise(F.col("repo")).alias("repo"),
        when(29, F.lit("x.ipynb")).otherwise(path).alias("path"), row.alias("source_row"),
    )
    # the function and variable are those of the program that the row refers to
    first = canonical.groupBy("repo", "path").agg(F.min("idx").alias("first"))
    to = F.when(F.col("source_row").isNotNull(), F.expr("try_cast(source_row AS BIGINT)")).otherwise(F.col("first"))
    names = canonical.select(F.col("idx").alias("to"), F.when(F.col("template") == 1, F.col("b")).otherwise(F.col("a")).alias("fn"), F.col("c").alias("var"))
    rows = rows.join(first, ["repo", "path"], "left").withColumn("to", to).join(names, "to", "left")
    function, variable = F.when(F.col("ord") % 41 == 0, "nope").otherwise(F.coalesce("fn", F.lit("gone"))), F.when(F.col("ord") % 37 == 0, "nothing").otherwise(F.coalesce("var", F.lit("gone")))
    return rows.select("ord", "parse_error", "role", "repo", "path", "source_row", function.alias("function"), variable.alias("variable")), canonical.select("idx", "repo", "path", "code")


@query(f"""WITH {_LABELS_SQL}, q AS (SELECT *, CASE WHEN parse_error IS NOT NULL THEN 'parse_error' WHEN role <> 'boolean_flag' THEN 'non_boolean' WHEN repo IS NULL THEN 'missing_fields' WHEN source_row IS NOT NULL AND sr IS NULL THEN 'bad_source_row'
 WHEN code IS NULL THEN 'missing_canonical' WHEN path LIKE '%ipynb%' THEN 'notebook_artifact' WHEN ct NOT IN (0, 1, 3) THEN 'malformed_canonical' WHEN ct = 3 OR ord % 41 = 0 THEN 'no_matching_function' WHEN ord % 37 = 0 THEN 'variable_few_occurrences' END AS reason FROM ln),
k AS (SELECT *, min(CASE WHEN reason IS NULL THEN ord END) OVER (PARTITION BY CASE WHEN sr IS NOT NULL THEN sr::VARCHAR ELSE repo || '/' || path END, function, variable) AS kept FROM q)
SELECT coalesce(CASE WHEN reason IS NULL AND ord > kept THEN 'duplicate' ELSE reason END, 'kept') AS reason, count(*) AS n FROM k GROUP BY 1""")
def clean_label_reasons(spark, d):
    records, canonical = _label_records(spark, d)
    return O.clean_labels(records, canonical, "ord").groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_SPLIT_SQL = f"CASE WHEN {_UNIT.format(k='repo', s='5')} < 0.2 THEN 'test' WHEN {_UNIT.format(k='repo', s='5')} < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END"


@query(f"""WITH {_LABELS_SQL}, sm AS (SELECT DISTINCT source AS repo, {_SPLIT_SQL.replace("repo ||", "source ||")} AS split FROM documents WHERE source <> (SELECT min(source) FROM documents)),
q AS (SELECT ln.*, sm.split, CASE WHEN parse_error IS NOT NULL THEN 'parse_error' WHEN role <> 'boolean_flag' THEN 'non_boolean' WHEN ln.repo IS NULL THEN 'missing_fields' WHEN sm.split IS NULL THEN 'repo_not_in_split'
 WHEN source_row IS NOT NULL AND sr IS NULL THEN 'bad_source_row' WHEN code IS NULL THEN 'missing_code' WHEN ct NOT IN (0, 1, 3) THEN 'bad_code' WHEN ct = 3 OR ord % 41 = 0 THEN 'no_function' END AS reason FROM ln LEFT JOIN sm ON sm.repo = ln.repo)
SELECT coalesce(reason, 'kept') AS reason, CASE WHEN reason IS NULL THEN split END AS split, count(*) AS n, coalesce(sum(CASE WHEN reason IS NOT NULL OR ord % 37 = 0 THEN 0 WHEN ct = 0 THEN 4 ELSE 3 END), 0)::BIGINT AS places FROM q GROUP BY 1, 2""")
def freeze_reasons(spark, d):
    records, canonical = _label_records(spark, d)
    repos = table(spark, d, "documents").select(F.col("source").alias("repo")).distinct()
    lowest = repos.agg(F.min("repo").alias("lowest"))
    splits = repos.crossJoin(F.broadcast(lowest)).filter("repo <> lowest").select("repo", S.hash_split(F.col("repo"), 5).alias("split"))
    rows = O.freeze_labels(records, canonical, splits)
    kept = F.col("skip_reason").isNull()
    return rows.groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("reason"), F.when(kept, F.col("split")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(kept, F.size("places")).otherwise(0)).alias("places"))


# --- filters and gates ------------------------------------------------------------------------------


@query("SELECT event_type, count(*) FILTER (value >= 20) AS kept, count(*) FILTER (value < 20 OR value IS NULL) AS below FROM events GROUP BY 1")
def min_clean_floor(spark, d):
    return U.above_floor(table(spark, d, "events"), ["event_type"], "value", 20.0)


@query("SELECT lang, CASE WHEN source < 'm' THEN 'target' ELSE 'other' END AS y, count(*) AS n FROM documents GROUP BY 1, 2")
def binary_targets(spark, d):
    rows = table(spark, d, "documents").withColumn("role", F.when(F.col("source") < "m", "iterator").otherwise("boolean"))
    return rows.groupBy("lang", U.binary_target(F.col("role"), "iterator").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '{_BLANKS}', ' ', 'g'), ' ')) AS sha FROM documents")
def single_blank_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(X.single_blanks(F.coalesce("text", F.lit(""))), 256).alias("sha"))


@query("""WITH t AS (SELECT doc_id, lang, text, unnest(range((length(text) + 9) // 10)) * 10 AS s FROM documents WHERE text <> ''), p AS (SELECT *, least(s + 10, length(text)) AS e, substr(text, s + 1, 10) AS cut FROM t)
SELECT lang, count(*) FILTER (doc_id % 97 = 0 AND s = 0) AS bad, count(*) AS total, count(*) FILTER (doc_id % 97 = 0 AND s = 0) = 0 AS ok FROM p GROUP BY lang""")
def tokenizer_offsets(spark, d):
    """Pieces of ten characters as tokens; the first one of some texts is not what its offsets cut out."""
    rows = table(spark, d, "documents").filter("text <> ''").select("doc_id", "lang", "text", F.regexp_extract_all("text", F.lit("(?s).{1,10}"), F.lit(0)).alias("pieces"))
    piece = lambda x, i: F.when((F.col("doc_id") % 97 == 0) & (i == 0), F.lit("wrong piece")).otherwise(x)
    token = lambda x, i: F.struct((i * 10).alias("s"), (i * 10 + F.length(x)).alias("e"), piece(x, i).alias("piece"))
    return U.offset_gate(rows.withColumn("tokens", F.transform("pieces", token)), ["lang"], "text", "tokens")


@query("""SELECT strategy, count(*) AS n FROM documents, (SELECT unnest(['baseline', 'all_same', 'misleading_iterator']) AS strategy) GROUP BY 1""")
def relevant_strategies(spark, d):
    """Documents under the strategies that count for iterators."""
    each = F.explode(F.array(*(F.lit(s) for s in ("baseline", "all_same", "misleading_iterator", "misleading_boolean")))).alias("strategy")
    return U.relevant(table(spark, d, "documents").select("doc_id", each), "iterator").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def sampled_ids(spark, d):
    """Labels of sampled ids; under nine tenths of them it would be refused."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return U.restricted(labels, labels.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi"), "doc_id")


@query(f"""SELECT seed::INT AS seed, count(*) FILTER (f = 'train') AS train, count(*) FILTER (f = 'val') AS val, count(*) FILTER (f = 'test') AS test, count(DISTINCT CASE WHEN f = 'train' THEN quality END) AS classes,
 least(count(*) FILTER (f = 'train'), count(*) FILTER (f = 'val'), count(*) FILTER (f = 'test')) > 0 AND count(DISTINCT CASE WHEN f = 'train' THEN quality END) >= 2 AS usable
 FROM (SELECT seed, quality, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS f FROM (SELECT seed, quality, {_UNIT.format(k="source", s="seed")} AS u FROM documents JOIN labels USING (doc_id), range(3) t(seed))) GROUP BY seed""")
def usable_seeds(spark, d):
    """Folds of whole sources and their classes by seed."""
    rows = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    return U.usable_seeds(rows, "source", "quality", [0, 1, 2])


@query(f"""SELECT policy, f AS split, count(*) AS n FROM (SELECT policy, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS f
 FROM (SELECT policy, {_UNIT.format(k="CASE policy WHEN 'function' THEN lang || source WHEN 'repo' THEN source ELSE doc_id::VARCHAR END", s="0")} AS u FROM documents, (SELECT unnest(['function', 'repo', 'random']) AS policy))) GROUP BY 1, 2""")
def split_policies(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat("lang", "source").alias("function"), F.col("source").alias("repo"))
    out = None
    for policy in ("function", "repo", "random"):
        group = U.split_group(policy)
        part = rows.select(F.lit(policy).alias("policy"), S.hash_split(F.col("doc_id") if group is None else group, 0).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("policy", "split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, list_reduce(list_transform(range(1, 41), lambda i: strpos('0123456789abcdef', substr(sha1(doc_id || ':4'), i::BIGINT, 1)) - 1), lambda a, x: (a * 16 + x) % 100)::BIGINT AS fold FROM documents")
def hundred_folds(spark, d):
    return table(spark, d, "documents").select("doc_id", S.hundred_fold(F.col("doc_id"), 4).alias("fold"))


# --- pairings ---------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT doc_id AS ord, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'runs/a/' || (doc_id % 700) || '.npz' END AS p, CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'other' ELSE lang END AS y, source, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars // 400 END AS f FROM documents),
u AS (SELECT * FROM m WHERE p <> '' AND y IS NOT NULL), g AS (SELECT source, f, count(*) AS k, count(DISTINCT y) AS t, arg_min(p, ord) AS p FROM u GROUP BY 1, 2), b AS (SELECT g.*, e.vec_id FROM g LEFT JOIN embeddings e ON g.p = 'runs/a/' || e.vec_id || '.npz' WHERE t = 1)
SELECT (SELECT sum(k) FROM g)::BIGINT AS usable, (SELECT coalesce(sum(k - 1), 0) FROM g WHERE t = 1)::BIGINT AS duplicates, (SELECT coalesce(sum(k), 0) FROM g WHERE t > 1)::BIGINT AS conflicts, count(*) FILTER (vec_id IS NULL) AS missing, count(vec_id) AS records FROM b""")
def manifest_stats(spark, d):
    """A manifest of files against the vectors there are: duplicates, conflicts, missing files."""
    n = F.col("doc_id")
    kind = F.when(n % 17 == 0, F.lit(None)).when(n % 11 == 0, F.lit("other")).otherwise(F.col("lang"))
    path = F.when(n % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("runs/a/"), n % 700, F.lit(".npz")))
    manifest = table(spark, d, "documents").select(n.alias("ord"), path.alias("activation_path"), kind.alias("occurrence_type"), "source", F.when(n % 3 == 0, F.lit(None)).otherwise(F.expr("n_chars div 400")).alias("f"))
    tensors = table(spark, d, "embeddings").select(F.concat("vec_id", F.lit(".npz")).alias("name"), F.col("embedding").alias("vec"))
    return T.manifest_records(manifest, tensors, ["source", "f"], "ord")[1]


@query(f"WITH {_PRED} SELECT doc_id, y_true, cluster, y_pred AS pred_a, y_other AS pred_b FROM p WHERE doc_id % 3 = 0")
def paired_seed_zero(spark, d):
    """Two predictors by occurrence, of one seed."""
    p = predictions(spark, d).withColumn("seed", (F.col("doc_id") % 3).cast("int"))
    return U.paired_seed(p, p.drop("y_pred").withColumnRenamed("y_other", "y_pred"), "doc_id", 0)


@query("""WITH c AS (SELECT event_type, user_id % 4 AS target, CASE WHEN event_id % 2 = 0 THEN 'original' ELSE 'C1' END AS condition, avg(value) AS f1 FROM events GROUP BY ALL),
b AS (SELECT event_type, user_id % 4 AS target, max(value) AS baseline FROM events WHERE user_id % 4 < 3 GROUP BY ALL)
SELECT c.event_type, c.target, c.condition, round(c.f1, 9) AS f1, b.baseline FROM c LEFT JOIN b ON c.event_type = b.event_type AND c.target = b.target AND c.condition = 'original'""")
def cells_with_baselines(spark, d):
    e = table(spark, d, "events").withColumn("target", F.col("user_id") % 4)
    cells = e.groupBy("event_type", "target", F.when(F.col("event_id") % 2 == 0, "original").otherwise("C1").alias("condition")).agg(F.round(F.avg("value"), 9).alias("f1"))
    base = e.filter("target < 3").groupBy("event_type", "target").agg(F.max("value").alias("baseline"))
    return U.with_baselines(cells, base, ["event_type", "target"])


@query("""WITH c AS (SELECT l_returnflag, CASE WHEN l_linenumber = 1 THEN 'baseline' ELSE 's' || l_linenumber END AS strategy, avg(l_quantity) AS f FROM lineitem GROUP BY ALL)
SELECT l_returnflag, strategy, round(f, 8) AS f, round(CASE WHEN strategy <> 'baseline' THEN f - max(f) FILTER (strategy = 'baseline') OVER (PARTITION BY l_returnflag) END, 8) AS delta FROM c""")
def delta_to_baseline(spark, d):
    name = F.when(F.col("l_linenumber") == 1, "baseline").otherwise(F.concat(F.lit("s"), "l_linenumber"))
    c = table(spark, d, "lineitem").groupBy("l_returnflag", name.alias("strategy")).agg(F.avg("l_quantity").alias("f"))
    return U.delta_to_baseline(c, ["l_returnflag"], "strategy", "f").withColumn("f", F.round("f", 8)).withColumn("delta", F.round("delta", 8))


@query("SELECT a.lang AS source, b.lang AS target FROM (SELECT DISTINCT lang FROM documents) a, (SELECT DISTINCT lang FROM documents) b WHERE a.lang <> b.lang")
def ordered_language_pairs(spark, d):
    return U.ordered_pairs(table(spark, d, "documents"), "lang")


@query("SELECT 'pair_id' AS name, count(*) AS shared FROM (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT p_partkey FROM part WHERE p_partkey % 2 = 1)")
def disjoint_sets(spark, d):
    part = table(spark, d, "part").select("p_partkey")
    a, b = part.filter("p_partkey % 2 = 0"), part.filter("p_partkey % 2 = 1")
    U.require_disjoint(a, b, ["p_partkey"])
    return a.intersect(b).agg(F.count(F.lit(1)).alias("shared")).select(F.lit("pair_id").alias("name"), "shared")


@query("SELECT l_orderkey, l_linenumber, (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) // 64 AS block FROM lineitem")
def blocks_of_64(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return U.blocks_of(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "block")


@query("WITH o AS (SELECT user_id, lag(user_id) OVER (ORDER BY event_id) AS b, row_number() OVER (ORDER BY event_id) AS n FROM events) SELECT count(*) AS rows, count(DISTINCT user_id) AS programs, count(*) FILTER (n = 1 OR user_id IS DISTINCT FROM b) AS runs FROM o")
def program_runs(spark, d):
    return U.program_runs(table(spark, d, "events"), "user_id", "event_id")


@query("SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id, role) AS n FROM conversations")
def name_frequency(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", U.frequency("conv_id", "role").alias("n"))


@query("SELECT user_id, event_id, row_number() OVER (ORDER BY user_id, value DESC, event_id) AS place FROM events")
def total_order(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return S.global_rank(e, [F.col("user_id"), F.col("value").desc(), F.col("event_id")], "place").select("user_id", "event_id", "place")


@query("SELECT 0::BIGINT AS misplaced, 288::BIGINT AS pairs")
def prompt_positions(spark, d):
    """The frozen prompts stand in the order of their clusters and variants."""
    p = P.prompt_pairs(spark)
    wrong = U.misplaced(p, ["pair_id"], F.col("cluster_id") * P.LEXICAL + F.col("lexical_variant"))
    return wrong.agg(F.count(F.lit(1)).alias("misplaced")).crossJoin(F.broadcast(p.agg(F.count(F.lit(1)).alias("pairs"))))


_CELLS_OF = """SELECT {n}, layer, span, direction, control FROM (SELECT unnest({layers}) AS layer), (SELECT unnest({spans}) AS span), (SELECT unnest(['denoise', 'noise']) AS direction), (SELECT unnest({controls}) AS control)"""


def _cells_sql(name, layers, spans, controls) -> str:
    return _CELLS_OF.format(n=f"'{name}' AS schedule", layers=layers, spans=spans, controls=controls)


_PRIMARY = " UNION ".join((_cells_sql("primary", [5], ["query_name"], ["target", "random", "same_source"]), _cells_sql("primary", [5], ["placebo"], ["target"]), _cells_sql("primary", [0], ["query_name"], ["target"])))
_CORE = _cells_sql("core", list(range(12)), ["query_name"], ["target"])


@query(f"""WITH pc AS ({_PRIMARY}), cc AS ({_CORE}), f AS (SELECT layer, span, direction, control FROM cc UNION {_CELLS_OF.format(n="1 AS k", layers=[5], spans=["declaration_name", "placebo"], controls=["target"]).replace("SELECT 1 AS k, ", "SELECT ")}
 UNION {_CELLS_OF.format(n="1 AS k", layers=[5], spans=["query_name", "declaration_name"], controls=["random", "same_source"]).replace("SELECT 1 AS k, ", "SELECT ")}),
fp AS ({_cells_sql("fp32", [2, 5, 7], ["query_name"], ["target", "random"])} UNION {_cells_sql("fp32", [2, 5, 7], ["placebo"], ["target"])})
SELECT schedule, layer::INT AS layer, span, direction, control FROM (SELECT * FROM pc UNION ALL SELECT * FROM cc UNION ALL SELECT * FROM fp
 UNION ALL SELECT 'expanded', * FROM (SELECT * FROM f EXCEPT SELECT layer, span, direction, control FROM pc EXCEPT SELECT layer, span, direction, control FROM cc))""")
def schedules(spark, d):
    """The primary, core, expanded and fp32 schedules of a model with 12 layers, probed at layer 5."""
    out = None
    for name in ("primary", "core", "expanded", "fp32"):
        part = Q.schedule(spark, name, 12, 5, frozen=[2, 5, 7]).select(F.lit(name).alias("schedule"), "layer", "span", "direction", "control")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH k AS (SELECT label, list_slice(list(i ORDER BY abs(m) DESC, i), 1, 8) AS top FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY label)
SELECT a.label AS a, b.label AS b, round(len(list_intersect(a.top, b.top))::DOUBLE / (16 - len(list_intersect(a.top, b.top))), 9) AS jaccard, round(8.0::DOUBLE / (2 * 64 - 8), 9) AS expected FROM k a JOIN k b ON a.label < b.label""")
def topk_overlap_against_chance(spark, d):
    """Overlap of the labels' strongest dimensions, and what k of d drawn at random share."""
    means = V.mean_vector(table(spark, d, "embeddings"), ["label"], "embedding").select("label", V.top_dimensions(F.col("embedding"), 8).alias("top"))
    a, b = means.alias("a"), means.alias("b")
    both = a.join(b, F.col("a.label") < F.col("b.label"))
    return both.select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.round(V.jaccard(F.col("a.top"), F.col("b.top")), 9).alias("jaccard"), F.round(V.chance_overlap(8, 64), 9).alias("expected"))


# --- statistics ---------------------------------------------------------------------------------------


@query("SELECT event_type, round(avg(value), 8) AS mean, round(stddev_pop(value), 7) AS std, count(value) AS n FROM events GROUP BY 1")
def seed_statistics(spark, d):
    return U.seed_stats(table(spark, d, "events"), ["event_type"], "value").withColumn("mean", F.round("mean", 8)).withColumn("std", F.round("std", 7))


@query("SELECT l_returnflag, trunc(quantile_cont(l_linenumber, 0.5))::INT AS selected_layer FROM lineitem GROUP BY 1")
def median_layer(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(U.median_int(F.col("l_linenumber")).alias("selected_layer"))


@query("""SELECT event_type, count(v) AS n, round(quantile_cont(v, 0.25), 8) AS q25, round(quantile_cont(v, 0.5), 8) AS median, round(quantile_cont(v, 0.75), 8) AS q75, round(avg((v < 5)::INT), 9) AS frac_below_floor, round(avg((v < 0)::INT), 9) AS frac_negative
 FROM (SELECT event_type, value - 10 AS v FROM events) GROUP BY 1""")
def value_distribution(spark, d):
    out = U.distribution(table(spark, d, "events").withColumn("v", F.col("value") - 10), ["event_type"], "v", 5.0)
    return out.select("event_type", "n", *(F.round(c, 8).alias(c) for c in ("q25", "median", "q75")), F.round("frac_below_floor", 9).alias("frac_below_floor"), F.round("frac_negative", 9).alias("frac_negative"))


_LAYERS = """ly AS (SELECT l_linenumber AS layer, l_quantity AS clean, CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE l_extendedprice / 4000 END AS changed, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity - l_tax * 20 END AS position FROM lineitem)"""


def _layers(spark, d):
    li = table(spark, d, "lineitem")
    changed = F.when(F.col("l_partkey") % 50 == 0, F.lit(None)).otherwise(F.col("l_extendedprice") / 4000)
    return li.select("l_returnflag", F.col("l_linenumber").alias("layer"), F.col("l_quantity").alias("clean"), changed.alias("changed"), F.when(F.col("l_returnflag") == "R", F.lit(None)).otherwise(F.col("l_quantity") - F.col("l_tax") * 20).alias("position"))


@query(f"""WITH {_LAYERS} SELECT layer, count(*) AS n, round(avg(clean), 7) AS clean_mean, round(avg(changed), 7) AS changed_mean, round(avg((clean - changed) / clean), 7) AS effect_mean, round(quantile_cont((clean - changed) / clean, 0.5), 7) AS effect_median,
 round(avg(clean - changed), 7) AS lost_mean, round(quantile_cont(clean - changed, 0.5), 7) AS lost_median, round(avg(position), 7) AS position_mean, count(position) AS position_n, round(avg(clean - position), 7) AS position_lost,
 round(CASE WHEN abs(avg(clean - position)) > 1e-9 THEN avg(clean - changed) / avg(clean - position) END, 6) AS position_ratio FROM ly GROUP BY layer""")
def layer_effects(spark, d):
    out = U.layer_effects(_layers(spark, d), "layer", "clean", "changed", ["position"])
    return out.select(*(F.round(c, 6 if c.endswith("ratio") else 7).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("SELECT doc_id, greatest(CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars / 7.0::DOUBLE END, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars / 9.0::DOUBLE END) AS best FROM documents")
def best_of_columns(spark, d):
    """The larger of two figures of which either may be NaN or missing."""
    x = F.col("n_chars").cast("double")
    return table(spark, d, "documents").select("doc_id", U.best_of(F.when(F.col("doc_id") % 5 == 0, float("nan")).otherwise(x / 7), F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(x / 9)).alias("best"))


@query("SELECT count(*) AS rows, count(DISTINCT doc_id) AS doc_id, count(DISTINCT source) AS source, count(DISTINCT lang) AS lang FROM documents")
def distinct_counts(spark, d):
    found = U.unique_counts(table(spark, d, "documents"), ["doc_id", "source", "lang"], "doc_id")
    return spark.createDataFrame([(found["rows"], found["doc_id"], found["source"], found["lang"])], "rows long, doc_id long, source long, lang long")


@query("""SELECT l_returnflag, round((sum(w*x*y) - sum(w*x)*sum(w*y)/sum(w)) / sqrt((sum(w*x*x) - sum(w*x)*sum(w*x)/sum(w)) * (sum(w*y*y) - sum(w*y)*sum(w*y)/sum(w))), 7) AS agreement,
 round(sum(CASE WHEN sign(x) <> sign(y) THEN w ELSE 0 END) / sum(w), 8) AS sign_disagreement, count(*) FILTER (w > 0) AS compared
 FROM (SELECT l_returnflag, l_quantity AS w, l_discount - 0.05 AS x, l_tax * l_linenumber - 0.1 AS y FROM lineitem) GROUP BY 1""")
def weighted_agreement(spark, d):
    rows = table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("w"), (F.col("l_discount") - 0.05).alias("x"), (F.col("l_tax") * F.col("l_linenumber") - 0.1).alias("y"))
    out = U.weighted_agreement(rows, "x", "y", "w", ["l_returnflag"])
    return out.withColumn("agreement", F.round("agreement", 7)).withColumn("sign_disagreement", F.round("sign_disagreement", 8))


_MASS = "mf AS (SELECT l_shipmode AS c, abs(x) * a AS ms, abs(x) * b AS mt, b FROM (SELECT 'c' || l_linenumber AS l_shipmode, l_discount - 0.03 AS x, l_quantity AS a, CASE WHEN l_tax > 0.04 THEN 0 ELSE l_quantity / 2 END AS b FROM lineitem))"


@query(f"WITH {_MASS} SELECT round(sum(mt) / sum(ms), 8) AS surviving_mass, count(*) AS features, count(*) FILTER (b = 0) AS absent FROM mf")
def surviving_mass(spark, d):
    return U.surviving_mass(_features(spark, d), "x", "a", "b").withColumn("surviving_mass", F.round("surviving_mass", 8))


def _features(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.concat(F.lit("c"), "l_linenumber").alias("c"), (F.col("l_discount") - 0.03).alias("x"), F.col("l_quantity").alias("a"), F.when(F.col("l_tax") > 0.04, 0.0).otherwise(F.col("l_quantity") / 2).alias("b"))


@query(f"""WITH {_MASS}, g AS (SELECT c AS class, count(*) AS n, sum(ms) AS s, sum(mt) AS t FROM mf GROUP BY 1)
SELECT class, n, round(s, 5) AS mass_source, round(t, 5) AS mass_target, round(t / s, 8) AS retained, round((s - t) / sum(s - t) OVER (), 8) AS share_of_lost FROM g""")
def mass_by_class(spark, d):
    out = U.mass_by_class(_features(spark, d), F.col("c"), "x", "a", "b", top=1 << 30)
    return out.select("class", "n", F.round("mass_source", 5).alias("mass_source"), F.round("mass_target", 5).alias("mass_target"), F.round("retained", 8).alias("retained"), F.round("share_of_lost", 8).alias("share_of_lost"))


@query("SELECT l_returnflag, arg_max(k, (f, k)) AS family, round(max(f), 8) AS score FROM (SELECT l_returnflag, 'm' || l_linenumber AS k, round(avg(l_tax), 4) AS f FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def strongest_baseline(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_returnflag", F.concat(F.lit("m"), "l_linenumber").alias("family")).agg(F.round(F.avg("l_tax"), 4).alias("score"))
    return U.strongest(rows, ["l_returnflag"], "family", "score")


# --- intervals --------------------------------------------------------------------------------------

_CONF = "count(*) FILTER (y_true = 0 AND yp = 0) AS tn, count(*) FILTER (y_true = 0 AND yp = 1) AS fp, count(*) FILTER (y_true = 1 AND yp = 0) AS fn, count(*) FILTER (y_true = 1 AND yp = 1) AS tp"


def _draws_sql(clusters: str, n: int) -> str:
    """SQL of the draw table w (b, k, times) and the numbered clusters k, from a relation of distinct ``cluster``."""
    return f"""k AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS k FROM (SELECT DISTINCT cluster FROM {clusters})),
w AS (SELECT b, ('0x' || substr(sha1(b || ':' || j), 1, 8))::BIGINT % (SELECT count(*) FROM k) + 1 AS k, count(*) AS times FROM range({n}) t(b), range((SELECT count(*) FROM k)) u(j) GROUP BY 1, 2)"""


_WEIGHTED = "sum(tn * times)::DOUBLE AS tn, sum(fp * times)::DOUBLE AS fp, sum(fn * times)::DOUBLE AS fn, sum(tp * times)::DOUBLE AS tp"
_SUMMED = "sum(tn)::DOUBLE AS tn, sum(fp)::DOUBLE AS fp, sum(fn)::DOUBLE AS fn, sum(tp)::DOUBLE AS tp"


@query(f"""WITH {_PRED}, q AS (SELECT cluster, y_true, unnest([0, 1]) AS seed, unnest([y_pred, y_other]) AS yp FROM p), c AS (SELECT cluster, seed, {_CONF} FROM q GROUP BY 1, 2), {_draws_sql("p", 200)},
b AS (SELECT b, avg({_F1}) AS f FROM (SELECT b, seed, {_WEIGHTED} FROM c JOIN k USING (cluster) JOIN w USING (k) GROUP BY b, seed) GROUP BY b), o AS (SELECT avg({_F1}) AS f, count(*) AS n FROM (SELECT seed, {_SUMMED} FROM c GROUP BY seed))
SELECT round((SELECT f FROM o), 9) AS macro_f1, (SELECT n FROM o) AS n_seeds, round(quantile_cont(f, 0.025), 9) AS lo, round(quantile_cont(f, 0.975), 9) AS hi, count(*) AS n_boot FROM b""")
def seed_averaged_ci(spark, d):
    """Two predictors as two seeds of one cell."""
    p = predictions(spark, d).select("cluster", "y_true", F.posexplode(F.array("y_pred", "y_other")).alias("seed", "yp"))
    cells = M.confusion_by(p, ["cluster", "seed"], p="yp")
    out = U.seed_averaged(cells, B.draws(cells, "cluster", 200), "cluster", "seed", [])
    return out.select(F.round("macro_f1", 9).alias("macro_f1"), "n_seeds", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n_boot")


def _condition_cells(spark, d):
    """Confusion counts by source, condition (three predictors), side of the boundary and language."""
    p = predictions(spark, d)
    named = F.array(*(F.struct(F.lit(n).alias("condition"), c.alias("yp")) for n, c in (("span_trained", F.col("y_pred")), ("context_trained", F.col("y_other")), ("context_untrained", (F.col("doc_id") % 2).cast("int")))))
    rows = p.withColumn("side", F.when(F.col("lang").isin("en", "de"), "near").otherwise("far")).select("cluster", "lang", "side", "y_true", F.explode(named).alias("c")).select("cluster", "lang", "side", "y_true", "c.*")
    return M.confusion_by(rows, ["cluster", "condition", "side", "lang"], p="yp")


_CONDITIONS = f"""q AS (SELECT cluster, lang, CASE WHEN lang IN ('en', 'de') THEN 'near' ELSE 'far' END AS side, y_true, unnest(['span_trained', 'context_trained', 'context_untrained']) AS condition, unnest([y_pred, y_other, (doc_id % 2)::INT]) AS yp FROM p),
c AS (SELECT cluster, condition, side, lang, {_CONF} FROM q GROUP BY ALL)"""
_TERMS = " UNION ALL ".join(f"SELECT '{name}' AS estimand, '{c}' AS condition, '{g}' AS side, {s} AS sign" for name, terms in U.CONTRASTS.items() for c, g, s in terms)


@query(f"""WITH {_PRED}, {_CONDITIONS}, {_draws_sql("p", 100)}, terms AS ({_TERMS}),
nc AS (SELECT condition, side, count(DISTINCT lang) AS nc FROM c GROUP BY ALL),
r AS (SELECT b, condition, side, sum({_F1}) / any_value(nc) AS f FROM (SELECT b, condition, side, lang, {_WEIGHTED} FROM c JOIN k USING (cluster) JOIN w USING (k) GROUP BY ALL) JOIN nc USING (condition, side) GROUP BY b, condition, side),
o AS (SELECT condition, side, avg({_F1}) AS f FROM (SELECT condition, side, lang, {_SUMMED} FROM c GROUP BY ALL) GROUP BY ALL),
e AS (SELECT estimand, g.b, sum(sign * coalesce(f, 0)) AS v FROM (SELECT unnest(range(100)) AS b) g CROSS JOIN terms LEFT JOIN r ON r.b = g.b AND r.condition = terms.condition AND r.side = terms.side GROUP BY ALL), x AS (SELECT estimand, sum(sign * f) AS v FROM o JOIN terms USING (condition, side) GROUP BY ALL)
SELECT e.estimand, round(any_value(x.v), 9) AS estimate, round(quantile_cont(e.v, 0.025), 9) AS lo, round(quantile_cont(e.v, 0.975), 9) AS hi, count(*) AS n_boot FROM e JOIN x USING (estimand) GROUP BY 1""")
def boundary_contrasts(spark, d):
    """The seven estimands on shared draws of sources."""
    cells = _condition_cells(spark, d)
    out = U.contrasts(cells, B.draws(cells, "cluster", 100), "cluster", "condition", "side", ["lang"])
    return out.select("estimand", *(F.round(c, 9).alias(c) for c in ("estimate", "lo", "hi")), "n_boot")


@query(f"""WITH {_PRED}, {_CONDITIONS}, {_draws_sql("p", 100)}, r AS (SELECT b, avg(f) FILTER (side = 'far') - avg(f) FILTER (side = 'near') AS v FROM (SELECT b, side, {_F1} AS f FROM (SELECT b, side, lang, condition, {_WEIGHTED} FROM c JOIN k USING (cluster) JOIN w USING (k) GROUP BY ALL)) GROUP BY b),
o AS (SELECT avg(f) FILTER (side = 'far') - avg(f) FILTER (side = 'near') AS v FROM (SELECT side, {_F1} AS f FROM (SELECT side, lang, condition, {_SUMMED} FROM c GROUP BY ALL)))
SELECT 'boundary' AS estimand, round((SELECT v FROM o), 9) AS estimate, round(quantile_cont(v, 0.025), 9) AS lo, round(quantile_cont(v, 0.975), 9) AS hi, count(v) AS n_boot FROM r""")
def boundary_effect(spark, d):
    """Far cells less near ones, every condition and language a cell."""
    cells = _condition_cells(spark, d).withColumn("all", F.lit("all"))
    one = {"boundary": (("all", "far", 1), ("all", "near", -1))}
    out = U.contrasts(cells, B.draws(cells, "cluster", 100), "cluster", "all", "side", ["lang", "condition"], one, absent_is_zero=False)
    return out.select("estimand", *(F.round(c, 9).alias(c) for c in ("estimate", "lo", "hi")), "n_boot")


@query(f"""WITH ev AS (SELECT user_id % 25 AS cluster, value AS e, value - 15.0::DOUBLE AS g FROM events WHERE event_type = 'view'), c AS (SELECT cluster, sum(e) AS e, sum(g) AS g, count(*) AS n FROM ev GROUP BY 1), {_draws_sql("ev", 200)},
b AS (SELECT b, sum(e * times) AS e, sum(g * times) AS g, sum(n * times) AS n FROM c JOIN k USING (cluster) JOIN w USING (k) GROUP BY b)
SELECT round((SELECT sum(e) / sum(g) FROM c), 7) AS point, round(quantile_cont(e / g, 0.025), 7) AS lo, round(quantile_cont(e / g, 0.975), 7) AS hi, (SELECT count(*) FROM c) AS n_clusters, (SELECT count(*) < 30 FROM c) AS few_clusters, min(g / n) <= 0 AND max(g / n) >= 0 AS denominator_crosses_zero FROM b""")
def clustered_ratio(spark, d):
    e = table(spark, d, "events").filter("event_type = 'view'").select((F.col("user_id") % 25).alias("cluster"), F.col("value").alias("e"), (F.col("value") - 15).alias("g"))
    out = U.ratio_interval(e, "e", "g", "cluster", 200)
    return out.select(*(F.round(c, 7).alias(c) for c in ("point", "lo", "hi")), "n_clusters", "few_clusters", "denominator_crosses_zero")


@query(f"""WITH ev AS (SELECT user_id % 25 AS cluster, value AS x, user_id AS y FROM events WHERE event_type = 'signup'), {_draws_sql("ev", 20)},
t AS (SELECT b, x, y FROM ev JOIN k USING (cluster) JOIN w USING (k), range(times) UNION ALL SELECT -1, x, y FROM ev),
r AS (SELECT b, rank() OVER (PARTITION BY b ORDER BY x) + (count(*) OVER (PARTITION BY b, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY b ORDER BY y) + (count(*) OVER (PARTITION BY b, y) - 1) / 2.0::DOUBLE AS ry FROM t),
c AS (SELECT b, corr(rx, ry) AS rho FROM r GROUP BY b) SELECT round(max(rho) FILTER (b = -1), 7) AS point, round(quantile_cont(rho, 0.025) FILTER (b >= 0), 7) AS lo, round(quantile_cont(rho, 0.975) FILTER (b >= 0), 7) AS hi, count(*) FILTER (b >= 0) AS n_boot FROM c""")
def clustered_spearman(spark, d):
    e = table(spark, d, "events").filter("event_type = 'signup'").withColumn("cluster", F.col("user_id") % 25)
    out = U.spearman_interval(e, "value", "user_id", "cluster", 20)
    return out.select(*(F.round(c, 7).alias(c) for c in ("point", "lo", "hi")), "n_boot")


@query(f"""WITH {_PRED}, s AS (SELECT lang, {_CONF.replace("yp", "y_pred")} FROM p GROUP BY lang), t AS (SELECT lang, {_CONF.replace("yp", "y_other")} FROM p GROUP BY lang)
SELECT lang, round(s.f - t.f, 9) AS selectivity FROM (SELECT lang, {_F1} AS f FROM s) s JOIN (SELECT lang, {_F1} AS f FROM t) t USING (lang)""")
def selectivity(spark, d):
    """What a predictor's macro F1 exceeds its control's by."""
    p = predictions(spark, d)
    f = M.macro_f1_binary(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))
    score = lambda col, name: M.confusion_by(p, ["lang"], p=col).select("lang", f.alias(name))
    return score("y_pred", "a").join(score("y_other", "b"), "lang").select("lang", F.round(F.col("a") - F.col("b"), 9).alias("selectivity"))


# --- shards and subspaces --------------------------------------------------------------------------


@query("""WITH e AS (SELECT vec_id % 4 AS layer, label, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS t, len(embedding) AS d FROM embeddings)
SELECT layer::INT AS layer, label::VARCHAR AS label, count(*) AS n, sum(d)::BIGINT AS entries, round(sum(t), 4) AS total FROM e WHERE layer IN (1, 3) GROUP BY 1, 2""")
def activation_shards(spark, d):
    """The vectors written as shards of four layers and two of them read again, by layer and label."""
    path = shared_path(spark, "shards")
    i = F.col("vec_id")
    rows = table(spark, d, "embeddings").select(i.cast("string").alias("occurrence_id"), (i % 7).cast("string").alias("problem_id"), F.col("label").cast("string").alias("label"), F.lit(None).cast("string").alias("variable"), F.lit(None).cast("string").alias("function"), (i % 4).cast("int").alias("layer"), F.col("embedding").alias("vec"))
    shards.write_shards(rows, path, {"model_id": "embeddings"}, store_rows=512)
    back = shards.read_shards(spark, path, [1, 3])
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return back.groupBy("layer", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("vec")).alias("entries"), F.round(F.sum(total), 4).alias("total"))


@query("""WITH e AS (SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), m AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS c, covar_samp(x, y) AS b FROM e GROUP BY label)
SELECT label, n, round(mx, 7) AS x, round(my, 7) AS y, round(4 * sqrt((a + c) / 2 + sqrt(((a - c) / 2) ^ 2 + b * b)), 7) AS width, round(4 * sqrt((a + c) / 2 - sqrt(((a - c) / 2) ^ 2 + b * b)), 7) AS height, round(degrees(atan2(2 * b, a - c) / 2), 5) AS degrees FROM m""")
def class_ellipses(spark, d):
    """The two-sigma ellipse of each label's vectors in their first two dimensions."""
    rows = table(spark, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    out = K.covariance_ellipses(rows, "x", "y", ["label"])
    return out.select("label", "n", *(F.round(c, 7).alias(c) for c in ("x", "y", "width", "height")), F.round("degrees", 5).alias("degrees"))


@query()
def class_subspace_angles(spark, d):
    """Angles between the principal subspaces of label 0 and those of the others (tests hold them against SVDs)."""
    return K.subspace_angles(table(spark, d, "embeddings"), "embedding", "label", 0, [1, 5, 10])


# --- scopes and published tables ------------------------------------------------------------------------


@query("""WITH r AS (SELECT l_returnflag, l_linestatus, l_linenumber AS layer, l_suppkey % 35 AS cluster, l_tax AS effect, l_discount + 0.1 AS gap, 'n' || l_partkey % 6 AS name FROM lineitem),
p AS (SELECT l_returnflag, l_linestatus, layer, name, sum(effect) AS e, count(*) AS k FROM r GROUP BY ALL), l AS (SELECT l_returnflag, l_linestatus, layer, (sum(e) OVER o - e) / (sum(k) OVER o - k) AS m FROM p WINDOW o AS (PARTITION BY l_returnflag, l_linestatus, layer)),
s AS (SELECT l_returnflag, l_linestatus, layer, min(m) AS lowest, max(m) AS highest FROM l GROUP BY ALL)
SELECT r.l_returnflag, r.l_linestatus, r.layer, count(*) AS n, count(DISTINCT cluster) AS n_clusters, round(avg(effect), 8) AS mean_effect, round(avg(effect) / avg(gap), 7) AS recovery, count(DISTINCT cluster) < 30 AS few_clusters,
 round(any_value(s.lowest), 8) AS lowest_without_one, round(any_value(s.highest), 8) AS highest_without_one FROM r JOIN s ON r.l_returnflag = s.l_returnflag AND r.l_linestatus = s.l_linestatus AND r.layer = s.layer GROUP BY ALL""")
def scope_summaries(spark, d):
    li = table(spark, d, "lineitem")
    rows = li.select("l_returnflag", "l_linestatus", F.col("l_linenumber").alias("layer"), (F.col("l_suppkey") % 35).alias("cluster"), F.col("l_tax").alias("effect"), (F.col("l_discount") + 0.1).alias("gap"), F.concat(F.lit("n"), F.col("l_partkey") % 6).alias("name"))
    out = U.scope_summaries(rows, ["l_returnflag", "l_linestatus"], ["layer"], "effect", "cluster", "gap", "name")
    return out.select(*(F.round(c, 7 if c == "recovery" else 8).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query("""WITH p AS (SELECT l_returnflag, l_orderkey, max(l_tax) FILTER (l_linenumber = 1) AS a, max(l_tax) FILTER (l_linenumber = 2) AS b, count(*) FILTER (l_linenumber = 1) AS na, count(*) FILTER (l_linenumber = 2) AS nb FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS n, round(avg(a - b), 8) AS minus FROM p WHERE na = 1 AND nb = 1 GROUP BY 1""")
def effect_minus_control(spark, d):
    rows = table(spark, d, "lineitem").withColumn("control", F.when(F.col("l_linenumber") == 1, "target").when(F.col("l_linenumber") == 2, "placebo"))
    return U.minus_control(rows, "l_orderkey", ["l_returnflag"], "control", "l_tax", "target", "placebo").withColumn("minus", F.round("minus", 8))


@query("""WITH p AS (SELECT l_orderkey AS pair, {cols} FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_linenumber = 1) = 1 AND count(*) FILTER (l_linenumber = 2) = 1)
SELECT pair, round(ds - dd, 8) AS probe_gap, round(((dp - dd) + (nd - np)) / 2, 8) AS symmetric_movement, round((de + ne) / 2, 6) AS symmetric_behavior FROM p""".replace(
    "{cols}",
    ", ".join(f"max({c}) FILTER (l_linenumber = {n}) AS {p}{k}" for n, p in ((1, "d"), (2, "n")) for k, c in (("s", "l_quantity"), ("d", "l_discount"), ("p", "l_tax"), ("e", "l_extendedprice"))),
))
def probe_link_table(spark, d):
    """Lines 1 and 2 of orders that have each once, as the two directions of a pair."""
    li = table(spark, d, "lineitem").withColumn("g", F.when(F.col("l_linenumber") == 1, "denoise").when(F.col("l_linenumber") == 2, "noise"))
    pairs = J.pair_counts(li.filter("g IS NOT NULL"), "l_orderkey", "g", ["denoise", "noise"]).filter("exact").select("l_orderkey")
    rows = li.join(pairs, "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("pair"), "g", F.col("l_quantity").alias("source"), F.col("l_discount").alias("destination"), F.col("l_tax").alias("patched"), F.col("l_extendedprice").alias("signed_effect"))
    out = U.probe_link(rows.filter("g = 'denoise'"), rows.filter("g = 'noise'"), "pair")
    return out.select("pair", F.round("probe_gap", 8).alias("probe_gap"), F.round("symmetric_movement", 8).alias("symmetric_movement"), F.round("symmetric_behavior", 6).alias("symmetric_behavior"))


@query(f"""WITH {_PRED}, s AS (SELECT lang, {_CONF.replace("yp", "y_pred")} FROM p GROUP BY lang), t AS (SELECT lang, {_CONF.replace("yp", "y_other")} FROM p GROUP BY lang), n AS (SELECT lang, min(c) AS a, max(c) AS b FROM (SELECT lang, y_true, count(*) AS c FROM p GROUP BY 1, 2) GROUP BY lang),
x AS (SELECT lang, s.f, t.f AS g, 1 - ((2.0::DOUBLE*(a-1))/(2.0::DOUBLE*(a-1)+1) + (2.0::DOUBLE*b)/(2.0::DOUBLE*b+1))/2 AS rho FROM (SELECT lang, {_F1} AS f FROM s) s JOIN (SELECT lang, {_F1} AS f FROM t) t USING (lang) JOIN n USING (lang))
SELECT lang, round(f, 8) AS macro_f1, round(g, 8) AS best_baseline, round(rho, 8) AS rho, round(f - g, 8) AS probe_minus_baseline, round((f - g) / rho, 4) AS in_rho_units, abs(f - g) < rho AS below_resolution FROM x""")
def probe_export(spark, d):
    """A published row a language: macro F1, baseline and their difference in steps of the resolution."""
    p = predictions(spark, d)
    f = M.macro_f1_binary(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))
    n = p.groupBy("lang", "y_true").count().groupBy("lang").agg(F.min("count").alias("small"), F.max("count").alias("big"))
    score = lambda col, name: M.confusion_by(p, ["lang"], p=col).select("lang", f.alias(name))
    out = R.probe_rows(score("y_pred", "f1").join(score("y_other", "line_masked"), "lang").join(n, "lang"), ["lang"], "f1", ["line_masked"], "small", "big")
    return out.select("lang", *(F.round(c, 8).alias(c) for c in ("macro_f1", "best_baseline", "rho", "probe_minus_baseline")), F.round("in_rho_units", 4).alias("in_rho_units"), "below_resolution")


@query("""WITH y AS (SELECT l_returnflag, l_linenumber AS layer, round(avg(l_quantity), 4) AS clean, round(avg(l_extendedprice) / 1500, 4) AS changed, round(avg(l_quantity - l_tax * 100), 4) AS control FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, abs(clean - changed) AS dd, CASE WHEN abs(clean - control) >= 1e-9 THEN abs(clean - changed) / abs(clean - control) END AS sp FROM y)
SELECT l_returnflag, arg_max(layer, (dd, -layer)) AS peak_layer, round(arg_max(sp, (dd, -layer)), 6) AS peak_specificity, arg_max(layer, (sp, layer)) AS best_layer, round(max(sp), 6) AS best_specificity FROM s GROUP BY 1""")
def causal_export(spark, d):
    """Specificity at the layer of the largest effect, and the best of all layers."""
    y = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("layer")).agg(
        F.round(F.avg("l_quantity"), 4).alias("clean"), F.round(F.avg("l_extendedprice") / 1500, 4).alias("changed"), F.round(F.avg(F.col("l_quantity") - F.col("l_tax") * 100), 4).alias("control")
    )
    out = R.causal_rows(y, ["l_returnflag"], "layer", "clean", "changed", "control")
    return out.withColumn("peak_specificity", F.round("peak_specificity", 6)).withColumn("best_specificity", F.round("best_specificity", 6))


@query("""SELECT event_type AS role, user_id % 3 AS target, round(avg(value) FILTER (event_id % 4 = 0), 8) AS original, round(avg(value) FILTER (event_id % 4 = 1), 8) AS "C1", round(avg(value) FILTER (event_id % 4 = 2), 8) AS "C2", round(avg(value) FILTER (event_id % 4 = 3), 8) AS "C4" FROM events GROUP BY 1, 2""")
def renaming_pivot(spark, d):
    """A row for each role and target, a column for each renaming condition."""
    name = F.element_at(F.array(*(F.lit(c) for c in ("original", "C1", "C2", "C4"))), (F.col("event_id") % 4 + 1).cast("int"))
    cells = table(spark, d, "events").groupBy(F.col("event_type").alias("role"), (F.col("user_id") % 3).alias("target"), name.alias("condition")).agg(F.round(F.avg("value"), 8).alias("f1"))
    return R.pivoted(cells, ["role", "target"], "condition", ["original", "C1", "C2", "C4"], "f1")


@query("""WITH c AS (SELECT 'probe' AS condition, lang, source, avg(n_chars) AS v FROM documents GROUP BY ALL UNION ALL SELECT 'surface', lang, source, max(n_chars) FROM documents GROUP BY ALL)
SELECT condition, round(avg(v) FILTER (lang IN ('en', 'de')), 6) AS near, round(avg(v) FILTER (lang NOT IN ('en', 'de')), 6) AS far, count(*) AS n, round(avg(v) FILTER (lang NOT IN ('en', 'de')) - avg(v) FILTER (lang IN ('en', 'de')), 6) AS effect FROM c GROUP BY 1""")
def condition_table(spark, d):
    """Cells of two conditions in one table, and their means on either side of the boundary."""
    docs = table(spark, d, "documents")
    cell = lambda name, agg: docs.groupBy("lang", "source").agg(agg.cast("double").alias("v")).withColumn("condition", F.lit(name))
    both = cell("probe", F.avg("n_chars")).unionByName(cell("surface", F.max("n_chars")))
    out = R.condition_effects(both, "condition", "v", ~F.col("lang").isin("en", "de"))
    return out.select("condition", F.round("near", 6).alias("near"), F.round("far", 6).alias("far"), "n", F.round("effect", 6).alias("effect"))


@query(f"""WITH {_PRED}, c AS (SELECT cluster, lang, {_CONF.replace("yp", "y_pred")} FROM p GROUP BY ALL), e AS (SELECT cluster, lang, {_CONF.replace("yp", "y_other")} FROM p GROUP BY ALL), {_draws_sql("p", 100)},
ra AS (SELECT b, lang, {_F1} AS f FROM (SELECT b, lang, {_WEIGHTED} FROM c JOIN k USING (cluster) JOIN w USING (k) GROUP BY ALL)), rb AS (SELECT b, lang, {_F1} AS f FROM (SELECT b, lang, {_WEIGHTED} FROM e JOIN k USING (cluster) JOIN w USING (k) GROUP BY ALL))
SELECT lang, round(quantile_cont(ra.f - rb.f, 0.025), 9) AS lo, round(quantile_cont(ra.f - rb.f, 0.975), 9) AS hi, count(*) AS n_boot, quantile_cont(ra.f - rb.f, 0.025) > 0 OR quantile_cont(ra.f - rb.f, 0.975) < 0 AS excludes_zero FROM ra JOIN rb USING (b, lang) GROUP BY lang""")
def paired_delta_table(spark, d):
    """A paired interval for each cell."""
    p = predictions(spark, d)
    both = M.confusion_by(p, ["cluster", "lang"]).withColumn("m", F.lit("a")).unionByName(M.confusion_by(p, ["cluster", "lang"], p="y_other").withColumn("m", F.lit("b")))
    f = M.macro_f1_binary(*(F.col(x) for x in ("tp", "fp", "fn", "tn")))
    boot = B.replicates(both, B.draws(p, "cluster", 100), "cluster", SUMS, ["m", "lang"]).withColumn("f", f)
    wide = boot.groupBy("replicate", "lang").agg((F.max(F.when(F.col("m") == "a", F.col("f"))) - F.max(F.when(F.col("m") == "b", F.col("f")))).alias("delta"))
    ci = B.percentile_interval(wide, ["lang"], F.col("delta"))
    return ci.select("lang", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n_boot", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))


_SLICES = """em AS (SELECT label, (i - 1) // 16 AS layer, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL),
co AS (SELECT a.label, a.layer, sum(a.m * b.m) / (sqrt(sum(a.m * a.m)) * sqrt(sum(b.m * b.m))) AS c FROM em a JOIN em b ON a.i = b.i AND b.label = 0 WHERE a.label <> 0 GROUP BY ALL)"""


def _layer_cosines(spark, d):
    """Cosine of each label's mean with that of label 0, by block of 16 dimensions."""
    means = V.mean_vector(table(spark, d, "embeddings"), ["label"], "embedding")
    cut = means.select("label", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, F.lit(16)))).alias("layer", "v"))
    base = cut.filter("label = 0").select("layer", F.col("v").alias("w"))
    return cut.filter("label <> 0").join(F.broadcast(base), "layer").select("label", "layer", F.round(V.cosine(F.col("v"), F.col("w")), 7).alias("cosine"))


@query(f"WITH {_SLICES} SELECT label, " + ", ".join(f"round(max(c) FILTER (layer = {i}), 7) AS layer_{i}" for i in range(4)) + " FROM co GROUP BY label")
def strategy_layer_pivot(spark, d):
    return R.pivoted(_layer_cosines(spark, d), ["label"], "layer", [0, 1, 2, 3], "cosine", "layer_")


@query(f"WITH {_SLICES} SELECT label, layer::INT AS layer, round(c, 7) AS cosine FROM co")
def layer_series(spark, d):
    """The wide table's layer columns as rows again."""
    return R.unpivoted(strategy_layer_pivot(spark, d), ["label"], "layer_", "layer", "cosine")


@query("""WITH u AS (SELECT DISTINCT event_type, user_id FROM events), s AS (SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type <> b.event_type GROUP BY 1, 2)
SELECT t AS name, """ + ", ".join(f"CASE WHEN t <> '{t}' THEN coalesce((SELECT n FROM s WHERE a = t AND b = '{t}'), 0) END AS {t}" for t in ("click", "purchase", "view")) + " FROM (SELECT unnest(['click', 'purchase', 'view']) AS t)")  # fmt: skip
def overlap_matrix(spark, d):
    """Users that two kinds of events share, as a matrix."""
    u = table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase", "view")).select("event_type", "user_id").distinct()
    a, b = u.alias("a"), u.alias("b")
    pairs = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.event_type") < F.col("b.event_type"))).groupBy(F.col("a.event_type").alias("x"), F.col("b.event_type").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return R.symmetric_matrix(pairs, "x", "y", "n", ["click", "purchase", "view"])
