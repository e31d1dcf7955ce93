"""Registry of the engine's queries on the driver's tables and of the SQL each is checked against.

Documents stand for programs (doc_id: problem, lang: language, source: repository), labels for gold
classes with a rule on length as the prediction, conversations for occurrences (conv_id: program,
turn: position), embeddings for activations, events for runs and orders for paired cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexiprobe.functions import text as X
from lexiprobe.functions import vectors as V
from lexiprobe.operators import bootstrap as B
from lexiprobe.operators import joins as J
from lexiprobe.operators import metrics as M
from lexiprobe.operators import occurrences as O
from lexiprobe.operators import splits as S
from lexiprobe.plans import prompts as P
from lexiprobe.plans import schedules as Q
from lexiprobe.session import shared_path
from lexiprobe.streaming import store as I

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from lexiprobe import result_queries  # noqa: F401 - adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_f1_cluster_ci(spark, sf_dir)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- predictions, metrics, intervals ----------------------------------------------------------------


def predictions(spark, d) -> DataFrame:
    """doc_id, lang, cluster (source), y_true, two predictions by length and the score behind them."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.select("doc_id", "lang", F.col("source").alias("cluster"), "n_chars").join(labels, "doc_id")
    return rows.select(
        "doc_id", "lang", "cluster", "n_chars", F.col("quality").alias("y_true"), (F.col("n_chars") >= 800).cast("int").alias("y_pred"),
        (F.col("n_chars") % 3 > 0).cast("int").alias("y_other"),
    )


_PRED = """p AS (SELECT d.doc_id, d.lang, d.source AS cluster, d.n_chars, l.quality AS y_true, (d.n_chars >= 800)::INT AS y_pred, (d.n_chars % 3 > 0)::INT AS y_other
 FROM documents d JOIN labels l USING (doc_id))"""
_CELLS = """c AS (SELECT cluster, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
 count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM p GROUP BY cluster)"""
_F1 = "((CASE WHEN 2*tp+fp+fn > 0 THEN 2.0::DOUBLE*tp/(2*tp+fp+fn) ELSE 0 END) + (CASE WHEN 2*tn+fp+fn > 0 THEN 2.0::DOUBLE*tn/(2*tn+fp+fn) ELSE 0 END)) / 2"
_DRAWS = """k AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS k FROM (SELECT DISTINCT cluster FROM p)),
w AS (SELECT b, ('0x' || substr(sha1(b || ':' || j), 1, 8))::BIGINT % (SELECT count(*) FROM k) + 1 AS k, count(*) AS times
 FROM range({n}) t(b), range((SELECT count(*) FROM k)) u(j) GROUP BY 1, 2)"""


def _sums(alias: str = "c") -> str:
    return ", ".join(f"sum({alias}.{x} * w.times)::DOUBLE AS {x}" for x in ("tn", "fp", "fn", "tp"))


def _f1() -> F.Column:
    return M.macro_f1_binary(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))


@query(f"""WITH {_PRED}, {_CELLS}, {_DRAWS.format(n=500)},
r AS (SELECT b, {_sums()} FROM c JOIN k USING (cluster) JOIN w USING (k) GROUP BY b),
o AS (SELECT {_F1} AS f FROM (SELECT sum(tn)::DOUBLE tn, sum(fp)::DOUBLE fp, sum(fn)::DOUBLE fn, sum(tp)::DOUBLE tp FROM c))
SELECT round((SELECT f FROM o), 9) AS macro_f1, round(quantile_cont({_F1}, 0.025), 9) AS lo, round(quantile_cont({_F1}, 0.975), 9) AS hi, count(*) AS n_boot,
 (SELECT count(*) FROM k) AS n_clusters FROM r""")
def macro_f1_cluster_ci(spark, d):
    """Macro F1 of the length rule with a percentile interval over 500 draws of whole sources."""
    cells = M.confusion_by(predictions(spark, d), ["cluster"]).persist()
    drawn = B.draws(cells, "cluster", 500)
    boot = B.replicates(cells, drawn, "cluster", ["tn", "fp", "fn", "tp"], [])
    ci = B.percentile_interval(boot.withColumn("one", F.lit(1)), ["one"], _f1())
    all_ = cells.agg(*(F.sum(x).alias(x) for x in ("tn", "fp", "fn", "tp")), F.count(F.lit(1)).alias("n_clusters"))
    return all_.crossJoin(F.broadcast(ci)).select(F.round(_f1(), 9).alias("macro_f1"), F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n_boot", "n_clusters")


@query(f"""WITH {_PRED}, {_CELLS.replace("c AS", "c0 AS")},
c AS (SELECT lang, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
 count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM p GROUP BY lang)
SELECT lang, tn, fp, fn, tp, round((tp + tn)::DOUBLE / (tp + fp + fn + tn), 9) AS accuracy, round({_F1}, 9) AS macro_f1 FROM c""")
def accuracy_confusion(spark, d):
    c = M.confusion_by(predictions(spark, d), ["lang"])
    return c.withColumn("accuracy", F.round(M.accuracy(*(F.col(x) for x in ("tp", "fp", "fn", "tn"))), 9)).withColumn("macro_f1", F.round(_f1(), 9))


@query(f"""WITH {_PRED}, t AS (SELECT lang, y_true AS label, count(*) AS support, count(*) FILTER (y_true = y_pred) AS tp FROM p GROUP BY 1, 2),
q AS (SELECT lang, y_pred AS label, count(*) AS predicted FROM p GROUP BY 1, 2)
SELECT lang, label, coalesce(support, 0) AS support, round(CASE WHEN coalesce(support,0)+coalesce(predicted,0) > 0 THEN 2.0::DOUBLE*coalesce(tp,0)/(coalesce(support,0)+coalesce(predicted,0)) ELSE 0 END, 9) AS f1
FROM t FULL JOIN q USING (lang, label)""")
def per_class_f1(spark, d):
    return M.per_class_f1(predictions(spark, d), ["lang"]).withColumn("f1", F.round("f1", 9))


@query(f"""WITH {_PRED}, n AS (SELECT lang, min(c) AS a, max(c) AS b FROM (SELECT lang, y_true, count(*) AS c FROM p GROUP BY 1, 2) GROUP BY lang)
SELECT lang, round(1 - ((2.0::DOUBLE*(a-1))/(2.0::DOUBLE*(a-1)+1) + (2.0::DOUBLE*b)/(2.0::DOUBLE*b+1))/2, 9) AS resolution FROM n""")
def resolution_rho(spark, d):
    n = predictions(spark, d).groupBy("lang", "y_true").count().groupBy("lang").agg(F.min("count").alias("a"), F.max("count").alias("b"))
    return n.select("lang", F.round(M.resolution(F.col("a"), F.col("b")), 9).alias("resolution"))


@query(f"""WITH {_PRED}, {_CELLS}, e AS (SELECT cluster, count(*) FILTER (y_true = 0 AND y_other = 0) AS tn, count(*) FILTER (y_true = 0 AND y_other = 1) AS fp,
 count(*) FILTER (y_true = 1 AND y_other = 0) AS fn, count(*) FILTER (y_true = 1 AND y_other = 1) AS tp FROM p GROUP BY cluster), {_DRAWS.format(n=300)},
ra AS (SELECT b, {_F1} AS f FROM (SELECT b, {_sums()} FROM c JOIN k USING (cluster) JOIN w USING (k) GROUP BY b)),
rb AS (SELECT b, {_F1} AS f FROM (SELECT b, {_sums("e")} FROM e JOIN k USING (cluster) JOIN w USING (k) GROUP BY b))
SELECT round(quantile_cont(ra.f - rb.f, 0.025), 9) AS lo, round(quantile_cont(ra.f - rb.f, 0.975), 9) AS hi, count(*) AS n_boot,
 (quantile_cont(ra.f - rb.f, 0.025) > 0 OR quantile_cont(ra.f - rb.f, 0.975) < 0) AS excludes_zero FROM ra JOIN rb USING (b)""")
def paired_delta(spark, d):
    """Both predictors on the same draws; whether the interval of their difference leaves out 0."""
    p = predictions(spark, d)
    sums = ["tn", "fp", "fn", "tp"]
    a, b = M.confusion_by(p, ["cluster"]), M.confusion_by(p, ["cluster"], p="y_other")
    both = a.withColumn("m", F.lit("a")).unionByName(b.withColumn("m", F.lit("b"))).persist()
    boot = B.replicates(both, B.draws(both, "cluster", 300), "cluster", sums, ["m"]).withColumn("f", _f1())
    wide = boot.groupBy("replicate").agg((F.max(F.when(F.col("m") == "a", F.col("f"))) - F.max(F.when(F.col("m") == "b", F.col("f")))).alias("delta"), F.lit(1).alias("one"))
    ci = B.percentile_interval(wide, ["one"], F.col("delta"))
    return ci.select(F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), "n_boot", ((F.col("lo") > 0) | (F.col("hi") < 0)).alias("excludes_zero"))


@query(f"""WITH {_PRED}, {_CELLS} SELECT cluster, (sum(tn) OVER () - tn)::BIGINT AS tn, (sum(fp) OVER () - fp)::BIGINT AS fp, (sum(fn) OVER () - fn)::BIGINT AS fn, (sum(tp) OVER () - tp)::BIGINT AS tp FROM c""")
def jackknife_table(spark, d):
    return B.jackknife(M.confusion_by(predictions(spark, d), ["cluster"]), "cluster", ["tn", "fp", "fn", "tp"])


@query(f"""WITH {_PRED}, {_CELLS.replace("SELECT cluster,", "SELECT cluster, lang IN ('en', 'de') AS near,").replace("GROUP BY cluster", "GROUP BY cluster, lang IN ('en', 'de')")}, {_DRAWS.format(n=300)},
r AS (SELECT b, near, {_F1} AS f FROM (SELECT b, near, {_sums()} FROM c JOIN k USING (cluster) JOIN w USING (k) GROUP BY b, near)),
x AS (SELECT b, max(f) FILTER (near) - max(f) FILTER (NOT near) AS d FROM r GROUP BY b)
SELECT round(quantile_cont(d, 0.025), 9) AS lo, round(quantile_cont(d, 0.975), 9) AS hi, round(avg(d), 9) AS mean FROM x""")
def contrast_near_far(spark, d):
    """Shared draws; difference of near languages' and far ones' macro F1."""
    p = predictions(spark, d).withColumn("near", F.col("lang").isin("en", "de"))
    cells = M.confusion_by(p, ["cluster", "near"]).persist()
    boot = B.replicates(cells, B.draws(cells, "cluster", 300), "cluster", ["tn", "fp", "fn", "tp"], ["near"]).withColumn("f", _f1())
    x = boot.groupBy("replicate").agg((F.max(F.when(F.col("near"), F.col("f"))) - F.max(F.when(~F.col("near"), F.col("f")))).alias("d"))
    q = x.agg(F.percentile("d", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg("d").alias("m"))
    return q.select(F.round(F.col("q")[0], 9).alias("lo"), F.round(F.col("q")[1], 9).alias("hi"), F.round("m", 9).alias("mean"))


@query()
def bca_interval(spark, d):
    """Macro F1 by language group with a BCa interval over 10,000 draws of sources (tested against a plain version)."""
    p = predictions(spark, d).withColumn("near", F.col("lang").isin("en", "de"))
    sums = ["tn", "fp", "fn", "tp"]
    cells = M.confusion_by(p, ["cluster", "near"]).persist()
    boot = B.replicates(cells, B.draws(cells, "cluster", 10_000), "cluster", sums, ["near"]).select("near", _f1().alias("stat"))
    jack = B.jackknife(cells, "cluster", sums, ["near"]).select("near", _f1().alias("stat"))
    whole = cells.groupBy("near").agg(*(F.sum(x).alias(x) for x in sums)).select("near", _f1().alias("stat"))
    return B.bca_interval(boot, jack, whole, ["near"])


@query("""WITH r AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS a,
 rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0::DOUBLE AS b FROM events)
SELECT event_type, round(corr(a, b), 8) AS rho FROM r GROUP BY event_type""")
def spearman_rank(spark, d):
    return M.spearman(table(spark, d, "events"), ["event_type"], "value", "user_id").withColumn("rho", F.round("rho", 8))


@query(f"""WITH {_PRED}, r AS (SELECT lang, y_true, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0::DOUBLE AS r FROM p),
g AS (SELECT lang, sum(r) FILTER (y_true = 1) AS s, count(*) FILTER (y_true = 1) AS a, count(*) FILTER (y_true = 0) AS b FROM r GROUP BY lang)
SELECT lang, round((s - a * (a + 1) / 2.0::DOUBLE) / (a * b), 9) AS auc FROM g""")
def auc_rank(spark, d):
    return M.auc(predictions(spark, d), ["lang"], "n_chars", "y_true").withColumn("auc", F.round("auc", 9))


@query("""SELECT l_returnflag, l_linestatus, round((sum(v) OVER (PARTITION BY l_returnflag) - v) / (sum(n) OVER (PARTITION BY l_returnflag) - n), 6) AS rest_mean
FROM (SELECT l_returnflag, l_linestatus, sum(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY count(*) OVER (PARTITION BY l_returnflag) > 1""")
def leave_one_out(spark, d):
    """Mean quantity of a flag's lines without one status."""
    out = M.leave_one_out_means(table(spark, d, "lineitem"), ["l_returnflag"], ["l_linestatus"], "l_quantity")
    return out.filter("rest_mean IS NOT NULL").withColumn("rest_mean", F.round("rest_mean", 6))


@query("""WITH g AS (SELECT event_type, user_id, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, round(sum(s) / sum(n), 8) AS point, count(*) AS n_clusters, count(*) < 30 AS few_clusters FROM g GROUP BY event_type""")
def clustered_mean(spark, d):
    g = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("event_type").agg(F.round(F.sum("s") / F.sum("n"), 8).alias("point"), F.count(F.lit(1)).alias("n_clusters"), (F.count(F.lit(1)) < 30).alias("few_clusters"))


@query("""SELECT l_returnflag, round(avg(l_extendedprice * l_discount) / avg(l_quantity), 8) AS ratio_of_means, round(avg(l_extendedprice * l_discount / l_quantity), 8) AS mean_of_ratios
FROM lineitem GROUP BY l_returnflag""")
def ratio_of_means(spark, d):
    e, g = F.col("l_extendedprice") * F.col("l_discount"), F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(e) / F.avg(g), 8).alias("ratio_of_means"), F.round(F.avg(e / g), 8).alias("mean_of_ratios"))


# --- splits, samples, classes ---------------------------------------------------------------------


_UNIT = "('0x' || substr(sha1({k} || ':' || {s}), 1, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE"


@query(f"""SELECT doc_id, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, {_UNIT.format(k='doc_id', s='0')} AS u FROM documents)""")
def hash_split_assign(spark, d):
    return table(spark, d, "documents").select("doc_id", S.hash_split(F.col("doc_id"), 0).alias("split"))


@query(f"""SELECT seed::INT AS seed, split, count(*) AS n FROM (SELECT seed, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2::DOUBLE + 0.1::DOUBLE THEN 'val' ELSE 'train' END AS split
 FROM (SELECT seed, {_UNIT.format(k='doc_id', s='seed')} AS u FROM documents, range(5) t(seed))) GROUP BY 1, 2""")
def hash_split_counts(spark, d):
    rows = table(spark, d, "documents").select("doc_id").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return rows.select("seed", S.hash_split(F.col("doc_id"), F.col("seed")).alias("split")).groupBy("seed", "split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang, source FROM documents WHERE (lang || source) IN (SELECT lang || source FROM documents GROUP BY 1 HAVING count(*) >= 12)")
def class_policy_kept(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source").withColumn("c", F.concat("lang", "source"))
    return S.class_policy(docs, "c", 12).drop("c")


@query("SELECT lang, arg_max(y, (c, -f)) AS majority, round(max(c)::DOUBLE / sum(c), 9) AS share FROM (SELECT lang, quality AS y, count(*) AS c, min(doc_id) AS f FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2) GROUP BY lang")
def majority_by_lang(spark, d):
    n = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").groupBy("lang", F.col("quality").alias("y")).agg(F.count(F.lit(1)).alias("c"), F.min("doc_id").alias("f"))
    return n.groupBy("lang").agg(F.max_by("y", F.struct("c", -F.col("f"))).alias("majority"), F.round(F.max("c") / F.sum("c"), 9).alias("share"))


@query("SELECT source, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY source ORDER BY n DESC, first_seen LIMIT 10")
def topk_sources(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_seen"))
    return n.orderBy(F.desc("n"), "first_seen").limit(10)


@query(f"""WITH g AS (SELECT lang, source, count(*) AS n, {_UNIT.format(k="source", s="1")} AS u FROM documents GROUP BY 1, 2),
b AS (SELECT lang, source, coalesce(sum(n) OVER (PARTITION BY lang ORDER BY u, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT doc_id, lang, source FROM documents SEMI JOIN (SELECT * FROM b WHERE before < 60) USING (lang, source)""")
def cap_whole_groups(spark, d):
    return S.cap_whole_groups(table(spark, d, "documents").select("doc_id", "lang", "source"), ["source"], 1, 60, per=["lang"])


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id ORDER BY min(event_id), user_id LIMIT 40)")
def first_seen_cap(spark, d):
    return S.first_seen_cap(table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id", 40)


@query(f"""WITH s AS (SELECT source, row_number() OVER (ORDER BY {_UNIT.format(k="source", s="42")}, source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
SELECT source, CASE WHEN r <= floor(0.8 * n) THEN 'train' WHEN r <= floor(0.8 * n) + floor(0.1 * n) THEN 'validation' ELSE 'test' END AS split FROM s""")
def repo_split(spark, d):
    return S.ordered_split(table(spark, d, "documents"), "source", 42)


@query(f"""WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {_UNIT.format(k="doc_id", s="3")}, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels)
SELECT doc_id, quality, CASE WHEN r <= floor(n * 0.2::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, d):
    return S.stratified_split(table(spark, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 3)


# --- occurrences ------------------------------------------------------------------------------------


def turns(spark, d) -> DataFrame:
    """Conversation turns as occurrences: function = role, variable = first word, span from the running length."""
    c = table(spark, d, "conversations")
    word = F.lower(F.regexp_extract("text", r"[A-Za-z]+", 0))
    start = F.coalesce(F.sum(F.length("text") + 1).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return c.select("conv_id", "turn", F.col("role").alias("function"), word.alias("variable"), start.cast("long").alias("s"), (start + F.length("text")).cast("long").alias("e"), "text")


_TURNS = """t AS (SELECT conv_id, turn, role AS function, lower(regexp_extract(text, '[A-Za-z]+')) AS variable, text,
 coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
 (coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text))::BIGINT AS e FROM conversations)"""


@query(f"""WITH {_TURNS}, m AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, function) AS ff, min(turn) OVER (PARTITION BY conv_id, function, variable) AS fv FROM t)
SELECT conv_id, turn, conv_id || ':chat:f' || (dense_rank() OVER (PARTITION BY conv_id ORDER BY ff) - 1) || ':b' || (dense_rank() OVER (PARTITION BY conv_id, function ORDER BY fv) - 1)
 || ':o' || (row_number() OVER (PARTITION BY conv_id, function, variable ORDER BY turn) - 1) AS occurrence_id FROM m""")
def occurrence_ids(spark, d):
    return O.occurrence_ids(turns(spark, d), "conv_id", F.lit("chat"), "function", "variable", "turn").select("conv_id", "turn", "occurrence_id")


@query("SELECT text, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def first_wins_dedupe(spark, d):
    return O.first_wins(table(spark, d, "documents").select("text", "doc_id", "source"), ["text"], ["doc_id"])


@query("""SELECT user_id, event_type, min(event_id) AS event_id, min(sign) AS sign FROM (SELECT user_id, event_type, event_id, (value > 20)::INT AS sign FROM events)
GROUP BY 1, 2 HAVING count(DISTINCT sign) = 1""")
def conflict_free_spans(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", (F.col("value") > 20).cast("int").alias("sign"))
    return O.conflict_free(rows, ["user_id", "event_type"], "sign", "event_id").select("user_id", "event_type", "event_id", "sign")


@query(f"""WITH {_TURNS}, g AS (SELECT conv_id, variable || '/' || function AS name, function, list(s ORDER BY s) AS st FROM t GROUP BY 1, 2, 3)
SELECT a.conv_id, a.name AS target, any_value(a.st[:-2]) AS edit_sites, any_value(a.st[-1]) AS readout, min(b.name) FILTER (a.function <> b.function) AS distractor, min(b.name) FILTER (a.function = b.function) AS same_role
FROM g a JOIN g b ON a.conv_id = b.conv_id AND a.name <> b.name AND b.st[1] < a.st[-1] AND len(a.st) > 1 GROUP BY a.conv_id, a.name""")
def case_builder(spark, d):
    rows = turns(spark, d).withColumn("name", F.concat_ws("/", "variable", "function"))
    return O.cases(rows, ["conv_id"], "name", "function", "s")


@query(r"""WITH r AS (SELECT doc_id, text, CASE WHEN text IS NULL OR text = '' THEN 'missing_code' WHEN lower(source) LIKE '%ipynb%' THEN 'notebook' WHEN regexp_matches(substr(text, 1, 8000), '(?i)auto[-_\s]?generated|do\s+not\s+(edit|modify)|this\s+file\s+was\s+generated|@generated\b|\bgenerated\s+by\b') THEN 'generated'
 WHEN len(list_filter(regexp_split_to_array(text, '\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: regexp_matches(x, '[^\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'))) < 2 THEN 'short' WHEN n_chars < 200 THEN 'few' END AS reason FROM documents),
f AS (SELECT *, min(CASE WHEN reason IS NULL THEN doc_id END) OVER (PARTITION BY text) AS first FROM r)
SELECT coalesce(CASE WHEN reason IS NULL AND doc_id > first THEN 'duplicate' ELSE reason END, 'kept') AS drop_reason, count(*) AS n FROM f GROUP BY 1""")
def drop_reason_cascade(spark, d):
    docs = table(spark, d, "documents")
    t = F.col("text")
    gates = [("missing_code", t.isNull() | (t == "")), ("notebook", F.lower("source").contains("ipynb")), ("generated", X.generated(t)), ("short", X.full_lines(t) < 2), ("few", F.col("n_chars") < 200)]
    rows = O.drop_reasons(docs.select("doc_id", "text", "source", "n_chars"), gates, ["text"], "doc_id")
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


# --- joins and sets -------------------------------------------------------------------------------------


@query("SELECT o.o_custkey, c.c_name, o.o_orderkey, o.o_totalprice FROM (SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) o JOIN customer c ON c.c_custkey = o.o_custkey")
def lookup_last_wins(spark, d):
    """Each customer with the last of its orders."""
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return J.lookup(left, orders, ["o_custkey"], "o_orderkey").select("o_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("""WITH l AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS k, lang, source FROM documents),
b AS (SELECT lang, source, arg_min(n_chars, doc_id) AS n FROM documents GROUP BY 1, 2)
SELECT l.doc_id, CASE WHEN l.k IS NOT NULL THEN a.n_chars ELSE b.n END AS n_chars FROM l LEFT JOIN documents a ON a.doc_id = l.k LEFT JOIN b ON b.lang = l.lang AND b.source = l.source""")
def lookup_conditional(spark, d):
    """By id where a row has one, else by (lang, source), first wins."""
    docs = table(spark, d, "documents")
    left = docs.select(F.col("doc_id").alias("row"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("doc_id"), "lang", "source")
    second = J.wins(docs.select("lang", "source", "doc_id", "n_chars"), ["lang", "source"], "doc_id", last=False).select("lang", "source", "n_chars")
    out = J.lookup_two_ways(left, docs.select("doc_id", "n_chars"), second, "doc_id", ["lang", "source"], "n_chars")
    return out.select(F.col("row").alias("doc_id"), "n_chars")


@query("SELECT l.doc_id, l.quality, r.source FROM (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM labels) l JOIN (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM documents) r USING (n)")
def positional_join(spark, d):
    """Labels and documents by their place in id order."""
    a = S.global_rank(table(spark, d, "labels").select("doc_id", "quality"), [F.col("doc_id")], "n")
    b = S.global_rank(table(spark, d, "documents").select(F.col("doc_id").alias("other"), "source"), [F.col("other")], "n")
    return a.join(b, "n").select("doc_id", "quality", "source")


@query("SELECT doc_id, quality, source FROM labels JOIN documents USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents)")
def matched_semi(spark, d):
    a, b = J.matched(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id", 10)
    return a.select("doc_id", "quality").join(b.select("doc_id", "source"), "doc_id")


@query("""SELECT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'click' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'""")
def three_way_intersection(spark, d):
    e = table(spark, d, "events")
    return J.shared_keys([e.filter(F.col("event_type") == t) for t in ("view", "click", "purchase")], "user_id")


@query("""WITH u AS (SELECT DISTINCT event_type, user_id FROM events) SELECT a.event_type AS a, b.event_type AS b, count(*) AS n_shared FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY 1, 2""")
def shared_ids_matrix(spark, d):
    u = table(spark, d, "events").select("event_type", "user_id").distinct()
    a, b = u.alias("a"), u.alias("b")
    both = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.event_type") < F.col("b.event_type")))
    return both.groupBy(F.col("a.event_type").alias("a"), F.col("b.event_type").alias("b")).agg(F.count(F.lit(1)).alias("n_shared"))


@query("SELECT user_id, count(*) FILTER (event_type = 'view') AS n_view, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'view') = 1 AND count(*) FILTER (event_type = 'click') = 1 AS exact FROM events GROUP BY 1")
def exact_pair_pivot(spark, d):
    return J.pair_counts(table(spark, d, "events"), "user_id", "event_type", ["view", "click"])


@query("""WITH e AS (SELECT o_orderkey, l FROM orders, (SELECT unnest([1, 2, 3]) AS l)), h AS (SELECT l_orderkey AS o_orderkey, l_linenumber AS l, count(*) AS n, bool_or(l_quantity = 13 OR l_tax IS NULL) AS bad FROM lineitem GROUP BY 1, 2),
b AS (SELECT e.o_orderkey AS w, h.n, h.bad FROM e FULL JOIN h ON e.o_orderkey = h.o_orderkey AND e.l = h.l)
SELECT count(w) AS expected, count(n) AS present, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (w IS NULL) AS extra, count(*) FILTER (n > 1) AS duplicates, count(*) FILTER (bad) AS non_finite FROM b""")
def completeness_report(spark, d):
    """Lines 1 to 3 of every order against the lines there are; the tax of a quantity of 13 stands for a value that is not finite."""
    want = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.explode(F.array(*(F.lit(i) for i in (1, 2, 3)))).alias("l"))
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.when(F.col("l_quantity") == 13, float("nan")).otherwise(F.col("l_tax")).alias("x"))
    return J.completeness(want, have, ["k", "l"], ["x"])


@query("SELECT o_orderkey, l FROM orders, (SELECT unnest([1, 2, 3]) AS l) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = l)")
def missing_cells(spark, d):
    want = table(spark, d, "orders").select("o_orderkey", F.explode(F.array(*(F.lit(i) for i in (1, 2, 3)))).alias("l"))
    return I.missing(want, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("l")), ["o_orderkey", "l"])


@query(f"""WITH {_TURNS}, tok AS (SELECT conv_id, w * 40 AS s, w * 40 + 10 AS e FROM (SELECT conv_id, unnest(range(max(e) // 40)) AS w FROM t GROUP BY conv_id))
SELECT tok.conv_id, tok.s AS token_s, t.turn FROM tok JOIN t ON tok.conv_id = t.conv_id AND tok.s < t.e AND t.s < tok.e""")
def span_overlap_join(spark, d):
    """Tokens of ten characters every forty, with the turns they touch."""
    spans = turns(spark, d)
    n = spans.groupBy("conv_id").agg(F.expr("max(e) div 40").alias("n")).filter("n > 0")
    tokens = n.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("w")).select("conv_id", (F.col("w") * 40).alias("s"), (F.col("w") * 40 + 10).alias("e"))
    return J.overlapping(tokens, spans, "conv_id").select(F.col("t.conv_id").alias("conv_id"), F.col("t.s").alias("token_s"), "s.turn")


@query(f"""WITH {_TURNS}, sc AS (SELECT conv_id, function || '@' || min(s) || '-' || max(e) AS scope, min(s) AS s, max(e) AS e FROM t GROUP BY conv_id, function)
SELECT t.conv_id, t.turn, arg_min(sc.scope, (sc.e - sc.s, sc.scope)) AS scope FROM t LEFT JOIN sc ON t.conv_id = sc.conv_id AND sc.s <= t.s AND t.s < sc.e GROUP BY 1, 2""")
def innermost_scope(spark, d):
    """The narrowest role range around each turn's start."""
    rows = turns(spark, d)
    scopes = rows.groupBy("conv_id", "function").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    scopes = scopes.select("conv_id", F.concat(F.col("function"), F.lit("@"), F.col("s"), F.lit("-"), F.col("e")).alias("scope"), "s", "e")
    return J.innermost(rows.select("conv_id", "turn", F.col("s").alias("pos")), scopes, "conv_id", "pos", "turn")


@query(f"""WITH {_TURNS}, ed AS (SELECT conv_id, s, s + length(variable) AS e, 7 AS w FROM t WHERE function = 'user')
SELECT t.conv_id, t.turn, t.s + coalesce((SELECT sum(w - (ed.e - ed.s)) FROM ed WHERE ed.conv_id = t.conv_id AND ed.e <= t.s), 0)::BIGINT AS new_s,
 t.s + coalesce((SELECT sum(w - (ed.e - ed.s)) FROM ed WHERE ed.conv_id = t.conv_id AND ed.e <= t.s), 0)::BIGINT + CASE WHEN function = 'user' THEN 7 ELSE length(variable) END AS new_e FROM t""")
def span_shift(spark, d):
    """Every turn's first word after those of users were renamed to seven letters."""
    rows = turns(spark, d).withColumn("we", F.col("s") + F.length("variable"))
    edits = rows.filter("function = 'user'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("s", F.col("we").alias("e"), F.lit("renamed").alias("repl")))).alias("edits"))
    rows = rows.join(edits, "conv_id", "left").withColumn("edits", F.coalesce("edits", F.expr("cast(array() as array<struct<s:bigint,e:bigint,repl:string>>)")))
    return rows.withColumn("n", J.shift_spans(F.col("s"), F.col("we"), F.col("edits"))).select("conv_id", "turn", F.col("n.s").alias("new_s"), F.col("n.e").alias("new_e"))


@query("""WITH u AS (SELECT DISTINCT event_type, user_id FROM events WHERE event_type IN ('view', 'click')), g AS (SELECT 'users' AS g, count(*) FILTER (event_type = 'view') AS n_a, count(*) FILTER (event_type = 'click') AS n_b FROM u),
s AS (SELECT count(*) AS n_shared FROM (SELECT user_id FROM u WHERE event_type = 'view' INTERSECT SELECT user_id FROM u WHERE event_type = 'click'))
SELECT g, n_a, n_b, n_shared, round(n_shared::DOUBLE / least(n_a, n_b), 9) AS coverage FROM g, s""")
def overlap_coverage(spark, d):
    e = table(spark, d, "events").select("event_type", "user_id", F.lit("users").alias("g"))
    return J.coverage(e.filter("event_type = 'view'"), e.filter("event_type = 'click'"), ["user_id"], "g").withColumn("coverage", F.round("coverage", 9))


# --- text ----------------------------------------------------------------------------------------------


_BLANKS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@query(f"SELECT doc_id, substr(sha1(trim(regexp_replace(lower(text), '{_BLANKS}', ' ', 'g'), ' ')), 1, 16) AS problem_id FROM documents")
def problem_id_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", X.problem_id(F.col("text")).alias("problem_id"))


@query(r"""WITH w AS (SELECT doc_id, text, lower(regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*')) AS v, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*') AS raw FROM documents), p AS (SELECT *, strpos(text, raw) - 1 AS s FROM w WHERE raw <> '')
SELECT doc_id, replace(substr(text, greatest(0, s - 60)::BIGINT + 1, (least(length(text), s + length(raw) + 60) - greatest(0, s - 60))::BIGINT), raw, ' VAR ') AS masked FROM p""")
def masked_window(spark, d):
    """60 characters on either side of a document's first identifier, masked (also inside longer words)."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.regexp_extract("text", r"[A-Za-z_]\w*", 0).alias("raw")).filter("raw <> ''")
    rows = rows.withColumn("s", F.expr("locate(raw, text) - 1"))
    span = X.window_span(F.col("text"), F.col("s"), F.col("s") + F.length("raw"), 60)
    return rows.withColumn("w", span).select("doc_id", X.masked(F.col("text"), F.col("w.s"), F.col("w.e"), F.col("raw")).alias("masked"))


@query("SELECT doc_id, translate(text, '.,;:', '    ') AS ablated, length(text) AS n FROM documents")
def ablate_chars(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", X.ablate(t, ".,;:").alias("ablated"), F.length(t).cast("long").alias("n"))


@query(r"""WITH g AS (SELECT unnest(regexp_extract_all(html, '[^a-zA-Z]{2}')) AS g FROM pages UNION ALL SELECT unnest(regexp_extract_all(html, '[a-z ]{4}')) FROM pages)
SELECT CASE WHEN contains(g, ';') THEN 'terminator' WHEN regexp_matches(g, '[{}]') THEN 'brace' WHEN regexp_matches(g, '[\[\]]') THEN 'bracket' WHEN regexp_matches(g, '[()]') THEN 'paren' WHEN regexp_matches(g, '[+\-*/%<>=!&|]') THEN 'operator'
 WHEN regexp_matches(g, '\b(for|while|in|range|let|var|const|foreach|do|if)\b') THEN 'keyword' WHEN regexp_full_match(g, '[A-Za-z_ ]+') THEN 'alpha' ELSE 'other' END AS class, count(*) AS n FROM g GROUP BY 1""")
def ngram_class_counts(spark, d):
    cut = lambda p: table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit(p), F.lit(0))).alias("g"))
    g = cut("[^a-zA-Z]{2}").unionByName(cut("[a-z ]{4}"))
    return g.groupBy(X.ngram_class(F.col("g")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, length(html) - length(replace(html, '{', '')) = length(html) - length(replace(html, '}', '')) AND length(html) - length(replace(html, '(', '')) = length(html) - length(replace(html, ')', '')) AS balanced FROM pages""")
def balance_check(spark, d):
    return table(spark, d, "pages").select("page_id", X.balanced(F.col("html")).alias("balanced"))


@query("SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM pages) GROUP BY name")
def regex_identifiers(spark, d):
    return table(spark, d, "pages").select(F.explode(X.identifiers(F.col("html"))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT page_id, list_sort(list_distinct(regexp_extract_all(html, '\bvar\s+([A-Za-z_]\w*)\s*=', 1))) AS vars, list_sort(list_distinct(regexp_extract_all(html, '([A-Za-z_]\w*)\(', 1))) AS calls FROM pages")
def regex_declarations(spark, d):
    names = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(p), F.lit(1))))
    return table(spark, d, "pages").select("page_id", names(r"\bvar\s+([A-Za-z_]\w*)\s*=").alias("vars"), names(r"([A-Za-z_]\w*)\(").alias("calls"))


@query(r"""WITH w AS (SELECT doc_id, ' ' || w || ' ' AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[ \t\n\x0B\f\r]+')) AS w FROM documents) WHERE w <> ''),
g AS (SELECT doc_id, substr(w, i::BIGINT, n::BIGINT) AS ngram FROM w, range(2, 5) a(n), range(1, greatest(2, length(w) - n + 2)) b(i) WHERE length(w) >= n OR n = 2)
SELECT ngram, count(DISTINCT doc_id) AS df, count(*) AS tf FROM g GROUP BY ngram HAVING count(DISTINCT doc_id) >= 2""")
def char_ngram_df(spark, d):
    return X.ngram_documents(table(spark, d, "documents"), "doc_id", "text")


@query("SELECT page_id, length(html) - length(replace(html, chr(10), '')) + 1 AS lines, strpos(html, 'var') - 1 AS at, length(substr(html, 1, strpos(html, 'var') - 1)) - length(replace(substr(html, 1, strpos(html, 'var') - 1), chr(10), '')) + 1 AS line FROM pages WHERE strpos(html, 'var') > 0")
def line_positions(spark, d):
    p = table(spark, d, "pages").withColumn("at", F.expr("locate('var', html) - 1")).filter("at >= 0")
    n = F.length("html") - F.length(F.replace("html", F.lit("\n"), F.lit(""))) + 1
    return p.select("page_id", n.cast("long").alias("lines"), F.col("at").cast("long").alias("at"), X.line_of(F.col("html"), F.col("at")).cast("long").alias("line"))


# --- vectors -------------------------------------------------------------------------------------------


_LONG = "e AS (SELECT vec_id, label, embedding, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY 1, 2)"


@query(f"WITH {_LONG} SELECT label, (i - 1)::INT AS dim, round(m, 9) AS mean FROM m")
def class_mean_direction(spark, d):
    means = V.mean_vector(table(spark, d, "embeddings"), ["label"], "embedding")
    return means.select("label", F.posexplode("embedding").alias("dim", "mean")).select("label", "dim", F.round("mean", 9).alias("mean"))


@query(f"WITH {_LONG} SELECT vec_id, round(sum(x * m) / (sqrt(sum(x * x)) * sqrt(sum(m * m))), 7) AS cosine FROM e JOIN m USING (label, i) GROUP BY vec_id")
def cosine_to_class_mean(spark, d):
    from lexiprobe.operators.joins import small_side

    rows = table(spark, d, "embeddings")
    means = V.mean_vector(rows, ["label"], "embedding").withColumnRenamed("embedding", "mean")
    return rows.join(small_side(means), "label").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("mean")), 7).alias("cosine"))


@query(f"WITH {_LONG}, s AS (SELECT vec_id, label, sum(x * m) AS p FROM e JOIN (SELECT i, m FROM m WHERE label = 0) z USING (i) GROUP BY 1, 2) SELECT label, round(min(p), 7) AS low, round(avg(p), 7) AS mean, round(max(p), 7) AS high FROM s GROUP BY label")
def margin_stats(spark, d):
    """Projections on class 0's mean, by class."""
    rows = table(spark, d, "embeddings")
    zero = V.mean_vector(rows.filter("label = 0"), ["label"], "embedding").select(F.col("embedding").alias("w"))
    p = rows.crossJoin(F.broadcast(zero)).select("label", V.margin(F.col("w"), F.lit(0.0), F.col("embedding")).alias("p"))
    return p.groupBy("label").agg(F.round(F.min("p"), 7).alias("low"), F.round(F.avg("p"), 7).alias("mean"), F.round(F.max("p"), 7).alias("high"))


@query(f"""WITH {_LONG}, k AS (SELECT label, list(i) AS top FROM (SELECT label, i, row_number() OVER (PARTITION BY label ORDER BY abs(m) DESC, i) AS r FROM m) WHERE r <= 8 GROUP BY label)
SELECT a.label AS a, b.label AS b, round(len(list_intersect(a.top, b.top))::DOUBLE / len(list_distinct(a.top || b.top)), 9) AS jaccard FROM k a JOIN k b ON a.label < b.label""")
def topk_dim_jaccard(spark, d):
    means = V.mean_vector(table(spark, d, "embeddings"), ["label"], "embedding").select("label", V.top_dimensions(F.col("embedding"), 8).alias("top"))
    a, b = means.alias("a"), means.alias("b")
    return a.join(b, F.col("a.label") < F.col("b.label")).select(F.col("a.label").alias("a"), F.col("b.label").alias("b"), F.round(V.jaccard(F.col("a.top"), F.col("b.top")), 9).alias("jaccard"))


# --- prompts, schedules ---------------------------------------------------------------------------------


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


_GRID = f"""g AS (SELECT (p * {len(P.BODIES)} + b) * {len(P.GAPS)} + g AS cluster_id, p::INT AS prefix_id, b::INT AS body_id, g::INT AS gap_id, v::INT AS lexical_variant,
 {_sql_list(P.PREFIXES)}[p + 1] AS prefix, {_sql_list(P.BODIES)}[b + 1] AS body, {_sql_list(P.GAPS)}[g + 1] AS gap
 FROM range({len(P.PREFIXES)}) a(p), range({len(P.BODIES)}) c(b), range({len(P.GAPS)}) e(g), range({P.LEXICAL}) h(v)),
n AS (SELECT *, {_sql_list(P.NAMES)}[(cluster_id * {P.LEXICAL} + lexical_variant) % {len(P.NAMES)} + 1] AS name FROM g)"""


@query(f"""WITH {_GRID} SELECT 'pair-' || lpad(cluster_id::VARCHAR, 2, '0') || '-' || lexical_variant AS pair_id, cluster_id::INT AS cluster_id, name,
 sha256(prefix || 'class ' || name || ':' || chr(10) || body || gap || 'item = ' || name) AS clean_sha, length(prefix) + 6 AS decl_s, length(prefix) + 6 + length(name) AS decl_e FROM n""")
def prompt_factorial(spark, d):
    p = P.prompt_pairs(spark)
    return p.select("pair_id", "cluster_id", "name", F.sha2("clean_prompt", 256).alias("clean_sha"), F.col("class_decl_s").cast("long").alias("decl_s"), F.col("class_decl_e").cast("long").alias("decl_e"))


@query(f"""WITH {_GRID} SELECT 'name' AS factor, name AS level, count(*) AS n FROM n GROUP BY name UNION ALL SELECT 'prefix_id', prefix_id::VARCHAR, count(*) FROM n GROUP BY prefix_id
UNION ALL SELECT 'body_id', body_id::VARCHAR, count(*) FROM n GROUP BY body_id UNION ALL SELECT 'gap_id', gap_id::VARCHAR, count(*) FROM n GROUP BY gap_id""")
def balanced_design(spark, d):
    return P.balance(P.prompt_pairs(spark), ["name", "prefix_id", "body_id", "gap_id"])


@query("""WITH c AS (SELECT layer::INT AS layer, 'query_name' AS span, d AS direction, 'target' AS control FROM range(12) r(layer), (SELECT unnest(['denoise', 'noise']) AS d)
UNION SELECT 5, s, d, 'target' FROM (SELECT unnest(['declaration_name', 'placebo']) AS s), (SELECT unnest(['denoise', 'noise']) AS d)
UNION SELECT 5, s, d, c FROM (SELECT unnest(['query_name', 'declaration_name']) AS s), (SELECT unnest(['denoise', 'noise']) AS d), (SELECT unnest(['random', 'same_source']) AS c))
SELECT layer, span, direction, control FROM c""")
def schedule_full(spark, d):
    return Q.schedule(spark, "full", 12, 5)


@query("""SELECT layer, round(score, 8) AS score FROM (SELECT l_linenumber AS layer, abs(avg((a + b) / 2)) AS score FROM (SELECT l_linenumber, l_orderkey, max(l_tax) FILTER (l_returnflag = 'N') AS a, max(l_discount) FILTER (l_returnflag = 'N') AS b
 FROM lineitem GROUP BY 1, 2) WHERE l_linenumber NOT IN (0, 7, 3) GROUP BY 1) ORDER BY score DESC, layer LIMIT 2""")
def strongest_layers(spark, d):
    """Line numbers as layers; tax and discount as the two directions' effects."""
    rows = table(spark, d, "lineitem").filter("l_returnflag = 'N'")
    both = rows.select(F.col("l_linenumber").alias("layer"), F.col("l_orderkey").alias("pair_id"), F.explode(F.create_map(F.lit("denoise"), "l_tax", F.lit("noise"), "l_discount")).alias("direction", "signed_effect"))
    return Q.strongest_layers(both, 8, 3).withColumn("score", F.round("score", 8))


# --- runs, stores --------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT event_type, event_id, greatest(60.0::DOUBLE, value) * 1.15::DOUBLE AS billed_s FROM events), u AS (SELECT *, (billed_s / 3600.0::DOUBLE * 2.5::DOUBLE)::DECIMAL(28, 12) AS usd FROM b),
r AS (SELECT event_type, event_id, billed_s, sum(usd) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM u)
SELECT event_type, event_id, round(billed_s, 4) AS billed_s, round(running::DOUBLE, 6) AS running_usd, running > 50 AS over_budget FROM r""")
def ledger_running_cost(spark, d):
    rows = O.cost_ledger(table(spark, d, "events").withColumn("rate", F.lit(2.5)), "event_type", "value", "rate", "event_id", 50.0)
    return rows.select("event_type", "event_id", F.round("billed_s", 4).alias("billed_s"), F.round(F.col("running_usd").cast("double"), 6).alias("running_usd"), "over_budget")


@query("""WITH b AS (SELECT user_id, max(epoch(ts)) AS last_beat, arg_max(event_type = 'signup', (epoch(ts), event_id)) AS rel FROM events GROUP BY 1), n AS (SELECT max(last_beat) AS now FROM b)
SELECT user_id, CASE WHEN rel THEN 'released' WHEN now - last_beat >= 86400 THEN 'stale' ELSE 'held' END AS state FROM b, n""")
def lease_staleness(spark, d):
    """Users as holders, events as heartbeats, a sign-up as a release; a day makes a lease stale."""
    e = table(spark, d, "events")
    beats = e.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", (F.col("event_type") == "signup").alias("rel"))
    now = beats.agg(F.max("at")).first()[0] or 0
    last = beats.groupBy("user_id").agg(F.max("at").alias("last"), F.max_by("rel", F.struct("at", "event_id")).alias("released"))
    beat = last.select("user_id", (F.col("last") / 1e6).alias("at"), "released")
    return I.lease_states(beat, "user_id", "at", F.lit(now / 1e6), 86400.0, "released").select("user_id", "state")


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_append_dedup(spark, d):
    """The events appended twice by an availableNow stream: each once."""
    base = shared_path(spark, "append")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    rows.write.parquet(f"{base}/in")
    for run in (1, 2):  # the second run reads everything again and must add nothing
        I.stream_append(spark, f"{base}/in", rows.schema, f"{base}/out", f"{base}/state-{run}", ["event_id"])
    return spark.read.parquet(f"{base}/out")


# --- models (no SQL says them; tests hold them against plain versions) ------------------------------


@query()
def lr_probe_by_seed(spark, d):
    from lexiprobe.operators.models import probe

    rows = table(spark, d, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int"))
    return probe(rows, "embedding", "y", "vec_id", [0, 1])


@query()
def tfidf_surface_baseline(spark, d):
    from lexiprobe.operators.models import surface_baseline

    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return surface_baseline(rows, "doc_id", "text", "quality", "source", 0)


@query()
def pca_by_layer(spark, d):
    from lexiprobe.operators.models import principal

    return principal(table(spark, d, "embeddings"), "embedding", 3)
