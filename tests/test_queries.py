"""Every query with SQL against DuckDB on the small tables, and entry()."""

import os

import pytest

from lexiprobe import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    cur = duck.sql(Q.oracle_sql()[name])
    columns = list(cur.columns)
    assert sorted(df.columns) == sorted(columns)
    ours = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_optional_part(tmp_path):
    """The rest of the library works where the subpackage and the pipeline are deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lexiprobe", tmp_path / "lexiprobe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'macro_f1_cluster_ci' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_no_label_is_dropped(spark, tmp_path):
    """More labels than are broadcast: every row stays."""
    from lexiprobe.operators.models import balanced_weights

    n = 10_050
    rows = spark.range(n).selectExpr("id AS vec_id", "CAST(id AS INT) AS label", "array_repeat(CAST(1.0 AS FLOAT), 64) AS embedding")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert Q.queries()["cosine_to_class_mean"](spark, str(tmp_path)).count() == n
    assert balanced_weights(rows, "label").count() == n


def test_surface_baseline_reads_whole_texts(spark, tmp_path):
    """The features are those of a plain version over all lines, and what only later lines tell is learned."""
    import math
    from collections import Counter

    from lexiprobe.operators.models import tfidf

    texts = [(i, f"same first line\n{'zuq zuq' if i % 2 else 'bam bam'}", f"s{i}") for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    found = Q.queries()["tfidf_surface_baseline"](spark, str(tmp_path)).collect()
    assert found and all(r["ngram_f1"] == 1.0 > r["majority_f1"] for r in found)
    grams = lambda t: Counter(w[i : i + n] for w in (f" {x} " for x in t.split()) for n in (2, 3, 4) for i in range(len(w) - n + 1))
    plain_ = {i: grams(t) for i, t, _ in texts}
    df = Counter(g for c in plain_.values() for g in c)
    for r in tfidf(docs, "doc_id", "text", docs).select("doc_id", "features").collect():
        w = [c * (math.log(81 / (1 + df[g])) + 1) for g, c in plain_[r["doc_id"]].items()]
        norm = math.sqrt(sum(x * x for x in w))
        assert sorted(r["features"].values.tolist()) == pytest.approx(sorted(x / norm for x in w))
