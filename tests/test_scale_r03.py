"""Findings of round 3: what grew faster than its input."""

from collections import Counter

from pyspark.sql import functions as F

from lexiprobe.functions import text as X


def cut(word: str, low: int = 2, high: int = 4) -> list[str]:
    w = f" {word} "
    return [w[i : i + n] for n in range(low, high + 1) if len(w) >= n or n == low for i in range(max(1, len(w) - n + 1))]


def no_text_is_shuffled(df) -> bool:
    """Whether no exchange of the plan carries a row's own n-grams: none is dealt by anything but the n-gram."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    deals = [line for line in plan.splitlines() if "hashpartitioning" in line]
    return len(deals) == 1 and "hashpartitioning(ngram" in deals[0]


def test_ngrams_are_counted_in_tasks(spark, monkeypatch):
    """only counted n-grams are shuffled; the counts are those of a plain version, whatever a task can hold."""
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["Ab ab c", "ab\ncd", None, "", " \t", "naïve ÉTÉ ab", "x" * 50, "cd " * 40])] + [(None, "ab zz"), (None, "zz")], "k long, t string")

    def plain(data):
        df, tf = {}, Counter()
        for k, t in data:
            found = [g for w in (t or "").lower().split() for g in cut(w)]
            tf.update(found)
            for g in found:
                df.setdefault(g, set()).update(() if k is None else (k,))
        return {g: (len(df[g]), n) for g, n in tf.items() if len(df[g]) >= 2}

    got = lambda r: {x["ngram"]: (x["df"], x["tf"]) for x in X.ngram_documents(r, "k", "t").collect()}
    assert no_text_is_shuffled(X.ngram_documents(rows, "k", "t"))
    assert got(rows) == plain([tuple(r) for r in rows.collect()])
    again = rows.unionByName(rows.withColumn("t", F.concat(F.coalesce("t", F.lit("")), F.lit(" more ab")))).repartition(5)  # every key twice
    assert got(again) == plain([tuple(r) for r in again.collect()])
    monkeypatch.setattr(X, "BLOCK_CHARS", 32)
    assert got(again) == plain([tuple(r) for r in again.collect()])


def test_ngram_numbers(monkeypatch):
    """n-grams of whole texts by numbers are those that words give one by one."""
    texts = ["ab ab c", "", " \t", "naïve été 漢字 ab", "x" * 30, "a\x0bb\rc \x1cd"]
    for table in (X.TABLE, 10):
        monkeypatch.setattr(X, "TABLE", table)
        for low, high in ((2, 4), (3, 3), (4, 5), (5, 6)):
            names, own = X.ngram_numbers([t.encode() for t in texts], low, high)
            assert len(set(names)) == len(names)
            for t, ids in zip(texts, own, strict=True):
                assert Counter(names[i] for i in ids) == Counter(g for w in t.encode().split() for g in cut(w.decode(), low, high)), (t, low, high)


def test_offsets_without_a_row_for_each_token(spark):
    """texts are not repeated for their tokens; offsets within, across and beyond pieces and odd ones count as a plain cut does."""
    import __spark_entry__ as entry
    from lexiprobe.operators import summaries as U

    long = "é漢😀ab\n" * 200
    spans = [(0, 10), (250, 262), (255, 256), (256, 257), (0, 1200), (1190, 1300), (1300, 1310), (5, 5), (700, 100)]
    tokens = [(s, e, long[s:e]) for s, e in spans] + [(3, 9, "no"), (None, 4, "x"), (0, 4, None)]
    rows = spark.createDataFrame([("a", long, tokens), ("a", "xy", [(0, 2, "xy"), (1, 2, "x")]), ("b", None, [(0, 1, "x")]), ("c", "xy", [])], "lang string, text string, tokens array<struct<s int, e int, piece string>>")
    got = {r["lang"]: (r["bad"], r["total"], r["ok"]) for r in U.offset_gate(rows, ["lang"], "text", "tokens").collect()}
    assert got == {"a": (4, 14, False), "b": (1, 1, False)}
    plan = entry.queries()["tokenizer_offsets"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_programs_are_read_and_renamed_once(spark):
    """the results of a renaming share what they were made from: no plan reads or renames programs anew."""
    from lexiprobe.operators import occurrences as O
    from lexiprobe.operators.renaming import renaming_flow

    rows = spark.createDataFrame([(1, "Python", "def f(a):\n    done = True\n    if done:\n        return a\n")], "problem_id long, language string, code string")
    renamed, carried, _ = renaming_flow(rows, O.program_occurrences(rows), "numbered", O.program_occurrences)
    assert carried.count() and renamed.filter("dropped IS NULL").count() == 1
    for df in (renamed, carried):
        assert df._jdf.queryExecution().withCachedData().toString().count("InMemoryRelation") >= 2
