"""Operators 11 to 13 against plain versions, and what they do at the edges."""

import hashlib
import json
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pyarrow.orc
import pytest
from helpers import CLASH, frame
from pyspark.sql import functions as F

from lexiprobe.llm import fill_middle, token_files, whitening
from lexiprobe.llm.shared import fresh_path

TRICKY = ["", None, "\n", "a", "a\n", "\na", "a\n\nb", "no newline at all", "x <P> y\nz", "<S>", "é日本\r\n𝒳𝒴\n\n  z", "\n" * 50, "word " * 4000 + "\nend", "  lead  and\ttrail  \n"]


def tricky(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY * 6)] + [(None, "of no id\nat all"), (None, "of no id\nat all"), (3, "a repeated id\nb\nc"), (3, "a repeated id\nb\nc")]
    return rows, frame(spark, rows)


# --- fill in the middle ---------------------------------------------------------------------------


def plain_fim(i, text, seed=7, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text)
    h = hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize(("unit", "pattern"), [("line", r"[^\n]*\n|[^\n]+"), ("word", r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), ("char", r"(?s).")])
def test_fim_equals_the_plain_version_and_restores(spark, unit, pattern):
    rows, docs = tricky(spark)
    made = fill_middle.fim_transform(docs, unit=unit, rate=80, spm_rate=40)
    got = made.withColumn("restored", fill_middle.fim_restore("output", "form")).collect()
    want = sorted((repr((i, *plain_fim(i, t, rate=80, spm=40, unit=pattern))) for i, t in rows))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == want
    assert sorted(r.restored for r in got) == sorted(t or "" for _, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_fim_digests_at_the_contracts_parameters(spark):
    rows, docs = tricky(spark)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted(repr((i, *(p := plain_fim(i, t))[:4], sha(p[4]), sha(t or ""))) for i, t in rows)
    assert sorted(repr(tuple(r)) for r in fill_middle.fim_digests(docs).collect()) == want


def test_fim_of_nothing_and_refusals(spark):
    _, docs = tricky(spark)
    assert fill_middle.fim_digests(docs.limit(0)).count() == 0
    for markers in (("<P>", "<P>", "<M>"), ("<P>", "<", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("xy", "yz", "<M>")):
        with pytest.raises(ValueError, match="marker"):
            fill_middle.fim_transform(docs, markers=markers)
    with pytest.raises(ValueError, match="unit"):
        fill_middle.fim_transform(docs, unit="page")


def test_fim_with_own_markers_holds_the_default_ones(spark):
    docs = spark.createDataFrame([(1, "x <P> y\nz <S>\n<M>")], "doc_id long, text string")
    r = fill_middle.fim_transform(docs, markers=("[pre]", "[suf]", "[mid]")).withColumn("back", fill_middle.fim_restore("output", "form", ("[pre]", "[suf]", "[mid]"))).first()
    assert r.form != "plain" and r.back == "x <P> y\nz <S>\n<M>"


# --- whitening ------------------------------------------------------------------------------------


def vectors(seed=5, n=300, dims=7):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dims)) @ rng.normal(size=(dims, dims)) * 0.3 + 1
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(base)]
    rows += [(1000 + k, rows[7][1]) for k in range(150)]  # a third are copies of one vector
    rows += [(2000, None), (2001, [1.0] * (dims - 1) + [None]), (2002, [float("nan")] * dims), (2003, [float("inf")] + [0.0] * (dims - 1)), (2004, []), (2005, [1.0, 2.0]), (None, rows[3][1]), (5, rows[9][1]), (5, rows[9][1]), (2006, [-0.0] * dims), (2007, [0.0] * dims)]
    random.Random(1).shuffle(rows)
    return rows


def vector_frame(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, label int")
    return df.select("*", *(F.lit("clash").alias(c) for c in (*CLASH, "x", "n", "whitened", "component"))).repartition(4)


def plain_whitening(rows, dims=7, k=4):
    good = [(i, np.array(v, float)) for i, v in rows if v and len(v) == dims and None not in v and np.isfinite(v).all()]
    xs = [[int(np.floor(256 * c)) for c in v] for _, v in good]
    fit = sorted(set(map(tuple, xs)))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit) - np.array(sums) / n
    values, comps = np.linalg.eigh(y.T @ y / n)
    order = np.argsort(-values)[:k]
    out = {}
    for (i, _), x in zip(good, xs):
        white = (np.array(x) - np.array(sums) / n) @ comps[:, order] / np.sqrt(values[order])
        out.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), white))
    return n, values[order] / values.sum(), out


@pytest.mark.parametrize("tile", [2, 3, 32])
def test_whitening_equals_the_plain_version(spark, tile, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 16 * 8 * tile)  # several row-blocks a task
    rows = vectors()
    df = vector_frame(spark, rows)
    got = whitening.whitening_rows(df, whitening.fit_whitening(df, tile=tile)).collect()
    n, shares, want = plain_whitening(rows)
    assert len(got) == 4 * sum(map(len, want.values()))
    signs = {}
    for r in got:
        white = next(w for d, w in want[r.vec_id] if d == r.deviation)
        w = white[r.component - 1]
        if abs(w) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(w) == np.sign(r.whitened))
        assert r.n == n and abs(abs(r.whitened) - abs(w)) < 1e-9
        assert abs(r.explained - shares[r.component - 1]) < 1e-9 and r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values()) and len(signs) == 4


def test_whitening_of_nothing_one_vector_and_flat_dimensions(spark):
    empty = vector_frame(spark, [(1, None), (2, [])])
    assert whitening.fit_whitening(empty) is None
    assert whitening.whitening_rows(empty, None).count() == 0
    one = vector_frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])
    rows = whitening.whitening_rows(one, whitening.fit_whitening(one)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in rows) == [(i, c, 1, 0, None, 0.0) for i in (1, 2) for c in (1, 2)]
    flat = vector_frame(spark, [(i, [i / 8, 3.0]) for i in range(9)])
    rows = whitening.whitening_rows(flat, whitening.fit_whitening(flat)).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in rows) and len(rows) == 18


def test_deviations_stay_exact_beyond_64_bits():
    model = whitening.Whitening(3, [1, 2], np.eye(2), np.ones(2), 2.0, 1.0)
    assert model.deviations(np.array([[10**9, 0], [1, 1]])) == [(3 * 10**9 - 1) ** 2 + 4, 5]
    assert model.deviations(np.array([[1 << 40, 0]])) == [None]
    assert [len(p) for p in whitening._packed(np.array([[0, -128], [0, 128], [1 << 31, 0]]))] == [2, 4, 16]


# --- token files ----------------------------------------------------------------------------------


def plain_tokens(rows, end_id=2):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.default_tokenizer())
    return [(i, [*t.encode(text or "", add_special_tokens=False).ids, *([] if end_id is None else [end_id])]) for i, text in rows]


def spaced(seed):
    rng = random.Random(seed)
    parts = [" ", "  ", "\n", "\n\n", "\t", "\x1c", "\x85", "　", "᠎", "'s", "'ll", "ab", "Été", "12", "!?", "<|endoftext|>", "word,", "naïve.", "ÿ×", "a1b2", "é", "don't", "x'S", "_y", "ǅa", "ª", "日本", "\U0001d4b3", "a b", "\xa0"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(1, 40)))


def test_pieces_encode_as_the_whole():
    encode = token_files.Encoder(token_files.default_tokenizer())
    assert encode.known.alone
    texts = [spaced(s) for s in range(6000)]
    for t, (_, want) in zip(texts, plain_tokens(enumerate(texts), None), strict=True):
        assert np.frombuffer(encode(t), "<u4").tolist() == want, repr(t)


def test_token_files_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 40)
    rows, docs = tricky(spark)
    rows += [(7, "x" * 30_000), (-4, "a negative id")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string"))
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, path, partitions=5)
    got = token_files.token_digests(spark, path).orderBy("start").collect()
    want = {}
    for i, ids in plain_tokens(rows):
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
    assert not any(want.values())
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))


def test_token_files_have_stripes_encodings_and_filters(spark):
    docs = spark.range(0, 20_000, 2).selectExpr("id AS doc_id", "concat(sha2(cast(id AS string), 256), ' ', sha2(cast(-id AS string), 256)) AS text")
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(docs, path, partitions=3, stripe_bytes=1 << 16)
    files = spark.read.orc(path).inputFiles()
    orc = [pyarrow.orc.ORCFile(f.removeprefix("file://")) for f in files]
    assert len(files) == 3 and max(o.nstripes for o in orc) > 1
    found = token_files.read_tokens(spark, path, [4, 19_998, 5])
    assert sorted(r.doc_id for r in found.collect()) == [4, 19_998]
    assert found._jdf.collectToPython() is not None
    plan = found._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [In(doc_id" in plan.toString()
    scan = plan.collectLeaves().head()
    assert scan.metrics().get("numOutputRows").get().value() < 5_000  # of 10,000 rows


def test_token_files_of_nothing(spark):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(frame(spark, [(1, "x")]).limit(0), path)
    assert token_files.token_digests(spark, path).count() == 0


def test_tokens_without_an_end_id(spark):
    path = fresh_path(spark, "tokens")
    token_files.write_tokens(spark.createDataFrame([(1, "one two"), (2, None), (3, "")], "doc_id long, text string"), path, end_id=None)
    got = {r.doc_id: (r.start, r.n_tokens) for r in token_files.token_digests(spark, path).collect()}
    n = len(plain_tokens([(1, "one two")], None)[0][1])
    assert got == {1: (0, n), 2: (n, 0), 3: (n, 0)}


# --- a stock session ------------------------------------------------------------------------------

STOCK = """
import json, sys
from lexiprobe.session import local_session
import __spark_entry__ as entry
spark = local_session(4, "4g")
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
out = {}
for name, query in entry.queries().items():
    if name == "pipeline" or name.startswith("op") and name[2].isdigit():
        out[name] = query(spark, sys.argv[1]).count()
print(json.dumps(out))
"""


def test_every_operator_runs_on_a_session_without_settings(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", STOCK, "/root/testdata/sf0.001"], env=env, capture_output=True, text=True, timeout=900, cwd=os.path.dirname(token_files.__file__) + "/../..", check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    counts = json.loads(done.stdout.strip().splitlines()[-1])
    assert len(counts) == 14 and all(counts.values()), counts
