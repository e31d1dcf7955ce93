"""Operators 1, 3, 5, 7 and 9, and the pipeline."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import frame
from pyspark.sql import functions as F

from lexiprobe.llm import ann, mixing, pii, quality, toxicity
from lexiprobe.llm.labelled import held_out


def labelled(spark, n=160):
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        docs.append((i, f"plain words number {i} here " + ("you utter grumpfish " if bad else "a pleasant day ") + f"and more text {i % 7}"))
        labels.append((i, 0 if i % 5 == 0 else 1, int(bad)))
    docs += [(n + 1, None), (n + 2, ""), (None, "grumpfish again"), (3, docs[3][1])]
    labels += [(None, 1, 1), (2, None, None), (99999, 1, 1), (3, 1, 0)]
    return frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_is_calibrated(spark):
    docs, labels = labelled(spark)
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == 164
    for r in out:
        assert 0.0 <= r["score"] <= 1.0 and r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None and r["doc_id"] < 160:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["predicted"] == (r["doc_id"] % 4 == 0)
    toxic = next(r for r in out if r["doc_id"] == 4)
    assert toxic["evidence"] and all(e["label"] == 1 for e in toxic["evidence"])
    assert next(r for r in out if r["doc_id"] is None)["held_out"]


def test_toxicity_looks_at_text_alone(spark):
    docs, labels = labelled(spark)
    a = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, labels).collect()}
    swapped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    b = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, swapped).collect()}
    assert a == b  # labels of held-out rows change nothing


def test_toxicity_learns_from_a_few_examples(spark):
    """All terms count: a handful of toxic examples, which no test of significance would tell from chance, still rank a text."""
    docs = [(i, f"plain words {i} a pleasant day with text {i % 7}") for i in range(60)] + [(100 + i, f"{w} grumpfish nitwort") for i, w in enumerate(("you", "utter", "such", "silly", "what"))]
    labels = [(i, 1, int(i >= 100)) for i, _ in docs]
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(frame(spark, [*docs, (500, "grumpfish nitwort"), (501, "a pleasant day")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert out[500]["score"] > out[501]["score"] and out[500]["evidence"][0]["label"] == 1
    assert out[501]["evidence"][0]["label"] == 0  # clean terms are in the index too


def brute_nearest(index, q, k):
    """Cosines of the query with every example, one by one, to the k nearest."""
    wide = dict(zip(*(x.tolist() for x in q), strict=True))
    found = []
    for i in range(len(index)):
        c = sum(w * wide.get(t, 0.0) for t, w in zip(*(x.tolist() for x in index.example(i)), strict=True))
        if c > 1e-15:
            found.append((-round(c, 12), i))
    return sorted(found)[:k]


@pytest.mark.parametrize("common", [2, 16, 10**9])
def test_nearest_examples_are_exact(monkeypatch, common):
    monkeypatch.setattr(toxicity, "BLOCK", 32)
    monkeypatch.setattr(toxicity, "COMMON", common)
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(40, rng.integers(0, 9), replace=False)) for _ in range(500)]
    row, term = np.concatenate([[0], np.cumsum([len(r) for r in rows])]), np.concatenate(rows).astype(np.int64)
    weight = rng.uniform(0, 3, 40)
    weight[3] = 0.0
    index = toxicity.BlockMaxIndex(row, term, rng.integers(1, 4, len(term)), weight)
    queries = [index.example(i) for i in range(60)] + [(np.zeros(0, np.int64), np.zeros(0))]
    for q, got in zip(queries, index.nearest(queries, 25), strict=True):
        want = brute_nearest(index, q, 25)
        assert np.allclose([c for c, _ in got], [-c for c, _ in want]) and len(got) == len(want)
    for i, got in enumerate(index.nearest(queries[:60], 25, list(range(60)))):
        assert i not in [p for _, p in got]


def plain_scores(docs, labels):
    """All of op1 again without its index: dense vectors, sorted cosines, votes, pooled steps."""
    kept = {i: t or "" for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 5}
    y = {i: t for i, t in labels if i in kept and t in (0, 1)}
    ids = sorted(y)
    words = lambda t: Counter(toxicity._WORD.findall((t or "").lower()))
    seen = {i: words(kept[i]) for i in ids}
    n = [sum(y[i] == c for i in ids) for c in (0, 1)]
    df = [Counter(w for i in ids if y[i] == c for w in seen[i]) for c in (0, 1)]
    pairs = [sum(f.values()) for f in df]
    add = [toxicity.SHRINK * p / sum(pairs) for p in pairs]
    weight = {}
    for w in set(df[0]) | set(df[1]):
        share = [math.log((df[c][w] + add[c]) / (pairs[c] + add[c])) for c in (0, 1)]
        contrast = abs(share[1] - share[0]) - math.sqrt(sum(1 / (df[c][w] + add[c]) for c in (0, 1)))
        weight[w] = max(0.0, math.log((1 + len(ids)) / (df[0][w] + df[1][w]))) * max(0.0, contrast)

    def vector(found):
        v = {w: (1 + math.log(c)) * weight[w] for w, c in found.items() if w in weight}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {w: x / norm for w, x in v.items()}

    example = {i: vector(seen[i]) for i in ids}
    blank = (sum(y[i] for i in ids if not seen[i]) + n[1] / len(ids)) / (sum(1 for i in ids if not seen[i]) + 1)

    def vote(v, without=None):
        near = sorted((-round(sum(x * example[i].get(w, 0.0) for w, x in v.items()), 12), i) for i in ids if i != without)[: toxicity.NEIGHBOURS]
        near = [(-c, i) for c, i in near if c < 0]
        return (sum(c * c * y[i] for c, i in near) + toxicity._LITTLE * blank) / (sum(c * c for c, _ in near) + toxicity._LITTLE)

    own = [vote(example[i], i) for i in ids]
    corners = toxicity._monotone(np.array(own), np.array([float(y[i]) for i in ids]), np.ones(len(ids)))
    return [float(np.interp(vote(vector(words(t))), *corners)) for _, t in docs]


def test_monotone_map_against_all_averages():
    """Pooling gives at each x the largest, over starts, of the smallest, over ends, mean between them."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = rng.permutation(30).astype(float), rng.integers(0, 2, 30).astype(float)
        corners = toxicity._monotone(x, y, np.ones(30))
        z, mean = y[np.argsort(x)], y.mean()
        for i in range(30):
            runs = [[(z[s : e + 1].mean(), e + 1 - s) for e in range(i, 30)] for s in range(i + 1)]
            want = max(min(v for v, _ in r) for r in runs)
            n = max(k for r in runs for v, k in r if abs(v - want) < 1e-12)
            assert abs(np.interp(i, *corners) - (want * n + mean) / (n + 1)) < 0.05
        assert (np.diff(corners[1]) >= 0).all()


def test_toxicity_end_to_end_against_a_plain_version(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(80)] + ["naïve", "Été", "x" * 300]
    docs, labels = [], []
    for i in range(150):
        text = " ".join(rng.choice(vocabulary, rng.integers(3, 30)))
        bad = i % 6 == 0
        docs.append((i, text + (" Nitwit, grumpfish!" if bad and i % 12 else " nitwit" if bad else "")))
        labels.append((i, int(bad)))
    docs += [(200, None), (201, ""), (202, "entirely unknown"), (203, "grumpfish " * 40_000), (None, "nitwit")]
    table = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int")
    got = {(r["doc_id"], i): r["score"] for i, r in enumerate(toxicity.score_toxicity(frame(spark, docs, 1), table).collect())}
    want = plain_scores(docs, labels)
    assert np.allclose([got[(d[0], i)] for i, d in enumerate(docs)], want, atol=1e-6)
    assert want[153] > 0.5 > want[150]


def plain_sites(rows):
    """(host, path) to the two posteriors, and the global rate, from (host, path, p), in plain Python."""
    total, mean = len(rows), sum(p for _, _, p in rows) / len(rows)
    hosts, paths = {}, {}
    for h, t, p in rows:
        for d, key in ((hosts, h), (paths, (h, t))):
            y, n = d.get(key, (0.0, 0))
            d[key] = (y + p, n + 1)

    def strength(spread, squares, groups):
        inside = mean * (1 - mean)
        return min(1e6, max(1.0, inside / max((spread - (groups - 1) * inside) / max(total - squares / total, 1e-9), 1e-9) - 1))

    k = strength(sum(n * (y / n - mean) ** 2 for y, n in hosts.values()), sum(n * n for _, n in hosts.values()), len(hosts))
    rate = {h: (y + k * mean) / (n + k) for h, (y, n) in hosts.items()}
    within = sum(n * (y / n - rate[h]) ** 2 for (h, _), (y, n) in paths.items())
    k2 = strength(within, sum(n * n / hosts[h][1] for (h, _), (_, n) in paths.items()) * total / max(1, len(hosts)), len(paths) - len(hosts) + 1)
    return {(h, t): (rate[h], (y + k2 * rate[h]) / (n + k2)) for (h, t), (y, n) in paths.items()}, mean


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_quality_of_pages_by_host_and_path(spark, monkeypatch, broadcast):
    """Hosts and paths from URLs, as of pages, against plain Python; null, empty, long and repeated rows too."""
    monkeypatch.setattr(quality, "BROADCAST_SITES", broadcast)
    docs, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        host, path = f"h{i % 6}.org", f"/{'abc'[i // 7 % 3]}/{i}"
        docs.append((i, " ".join(("###$$$%%%" if bad else f"word{(i * 7 + j) % 50}") for j in range(20 + i % 9)), f"https://{host}{path}"))
        labels.append((i, int(not bad), 0))
    docs += [(300, None, "https://h1.org/a/x"), (301, "", None), (302, "good words " * 30_000, "https://new.org/"), (5, docs[5][1], docs[5][2]), (None, "###$$$%%%", "https://h1.org/a/x")]
    table = spark.createDataFrame(docs, "doc_id long, text string, url string").withColumn("host", F.lit("clash")).withColumn("evidence", F.lit("clash"))
    host, path = F.regexp_extract("url", r"^https?://([^/]+)", 1), F.regexp_extract("url", r"^https?://[^/]+(/[^/]*)", 1)
    host, path = F.when(F.col("url").isNotNull(), host), F.when(F.col("url").isNotNull(), path)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = [r.asDict() for r in quality.score_quality(table, known, host, path).collect()]
    assert Counter(r["doc_id"] for r in out) == Counter(d[0] for d in docs)
    of = {r["doc_id"]: r for r in out}
    out = [of[d[0]] for d in docs]
    site = lambda u: (u.split("/")[2], "/" + u.split("/")[3]) if u else (None, None)
    y = {i: q for i, q, _ in labels if zlib.crc32(str(i).encode()) % 5}
    rows = [(*site(d[2]), float(y[d[0]]) if d[0] in y else 1 / (1 + math.exp(-r["evidence"]))) for d, r in zip(docs, out, strict=True)]
    posts, mean = plain_sites(rows)
    logit = lambda p: math.log(min(1 - 1e-6, max(1e-6, p)) / (1 - min(1 - 1e-6, max(1e-6, p))))
    for d, r in zip(docs, out, strict=True):
        h, t = posts[site(d[2])]
        score = 1 / (1 + math.exp(-(r["evidence"] + logit(t) - logit(mean))))
        assert abs(r["host_rate"] - h) < 1e-9 and abs(r["path_rate"] - t) < 1e-9 and abs(r["score"] - score) < 1e-6
        assert r["keep"] == (r["score"] >= 0.5)
    assert sum(r["keep"] for r in out[:240]) == 160


def test_quality_separates_and_keeps(spark):
    docs, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        docs.append((i, " ".join(("###$$$%%%" if bad else f"word{(i * 7 + j) % 50}") for j in range(30))))
        labels.append((i, int(not bad), 0))
    docs += [(900, None), (901, ""), (None, "word1 word2 word3")]
    d, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.score_quality(d, lab, *quality.documents_sites()).collect()}
    assert len(out) == 203 and all(out[i]["keep"] == (i % 5 != 0) for i in range(200))
    kept = quality.score_quality(d, lab, *quality.documents_sites(), carry=True)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["keep"]}


def test_sites_shrink_towards_their_parents(spark):
    rows = [("big", "big/a", 1.0)] * 400 + [("big", "big/b", 0.0)] * 2 + [("low", "low/a", 0.0)] * 300 + [("tiny", "tiny/a", 1.0), (None, "x", 0.5)]
    sites, mean = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double"))
    by = {r["path"]: r for r in sites.collect()}
    assert len(by) == 5 and by["big/a"]["path_rate"] > 0.9 and by["low/a"]["path_rate"] < 0.1
    assert by["big/b"]["path_rate"] > 0.0 and mean < by["tiny/a"]["host_rate"] < 1.0


def test_without_labels(spark):
    docs, labels = labelled(spark, 8)
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs, labels.limit(0), *quality.documents_sites()).count() == 12


def test_empty_tables(spark, none):
    labels = labelled(spark, 8)[1]
    assert toxicity.score_toxicity(none, labels).collect() == []
    assert quality.score_quality(none, labels, *quality.documents_sites()).collect() == []
    assert mixing.mix_sources(none).collect() == []
    assert pii.find_pii(none).collect() == []
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def plain_copies(doc, mean, seed=7):
    def u(*parts):
        return int(hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:13], 16) / (1 << 52)

    parts = max(1, math.ceil(mean / 16))
    total = 0
    for j in range(1, parts + 1):
        p = c = math.exp(-mean / parts)
        k, x = 0, u("copies", seed, doc, j)
        while c <= x and k < 97:
            k += 1
            p *= mean / parts / k
            c += p
        total += k
    return total


def test_mixing_draws_poisson_numbers(spark):
    rows = [(i, f"t{i}") for i in range(300)]
    docs = frame(spark, rows)
    n = Counter(r["source"] for r in docs.select("source").collect())
    out = mixing.mix_sources(docs, {"s0": 3, "s1": 1, "": 1}, rows=6000).collect()
    share = {"s0": 3 / 5, "s1": 1 / 5, None: 1 / 5}
    have = Counter(r["doc_id"] for r in out)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    want = {i: plain_copies(i, 6000 * share[s] / n[s]) for i, s in source.items() if s in share}
    assert have == Counter({i: c for i, c in want.items() if c})
    assert abs(len(out) - 6000) < 500 and max(want.values()) > 16
    assert len({(r["doc_id"], r["copy"]) for r in out}) == len(out) and {r["digest"] for r in out} == {"clash"}


def test_mixing_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = frame(spark, [(i, "t") for i in range(60)])
    a = sorted((r["doc_id"], r["copy"], r["mix_key"]) for r in mixing.mix_sources(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted((r["doc_id"], r["copy"], r["mix_key"]) for r in mixing.mix_sources(docs).collect()) == a


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500 + i, x[3].tolist()) for i in range(30)]
    bad = [(601, None), (602, [0.0] * 12), (603, [None] + [1.0] * 11), (604, [float("nan")] * 12), (605, [1.0]), (None, [1.0] * 12), (606, [])]
    out = ann.nearest(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>"), probes=10_000).collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in out}
    hit = total = 0
    for q in range(0, len(ids)):
        if ids[q] % 20:
            continue
        score = (m * m[q]).sum(1)
        score[q] = -np.inf
        best = np.lexsort((ids, -score))[:20]
        near = [found[int(ids[q]), r] for r in range(1, 21)]
        assert all(abs(s - float(m[ids == v][0] @ m[q])) < 1e-12 for v, s in near) and [s for _, s in near] == sorted((s for _, s in near), reverse=True)
        hit += len({v for v, _ in near} & set(ids[best].tolist()))
        total += 20
        assert near == sorted(near, key=lambda x: (-x[1], x[0]))  # ties to the smaller id
    assert hit / total >= 0.98 and not {v for v, _ in found.values()} & {601, 602, 603, 604, 605, 606}


def test_hot_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_VECTORS", 50)
    monkeypatch.setattr(ann, "CHUNK_QUERIES", 3)
    rows = [(i, [1.0, 0.0, 0.5]) for i in range(300)] + [(300 + i, [0.0, 1.0, float(i)]) for i in range(50)]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), probes=1000).filter("query_id = 0 AND rank <= 20").orderBy("rank").collect()
    assert len(out) == 20 and len({r["vec_id"] for r in out}) == 20


def test_short_lists_are_widened(spark):
    """One list holds fewer others than are asked for: the query goes on through all lists."""
    rng = np.random.default_rng(8)
    rows = [(i, (np.eye(8)[i % 8] * 5 + rng.standard_normal(8) * 0.1).tolist()) for i in range(160)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("query_id", F.lit("clash")).withColumn("list", F.lit(0))
    out = ann.nearest(table, k=60, probes=1).collect()
    assert Counter(r["query_id"] for r in out) == Counter({q: 60 for q in range(0, 160, 20)})
    every = ann.nearest(table, k=500, probes=1).collect()
    assert Counter(r["query_id"] for r in every) == Counter({q: 159 for q in range(0, 160, 20)})


def test_fitted_probes_reach_the_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    out = ann.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    found = {}
    for r in out:
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = 0
    for q in range(0, 3000, 20):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-score)[:20].tolist()))
    assert hit / (20 * 150) >= 0.9 and all(len(v) == 20 for v in found.values())


def test_few_candidates_all_return(spark):
    out = ann.nearest(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 0.0])], "vec_id long, embedding array<float>")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out] == [(0, 1, 1, 1.0)]


CASES = {
    "mail a.b@x.org, 10.0.0.255 and 10.0.0.256": "email:5:14,ip:16:26",
    "card 4111 1111 1111 1111 not 4111 1111 1111 1112": "card:5:24",
    "call +1 (906) 555-7738 now": "phone:5:22",
    "a@b @c.de x@y.z@w.v": "email:10:15",
    "1.2.3.4.5.6.7.8": "ip:0:7,ip:8:15",
    "": "",
}


def test_base_entities():
    for text, want in CASES.items():
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(text)) == want, text


def plain_base(text):
    """The contract's four expressions, run plainly."""
    import re

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    tests = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    }
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, (p, ok)) in enumerate(tests.items()) for m in re.finditer(p, text) if ok(m)]
    return ",".join(x for _, _, x in sorted(found))


def test_base_entities_against_the_expressions():
    rng = np.random.default_rng(4)
    parts = ["a.b@x.org", "@", ".", "-", " ", "+", "1", "255", "256", "0007", "4111 1111 1111 1111", "+1 (906) 555-7738", "é", "x", "10.0.0.1", "(", ")", "4111-1111-1111-1111", "%", "_", "٣", "\n", "日"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 14)))
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(text)) == plain_base(text), repr(text)
    for text in ("a@b.c " * 3000, "1." * 5000 + "x", "a" * 20_000 + "@" + "b.c" * 10, "1 " * 9000):
        assert ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in pii.base_spans(text)) == plain_base(text)


def test_context_is_the_two_tokens_before():
    assert pii._before("Reach Mail:u@x", 11) == "mail :" and pii._before("(x", 1) == " (" and pii._before("x", 0) == " "
    assert pii._before("ab", 1) is None and pii._before("w " + "y" * 500 + " x", 503) == f"w {'y' * 500}"
    texts = ["Reach Mail:(x y", "", "a", "é, b  c!"]
    data, offsets = pii.K.text_buffer(pii.pa.array(texts))
    pairs = [x for t in texts for m in pii._TOKEN.finditer(t) for x in [pii._before(t, m.start())]]
    assert pii._pairs(data, offsets).tolist() == pii._pattern_hashes(pairs).tolist()


def test_unseen_identifiers_behind_punctuation(spark):
    rows = [(i, f"see (Email:u{i}@host.org) end") for i in range(12)] + [(100, "x (Email:u5x(at)host(dot)org) bye"), (100, "x (Email:u5x(at)host(dot)org) bye"), (101, "u5x(at)host(dot)org " + "word " * 30_000)]
    out = [(r["doc_id"], r["n_added"]) for r in pii.find_pii(frame(spark, rows)).collect()]
    assert out.count((100, 1)) == 2 and out.count((101, 0)) == 1 and sum(n for _, n in out) == 2


def test_patterns_discover_what_is_unseen(spark):
    rows = [(i, f"reach mail: u{i}@host.org end") for i in range(12)] + [(100, "reach mail: u5x(at)host(dot)org bye"), (101, "we saw 12 u5x(at)host(dot)org bye"), (102, None), (None, "nothing 7 here"), (None, "reach mail: q@r.st")]
    out = {(r["doc_id"], r["spans"]): r["n_added"] for r in pii.find_pii(frame(spark, rows)).collect()}
    assert len(out) == 17 and out[100, "email:12:31"] == 1 and out[101, ""] == 0 and out[None, "email:12:18"] == 0
    assert sum(out.values()) == 1


def test_common_words_make_no_pattern(spark):
    rows = [(i, f"it is the one u{i}@host.org " + "and it is the one thing " * 40) for i in range(12)] + [(100, "it is the one u5x(at)host(dot)org")]
    assert sum(r["n_added"] for r in pii.find_pii(frame(spark, rows)).collect()) == 0


def test_patterns_beyond_a_run_are_rated(spark):
    """A frequent pattern of low confidence pushes no rarer, confident one out."""
    rows = [(i, f"it is the one u{i}@host.org " + "and it is the one thing " * 20) for i in range(12)] + [(50 + i, f"reach mail: v{i}@host.org end") for i in range(5)] + [(100, "reach mail: v5x(at)host(dot)org bye")]
    want = pii.find_pii(frame(spark, rows)).sort("doc_id").collect()
    assert sum(r["n_added"] for r in want) == 1
    assert pii.find_pii(frame(spark, rows), patterns_per_run=1).sort("doc_id").collect() == want


def test_held_out_is_crc32(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_pipeline_stage_by_stage(spark, sf, tmp_path):
    import os

    import corpus_pipeline as C
    from test_text_operators import jaccard_brute

    d = f"/root/testdata/{sf}"
    if not os.path.isdir(d):
        pytest.skip("no test data")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(C.STAGES):
        before = docs
        stage(spark, docs, d).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        assert i == 4 or docs.columns == before.columns
        kept.append((before, docs))
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    a, b = texts(kept[1][0]), texts(kept[1][1])
    first = {}
    for i, t in sorted(a.items()):
        first.setdefault(" ".join(t.split()), i)
    assert set(b) == set(first.values())
    assert set(texts(kept[2][1])) == {i for i, (_, c) in jaccard_brute(list(b.items())).items() if c == i}
    mixed, encoded = kept[4]
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter(r["doc_id"] for r in encoded.collect())
    assert {(r["doc_id"], r["decoded_sha256"]) for r in encoded.collect()} == {(r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect()}
    again = C.run(spark, d)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, encoded.collect()))
