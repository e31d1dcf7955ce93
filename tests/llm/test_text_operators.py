"""Operators 2, 4, 6, 8 and 10 against brute force, on a table with all the awkward rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import frame
from pyspark.sql import functions as F

from lexiprobe.llm import byte_bpe, exact_dedup, jaccard, line_dedup, substring_dedup
from lexiprobe.llm import kernels as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
lower = lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def got(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_exact_dedup(docs, rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    want = {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), sha(t)) for i, t in norm.items()}
    assert got(exact_dedup.exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256") == want
    assert sorted(r["doc_id"] for r in exact_dedup.keep_first_texts(docs).collect()) == sorted(i for i, w in want.items() if w[2])


def test_exact_dedup_repeats_nulls_and_second_batch(spark):
    frame_ = frame(spark, [(1, "a b"), (1, "a b"), (None, "a  b"), (None, None), (None, ""), (4, "c")])
    out = sorted((r["doc_id"] or -1, r["kept"], r["group_size"]) for r in exact_dedup.exact_dedup(frame_).collect())
    assert out == sorted([(1, True, 3), (1, False, 3), (-1, False, 3), (-1, True, 2), (-1, False, 2), (4, True, 1)])
    index = exact_dedup.DigestIndex(spark, exact_dedup.fresh_path(spark, "t"), buckets=4)
    exact_dedup.exact_dedup(frame(spark, [(9, "c"), (8, "d")]), index, "one").collect()
    second = got(exact_dedup.exact_dedup(frame(spark, [(1, "c"), (2, "e"), (3, "e")]), index, "two"), "keep_id", "kept")
    assert second == {1: (9, False), 2: (2, True), 3: (2, False)}
    assert index.read().count() == 3
    exact_dedup.exact_dedup(frame(spark, [(1, "c"), (2, "e")]), index, "two").collect()  # again: nothing is added
    assert index.read().count() == 3


def substring_brute(rows, k=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            if g in seen:
                gone.update(range(j, j + k))
            seen.add(g)
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("how", [{}, {"block_windows": 300, "buckets": 5}])
def test_substring_dedup(docs, rows, how):
    assert got(substring_dedup.substring_dedup(docs, **how), "n_words", "n_removed", "kept") == substring_brute(rows)


def test_substring_verification_undoes_collisions(spark, docs, rows):
    """With 9-bit hashes nearly every window collides: what is removed must be repeated all the same."""
    want = substring_brute(rows)
    for i, (n, gone, kept) in got(substring_dedup.substring_dedup(docs, bits=9), "n_words", "n_removed", "kept").items():
        words, left = WORD.findall(dict(rows)[i] or ""), kept.split()
        brute = want[i][2].split()
        assert n == want[i][0] and gone <= want[i][1] and len(left) == n - gone
        it = iter(left)
        assert all(w in it for w in brute) and Counter(left) - Counter(words) == Counter()  # keeps all that brute force keeps


def test_substring_paths_name_their_source(spark):
    text = " ".join(f"t{i}" for i in range(40))
    paths = got(substring_dedup.repeated_paths(frame(spark, [(1, text), (2, "x y " + text)])), "paths")
    assert [tuple(p) for p in paths[2][0]] == [(2, 21, 1, 0)]


def test_substring_repeated_and_null_ids(spark):
    text = " ".join(f"t{i}" for i in range(25))
    out = sorted((r["doc_id"] or -1, r["n_removed"]) for r in substring_dedup.substring_dedup(frame(spark, [(5, text), (5, text), (None, text)])).collect())
    assert out == [(-1, 25), (5, 0), (5, 0)]


def line_brute(rows, least=5, chars=40):
    key = lambda s: lower(s.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars:
                holders[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) >= least and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("parts", ["2", "37"])
def test_line_dedup(spark, docs, rows, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    adaptive = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a common line then spans partitions
        assert got(line_dedup.line_dedup(docs), "n_lines", "n_dropped", "kept") == line_brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", adaptive)


def test_line_that_a_boundary_cuts_is_judged_whole():
    runs = [{"hi": 1, "lo": 2, "docs": 3, "largest": 9, "smallest": 5}, {"hi": 1, "lo": 2, "docs": 2, "largest": 5, "smallest": 4}, {"hi": 7, "lo": 0, "docs": 1, "largest": 4, "smallest": 4}]
    assert line_dedup._merged(runs) == {(1, 2): (4, 9), (7, 0): (1, 4)}


def jaccard_brute(rows, k=5, percent=80):
    sets, parent = {}, {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
        parent[i] = i

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("how", [{}, {"blocks": 7, "buckets": 5}])
def test_jaccard(docs, rows, how):
    assert got(jaccard.jaccard_components(docs, **how), "n_shingles", "component_id") == jaccard_brute(rows)


def near_texts():
    """Chains of edits of a few bases, so that many pairs are near the threshold and hubs miss links, and unlike texts of shared passages."""
    rng = np.random.default_rng(9)
    out = []
    for b in range(3):
        base = [f"b{b}w{i}" for i in range(60)]
        for _ in range(25):
            w = list(base)
            for at in rng.choice(60, rng.integers(0, 3), replace=False):
                w[at] = f"e{rng.integers(0, 9)}"
            out.append(w)
    passages = [[f"p{p}w{i}" for i in range(30)] for p in range(8)]
    out += [sum((passages[p] for p in rng.choice(8, 4, replace=False)), []) for _ in range(40)]
    return [(int(i), " ".join(w)) for i, w in zip(rng.permutation(len(out)) * 7 + 1, out, strict=True)]


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_links_between_components(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(jaccard, "CHUNK", 3)
        monkeypatch.setattr(jaccard, "MEMBERS", 4)
    rows = near_texts()
    want = jaccard_brute(rows)
    assert got(jaccard.jaccard_components(frame(spark, rows)), "n_shingles", "component_id") == want


def test_jaccard_links_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "MEMBERS", 16)
    rows = near_texts()
    sets = {}
    for i, t in rows:
        w = t.split()
        sets.setdefault(frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)), []).append(i)
    name = {s: min(ids) for s, ids in sets.items()}
    all_ = list(name)
    want = {frozenset((name[a], name[b])) for x, a in enumerate(all_) for b in all_[:x] if 100 * len(a & b) >= 80 * len(a | b)}
    links, of = jaccard.jaccard_links(frame(spark, rows))
    found = [frozenset((r["class_a"], r["class_b"])) for r in links.collect()]
    assert len(want) > 50 and Counter(found) == Counter(want)
    for r in of.collect():
        own = next(s for s, ids in sets.items() if r["doc_id"] in ids)
        assert r["class_id"] == name[own] and r["n_links"] == sum(name[own] in w for w in want)


def test_unlike_texts_of_shared_passages_send_rows_in_proportion(spark, monkeypatch):
    sent = []
    real = jaccard._candidates

    def counted(members, *args):
        sent.append(members.count())
        return real(members, *args)

    monkeypatch.setattr(jaccard, "_candidates", counted)
    for n in (100, 400):
        rng = np.random.default_rng(n)
        rows = [(i, " ".join(f"p{p}w{j}" for p in rng.choice(60, 4, replace=False) for j in range(30))) for i in range(n)]
        out = got(jaccard.jaccard_components(frame(spark, rows)), "component_id")
        assert sum(c != i for i, (c,) in out.items()) <= n // 50
    assert sent[-1] <= 6 * sent[0]


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for size in (5, 100, 900, 3000):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for part in (0.5, 0.9, 1.0):
            b = np.concatenate([rng.choice(a, int(size * part), replace=False), rng.integers(0, 1 << 63, size // 5, dtype=np.uint64)])
            x, y = (np.frombuffer(jaccard.parities(s), np.uint64)[None, :] for s in (a, b))
            assert jaccard._differ(x, y)[0] <= len(np.setxor1d(a, b))


def test_jaccard_chains_of_near_copies(spark):
    """Links only from one to the next: the ends are joined through all between."""
    text = [f"c{i}" for i in range(80)]
    chain = []
    for i in range(14):
        chain.append((100 - i, " ".join(text)))
        text = [*text[2:], f"n{i}a", f"n{i}b"]
    want = jaccard_brute(chain)
    assert len({c for _, c in want.values()}) == 1
    assert got(jaccard.jaccard_components(frame(spark, chain)), "n_shingles", "component_id") == want


def test_trie_overlaps_match_sets():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    probe = np.sort(rng.choice(pool, 120, replace=False))
    many = [np.sort(np.unique(np.concatenate([rng.choice(probe, rng.integers(80, 121), replace=False), rng.choice(pool, 9)]))) for _ in range(60)]
    want = [i for i, m in enumerate(many) if 100 * len(np.intersect1d(m, probe)) >= 80 * len(np.union1d(m, probe))]
    assert want and len(want) < 60 and jaccard.trie_overlaps(probe, many, 80) == want


def test_bpe_matches_the_library(spark, docs, rows):
    enc = byte_bpe._encoder(*byte_bpe.default_vocabulary())
    extra = [(1000 + i, t) for i, t in enumerate(["  two  spaces ", "a\n b\n\n c \n \n d", "  x　 y", "it's we'll 'd", "🙂🙂 é", "<|endoftext|>", " ", "z" * 3000, "\r\n\t mixed \x0b\x0c"])]
    both = rows + extra
    out = got(byte_bpe.bpe_digests(frame(spark, both), block_chars=3000, buckets=7), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, t in both:
        ids = enc.encode_ordinary(t or "")
        assert out[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t or "")), repr(t)[:80]


def test_bpe_with_another_pattern(spark):
    """A pattern by which blanks do not start pre-tokens: texts must not be split there."""
    path, pattern = byte_bpe.default_vocabulary()[0], r"\w+ ?|[^\w]+"
    import tiktoken

    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=byte_bpe._ranks(path), special_tokens={})
    rows = [(1, "some words and more words, here"), (2, "a  b c")]
    out = got(byte_bpe.bpe_encode(frame(spark, rows), pattern=pattern), "ids")
    assert {i: np.frombuffer(x, "<u4").tolist() for i, (x,) in out.items()} == {i: enc.encode_ordinary(t) for i, t in rows}


def test_each_word_of_a_bucket_is_encoded_once(monkeypatch):
    import pyarrow as pa

    calls = []

    class Encoder:
        def encode_ordinary(self, w):
            calls.append(w)
            return [len(w)]

    monkeypatch.setattr(byte_bpe, "_encoder", lambda *_: Encoder())
    row = lambda to, words: byte_bpe._row(to, 1, 0, K.pack_all(K.pack(np.arange(len(words))), K.pack(np.array([len(w) for w in words])), K.zstandard.ZstdCompressor().compress("".join(words).encode())))
    out = list(byte_bpe._encode_words("p", "x")([row(0, ["a", "bb"]), row(0, ["bb", "ccc"]), row(1, ["d"])]))
    assert calls == ["a", "bb", "ccc", "d"] and len(out) == 3 and isinstance(out[0], pa.RecordBatch)


@pytest.mark.parametrize("total", [10**8, 10**10, 10**12])
def test_rows_between_blocks_and_buckets_grow_with_the_input(total):
    from lexiprobe.llm.shared import ROW_BYTES, UNIT, deal

    each, buckets = deal(total)
    rows = -(-total // each) * buckets
    assert each * buckets >= total and rows <= max(8 * (total // UNIT + 8), 2 * total / ROW_BYTES)


def test_bpe_round_trip_keeps_repeated_rows(spark):
    rows = [(1, "same"), (1, "same"), (None, "none"), (None, None)]
    out = byte_bpe.bpe_decode(byte_bpe.bpe_encode(frame(spark, rows))).select("doc_id", F.col("decoded").cast("string").alias("t")).collect()
    assert Counter((r[0], r[1]) for r in out) == Counter([(1, "same"), (1, "same"), (None, "none"), (None, "")])


def test_packing_round_trips():
    for values in ([], [0], [5, 1, 300], [127, 128, 129, 255, 1 << 20, (1 << 23) - 1], [1 << 40, 3]):
        a = np.array(values, np.uint64)
        assert K.unpack(K.pack(a)).tolist() == values
        assert K.unpack_ranks(K.pack_ranks(a)).tolist() == values
    assert K.unpack_ids(K.pack_ids([3, None, -7])) == [3, None, -7]
    assert substring_dedup._unpack_ids(substring_dedup._pack_ids(np.array([-5, 9, 1 << 62]))).tolist() == [-5, 9, 1 << 62]


@pytest.mark.parametrize("run", [exact_dedup.exact_dedup, substring_dedup.substring_dedup, jaccard.jaccard_components, line_dedup.line_dedup, byte_bpe.bpe_digests])
def test_empty_tables(none, run):
    assert run(none).collect() == []
