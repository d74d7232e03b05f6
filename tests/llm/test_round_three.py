"""Operators 11 to 13 against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, other columns."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from weftgraph.llm import byte_bpe, hard_negatives, periodic_runs, queries

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def odd_texts():
    r = random.Random(5)
    pool = ["a", "aa", "ab", "ba", " ", "  ", "\n", "é", "漢", "😀", "'s", "'ll", "12", "!", "--", "\t", "ing", " th", " ", " ", "<|endoftext|>"]
    return [None, "", " ", "x" * 5000, "漢字 😀😀 naïve", "don't  we'll 12345", *("".join(r.choices(pool, k=r.randint(1, 80))) for _ in range(200))]


# operator 13


def test_byte_bpe_equals_the_library(spark, library):
    rows = [(k, t, "x", k) for k, t in enumerate(odd_texts())] + [(None, "null id", "x", 1), (3, "x" * 5000, "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, pieces long").repartition(3)
    got = byte_bpe.encode_texts(docs, RANKS).collect()
    assert len(got) == len(rows)
    texts = {(d, t or "") for d, t, _, _ in rows}
    for r in got:
        text = bytes(r["decoded"]).decode()
        assert (r["doc_id"], text) in texts
        assert r["ids"] == library.encode_ordinary(text) and "".join(r["pieces"]) == text
        # each id's characters are those that its bytes touch
        of_byte = [k for k, c in enumerate(text) for _ in c.encode()]
        at = 0
        for i, a, b in zip(r["ids"], r["starts"], r["ends"], strict=True):
            n = len(library.decode_single_token_bytes(i))
            assert (a, b) == (of_byte[at], of_byte[at + n - 1] + 1)
            at += n
    digests = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.encode_digests(docs, RANKS).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    coded = {(d, t): library.encode_ordinary(t) for d, t in texts}
    assert digests == {(d, len(i), sha(np.array(i, "<u4").tobytes()), sha(t.encode())) for (d, t), i in coded.items()}
    assert byte_bpe.encode_texts(docs.limit(0), RANKS).count() == byte_bpe.encode_digests(docs.limit(0), RANKS).count() == 0


def test_pieces_are_cut_where_the_pattern_cuts(library):
    """Letters, digits and spaces of the whole of Unicode, each beside its like."""
    t = byte_bpe.tokenizer(RANKS)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"x{c}1{c} {c}  {c}!" for c in every[k : k + 500]) for k in range(0, len(every), 500)]
    assert [np.frombuffer(i, "<u4").tolist() for i in t.encode(texts)] == library.encode_ordinary_batch(texts)


def test_long_texts_are_cut_at_seams(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "STRETCH", 40)
    t = byte_bpe.ByteBpe(RANKS)
    for text in [*filter(None, odd_texts()), "a b  c   d " * 60, "word " * 99, " \n " * 70]:
        assert "".join(byte_bpe.stretches(text)) == text
        assert np.frombuffer(t.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text) == t.offsets(text)[0]


def test_ranks_whose_tokens_no_merge_reaches(tmp_path):
    """A token that its own bytes never merge to is found whole only; two ways to one token need no second merge."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cde", b"aa", b"aaaa", b"aaa", b"xyz"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    own = tiktoken.Encoding("o", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    t, r = byte_bpe.ByteBpe(str(path)), random.Random(2)
    texts = ["xyz", "axyz", "cde", "abcde"] + ["".join(r.choices("aaabcdexyz ", k=r.randint(1, 14))) for _ in range(3000)]
    assert [np.frombuffer(i, "<u4").tolist() for i in t.encode(texts)] == [own.encode_ordinary(x) for x in texts]


# operator 12


def brute_runs(a, min_length=6, min_exponent=4):
    found = {}
    for q in range(1, len(a) // min_exponent + 1):
        i = 0
        while i < len(a) - q:
            j = i
            while j < len(a) - q and a[j] == a[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_exponent * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(r, kinds, n):
    a = [f"w{r.randrange(kinds)}" for _ in range(n)]
    for _ in range(r.randint(0, 3)):
        if a:
            s = r.randrange(len(a))
            a[s : s + r.randint(1, 12)] = a[s : s + r.randint(1, 12)] * r.randint(2, 8)
    return a


def test_find_runs():
    r = random.Random(1)
    for _ in range(1500):
        a = repeating(r, r.choice([1, 2, 3, 5, 50]), r.randint(0, r.choice([12, 60, 250])))
        _, ids = periodic_runs.word_ids(" ".join(a))
        for exponent in (2, 3, 4):
            assert sorted(periodic_runs.find_runs(ids, periodic_runs.octaves(len(a), exponent), 6, exponent)) == brute_runs(a, 6, exponent)


@pytest.mark.parametrize("long", [60_000, 100])
def test_periodic_runs(spark, monkeypatch, long):
    """Also with texts dealt over ranges of lags."""
    monkeypatch.setattr(periodic_runs, "LONG", long)
    r = random.Random(long)
    texts = [None, "", " \t\n", "one", "na " * 6, "na\x0bna\x0cna na na na na na na", " ".join("ab"), *(r.choice([" ", "\n", " \t "]).join(repeating(r, r.choice([1, 2, 4, 40]), r.randint(0, 150))) for _ in range(120))]
    rows = [(k if k % 17 else None, t, "z", k) for k, t in enumerate(texts)] + [(5, "na " * 40, "z", 0)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, sha long").repartition(3)
    got = sorted(((r["doc_id"] or -1, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in periodic_runs.periodic_runs(docs).collect()), key=repr)
    want = []
    for d, t, _, _ in rows:
        words = WORDS.findall(t or "")
        runs = brute_runs(words)
        want.append((d or -1, len(words), runs, brute_collapsed(words, runs)))
    assert got == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0


def test_query_12(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = set()
    for d, t in docs.select("doc_id", "text").collect():
        w, h = WORDS.findall(t or ""), zlib.crc32(str(d).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            w = w[:a] + [w[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(a, n)]
        runs = brute_runs(w)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        want.add((d, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, brute_collapsed(w, runs)))))
    assert {tuple(r) for r in queries.op12_periodic_runs(spark, SF).collect()} == want


# operator 11


def brute_mined(rows, anchor, scale=256, positives=5, negatives=10, low=30, high=90):
    rows = [(i, x, [int(np.floor(scale * np.float64(c))) for c in v]) for i, x, v in rows if i is not None and x is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    widths = [len(v) for _, _, v in rows]
    rows = [r for r in rows if len(r[2]) == max(set(widths), key=lambda w: (widths.count(w), -w))]
    rows = [r for k, r in enumerate(rows) if r not in rows[:k]]
    out = []
    for a in rows:
        if not anchor(a[0]):
            continue
        score = lambda b, a=a: sum(x * y for x, y in zip(a[2], b[2], strict=True))
        order = sorted(((-score(b), b[0], b[1]) for b in rows if b != a))
        for s, i, _ in [x for x in order if x[2] == a[1]][:positives]:
            fit = [x for x in order if x[2] != a[1] and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a[0], i, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fit)]
    return sorted(out)


def odd_vectors(scale=1.0):
    r = np.random.default_rng(4)
    middles = r.normal(size=(6, 8))
    rows = [(k, int(r.integers(4)), (scale * (middles[k % 6] + 0.3 * r.normal(size=8))).tolist()) for k in range(400)]
    same = rows[7][2]
    rows += [(400 + k, k % 2, same) for k in range(150)]
    rows += [(600, None, same), (601, 1, None), (None, 1, same), (602, 1, [*same[:7], None]), (603, 1, [*same[:7], float("nan")]), (604, 2, [*same[:7], float("inf")]), (605, 1, []), (606, 1, same[:5]), (610, 3, [0.0] * 8), rows[20], rows[20], (20, 3, rows[1][2])]
    return rows


@pytest.mark.parametrize("scale", [1.0, 1e-3, 1e6])
def test_hard_negatives(spark, scale):
    rows = odd_vectors(scale)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, id string, part int").repartition(4)
    mined = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, per_block=32, group=4, sample=40)
    got = sorted(tuple(r) for r in mined.collect())
    assert got == brute_mined(rows, lambda i: i % 10 == 0)
    assert scale < 1 or got


def test_hard_negatives_of_little(spark):
    schema = "vec_id long, label int, embedding array<float>"
    none = spark.createDataFrame([], schema)
    assert hard_negatives.mine(none, F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, 1, [1.0])], schema)
    assert hard_negatives.mine(one, F.lit(True)).count() == 0
    assert hard_negatives.mine(one, F.lit(None).cast("boolean")).count() == 0
    few = [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5]), (3, 2, [0.5])]
    got = sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(few, schema), F.col("vec_id") == 0).collect())
    assert got == brute_mined(few, lambda i: i == 0) == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 3, 65536, 32768)]


def test_names_as_labels(spark):
    rows = odd_vectors()
    schema = "vec_id long, label string, embedding array<double>"
    named = [(i, None if x is None else f"name {x}", v) for i, x, v in rows]
    got = sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame(named, schema), F.col("vec_id") % 50 == 0).collect())
    assert got == brute_mined(rows, lambda i: i % 50 == 0)


def test_pairs_of_nodes_are_dropped():
    """Of clustered vectors most pairs of leaves go, and none that holds a wanted score."""
    r = np.random.default_rng(0)
    x = (200 * np.eye(8)[np.arange(4096) % 8] + r.normal(size=(4096, 8))).round()
    y = x[::15]

    def tree(rows, depth):
        t = hard_negatives.Tree.fitted(rows, depth)
        for node in t.paths(rows):
            np.maximum.at(t.radii, node, np.linalg.norm(rows - t.centres[node], axis=1))
        return t

    a, b = tree(y, 5), tree(x, 5)
    left = hard_negatives.left_pairs(a, b, np.full(32, 30_000.0), np.full(32, np.inf))
    assert sum(map(len, left)) < 32 * 32 / 2
    leaf, other = a.leaf_of(y), b.leaf_of(x)
    for i, j in zip(*np.nonzero(y @ x.T >= 30_000), strict=True):
        assert other[j] in left[leaf[i]]


def test_query_11(spark):
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    moved = [(i, (x + 1) % 10 if x is not None and i % 7 == 0 else x, v) for i, x, v in rows]
    assert sorted(tuple(r) for r in queries.op11_hard_negatives(spark, SF).collect()) == brute_mined(moved, lambda i: i % 100 == 0)


def test_query_13(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {(d, len(i := library.encode_ordinary(t or "")), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in docs}
    assert {tuple(r) for r in queries.op13_byte_bpe(spark, SF).collect()} == want


def test_a_group_keeps_the_best_of_its_blocks():
    rng = np.random.default_rng(3)
    whole = rng.integers(-200, 200, (400, 8))
    block = lambda at: hard_negatives.Block(at.astype(np.int64), at % 3, whole[at])
    group = block(np.arange(0, 40))
    longest = hard_negatives.LONGEST
    wants = np.array([(s, t, low, longest) for s in range(0, 40, 2) for t, low in enumerate((-longest - 1, 9_000))])
    for kind in (np.float32, np.float64, object):
        for same in (True, False):
            best = hard_negatives.Best(hard_negatives.Search(None, None, None, kind, 3, same), group, wants)
            for at in np.array_split(np.arange(400), 7):
                best.meet(block(at))
            rows = best.rows(5)
            assert set(rows["part"]) == {5}
            got = sorted(rows[["slot", "turn", "id", "score"]].itertuples(index=False, name=None))
            want = []
            for s, t, low, _ in wants.tolist():
                near = sorted((-int(whole[s] @ whole[i]), i) for i in range(400) if i != s and (i % 3 == s % 3) == same and whole[s] @ whole[i] >= low)
                want += [(s, t, i, -x) for x, i in near[:3]]
            assert got == sorted(want)
