"""The ten operators against brute force on small fixtures with nulls, empty and long texts, ties and repeats."""

import hashlib
import re
import time
import zlib
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from weftgraph.llm import ann, bpe, chat_format, exact_dedup, html_text, ngram_join, packing, suffix_dedup, token_counts, toxicity
from weftgraph.llm.common import components

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def some_texts():
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(r.choice(words, 3000))
    shared = " ".join(r.choice(words, 120))
    own = [" ".join(r.choice(words, 150)) for _ in range(12)]
    near = own[0].split()
    near[75] = "changed"
    return [None, "", "", " ", "one", "one two", long, long, own[0], " ".join(near), *own[1:6], own[6] + " " + shared + " " + own[7], own[8] + " " + shared, "a" * 500, "naïve 😀  'tis  it's<|endoftext|> we'll \n\n\t end ", "ÄÖ 漢字かな" * 40, "Zz" * 150 + shared, own[9], own[9].upper()]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 3 % 101, t, "x", k) for k, t in enumerate(some_texts())] + [(None, "a null id", None, None), (None, None, None, None), (5, "one", "y", 1), (5, "one", "y", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def pairs_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def test_packing(docs, empty, library):
    got = packing.pack_documents(docs, PATH, with_ids=True).collect()
    want = sum(-(-(len(library.encode(t, add_special_tokens=False).ids) + 1) // 1024) for _, t in pairs_of(docs))
    assert len(got) == want
    held = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(bpe.pack_ids(r["ids"])) and len(r["ids"]) == r["length"] <= 1024
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in got)
    assert len(held) <= -(-total // 1024) + 1
    assert packing.pack_documents(empty, PATH).count() == 0


def test_plan_slots_fills_every_item():
    r = np.random.default_rng(3)
    for _ in range(30):
        histogram = {int(k): int(n) for k, n in zip(r.choice(np.arange(1, 65), 12, replace=False), r.integers(1, 50, 12), strict=True)}
        slots = packing.plan_slots(histogram, 64)
        for length, n in histogram.items():
            ranks = sorted((s[1], s[2]) for s in slots if s[0] == length)
            assert sum(x[1] for x in ranks) == n and all(a + m == b for (a, m), (b, _) in zip(ranks, ranks[1:], strict=False))


def test_bpe_and_counts(docs, empty, library):
    want = sorted((d or -1, library.encode(t, add_special_tokens=False).ids, library.decode(library.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)) for d, t in pairs_of(docs))
    got = sorted((r["doc_id"] or -1 if r["doc_id"] != 0 else -1, r["ids"], r["decoded"]) for r in bpe.encode_texts(docs, PATH).collect())
    assert got == want
    digests = sorted(r["ids_sha256"] for r in bpe.encode_digests(docs, PATH).collect())
    assert digests == sorted(hashlib.sha256(bpe.pack_ids(w[1])).hexdigest() for w in want)
    counted = token_counts.token_counts(docs, PATH, 512).collect()
    assert sorted((r["n_tokens"], r["over_limit"]) for r in counted) == sorted((len(w[1]), len(w[1]) > 512) for w in want)
    assert sorted(r["n_bytes"] for r in counted) == sorted(len(t.encode()) for _, t in pairs_of(docs))
    assert bpe.encode_digests(empty, PATH).count() == token_counts.token_counts(empty, PATH).count() == 0


def test_every_prefix(library):
    c = token_counts.counter(PATH)
    for text in ["we'll see  it's\n\n 12345 naïve 😀!", "  a  b", "x" * 30, "don't <|endoftext|>"]:
        got = c.prefixes(text)
        for i in range(len(text) + 1):
            if "<|" not in text or i == len(text):
                assert got[i] == len(library.encode(text[:i], add_special_tokens=False).ids), (text, i)


def test_exact(docs, empty):
    rows = pairs_of(docs)
    want = {}
    for d, t in rows:
        want.setdefault(t, []).append(d)
    got = exact_dedup.exact_groups(docs).collect()
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(want)
    for r in got:
        same = next(v for t, v in want.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"] and r["doc_id"] in v)
        assert r["group_size"] == len(same) and r["keep_id"] == max((x for x in same if x is not None), default=None)
    # names that collide change nothing
    clash = exact_dedup.exact_groups(docs, lambda c: F.length(c) % 2)
    assert sorted(map(repr, clash.collect())) == sorted(map(repr, got))
    assert exact_dedup.exact_dedup(docs).columns == docs.columns and exact_dedup.exact_dedup(docs).count() == len(want)
    assert exact_dedup.exact_groups(empty).count() == 0


def brute_components(rows, n, t):
    sets = []
    for _, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and t.denominator * both >= t.numerator * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [d]
        out.append((d, len(sets[i]), min((x for x in ids if x is not None), default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("n", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_ngram_join(docs, empty, n, t):
    got = sorted((tuple(r) for r in ngram_join.ngram_components(docs, n, t).select("doc_id", "n_shingles", "component_id").collect()), key=repr)
    assert got == brute_components(pairs_of(docs), n, t)
    assert ngram_join.ngram_components(empty, n, t).count() == 0


def test_passes_hold_every_name_once(spark):
    names = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 500).tolist()
    df = spark.createDataFrame([(names,)], "names array<long>")
    (r,) = df.select(*[ngram_join.names_of_pass(i).alias(f"p{i}") for i in range(ngram_join.PASSES)]).collect()
    assert all(len(p) for p in r) and sorted(x for p in r for x in p) == sorted(names)


@pytest.mark.parametrize(("n", "t"), [(5, Fraction(4, 5)), (3, Fraction(9, 10))])
def test_near_copies_of_hundreds_of_words(spark, n, t):
    r = np.random.default_rng(6)
    rows = []
    for k in range(60):
        own = [f"v{x}" for x in r.integers(0, 50_000, 300 + 12 * k)]
        near = list(own)
        for at in r.choice(len(own), 4, replace=False):
            near[at] = "changed"
        # the longer one of some pairs is in the size class above
        near += [f"more{k}x{x}" for x in range(len(own) // 40)]
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(near))]
    sets = [ngram_join.shingle_set(x, n) for _, x in rows]
    classes = [ngram_join.classes_of(len(s), t)[0] for s in sets]
    assert any(a != b for a, b in zip(classes[::2], classes[1::2], strict=True))
    assert all(len(np.intersect1d(a, b)) >= t * len(np.union1d(a, b)) for a, b in zip(sets[::2], sets[1::2], strict=True))
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), n, t).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == {k: k // 2 * 2 for k in range(120)}


@pytest.mark.parametrize("t", [Fraction(4, 5), Fraction(9, 10)])
def test_slices_tie_partners_and_little_else(t):
    r = np.random.default_rng(7)
    names = lambda s: set(ngram_join.slice_names(np.unique(s), t).tolist())
    draw = lambda n: r.integers(0, 2**64, n, dtype=np.uint64)
    for size in [*range(1, 60), *range(60, 900, 40)]:
        for _ in range(5):
            own = draw(size)
            # as many elements changed, gone or new as a link allows
            kept = own[: -(-2 * size * t.numerator // (t.numerator + t.denominator))]
            for other in (np.concatenate([kept, draw(size - len(kept))]), own[: -(-size * t.numerator // t.denominator)], np.concatenate([own, draw(int(size / t) - size)])):
                both = len(np.intersect1d(own, other))
                assert both >= t * (len(own) + len(other) - both)
                assert names(own) & names(other)
    # sets of one size class without a common element
    seen = [names(draw(n)) for n in range(450, 650, 2) for _ in range(5)]
    assert sum(map(len, seen)) == len(set().union(*seen))


def test_sets_of_large_clusters_are_not_written_once_a_region(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "IN_TASK", 30)
    written, shuffled, materialise, in_tasks = [], [], ngram_join.materialise, ngram_join._join_in_tasks

    def seen(df, name="step"):
        out = materialise(df, name)
        if "s" in out.columns:
            written.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", seen)
    monkeypatch.setattr(ngram_join, "_join_in_tasks", lambda members, *a: shuffled.append(members.count()) or in_tasks(members, *a))
    r = np.random.default_rng(11)
    sets = [np.sort(r.integers(0, 2**64, 50, dtype=np.uint64)) for _ in range(150)]
    sets += [np.sort(np.append(s[:-1], r.integers(0, 2**64, 1, dtype=np.uint64))) for s in sets[:40]]
    members = spark.createDataFrame([(1, k, bytearray(s.tobytes())) for k, s in enumerate(sets)], "grp long, node long, s binary")
    links = ngram_join._join_over_tasks(members, Fraction(9, 10)).distinct().collect()
    assert {tuple(sorted((x["a"], x["b"]))) for x in links} == {(k, 150 + k) for k in range(40)}
    assert max(written) <= len(sets)
    assert max(shuffled) < 4 * len(sets)  # all pairs of blocks at once take thirteen times as many


def test_stuck_groups_are_joined_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "IN_TASK", 30)
    blocks, joined = ngram_join._join_blocks, []
    monkeypatch.setattr(ngram_join, "_join_blocks", lambda members, t: joined.append(members.count()) or blocks(members, t))
    r = np.random.default_rng(10)
    draw = lambda n: r.integers(0, 2**64, n, dtype=np.uint64)
    chain = [draw(100)]
    for _ in range(39):  # each links with the one before
        chain.append(np.concatenate([chain[-1][5:], draw(5)]))
    apart = [draw(100) for _ in range(120)]  # no region of these shrinks
    rows = [(g, 1000 * g + k, np.sort(s).tobytes()) for g, sets in ((1, chain), (2, apart)) for k, s in enumerate(sets)]
    members = spark.createDataFrame([(g, n, bytearray(s)) for g, n, s in rows], "grp long, node long, s binary")
    links = ngram_join._join_over_tasks(members, Fraction(9, 10)).distinct().collect()
    root = {n: n for _, n, _ in rows}
    for x in links:
        a, b = root[x["a"]], root[x["b"]]
        root = {n: a if v == b else v for n, v in root.items()}
    assert len({root[1000 + k] for k in range(40)}) == 1 and len({root[2000 + k] for k in range(120)}) == 120
    assert joined[0] in (120, 160)  # whole groups, once each


@pytest.mark.parametrize("in_task", [ngram_join.IN_TASK, 20])
@pytest.mark.parametrize(("n", "t"), [(3, Fraction(9, 10)), (5, Fraction(4, 5))])
def test_many_near_copies(spark, monkeypatch, in_task, n, t):
    """Copies of templates with a few words changed, many of them, also where a cluster is too large for a task."""
    monkeypatch.setattr(ngram_join, "IN_TASK", in_task)
    r = np.random.default_rng(12)
    rows = []
    for k, size in enumerate((60, 90, 200)):
        template = [f"t{k}w{i}" for i in range(size)]
        for _ in range(120 if k == 1 else 40):
            words = list(template)
            for at in r.integers(0, size, r.integers(0, 4)):
                words[at] = f"x{r.integers(0, 30)}"
            rows.append((int(r.integers(0, 10**6)), " ".join(words)))
    # a third of all rows are one text; ids that are null or on many rows
    rows += [(10**6 + k, rows[0][1]) for k in range(60)] + [(None, rows[k][1]) for k in range(0, 60, 3)] + [(7, rows[k][1]) for k in range(60, 120, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(x) for x in ngram_join.ngram_components(df, n, t).collect()), key=repr)
    assert got == brute_components(rows, n, t)


def test_components_of_hubs_chains_and_pairs(spark):
    r = np.random.default_rng(13)
    edges = [(0, k) for k in range(1, 300)] + [(k, 5000) for k in range(300, 500)] + [(k, k + 1) for k in range(1000, 1100)] + [(2000, 2001), (2001, 2000), (3, 3), (None, 4)]
    edges += [(6000 + int(a), 6000 + int(b)) for a, b in r.integers(0, 200, (180, 2))]
    df = spark.createDataFrame([edges[k] for k in r.permutation(len(edges))], "a long, b long")
    root = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        a, b = root.setdefault(a, a), root.setdefault(b, b)
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {x["node"]: x["label"] for x in components(df).collect()} == root


def test_partners_two_classes_up():
    t = Fraction(1, 2)
    r = np.random.default_rng(9)
    for size in (3, 40, 100, 130, 300):
        large = r.integers(0, 2**64, 2 * size, dtype=np.uint64)
        small = np.sort(large[:size])
        assert ngram_join.classes_of(2 * size, t)[0] in ngram_join.classes_of(size, t)
        assert set(ngram_join.slice_names(small, t).tolist()) & set(ngram_join.slice_names(np.unique(large), t).tolist())


def test_regions_are_exact():
    r = np.random.default_rng(5)
    base = [set(r.integers(0, 5000, 60).tolist()) for _ in range(6)]
    sets = []
    for _ in range(260):
        s = set(base[r.integers(0, 6)])
        for x in list(s)[: r.integers(0, 9)]:
            s.discard(x)
            s.add(int(r.integers(0, 5000)))
        sets.append(np.array(sorted(s), np.uint64))
    t = Fraction(9, 10)
    region = ngram_join.Region(sets, t)
    region.join(np.arange(len(sets)))
    label = region.label(np.arange(len(sets)))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 10 * both >= 9 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    want = [find(i) for i in range(len(sets))]
    assert all((label[i] == label[j]) == (want[i] == want[j]) for i in range(len(sets)) for j in range(i))


def brute_repeats(texts, length=200):
    seen = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((k, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    return gone


@pytest.mark.parametrize("in_task", [suffix_dedup.IN_TASK, 0])
def test_suffix(docs, empty, in_task, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "IN_TASK", in_task)
    rows = pairs_of(docs)
    texts = [t.encode() for _, t in rows]
    gone = brute_repeats(texts)
    want = sorted((len(t), sum(g), len(re.findall(b"\1+", bytes(g))), hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()) for t, g in zip(texts, gone, strict=True))
    got = sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeat_digests(docs).collect())
    assert got == want and any(w[1] for w in want)
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns
    assert suffix_dedup.repeat_digests(empty).count() == 0


@pytest.mark.parametrize("in_task", [suffix_dedup.IN_TASK, 0])
def test_suffix_at_seams(spark, in_task, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "IN_TASK", in_task)
    monkeypatch.setattr(suffix_dedup, "STRETCH", 1000)
    r = np.random.default_rng(8)
    text = lambda n: bytes(r.integers(97, 123, n, dtype=np.uint8)).decode()
    long = [text(6000) for _ in range(3)]
    # passages of 200 to 380 bytes from all over the long texts, seams among them, between other text
    again = [text(30) + long[k % 3][at : at + 200 + at % 181] + text(30) for k, at in enumerate(range(0, 5600, 150))]
    texts = [*long, *again]
    gone = brute_repeats([t.encode() for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["n_removed"] for x in suffix_dedup.repeat_digests(df).collect()}
    assert got == {k: int(sum(g)) for k, g in enumerate(gone)}


def brute_neighbours(ids, x, q, k=20):
    scores = x @ x[q]
    return [ids[i] for i in np.lexsort((ids, -scores)) if ids[i] != ids[q]][:k]


def recall_of(found, ids, x):
    got = {}
    for q in found.collect():
        got.setdefault(q["query_id"], []).append((q["rank"], q["vec_id"], q["score"]))
    hits = wanted = 0
    for q in np.flatnonzero(ids % 20 == 0):
        want, own = brute_neighbours(ids, x, q), sorted(got[ids[q]])
        assert [o[0] for o in own] == list(range(1, len(want) + 1))
        assert [o[1] for o in own] == [o[1] for o in sorted(own, key=lambda o: (-o[2], o[1]))]
        assert all(np.isclose(o[2], x[np.flatnonzero(ids == o[1])[0]] @ x[q], rtol=1e-9, atol=1e-9) for o in own)
        hits, wanted = hits + len({o[1] for o in own} & set(want)), wanted + len(want)
    assert len(got) == (ids % 20 == 0).sum()
    return hits / wanted


@pytest.mark.parametrize("per_block", [2048, 40])
def test_ann(spark, per_block):
    r = np.random.default_rng(2)
    centres = r.standard_normal((12, 16))
    x = centres[r.integers(0, 12, 1500)] + 0.4 * r.standard_normal((1500, 16))
    x[100:140] = x[7]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16), (None, x[0].tolist()), (9, x[9].tolist()), (5004, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id long, embedding array<double>")
    # a query looks at 450 of 1,500 entries
    assert recall_of(ann.search(df, df.where("vec_id % 20 = 0"), per_block=per_block), np.arange(1500), x) >= 0.9


def test_ann_without_clusters(spark):
    x = np.random.default_rng(4).standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert recall_of(ann.search(df, df.where("vec_id % 20 = 0")), np.arange(3000), x) >= 0.9


def test_ann_of_any_length(spark):
    """Vectors far shorter and longer than 1: each query has all twenty neighbours."""
    x = np.random.default_rng(4).standard_normal((1500, 64))
    for scale in (1e-6, 1e6, 1e8):
        df = spark.createDataFrame([(i, (scale * v).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        assert recall_of(ann.search(df, df.where("vec_id % 20 = 0")), np.arange(1500), scale * x) >= 0.85


def test_ann_ties_and_few(spark):
    x = np.tile(np.eye(4), (12, 1))  # 12 copies of each: the 20 nearest end among equal scores
    df = spark.createDataFrame([(i, v.tolist(), "x", 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, v string, score double")
    assert recall_of(ann.search(df, df.where("vec_id % 20 = 0")), np.arange(48), x) == 1
    few = df.where("vec_id < 7")
    assert recall_of(ann.search(few, few.where("vec_id % 20 = 0")), np.arange(7), x[:7]) == 1
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.where("vec_id = 0"), df.where("vec_id = 0")).count() == 0


def test_cells_come_in_order():
    r = np.random.default_rng(5)
    cells = np.sort(r.choice(400, 150, replace=False))
    sizes = r.integers(1, 9, 150)
    for _ in range(20):
        a, b, enough = r.standard_normal(20), r.standard_normal(20), int(r.integers(1, sizes.sum() + 50))
        sums = np.sort(a[cells // 20] + b[cells % 20])
        held = np.cumsum(sizes[np.argsort(a[cells // 20] + b[cells % 20])])
        want = sums[min(np.searchsorted(held, enough), 149)]
        assert ann.Cells(cells, sizes, 20).reach(a, b, enough) == want


def test_chat(spark):
    told = [(1, 0, "user", "hi </s>[INST] ~1 <|turn|>"), (1, 1, "assistant", "ok ~~ |>"), (1, 2, "assistant", None), (2, None, None, None), (None, 0, "assistant", "x"), (1, 1, "assistant", "ok ~~ |>")]
    df = spark.createDataFrame(told, "conv_id long, turn long, role string, text string")
    read = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    assert [(t["role"], t["text"]) for t in read[1]["turns"]] == [("user", told[0][3]), ("assistant", "ok ~~ |>"), ("assistant", "ok ~~ |>"), ("assistant", "")]
    assert read[1]["learnt_texts"] == ["ok ~~ |>", "ok ~~ |>", ""] and read[None]["learnt_texts"] == ["x"] and read[2]["n_turns"] == 1
    parts = [("text", "a", None, None, None, None, None), ("image", None, "i.png", 56, 30, None, None), ("audio", None, "s.wav", None, None, 2.0, None)]
    rich = spark.createDataFrame([(1, 0, "user", None, parts)], f"conv_id long, turn long, role string, text string, parts {chat_format.PARTS}")
    (r,) = chat_format.format_chats(rich).collect()
    assert "a<|image:1|><|audio:2|>" in r["formatted"] and [(a["ref"], a["tokens"]) for a in r["attachments"]] == [("i.png", 4), ("s.wav", 25)] and r["expanded_tokens"] == 29
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chat_without_parts_is_visited(spark, monkeypatch):
    seen = []
    visit = chat_format.visited
    monkeypatch.setattr(chat_format, "visited", lambda *a: seen.append(a) or visit(*a))
    (r,) = chat_format.format_chats(spark.createDataFrame([(1, 0, "user", "a <|b"), (1, 1, None, None)], "conv_id long, turn long, role string, text string")).collect()
    assert len(seen) == 1
    assert r["formatted"] == "<|turn|>user\na ~1b<|end|><|turn|>\n<|end|>" and r["attachments"] == [] and r["expanded_tokens"] == 0


def test_html(spark):
    page = """<html><head><title>t</title></head><body><nav><a href=x>Home</a> <a href=y>More</a></nav><article><h1>A &amp; B</h1><p>First  paragraph
    with words, long enough to be text and to be kept.</p><script>var x = '<p>no</p>'</script><p>Second &lt;one&gt;.</p></article><div class="sidebar"><p>Buy this now, please, it is cheap and it is good for you.</p></div><footer>Copyright</footer></body></html>"""
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert got[1]["text"] == "A & B\nFirst paragraph with words, long enough to be text and to be kept.\nSecond <one>."
    assert got[2]["text"] == got[3]["text"] == "" and got[1]["n_chars"] == len(got[1]["text"])


def test_html_wrappers():
    said = [" ".join(f"{w}{k}" for k in range(60)) + "." for w in ("one", "two")]
    text = "".join(f"<p>{x}</p>" for x in said)
    for name in ("layout with-sidebar", "has-sidebar", "post tag-news", "page header-fixed", "container-share", "sidebar", "comments"):
        assert html_text.main_text(f'<body><div class="{name}"><main><article>{text}</article></main></div></body>') == "\n".join(said), name
    for name in ("layout with-sidebar", "has-sidebar", "post tag-news", "page header-fixed", "container-share"):
        assert html_text.main_text(f'<body><div class="{name}"><div>{text}</div><ul><li><a href=x>More</a></li></ul></div></body>') == "\n".join(said), name
    for name in ("ad", "ads-2", "sidebar", "comment-list", "site-footer", "main-nav", "cookie-notice", "share-buttons", "page related-links"):
        assert html_text.main_text(f'<body><article>{text}<div class="{name}">{text}</div></article><div class="{name}">{text}</div></body>') == "\n".join(said), name
    assert html_text.main_text(f'<div class="comments"><article class="comment">{text}</article></div><div hidden><main>{text}</main></div>') == ""


class Plain(HTMLParser):
    """The blocks of <article>, in the plainest way."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.blocks[-1] += " "
        elif tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1", "article"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_html_against_a_plain_extractor(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {k: "\n".join(t for b in Plain(h or "").blocks if (t := " ".join(b.split()))) for k, h in html.items()}


# pages that are in no table of the operator: ~ begins a block of main text
HELD_OUT = [
    "<body><div class=top><a>Home</a> | <a>About us</a></div><div class=col><h1>~{6}</h1><p>~{30}</p><p>~{44}</p><p>~{18}</p></div><div class=col2><a>{3}</a><br><a>{4}</a></div></body>",
    "<body class='has-sidebar'><header class=masthead><h1>{2}</h1></header><main id=primary><h2>~{4}</h2><p>~{2}</p><p>~{77}</p></main><section class='comment-list'><p>{33}</p></section></body>",
    "<table><tr><td><a>{1}</a></td><td><a>{2}</a></td></tr></table><table><tr><td><p>~{65}</p><p>~{43}</p><p>~{90}</p></td></tr></table><center>{3}</center>",
    "<article class='post tag-sport'><h1>~{9}</h1><div class='byline-row'>~{3}</div><p>~{21}</p><ul><li>~{1}</li><li><a>~{7}</a></li></ul><div class='social-share'><a>{2}</a></div></article><div class='site-footer'>{20}</div>",
    "<div id=cookies>{31}</div><div role=main><p>~{12}</p><p>~{3}</p><form><label>{2}</label><p>{14}</p></form><p>~{61}</p></div>",
    "<nav>{3}</nav><section><p>~{37}</p><p>~{52}</p></section><aside class=promo><h4>{3}</h4><p>{36}</p></aside><footer><p>{28}</p></footer>",
]


def test_html_held_out_layouts():
    for layout in HELD_OUT:
        n = iter(range(1000))
        page = re.sub(r"(~?)\{(\d+)\}", lambda m: m[1] + " ".join(f"w{next(n)}" for _ in range(int(m[2]))), layout)
        want = re.findall("~([^<]*)", page)
        assert html_text.main_text(page.replace("~", "")) == "\n".join(want), layout


def words(n, begin="word"):
    return " ".join(f"{begin}{k}" for k in range(n))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><p>{words(60)}</p><ol class="commentlist"><li>{words(50, "said")}</li><li>{words(20, "told")}</li></ol></article>', words(60)),
        (f'<article><p>{words(70)}</p></article><div class="related-posts"><article><h3>{words(5, "t")}</h3><p>{words(30, "u")}</p></article><article><p>{words(30, "v")}</p></article></div>', words(70)),
        (f'<article><p>{words(70)}</p><div class="related"><article><p>{words(30, "v")}</p></article></div></article>', words(70)),
        (f'<div class="legal"><article><p>{words(70)}</p></article></div>', words(70)),
        *((f'<article><p>{words(40)}</p><div {name}><p>{words(35, "x")}</p></div></article>', words(40)) for name in ('class="adsbygoogle"', 'id="outbrain_widget_0"', 'id="CybotCookiebotDialog"', 'class="commentList"', 'class="relatedPosts"', 'class="cookiebar"')),
        ("<p>Short one here.</p><p>Another short one.</p>", "Short one here.\nAnother short one."),
        ("<nav><a>Home</a></nav><div>Closed today.</div>", "Closed today."),
        ("<ul><li><a>one</a></li><li><a>two</a></li></ul>", ""),
    ],
)
def test_html_names_teasers_and_short_pages(page, want):
    assert html_text.main_text(page) == want



@pytest.mark.parametrize("part", ["<a ", "<a '", "</script ", "<b>", "</b>", "<p>", "<div>", "<!--", '<div class="', "<i><div></i>", "&amp", "<"])
def test_html_takes_linear_time(part):
    page = "<article><p>Text.</p></article>" + part * (400_000 // len(part))
    began = time.process_time()
    assert html_text.main_text(page).startswith("Text.")
    assert time.process_time() - began < 10


def test_html_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(200_000))
    page = f"<nav>x</nav><p>{long}</p>"
    rows = [(1, "u", page, "own", 5), (1, "u", page, "own", 5), (None, None, None, None, None), (2, None, "<p>Short.</p>", "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_text.extract(df, carry=tuple(df.columns))
    assert got.columns == ["page_id", "url", "html", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"] == long, r["n_chars"]) for r in got.collect()) == [(0, False, 0), (1, True, len(long)), (1, True, len(long)), (2, False, 6)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_gradients_are_those_of_the_loss():
    net = toxicity.Network(3)
    words = ["bad", "good", "plain", "words", "here"]
    index = np.full((3, toxicity.WINDOW), -1)
    index[0, :4], index[1, :2] = [0, 1, 2, 0], [3, 4]
    label, weight = np.array([1, 0, 1], np.float32), np.array([2, 1, 1], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        x = np.concatenate([net.inputs(words)[0].astype(np.float64), np.zeros((1, toxicity.WIDTH))])
        mask = index >= 0
        mask[~mask.any(1), 0] = True
        p = toxicity.sigmoid(net.pooled(net.run(net.project(x)[index])[0], mask)[3].astype(np.float64))
        return float(np.mean(-weight * (label * np.log(p) + (1 - label) * np.log(1 - p))))

    class Seen:
        def step(self, p, g):
            self.g = g

    net.learn(words, index, label, weight, seen := Seen())
    r = np.random.default_rng(1)
    for name, g in seen.g.items():
        flat, own = net.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for at in r.choice(np.flatnonzero(own) if own.any() else len(own), 4):
            kept = flat[at]
            flat[at] = kept + 1e-2
            up = loss()
            flat[at] = kept - 1e-2
            down = loss()
            flat[at] = kept
            assert abs((up - down) / 2e-2 - own[at]) < 2e-3 + 0.05 * abs(own[at]), name


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, "vile vile words", "a", 7.0), (1, "another text", "a", 7.0), (2, "calm words", "b", None), (2, "calm words", "b", None), (None, None, None, None), (3, "", "c", 1.0), (4, "x " * 100_000, "d", 1.0)], "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1), (3, None), (9, 1)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels, carry=tuple(docs.columns))
    assert sorted(got.columns) == ["doc_id", "predicted", "score", "text"]
    rows = got.collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 2}) == 1
    stay = toxicity.accepted(docs, labels)
    assert stay.columns == docs.columns and stay.count() == sum(r["predicted"] == 0 for r in rows)
    assert toxicity.score(docs.limit(0), labels).count() == 0 and toxicity.accepted(docs.limit(0), labels.limit(0)).count() == 0


def test_a_scorer_that_forgets_scores_alike(monkeypatch):
    texts = [" ".join(f"w{k}x{j}" for k in range(n)) for j, n in enumerate((0, 1, 31, 32, 33, 500, 3000))]
    net = toxicity.Network(2)
    want = toxicity.Scorer(net).scores(texts)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 50)
    monkeypatch.setattr(toxicity, "LOT_WORDS", 10)
    assert np.allclose(toxicity.Scorer(net).scores(iter(texts)), want, atol=1e-6)


def test_toxicity_held_out(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score(documents, labels)
    held = scored.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).join(labels.select("doc_id", "toxic"), "doc_id").toPandas()
    pos, neg = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert (pos[:, None] > neg[None, :]).mean() > 0.9
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x " * 4000)], "doc_id long, text string")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score(odd, labels.limit(0)).collect())
