"""Operator 9: toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Method: a word enters as a hashed word vector and as the mean of its hashed character n-gram vectors (3 to 5
characters, with marks at its ends), beside the strongest evidence among these n-grams. A gated recurrent unit
runs over a window of WINDOW words in each direction; attention pools its states; a logistic unit scores the window. All
windows of a text are scored, each overlapping the next, and the text has the score of its worst window.

Training: at most `per_class` labelled documents of each class (clean, toxic) (the least by hash of doc_id) are brought to the
driver. Labels belong to documents, so of a toxic document its worst window under the network so far is learnt, of a
clean one its worst and one other. The vectors start from the log-odds of n-grams and words in that sample.
Language, source and doc_id are no inputs of a score.

Null text counts as empty; an empty text is one window of padding and gets a score as any other. Words of more than
PIECE characters enter in pieces. Repeated rows score alike; rows with a null doc_id are scored; labels that are null or
without a document are ignored, and of several labels of a document the larger holds. If either class has no example
all scores are the share of toxic labels (0 without labels). A doc_id on several texts is learnt by the least of them.
Other columns are not read; carried ones named score or predicted give way to the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, text_of

WINDOW, STRIDE, PIECE = 32, 24, 48
WORD_BUCKETS, GRAM_BUCKETS, WORD_WIDTH, GRAM_WIDTH, HIDDEN, ATTENTION = 1 << 15, 1 << 17, 8, 8, 8, 8
WIDTH = WORD_WIDTH + GRAM_WIDTH + 1
#: What a scorer holds: projected inputs of so many distinct words (192 bytes each), the words of so many
#: positions at a time, so many windows at a time.
KEPT_WORDS, LOT_WORDS, AT_ONCE = 100_000, 40_000, 2048
_U = np.uint64
EDGES = re.compile(r"^\W+|\W+$")


def tokens(text: str) -> list[str]:
    words = text.lower().split()
    if words and max(map(len, words)) > PIECE:
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    return words


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, the word of each (in order), and the bucket of each word."""
    bare = [f"<{EDGES.sub('', w) or w}>" for w in words]
    code = np.frombuffer("".join(bare).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U)
    lengths = np.fromiter(map(len, bare), np.int64, len(bare))
    owner = np.repeat(np.arange(len(bare)), lengths)
    buckets, owners = [], []
    for n in (3, 4, 5):
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, _U)
        for k in range(n):
            h = (h * _U(0x100000001B3)) ^ (code[k : len(code) - n + 1 + k] * _U(0x9E3779B97F4A7C15))
        own = owner[: len(code) - n + 1]
        inside = own == owner[n - 1 :]
        buckets.append(mix(h[inside]) >> _U(64 - 17))
        owners.append(own[inside])
    b, o = np.concatenate(buckets).astype(np.int64), np.concatenate(owners)
    by = np.argsort(o, kind="stable")
    starts = np.cumsum(lengths) - lengths
    whole = np.add.reduceat(mix(code + (np.arange(len(code)) - np.repeat(starts, lengths)).astype(_U) * _U(0x9E3779B97F4A7C15)), starts)
    return b[by], o[by], (mix(whole) >> _U(64 - 15)).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def windows(n: int) -> list[int]:
    """Starts of the windows over n words; the last ends with the text."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


class Network:
    def __init__(self, seed: int = 0):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.15).astype(np.float32)
        self.p = {"words": f(WORD_BUCKETS, WORD_WIDTH), "grams": f(GRAM_BUCKETS, GRAM_WIDTH), "evidence": np.zeros(GRAM_BUCKETS, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": f(WIDTH, 3 * HIDDEN), f"U{d}": f(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": f(2 * HIDDEN, ATTENTION), "v": f(ATTENTION), "o": f(2 * HIDDEN), "bias": np.array([-1.0], np.float32)}
        self.constant: float | None = None

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        b, o, w = grams(words)
        starts = np.searchsorted(o, np.arange(len(words)))
        many = np.diff(np.append(starts, len(o)))
        mean = np.add.reduceat(self.p["grams"][b], starts, axis=0) / many[:, None]
        top = np.maximum.reduceat(self.p["evidence"][b], starts)
        return np.concatenate([self.p["words"][w], mean, top[:, None]], 1).astype(np.float32), (b, o, w, many)

    def run(self, x: np.ndarray, keep: bool = False):
        """x: projected inputs (windows, WINDOW, 2, 3 * HIDDEN), padding being nan-free rows flagged by mask."""
        n = len(x)
        states, kept = np.empty((n, WINDOW, 2 * HIDDEN), np.float32), []
        for d, name in enumerate("fb"):
            u, h = self.p["U" + name], np.zeros((n, HIDDEN), np.float32)
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                g, k = x[:, t, d], h @ u
                zr = sigmoid(g[:, : 2 * HIDDEN] + k[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + r * k[:, 2 * HIDDEN :])
                if keep:
                    kept.append((d, t, h, z, r, new, k[:, 2 * HIDDEN :]))
                h = new + z * (h - new)
                states[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
        return states, kept

    def pooled(self, states: np.ndarray, mask: np.ndarray):
        hidden = np.tanh(states @ self.p["A"])
        e = np.where(mask, hidden @ self.p["v"], np.float32(-30))
        e = np.exp(e - e.max(1, keepdims=True))
        a = e / e.sum(1, keepdims=True)
        c = (a[:, :, None] * states).sum(1)
        return hidden, a, c, c @ self.p["o"] + self.p["bias"][0]

    def project(self, x: np.ndarray) -> np.ndarray:
        return np.stack([x @ self.p["W" + d] + self.p["c" + d] for d in "fb"], 1).astype(np.float32)

    def learn(self, words: list[str], index: np.ndarray, label: np.ndarray, weight: np.ndarray, adam: Adam) -> float:
        """One step on windows given as rows of index into words (-1: padding)."""
        x, (b, o, w, many) = self.inputs(words)
        x = np.concatenate([x, np.zeros((1, WIDTH), np.float32)])
        mask = index >= 0
        mask[~mask.any(1), 0] = True
        states, kept = self.run(self.project(x)[index], True)
        hidden, a, c, logit = self.pooled(states, mask)
        p = sigmoid(logit)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("evidence", "words", "grams")}
        dl = ((p - label) * weight / len(label)).astype(np.float32)
        g["bias"][0], g["o"] = dl.sum(), c.T @ dl
        dc = dl[:, None] * self.p["o"]
        da = (states * dc[:, None, :]).sum(2)
        de = a * (da - (a * da).sum(1, keepdims=True))
        dh = de[:, :, None] * self.p["v"] * (1 - hidden**2)
        g["v"] = (de[:, :, None] * hidden).sum((0, 1))
        g["A"] = np.einsum("nti,ntj->ij", states, dh)
        ds = a[:, :, None] * dc[:, None, :] + dh @ self.p["A"].T
        dx = np.zeros((*index.shape, WIDTH), np.float32)
        back = [np.zeros((len(label), HIDDEN), np.float32) for _ in range(2)]
        for d, t, h, z, r, new, kn in reversed(kept):
            name = "fb"[d]
            dn = ds[:, t, d * HIDDEN : (d + 1) * HIDDEN] + back[d]
            dnew = dn * (1 - z) * (1 - new**2)
            gates = np.concatenate([dn * (h - new) * z * (1 - z), dnew * kn * r * (1 - r), dnew], 1)
            inner = np.concatenate([gates[:, : 2 * HIDDEN], dnew * r], 1)
            g["U" + name] += h.T @ inner
            back[d] = dn * z + inner @ self.p["U" + name].T
            g["W" + name] += x[index[:, t]].T @ gates
            g["c" + name] += gates.sum(0)
            dx[:, t] += gates @ self.p["W" + name].T
        per_word = np.zeros((len(words) + 1, WIDTH), np.float32)
        np.add.at(per_word, index.ravel(), dx.reshape(-1, WIDTH))
        per_word = per_word[:-1]
        gw, gg = np.zeros_like(self.p["words"]), np.zeros_like(self.p["grams"])
        np.add.at(gw, w, per_word[:, :WORD_WIDTH])
        np.add.at(gg, b, (per_word[:, WORD_WIDTH:-1] / many[:, None])[o])
        adam.step(self.p, g | {"words": gw, "grams": gg})
        return float(-np.mean(label * np.log(p + 1e-7) + (1 - label) * np.log(1 - p + 1e-7)))


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m = rate, 0, {}

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = min(1.0, 5.0 / (size + 1e-9))
        for k, x in g.items():
            m, v = self.m.setdefault(k, (np.zeros_like(x), np.zeros_like(x)))
            x = x * np.float32(scale)
            m += 0.1 * (x - m)
            v += 0.01 * (x * x - v)
            p[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-6)).astype(np.float32)


class Scorer:
    """Scores texts; projected inputs of up to KEPT_WORDS distinct words, or of one lot, are kept."""

    def __init__(self, net: Network):
        self.net, self.row = net, {}
        self.table = np.zeros((1, 2, 3 * HIDDEN), np.float32)
        self.clear()

    def clear(self) -> None:
        self.row.clear()
        self.used = 1
        self.table = np.zeros((1 << 14, 2, 3 * HIDDEN), np.float32)
        self.table[0] = self.net.project(np.zeros((1, WIDTH), np.float32))[0]

    def index(self, lists: list[list[str]]) -> list[np.ndarray]:
        every = {w for ws in lists for w in ws}
        new = [w for w in every if w not in self.row]
        if self.used + len(new) > KEPT_WORDS:
            self.clear()
            new = list(every)
        get = self.row.get
        for k in range(0, len(new), 1 << 12):
            part = new[k : k + (1 << 12)]
            need = self.used + len(part)
            if need > len(self.table):
                self.table = np.resize(self.table, (need + len(self.table) // 2, 2, 3 * HIDDEN))
            self.table[self.used : need] = self.net.project(self.net.inputs(part)[0])
            self.row.update(zip(part, range(self.used, need), strict=True))
            self.used = need
        return [np.fromiter(map(get, ws), np.int64, len(ws)) for ws in lists]

    def window_scores(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The logit of every window, the text and the first word of each."""
        rows = self.index(lists)
        begins = [windows(len(r)) for r in rows]
        flat = np.concatenate([*rows, np.zeros(WINDOW, np.int64)])
        base = np.cumsum([0] + [len(r) for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(b) for b in begins])
        start = np.fromiter((s for b in begins for s in b), np.int64, len(owner))
        n = np.array([len(r) for r in rows])[owner]
        out = np.empty(len(owner), np.float32)
        steps = np.arange(WINDOW)
        for k in range(0, len(owner), AT_ONCE):
            s, own, m = start[k : k + AT_ONCE], owner[k : k + AT_ONCE], n[k : k + AT_ONCE]
            inside = s[:, None] + steps < m[:, None]
            index = np.where(inside, flat[(base[own] + s)[:, None] + steps], 0)
            inside[:, 0] |= ~inside.any(1)
            states, _ = self.net.run(self.table[index])
            out[k : k + AT_ONCE] = self.net.pooled(states, inside)[3]
        return out, owner, start

    def scores(self, texts: Iterable[str]) -> np.ndarray:
        """The score of each text: that of its worst window. Texts are read one after another, in lots."""
        out: list[float] = []
        part: list[list[str]] = []
        held = 0

        def close() -> None:
            logit, owner, _ = self.window_scores(part)
            worst = np.full(len(part), -np.inf)
            np.maximum.at(worst, owner, logit)
            out.extend(1 / (1 + np.exp(-worst)))

        for t in texts:
            part.append(tokens(t))
            held += len(part[-1])
            if held > LOT_WORDS or len(part) == AT_ONCE:
                close()
                part, held = [], 0
        if part:
            close()
        return np.array(out) if self.net.constant is None else np.full(len(out), self.net.constant)


def train(texts: list[str], labels: list[int], examples: int = 15_000, most_rounds: int = 40, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Network:
    """A network that has learnt about `examples` texts, each of the sample as often as another and no text more than
    `most_rounds` times."""
    net, y = Network(seed), np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.0
        return net
    lists = [tokens(t) for t in texts]
    # the start: in how many documents of each class an n-gram or word is
    counts = {"grams": np.zeros((2, GRAM_BUCKETS)), "words": np.zeros((2, WORD_BUCKETS))}
    for ws, label in zip(lists, labels, strict=True):
        if ws:
            b, _, w = grams(list(dict.fromkeys(ws)))
            counts["grams"][label, np.unique(b)] += 1
            counts["words"][label, np.unique(w)] += 1
    totals = np.array([(y == 0).sum(), (y == 1).sum()], float)
    for k, c in counts.items():
        odds = np.log((c[1] + 0.5) / (totals[1] + 1)) - np.log((c[0] + 0.5) / (totals[0] + 1))
        odds = np.where(c.sum(0) >= 3, odds, 0).clip(-4, 4)
        net.p[k][:, 0] = odds / 4
        if k == "grams":
            net.p["evidence"] = (odds / 2).astype(np.float32)
    rng, adam = np.random.default_rng(seed), Adam(rate)
    weight = np.where(y == 1, np.clip(totals[0] / totals[1], 1, 8), 1).astype(np.float32)
    for _ in range(max(1, min(most_rounds, examples // len(lists)))):
        scorer = Scorer(net)
        chosen: list[tuple[int, int]] = []
        for k in range(0, len(lists), 128):
            logit, owner, start = scorer.window_scores(lists[k : k + 128])
            order = np.lexsort((-logit, owner))
            worst = order[np.unique(owner[order], return_index=True)[1]]
            chosen += [(k + int(owner[i]), int(start[i])) for i in worst]
            other = rng.permutation(len(owner))
            other = other[np.unique(owner[other], return_index=True)[1]]
            chosen += [(k + int(owner[i]), int(start[i])) for i in other if y[k + owner[i]] == 0]
        rng.shuffle(chosen)
        for k in range(0, len(chosen), batch):
            part = chosen[k : k + batch]
            own = [lists[d][s : s + WINDOW] for d, s in part]
            words = list(dict.fromkeys(w for ws in own for w in ws)) or ["-"]
            at = {w: i for i, w in enumerate(words)}
            index = np.full((len(part), WINDOW), -1)
            for i, ws in enumerate(own):
                index[i, : len(ws)] = [at[w] for w in ws]
            net.learn(words, index, y[(of := [d for d, _ in part])], weight[of], adam)
    return net


def labelled_sample(documents: DataFrame, labels: DataFrame, per_class: tuple[int, int]) -> tuple[list[str], list[int]]:
    """At most per_class texts of the classes 0 and 1, of the documents whose crc32(doc_id as text) mod 4 is not 2."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    spark = documents.sparkSession
    picked = [(r["doc_id"], r["toxic"]) for y in (0, 1) for r in known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class[y]).collect()]
    if not picked:
        return [], []
    small = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int"))  # at most sum(per_class) rows
    # a doc_id that is on several rows stands for the least of its texts
    rows = documents.select(F.col("doc_id").cast("long"), text_of().alias("text")).join(small, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def scores_of(documents: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2_000, 1_000), examples: int = 15_000, most_rounds: int = 40) -> Column:
    """The score of each row's text, a column of documents. Its text alone goes to Python, and a number comes back."""
    net = train(*labelled_sample(documents, labels, per_class), examples, most_rounds)
    shared = documents.sparkSession.sparkContext.broadcast(net)  # its size is fixed by the buckets

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pa.array(scorer.scores(t.as_py() for t in texts), pa.float64())

    return run(text_of())


def score(documents: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2_000, 1_000), cut: float = 0.3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What is carried, with score and predicted of every row of documents."""
    scored = documents.select(*(c for c in carry if c not in ("score", "predicted")), scores_of(documents, labels, per_class).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def accepted(documents: DataFrame, labels: DataFrame, per_class: tuple[int, int] = (2_000, 1_000), cut: float = 0.3) -> DataFrame:
    """The rows of documents, with all their columns, whose score is below the cut."""
    return documents.where(scores_of(documents, labels, per_class) < cut)
