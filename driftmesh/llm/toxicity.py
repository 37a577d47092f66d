"""Toxicity by noisy-channel deobfuscation and a linear score of the restored words.

A token that may be disguised (digits or signs among or around letters, a letter
twice or more in a row) or a run of letters set apart by spaces, dots or dashes
spans a lattice: each character stands for itself, for the letters that it is
used for, or, if it is a sign or repeats the one before, for nothing; a separator
stands for nothing or for the end of a word. Viterbi finds the path that a
character trigram model and the channel's costs make likeliest; it may restore
several words from one run. The model is counted over the words of all documents:
words are counted where they stand and dealt out, and only the sums of n-grams
reach the driver. Runs of one character are cut to three; tokens of any length
are decoded. Every other token has a lattice of one path, itself, and isn't run.

The restored and the plain words and their beginnings are features. Those that
are much commoner in texts of label 1 are weighted by a logistic regression
(numpy), fitted on a bounded sample of labelled rows: the ``most_train`` of each
label whose hashed ids are smallest, of rows whose crc32(doc_id as text) mod 5
is not 0. A feature whose share of label 1 is surely
high (Wilson bound) speaks for itself, so that one word is enough. Scores depend
on the text alone. At most ``most_features`` features that at least ``least``
sampled texts of label 1 have are weighted.

Of labels that disagree about an id, 1 counts; of several texts of one labelled
id, the smallest in order. Empty tables give empty tables; only the named columns
are read, so no other can clash; long texts take time in proportion to their
distinct tokens. Null and empty texts get the score of a text without features. Without any
labelled row every score is 0. Repeated rows are each scored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROWS_AT_ONCE, Codes, load, map_many

EDGES = ".,;:!?\"'()[]{}%$&*#|<>«»„“”‘’…-–—_~^=+/\\"
#: Letters that digits and signs are used for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
SEPARATE = re.compile(r"(?<!\S)\w(?:[ ._*-]\w(?!\w)){2,}(?!\w)")
#: What may stand between letters set apart, or end a word there.
BREAKS = " ._*-"
#: Edge signs that are read as letters or as nothing; other punctuation at a token's edges is none of its letters.
SIGNS = "@$|+(€£*#%&"
PUNCTUATION = "".join(c for c in EDGES if c not in SIGNS)
DISGUISED = re.compile(r"(.)\1\1", re.S)
DOUBLED = re.compile(r"(.)\1", re.S)
STRETCHED = re.compile(r"(.)\1{3,}", re.S)
#: Words or n-grams that a task counts before it passes the counts on.
AT_ONCE = 1 << 18


def grams(words: Iterable[tuple[str, int]]) -> Iterator[Counter]:
    """Weights of the words' n-grams and of their pasts, in whole millionths, so that sums don't depend on their order."""
    tri: dict[str, int] = defaultdict(int)
    for word, n in words:
        w, x = f"^^{word}$", round(1e6 * (1 + log(n)))
        for i in range(len(w) - 2):
            tri[w[i : i + 3]] += x
        if len(tri) >= AT_ONCE:
            yield shorter(tri)
            tri.clear()
    yield shorter(tri)


def shorter(tri: dict[str, int]) -> Counter:
    """Sums of trigrams, and from them those of what they end in and of the pasts of all."""
    out = Counter(tri)
    for g, x in tri.items():
        for k in range(3):
            if k < 2:
                out[g[2 - k :]] += x
            out[g[2 - k : 2] + "\0"] += x
    return out


def counted(docs: DataFrame, text_col: str = "text") -> Counter:
    """grams of the words of all texts."""

    def batch_of(counts: Counter, name: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=[name, "n"])

    def words(batches):
        seen: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                for text in batch.column(0).slice(at, ROWS_AT_ONCE).to_pylist():
                    seen.update(plain_words(text or ""))
                if len(seen) >= AT_ONCE:
                    yield batch_of(seen, "word")
                    seen = Counter()
        yield batch_of(seen, "word")

    def parts(batches):
        pairs = (x for batch in batches for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        for out in grams(pairs):
            yield batch_of(out, "gram")

    found = docs.select(text_col).mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    sums = found.mapInArrow(parts, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return Counter({r.gram: r.n for r in sums.toLocalIterator()})


class Letters:
    """A character trigram model of words, smoothed by the bigram and the single letter."""

    def __init__(self, weights: dict[str, int]):
        self.tri = {g: n / 1e6 for g, n in weights.items()}
        #: Minus the log probability of a character after two, by all three.
        self.known = Costs(self.tri)

    def cost(self, before: str, c: str) -> float:
        """Minus the log probability of c after two characters."""
        return self.known[before + c]


class Costs(dict):
    """Costs by three characters, found when first asked for."""

    def __init__(self, tri: dict[str, float]):
        super().__init__()
        self.tri = tri

    def __reduce__(self):
        return Costs, (self.tri,)

    def __missing__(self, key: str) -> float:
        p = 1e-4
        for k in range(3):
            past = key[2 - k : 2]
            p = (self.tri.get(past + key[2:], 0.0) + 2.0 * p) / (self.tri.get(past + "\0", 0.0) + 2.0)
        self[key] = x = -log(p)
        return x


def suspicious(token: str) -> bool:
    """Whether the token's lattice has more than one path."""
    if token.isalpha():
        return DOUBLED.search(token) is not None
    if len(token) < 2 or ("@" in token and "." in token[token.index("@") :]):
        return False
    return any(map(str.isalpha, token))


def options(token: str, i: int, tripled: set[str]) -> list[tuple[str, float]]:
    """What the token's character at i may stand for, with the channel's costs; a space is a word's end."""
    edge = not token[:i].strip(EDGES) or not token[i + 1 :].strip(EDGES)
    return list(readings(token[i], i > 0 and token[i - 1] == token[i], token[i] in tripled, edge))


@lru_cache(maxsize=1 << 16)
def readings(c: str, again: bool, stretched: bool, edge: bool) -> tuple[tuple[str, float], ...]:
    """``options`` of a character: whether it repeats the one before, stands thrice in a row anywhere, and has nothing but punctuation on one side."""
    if c.isalpha():
        return ((c, 0.0), ("", 0.5 if stretched else 3.0)) if again else ((c, 0.0),)
    if c == " ":
        return ("", 0.5), (" ", 1.0)
    out = [("", 0.5 if edge or c not in LEET else 4.0)] + [(x, 0.7) for x in LEET.get(c, "")]
    if c in "*#%&?-_.":
        out += [(x, 4.0) for x in "aeiou"]
    return (*out, (" ", 2.0)) if c in BREAKS else tuple(out)


def restore(token: str, letters: Letters) -> str:
    """The likeliest words behind a disguised token, with a space between."""
    token = STRETCHED.sub(r"\1\1\1", token)
    tripled = {m[1] for m in DISGUISED.finditer(token)}
    known = letters.known
    # the first and last that is no punctuation
    lo, hi = len(token) - len(token.lstrip(EDGES)), len(token.rstrip(EDGES))
    # a path is its last letter and the path before it
    best: dict[str, tuple[float, tuple | None]] = {"^^": (0.0, None)}
    last = ""
    for i, c in enumerate(token):
        own = readings(c, c == last, c in tripled, i <= lo or i + 1 >= hi)
        last = c
        if len(own) == 1 and len(best) == 1 and own[0][0]:
            ((state, (score, out)),) = best.items()
            emit, price = own[0]
            key = state + emit
            best = {key[1:]: (score + price + known[key], (out, emit))}
            continue
        after: dict[str, tuple[float, tuple | None]] = {}
        for state, (score, out) in best.items():
            for emit, price in own:
                if not emit:
                    to, total = state, score + price
                elif emit != " ":
                    key = state + emit
                    to, total = key[1:], score + price + known[key]
                elif state != "^^":
                    to, total = "^^", score + price + known[state + "$"]
                else:
                    continue
                if to not in after or total < after[to][0]:
                    after[to] = (total, (out, emit) if emit else out)
        best = after
    ends = [(s + known[state + "$"], out) for state, (s, out) in best.items()]
    least = min(s for s, _ in ends)
    return min(spelled(out) for s, out in ends if s == least)


def spelled(path: tuple | None) -> str:
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out))


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens, and runs of letters set apart as they stand."""
    low = text.lower()
    out = set(low.split())
    out.update(" ".join(m[0].split()) for m in SEPARATE.finditer(low))
    return out


def plain_words(text: str) -> list[str]:
    """The distinct words of letters only; runs of letters set apart are none."""
    return list({c for t in set(text.lower().split()) if (c := t.strip(EDGES)).isalpha() and len(c) > 1})


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in range(4, min(9, len(word))))] if len(word) > 1 else []


def words_in(token: str, letters: Letters | None) -> set[str]:
    core = token.strip(EDGES)
    out = {core} if core else set()
    if letters is not None:
        for form in {core, token.strip(PUNCTUATION)}:
            if suspicious(form):
                out.update(restore(form, letters).split())
    return out


class Model:
    """An index by feature, weights and own log odds (or -30) by index, an intercept; the letters."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, alone: np.ndarray, bias: float, letters: Letters | None):
        self.index, self.weights, self.alone, self.bias, self.letters = index, weights.tolist(), alone.tolist(), bias, letters
        #: How features begin: no other word has any.
        self.stems = {f[:4] for f in index}

    def indices(self, token: str) -> tuple[int, ...]:
        return tuple({self.index[f] for w in words_in(token, self.letters) if w[:4] in self.stems for f in features_of(w) if f in self.index})

    def score(self, text: str | None, cache: Codes) -> float:
        found: set[int] = set()
        for t in tokens(text or ""):
            if got := cache[t]:
                found.update(got)
        x = self.bias + sum(self.weights[i] for i in sorted(found))
        x = max([x, *(self.alone[i] for i in found)])
        return 1 / (1 + exp(-max(-30.0, min(30.0, x))))


def fit(rows: list[tuple[str | None, int]], positive_share: float | None = None, most_features: int = 800, least: int = 4, rounds: int = 600, sure: float = 0.9, letters: Letters | None = None) -> Model:
    """rows: (text, label). positive_share: of all labelled rows, where the sample's differs. letters: of all documents, else of the rows."""
    rows = [(t or "", int(y)) for t, y in rows]
    n1 = sum(y for _, y in rows)
    n0 = len(rows) - n1
    if not n1 or not n0:
        return Model({}, np.zeros(0), np.zeros(0), 30.0 if n1 else -30.0, None)
    if letters is None:
        letters = Letters(sum(grams(Counter(w for t, _ in rows for w in plain_words(t)).items()), Counter()))
    # only features that enough texts of label 1 have are looked for in the others
    parts = Codes(lambda t: tuple({f for w in words_in(t, letters) for f in features_of(w)}), 1 << 15)
    first: Counter = Counter()
    for t, y in rows:
        if y:
            first.update({f for t in tokens(t) for f in parts[t]})
    place = {f: i for i, f in enumerate(sorted(f for f, k in first.items() if k >= least))}
    del first, parts
    found = Codes(lambda t: tuple({place[f] for w in words_in(t, letters) for f in features_of(w) if f in place}), 1 << 16)
    held = [np.array(sorted({i for t in tokens(t) for i in found[t]}), np.int64) for t, _ in rows]
    counts = [np.bincount(np.concatenate([h for h, (_, y) in zip(held, rows, strict=True) if y == label]), minlength=len(place)) for label in (0, 1)]
    # commoner with label 1, by the z of two shares
    ranked = []
    for f, i in place.items():
        k0, k1 = int(counts[0][i]), int(counts[1][i])
        p1, p0 = (k1 + 0.5) / (n1 + 1), (k0 + 0.5) / (n0 + 1)
        if p1 >= 3 * p0:
            p = (k1 + k0 + 1) / (len(rows) + 2)
            z = (p1 - p0) / (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5
            if z > 5:
                ranked.append((-z, f))
    index = {f: i for i, (_, f) in enumerate(sorted(ranked)[:most_features])}
    x = np.zeros((len(rows), len(index) + 1), np.float32)
    x[:, -1] = 1
    column = np.full(len(place), -1)
    column[[place[f] for f in index]] = list(index.values())
    for r, own in enumerate(held):
        got = column[own]
        x[r, got[got >= 0]] = 1
    y = np.array([y for _, y in rows], np.float32)
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    square = np.zeros_like(w)
    for step in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + 1e-5 * np.append(w[:-1], 0)
        speed = 0.9 * speed + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        w -= 0.1 * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    bias = float(w[-1])
    if positive_share and 0 < positive_share < 1:
        bias += log(positive_share / (1 - positive_share)) - log(n1 / n0)
    share = positive_share or n1 / len(rows)
    scale = (1 - share) / share * n1 / n0 if share < 1 else 1.0
    alone = np.full(len(index), -30.0)
    for f, i in index.items():
        k1 = int(counts[1][place[f]])
        k = k1 + scale * int(counts[0][place[f]])
        p = k1 / k
        low = (p + 1.92 / k - 1.96 * (p * (1 - p) / k + 0.96 / k / k) ** 0.5) / (1 + 3.84 / k)
        if low >= sure:
            alone[i] = log(low / (1 - low))
    return Model(index, w[:-1].astype(float), alone, bias, letters)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, most_train: int, id_col: str, text_col: str, label_col: str) -> tuple[list[tuple], float | None]:
    """Labelled (text, label) rows, at most most_train of each label, and the share of label 1 among all."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(id_col).agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64(id_col), id_col).limit(most_train) for y in (0, 1)]
    # at most 2 x most_train ids: bounded, and so broadcast
    ids = picked[0].unionByName(picked[1])
    rows = docs.select(id_col, F.col(text_col).alias("text")).join(F.broadcast(ids), id_col).groupBy(id_col, "y").agg(F.min("text").alias("text")).orderBy(id_col)
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    return [(r.text, r.y) for r in rows.toLocalIterator()], share or None


def score(docs: DataFrame, labels: DataFrame, most_train: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    known, share = sample(docs, labels, most_train, id_col, text_col, label_col)
    letters = Letters(counted(docs, text_col)) if len({y for _, y in known}) == 2 else None
    model = fit(known, share, letters=letters)

    def rows(cache: Codes, keys: list, out: list, texts: list) -> list[tuple]:
        scores = [model.score(t, cache) for t in texts]
        return [(k, bool(h), s, int(s >= 0.5)) for k, h, s in zip(keys, out, scores, strict=True)]

    marked = F.coalesce(held_out(id_col), F.lit(False)).alias("held_out")
    return map_many(docs, [id_col, marked, text_col], rows, f"{id_col} long, held_out boolean, score double, predicted int", lambda: Codes(model.indices))


def query(spark, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
