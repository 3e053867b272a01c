"""Reading level of English texts (problem 9).

Every sentence gets a distribution over the bands from a regularised multinomial model of its words and of the
characters inside them; a document's bands come from a second, calibrating model of the mean, spread and
extremes of these distributions. Both are fitted on rated documents, the second on sentences that the first
didn't see.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmask.llm.glyphs import fold

BANDS = 5
#: Rated documents that the models are fitted on, chosen by a hash of their ids; rows are never left out of scoring.
FIT_DOCUMENTS = 3000
#: Their sentences that the sentence model is fitted on, evenly spread.
FIT_SENTENCES = 12_000
MIN_WORDS = 60
#: Words that are scored side by side; they bound a worker's memory only.
PORTION_WORDS = 500_000
#: Frequent function words of English and of other languages in Latin script.
ENGLISH = frozenset("the of and to in a is that for it was on with as by at be this are from or an which not have has its under their our we you your does did who since because although while if when but so".split())
FOREIGN = frozenset("der die das und ist von den des dem im zu mit auf wurde für sich eine el la los las del que en por una se le les du une est dans pour sur au aux qui ce et il de un".split())
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*|\d+")
_SENTENCE = re.compile(r"(?<=[.!?])[\"')]*\s+|\n+")


@lru_cache(1)
def _letters() -> np.ndarray:
    """Of each code point of the first plane: 0 no letter, 1 Latin letter, 2 other letter."""
    return np.array([0 if not chr(i).isalpha() else 1 if i < 0x250 else 2 for i in range(0x10000)], np.uint8)


def _latin(text: str) -> bool:
    """Whether Latin letters outweigh others by far; letters beyond the first plane count as others."""
    if text.isascii():
        return True
    kinds = np.bincount(_letters()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x4E00)], minlength=3)
    return kinds[1] >= 0.6 * (kinds[1] + kinds[2])


def english(text: str) -> bool:
    """Mainly English: Latin letters outweigh others and English function words those of other languages."""
    if not _latin(text):
        return False
    ws = text.lower().split()
    n = Counter(ws)
    here = sum(n[w] for w in ENGLISH)
    return here >= 0.04 * len(ws) and here > sum(n[w] for w in FOREIGN)


def sentences(text: str) -> list[list[str]]:
    return [t for t in (["0" if "0" <= w[0] <= "9" else w for w in _TOKEN.findall(s)] for s in _SENTENCE.split(text.lower())) if t]


def word_features(w: str) -> list[str]:
    p = f"<{w}>"
    return [f"w={w}"] + [p[i : i + 3] for i in range(len(p) - 2)] + [f"e={p[-5:]}", f"n={min(len(w), 16)}"]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int, rate: float = 0.1, basis: np.ndarray | None = None) -> np.ndarray:
    """Multinomial logistic regression with an L2 penalty by Adam over all rows; y holds target distributions.

    With a ``basis`` the features are x @ basis, which is never formed.
    """
    w = np.zeros((x.shape[1] if basis is None else basis.shape[1], y.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = x @ (w if basis is None else basis @ w)
        g = x.T @ (softmax(z) - y) / len(x)
        g = (g if basis is None else basis.T @ g) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Level:
    """The fitted models; small (words seen in the fit, three-letter pieces), so they travel with the function."""

    def __init__(self) -> None:
        self.features: dict[str, int] = {}
        self.weights = np.zeros((1, BANDS), np.float32)
        self.shape = np.zeros((2, BANDS), np.float32)
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, BANDS), np.float32)
        self.top = np.zeros((1, BANDS), np.float32)
        self.mean = self.dev = np.zeros(1, np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": np.zeros((0, BANDS), np.float32)}

    def ids(self, sents: list[list[str]]) -> np.ndarray:
        """Rows of the table of word scores; words that are new get theirs."""
        known = self.known
        if len(known) > 400_000:
            known.clear()
        flat = [w for s in sents for w in s]
        new = [w for w in dict.fromkeys(flat) if w not in known]
        if new:
            rows = [[self.features[f] for f in word_features(w) if f in self.features] for w in new]
            scores = np.stack([self.weights[r].sum(axis=0) if r else np.zeros(BANDS, np.float32) for r in rows]).astype(np.float32)
            start = len(known)
            known.update(zip(new, range(start, start + len(new))))
            if len(self.table) < len(known):
                self.table = np.concatenate([self.table[:start], scores, np.zeros((max(1000, len(known)), BANDS), np.float32)])
            else:
                self.table[start : len(known)] = scores
        return np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))

    def scores(self, sents: list[list[str]]) -> np.ndarray:
        """A row of scores for each sentence."""
        n = np.array([len(s) for s in sents])
        ids = self.ids(sents)
        flat = self.table[ids]
        mean = np.add.reduceat(flat, np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / n[:, None]
        return mean + np.stack([np.ones(len(n)), np.log(n)], axis=1).astype(np.float32) @ self.shape

    def fit_sentences(self, docs: list[tuple[list[list[str]], np.ndarray]]) -> None:
        rows = [(s, y) for sents, y in docs for s in sents]
        vocab = Counter(w for s, _ in rows for w in set(s))
        seen = Counter(f for w, n in vocab.items() for f in word_features(w) for _ in range(min(n, 3)))
        self.features = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
        words = {w: i for i, w in enumerate(sorted(w for w, n in vocab.items() if n >= 3))}
        rows = rows[:: -(-len(rows) // FIT_SENTENCES)]
        counts = np.zeros((len(rows), len(words)), np.float32)
        for r, (s, _) in enumerate(rows):
            for w in s:
                if w in words:
                    counts[r, words[w]] += 1.0 / len(s)
        spell = np.zeros((len(words) + 2, len(self.features) + 2), np.float32)
        for w, i in words.items():
            for f in word_features(w):
                if f in self.features:
                    spell[i, self.features[f]] += 1
        spell[-2, -2] = spell[-1, -1] = 1
        x = np.concatenate([counts, np.stack([np.ones(len(rows)), np.log([len(s) for s, _ in rows])], axis=1).astype(np.float32)], axis=1)
        w = fit_logistic(x, np.stack([y for _, y in rows]).astype(np.float32), 1e-4, 150, basis=spell)
        self.weights, self.shape, self.known = w[:-2], w[-2:], {}
        self.table = np.zeros((0, BANDS), np.float32)

    def documents(self, docs: list[list[list[str]]]) -> np.ndarray:
        """A row of features for each document, from the distributions of its sentences; all documents are worked out side by side."""
        sents = [s for d in docs for s in d]
        per = np.array([len(d) for d in docs])
        first = np.concatenate([[0], np.cumsum(per)[:-1]])
        n = np.array([len(s) for s in sents], np.float64)
        z = self.scores(sents)
        p = softmax(z)
        total = lambda x: np.add.reduceat(x, first, axis=0)
        mean = lambda x: total(x) / (per if x.ndim == 1 else per[:, None])
        spread = lambda x: np.sqrt(np.maximum(mean(x * x) - mean(x) ** 2, 0))
        words = total(n)
        sizes = np.fromiter((len(w) for s in sents for w in s), np.float64, int(n.sum()))
        begins = np.concatenate([[0], np.cumsum(words)[:-1]]).astype(np.int64)
        level, length = p.astype(np.float64) @ np.arange(BANDS), np.log(n)
        columns = [spread(level), mean(length), spread(length), mean(n) / 10, np.add.reduceat(sizes, begins) / words, np.add.reduceat((sizes > 8).astype(np.float64), begins) / words]
        return np.concatenate([mean(p), total(n[:, None] * p) / words[:, None], mean(z), np.stack(columns, axis=1)], axis=1).astype(np.float32)

    def fit(self, docs: list[tuple[list[list[str]], np.ndarray]]) -> "Level":
        """Cross-fitted: each half's document features come from sentences of the other half's model."""
        xs, ys = [], []
        for half in (0, 1):
            self.fit_sentences(docs[1 - half :: 2] or docs)
            if rest := docs[half::2]:
                xs.append(self.documents([sents for sents, _ in rest]))
                ys += [y for _, y in rest]
        self.fit_sentences(docs)
        x = np.concatenate(xs)
        self.mean, self.dev = x.mean(axis=0), x.std(axis=0) + 1e-3
        x = (x - self.mean) / self.dev
        self.top = fit_logistic(np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1), np.stack(ys), 2e-3, 600, 0.03)
        return self

    def bands(self, docs: list[list[list[str]]]) -> list[int]:
        out: list[int] = []
        at = 0
        while at < len(docs):
            end = size = 0
            for end in range(at, len(docs)):
                size += sum(map(len, docs[end]))
                if size > PORTION_WORDS:
                    break
            x = (self.documents(docs[at : end + 1]) - self.mean) / self.dev
            out += (np.argmax(np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1) @ self.top, axis=1) + 1).tolist()
            at = end + 1
        return out


def target(text: str | None) -> list[list[str]] | None:
    """The sentences of the folded text if it is to be rated (mainly English, at least MIN_WORDS words between blanks), else None."""
    if text is None or len(text.split()) < MIN_WORDS:
        return None
    folded = fold(text)
    return (sentences(folded) or None) if english(folded) else None


def fit(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, band: str) -> Level | None:
    """The models of FIT_DOCUMENTS rated documents at most; None without any rating. Raters of one document share it equally."""
    rated = labels.select(F.col(label_key).alias("_k"), F.col(band).cast("int").alias("_b")).where(F.col("_b").between(1, BANDS))
    rated = rated.groupBy("_k").agg(F.collect_list("_b").alias("_b"))
    chosen = rated.orderBy(F.xxhash64("_k"), "_k").limit(FIT_DOCUMENTS)
    # A few keys go to the texts, not the texts to them.
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k").toPandas().drop_duplicates("_k").sort_values("_k")
    fitted = []
    for t, bs in zip(rows["_t"], rows["_b"]):
        if (sents := target(t)) is not None:
            y = np.bincount(np.array(bs) - 1, minlength=BANDS).astype(np.float32)
            fitted.append((sents, y / y.sum()))
    return Level().fit(fitted) if len(fitted) >= 2 else None


def levels(docs: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, band: str) -> DataFrame:
    """(key, band): the band 1 to 5 of every row whose text is mainly English and has at least MIN_WORDS words.

    Rows with null, empty or shorter texts, and all rows if nothing is rated, are left out. Repeated rows
    (same key) give one row each; null bands and those outside 1 to 5 don't count. Texts are read whole.
    """
    kind = docs.schema[key].dataType.simpleString()
    model = fit(docs, key, text, labels, label_key, band)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [(k, sents) for k, t in zip(pdf["_k"], pdf["_t"]) if (sents := target(t)) is not None] if model else []
            yield pd.DataFrame({"_k": [k for k, _ in got], "_b": model.bands([s for _, s in got]) if got else []})

    return docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_t is not null").mapInPandas(run, f"_k {kind}, _b int").select(F.col("_k").alias(key), F.col("_b").alias("band"))
