"""Personal information in free text (problem 5): a skip-chain conditional random field.

Texts become tokens, numbers and mail addresses in any disguise being one token each. Neighbouring tokens share a
chain; tokens that recur in a text with a capital letter, or in a script without case, are joined by skip edges.
Messages pass over chain and skip edges in turn (loopy belief propagation); the messages of the skip edges then stand
beside the tokens' own scores in a Viterbi pass. Chain and token weights are fitted on labelled records by maximum
likelihood; in the last epochs, the skip edges' potentials are fitted together with them, by the pair beliefs of the messages.

Texts of one document share their skip edges: a first pass tags every text and gives its words' beliefs, which are
added up by document and word, also over words that are a letter away. They reach the equal and similar words of the
document's other texts as one message each. As in residual belief propagation, a message is sent only where it can
change something: to words whose own belief is not settled yet; texts without such a word are done after the first pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanmask.llm.cluster import within
from spanmask.llm.glyphs import visible
from spanmask.llm.sentences import INVISIBLE, _one_to_one
from spanmask.sources.lineage import cut

#: Labelled records the field is fitted on, chosen by a hash of their ids. Every row is tagged.
FIT_RECORDS = 2000
ROUNDS = 2  # of messages over the skip edges
EPOCHS, JOINT = 10, 3  # of the fit, and how many of them, the last, have skip edges
#: A word whose greatest belief is this or more hears no other text: a message of MESSAGE at most (in logs) can't change its label.
SETTLED, MESSAGE = 0.98, 3.0
#: Characters that are tagged at a time and tokens whose passes run side by side; they bound a worker's memory only.
PORTION_CHARS, GROUP_TOKENS = 2_000_000, 30_000
#: Of long texts so many run side by side all the same, up to so many tokens: the steps of a pass cost the same for one text and for many.
LEAST_TEXTS, MOST_TOKENS = 64, 200_000
CLASSES = ("PERSON", "ORGANIZATION", "ADDRESS", "EMAIL", "PHONE", "SSN_TAX_ID", "CREDIT_CARD", "DATE_OF_BIRTH", "IP_ADDRESS")
#: Classes whose pieces are words; a piece of the others is mostly one token, so one label will do.
WORDED = CLASSES[:3]
LABELS = ("O", *(f"{p}-{c}" for c in CLASSES for p in ("BI" if c in WORDED else "B")))
L = len(LABELS)
#: Class of each label: 0 none, then the classes in order; and the labels of each class's first and further tokens.
CLASS_OF = np.array([0, *(i + 1 for i, c in enumerate(CLASSES) for _ in ("BI" if c in WORDED else "B"))])
FIRST = [0, *(LABELS.index(f"B-{c}") for c in CLASSES)]
NEXT = [0, *(LABELS.index(f"{'I' if c in WORDED else 'B'}-{c}") for c in CLASSES)]
#: Labels to classes: a token's beliefs by class are its beliefs by label times this.
TO_CLASS = np.eye(len(CLASSES) + 1, dtype=np.float32)[CLASS_OF]
#: Classes whose beliefs travel between texts: none (with all classes of numbers, which aren't words) and those of words.
HEARD = len(WORDED) + 1
OFFSETS = (0, -1, 1, -2, 2)
WIDTH = 14

# The shapes of numbers and addresses that are one token.
_MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|April|June|July|August|September|October|November|December)"
SHAPES = {
    "blob": r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*\d)[A-Za-z0-9+/]{30,}={0,2}",
    "mail": r"[A-Za-z0-9._+%-]+(?:\s?@\s?|\s?\[at\]\s?|\s?\(at\)\s?|\sAT\s)[A-Za-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?|\sDOT\s)[A-Za-z0-9-]+)+",
    "ip": r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    "date": rf"\b\d{{1,2}}[-./]\d{{1,2}}[-./]\d{{4}}\b|\b\d{{4}}-\d\d-\d\d\b|\b\d{{1,2}}-{_MONTH}-\d{{4}}\b|\b\d{{1,2}} {_MONTH} \d{{4}}\b|\b{_MONTH} \d{{1,2}}, \d{{4}}\b",
    "firm": r"\b[LUlu]\d{5}[A-Za-z]{2}\d{4}[A-Za-z]{3}\d{6}\b|\b\d\d[A-Za-z]{5}\d{4}[A-Za-z]\w[Zz]\w\b",
    "pan": r"\b(?:[A-Za-z]{5}\d{4}[A-Za-z]|[A-Z]{5} \d{4} [A-Z])\b",
    "card": r"(?<![\d,.])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\d,]*\d)",
    "phone": r"\+ ?\d{1,3} ?\(\d{2,4}\) ?\d{3,4}[- ]?\d{4}|\+ ?\d{2} ?-?\d{2} \d{4} ?\d{4}\b|\+ ?\d{2}-?\d{5}-?\d{5}\b|\+ ?\d{2} \d{10}\b|\b0091[ -]?\d{10}\b|\(0\d{2,4}\) ?\d{3} \d{4}\b|\b0\d{2,4}-\d{6,8}\b|\b\d{3}\.\d{3}\.\d{4}\b|\b\d{4} \d{3} \d{3}\b|(?<![\d,.])\d{10}(?![\d,.]*\d)",
    "ssn": r"\b\d{3}([- ])\d{2}\2\d{4}\b",
    "code": r"\b(?!\d+[-/][A-Z]\b(?![-/]))(?=[0-9/.-]*[A-Z])(?=[A-Z/.-]*\d)[A-Z0-9]+(?:[-/.][A-Z0-9]+)+\b",
}
#: Ideographs and kana are a token each; letters of other scripts make words with their vowel signs.
_IDEOGRAPH = "぀-ヿ㐀-鿿豈-﫿"
_NUMBER, _WORD, _REST = r"\d+(?:,\d+)*(?:\.\d+)?%?", rf"[{_IDEOGRAPH}]|(?:(?![{_IDEOGRAPH}])[^\W\d_])(?:(?![{_IDEOGRAPH}])[^\W\d_]|[ा-ॏऀ-ःั-๎̀-ͯ])*", r"\n+|\S"


#: A word that can't begin any of the shapes, and marks that can't either: most tokens are found by these, tried first.
_SURE_WORD = _WORD.replace(")*", ")*+") + r"(?![@+%_\d]|[-./:]\w| \d{4} [A-Z]\b|\s?[\[(]at|\s@|\sAT\s)"
_MONTHS = rf"(?!{_MONTH} \d)"


def _grammar(kinds: tuple[str, ...]) -> re.Pattern[str]:
    shapes = []
    for k in kinds:  # groups inside a shape get names of their own
        rx = SHAPES[k]
        for i, group in enumerate(("([ -]?)", "([- ])"), 1):
            if group in rx:
                rx = rx.replace(group, f"(?P<{k}_s>{group[1:-1]})").replace("\\1", f"(?P={k}_s)").replace("\\2", f"(?P={k}_s)")
        shapes.append(f"(?P<{k}>{rx})")
    return re.compile("|".join([f"{_MONTHS}(?P<word>{_SURE_WORD})", "(?P<rest>[,;:!?.)\"])", *shapes, f"(?P<number>{_NUMBER})", f"(?P<word_>{_WORD})", f"(?P<rest_>{_REST})"]))


_ALL, _NO_MAIL = _grammar(tuple(SHAPES)), _grammar(tuple(k for k in SHAPES if k != "mail"))
_PLAIN = re.compile(f"(?P<word>{_WORD})|(?P<rest>{_REST})")
#: What the groups' names stand for.
_KIND = {g: g.rstrip("_") if not g.endswith("_s") else g[:-2] for g in {*_ALL.groupindex, *_PLAIN.groupindex}}
_HAS_MAIL, _HAS_DIGIT = re.compile(r"@|at\]|\(at\)|\sAT\s"), re.compile(r"\d")
_DIGITS = str.maketrans("0123456789", "0000000000")
_CLEAN: dict[int, str] = {}


def clean(text: str) -> tuple[str, list[int] | None]:
    """The text in plain letters without invisible characters, and the place of each of its characters in the raw text."""
    if text.isascii():
        return text, None
    if not _CLEAN:
        _CLEAN.update(_one_to_one())
    s = text.translate(_CLEAN)
    if INVISIBLE not in s:
        return s, None
    at = [i for i, c in enumerate(s) if c != INVISIBLE]
    return s.replace(INVISIBLE, ""), at


def tokens(s: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of each token of a clean text."""
    pattern = _PLAIN if not _HAS_DIGIT.search(s) and not _HAS_MAIL.search(s) else _ALL if _HAS_MAIL.search(s) else _NO_MAIL
    return [(_KIND[m.lastgroup], m[0], *m.span()) for m in pattern.finditer(s)]


def type_key(kind: str, word: str) -> tuple[str, str]:
    """What the field knows of a token: digits don't tell one number from another, nor letters one address."""
    if kind == "word":
        return kind, word if word.isascii() else unicodedata.normalize("NFC", word)
    if kind == "mail":
        return kind, ""
    if kind in ("pan", "firm"):
        return kind, "s" if " " in word else ""
    return kind, re.sub(r"[A-Za-z]+", "a", word.translate(_DIGITS))[:24]


def type_features(kind: str, word: str) -> list[str]:
    if kind == "edge":
        return ["edge"]
    if kind != "word":
        return [f"k={kind}", f"x={kind}{word[:20]}", f"n={kind}{sum(c == '0' for c in word)}"]
    low = word.lower()
    shape = "A" if len(word) == 1 and word.isupper() else "AA" if word.isupper() else "Aa" if word[0].isupper() else "a"
    return [f"w={low}", f"s={shape}", f"sw={shape}{low}", f"e2={low[-2:]}", f"e3={low[-3:]}", f"e4={shape}{low[-4:]}", f"b2={low[:2]}", f"b3={low[:3]}", f"b4={shape}{low[:4]}", f"l={shape}{min(len(word), 12)}", "k=word" if word.isascii() else "k=other"]


def gold_labels(toks: list[tuple[str, str, int, int]], entities: list[tuple[int, int, str]], at: list[int] | None) -> list[int]:
    """BIO labels of tokens from entities in raw places."""
    out = [0] * len(toks)
    where = {c: i for i, c in enumerate(CLASSES)}
    for start, end, label in entities:
        c = where.get(label)
        if c is None:
            continue
        first = True
        for i, (_, _, a, b) in enumerate(toks):
            ra, rb = (at[a], at[b - 1] + 1) if at else (a, b)
            if ra < end and rb > start:
                out[i] = (FIRST if first else NEXT)[c + 1]
                first = False
    return out


#: Cells and headings that hold nothing personal, and an encoded text; a fit learns them beside its records.
NOTHING = (
    "N.A.", "Nil", "-", "Total", "Particulars", "Name", "Sr. No.", "Not applicable", "Remarks", "Date", "Place", "Signature", "Amount", "Notes", "Contents", "General Information", "Risk Factors", "Annexure A", "Fiscal 2021", "Page 7 of 90", "Dated: 03/04/2021",
    "Name of the director", "DRAFT PROSPECTUS", "Strictly confidential", "Secured loans", "Face value", "See Section 9", "Under the Act, the charge stands.", "Total income fell. Under clause 4, no dividend is due.", "Quote our reference in all letters.",
    "UEsDBBQABgAIAAAAIQDfpNJsWgEAACAFAAATAAgCW0NvbnRlbnRfVHlwZXNdLnhtbA==", "The seal is as filed.\nMIIBIjANBgkqhkiG9w0BAQEFAAOCAQ8AMIIBCgKCAQEAu1SU1LfVLPHCozMxH2Mo4lgOEePzNm0tRgeLezV6ffAt0g",
)


@lru_cache(200_000)
def link_key(word: str) -> str | None:
    """The form in which a word has skip edges; None if it has none."""
    return word.lower() if linkable("word", word) else None


def linkable(kind: str, word: str) -> bool:
    """Whether a token may have skip edges: words of more than three letters with a capital, or in a script without case."""
    return kind == "word" and len(word) > 3 and not word[0].islower()


def linked(toks: list[tuple[str, str, int, int]]) -> list[tuple[int, str]]:
    """The tokens that may have skip edges, in lower case."""
    return [(i, low) for i, (kind, word, _, _) in enumerate(toks) if kind == "word" and (low := link_key(word))]


@lru_cache(100_000)
def near_keys(word: str) -> tuple[tuple, tuple]:
    """(index, probe): of words a letter apart, one's index shares a key with the other's probe.

    An edit leaves one half of a word whole; two letters turned about the middle leave the sorted letters.
    """
    n, turned = len(word), "".join(sorted(word))
    index = ((n, 0, word[: n // 2]), (n, 1, word[n // 2 :]), (n, 2, turned))
    probe = tuple(k for m in (n - 1, n, n + 1) for k in ((m, 0, word[: m // 2]), (m, 1, word[n - (m - m // 2) :]))) + ((n, 2, turned),)
    return index, probe


def parted(toks: list[tuple[str, str, int, int]], i: int, j: int) -> list[tuple[int, int]]:
    """A run of name tokens, parted at commas that don't follow a lone surname: those separate two names."""
    out, begin, n = [], i, 0
    for k in range(i, j):
        if toks[k][1] == "," and n > 1:
            out.append((begin, k))
            begin, n = k + 1, 0
        elif toks[k][0] == "word" and len(toks[k][1]) > 1:
            n += 1
    return [*out, (begin, j)] if begin < j else out


class Tagger:
    """The fitted field. Scores of token types are computed when a type is first met."""

    def __init__(self) -> None:
        self.features: dict[str, int] = {}
        self.weights = np.zeros((len(OFFSETS), 1, L), np.float32)
        self.steps = np.zeros((L, L), np.float32)
        self.begin = np.zeros(L, np.float32)
        self.skip = np.zeros((L, L), np.float32)
        self._fresh()

    def _fresh(self) -> None:
        self.types: dict[tuple[str, str], int] = {}
        self.words: dict[str, int] = {}
        self.marks: dict[str, int] = {}
        self.scores = np.zeros((len(OFFSETS), 1024, L), np.float32)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("types", "words", "marks", "scores")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fresh()

    def type_id(self, key: tuple[str, str]) -> int:
        i = self.types.get(key)
        if i is None:
            i = self.types[key] = len(self.types)
            if i >= self.scores.shape[1]:
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)], axis=1)
            ids = [f for f in (self.features.get(x) for x in type_features(*key)) if f is not None]
            self.scores[:, i] = self.weights[:, ids].sum(axis=1) if ids else 0
        return i

    def ids(self, toks: list[tuple[str, str, int, int]]) -> list[int]:
        out, words = [], self.words
        for kind, word, _, _ in toks:
            if kind == "word":
                i = words.get(word)
                if i is None:
                    i = words[word] = self.type_id(type_key("word", word))
            elif kind == "rest":
                i = self.marks.get(word)
                if i is None:
                    i = self.marks[word] = self.type_id(type_key("rest", word))
            else:
                i = self.type_id(type_key(kind, word))
            out.append(i)
        return out

    def emissions(self, rows: list[list[int]], size: int) -> np.ndarray:
        edge = self.type_id(("edge", ""))
        padded = np.full((len(rows), size + 4), edge, np.int64)
        for r, ids in enumerate(rows):
            padded[r, 2 : 2 + len(ids)] = ids
        out = self.scores[0][padded[:, 2:-2]]
        for k, o in enumerate(OFFSETS[1:], 1):
            out = out + self.scores[k][padded[:, 2 + o : 2 + o + size]]
        return out

    def marginals(self, em: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scaled forward and backward passes: node marginals, the forward and backward messages and the node factors."""
        b, n, _ = em.shape
        node = np.exp(em - em.max(axis=2, keepdims=True))
        step = np.exp(self.steps)
        alpha, beta = np.empty_like(node), np.empty_like(node)
        a = node[:, 0] * np.exp(self.begin)
        alpha[:, 0] = a / a.sum(axis=1, keepdims=True)
        for t in range(1, n):
            a = (alpha[:, t - 1] @ step) * node[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        beta[:, n - 1] = 1
        inside = np.arange(n)[None, :] < lens[:, None]
        for t in range(n - 2, -1, -1):
            c = (beta[:, t + 1] * node[:, t + 1]) @ step.T
            c /= c.sum(axis=1, keepdims=True)
            beta[:, t] = np.where(inside[:, t + 1, None], c, 1)
        p = alpha * beta
        return p / p.sum(axis=2, keepdims=True), alpha, beta, node

    def viterbi(self, em: np.ndarray, lens: np.ndarray) -> np.ndarray:
        b, n, _ = em.shape
        v = em[:, 0] + self.begin
        back = np.zeros((n, b, L), np.int8)
        keep = np.zeros((n, b, L), np.float32) if lens.min() < n else None
        if keep is not None:
            keep[0] = v
        into = np.ascontiguousarray(self.steps.T)
        for t in range(1, n):
            x = v[:, None, :] + into[None]
            back[t] = x.argmax(axis=2)
            v = x.max(axis=2) + em[:, t]
            if keep is not None:
                keep[t] = v
        last = v if keep is None else keep[lens - 1, np.arange(b)]
        out = np.zeros((b, n), np.int8)
        tag = last.argmax(axis=1)
        rows = np.arange(b)
        for t in range(n - 1, -1, -1):
            here = t < lens
            if t < n - 1:
                tag = np.where(t + 1 < lens, back[t + 1, rows, tag], tag)
            out[:, t] = np.where(here, tag, 0)
        return out

    @staticmethod
    def recurring(toks: list[tuple[str, str, int, int]]) -> list[tuple[int, int]]:
        """Skip edges: each linkable word with the last occurrence before of the same word, and of one that is a letter apart."""
        return Tagger.joined(linked(toks))

    @staticmethod
    def joined(links: list[tuple[int, str]]) -> list[tuple[int, int]]:
        last: dict[str, int] = {}
        index: dict[tuple, str] = {}
        out = []
        for i, low in links:
            if low in last:
                out.append((last[low], i))
            elif len(low) > 4 and len(links) > 1:
                mine, probe = near_keys(low)
                out += [(last[o], i) for o in {index[k] for k in probe if k in index} if within(o, low, 1) <= 1]
                index.update(dict.fromkeys(mine, low))
            last[low] = i
        return out

    def scored(self, texts: list[list[tuple[str, str, int, int]]], outer: list[dict[str, np.ndarray]] | None = None, links: list[list[tuple[int, str]]] | None = None) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Groups of texts with their lengths and their tokens' scores, messages included; ``outer`` are those of other texts by word."""
        order = sorted((i for i, t in enumerate(texts) if t), key=lambda i: len(texts[i]))
        links = links or [linked(t) for t in texts]
        at = 0
        while at < len(order):
            group, size = [], 0
            while at < len(order) and (not group or len(texts[order[at]]) * (len(group) + 1) <= (GROUP_TOKENS if len(group) >= LEAST_TEXTS else MOST_TOKENS)):
                group.append(order[at])
                size = len(texts[order[at]])
                at += 1
            lens = np.array([len(texts[i]) for i in group])
            em = self.emissions([self.ids(texts[i]) for i in group], size)
            for r, g in enumerate(group):
                if outer and outer[g]:
                    for i, word in links[g]:
                        if (message := outer[g].get(word)) is not None:
                            em[r, i] += message
            edges = [(r, i, j) for r, g in enumerate(group) for i, j in self.joined(links[g])]
            if edges:
                em = em + self.skips(em, lens, edges)[0]
            yield group, lens, em

    def tag(self, texts: list[list[tuple[str, str, int, int]]], outer: list[dict[str, np.ndarray]] | None = None) -> list[np.ndarray]:
        """Labels of each text's tokens."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(texts)
        for group, lens, em in self.scored(texts, outer):
            tags = self.viterbi(em, lens)
            for r, i in enumerate(group):
                out[i] = tags[r, : lens[r]]
        return out

    def first(self, texts: list[str]) -> list[tuple[list[tuple[str, int, int]], list[str], np.ndarray, int]]:
        """(findings, linkable words, their mean beliefs, how many are open) of each text, before it hears of other texts.

        The words that aren't settled, the open ones, come first.
        """
        cleaned = [clean(t) for t in texts]
        toks = [tokens(s) for s, _ in cleaned]
        out: list = [([], [], np.zeros((0, HEARD), np.float32), 0)] * len(texts)
        links = [linked(ts) for ts in toks]
        for group, lens, em in self.scored(toks, None, links):
            tags = self.viterbi(em, lens)
            rows = [r for r, g in enumerate(group) if links[g]]
            at_row = dict(zip(rows, range(len(rows))))
            if rows:
                p = self.marginals(em[rows], lens[rows])[0] @ TO_CLASS
                p[..., 0] += p[..., HEARD:].sum(axis=2)
                p = p[..., :HEARD]
                sure = p.max(axis=2) >= SETTLED
            for r, g in enumerate(group):
                found = self.decoded(cleaned[g], toks[g], tags[r, : lens[r]])
                if not links[g]:
                    out[g] = found, [], out[g][2], 0
                    continue
                r = at_row[r]
                by: dict[str, list[int]] = {}
                for i, word in links[g]:
                    by.setdefault(word, []).append(i)
                settled = {w: all(sure[r, i] for i in at) for w, at in by.items()}
                words = sorted(by, key=settled.__getitem__)
                firsts = p[r, [by[w][0] for w in words]]
                for k, w in enumerate(words):
                    if len(by[w]) > 1:
                        firsts[k] = p[r, by[w]].mean(axis=0)
                out[g] = found, words, firsts, len(words) - sum(settled.values())
        return out

    def message(self, belief: np.ndarray) -> np.ndarray:
        """What tokens of such a belief by class (the last axis) say over a skip edge, as log messages by label."""
        kernel = np.exp(self.skip[FIRST[:HEARD]])[:, FIRST]
        m = np.log(np.maximum(belief, 1e-9) @ kernel)[..., CLASS_OF]
        return (m - m.mean(axis=-1, keepdims=True)).astype(np.float32)

    def skips(self, em: np.ndarray, lens: np.ndarray, edges: list[tuple[int, int, int]], pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Loopy messages: the sum of log messages that reach each token over its skip edges, and if asked each edge's belief in pairs of classes."""
        rows = sorted({r for r, _, _ in edges})
        local = {r: k for k, r in enumerate(rows)}
        r, i, j = (np.array(x) for x in zip(*((local[r], i, j) for r, i, j in edges)))
        part, plens = em[rows], lens[rows]
        there = np.zeros((len(r), L), np.float32)  # i to j
        back = np.zeros((len(r), L), np.float32)
        kernel = np.exp(self.skip)
        total = np.zeros_like(part)
        for _ in range(ROUNDS):
            p, *_ = self.marginals(part + total, plens)
            log = np.log(np.maximum(p, 1e-9))
            # A message leaves out what came over its own edge.
            a = np.exp(log[r, i] - back)
            b = np.exp(log[r, j] - there)
            there, back = np.log(a / a.sum(axis=1, keepdims=True) @ kernel), np.log(b / b.sum(axis=1, keepdims=True) @ kernel.T)
            there, back = there - there.mean(axis=1, keepdims=True), back - back.mean(axis=1, keepdims=True)
            total = np.zeros_like(part)
            np.add.at(total, (r, j), there)
            np.add.at(total, (r, i), back)
        out = np.zeros_like(em)
        out[rows] = total
        if not pairs:
            return out, None
        pair = np.einsum("el,lm,em->elm", a, kernel, b)
        pair = np.einsum("lc,elm,md->ecd", TO_CLASS, pair, TO_CLASS)
        return out, pair / pair.sum(axis=(1, 2), keepdims=True)

    def pulls(self, texts: list[list[tuple[str, str, int, int]]], gold: list[list[int]]) -> np.ndarray:
        """Where the fit of the skip potentials starts: how much more often joined tokens share a pair of classes than chance has it, in half measure."""
        k = len(CLASSES) + 1
        pairs = np.full((k, k), 0.5)
        for toks, y in zip(texts, gold):
            for i, j in self.recurring(toks):
                a, b = CLASS_OF[y[i]], CLASS_OF[y[j]]
                pairs[a, b] += 0.5
                pairs[b, a] += 0.5
        share = pairs.sum(axis=1) / pairs.sum()
        return np.clip(0.5 * np.log(pairs / pairs.sum() / np.outer(share, share)), -MESSAGE / 2, MESSAGE / 2).astype(np.float32)

    def fit(self, texts: list[list[tuple[str, str, int, int]]], gold: list[list[int]], epochs: int = EPOCHS, rate: float = 0.04, penalty: float = 1e-5) -> "Tagger":
        counts: dict[str, int] = defaultdict(int)
        types: dict[tuple[str, str], int] = {("edge", ""): 0}
        rows = []
        for toks in texts:
            rows.append([types.setdefault(type_key(k, w), len(types)) for k, w, _, _ in toks])
        for toks in texts:
            for key in {type_key(k, w) for k, w, _, _ in toks}:
                for f in type_features(*key):
                    counts[f] += 1
        self.features = {"": 0} | {f: i + 1 for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 2 or f.startswith(("k=", "edge"))))}
        self.features.setdefault("edge", len(self.features))
        index = np.zeros((len(types), WIDTH), np.int64)
        for key, t in types.items():
            ids = [self.features[f] for f in type_features(*key) if f in self.features][:WIDTH]
            index[t, : len(ids)] = ids
        order = sorted((i for i, t in enumerate(rows) if t), key=lambda i: len(rows[i]))
        groups = [order[i : i + 128] for i in range(0, len(order), 128)]
        w = np.zeros((len(OFFSETS), len(self.features), L), np.float32)
        pull = self.pulls(texts, gold)
        joined = [self.recurring(toks) for toks in texts]
        params = [w, self.steps, self.begin, pull]
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
        t = 0
        rng = np.random.default_rng(0)
        for epoch in range(epochs):
            for g in rng.permutation(len(groups)):
                group = groups[g]
                lens = np.array([len(rows[i]) for i in group])
                n = int(lens.max())
                padded = np.zeros((len(group), n + 4), np.int64)
                y = np.zeros((len(group), n), np.int64)
                for r, i in enumerate(group):
                    padded[r, 2 : 2 + lens[r]] = rows[i]
                    y[r, : lens[r]] = gold[i]
                used, inverse = np.unique(padded, return_inverse=True)
                inverse = inverse.reshape(padded.shape)
                table_ = w[:, index[used]].sum(axis=2)
                em = sum(table_[k][inverse[:, 2 + o : 2 + o + n]] for k, o in enumerate(OFFSETS))
                edges = [(r, i, j) for r, g_ in enumerate(group) for i, j in joined[g_]] if epoch >= epochs - JOINT else []
                gp = np.zeros_like(pull)
                if edges:
                    self.skip = pull[CLASS_OF[:, None], CLASS_OF[None, :]]
                    message, pair = self.skips(em, lens, edges, pairs=True)
                    em = em + message
                    gp = pair.sum(axis=0)
                    r, i, j = np.array(edges).T
                    np.add.at(gp, (CLASS_OF[y[r, i]], CLASS_OF[y[r, j]]), -1)
                    gp = (gp + gp.T) / 2
                p, alpha, beta, node = self.marginals(em, lens)
                mask = np.arange(n)[None, :] < lens[:, None]
                d = p.copy()
                np.put_along_axis(d, y[..., None], np.take_along_axis(d, y[..., None], 2) - 1, 2)
                d *= mask[..., None]
                total = lens.sum()
                step = np.exp(self.steps)
                gs = np.zeros_like(self.steps)
                right = beta[:, 1:] * node[:, 1:]
                norm = np.einsum("btl,btl->bt", alpha[:, :-1] @ step, right)
                both = mask[:, 1:]
                left = (alpha[:, :-1] / np.maximum(norm, 1e-30)[..., None])[both]
                gs += (left.T @ right[both]) * step
                np.add.at(gs, (y[:, :-1][both], y[:, 1:][both]), -1)
                gw = np.zeros_like(w)
                # The features of the group's own token types only, in order, so that their gradients are sums of runs.
                flat = index[used].ravel()
                by_feature = np.argsort(flat, kind="stable")
                ordered = flat[by_feature]
                runs = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
                for k, o in enumerate(OFFSETS):
                    ids = inverse[:, 2 + o : 2 + o + n].ravel()
                    s = np.argsort(ids, kind="stable")
                    firsts = np.searchsorted(ids[s], np.arange(len(used)))
                    seen = np.unique(ids)
                    de = np.zeros((len(used), L), np.float32)
                    de[seen] = np.add.reduceat(d.reshape(-1, L)[s], firsts[seen], axis=0)
                    gw[k, ordered[runs]] = np.add.reduceat(de[by_feature // WIDTH], runs, axis=0)
                gw[:, 0] = 0
                t += 1
                lr = rate * (1 - epoch / epochs * 0.8)
                for x, grad, (m, v) in zip(params, (gw / total + penalty * w, gs / total + penalty * self.steps, d[:, 0].sum(axis=0) / len(group), gp / max(len(edges), 1)), moments if edges else moments[:3]):
                    m *= 0.9
                    m += 0.1 * grad
                    v *= 0.99
                    v += 0.01 * grad * grad
                    x -= lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
        w[:, 0] = 0
        self.weights = w
        pull = np.clip(pull, -MESSAGE / 2, MESSAGE / 2)
        self.skip = pull[CLASS_OF[:, None], CLASS_OF[None, :]].astype(np.float32)
        self._fresh()
        return self

    def found(self, texts: list[str], outer: list[dict[str, np.ndarray]] | None = None) -> list[list[tuple[str, int, int]]]:
        """(label, start, end) in raw places of each text's personal information, organisations included."""
        cleaned = [clean(t) for t in texts]
        toks = [tokens(s) for s, _ in cleaned]
        return [self.decoded(c, ts, tags) for c, ts, tags in zip(cleaned, toks, self.tag(toks, outer))]

    @staticmethod
    def decoded(cleaned: tuple[str, list[int] | None], ts: list[tuple[str, str, int, int]], labels: np.ndarray) -> list[tuple[str, int, int]]:
        """The findings of a text's labels, without marks at their ends."""
        at = cleaned[1]
        got, i, tags = [], 0, labels.tolist()
        while i < len(tags):
            if not tags[i]:
                i += 1
                continue
            c, j = CLASS_OF[tags[i]], i + 1
            while j < len(tags) and tags[j] == NEXT[c]:
                j += 1
            for a, b in parted(ts, i, j) if c == 1 else [(i, j)]:
                b -= 1
                while b > a and ts[b][0] == "rest" and not (ts[b][1] == "." and ts[b - 1][0] == "word" and len(ts[b - 1][1]) == 1) and ts[b][1] not in ")":
                    b -= 1
                while a < b and ts[a][0] == "rest" and ts[a][1] not in "#(+":
                    a += 1
                if ts[a][0] != "rest" or a < b:
                    start, end = ts[a][2], ts[b][3]
                    got.append((CLASSES[c - 1], at[start] if at else start, at[end - 1] + 1 if at else end))
            i = j
        return got


def respelled(name: str, label: str, turn: int) -> str | None:
    """Another way to write a name, so that rare ways are learnt from common ones; None where there's none."""
    parts = name.split()
    if label == "PERSON" and 2 <= len(parts) <= 3 and all(p.isalpha() and len(p) > 1 for p in parts):
        given, surname = parts[:-1], parts[-1]
        dotted = " ".join(p[0] + "." for p in given)
        first = " ".join([given[0], *(p[0] + "." for p in given[1:])])
        return (f"{surname}, {first}", f"{dotted} {surname}", f"{surname} {' '.join(given)}", f"{surname}, {first}", f"{''.join(p[0] for p in given)} {surname}", surname, f"{first} {surname}", name.upper(), f"{given[0]} {given[-1][0]} {surname}", name.lower())[turn % 10]
    if label == "ORGANIZATION" and len(parts) >= 3 and all(p.isalpha() for p in parts):
        letters = [p[0] for p in parts if p != "and"]
        return (".".join(letters) + ".", "".join(letters), f"M/s {name}", name.upper(), parts[0])[turn % 5]
    return None


def examples(records: list[tuple[str, list[tuple[int, int, str]]]]) -> tuple[list, list]:
    """Tokens and labels of labelled records; some entities also respelled, or alone as in a cell (a date alone isn't a birth date)."""
    texts, gold = [], []

    def add(text: str, entities: list[tuple[int, int, str]]) -> None:
        s, at = clean(text)
        toks = tokens(s)
        texts.append(toks)
        gold.append(gold_labels(toks, entities, at))

    for text in NOTHING * max(1, len(records) // 200):
        add(text, [])
    for n, (text, entities) in enumerate(records):
        add(text, entities)
        for m, (a, b, label) in enumerate(entities):
            value = text[a:b]
            if label == "DATE_OF_BIRTH":
                add(value, [])
            elif (n + m) % 3 == 0 and not (label == "SSN_TAX_ID" and value.isdigit()):
                add(value, [(0, len(value), label)])
            if (n + m) % 2 == 0 and (other := respelled(value, label, n // 2 + m)) is not None:
                shift = len(other) - len(value)
                add(text[:a] + other + text[b:], [(x, y + shift, c) if x == a else (x + shift * (x > a), y + shift * (x > a), c) for x, y, c in entities])
                if n % 4 == 0:
                    add(other, [(0, len(other), label)])
    return texts, gold


def fit(labelled: DataFrame, key: str, text: str, entities: str) -> Tagger | None:
    """The field of at most FIT_RECORDS labelled records; None if none is labelled."""
    some = labelled.where(F.col(entities).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(entities).alias("_e")).dropDuplicates(["_k"])
    rows = some.orderBy(F.xxhash64("_k"), "_k").limit(FIT_RECORDS).collect()
    records = [(r["_t"], [(e["start"], e["end"], e["label"]) for e in r["_e"] if e["start"] is not None and e["end"] is not None]) for r in rows]
    return Tagger().fit(*examples(records)) if records else None


def _portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(begin, end) of portions of bounded size."""
    at = 0
    while at < len(texts):
        part, size = at, 0
        while at < len(texts) and (at == part or size + len(texts[at]) < PORTION_CHARS):
            size += len(texts[at])
            at += 1
        yield part, at


def _different(texts: list[str]) -> tuple[list[str], list[int]]:
    """Each different text once, and where each text stands among them."""
    which = {t: i for i, t in enumerate(dict.fromkeys(texts))}
    return list(which), [which[t] for t in texts]


_FOUND = "array<struct<label:string,start:int,end:int>>"
_PARTS = [f"c{i}" for i in range(HEARD)]


def _without_firms(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return [x for x in found if x[0] != "ORGANIZATION"]


def _alone(one: DataFrame, tagger: Tagger) -> DataFrame:
    """(_k, _t, found) of texts that stand alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, texts = pdf["_k"].tolist(), pdf["_t"].tolist()
            for part, end in _portions(texts):
                some, at = _different(texts[part:end])
                got = [_without_firms(f) for f in tagger.found(some)]
                yield pd.DataFrame({"_k": keys[part:end], "_t": texts[part:end], "found": [got[i] for i in at]})

    return one.select("_k", "_t").mapInPandas(run, f"_k {one.schema['_k'].dataType.simpleString()}, _t string, found {_FOUND}")


def first_pass(one: DataFrame, tagger: Tagger, keep: bool) -> DataFrame:
    """(_k, _d, _t, found, words, beliefs, opened): each text's findings, its linkable words with their beliefs, and how many are open.

    The text goes on only where a word is open, or everywhere if it is to be kept.
    """
    kinds = {c: one.schema[c].dataType.simpleString() for c in ("_k", "_d")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, scopes, texts = pdf["_k"].tolist(), pdf["_d"].tolist(), pdf["_t"].tolist()
            for part, end in _portions(texts):
                some, at = _different(texts[part:end])
                got = [(_without_firms(f), w, b.ravel(), n) for f, w, b, n in tagger.first(some)]
                rows = [got[i] for i in at]
                yield pd.DataFrame({"_k": keys[part:end], "_d": scopes[part:end], "_t": [t if keep or r[3] else None for t, r in zip(texts[part:end], rows)], **{c: [r[i] for r in rows] for i, c in enumerate(("found", "words", "beliefs", "opened"))}})

    return one.select("_k", "_d", "_t").mapInPandas(run, f"_k {kinds['_k']}, _d {kinds['_d']}, _t string, found {_FOUND}, words array<string>, beliefs array<float>, opened int")


def heard(first: DataFrame) -> DataFrame:
    """(_k, _w, _b): the open words of each text that occur in other texts of its document ``_d``, and what those believe of them.

    ``_b`` holds a belief by class for each word, the mean over the document's other texts in which the word or a
    similar one stands. Similar are words of five letters and more that differ by one letter added, lost or changed, or
    by two letters in turned places. Sums are formed by document and word before any join, so that a document's size doesn't matter.
    """
    own = [F.expr(f"beliefs[{HEARD} * i + {c}]").alias(p) for c, p in enumerate(_PARTS)]
    said = first.where("_d is not null and size(words) > 0").select("_k", "_d", F.posexplode("words").alias("i", "word"), "beliefs", "opened").select("_k", "_d", "word", (F.col("i") < F.col("opened")).alias("open"), *own)
    words = said.groupBy("_d", "word").agg(F.count("*").alias("n"), *(F.sum(c).cast("float").alias(c) for c in _PARTS), F.max("open").alias("asks"))
    asks = words.where("asks").select("_d", "word")
    # One's index shares a key with the other's probe if the words are a letter apart; keys travel as hashes, words verify.
    half = lambda m, of: f"concat({m}, '<', substring({of}, 1, ({m}) div 2))"
    rest = lambda m, of: f"concat({m}, '>', substring({of}, length({of}) - ({m}) + ({m}) div 2 + 1))"
    turned = "concat('=', array_join(array_sort(split(word, '')), ''))"
    n = "length(word)"
    keyed = lambda *keys: F.explode(F.expr(f"array_distinct(transform(array({', '.join(keys)}), k -> xxhash64(_d, k)))")).alias("_h")
    long = F.length("word") > 4
    index = words.where(long).select(F.col("_d").alias("_e"), F.col("word").alias("other"), "n", *_PARTS, keyed(half(n, "word"), rest(n, "word"), turned))
    probe = asks.where(long).select("_d", "word", keyed(*(f(m, "word") for m in (f"{n} - 1", n, f"{n} + 1") for f in (half, rest)), turned))
    apart = F.expr("levenshtein(word, other, 2) = 1 or length(word) = length(other) and levenshtein(word, other, 2) = 2 and array_sort(split(word, '')) = array_sort(split(other, ''))")
    similar = probe.join(index, "_h").where("_d = _e").where(apart).dropDuplicates(["_d", "word", "other"]).select("_d", "word", "n", *_PARTS)
    every = words.where("asks").select("_d", "word", "n", *_PARTS).unionByName(similar).groupBy("_d", "word").agg(*(F.sum(c).alias(f"{c}_s") for c in ("n", *_PARTS))).where("n_s > 1")
    others = F.array(*((F.col(f"{c}_s") - F.col(c)) / (F.col("n_s") - 1) for c in _PARTS)).cast("array<float>")
    got = said.where("open").join(every, ["_d", "word"]).groupBy("_k").agg(F.collect_list(F.struct("word", others.alias("b"))).alias("m"))
    return got.select("_k", F.col("m.word").alias("_w"), F.flatten("m.b").alias("_b"))


def _again(tagger: Tagger):
    """Texts with open words, tagged with what they heard; a text that heard nothing keeps its findings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, t, f) for k, t, f, w in zip(pdf["_k"], pdf["_t"], pdf["found"], pdf["_w"]) if w is None]
            yield pd.DataFrame(rows, columns=["_k", "_t", "found"])
            some = pdf[pdf["_w"].notna()]
            keys, texts, words, beliefs = (some[c].tolist() for c in ("_k", "_t", "_w", "_b"))
            for part, end in _portions(texts):
                outer = [dict(zip(w, tagger.message(np.reshape(b, (-1, HEARD))))) for w, b in zip(words[part:end], beliefs[part:end])]
                yield pd.DataFrame({"_k": keys[part:end], "_t": texts[part:end], "found": [_without_firms(f) for f in tagger.found(texts[part:end], outer)]})

    return run


def _tagged(df: DataFrame, key: str, text: str, tagger: Tagger, document: str | None, keep: bool) -> DataFrame:
    """(_k, _t, found) of each distinct visible text, the text itself only if it is to be kept."""
    one = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), *([F.col(document).alias("_d")] if document else [])).where(visible(F.col("_t"))).dropDuplicates(["_k"])
    if not document:
        return _alone(one, tagger)
    first = cut(first_pass(one, tagger, keep))
    waits = (F.col("opened") > 0) & F.col("_d").isNotNull()
    again = first.where(waits).select("_k", "_t", "found").join(heard(first), "_k", "left")
    done = first.where(~waits).select("_k", "_t", "found")
    return done.unionByName(again.mapInPandas(_again(tagger), done.schema))


def spans(df: DataFrame, key: str, text: str, tagger: Tagger | None, document: str | None = None) -> DataFrame:
    """(key, label, pii_start, pii_end): a row for each piece of personal information in the text of each distinct ``key``.

    Null, empty and blank texts have none; repeated rows (same key) count once; the longest texts are read whole;
    columns besides these aren't read; without a fitted ``tagger`` there are no rows. Organisations are tagged as well,
    so that they aren't taken for persons, but are no personal information. Texts of one ``document`` hear of each
    other's words; without a ``document``, or where it is null, each text stands alone.
    """
    if not tagger:
        return df.where("false").select(key, F.lit("").alias("label"), F.lit(0).alias("pii_start"), F.lit(0).alias("pii_end"))
    each = _tagged(df, key, text, tagger, document, False).select("_k", F.explode("found").alias("f"))
    return each.select(F.col("_k").alias(key), "f.label", F.col("f.start").alias("pii_start"), F.col("f.end").alias("pii_end"))


def replaced(text: str, found: list[tuple[str, int, int]]) -> str:
    out, last = [], 0
    for label, a, b in sorted(found, key=lambda x: x[1]):
        if a >= last:
            out += [text[last:a], f"[{label}]"]
            last = b
    return "".join(out) + text[last:]


def masked(df: DataFrame, key: str, text: str, tagger: Tagger | None, document: str | None = None) -> DataFrame:
    """(key, masked): each distinct ``key`` with its text, every piece of personal information as a typed placeholder.

    Null texts stay null, empty and blank ones stay as they are; the rest of a text isn't touched. Without a fitted
    ``tagger`` texts stay as they are. ``document`` is as for spans.
    """
    plain = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    blank = plain if not tagger else plain.where(F.coalesce(~visible(F.col("_t")), F.lit(True)))
    as_is = blank.dropDuplicates(["_k"]).select(F.col("_k").alias(key), F.col("_t").alias("masked"))
    if not tagger:
        return as_is

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[(x["label"], x["start"], x["end"]) for x in f] for f in pdf["found"]]
            yield pd.DataFrame({"_k": pdf["_k"], "masked": [replaced(t, f) for t, f in zip(pdf["_t"], found)]})

    kind = df.schema[key].dataType.simpleString()
    there = _tagged(df, key, text, tagger, document, True).mapInPandas(run, f"_k {kind}, masked string").withColumnRenamed("_k", key)
    return there.unionByName(as_is)
