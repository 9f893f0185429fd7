"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Tokens are the white-space separated words of a text; a chain is a run of at most CHAIN of them. The field
has two labels, weights for features of a token (the word, its beginnings, capitals and marks), of the words
before and after it (their beginnings, and whether a sentence ends there), and for transitions. Marginals come
from the forward-backward recursions, over all chains of a batch in step. A document's spans are the stretches
of tokens above a threshold; its score is a logistic function of what its tokens' marginals amount to
together (one less the product of their complements, as odds) beyond those of a clean text of that length,
of the largest marginal, and of the length.

Training tokens are labelled from labelled documents. A form that toxic documents hold significantly more
often than clean ones (log-likelihood ratio above a bound that grows with the number of forms compared) labels
its tokens in toxic documents by the part of its occurrences that the clean ones do not explain. The field is
fitted to these; then toxic documents are labelled anew by their own marginals, where context and form agree,
and it is fitted again. The logistic function is fitted to scores of documents that the field had not seen
(two halves, each scored by the field of the other). The documents are a bounded sample: at most SAMPLE of
each class, in the order of a hash, of at most SAMPLE_CHARS characters each, without near copies.

Defined cases: a null or empty text scores 0; without toxic documents to learn from every score is 0;
labels that are null or whose document is missing teach nothing; a doc_id labelled several times
counts by its largest label, and of several texts of an id the smallest teaches; repeated rows score alike;
an empty table gives no rows; only doc_id and text are read for a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, texts_of, trimmed

CHAIN = 256
#: Documents of each class, and characters of a document, that may train the field.
SAMPLE, SAMPLE_CHARS = 1000, 10_000
ROUNDS, RATE, RIDGE = 30, 0.5, 1.0
#: How much more often toxic documents must hold a form than clean ones to label its tokens.
RATIO = 10.0
#: Occurrences of a form in one document that count at most.
REPEATS = 4
THRESHOLD = 0.3
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_STARTS = range(3, 9)


def forms(word: str) -> list[str]:
    """What a word alone shows: itself and its beginnings."""
    bare = _EDGES.sub("", word).lower()
    if not bare:
        return ["mark"]
    return [f"={bare}"] + [f"^{bare[:k]}" for k in _STARTS if len(bare) > k]


def own_features(word: str) -> list[str]:
    return forms(word) + ["caps"] * (word.isupper() and len(word) > 1) + ["odd"] * (len(word) > 2 and not word[-2].isalnum())


def _stem(word: str) -> str:
    return _EDGES.sub("", word).lower()[:5]


def left_features(word: str) -> list[str]:
    """What a word tells of the one after it: its beginning, and that a sentence may begin there."""
    return [f"<{_stem(word)}"] + ["<."] * (word[-1] in ".!?")


def right_features(word: str) -> list[str]:
    return [f">{_stem(word)}"]


class Emissions(dict):
    """The row of every word; `own`, `left` and `right` hold the scores of label 1 over label 0 that the word
    gives its own token, the one after it and the one before it. Row 0 stands for no word."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.sums = np.zeros((1, 3))
        self.new: list[tuple[float, float, float]] = []

    def __missing__(self, word: str) -> int:
        get = self.weights.get
        row = self[word] = len(self.sums) + len(self.new)
        self.new.append(tuple(sum(get(f, 0.0) for f in kind(word)) for kind in (own_features, left_features, right_features)))
        return row

    def scores(self, words: list[list[str]], bias: float) -> tuple[np.ndarray, np.ndarray]:
        """The score of every token of all documents, and how many each has."""
        if len(self.sums) > 300_000:
            self._reset()
        sizes = np.array([len(w) for w in words], np.int64)
        row = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(sizes.sum()))
        if self.new:
            self.sums, self.new = np.concatenate([self.sums, self.new]), []
        before, after = neighbours(row, sizes)
        return bias + self.sums[row, 0] + self.sums[before, 1] + self.sums[after, 2], sizes


def neighbours(row: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the tokens before and after each in its document; 0 where there is none."""
    before, after = np.zeros_like(row), np.zeros_like(row)
    before[1:], after[:-1] = row[:-1], row[1:]
    ends = np.cumsum(sizes)
    full = sizes > 0
    before[(ends - sizes)[full]] = 0
    after[ends[full] - 1] = 0
    return before, after


@dataclass
class Field:
    """Feature weights, transitions as scores of 00, 01, 10, 11 (from, to), the document score's weights, and
    what a token of a clean document adds to the joint odds on average."""

    weights: dict[str, float]
    bias: float
    moves: np.ndarray
    scale: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0, 0.0, 0.0, 0.0]))
    background: float = 0.0

    def emissions(self) -> Emissions:
        return Emissions(self.weights)

    def tokens(self, words: list[list[str]], odds: Emissions) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of all tokens, and how many each document has."""
        flat, sizes = odds.scores(words, self.bias)
        return marginals(flat, sizes, self.moves), sizes

    def document(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The score of every document; 0 for one without tokens."""
        return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(evidence(p, sizes, self.background) @ self.scale, -50, 50))), 0.0)


def joint(p: np.ndarray) -> np.ndarray:
    """What each token adds to the log odds that some token is toxic."""
    return -np.log1p(-np.clip(p, 0, 1 - 1e-9))


def evidence(p: np.ndarray, sizes: np.ndarray, background: float) -> np.ndarray:
    """Of every document: 1, the log of its tokens' joint odds beyond those of a clean text of its length, the
    same in standard deviations, the largest marginal, and the log of its length."""
    ends = np.cumsum(sizes)
    total, most, full = np.zeros(len(sizes)), np.zeros(len(sizes)), sizes > 0
    if full.any():
        starts = (ends - sizes)[full]
        total[full] = np.add.reduceat(joint(p), starts)
        most[full] = np.maximum.reduceat(p, starts)
    usual = background * sizes
    beyond = np.maximum(total - usual, 0)
    return np.stack([np.ones(len(sizes)), np.log(beyond + 1e-2), np.log(beyond / np.sqrt(usual + 0.1) + 0.1), most, np.log1p(sizes)], axis=1)


def lanes(scores: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chains as rows of a matrix, and where in it each token is."""
    first = np.cumsum(sizes) - sizes
    chains = -(-sizes // CHAIN)
    begin = np.cumsum(chains) - chains
    within = np.arange(len(scores)) - np.repeat(first, sizes)
    at = (np.repeat(begin, sizes) + within // CHAIN) * CHAIN + within % CHAIN
    return at, np.full(int(chains.sum()) * CHAIN, np.nan)


def forward_backward(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of label 1 by what comes up to each place, and by what comes after it.

    `scores` has a row for each chain, NaN after its end.
    """
    m00, m01, m10, m11 = np.exp(moves)
    ahead, back = np.zeros_like(scores), np.zeros_like(scores)
    now = np.exp(np.clip(scores[:, 0], -30, 30))
    ahead[:, 0] = np.log(now)
    for t in range(1, scores.shape[1]):
        now = np.exp(np.clip(scores[:, t], -30, 30)) * (now * m11 + m01) / (now * m10 + m00)
        ahead[:, t] = np.log(now)
    then = np.ones(len(scores))
    for t in range(scores.shape[1] - 2, -1, -1):
        own = np.exp(np.clip(scores[:, t + 1], -30, 30)) * then
        then = np.where(np.isnan(own), 1.0, (own * m11 + m10) / (own * m01 + m00))
        back[:, t] = np.log(then)
    return ahead, back


def marginals(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of label 1 of every token; `sizes` tokens for each document."""
    if not len(scores):
        return np.zeros(0)
    at, grid = lanes(scores, sizes)
    grid[at] = scores
    grid = grid.reshape(-1, CHAIN)
    by_size = np.argsort(np.isnan(grid).sum(axis=1), kind="stable")
    out = np.zeros_like(grid)
    for a in range(0, len(grid), 512):
        rows = by_size[a : a + 512]
        width = int((~np.isnan(grid[rows])).sum(axis=1).max())
        ahead, back = forward_backward(grid[rows, :width], moves)
        out[rows, :width] = 1 / (1 + np.exp(-(ahead + back)))
    return out.reshape(-1)[at]


def token_labels(texts: list[list[str]], toxic: list[int]) -> dict[str, float]:
    """Forms that mark toxic documents, with the part of their occurrences there that clean ones do not explain."""
    shapes: dict[str, list[str]] = {}
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for own, label in zip(texts, toxic, strict=True):
        held: Counter = Counter()
        for w in own:
            held.update(shapes.get(w) or shapes.setdefault(w, forms(w)))
        for f, n in held.items():
            seen[label][f] += min(n, REPEATS)
    n0, n1 = max(1, toxic.count(0)), toxic.count(1)
    bound = 2 * np.log(len(seen[0].keys() | seen[1].keys()) + 1) + 2
    out = {}
    for f, k1 in seen[1].items():
        k0 = seen[0][f]
        if k1 / n1 > RATIO * k0 / n0:
            share = (k0 + k1) / (n0 + n1)
            if 2 * sum(k * np.log(k / (n * share)) for k, n in ((k0, n0), (k1, n1)) if k) > bound:
                out[f] = 1 - (k0 / n0) / (k1 / n1)
    return out


class Learner:
    """Documents as arrays, for fitting fields to soft token labels."""

    def __init__(self, words: list[list[str]]):
        self.vocab: dict[str, int] = {}
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.token = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for own in words for w in own], np.int64)
        self.before, self.after = neighbours(self.token, self.sizes)
        often = np.minimum(np.bincount(self.token, minlength=len(self.vocab) + 1), 2)
        self.feats: dict[str, int] = {"": 0}  # what rare features share: no weight
        self.kinds = [self._kind(kind, often, least) for kind, least in ((own_features, 2), (left_features, 5), (right_features, 5))]
        self.at, self.blank = lanes(self.token, self.sizes)

    def _kind(self, kind, often: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lists = [kind(w) for w in self.vocab]
        total: Counter = Counter()
        for own, n in zip(lists, often[1:].tolist(), strict=True):
            for f in own:
                total[f] += n
        rows = [[0]] + [[self.feats.setdefault(f, len(self.feats)) if total[f] >= least else 0 for f in own] for own in lists]
        width = np.array([len(r) for r in rows])
        return np.array([f for r in rows for f in r]), np.cumsum(width) - width, width

    def fit(self, told: np.ndarray) -> Field:
        """A field by adaptive gradient ascent on the likelihood of token labels between 0 and 1."""
        gold = self.blank.copy()
        gold[self.at] = told
        gold = gold.reshape(-1, CHAIN)
        live = ~np.isnan(gold)
        pair = live[:, 1:] & live[:, :-1]
        g = np.nan_to_num(gold)
        wanted = np.array([k[pair].sum() for k in ((1 - g[:, :-1]) * (1 - g[:, 1:]), (1 - g[:, :-1]) * g[:, 1:], g[:, :-1] * (1 - g[:, 1:]), g[:, :-1] * g[:, 1:])])
        weights, moves, bias = np.zeros(len(self.feats)), np.zeros(4), -3.0
        grown = [np.full(len(self.feats), 1e-8), np.full(4, 1e-8), 1e-8]
        places = (self.token, self.before, self.after)
        for _ in range(ROUNDS):
            score = np.full(len(self.token), bias)
            for (flat, first, _), place in zip(self.kinds, places, strict=True):
                score += np.add.reduceat(weights[flat], first)[place]
            grid = self.blank.copy()
            grid[self.at] = score
            grid = grid.reshape(-1, CHAIN)
            ahead, back = forward_backward(grid, moves)
            p = 1 / (1 + np.exp(-(ahead + back)))
            miss = (gold - p).reshape(-1)[self.at]
            step = -RIDGE * weights
            for (flat, _, width), place in zip(self.kinds, places, strict=True):
                step += np.bincount(flat, np.repeat(np.bincount(place, miss, len(self.vocab) + 1), width), len(self.feats))
            step[0] = 0.0  # rare features stay without a weight, as unknown ones do
            # Joint probabilities of neighbours, from the odds before the pair and after it.
            a, b = ahead[:, :-1], grid[:, 1:] + back[:, 1:]
            pairs = np.stack([np.full_like(a, moves[0]), moves[1] + b, moves[2] + a, moves[3] + a + b])
            pairs = np.exp(pairs - np.nanmax(pairs, axis=0))
            pairs /= pairs.sum(axis=0)
            pull = (wanted - np.array([j[pair].sum() for j in pairs])) / max(1, pair.sum())
            lift = float(miss.mean())
            for k, s in enumerate((step, pull, lift)):
                grown[k] = grown[k] + s * s
            weights = weights + RATE * step / np.sqrt(grown[0])
            moves = moves + RATE * pull / np.sqrt(grown[1])
            bias += RATE * lift / np.sqrt(grown[2])
        kept = {f: float(weights[k]) for f, k in self.feats.items() if f and abs(weights[k]) > 1e-3}
        return Field(kept, float(bias), moves)


def fit_tokens(words: list[list[str]], toxic: list[int]) -> Field:
    """A field fitted to token labels from telling forms, and again to those that its marginals refine."""
    marks = token_labels(words, toxic)
    learner = Learner(words)
    by_word = np.array([0.0] + [max((marks.get(f, 0.0) for f in forms(w)), default=0.0) for w in learner.vocab])
    bad = np.repeat(np.array(toxic, bool), learner.sizes)
    told = by_word[learner.token] * bad
    first = learner.fit(told)
    p, _ = first.tokens(words, first.emissions())
    return learner.fit(np.where(bad, (told + p) / 2, 0.0))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 25, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def fit(texts: list[str], toxic: list[int], rate: float | None = None) -> Field:
    """A field of labelled documents, with the weights of the document score. `rate` is the toxic part of all
    labelled documents, where that of these is another."""
    words = [t.split() for t in texts]
    if toxic.count(1) < 4 or toxic.count(0) < 4:
        return Field({}, -30.0, np.zeros(4))
    x = np.zeros((len(words), 5))
    order = np.argsort([zlib.crc32(t.encode("utf-8", "replace")) for t in texts], kind="stable")
    order = order[np.argsort(np.array(toxic)[order], kind="stable")]
    levels = []
    for half in range(2):
        own, other = order[half::2], order[1 - half :: 2]
        part = fit_tokens([words[k] for k in other], [toxic[k] for k in other])
        p, sizes = part.tokens([words[k] for k in own], part.emissions())
        clean = np.repeat(np.array(toxic)[own] == 0, sizes)
        levels.append(float(joint(p[clean]).mean()) if clean.any() else 0.0)
        x[own] = evidence(p, sizes, levels[-1])
    whole = fit_tokens(words, toxic)
    whole.background = sum(levels) / 2
    whole.scale = logistic(x, np.array(toxic, float))
    if rate is not None and 0 < rate < 1:
        whole.scale[0] += np.log(rate / (1 - rate)) - np.log(toxic.count(1) / toxic.count(0))
    return whole


def without_copies(texts: list[str], toxic: list[int]) -> tuple[list[str], list[int]]:
    """The documents but near copies of those before, whose words would seem to tell a class apart.

    A near copy shares two of the eight least hashes of its five-word windows with others."""
    seen: set[int] = set()
    kept = []
    for k, text in enumerate(texts):
        words = text.split()
        least = sorted({zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))})[:8]
        if sum(h in seen for h in least) < min(2, len(least)):
            kept.append(k)
        seen.update(least)
    return [texts[k] for k in kept], [toxic[k] for k in kept]


def sample(docs: DataFrame, labels: DataFrame, learnable) -> tuple[list[str], list[int], float | None]:
    """Texts and labels of at most SAMPLE documents of each class among the `learnable` label rows, and the
    toxic part of all those rows' documents."""
    own = labels.where(learnable).where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = own.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    parts = [own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    short = docs.where(f"char_length(text) <= {SAMPLE_CHARS}").select("doc_id", "text")
    rows = short.join(F.broadcast(parts[0].union(parts[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return *without_copies([r.text for r in rows], [int(r.toxic) for r in rows]), rate


def score(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, score and the toxic spans (code points, end exclusive, probability) of every row."""
    schema = "doc_id long, score double, spans array<struct<start:long,stop:long,probability:double>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = field.emissions()
        for batch in small_batches(batches):
            texts = texts_of(batch)
            p, sizes = field.tokens([t.split() for t in texts], odds)
            found = field.document(p, sizes)
            spans = [spans_of(t, p[b - n : b]) if own >= THRESHOLD else [] for t, b, n, own in zip(texts, np.cumsum(sizes), sizes, found, strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array(spans, kind)], ["doc_id", "score", "spans"])

    lean(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), schema)


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Stretches of tokens whose marginals reach the threshold, with the largest of them."""
    out: list[dict] = []
    last = -2
    for k, word in enumerate(re.finditer(r"\S+", text)) if len(text.split()) == len(p) else ():
        if k < len(p) and p[k] >= THRESHOLD:
            if last == k - 1:
                out[-1]["stop"], out[-1]["probability"] = word.end(), max(out[-1]["probability"], float(p[k]))
            else:
                out.append({"start": word.start(), "stop": word.end(), "probability": float(p[k])})
            last = k
    return out
