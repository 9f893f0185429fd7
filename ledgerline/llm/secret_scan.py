"""Secret scans: patterns of known shapes, and strings that look random by character Markov models.

Two first-order Markov models over characters are trained from labelled samples (strings labelled random
or ordinary), one of each label. The registered query's samples are random strings of the alphabets of keys
and identifiers composed of the corpus's words; `fit_labelled` takes any table of such rows. A run of token characters is a secret where the mean
log-likelihood ratio of its transitions exceeds a threshold. A run that as a whole does not is searched
for stretches that do, as a key may stand behind a long path or name: its parts between separators, and
windows of RUN characters by a stricter threshold, for keys that hold separators themselves. Letters alone
need the stricter threshold too, and digits alone are numbers; runs shorter than RUN are never scored, since
below it the mean ratio does not tell keys from names. Spans that a pattern's match already covers add nothing.

Defined cases: a null or empty text has no spans; matches of a kind do not overlap, the leftmost
counts; spans are in code points, sorted by start and then kind; repeated rows are scanned alike; an
empty table gives no rows; columns besides doc_id and text stay untouched.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches, texts_of, trimmed

# The patterns, by kind in the order of the kinds, and what makes a match count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Characters of a candidate run, and the least of them.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = 16
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{RUN},}}")
#: Mean log-likelihood ratio for each transition from which a run is a secret.
THRESHOLD = 0.5
#: The same for a window within a run, of which there are many; and what separates the parts of a run.
WINDOW_THRESHOLD = 1.0
#: The same for a stretch of letters alone.
LETTERS_THRESHOLD = 1.0
_PART = re.compile(r"[^/_=-]+")
#: Rows whose words may train the model of ordinary identifiers, and the distinct words taken.
SAMPLE_ROWS, SAMPLE_WORDS = 2000, 20_000

_CLASS = np.full(256, len(ALPHABET), np.uint8)
_CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_IN_RUN = _CLASS < len(ALPHABET)


def _needs(run: str, threshold: float) -> float:
    """The mean ratio that makes a stretch a secret: more where it has letters alone, as words have; digits
    alone are numbers whatever they score."""
    if not any(c.isalpha() for c in run):
        return np.inf
    return threshold if any(c.isdigit() for c in run) else max(threshold, LETTERS_THRESHOLD)


@dataclass
class Model:
    """Log-likelihood ratio of every transition between alphabet characters, random over ordinary."""

    ratio: np.ndarray
    threshold: float = THRESHOLD

    def score(self, run: str) -> float:
        kinds = _CLASS[np.frombuffer(run.encode(), np.uint8)]
        return float(self.ratio[kinds[:-1], kinds[1:]].mean()) if len(kinds) > 1 else 0.0

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of what is secret in a run: all of it, or else its parts and windows."""
        kinds = _CLASS[np.frombuffer(run.encode(), np.uint8)]
        ratio = self.ratio[kinds[:-1], kinds[1:]]
        if ratio.mean() > _needs(run, self.threshold):
            return [(0, len(run))]
        sums = np.concatenate([[0.0], np.cumsum(ratio)])
        parts = [m.span() for m in _PART.finditer(run)]
        found = [(a, b) for a, b in parts if b - a >= RUN and sums[b - 1] - sums[a] > _needs(run[a:b], self.threshold) * (b - 1 - a)]
        at = np.flatnonzero(sums[RUN - 1 :] - sums[: 1 - RUN] > max(self.threshold, WINDOW_THRESHOLD) * (RUN - 1))
        for own in np.split(at, np.flatnonzero(np.diff(at) > RUN) + 1) if len(at) else []:
            # of windows that meet, the stretch of most excess, and all of the parts that it reaches into but plain words at its ends
            a, b = int(own[0]), int(own[-1]) + RUN
            rise = sums[a:b] - self.threshold * np.arange(a, b)
            gain = rise - np.minimum.accumulate(rise)
            stop = int(gain.argmax())
            a, b = a + int(rise[: stop + 1].argmin()), a + stop + 1
            reached = [x for x in parts if x[0] < b and a < x[1]]
            plain = [y - x >= 6 and sums[y - 1] < sums[x] for x, y in reached]
            if not all(plain):
                found.append((reached[plain.index(False)][0], reached[len(plain) - 1 - plain[::-1].index(False)][1]))
        merged: list[tuple[int, int]] = []
        for a, b in sorted(x for x in found if sums[x[1] - 1] - sums[x[0]] > _needs(run[x[0] : x[1]], 0.0) * (x[1] - 1 - x[0])):
            if merged and a < merged[-1][1]:
                merged[-1] = merged[-1][0], max(b, merged[-1][1])
            else:
                merged.append((a, b))
        return merged


def transitions(samples: list[str]) -> np.ndarray:
    """Smoothed transition probabilities of the samples' characters."""
    n = len(ALPHABET)
    counts = np.ones((n + 1, n + 1))
    joined = _CLASS[np.frombuffer("\n".join(samples).encode(), np.uint8)]
    np.add.at(counts, (joined[:-1], joined[1:]), 1)
    counts = counts[:n, :n]
    return counts / counts.sum(axis=1, keepdims=True)


def train(samples: list[tuple[str, int]], threshold: float = THRESHOLD) -> Model:
    """The models of labelled samples: 1 a random string, 0 an ordinary one."""
    kinds = [[text for text, label in samples if label == k] for k in (1, 0)]
    return Model(np.log(transitions(kinds[0]) / transitions(kinds[1])), threshold)


def labelled(words: list[str]) -> list[tuple[str, int]]:
    """Labelled samples: strings of the alphabets that keys are written in, and identifiers made of words."""
    return [(x, 1) for x in random_samples()] + [(x, 0) for x in identifier_samples(words)]


def fit_labelled(samples: DataFrame, most: int = 100_000) -> Model:
    """The models of at most `most` rows (text, label) of a labelled table, in the order of a hash."""
    rows = samples.where("text is not null and label is not null").orderBy(F.xxhash64("text"), "text").limit(most)
    return train([(r.text, int(r.label)) for r in rows.select("text", "label").collect()])


def random_samples(n: int = 4000, seed: int = 7) -> list[str]:
    """Strings of the alphabets that keys are written in: hexadecimal, base 32, base 62, base 64."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "-_")
    return ["".join(rng.choices(alphabets[k % len(alphabets)], k=40)) for k in range(n)]


def identifier_samples(words: list[str], n: int = 20_000, seed: int = 11) -> list[str]:
    """Identifiers as people write them, of the given words: joined by case, underscore, hyphen, slash, with numbers."""
    rng = random.Random(seed)
    words = sorted({w for w in words if w.isascii() and w.isalpha()}) or ["get", "value", "index", "name", "list", "count"]
    out = []
    for k in range(n):
        own = [w.lower() for w in rng.choices(words, k=rng.randint(2, 5))]
        style = k % 6
        out.append(
            {
                0: "_".join(own),
                1: "-".join(own),
                2: own[0] + "".join(w.capitalize() for w in own[1:]),
                3: "/".join(own),
                4: "_".join(own).upper(),
                5: "-".join(own) + f"-{rng.randint(1, 2999)}",
            }[style]
        )
    out += ["-" * 40, "=" * 40, "_" * 40, "/" * 20] * (n // 200)
    out += ["".join(str((a + b) % 10) for b in range(20)) for a in range(10)] * (n // 1000)
    return out + words


def fit(docs: DataFrame) -> Model:
    """The production model: generated random strings, and words of at most SAMPLE_ROWS documents."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    words = rows.select(F.explode(F.split("text", r"\s+")).alias("word")).where("word rlike '^[A-Za-z]+$'").distinct()
    words = [r.word for r in words.orderBy(F.xxhash64("word"), "word").limit(SAMPLE_WORDS).collect()]
    return train(labelled(words))


def suspicious(blob: bytes) -> bool:
    """Whether a text can hold a span: it has a keyword, a key's prefix, or a run of token characters."""
    low = blob.lower()
    if b"AKIA" in blob or any(k in low for k in KEYWORDS):
        return True
    gaps = np.flatnonzero(~_IN_RUN[np.frombuffer(blob, np.uint8)])
    longest = int(np.diff(gaps, prepend=-1, append=len(blob)).max()) - 1
    return longest >= RUN


def spans(text: str, model: Model) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every span, in code points, by start and then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    starts = sorted(a for a, _, _ in found)
    reach = list(accumulate((b for _, _, b in sorted(found)), max))  # how far the spans up to each start go
    for m in _RUN.finditer(text):
        for a, b in model.stretches(m[0]):
            x, y = m.start() + a, m.start() + b
            k = bisect_right(starts, x)
            if not k or reach[k - 1] < y:
                found.append((x, 3, y))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def _written(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in found)


SPANS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id with the counts and spans of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = hashlib.sha256(b"").hexdigest()
        for batch in small_batches(batches):
            cols: list[list] = [[], [], [], [], []]
            for text in texts_of(batch):
                if not text or not suspicious(text.encode()):
                    row = (0, 0, 0, empty, "")
                else:
                    found = spans(text, model)
                    base = _written([x for x in found if x[1] != "random"])
                    row = (*(sum(x[1] == k for x in found) for k in KINDS[:3]), hashlib.sha256(base.encode()).hexdigest(), _written(found))
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            names = [x.split()[0] for x in SPANS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), f"doc_id long, {SPANS}")


def masked(text: str, found: list[tuple[int, str, int]], mark: str) -> str:
    """The text with every maximal stretch of spans replaced by the mark."""
    out, at = [], 0
    for a, _, b in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame, model: Model, mark: str = "[secret]") -> DataFrame:
    """All columns of `docs` as they are, but secrets in `text` replaced by the mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            for k, text in enumerate(texts):
                if text and suspicious(text.encode()):
                    texts[k] = masked(text, spans(text, model), mark)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    lean(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), docs.schema)
