"""Token ids of whole texts by public tokenizer files, with work shared between repeated pieces.

A text is cut where the pre-splitting pattern of the tokenizer must start a new match whatever
surrounds the cut; ids of the parts then join to the ids of the text. The pattern's matches repeat, so
a bounded table keeps the ids of those seen; only new ones reach the library. Parts with characters
that the pattern's short form does not know go through the whole tokenizer.
"""

from __future__ import annotations

import base64
import re
from itertools import groupby

import numpy as np

#: Characters that are neither white space nor able to change a neighbouring match across a cut.
_PLAIN = "!-~¡-ɏ"
#: Before a space that a visible character follows, or after a lone line end between two of them.
SAFE_CUT = re.compile(rf"(?= [{_PLAIN}])|(?<=[{_PLAIN}]\n)(?=[{_PLAIN}])")
#: A text longer than this many characters is encoded in segments.
SEGMENT = 1 << 16


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """The text in parts of about `size` characters, cut at safe boundaries; one part if it has none."""
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        cut = SAFE_CUT.search(text, at + size)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


#: Letters of the fast way; a part of a text with any other character than these and visible ASCII goes the whole way.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_USUAL = bytes(b for b in range(256) if re.match(rf"[\n -~{_LETTER}]", chr(b)))
# The pre-splitting patterns of the two kinds of files, for the characters above.
_SPACED = re.compile(rf" ?[{_LETTER}]++|'(?:[stmd]|re|ve|ll)| ?[0-9]++| ?[^\s{_LETTER}0-9]++|\s+(?!\S)|\s+")
_BARE = re.compile(rf"[{_LETTER}]++|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s{_LETTER}0-9]++")


def is_odd(text: str) -> bool:
    """Whether a text has characters that only the whole tokenizer knows."""
    try:
        return bool(text.encode("latin-1").translate(None, _USUAL))
    except UnicodeEncodeError:
        return True


def _written() -> dict[int, str]:
    """For every character up to U+00FF: the letters by which byte-level files write its bytes.

    A byte is itself where it is visible in Latin-1; the others follow from U+0100 on, in order.
    """
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(seen)))}
    return {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}


class _Rows(dict):
    """The row of each match; a new one gets the next row."""

    def __init__(self, known: list[str] = []):  # noqa: B006
        super().__init__(zip(known, range(len(known)), strict=True))
        self.new: list[str] = []

    def __missing__(self, match: str) -> int:
        row = self[match] = len(self)
        self.new.append(match)
        return row


class PieceTable:
    """Ids of texts by a tokenizers file. `spaced`: white space is part of matches (byte-level files).

    The matches of the pre-splitting pattern that texts consist of are looked up in a table of at most
    `limit` rows, which when full keeps the more frequent half. New ones go to the file's merges.
    """

    def __init__(self, path: str, spaced: bool, limit: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.spaced, self.limit = spaced, limit
        self._matches = (_SPACED if spaced else _BARE).findall
        self._letters = _written()
        self.rows = _Rows()
        self.flat = np.zeros(0, np.uint32)
        self.starts = self.sizes = self.hits = np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Ids of the matches met for the first time, straight from the file's merges."""
        new, self.rows.new = self.rows.new, []
        letters = self._letters | {0: "\0"}  # no match holds a zero byte
        ids: list[int] = []
        sizes: list[int] = []
        for word in "\0".join(new).translate(letters).split("\0"):
            got = self.tokenizer.model.tokenize(word)
            ids += [t.id for t in got]
            sizes.append(len(got))
        self.sizes = np.concatenate([self.sizes, np.array(sizes, np.int64)])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        self.flat = np.concatenate([self.flat, np.array(ids, np.uint32)])

    def _shrink(self) -> None:
        keep = np.sort(np.argpartition(-self.hits, self.limit // 2)[: self.limit // 2])
        self.rows = _Rows(np.array(list(self.rows), object)[keep].tolist())
        starts, self.sizes, self.hits = self.starts[keep], self.sizes[keep], self.hits[keep] >> 1
        ends = np.cumsum(self.sizes)
        self.flat = self.flat[np.repeat(starts - (ends - self.sizes), self.sizes) + np.arange(ends[-1] if len(ends) else 0)]
        self.starts = ends - self.sizes

    def _plain_ids(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts without odd characters, and how many each has."""
        words: list[str] = []
        counts = np.zeros(len(parts) + 1, np.int64)
        for k, part in enumerate(parts, 1):
            words += self._matches(part if self.spaced else part.lower())
            counts[k] = len(words)
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        if self.rows.new:
            self._learn()
        self.hits += np.bincount(at, minlength=len(self.hits))
        starts, sizes = self.starts[at], self.sizes[at]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]
        if len(self.rows) > self.limit:
            self._shrink()
        return ids, np.diff(np.concatenate([[0], ends])[counts])

    def _odd_ids(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of any parts by the whole tokenizer."""
        out: list[np.ndarray] = []
        for a in range(0, len(parts), 4096):
            out += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(parts[a : a + 4096], add_special_tokens=False)]
        return out

    def _segment_ids(self, segs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not any(map(is_odd, segs)):
            return self._plain_ids(segs)
        parts: list[str] = []  # of each segment, plain and odd stretches between safe cuts
        odd: list[bool] = []
        owner: list[int] = []
        for k, s in enumerate(segs):
            if not is_odd(s):
                parts, odd, owner = [*parts, s], [*odd, False], [*owner, k]
                continue
            for whole, run in groupby(SAFE_CUT.split(s), is_odd):
                own = list(run) if whole else ["".join(run)]
                parts += own
                odd += [whole] * len(own)
                owner += [k] * len(own)
        plain, sizes = self._plain_ids([p for p, o in zip(parts, odd, strict=True) if not o])
        ends = iter(np.split(plain, np.cumsum(sizes)[:-1]) if len(sizes) else [])
        hard = iter(self._odd_ids([p for p, o in zip(parts, odd, strict=True) if o]))
        found = [next(hard) if o else next(ends) for o in odd]
        counts = np.bincount(owner, [len(x) for x in found], len(segs)).astype(np.int64) if owner else np.zeros(len(segs), np.int64)
        return (np.concatenate(found) if found else np.zeros(0, np.uint32)), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another (uint32), and how many each text has."""
        segs, owner = [], []
        for k, text in enumerate(texts):
            for s in segments(text):
                segs.append(s)
                owner.append(k)
        out, sizes, at = [], [], 0
        while at < len(segs):  # a few segments at a time bound the list of matches
            stop, room = at, 1 << 20
            while stop < len(segs) and (stop == at or room >= len(segs[stop])):
                room -= len(segs[stop])
                stop += 1
            ids, n = self._segment_ids(segs[at:stop])
            out.append(ids)
            sizes.append(n)
            at = stop
        lengths = np.zeros(len(texts), np.int64)
        if sizes:
            np.add.at(lengths, np.asarray(owner), np.concatenate(sizes))
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), lengths


_TABLES: dict[tuple[str, bool], PieceTable] = {}


def piece_table(path: str, spaced: bool, limit: int = 250_000) -> PieceTable:
    """One table for each file in a Python worker."""
    key = (path, spaced)
    if key not in _TABLES:
        _TABLES[key] = PieceTable(path, spaced, limit)
    return _TABLES[key]


_RANKED: dict[str, object] = {}


def rank_encoding(path: str, pattern: str):
    """A tiktoken encoding from a local rank file, without special tokens."""
    import tiktoken

    if path not in _RANKED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _RANKED[path] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _RANKED[path]


#: White space (as the rank files' pattern knows it) of a length that the pattern engine should not meet.
_BLANK = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


def rank_ids(encoding, text: str) -> np.ndarray:
    """Ids of a whole text; a long one goes to the library in segments, and a long run of white space as one
    piece: the pattern takes it but for its last character, with which the next match may begin."""
    parts: list[list[int]] = []
    at = 0
    for run in _BLANK.finditer(text):
        stop = run.end() - (run.end() < len(text))
        parts += [encoding.encode_ordinary(s) for s in segments(text[at : run.start()])]
        parts.append(encoding._encode_single_piece(text[run.start() : stop].encode()))
        at = stop
    parts += [encoding.encode_ordinary(s) for s in segments(text[at:])]
    arrays = [np.asarray(p, dtype="<u4") for p in parts]
    return arrays[0] if len(arrays) == 1 else np.concatenate(arrays)
