"""Toxicity with noisy-channel deobfuscation.

Words that look disguised (leetspeak, letters set apart one by one or in pairs,
dotted, doubled or stretched letters, look-alikes of other alphabets), of any
length, are read as a lattice of what each character may stand for, decoded
by Viterbi under a trigram character model whose counts come from all
documents, and the restored words are scored beside the written ones.  In
letters set apart, the strongest words that don't overlap count, once each.

A word's evidence is the lower confidence bound of its log odds between toxic
and clean training documents, taken over the word and its first 4, 5 and 6
bytes, so inflected forms count.  A document's strongest words and their number
go into a small logistic model, which is fitted on evidence from the other
half of the training rows and so is calibrated.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import IS_SPACE, LOWER, Hasher, crc_mod, drawn, materialize, read, spans_where, steps, text_of, word_spans

#: Labelled rows to learn from at most, the least by a hash of the id.
TRAIN_ROWS = 40_000
PREFIXES = (4, 5, 6)
#: Standard errors that are taken off a log odds, and the evidence from which a word counts.
CAUTION = 2.5
LEAST = 0.5
THRESHOLD = 0.7
#: What a character may stand for besides itself (fixed values).
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "%": "o",
}
#: Characters inside a word that may stand for nothing.
BETWEEN = ".-_*~'`^,:;/\\"
OUTSIDE = ".,;:?!\"'()[]{}<>«»%&#*|"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Classes of the character model: 0 between words, 1-26 letters, 27 all other bytes of words.
CLASSES = 28
CLASS = np.zeros(256, np.int32)
CLASS[97:123] = np.arange(1, 27)
CLASS[128:] = 27
CACHED = 20_000
#: Lengths of the words that are looked for at every place of a spaced run.
PIECES = range(4, 11)
#: Runs of one character of over three, which the lattice reads like three.
STRETCHED = re.compile(r"(.)\1{3,}", re.S)
#: Words without letters that are numbers, not disguised words.
NUMBER = re.compile(r"[-+#$(<]*[0-9][0-9.,:;/+*()-]*[%$]*")

#: Words of which every letter is written twice.
DOUBLED = re.compile(r"(?:([a-z])\1){3,}")
#: Letters of other alphabets that look like a Latin one (fixed values).
LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "α": "a", "ο": "o", "ν": "v", "ι": "i", "ρ": "p", "τ": "t", "υ": "u", "κ": "k",
}
LOOK_TABLE = str.maketrans(LOOKS | {c.upper(): x for c, x in LOOKS.items()})
#: First bytes of these letters.
LOOK_LEAD = np.zeros(256, bool)
LOOK_LEAD[[0xCE, 0xCF, 0xD0, 0xD1, 0xD2, 0xD4]] = True
#: UTF-8 of characters without width, which are taken out, and of spaces, which are read as one (fixed values).
NO_WIDTH = [c.encode() for c in "\u00ad\u200b\u200c\u200d\u2060\ufeff"]
SPACES = [c.encode() for c in "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u3000"]
UNSEEN_LEAD = np.zeros(256, bool)
UNSEEN_LEAD[[c[0] for c in NO_WIDTH + SPACES]] = True

IS_CORE = np.zeros(256, bool)
IS_CORE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(97, 123), *range(128, 256)]] = True
IS_ODD = ~IS_LETTER & ~IS_SPACE
IS_MARK = np.zeros(256, bool)
IS_MARK[[ord(c) for c in LEET if not c.isdigit()]] = True


def trigrams(docs: DataFrame) -> np.ndarray:
    """Counts of character classes in threes over all documents, runs between words as one boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for _, _, data, _ in steps(batch.column(0)):
                c = CLASS[LOWER[data]]
                c = np.concatenate([[0, 0], c[(c > 0) | np.concatenate([[True], c[:-1] > 0])], [0]])
                total += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(CLASSES**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts.reshape(CLASSES, CLASSES, CLASSES)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), trigrams backed by bigrams backed by single characters."""
    one = counts.sum(axis=(0, 1)) + 1
    one = one / one.sum()
    two = counts.sum(axis=0) + 5 * one
    two = two / two.sum(axis=1, keepdims=True)
    three = counts + 5 * two[None]
    return np.log(three / three.sum(axis=2, keepdims=True))


def is_letter(c: str) -> bool:
    """a-z, and the letters and combining accents of other alphabets."""
    return c in LETTERS or (c > "\x7f" and (c.isalpha() or unicodedata.combining(c) > 0))


def shortened(word: str) -> str:
    """The word with every run of one character at most three long, which doesn't change its lattice."""
    return STRETCHED.sub(r"\1\1\1", word)


def cleaned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A step's bytes in lower case without characters of no width and with spaces of every kind as plain ones, and the offsets in them."""
    data = LOWER[data]
    lead = np.flatnonzero(UNSEEN_LEAD[data])
    if not len(lead):
        return data, offsets
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    code = padded[lead].astype(np.int64) << 16 | padded[lead + 1].astype(np.int64) << 8
    wide = data[lead] >= 0xE0
    code[wide] |= padded[lead[wide] + 2]
    keep = np.ones(len(data), bool)
    for chars, gone in ((NO_WIDTH, True), (SPACES, False)):
        known = [int.from_bytes(c.ljust(3, b"\0"), "big") for c in chars]
        at = np.isin(code, known)
        for k in range(3):
            keep[lead[at & (wide | (k < 2))] + k] = False
        if not gone:
            data[lead[at]] = 0x20
            keep[lead[at]] = True
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


class Decoder:
    """Reads disguised words back by Viterbi over a lattice of what their characters stand for."""

    def __init__(self, model: np.ndarray):
        self.model, self.seen, self.known = model, {}, {}

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each run of one character, the readings (letters, log probability in the channel)."""
        runs: list[list] = []
        for c in word:
            if runs and runs[-1][0] == c:
                runs[-1][1] += 1
            else:
                runs.append([c, 1])
        out = []
        for c, n in runs:
            if is_letter(c):
                out.append([(c, -0.1)] if n == 1 else [(c * 2, -0.3), (c, -3.5)] if n == 2 else [(c, -0.7), (c * 2, -1.5)])
                continue
            options = [(x * k, -1.2 - 0.8 * (n > 1 and k != min(n, 2)) - 0.3 * len(LEET[c])) for x in LEET.get(c, "") for k in ((1,) if n == 1 else (1, 2))]
            if c in BETWEEN:
                options.append(("", -0.7))
            out.append(options or [("?", -6.0)])
        return out

    def __call__(self, word: str) -> str:
        if (known := self.seen.get(word)) is not None:
            return known
        # A path is a chain of its readings, the last first, so that a long word costs no more a character than a short one.
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for options in self.lattice(word):
            options = [(letters, self.classes(letters), p) for letters, p in options]
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for letters, classes, p in options:
                    i, j, s = a, b, score + p
                    for c in classes:
                        s += self.model[i, j, c]
                        i, j = j, c
                    if (i, j) not in after or s > after[i, j][0]:
                        after[i, j] = (s, (path, letters))
            best = after
        ends = [(s + self.model[a, b, 0], path) for (a, b), (s, path) in best.items()]
        top = max(s for s, _ in ends)
        found = max(self.text(path) for s, path in ends if s == top)
        if len(self.seen) < CACHED and len(word) < 100:
            self.seen[word] = found
        return found

    def classes(self, letters: str) -> list[int]:
        if letters not in self.known:
            self.known[letters] = CLASS[np.frombuffer(letters.encode(), np.uint8)].tolist()
        return self.known[letters]

    @staticmethod
    def text(path: tuple | None) -> str:
        out = []
        while path is not None:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))


def disguised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[list[tuple[int, str]], list[tuple[int, str, int]]]:
    """(index of the word, characters) of the words, and (row, characters, number of words) of the runs of single letters and pairs, of a step that may be disguised; data in lower case.

    Any white space may stand between a run's letters.  Neither has a greatest length; runs of one character are shortened to three.
    A word that ends in "$$$" is taken with it, as letters, and without it.
    """
    if not len(starts):
        return [], []
    letter, odd = IS_LETTER[data], IS_ODD[data]
    n = len(data)
    stretched = np.zeros(n, bool)
    stretched[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & (data[2:] < 128)
    for width in (2, 3, 4) if n and data.max() >= 128 else ():  # the same for letters of several bytes
        same = np.zeros(n, np.int64)
        same[width:] = (data[width:] == data[:-width]) & (data[width:] >= 128)
        run = np.concatenate([[0], np.cumsum(same)])
        stretched[2 * width - 1 :] |= run[2 * width :] - run[: -2 * width] == 2 * width
    # an odd character that a letter follows, or before which one stands
    inner = np.zeros(n, bool)
    inner[:-1] |= odd[:-1] & letter[1:]
    inner[1:] |= odd[1:] & letter[:-1]
    sums = np.concatenate([[0], np.cumsum(stretched | inner | IS_MARK[data])])
    flagged = (sums[ends] > sums[starts]) & (ends - starts >= 3)
    twice = np.zeros(n, np.int64)
    twice[1:] = letter[1:] & (data[1:] == data[:-1]) & (data[1:] < 128)
    twice = np.concatenate([[0], np.cumsum(twice)])
    flagged |= (2 * (twice[ends] - twice[np.minimum(starts + 1, n)]) >= ends - starts - 2) & (ends - starts >= 6)
    if n and data.max() >= 128:  # letters of two alphabets
        looks = np.concatenate([[0], np.cumsum(LOOK_LEAD[data])])
        latin = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        flagged |= (looks[ends] > looks[starts]) & (latin[ends] > latin[starts]) & (ends - starts >= 3)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = []
    for i in np.flatnonzero(flagged).tolist():
        word = bytes(data[starts[i] : ends[i]]).decode("utf-8", "ignore").strip(OUTSIDE)
        like = latin_letters(word)
        if like != word and like.isalpha() or DOUBLED.fullmatch(like):
            out.append((i, like[::2] if DOUBLED.fullmatch(like) else like))
        word = shortened(like)
        for w in (word, word.rstrip("$")) if word.endswith("$$$") else (word,):
            if len(w) >= 3 and may_hide(w):
                out.append((i, w))
    spaced = []
    pair = (ends - starts == 2) & (data[starts] >= 97) & (data[starts] <= 122) & (data[ends - 1] >= 97) & (data[ends - 1] <= 122)
    single = np.flatnonzero(pair | single_letters(data, starts, ends))
    if len(single):
        new = np.concatenate([[True], (np.diff(single) != 1) | (row[single[1:]] != row[single[:-1]])])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(single)))
        for i, k in zip(begin[size >= 3].tolist(), size[size >= 3].tolist()):
            a, b = starts[single[i]], ends[single[i + k - 1]]
            part = data[a:b]
            spaced.append((int(row[single[i]]), shortened(latin_letters(bytes(part[~IS_SPACE[part]]).decode("utf-8", "ignore"))), k))
    return out, spaced


def latin_letters(word: str) -> str:
    """The word with look-alikes of other alphabets as Latin letters, if it holds Latin ones too."""
    return word.translate(LOOK_TABLE) if not word.isascii() and any(c in LETTERS for c in word) else word


def may_hide(word: str) -> bool:
    """Whether a word is worth decoding: not plain letters without a stretch, and holding letters, or leet that is no number."""
    if word.isalpha():
        return any(word[k] == word[k + 1] == word[k + 2] for k in range(len(word) - 2))
    return any(map(is_letter, word)) or (any(c in LEET for c in word) and not NUMBER.fullmatch(word))


def single_letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words are single characters that may be a spaced word's: letters of any alphabet and leet."""
    lead, size = data[starts], ends - starts
    out = (size == 1) & (((lead >= 97) & (lead <= 122)) | np.isin(lead, [ord(c) for c in LEET]))
    wide = np.flatnonzero((lead >= 0xC2) & (size == 2 + (lead >= 0xE0) + (lead >= 0xF0)))
    known: dict[bytes, bool] = {}
    for i, a, b in zip(wide.tolist(), starts[wide].tolist(), ends[wide].tolist()):
        c = data[a:b].tobytes()
        if c not in known:
            text = c.decode("utf-8", "ignore")
            known[c] = len(text) == 1 and is_letter(text)
        out[i] = known[c]
    return out


def hashed(hasher: Hasher, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features of words: the whole word and its prefixes, one column each; a prefix as long as the word or longer is the word."""
    cols = [hasher(data, starts, ends)]
    for p in PREFIXES:
        cut = np.minimum(starts + p, ends)
        salt = np.where(cut < ends, np.uint64(p), np.uint64(0))
        cols.append(hasher(data, starts, cut) ^ salt)
    return np.stack(cols, axis=1)


NONE = np.zeros(0, np.int64)


class Readings(NamedTuple):
    """The features from `first` on: readings of odd words, each in place of the written ones from `since` to `until`, then those of spaced runs, from `begin` to `end` of their letters."""

    first: int
    since: np.ndarray = NONE
    until: np.ndarray = NONE
    begin: np.ndarray = NONE
    end: np.ndarray = NONE


def features(decode: Decoder, hasher: Hasher, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Readings]:
    """(row, features) of all written and restored words of a step, each row's number of words, and which of the features are restored."""
    data, offsets = cleaned(data, offsets)
    starts, ends, first = word_spans(data, offsets)
    at, to, begin = spans_where(IS_CORE[data], offsets)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(begin))
    found = hashed(hasher, data, at, to)
    words, readings = np.diff(first), Readings(len(found))
    odd, spaced = disguised(data, starts, ends, first)
    if odd or spaced:
        of = np.array([i for i, _ in odd], np.int64)
        owner = np.concatenate([np.searchsorted(first, of, "right") - 1, np.array([r for r, _, _ in spaced], np.int64)])
        texts = [decode(w).encode() for _, w in odd] + [decode(w).encode() for _, w, _ in spaced]
        extra = np.frombuffer(b" ".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        stop = np.cumsum(size + 1) - 1
        lo, hi, row = [stop - size], [stop], [owner]
        # Spaced letters don't show where a word ends, so every piece of a run that is as long as a word may be one.
        for k, (r, _, n_words) in enumerate(spaced, len(odd)):
            edge = np.append(np.flatnonzero(np.frombuffer(texts[k], np.uint8) & 0xC0 != 0x80), size[k]) + stop[k] - size[k]
            words[r] -= n_words - max(1, min(n_words, len(edge) // 5))
            for n in range(PIECES.start, min(PIECES.stop, len(edge) - 1)):
                lo.append(edge[:-n]), hi.append(edge[n:]), row.append(np.full(len(edge) - n, r))
        lo, hi = np.concatenate(lo), np.concatenate(hi)
        readings = Readings(len(found), np.searchsorted(at, starts[of]), np.searchsorted(at, ends[of]), lo[len(odd) :], hi[len(odd) :])
        found = np.concatenate([found, hashed(hasher, extra, lo, hi)])
        rows = np.concatenate([rows, *row])
    return rows, found, words, readings


def once(strength: np.ndarray, of: Readings) -> np.ndarray:
    """Strengths in which each word counts once.

    An odd word's reading and the strongest written word in it: the stronger of
    both.  A spaced run's overlapping words: the strongest; of equal ones the
    shortest, then the first.
    """
    for k in np.flatnonzero(strength[of.first : of.first + len(of.since)] > LEAST).tolist():
        if of.until[k] > of.since[k]:
            written = of.since[k] + int(np.argmax(strength[of.since[k] : of.until[k]]))
            least = min(written, of.first + k, key=lambda i: strength[i])
            strength[least] = 0.0
    first = of.first + len(of.since)
    hit = np.flatnonzero(strength[first:] > LEAST)
    if len(hit) > 1:
        taken = np.zeros(int(of.end.max()), bool)
        for k in hit[np.lexsort((of.begin[hit], of.end[hit] - of.begin[hit], -strength[first + hit]))].tolist():
            if taken[of.begin[k] : of.end[k]].any():
                strength[first + k] = 0.0
            else:
                taken[of.begin[k] : of.end[k]] = True
    return strength


def counted(model: np.ndarray):
    """For batches (toxic, half, text): in how many documents of each half and label each feature stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, hasher = Decoder(model), Hasher()
        for batch in batches:
            label, half = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for i, _, data, offsets in steps(batch.column(2)):
                rows, found, _, _ = features(decode, hasher, data, offsets)
                pair = np.empty(found.size, [("h", "<u8"), ("r", "<i8")])
                pair["h"], pair["r"] = found.ravel(), np.repeat(rows, found.shape[1])
                pair = np.unique(pair)
                kind = half[i + pair["r"]] * 2 + label[i + pair["r"]]
                h, back = np.unique(pair["h"], return_inverse=True)
                n = np.zeros((4, len(h)), np.int64)
                np.add.at(n, (kind, back), 1)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *[pa.array(x) for x in n]], names=["h", "n00", "n01", "n10", "n11"])

    return run


def evidence(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """Lower confidence bound of the log odds of features that stand in so many toxic and clean documents."""
    odds = np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1))
    return odds - CAUTION * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def pooled(rows: np.ndarray, strength: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Six values for each document: its three strongest words, how many count, their sum, and their share of its words."""
    out = np.zeros((len(words), 6))
    hit = np.flatnonzero(strength > LEAST)
    hit = hit[np.lexsort((-strength[hit], rows[hit]))]
    r, s = rows[hit], strength[hit]
    begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(begin, np.diff(np.append(begin, len(r))))
    for k in range(3):
        out[r[rank == k], k] = s[rank == k]
    n = np.bincount(r, minlength=len(words))
    out[:, 3] = np.log1p(n)
    out[:, 4] = np.log1p(np.bincount(r, s, minlength=len(words)))
    out[:, 5] = np.log1p(100 * n / np.maximum(words, 1))
    return out


def strengths(found: np.ndarray, known: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A word's evidence: the most that it or one of its prefixes has; known is sorted."""
    if not len(known):
        return np.zeros(len(found))
    filter_ = np.zeros(1 << 20, bool)
    filter_[known >> np.uint64(44)] = True
    out = np.zeros(len(found))
    for col in range(found.shape[1]):
        may = np.flatnonzero(filter_[found[:, col] >> np.uint64(44)])
        h = found[may, col]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        out[may] = np.maximum(out[may], np.where(known[at] == h, weight[at], 0.0))
    return out


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights (the last is the constant) of a penalised logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What fit() learns: the character model, the features with their evidence, and the logistic weights over scaled pooled values."""

    def __init__(self, chars: np.ndarray, known: np.ndarray, weight: np.ndarray, scale: np.ndarray, logit: np.ndarray):
        self.chars, self.known, self.weight, self.scale, self.logit = chars, known, weight, scale, logit

    def score(self, pool: np.ndarray) -> np.ndarray:
        z = (pool / self.scale) @ self.logit[:-1] + self.logit[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, hasher = Decoder(model.chars), Hasher()
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, data, offsets in steps(batch.column(batch.num_columns - 1)):
                rows, found, words, readings = features(decode, hasher, data, offsets)
                out.append(model.score(pooled(rows, once(strengths(found, model.known, model.weight), readings), words)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(out))], names=[*batch.schema.names[:-1], "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", held: int = 1, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from labels of rows whose crc32(id as text) mod 3 is not `held`; character counts come from all of docs.

    At most train_rows labelled rows are used, the least by a hash of their id.
    Rows with a null id or label teach nothing; of several labels of one id the
    largest holds.  With rows of one class only, every score is that class's rate.
    """
    chars = log_model(trigrams(docs))
    half = F.when(crc_mod(id_col, 3) == (held + 1) % 3, 0).otherwise(1)
    usable = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (crc_mod(id_col, 3) != held))
    known = (
        usable.filter(drawn(F.xxhash64(id_col), usable.count(), train_rows))
        .groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(train_rows)
    )
    chosen = docs.select(id_col, text_of().alias("text")).join(F.broadcast(known), F.col(id_col) == F.col("label_id"))
    sample = materialize(chosen.select(F.col("toxic"), half.alias("half"), "text"), "toxic-sample")
    totals = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    a, b = (np.array([float(totals.get((h, x), 0)) for h in (0, 1)]) for x in (1, 0))
    if not a.sum() or not b.sum():
        rate = (a.sum() + 0.5) / (a.sum() + b.sum() + 1)
        return Model(chars, np.zeros(0, np.uint64), np.zeros(0), np.ones(6), np.array([0.0] * 6 + [math.log(rate / (1 - rate))]))
    n = [F.sum(k).alias(k) for k in ("n00", "n01", "n10", "n11")]
    counts = sample.mapInArrow(counted(chars), "h long, n00 long, n01 long, n10 long, n11 long").groupBy("h").agg(*n)
    # Only features whose evidence counts in some half or in both; the training rows bound their number.
    bound = lambda x, y, t, c: (F.log((x + 0.5) / (t + 1)) - F.log((y + 0.5) / (c + 1))) - CAUTION * F.sqrt(1 / (x + 0.5) + 1 / (y + 0.5))
    c = {k: F.col(k) for k in ("n00", "n01", "n10", "n11")}
    most = F.greatest(bound(c["n11"], c["n10"], float(a[1]), float(b[1])), bound(c["n01"], c["n00"], float(a[0]), float(b[0])), bound(c["n01"] + c["n11"], c["n00"] + c["n10"], float(a.sum()), float(b.sum())))
    kept = counts.filter(most > LEAST - 1e-9).toPandas()
    h = kept["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, kept = h[order], kept.iloc[order]
    n00, n01, n10, n11 = (kept[c].to_numpy(float) for c in ("n00", "n01", "n10", "n11"))
    of = [evidence(n11, n10, a[1], b[1]), evidence(n01, n00, a[0], b[0]), evidence(n01 + n11, n00 + n10, a.sum(), b.sum())]

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, hasher = Decoder(chars), Hasher()
        for batch in batches:
            label, half = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            for i, j, data, offsets in steps(batch.column(2)):
                rows, found, words, readings = features(decode, hasher, data, offsets)
                s = np.where(half[i + rows] == 0, strengths(found, h, of[0]), strengths(found, h, of[1])) if len(rows) else np.zeros(0)
                values = pooled(rows, once(s, readings), words)
                yield pa.RecordBatch.from_arrays([pa.array(label[i:j]), *[pa.array(v) for v in values.T]], names=["y", *[f"x{k}" for k in range(6)]])

    rows = sample.mapInArrow(pool, "y long, " + ", ".join(f"x{k} double" for k in range(6))).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")  # bounded by train_rows; a fixed order gives a fixed fit
    x, y = rows[[f"x{k}" for k in range(6)]].to_numpy(), rows["y"].to_numpy(float)
    scale = np.maximum(x.std(axis=0), 1e-3)
    strong = of[2] > LEAST
    return Model(chars, h[strong], of[2][strong], scale, logistic(x / scale, y))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) for every row; null text counts as empty and gets the score of a document without evidence."""
    chosen = docs.select(id_col, text_of().alias("text"))
    return chosen.mapInArrow(scored_batches(model), T.StructType([chosen.schema[id_col], T.StructField("score", T.DoubleType())]))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold, all columns as they are; a null text counts as empty."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, hasher = Decoder(model.chars), Hasher()
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, data, offsets in steps(batch.column(place)):
                rows, found, words, readings = features(decode, hasher, data, offsets)
                out.append(model.score(pooled(rows, once(strengths(found, model.known, model.weight), readings), words)))
            yield batch.filter(pa.array(np.concatenate(out) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
