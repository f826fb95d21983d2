"""SentencePiece encoding and decoding with a merge-type (BPE) model, as the library does it.

The library joins, again and again, the neighbouring pair whose union is the
piece of highest score, the leftmost of equal ones.  A sequence of pieces is the
result of that if and only if joining any two neighbours' characters anew gives
just these two.  So a text is encoded from left to right: the longest piece that
starts at a place (an Aho-Corasick automaton over the reversed pieces finds all
of them in one pass) is taken if it fits its left neighbour, else the next
shorter one; if none fits, the place is marked in a bit field and the piece
before it is taken back.  Every place fails at most once, so the work is linear
in the text, however long.

No piece reaches over a place whose two characters stand side by side in no
piece.  Texts are cut there first, and equal parts are encoded once for a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read, steps

MODEL = "piece_bpe_32k.model"
#: What stands for a space in pieces.
MARK = "▁"
#: Parts, and a quarter as many pairs of pieces, that a task remembers; parts of more characters than LONG are encoded anew.
REMEMBERED = 1 << 20
LONG = 48
NORMAL, UNKNOWN, CONTROL, BYTE = range(4)
PROBES = ("", " ", "a", "  a  b ", "aaaaaaaaaaaaaaaaaaaaaaa", "Hello, world 2024!", "你好 \U0001f600 ﬁ­", "<s>x</s>", "\n\t\x00")


class Model:
    """A merge-type model's pieces, scores and kinds: what executors need of its file.

    Raises ValueError for a file of another kind: unigram models, and models
    that rewrite characters or white space.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.proto = f.read()
        lib = self.library()
        ids = range(lib.get_piece_size())
        self.pieces = [lib.id_to_piece(i) for i in ids]
        self.scores = [lib.get_score(i) for i in ids]
        self.kinds = [UNKNOWN if lib.is_unknown(i) else CONTROL if lib.is_control(i) else BYTE if lib.is_byte(i) else NORMAL for i in ids]
        coder = Encoder(self)
        for text in PROBES:
            if lib.normalize(text) != spaced(text) or lib.encode(text) != list(chain.from_iterable(coder.parts_of(text))):
                raise ValueError(f"{path} is no merge-type model that leaves characters as they are")

    def library(self) -> sentencepiece.SentencePieceProcessor:
        """The library's own processor of this model."""
        return sentencepiece.SentencePieceProcessor(model_proto=self.proto)


def spaced(text: str) -> str:
    """The text as pieces see it: a space before it, spaces written as MARK; an empty one stays."""
    return MARK + text.replace(" ", MARK) if text else ""


class Remembered(dict):
    """What a function gave, for short keys; emptied when it holds `most` keys."""

    def __init__(self, function: Callable, most: int):
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key):
        value = self.function(key)
        if len(key) <= LONG:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes texts with a model; one for a task."""

    def __init__(self, model: Model):
        self.score = {p: s for p, s, k in zip(model.pieces, model.scores, model.kinds) if k == NORMAL}
        self.id = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.unknown = model.kinds.index(UNKNOWN)
        chars = sorted({c for p in self.id for c in p})
        known = {*self.id, *chars}
        self.shorter = {p: next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in known), None) for p in known}
        self.longest = ahocorasick.Automaton()
        for p in known:
            self.longest.add_word(p[::-1], p)
        self.longest.make_automaton()
        self.char = np.zeros(0x110000, np.uint16)
        self.char[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {c: i for i, c in enumerate(chars, 1)}
        self.beside = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for p in known:
            for a, b in zip(p, p[1:]):
                self.beside[number[a], number[b]] = True
        self.fits = Remembered(self.fit, REMEMBERED >> 2)
        self.parts = Remembered(self.ids, REMEMBERED)

    def joined(self, text: str) -> list[str]:
        """The pieces by the rule itself, quadratic in the text: for one or two pieces' characters."""
        found, score, none = list(text), self.score.get, -np.inf
        scores = [score(a + b, none) for a, b in zip(found, found[1:])]
        while scores and (most := max(scores)) > none:
            i = scores.index(most)
            found[i : i + 2] = [found[i] + found[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(found[i - 1] + found[i], none)
            if i < len(scores):
                scores[i] = score(found[i] + found[i + 1], none)
        return found

    def fit(self, pair: tuple[str, str]) -> bool:
        """Whether two neighbours' characters, joined anew, give just these two ('' on the left: whether a piece gives itself)."""
        left, right = pair
        if not left:
            return self.joined(right) == [right]
        return left + right not in self.score and self.joined(left + right) == [left, right]

    def encode(self, part: str) -> list[str]:
        """The pieces of a part, or single characters that are none, by backtracking."""
        fits, shorter = self.fits, self.shorter
        if part in shorter and fits["", part]:
            return [part]
        n = len(part)
        # The automaton gives the longest piece first at every end, that is start of the part: let it come last.
        longest = dict([*self.longest.iter(part[::-1])][::-1])
        failed, taken, at, last, piece = bytearray(n + 1), [], 0, "", longest.get(n - 1) or part[0]
        while True:
            end = at + len(piece)
            if not failed[end] and fits[last, piece]:
                taken.append(piece)
                if end == n:
                    return taken
                at, last, piece = end, piece, longest.get(n - 1 - end) or part[end]
                continue
            piece = shorter.get(piece)
            while piece is None:
                failed[at] = 1
                piece = taken.pop()
                at -= len(piece)
                piece = shorter.get(piece)
            last = taken[-1] if taken else ""

    def ids(self, part: str) -> tuple[int, ...]:
        """A part's ids; a character that is no piece counts by its bytes, or as unknown where the model has none."""
        ids: list[int] = []
        for p in self.encode(part):
            if p in self.id:
                ids.append(self.id[p])
            elif self.bytes:
                ids += [self.bytes[b] for b in p.encode()]
            else:
                ids.append(self.unknown)
        return tuple(ids)

    def parts_of(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of a text, part by part."""
        text = spaced(text)
        if not text:
            return iter(())
        c = self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cuts = [0, *(np.flatnonzero(~self.beside[c[:-1], c[1:]]) + 1).tolist(), len(text)]
        return map(self.parts.__getitem__, map(text.__getitem__, map(slice, cuts, cuts[1:])))

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of several texts, and where each text's begin (texts + 1)."""
        each = [np.fromiter(chain.from_iterable(self.parts_of(t)), np.int32) for t in texts]
        return np.concatenate([*each, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(e) for e in each], dtype=np.int64)]).astype(np.int64)


class Decoder:
    """Decodes ids with a model; one for a task."""

    def __init__(self, model: Model):
        surface = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(model.pieces, model.kinds)]
        self.surface = surface
        self.kinds = np.array(model.kinds, np.int8)
        self.marked = np.array([k == NORMAL and p.startswith(MARK) for p, k in zip(model.pieces, model.kinds)])

    def __call__(self, ids: np.ndarray) -> str:
        """The text of ids (all of them the model's): the first piece's space goes, bytes that are no UTF-8 become U+FFFD one by one."""
        if not len(ids):
            return ""
        kinds = self.kinds[ids]
        skip = 1 if self.marked[ids[first := int(np.argmax(kinds != CONTROL))]] and kinds[first] != CONTROL else 0
        data = b"".join(map(self.surface.__getitem__, ids.tolist()))[skip:]
        if not ((kinds == CONTROL).any() and (kinds == BYTE).any()):
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        # Runs of bytes are read for themselves: neither a piece nor a control id may lie inside a character.
        edges = np.flatnonzero(np.diff((kinds == BYTE).astype(np.int8))) + 1
        out = []
        for run in np.split(ids, edges):
            raw = b"".join(map(self.surface.__getitem__, run.tolist()))
            out.append(one_by_one(raw) if self.kinds[run[0]] == BYTE else raw.decode())
        return "".join(out)[skip:]


def one_by_one(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every byte that belongs to no whole character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def encode(docs: DataFrame, model: Model, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with `ids_col`, the text's ids without begin or end ids; a column of that name is replaced.

    A null text counts as empty and has no ids.  Every row, repeated ones too,
    keeps its other columns, whatever their names.
    """
    out = docs.drop(ids_col).withColumn(ids_col, F.array().cast("array<int>"))
    place = out.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(model)
        for batch in batches:
            for i, j, data, at in steps(batch.column(place)):
                ids, first = coder.flat([data[a:b].tobytes().decode() for a, b in zip(at, at[1:])])
                column = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids)).cast(batch.schema.field(batch.num_columns - 1).type)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns[:-1], column], names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


def decode(rows: DataFrame, model: Model, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """rows with `text_col`, the text of the ids; a column of that name is replaced.

    Null ids give a null text and none an empty one; a null or an id that the
    model doesn't have counts as unknown.
    """
    out = rows.drop(text_col).withColumn(text_col, F.when(F.col(ids_col).isNotNull(), F.lit("")))
    place = out.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = Decoder(model)
        unknown, size = model.kinds.index(UNKNOWN), len(model.pieces)
        for batch in batches:
            column = batch.column(place)
            flat = column.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = np.where((flat < 0) | (flat >= size), unknown, flat)
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            texts = [text_of(flat[a:b]) for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
            text = pa.array(texts, batch.schema.field(batch.num_columns - 1).type, mask=column.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text that they decode to, as counts and digests."""
    model = Model(public_tokenizers.path(MODEL))
    ids = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")
    out = decode(ids, model)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
