"""SentencePiece encoding and decoding as weighted finite-state transduction.

Three transducers are compiled from a model, each as states and arcs:

* Normaliser: reads characters, writes characters: white space as U+2581, the dummy prefix, runs of white space as one where
  the model says so. It is deterministic, so composed with a text it is again one line of characters.
* Pieces: a trie whose ends write a piece's id. Its weights are in the tropical semiring (min, +). Unigram models: one state,
  an arc weighs minus its piece's score. Merge (BPE) models: the state is the last piece written, and an arc to the next weighs 0
  if the two stand side by side in a merged text, infinity if not. A text is merged just so if all neighbours on its path are
  such pairs, so exactly one path is of finite weight.
* Byte fallback: arcs that read a character that is no piece and write the ids of its UTF-8 bytes.

The three are composed with the input arc by arc, as they are asked for (arcs()), and the path of least weight through the composition
is the encoding. It is found best first, of equal weights the furthest (shortest(), the same for both kinds of models; weights
are never negative), so that few states are ever made. Decoding reads the inverted transducers.

The arcs between pieces of a merge model are as many as pairs of pieces; each is decided when a text first asks for it, and kept.
A merge crosses from a to b if some end of a and some start of b, as they come about while a and b are merged, make a piece that is
merged before either of the two is used up. Where pieces of equal scores, or of parts with lower scores, come in (as runs of blanks
do in the public models), the two are merged instead.

No piece of the model may hold white space after another character (the compiler checks this); so texts fall into chunks
at white space whose paths are independent, and the paths of frequent chunks are kept. Paths take time linear in a chunk's length.

Defined cases: a null text is an empty text, with no ids. Texts of any length are encoded whole. Repeated rows are
encoded alike. An empty table gives an empty table. Only doc_id and text are read, so other columns can't clash. A model whose
normaliser has a character map is refused, as none of the public files has one. Ids that are no piece's decode to nothing.
"""

from __future__ import annotations

import collections
import functools
import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
CACHE_CHUNKS, CACHE_PAIRS, CACHE_LENGTH = 400_000, 1_000_000, 32
UNIGRAM, MERGES = 1, 2
NEVER = float("inf")
_loaded: dict[str, Transducer] = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            byte = data[at]
            out, shift, at = out | (byte & 127) << shift, shift + 7, at + 1
            if byte < 128:
                return out, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        if tag & 7 == 0:
            value, at = varint(at)
        else:
            n, at = varint(at) if tag & 7 == 2 else (4 if tag & 7 == 5 else 8, at)
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class Normaliser:
    """States and arcs over two kinds of characters, white space and others. An arc writes symbols; OWN is the character read."""

    START, TEXT, GAP = 0, 1, 2
    OWN = ""

    def __init__(self, prefix: bool, squeeze: bool, escape: bool):
        gap, first = (SPACE if escape else " "), [SPACE if escape else " "] if prefix else []
        #: (state, whether white space is read): (symbols written, next state)
        self.arcs = {
            (self.START, False): ([*first, self.OWN], self.TEXT),
            (self.START, True): ([], self.START) if squeeze else ([*first, gap], self.TEXT),
            (self.TEXT, False): ([self.OWN], self.TEXT),
            (self.TEXT, True): ([], self.GAP) if squeeze else ([gap], self.TEXT),
            (self.GAP, False): ([gap, self.OWN], self.TEXT),
            (self.GAP, True): ([], self.GAP),
        }

    def read(self, text: str, state: int) -> str:
        """What the transducer writes for a text from a state."""
        out = []
        for c in text:
            symbols, state = self.arcs[state, c == " "]
            out += [x or c for x in symbols]
        return "".join(out)


class Transducer:
    """The compiled model of a SentencePiece file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces, score, byte, text_of = {}, [], [None] * 256, []
        for i, piece in enumerate(v for k, v in model if k == 1):
            got = dict(_fields(piece))
            text, kind = got[1].decode("utf-8"), got.get(3, 1)
            score.append(float(np.frombuffer(got.get(2, b"\0\0\0\0"), "<f4")[0]))
            # Bytes beyond ASCII are spelt as escapes, which _spelt reads as UTF-8 together.
            text_of.append(text.replace(SPACE, " ") if kind in (1, 4) else bytes([int(text[3:5], 16)]).decode("utf-8", "surrogateescape") if kind == 6 else " ⁇ " if kind == 2 else "")
            if kind in (1, 4):
                pieces[text] = i
            elif kind == 6:
                byte[int(text[3:5], 16)] = i
        trainer, normaliser = (dict(_fields(next((v for k, v in model if k == n), b""))) for n in (2, 3))
        if normaliser.get(2):
            raise ValueError("a normaliser with a character map isn't supported")
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces):
            raise ValueError("a piece holds white space after another character")
        self.prefix = bool(normaliser.get(3, 1))
        self.compile(pieces, score, byte, text_of, trainer.get(3, UNIGRAM), Normaliser(self.prefix, bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1))))

    def compile(self, pieces: dict[str, int], score: list[float], byte: list[int | None], text_of: list[str], kind: int, normaliser: Normaliser) -> None:
        self.pieces, self.score, self.byte, self.text_of, self.kind, self.normaliser = pieces, score, byte, text_of, kind, normaliser
        if kind == UNIGRAM and max(score, default=0.0) > 0:
            raise ValueError("a unigram model with a score above 0 isn't supported")
        self.lost = 10.0 - min(score, default=0.0)  # the weight of byte fallback in a unigram model
        alone = "" if any("\n" in p for p in pieces) else "\n"
        self.chunks = re.compile(f"[ {SPACE}]*[^ {SPACE}{alone}]+|[ {SPACE}]+" + (f"|{alone}" if alone else "")).findall
        self.known: dict[int, dict[str, bytes]] = {Normaliser.START: {}, Normaliser.TEXT: {}}
        self.older = {k: {} for k in self.known}
        self.between: dict[int, bool] = {}  # the arcs between pieces that were asked for
        splits = {p: last for p in pieces if (last := self._last_merge(p)) is not None} if kind == MERGES else {}
        same = collections.Counter(score[pieces[p]] for p in splits if len(p) > 1)
        early = lambda x, p: len(x) == 1 or score[pieces[x]] > score[pieces[p]]
        #: Pieces that are not merged in the one order of their scores.
        self.odd = {p for p, k in splits.items() if k and not (same[score[pieces[p]]] == 1 and early(p[:k], p) and early(p[k:], p))}
        self.splits: dict[str, int] = splits
        self.root: list = [{}, -1]  # a state: its arcs by character, and the id that is written where a piece ends
        for p, i in pieces.items():
            if kind == UNIGRAM or p in splits:  # other pieces of a merge model come of no merging
                node = self.root
                for c in p:
                    node = node[0].setdefault(c, [{}, -1])
                node[1] = i
        self.spines: dict[int, tuple[list, list]] = {}

    @classmethod
    def load(cls, path: str) -> Transducer:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def merged(self, text: str, track: list[int] | None = None) -> list[str]:
        """What merging the characters of a text gives: the best-scored neighbours first, the leftmost of equals. `track` gets where
        the two parts of each merge meet."""
        part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
        queue: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part) and (both := part[i] + part[after[i]]) in self.pieces:
                heapq.heappush(queue, (-self.score[self.pieces[both]], i, both))

        for i in range(len(part) - 1):
            offer(i)
        while queue:
            _, i, both = heapq.heappop(queue)
            j = after[i]
            if not part[i] or j >= len(part) or part[i] + part[j] != both:
                continue  # one of the two has merged since
            part[i], part[j], after[i] = both, "", after[j]
            if track is not None:
                track.append(j)
            if after[j] < len(part):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def _last_merge(self, piece: str) -> int | None:
        """Where the last merge of a piece joins its parts; 0 for a single character, None if merging doesn't give the piece."""
        track: list[int] = []
        return (track[-1] if track else 0) if self.merged(piece, track) == [piece] else None

    def _label(self, label: int) -> str:
        return chr(label - len(self.score)) if label >= len(self.score) else self._text[label]

    @functools.cached_property
    def _text(self) -> dict[int, str]:
        return {i: p for p, i in self.pieces.items()}

    def _spine(self, label: int) -> tuple[list, list]:
        """The ends of a label and its starts, as they come about while it is merged: (text, when it is made, when it is used up)."""
        got = self.spines.get(label)
        if got is None:
            made = lambda x: -NEVER if len(x) == 1 else -self.score[self.pieces[x]]
            sides = []
            for end in (True, False):
                out, x, until = [], self._label(label), NEVER
                while True:
                    out.append((x, made(x), until))
                    k = self.splits.get(x, 0)
                    if not k:
                        break
                    x, until = (x[k:] if end else x[:k]), made(x)
                sides.append(out)
            got = self.spines[label] = tuple(sides)
        return got

    def _beside(self, a: int, b: int) -> bool:
        """Whether no merge crosses from label a to label b."""
        pieces, score, odd = self.pieces, self.score, self.odd
        ends, starts = self._spine(a)[0], self._spine(b)[1]
        crosses = False
        for x, x_made, x_used in ends:
            for y, y_made, y_used in starts:
                i = pieces.get(x + y)
                if i is not None:
                    if x in odd or y in odd or x + y in odd:
                        return self.merged(self._label(a) + self._label(b)) == [self._label(a), self._label(b)]
                    when = max(-score[i], x_made, y_made)
                    crosses = crosses or when < x_used and when <= y_used  # of equal merges the leftmost is first
        return not crosses

    def arcs(self, symbols: str, at: int) -> list[tuple[int, int, float]]:
        """(end, label, weight) of the composition's arcs from a place: pieces that start there, else byte fallback. A label is a
        piece's id, or beyond all ids a character's number."""
        out, end, unigram = [], at, self.kind == UNIGRAM
        then = self.root[0]
        for c in symbols[at:]:
            node = then.get(c)
            if node is None:
                break
            end += 1
            then, i = node
            if i >= 0:
                out.append((end, i, -self.score[i] if unigram else 0.0))
        if not out or out[0][0] > at + 1:
            out.append((at + 1, len(self.score) + ord(symbols[at]), self.lost if unigram else 0.0))
        return out

    def shortest(self, symbols: str) -> list[int]:
        """The labels along the path of least weight from the first place to the last; states are a place and the piece machine's state."""
        n, between, merges, push, pop = len(symbols), self.between, self.kind == MERGES, heapq.heappush, heapq.heappop
        queue, done, arcs = [(0.0, 0, -1, None)], set(), {}
        path: tuple | None = None
        while queue:
            least, place, label, before = pop(queue)
            path = (label, before)  # paths to one place differ in a label, so that the queue never compares their ends
            if place == -n:
                break
            state = (place, label if merges else 0)
            if state in done:
                continue
            done.add(state)
            some = arcs.get(place)
            if some is None:
                some = arcs[place] = self.arcs(symbols, -place)
            for end, to, weight in some:
                if merges and place:
                    key = label << 22 | to
                    ok = between.get(key)
                    if ok is None:
                        if len(between) >= CACHE_PAIRS:
                            between.clear()
                        ok = between[key] = self._beside(label, to)
                    if not ok:
                        continue  # an arc of infinite weight
                push(queue, (least + weight, -end, to, path))
        out = []
        while path[1] is not None:
            label, path = path
            out.append(label)
        return out[::-1]

    def labels(self, symbols: str) -> list[str]:
        return [self._label(x) for x in self.shortest(symbols)]

    def _ids(self, chunk: str, state: int) -> bytes:
        """Ids of a chunk that isn't among the latest ones; those before them are kept too, so that frequent chunks stay."""
        got = self.older[state].get(chunk)
        if got is None:
            out = []
            for label in self.shortest(self.normaliser.read(chunk, state)):
                if label < len(self.score):
                    out.append(label)
                else:
                    out += [self.byte[b] if self.byte[b] is not None else 0 for b in chr(label - len(self.score)).encode("utf-8", "surrogatepass")]
            got = array("i", out).tobytes()
        if len(chunk) <= CACHE_LENGTH:
            if len(self.known[state]) >= CACHE_CHUNKS:
                self.known[state], self.older[state] = {}, self.known[state]
            self.known[state][chunk] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        chunks = self.chunks(text or "")
        if not chunks:
            return np.zeros(0, dtype="<i4")
        start, then = Normaliser.START, Normaliser.TEXT
        first, rest, own = self.known[start].get(chunks[0]), [], self._ids
        parts = [first if first is not None else own(chunks[0], start)]
        k = 1
        while parts[-1] == b"" and k < len(chunks):  # nothing was written yet: the next chunk is the first
            parts.append(own(chunks[k], start))
            k += 1
        rest = chunks[k:] if k < len(chunks) else []
        known = self.known[then].get
        parts += [known(c) or own(c, then) for c in rest]
        return np.frombuffer(b"".join(parts), dtype="<i4")

    def _spelt(self, ids: list[int]) -> str:
        """The inverted transducers' reading: bytes in a row are UTF-8, U+2581 is a space."""
        try:
            out = "".join(map(self.text_of.__getitem__, ids))
        except IndexError:
            out = "".join(self.text_of[i] for i in ids if i < len(self.text_of))
        return out if out.isascii() else out.encode("utf-8", "surrogateescape").decode("utf-8", "replace")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the dummy prefix."""
        ids = np.asarray(ids)
        text = self._spelt((ids[ids >= 0] if len(ids) and ids.min() < 0 else ids).tolist())
        return text[1:] if self.prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, n_ids, ids_crc32 (of 4-byte little-endian ids) and round_trip (whether decoding the row's ids gives its text back)."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer.load(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [x.as_py() or "" for x in part.column(1)]
                ids = [t.encode(x) for x in texts]
                back = [t.decode(x) == y for x, y in zip(ids, texts, strict=True)]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64()), pa.array(back)], names=["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encoded, "doc_id bigint, ids array<int>, n_ids bigint, ids_crc32 bigint, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids are none."""

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Transducer.load(model)
        for b in batches:
            texts = [t.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(decoded, "doc_id bigint, text string")
