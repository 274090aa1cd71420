"""Cost-balanced packing of tokenised documents into sequences.

The cost of a piece of n tokens is estimated as LINEAR * n + QUADRATIC * n^2 (attention). Documents are packed in blocks. Within a
block they go, the longest first, to the sequence of the lowest cost that has room for all of them (of equals the first); only a
document that no sequence of the block has room for is cut: it fills the cheapest sequence with any room and its rest goes on
alike. Sequences lie by their room in a tree of lowest costs (ByRoom), so the choice is exact and takes the logarithm of the
capacity, however many sequences there are. The sequences of a block hold exactly its tokens: all have `capacity`, and what
remains is split into powers of two, which need no padding.

Blocks: the number of blocks follows from the bytes of all texts and the number of rows, so that a block has about
BLOCK_BYTES (a row counts as ROW_BYTES more than its text). A document's block is a hash of its id and length and of the task
that reads it, and, where a batch of that task holds equal rows, of their number there; so equal rows, null ids and empty texts
spread over blocks too. A task that is run again puts its rows where it did before, if its input has an order (files, tables).
Tokens are found once and shuffled once, with their block. A task holds one block; a single document longer than that is
a block's one large row.

Defined cases: a null text is an empty text, whose one token is the end mark. Rows with equal ids are documents of
their own. A null doc_id is a document like any other. An empty table gives an empty table. Ties in length go by id,
then by content. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY, END, BLOCK_BYTES, ROW_BYTES = 2048, 1, 2_000_000, 64
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Fixed value: the pattern that splits a text before byte-level merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: Runs of blanks that are left to the tokenizer, as the merger's pattern takes long to look back over them.
_BLANKS = re.compile(r"\s{10000}")
_loaded: dict[str, ByteTokens] = {}


def byte_of() -> dict[str, int]:
    """The byte that each character stands for in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteTokens:
    """Ids of texts by a tokenizer's file, as little-endian unsigned 32-bit numbers.

    If the file is of plain byte-level merges, ranked as their ids are, a merger is built of its vocabulary that gives the same
    ids in a fraction of the time; if not, or for texts with strings of special tokens, the tokenizer itself is called."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [str(t.content) for t in self.model.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.merger = self._merger(json.load(f))

    def _merger(self, spec: dict):
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not spec.get("normalizer")
        odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
        ids = [model["vocab"].get("".join(m), -1) for m in pairs]
        if not plain or odd or ids != sorted(ids) or ids[:1] == [-1]:
            return None
        byte = byte_of()
        made = {*byte, *("".join(m) for m in pairs)}
        ranks = {bytes(byte[c] for c in k): i for k, i in model["vocab"].items() if k in made}
        return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == len(made) else None

    @classmethod
    def load(cls, path: str) -> ByteTokens:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def encode(self, text: str) -> np.ndarray:
        if self.merger is None or any(s in text for s in self.special) or _BLANKS.search(text):
            return self.whole(text)
        return self.merger.encode_to_numpy(text, disallowed_special=())


def bins(total: int, capacity: int) -> list[int]:
    """Room of each sequence for `total` tokens: full ones, then the rest as powers of two."""
    full, rest = divmod(total, capacity)
    return [capacity] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class ByRoom:
    """Sequences by their room: for each room a heap of (cost, sequence), and a tree of the least of the heaps."""

    NONE = (float("inf"), -1)

    def __init__(self, rooms: list[int]):
        self.size = 1 << max(rooms, default=0).bit_length()
        self.heaps: dict[int, list[tuple[float, int]]] = {}
        self.least = [self.NONE] * (2 * self.size)
        for i, room in enumerate(rooms):
            self.heaps.setdefault(room, []).append((0.0, i))  # in order, so each is a heap
        for room in self.heaps:
            self._mend(room)

    def _mend(self, room: int) -> None:
        at, heap = room + self.size, self.heaps[room]
        self.least[at] = heap[0] if heap else self.NONE
        while at > 1:
            at >>= 1
            self.least[at] = min(self.least[2 * at], self.least[2 * at + 1])

    def cheapest(self, room: int) -> tuple[float, int]:
        """(cost, sequence) of the cheapest with so much room at least; NONE if there is none."""
        if room >= self.size:
            return self.NONE
        lo, hi, best = room + self.size, 2 * self.size, self.NONE
        while lo < hi:  # `hi` is past the end at every level: only the left border has nodes of its own
            if lo & 1:
                best = min(best, self.least[lo])
                lo += 1
            lo, hi = lo >> 1, hi >> 1
        return best

    def move(self, room: int, to: int, cost: float) -> None:
        """The cheapest sequence of a room gets another room and cost; without room it leaves."""
        _, i = heapq.heappop(self.heaps[room])
        self._mend(room)
        if to:
            heapq.heappush(self.heaps.setdefault(to, []), (cost, i))
            self._mend(to)


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece. `lengths`: of the documents, in descending order."""
    room = bins(sum(lengths), capacity)
    size, queue, out = list(room), ByRoom(room), []
    for doc, length in enumerate(lengths):
        start = 0
        while start < length:
            cost, i = queue.cheapest(length - start)
            if i < 0:
                cost, i = queue.cheapest(1)
            n = min(length - start, room[i])
            out.append((doc, start, n, i, size[i] - room[i]))
            queue.move(room[i], room[i] - n, cost + LINEAR * n + QUADRATIC * n * n)
            room[i] -= n
            start += n
    return out


def tokenised(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n (tokens with the end mark), ids (4 bytes each, or 2 for vocabularies that fit) and place (the task, and a row's
    number in it where its batch holds rows like it) for each row of `docs`."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ByteTokens.load(tokenizer)
        kind = np.dtype("<u2" if tokens.model.get_vocab_size() <= 1 << 16 else "<u4")
        end, task, row = np.array([END], dtype=kind).tobytes(), TaskContext.get().partitionId() << 40, 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [tokens.encode(t.as_py() or "").astype(kind).tobytes() + end for t in part.column(1)]
                seen, places = set(), []
                for like in zip(part.column(0).to_pylist(), ids, strict=True):
                    places.append(task + row if like in seen else task)
                    seen.add(like)
                    row += 1
                cols = [part.column(0), pa.array([len(x) // kind.itemsize for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(places, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "ids", "place"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id bigint, n bigint, ids binary, place bigint")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block_bytes: int = BLOCK_BYTES, with_ids: bool = False) -> DataFrame:
    """A row for each piece (PIECES, and its ids as 4-byte integers if asked for). `tokenizer`: the path of its file on each executor."""
    nbytes = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    blocks = max(1, -(-nbytes // block_bytes))
    rows = tokenised(docs, tokenizer).withColumn("block", F.pmod(F.xxhash64("doc_id", "n", "place"), F.lit(blocks))).drop("place")

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        doc, n = table.column("doc_id").to_pylist(), table.column("n").to_pylist()
        held = table.column("ids").combine_chunks()
        ends = np.frombuffer(held.buffers()[1], dtype=np.int64 if pa.types.is_large_binary(held.type) else np.int32)[held.offset : held.offset + len(held) + 1].tolist()
        raw = memoryview(held.buffers()[2])  # ids of one document after another, not copied
        width = (ends[1] - ends[0]) // n[0]
        order = sorted(range(len(n)), key=lambda i: (-n[i], doc[i] is None, doc[i] or 0, zlib.crc32(raw[ends[i] : ends[i + 1]])))
        out = []
        for k, start, length, sequence, offset in pack([n[i] for i in order], capacity):
            i = order[k]
            at = ends[i] + width * start
            piece = np.frombuffer(raw[at : at + width * length], dtype=f"<u{width}").astype("<u4").tobytes()
            out.append((doc[i], start, length, zlib.crc32(piece), n[i], (key[0].as_py() << 24) + sequence, offset, *([piece] if with_ids else [])))
        names = [*(x.split()[0] for x in PIECES.split(", ")), *(["ids"] if with_ids else [])]
        return pa.table(dict(zip(names, [pa.array(c, pa.binary() if x == "ids" else pa.int64()) for x, c in zip(names, zip(*out, strict=True), strict=True)], strict=True)))

    return rows.groupBy("block").applyInArrow(packed, PIECES + (", ids binary" if with_ids else ""))


def padding(pieces: pd.DataFrame, capacity: int = CAPACITY) -> int:
    """Tokens of padding that sequences need: up to `capacity`, unless they end at a power of two."""
    used = pieces.groupby("sequence_id")["length"].sum()
    return int(sum(0 if n & (n - 1) == 0 else capacity - n for n in used))
