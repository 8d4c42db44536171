"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text, with the model's leading blank, is a lattice: every vocabulary piece that matches somewhere
is an edge, weighted by (rank + 2) ^ -alpha; a character without a piece of its own also has an edge
of its UTF-8 byte pieces. The forward pass sums the weights of all paths to each place; the backward
pass draws a path from the end with exactly its share of the total weight. Draws are seeded by the
row key alone, so a row has the same segmentation on every run and machine.

No piece has a blank after another character or letters beside other characters, so the lattice falls
into independent units (blanks and the letters, or the other characters, that follow). The new units of
some text go forward together, place by place, and their edges are kept per worker; all units go
backward together, draw by draw. A unit of more than LONGEST characters is cut there. A literal U+2581 in a text is written in byte pieces, so decoding
gives back every text exactly.

Defined cases: a null or empty text has no pieces (and decodes to null or to the empty text). Rows
with null doc_id share the seed of the key "null"; rows that repeat a doc_id share its seed. An empty
table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweave.llm.text import mix, owners

BLANK = "▁"
LONGEST = 4096
_CROSSING = regex.compile(r"[^ ] |\p{L}[^\p{L} ]|[^\p{L} ]\p{L}")
#: Weight of one byte piece.
SPELLED = 1e-5
#: Units whose edges a worker keeps, and the edges.
CACHE = 120_000
CACHE_EDGES = 4_000_000
#: Units that go backward together.
STEP = 1 << 18
#: Characters that are sampled at once, about.
BATCH = 1 << 20


class Trie:
    """Pieces and what they can start with, as numbered nodes; 0 is the root."""

    def __init__(self, pieces: dict[str, int]):
        number = {"": 0}
        for piece in pieces:
            for k in range(1, len(piece) + 1):
                number.setdefault(piece[:k], len(number))
        self.piece = np.full(len(number), -1, dtype=np.int32)
        for piece, i in pieces.items():
            self.piece[number[piece]] = i
        # open addressing by (parent, character)
        self.bits = max(4, (4 * len(number)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.nodes = np.full(1 << self.bits, -1, dtype=np.int32)
        keys = [number[text[:-1]] << 21 | ord(text[-1]) for text in number if text]
        for node, (key, at) in enumerate(zip(keys, self._slots(np.array(keys)).tolist()), 1):
            while self.keys[at] >= 0:
                at = (at + 1) % len(self.keys)
            self.keys[at], self.nodes[at] = key, node

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of every node by its character, -1 if there is none."""
        keys = (nodes.astype(np.int64) << 21) | chars
        at = self._slots(keys)
        out = np.full(len(keys), -1, dtype=np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[at[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.nodes[at[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
            at[open_] = (at[open_] + 1) % len(self.keys)
        return out


class Lattice:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str, alpha: float = 1.0):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        self.raw: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value] = i
                self.raw.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece.replace(BLANK, " ")] = i
                self.raw.append(piece.replace(BLANK, " ").encode())
        if any(_CROSSING.search(p) for p in self.ids):
            raise ValueError("a piece that joins letters and others would cross units")
        # breaks that are in no piece are units by themselves
        breaks = "".join(c for c in "\n\r\t" if not any(c in p for p in self.ids))
        self.units = regex.compile(rf" *\p{{L}}+| *[^\p{{L}} {breaks}]+| +"
                                   + (f"|[{breaks}]" if breaks else ""))
        order = sorted(self.ids.values())
        rank = {i: r for r, i in enumerate(order)}
        self.weight = {p: (rank[i] + 2.0) ** -alpha for p, i in self.ids.items()}
        self.trie = Trie(self.ids)
        self.longest = max(map(len, self.ids))
        size = max(self.ids.values()) + 1
        self.weights = np.zeros(size)
        for p, i in self.ids.items():
            self.weights[i] = self.weight[p]
        self._forget()

    def _forget(self) -> None:
        """Edges of no unit: by unit the first place, by place the first edge."""
        self._unit: dict[str, int] = {}
        self._first = np.zeros(1, dtype=np.int64)
        self._begin = np.zeros(1, dtype=np.int64)
        self._sums = np.zeros(0)
        self._starts = np.zeros(0, dtype=np.int32)
        self._pieces = np.zeros(0, dtype=np.int32)

    def _forward(self, units: list[str]):
        """(first place of each unit, first edge of each place, running sums of path weights, starts,
        pieces).

        The edges into a place are in the order of their starts; one that is no piece is the byte
        spelling of the character c before the place, written as -1 - c. Weights are divided by those of
        the paths to the place before, so that long units neither vanish nor overflow.
        """
        data = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        size = np.array([len(u) for u in units], dtype=np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        unit = owners(first)
        limit = first[1:][unit]
        # edges by length, shortest first
        found, start, node = [], np.arange(len(data)), np.zeros(len(data), dtype=np.int32)
        for n in range(1, self.longest + 1):
            inside = start + n <= limit[start]
            start, node = start[inside], node[inside]
            node = self.trie.step(node, data[start + n - 1])
            start, node = start[node >= 0], node[node >= 0]
            piece = self.trie.piece[node]
            whole = piece >= 0
            if n == 1:
                alone = np.ones(len(data), dtype=bool)
                alone[start[whole]] = False
                spelt = np.flatnonzero(alone)
                found.append((1, spelt, (-1 - data[spelt]).astype(np.int32)))
            found.append((n, start[whole], piece[whole]))
            if not len(start):
                break
        count = np.zeros(len(data), dtype=np.int64)
        for n, start, _ in found:
            count[start + n - 1] += 1  # a place has one edge of a length
        begin = np.concatenate([[0], np.cumsum(count)])
        origin = np.empty(begin[-1], dtype=np.int64)
        pieces = np.empty(begin[-1], dtype=np.int32)
        filled = begin[:-1].copy()
        for n, start, piece in reversed(found):
            at = filled[start + n - 1]
            origin[at], pieces[at] = start, piece
            filled[start + n - 1] += 1
        weight = self.weights[np.maximum(pieces, 0)]
        spelt = np.flatnonzero(pieces < 0)
        code = -1 - pieces[spelt].astype(np.int64)
        weight[spelt] = SPELLED ** (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))

        # total weight by place, a place 0 for each unit
        total, sums = np.ones(len(data) + len(units)), np.empty(len(origin))
        source = origin + unit[origin]
        order = np.argsort(-size, kind="stable")
        ranked = -size[order]
        for k in range(int(size.max(initial=0))):
            who = order[:np.searchsorted(ranked, -k)]  # units of more than k characters
            place = first[who] + k
            run, edges = np.zeros(len(who)), count[place]
            for j in range(int(edges.max())):
                some = np.flatnonzero(edges > j)
                at = begin[place[some]] + j
                run[some] += total[source[at]] * weight[at]
                sums[at] = run[some]
            total[place + who + 1] = run
            for i in np.flatnonzero(run < 1e-120):  # only ratios matter: lift the places in reach
                end = place[i] + who[i] + 1
                total[max(end - self.longest, first[who[i]] + who[i]):end + 1] /= run[i]
        return first, begin, sums, (origin - first[unit[origin]]).astype(np.int32), pieces

    def _learn(self, units: list[str]) -> None:
        first, begin, sums, starts, pieces = self._forward(units)
        self._unit.update(zip(units, range(len(self._unit), len(self._unit) + len(units))))
        self._first = np.concatenate([self._first, self._first[-1] + first[1:]])
        self._begin = np.concatenate([self._begin, self._begin[-1] + begin[1:]])
        self._sums = np.concatenate([self._sums, sums])
        self._starts = np.concatenate([self._starts, starts])
        self._pieces = np.concatenate([self._pieces, pieces])

    def _backward(self, units: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all units, number of pieces of each): one path through every unit."""
        at = self._first[units + 1] - self._first[units]
        number = np.zeros(len(units), dtype=np.int64)
        steps, active = [], np.flatnonzero(at)
        while len(active):
            place = self._first[units[active]] + at[active] - 1
            edge, last = self._begin[place], self._begin[place + 1] - 1
            draw = (mix(seeds[active] + np.uint64(len(steps))) >> np.uint64(11)) * 2.0 ** -53
            wanted = draw * self._sums[last]
            # the last edge takes what rounding leaves of the total
            open_ = np.flatnonzero(edge < last)
            while len(open_):
                open_ = open_[self._sums[edge[open_]] <= wanted[open_]]
                edge[open_] += 1
                open_ = open_[edge[open_] < last[open_]]
            steps.append((active, self._pieces[edge]))
            number[active] += 1
            at[active] = self._starts[edge]
            active = active[at[active] > 0]
        ends = np.cumsum(number)
        out = np.empty(ends[-1] if len(ends) else 0, dtype=np.int32)
        for k, (who, piece) in enumerate(steps):
            out[ends[who] - 1 - k] = piece
        spelt = np.flatnonzero(out < 0)
        if len(spelt):
            raw = [chr(c).encode() for c in (-1 - out[spelt].astype(np.int64)).tolist()]
            size = np.ones(len(out), dtype=np.int64)
            size[spelt] = [len(x) for x in raw]
            number = np.bincount(np.repeat(np.arange(len(units)), number), weights=size,
                                 minlength=len(units)).astype(np.int64)
            where = np.repeat(out < 0, size)
            out = np.repeat(out, size)
            out[where] = np.array(self.byte_ids, dtype=np.int32)[
                np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return out, number

    def sample_many(self, values: list[str], keys: list, seed: int = 42) -> list[np.ndarray]:
        """Piece ids of one path through every text's lattice, drawn with its row key as seed."""
        split = [self._split(" " + v) if v else [] for v in values]
        new = set().union(*split).difference(self._unit)
        if len(self._unit) + len(new) > CACHE or len(self._sums) > CACHE_EDGES:
            self._forget()
            new = set().union(*split)
        if new:
            self._learn(list(new))
        size = np.array([len(x) for x in split], dtype=np.int64)
        units = np.fromiter(map(self._unit.__getitem__, chain.from_iterable(split)), np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        own = np.array([int.from_bytes(blake2b(
            f"{seed}:{'null' if k is None else k}".encode(), digest_size=8).digest(), "little")
            for k in keys], dtype=np.uint64)
        row = owners(first)
        seeds = mix(mix(own[row]) ^ (np.arange(len(units)) - first[row]).astype(np.uint64))
        made = [self._backward(units[k:k + STEP], seeds[k:k + STEP])
                for k in range(0, len(units), STEP)]
        ids = np.concatenate([np.zeros(0, np.int32), *[m[0] for m in made]])
        ends = np.cumsum(np.concatenate([[0], *[m[1] for m in made]]))
        return [ids[a:b] for a, b in zip(ends[first[:-1]].tolist(), ends[first[1:]].tolist())]

    def sample(self, value: str, key: object, seed: int = 42) -> np.ndarray:
        """Piece ids of one text."""
        return self.sample_many([value], [key], seed)[0]

    def _split(self, value: str) -> list[str]:
        found = self.units.findall(value)
        if max(map(len, found)) <= LONGEST:
            return found
        return [u[k:k + LONGEST] for u in found for k in range(0, len(u), LONGEST)]

    def decode(self, ids) -> str:
        """The text that was encoded."""
        raw = self.raw
        return b"".join([raw[i] for i in ids]).decode()[1:]


_LATTICES: dict[tuple, Lattice] = {}


def lattice(path: str, alpha: float) -> Lattice:
    """The worker's lattice for a model file."""
    if (path, alpha) not in _LATTICES:
        _LATTICES[path, alpha] = Lattice(path, alpha)
    return _LATTICES[path, alpha]


def segmentations(docs: DataFrame, path: str, alpha: float = 1.0, seed: int = 42) -> DataFrame:
    """(doc_id, n_chars, n_pieces, lossless, pieces) of every row; lossless says whether decoding
    the pieces gave the text back."""
    def run(batches):
        known = lattice(path, alpha)
        for batch in batches:
            keys, texts, low = batch.column(0).to_pylist(), batch.column(1), 0
            while low < len(keys):
                high, chars, some = low, 0, []
                while high < len(keys) and chars < BATCH:
                    some.append(texts[high].as_py() or "")
                    chars += len(some[-1])
                    high += 1
                found = known.sample_many(some, keys[low:high], seed)
                same = [known.decode(x.tolist()) == v for x, v in zip(found, some)]
                lengths = np.array([len(x) for x in found], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low),
                     pa.array([len(v) for v in some], pa.int64()), pa.array(lengths),
                     pa.array(same, pa.bool_()),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))],
                    names=["doc_id", "n_chars", "n_pieces", "lossless", "pieces"])
                low = high

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_chars long, n_pieces long, lossless boolean, pieces array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, pieces); rows without pieces decode to the empty text."""
    def run(batches):
        known = lattice(path, 1.0)
        for batch in batches:
            texts = [known.decode(x.as_py() or []) if x.as_py() else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])
    return encoded.select("doc_id", "pieces").mapInArrow(run, "doc_id long, text string")
