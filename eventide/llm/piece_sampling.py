"""Distinct sampled segmentations of texts into sentence pieces, and their decoding.

Gumbel top-k without replacement: every segmentation of a text has its log-probability
plus Gumbel noise, and the k largest are k samples without replacement.  They are found by best-first search
over the lattice without making the others: a set of segmentations
with total probability p has a largest perturbed value that is Gumbel around log p, and
splitting the set splits that value, one part keeping it and the others being
bounded by it.  The search starts with the set of all and descends to one segmentation; at each
piece of its path the alternatives stay behind as one set with a value of its own.  The next
sample comes from the set with the largest value.  The value of the best set that is left after k samples
is the threshold of the inclusion scores: P(included) = 1 - exp(-exp(log p - threshold)).

The weights of pieces: a model file of this kind holds ranks, so a piece of rank r weighs as
Zipf's law has it, 1 / (r + ``SHIFT``); characters that no piece covers become byte pieces with a
small weight.  Pieces that the model never joins (runs of space marks) are left out, but for the single
mark.  Probabilities are normalised over the segmentations of the text.

No piece reaches over a space mark or a line end, so the lattice falls into those of the stretches
between, which are built once for all their repetitions in a batch, in NumPy.  The rows of a batch are searched
side by side, sample by sample: the sets that their newest samples leave behind are valued together.  Noise is a hash of the
seed, the row's key, the sample and the place: a row gets the same samples wherever it is
processed.  A set is passed over only if double precision has no noise large enough to let it win.

Defined cases: a null or empty text has one segmentation, the empty one; a text with fewer than k
segmentations returns all, with inclusion 1; rows with the same key and text
return the same samples; a space mark in a text decodes as a space.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

MARK, SHIFT, BATCH_BYTES = "▁", 2.7, 3 << 20
STRETCH = re.compile(f"{MARK}[^{MARK}\n]*|\n|[^{MARK}\n]+")
#: The largest Gumbel noise that a double below 1 can give.
MOST_NOISE = 36.8
#: The places of a new sample that are looked at before it is known how far its sets may still be wanted.
BLOCK = 48
BASE = np.uint64(0x100000001B3)
ALL = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of each 64-bit number."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mixed_one(x: int) -> int:
    """``mixed`` of one number, without the cost of an array."""
    x = (x + 0x9E3779B97F4A7C15) & ALL
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from hashes."""
    return ((mixed(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """The vocabulary of a model file, with a table of all prefixes of its pieces."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.bytes_at = next(i for i in range(n) if model.is_byte(i))
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and (model.get_score(i) > -1e8 or model.id_to_piece(i) == MARK)]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        self.log_weight = np.full(n, -np.log(len(plain) + SHIFT) - np.log(256.0))
        self.log_weight[plain] = -np.log(np.arange(len(plain)) + SHIFT)
        self.raw = [bytes([i - self.bytes_at]) if model.is_byte(i) else b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.texts = pa.array(self.raw, pa.binary())
        ids: dict[str, int] = {}
        for i in plain:
            piece = model.id_to_piece(i)
            ids[piece] = i
            for k in range(1, len(piece)):
                ids.setdefault(piece[:k], -1)
        with np.errstate(over="ignore"):
            keys = np.array([self._hash(p) for p in ids], np.uint64)
        self.single = np.full(0x110000, -2, np.int32)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.single[ord(piece)] = i
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(ids.values()), np.int64)[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self._slot(self.keys)] = True

    @staticmethod
    def _hash(piece: str) -> np.uint64:
        h = np.uint64(0)
        for c in piece:
            h = (h + np.uint64(ord(c) + 1)) * BASE
        return h

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The id of each hashed string, -1 for a mere prefix of pieces, -2 for neither."""
        found = np.full(len(h), -2, np.int64)
        at = np.flatnonzero(self.maybe[self._slot(h)])
        i = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[i] == h[at]
        found[at[hit]] = self.ids[i[hit]]
        return found

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """The text of the pieces, in UTF-8, without the mark that encoding puts first."""
        if not len(ids):
            return b""
        _, ends, data = self.texts.take(pa.array(ids)).buffers()
        return data.to_pybytes()[1 : int(np.frombuffer(ends, np.int32, 1, 4 * len(ids))[0])]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Pieces:
    """A worker's vocabulary, kept from task to task."""
    return Pieces(path)


@dataclass
class Lattice:
    """The stretches of a batch: nodes are places between characters, edges are pieces.

    The edges of a node stand together, with the probability of each given the node,
    summed up in ``cum``.  An edge of several byte pieces has a negative ``piece``.
    """

    start: np.ndarray
    first: np.ndarray
    degree: np.ndarray
    to: np.ndarray
    piece: np.ndarray
    log_q: np.ndarray
    cum: np.ndarray
    last: np.ndarray
    source: np.ndarray
    chars: np.ndarray


def lattice(stretches: list[str], pieces: Pieces) -> Lattice:
    lengths = np.array([len(s) for s in stretches], np.int64)
    start = np.cumsum(lengths + 1) - lengths - 1
    nodes = int((lengths + 1).sum())
    chars = np.zeros(nodes, np.uint32)
    inner = np.ones(nodes, bool)
    inner[start + lengths] = False
    chars[inner] = np.frombuffer("".join(stretches).encode("utf-32-le"), np.uint32)
    end = np.repeat(start + lengths, lengths + 1)
    found_at, found_ids = [], []
    at = np.flatnonzero(inner)
    h, size = np.zeros(len(at), np.uint64), 0
    alone = np.zeros(nodes, bool)
    while len(at):
        h = (h + chars[at + size].astype(np.uint64) + np.uint64(1)) * BASE
        size += 1
        found = pieces.find(h) if size > 1 else pieces.single[chars[at]]
        is_piece = found >= 0
        begins = at[is_piece]
        found_at.append((begins, size))
        found_ids.append(found[is_piece])
        if size == 1:
            alone[begins] = True
        more = (found >= -1) & (at + size < end[at])
        at, h = at[more], h[more]
    # a character that is no piece goes by its bytes; one byte is one piece, more are told by the place
    bare = np.flatnonzero(inner & ~alone)
    found_at.append((bare, 1))
    found_ids.append(np.where(chars[bare] < 128, chars[bare].astype(np.int64) + pieces.bytes_at, -1))
    degree = np.zeros(nodes, np.int64)
    for begins, _ in found_at:
        degree[begins] += 1
    first = np.cumsum(degree) - degree
    edges = int(degree.sum())
    # numbers are kept narrow, since paths read them all over
    kind = np.int32 if max(nodes, edges) < 1 << 31 else np.int64
    to, piece = np.empty(edges, kind), np.empty(edges, np.int32)
    free = first.copy()
    for (begins, size), found in zip(found_at, found_ids, strict=True):
        e = free[begins]
        to[e], piece[e] = begins + size, found
        free[begins] += 1
    source = np.repeat(np.arange(nodes, dtype=kind), degree)
    weight = pieces.log_weight[np.maximum(piece, 0)]
    wide = np.flatnonzero(piece < 0)
    code = chars[source[wide]]
    weight[wide] = (1 + (code >= 0x80).astype(int) + (code >= 0x800) + (code >= 0x10000)) * pieces.log_weight[pieces.bytes_at]
    # log-sums of the weights from each node to its end, from the last characters to the first
    total = np.zeros(nodes)
    distance = end - np.arange(nodes)
    # NumPy sorts 16 bits by radix
    by_distance = np.argsort(distance.astype(np.uint16) if lengths.max(initial=0) < 1 << 16 else distance, kind="stable")
    cuts = np.searchsorted(distance[by_distance], np.arange(1, int(lengths.max(initial=0)) + 2))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        level = by_distance[a:b]
        n = degree[level]
        begin = np.cumsum(n) - n
        e = np.repeat(first[level] - begin, n) + np.arange(int(n.sum()))
        value = weight[e] + total[to[e]]
        top = np.maximum.reduceat(value, begin)
        total[level] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, n)), begin))
    log_q = weight + total[to] - total[source]
    q = np.exp(log_q)
    run = np.cumsum(q)
    some = degree > 0
    cum = run - np.repeat((run - q)[first[some]], degree[some])
    last = first + degree - 1
    return Lattice(start, first.astype(kind), degree.astype(kind), to, piece, log_q, cum, last.astype(kind), source, chars)


def descend(lat: Lattice, stretch: np.ndarray, noise: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sampled path through each stretch: all edges in a row, and the number of each stretch's edges."""
    node, active = lat.start[stretch], np.arange(len(stretch))
    active = active[lat.degree[node] > 0]
    steps = []
    size = np.zeros(len(stretch), np.int64)
    step = 0
    while len(active):
        here = node[active]
        u = uniform(noise[active] + np.uint64(step))
        e, last = lat.first[here], lat.last[here]
        rest = np.flatnonzero((lat.cum[e] < u) & (e < last))
        while len(rest):
            e[rest] += 1
            rest = rest[(lat.cum[e[rest]] < u[rest]) & (e[rest] < last[rest])]
        steps.append((active, e))
        node[active] = lat.to[e]
        size[active] += 1
        active = active[lat.degree[lat.to[e]] > 0]
        step += 1
    at = np.cumsum(size) - size
    edges = np.zeros(int(size.sum()), lat.first.dtype)
    for k, (who, e) in enumerate(steps):
        edges[at[who] + k] = e
    return edges, size


def bounded_gumbel(location: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values around each location, given that they are below the bounds."""
    return location - np.log(np.exp(location - bound) - np.log(u))


@dataclass
class Sample:
    """Edges of a path and their log-probabilities, where its stretches end in them, its log-probability and its perturbed value.

    ``prefix``, what the edges before each place sum up to, is held until the sets that it leaves behind are valued.
    """

    edges: np.ndarray
    log_q: np.ndarray
    ends: np.ndarray
    log_p: float
    value: float
    prefix: np.ndarray | None


class Row:
    """The best-first search of one text: ``first`` makes a sample, ``following`` the next ones, ``explore`` values their sets."""

    def __init__(self, lat: Lattice, key: np.uint64, k: int):
        self.lat, self.key, self.k = lat, int(key), k
        self.heap: list[tuple] = []
        self.samples: list[Sample] = []

    def base(self, sample: int, kind: int) -> int:
        return mixed_one(self.key ^ ((sample << 44) + (kind << 36)))

    def noise(self, sample: int, kind: int, place: int = 0) -> float:
        """A number in (0, 1) for one use at one place."""
        return ((mixed_one((self.base(sample, kind) + place) & ALL) >> 11) + 0.5) * 2.0**-53

    def first(self, edges: np.ndarray, log_q: np.ndarray, ends: np.ndarray) -> int:
        """Keeps the first sample; the place from which it leaves sets behind."""
        self.add(edges, log_q, ends, -math.log(-math.log(self.noise(0, 0))))
        return 0

    def following(self, edges: np.ndarray, log_q: np.ndarray, ends: np.ndarray) -> int | None:
        """The next sample: the best set's alternative, then the fresh path of the later stretches; the place from which it leaves sets behind."""
        if not self.heap:
            return None
        value, parent, place, excluded, prefix = heapq.heappop(self.heap)
        old, number = self.samples[parent], len(self.samples)
        node = self.lat.source[old.edges[place]]
        rest = [e for e in range(self.lat.first[node], self.lat.first[node] + self.lat.degree[node]) if e not in excluded]
        chosen = self.pick(rest, self.noise(number, 1))
        own, node = [chosen], self.lat.to[chosen]
        while self.lat.degree[node]:
            choices = range(self.lat.first[node], self.lat.first[node] + self.lat.degree[node])
            own.append(self.pick(list(choices), self.noise(number, 2, len(own))))
            node = self.lat.to[own[-1]]
        within = int(np.searchsorted(old.ends, place, side="right"))
        skipped = ends[within]
        after = place + len(own)
        self.add(
            np.concatenate([old.edges[:place], np.array(own, edges.dtype), edges[skipped:]]),
            np.concatenate([old.log_q[:place], self.lat.log_q[own], log_q[skipped:]]),
            np.concatenate([old.ends[:within], [after], ends[within + 1 :] - skipped + after]),
            -value,
        )
        excluded = excluded | {chosen}
        left = 1 - sum(math.exp(self.lat.log_q[e]) for e in excluded)
        if len(excluded) < self.lat.degree[self.lat.source[chosen]] and left > 1e-15:
            location = prefix + math.log(left)
            self.push(location - math.log(math.exp(location + value) - math.log(self.noise(number, 3))), number, place, excluded, prefix)
        return place + 1

    def add(self, edges: np.ndarray, log_q: np.ndarray, ends: np.ndarray, value: float) -> None:
        prefix = np.zeros(len(edges) + 1)
        np.cumsum(log_q, out=prefix[1:])
        self.samples.append(Sample(edges, log_q, ends, float(prefix[-1]), value, prefix))

    def pick(self, edges: list[int], u: float) -> int:
        if len(edges) == 1:
            return edges[0]
        q = np.cumsum(np.exp(self.lat.log_q[edges]))
        return edges[min(int(np.searchsorted(q, u * q[-1])), len(edges) - 1)]

    def push(self, value: float, number: int, place: int, excluded: frozenset, prefix: float) -> None:
        heapq.heappush(self.heap, (-float(value), number, place, excluded, prefix))

    def floor(self) -> float:
        """The value that a set needs to be among those still wanted, the threshold's set included."""
        wanted = self.k + 1 - len(self.samples)
        if wanted == 1 and self.heap:
            return -self.heap[0][0]
        return -heapq.nsmallest(wanted, self.heap)[-1][0] if len(self.heap) >= wanted > 0 else -np.inf

    def log_inclusion(self, sample: Sample) -> float:
        if not self.heap:
            return 0.0
        x = np.exp(min(sample.log_p + self.heap[0][0], 700.0))
        return float(np.log(-np.expm1(-x))) if x > 1e-12 else float(sample.log_p + self.heap[0][0])

    def ids(self, sample: Sample, pieces: Pieces) -> np.ndarray:
        """The piece ids of a sample, edges of several bytes spelled out."""
        found = self.lat.piece[sample.edges]
        wide = np.flatnonzero(found < 0)
        if not len(wide):
            return found
        parts, done = [], 0
        for i in wide.tolist():
            spelled = chr(self.lat.chars[self.lat.source[sample.edges[i]]]).encode()
            parts += [found[done:i], np.frombuffer(spelled, np.uint8).astype(np.int64) + pieces.bytes_at]
            done = i + 1
        return np.concatenate([*parts, found[done:]])


def explore(rows: list[Row], since: list[int]) -> None:
    """Puts on each row's heap the sets that its newest sample leaves behind from place ``since`` on and that may still be wanted."""
    near = [(row, a, min(len(row.samples[-1].edges), a + BLOCK)) for row, a in zip(rows, since, strict=True)]
    left_behind(near)
    far = []
    for row, _, to in near:
        prefix, floor = row.samples[-1].prefix[:-1], row.floor()
        if to < len(prefix) and prefix[to] + MOST_NOISE >= floor:
            far.append((row, to, to + int(np.searchsorted(-prefix[to:], MOST_NOISE - floor + 1e-9, side="right"))))
    left_behind(far)
    for row in rows:
        row.samples[-1].prefix = None


def left_behind(spans: list[tuple[Row, int, int]]) -> None:
    """Values the sets of each row's newest sample between two places, and pushes the best of those that reach the row's floor."""
    spans = [(row, row.samples[-1], a, b) for row, a, b in spans if a < b]
    if not spans:
        return
    lat, k = spans[0][0].lat, spans[0][0].k
    edges = np.concatenate([s.edges[a:b] for _, s, a, b in spans])
    sizes, since = np.array([b - a for _, _, a, b in spans]), np.array([a for _, _, a, _ in spans])
    at = np.flatnonzero(lat.degree[lat.source[edges]] > 1)
    who = np.repeat(np.arange(len(spans)), sizes)[at]
    places = at - (np.cumsum(sizes) - sizes - since)[who]
    edges, log_q, prefix = edges[at], np.concatenate([s.log_q[a:b] for _, s, a, b in spans])[at], np.concatenate([s.prefix[a:b] for _, s, a, b in spans])[at]
    bases = np.array([row.base(len(row.samples) - 1, 4) for row, *_ in spans], np.uint64)
    left = np.log(np.maximum(-np.expm1(log_q), 1e-300))
    values = bounded_gumbel(prefix + left, np.array([s.value for _, s, _, _ in spans])[who], uniform(bases[who] + places.astype(np.uint64)))
    wanted = np.flatnonzero(values >= np.array([row.floor() for row, *_ in spans])[who])
    order = wanted[np.lexsort((-values[wanted], who[wanted]))]
    # of one sample no more than k + 1 sets can be wanted
    best = order[np.arange(len(order)) - np.searchsorted(who[order], who[order]) <= k]
    for i, place, value, edge, before in zip(who[best].tolist(), places[best].tolist(), values[best].tolist(), edges[best].tolist(), prefix[best].tolist(), strict=True):
        row = spans[i][0]
        row.push(value, len(row.samples) - 1, place, frozenset([edge]), before)


class Numbers(dict):
    """Numbers stretches as they come."""

    def __missing__(self, stretch: str) -> int:
        self[stretch] = n = len(self)
        return n


def sampled(texts: list[str], keys: np.ndarray, pieces: Pieces, k: int) -> Iterator[Row]:
    """The finished search of each text, in order."""
    numbers = Numbers()
    number = numbers.__getitem__
    rows = [np.fromiter(map(number, STRETCH.findall(MARK + t.replace(" ", MARK))), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    lat = lattice(list(numbers), pieces)
    stretch = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    sizes = np.array([len(r) for r in rows], np.int64)
    ends = np.cumsum(sizes)
    ordinal = (np.arange(len(stretch)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)
    owner = np.repeat(keys, sizes)
    found = [Row(lat, key, k) for key in keys]
    spans = list(zip(found, (ends - sizes).tolist(), ends.tolist(), strict=True))
    for r in range(k):
        edges, counts = descend(lat, stretch, mixed(owner ^ mixed(ordinal + np.uint64((r + 1) << 40))))
        log_q, at = lat.log_q[edges], np.concatenate([[0], np.cumsum(counts)])
        going, since = [], []
        for row, a, b in spans:
            begin, end = int(at[a]), int(at[b])
            fresh = edges[begin:end], log_q[begin:end], at[a + 1 : b + 1] - begin
            place = row.following(*fresh) if r else row.first(*fresh)
            if place is not None:
                going.append((row, a, b))
                since.append(place)
        spans = going
        explore([row for row, _, _ in spans], since)
    yield from found


def sample_segmentations(docs: DataFrame, model: str, k: int = 2, seed: int = 3, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, packed: bool = False) -> DataFrame:
    """(id_col, sample, n_pieces, ids_crc32, log_prob, perturbed, log_inclusion, round_trip, ids): k distinct samples of each row.

    ``sample`` counts from 0 by falling perturbed value; ``round_trip`` tells whether the
    pieces decode to the text; ``ids`` is left out if not asked for, and little-endian 32-bit numbers in a binary if ``packed``.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("sample", pa.int32()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_()), *([("ids", pa.binary() if packed else pa.list_(pa.int32()))] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = vocabulary(model)
        for batch in batches:
            lengths = np.diff(np.frombuffer(batch.column(2).buffers()[1], np.int32, batch.num_rows + 1, 4 * batch.column(2).offset)) if batch.num_rows else np.zeros(0)
            cut = np.flatnonzero(np.diff(np.cumsum(lengths) // BATCH_BYTES)) + 1
            for part in np.split(np.arange(batch.num_rows), cut):
                if len(part):
                    yield one(batch.slice(int(part[0]), len(part)), pieces)

    def one(batch: pa.RecordBatch, pieces: Pieces) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        keys = np.array([xxhash.xxh64_intdigest(x.encode(), seed) for x in batch.column(1).to_pylist()], np.uint64)
        at, columns = [], [[] for _ in fields]
        for i, row in enumerate(sampled(texts, keys, pieces, k)):
            plain = texts[i].replace(MARK, " ").encode()
            for j, sample in enumerate(row.samples):
                ids = row.ids(sample, pieces)
                at.append(i)
                raw = ids.astype("<u4").tobytes()
                values = (j, len(ids), zlib.crc32(raw), sample.log_p, sample.value, row.log_inclusion(sample), pieces.decode(ids) == plain, *([raw if packed else ids.astype(np.int32)] if with_ids else []))
                for column, value in zip(columns, values, strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True))], names=["id", *(n for n, _ in fields)])

    raw = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), text_or_empty(text_col).alias("data"))
    schema = f"id {kind}, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, round_trip boolean" + (f", ids {'binary' if packed else 'array<int>'}" if with_ids else "")
    return raw.mapInArrow(run, schema).withColumnRenamed("id", id_col)
