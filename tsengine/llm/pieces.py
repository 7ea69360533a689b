"""SentencePiece encoding, decoding and sampling of segmentations without replacement.

Encoding. No piece of a text runs over two letters in a row that are in no piece of the vocabulary, nor past a space that
follows something else (checked when the vocabulary is loaded). So a text is cut there into its chunks; every distinct
chunk is encoded once a worker by the library's own processor, and a text's ids are its chunks' ids in order. Where the
library changes texts before it encodes them, or doesn't merge pairs, they are cut at spaces only.

Sampling. Every chunk has a lattice: positions, and pieces that lead from one to a later one. A piece's weight follows
its rank in the vocabulary (Zipf's law, to the power ``alpha``); characters without a piece are spelled in byte pieces.
A segmentation's log-probability is the sum of its pieces' weights less the lattice's normaliser. The ``k`` segmentations
with the largest Gumbel-perturbed log-probabilities are a sample without replacement; a best-first (A-star) search finds
them without listing the rest: the normaliser of what can still follow is the search's exact bound, the perturbed maximum
of a subtree is known before it is opened, and only the best one is. A subtree's largest value is drawn under its
parent's; which way reaches it is drawn apart from the value, so that all texts of a batch are walked at once.

Emitted are each sample's ids, log-probability and log inclusion probability, given the (k+1)-th perturbed value: their
ratio weighs an estimate over segmentations. Random numbers are hashes of the row's key, the sample, the chunk and
the step: the same row gives the same samples wherever it runs.

Defined results: null text is empty: it has no pieces and one segmentation, the empty one; a text with fewer than k
segmentations gives all of them, each with inclusion 1; null keys share one seed; equal rows give equal results. U+2581
reads back as a space. Texts of any length are taken whole. Only the named columns are read.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm.common import chunks, new_name, once_per_worker, table

SPACE = "▁"
SAMPLES, ALPHA, FAR = 2, 0.6, 38.0
#: Lattice edges that a worker remembers. The first half stays: frequent chunks come early.
REMEMBERED = 8_000_000
#: Chunks learned, and bytes of texts sampled, at a time: few enough for a processor's cache to hold their arrays.
LEARNED, SAMPLED_BYTES = 2048, 200_000
#: Bytes of texts cut at a time: their distinct chunks are looked up once.
CUT_BYTES = 1_000_000
#: Bits of the table of letter pairs. Pairs that share an entry with one in a piece are only left uncut.
PAIR_BITS = 20
U64 = np.uint64
BEGIN = U64(0x9E3779B97F4A7C15)


def mixed(h, *parts) -> np.ndarray:
    """A hash of whole numbers, begun or carried on (the splitmix64 finaliser, a fixed public mix)."""
    with np.errstate(over="ignore"):
        for p in parts:
            h = np.asarray(p).astype(U64) + h
            h *= U64(0xBF58476D1CE4E5B9)
            h ^= h >> U64(27)
            h *= U64(0x94D049BB133111EB)
            h ^= h >> U64(31)
    return h


def uniform(h, *parts) -> np.ndarray:
    """Uniform numbers in (0, 1) that depend on whole numbers alone."""
    u = (mixed(h, *parts) >> U64(11)).astype(np.float64)
    u += 0.5
    u *= 2.0**-53
    return u


def below(bound, mass, u):
    """A Gumbel value with log-mass ``mass``, given that it is at most ``bound``."""
    return bound - np.logaddexp(0.0, bound - mass + np.log(-np.log(u)))


class Lattices:
    """Distinct chunks' lattices, one after the other, as flat arrays; and the chunks' own encodings."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_proto=model)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        usual = [i for i in range(len(names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) for i in usual):
            raise ValueError("a piece runs past a space: texts can't be cut into chunks")
        self.weight = -alpha * np.log(np.arange(len(names)) + 2.0)
        self.byte = {int(names[i][3:5], 16): i for i in range(len(names)) if sp.is_byte(i)}
        self.spelled = [bytes([int(n[3:5], 16)]) if sp.is_byte(i) else n.encode() for i, n in enumerate(names)]
        self.spelled_size = np.array([len(x) for x in self.spelled], np.int64)
        self._trie([(names[i], i) for i in usual])
        self.mark = self.byte.get(10) if merges_alone(model) and not any(len(n) > 1 and "\n" in n for n in names) else None
        inside = np.array([(ord(a), ord(b)) for n in names for a, b in zip(n, n[1:], strict=False)], np.uint32).reshape(-1, 2)
        self.joined = np.zeros(1 << PAIR_BITS, bool)
        self.joined[self.pair(inside[:, 0], inside[:, 1])] = True
        self.clear()

    @staticmethod
    def pair(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The place of two letters in the table of pairs."""
        h = one * np.uint32(0x9E3779B1)
        h += two * np.uint32(0x85EBCA77)
        h >>= np.uint32(32 - PAIR_BITS)
        return h

    def cut(self, codes: np.ndarray) -> np.ndarray:
        """Whether a chunk begins at a letter, for all but the first one; spaces are U+2581."""
        one, two = codes[:-1], codes[1:]
        if self.mark is None:
            return (two == ord(SPACE)) & (one != ord(SPACE))
        begins = ~self.joined[self.pair(one, two)]
        line = codes == ord("\n")  # alone, whatever shares its pairs' entries
        begins |= line[:-1]
        begins |= line[1:]
        return begins

    def _trie(self, pieces: list[tuple[str, int]]) -> None:
        """Pieces as a tree of characters: a hash table of (node, character) keys, the node that each leads to, and its piece or -1."""
        self.letters = np.array(sorted({ord(c) for name, _ in pieces for c in name}), np.int64)
        self.letter = np.full(0x110000, -1, np.int32)
        self.letter[self.letters] = np.arange(len(self.letters))
        number = {c: i for i, c in enumerate(self.letters.tolist())}
        ways, ends = {}, [-1]
        for name, i in pieces:
            node = 0
            for c in name:
                key = node * len(self.letters) + number[ord(c)]
                if key not in ways:
                    ways[key] = len(ends)
                    ends.append(-1)
                node = ways[key]
            ends[node] = i
        bits = (4 * len(ways)).bit_length()
        self.shift = U64(64 - bits)
        self.ways, self.way_to = (np.full((1 << bits) + len(ways) + 1, -1, np.int64) for _ in range(2))
        keys = np.array(list(ways), np.int64)
        for key, place in zip(keys.tolist(), self.place(keys).tolist(), strict=True):
            while self.ways[place] >= 0:
                place += 1
            self.ways[place], self.way_to[place] = key, ways[key]
        self.root = np.array([ways.get(i, -1) for i in range(len(self.letters))], np.int64)
        self.ends = np.array(ends, np.int64)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(U64) * BEGIN >> self.shift).view(np.int64)

    def lead(self, keys: np.ndarray) -> np.ndarray:
        """The nodes that (node, character) keys lead to, or -1."""
        place = self.place(keys)
        there = self.ways[place]
        other = np.flatnonzero((there != keys) & (there >= 0))
        while len(other):  # the table is mostly empty, so few look further
            place[other] += 1
            there = self.ways[place[other]]
            other = other[(there != keys[other]) & (there >= 0)]
        return np.where(self.ways[place] == keys, self.way_to[place], -1)

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self._room: dict[str, np.ndarray] = {}
        self.base = None
        for name, kind in (("whole", bool), ("start", np.int64), ("first", np.int64), ("cum", np.float32), ("log_p", np.float64), ("to", np.int32), ("piece", np.int32), ("ids", np.uint32), ("ids_from", np.int64)):
            setattr(self, name, np.zeros(0, kind))
        self._append("first", np.zeros(1, np.int64))
        self._append("ids_from", np.zeros(1, np.int64))

    def _append(self, name: str, values: np.ndarray) -> None:
        held = getattr(self, name)
        n = len(held) + len(values)
        room = self._room.get(name)
        if room is None or n > len(room):
            self._room[name] = room = np.empty(n * 3 // 2 + 1024, held.dtype)
            room[: len(held)] = held
        room[len(held) : n] = values
        setattr(self, name, room[:n])

    def _trim(self) -> None:
        """Forget all chunks but those of the first half."""
        n_chunks, n_nodes, n_edges = self.base
        self.at = {c: i for c, i in self.at.items() if i < n_chunks}
        self.ids_from = self.ids_from[: n_chunks + 1]
        self.ids = self.ids[: self.ids_from[-1]]
        self.whole, self.start, self.first = self.whole[:n_chunks], self.start[:n_chunks], self.first[: n_nodes + 1]
        self.cum, self.log_p, self.to, self.piece = (x[:n_edges] for x in (self.cum, self.log_p, self.to, self.piece))

    def spelled_in_bytes(self, code: int) -> list[int]:
        return [self.byte[b] for b in chr(code).encode("utf-8", "replace")]

    def edges(self, codes: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number from each position; to, piece, weight) between positions of chunks laid end to end, by from, then to; a piece below 0 is a character in bytes."""
        letter = self.letter[codes]
        at = np.flatnonzero(letter >= 0)
        node = self.root[letter[at]]
        at, node, length = at[node >= 0], node[node >= 0], 1
        piece = np.full(len(codes), -1, np.int64)
        piece[at] = self.ends[node]
        rows, per = [(np.arange(len(codes)), piece)], np.ones(len(codes), np.int64)
        while len(at):
            on = at + length < end[at]
            at, node = at.compress(on), node.compress(on)
            after = letter.take(at + length)
            on = after >= 0
            at, node, after = at.compress(on), node.compress(on), after.compress(on)
            node = self.lead(node * len(self.letters) + after)
            on = node >= 0
            at, node = at.compress(on), node.compress(on)
            length += 1
            ends = self.ends.take(node)
            on = ends >= 0
            rows.append((at.compress(on), ends.compress(on)))
            per[rows[-1][0]] += 1
        lone = np.flatnonzero(piece < 0)
        piece[lone] = -1 - codes[lone]
        free = per.cumsum() - per
        first_of = free.copy()
        n = per.sum()
        b, piece = np.empty(n, np.int64), np.empty(n, np.int64)
        for i, (at, ids) in enumerate(rows):  # each position is in a row once at most
            place = free[at]
            b[place], piece[place] = at + (i + 1), ids
            free[at] += 1
        weight = self.weight[np.maximum(piece, 0)]
        if len(lone):
            kinds, kind = np.unique(codes[lone], return_inverse=True)
            weight[first_of[lone]] = np.array([self.weight[self.spelled_in_bytes(c)].sum() for c in kinds.tolist()])[kind]
        return per, b, piece, weight

    def encoded(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of chunks, one after the other, and how many each has."""
        if self.mark is None:
            found = self.sp.encode([c[1:].replace(SPACE, " ") for c in fresh], num_threads=1)
            # A space at a text's end: the processor puts its own space only before something.
            found = [ids if len(c) > 1 else [self.sp.piece_to_id(SPACE)] for c, ids in zip(fresh, found, strict=True)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        # No piece holds a line's end and another letter, so chunks with one in front of each are encoded as if alone.
        ids = np.array(self.sp.encode("\n" + "\n".join(fresh)), np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        if "\n" in fresh:
            marks = np.delete(marks, fresh.index("\n") + 1)
        if len(marks) != len(fresh):
            raise ValueError("the processor doesn't keep line ends: chunks can't be told apart")
        inside = np.ones(len(ids), bool)
        inside[: marks[0]] = inside[marks] = False
        return ids[inside], np.diff(np.r_[marks, len(ids)]) - 1

    def learn(self, fresh: list[str]) -> None:
        together = "".join(fresh).replace(" ", SPACE)
        codes = np.frombuffer(together.encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        end = np.repeat(sizes.cumsum(), sizes)
        per, b, piece, weight = self.edges(codes, end)
        a = np.repeat(np.arange(len(codes)), per)
        first = per.cumsum() - per  # every position has an edge
        last = b == end[a]
        # The log-sum of all ways from a position to its chunk's end, from the last positions on.
        beta, left = np.zeros(len(codes) + 1), (end - np.arange(len(codes)))[a]
        order = np.argsort(left.astype(np.int16) if sizes.max() < 1 << 15 else left, kind="stable")
        cuts = np.flatnonzero(np.r_[True, left[order][1:] != left[order][:-1], True])
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            e = order[i:j]
            starts = np.flatnonzero(np.r_[True, a[e][1:] != a[e][:-1]])
            beta[a[e][starts]] = np.logaddexp.reduceat(weight[e] + np.where(last[e], 0.0, beta[b[e]]), starts)
        log_p = weight + np.where(last, 0.0, beta[b]) - beta[a]
        sums = np.exp(log_p).cumsum()
        within = sums - np.repeat(np.r_[0.0, sums[first[1:] - 1]], per)
        within[np.r_[first[1:] - 1, len(a) - 1]] = 1.0
        node = len(self.first) - 1
        ids, n_ids = self.encoded(fresh)
        spelled, plain = b"".join(map(self.spelled.__getitem__, ids.tolist())), together.encode()
        wide = np.r_[0, (1 + wider(codes)).cumsum(dtype=np.int64)][np.r_[0, sizes.cumsum()]]
        read = np.r_[0, self.spelled_size[ids].cumsum()][np.r_[0, n_ids.cumsum()]]
        if spelled == plain:
            whole = (wide[:-1] == read[:-1]) & (wide[1:] == read[1:])
        else:
            whole = np.array([spelled[r:r_] == plain[w:w_] for r, r_, w, w_ in zip(read[:-1].tolist(), read[1:].tolist(), wide[:-1].tolist(), wide[1:].tolist(), strict=True)], bool)
        self._append("whole", whole)
        self._append("ids", ids)
        self._append("ids_from", self.ids_from[-1] + n_ids.cumsum())
        self._append("start", node + sizes.cumsum() - sizes)
        self._append("first", self.first[-1] + per.cumsum())
        self._append("cum", np.minimum(within, 1.0))
        self._append("log_p", np.minimum(log_p, 0.0))
        self._append("piece", piece)
        self._append("to", np.where(last, -1, b + node))

    def add(self, distinct: list[str]) -> np.ndarray:
        """The places of distinct chunks, learning those not seen before."""
        if self.base and len(self.cum) > REMEMBERED:
            self._trim()
        elif not self.base and len(self.cum) > REMEMBERED // 2:
            self.base = len(self.whole), len(self.first) - 1, len(self.cum)
        at = np.fromiter(map(self.at.get, distinct, repeat(-1)), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        n = len(self.whole)
        fresh = [distinct[i] for i in missing.tolist()]
        for i in range(0, len(fresh), LEARNED):
            self.learn(fresh[i : i + LEARNED])
        at[missing] = np.arange(n, n + len(fresh))
        self.at.update(zip(fresh, range(n, n + len(fresh)), strict=True))
        return at

    def encoding(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (sizes[i] of the chunk places in flat), one after the other, and where each text's begin and end."""
        begin = self.ids_from[flat]
        n = self.ids_from[flat + 1] - begin
        ends = np.r_[0, n.cumsum()]
        return self.ids[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])].astype("<u4"), ends[np.r_[0, sizes.cumsum()]]

    def spell(self, ways: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of ways (arrays of edges)."""
        ends = np.r_[0, np.fromiter(map(len, ways), np.int64, len(ways)).cumsum()]
        ids = self.piece[np.concatenate(ways)] if ways else self.piece[:0]
        outside = np.flatnonzero(ids < 0)
        if len(outside):
            kinds, kind = np.unique(-1 - ids[outside], return_inverse=True)
            spelled = [self.spelled_in_bytes(c) for c in kinds.tolist()]
            size = np.ones(len(ids), np.int64)
            size[outside] = np.array([len(x) for x in spelled])[kind]
            ends, starts = np.r_[0, size.cumsum()][ends], size.cumsum() - size
            ids = np.repeat(ids, size)
            letters, begin = np.array(list(chain.from_iterable(spelled))), np.r_[0, np.cumsum([len(x) for x in spelled])][kind]
            for j in range(max(map(len, spelled))):
                on = outside[size[outside] > j]
                ids[starts[on] + j] = letters[begin[size[outside] > j] + j]
        ids = ids.astype("<u4")
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def ways_on(self, node: np.ndarray, base: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a way to the end for each walker: (number of edges of each, edges by walker and step)."""
        walkers, rows, taken = np.flatnonzero(node >= 0), [], np.zeros(len(node), np.int64)
        node, base = node.take(walkers), (base + depth.astype(U64)).take(walkers)
        while len(walkers):
            goal = uniform(base, len(rows))
            edge = self.first.take(node)
            behind = np.flatnonzero(self.cum.take(edge) <= goal)
            at, most = edge.take(behind), goal.take(behind)
            while len(behind):  # few edges leave a node, and the likely ones are near
                at += 1
                edge[behind] = at
                on = self.cum.take(at) <= most
                behind, at, most = behind.compress(on), at.compress(on), most.compress(on)
            rows.append((walkers, edge))
            node = self.to.take(edge)
            on = node >= 0
            taken[walkers.compress(~on)] = len(rows)
            walkers, node, base = walkers.compress(on), node.compress(on), base.compress(on)
        first = taken.cumsum() - taken
        edges = np.empty(taken.sum(), np.int64)
        for i, (walkers, edge) in enumerate(rows):  # a walker that is there in a round has been in all before
            edges[first.take(walkers) + i] = edge
        return taken, edges

    def steps(self, node: np.ndarray, depth: np.ndarray, taken: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The walker, step and node of each edge of walkers' whole ways."""
        first = taken.cumsum() - taken
        begins = first[taken > 0]
        nodes = np.empty(len(edges), np.int64)
        nodes[1:] = self.to[edges[:-1]]
        nodes[begins] = node[taken > 0]
        return np.repeat(np.arange(len(depth)), taken), np.arange(len(edges)) - np.repeat(first - depth, taken), nodes

    def walk(self, node: np.ndarray, base: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Draw a way to the end for each walker: (walker, step, node, edge), sorted by walker and step."""
        taken, edges = self.ways_on(node, base, depth)
        return *self.steps(node, depth, taken, edges), edges


def sample(held: Lattices, flat: np.ndarray, sizes: np.ndarray, seeds: list[int], k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text (sizes[i] of the chunk places in flat): up to k of (edges, log-probability, log inclusion probability)."""
    n_docs = len(sizes)
    base = np.r_[0, sizes.cumsum()]
    seed = np.array(seeds, U64)
    doc_of = np.repeat(np.arange(n_docs), sizes)
    # What each text has open: its best subtrees, as (-value, number, sample, place in its edges, node, edges left out, mass before)
    heaps, found, tick = [[] for _ in range(n_docs)], [[] for _ in range(n_docs)], count()
    top = -np.log(-np.log(uniform(BEGIN, seed, 0, 1, 2)))

    def emit(docs, prefixes, values, draw, first_word, depth, node):
        """Finish one segmentation in each of docs from a prefix (edges, log-mass, words done), and open what it passes by."""
        if not docs:
            return
        low = base[:-1][docs] + first_word
        n = base[1:][docs] - low
        which = np.repeat(np.arange(len(docs)), n)
        at = np.arange(len(which)) + (low - n.cumsum() + n)[which]
        begin, steps = held.start[flat[at]], np.zeros(len(at), np.int64)
        lead, node = (n.cumsum() - n)[n > 0], np.array(node, np.int64)[n > 0]
        begin[lead] = np.where(node == -2, begin[lead], node)
        steps[lead] = np.array(depth, np.int64)[n > 0]
        word = at - base[doc_of[at]]
        taken, edge = held.ways_on(begin, mixed(BEGIN, seed[doc_of[at]], draw, word), steps)
        log_p = held.log_p.take(edge)
        ends = np.r_[0, taken.cumsum()]  # of walkers, in edges
        bounds = np.r_[0, n.cumsum()]  # of texts, in walkers
        lead_mass, value = np.array([p[1] for p in prefixes]), np.array(values)
        # A text's mass before each of its walkers.
        before = np.r_[0.0, log_p.cumsum()][ends]
        before += np.r_[np.repeat(lead_mass - before[bounds[:-1]], n), 0.0]
        # A Gumbel value is less than its log-mass + FAR, and mass only falls along a way: what is further off can't be best.
        near = bounds[:-1] + np.bincount(which[before[:-1] > -2 * FAR], minlength=len(docs))
        full = [None] * len(docs)

        def perturb(some: np.ndarray, until: np.ndarray) -> np.ndarray:
            """Note what some texts open along their walkers up to one; which of them have enough."""
            size = until - bounds[some]
            walker = np.arange(size.sum()) + np.repeat(bounds[some] - size.cumsum() + size, size)
            long = taken[walker]
            r = np.arange(long.sum()) + np.repeat(ends[walker] - long.cumsum() + long, long)
            own, step, node_of = held.steps(begin[walker], steps[walker], long, edge[r])
            of = np.repeat(np.arange(len(some)), size)[own]
            walker, lost = walker[own], log_p[r]
            sums = lost.cumsum() - lost
            mass = before[walker] + sums - sums[long.cumsum() - long][own] if len(r) else sums
            ways = np.flatnonzero(held.first[node_of + 1] - held.first[node_of] > 1)
            rest = np.log(np.maximum(-np.expm1(lost[ways]), 1e-300))
            open_ = np.full(len(r), -np.inf)
            open_[ways] = below(value[which[walker[ways]]], mass[ways] + rest, uniform(BEGIN, seed[doc_of[at[walker[ways]]]], draw + 1000, word[walker[ways]], step[ways]))
            stops = np.searchsorted(of, np.arange(len(some) + 1)).tolist()
            for i, a, b in zip(some.tolist(), stops[:-1], stops[1:], strict=True):
                best = open_[a:b]
                chosen = a + (np.argpartition(-best, k)[: k + 1] if b - a > k + 1 else np.arange(b - a))
                full[i] = [(-open_[j], int(r[j] - ends[bounds[i]]), int(node_of[j]), (int(edge[r[j]]),), float(mass[j]), int(word[walker[j]]), int(step[j])) for j in chosen.tolist() if open_[j] > -np.inf]
            return np.bincount(of[open_ > -FAR], minlength=len(some)) > k

        some = np.arange(len(docs))
        more = np.flatnonzero(~perturb(some, near) & (near < bounds[1:]))
        if len(more):
            perturb(more, bounds[1:][more])
        stops = ends[bounds].tolist()
        for i, d in enumerate(docs):
            a, b = stops[i], stops[i + 1]
            total = prefixes[i][1] + log_p[a:b].sum()
            found[d].append((np.concatenate([prefixes[i][0], edge[a:b]]), float(total), value[i]))
            for opened, j, *rest in full[i]:
                heapq.heappush(heaps[d], (opened, next(tick), len(found[d]) - 1, len(prefixes[i][0]) + j, *rest))

    emit(list(range(n_docs)), [(np.zeros(0, np.int64), 0.0)] * n_docs, top.tolist(), 1, [0] * n_docs, [0] * n_docs, [-2] * n_docs)
    for draw in range(2, k + 1):
        docs, prefixes, values, first_word, depth, nodes = [], [], [], [], [], []
        for d, heap in enumerate(heaps):
            if not heap:
                continue
            value, _, of, place, node, out, mass, word, step = heapq.heappop(heap)
            value = -value
            edges = [e for e in range(held.first[node], held.first[node + 1]) if e not in out]
            p = np.exp(held.log_p[edges] - held.log_p[edges].max())
            u = float(uniform(BEGIN, seeds[d], draw + 2000, word, step))
            e = edges[min(int(np.searchsorted(p.cumsum(), u * p.sum(), side="right")), len(edges) - 1)]
            left = [x for x in edges if x != e]
            if left:
                rest = mass + float(np.logaddexp.reduce(held.log_p[left]))
                again = float(below(value, rest, uniform(BEGIN, seeds[d], draw + 3000, word, step)))
                heapq.heappush(heap, (-again, next(tick), of, place, node, (*out, e), mass, word, step))
            docs.append(d)
            prefixes.append((np.append(found[d][of][0][:place], e), mass + float(held.log_p[e])))
            values.append(value)
            ended = held.to[e] < 0
            first_word.append(word + 1 if ended else word)
            depth.append(0 if ended else step + 1)
            nodes.append(-2 if ended else int(held.to[e]))
        emit(docs, prefixes, values, draw, first_word, depth, nodes)
    out = []
    for heap, got in zip(heaps, found, strict=True):
        bound = -heap[0][0] if heap else -np.inf
        out.append([(edges, p, float(np.log(-np.expm1(-np.exp(p - bound)))) if p - bound > -30 else p - bound) if heap else (edges, p, 0.0) for edges, p, _ in got])
    return out


def wider(codes: np.ndarray) -> np.ndarray:
    """The bytes that letters take in UTF-8 beyond the first."""
    return (codes > 0x7F).view(np.uint8) + (codes > 0x7FF) + (codes > 0xFFFF)


def merges_alone(model: bytes) -> bool:
    """Whether a vocabulary's processor merges pairs of a text as it stands, with a space before it and bytes for the rest."""
    try:
        from sentencepiece.sentencepiece_model_pb2 import ModelProto
    except ImportError:
        return False
    proto = ModelProto.FromString(model)
    normal, trained = proto.normalizer_spec, proto.trainer_spec
    kept = normal.add_dummy_prefix and normal.escape_whitespaces and not normal.remove_extra_whitespaces and not normal.precompiled_charsmap
    usual = all(p.type in (p.NORMAL, p.UNKNOWN, p.CONTROL, p.BYTE) for p in proto.pieces)
    return kept and usual and trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix


def key_seed(key) -> int:
    return xxhash.xxh64_intdigest(str(key).encode(), 8)


def _prepared(held: Lattices, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all texts' chunks, one after the other, and how many each text has. The vocabulary puts a space before every text."""
    spaced = [" " + t if t else "" for t in texts]
    together = "".join(spaced)
    ends = np.fromiter(map(len, spaced), np.int64, len(spaced)).cumsum()
    if not together:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    data, codes = together.encode(), np.frombuffer(together.encode("utf-32-le"), "<u4")
    begins = np.r_[True, held.cut(np.where(codes == ord(" "), np.uint32(ord(SPACE)), codes))]
    begins[ends[:-1][ends[:-1] < len(codes)]] = True
    at = np.flatnonzero(begins)
    sizes = np.diff(np.searchsorted(at, np.r_[0, ends]))
    if len(data) > len(codes):
        at[1:] += wider(codes).cumsum(dtype=np.int64)[at[1:] - 1]  # in bytes from here on
    found = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.r_[at, len(data)]), pa.py_buffer(data)).dictionary_encode()
    return held.add(found.dictionary.to_pylist())[found.indices.to_numpy()], sizes


SCHEMA = "ids array<int>, whole boolean, samples array<struct<ids:array<int>,log_p:double,log_inclusion:double>>"


def encode(df: DataFrame, key: str, text: str, model: bytes, k: int = SAMPLES, alpha: float = ALPHA, lists: bool = True) -> DataFrame:
    """The key, ids, whether they read back as the text, and up to k sampled segmentations.

    With lists=False, ids are replaced by their number and crc32 (of little-endian unsigned 32-bit ids), where they are made.
    """
    sent, name = df.sparkSession.sparkContext.broadcast(model), new_name("pieces")  # its size is fixed by the vocabulary file
    one = pa.struct([("ids", pa.list_(pa.int32())) if lists else ("n_pieces", pa.int64()), *([] if lists else [("ids_crc32", pa.int64())]), ("log_p", pa.float64()), ("log_inclusion", pa.float64())])

    def run(batches):
        held = once_per_worker(name, lambda: Lattices(sent.value, alpha))
        for whole in batches:
            for batch in chunks(whole, text, CUT_BYTES):
                texts = [t or "" for t in batch.column(text).to_pylist()]
                seeds = [key_seed(x) for x in batch.column(key).to_pylist()]
                flat, sizes = _prepared(held, texts)
                ids, at = held.encoding(flat, sizes)
                ids = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                part_at = np.r_[0, sizes.cumsum()]
                unlike = np.r_[0, (~held.whole[flat]).cumsum()][part_at]
                read_back = [a == b and SPACE not in t for a, b, t in zip(unlike[:-1].tolist(), unlike[1:].tolist(), texts, strict=True)]
                block = np.fromiter(map(len, texts), np.int64, len(texts)).cumsum() // SAMPLED_BYTES
                cuts = [*np.flatnonzero(np.r_[True, block[1:] != block[:-1]]).tolist(), len(texts)]
                spelled = []
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    drawn = sample(held, flat[part_at[i] : part_at[j]], sizes[i:j], seeds[i:j], k)
                    ways = iter(held.spell([edges for x in drawn for edges, *_ in x]))
                    spelled += [[(next(ways), p, q) for _, p, q in x] for x in drawn]
                if lists:
                    columns = [pa.array([x.view("<i4") for x in ids], pa.list_(pa.int32())), pa.array(read_back, pa.bool_()), pa.array([[{"ids": s.astype(np.int32), "log_p": p, "log_inclusion": q} for s, p, q in x] for x in spelled], pa.list_(one))]
                    names = ["ids", "whole", "samples"]
                else:
                    columns = [pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(read_back, pa.bool_()), pa.array([[{"n_pieces": len(s), "ids_crc32": zlib.crc32(s), "log_p": p, "log_inclusion": q} for s, p, q in x] for x in spelled], pa.list_(one))]
                    names = ["n_pieces", "ids_crc32", "whole", "samples"]
                yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, *names])

    schema = SCHEMA if lists else "n_pieces long, ids_crc32 long, whole boolean, samples array<struct<n_pieces:long,ids_crc32:long,log_p:double,log_inclusion:double>>"
    return df.select(key, F.col(text).cast("string").alias(text)).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")


def decode(df: DataFrame, ids: str, model: bytes, name: str = "decoded") -> DataFrame:
    """The input with the text that a column of ids stands for; null ids give null. An existing column of the result's name is replaced."""
    from pyspark.sql.types import StringType, StructType

    sent, held = df.sparkSession.sparkContext.broadcast(model), new_name("decoder")
    df = df.drop(name)

    def run(batches):
        from sentencepiece import SentencePieceProcessor

        sp = once_per_worker(held, lambda: SentencePieceProcessor(model_proto=sent.value))
        for batch in batches:
            rows = [None if x is None else sp.decode(x) if x else "" for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.string())], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields]).add(name, StringType()))


def piece_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text", piece_model(), lists=False)
