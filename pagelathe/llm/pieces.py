"""SentencePiece encoding and decoding with N-best segmentation.

A text, with one blank before it, is a lattice of vocabulary pieces. Its best
paths come from a backward A* search whose heuristic is exact: the forward
Viterbi score of every place. Since no piece of the vocabulary holds a blank after
another character, the lattice falls apart before each blank that follows a
word; chunks between are searched alone (and once, if they come again), and the
N best of the text are the best combinations of its chunks' N best.

A character that no single piece covers is one node that scores PENALTY below the
least piece score and is encoded as its UTF-8 bytes; so is a literal U+2581, which
stands for a blank inside the vocabulary. Decoding inverts encoding for any text.

The search runs in numpy over the bytes of all distinct chunks of a slice together
(`Lattice`): for each segmentation every chunk takes the best way from its front and
follows it to the start, and the ways that leave it join the front. `Pieces` is the
same search chunk by chunk, for tests. All N segmentations are returned and decoded.

Defined cases: a null text gives null pieces and a null decoded text; an empty
text gives no pieces; of equal scores the one with the longer last piece comes first;
fewer than n segmentations give as many as there are; repeated rows each get their
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE, slices, table, text_bytes
from .suffixes import digests, gather

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PENALTY = 10.0
#: Bits of a piece's hash that its slot has.
SLOT_BITS = 20
#: Segmentations of a text.
N_BEST = 4
#: Chunks kept by a worker in each of two generations.
CACHED = 100_000
BLANK = "▁"
#: Bytes of texts whose distinct chunks are searched together.
ENCODE_BYTES = 1 << 20
_MULTIPLIER = 0xD6E8FEB86659FD93
_CHUNK = re.compile(f" *[^ {BLANK}]+| +|{BLANK}")


def combinations(losses: dict[int, list[float]], n: int) -> list[tuple[float, dict[int, int]]]:
    """Losses of each rank of chunks with a choice -> (loss, rank by chunk) of the 2nd to n-th best combination."""
    # steps down from the best
    loose = sorted((x[1], k) for k, x in losses.items())[: n - 1]
    steps = [losses[k] for _, k in loose]
    queue = [(steps[0][1], 0, ((0, 1),))] if steps else []
    out: list[tuple[float, dict[int, int]]] = []
    while queue and len(out) < n - 1:
        loss, at, taken = heapq.heappop(queue)
        out.append((loss, {loose[a][1]: r for a, r in taken}))
        rank = taken[-1][1]
        before = loss - steps[at][rank]
        if rank + 1 < len(steps[at]):
            heapq.heappush(queue, (before + steps[at][rank + 1], at, (*taken[:-1], (at, rank + 1))))
        if at + 1 < len(steps):
            heapq.heappush(queue, (loss + steps[at + 1][1], at + 1, (*taken, (at + 1, 1))))
            if rank == 1:
                heapq.heappush(queue, (before + steps[at + 1][1], at + 1, (*taken[:-1], (at + 1, 1))))
    return out


class Pieces:
    """A vocabulary and its lattice search. Made from (piece, score) by id."""

    def __init__(self, listed: list[tuple[str, float]], bytes_at: int, special: int):
        """Ids below special are control pieces, the 256 from bytes_at are single bytes."""
        self.bytes_at = bytes_at
        self.text = [p.replace(BLANK, " ") for p, _ in listed]
        self.id = {}
        for i, (p, s) in enumerate(listed):
            if i >= special and not bytes_at <= i < bytes_at + 256:
                self.id[p.replace(BLANK, " ")] = (i, s)
        if any(re.search(r"[^ ] ", p) for p in self.id):
            raise ValueError("a piece holds a blank after another character")
        #: (id, score) of pieces, None for what only begins a piece
        self.known: dict = dict.fromkeys(p[:k] for p in self.id for k in range(1, len(p))) | self.id
        self.spelt = [bytes([i - bytes_at]) if bytes_at <= i < bytes_at + 256 else t.encode() for i, t in enumerate(self.text)]
        self.unknown = min((s for _, s in self.id.values() if s > -1e8), default=0.0) - PENALTY
        self.young: dict = {}
        self.old: dict = {}

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        listed = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
        first = next((i for i in range(len(listed)) if model.is_byte(i)), None)
        if first is None:
            raise ValueError("the vocabulary has no byte pieces")
        return cls(listed, first, first)

    def nodes(self, chunk: str) -> tuple[list[list[tuple]], list[float]]:
        """For each end the nodes (start, id or -1, score), longest first, and the forward Viterbi scores."""
        n, known = len(chunk), self.known
        ends: list[list[tuple]] = [[] for _ in range(n + 1)]
        best = [0.0] + [float("-inf")] * n
        for start in range(n):
            here, hit = best[start], known.get(chunk[start], False)
            if not hit:
                ends[start + 1].append((start, -1, self.unknown))
                if here + self.unknown > best[start + 1]:
                    best[start + 1] = here + self.unknown
            end = start + 1
            while hit is not False:
                if hit:
                    ends[end].append((start, *hit))
                    if here + hit[1] > best[end]:
                        best[end] = here + hit[1]
                if end == n:
                    break
                end += 1
                hit = known.get(chunk[start:end], False)
        return ends, best

    def spell(self, character: str) -> list[int]:
        return [self.bytes_at + b for b in character.encode("utf-8")]

    def n_best(self, chunk: str, n: int) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a chunk as (score, ids), by backward A*.

        With an exact heuristic the front only ever holds what is still needed, so
        at most n times the places are expanded.
        """
        if chunk == BLANK:
            return [(self.unknown, self.spell(chunk))]
        ends, best = self.nodes(chunk)
        push, pop = heapq.heappush, heapq.heappop
        # (-(score so far + forward score), place, order, score so far, path)
        queue: list[tuple] = [(-best[-1], len(chunk), 0, 0.0, None)]
        found, order = [], 0
        while queue and len(found) < n:
            _, at, _, score, path = pop(queue)
            while at:  # the best way on keeps the priority of what was popped: no need to queue it
                go, top = None, best[at]
                for node in ends[at]:
                    if go is None and best[node[0]] + node[2] == top:
                        go = node
                    elif n > 1:
                        order += 1
                        so_far = score + node[2]
                        push(queue, (-(so_far + best[node[0]]), node[0], order, so_far, (node, at, path)))
                score += go[2]
                path, at = (go, at, path), go[0]
            ids = []
            while path:
                (start, i, _), end, path = path
                if i >= 0:
                    ids.append(i)
                else:
                    ids += self.spell(chunk[start:end])
            found.append((score, ids))
        return found

    def cached(self, key: tuple[str, int]) -> tuple:
        chunk, n = key
        if (hit := self.young.get(key)) is None:
            if (hit := self.old.get(key)) is None:
                found = self.n_best(chunk, n)
                hit = tuple([(s, pack(f"<{len(ids)}i", *ids)) for s, ids in found])
            if len(self.young) >= CACHED:
                self.old, self.young = self.young, {}
            self.young[key] = hit
        return hit

    def encode(self, text: str, n: int = 1) -> list[tuple[float, np.ndarray]]:
        """The n best segmentations of a text as (score, ids)."""
        if not text:
            return [(0.0, np.zeros(0, np.int32))]
        known = self.young
        chunks = [known.get(key := (c, n)) or self.cached(key) for c in _CHUNK.findall(" " + text)]
        total = sum(c[0][0] for c in chunks)
        out = [(total, np.frombuffer(b"".join([c[0][1] for c in chunks]), np.int32))]
        if n == 1:
            return out
        losses = {k: [c[0][0] - x[0] for x in c] for k, c in enumerate(chunks) if len(c) > 1}
        for loss, choice in combinations(losses, n):
            out.append((total - loss, np.frombuffer(b"".join([c[choice.get(k, 0)][1] for k, c in enumerate(chunks)]), np.int32)))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.spelt.__getitem__, ids)).decode("utf-8", "replace")[1:]


def longer_first(edge_start: np.ndarray, edge_end: np.ndarray, relative: np.ndarray) -> np.ndarray:
    """Order of edges by relative end, end, and length, the longest first."""
    return np.argsort((relative << 32) | (edge_end << 6) | (63 - (edge_end - edge_start)))  # no two are equal


class Lattice:
    """The vocabulary as byte hashes, and the search over many chunks at once."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        listed = [(p.encode(), i, s) for p, (i, s) in pieces.id.items()]
        if max((len(p) for p, _, _ in listed), default=1) > 63:
            raise ValueError("a piece is longer than 63 bytes")
        codes = {p[:k]: -1 for p, _, _ in listed for k in range(1, len(p))} | {p: i for p, i, _ in listed}
        keys = np.array([self._hash(p) for p in codes], np.uint64)
        order = np.argsort(keys)
        self.keys, self.code = keys[order], np.array(list(codes.values()), np.int64)[order]
        # first key of each leading SLOT_BITS bits, and the most keys that share them
        slot = (self.keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.searchsorted(slot, np.arange(1 << SLOT_BITS)).astype(np.int32)
        self.shared = int(np.bincount(slot).max(initial=1))
        self.score = np.zeros(len(pieces.text))
        for _, i, x in listed:
            self.score[i] = x
        self.spelt = np.frombuffer(b"".join(pieces.spelt), np.uint8)
        self.spelt_size = np.array([len(x) for x in pieces.spelt], np.int64)
        self.spelt_at = np.cumsum(self.spelt_size) - self.spelt_size

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * _MULTIPLIER + int(BYTE[b])) % (1 << 64)
        return h

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash among the keys, and whether it is one of them."""
        at = self.slots[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
        last = len(self.keys) - 1
        hit = self.keys[np.minimum(at, last)] == h
        for k in range(1, self.shared):
            open_ = np.flatnonzero(~hit)
            more = np.minimum(at[open_] + k, last)
            same = self.keys[more] == h[open_]
            at[open_[same]], hit[open_[same]] = more[same], True
        return np.minimum(at, last), hit

    def edges(self, flat: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, id or -1) of all nodes of the lattice; end: where the chunk of each byte ends."""
        size = np.zeros(len(flat), np.int64)  # of the character that begins here
        size[flat < 0x80] = 1
        size[flat >= 0xC0] = 2
        size[flat >= 0xE0] = 3
        size[flat >= 0xF0] = 4
        alive, h, length = np.flatnonzero(size), np.zeros(np.count_nonzero(size), np.uint64), 0
        single = np.zeros(len(flat), bool)
        starts, ends, ids = [], [], []
        while len(alive):
            h = h * np.uint64(_MULTIPLIER) + BYTE[flat[alive + length]]
            length += 1
            at, hit = self.look_up(h)
            alive, h, code = alive[hit], h[hit], self.code[at[hit]]
            piece = code >= 0
            starts.append(alive[piece])
            ends.append(alive[piece] + length)
            ids.append(code[piece])
            single[alive[piece & (size[alive] == length)]] = True
            more = alive + length < end[alive]
            alive, h = alive[more], h[more]
        lone = np.flatnonzero((size > 0) & ~single)
        cat = lambda x, y: np.concatenate([*x, y])
        return cat(starts, lone), cat(ends, lone + size[lone]), cat(ids, np.full(len(lone), -1))

    def search(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray, n: int, needed: Callable[[np.ndarray], np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Chunks flat[begin:begin + size], one after another -> for each of n ranks their ids, numbers of ids and scores (-inf: none).

        After the first rank the front holds the score of each chunk's second; needed
        tells from what the seconds lose which chunks go on. The others' fronts are
        never popped.
        """
        of = np.repeat(np.arange(len(begin)), size)
        start, end, piece = self.edges(flat, (begin + size)[of])
        relative = end - begin[of[start]]
        order = longer_first(start, end, relative)
        start, end, piece, relative = start[order], end[order], piece[order], relative[order]
        score = np.where(piece >= 0, self.score[piece], self.pieces.unknown)
        best = np.zeros(len(flat) + len(begin) + 1)  # place k of chunk c is at begin + c + k
        place_of_start, place_of_end = start + of[start], end + of[start]
        taken = np.zeros(len(best), np.int64)
        edge_from, edge_count = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)  # the nodes that end at a place
        cuts = np.searchsorted(relative, np.arange(1, int(size.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            value = best[place_of_start[a:b]] + score[a:b]
            goal = place_of_end[a:b]
            heads = np.flatnonzero(np.append(True, goal[1:] != goal[:-1]))
            top = np.maximum.reduceat(value, heads)
            count = np.diff(np.append(heads, b - a))
            wins = np.flatnonzero(value == np.repeat(top, count))
            won = np.repeat(np.arange(len(heads)), count)[wins]
            wins = wins[np.append(True, won[1:] != won[:-1])]
            best[goal[heads]], taken[goal[heads]] = top, wins + a
            edge_from[goal[heads]], edge_count[goal[heads]] = heads + a, count
        # backward A*, all chunks together: the way with the best priority is followed to the start, the ways that leave it join the front
        first = begin + np.arange(len(begin))
        goes, at, behind, edge, parent = np.arange(len(begin)), first + size, np.zeros(len(begin)), np.full(len(begin), -1), np.zeros(len(begin), np.int64)
        front = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # chunk, priority, place, score so far, node, rank it left
        paths, found = [], []
        for rank in range(n):
            steps, live = [], np.flatnonzero(at > first[goes])
            to, so_far = at.copy(), behind.copy()
            while len(live):
                step = taken[to[live]]
                steps.append((goes[live], step, to[live], so_far[live]))
                so_far[live] += score[step]
                to[live] = place_of_start[step]
                live = live[to[live] > first[goes[live]]]
            chunk, walked, place, before = (np.concatenate(x) for x in zip(*steps, strict=True)) if steps else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            if rank + 1 < n:
                count = edge_count[place]
                ways = np.repeat(edge_from[place] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                ways_of = np.repeat(np.arange(len(place)), count)
                leaves = ways != walked[ways_of]
                ways, ways_of = ways[leaves], ways_of[leaves]
                reached = before[ways_of] + score[ways]
                new = [chunk[ways_of], reached + best[place_of_start[ways]], place_of_start[ways], reached, ways, np.full(len(ways), rank)]
                if not rank:
                    second = np.full(len(begin), -np.inf)
                    np.maximum.at(second, new[0], new[1])
                    goes_on = needed(best[first + size] - second)[new[0]]
                    new = [x[goes_on] for x in new]
                front = [np.concatenate(x) for x in zip(front, new, strict=True)]
                foremost = self.foremost(front, best[first + size], n - 1 - rank)
                front = [x[foremost] for x in front]
            # the path: what was walked, the node that left the parent, the parent's nodes behind it
            left = edge >= 0
            path = [np.stack([chunk, walked]), np.stack([goes[left], edge[left]])]
            behind_at = np.full(len(begin), np.iinfo(np.int64).max)
            for r in np.unique(parent[left]).tolist():
                mine = left & (parent == r)
                behind_at[:] = np.iinfo(np.int64).max
                behind_at[goes[mine]] = end[edge[mine]]
                path.append(paths[r][:, start[paths[r][1]] >= behind_at[paths[r][0]]])
            path = np.concatenate(path, axis=1)
            path = path[:, np.argsort((path[0] << 32) | start[path[1]], kind="stable")]
            paths.append(path)
            total = np.full(len(begin), -np.inf)
            total[goes] = behind + best[at]
            found.append((*self.spell(path[0], piece[path[1]], start[path[1]], end[path[1]], flat, len(begin)), total))
            if not len(front[0]):
                goes = goes[:0]
            else:
                popped = np.flatnonzero(np.append(True, front[0][1:] != front[0][:-1]))
                goes, _, at, behind, edge, parent = (x[popped] for x in front)
                front = [np.delete(x, popped) for x in front]
            if not len(goes):
                at, behind, edge, parent = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return found

    @staticmethod
    def foremost(front: list[np.ndarray], top: np.ndarray, k: int) -> np.ndarray:
        """The k ways of each chunk with the best priority, best first; more are never needed.

        One sort by chunk and coarse loss leaves few; of equal ones the earlier place counts.
        """
        chunk, priority, place = front[:3]
        coarse = np.minimum(np.maximum(top[chunk] - priority, 0) * 1024, (1 << 40) - 1).astype(np.int64)
        order = np.argsort((chunk << 40) | coarse)
        heads = np.flatnonzero(np.append(True, chunk[order][1:] != chunk[order][:-1])) if len(order) else order
        count = np.diff(np.append(heads, len(order)))
        least = np.repeat(coarse[order][heads + np.minimum(k, count) - 1], count)
        few = order[coarse[order] <= least]
        few = few[np.lexsort((few, place[few], -priority[few], chunk[few]))]
        heads = np.flatnonzero(np.append(True, chunk[few][1:] != chunk[few][:-1])) if len(few) else few
        rank = np.arange(len(few)) - np.repeat(heads, np.diff(np.append(heads, len(few))))
        return few[rank < k]

    def spell(self, chunk: np.ndarray, piece: np.ndarray, start: np.ndarray, end: np.ndarray, flat: np.ndarray, n_chunks: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and numbers of ids of paths given by their nodes in order."""
        known, span = piece >= 0, end - start
        made = np.where(known, 1, span)
        where = np.cumsum(made) - made
        ids = np.zeros(int(made.sum()), np.int32)
        ids[where[known]] = piece[known]
        for k in range(4):
            part = ~known & (span > k)
            ids[where[part] + k] = self.pieces.bytes_at + flat[start[part] + k]
        return ids, np.bincount(chunk, weights=made, minlength=n_chunks).astype(np.int64)

    def decode(self, ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts with so many ids each, without the blank before them, and their n + 1 offsets."""
        width = self.spelt_size[ids]
        flat = gather(self.spelt, self.spelt_at[ids], width)
        size = np.diff(np.concatenate([[0], np.cumsum(width)])[np.concatenate([[0], np.cumsum(n_ids)])])
        kept = np.ones(len(flat), bool)
        kept[(np.cumsum(size) - size)[size > 0]] = False
        return flat[kept], np.concatenate([[0], np.cumsum(size - (size > 0))])

    def round_trip(self, ids: np.ndarray, n_ids: np.ndarray, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Whether the ids of each text decode to it."""
        got, at = self.decode(ids, n_ids)
        right = np.diff(at) == np.diff(off)
        if right.all():
            wrong = np.concatenate([[0], np.cumsum(got != raw[off[0] : off[-1]])])
            return np.diff(wrong[at]) == 0
        return np.array([ok and np.array_equal(got[at[i] : at[i + 1]], raw[off[i] : off[i + 1]]) for i, ok in enumerate(right.tolist())], bool)

    def encode_texts(self, raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Texts in slices: (first, end text, ids, numbers of ids, best, second scores, round trip)."""
        for a, b, ((ids, n_ids, best), (_, _, second)), right in self.encode_n(raw, off, 2):
            yield a, b, ids, n_ids, best, second, right

    def encode_n(self, raw: np.ndarray, off: np.ndarray, n: int) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]]:
        """Texts in slices: (first, end text, (ids, numbers of ids, scores; -inf: none) of each rank, whether all decode to the text)."""
        for a, b in slices(off, ENCODE_BYTES):
            size = np.diff(off[a : b + 1])
            blank = np.flatnonzero(size > 0)
            flat = np.insert(raw[off[a] : off[b]], off[a:b][blank] - off[a], 32)
            size[blank] += 1
            text_at = np.cumsum(size) - size
            opens = flat == 32
            opens[1:] &= flat[:-1] != 32
            opens[text_at[blank]] = True
            begin = np.flatnonzero(opens)
            length = np.diff(np.append(begin, len(flat)))
            if not len(begin):
                none = (np.zeros(0, np.int32), np.zeros(b - a, np.int64))
                yield a, b, [(*none, np.full(b - a, -np.inf if r else 0.0)) for r in range(n)], np.ones(b - a, bool)
                continue
            digest = digests(flat, length)
            _, first, chunk = np.unique(digest[:, 0] ^ (digest[:, 1] << np.uint64(1)), return_index=True, return_inverse=True)
            some = gather(flat, begin[first], length[first])
            per = np.searchsorted(begin, np.append(text_at, len(flat)))

            def needed(loss: np.ndarray, chunk=chunk, per=per) -> np.ndarray:
                taken = np.zeros(len(loss), bool)
                taken[chunk[self.loosest(loss[chunk], per, n)[0]]] = True
                return taken

            found = self.search(some, np.cumsum(length[first]) - length[first], length[first], n, needed)
            ids = np.concatenate([x for x, _, _ in found])
            n_ids = np.stack([x for _, x, _ in found])
            ids_at = (np.cumsum(n_ids) - n_ids.ravel()).reshape(n_ids.shape)
            scores = np.stack([x for _, _, x in found])
            sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[per])
            total = sums(scores[0][chunk])
            ranks, right = [], np.ones(b - a, bool)
            for score, pick in self.picks(scores, chunk, per, total, n):
                have = np.repeat(score > -np.inf, np.diff(per))
                count = np.where(have, n_ids[pick, chunk], 0)
                made = gather(ids, ids_at[pick, chunk][have], count[have])
                ranks.append((made, sums(count), score))
                same = self.round_trip(made, ranks[-1][1], raw, off[a : b + 1])
                right &= same | (score == -np.inf)
            yield a, b, ranks, right

    @staticmethod
    def loosest(loss: np.ndarray, per: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the n - 1 chunks whose second way loses least, in that order: only they can differ from the best. And the text of each chunk."""
        owner = np.repeat(np.arange(len(per) - 1), np.diff(per))
        loose = np.flatnonzero(loss < np.inf)
        loose = loose[np.lexsort((loose, loss[loose], owner[loose]))]
        heads = np.flatnonzero(np.append(True, owner[loose][1:] != owner[loose][:-1])) if len(loose) else loose
        rank = np.arange(len(loose)) - np.repeat(heads, np.diff(np.append(heads, len(loose))))
        return loose[rank < n - 1], owner

    def picks(self, scores: np.ndarray, chunk: np.ndarray, per: np.ndarray, total: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each rank the scores of the texts and the rank taken of each of their chunks."""
        pick = np.zeros(len(chunk), np.int64)
        yield total, pick
        if n == 1:
            return
        loose, owner = self.loosest((scores[0] - scores[1])[chunk], per, n)
        losses = (scores[0] - scores)[:, chunk[loose]].T.tolist()
        heads = np.flatnonzero(np.append(True, owner[loose][1:] != owner[loose][:-1])).tolist() if len(loose) else []
        chosen = [(np.full(len(total), -np.inf), np.zeros(len(chunk), np.int64)) for _ in range(n - 1)]
        at = loose.tolist()
        for a, b in zip(heads, [*heads[1:], len(at)], strict=True):
            i = int(owner[at[a]])
            for (score, taken), (lost, choice) in zip(chosen, combinations({at[k]: [x for x in losses[k] if x < np.inf] for k in range(a, b)}, n), strict=False):
                score[i] = total[i] - lost
                for k, r in choice.items():
                    taken[k] = r
        yield from chosen


_loaded: dict = {}


def worker_pieces(shipped: tuple) -> tuple[Pieces, Lattice]:
    """One vocabulary a worker process."""
    key = (len(shipped[0]), shipped[1], shipped[2], hash(tuple(shipped[0][-50:])))
    if key not in _loaded:
        _loaded.clear()
        pieces = Pieces(*shipped)
        _loaded[key] = (pieces, Lattice(pieces))
    return _loaded[key]


ENCODED = "pieces array<int>, others array<array<int>>, scores array<double>, n_pieces bigint, ids_sha256 string, round_trip boolean"


def lists(ids: np.ndarray, n_ids: np.ndarray, mask: pa.Array | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_ids)]).astype(np.int32)), pa.array(ids), mask=mask)


def encode_batches(batches: Iterator[pa.RecordBatch], held, n: int, ids_too: bool) -> Iterator[pa.RecordBatch]:
    _, lattice = worker_pieces(held.value)
    for batch in batches:
        text = batch.column("text")
        raw, off = text_bytes(text)
        null = text.is_null().to_numpy(zero_copy_only=False)
        for a, b, ranks, right in lattice.encode_n(raw, off, n):
            ids, n_ids, _ = ranks[0]
            ends = np.cumsum(n_ids)
            sha = [hashlib.sha256(ids[y - k : y]).hexdigest() for y, k in zip(ends.tolist(), n_ids.tolist(), strict=True)]
            have = np.stack([s > -np.inf for _, _, s in ranks], axis=1)
            scores = [[x for x, y in zip(row, ok, strict=True) if y] for row, ok in zip(np.stack([s for _, _, s in ranks], axis=1).tolist(), have.tolist(), strict=True)]
            gone = pa.array(null[a:b])
            unless = lambda x, gone=gone: pc.if_else(gone, None, x)
            if ids_too:
                # a null list where the text is null
                listed = lists(ids, n_ids, gone)
                more = pa.concat_arrays([lists(x, k) for x, k, _ in ranks[1:]] or [lists(ids[:0], n_ids[:0])])
                row, rank = np.nonzero(have[:, 1:])
                more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(have[:, 1:].sum(axis=1))]).astype(np.int32)), more.take(pa.array(rank * (b - a) + row)), mask=gone)
            else:
                listed, more = pa.nulls(b - a, pa.list_(pa.int32())), pa.nulls(b - a, pa.list_(pa.list_(pa.int32())))
            keep = [c for c in batch.schema.names if c != "text"]
            rows = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in keep), listed, more, unless(pa.array(scores, pa.list_(pa.float64()))), unless(pa.array(n_ids)), unless(pa.array(sha, pa.string())), unless(pa.array(right))],
                names=[*keep, "pieces", "others", "scores", "n_pieces", "ids_sha256", "round_trip"],
            )


def ship(spark: SparkSession, model: str):
    """The vocabulary, of fixed size, for the workers: they need no file."""
    pieces = Pieces.load(model)
    listed = [("", 0.0)] * len(pieces.text)
    listed = [(t.replace(" ", BLANK), 0.0) for t in pieces.text]
    for p, (i, s) in pieces.id.items():
        listed[i] = (p.replace(" ", BLANK), s)
    return spark.sparkContext.broadcast((listed, pieces.bytes_at, pieces.bytes_at))


def encode(docs: DataFrame, model: str = MODEL, n: int = N_BEST, ids_too: bool = True) -> DataFrame:
    """doc_id, pieces (best ids), others (ids of the 2nd to n-th), scores of the n best, n_pieces, ids_sha256, round_trip.

    ids_sha256 hashes the best ids as little-endian 32-bit numbers; round_trip tells
    whether all segmentations decode to the text. pieces and others are null unless ids_too.
    """
    held = ship(docs.sparkSession, model)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(lambda it: encode_batches(it, held, n, ids_too), f"doc_id bigint, {ENCODED}")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, text from doc_id, pieces."""
    held = ship(encoded.sparkSession, model)

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lattice = worker_pieces(held.value)
        for batch in batches:
            column = batch.column("pieces")
            n_ids = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            raw, off = lattice.decode(column.flatten().to_numpy(zero_copy_only=False), n_ids)
            null = column.is_null().to_pylist()
            texts = [None if gone else raw[x:y].tobytes().decode("utf-8", "replace") for gone, x, y in zip(null, off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "pieces").mapInArrow(back, "doc_id bigint, text string")


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_pieces", "ids_sha256", "scores", "round_trip", "pieces", "others")
