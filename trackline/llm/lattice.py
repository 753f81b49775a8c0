"""The lattice of vocabulary pieces over many texts at once.

A text becomes code points behind one dummy space; spaces are the vocabulary's word mark. Characters that have no piece
of their own stand as their UTF-8 bytes and cut the lattice, as does every space after a non-space: no piece crosses
such a place. What lies between two cuts is a unit. Equal units share one lattice, so the forward pass runs over the
distinct units of a run of texts only.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MARK = 0x2581  # the vocabulary's sign for a space
LITERAL_MARK = 0x110000  # the same character written in a text: no Unicode code, hence never a piece
BASE = np.uint64(0x9E3779B97F4A7C15)
BITS = 22


def _slot(h: np.ndarray) -> np.ndarray:
    return (h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)


def _step(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return (h + codes.astype(np.uint64) + np.uint64(1)) * BASE


class Vocabulary:
    """Pieces of a SentencePiece model with log-probabilities.

    Unigram scores are log-probabilities already. The scores of a merge vocabulary are ranks, so piece probabilities
    follow Zipf's law: in proportion to 1 / (rank + 2). Bytes count as the rarest rank. ``temperature`` below 1
    flattens them. One part is kept for the end of a text. All of it sums to 1.
    """

    def __init__(self, path: str, temperature: float = 1.0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        scores = np.array([model.get_score(i) for i in range(size)])
        self.byte_id = np.zeros(256, np.int32)
        self.bytes = [b""] * size
        pieces: list[tuple[int, str]] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.bytes[i] = piece.replace(chr(MARK), " ").encode()
                pieces.append((i, piece))
        ids = np.array([i for i, _ in pieces])
        ranked = bool((scores[ids] <= -1).any() and scores[ids].min() < -1000)
        logs = np.full(size, -np.inf)
        logs[ids] = -np.log(np.minimum(-scores[ids], size) + 2) if ranked else scores[ids]
        rare = logs[ids].min()
        logs[self.byte_id] = rare
        logs *= temperature
        top = logs[ids].max()
        total = top + np.log(np.exp(logs - top).sum() + 1.0)  # the end of a text is as likely as the likeliest piece
        self.log_p = logs - total
        self.log_end = top - total
        self.single = {ord(p): i for i, p in pieces if len(p) == 1}
        self.longest = max(len(p) for _, p in pieces)
        self._index(pieces)
        known = np.zeros(0x110001, bool)
        known[list(self.single)] = True
        self.known = known

    def _index(self, pieces: list[tuple[int, str]]) -> None:
        whole: dict[int, int] = {}
        starts: set[int] = set()
        base, top = int(BASE), (1 << 64) - 1
        for i, p in pieces:
            h = 0
            for c in p:
                h = ((h + ord(c) + 1) * base) & top
                starts.add(h)
            whole[h] = i
        self.keys = np.array(sorted(whole), np.uint64)
        self.ids = np.array([whole[int(k)] for k in self.keys], np.int32)
        slot = _slot(self.keys)
        self.row = np.full(1 << BITS, -1, np.int32)  # of ``keys`` by slot; -2 where several share one
        self.row[slot] = np.arange(len(slot), dtype=np.int32)
        shared, many = np.unique(slot, return_counts=True)
        self.row[shared[many > 1]] = -2
        self.starts = np.zeros(1 << BITS, bool)
        self.starts[_slot(np.fromiter(starts, np.uint64))] = True

    def piece_at(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, -1 where there is none."""
        row = self.row[_slot(h)]
        doubt = np.flatnonzero(row == -2)
        row[doubt] = np.searchsorted(self.keys, h[doubt]).clip(max=len(self.keys) - 1)
        found = np.flatnonzero(row >= 0)
        found = found[self.keys[row[found]] == h[found]]
        out = np.full(len(h), -1, np.int32)
        out[found] = self.ids[row[found]]
        return out

    def codes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts, each behind a space, as one array of codes, and where each begins."""
        flat = np.frombuffer("".join([" " + t for t in texts]).encode("utf-32-le"), np.uint32).astype(np.int32)
        flat[flat == MARK] = LITERAL_MARK
        flat[flat == 0x20] = MARK
        return flat, np.r_[0, np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))]


@lru_cache(maxsize=2)
def vocabulary(path: str, temperature: float = 1.0) -> Vocabulary:
    return Vocabulary(path, temperature)


class Units:
    """The units of a run of codes: where each begins and ends, and which distinct unit it is."""

    def __init__(self, vocab: Vocabulary, flat: np.ndarray, texts: np.ndarray):
        known = vocab.known[flat]
        first = np.zeros(len(flat) + 1, bool)
        first[texts] = True
        word = flat == MARK
        first[1:-1] |= (word[1:] & ~word[:-1]) | ~known[1:] | ~known[:-1]
        cuts = np.flatnonzero(first)
        start, end = cuts[:-1], cuts[1:]
        inside = known[start] if len(start) else np.zeros(0, bool)
        self.known = known
        self.start, self.end = start[inside], end[inside]
        mixed = (flat.astype(np.uint64) + np.uint64(1)) * BASE
        # A unit's key: each code weighted by its place in the unit, summed over the unit.
        place = np.arange(len(flat)) - np.repeat(start, end - start)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * ((place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
        mixed ^= mixed >> np.uint64(29)
        total = np.r_[np.uint64(0), np.cumsum(mixed, dtype=np.uint64)]
        size = self.end - self.start
        key = total[self.end] - total[self.start] + size.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        _, self.example, self.kind = np.unique(key, return_index=True, return_inverse=True)
        sizes = size[self.example]
        self.offset = np.r_[0, np.cumsum(sizes)]  # of each distinct unit in ``codes``
        source = np.repeat(self.start[self.example] - self.offset[:-1], sizes) + np.arange(self.offset[-1])
        self.codes = flat[source]


class Lattice:
    """Arcs and forward log-probabilities of the distinct units.

    Node ``offset[u] + u + j`` is the place after the first j codes of unit u. Arcs are ordered by end node.
    """

    def __init__(self, vocab: Vocabulary, codes: np.ndarray, offset: np.ndarray):
        n_units = len(offset) - 1
        unit = np.repeat(np.arange(n_units), np.diff(offset))
        limit = offset[1:][unit]
        at, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        begins, lengths, pieces = [], [], []
        for n in range(1, vocab.longest + 1):
            h = _step(h, codes[at + n - 1])
            live = vocab.starts[_slot(h)]
            at, h = at[live], h[live]
            piece = vocab.piece_at(h)
            whole = np.flatnonzero(piece >= 0)
            begins.append(at[whole])
            pieces.append(piece[whole])
            lengths.append(np.full(len(whole), n))
            more = at + n < limit[at]
            at, h = at[more], h[more]
            if len(at) == 0:
                break
        begin, length, piece = np.concatenate(begins), np.concatenate(lengths), np.concatenate(pieces)
        node = begin + unit[begin]  # every unit has one node more than codes
        depth = begin - offset[unit[begin]] + length
        order = np.lexsort((length, node + length))
        self.begin, self.length, self.piece = node[order], length[order].astype(np.int32), piece[order]
        end, depth = self.begin + self.length, depth[order]
        n_nodes = len(codes) + n_units
        self.first = np.searchsorted(end, np.arange(n_nodes + 1))  # of each node's arcs
        self.forward = np.zeros(n_nodes)
        weight = vocab.log_p[self.piece]
        by_depth = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by_depth], np.arange(1, (int(depth.max()) if len(depth) else 0) + 2))
        self.share = np.zeros(len(end))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            arcs = by_depth[a:b]  # still ordered by end node
            ends = end[arcs]
            group = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
            size = np.diff(np.r_[group, len(ends)])
            score = self.forward[self.begin[arcs]] + weight[arcs]
            top = np.maximum.reduceat(score, group)
            part = np.exp(score - np.repeat(top, size))
            total = np.add.reduceat(part, group)
            self.forward[ends[group]] = top + np.log(total)
            self.share[arcs] = part / np.repeat(total, size)
        self.last = offset[1:] + np.arange(n_units)  # end node of each unit

    def log_total(self) -> np.ndarray:
        """Log of the summed probability of all segmentations of each distinct unit."""
        return self.forward[self.last]

    def cumulative(self) -> np.ndarray:
        """Whole-number shares: a node's arcs cover 2**32, and arcs of node k lie between k and k+1 times that."""
        parts = np.floor(self.share * 2.0**32).astype(np.int64)
        arcs = self.first[1:] - self.first[:-1]
        has = arcs > 0
        total = np.zeros(len(arcs), np.int64)
        total[has] = np.add.reduceat(parts, self.first[:-1][has])
        parts[self.first[1:][has] - 1] += (1 << 32) - total[has]
        return np.cumsum(parts)
