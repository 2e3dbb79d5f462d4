"""SentencePiece encoding and decoding with exact N-best segmentation.

The lattice of a text has an edge for every piece of the vocabulary that the text holds at a place;
a character without a piece of its own has one edge that stands for its UTF-8 byte pieces. A forward
Viterbi pass gives each place the best score of a path up to it. These scores are exact heuristics
for an A-star search from the end backwards, so complete paths leave the agenda in order of score:
the first is the best segmentation, the first N are the N best. A step along a Viterbi edge loses
nothing and would be the next to leave the agenda, so it is taken at once: of several equal partial
paths the one nearest its end goes first, every entry that leaves the agenda completes a path, and N
entries leave it in all, however many paths tie.

How the passes are spread. No piece crosses the edge before a word mark (checked when the vocabulary
is loaded) nor an unknown character, so a text falls into independent segments. The forward pass
runs in numpy over the distinct segments of a slice at once and gives each segment's best path and
its gap to the second best, the smallest loss of an edge that enters the best path from outside. A
text's N best paths differ from its best path in its N - 1 segments of smallest gap at most, so
A-star searches the lattices of these alone and the lists are merged. A segment of more than
``LONG`` characters (text without spaces) is walked place by place, its edges in blocks: time and
memory grow in proportion to its length.

Scores. A unigram model brings its pieces' log-probabilities. A BPE model brings merge ranks, which
are no scores of a sum; nothing is trained here, so its pieces get the log-probabilities of a
Zipf-Mandelbrot law over these ranks, ``1 / (rank + RANK_SHIFT)``, scaled to one.

Texts are encoded with a leading word mark, spaces become word marks, and a mark that stands in the
text itself is encoded by its bytes, so decoding gives every text back exactly.

Pieces and segments are found by 64 bits of hash. Every path is decoded and compared with the text; one that
does not give it back, which takes two strings of one hash, is encoded again with other hashes.

Cases. A null text has null tokens; an empty one is the leading mark alone. Equal scores come in the
order of the search, which depends on the segment alone. Repeated rows come back once each; a null
doc_id keeps its row. Very long texts, with or without spaces, are encoded whole. An empty
table gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import SLICE_BYTES, mix, tidy

MARK = "▁"
_MARK = ord(MARK)
_OWN_MARK = 0x110000  # stands for a mark of the text itself; no piece holds it
_U = np.uint64
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
LONG = 400
BLOCK = 50_000
RANK_SHIFT = 100.0


def rank_scores(n: int, shift: float = RANK_SHIFT) -> list[float]:
    """Log-probabilities of ranks 0 to n - 1 under a Zipf-Mandelbrot law."""
    p = 1.0 / (np.arange(n) + shift)
    return np.log(p / p.sum()).tolist()


@dataclass
class Vocabulary:
    """Pieces with scores; ``byte_ids[b]`` is the piece of byte b."""

    pieces: list[str]
    scores: list[float]
    ids: list[int]
    byte_ids: list[int]
    unknown: float = field(default=0.0)
    salt: int = 77  # of the hashes by which pieces are found

    def __post_init__(self):
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece crosses a word mark")
        self.unknown = min(self.scores, default=0.0) - 10.0

    @classmethod
    def load(cls, model_file: str) -> Vocabulary:
        """The normal and byte pieces of a SentencePiece model, in the order of their numbers."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        normal, byte_ids = [], [0] * 256
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append((sp.id_to_piece(i), sp.get_score(i), i))
        scores = [s for _, s, _ in normal]
        if all(s == int(s) for s in scores):  # merge ranks
            scores = rank_scores(len(normal))
        return cls([p for p, _, _ in normal], scores, [i for _, _, i in normal], byte_ids)

    @cached_property
    def by_piece(self) -> dict[str, int]:
        return {p: k for k, p in enumerate(self.pieces)}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def to_bytes(self) -> dict[int, bytes]:
        out = {i: p.replace(MARK, " ").encode() for p, i in zip(self.pieces, self.ids, strict=True)}
        return out | {i: bytes([b]) for b, i in enumerate(self.byte_ids)}

    @cached_property
    def char_hash(self) -> np.ndarray:
        return mix(np.arange(_OWN_MARK + 1, dtype=np.uint64) + _U(self.salt))

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash table with linear probing: prefixes of pieces, and the piece each is (-1: none)."""
        found: dict[int, int] = {}
        t = [int(x) for x in self.char_hash[[ord(c) for c in sorted({c for p in self.pieces for c in p})]]]
        by_char = dict(zip(sorted({c for p in self.pieces for c in p}), t, strict=True))
        for k, p in enumerate(self.pieces):
            h, power = 0, 1
            for j, c in enumerate(p):
                h = (h + by_char[c] * power) & 0xFFFFFFFFFFFFFFFF
                power = power * _BASE & 0xFFFFFFFFFFFFFFFF
                if j == len(p) - 1:
                    found[h] = k
                else:
                    found.setdefault(h, -1)
        slots = 1 << max(8, (6 * len(found)).bit_length())
        keys, pieces, shift = np.zeros(slots, np.uint64), np.full(slots, -2, np.int32), 65 - slots.bit_length()
        for h, k in found.items():
            at = h >> shift
            while pieces[at] != -2:
                at = (at + 1) % slots
            keys[at], pieces[at] = h, k
        return keys, pieces

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The piece of each hash; -1 for a mere prefix of pieces, -2 for neither."""
        keys, pieces = self.table
        out = np.full(len(hashes), -2, np.int32)
        open_ = np.arange(len(hashes))
        at = (hashes >> _U(65 - len(keys).bit_length())).astype(np.int64)
        while len(open_):
            got, same = pieces[at], keys[at] == hashes[open_]
            out[open_[same]] = got[same]
            more = ~same & (got != -2)
            open_, at = open_[more], (at[more] + 1) % len(keys)
        return out

    def decode(self, tokens) -> str:
        data = b"".join([self.to_bytes[t] for t in tokens])
        return data[1:].decode() if data[:1] == b" " else data.decode()


# ---------------------------------------------------------------- A-star


def segment_edges(v: Vocabulary, segment: str) -> list[list[tuple[int, float, int]]]:
    """For each place, the edges (start, score, piece) that end there; piece -1 is by bytes."""
    n = len(segment)
    ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n + 1)]
    for i in range(n):
        known = False
        for j in range(i + 1, min(n, i + v.longest) + 1):
            k = v.by_piece.get(segment[i:j])
            if k is not None:
                ends[j].append((i, v.scores[k], k))
                known |= j == i + 1
        if not known:
            ends[i + 1].append((i, v.unknown, -1))
    return ends


def short_paths(v: Vocabulary, segment: str, n: int) -> list[tuple[float, list[tuple[int, int, int]]]]:
    """The n best paths of a segment, best first: (score lost against the best, its (start, end, piece) in order)."""
    ends = segment_edges(v, segment)
    best, lost, via = [0.0], [[]], [0]
    for edges in ends[1:]:
        through = [best[i] + s for i, s, _ in edges]
        best.append(top := max(through))
        via.append(through.index(top))
        lost.append([top - x for x in through])
    # (loss, order, place, edges from there to the end as a linked list)
    agenda: list[tuple] = [(0.0, 0, len(segment), None)]
    order, out = 0, []
    while agenda and len(out) < n:
        loss, _, j, path = heapq.heappop(agenda)
        while j > 0:
            for e, (i, _, k) in enumerate(ends[j]):
                if e != via[j]:
                    order += 1
                    heapq.heappush(agenda, (loss + lost[j][e], order, i, ((i, j, k), path)))
            i, _, k = ends[j][via[j]]
            path, j = ((i, j, k), path), i
        edges = []
        while path is not None:
            edge, path = path
            edges.append(edge)
        out.append((loss, edges))
    return out


def merged_paths(lists: list[list[tuple[float, object]]], n: int) -> list[tuple[float, tuple]]:
    """The n best choices of one entry from each of some independent lists: (loss, entries)."""
    out: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for one in lists:
        out = heapq.nsmallest(n, ((loss + more[0], (*at, i)) for loss, at in out for i, more in enumerate(one)))
    return [(loss, tuple(one[i][1] for one, i in zip(lists, at, strict=True))) for loss, at in out]


# ---------------------------------------------------------------- numpy passes


class SegmentEncoder:
    """Best paths and gaps of segments, remembered from slice to slice up to ``memory`` segments."""

    def __init__(self, v: Vocabulary, memory: int = 200_000):
        self.v, self.memory = v, memory
        self.scores = np.array([*v.scores, v.unknown])
        self.ids = np.array([*v.ids, -1], np.int32)
        self.powers = (np.ones(1, _U), np.ones(1, _U))
        self.paths: dict[tuple[int, str], list] = {}  # of short segments searched before
        self._forget()

    def _forget(self):
        self.keys = np.zeros(0, _U)
        self.value, self.gap, self.at, self.size = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _powers(self, n: int):
        if len(self.powers[0]) < n:
            up, down = np.full(n, _BASE, _U), np.full(n, _INVERSE, _U)
            up[0] = down[0] = 1
            self.powers = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
        return self.powers[0][:n], self.powers[1][:n]

    def prefix_sums(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up, down = self._powers(len(chars) + 1)
        total = np.zeros(len(chars) + 1, _U)
        np.cumsum(self.v.char_hash[chars] * up[:-1], out=total[1:])
        return total, down

    def encode(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """For each segment: index into ``self``'s arrays of value, gap, at and size."""
        total, down = self.prefix_sums(chars)
        h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.memory:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == distinct[known]
        new = first[~known]
        if len(new):
            self._add(distinct[~known], chars, starts[new], ends[new])
        return np.searchsorted(self.keys, distinct)[which]

    def _add(self, keys: np.ndarray, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        value, gap, size, flat = self._passes(chars, starts, ends)
        at = np.cumsum(size) - size + len(self.flat)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.value, self.gap = np.insert(self.value, place, value), np.insert(self.gap, place, gap)
        self.at, self.size = np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.flat = np.concatenate([self.flat, flat])

    def _edges(self, total: np.ndarray, down: np.ndarray, at: np.ndarray, rest: np.ndarray):
        """Edges (begin, width, piece) that begin at the places ``at``, ``rest`` characters before
        their segments' ends, in order of begin and width."""
        begin, width, piece = [], [], []
        single = np.zeros(len(at), bool)
        active = np.arange(len(at))
        for k in range(1, self.v.longest + 1):
            active = active[rest[active] >= k]
            if not len(active):
                break
            x = at[active]
            got = self.v.find((total[x + k] - total[x]) * down[x])
            hit = got >= 0
            begin.append(x[hit])
            width.append(np.full(int(hit.sum()), k))
            piece.append(got[hit])
            if k == 1:
                single[active[hit]] = True
            active = active[got >= -1]
        alone = at[~single]  # characters by bytes
        begin, width = np.concatenate([*begin, alone]), np.concatenate([*width, np.ones(len(alone), np.int64)])
        piece = np.concatenate([*piece, np.full(len(alone), len(self.v.pieces), np.int32)])
        line = np.argsort(begin, kind="stable")  # so the edges of a segment are neighbours
        return begin[line], width[line], piece[line]

    def _passes(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Best score, gap to the second best, number of tokens and tokens of each segment."""
        n = len(starts)
        if not (ends - starts > LONG).any():
            return self._short_passes(chars, starts, ends)
        value, gap, made = np.zeros(n), np.full(n, np.inf), [None] * n
        short = np.flatnonzero(ends - starts <= LONG)
        if len(short):
            v, g, size, flat = self._short_passes(chars, starts[short], ends[short])
            value[short], gap[short] = v, g
            for s, part in zip(short.tolist(), np.split(flat, np.cumsum(size)[:-1]), strict=True):
                made[s] = part
        for s in np.flatnonzero(ends - starts > LONG).tolist():
            found = self.long_paths(chars[starts[s] : ends[s]], 2)
            value[s], made[s] = self.long_score, np.array(found[0][1], np.int32)
            if len(found) > 1:
                gap[s] = found[1][0]
        return value, gap, np.array([len(m) for m in made], np.int64), np.concatenate(made)

    def _short_passes(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        order = np.argsort(starts - ends, kind="stable")  # longest first
        length = (ends - starts)[order]
        n, m = len(order), int(length.sum())
        base = np.cumsum(length) - length
        own = np.repeat(np.arange(n), length)
        c = chars[np.repeat(starts[order] - base, length) + np.arange(m)]
        rest = np.repeat(base + length, length) - np.arange(m)  # characters up to the segment's end
        begin_at, width, piece = self._edges(*self.prefix_sums(c), np.arange(m), rest)
        score = self.scores[piece]
        # Places of segment s: base[s] + s .. base[s] + s + length[s].
        start = begin_at + own[begin_at]
        end = start + width
        local = begin_at - base[own[begin_at]]  # place within the segment
        node = base + np.arange(n)
        forward, back = np.zeros(m + n), np.zeros(m + n, np.int64)
        by_end = np.argsort((local + width) * (m + n) + end, kind="stable")
        for e in _runs(by_end, (local + width)[by_end]):
            x = forward[start[e]] + score[e]
            group = np.flatnonzero(np.append(True, end[e][1:] != end[e][:-1]))
            best = np.maximum.reduceat(x, group)
            among = np.where(x == np.repeat(best, np.diff(np.append(group, len(e)))), np.arange(len(e)), len(e))
            to = end[e][group]
            forward[to], back[to] = best, e[np.minimum.reduceat(among, group)]
        value = forward[node + length]
        on, reached = np.zeros(len(start), bool), np.zeros(m + n, bool)  # the best path's edges and places, from the end backwards
        at, first = node + length, node.copy()
        while len(at):
            e = back[at]
            on[e], reached[at] = True, True
            at = start[e]
            go = at > first
            at, first = at[go], first[go]
        lost = np.where(reached[end] & ~on, np.maximum(forward[end] - forward[start] - score, 0.0), np.inf)
        gap = np.minimum.reduceat(lost, np.searchsorted(begin_at, base))
        # Tokens in order; a character by bytes becomes its byte pieces.
        tokens, i = self.ids[piece[on]], begin_at[on]
        size = np.bincount(own[i], minlength=n)
        if (tokens < 0).any():
            flat: list[int] = []
            size = np.zeros(n, np.int64)
            for t, j in zip(tokens.tolist(), i.tolist(), strict=True):
                made = [t] if t >= 0 else self.bytes_of(int(c[j]))
                flat += made
                size[own[j]] += len(made)
            tokens = np.array(flat, np.int32)
        # Back to the caller's order of segments.
        undo = np.argsort(order, kind="stable")
        begin = np.cumsum(size) - size
        out_size = size[undo]
        pick = np.repeat(begin[undo] - (np.cumsum(out_size) - out_size), out_size) + np.arange(int(out_size.sum()))
        return value[undo], gap[undo], out_size, tokens[pick]

    def long_paths(self, c: np.ndarray, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of one long segment as (score lost, tokens); ``long_score`` is the best score.

        The search of ``short_paths`` with edges made anew, block by block, for each path.
        """
        m = len(c)
        total, down = self.prefix_sums(c)
        reach = self.v.longest
        best, via, kind = np.zeros(m + 1), np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int32)

        def blocks(to: int):
            """(a, z, begins, ends, pieces) of the edges that end at places a + 1 .. z, by end and begin."""
            for a in range(0, to, BLOCK):
                z = min(a + BLOCK, to)
                at = np.arange(max(0, a + 1 - reach), z)
                begin, width, piece = self._edges(total, down, at, z - at)
                end = begin + width
                line = np.flatnonzero(end > a)
                line = line[np.argsort(end[line], kind="stable")]
                yield a, z, begin[line], end[line], piece[line]

        for a, z, begin, end, piece in blocks(m):  # every place is the end of its last character's edge
            low = max(0, a + 1 - reach)
            held, of, what, now = best[low : a + 1].tolist(), [], [], a
            for i, j, s, k in zip(begin.tolist(), end.tolist(), self.scores[piece].tolist(), piece.tolist(), strict=True):
                x = held[i - low] + s
                if j != now:
                    now = j
                    held.append(x)
                    of.append(i)
                    what.append(k)
                elif x > held[-1]:
                    held[-1], of[-1], what[-1] = x, i, k
            best[a + 1 : z + 1], via[a + 1 : z + 1], kind[a + 1 : z + 1] = held[a + 1 - low :], of, what
        self.long_score = float(best[m])
        back, used = via.tolist(), kind.tolist()

        def entering(j: int, few: int) -> list[tuple[float, int, int, int]]:
            """The cheapest edges that enter the Viterbi path to ``j`` from outside: (lost, end, begin, piece)."""
            reached, x = np.zeros(m + 1, bool), j
            while x > 0:
                reached[x] = True
                x = back[x]
            found = []
            for _, _, begin, end, piece in blocks(j):
                out = np.flatnonzero(reached[end] & ((via[end] != begin) | (kind[end] != piece)))
                lost = best[end[out]] - best[begin[out]] - self.scores[piece[out]]
                some = out[_smallest(lost, few)] if len(out) > few else out
                found += [(max(0.0, float(best[end[i]] - best[begin[i]] - self.scores[piece[i]])), int(end[i]), int(begin[i]), int(piece[i])) for i in some]
            return heapq.nsmallest(few, found)

        def tokens(chosen: list[tuple[int, int, int]]) -> list[int]:
            """Of the path that takes the ``chosen`` edges, last first, and Viterbi edges between them."""
            edges, x = [], m
            for end, begin, k in [*chosen, (0, 0, -1)]:
                while x > end:
                    edges.append((back[x], used[x]))
                    x = back[x]
                if k >= 0:
                    edges.append((begin, k))
                    x = begin
            out: list[int] = []
            for i, k in reversed(edges):
                t = int(self.ids[k])
                out += [t] if t >= 0 else self.bytes_of(int(c[i]))
            return out

        agenda: list[tuple[float, int, int, list]] = [(0.0, 0, m, [])]
        order, out = 0, []
        while agenda and len(out) < n:
            loss, _, j, chosen = heapq.heappop(agenda)
            out.append((loss, tokens(chosen)))
            for more, end, begin, k in entering(j, n - len(out)) if len(out) < n else []:
                order += 1
                heapq.heappush(agenda, (loss + more, order, begin, [*chosen, (end, begin, k)]))
        return out

    def alternatives(self, c: np.ndarray, n: int) -> list[tuple[float, list[int]]]:
        """The n best paths of a segment as (score lost, tokens)."""
        if len(c) > LONG:
            return self.long_paths(c, n)
        text = "".join(map(chr, c)) if _OWN_MARK not in c else None
        if text is None:  # a mark of the text itself is a segment of its own
            return [(0.0, [b for x in c.tolist() for b in self.bytes_of(x)])]
        if (known := self.paths.get((n, text))) is None:
            if len(self.paths) >= 20_000:
                self.paths.clear()
            known = [(loss, np.array(_tokens_of(self, text, path), np.int32)) for loss, path in short_paths(self.v, text, n)]
            self.paths[n, text] = known
        return known

    def bytes_of(self, char: int) -> list[int]:
        return [self.v.byte_ids[b] for b in (MARK if char == _OWN_MARK else chr(char)).encode()]


def _runs(order: np.ndarray, key: np.ndarray):
    """``order`` cut where the sorted ``key`` changes."""
    return np.split(order, np.flatnonzero(key[1:] != key[:-1]) + 1) if len(order) else []


def _segments(v_known: np.ndarray, chars: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where segments begin: at texts, at word marks after another character, around unknowns."""
    mark = chars == _MARK
    begin = np.zeros(len(chars), bool)
    begin[text_starts] = True
    begin[1:] |= mark[1:] & ~mark[:-1]
    strange = ~v_known[chars]
    begin |= strange
    begin[1:] |= strange[:-1]
    return np.flatnonzero(begin)


def encode_texts(encoder: SegmentEncoder, texts: list[str], n: int):
    """For each text: tokens, scores of its n best paths, and these paths as edits of the tokens."""
    v = encoder.v
    if "known" not in encoder.__dict__:
        known = np.zeros(_OWN_MARK + 1, bool)
        known[[ord(c) for p in v.pieces for c in p]] = True
        encoder.known = known
    sizes = np.array([len(t) + 1 for t in texts])
    at = np.cumsum(sizes) - sizes
    chars = np.frombuffer("".join(["\0" + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    chars[chars == _MARK] = _OWN_MARK
    chars[chars == 0x20] = _MARK
    chars[at] = _MARK
    starts = _segments(encoder.known, chars, at)
    ends = np.append(starts[1:], len(chars))
    index = encoder.encode(chars, starts, ends)
    size, value, gap, where = encoder.size[index], encoder.value[index], encoder.gap[index], encoder.at[index]
    tokens = encoder.flat[np.repeat(where - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
    token_at = np.concatenate([[0], np.cumsum(size)])
    seg_at = np.append(np.searchsorted(starts, at), len(starts))
    out = []
    for t in range(len(texts)):
        a, b = seg_at[t], seg_at[t + 1]
        best = float(value[a:b].sum())
        scores, edits = [best], [[]]
        if n > 1:
            g = gap[a:b]
            few = np.argsort(g, kind="stable")[: n - 1] if len(g) <= 64 else _smallest(g, n - 1)
            few = np.sort(few[np.isfinite(g[few])]) + a
            if len(few):
                # A strange character has one path, so no chosen segment holds one.
                lists = [encoder.alternatives(chars[starts[s] : ends[s]], n) for s in few]
                for loss, chosen in merged_paths(lists, n)[1:]:
                    scores.append(best - loss)
                    edits.append([(int(token_at[s] - token_at[a]), int(size[s]), list(map(int, new))) for s, new in zip(few, chosen, strict=True)])
        out.append((tokens[token_at[a] : token_at[b]], scores, edits))
    return out


def _smallest(g: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest values, earlier places first among equals."""
    few = np.flatnonzero(g <= np.partition(g, k - 1)[k - 1])
    return few[np.argsort(g[few], kind="stable")][:k]


def _tokens_of(encoder: SegmentEncoder, text: str, path) -> list[int]:
    made: list[int] = []
    for i, _, k in path:
        made += [encoder.v.ids[k]] if k >= 0 else encoder.bytes_of(ord(text[i]))
    return made


def apply_edits(tokens: list[int], edits) -> list[int]:
    """A path's tokens from those of the best path."""
    out, at = [], 0
    for start, size, new in edits:
        out += [*tokens[at:start], *new]
        at = start + size
    return out + list(tokens[at:])


def _edited(tokens: np.ndarray, edits) -> np.ndarray:
    """``apply_edits`` of arrays, as little-endian 32-bit numbers."""
    parts, at = [], 0
    for start, size, new in edits:
        parts += [tokens[at:start], np.array(new, np.int32)]
        at = start + size
    return np.concatenate([*parts, tokens[at:]]).astype("<i4")


_EDITS = "array<array<struct<at:int,size:int,tokens:array<int>>>>"


#: Texts that do not decode are encoded again with other hashes, so often at most.
TRIES = 3


def _runner(v: Vocabulary, n: int, digest: bool):
    import hashlib

    edit_type = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("tokens", pa.list_(pa.int32()))])))

    def encoded(encoder, texts):
        """Slices keep the arrays of the passes small."""
        held, size = [], 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1])
            if size > SLICE_BYTES:
                yield from encode_texts(encoder, held, n)
                held, size = [], 0
        if held:
            yield from encode_texts(encoder, held, n)

    def paths(tokens, edits, text):
        """Digests of the paths, and whether each of them decodes to the text.

        Decoding joins the tokens' bytes, so a later path decodes to the text where the best one does
        and each of its changes stands for the same bytes as the tokens it replaces.
        """
        digests, same = [], v.decode(tokens.tolist()) == text
        spelled = v.to_bytes
        for e in edits:
            for at, size, new in e:
                same = same and b"".join([spelled[t] for t in new]) == b"".join([spelled[t] for t in tokens[at : at + size].tolist()])
            if digest:
                digests.append(hashlib.md5(_edited(tokens, e).tobytes()).hexdigest())
        return digests, same

    def mended(found, seen, texts):
        """Where decoding does not give the text, two strings had one hash: other hashes tell them apart."""
        for i, (text, (_, same)) in enumerate(zip(texts, seen, strict=True)):
            for salt in range(1, TRIES + 1):
                if same or text is None:
                    break
                found[i] = encode_texts(SegmentEncoder(replace(v, salt=v.salt + salt)), [text], n)[0]
                seen[i] = paths(found[i][0], found[i][2], text)
                same = seen[i][1]

    def run(batches):
        encoder = SegmentEncoder(v)
        for batch in batches:
            step = 200
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                texts = part.column(1).to_pylist()
                found = list(encoded(encoder, texts))
                seen = [paths(tokens, edits, x) for x, (tokens, _, edits) in zip(texts, found, strict=True)]
                mended(found, seen, texts)
                null = np.array([t is None for t in texts], bool)
                if digest:
                    columns = [
                        pa.array([len(t) for t, _, _ in found], pa.int64(), mask=null),
                        pa.array([d[0] for d, _ in seen], pa.string(), mask=null),
                        pa.array([d if x is not None else None for x, (d, _) in zip(texts, seen, strict=True)], pa.list_(pa.string())),
                    ]
                    names = ["n_tokens", "token_digest", "path_digests"]
                else:
                    columns = [pa.array([t.tolist() if x is not None else None for x, (t, _, _) in zip(texts, found, strict=True)], pa.list_(pa.int32()))]
                    names = ["tokens"]
                scores = pa.array([s if x is not None else None for x, (_, s, _) in zip(texts, found, strict=True)], pa.list_(pa.float64()))
                edits = pa.array(
                    [[[{"at": a, "size": z, "tokens": k} for a, z, k in p] for p in e] if x is not None else None for x, (_, _, e) in zip(texts, found, strict=True)], edit_type
                )
                same = pa.array([same for _, same in seen], pa.bool_(), mask=null)
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, scores, edits, same], ["doc_id", *names, "scores", "edits", "decoded"])

    return tidy(run)


def encode_documents(docs: DataFrame, model_file: str, n: int = 4, digest: bool = False) -> DataFrame:
    """``(doc_id, tokens, scores, edits, decoded)`` for every row of ``docs(doc_id, text)``.

    ``scores`` are those of the n best paths, best first; ``edits`` gives each path as changes of
    ``tokens`` (``apply_edits``); ``decoded`` tells that decoding each path gives the text back.
    With ``digest``, ``n_tokens``, ``token_digest`` and the digests of all paths' tokens,
    ``path_digests``, stand in for ``tokens``. The vocabulary is read on the driver and sent with
    the task: its size is that of the model.
    """
    v = Vocabulary.load(model_file)
    first = "n_tokens long, token_digest string, path_digests array<string>" if digest else "tokens array<int>"
    return docs.select("doc_id", "text").mapInArrow(_runner(v, n, digest), f"doc_id long, {first}, scores array<double>, edits {_EDITS}, decoded boolean")


def decode_tokens(rows: DataFrame, model_file: str) -> DataFrame:
    """``(doc_id, text)`` of ``rows(doc_id, tokens)``."""
    v = Vocabulary.load(model_file)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([None if t is None else v.decode(t) for t in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"]
            )

    return rows.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    """The public 32k byte-fallback model, where the box provides it."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
