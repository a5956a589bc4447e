"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The pieces come from a model file (its path is a parameter).  The scores of a unigram model are those of the
file; any other model holds no log scores (those of a BPE model are merge ranks), so ``fit`` makes them: EM over
the distinct units of all texts that are encoded, from the occurrences of each piece.  Counts are summed as whole
numbers, so the scores do not depend on how rows are dealt.

Texts are worked as UTF-8 with a blank for each white-space marker.  They are cut into units at places that no piece
crosses (a vocabulary with pieces that go from another character to a marker is worked text by text).  Equal units
have equal ids, so only distinct ones are searched for their best path, many at once: a ``Lattice`` lays them side by
side, and each of its steps relaxes the edges of one length from one place of all units.  Units go by 64-bit hashes;
a text that does not decode to itself is encoded again without them, so a collision cannot stay.  What is remembered
of units has a bound; very long texts are worked in parts.

Characters without a piece fall back to the pieces of their bytes.  Null texts count as empty; an empty text
has no ids; a text that holds the marker character itself decodes to a blank in its place; a null or repeated
``doc_id`` keeps its own row; other columns are ignored.
"""

from __future__ import annotations

import codecs
import copy
import hashlib
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docfields.llm.base import cut, frugal, groups, ragged, run_hashes, slices

MARK = "▁"
#: How far below the least score a character without a piece stands.
PENALTY = 10.0
#: Rounds of EM after the first scores.
ROUNDS = 2
#: Least expected count of a piece, so that each keeps a finite score.
FLOOR = 0.5
#: Expected counts are summed in these parts of one.
PARTS = 1 << 16
#: Bytes of a unit up to which it is worked together with others, and units that are worked at once.
WIDE, AT_ONCE = 64, 1 << 15
#: Units that are remembered or counted before they are handed on, and bytes of a text that are worked at once.
REMEMBER, COUNTED, CHUNK = 400_000, 200_000, 1 << 19

#: Bytes of a character by its first one; 0 inside a character.
_WIDTH = np.array([1 if c < 0x80 else 0 if c < 0xC0 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4 for c in range(256)])

codecs.register_error("each-byte", lambda e: ("�" * (e.end - e.start), e.end))


class DoubleArray:
    """Trie of byte strings in two arrays: the child of node ``s`` by byte ``c`` is ``base[s] + c + 1`` where ``check`` of it is ``s``.

    The arrays go on for 257 places after the last node, so a child can be looked up without a test of bounds.
    """

    def __init__(self, keys: dict[bytes, int]):
        base, check, value = [0] * 1024, [-1] * 1024, [-1] * 1024
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for key, v in keys.items():
            node = 0
            for c in key:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    ends.append(-1)
            ends[node] = v
        check[0], value[0], free, todo = 0, ends[0], 257, [(0, 0)]
        while todo:
            node, at = todo.pop()
            codes = sorted(children[node])
            if not codes:
                continue
            while free < len(check) and check[free] >= 0:
                free += 1
            slot, missed = free, 0
            while True:
                if slot + 256 >= len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                b = slot - codes[0] - 1
                if check[slot] < 0:
                    if all(check[b + c + 1] < 0 for c in codes):
                        break
                    missed += 1
                slot += 1
            if missed > 16:  # holes this full are left behind, so building stays linear
                free = slot
            base[at] = b
            for c in codes:
                to = b + c + 1
                check[to], value[to] = at, ends[children[node][c]]
                todo.append((children[node][c], to))
        used = max(i for i, c in enumerate(check) if c >= 0) + 1
        self.base, self.check, self.value = (array("i", [*x[:used], *[fill] * 257]) for x, fill in ((base, 0), (check, -1), (value, -1)))

    def prefixes(self, text: bytes, start: int) -> Iterator[tuple[int, int]]:
        """(end, value) of every key that starts at ``start``, shortest first."""
        base, check, value, node = self.base, self.check, self.value, 0
        for i in range(start, len(text)):
            to = base[node] + text[i] + 1
            if check[to] != node:
                return
            node = to
            if value[node] >= 0:
                yield i + 1, value[node]


class Lattice:
    """The edges of many short texts side by side: row ``i`` of a matrix is place ``i`` of each text, longest texts first.

    ``steps`` lists (start, length, texts, pieces) with ascending starts; within a step all ends are different.  Piece
    -1 is a character without a piece of its own.  The texts are runs of ``flat``.
    """

    def __init__(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, trie: DoubleArray):
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        most, n = int(self.sizes[0]) if len(sizes) else 0, len(sizes)
        self.codes = codes = np.full((most + 4, n), 255, np.int32)  # a byte that no text holds
        place = np.repeat(np.arange(n), self.sizes)
        codes[ragged(np.zeros(n, np.int64), self.sizes), place] = flat[ragged(starts[self.order], self.sizes)]
        base, check, value = (np.frombuffer(x, np.int32) for x in (trie.base, trie.check, trie.value))
        self.steps: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for i in range(most):
            lead = codes[i, : np.searchsorted(-self.sizes, -i, "left")]
            which = np.flatnonzero((lead & 0xC0) != 0x80)
            chars = _WIDTH[lead]
            single = np.zeros(len(lead), bool)
            at, node, d = which, np.zeros(len(which), np.int32), 0
            while len(at):
                to = base[node] + codes[i + d, at] + 1
                ok = np.flatnonzero(check[to] == node)
                at, node, d = at[ok], to[ok], d + 1
                piece = value[node]
                hit = np.flatnonzero(piece >= 0)
                if len(hit):
                    ends = at[hit]
                    self.steps.append((i, d, ends, piece[hit]))
                    if d <= 4:
                        single[ends[chars[ends] == d]] = True
            alone = which[~single[which]]
            if len(alone):
                for d in np.unique(chars[alone]).tolist():
                    own = alone[chars[alone] == d]
                    self.steps.append((i, d, own, np.full(len(own), -1, np.int32)))

    def _weights(self, cost: np.ndarray, unknown: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        for i, d, at, piece in self.steps:
            yield i, d, at, piece, np.where(piece >= 0, cost[piece], unknown)

    def best(self, cost: np.ndarray, unknown: float, byte_ids: np.ndarray | None, unknown_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids) of the best paths, in the order in which the texts were given.

        Where two paths to a place are equal, the one whose last piece is longest is taken.
        """
        rows, n = len(self.codes) - 3, len(self.sizes)
        score = np.full((rows, n), -np.inf)
        long, ids = np.ones((rows, n), np.int32), np.zeros((rows, n), np.int32)
        score[0] = 0.0
        for i, d, at, piece, weight in self._weights(cost, unknown):
            new = score[i, at] + weight
            better = np.flatnonzero(new > score[i + d, at])
            at, piece = at[better], piece[better]
            score[i + d, at] = new[better]
            if len(piece) and piece[0] < 0 and byte_ids is not None:
                for k in range(1, d + 1):  # one byte after the other; no other path stops inside a character
                    ids[i + k, at], long[i + k, at] = byte_ids[self.codes[i + k - 1, at]], 1
            else:
                ids[i + d, at], long[i + d, at] = np.where(piece < 0, unknown_id, piece), d
        which, place = np.arange(n), self.sizes.copy()
        which = which[place > 0]
        owners, found = [], []
        while len(which):
            at = place[which]
            owners.append(which)
            found.append(ids[at, which])
            place[which] = at - long[at, which]
            which = which[place[which] > 0]
        if not found:
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        owner = self.order[np.concatenate(owners[::-1])]
        return np.concatenate(found[::-1])[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=n)

    def expected(self, times: np.ndarray, cost: np.ndarray | None, unknown: float, pieces: int) -> np.ndarray:
        """Expected count of each piece over all paths, in ``PARTS``; without ``cost``, how often each piece occurs.  ``times`` weighs the texts."""
        out, times = np.zeros(pieces, np.int64), times[self.order]
        if cost is None:
            for _, _, at, piece in self.steps:
                if len(piece) and piece[0] >= 0:
                    np.add.at(out, piece, times[at] * PARTS)
            return out
        shares, usable = self._shares(cost, unknown, logs=False)
        if not usable.all():  # products out of range
            for k, (share, exact) in enumerate(zip(shares, self._shares(cost, unknown, logs=True)[0], strict=True)):
                shares[k] = np.where(usable[self.steps[k][2]], share, exact)
        for (_, _, at, piece), share in zip(self.steps, shares, strict=True):
            if len(piece) and piece[0] >= 0:
                np.add.at(out, piece, np.rint(share * PARTS).astype(np.int64) * times[at])
        return out

    def _shares(self, cost: np.ndarray, unknown: float, logs: bool) -> tuple[list[np.ndarray], np.ndarray]:
        """Probability of each edge over all paths of its text, and whether each text's total is a usable number."""
        rows, n = len(self.codes) - 3, len(self.sizes)
        zero, one = (-np.inf, 0.0) if logs else (0.0, 1.0)
        times, plus = (np.add, np.logaddexp) if logs else (np.multiply, np.add)
        forward, backward = np.full((rows, n), zero), np.full((rows, n), zero)
        forward[0], backward[self.sizes, np.arange(n)] = one, one
        # A factor for each byte is the same on every path; it keeps the products near one.
        known = [(i, d, at, w if logs else np.exp(w + 2.5 * d)) for i, d, at, _, w in self._weights(cost, unknown)]
        for i, d, at, w in known:
            forward[i + d, at] = plus(forward[i + d, at], times(forward[i, at], w))
        for i, d, at, w in reversed(known):
            backward[i, at] = plus(backward[i, at], times(backward[i + d, at], w))
        total = backward[0]
        with np.errstate(all="ignore"):
            paths = ((at, times(times(forward[i, at], w), backward[i + d, at])) for i, d, at, w in known)
            shares = [np.exp(p - total[at]) if logs else p / total[at] for at, p in paths]
        return shares, np.ones(n, bool) if logs else (total > 1e-250) & (total < 1e250)


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kinds: list[str]  # normal, unknown, control, byte, unused, user
    dummy_prefix: bool = True
    unigram: bool = True  # whether the scores are log scores
    trie: DoubleArray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        usable = [i for i, k in enumerate(self.kinds) if k in ("normal", "user")]
        self.trie = DoubleArray({self.pieces[i].replace(MARK, " ").encode(): i for i in usable if " " not in self.pieces[i]})
        self._weigh()
        self.byte_ids = np.zeros(256, np.int32)
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == "byte":
                self.byte_ids[int(p[3:5], 16)] = i
        self.has_bytes = "byte" in self.kinds
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == "unknown"), 0)
        texts = [self.pieces[i] for i in usable]
        self.crosses = any(re.search(f"[^{MARK}]{MARK}", p) for p in texts)
        # What a byte tells of cuts, 1: a blank, where a unit begins unless it follows another; 3: in no piece with others,
        # a unit of its own; 2: in pieces only after blanks and its like, so a unit begins unless it follows those.
        before = {c: {p[i - 1] for p in texts for i, x in enumerate(p) if i and x == c} for c in ",.;:!?|\"'()[]{}#$%&*+=/@-"}
        cuts = set(before)
        while bad := {c for c in cuts if before[c] - cuts - {MARK}}:
            cuts -= bad
        self.marks = np.zeros(256, np.uint8)
        if not self.crosses:
            self.marks[[ord(c) for c in cuts]] = 2
            self.marks[[ord(c) for c in "\n\r\t|" if not any(c in p and len(p) > 1 for p in texts)]] = 3
            self.marks[32] = 1
        names = [b"" if k == "control" else bytes([int(p[3:5], 16)]) if k == "byte" else p.replace(MARK, " ").encode() for p, k in zip(self.pieces, self.kinds, strict=True)]
        if self.kinds and "unknown" in self.kinds:
            names[self.unknown] = " ⁇ ".encode()
        self.out, self.out_sizes = np.frombuffer(b"".join(names), np.uint8), np.array([len(x) for x in names], np.int64)
        self.out_starts = np.cumsum(self.out_sizes) - self.out_sizes
        #: Stands for a blank that is no piece, until its ids are known.
        self.blank = len(self.pieces)
        self.blank_ids = [int(x) for x in self.byte_ids[list(MARK.encode())]] if self.has_bytes else [self.unknown]
        self._forget()

    def _weigh(self) -> None:
        normal = [s for s, k in zip(self.scores, self.kinds, strict=True) if k == "normal"] or [0.0]
        self.least, self.most = min(normal), max(normal)
        self.cost = array("d", [len(p.encode()) * self.most - 0.1 if k == "user" else s for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True)])

    def _forget(self) -> None:
        self.seen, self.starts, self.sizes, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __getstate__(self) -> dict:
        return {k: v[:0] if k in ("seen", "starts", "sizes", "flat") else v for k, v in self.__dict__.items()}

    def rescored(self, scores: list[float]) -> Vocabulary:
        """The same pieces with other log scores."""
        other = copy.copy(self)
        other.scores, other.unigram = scores, True
        other._weigh()
        other._forget()
        return other

    def parts(self, raw: bytes) -> list[bytes]:
        """A text as blanks for markers, cut before blanks or after lines where it is very long."""
        if not raw:
            return []
        raw = (b" " if self.dummy_prefix else b"") + raw.replace(MARK.encode(), b" ")
        out, start = [], 0
        lines = self.marks[10] == 3
        while not self.crosses and len(raw) - start > CHUNK:
            at = raw.find(b" ", start + CHUNK)
            while at >= 0 and raw[at - 1] == 32:
                at = raw.find(b" ", at + 1)
            line = raw.find(b"\n", start + CHUNK, at if at >= 0 else len(raw)) + 1 if lines else 0
            if line or at >= 0:
                out.append(raw[start : line or at])
                start = line or at
            else:
                break
        return [*out, raw[start:]] if start < len(raw) else out

    def cuts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all parts, starts of their units)."""
        flat = np.frombuffer(b"".join(parts), np.uint8)
        kind = self.marks[flat]
        before = np.zeros_like(kind)
        before[1:] = kind[:-1]
        begins = ((kind == 1) & (before != 1)) | (kind == 3) | (before == 3) | ((kind == 2) & (before != 1) & (before != 2))
        begins[np.cumsum([0, *map(len, parts[:-1])])] = True
        return flat, np.flatnonzero(begins)

    def units(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes of all parts, starts of their units, sizes, hashes)."""
        flat, starts = self.cuts(parts)
        sizes = np.diff(starts, append=len(flat))
        return flat, starts, sizes, run_hashes(flat, starts, sizes)

    def viterbi(self, text: bytes) -> list[int]:
        """Ids of the best path; where two paths to a place are equal, the one whose last piece is longest."""
        n = len(text)
        best, origin, piece = array("d", [-np.inf]) * (n + 1), array("q", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        best[0] = 0.0
        unk, cost, trie = self.least - PENALTY, self.cost, self.trie
        base, check, value = trie.base, trie.check, trie.value
        for i in range(n):
            here = best[i]
            if here == -np.inf:  # inside a character
                continue
            lead = text[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            node, j, single = 0, i, False
            while j < n:
                to = base[node] + text[j] + 1
                if check[to] != node:
                    break
                node = to
                j += 1
                v = value[node]
                if v >= 0:
                    single |= j == i + width
                    score = here + cost[v]
                    if score > best[j]:
                        best[j], origin[j], piece[j] = score, i, v
            if not single and here + unk > best[i + width]:  # only a character that is no piece itself can be unknown
                best[i + width], origin[i + width], piece[i + width] = here + unk, i, -1
        ids: list[int] = []
        while n:
            i, v = origin[n], piece[n]
            if v >= 0:
                ids.append(v)
            elif text[i] == 32:
                ids += self.blank_ids[::-1]
            elif self.has_bytes:
                ids += [int(self.byte_ids[b]) for b in reversed(text[i:n])]
            else:
                ids.append(self.unknown)
            n = i
        return ids[::-1]

    def searched(self, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids) of the best paths of runs of ``flat``."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        short, cost = np.flatnonzero(sizes <= WIDE), np.frombuffer(self.cost, np.float64)
        byte_ids = self.byte_ids.copy() if self.has_bytes else None
        if byte_ids is not None:
            byte_ids[32] = self.blank
        for at in range(0, len(short), AT_ONCE):
            own = short[at : at + AT_ONCE]
            ids, n = Lattice(flat, starts[own], sizes[own], self.trie).best(cost, self.least - PENALTY, byte_ids, self.unknown)
            if (ids == self.blank).any():
                wide = np.where(ids == self.blank, len(self.blank_ids), 1)
                n = np.diff(np.concatenate([[0], np.cumsum(wide)])[np.cumsum(n)], prepend=0)
                first = np.repeat(np.cumsum(wide) - wide, wide)
                ids = np.where(np.repeat(ids == self.blank, wide), np.array(self.blank_ids)[np.minimum(np.arange(len(first)) - first, len(self.blank_ids) - 1)], np.repeat(ids, wide))
            done.append((own, ids.astype(np.int32), n))
        for k in np.flatnonzero(sizes > WIDE).tolist():
            ids = np.array(self.viterbi(flat[starts[k] : starts[k] + sizes[k]].tobytes()), np.int32)
            done.append((np.array([k]), ids, np.array([len(ids)])))
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        own, ids, n = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(own, kind="stable")
        return ids[ragged((np.cumsum(n) - n)[order], n[order])], n[order]

    def _encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids) of a group of parts.  What is remembered goes when it is too much."""
        flat, starts, sizes, hashes = self.units(parts)
        names, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.seen) > REMEMBER:
            self._forget()
        at = np.searchsorted(self.seen, names)
        new = at == len(self.seen)
        new[~new] = self.seen[at[~new]] != names[~new]
        if new.any():
            ids, n = self.searched(flat, starts[first[new]], sizes[first[new]])
            # Both lists of names ascend, so one is put into the other.
            self.seen = np.insert(self.seen, at[new], names[new])
            self.starts = np.insert(self.starts, at[new], len(self.flat) + np.cumsum(n) - n)
            self.sizes, self.flat = np.insert(self.sizes, at[new], n), np.concatenate([self.flat, ids])
            at = at + np.cumsum(new) - new
        at = at[which]
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        last = np.searchsorted(starts, np.cumsum([len(p) for p in parts]), "left")
        return self.flat[ragged(self.starts[at], sizes)], np.diff(ends[last], prepend=0)

    def exact(self, raw: bytes) -> list[int]:
        """Ids of a text without hashes and anything remembered."""
        out: list[int] = []
        for part in self.parts(raw):
            starts = self.cuts([part])[1].tolist()
            for a, b in zip(starts, [*starts[1:], len(part)], strict=True):
                out += self.viterbi(part[a:b])
        return out

    def encode_all(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(ids one after the other, number of ids, decoded texts) of the texts."""
        parts = [self.parts(r) for r in raws]
        found = [self._encode_parts(g) for g in groups([x for p in parts for x in p], CHUNK)]
        ids, n = (np.concatenate([np.zeros(0, kind), *c]) for c, kind in zip(zip(*found, strict=True) if found else ([], []), (np.int32, np.int64), strict=True))
        ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(p) for p in parts])]
        n = np.diff(ends, prepend=0)
        joined, sizes = self.raw(ids)
        places = np.concatenate([[0], np.cumsum(sizes)])
        backs = [self.text(joined[places[b - k] : places[b]]) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
        for k, (back, raw) in enumerate(zip(backs, raws, strict=True)):
            if back.encode() != raw and self.exact(raw) != ids[ends[k] - n[k] : ends[k]].tolist():  # two units of one hash
                slow = [self.exact(r) for r in raws]
                return np.array([x for f in slow for x in f], np.int32), np.array([len(f) for f in slow], np.int64), [self.decode(f) for f in slow]
        return ids, n, backs

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text.encode()])[0].tolist()

    def raw(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the ids, blanks for markers, and how many bytes each gives."""
        sizes, out = self.out_sizes[ids], []
        for at in range(0, len(ids), CHUNK):
            some = ids[at : at + CHUNK]
            out.append(self.out[ragged(self.out_starts[some], sizes[at : at + CHUNK])].tobytes())
        return b"".join(out), sizes

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids; bytes that make no character each become U+FFFD; the marker set before the text goes."""
        return self.text(self.raw(np.fromiter(ids, np.int64))[0])

    def text(self, raw: bytes) -> str:
        text = raw.decode("utf-8", "each-byte").replace(MARK, " ")
        return text[1:] if self.dummy_prefix and text[:1] == " " else text

    def proto(self) -> bytes:
        """The vocabulary as a unigram model file, whose normaliser leaves texts as they are."""
        kinds = {v: k for k, v in KINDS.items()}

        def varint(n: int) -> bytes:
            return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

        def block(number: int, data: bytes) -> bytes:
            return varint(number << 3 | 2) + varint(len(data)) + data

        def flag(number: int, n: int) -> bytes:
            return varint(number << 3) + varint(n)

        out = [block(1, block(1, p.encode()) + b"\x15" + struct.pack("<f", s) + flag(3, kinds[k])) for p, s, k in zip(self.pieces, self.scores, self.kinds, strict=True)]
        trainer = flag(3, 1) + flag(4, len(self.pieces)) + flag(35, int(self.has_bytes))
        out += [block(2, trainer), block(3, block(1, b"identity") + flag(3, int(self.dummy_prefix)) + flag(4, 0) + flag(5, 1))]
        return b"".join(out)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffers message."""

    def varint(at: int) -> tuple[int, int]:
        shift = total = 0
        while True:
            b = data[at]
            total |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return total, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = varint(at) if kind == 2 else (8 if kind == 1 else 4, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


#: Kinds of pieces by their number in a model file.
KINDS = {1: "normal", 2: "unknown", 3: "control", 4: "user", 5: "unused", 6: "byte"}


def load(path: str) -> Vocabulary:
    """Vocabulary of a SentencePiece model file; a name without a folder is a public tokenizer's.

    Texts are taken as they are, so a file whose normaliser changes them (a map of characters, blanks that are
    dropped, markers behind the words) is refused.
    """
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    with open(path, "rb") as f:
        return parsed(f.read())


def parsed(data: bytes) -> Vocabulary:
    rows, dummy, unigram, other = [], True, True, []
    for number, value in _fields(data):
        if number == 1:
            x = dict(_fields(value))
            rows.append((x[1].decode(), float(np.frombuffer(x[2], "<f4")[0]) if 2 in x else 0.0, KINDS[x.get(3, 1)]))
        elif number == 2:
            x = dict(_fields(value))
            unigram = x.get(3, 1) == 1
            other += ["markers behind words"] * bool(x.get(24, 0))
        elif number == 3:
            x = dict(_fields(value))
            dummy = bool(x.get(3, 1))
            other += ["a map of characters"] * bool(x.get(2)) + ["dropped blanks"] * bool(x.get(4, 1)) + ["blanks without markers"] * (not x.get(5, 1))
    if other:
        raise ValueError(f"the model's normaliser changes texts: {', '.join(other)}")
    return Vocabulary(*(list(c) for c in zip(*rows, strict=True)), dummy, unigram)


def fit(docs: DataFrame, data: Vocabulary, rounds: int = ROUNDS) -> Vocabulary:
    """``data`` with log scores of its normal pieces by EM over all texts of ``docs``; one number a piece comes to the driver.

    For these counts alone, units of more than ``WIDE`` bytes are cut into ``WIDE`` bytes or fewer, at character borders.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # hashes, counts, bytes, sizes

        def merged() -> None:
            names, n, flat, sizes = (np.concatenate(c) for c in zip(*held, strict=True))
            names, first, which = np.unique(names, return_index=True, return_inverse=True)
            total = np.zeros(len(names), np.int64)
            np.add.at(total, which, n)
            starts = np.cumsum(sizes) - sizes
            held[:] = [(names, total, flat[ragged(starts[first], sizes[first])], sizes[first])]

        def out() -> pa.RecordBatch:
            _, n, flat, sizes = held.pop()
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            unit = pa.Array.from_buffers(pa.binary(), len(n), [None, offsets.buffers()[1], pa.py_buffer(flat.tobytes())])
            return pa.RecordBatch.from_arrays([unit, pa.array(n, pa.int64())], ["unit", "n"])

        for _, texts in slices(batches, "text", CHUNK):
            parts = [p for raw in texts for p in data.parts(sound(raw))]
            for group in groups(parts, CHUNK):
                flat, starts, sizes, hashes = data.units(group)
                names, first, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((names, n, flat[ragged(starts[first], sizes[first])], sizes[first]))
                merged()
                if len(held[0][0]) >= COUNTED or len(held[0][2]) >= 8 * CHUNK:
                    yield out()
        if held:
            yield out()

    units = cut(docs.selectExpr("cast(text as string) text").mapInArrow(frugal(count), "unit binary, n long").groupBy("unit").agg(F.sum("n").alias("n")))
    normal = np.array([k == "normal" for k in data.kinds])
    chars, pieces = np.array([len(p) for p in data.pieces]), len(data.pieces)

    def short(texts: list[bytes], times: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        if max(map(len, texts)) <= WIDE:
            return texts, times
        parts, n = [], []
        for text, k in zip(texts, times.tolist(), strict=True):
            while len(text) > WIDE:
                at = WIDE
                while at > WIDE - 4 and text[at] & 0xC0 == 0x80:
                    at -= 1
                parts.append(text[:at])
                n.append(k)
                text = text[at:]
            parts.append(text)
            n.append(k)
        return parts, np.array(n, np.int64)

    def scored(cost: np.ndarray | None, unknown: float) -> list[float]:
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(pieces, np.int64)
            for batch, texts in slices(batches, "unit", CHUNK // 2):
                texts, n = short(texts, batch.column("n").to_numpy())
                sizes = np.array([len(t) for t in texts], np.int64)
                flat, starts = np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes
                for at in range(0, len(texts), AT_ONCE):
                    own = slice(at, at + AT_ONCE)
                    sums += Lattice(flat, starts[own], sizes[own], data.trie).expected(n[own], cost, unknown, pieces)
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], ["piece", "n"])

        counts = np.zeros(pieces)
        for r in units.mapInArrow(frugal(go), "piece int, n long").groupBy("piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
            counts[r["piece"]] = float(r["n"]) / PARTS
        if cost is None:
            counts *= chars
        counts = np.where(normal, np.maximum(counts, FLOOR), 0.0)
        with np.errstate(divide="ignore"):
            scores = np.where(normal, np.log(counts) - np.log(max(counts.sum(), FLOOR)), 0.0)
        return scores.astype(np.float32).tolist()  # as a model file can hold them

    fitted = data.rescored(scored(None, 0.0))
    for _ in range(rounds):
        fitted = data.rescored(scored(np.array(fitted.cost), fitted.least - PENALTY))
    return fitted


def sound(raw: bytes) -> bytes:
    """``raw`` with U+FFFD for what is no UTF-8."""
    return raw.decode("utf-8", "replace").encode()


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids, round_trip, decoded_sha256: one row for each row of ``docs``.

    The scores of a model other than unigram are fitted to ``docs`` at once.
    """
    data = load(model)  # a vocabulary is bounded, so it goes out with the task
    if not data.unigram:
        data = fit(docs, data)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte = np.array([k == "byte" for k in data.kinds])
        for batch, raws in slices(batches, "text", CHUNK):
            raws = [sound(r) for r in raws]
            ids, counts, backs = data.encode_all(raws)
            ends, fallen = np.cumsum(counts), np.concatenate([[0], np.cumsum(byte[ids])])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(counts, pa.int64()),
                    pa.array(fallen[ends] - fallen[ends - counts], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids, pa.int32())),
                    pa.array([a.encode() == b for a, b in zip(backs, raws, strict=True)], pa.bool_()),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in backs], pa.string()),
                ],
                ["doc_id", "n_ids", "n_byte_ids", "ids", "round_trip", "decoded_sha256"],
            )
        data._forget()

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        frugal(go), "doc_id long, n_ids long, n_byte_ids long, ids array<int>, round_trip boolean, decoded_sha256 string"
    )
