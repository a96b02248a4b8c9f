"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement.

The lattice of a text has an edge for every vocabulary piece that matches at a position, and a byte-fallback edge for characters
that are no piece. An edge's log-weight comes from its piece's place in the vocabulary (a Zipf law on the rank, sharpened by
`alpha`); the model is read, never trained. Segmentations are sampled without replacement by perturbed A-star search: each
subtree of partial segmentations carries the maximum of the Gumbel-perturbed log-probabilities of its leaves. The best open subtree is
popped, one edge is drawn for the next position, and the alternatives stay open as one subtree whose maximum is a Gumbel
truncated at the popped value; following the drawn edge keeps the popped value, so each pop descends to one new leaf. The exact
heuristic is the backward log-sum of the lattice, which makes edge probabilities normalised, and the k leaves found first are the
k largest perturbed values: a sample without replacement with known inclusion scores 1-exp(-exp(logp - kappa)), kappa being the
next subtree's value. (It is 1 for texts with no more than k segmentations.)

Pieces never run over the start of a word (white space belongs to the word behind it), so word lattices are built once a word and
shared; the descents of many documents advance together in numpy. Random numbers are hashes of (row key, sample, word, step),
so a row gives the same samples wherever and however often it is computed. The values of subtrees are
drawn for the first words behind a branch; where a later one could still be among the best, for all of them.

Defined results: null and empty texts have exactly one segmentation, the empty one (log-probability 0, inclusion 1); equal
(key, text) rows give equal samples; a null key counts as 0; texts with fewer than k segmentations give as many samples as there
are; an empty table gives an empty result; other columns are ignored. Decoding gives the text back, except that the model
writes the character U+2581 as a space.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
MARK = SPACE.encode()
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")
_G = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x):
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _seeded(key, a, c: int):
    """The hash state of (key, a, c)."""
    return _mix(_mix(key + np.uint64(c) * _G) + a * _M1)


def _two(state, b):
    """Two numbers in (0, 1), of 32 bits each, from a hash state and b."""
    h = _mix(state + b * _G)
    return ((h >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32, ((h & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32


class Model:
    """Pieces, ids and log-weights of a SentencePiece model file."""

    def __init__(self, path: str = MODEL, alpha: float = 1.0):
        import sentencepiece

        self.sp, self.flat = sentencepiece.SentencePieceProcessor(model_file=path), None
        sp = self.sp
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        usual = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        ranked = sorted(usual, key=lambda i: (-sp.get_score(i), i))
        weight = 1.0 / (np.arange(len(ranked)) + 10.0)
        logw = alpha * np.log(weight / weight.sum())
        self.byte_logw = float(logw[-1])
        self.ascii = np.array([self.bytes[i] for i in range(128)], np.int32)
        self.by_piece = {self.pieces[i]: (i, float(w)) for i, w in zip(ranked, logw, strict=True)}
        self.width = max(map(len, self.by_piece))
        self._hash_prefixes()

    #: A slot: hash of a prefix of pieces, the piece it is (-1: none), and its log-weight, whose sign bit says whether a longer piece goes on.
    SLOT = np.dtype([("hash", "<u8"), ("id", "<i4"), ("logw", "<f4")])

    def _hash_prefixes(self) -> None:
        """An open-addressed table of all prefixes of pieces in records of 16 bytes: one memory access finds all about a prefix."""
        entries: dict[int, list] = {}
        spelled: dict[int, str] = {}
        for piece, (i, w) in self.by_piece.items():
            h = 0
            for n, c in enumerate(piece, 1):
                h = (h * int(_POLY) + ord(c) + 1) % 2**64
                if spelled.setdefault(h, piece[:n]) != piece[:n]:
                    raise ValueError("piece hashes collide")
                e = entries.setdefault(h, [-1, 1.0, False])
                if n == len(piece):
                    e[0], e[1] = i, w
                else:
                    e[2] = True
        bits = max(8, (4 * len(entries)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        slots = np.zeros(1 << bits, self.SLOT)
        for h, (i, w, on) in entries.items():
            at = (h * int(_G) % 2**64) >> (64 - bits)
            while slots["hash"][at]:
                at = (at + 1) & self.mask
            slots[at] = (h, i, abs(w) if on else -abs(w))
        self.slots = slots.view(np.complex128)  # any type of 16 bytes

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slots of the hashes; of those that are no prefix, a slot whose hash is another."""
        at = ((h * _G) >> self.shift).astype(np.int64)
        got = self.slots.take(at)
        found = got.view(np.uint64)[::2]
        todo = np.flatnonzero((found != h) & (found != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            more = self.slots.take(at[todo])
            got[todo] = more
            held = more.view(np.uint64)[::2]
            todo = todo[(held != h[todo]) & (held != 0)]
        return got.view(self.SLOT)


_POLY = np.uint64(0x100000001B3 * 2 + 1)


class _Index(dict):
    """Word to number, new words being numbered as they come and kept in `new`."""

    def __init__(self):
        self.new: list[str] = []
        self.at = np.zeros(0, np.int64)  # the words' lattices

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


_BASE = 0x9E3779B97F4A7C15 | 1
_LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * _G)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the word hash's base, and of its inverse."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + n // 2, base, np.uint64)
            steps[0] = 1
            _POWERS[i] = np.cumprod(steps)
    return _POWERS


class Lattices:
    """Word lattices in flat arrays. The edges of a position stand together, the likeliest first; a word has the place of its first
    position's edges. An edge is a record of 16 bytes, so that one memory access gives all that a step needs: cumulative probability (in
    units of 2^-31; 2^31 for the position's last), log-probability, piece id (-1 - code point: the bytes of a character beyond ASCII), and the
    place of the edges behind it (-1: the word ends). `shut` is the log-probability of all other edges of the position together."""

    RECORD = np.dtype([("cum", "<u4"), ("logp", "<f4"), ("id", "<i4"), ("next", "<i4")])

    def __init__(self, model: Model, limit: int = 12_000_000):
        self.model, self.limit = model, limit  # edges kept
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.m = self.words = 0
        self.edges, self.shut = np.zeros(0, np.complex128), np.zeros(0, np.float32)  # any type of 16 bytes
        self.first = np.zeros(0, np.int64)
        self.held, self.bits = 0, 16
        self.slots, self.word_of = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)

    def beside(self, edge: int) -> list[tuple[int, float, int, int]]:
        """The records of a position's edges, from its first."""
        out, n = [], 12
        while not out or out[-1][0] != _LAST:
            out += self.edges[edge + len(out) : edge + len(out) + n].view(self.RECORD).tolist()
            last = next((i for i, x in enumerate(out) if x[0] == _LAST), None)
            if last is not None:
                return out[: last + 1]
        return out

    def lookup(self, words: list[str]) -> np.ndarray:
        """Indices of the words; new ones are built together."""
        index = self.index
        out = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        new, index.new = index.new, []
        if not new:
            return index.at[out]
        at = np.zeros(len(index), np.int64)
        at[: len(index) - len(new)] = index.at
        at[len(index) - len(new) :] = self._add([w.encode("utf-8", "surrogatepass") for w in new], np.array([len(w) for w in new], np.int64))
        index.at = at
        return at[out]

    def split(self, text: bytes) -> np.ndarray:
        """Indices of the words of `text`, which stand between single spaces. Words are found by a 64-bit hash that is a difference of two
        prefix sums; the few of more than 255 bytes by themselves."""
        codes = np.frombuffer(text, np.uint8)
        gaps = np.flatnonzero(codes == 32)
        start, end = np.append(0, gaps + 1), np.append(gaps, len(codes))
        power, inverse = _powers(len(codes) + 1)
        run = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_LETTERS.take(codes) * power[: len(codes)], out=run[1:])
        h = run.take(end)
        h -= run.take(start)
        h *= inverse.take(start)
        h += (end - start).astype(np.uint64)
        h = _mix(h) | np.uint64(1)
        out = self._find(h)
        long = np.flatnonzero(end - start > 255)
        if len(long):
            out[long] = self.lookup([text[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        new = np.flatnonzero(out < 0)
        if len(new):
            keys, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            one = new[one]
            letters = np.append(0, np.cumsum((codes & 0xC0) != 0x80))  # code points
            at = self._add([text[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)], letters[end[one]] - letters[start[one]])
            self._insert(keys, at)
            out[new] = at[back]
        return out

    def _find(self, h: np.ndarray) -> np.ndarray:
        shift, mask = np.uint64(64 - self.bits), (1 << self.bits) - 1
        at = (h >> shift).astype(np.int64)
        got = self.slots.take(at)
        out = np.where(got == h, self.word_of.take(at), -1).astype(np.int64)
        todo = np.flatnonzero((got != h) & (got != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            got = self.slots[at[todo]]
            hit = got == h[todo]
            out[todo[hit]] = self.word_of[at[todo[hit]]]
            todo = todo[~hit & (got != 0)]
        return out

    def _insert(self, h: np.ndarray, words: np.ndarray) -> None:
        """Put distinct new hashes into the open-addressed table."""
        self.held += len(h)
        if 2 * self.held > 1 << self.bits:
            full = self.slots != 0
            h, words = np.concatenate([self.slots[full], h]), np.concatenate([self.word_of[full], words])
            self.bits = (2 * len(h)).bit_length() + 1
            self.slots, self.word_of = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        mask, at, todo = (1 << self.bits) - 1, (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = self.slots[at[todo]] == 0
            claim = todo[free]
            self.slots[at[claim]] = h[claim]  # the last of several claims holds
            won = self.slots[at[claim]] == h[claim]
            self.word_of[at[claim[won]]] = words[claim[won]]
            todo = np.concatenate([todo[~free], claim[~won]])
            at[todo] = (at[todo] + 1) & mask

    def _add(self, words: list[bytes], sizes: np.ndarray) -> np.ndarray:
        """Build the lattices of new words of `sizes` code points; their indices."""
        done = self.words
        cuts = np.flatnonzero(np.diff(np.append(-1, np.cumsum(sizes) // 100_000))).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(words)], strict=True):
            self._build(words[lo:hi], sizes[lo:hi] + 1, done + lo)
        self.words += len(words)
        return np.arange(done, self.words)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        held = getattr(self, name)
        if at + len(values) > len(held):
            held.resize((at + len(values)) * 5 // 4 + 1024, refcheck=False)  # in place: large arrays are not copied
        held[at : at + len(values)] = values

    def _build(self, words: list[bytes], sizes: np.ndarray, done: int) -> None:
        model, mark = self.model, MARK
        codes = np.frombuffer((mark + mark.join(words)).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(codes)
        ends = np.cumsum(sizes)
        start = ends - sizes
        rest = np.repeat(ends, sizes) - np.arange(n)  # characters to the word's end
        found, per = [], np.zeros(n, np.int64)
        c64 = codes.astype(np.uint64) + np.uint64(1)
        live, h = np.arange(n), c64
        for size in range(1, model.width + 1):  # positions drop out where no piece goes on
            slot = model.find(h)
            known = slot["hash"] == h
            ids, weight = np.where(known, slot["id"], -1), slot["logw"]
            hit = np.flatnonzero(ids >= 0)
            at = live.take(hit)
            per[at] += 1
            found.append((size, at, -np.abs(weight.take(hit)).astype(np.float64), ids.take(hit)))
            if size == 1:  # no piece for the character alone: its bytes
                lone = np.flatnonzero(ids < 0)
                per[lone] += 1
                odd = codes[lone]
                wide = 1 + (odd > 0x7F) + (odd > 0x7FF) + (odd > 0xFFFF)
                found.append((1, lone, model.byte_logw * wide, np.where(odd < 128, model.ascii[np.minimum(odd, 127)], -1 - odd.astype(np.int64))))
            on = np.flatnonzero(known & (weight > 0) & (rest.take(live) > size))
            if not len(on):
                break
            live = live.take(on)
            h = h.take(on) * _POLY + c64.take(live + size)
        # edges by their position's distance to the word's end, then by position
        head = np.argsort(rest.astype(np.uint16) if int(sizes.max()) < 1 << 16 else rest, kind="stable")
        count = per.take(head)
        starts = np.cumsum(count) - count
        slot, m = np.empty(n, np.int64), int(count.sum())
        slot[head] = starts
        length, logw, ids = np.empty(m, np.int64), np.empty(m), np.empty(m, np.int64)
        for size, at, w, i in found:
            to = slot.take(at)
            slot[at] = to + 1
            length[to], logw[to], ids[to] = size, w, i
        pos, level = np.repeat(head, count), rest.take(head)
        bounds = np.searchsorted(level, np.arange(1, int(level[-1]) + 2))
        beta = np.zeros(n + 1)
        whole = length == np.repeat(level, count)  # edges to the word's end
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            a, b = starts[lo], starts[hi] if hi < len(starts) else len(pos)
            own, c = starts[lo:hi] - a, count[lo:hi]
            v = logw[a:b] + np.where(whole[a:b], 0.0, beta[pos[a:b] + length[a:b]])
            top = np.maximum.reduceat(v, own)
            total = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, c)), own))
            beta[head[lo:hi]] = total
            logw[a:b] = v - np.repeat(total, c)
        # the likeliest edge of each position first
        best = np.repeat(np.maximum.reduceat(logw, starts), count) == logw
        first = np.flatnonzero(best)
        first = first[np.searchsorted(first, starts)]
        for x in (length, logw, ids, whole):
            x[starts], x[first] = x[first], x[starts].copy()
        prob = np.exp(logw)
        others = prob.copy()
        others[starts] = 0.0
        with np.errstate(divide="ignore"):
            shut = np.log1p(-np.minimum(prob, 1.0))
            shut[starts] = np.log(np.add.reduceat(others, starts))  # 1-p would lose small remainders
        run = np.cumsum(prob)
        cum = run - np.repeat(run[starts] - prob[starts], count)
        cum = (np.minimum(cum, 1.0) * (2.0**31 - 1)).astype(np.uint32)
        cum[starts + count - 1] = 1 << 31
        off = np.full(n + 1, -1)
        off[head] = self.m + starts
        edges = np.zeros(len(pos), self.RECORD)
        edges["cum"], edges["logp"], edges["id"], edges["next"] = cum, logw, ids, np.where(whole, -1, off[pos + length])
        self._put("edges", self.m, edges.view(np.complex128))
        self._put("shut", self.m, shut)
        self._put("first", done, off[start])
        self.m += len(pos)


def pretokens(text: str) -> list[str]:
    """Words of the escaped text, each with the white space before it, of which the first mark is left out."""
    if not text:
        return []
    parts = text.split(" ")
    if SPACE not in text and "" not in parts:  # single spaces only
        return parts
    return [w[1:] for w in WORD.findall(SPACE + text.replace(" ", SPACE))]


def _odd(text: bytes) -> bool:
    """Whether the words of a text are not just what stands between single spaces."""
    return b"  " in text or text[:1] == b" " or text[-1:] == b" " or MARK in text


def _word_ids(lat: Lattices, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lattice indices of the words of all texts, and the number of words of each. Only new words reach Python."""
    if lat.m > lat.limit:
        lat.reset()
    odd = [_odd(t) for t in texts]
    plain = [t for t, o in zip(texts, odd, strict=True) if t and not o]
    ids = lat.split(b" ".join(plain)) if plain else np.zeros(0, np.int64)
    count = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    if any(odd):
        special = [pretokens(t.decode("utf-8", "surrogatepass")) for t, o in zip(texts, odd, strict=True) if o]
        more = lat.lookup([w for words in special for w in words])
        odd = np.array(odd)
        count[odd] = [len(words) for words in special]
        own = np.repeat(odd, count)
        whole = np.empty(len(own), np.int64)
        whole[~own], whole[own] = ids, more
        ids = whole
    return ids, count


def _descend(lat: Lattices, state: np.ndarray, at: np.ndarray, full: bool):
    """Draw edges from the places `at` to the words' ends for word instances with hash states: ([edge records by instance], number of each
    instance), and for `full` behind the records the places they were drawn at, the edges, and a second random number of each."""
    inst, outs, step = np.arange(len(at)), [], np.uint64(0)
    while len(inst):
        h = _mix(state + step * _G)
        step += np.uint64(1)
        u = (h >> np.uint64(33)).astype(np.uint32)
        edge, got = at, lat.edges.take(at)
        fields = got.view(np.uint32).reshape(-1, 4)
        low = np.flatnonzero(u >= fields[:, 0])
        if len(low):
            edge = at.copy() if full else at
            while len(low):
                e = edge[low] + 1
                edge[low] = e
                more = lat.edges.take(e)
                got[low] = more
                low = low[u.take(low) >= more.view(np.uint32).reshape(-1, 4)[:, 0]]
        outs.append((inst, got, at, edge, ((h & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) * 2.0**-32) if full else (inst, got))
        behind = fields.view(np.int32)[:, 3]
        on = np.flatnonzero(behind >= 0)
        inst, state, at = inst.take(on), state.take(on), behind.take(on).astype(np.int64)
    n_inst = len(outs[0][0]) if outs else 0
    count = np.bincount(np.concatenate([x[0] for x in outs]), minlength=n_inst) if outs else np.zeros(0, np.int64)
    place, n = np.cumsum(count) - count, int(count.sum())
    columns = [np.empty(n, t) for t in (np.complex128, np.int64, np.int64, np.float64)[: 4 if full else 1]]
    for step, (i, *parts) in enumerate(outs):  # tokens take their places: by instance, then step
        to = place.take(i) + step
        for whole, part in zip(columns, parts, strict=True):
            whole[to] = part
    return columns, count


def _truncated(phi, bound, u):
    """Gumbel of location phi, truncated at bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        return phi - np.log(np.exp(phi - bound) - np.log(u))


class _Path:
    """A sample of a document: its piece ids, and word instance, place in the lattice and log-probability before each of the tokens from
    `head` on that may open subtrees."""

    __slots__ = ("before", "head", "ids", "inst", "logp", "place", "value")

    def __init__(self, ids, head, inst, place, before, logp, value):
        self.ids, self.head, self.inst, self.place, self.before, self.logp, self.value = ids, head, inst, place, before, logp, value


OPENING = 200  # words behind a branch that are looked at first for subtrees to open
HIGHEST = -math.log(-math.log((2**32 - 0.5) * 2.0**-32))  # no Gumbel drawn from 32 bits lies further above its location


def sample(lat: Lattices, keys: np.ndarray, texts: list[str | bytes], k: int) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text (or its UTF-8) up to k samples (logp, perturbed value, inclusion score, piece ids), largest perturbed value first."""
    texts = [t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    ids, n_words = _word_ids(lat, texts)
    first = lat.first.take(ids)
    base = np.concatenate([[0], np.cumsum(n_words)])
    keys = keys.astype(np.uint64)
    d_of = np.repeat(np.arange(len(texts)), n_words)
    state = keys.take(d_of), (np.arange(len(ids)) - base.take(d_of)).astype(np.uint64)
    g = -np.log(-np.log(_two(_seeded(keys, np.uint64(0), 0), np.uint64(0))[0]))
    paths: list[list[_Path]] = [[] for _ in texts]
    # open subtrees of a document: (-value, tie, path, token behind its head, edges shut there)
    queues: list[list] = [[] for _ in texts]
    # a branch: document, word and place to go on from (_START: its start; -1: its end), ids before, log-probability before, perturbed value
    todo = [(d, int(base[d]), _START, _NONE, 0.0, float(g[d])) for d in range(len(texts))]
    for r in range(k):
        if r:
            todo = _popped(lat, keys, paths, queues, r)
        if not todo:
            break
        begin = np.array([x[1] for x in todo], np.int64)
        end = base[np.array([x[0] for x in todo], np.int64) + 1]
        mid = np.minimum(begin + OPENING, end)
        places = np.array([x[2] for x in todo], np.int64)
        # the words that may open subtrees with everything that these need, the others for their edges alone
        near = _advance(lat, state, 1 + r, first, places, begin, mid, True)
        far = _advance(lat, state, 1 + r, first, np.full(len(todo), _START), mid, end, False)
        _record(lat, todo, near, far, paths, queues, k - r, lambda i, r=r, places=places, begin=begin, end=end: _advance(lat, state, 1 + r, first, places[i : i + 1], begin[i : i + 1], end[i : i + 1], True))
    out = []
    for found, q in zip(paths, queues, strict=True):
        kappa = -q[0][0] if q else -math.inf
        out.append([(x.logp, x.value, 1.0 if kappa == -math.inf else -math.expm1(-math.exp(min(x.logp - kappa, 700.0))), _spelled(lat.model, x.ids)) for x in found])
    return out


_NONE, _START, _LAST = np.zeros(0, np.int32), -2, 1 << 31


def _truncated_one(phi: float, bound: float, u: float) -> float:
    return phi - (math.log(math.exp(phi - bound) - math.log(u)) if phi - bound < 700 else phi - bound)


def _popped(lat: Lattices, keys: np.ndarray, paths, queues, r: int) -> list[tuple]:
    """The best open subtree of each document, one edge of it drawn; the others stay open."""
    who = [d for d, q in enumerate(queues) if q]
    if not who:
        return []
    popped = [heapq.heappop(queues[d]) for d in who]
    at = np.array([(x[2], x[3]) for x in popped], np.uint64).reshape(-1, 2)
    us, vs = (x.tolist() for x in _two(_seeded(keys[who], at[:, 1], 1000 + r), at[:, 0]))
    todo = []
    for d, (neg, _, s, t, shut), u1, v1 in zip(who, popped, us, vs, strict=True):
        path = paths[d][s]
        open_ = [(e, math.exp(x[1]), *x[1:]) for e, x in enumerate(lat.beside(int(path.place[t])), int(path.place[t])) if e not in shut]
        left = u1 * sum(x[1] for x in open_)
        for new, w, logp, piece, behind in open_:  # one of the open edges, by probability
            left -= w
            if left < 0:
                break
        rest = sum(x[1] for x in open_ if x[0] != new)
        before = float(path.before[t])
        if rest > 0.0:
            heapq.heappush(queues[d], (-_truncated_one(before + math.log(rest), -neg, v1), (r, t), s, t, (*shut, new)))
        head = np.append(path.ids[: path.head + t], np.int32(piece))
        todo.append((d, int(path.inst[t]), behind, head, before + logp, -neg))
    return todo


def _advance(lat: Lattices, state, c: int, first, places, begin, end, full: bool):
    """Descend the words begin to end of each branch, the first of them from its place. (Where each branch's tokens begin, log-probabilities
    and ids of the tokens), and for `full` word instances, places, edges and second random numbers of the tokens."""
    n = end - begin
    starts = np.cumsum(n) - n
    words = np.repeat(begin - starts, n) + np.arange(int(n.sum()))
    at = first.take(words)
    inside = np.flatnonzero((places != _START) & (n > 0))
    if len(inside):
        at[starts[inside]] = places[inside]
        live = np.flatnonzero(at >= 0)  # a branch may end its word
        words_in, at = words.take(live), at.take(live)
    else:
        live, words_in = slice(None), words
    keys, number = state
    (got, *more), count = _descend(lat, _seeded(keys.take(words_in), number.take(words_in), c), at, full)
    per = np.zeros(len(words), np.int64)
    per[live] = count
    cuts = np.append(0, np.cumsum(per))[np.append(starts, len(words))]
    got = got.view(lat.RECORD)
    logp, ids = got["logp"].astype(np.float64), np.ascontiguousarray(got["id"])
    return (cuts, logp, ids, np.repeat(words_in, count), *more) if full else (cuts, logp, ids)


def _opened(lat: Lattices, near, after: np.ndarray, bound: np.ndarray):
    """Log-probability before each token, perturbed values of the subtrees beside the tokens, and log-probability behind each branch."""
    cuts, logp, _, _, _, edge, v = near
    n = np.diff(cuts)
    run = np.append(0.0, np.cumsum(logp))
    behind = after + run[cuts[1:]] - run[cuts[:-1]]
    before = run[:-1] + np.repeat(after - run[cuts[:-1]], n)
    return before, _truncated(before + lat.shut.take(edge), np.repeat(bound, n), v), behind


def _record(lat: Lattices, todo, near, far, paths, queues, want: int, again) -> None:
    """Record the leaf of each descent, and open the `want` best subtrees beside it; again(i): the i-th descent in full."""
    after, bound = (np.array([x[j] for x in todo]) for j in (4, 5))
    before, value, behind = _opened(lat, near, after, bound)
    rest = np.append(0.0, np.cumsum(far[1]))
    total = (behind + rest[far[0][1:]] - rest[far[0][:-1]]).tolist()
    cuts, ends = near[0].tolist(), far[0].tolist()
    for i, (d, _, _, head, _, g) in enumerate(todo):
        a, b, lo, hi = cuts[i], cuts[i + 1], ends[i], ends[i + 1]
        s = len(paths[d])
        v = value[a:b]
        top = np.argpartition(-v, want)[:want] if b - a > want else np.arange(b - a)
        _, _, _, inst, place, edge, _ = near
        ahead, ids = before, np.concatenate([head, near[2][a:b], far[2][lo:hi]])
        if hi > lo and (len(top) < want or v[top].min() <= behind[i] + HIGHEST):  # subtrees behind the first words may be among the best
            whole = again(i)
            _, _, _, inst, place, edge, _ = whole
            a, b = 0, len(edge)
            ahead, v, _ = _opened(lat, whole, after[i : i + 1], bound[i : i + 1])
            top = np.argpartition(-v, want)[:want] if b > want else np.arange(b)
        paths[d].append(_Path(ids, len(head), inst[a:b], place[a:b], ahead[a:b], total[i], g))
        for j, y in zip(top.tolist(), v[top].tolist(), strict=True):
            if y > -math.inf:
                heapq.heappush(queues[d], (-y, (s, j), s, j, (int(edge[a + j]),)))


def _spelled(model: Model, ids: np.ndarray) -> np.ndarray:
    """Ids with each byte-fallback character (held as -1 - code point) as its bytes' ids."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids
    parts, done = [], 0
    for i in odd.tolist():
        parts += [ids[done:i], np.array([model.bytes[x] for x in chr(-1 - int(ids[i])).encode("utf-8", "surrogatepass")], np.int32)]
        done = i + 1
    return np.concatenate([*parts, ids[done:]])


def decode(model: Model, ids) -> str:
    """The text of piece ids: bytes joined, white space unescaped, the leading one dropped."""
    out, held = [], bytearray()
    for i in ids:
        piece = model.pieces[i]
        if model.sp.is_byte(int(i)):
            held.append(int(piece[3:5], 16))
            continue
        if held:
            out.append(held.decode("utf-8", "replace"))
            held = bytearray()
        out.append(piece)
    if held:
        out.append(held.decode("utf-8", "replace"))
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if text[:1] == " " else text


def decoded(model: Model, samples: list[np.ndarray]) -> list[bytes]:
    """The UTF-8 of `decode` for many samples at once: the pieces' bytes are gathered together."""
    if model.flat is None:
        model.flat = pa.array([bytes([int(p[3:5], 16)]) if model.sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)], pa.large_binary())
    spelled = model.flat.take(pa.array(np.concatenate(samples) if samples else _NONE))
    _, ends, whole = spelled.buffers()
    ends = np.frombuffer(ends, np.int64)[spelled.offset : spelled.offset + len(spelled) + 1] if len(spelled) else np.zeros(1, np.int64)
    whole = memoryview(whole) if whole is not None else memoryview(b"")
    at = ends[np.cumsum([0, *map(len, samples)])].tolist()
    return [bytes(whole[a + 1 if b > a and whole[a] == 32 else a : b]) for a, b in zip(at[:-1], at[1:], strict=True)]


OUT = "rank int, n_pieces int, logp double, perturbed double, inclusion double"


def _blocks(keys: list[int], texts: list[bytes], chars: int = 400_000) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total > chars:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_SHARED: dict = {}


def shared_lattices(model_path: str, alpha: float) -> Lattices:
    """The lattices of this Python worker, which its later tasks find again (a function of the module, so that Spark ships no copy)."""
    if (model_path, alpha) not in _SHARED:
        _SHARED[model_path, alpha] = Lattices(Model(model_path, alpha))
    return _SHARED[model_path, alpha]


def sample_segmentations(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", k: int = 4, alpha: float = 1.0, model_path: str = MODEL, with_ids: bool = True) -> DataFrame:
    """One row per row and sample: key, rank, n_pieces, logp, perturbed, inclusion, ids_crc32, decoded (whether the sample gives the
    text back), ids."""
    kind = docs.schema[key_col].dataType.simpleString()

    def run(batches):
        lat = shared_lattices(model_path, alpha)
        for b in batches:
            all_keys, seeds, all_texts = b.column(0), b.column(1).to_numpy(zero_copy_only=False), [t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()]
            for lo, hi in _blocks(seeds, all_texts):
                texts = all_texts[lo:hi]
                with np.errstate(over="ignore"):
                    got = sample(lat, seeds[lo:hi].view(np.uint64), texts, k)
                back = iter(decoded(lat.model, [x[3] for found in got for x in found]))
                rows = []
                for i, (text, found) in enumerate(zip(texts, got, strict=True)):
                    for rank, (lp, gv, inc, ids) in enumerate(found):
                        rows.append((lo + i, rank, len(ids), lp, gv, inc, zlib.crc32(ids.astype("<i4", copy=False)), next(back) == text, ids))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
                arrays = [all_keys.take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:8], (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()), strict=True)]]
                if with_ids:
                    ends = np.cumsum([0, *map(len, cols[8])]).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(ends, np.concatenate(cols[8]) if cols[8] else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(arrays, [key_col, "rank", "n_pieces", "logp", "perturbed", "inclusion", "ids_crc32", "decoded", *(["ids"] if with_ids else [])])

    key = F.col(key_col)
    if isinstance(docs.schema[key_col].dataType, NumericType):  # a null key counts as 0; xxhash64 passes over one of another type
        key = F.coalesce(key, F.lit(0))
    rows = docs.select(F.col(key_col), F.xxhash64(F.lit("segmentation"), key).alias("_seed"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"`{key_col}` {kind}, {OUT}, ids_crc32 long, decoded boolean" + (", ids array<int>" if with_ids else ""))


def op5_gumbel_segmentation(spark, sf_dir):
    from .common import table

    return sample_segmentations(table(spark, sf_dir, "documents"))
