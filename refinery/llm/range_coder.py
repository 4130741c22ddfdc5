"""Adaptive context-mixing range coder for token ids, many blocks at a time.

Blocks are independent: each starts from an empty model.  To keep the work in
vector operations the blocks of a batch are coded in lockstep, one id of every
block per step; block k is lane k.  A single block decodes just as well alone.

Model of one id, all parts adaptive and per block:
  - order 2: the id that last followed the two ids before (hashed table);
  - order 1: the id that last followed the id before;
  - order 0: the counts of the block's ids so far (refreshed at ``REFRESH``);
  - a fixed prior that falls with the id, as byte-pair ids do.
Their mixture codes the id in one step: an id's probability is the sum of what
every order gives it,

    P(x) = w2 [x = id2] + w1 [x = id1] + w0 count(x) / n + wp prior(x),

and its place is the sum of the cumulative probabilities, so the decoder finds
it by binary search.  The weights of orders 2 and 1 are kept per confidence
(hits in a row).  All weights follow the share that their order had in the
probability of the ids coded (online expectation maximisation).

Weights and places are integers of 2**TOTAL_BITS, so that both sides compute
the same.  The coder keeps 48 bits of low and range and puts out 16-bit words.
A carry is added to the last word and resolved when the block ends.
"""

from __future__ import annotations

import numpy as np

BLOCK = 2048
LANES = 1024  # blocks coded together; bounds the memory of a task
REFRESH = (16, 32, 64, 128, 256, 512, 1024)  # powers of 2
TABLE_BITS = 11
LEVELS = 16  # of confidence; 0: the context is new
PRIOR_BITS = 20
TOTAL_BITS = 28
RATE = 5  # weights move by 2**-RATE of the difference
_FLOOR = 1 << PRIOR_BITS  # of the prior's weight: every id can be coded
_ONE = 1 << 16  # of the weights within what higher orders leave
_U = np.uint64
_MASK = _U((1 << 48) - 1)
_LOW = _U(1 << 32)


def prior(vocabulary: int) -> np.ndarray:
    """Cumulative prior of the ids, each at least 1 of 2**PRIOR_BITS."""
    weight = 1.0 / (np.arange(vocabulary) + 64.0)
    count = 1 + np.floor(weight / weight.sum() * ((1 << PRIOR_BITS) - vocabulary)).astype(np.int64)
    count[0] += (1 << PRIOR_BITS) - count.sum()
    return np.concatenate([[0], np.cumsum(count)]).astype(np.int32)


class _Past:
    """Counts of the lanes' ids so far: sorted, behind a sentinel, with the run of equal ids around each place."""

    def __init__(self, ids: np.ndarray, n: int, cum: np.ndarray):
        order = np.argsort(ids[:, :n], axis=1)
        found = np.take_along_axis(ids[:, :n], order, 1)
        change = np.ones((ids.shape[0], n + 1), bool)
        change[:, 1:n] = found[:, 1:] != found[:, :-1]
        place = np.arange(n + 1, dtype=np.int32)
        first = np.maximum.accumulate(np.where(change[:, :n], place[:n], 0), axis=1)
        end = np.minimum.accumulate(np.where(change[:, 1:], place[1:], n)[:, ::-1], axis=1)[:, ::-1]
        #: (first place, end) of the id at each time so far
        self.by_time = np.empty((2, *order.shape), np.int32)
        for side, values in zip(self.by_time, (first, end)):
            np.put_along_axis(side, order, values, 1)
        self.n, self.width = n, n + 1
        padded = np.zeros((4, ids.shape[0], n + 1), np.int32)
        padded[:, :, 1:] = found, first, end, cum[found]
        self.sorted, self.first, self.end, self.cum = (x.ravel() for x in padded)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, end) of each id of the lanes; equal where it did not occur."""
        lane = np.arange(ids.shape[0], dtype=np.int64)[:, None]
        rows = self.sorted.reshape(-1, self.width)[:, 1:]
        keys = (rows + (lane << 32)).ravel()
        at = np.searchsorted(keys, (ids + (lane << 32)).ravel()).reshape(ids.shape) - lane * self.n
        inside = np.minimum(at, self.n - 1)
        there = (at < self.n) & (np.take_along_axis(rows, inside, 1) == ids)
        end = np.take_along_axis(self.end.reshape(-1, self.width)[:, 1:], inside, 1)
        return at.astype(np.int32), np.where(there, end, at).astype(np.int32)


class _Mixer:
    """The predictions and their weights, for the first ``k`` lanes at a step.

    Tables hold the time at which a context's last id stood (from 1; 0: none)
    and its confidence.  ``ids`` are the lanes' ids by time, ``runs`` their
    (first place, end) among the past ones.
    """

    def __init__(self, lanes: int, longest: int):
        self.base = np.arange(lanes, dtype=np.int64)
        self.rows = self.base * (longest + 1)
        self.ids = np.zeros((lanes, longest + 1), np.int32)
        self.runs = np.zeros((2, lanes, longest + 1), np.int32)
        self.table1 = np.zeros(lanes << TABLE_BITS, np.uint16)
        self.table2 = np.zeros(lanes << TABLE_BITS, np.uint16)
        start = np.minimum(6144 + 8192 * np.arange(LEVELS, dtype=np.int32), 49152)
        self.p2, self.p1 = np.tile(start, lanes), np.tile(start // 2, lanes)
        self.p2[::LEVELS] = self.p1[::LEVELS] = 0
        self.p0 = np.full(lanes, 32768, np.int32)
        self.last1 = np.zeros(lanes, np.uint32)
        self.last2 = np.zeros(lanes, np.uint32)

    def predict(self, k: int, n: int) -> None:
        """Set id2, id1, their weights w2 and w1, and the units u0 (of a count of ``n``) and up (of the prior)."""
        self.n, base, shift = n, self.base[:k], np.uint32(32 - TABLE_BITS)
        a = self.last1[:k] * np.uint32(0x9E3779B1)
        self.at1 = (base << TABLE_BITS) + (a >> shift)
        self.at2 = (base << TABLE_BITS) + ((a ^ self.last2[:k] * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
                                           >> shift)
        e1, e2 = self.table1[self.at1], self.table2[self.at2]
        self.c1, self.c2 = e1 & np.uint16(15), e2 & np.uint16(15)
        self.t1, self.t2 = self.rows[:k] + (e1 >> np.uint16(4)), self.rows[:k] + (e2 >> np.uint16(4))
        ids = self.ids.ravel()
        self.id1, self.id2 = ids[self.t1], ids[self.t2]
        self.q1, self.q2 = base * LEVELS + self.c1, base * LEVELS + self.c2
        self.v1, self.v2 = self.p1[self.q1], self.p2[self.q2]
        rest = (1 << TOTAL_BITS) - _FLOOR
        self.w2 = self.v2 * np.int32(rest >> 16)
        rest = rest - self.w2
        self.w1 = (rest >> 16) * self.v1
        rest -= self.w1
        if n:
            self.u0 = (rest >> 16) * self.p0[:k] >> n.bit_length() - 1
            rest -= self.u0 * np.int32(n)
        else:
            self.u0 = np.zeros(k, np.int32)
        self.up = (rest >> PRIOR_BITS) + 1

    def update(self, k: int, t: int, x: np.ndarray, first: np.ndarray, end: np.ndarray, width: np.ndarray) -> None:
        hit2, hit1 = x == self.id2, x == self.id1
        scale = _ONE / width
        r2 = (self.w2 * hit2 * scale).astype(np.int32)
        r1 = (self.w1 * hit1 * scale).astype(np.int32)
        r0 = (self.u0 * (end - first) * scale).astype(np.int32)
        low, high = 256, _ONE - 256
        left = _ONE - r2
        self.p2[self.q2] = np.clip(self.v2 + (r2 - self.v2 >> RATE), low, high)
        # a weight counts within what the orders above leave (halves, so that products stay below 2**31)
        self.p1[self.q1] = np.clip(self.v1 + (r1 - ((self.v1 >> 1) * (left >> 1) >> 14) >> RATE), low, high)
        if self.n:
            p0 = self.p0[:k]
            self.p0[:k] = np.clip(p0 + (r0 - ((p0 >> 1) * (left - r1 >> 1) >> 14) >> RATE), low, high)
        self.p2[:k * LEVELS:LEVELS] = 0
        self.p1[:k * LEVELS:LEVELS] = 0
        top, one, now = np.uint16(LEVELS - 1), np.uint16(1), np.uint16(t + 1 << 4)
        self.table2[self.at2] = now + np.minimum(self.c2 * hit2 + one, top)
        self.table1[self.at1] = now + np.minimum(self.c1 * hit1 + one, top)
        self.last2[:k] = self.last1[:k]
        self.last1[:k] = x


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """The coded words of every block of ids (each at most BLOCK long and not empty)."""
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lanes, longest = len(blocks), len(blocks[order[0]])
    sizes = np.array([len(blocks[i]) for i in order])
    mixer, cum = _Mixer(lanes, longest), prior(vocabulary)
    ids = mixer.ids[:, 1:]
    for lane, i in enumerate(order):
        ids[lane, :sizes[lane]] = blocks[i]
    low, span = np.zeros(lanes, _U), np.full(lanes, _MASK, _U)
    out = np.zeros((lanes, 3 * longest + 8), np.uint32)
    length = np.zeros(lanes, np.int64)
    none = np.zeros(lanes, np.int32)

    edges = [0, *(r for r in REFRESH if r < longest), longest]
    for begin, stop in zip(edges, edges[1:]):
        # step by step, so that the lanes of a step lie together
        part = np.ascontiguousarray(ids[:, begin:stop].T)
        if begin:
            firsts, ends = (np.ascontiguousarray(x.T) for x in _Past(ids, begin, cum).find(part.T))
        p_start = cum[part]
        p_count = cum[part + 1] - p_start
        for t in range(begin, stop):
            j = t - begin
            k = int(np.searchsorted(-sizes, -t))  # lanes that still have an id
            x = part[j, :k]
            mixer.predict(k, begin)
            first, end = (firsts[j, :k], ends[j, :k]) if begin else (none[:k],) * 2
            start = mixer.up * p_start[j, :k] + mixer.w2 * (x > mixer.id2) + mixer.w1 * (x > mixer.id1)
            width = mixer.up * p_count[j, :k] + mixer.w2 * (x == mixer.id2) + mixer.w1 * (x == mixer.id1)
            if begin:
                start += mixer.u0 * first
                width += mixer.u0 * (end - first)
            a, b = low[:k], span[:k]
            b >>= _U(TOTAL_BITS)
            a += b * start.astype(_U)
            b *= width.astype(_U)
            over = np.flatnonzero(a > _MASK)
            if over.size:
                out[over, length[over] - 1] += 1
                a[over] &= _MASK
            while (thin := np.flatnonzero(b < _LOW)).size:
                out[thin, length[thin]] = a[thin] >> _U(32)
                length[thin] += 1
                a[thin] = (a[thin] << _U(16)) & _MASK
                b[thin] <<= _U(16)
            mixer.update(k, t, x, first, end, width)

    for shift in (32, 16, 0):
        out[np.arange(lanes), length] = (low >> _U(shift)) & _U(0xFFFF)
        length += 1
    for i in range(int(length.max()) - 1, 0, -1):  # carries, from the last word to the first
        out[:, i - 1] += out[:, i] >> 16
    words = out.astype("<u2")
    coded: list[bytes] = [b""] * lanes
    for lane, i in enumerate(order):
        coded[i] = words[lane, :length[lane]].tobytes()
    return coded


def decode_blocks(coded: list[bytes], lengths: list[int], vocabulary: int) -> list[np.ndarray]:
    """The ids of every block."""
    order = sorted(range(len(coded)), key=lambda i: -lengths[i])
    lanes, longest = len(coded), lengths[order[0]]
    sizes = np.array([lengths[i] for i in order])
    words = np.zeros((lanes, max(len(c) for c in coded) // 2 + 8), _U)
    for lane, i in enumerate(order):
        one = np.frombuffer(coded[i], "<u2")
        words[lane, :len(one)] = one
    mixer, cum = _Mixer(lanes, longest), prior(vocabulary)
    ids = mixer.ids[:, 1:]
    by_place = np.repeat(np.arange(vocabulary, dtype=np.int32), np.diff(cum))
    value = (words[:, 0] << _U(32)) | (words[:, 1] << _U(16)) | words[:, 2]
    span, at = np.full(lanes, _MASK, _U), np.full(lanes, 3, np.int64)
    none = np.zeros(lanes, np.int32)

    def search(past: _Past, lane: np.ndarray, place: np.ndarray, u0: np.ndarray,
               up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id, first, end) at a place of the cumulative counts and prior."""
        row = lane * past.width
        spot, step = np.zeros(len(lane), np.int64), past.n
        while step:
            ahead = np.minimum(spot + step, past.n)
            i = row + ahead
            spot = np.where(u0 * past.first[i] + up * past.cum[i] <= place, ahead, spot)
            step >>= 1
        i = row + spot
        x, first, end = past.sorted[i], past.first[i], past.end[i]
        behind = (spot == 0) | (place >= u0 * end + up * cum[x + 1])  # after the id's run, in the prior alone
        other = by_place[np.clip((place - u0 * end) // up, 0, (1 << PRIOR_BITS) - 1)]
        return np.where(behind, other, x), np.where(behind, end, first), end

    edges = [0, *(r for r in REFRESH if r < longest), longest]
    for begin, stop in zip(edges, edges[1:]):
        past = None
        if begin:
            past = _Past(ids, begin, cum)
            mixer.runs[:, :, 1:begin + 1] = past.by_time
        runs = mixer.runs.reshape(2, -1)
        for t in range(begin, stop):
            k = int(np.searchsorted(-sizes, -t))
            mixer.predict(k, begin)
            id2, id1, w2, w1, u0, up = mixer.id2, mixer.id1, mixer.w2, mixer.w1, mixer.u0, mixer.up
            a, b = value[:k], span[:k]
            b >>= _U(TOTAL_BITS)
            place = np.minimum(np.floor(a / b), (1 << TOTAL_BITS) - 1).astype(np.int32)
            same = id2 == id1
            start2, start1 = up * cum[id2] + w1 * (id2 > id1), up * cum[id1] + w2 * (id1 > id2)
            stop2 = start2 + up * (cum[id2 + 1] - cum[id2]) + w2 + w1 * same
            stop1 = start1 + up * (cum[id1 + 1] - cum[id1]) + w1 + w2 * same
            first, end = none[:k], none[:k]
            if begin:
                first2, first1 = runs[0, mixer.t2], runs[0, mixer.t1]
                end2, end1 = runs[1, mixer.t2], runs[1, mixer.t1]
                start2 += u0 * first2
                stop2 += u0 * end2
                start1 += u0 * first1
                stop1 += u0 * end1
            hit2 = (place >= start2) & (place < stop2) & (w2 > 0)
            hit1 = (place >= start1) & (place < stop1) & (w1 > 0)
            x = np.where(hit2, id2, id1)
            start, width = np.where(hit2, start2, start1), np.where(hit2, stop2 - start2, stop1 - start1)
            if begin:
                first, end = np.where(hit2, first2, first1), np.where(hit2, end2, end1)
            lane = np.flatnonzero(~(hit2 | hit1))
            if lane.size:
                before = (w2 * (place >= stop2) + w1 * (place >= stop1))[lane]
                v0, vp = u0[lane], up[lane]
                if past:
                    x[lane], first[lane], end[lane] = one = search(past, lane, place[lane] - before, v0, vp)
                    start[lane] = v0 * one[1] + vp * cum[one[0]] + before
                    width[lane] = v0 * (one[2] - one[1]) + vp * (cum[one[0] + 1] - cum[one[0]])
                else:
                    x[lane] = found = by_place[np.clip((place[lane] - before) // vp, 0, (1 << PRIOR_BITS) - 1)]
                    start[lane] = vp * cum[found] + before
                    width[lane] = vp * (cum[found + 1] - cum[found])
            a -= b * start.astype(_U)
            b *= width.astype(_U)
            while (thin := np.flatnonzero(b < _LOW)).size:
                # past the end (of a damaged block) the words are 0
                a[thin] = (a[thin] << _U(16)) | words[thin, np.minimum(at[thin], words.shape[1] - 1)]
                at[thin] += 1
                b[thin] <<= _U(16)
            ids[:k, t] = x
            mixer.runs[0, :k, t + 1] = first
            mixer.runs[1, :k, t + 1] = end
            mixer.update(k, t, x, first, end, width)

    found: list[np.ndarray] = [ids[0]] * lanes
    for lane, i in enumerate(order):
        found[i] = ids[lane, :sizes[lane]].astype(np.uint32)
    return found
