"""Adaptive context-mixing range coder for token ids.

A block of ids is coded by itself: all models start anew, and its header carries checksums.  The next id is
predicted by three orders.  Order 2 and order 1 each name one id, the one that lately followed the two ids or the id
before, with a confidence; order 0 is the distribution of the ids seen in the block; ids that it leaves out (not yet
seen, or very rare) are uniform.  A block mixes them into one distribution, whose weights come from how often each
order was right at those confidences.  It drives the arithmetic coding: one range step an id.

A block is cut into lanes of consecutive ids, which share the block's models and are coded in step: numpy treats one
place of all lanes at once.  The models are renewed from all lanes after 1, 2, 4, 8, 16 and then every 32 places, to the
end of the block.  Ranges are whole numbers under 2 ** 53, which doubles hold exactly, and every quotient is far enough
from the next whole number; so any machine decodes what another wrote.

Special cases: no ids make no block; ids may be any unsigned 32-bit integers, as a block of ids from 2 ** 18 on
codes ranks among its distinct ids, which it lists, and is shorter where there would be over 2 ** 18 of these; what
coding would lengthen (the list included) is stored as it is.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 21
#: Places of a lane, but for blocks so large that they would need more lanes than ``LANES``.
PLACES, LANES = 256, 8192
#: Order 1 and the weights learn from one place in ``THIN``: over 9.3 million ids that took 0.04 % less room than all places.
RENEWED, THIN = 32, 4
#: Bits of the mixture's weights and of the order-0 distribution under a weight.
MIX, ZERO = 12, 16
WHOLE = float(1 << MIX + ZERO)
ID, SURE = 18, 3  # bits of an id and of a confidence in the tables
KNOWN, MOST = (1 << ID) - 1, (1 << SURE) - 1
ROWS = 2 << 2 * SURE  # by order 1's confidence, order 2's, and whether both name one id
ORDER2 = 17  # bits of the hashed table
SPREAD = 0x2F0B
LOW, DIGIT = float(1 << 32), float(1 << 16)  # of the range, 32 to 48 bits wide
HEADER = struct.Struct("<4sBIIII")  # magic, mode, ids, crc of the ids, bytes of the body, crc of header and body
SHAPE = struct.Struct("<III")  # lanes, ids are under this, distinct ids listed
MAGIC = b"LQT2"
RAW, CODED = 0, 1
#: By twice a confidence, and one more if the named id was right: the new confidence, and all bits set if the id goes.
AFTER = np.array([1, 1, *(x for c in range(1, MOST + 1) for x in (max(c >> 1, 1), min(c + 1, MOST)))], np.int32)
GOES = np.array([-1, -1, -1, 0, *[0] * (2 * MOST - 2)], np.int32)


class Models:
    """The models of a block of ids under ``size``; ``slots`` also keeps what decoding looks up."""

    def __init__(self, size: int, slots: bool) -> None:
        self.size = size
        self.table1, self.table2 = np.zeros(size, np.int32), np.zeros(1 << ORDER2, np.int32)
        self.seen = np.zeros((ROWS, 2, 2), np.int64)  # by row, whether order 2 was right, and order 1
        self.counts = np.zeros(size, np.int64)
        self.before, self.often = np.zeros(size), np.zeros(size)  # order 0: frequencies before and own
        self.slots, self.ranked = (np.zeros(1 << ZERO, np.uint16), np.zeros(1, np.int64)) if slots else (None, None)
        self.ranked_before = self.ranked_often = np.zeros(1)
        self.mix()

    def mix(self) -> None:
        """By row: ends of the parts of order 2, 1 and 0, and the weights of order 0 and of a uniform id."""
        row = np.arange(ROWS)
        sure1, sure2 = row & MOST, row >> SURE & MOST
        total, whole = int(self.counts.sum()), 1 << MIX
        tries, two = self.seen.sum((1, 2)) * 2 + 4, self.seen[:, 1].sum(1)
        one = np.where(sure2 > 0, self.seen[:, 0, 1], self.seen[:, :, 1].sum(1))
        two, one = (np.where(sure > 0, (hits * 2 + 1) * whole // tries, 0) for sure, hits in ((sure2, two), (sure1, one)))
        # uniform: ids that order 0 leaves out, and as often as ids were seen once there are new ones
        fresh = total - int(self.counts @ (self.often > 0)) + np.count_nonzero((self.counts == 1) & (self.often > 0))
        rare = max(16, min(whole // 2, whole * fresh // max(1, total)))
        two = np.minimum(two, whole - 96)
        one = np.minimum(one, whole - 96 - two)
        rest = whole - two - one
        zero = rest - np.maximum(16, np.minimum(rare, rest // 2)) if total else np.zeros(ROWS, np.int64)
        ends = np.stack((two, two + one, two + one + zero)) << ZERO
        self.e2, self.e1, self.e0 = ends.astype(float)
        self.w0 = zero.astype(float)
        self.share = np.maximum(zero, 2.0**-30)
        if not total:  # at a block's start, when nothing is named: all is beyond order 0
            self.e1[:] = -1.0
        self.u = (((whole << ZERO) - ends[2]) // self.size).astype(float)

    def look(self, one: np.ndarray, two: np.ndarray, at: np.ndarray, t1: np.ndarray, t2: np.ndarray, row: np.ndarray) -> None:
        """After the ids ``two``, ``one``: where order 2 keeps what it names, what both orders name, with confidences, and the row of the mixture."""
        np.multiply(one, SPREAD, out=at)
        at ^= two
        at &= (1 << ORDER2) - 1
        self.table1.take(one, out=t1, mode="clip")
        self.table2.take(at, out=t2, mode="clip")
        same = t1 ^ t2
        same &= KNOWN
        x = t2 >> ID
        x += t1 >> ID
        x += (same == 0) * np.int32(ROWS // 2)
        row[...] = x

    def note(self, own: np.ndarray, one: np.ndarray, at: np.ndarray, t1: np.ndarray, t2: np.ndarray, row: np.ndarray) -> None:
        """Takes up ids (places x lanes) that came after ``one``; order 1 and the weights from one place in ``THIN``."""
        thin = slice(None, None, THIN)
        hits = [self.follow(own[thin], one[thin], t1[thin], self.table1, ID)]
        for k in range(0, len(own), THIN):  # a few places at a time stay in the cache
            z = slice(k, k + THIN)
            hit = self.follow(own[z], at[z], t2[z], self.table2, ID + SURE)
            hits.append(hit[:1])
        key = row[thin] * 4 + hits[0] + np.concatenate(hits[1:]) * 2
        self.seen += np.bincount(key.ravel(), minlength=ROWS * 4).reshape(ROWS, 2, 2)
        self.counts += np.bincount(own.ravel(), minlength=self.size)
        f = np.floor(self.counts * ((1 << ZERO) / self.counts.sum()))
        f[np.argmax(f)] += (1 << ZERO) - f.sum()
        self.before, self.often = np.cumsum(f) - f, f
        if self.slots is not None:
            found = np.flatnonzero(f)
            self.slots = np.repeat(np.arange(len(found), dtype=np.uint16), f[found].astype(np.int64))
            self.ranked, self.ranked_before, self.ranked_often = found, self.before[found], self.often[found]
        self.mix()

    @staticmethod
    def follow(own: np.ndarray, at: np.ndarray, past: np.ndarray, table: np.ndarray, bit: int) -> np.ndarray:
        """Whether what was named came; and the table names what came, or keeps a name of some confidence."""
        key = past >> bit
        known = key > 0
        wrong = past ^ own.astype(np.int32)
        wrong &= KNOWN
        hit = wrong == 0
        key += key
        key += hit
        wrong &= GOES.take(key, mode="clip")
        named = past & KNOWN
        named ^= wrong
        named |= AFTER.take(key, mode="clip") << bit
        table[at.ravel()] = named.ravel()  # the last of equal places stays
        hit &= known
        return hit

    def steps(self, own: np.ndarray, t1: np.ndarray, t2: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size, of WHOLE, of each id."""
        own, t1, t2, row = own.ravel(), t1.ravel(), t2.ravel(), row.ravel()
        e2, e1, w0 = (x.take(row, mode="clip") for x in (self.e2, self.e1, self.w0))
        part = self.often.take(own, mode="clip")
        part *= w0
        start = self.before.take(own, mode="clip")
        start *= w0
        start += e1
        if len(k := np.flatnonzero(part == 0)):
            u = self.u[row[k]]
            start[k], part[k] = self.e0[row[k]] + own[k] * u, u
        t1 = t1 ^ own
        t1 &= KNOWN
        k = np.flatnonzero((t1 == 0) & (e1 > e2))
        start[k], part[k] = e2[k], e1[k] - e2[k]
        t2 = t2 ^ own
        t2 &= KNOWN
        k = np.flatnonzero((t2 == 0) & (e2 > 0))
        start[k], part[k] = 0.0, e2[k]
        return start, part


def spans(places: int) -> list[tuple[int, int]]:
    """Places between renewals."""
    ends = [x for x in (1, 2, 4, 8, 16, *range(RENEWED, places, RENEWED)) if x < places]
    return list(zip([0, *ends], [*ends, places], strict=True))


def shape(n: int) -> tuple[int, int]:
    """Lanes and places of n ids."""
    lanes = max(1, min(LANES, -(-n // PLACES)))
    return lanes, -(-n // lanes)


def looks(places: int, lanes: int) -> tuple[np.ndarray, ...]:
    """Room for what ``Models.look`` says at some places."""
    return tuple(np.empty((places, lanes), kind) for kind in (np.int64, np.int32, np.int32, np.int64))


def encode_block(ids: np.ndarray) -> bytes:
    """The coded body of a block."""
    listed = np.zeros(0, "<u4")
    own = ids.astype(np.int64)
    if int(ids.max()) > KNOWN:
        listed, own = np.unique(ids, return_inverse=True)
    size = int(own.max()) + 1
    lanes, places = shape(len(ids))
    past = np.zeros((places + 2, lanes), np.int64)  # two zeros go before a lane, and zeros fill the last
    past[2:] = np.concatenate((own, np.zeros(lanes * places - len(own), np.int64))).reshape(lanes, places).T
    models, seen = Models(size, False), looks(RENEWED, lanes)
    low, width, step = np.zeros(lanes), np.full(lanes, LOW * DIGIT), np.empty(lanes)
    shifted, digits = [np.zeros(0, np.int64)], [np.zeros(0)]  # by step: lanes, and the digits that left them

    for first, last in spans(places):
        for a in range(first, last, 4):
            z = min(a + 4, last)
            part = [x[a - first : z - first] for x in seen]
            now = past[a + 2 : z + 2]
            models.look(past[a + 1 : z + 1], past[a:z], *part)
            starts, sizes = models.steps(now, *part[1:])
            for start, size_ in zip(starts.reshape(now.shape), sizes.reshape(now.shape), strict=True):
                np.multiply(width, 1 / WHOLE, out=step)
                np.floor(step, out=step)
                np.multiply(size_, step, out=width)
                step *= start
                np.add(low, step, out=low)
                k = np.flatnonzero(width < LOW)
                while len(k):
                    x = low[k]
                    d = np.floor(x * (1 / LOW))  # 16 bits and a carry
                    shifted.append(k)
                    digits.append(d)
                    x -= d * LOW
                    x *= DIGIT
                    low[k] = x
                    x = width[k]
                    x *= DIGIT
                    width[k] = x
                    k = k[x < LOW]
        if last < places:
            models.note(past[first + 2 : last + 2], past[first + 1 : last + 1], *(x[: last - first] for x in seen))
    low = np.ceil(low / DIGIT) * DIGIT  # a value within the range that ends in a digit of zeros
    upper = np.floor(low / LOW)
    return SHAPE.pack(lanes, size, len(listed)) + listed.astype("<u4").tobytes() + dealt(np.concatenate(shifted), np.concatenate(digits), upper, (low - upper * LOW) / DIGIT)


def dealt(shifted: np.ndarray, digits: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> bytes:
    """Three digits a lane, then the others in the order in which decoding takes them.

    Decoding shifts a lane's digit in where coding shifted one out, three digits later; the last are ``upper``, ``lower`` and a zero.
    """
    order = np.argsort(shifted.astype(np.uint16), kind="stable")
    n = np.bincount(shifted, minlength=len(upper))
    ends = np.cumsum(n + 3)
    first = np.zeros(int(ends[-1]), bool)
    for k in range(3):
        first[ends - n - 3 + k] = True
    lane = np.zeros(len(first), np.int64)
    last = ends - 3
    tail = np.zeros(len(first), bool)
    for k in range(3):
        tail[last + k] = True
    lane[~tail] = digits[order]
    lane[last], lane[last + 1] = upper, lower
    while (carry := lane >> 16).any():  # carries go to the digit before
        lane &= 0xFFFF
        lane[:-1] += carry[1:]
    rest = np.empty(len(digits), "<u2")
    rest[order] = lane[~first]
    return lane[first].astype("<u2").tobytes() + rest.tobytes()


def decode_block(body: bytes, n: int) -> np.ndarray:
    """The n ids of a coded body."""
    lanes, size, n_listed = SHAPE.unpack_from(body)
    listed = np.frombuffer(body, "<u4", n_listed, SHAPE.size)
    digits = np.frombuffer(body, "<u2", offset=SHAPE.size + 4 * n_listed)
    places = -(-n // lanes)
    past = np.zeros((places + 2, lanes), np.int64)
    models, seen = Models(size, True), looks(RENEWED, lanes)
    first3 = digits[: 3 * lanes].astype(float).reshape(lanes, 3)
    code, taken = (first3[:, 0] * DIGIT + first3[:, 1]) * DIGIT + first3[:, 2], 3 * lanes
    width, r, slot, q, e1, w0, share, start, part = (np.full(lanes, LOW * DIGIT) for _ in range(9))
    for first, last in spans(places):
        for t in range(first, last):
            _, t1, t2, row = at = [x[t - first] for x in seen]
            models.look(past[t + 1], past[t], *at)
            for values, to in ((models.e1, e1), (models.w0, w0), (models.share, share)):
                values.take(row, out=to, mode="clip")
            np.multiply(width, 1 / WHOLE, out=r)
            np.floor(r, out=r)
            np.divide(code, r, out=slot)
            np.floor(slot, out=slot)
            np.subtract(slot, e1, out=q)
            q /= share
            # beside order 0 this looks up some id or other, which is replaced below
            rank = models.slots.take(q.astype(np.int64), mode="clip").astype(np.int64)
            own = past[t + 2]
            models.ranked.take(rank, out=own, mode="clip")
            models.ranked_often.take(rank, out=part, mode="clip")
            models.ranked_before.take(rank, out=start, mode="clip")
            part *= w0
            start *= w0
            start += e1
            if len(k := np.flatnonzero(q < 0)):  # named by order 2 or 1
                e2 = models.e2.take(row[k])
                k1, two = np.flatnonzero(slot[k] >= e2), t2[k]
                ends, begins = e2.copy(), np.zeros(len(k))
                at1 = k[k1]
                two[k1], begins[k1], ends[k1] = t1[at1], e2[k1], e1[at1]
                two &= KNOWN
                own[k], start[k] = two, begins
                ends -= begins
                part[k] = ends
            if len(k := np.flatnonzero(q >= 1 << ZERO)):  # uniform
                e0, u = models.e0[row[k]], models.u[row[k]]
                y = np.minimum(np.floor((slot[k] - e0) / u), size - 1.0)
                own[k], start[k], part[k] = y, e0 + y * u, u
            start *= r
            code -= start
            np.multiply(part, r, out=width)
            k = np.flatnonzero(width < LOW)
            while len(k):
                x = code[k]
                x *= DIGIT
                x += digits[taken : taken + len(k)]
                code[k] = x
                taken += len(k)
                x = width[k]
                x *= DIGIT
                width[k] = x
                k = k[x < LOW]
        if last < places:
            models.note(past[first + 2 : last + 2], past[first + 1 : last + 1], *(x[: last - first] for x in seen))
    ids = past[2:].T.ravel()[:n]
    return (listed[ids] if n_listed else ids).astype("<u4")


def pack_block(ids: np.ndarray, mode: int, body: bytes) -> bytes:
    fields = MAGIC, mode, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4")), len(body)
    return HEADER.pack(*fields, zlib.crc32(body, zlib.crc32(HEADER.pack(*fields, 0)))) + body


def blocks(ids: np.ndarray) -> Iterator[np.ndarray]:
    """Cuts of up to ``BLOCK`` ids; of up to 2 ** ``ID`` where more distinct ones than the tables name would meet in a block."""
    for i in range(0, len(ids), BLOCK):
        block = ids[i : i + BLOCK]
        fits = int(block.max()) <= KNOWN or len(np.unique(block)) <= KNOWN + 1
        step = len(block) if fits else KNOWN + 1
        yield from (block[k : k + step] for k in range(0, len(block), step))


def encode(ids: np.ndarray) -> list[bytes]:
    """Coded blocks."""
    ids = np.ascontiguousarray(ids, "<u4")
    out = []
    for block in blocks(ids):
        body = encode_block(block)
        out.append(pack_block(block, CODED, body) if len(body) < 4 * len(block) else pack_block(block, RAW, block.tobytes()))
    return out


class Corrupt(ValueError):
    """A block whose checksum or length doesn't hold."""


def decode(data: bytes) -> np.ndarray:
    """The ids of consecutive blocks; raises Corrupt."""
    out, at = [np.zeros(0, "<u4")], 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise Corrupt("a block's header is cut off")
        magic, mode, n, crc, size, total = HEADER.unpack_from(data, at)
        body = data[at + HEADER.size : at + HEADER.size + size]
        if magic != MAGIC or len(body) != size or zlib.crc32(body, zlib.crc32(HEADER.pack(magic, mode, n, crc, size, 0))) != total:
            raise Corrupt(f"the block at byte {at} fails its checksum")
        ids = decode_block(body, n) if mode == CODED else np.frombuffer(body, "<u4")
        if len(ids) != n or zlib.crc32(np.ascontiguousarray(ids)) != crc:
            raise Corrupt("decoded ids fail their checksum")
        out.append(ids)
        at += HEADER.size + size
    return np.concatenate(out)
