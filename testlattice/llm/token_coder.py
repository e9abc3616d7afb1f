"""An adaptive context-mixing range coder for token ids, in many lanes side by side.

A block of ids is coded on its own, in lanes of LANE ids that share one model; the model starts from the same state in every block and learns from the first TEACHERS
lanes of the block after each *stretch* of up to STRETCH steps. Three predictions are mixed. Order 2 and order 1 name one id each, one that came after the same two ids or the
same id (by hashed tables), with a trust; order 0 is a distribution over all ids, adaptive in groups of neighbouring ids. For every trust the block learns how often such a
prediction comes true; these rates are the mixing weights. An id's interval on the line [0, TOTAL) is

    order 2's id: [0, a2)    order 1's id: [a2, b)    any other id: b + its interval of order 0, scaled to what is left

and drives a 64-bit range coder with 32-bit output words and carry, one a lane. Every step treats one id of all lanes in numpy; what needs no earlier step is done for a
whole stretch. Encoder and decoder run the same model.

A coded block is the number of words of each lane (u16), then the lanes' words (u32), one lane after the other; its number of ids is kept by the caller.
"""

from __future__ import annotations

import numpy as np

LANE, STRETCH, TEACHERS, ID_BITS = 1024, 16, 256, 16
IDS, GROUP_BITS = 1 << ID_BITS, 7
GROUP, GROUPS = 1 << GROUP_BITS, 1 << (ID_BITS - GROUP_BITS)
SLOT_BITS, LEVELS = 14, 8
SLOTS = 1 << SLOT_BITS
TOTAL_BITS, SUM_BITS, REBUILD, GAIN = 28, 14, 64, 24
TOTAL = 1 << TOTAL_BITS
FINE_BITS = SUM_BITS + GROUP_BITS
#: Steps after which the model learns.
EDGES = [1, 2, 4, 8, *range(STRETCH, LANE + 1, STRETCH)]
_U, _LOW = np.uint64, np.uint64(0xFFFFFFFF)


def shape(n: int) -> tuple[int, int]:
    """Lanes, and steps of each, of a block of ``n`` ids; what is missing in the last lane is filled with the last id."""
    steps = next((e for e in EDGES if e >= n), LANE)
    return -(-n // steps), steps


class Model:
    """State of blocks with ``lanes`` lanes each. Rows 0 and 1 of paired arrays belong to order 2 and order 1."""

    def __init__(self, lanes: list[int]):
        m = self.m = len(lanes)
        block = np.repeat(np.arange(m), lanes)
        before = np.cumsum([0, *lanes])
        self.teachers = [before[k] + np.arange(min(n, TEACHERS)) for k, n in enumerate(lanes)]
        self.slot0 = np.arange(2)[:, None] * (m << SLOT_BITS) + (block << SLOT_BITS)
        self.level0, self.group0, self.line0 = block * (LEVELS * LEVELS), block * (GROUPS + 1), block << SUM_BITS
        self.guess = np.full(2 * m << SLOT_BITS, IDS << 3, np.int32)  # id and trust of three bits; a trust of 0 is no prediction
        self.hits = np.tile(np.arange(LEVELS) * 256 + 77, (2, m, 1))
        self.tries = np.full((2, m, LEVELS), 9 * 256)
        self.count = np.tile(np.maximum(1, 4000 // (np.arange(GROUPS + 1) + 8)), (m, 1))
        self.sums = np.zeros((m, GROUPS + 1), np.int64)
        self.inverse = np.zeros((m, 1 << SUM_BITS), np.int16)
        self.weigh()
        self.rebuild()

    def weigh(self) -> None:
        """Weights of orders 2 and 1, by their trusts, from the rates."""
        rate = np.clip((self.hits << 16) // self.tries, 16, 65300)
        rate[:, :, 0] = 0
        span = TOTAL - (TOTAL >> 7)
        a2 = span * rate[0] >> 16
        self.a2 = np.repeat(a2.reshape(-1), LEVELS)
        self.b = (a2[:, :, None] + ((span - a2)[:, :, None] * rate[1][:, None, :] >> 16)).reshape(-1)

    def rebuild(self) -> None:
        """Order 0 from the counts: sums to 2^SUM_BITS, one at least for each group, and the group at each place of the line."""
        own = np.cumsum(self.count[:, :GROUPS], axis=1)
        self.sums[:, 1:] = own * ((1 << SUM_BITS) - GROUPS) // own[:, -1:] + np.arange(1, GROUPS + 1)
        for sums, inverse in zip(self.sums, self.inverse, strict=True):
            inverse[:] = np.repeat(np.arange(GROUPS, dtype=np.int16), np.diff(sums))
        self.flat_sums, self.flat_inverse = self.sums.reshape(-1), self.inverse.reshape(-1)

    def slots(self, one: np.ndarray, two: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the tables for the last id and the one before."""
        return ((one * 40503 + two * 2654435) >> 4 & SLOTS - 1) + self.slot0[0, :n], ((one * 40503 >> 2) & SLOTS - 1) + self.slot0[1, :n]

    def weights(self, held2: np.ndarray, held1: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Named ids of orders 2 and 1, and the ends of their intervals."""
        at = ((held2 & 7) << 3) + (held1 & 7) + self.level0[:n]
        named2, named1 = held2 >> 3, held1 >> 3
        a2 = self.a2.take(at)
        return named2, named1, a2, np.where(named2 == named1, a2, self.b.take(at))

    def taught(self, blocks: int, n: int) -> np.ndarray | slice:
        """The lanes, of the first ``blocks`` with ``n`` in all, that the model learns from."""
        at = np.concatenate(self.teachers[:blocks])
        return at if len(at) < n else slice(None, n)

    def learn(self, ids: np.ndarray, slots: list[np.ndarray], held: list[np.ndarray], at: np.ndarray | slice, blocks: int, step: int) -> None:
        """``ids`` (steps by lanes) of the lanes ``at``, with what the tables held for them."""
        fresh, missed = (ids << 3 | 1).astype(np.int32), np.ones(ids.shape, bool)
        by_level, size = self.level0[at] >> 3, blocks * LEVELS
        for k in range(2):
            trust, hit = held[k] & 7, held[k] >> 3 == ids
            self.guess[slots[k].reshape(-1)] = np.where(hit, held[k] + (trust < 7), np.where(trust > 2, held[k] - 2, fresh)).reshape(-1)
            level = by_level + trust
            self.tries[k, :blocks] += (np.bincount(level.reshape(-1), minlength=size) << 8).reshape(blocks, LEVELS)
            self.hits[k, :blocks] += (np.bincount(level[hit], minlength=size) << 8).reshape(blocks, LEVELS)
            missed &= ~hit
        old = self.tries > 1 << 22
        self.tries[old] >>= 1
        self.hits[old] >>= 1
        group = ((ids >> GROUP_BITS) + self.group0[at])[missed]
        self.count[:blocks] += GAIN * np.bincount(group, minlength=blocks * (GROUPS + 1)).reshape(blocks, GROUPS + 1)
        self.weigh()
        if step % REBUILD == 0 or step & (step - 1) == 0:
            self.rebuild()

    def interval(self, ids: np.ndarray, b: np.ndarray, group0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of ids' intervals by order 0."""
        at, inner, a0 = group0 + (ids >> GROUP_BITS), ids & (GROUP - 1), TOTAL - b
        low = self.flat_sums.take(at)
        width = self.flat_sums.take(at + 1) - low
        fine = (low << GROUP_BITS) + width * inner
        first = a0 * fine >> FINE_BITS
        return b + first, (a0 * (fine + width) >> FINE_BITS) - first


def _plan(sizes: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Blocks with the longest lanes first; lanes and steps of each."""
    shapes = [shape(n) for n in sizes]
    order = sorted(range(len(sizes)), key=lambda i: -shapes[i][1])
    return order, [shapes[i][0] for i in order], [shapes[i][1] for i in order]


def _stretches(steps: list[int], lanes: list[int]):
    """First and last step of each stretch, with the number of lanes and blocks that have it."""
    first = 0
    for edge in EDGES:
        blocks = sum(s >= edge for s in steps)
        if not blocks:
            return
        yield first, edge, sum(lanes[:blocks]), blocks
        first = edge


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded form of each block of ids below IDS."""
    coded = [b""] * len(blocks)
    some = [i for i, b in enumerate(blocks) if len(b)]
    order, lanes, steps = _plan([len(blocks[i]) for i in some])
    whole = sum(lanes)
    grid = np.zeros((max(steps, default=0) + 2, whole), np.int64)  # two rows of zeros come before the first step
    at = 0
    for i, n, s in zip(order, lanes, steps, strict=True):
        own = np.full(n * s, blocks[some[i]][-1], np.int64)
        own[: len(blocks[some[i]])] = blocks[some[i]]
        grid[2 : s + 2, at : at + n] = own.reshape(n, s).T
        at += n
    model, low, reach = Model(lanes), np.zeros(whole, _U), np.full(whole, 0xFFFFFFFFFFFFFFFF, _U)
    out, used = np.zeros((max(steps, default=0) + 3, whole), np.uint64), np.zeros(whole, np.int64)
    for first, last, n, m in _stretches(steps, lanes):
        ids = grid[first + 2 : last + 2, :n]
        slots = model.slots(grid[first + 1 : last + 1, :n], grid[first:last, :n], n)
        held = [model.guess.take(s) for s in slots]
        named2, named1, end2, end1 = model.weights(*held, n)
        is2, is1 = named2 == ids, named1 == ids
        start = np.where(is2, 0, end2)
        size = np.where(is2, end2, end1 - end2)
        other = ~(is2 | is1)
        start[other], size[other] = model.interval(ids[other], end1[other], np.broadcast_to(model.group0[:n], ids.shape)[other])
        start, size = start.view(_U), size.view(_U)
        lo, re, us = low[:n], reach[:n], used[:n]
        for k in range(last - first):
            r = re >> _U(TOTAL_BITS)
            new = lo + start[k] * r
            over = np.flatnonzero(new < lo)
            if len(over):
                out[us[over] - 1, over] += _U(1)  # carries are spread at the end
            lo[:] = new
            np.multiply(size[k], r, out=re)
            full = np.flatnonzero(re <= _LOW)
            if len(full):
                part = lo[full]
                out[us[full], full] = part >> _U(32)
                us[full] += 1
                lo[full] = part << _U(32)
                re[full] <<= _U(32)
        at = model.taught(m, n)
        model.learn(ids[:, at], [x[:, at] for x in slots], [x[:, at] for x in held], at, m, last)
    every = np.arange(whole)
    ends = low + _LOW  # reach is 2^32 at least, so one word names a point within
    over = np.flatnonzero(ends < low)
    out[used[over] - 1, over] += _U(1)
    out[used, every] = ends >> _U(32)
    used += 1
    carry = np.zeros(whole, _U)
    for k in range(int(used.max(initial=0)) - 1, -1, -1):
        out[k] += carry
        carry = out[k] >> _U(32)
    words, at = out.T.astype("<u4"), 0
    for i, n in zip(order, lanes, strict=True):
        own = used[at : at + n]
        coded[some[i]] = own.astype("<u2").tobytes() + words[at : at + n][np.arange(words.shape[1]) < own[:, None]].tobytes()
        at += n
    return coded


def decode(coded: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Ids of each block from its coded form and number of ids."""
    found = [np.zeros(0, np.int64)] * len(coded)
    some = [i for i, n in enumerate(lengths) if n]
    order, lanes, steps = _plan([lengths[i] for i in some])
    whole, heads = sum(lanes), []
    for i, n in zip(order, lanes, strict=True):
        data = coded[some[i]]
        heads.append(np.frombuffer(data[: 2 * n], "<u2").astype(np.int64))
        if len(heads[-1]) != n or len(data) != 2 * n + 4 * heads[-1].sum():
            raise ValueError("a block's code is not as long as its lanes say")
    words = np.zeros((whole, max((int(h.max()) for h in heads), default=0) + 3), np.uint32)
    at = 0
    for i, n, own in zip(order, lanes, heads, strict=True):
        words[at : at + n][np.arange(words.shape[1]) < own[:, None]] = np.frombuffer(coded[some[i]], "<u4", offset=2 * n)
        at += n
    width, words = words.shape[1], words.reshape(-1)
    base = np.arange(whole) * width
    most = base + width - 1  # damaged code may ask for more words than there are
    code = words[base].astype(_U) << _U(32) | words[base + 1]
    reach, used = np.full(whole, 0xFFFFFFFFFFFFFFFF, _U), base + 2
    grid, model = np.zeros((max(steps, default=0) + 2, whole), np.int64), Model(lanes)
    for first, last, n, m in _stretches(steps, lanes):
        co, re, us, group0, line0 = code[:n], reach[:n], used[:n], model.group0[:n], model.line0[:n]
        at, slots, held = model.taught(m, n), ([], []), ([], [])
        for k in range(first, last):
            slot2, slot1 = model.slots(grid[k + 1, :n], grid[k, :n], n)
            held2, held1 = model.guess.take(slot2), model.guess.take(slot1)
            named2, named1, end2, end1 = model.weights(held2, held1, n)
            r = re >> _U(TOTAL_BITS)
            value = np.minimum(co // r, _U(TOTAL - 1)).view(np.int64)
            is2 = value < end2
            ids = np.where(is2, named2, named1).astype(np.int64)
            start = np.where(is2, 0, end2)
            size = np.where(is2, end2, end1 - end2)
            other = np.flatnonzero(value >= end1)
            if len(other):
                b, groups = end1[other], group0[other]
                fine = (((value[other] - b + 1) << FINE_BITS) - 1) // (TOTAL - b)
                group = model.flat_inverse.take(line0[other] + (fine >> GROUP_BITS)).astype(np.int64)
                low = model.flat_sums.take(groups + group)
                span = model.flat_sums.take(groups + group + 1) - low
                own = (group << GROUP_BITS) + (fine - (low << GROUP_BITS)) // span
                ids[other] = own
                start[other], size[other] = model.interval(own, b, groups)
            co -= start.view(_U) * r
            np.multiply(size.view(_U), r, out=re)
            full = np.flatnonzero(re <= _LOW)
            if len(full):
                place = us[full]
                co[full] = co[full] << _U(32) | words.take(place)
                us[full] = np.minimum(place + 1, most[full])
                re[full] <<= _U(32)
            grid[k + 2, :n] = ids
            for kept, own in zip((*slots, *held), (slot2, slot1, held2, held1), strict=True):
                kept.append(own[at])
        model.learn(grid[first + 2 : last + 2, :n][:, at], [np.stack(s) for s in slots], [np.stack(h) for h in held], at, m, last)
    at = 0
    for i, n, s in zip(order, lanes, steps, strict=True):
        found[some[i]] = grid[2 : s + 2, at : at + n].T.reshape(-1)[: lengths[some[i]]]
        at += n
    return found
