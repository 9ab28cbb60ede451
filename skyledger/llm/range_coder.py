"""Adaptive context-mixing range coder for 16-bit ids, over many blocks at a time.

A block is coded by itself, from a fresh model. Blocks are lanes of numpy arrays that advance
together, one id a step, so the sequential work of adapting is paid once for all of them.

Contexts of order 2, 1 and 0 (the last two ids, the last id, none) predict ids. One range step
decides among the id last seen in the order-2 context, the one last seen in the order-1 context,
and neither; its chances mix the evidence of both orders in the logistic domain. After "neither"
order 0 decides: ids are spread over 256 slots by a bijective hash; the slot is coded under adaptive
frequencies, and then whether the id is the one last seen in that slot. An id that nothing predicts
gives its remaining byte.

Predictions and their records follow every id. Mixing weights, what a record says, and the
frequencies of slots are learned at the steps of `LEARN`, from all ids since the step before. The
model computes in integers only, so that blocks can be decoded on another kind of machine.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

MAGIC = b"IDB2"
HEADER = "<4sIII"  # magic, ids, crc32 of the ids as 32-bit integers, payload bytes
#: log2 of the context slots of a block, of order 1 and order 2.
SLOTS = (11, 12)
STATES = 8  # of a prediction: none yet, then how often in a row it came true
#: After so many ids of a block the model learns, and then after every `ROWS`.
LEARN = (16, 32, 64, 96, 128, 192, 256, 384)
ROWS = 512
#: What the states of order 1 and 2 say before a block has its own counts: chances in 4096ths that
#: the prediction comes true, with the weight of so many ids.
PRIOR = ((40, 1000, 2000, 2600, 3000, 3200, 3400, 3600), (20, 1500, 2500, 3000, 3300, 3500, 3600, 3700))
BELIEF = 4
#: Weights at first, in 65536ths: of order 2 and 1, and a bias in 256ths. For the prediction that
#: both orders share, for order 2's own, and for order 1's own once that is declined.
WEIGHTS = ((45000, 45000, -128), (50000, 0, -128), (0, 50000, -128))
RATE = 11  # log2 of what a gradient is divided by
ADAPT = 5  # the chance that a slot repeats its id moves by 1 / 2**ADAPT of its error
INCREMENT = 24  # of a slot's frequency; frequencies halve when their sum passes LIMIT
LIMIT = 1 << 18
#: An odd factor and its inverse modulo 65536: the bijection of ids to (slot, rest).
SPREAD, GATHER = 40503, pow(40503, -1, 1 << 16)
#: The window of the coder: 62 bits, of which 32 leave when the interval falls below 2**30.
_TIGHT, _KEPT, _WIDE = np.uint64(1 << 30), np.uint64((1 << 30) - 1), (1 << 62) - 1
_2, _3, _8, _12, _16, _30, _32 = map(np.uint64, (2, 3, 8, 12, 16, 30, 32))
#: Logits of chances in 4096ths, and chances in 65536ths of logits from -2047 on, in 256ths.
_STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in range(4096)], np.int32)
_LEAST = 32  # 65536ths that any decision keeps
_SQUASH = np.array([min(max(round(65536 / (1 + math.exp(-z / 256))), _LEAST), 65536 - 2 * _LEAST) for z in range(-2047, 2048)],
                   np.int32)
_TWO = np.dtype([("state", "u2"), ("guess", "u2")])  # both halves of an entry of 32 bits


def crc(ids: np.ndarray, before: int = 0) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes(), before)


class Lanes:
    """The state of several blocks: coder, contexts, predictions and mixing weights. Lanes are
    ordered by falling length; the first `n` of them are still at work."""

    def __init__(self, count: int, data: list[bytes] | None = None):
        self.count, self.decoding, self.steps, self.since = count, data is not None, 0, 0
        self.size = np.full(count, _WIDE, np.uint64)
        self.low = np.zeros(count, np.uint64)  # of the interval; when decoding, how far the code is above it
        if data is None:
            self.width = 3 * ROWS
            self.words = np.zeros(count * self.width, np.uint64)
            self.place = np.arange(count) * self.width
        else:
            self.width = max(map(len, data)) // 4 + 4
            words = np.zeros((count, self.width * 4), np.uint8)
            for i, d in enumerate(data):
                words[i, : len(d)] = np.frombuffer(d, np.uint8)
            words = words.view(">u4").astype(np.uint64)
            self.low[:] = words[:, 0] << _30 | words[:, 1] >> _2
            # Words as they enter the window, two bits off.
            words[:, 1:-1] = (words[:, 1:-1] & _3) << _30 | words[:, 2:] >> _2
            self.words = words.ravel()
            self.place = np.arange(count) * self.width + 1
            self.stop = self.place + (self.width - 3)
        # The ids last seen in the contexts: all lanes of order 1, then all of order 2.
        self.table = np.zeros((count << SLOTS[0]) + (count << SLOTS[1]), np.uint32)
        # What the model says, lanes last: by agreement of the orders, states of order 2 and of order 1.
        self.chance = np.zeros((2, STATES, STATES, count), np.uint32)
        self.seen = np.zeros((2, STATES, count), np.int64)  # of each order and state: predictions
        self.true = np.zeros((2, STATES, count), np.int64)  # and those that came true
        self.weight = np.repeat(np.array(WEIGHTS, np.int32)[:, :, None], count, axis=2)
        self.slot = np.ones((count, 256), np.int32)
        self.bounds = np.zeros(count << 8, np.uint32)  # of each slot: where it begins, and its width
        self.repeat = np.full(count << 8, 1 << 31, np.uint32)  # of each slot: chance to repeat, rest of its last id
        self.inverse = np.zeros(count << 12 if self.decoding else 0, np.uint8)
        self.context = np.zeros((ROWS, count), np.uint16)
        self.second, self.either = np.zeros((ROWS, count), bool), np.zeros((ROWS, count), bool)
        self.escaped: list[np.ndarray] = []
        self.last, self.product = np.zeros(count, np.uint16), np.zeros(count, np.uint16)
        self.keep(count)
        self.learn()

    def keep(self, n: int) -> None:
        """Go on with the first lanes only."""
        self.n = n
        self.last, self.product = self.last[:n], self.product[:n]
        self.lane = np.arange(n)
        self.first = np.stack((self.lane << SLOTS[0], (self.count << SLOTS[0]) + (self.lane << SLOTS[1])))
        self.hash, self.state = np.empty((2, n), np.uint16), np.empty((2, n), np.uint16)
        self.index, self.entry = np.empty((2, n), np.intp), np.empty((2, n), np.uint32)
        self.hit, self.at, self.pair = np.empty((2, n), bool), np.empty(n, np.intp), np.empty(n, np.uint32)
        self.unit, self.a, self.b = np.empty((3, n), np.uint64)

    # ---- The coder: an interval of a 62-bit window for each lane

    def shift(self, lane: np.ndarray) -> None:
        """Pass on a word of each lane whose interval has become tight. A carry stays in a word's
        upper half until the end."""
        if not len(lane):
            return
        place, low = self.place.take(lane, mode="clip"), self.low.take(lane, mode="clip")
        if self.decoding:
            word = self.words.take(np.minimum(place, self.stop.take(lane, mode="clip")), mode="clip")
            self.low[lane] = low << _32 | word
        else:
            self.words[place] = low >> _30
            self.low[lane] = (low & _KEPT) << _32
        self.size[lane] = self.size.take(lane, mode="clip") << _32
        self.place[lane] = place + 1

    def room(self) -> None:
        """Space for the words until the next step of learning: an id gives two at most."""
        used = self.place - np.arange(self.count) * self.width
        if used.max(initial=0) + 2 * ROWS + 2 > self.width:
            words = np.zeros((self.count, 2 * self.width), np.uint64)
            words[:, : self.width] = self.words.reshape(self.count, self.width)
            self.words, self.width = words.ravel(), 2 * self.width
            self.place = used + np.arange(self.count) * self.width

    def finish(self) -> list[bytes]:
        """The words of each lane, once carries have run through."""
        self.shift(np.flatnonzero(self.size < _TIGHT))
        self.words[self.place] = (self.low + _KEPT) >> _30
        used = self.place + 1 - np.arange(self.count) * self.width
        words = self.words.reshape(self.count, self.width)[:, : used.max(initial=0)].T.copy()
        for k in range(len(words) - 1, 0, -1):
            words[k - 1] += words[k] >> _32
        words = words.T.astype(">u4")  # without the carries
        return [w[:k].tobytes() for w, k in zip(words, used.tolist(), strict=True)]

    # ---- The model

    def step(self, out: np.ndarray, known: bool) -> None:
        """Code one spread id of each lane; `out` holds them, or is filled."""
        row, size, low = self.since, self.size[: self.n], self.low[: self.n]
        slots, index, entry, state, hit, at = self.hash, self.index, self.entry, self.state, self.hit, self.at
        np.right_shift(self.last, 16 - SLOTS[0], out=slots[0])
        np.bitwise_xor(self.last, self.product, out=slots[1])
        np.right_shift(slots[1], 16 - SLOTS[1], out=slots[1])
        np.add(slots, self.first, out=index)
        self.table.take(index, out=entry, mode="clip")
        guess, states = entry.view(_TWO)["guess"], entry.view(_TWO)["state"]
        context = self.context[row, : self.n]
        np.equal(guess[0], guess[1], out=hit[0])
        np.left_shift(hit[0], 3, out=context, dtype=np.uint16)
        np.add(context, states[1], out=context)
        np.left_shift(context, 3, out=context)
        np.add(context, states[0], out=context)
        np.multiply(context, self.count, out=at, dtype=np.intp)
        np.add(at, self.lane, out=at)
        self.chance.take(at, out=self.pair, mode="clip")
        pair = self.pair.view(_TWO)
        np.right_shift(size, _16, out=self.unit)
        a, b = np.multiply(self.unit, pair["state"], out=self.a), np.multiply(self.unit, pair["guess"], out=self.b)
        second, either = self.second[row, : self.n], self.either[row, : self.n]
        if known:
            np.equal(guess, out, out=hit)
            np.copyto(second, hit[1])
            np.logical_or(hit[0], hit[1], out=either)
        else:
            np.less(low, a, out=second)
            np.less(low, b, out=either)
            np.copyto(out, guess[0])
            np.copyto(out, guess[1], where=second)
        # The interval goes from `start` to `end`.
        start, end = np.where(either, a, b), np.where(either, b, size)
        np.copyto(end, a, where=second)
        np.copyto(start, 0, where=second)
        np.subtract(end, start, out=size)
        if known:
            np.add(low, start, out=low)
        else:
            np.subtract(low, start, out=low)
        lane = np.flatnonzero(~either)
        if len(lane):
            self.escaped.append(self.order_0(lane, out, known))
        if not known:
            np.equal(guess, out, out=hit)
        np.multiply(states, hit, out=state)
        np.add(state, 1, out=state)
        np.minimum(state, STATES - 1, out=states)
        np.copyto(guess, out)
        self.table[index] = entry
        np.multiply(self.last, 51749, out=self.product)
        np.copyto(self.last, out)
        self.shift(np.flatnonzero(size < _TIGHT))
        self.steps += 1
        self.since += 1
        if self.steps in LEARN or not self.steps % ROWS:
            self.learn()

    def order_0(self, lane: np.ndarray, out: np.ndarray, known: bool) -> np.ndarray:
        """Code ids that order 1 and 2 don't predict; returns the lanes' slots."""
        size = self.size.take(lane, mode="clip")
        tight = np.flatnonzero(size < _TIGHT)
        if len(tight):
            self.shift(lane[tight])
            size[tight] <<= _32
        low = self.low.take(lane, mode="clip")
        unit = size >> _12
        if known:
            value = out.take(lane, mode="clip")
            at = (lane << 8) + (value >> 8)
            rest = value & 255
        else:
            target = np.minimum(low // unit, 4095).astype(np.intp)
            at = (lane << 8) + self.inverse.take((lane << 12) + target, mode="clip")
        bounds, entry = self.bounds.take(at, mode="clip").view(_TWO), self.repeat.take(at, mode="clip")
        size, start = unit * bounds["guess"], unit * bounds["state"]
        chance, own = entry >> 16, entry & 255
        yes = (size >> _16) * chance
        if known:
            same = rest == own
        else:
            low -= start
            same = low < yes
            rest = own.copy()
        # Otherwise the remaining byte divides the upper part.
        new = np.flatnonzero(~same)
        above = yes.take(new, mode="clip")
        part = (size.take(new, mode="clip") - above) >> _8
        if known:
            start[new] += above + part * rest.take(new, mode="clip")
            low += start
        else:
            above = low.take(new, mode="clip") - above
            value = np.minimum(above // part, 255)
            low[new] = above - part * value
            rest[new] = value
            out[lane] = (at & 255) << 8 | rest
        yes[new] = part
        self.low[lane], self.size[lane] = low, yes
        # The chance moves towards what came.
        chance += (65472 - chance) * same >> ADAPT
        chance -= (chance - 64) * ~same >> ADAPT
        self.repeat[at] = chance << 16 | rest
        return at

    def learn(self) -> None:
        """Take in what came since the last time, and set chances and the bounds of slots."""
        n = self.n
        if self.since:
            self.observe(n)
        self.since, self.escaped = 0, []
        if not self.decoding:
            self.room()
        prior = np.array(PRIOR, np.int64)[:, :, None]
        told = (self.true[:, :, :n] * 4096 + prior * BELIEF) // (self.seen[:, :, :n] + BELIEF)
        self.logit = _STRETCH.take(told, mode="clip")
        one, two = self.logit[0], self.logit[1][:, None]
        self.mixed = []
        for w in self.weight[:, :, :n]:
            z = ((w[0] * two + w[1] * one) >> 16) + (w[2] + 2047)
            self.mixed.append(_SQUASH.take(z, mode="clip"))
        both, second, first = self.mixed
        chance = self.chance.view(_TWO)[..., :n]
        chance["state"][1] = chance["guess"][1] = both
        chance["state"][0] = second
        chance["guess"][0] = second + np.maximum((65536 - second) * (first >> 1) >> 15, _LEAST // 2)
        upto = np.cumsum(self.slot[:n], axis=1, dtype=np.int32)
        upto = upto * (4096 - 256) // upto[:, -1:] + np.arange(1, 257, dtype=np.int32)
        entry = np.zeros((n, 256), _TWO)
        entry["state"][:, 1:] = upto[:, :-1]
        entry["guess"] = upto - entry["state"]
        self.bounds[: n << 8] = entry.view(np.uint32).ravel()
        if self.decoding:
            self.inverse[: n << 12] = np.repeat(np.tile(np.arange(256, dtype=np.uint8), n), entry["guess"].ravel())

    def observe(self, n: int) -> None:
        """Counts of states and slots, and a step of the weights along the gradient."""
        # Outcomes: neither, order 1's prediction, order 2's.
        outcome = np.add(self.second[: self.since, :n], self.either[: self.since, :n], dtype=np.uint16)
        came = np.multiply((outcome << 7) + self.context[: self.since, :n], n, dtype=np.intp)
        came += self.lane
        came = np.bincount(came.ravel(), minlength=3 * 128 * n).astype(np.int32).reshape(3, 2, STATES, STATES, n)
        no, first, second = came
        every = no + first + second
        self.seen[0, :, :n] += every.sum((0, 1))
        self.seen[1, :, :n] += every.sum((0, 2))
        self.true[0, :, :n] += first.sum((0, 1)) + second[1].sum(0)
        self.true[1, :, :n] += second.sum((0, 2))
        yes, asked = (second[1], second[0], first[0]), (every[1], every[0], no[0] + first[0])
        for w, came_true, times, said in zip(self.weight[:, :, :n], yes, asked, self.mixed, strict=True):
            error = (came_true << 16) - times * said[..., :n]
            by_two, by_one = error.sum(1, dtype=np.int64), error.sum(0, dtype=np.int64)
            total = times.sum((0, 1)) + 8
            w[0] += (by_two * self.logit[1][:, :n]).sum(0) // total >> RATE
            w[1] += (by_one * self.logit[0][:, :n]).sum(0) // total >> RATE
            w[2] += by_two.sum(0) // total >> RATE - 2
            np.clip(w[:2], -1 << 18, 1 << 18, out=w[:2])
        slots = np.concatenate([np.zeros(0, np.intp), *self.escaped])
        self.slot[:n] += INCREMENT * np.bincount(slots, minlength=self.count << 8).reshape(-1, 256)[:n].astype(np.int32)
        full = np.flatnonzero(self.slot[:n].sum(1) > LIMIT)
        self.slot[full] = (self.slot[full] + 1) >> 1


def _run(lanes: Lanes, ids: np.ndarray, length: np.ndarray, known: bool) -> None:
    for t in range(len(ids)):
        n = int(np.searchsorted(-length, -t, "left"))
        if n < lanes.n:
            lanes.keep(n)
        lanes.step(ids[t, :n], known)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Code blocks of ids; each result can be decoded by itself."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    length = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((int(length.max(initial=0)), len(blocks)), np.uint16)
    for lane, i in enumerate(order):
        ids[: length[lane], lane] = blocks[i]
    lanes = Lanes(len(blocks))
    _run(lanes, ids * np.uint16(SPREAD), length, True)
    out = [b""] * len(blocks)
    for i, data in zip(order, lanes.finish(), strict=True):
        out[i] = struct.pack(HEADER, MAGIC, len(blocks[i]), crc(blocks[i]), len(data)) + data
    return out


def decode(records: list[bytes]) -> list[np.ndarray]:
    """Decode blocks; a block that doesn't match its checksum raises ValueError."""
    if not records:
        return []
    heads = [struct.unpack_from(HEADER, r) for r in records]
    for record, (magic, _, _, size) in zip(records, heads, strict=True):
        if magic != MAGIC or len(record) != struct.calcsize(HEADER) + size:
            raise ValueError("not a block of ids, or cut off")
    order = sorted(range(len(records)), key=lambda i: -heads[i][1])
    length = np.array([heads[i][1] for i in order])
    ids = np.zeros((int(length.max(initial=0)), len(records)), np.uint16)
    _run(Lanes(len(records), [records[i][struct.calcsize(HEADER) :] for i in order]), ids, length, False)
    ids *= np.uint16(GATHER)
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(records)
    for lane, i in enumerate(order):
        out[i] = np.ascontiguousarray(ids[: length[lane], lane])
        if crc(out[i]) != heads[i][2]:
            raise ValueError("a block's checksum doesn't match its ids")
    return out
