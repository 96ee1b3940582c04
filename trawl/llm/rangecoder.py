"""An adaptive context-mixing range coder for token ids.

Ids are coded in blocks that start from the same empty model, so any block can be
read alone; each carries its length, its alphabet (the ids it uses) and a checksum. In a block, order-2 and
order-1 contexts each predict the id that followed them last. Whether one of them
is right is a three-way choice whose frequencies mix three adaptive counts: by the
confidence of order 2, by that of order 1, and without context. Where both miss, order-0 frequencies of the
alphabet code the id; they follow the ids coded so far at steps that both sides know.

All arithmetic is on integers, and many blocks advance in step as the lanes of numpy arrays.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK_IDS = 4096
HEADER = struct.Struct("<4sIIII")  # magic, ids, bytes of the alphabet, words, crc32 of alphabet, words and ids
MAGIC = b"TID1"
TABLE = 1024
LIMIT, GAIN = 1 << 12, 4
#: Steps after which order-0 frequencies follow what was coded: early and dense, then every so many.
EARLY, EVERY = (8, 16, 32, 64, 128, 192), 256
WORD = np.uint64(32)
LOW = np.uint64(1 << 32)


class Writer:
    """Range encoders in lanes: 64-bit low and range, 32-bit words out, carries into what is out."""

    def __init__(self, lanes: int, steps: int) -> None:
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.out, self.at = np.zeros((lanes, steps + 16), np.uint32), np.zeros(lanes, np.int64)

    def carry(self, lanes: np.ndarray) -> None:
        at = self.at[lanes] - 1
        while lanes.size:
            self.out[lanes, at] += np.uint32(1)
            more = self.out[lanes, at] == 0
            lanes, at = lanes[more], at[more] - 1

    def shift(self, lanes: np.ndarray) -> None:
        if self.at[lanes].max(initial=0) >= self.out.shape[1]:
            self.out = np.concatenate([self.out, np.zeros_like(self.out)], axis=1)
        self.out[lanes, self.at[lanes]] = (self.low[lanes] >> WORD).astype(np.uint32)
        self.at[lanes] += 1
        self.low[lanes] <<= WORD

    def put(self, lanes: np.ndarray, begin: np.ndarray, size: np.ndarray, total: np.ndarray) -> None:
        part = self.range[lanes] // total.astype(np.uint64)
        old = self.low[lanes]
        low = old + part * begin.astype(np.uint64)
        self.low[lanes] = low
        if (over := low < old).any():
            self.carry(lanes[over])
        span = part * size.astype(np.uint64)
        if (small := span < LOW).any():
            span[small] <<= WORD
            self.shift(lanes[small])
        self.range[lanes] = span

    def close(self) -> list[bytes]:
        every = np.arange(self.low.size)
        for _ in range(2):
            self.shift(every)
        return [self.out[i, :n].astype("<u4").tobytes() for i, n in enumerate(self.at.tolist())]


class Reader:
    """Range decoders in lanes over the words of each block."""

    def __init__(self, payloads: list[bytes]) -> None:
        longest = max(len(p) for p in payloads) // 4 + 4
        self.words = np.zeros((len(payloads), longest), np.uint64)
        for i, p in enumerate(payloads):
            self.words[i, : len(p) // 4] = np.frombuffer(p, "<u4")
        self.at = np.full(len(payloads), 2, np.int64)
        self.code = self.words[:, 0] << WORD | self.words[:, 1]
        self.range = np.full(len(payloads), 2**64 - 1, np.uint64)

    def peek(self, lanes: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = self.range[lanes] // total.astype(np.uint64)
        return np.minimum(self.code[lanes] // part, total.astype(np.uint64) - np.uint64(1)).astype(np.int64), part

    def take(self, lanes: np.ndarray, begin: np.ndarray, size: np.ndarray, part: np.ndarray) -> None:
        code, span = self.code[lanes] - part * begin.astype(np.uint64), part * size.astype(np.uint64)
        if (small := span < LOW).any():
            some = lanes[small]
            span[small] <<= WORD
            code[small] = code[small] << WORD | self.words[some, self.at[some]]
            self.at[some] += 1
        self.code[lanes], self.range[lanes] = code, span


class Order0:
    """Frequencies of every lane's alphabet, laid end to end."""

    def __init__(self, sizes: np.ndarray) -> None:
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.counts = np.ones(self.first[-1], np.int64)
        self.renew()

    def renew(self, seen: np.ndarray | None = None) -> None:
        if seen is not None:
            self.counts += GAIN * np.bincount(seen.ravel(), minlength=self.counts.size)
        self.ends = np.cumsum(self.counts)
        edge = np.concatenate([[0], self.ends])[self.first]
        self.base, self.total = edge[:-1], np.diff(edge)


class Choice:
    """Adaptive counts of the outcomes order 2, order 1, neither."""

    def __init__(self, lanes: int) -> None:
        self.at = [np.arange(lanes) * n for n in (1, 4, 4)]
        self.counts = [np.repeat(np.array([[4], [4], [24]]), lanes * n, axis=1) for n in (1, 4, 4)]

    def rows(self, trust: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        self.now = [self.at[0], self.at[1] + trust[0], self.at[2] + trust[1]]
        zero, one, two = self.counts
        return [zero[k] + one[k].take(self.now[1]) + two[k].take(self.now[2]) for k in range(3)]

    def learn(self, outcome: np.ndarray, tidy: bool) -> None:
        for c, at in zip(self.counts, self.now, strict=True):
            c[outcome, at] += 8
            if tidy:
                full = c.sum(axis=0) > LIMIT
                c[:, full] = c[:, full] + 1 >> 1


def walk(io: Writer | Reader, sizes: np.ndarray, steps: int, symbols: np.ndarray | None) -> np.ndarray:
    """Codes ``steps`` symbols in each lane; from ``symbols[step]``, or into the result where there are none.

    A symbol is its place among the alphabets of all lanes, laid end to end.
    """
    lanes, writes = sizes.size, symbols is not None
    done = symbols if writes else np.zeros((steps, lanes), np.int64)
    every = np.arange(lanes)
    shift = every * TABLE
    guess = [np.full(lanes * TABLE, -1, np.int32) for _ in range(2)]  # by order-1 and order-2 context
    sure = [np.zeros(lanes * TABLE, np.int8) for _ in range(2)]
    order0, choice = Order0(sizes), Choice(lanes)
    last, before, renewed = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64), 0
    for step in range(steps):
        if step in EARLY or step and step % EVERY == 0:
            order0.renew(done[renewed:step])
            renewed = step
        mixed = last * 40503
        places = shift + (mixed & TABLE - 1), shift + (mixed + before * 309163 & TABLE - 1)
        one, two = guess[0].take(places[0]), guess[1].take(places[1])
        trust = sure[0].take(places[0]), sure[1].take(places[1])
        a, b, c = choice.rows(trust)
        b[one == two] = 0  # order 1 says nothing new
        ends = a, a + b, a + b + c
        if writes:
            now = done[step]
            hit = now == two
            outcome = np.where(hit, 0, np.where(now == one, 1, 2))
        else:
            target, part = io.peek(every, ends[2])
            outcome = (target >= ends[0]).astype(np.int64) + (target >= ends[1])
            now = np.where(outcome == 0, two, one).astype(np.int64)
        begin, size = np.where(outcome == 0, 0, np.where(outcome == 1, ends[0], ends[1])), np.where(outcome == 0, a, np.where(outcome == 1, b, c))
        if writes:
            io.put(every, begin, size, ends[2])
        else:
            io.take(every, begin, size, part)
        missed = np.flatnonzero(outcome == 2)
        if missed.size:
            base, total = order0.base[missed], order0.total[missed]
            if not writes:
                target, part = io.peek(missed, total)
                now[missed] = np.searchsorted(order0.ends, base + target, "right")
            symbol = now[missed]
            size = order0.counts[symbol]
            begin = order0.ends[symbol] - size - base
            if writes:
                io.put(missed, begin, size, total)
            else:
                io.take(missed, begin, size, part)
        if not writes:
            done[step] = now
        choice.learn(outcome, step & 63 == 63)
        for g, s, p, said, faith in zip(guess, sure, places, (one, two), trust, strict=True):
            right = said == now
            s[p] = np.where(right, np.minimum(faith + 1, 3), np.maximum(faith - 1, 0))
            g[p] = np.where(right | (faith > 0), said, now)
        last, before = now, last
    return done


def pack_alphabet(ids: np.ndarray) -> bytes:
    """Rising ids as how many are left out before each, in one byte, or 255 and two bytes."""
    gaps = np.diff(ids, prepend=-1) - 1
    return b"".join(bytes((g,)) if g < 255 else b"\xff" + struct.pack("<H", g) for g in gaps.tolist())


def unpack_alphabet(raw: bytes) -> np.ndarray:
    gaps, at = [], 0
    while at < len(raw):
        wide = raw[at] == 255
        gaps.append(struct.unpack_from("<H", raw, at + 1)[0] if wide else raw[at])
        at += 3 if wide else 1
    return np.cumsum(np.array(gaps, np.int64) + 1) - 1


def encode(ids: np.ndarray, block_ids: int = BLOCK_IDS) -> bytes:
    """Ids below 2^16 as a sequence of blocks; an error for any other."""
    if ids.size and not 0 <= ids.min() <= ids.max() < 1 << 16:
        raise ValueError("the coder takes ids from 0 to 65,535")
    blocks = [ids[i : i + block_ids] for i in range(0, ids.size, block_ids)]
    if not blocks:
        return b""
    alphabets, ranks = zip(*(np.unique(b, return_inverse=True) for b in blocks), strict=True)
    sizes = np.array([a.size for a in alphabets])
    first = np.concatenate([[0], np.cumsum(sizes)])
    symbols = np.repeat(first[None, :-1], blocks[0].size, axis=0)  # a short block goes on with its first symbol
    for lane, r in enumerate(ranks):
        symbols[: r.size, lane] += r
    io = Writer(len(blocks), blocks[0].size // 2)
    walk(io, sizes, blocks[0].size, symbols)
    made = []
    for b, a, payload in zip(blocks, map(pack_alphabet, alphabets), io.close(), strict=True):
        made.append(HEADER.pack(MAGIC, b.size, len(a), len(payload) // 4, zlib.crc32(b.astype("<u4").tobytes(), zlib.crc32(a + payload))) + a + payload)
    return b"".join(made)


def decode(raw: bytes) -> np.ndarray:
    """The ids of ``encode``; an error if a block's magic, length or checksum is wrong."""
    heads, alphabets, payloads, at = [], [], [], 0
    while at < len(raw):
        if len(raw) - at < HEADER.size or raw[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        _, n, letters, words, crc = HEADER.unpack_from(raw, at)
        at += HEADER.size
        if at + letters + 4 * words > len(raw):
            raise ValueError(f"the block before byte {at} is cut off")
        heads.append((n, crc, zlib.crc32(raw[at : at + letters + 4 * words])))
        alphabets.append(unpack_alphabet(raw[at : at + letters]))
        payloads.append(raw[at + letters : at + letters + 4 * words])
        at += letters + 4 * words
    if not heads:
        return np.zeros(0, "<u4")
    sizes = np.array([a.size for a in alphabets])
    symbols = walk(Reader(payloads), sizes, max(n for n, *_ in heads), None)
    ids = np.concatenate(alphabets)[np.minimum(symbols, sizes.sum() - 1)].astype("<u4")
    parts = [ids[:n, lane] for lane, (n, *_) in enumerate(heads)]
    for k, (part, (_, crc, coded)) in enumerate(zip(parts, heads, strict=True)):
        if zlib.crc32(part.tobytes(), coded) != crc:
            raise ValueError(f"block {k} does not match its checksum")
    return np.concatenate(parts)
