"""Range asymmetric numeral system over arrays of symbols.

All blocks that share a frequency table are coded at once: a block is dealt to
``LANES`` interleaved states, and numpy works on the states of all blocks side
by side. A block can be decoded alone from its own states, words and checksum.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 32
BLOCK = 1 << 14             # symbols of a block
LOW = np.uint64(1 << 31)    # states stay in [LOW, LOW << 32)
W = np.uint64(32)


class Table:
    """Symbols and their frequencies, which add up to 2 ** bits; each is at least 1."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray, bits: int):
        self.symbols, self.bits = symbols, bits
        self.freqs = freqs.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(freqs)]).astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> "Table":
        counts = np.bincount(ids) if len(ids) else np.ones(1, np.int64)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        bits = max(14, int(len(symbols)).bit_length() + 2)
        total = 1 << bits
        freqs = np.maximum(1, counts * total // counts.sum())
        over = int(freqs.sum()) - total
        if over < 0:
            freqs[counts.argmax()] -= over
        while over > 0:     # take back from the largest, in proportion
            room = freqs - 1
            cut = np.minimum(room, np.ceil(room * (over / room.sum())).astype(np.int64))
            cut = np.minimum(cut, np.maximum(0, over - (np.cumsum(cut) - cut)))
            freqs -= cut
            over -= int(cut.sum())
        return cls(symbols.astype(np.uint32), freqs, bits)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freqs)), self.freqs.astype(np.int64))


def _encode(rows: np.ndarray, t: Table):
    """States and words of equal blocks; rows: symbol numbers, (blocks, steps, LANES)."""
    blocks, steps, lanes = rows.shape
    by_step = np.ascontiguousarray(rows.transpose(1, 0, 2)).reshape(steps, blocks * lanes)
    x = np.full(blocks * lanes, LOW, np.uint64)
    bits, limit = np.uint64(t.bits), t.freqs * np.uint64((int(LOW) >> t.bits) << 32)
    out = []
    for s in range(steps - 1, -1, -1):
        k = by_step[s]
        f = t.freqs[k]
        full = np.flatnonzero(x >= limit[k])
        if len(full):
            v = x[full]
            out.append((full, v.astype("<u4")))
            x[full] = v >> W
        q = x // f
        x -= q * f
        x += (q << bits) + t.cum[k]
    if not out:
        return x.reshape(blocks, lanes), [b""] * blocks
    # Words by step already, then by block: a stable sort by block number is all that is left.
    at, v = (np.concatenate(p[::-1]) for p in zip(*out))
    block = at // lanes
    order = np.argsort(block.astype(np.uint16) if blocks <= 1 << 16 else block, kind="stable")
    v, n = v[order], np.bincount(block, minlength=blocks)
    ends = np.cumsum(n)
    return x.reshape(blocks, lanes), [v[e - k:e].tobytes() for e, k in zip(ends, n)]


def encode(ids: np.ndarray, t: Table) -> list[dict]:
    """Blocks of ``ids``: n, states, words and the checksum of both and of the ids."""
    number = np.zeros(int(t.symbols.max()) + 1, np.int32)
    number[t.symbols] = np.arange(len(t.symbols))
    rows = number[ids]
    whole = len(rows) // BLOCK * BLOCK
    blocks = []
    for part in (rows[:whole].reshape(-1, BLOCK), rows[whole:].reshape(1, -1) if len(rows) > whole else rows[:0].reshape(0, 1)):
        if not part.size:
            continue
        pad = -part.shape[1] % LANES
        part = np.pad(part, ((0, 0), (0, pad)), constant_values=int(t.freqs.argmax()))
        x, words = _encode(part.reshape(len(part), -1, LANES), t)
        blocks += [(xs.astype("<u8").tobytes(), w) for xs, w in zip(x, words)]
    out = []
    for k, (states, words) in enumerate(blocks):
        own = ids[k * BLOCK:(k + 1) * BLOCK]
        out.append({"n": len(own), "states": states, "words": words, "crc": zlib.crc32(words, zlib.crc32(states)),
                    "ids_crc": zlib.crc32(own.astype("<u4").tobytes())})
    return out


def _decode(states: np.ndarray, words: list[bytes], steps: int, t: Table, slots: np.ndarray) -> np.ndarray:
    x, bits = states.copy(), np.uint64(t.bits)
    mask = np.uint64((1 << t.bits) - 1)
    at = np.concatenate([[0], np.cumsum([len(w) // 4 for w in words])])[:-1]
    stream = np.frombuffer(b"".join(words), "<u4").astype(np.uint64)
    out = np.empty((len(x), steps, x.shape[1]), np.uint32)
    for s in range(steps):
        low = x & mask
        k = slots[low.astype(np.int64)]
        out[:, s] = t.symbols[k]
        x = t.freqs[k] * (x >> bits) + low - t.cum[k]
        b, lane = np.nonzero(x < LOW)
        if len(b):
            n = np.bincount(b, minlength=len(x))
            first = np.concatenate([[0], np.cumsum(n)])[:-1]
            x[b, lane] = (x[b, lane] << W) | stream[at[b] + np.arange(len(b)) - first[b]]
            at = at + n
    return out.reshape(len(x), -1)


def decode(blocks: list[dict], t: Table) -> np.ndarray:
    """The ids of some blocks of one table, in order. A broken checksum raises."""
    if not blocks:
        return np.empty(0, np.uint32)
    for b in blocks:
        if zlib.crc32(b["words"], zlib.crc32(b["states"])) != b["crc"]:
            raise ValueError("token block: checksum of the coded bytes differs")
    slots, parts = t.slots(), [None] * len(blocks)
    for steps in {-(-b["n"] // LANES) for b in blocks}:
        own = [k for k, b in enumerate(blocks) if -(-b["n"] // LANES) == steps]
        states = np.array([np.frombuffer(blocks[k]["states"], "<u8") for k in own], np.uint64)
        for k, row in zip(own, _decode(states, [blocks[k]["words"] for k in own], steps, t, slots)):
            parts[k] = row[:blocks[k]["n"]]
            if zlib.crc32(parts[k].astype("<u4").tobytes()) != blocks[k]["ids_crc"]:
                raise ValueError("token block: checksum of the ids differs")
    return np.concatenate(parts)
