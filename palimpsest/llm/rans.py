"""Static range asymmetric numeral system over token ids, vectorised over lanes and segments.

A block of ids is written as SEGMENT-long stretches of LANES interleaved lanes: id i belongs to lane
i % LANES. All lanes of a step share one stream of 16-bit words. At the start of each segment a checkpoint
holds the lane states and the place in the stream, so segments decode side by side, here as rows of an array.
"""

from __future__ import annotations

import numpy as np

LANES = 64
STEPS = 256  # steps between checkpoints
SEGMENT = LANES * STEPS


class Table:
    """Frequencies scaled to a power of two, at least one for every id that occurs."""

    def __init__(self, freq: np.ndarray, bits: int) -> None:
        if int(freq.sum()) not in (0, 1 << bits):
            raise ValueError("frequencies must fill the range")
        self.bits, self.freq = bits, freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Counts scaled down; what rounding leaves goes to, or comes from, the most frequent ids."""
        present = counts > 0
        bits = max(16, int(np.ceil(np.log2(max(int(present.sum()), 1)))) + 1)
        total, size = int(counts.sum()), 1 << bits
        if not total:
            return cls(np.zeros(len(counts), np.int64), bits)
        freq = np.where(present, np.maximum(np.floor(counts.astype(np.float64) / total * size), 1), 0).astype(np.int64)
        order, rest = np.argsort(-freq, kind="stable"), size - int(freq.sum())
        if rest > 0:
            freq[order[0]] += rest
        while rest < 0:
            give = np.minimum(freq[order] - 1, np.maximum(freq[order] // 64, 1))
            give = np.minimum(give, np.maximum(-rest - (np.cumsum(give) - give), 0))
            freq[order] -= give
            rest += int(give.sum())
        return cls(freq, bits)


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words uint16, states uint64 [segments, LANES], offsets int64 [segments]) of one block.

    The last segment is filled up with the last id of the block; the caller keeps the length.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint16), np.zeros((0, LANES), np.uint64), np.zeros(0, np.int64)
    segments = -(-n // SEGMENT)
    steps = -(-n // LANES) if segments == 1 else STEPS
    grid = np.full(segments * steps * LANES, ids[-1], np.int64)
    grid[:n] = ids
    grid = grid.reshape(segments, steps, LANES)
    freq, start = table.freq[grid], table.start[grid]
    if not freq.all():
        raise ValueError("an id without frequency")
    bits, low = np.uint64(table.bits), np.uint64(0xFFFF)
    sixteen = np.uint64(16)
    state = np.full((segments, LANES), 1 << table.bits, np.uint64)
    words = np.zeros((segments, steps, LANES), np.uint16)
    sent = np.zeros((segments, steps, LANES), bool)
    for t in range(steps - 1, -1, -1):
        f = freq[:, t]
        full = state >= f << sixteen
        sent[:, t], words[:, t] = full, state & low
        state = np.where(full, state >> sixteen, state)
        state = ((state // f) << bits) + state % f + start[:, t]
    per = sent.reshape(segments, -1).sum(1)
    return words[sent], state, np.cumsum(per) - per


def decode(words: np.ndarray, states: np.ndarray, offsets: np.ndarray, n: int, table: Table) -> np.ndarray:
    """The n ids of a block; all its segments go forward together."""
    if not n:
        return np.zeros(0, np.uint32)
    segments = len(offsets)
    steps = -(-n // LANES) if segments == 1 else STEPS
    out = np.zeros((segments, steps, LANES), np.uint32)
    state, at = states.copy(), offsets.copy()
    bits, mask = np.uint64(table.bits), np.uint64((1 << table.bits) - 1)
    words = np.append(words, np.uint16(0)).astype(np.uint64)
    for t in range(steps):
        slot = state & mask
        symbol = table.symbol[slot.astype(np.int64)]
        out[:, t] = symbol
        state = table.freq[symbol] * (state >> bits) + slot - table.start[symbol]
        short = state < mask + np.uint64(1)
        turn = np.cumsum(short, axis=1)
        place = np.minimum(at[:, None] + turn - 1, len(words) - 1)
        state = np.where(short, state << np.uint64(16) | words[np.maximum(place, 0)], state)
        at = at + turn[:, -1]
    if (state != np.uint64(1 << table.bits)).any():
        raise ValueError("a block does not end in the first state")
    return out.reshape(-1)[:n]
