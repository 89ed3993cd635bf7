"""An adaptive range coder for blocks of token ids, run over many interleaved streams at once.

A block is cut into streams of ``steps`` neighbouring ids. All streams move together, one id a step, and share one
model that starts afresh with the block, so a block can be read without any other:

* order 2 and order 1 each remember the id that last followed a context, and how far to trust it (0 to 3);
* how often either was right, for each pair of trusts, is counted as the block goes on (of many streams in each fourth
  step), and these counts, renewed every ``RENEW`` steps, mix the two with the escape to order 0;
* order 0 codes the rest by the counts of such ids so far, renewed after the steps of ``RECOUNT``.

Counts are scaled to powers of two, choices between streams are masks (0 or -1), and all streams take the same steps: a
stream whose id was guessed codes the id ``vocabulary`` in order 0, which has the whole span. A stream's span has 31 to 63
bits; below, 32 bits go out. Layout of a block, little endian: magic ``BLR2``, ids, streams, steps, vocabulary (u4 each),
the first word (u4) of each stream, the words in the order in which a reader needs them, and the crc32 of the ids as u4.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"BLR2"
STEPS, RENEW = 256, 8
RECOUNT = frozenset((1, 2, 4, 8, 16, 32, 48, 64, 96, 128, 192))
SLOTS = 1 << 16
MOST = 1 << 17  # the counts of a mixture are halved beyond this
MIX, LITERAL, LOW = 11, 20, 31  # bits to which the counts are scaled; together no more than the bits of the least span
#: By four times right plus trust: change of the trust, and whether the guess stays.
CHANGE = np.array([0, 0, -1, -1, 1, 1, 1, 0])
STAYS = np.array([0, 0, -1, -1, -1, -1, -1, -1])


class Model:
    """What encoder and decoder learn alike, step by step."""

    def __init__(self, streams: int, vocabulary: int, lookup: bool):
        if vocabulary > 1 << LITERAL - 1:
            raise ValueError(f"a vocabulary of {vocabulary} is too large")
        self.size, self.lookup, self.sparse = vocabulary, lookup, streams >= 1024
        self.counts = np.ones(vocabulary, np.int64)
        # the id that followed last, times four, and its trust
        self.after2, self.after1 = np.zeros(SLOTS, np.int64), np.zeros(vocabulary, np.int64)
        self.choice = np.ones((32, 3), np.int64)
        self.last, self.hashed = np.zeros(streams, np.int64), np.zeros(streams, np.int64)
        self.kinds: list[np.ndarray] = []
        self.coded: list[np.ndarray] = []
        self.step = 0
        self._remix()
        self._recount()

    def _remix(self):
        if self.kinds:
            hits = np.bincount(np.concatenate(self.kinds), minlength=128).reshape(32, 4)
            self.choice += 2 * hits[:, :3]
            self.kinds = []
            large = self.choice.sum(1) > MOST
            self.choice[large] = self.choice[large] // 2 + 1
        cum = self.choice.cumsum(1)
        self.cut2, self.cut1 = np.ascontiguousarray((cum[:, :2] * ((1 << MIX) - 3) // cum[:, 2:] + [1, 2]).T)

    def _recount(self):
        if self.coded:
            self.counts += 32 * np.bincount(np.concatenate(self.coded), minlength=self.size + 1)[:-1]
            self.coded = []
        cum = np.zeros(self.size + 1, np.int64)
        np.cumsum(self.counts, out=cum[1:])
        cum = cum * ((1 << LITERAL) - self.size) // cum[-1] + np.arange(self.size + 1)
        share = np.diff(cum)
        self.start, self.share = np.append(cum[:-1], 0), np.append(share, 1 << LITERAL)
        if self.lookup:
            self.owner = np.repeat(np.arange(self.size, dtype=np.uint16 if self.size <= 1 << 16 else np.int32), share)

    def predict(self, part: np.ndarray):
        """The guesses of order 2 and 1, and where in a stream's span their shares end, ``part`` being its unit."""
        self.slot = (self.hashed + self.last * 10007) & (SLOTS - 1)
        self.packed2, self.packed1 = self.after2.take(self.slot, mode="clip"), self.after1.take(self.last, mode="clip")
        guess2, guess1 = self.packed2 >> 2, self.packed1 >> 2
        self.context = ((self.packed2 & 3) << 3) + ((self.packed1 & 3) << 1) - (((guess2 ^ guess1) - 1) >> 63)
        return guess2, guess1, part * self.cut2.take(self.context, mode="clip"), part * self.cut1.take(self.context, mode="clip")

    def learn(self, ids: np.ndarray, right2: np.ndarray, right1: np.ndarray, coded: np.ndarray):
        """``ids`` came; ``right``: -1 where the guess of an order was right; ``coded``: what order 0 was given."""
        fresh = (ids << 2) + 1
        for packed, right, table, at in ((self.packed2, right2, self.after2, self.slot), (self.packed1, right1, self.after1, self.last)):
            state = (packed & 3) + (right & 4)
            kept = packed + CHANGE.take(state, mode="clip")
            table[at] = fresh ^ ((fresh ^ kept) & STAYS.take(state, mode="clip"))
        if not self.sparse or self.step % 4 == 0:
            self.kinds.append((self.context << 2) + ((right1 + 2) & ~right2))
        self.coded.append(coded)
        self.hashed = self.last * 40503
        self.last = ids
        self.step += 1
        if self.step % RENEW == 0 or self.step in RECOUNT:
            self._remix()
        if self.step in RECOUNT:
            self._recount()


def _share(part, end2, end1, not2, neither):
    """Where the share of a stream's kind of id begins in its span, and its width: order 2, order 1, or order 0."""
    between = end1 - end2
    start = (end2 & not2) + (between & neither)
    end = end2 + (between & not2) + (((part << MIX) - end1) & neither)
    return start, end - start


def _in_reading_order(sent, values, streams, last):
    """The words of all streams as a reader takes them: the first of each, then one for each word sent.

    ``sent``: the stream of each word, by step; ``values``: the words, with carries into the word before; ``last``: the word
    that ends each stream."""
    order = np.argsort(sent.astype(np.uint16 if streams <= 1 << 16 else np.uint32), kind="stable")
    stream = sent[order]
    counts = np.bincount(stream, minlength=streams)
    first = np.cumsum(counts + 2) - counts - 2
    words = np.zeros(len(sent) + 2 * streams, np.int64)
    # each stream has two words more than it sent
    at = np.arange(len(sent)) + 2 * stream
    words[at] = values[order]
    words[first + counts] = last
    over = np.flatnonzero(words >> 32)
    while over.size:
        words[over] &= (1 << 32) - 1
        words[over - 1] += 1
        over = over - 1
        over = over[words[over] >> 32 > 0]
    # a word sent begins at bit 31 of the span, a reader's word ends at bit 0
    whole = np.zeros(len(words), np.int64)
    whole[:-1] = ((words[:-1] << 31) & ((1 << 32) - 1)) | (words[1:] >> 1)
    body = np.empty(len(sent), "<u4")
    body[order] = whole[at + 1]
    return whole[first].astype("<u4"), body


def encode(ids: np.ndarray, vocabulary: int, steps: int = STEPS) -> bytes:
    """The block of ``ids``, each below ``vocabulary``."""
    n = len(ids)
    streams = -(-n // steps)
    grid = np.zeros(streams * steps, np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(streams, steps).T)
    model = Model(streams, vocabulary, lookup=False)
    low, span = np.zeros(streams, np.uint64), np.full(streams, 1 << 32)
    sent, values = [], []
    rest, bits, word = np.uint64((1 << LOW) - 1), np.uint64(LOW), np.uint64(32)
    for x in grid:
        x = x.astype(np.int64)
        part = span >> MIX
        guess2, guess1, end2, end1 = model.predict(part)
        right2, right1 = ((guess2 ^ x) - 1) >> 63, ((guess1 ^ x) - 1) >> 63
        not2 = ~right2
        neither = not2 & ~right1
        start, width = _share(part, end2, end1, not2, neither)
        coded = vocabulary + ((x - vocabulary) & neither)
        unit = width >> LITERAL
        start += unit * model.start.take(coded, mode="clip")
        span = unit * model.share.take(coded, mode="clip")
        low += start.view(np.uint64)
        short = np.flatnonzero(span < 1 << LOW)
        out = low[short]
        low[short] = (out & rest) << word
        span[short] <<= 32
        sent.append(short)
        values.append((out >> bits).view(np.int64))
        model.learn(x, right2, right1, coded)
    last = ((low + rest) >> bits).view(np.int64)
    first, body = _in_reading_order(np.concatenate(sent), np.concatenate(values), streams, last)
    return b"".join((
        MAGIC, struct.pack("<4I", n, streams, steps, vocabulary), first.tobytes(), body.tobytes(),
        struct.pack("<I", zlib.crc32(ids.astype("<u4").tobytes())),
    ))


def decode(block: bytes) -> np.ndarray:
    """The ids of a block as u4. Raises ValueError when the block is damaged."""
    if block[:4] != MAGIC or len(block) < 24:
        raise ValueError("not a block of token ids")
    n, streams, steps, vocabulary = struct.unpack_from("<4I", block, 4)
    words = np.frombuffer(block, "<u4", len(block) // 4 - 6, 20).astype(np.int64)
    model = Model(streams, vocabulary, lookup=True)
    grid = np.zeros((steps, streams), "<u4")
    code, at = words[:streams].copy(), streams
    span = np.full(streams, 1 << 32)
    for step in range(steps):
        part = span >> MIX
        guess2, guess1, end2, end1 = model.predict(part)
        not2, neither = ~((code - end2) >> 63), ~((code - end1) >> 63)
        start, width = _share(part, end2, end1, not2, neither)
        code -= start
        unit = width >> LITERAL
        found = model.owner.take((code.view(np.uint64) // unit.view(np.uint64)).view(np.int64), mode="clip").astype(np.int64)
        x = guess2 + ((guess1 - guess2) & not2)
        x += (found - x) & neither
        coded = vocabulary + ((found - vocabulary) & neither)
        code -= unit * model.start.take(coded, mode="clip")
        span = unit * model.share.take(coded, mode="clip")
        short = np.flatnonzero(span < 1 << LOW)
        code[short] = (code[short] << 32) | words[at : at + len(short)]
        at += len(short)
        span[short] <<= 32
        grid[step] = x
        model.learn(x, ~not2, ((guess1 ^ x) - 1) >> 63, coded)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n]
    if zlib.crc32(ids.tobytes()) != struct.unpack_from("<I", block, len(block) - 4)[0]:
        raise ValueError("the checksum of a block of token ids does not agree")
    return ids
