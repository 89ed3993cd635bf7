"""Words to token ids inside a task: a batch's distinct words are encoded once and remembered."""

from __future__ import annotations

import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes by what they say of a cut before or after them.
SPACE, GRAPH, ALNUM, POINT, LEAD, NEXT = 1, 2, 4, 8, 16, 32
CLASSES = np.zeros(256, np.uint8)
CLASSES[[9, 10, 11, 12, 13, 32]] = SPACE
CLASSES[0x21:0x7F] = GRAPH
for _span in (slice(48, 58), slice(65, 91), slice(97, 123)):
    CLASSES[_span] |= ALNUM
CLASSES[[ord(c) for c in ",.;:!?)"]] |= POINT
CLASSES[0x80:0xC0] = NEXT
CLASSES[0xC3:0xE0] = LEAD   # characters U+00C0 to U+07FF, none of them a space


def of_worker(key, make):
    """What the Python worker keeps from task to task; modules that are sent as code start anew with each task."""
    shelf = sys.modules.setdefault("brightloom_worker", types.ModuleType("brightloom_worker")).__dict__
    if key not in shelf:
        shelf[key] = make()
    return shelf[key]


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and its len + 1 offsets in them."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends.astype(np.int64) - int(ends[0])


def strings(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of UTF-8 bytes between neighbouring ``ends``; under 2 GB in all."""
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _solid(classes):
    """Bytes that end a character which is no space: printable ASCII, or two bytes from U+00C0 on."""
    solid = classes & GRAPH > 0
    solid[1:] |= (classes[:-1] & LEAD > 0) & (classes[1:] & NEXT > 0)
    return solid


def cuts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts in pieces that a byte-level BPE may encode one by one, and the number of pieces before each text and in all.

    A cut is made where its split cuts whatever comes before and after: before a space after a character that is none, and
    before a point after an ASCII letter or digit. No cut is made inside ``<|endoftext|>``.
    """
    data, starts = bytes_of(texts)
    classes = CLASSES[data]
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 1:
        solid = _solid(classes)
        cut[1:-1] = (classes[1:] & SPACE > 0) & solid[:-1]
        cut[1:-1] |= (classes[1:] & POINT > 0) & (classes[:-1] & ALNUM > 0)
    cut[starts] = True
    ends = np.flatnonzero(cut)
    return strings(data, ends), np.searchsorted(ends, starts)


class PieceIds:
    """The token ids of pieces made by ``cuts``, of a byte-level BPE of the tokenizers library.

    Short pieces are remembered, at most ``most``; when these are full and more than half of what comes is not among them,
    they are forgotten. Other pieces are encoded again.
    """

    def __init__(self, tokenizer, most: int = 500_000, longest: int = 64, together: int = 100):
        self.tokenizer, self.most, self.longest, self.together = tokenizer, most, longest, together
        vocabulary = tokenizer.get_vocab()
        # a character of a token is a byte of the text
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        if len(self.lengths) > 1 << 16:
            raise ValueError(f"a vocabulary of {len(self.lengths)} does not fit 16 bits")
        self.lengths[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self._forget()

    def _forget(self):
        self.known = pa.array([], pa.string()), np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces, and where those of each begin and how many they are."""
        data, ends = bytes_of(pieces)
        starts, sizes = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        flat, used = [np.zeros(0, np.uint16)], 0
        classes = CLASSES[data]
        # a space, and a character that is none at the end: any such pieces, one after the other, are cut at their ends
        joined = (classes[ends[:-1]] & SPACE > 0) & _solid(classes)[ends[1:] - 1]
        own, own_ends = bytes_of(pieces.filter(pa.array(joined)))
        place = np.flatnonzero(joined)
        single = [np.flatnonzero(~joined)]
        for i in range(0, len(place), self.together):
            here = place[i : i + self.together]
            bounds = own_ends[i : i + len(here) + 1]
            found = self.tokenizer.encode_batch_fast([own[bounds[0] : bounds[-1]].tobytes().decode()], add_special_tokens=False)[0].ids
            ids = np.array(found, np.int64)
            reach = np.append(0, np.cumsum(self.lengths[ids]))
            at = np.searchsorted(reach, bounds - bounds[0])
            if at[-1] != len(ids) or (reach[at] != bounds - bounds[0]).any():
                single.append(here)
                continue
            starts[here], sizes[here] = used + at[:-1], np.diff(at)
            flat.append(ids.astype(np.uint16))
            used += len(ids)
        single = np.concatenate(single)
        for i in range(0, len(single), self.together):
            here = single[i : i + self.together]
            for j, found in zip(here, self.tokenizer.encode_batch_fast(pieces.take(pa.array(here)).to_pylist(), add_special_tokens=False)):
                ids = np.array(found.ids, np.uint16)
                starts[j], sizes[j] = used, len(ids)
                flat.append(ids)
                used += len(ids)
        return np.concatenate(flat), starts, sizes

    def _remember(self, pieces, flat, starts, sizes):
        words, all_flat, all_starts, all_sizes = self.known
        short = np.flatnonzero(np.diff(bytes_of(pieces)[1]) <= self.longest)[: self.most - len(words)]
        if len(short):
            flat, own = _gathered(flat, starts[short], sizes[short])
            self.known = (
                pa.concat_arrays([words, pieces.take(pa.array(short))]), np.concatenate([all_flat, flat]),
                np.concatenate([all_starts, len(all_flat) + np.cumsum(own) - own]), np.concatenate([all_sizes, own]),
            )

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and how many each gave."""
        code = pieces.dictionary_encode()
        distinct = code.dictionary
        words, flat, starts, sizes = self.known
        found = pc.index_in(distinct, value_set=words)
        missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        place = found.fill_null(0).to_numpy(zero_copy_only=False)
        at, n = (starts[place], sizes[place]) if len(words) else (np.zeros(len(place), np.int64), np.zeros(len(place), np.int64))
        if len(missing):
            new = distinct.take(pa.array(missing))
            new_flat, new_starts, new_sizes = self._encode(new)
            at[missing], n[missing] = len(flat) + new_starts, new_sizes
            flat = np.concatenate([flat, new_flat])
            if len(words) >= self.most and 2 * len(missing) > len(distinct):
                self._forget()
            self._remember(new, new_flat, new_starts, new_sizes)
        index = code.indices.to_numpy(zero_copy_only=False)
        return _gathered(flat, at[index], n[index])


def _gathered(flat, starts, sizes):
    """The runs of ``flat`` that begin at ``starts``, one after the other, and their sizes."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], sizes


class WordIds:
    """The token ids of words, by ``encode(list of words) -> (ids, ids of each word)``; forgets all beyond ``most`` words."""

    def __init__(self, encode, most: int = 600_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint16), 0
        self.starts, self.sizes = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)

    def _add(self, words: list[str]):
        ids, sizes = self.encode(words)
        n, m = len(self.known), len(words)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n + m > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        self.flat[self.used : self.used + len(ids)] = ids
        self.sizes[n : n + m] = sizes
        self.starts[n : n + m] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.known.update(zip(words, range(n, n + m)))

    def _learn(self, words):
        if len(self.known) > self.most:
            self._clear()
        new = list({w for w in words if w not in self.known})
        for i in range(0, len(new), 50_000):
            self._add(new[i : i + 50_000])

    def of(self, words: list[str], codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after the other, and how many each gave; with ``codes``, of ``words[c]`` for each code."""
        self._learn(words)
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        place = place if codes is None else place[codes]
        starts, sizes = self.starts[place], self.sizes[place].astype(np.int64)
        ends = np.cumsum(sizes)
        at = np.repeat(starts - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.flat[at], sizes
