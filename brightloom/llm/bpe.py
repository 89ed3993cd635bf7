"""BPE encoding and decoding with a public vocabulary of byte-level symbols and word ends.

A word's symbols form a doubly linked list; a priority queue holds the rank and place of every pair that can be merged.
Entries whose pair has changed since are skipped when they come up. Decoding joins the vocabulary's strings.
A task encodes each distinct word once and remembers it, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import ship_by_value
from brightloom.llm import words
from brightloom.llm.lean import lean
from brightloom.llm.names import free, own, quoted
from brightloom.llm.words import WordIds

ship_by_value(words.__name__)
ship_by_value(__name__)

WORD = (r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
DIGEST = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where it shows, else the next one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class Bpe:
    """A vocabulary file of the tokenizers library whose model is BPE with word ends; others raise ValueError."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, kinds = spec["model"], [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        end = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not end or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path} is not a lower-casing BPE vocabulary with word ends")
        vocabulary = model["vocab"]
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocabulary[a] << 20 | vocabulary[b]] = rank << 20 | vocabulary[a + b]
        shown = byte_symbols()
        self.inner = [vocabulary[s] for s in shown]
        self.final = [vocabulary[s + end] for s in shown]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = np.empty(max([*vocabulary.values(), *special.values()]) + 1, object)
        for text, i in [*vocabulary.items(), *special.items()]:
            self.strings[i] = text
        self.special = special
        self.split = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True))))
        self.word, self.beyond = regex.compile(WORD), regex.compile("[^\\x00-\u04ff]")
        self.path, self.library, self.byte_of = path, None, {c: b for b, c in enumerate(shown)}

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word of normal form."""
        data = word.encode("utf-8")
        get, n = self.pairs.get, len(data)
        symbol = [*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]]
        if n == 1:
            return symbol
        queue = []
        for i in range(n - 1):
            merge = get(symbol[i] << 20 | symbol[i + 1])
            if merge is not None:
                queue.append(merge >> 20 << 40 | i)
        heapify(queue)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFFFF
            j = right[i]
            if symbol[i] < 0 or j == n:
                continue
            merge = get(symbol[i] << 20 | symbol[j])
            if merge is None or merge >> 20 != entry >> 40:
                continue  # stale: a neighbour was merged meanwhile
            symbol[i], symbol[j] = merge & 0xFFFFF, -1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                merge = get(symbol[i] << 20 | symbol[k])
                if merge is not None:
                    heappush(queue, merge >> 20 << 40 | i)
            h = left[i]
            if h >= 0:
                merge = get(symbol[h] << 20 | symbol[i])
                if merge is not None:
                    heappush(queue, merge >> 20 << 40 | h)
        return [s for s in symbol if s >= 0]

    def encode_words(self, some: list[str]) -> tuple[list[int], list[int]]:
        ids, sizes = [], []
        for word in some:
            own = self.encode_word(word)
            ids += own
            sizes.append(len(own))
        return ids, sizes

    def words(self, text: str) -> list[str]:
        """The words of a text in normal form; special tokens stay as they are, marked by a leading NUL."""
        out, at = [], 0
        for found in self.split.finditer(text):
            out += self._plain(text[at : found.start()])
            out.append("\0" + found[0])
            at = found.end()
        return out + self._plain(text[at:])

    def _plain(self, text):
        if self.beyond.search(text):  # what is a letter there depends on the Unicode version of the library
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8") for w, _ in found]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma
        return self.word.findall(text.lower())

    def word_or_special(self, some: list[str]) -> tuple[list[int], list[int]]:
        ids, sizes = [], []
        for word in some:
            own = [self.special[word[1:]]] if word[0] == "\0" and word[1:] in self.special else self.encode_word(word)
            ids += own
            sizes.append(len(own))
        return ids, sizes

    def encode(self, text: str) -> list[int]:
        return self.word_or_special(self.words(text))[0]

    def decode(self, ids) -> str:
        """The vocabulary's strings, with the spaces that a vocabulary without a decoder puts between tokens."""
        return " ".join(self.strings[ids].tolist())


def _over(path, schema, row):
    def run(batches):
        bpe = Bpe(path)
        store = WordIds(bpe.word_or_special)
        for batch in batches:
            for some in (batch.slice(i, 500) for i in range(0, batch.num_rows, 500)):
                lists = [bpe.words(t or "") for t in some["text"].to_pylist()]
                ids, sizes = store.of([w for ws in lists for w in ws])
                ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum([len(ws) for ws in lists]))]
                out = [row(bpe, ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(some[n] for n in some.schema.names if n != "text"),
                     *(pa.array(list(c), t) for c, t in zip(zip(*out), schema.types[-len(out[0]):]))],
                    schema=schema,
                )

    return lean(run)


def _digest(bpe, ids):
    return (
        len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
        hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest(),
    )


def _ids(bpe, ids):
    return ids.astype(np.int32), bpe.decode(ids)


def _schema(df, ddl):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (ids as little-endian u4), decoded_sha256 (UTF-8).

    A NULL text is an empty one: no tokens, the digests of nothing. Rows stay apart, whatever their doc_id; very long
    texts and words are encoded whole; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(_over(path, _schema(docs, DIGEST), _digest), DIGEST)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """The columns of ``docs`` with ``token_ids array<int>`` and ``decoded string``, which replace columns so named."""
    kept = docs.drop("token_ids", "decoded")
    rest, text = [c for c in kept.columns if c != "text"], free(kept, "whole")
    types = {f.name: f.dataType.simpleString() for f in kept.schema}
    ddl = ", ".join([*(f"{quoted(c)} {types[c]}" for c in rest), f"{quoted(text)} string", "token_ids array<int>", "decoded string"])
    keyed = kept.select(*[F.col(quoted(c)) for c in rest], F.col("text").alias(text), "text")
    found = keyed.mapInArrow(_over(path, _schema(docs, ddl), _ids), ddl).withColumnRenamed(text, "text")
    return found.select(*own(kept), "token_ids", "decoded")
