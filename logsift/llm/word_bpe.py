"""Byte-pair encoding of words in batches, and decoding.

The symbols of many words lie in one flat array. In each round the neighbouring pairs are looked up
by binary search among the sorted pair keys of the vocabulary, every word merges its pair of lowest
rank (all places of it, from the left), and only the pairs next to a merge are looked up again.
Words in which no pair is left go out of the array. Decoding gathers the texts of the tokens.

Files are those of the tokenizers library whose words end in a mark and whose white space is dropped
(``word_bpe_49k.json``): texts are cut at ASCII blanks, which no rule of such a file joins, and
special tokens stand for themselves. Normal forms and word limits outside ASCII are left to the
rules of the file, once for each distinct piece.

Defined results: a null text has the tokens of the empty one, none; repeated rows are coded each;
a very long word takes one round for each distinct pair it merges; an empty table gives no row.
"""

from __future__ import annotations

import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from logsift.llm.common import pieces, spread

BATCH_BYTES = 1 << 20
# Ids decoded at a time.
DECODED = 1 << 17
# Pieces between blanks that a Python worker remembers before it starts anew.
KNOWN_PIECES = 200_000
_NONE = np.int32(np.iinfo(np.int32).max)


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it can be printed, else one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, free = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in printed else free))
        free += byte not in printed
    return letters


def _cells(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat bytes, start, size) of a table of strings."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer(b"".join(strings), np.uint8), np.cumsum(sizes) - sizes, sizes


class WordBpe:
    def __init__(self, path: str):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, (split, last) = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        plain = not (model["dropout"] or model["ignore_merges"] or model["continuing_subword_prefix"])
        dropped = split["behavior"] == "Removed" and split["invert"] and last["type"] == "ByteLevel"
        if not (plain and dropped and model["end_of_word_suffix"] and spec["decoder"] is None):
            raise ValueError(f"{path} is no vocabulary of words with an end mark")
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        letters, mark = byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([vocabulary[c] for c in letters], np.int32)
        self.final = np.array([vocabulary[c + mark] for c in letters], np.int32)
        self.size = 1 + max([*vocabulary.values(), *self.special.values()])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        pairs = np.array([[vocabulary[a], vocabulary[b]] for a, b in merges], np.int64)
        self.merged = np.array([vocabulary[a + b] for a, b in merges], np.int32)
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        self.ranks = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.ranks]
        tokens = [""] * self.size
        for token, number in (vocabulary | self.special).items():
            tokens[number] = token
        self.texts = _cells([t.encode() + b" " for t in tokens])

        self.normal = Tokenizer.from_file(path).normalizer
        pattern = split["pattern"]["Regex"]
        self.words = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        # The same limits for lower-case ASCII.
        narrow = pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\x09-\x0D\x20")
        self.ascii_words = re.compile(narrow).findall
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, np.int32)
        self.starts = self.sizes = np.empty(0, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * self.size + right
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.ranks[place], _NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids) of words that are not empty."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        data, starts, sizes = _cells(words)
        symbols = self.inner[data]
        symbols[starts + sizes - 1] = self.final[data[starts + sizes - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        # Rank of the pair of each symbol and the next one of its word.
        rank = np.full(len(symbols), _NONE, np.int32)
        paired = np.flatnonzero(owner[:-1] == owner[1:])
        rank[paired] = self._rank(symbols[paired], symbols[paired + 1])
        out = []
        while len(symbols):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            length = np.diff(np.append(first, len(owner)))
            low = np.repeat(np.minimum.reduceat(rank, first), length)
            live = low < _NONE
            out.append((owner[~live], symbols[~live]))
            owner, symbols, rank, low = owner[live], symbols[live], rank[live], low[live]
            hits = np.flatnonzero(rank == low)
            if not len(hits):
                break
            # Neighbouring hits overlap (a pair of two equal symbols): every second one counts.
            fresh = np.append(True, hits[1:] != hits[:-1] + 1)
            number = np.arange(len(hits))
            hits = hits[(number - np.maximum.accumulate(np.where(fresh, number, 0))) % 2 == 0]
            symbols[hits] = self.merged[rank[hits]]
            stay = np.ones(len(symbols), bool)
            stay[hits + 1] = False
            at = hits - np.arange(len(hits))
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[changed] = _NONE
            changed = changed[changed + 1 < len(owner)]
            changed = changed[owner[changed] == owner[changed + 1]]
            rank[changed] = self._rank(symbols[changed], symbols[changed + 1])
        owner, symbols = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(words)), symbols[order]

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words(text.lower())
        text = self.normal.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.words.pre_tokenize_str(text)]

    def _parts(self, piece: str) -> list[str | int]:
        """Words of a piece, and the ids of special tokens in it."""
        if "<" not in piece or not self.cut.search(piece):
            return self._words(piece)
        out, at = [], 0
        for found in self.cut.finditer(piece):
            out += [*self._words(piece[at : found.start()]), self.special[found[0]]]
            at = found.end()
        return out + self._words(piece[at:])

    def learn(self, new: list[str]) -> None:
        """Remember the ids of pieces."""
        parts = [self._parts(p) for p in new]
        distinct = {w: None for p in parts for w in p}
        words = [w for w in distinct if isinstance(w, str)]
        sizes, ids = self.merge([w.encode() for w in words])
        alone = [w for w in distinct if isinstance(w, int)]
        starts = np.cumsum(sizes) - sizes
        number = {w: i for i, w in enumerate([*words, *alone])}
        starts = np.append(starts, len(ids) + np.arange(len(alone)))
        sizes = np.append(sizes, np.ones(len(alone), np.int64))
        ids = np.append(ids, np.array(alone, np.int32)).astype(np.int32)
        counts = np.fromiter(map(len, parts), np.int64, len(parts))
        which = np.fromiter((number[w] for p in parts for w in p), np.int64, int(counts.sum()))
        total = np.append(0, np.cumsum(sizes[which]))
        ends = np.cumsum(counts)
        each = total[ends] - total[ends - counts]
        for piece in new:
            self.known[piece] = len(self.known)
        self.starts = np.append(self.starts, len(self.flat) + np.cumsum(each) - each)
        self.sizes = np.append(self.sizes, each)
        self.flat = np.append(self.flat, ids[spread(starts[which], sizes[which])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds of the ids of each text)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        lists = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(lists.flatten())
        distinct = coded.dictionary.to_pylist()
        if len(self.known) + len(distinct) > KNOWN_PIECES:
            self.forget()
        new = [p for p in distinct if p not in self.known]
        if new:
            self.learn(new)
        known = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        which = known[coded.indices.to_numpy()] if len(distinct) else known
        sizes = self.sizes[which]
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        return self.flat[spread(self.starts[which], sizes)], np.append(0, np.cumsum(sizes))[bounds]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(texts one after the other, bounds of each in it): tokens joined by one space."""
        flat, starts, sizes = self.texts
        parts = [ids[k : k + DECODED] for k in range(0, len(ids), DECODED)]
        data = np.concatenate([np.empty(0, np.uint8), *[flat[spread(starts[x], sizes[x])] for x in parts]])
        ends = np.append(0, np.cumsum(sizes[ids]))[bounds]
        # Each token has a space behind it; that of the last one of a text goes.
        filled = np.diff(bounds) > 0
        stay = np.ones(len(data), bool)
        stay[ends[1:][filled] - 1] = False
        return data[stay].tobytes(), ends - np.append(0, np.cumsum(filled))


def _of_worker(path: str) -> WordBpe:
    """The vocabulary of a file, kept between the tasks of one Python worker."""
    kept = sys.modules.setdefault("_logsift_bpe", types.ModuleType("_logsift_bpe")).__dict__
    if path not in kept:
        kept[path] = WordBpe(path)
    return kept[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of the whole text of every row of ``docs`` by the vocabulary at ``path``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _of_worker(path)
        for batch in pieces(batches, BATCH_BYTES):
            ids, bounds = coder.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids array<int>")


def decoded(coded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids); null ids are none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _of_worker(path)
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy()
            start, upto = 0, np.cumsum(sizes)
            while start < batch.num_rows:  # rows of about DECODED ids
                before = upto[start] - sizes[start]
                stop = max(start + 1, int(np.searchsorted(upto, before + DECODED, "right")))
                part = batch.slice(start, stop - start)
                bounds = np.append(0, np.cumsum(sizes[start:stop]))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), part.column(1).flatten())
                data, ends = coder.decode(lists.values.to_numpy(), bounds)
                texts = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, texts.cast(pa.string())], names=["doc_id", "ids", "text"]
                )
                start = stop

    return coded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, ids array<int>, text string")
