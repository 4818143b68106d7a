"""Token ids of whole texts through a public tokenizer file, each distinct word encoded once.

Texts are cut where the tokenizer's own rules always cut, so the ids of the chunks are the ids
of the text: at ASCII blanks for vocabularies that drop white space, and before each single
space for byte-level vocabularies whose words carry their leading space. Texts in which such
cuts are not certain (neighbouring white space, the marks used here) are encoded whole.

A Python worker remembers the ids of the chunks it has met by a 64-bit hash, in sorted arrays
that take about 30 bytes for a chunk. New chunks are encoded many in one string and parted again
at a mark, or at the tokens that begin with a space.
"""

from __future__ import annotations

import os
import sys
import types
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from logsift.llm.common import mixed

# Chunks that a Python worker remembers before it starts anew.
KNOWN_CHUNKS = 1_500_000
# Chunks encoded in one string.
JOINED = 500
_CUT = "\x01\x1e\x02"
_MARK = "\x01"
_WHITE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}-\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]{2}"


class _Known:
    """Tokenizer of a file and the chunks met so far."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.leads = np.zeros(max(vocabulary.values()) + 1, bool)
        self.leads[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True
        self.mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self):
        self.keys, self.starts = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.sizes, self.flat = np.empty(0, np.int32), np.empty(0, np.uint32)

    def learn(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray):
        starts = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids])
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])[order]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return place, self.keys[place] == keys


def _kept_by_worker(path: str) -> _Known:
    """What is known of a file, kept between the tasks of one Python worker."""
    kept = sys.modules.setdefault("_logsift_tokens", types.ModuleType("_logsift_tokens")).__dict__
    if path not in kept:
        kept[path] = _Known(path)
    return kept[path]


def vocabulary_size(path: str) -> int:
    """One more than the highest id of a file."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab().values()) + 1


def _hashes(texts: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: the sum of a mixed number for every byte at its place."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    begin = offsets[:-1] - offsets[0]
    place = np.arange(len(data)) - np.repeat(begin, sizes)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed((place << 8 | data).astype(np.uint64) + np.uint64(1)))])
        return mixed(sums[begin + sizes] - sums[begin] + sizes.astype(np.uint64))


class TokenCoder:
    """Ids of texts by the file at ``path``; ``spaced`` if tokens carry their leading space."""

    def __init__(self, path: str, spaced: bool):
        self.known = _kept_by_worker(path)
        self.spaced = spaced

    def _one_by_one(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each string, all ids)."""
        found = [x.ids for x in self.known.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))

    def _joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for chunks that can be told apart in joined strings."""
        joint, tail = ("", "") if self.spaced else (f" {_MARK} ", f" {_MARK}")
        strings = [joint.join(chunks[at : at + JOINED]) + tail for at in range(0, len(chunks), JOINED)]
        _, ids = self._one_by_one(strings)
        if self.spaced:
            starts = np.flatnonzero(self.known.leads[ids])
            sizes = np.diff(np.append(starts, len(ids)))
        else:
            marks = ids == self.known.mark[0]
            sizes = np.diff(np.flatnonzero(marks), prepend=-1) - 1
            ids = ids[~marks]
        if len(sizes) != len(chunks):
            raise RuntimeError("chunks of a joined string were not told apart")
        return sizes, ids

    def _plain(self, chunk: str) -> bool:
        if self.spaced:
            return chunk[:1] == " " and len(chunk) > 1 and " " not in chunk[1:] and "\u0120" not in chunk
        return _MARK not in chunk and len(self.known.mark) == 1

    def _ids_of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place of the ids, number of ids) of each chunk in the worker's table."""
        keys = _hashes(chunks)
        place, met = self.known.find(keys)
        if not met.all():
            new = np.flatnonzero(~met)
            if len(self.known.keys) + len(new) > KNOWN_CHUNKS and len(self.known.keys):
                self.known.forget()
                return self._ids_of(chunks)
            texts = chunks.take(pa.array(new)).to_pylist()
            plain = np.fromiter(map(self._plain, texts), bool, len(texts))
            for some, coded in ((plain, self._joined), (~plain, self._one_by_one)):
                if some.any():
                    sizes, ids = coded(list(compress(texts, some)))
                    self.known.learn(keys[new[some]], sizes, ids)
            place, _ = self.known.find(keys)
        return self.known.starts[place], self.known.sizes[place].astype(np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Unsigned 32-bit ids of each text (null: none)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.spaced:
            whole = pc.match_substring_regex(texts, _WHITE)
            marked = pc.if_else(whole, texts, pc.replace_substring(texts, " ", _CUT + " "))
            lists = pc.split_pattern(marked, _CUT)
        else:
            lists = pc.ascii_split_whitespace(texts)
        coded = pc.dictionary_encode(lists.flatten())
        starts, sizes = self._ids_of(coded.dictionary)
        which = coded.indices.to_numpy()
        each = sizes[which]
        ends = np.cumsum(each)
        place = np.repeat(starts[which] - ends + each, each)
        place += np.arange(len(place))
        ids = self.known.flat[place]
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        at = np.concatenate([[0], ends])[bounds]
        out = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for row in np.flatnonzero(pc.match_substring(texts, _CUT)) if self.spaced else []:
            out[row] = self._one_by_one([texts[int(row)].as_py()])[1]
        return out
