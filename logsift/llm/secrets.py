"""Secret scan: keyword automaton, anchored patterns at its hits, checksum validation.

An Aho-Corasick automaton over all keywords reads the lower-cased bytes of a text once. Only where
it hits is the pattern of that keyword matched, anchored at the hit. Runs of hexadecimal digits have
no keyword; their bytes are classified at once and only runs of 32 or more remain. Tokens that carry
a checksum of their own are kept only if it is right.

Kinds, in their order in results: assign, access, hex (fixed definitions of the base), then
github and npm (prefix, 30 characters, CRC32 of these in six base-62 digits) and private_key
(armoured block: from its BEGIN line through the END line of the same label if that is the next
armour line, else through the lines that can be its body). Matches of a kind do not overlap; a match that fails its length or checksum is
dropped and still consumes its characters. Spans count code points, end exclusive.

Defined results: a null or empty text has no span; repeated rows each have their own result;
an empty table gives no row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import text_bytes, trimmed

KINDS = ("assign", "access", "hex", "github", "npm", "private_key")
BASE = KINDS[:3]

# The base patterns. Letters of the assign keyword are matched in either case.
ASSIGN = rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}

GITHUB = rb"gh[pousr]_[A-Za-z0-9]+"
NPM = rb"npm_[A-Za-z0-9]+"
# What stands between the lines of a body: blanks, quotes of mail or code, line ends written out.
_GAP = rb"""(?:[\s>"',]|\\[nr])"""
# Without its END line a block goes on through header lines, runs of at least 24 base64 digits and
# a shorter last one that is padded, fills its line or ends the text. Loops are possessive.
PRIVATE_KEY = (
    rb"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----"
    rb"(?:[^-]*+(?:-{1,4}(?!-)[^-]*+)*+-----END \1-----"
    rb"|(?:" + _GAP + rb"++(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+"
    rb"(?:(?:" + _GAP + rb"++[A-Za-z0-9+/]{24,}+={0,2})++"
    rb"(?:" + _GAP + rb"++[A-Za-z0-9+/]++={1,2}|(?:[\r\n]|\\[nr])++[\x20\t>]*+[A-Za-z0-9+/]++(?=[\x20\t]*+(?:[\r\n\\\"'-]|\Z)))?+"
    rb"|(?:[\r\n]|\\[nr])++[\x20\t>]*+[A-Za-z0-9+/]++={0,2}\Z)?+)"
)

KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "private_key": ("-----begin ",),
}
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "private_key": PRIVATE_KEY}

_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True


def checksum_holds(token: bytes) -> bool:
    """True if the last six of the 36 characters after the prefix are the CRC32 of the first 30."""
    body = token.partition(b"_")[2]
    if len(body) != 36:
        return False
    value, digits = zlib.crc32(body[:30]), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(_DIGITS[digit])
    return bytes(reversed(digits)) == body[30:]


def _accepted(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[1]) >= LEAST[kind]
    if kind == "access":
        return len(match[0]) >= LEAST[kind]
    return kind == "private_key" or checksum_holds(match[0])


def hex_runs(text: bytes) -> list[tuple[int, int]]:
    """(start, end) of runs of at least 32 digits 0-9a-f.

    Such a run covers two neighbouring multiples of 16, so only those are looked at first.
    """
    least = LEAST["hex"]
    data = np.frombuffer(text, np.uint8)
    sampled = _HEX[data[::16]]
    near = np.flatnonzero(sampled[1:] & sampled[:-1]) * 16
    found, reach = [], -1
    for at in near.tolist():
        if at < reach:
            continue
        start = stop = at
        while start > 0 and _HEX[text[start - 1]]:
            start -= 1
        while stop < len(text) and _HEX[text[stop]]:
            stop += 1
        reach = stop
        if stop - start >= least:
            found.append((start, stop))
    return found


class Scanner:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()
        self.patterns = {kind: re.compile(p) for kind, p in PATTERNS.items()}

    def spans(self, text: bytes | None) -> list[tuple[int, str, int]]:
        """(start, kind, end) in code points, ordered by start, then kind."""
        if not text:
            return []
        hits = [
            (end - length + 1, kind)
            for end, (kind, length) in self.automaton.iter(text.lower().decode("latin-1"))
        ]
        found = [(start, "hex", stop) for start, stop in hex_runs(text)]
        reached = dict.fromkeys(KINDS, 0)
        for start, kind in sorted(hits):
            if start < reached[kind]:
                continue
            match = self.patterns[kind].match(text, start)
            if match:
                reached[kind] = match.end()
                if _accepted(kind, match):
                    found.append((start, kind, match.end()))
        if found and not text.isascii():
            lead = np.frombuffer(text, np.uint8) & 0xC0 != 0x80
            before = np.concatenate([[0], np.cumsum(lead)])
            found = [(int(before[a]), kind, int(before[b])) for a, kind, b in found]
        return sorted(found, key=lambda x: (x[0], KINDS.index(x[1])))


FOUND = "doc_id long, spans array<struct<start: int, kind: string, stop: int>>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): the secrets of every row of ``docs`` (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            spans = [
                [{"start": a, "kind": kind, "stop": b} for a, kind, b in scanner.spans(text)]
                for text in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(spans, _SPANS)], names=["doc_id", "spans"]
            )

    return text_bytes(docs).mapInArrow(trimmed(rows), FOUND)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())]))


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of ``text`` replaced by ``mark``; other columns as they are."""
    at = docs.schema.fieldNames().index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, put = Scanner(), mark
        for batch in batches:
            clean = []
            for text in batch.column(at).to_pylist():
                spans = scanner.spans(text.encode()) if text else []
                parts, done = [], 0
                for start, _, stop in spans:
                    if stop > done:
                        if start >= done:
                            parts += [text[done:start], put]
                        done = stop
                clean.append("".join([*parts, text[done:]]) if parts else text)
            columns = list(batch.columns)
            columns[at] = pa.array(clean, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(trimmed(rows), docs.schema)


def span_text(spans: str, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of the spans of ``kinds``, comma-joined."""
    some = F.filter(spans, lambda s: s.getField("kind").isin(*kinds))
    one = lambda s: F.concat_ws(":", s.getField("kind"), s.getField("start"), s.getField("stop"))
    return F.array_join(F.transform(some, one), ",")


def kind_count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s.getField("kind") == kind)).cast("long")
