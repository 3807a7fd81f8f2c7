"""Texts cut where no tokenizer in use can join, so that each distinct segment is tokenised once.

A cut lies before a blank or line feed that follows something other than white space, or between two ASCII characters that no
token of the given vocabularies holds side by side.  No merge reaches over such a place and the byte-level tokenizer's pre-tokens on
either side are those of the whole text, so the tokens of a text are those of its segments, one after the other.
"""
from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .common import cut
from .words import column_bytes

_SPACES = (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20))
#: White space beyond ASCII, in UTF-8.
_WIDE_SPACES = np.array(sorted(int.from_bytes(chr(c).encode().rjust(3, b"\0"), "big") for c in (
    0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Segments that begin with their only white space stay apart from each other when they are joined.
_PLAIN = re.compile(r"[ \n]\S+").fullmatch
JOINED = 512  # so many segments are tokenised as one string


def byte_level(token: str) -> bytes:
    """The bytes of a token of a byte-level vocabulary."""
    return bytes(_BYTE_OF[c] for c in token)


def _byte_alphabet() -> dict[str, int]:
    """Printable bytes stand for themselves, the others for characters from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


_BYTE_OF = _byte_alphabet()


class Cutter:
    """Cuts texts for vocabularies given as their tokens' bytes."""

    def __init__(self, *vocabularies: list[bytes]):
        inside = np.zeros((256, 256), bool)
        for tokens in vocabularies:
            for token in tokens:
                b = np.frombuffer(token, np.uint8)
                inside[b[:-1], b[1:]] = True
        safe = np.zeros((256, 256), bool)
        visible = np.arange(0x21, 0x7F)
        safe[np.ix_(visible, visible)] = True
        marks = np.array([b for b in visible.tolist() if not chr(b).isalnum()])
        safe[marks, ord("'")] = False  # a run of marks would end at a shortened verb
        solid = np.ones(256, bool)
        solid[list(_SPACES)] = False
        safe[solid, 0x20] = safe[solid, 0x0A] = True
        self._safe = (safe & ~inside).reshape(-1)

    def _cuts(self, raw: np.ndarray) -> np.ndarray:
        """Of each byte, whether a segment may begin there."""
        out = np.zeros(len(raw), bool)
        if len(raw) > 1:
            out[1:] = self._safe.take(raw[:-1].astype(np.uint16) << np.uint16(8) | raw[1:])
            wide = np.flatnonzero(out[1:] & (raw[:-1] >= 0x80)) + 1
            before = raw[wide - 1].astype(np.int32) | raw[wide - 2].astype(np.int32) << 8  # a wide character has two bytes at least
            three = before | raw[np.maximum(wide - 3, 0)].astype(np.int32) << 16
            out[wide[np.isin(three, _WIDE_SPACES) | np.isin(before, _WIDE_SPACES[_WIDE_SPACES < 1 << 16])]] = False
        return out

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The segments of all texts, and the number of segments before each text, with the end."""
        raw, at = column_bytes(texts)
        raw = np.ascontiguousarray(raw)
        begins = self._cuts(raw)
        begins[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(begins)
        kind, array = (np.int32, pa.StringArray) if len(raw) < 2**31 else (np.int64, pa.LargeStringArray)
        ends = np.append(starts, len(raw)).astype(kind)
        return array.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(raw)), np.searchsorted(starts, at)

    def _slices(self, text: pa.Array, most: int) -> list[pa.Array]:
        """One long text as texts of about ``most`` bytes that begin where segments may."""
        raw, _ = column_bytes(text)
        out, begin = [], 0
        while begin < len(raw):
            size = most
            while True:  # a segment longer than ``most`` stays whole
                end = min(begin + size, len(raw))
                places = np.flatnonzero(self._cuts(raw[max(begin, end - (1 << 16)) if size == most else begin:end])) if end < len(raw) else np.zeros(0, np.int64)
                if end == len(raw):
                    break
                if len(places):
                    end = (max(begin, end - (1 << 16)) if size == most else begin) + int(places[-1])
                    if end > begin:
                        break
                size *= 2
            out.append(pa.array([raw[begin:end].tobytes()], pa.binary()).cast(pa.string()))
            begin = end
        return out or [text]

    def parts(self, batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, pa.Array, bool]]:
        """Rows, their texts, and whether these are the texts' ends.  A text beyond ``most`` bytes comes in several parts, each with its row, so that
        a task never works on more than a few megabytes at once."""
        for rows in cut(batches, column, most):
            texts = rows.column(column)
            if rows.num_rows == 1 and texts.is_valid()[0].as_py() and texts.nbytes > 2 * most:
                found = self._slices(texts, most)
                for k, text in enumerate(found):
                    yield rows, text, k == len(found) - 1
            else:
                yield rows, texts, True


def joined(segments: list[str]) -> list[tuple[list[int], str, np.ndarray]]:
    """Strings that hold many segments: which ones, the string, and the byte where each segment starts, with the end.
    A segment that others could change is alone."""
    plain, out = [], []
    for i, s in enumerate(segments):
        if _PLAIN(s):
            plain.append(i)
        else:
            out.append(([i], s, np.array([0, len(s.encode())])))
    for k in range(0, len(plain), JOINED):
        own = plain[k:k + JOINED]
        texts = [segments[i] for i in own]
        sizes = [len(s) if s.isascii() else len(s.encode()) for s in texts]
        out.append((own, "".join(texts), np.concatenate(([0], np.cumsum(sizes)))))
    return out


class ByteLevel:
    """A byte-level tokenizer file of ``tokenizers``; special tokens' strings are tokens unless ``plain``."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        special = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.tokens: list[bytes] = [b""] * (max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.tokens[i] = special[i] if i in special else byte_level(token)
        self.sizes = np.array([len(t) for t in self.tokens])
        self.kind = np.dtype("<u2" if len(self.tokens) <= 1 << 16 else "<u4")

    def ids(self, segments: list[str]) -> list[bytes]:
        """The ids of each segment as little-endian bytes of ``kind``."""
        out: list[bytes] = [b""] * len(segments)
        parts = joined(segments)
        for (own, _, at), found in zip(parts, self.tokenizer.encode_batch_fast([p[1] for p in parts], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            ends = np.concatenate(([0], np.cumsum(self.sizes[ids])))
            first = (np.searchsorted(ends, at) * self.kind.itemsize).tolist()
            data = ids.tobytes()
            for i, x, y in zip(own, first, first[1:]):
                out[i] = data[x:y]
        return out


def gather(values: list[bytes], kind: np.dtype, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[w] for w in which, one after the other, and the place where each starts, with the end."""
    kind = np.dtype(kind)
    data = np.frombuffer(b"".join(values), kind)
    size = np.fromiter(map(len, values), np.int64, len(values)) // kind.itemsize
    start = np.cumsum(size) - size
    each = size[which]
    ends = np.concatenate(([0], np.cumsum(each)))
    narrow = np.int32 if max(ends[-1], len(data)) < 2**31 else np.int64
    at = np.repeat((start[which] - ends[:-1]).astype(narrow), each)
    at += np.arange(ends[-1], dtype=narrow)
    return data.take(at), ends


class Known:
    """What is known of segments, filled as they come until ``most`` are held: the first to come are the commonest."""

    def __init__(self, learn, most: int, longest: int = 64):
        self._learn, self._most, self._longest, self._known = learn, most, longest, {}

    def __call__(self, kinds: list[str]) -> list:
        known = self._known
        own = list(map(known.get, kinds))
        new = [i for i, x in enumerate(own) if x is None]
        for i, x in zip(new, self._learn([kinds[i] for i in new])):
            own[i] = x
            if len(known) < self._most and len(kinds[i]) <= self._longest:
                known[kinds[i]] = x
        return own
