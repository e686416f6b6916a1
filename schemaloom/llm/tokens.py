"""Token ids of whole texts by a tokenizer file, with a bounded cache of what lies between spaces.

Ids depend only on the part between two places at which no token can cross. For the two kinds of
tokenizer files known here such places are found on the bytes of many texts at once; equal parts
are then told by an Arrow dictionary, so that Python and the tokenizer see each distinct part of a
slice once, and the ids of the texts are gathered from theirs. Any other tokenizer file encodes
whole texts, and so are texts encoded that hold the string of an added token or odd white space.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np

#: Parts kept by a worker, about 150 bytes each: just under a size at which a dictionary doubles.
CACHE_PARTS = 1_390_000
#: Bytes of the longest part that is kept.
LONGEST_PART = 64
#: Bytes of text that are encoded together; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: New parts that the tokenizer is given as one text, between separators.
JOINED = 128

_SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.isin(np.arange(256), list(_SPACES))
_LOWERED = np.array([32 if _IS_SPACE[i] else i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
#: First byte of the characters from U+0300 on, where combining marks begin.
_FROM_MARKS = 0xCC
#: White space on which regular expression engines disagree, or that lies beyond ASCII, in UTF-8.
_ODD_SPACE = re.compile(rb"\x1c|\x1d|\x1e|\x1f|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf")

#: How to divide: the bytes and where texts start, to the bytes of the parts and where those start.
Divide = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _at_spaces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the white space after them, as single spaces, and A-Z in lower case.

    The tokenizer composes letters and then lowers them, so a letter before a combining mark stays.
    """
    plain = _LOWERED[data]
    composing = np.flatnonzero((plain[:-1] != data[:-1]) & (data[1:] >= _FROM_MARKS))
    composing = composing[~_IS_SPACE[data[composing]]]
    plain[composing] = data[composing]
    space = plain == 32
    begins = np.zeros(len(data), bool)
    begins[1:] = space[:-1] & ~space[1:]
    begins[starts] = True
    return plain, begins


def _before_spaces(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with the one space before them; of other white space, the last character before a word is a part, and what is before it."""
    space = _IS_SPACE[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    begins[starts] = True
    inside = np.ones(len(data), bool)
    inside[starts] = False
    words = np.flatnonzero(space[:-1] & ~space[1:] & inside[1:]) + 1
    begins[words - 1] = True
    begins[words[data[words - 1] != 32]] = True
    return data, begins


def _division(config: dict) -> Divide | None:
    """How to divide a text without changing its ids, by what the file says of its tokenizer; None for whole texts."""
    normalizer, pre = config.get("normalizer"), config.get("pre_tokenizer") or {}
    if config["model"].get("type") != "BPE":
        return None
    if normalizer is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return _before_spaces
    steps = [x.get("type") for x in (normalizer or {}).get("normalizers", [])]
    kinds = [x.get("type") for x in pre.get("pretokenizers", [])]
    drops_space = kinds[:1] == ["Split"] and pre["pretokenizers"][0].get("behavior") == "Removed" and pre["pretokenizers"][0].get("invert")
    if steps == ["NFC", "Replace", "Lowercase"] and drops_space and r"[^\s\p{L}\p{N}]+" in json.dumps(pre["pretokenizers"][0]["pattern"]).replace("\\\\", "\\"):
        return _at_spaces
    return None


def _plain(added: dict) -> bool:
    """Whether an added token is found in texts as it is, within one part, and takes nothing beside it."""
    odd = ("single_word", "lstrip", "rstrip", "normalized")
    return added["content"] == "".join(added["content"].split()) != "" and not any(added.get(k) for k in odd)


def _gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + length], one after another."""
    ends = np.cumsum(lengths, dtype=np.int64)
    small = np.int32 if len(flat) < 1 << 31 and (not len(ends) or ends[-1] < 1 << 31) else np.int64
    at = np.arange(ends[-1] if len(ends) else 0, dtype=small)
    at += np.repeat((starts - (ends - lengths)).astype(small), lengths)
    return flat[at]


class _Cache:
    """Parts and their ids, in arrays that grow by doubling."""

    def __init__(self) -> None:
        self.row: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def __len__(self) -> int:
        return len(self.row)

    def __iter__(self) -> Iterator[bytes]:
        return iter(self.row)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(len(a), n - len(a)), a.dtype)])

    def add(self, parts: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        first, n = len(self), len(self) + len(parts)
        self.flat = self._room(self.flat, self.used + len(ids))
        self.start, self.length = self._room(self.start, n), self._room(self.length, n)
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[first:n] = self.used + np.cumsum(lengths) - lengths
        self.length[first:n] = lengths
        self.used += len(ids)
        self.row.update(zip(parts, range(first, n), strict=True))


class Encoder:
    """Whole texts to little-endian unsigned 32-bit ids, without added special tokens.

    A special token's string in a text is ordinary text, or, with ``special_strings``, that token,
    as the library has it by default. Bytes that are no UTF-8 count as U+FFFD.
    """

    def __init__(self, path: str, cache_parts: int = CACHE_PARTS, special_strings: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special_strings = special_strings
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        added = config.get("added_tokens") or []
        self.divide = _division(config) if all(map(_plain, added)) else None
        self.strings = [x["content"].lower().encode() for x in added]
        # between such strings the tokenizer reads each text for itself; no two of them may overlap
        apart = [x for x in added if x.get("special") and not any(x["content"][0] in y["content"][1:] for y in added)]
        self.separator = (apart[0]["content"].encode(), apart[0]["id"]) if apart else None
        self.most, self.cache = cache_parts, _Cache()

    def _encoded(self, texts: list[str], special: bool) -> list[np.ndarray]:
        self.tokenizer.encode_special_tokens = not special
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)  # the same ids, without offsets
        return [np.array(e.ids, np.uint32) for e in encode(texts, add_special_tokens=False)]

    def _each(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = self._encoded([x.decode("utf-8", "replace") for x in parts], self.special_strings)
        return np.concatenate(found) if found else np.zeros(0, np.uint32), np.array([len(x) for x in found], np.int64)

    def _fill(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of new parts, one after another, and how many each has; short parts go to the tokenizer many at a time."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(parts), JOINED):
            some = parts[i : i + JOINED]
            held = b" ".join(some).lower()
            if self.separator and len(held) < JOINED * LONGEST_PART and not any(s in held for s in self.strings):
                text, mark = self.separator[0].join(some).decode("utf-8", "replace"), self.separator[1]
                own = self._encoded([text], True)[0]
                marks = np.flatnonzero(own == mark)
                if len(marks) == len(some) - 1:
                    ids.append(own[own != mark])
                    lengths.append(np.diff(marks, prepend=-1, append=len(own)) - 1)
                    continue
            own, n = self._each(some)
            ids.append(own)
            lengths.append(n)
        return np.concatenate(ids), np.concatenate(lengths)

    def _odd(self, data: np.ndarray, starts: np.ndarray) -> list[int]:
        """The texts that are encoded whole."""
        own = data.tobytes()
        at = [m.start() for m in _ODD_SPACE.finditer(own)] if self.divide is _before_spaces else []
        low = own.lower()
        for s in self.strings:
            i = low.find(s)
            while i >= 0:
                at.append(i)
                i = low.find(s, i + 1)
        return np.unique(np.searchsorted(starts, at, side="right") - 1).tolist() if at else []

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts of one slice, and where each one's begin and the last one's end."""
        import pyarrow as pa

        size = len(data)
        first = offsets[:-1]
        if not size:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        starts = np.unique(first[first < size])
        own, begins = self.divide(data, starts)
        odd = self._odd(data, starts)
        if odd:
            own = own.copy() if own is data else own
            ends = np.append(starts[1:], size)
            for k in odd:
                a, b = starts[k], ends[k]
                begins[a + 1 : b] = False
                own[a:b] = data[a:b]
        at = np.flatnonzero(begins)
        buffers = [None, pa.py_buffer(np.append(at, size)), pa.py_buffer(np.ascontiguousarray(own))]
        parts = pa.Array.from_buffers(pa.large_binary(), len(at), buffers).dictionary_encode()
        distinct, which = parts.dictionary.to_pylist(), parts.indices.to_numpy()
        if len(self.cache) + len(distinct) > self.most:  # before the dictionary doubles
            self.cache = _Cache()
        cache = self.cache
        row = np.fromiter(map(cache.row.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(row < 0)
        if len(new):
            long = np.array([len(distinct[i]) > LONGEST_PART for i in new])
            short = new[~long]
            missing = [distinct[i] for i in short]
            row[short] = len(cache) + np.arange(len(short))
            cache.add(missing, *self._fill(missing))
        else:
            long = np.zeros(0, bool)
        known = row >= 0
        length = np.zeros(len(distinct), np.int32)
        start = np.zeros(len(distinct), np.int64)
        length[known] = cache.length[row[known]]
        flat = _gathered(cache.flat, cache.start[row[known]], length[known])
        start[known] = np.cumsum(length[known]) - length[known]
        if long.any():  # long parts are not kept, so that the cache is bounded in bytes
            once, n = self._each([distinct[i] for i in new[long]])
            start[new[long]] = len(flat) + np.cumsum(n) - n
            length[new[long]] = n
            flat = np.concatenate([flat, once])
        n = length[which]
        upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return _gathered(flat, start[which], n), upto[np.searchsorted(at, offsets)]

    def encode_column(self, column) -> Iterator[bytes]:
        """The ids of each text of an Arrow column of strings; a null text is empty."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if self.divide is None:
            for i in range(0, len(column), 256):
                some = column.slice(i, 256).to_pylist()
                yield from (x.astype("<u4").tobytes() for x in self._encoded([t or "" for t in some], self.special_strings))
            return
        own = pc.fill_null(column, "").cast(pa.large_binary())
        _, offsets, data = own.buffers()
        offsets = np.frombuffer(offsets, np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        i = 0
        while i < len(own):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE_BYTES, side="right")) - 1)
            ids, upto = self._slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids = ids.astype("<u4", copy=False)
            yield from (ids[a:b].tobytes() for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))
            i = j

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text; a null text is empty."""
        import pyarrow as pa

        return list(self.encode_column(pa.array(list(texts), pa.large_string())))


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, special_strings: bool = False) -> Encoder:
    """This process's encoder for a tokenizer file; workers live longer than tasks, and so does its cache."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, special_strings)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(path, special_strings=special_strings)
    return _ENCODERS[key]


def encoded_rows(batches, path: str, special_strings: bool = False) -> Iterator[tuple]:
    """(doc_id, ids as bytes) of Arrow batches with doc_id and text, in order, a slice of the texts at a time."""
    own = encoder(path, special_strings)
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), own.encode_column(batch.column(1)), strict=True)
