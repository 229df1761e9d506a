"""Token ids of whole texts by the ``tokenizers`` library, with a bounded store of encoded chunks.

The two vocabularies that are known here cut a text into pieces (words, digits, symbols, white space) before any
merge. Texts of plain Latin letters, digits and ASCII symbols are cut into these pieces over the bytes of a whole
batch; each distinct piece goes to the library's merges once per worker, and the ids of a text are gathered from
those of its pieces. Other texts are cut at single spaces, which no piece crosses, and their distinct chunks go to
the library; so do, as they are, texts with unusual white space and all texts of any other tokenizer file.

Strings of special tokens in a text are ordinary text (``encode_special_tokens``), so that no document can
write a control token; the library's default would give them their special id.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space other than space, tab and line ends; also marks that are white space to some tools only.
UNUSUAL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{2064}\x{3000}\x{feff}]"
#: A space within white space that is not its last character: a piece may start before it and go on behind it.
INNER_SPACE = r"[ \t\n\r] (?:[ \t\n\r]|$)"
#: A character that is none of the plain ones: then texts are not cut into pieces here.
NOT_PLAIN = r"[^\n -~A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{132}-\x{17f}]"
SPACE, LINE_END, LETTER, DIGIT, OTHER = range(5)
#: How the two vocabularies cut texts. Only files with one of these settings take the short way.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            BYTE_LEVEL | {"use_regex": False},
        ],
    },
}
#: Chunks and ids kept at most; beyond either, the store starts anew.
KEPT_CHUNKS, KEPT_IDS = 300_000, 3_000_000
#: Bytes of text that are handled at once.
BYTES_AT_ONCE = 4 << 20


def character_classes() -> np.ndarray:
    """The class of each byte of a plain text: bytes beyond ASCII are parts of letters there."""
    out = np.full(256, OTHER, np.uint8)
    out[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
    out[48:58], out[32], out[10] = DIGIT, SPACE, LINE_END
    return out


CLASSES = character_classes()


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + n) for n, b in enumerate(hidden)}


SHOWN = {b: c for b, c in byte_characters().items() if b}  # plain texts have no zero byte

_encoders: dict[str, "Encoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def encoder(path: str) -> "Encoder":
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of runs, given by where they start and how long they are, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def starts_of_pieces(data: np.ndarray, begins: np.ndarray, with_space: bool) -> np.ndarray:
    """Whether a piece starts at each byte of plain texts, which begin at ``begins``.

    ``with_space``: a space belongs to the word behind it, and digits and white space form runs; else digits stand
    alone and white space only parts pieces.
    """
    n, kind = len(data), CLASSES[data]
    fresh = np.zeros(n + 1, bool)
    fresh[begins] = fresh[n] = True
    fresh = fresh[:n]
    blank = kind <= LINE_END
    starts = np.empty(n, bool)
    starts[0] = True
    np.not_equal(kind[1:], kind[:-1], out=starts[1:])
    after_blank = np.r_[False, blank[:-1]]
    # White space is one run, but its last character stands apart before a word of the same text.
    before_word = np.r_[~blank[1:] & ~fresh[1:], False]
    if with_space:
        after_space = np.r_[False, kind[:-1] == SPACE]
        starts = np.where(blank, ~after_blank | before_word, starts & ~after_space)
    else:
        starts = np.where(blank, ~after_blank, starts) | (kind == DIGIT)
    starts |= fresh
    at = np.flatnonzero((data == 39) & starts)  # an apostrophe and the ending of a short form
    if len(at):
        ends = np.r_[begins, n][np.searchsorted(begins, at, "right")]  # of the text
        low = lambda k: np.where(at + k < ends, data[np.minimum(at + k, n - 1)] | (0 if with_space else 32), 0)
        one, two = low(1), low(2)
        short = np.isin(one, [*b"stmd"])
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        for found, size in ((at[short], 2), (at[long & ~short], 3)):
            for k in range(1, size):
                starts[found + k] = False
            starts[(found + size)[found + size < n]] = True
    return starts


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Of the two parts alone: the file's vocabulary as Python objects would stay in the worker's memory.
        parts = {k: getattr(self.tokenizer, k) for k in ("normalizer", "pre_tokenizer")}
        cuts = {k: None if x is None else json.loads(x.__getstate__()) for k, x in parts.items()}
        self.with_space = cuts == {"normalizer": None, "pre_tokenizer": BYTE_LEVEL}
        self.known = self.with_space or cuts == WORDS
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def by_library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def by_merges(self, pieces: list[str]) -> list[list[int]]:
        """The ids of pieces of plain texts: straight to the merges, in the characters that stand for bytes."""
        merge = self.tokenizer.model.tokenize
        texts = pieces if self.with_space else "\0".join(pieces).lower().split("\0")
        shown = "\0".join(texts).encode().decode("latin-1").translate(SHOWN).split("\0")
        return [[t.id for t in merge(x)] for x in shown]

    def find(self, chunks: list[str], encode: Callable[[list[str]], list[list[int]]]) -> np.ndarray:
        """Places of distinct chunks in the store, new ones made by ``encode``."""
        found = [*map(self.places.get, chunks)]
        if None in found:
            new = [c for c, k in zip(chunks, found, strict=True) if k is None]
            lists = encode(new)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            n, total = len(self.places), int(sizes.sum())
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while n + len(new) > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
            self.starts[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[n : n + len(new)] = sizes
            self.used += total
            self.places.update(zip(new, range(n, n + len(new)), strict=True))
            found = [*map(self.places.__getitem__, chunks)]
        return np.array(found, np.int64)

    def gathered(self, places: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at these places, and where those of each text begin and end; ``bounds``: of the texts, in places."""
        sizes = self.sizes[places]
        ends = np.r_[0, np.cumsum(sizes)]
        return self.pool[ragged(self.starts[places], sizes)], ends[bounds]

    def of_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cuts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
        cuts = cuts - cuts[0]
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        first = np.flatnonzero(starts_of_pieces(data, np.unique(cuts[:-1][np.diff(cuts) > 0]), self.with_space))
        bounds = np.searchsorted(first, cuts)
        pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.r_[first, len(data)].astype(np.int32)), pa.py_buffer(data))
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        if not self.with_space:  # white space is dropped
            word = CLASSES[data[first]] > LINE_END
            codes, bounds = codes[word], np.r_[0, np.cumsum(word)][bounds]
        used = np.zeros(len(coded.dictionary), bool)
        used[codes] = True
        places = np.zeros(len(used), np.int64)
        places[used] = self.find(coded.dictionary.filter(pa.array(used)).to_pylist(), self.by_merges)
        return self.gathered(places[codes], bounds)

    def of_chunks(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that may be cut at single spaces."""
        lists = pc.split_pattern(texts, " ") if self.with_space else pc.utf8_split_whitespace(texts)
        bounds = lists.offsets.to_numpy()
        bounds = bounds - bounds[0]
        coded = lists.flatten().dictionary_encode()
        codes, chunks = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if not self.with_space:
            return self.gathered(self.find(chunks, self.by_library)[codes], bounds)
        first = bounds[:-1]  # all chunks but the first of a text have the space before them; every text has one
        heads, nth = np.unique(codes[first], return_inverse=True)
        places = self.find([" " + c for c in chunks], self.by_library)[codes]
        places[first] = self.find([chunks[k] for k in heads.tolist()], self.by_library)[nth]
        return self.gathered(places, bounds)

    def of_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = self.by_library(texts.to_pylist())
        return np.fromiter(chain.from_iterable(lists), np.uint32), np.r_[0, np.cumsum([*map(len, lists)])].astype(np.int64)

    def encode_batch(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (no nulls) one after the other, each with ``end_id`` behind it, and where each begins and ends."""
        if len(self.places) > KEPT_CHUNKS or self.used > KEPT_IDS:
            self.clear()
        texts = texts.cast(pa.string())
        kind = np.full(len(texts), 2)
        if self.known:
            matches = lambda pattern: pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
            kind = matches(NOT_PLAIN).astype(int)
            if kind.any():
                kind[(kind > 0) & (matches(UNUSUAL) | (matches(INNER_SPACE) if self.with_space else False))] = 2
        parts, starts, sizes, at = [], np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), 0
        for k, encode in enumerate((self.of_plain, self.of_chunks, self.of_whole)):
            rows = np.flatnonzero(kind == k)
            if len(rows):
                ids, bounds = encode(texts if len(rows) == len(texts) else texts.take(pa.array(rows)))
                starts[rows], sizes[rows] = at + bounds[:-1], np.diff(bounds)
                parts.append(ids)
                at += len(ids)
        ids = parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts])
        ends = np.r_[0, np.cumsum(sizes + (end_id is not None))]
        out = np.full(int(ends[-1]), end_id or 0, np.uint32)
        out[ragged(ends[:-1], sizes)] = ids if len(parts) == 1 else ids[ragged(starts, sizes)]
        return out, ends

    def encode(self, text: str) -> list[int]:
        return self.encode_batch(pa.array([text], pa.string()))[0].tolist()


def list_of(ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrow lists of 32-bit ids between the bounds."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.ascontiguousarray(ids).view(np.int32)))


def checksums(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """CRC-32 of the ids between the bounds, as little-endian unsigned 32-bit integers."""
    import zlib

    data, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), (bounds * 4).tolist()
    return np.array([zlib.crc32(data[i:j]) for i, j in zip(at[:-1], at[1:])], np.int64)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of the batches whose texts have some ``BYTES_AT_ONCE`` together, or one row.

    What Arrow has kept from earlier tasks of the worker goes back to the system first.
    """
    pa.default_memory_pool().release_unused()
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False))
        k = 0
        while k < batch.num_rows:
            n = max(1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BYTES_AT_ONCE, "right")) - k)
            yield batch.slice(k, n)
            k += n
