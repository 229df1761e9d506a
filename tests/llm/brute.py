"""Plain versions of the corpus operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def base_rule(text):
    text = text or ""
    words, seen, covered = WORD.findall(text), {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            covered.update(j for i in places for j in range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    size = min(size, len(words))
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) if words else frozenset()


def components(docs, size, percent):
    """docs: (id, text); the least id that each id reaches."""
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in docs}


def without_repeats(docs, length=50):
    """docs: (id, text); id: (bytes, removed, runs, sha256 of the rest)."""
    first, out = {}, {}
    for i, t in docs:
        data = (t or "").encode()
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            first[w] = min(first.get(w, i), i)
    for i, t in docs:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        rest = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        out[i] = (len(data), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(rest).hexdigest())
    return out


def ids_by_library(path, texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
