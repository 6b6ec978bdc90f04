"""Plain single-process versions of the training-data operators, written from their definitions."""

import re
import zlib

import xxhash

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def ascii_lower(text):
    return (text or "").translate(LOWER)


def components(ids, links):
    """Smallest reachable id of every id (None is above all others)."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode("utf-8"), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def crc(text):
    return zlib.crc32((text or "").encode())


def docs(spark, rows):
    """rows: (doc_id, text[, lang, source, n_chars])."""
    return spark.createDataFrame([(*r, *[None] * (5 - len(r))) for r in rows], DOCS)
