"""Helpers shared by the training-data operators.

A *word* is a maximal run of characters other than the six ASCII blanks
(space, tab, newline, vertical tab, form feed, carriage return).  Word hashing
is vectorised over the bytes of a whole Arrow batch, so Python touches a
document, not a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.tables import materialise

BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of text that a step of a task handles at once; a longer document is handled alone.
BLOCK_BYTES = 256 << 10
#: Bytes whose running sums are held at once, whatever the length of a text.
SEGMENT = 64 << 10

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_BY_LENGTH = 0xD6E8FEB86659FD93
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that make up a plain word (letters, digits, anything not ASCII) and those of ASCII punctuation.
_PLAIN = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_PUNCTUATION = ~_PLAIN & ~_BLANK & (np.arange(256) > 32) & (np.arange(256) < 127)
SOLID = {"word": ~_BLANK, "plain": _PLAIN, "punctuation": _PUNCTUATION}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# --------------------------------------------------------------- tables


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


#: Up to so many ids (16 MB of longs) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of docs with (left_semi) or without (left_anti) one of the ids (a column doc_id), which are written and counted first."""
    ids = materialise(ids.select("doc_id").where("doc_id is not null").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def word_array(text: Column) -> Column:
    """Words of a text as an array; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


# --------------------------------------------------------------- hashing


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _powers():
    """P**i and P**-i modulo 2**64 for the places of a segment."""
    out = []
    with np.errstate(over="ignore"):
        for base in (_P, _P_INV):
            step = np.full(SEGMENT + 1, base, np.uint64)
            step[0] = 1
            out.append(np.cumprod(step))
    return out


_UP, _DOWN = _powers()


def _long_hash(piece: np.ndarray) -> np.uint64:
    """The hash of one word of any length, by segments of it."""
    total, factor = 0, 1
    with np.errstate(over="ignore"):
        for at in range(0, len(piece), SEGMENT):
            part = piece[at : at + SEGMENT].astype(np.uint64) + np.uint64(1)
            total += factor * int((part * _UP[: len(part)]).sum(dtype=np.uint64))
            factor = factor * int(_UP[SEGMENT]) % (1 << 64)
    return np.uint64((total + len(piece) * _BY_LENGTH) % (1 << 64))


def _in_segment(buf, first, a: int, kind: str, opened: int | None):
    """(starts, ends, still open word, word that was open and ends here) of one segment of a buffer, as places of the buffer."""
    b = min(len(buf), a + SEGMENT)
    solid = SOLID[kind][buf[a : min(len(buf), b + 1)]]
    edge = np.zeros(b - a + 1, bool)
    edge[first[np.searchsorted(first, a) : np.searchsorted(first, b, "right")] - a] = True
    before = np.empty(b - a, bool)
    before[0] = opened is not None
    before[1:] = solid[: b - a - 1]
    after = np.zeros(b - a, bool)
    after[: len(solid) - 1] = solid[1:][: b - a]
    here = solid[: b - a]
    starts = np.flatnonzero(here & ~(before & ~edge[:-1])) + a
    ends = np.flatnonzero(here & ~(after & ~edge[1:])) + a + 1
    done = None
    if opened is not None and len(ends) and (not len(starts) or ends[0] <= starts[0]):
        done, ends, opened = (opened, int(ends[0])), ends[1:], None
    if len(starts) > len(ends):
        opened, starts = int(starts[-1]), starts[:-1]
    return starts, ends, opened, done


def hash_kinds(buf: np.ndarray, first: np.ndarray, lower: bool, kinds: list[tuple[str, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each (kind, prefix): (64-bit hashes, start bytes) of the pieces of a buffer of texts.

    kind: what makes up a piece (SOLID).  prefix: only so many bytes of each are
    hashed (0: all).  first: the byte offset at which each text begins, with the
    end as last entry.  Equal pieces have equal hashes in every batch and
    process.  Scratch is bounded by SEGMENT, not by the length of a text.
    """
    out = [([], []) for _ in kinds]
    names = list(dict.fromkeys(k for k, _ in kinds))
    opened = dict.fromkeys(names)
    for a in range(0, len(buf), SEGMENT):
        part = buf[a : a + SEGMENT]
        part = _LOWER[part] if lower else part
        total = np.zeros(len(part) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _UP[: len(part)], out=total[1:])
        for name in names:
            starts, ends, opened[name], done = _in_segment(buf, first, a, name, opened[name])
            for (k, prefix), (hashes, places) in zip(kinds, out):
                if k != name:
                    continue
                if done:
                    piece = buf[done[0] : min(done[1], done[0] + prefix) if prefix else done[1]]
                    hashes.append(np.array([_long_hash(_LOWER[piece] if lower else piece)], np.uint64))
                    places.append(np.array([done[0]], np.int64))
                x, y = starts - a, (np.minimum(ends, starts + prefix) if prefix else ends) - a
                with np.errstate(over="ignore"):
                    hashes.append((total[y] - total[x]) * _DOWN[x] + (y - x).astype(np.uint64) * np.uint64(_BY_LENGTH))
                places.append(starts)
    return [(mix(np.concatenate(h)), np.concatenate(p)) if h else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for h, p in out]


def hash_words(block, first: np.ndarray, lower: bool = False, kind: str = "word"):
    """(64-bit hash, start byte) of each word of a buffer of texts; see hash_kinds."""
    return hash_kinds(np.frombuffer(block, np.uint8), np.asarray(first), lower, [(kind, 0)])[0]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without a copy; null counts as empty."""
    if isinstance(column, list):
        column = pa.array(column, pa.string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def text_blocks(texts, limit: int = BLOCK_BYTES):
    """Blocks of an Arrow string array: (index of the first text, bytes, offsets of the texts); null counts as empty."""
    data, offsets = text_bytes(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def bounded(batches, text: str = "text", limit: int = 4 * BLOCK_BYTES):
    """The record batches of a task in slices of at most so many bytes of text (a longer text alone), so what a task makes of one is bounded."""
    for batch in batches:
        _, offsets = text_bytes(batch.column(text))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def hashed_texts(texts, lower: bool = False, limit: int = BLOCK_BYTES, kind: str = "word"):
    """For each text, in order: (word hashes, the text's bytes)."""
    for _, block, first in text_blocks(texts, limit):
        h, start = hash_words(block, first, lower, kind)
        cut = np.searchsorted(start, first)
        for i in range(len(first) - 1):
            yield h[cut[i] : cut[i + 1]], block[first[i] : first[i + 1]]


_STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each window of k consecutive words (not distinct); none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n] * _STEP[0]
        for j in range(1, k):
            h += words[j : n + j] * _STEP[j]
    return mix(h)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Distinct k-word shingles, sorted; of fewer words the whole sequence is the one shingle."""
    if 0 < len(words) < k:
        return shingles(words, len(words)) + np.uint64(len(words))
    return np.unique(shingles(words, k))
