"""Token counts of whole texts, as the tokenizer's own library gives them.

Ordinary documents are made of remembered pieces (packing.Ids), of which new
ones alone are given to the library.
A huge document is encoded in overlapping chunks with offsets, which are
spliced at a boundary that is stable in any context: a place right after a
blank at which both encodings start a token.  An overlap without one is
widened; if it reaches the start of the chunk, or the chunk has no blank, both
are encoded as one, up to a chunk beyond the next blank, so that a stretch
without blanks is encoded once and not again for every chunk of it.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import text_bytes
from pulsegrid.llm.packing import Ids

#: Characters of a chunk and of the first overlap.
CHUNK, OVERLAP = 16_384, 512
_BLANKS = " \t\n\x0b\x0c\r"
_BLANK = re.compile(r"[\x20\x09-\x0D]")
LIMIT = 2048


@lru_cache(maxsize=2)
def _ids(path: str) -> Ids:
    return Ids(path)


def _starts(tokenizer, text: str, at: int) -> np.ndarray:
    """Offsets in the document at which the tokens of a part that begins at `at` start."""
    found = tokenizer.encode(text, add_special_tokens=False).offsets
    return np.array([a for a, _ in found], np.int64) + at


def splice_count(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text, from overlapping chunks of it."""
    def beyond(at: int) -> int:
        """A chunk beyond the next blank."""
        blank = _BLANK.search(text, at)
        return min(len(text), blank.end() + chunk) if blank else len(text)

    total, begin = 0, 0
    end = min(chunk, len(text))
    starts = _starts(tokenizer, text[:end], 0)
    while end < len(text):
        blank = max(text.rfind(c, begin + 1, end) for c in _BLANKS)
        step, joined = max(overlap, 2 * (end - blank)) if blank > 0 else end - begin, False
        while not joined:
            first = max(begin, end - step)
            last = min(len(text), end + chunk)
            if first == begin:  # nothing stable in the whole chunk: both in one
                end = beyond(end)
                starts, joined = _starts(tokenizer, text[begin:end], begin), True
                break
            following = _starts(tokenizer, text[first:last], first)
            common = np.intersect1d(starts[starts > first], following)
            stable = [p for p in common[common < end].tolist() if text[p - 1] in _BLANKS]
            if stable:
                cut = stable[len(stable) // 2]
                total += int(np.count_nonzero(starts < cut))
                starts, begin, end, joined = following[following >= cut], cut, last, True
            step *= 4
    return total + len(starts)


def _counted(path: str, chunk: int, overlap: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        ids = _ids(path)
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            counts = []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                text = data[a:b].tobytes().decode("utf-8", "replace")
                counts.append(splice_count(ids.tokenizer, text, chunk, overlap) if len(text) > chunk else len(ids.of(text)) // 4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), pa.array(counts, pa.int64())], schema=schema)

    return run


def token_counts(docs: DataFrame, tokenizer_path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty.  No begin, end or other special tokens are
    added; their strings inside texts are what the library makes of them.  No
    shuffle; a task holds one Arrow batch.  tokenizer_path must lead to the
    file on every executor.  Other columns are ignored.
    """
    counted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _counted(tokenizer_path, chunk, overlap), "doc_id long, n_bytes long, n_tokens long"
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
