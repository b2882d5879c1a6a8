"""Best-fit packing planned over a histogram of lengths.

Texts become token ids inside tasks and are cut into pieces of at most
`capacity` ids.  Only the histogram of piece lengths (at most `capacity`
numbers) reaches the driver, where best fit, by falling length, is played over
counts: sequences of one filling are one entry.  The plan is a list of
intervals: of the pieces of a length, those ranked from `first` on go, `each` a
sequence, to consecutive sequences at one offset.  Pieces are ranked within
their length by one range sort of small rows, in which no length has a task of
its own, and take their slots by joining with the plan on length and rank.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise, text_bytes

CAPACITY = 2048
END = 0  # the id after each document
#: Pieces of at most so many characters are remembered, so many of them in each of two generations: some 200 MB of a Python worker.
PIECE, REMEMBERED = 48, 500_000
#: Bytes of a text whose ids are made at once.
BLOCK = 1 << 20

_ASCII_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- ids


#: Texts of these characters alone (Latin, without the one whose lower case is longer) need no normal form, and their letters, digits and blanks can be written down.
_NOT_LATIN = re.compile("[^\x00-\u012f\u0131-\u017f]|<\\|")
_LETTERS, _DIGITS, _BLANKS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\\x09-\\x0d\\x20\u0085\u00a0"
#: The normal form and the pattern of pre-tokens that the next line is for; other vocabularies are asked for whole words.
_FORM, _PATTERN = ["NFC", "Replace", "Lowercase"], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENS = re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_DIGITS}]|[^{_BLANKS}{_LETTERS}{_DIGITS}]+")


class Remembered(dict):
    """Ids of pieces by make(piece), little-endian and 4 bytes each; short pieces are remembered, the generation met longest ago is forgotten."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= PIECE:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class _Characters(dict):
    """How the pre-tokenizer writes a character's bytes, by code."""

    def __init__(self, pre_tokenizer):
        super().__init__()
        self.pre_tokenizer = pre_tokenizer

    def __missing__(self, code: int) -> str:
        self[code] = found = "".join(p for p, _ in self.pre_tokenizer.pre_tokenize_str(chr(code)))
        return found


class Ids:
    """Ids of texts as the library gives them, made of remembered pieces.

    Latin texts are cut into the pre-tokens of the vocabulary's own pattern,
    and the library's model is asked for new ones.  Other texts, and those that
    may hold a special string, are cut at ASCII blanks, and the library is
    asked for whole words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.characters = self.tokenizer.model, _Characters(self.tokenizer.pre_tokenizer)
        self.pieces, self.words = Remembered(self._piece), Remembered(self._word)
        with open(path, encoding="utf-8") as file:
            form = json.load(file)
        steps, cuts = ((form.get(a) or {}).get(b) or [{}] for a, b in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.known = [x.get("type") for x in steps] == _FORM and cuts[0].get("pattern") == {"Regex": _PATTERN}

    def _piece(self, piece: str) -> bytes:
        written = piece if piece.isascii() and piece.isalpha() else piece.translate(self.characters)
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def of(self, text: str) -> bytes:
        if not self.known or _NOT_LATIN.search(text):
            return b"".join(map(self.words.__getitem__, _WORDS.findall(text)))
        return b"".join(map(self.pieces.__getitem__, _PRE_TOKENS.findall(text.lower())))


_ids: dict[str, Ids] = {}


def blocks(raw: bytes, size: int = BLOCK):
    """A text in parts that end at ASCII blanks, which no pre-token spans; a part without one is as long as it must be."""
    at = 0
    while at < len(raw):
        cut = _ASCII_BLANK.search(raw, at + size) if at + size < len(raw) else None
        to = cut.end() if cut else len(raw)
        yield raw[at:to]
        at = to


def pieces_of(raw: bytes, ids_of: Ids, capacity: int):
    """(start, ids) of each piece of a text, its end id included; scratch is a block and a piece."""
    held, start, width = b"", 0, 4 * capacity
    for part in blocks(raw):
        held += ids_of.of(part.decode("utf-8", "replace"))
        whole = max(0, len(held) - 4) // width * width  # the end id may still fill the last piece
        for at in range(0, whole, width):
            yield start + at // 4, held[at : at + width]
        held, start = held[whole:], start + whole // 4
    held += array("I", [END]).tobytes()
    for at in range(0, len(held), width):
        yield start + at // 4, held[at : at + width]


def _cut(path: str, capacity: int, with_ids: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    def run(batches):
        ids_of = _ids.get(path) or _ids.setdefault(path, Ids(path))
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            out, held = [], 0

            def flushed():
                done = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
                return done

            for i, (doc, copy) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist())):
                for n, (start, ids) in enumerate(pieces_of(data[offsets[i] : offsets[i + 1]].tobytes(), ids_of, capacity)):
                    out.append((doc, copy, n, start, len(ids) // 4, zlib.crc32(ids), *([ids] if with_ids else [])))
                    held += len(ids) if with_ids else 0
                    if len(out) >= 4096 or held > 4 << 20:
                        yield flushed()
                        held = 0
            if out:
                yield flushed()

    return run


# ---------------------------------------------------------------- plan


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by falling length over a histogram: (length, first rank, pieces, each, first sequence, offset).

    Of a length's pieces those ranked first .. first + pieces - 1 go to
    consecutive sequences from `first sequence` on, `each` in every one, side by
    side from `offset`.  The outcome is that of best fit piece by piece: a
    piece goes where the least room is left for it, and a sequence that has just
    taken one is the fullest of its kind, so it takes as many as fit.  A length
    adds at most four entries and no entry takes part more often than distinct
    lengths fit a sequence, so the plan's size is bounded by `capacity` alone.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free places -> runs of sequences (first, number)
    sizes: list[int] = []
    made = 0

    def put(free: int, first: int, n: int):
        if n and free:
            if free not in room:
                room[free] = []
                insort(sizes, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                free = sizes[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], sizes[at]
            else:
                free, first, n = capacity, made, -(-left // (capacity // length))
                made += n
            each, offset = free // length, capacity - free
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, each, first, offset))
                put(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer are left than fit the next sequence
                out.append((length, rank, left, left, first + full, offset))
                put(free - left * length, first + full, 1)
                full, left = full + 1, 0
            put(free, first + full, n - full)
    return out


# ---------------------------------------------------------------- slots


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, copy (tells repeated rows apart), piece, start, length, ids_crc32 and, if asked for, ids (binary, little-endian, 4 bytes each)."""
    kinds = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("copy"))
    return rows.mapInArrow(_cut(tokenizer_path, capacity, with_ids), kinds)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset.

    A document is its ids and one END id; null and empty texts are that id
    alone.  Only documents of more than `capacity` ids are cut.  Repeated rows,
    and rows without an id, are documents of their own; other columns are
    ignored; an empty table gives no rows.  tokenizer_path must lead to the file
    on every executor.  Texts are not shuffled.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer_path, capacity, with_ids), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sort = ["length", "doc_id", "copy", "piece"]
    placed = F.monotonically_increasing_id()  # partition * 2^33 + row
    ordered = materialise(cut.repartitionByRange(n, *sort).sortWithinPartitions(*sort).withColumn("row", placed).withColumn("part", F.shiftright("row", 33)), "ordered")
    # where each partition's pieces of a length begin in that length's ranking: one row for each partition and each length at most
    cells = ordered.groupBy("length", "part").agg(F.min("row").alias("begin"), F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "part", (F.col("begin") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("shift"))
    slots = spark.createDataFrame(plan(counts, capacity), "length long, first long, pieces long, each long, sequence long, place long")
    ranked = ordered.join(F.broadcast(cells), ["length", "part"]).withColumn("rank", F.col("row") - F.col("shift"))
    taken = ranked.join(F.broadcast(slots), "length").where("rank >= first and rank < first + pieces")
    return taken.select(
        "doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else []),
        (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"), (F.col("place") + F.expr("(rank - first) % each") * F.col("length")).alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, length, ids (binary), documents (doc_id, piece, start, offset, length, by offset); packed: pack(with_ids=True)."""
    part = F.struct("offset", "length", "doc_id", "piece", "start", "ids")
    found = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))  # at most `capacity` parts
    return found.select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda b, p: F.concat(b, p["ids"])).alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("documents"),
    )
