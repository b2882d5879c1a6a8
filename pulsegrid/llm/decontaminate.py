"""Benchmark decontamination: BM25 retrieval of test items by training passages, then overlap checks.

The benchmark is indexed in blocks of bounded size, one inverted index each;
every passage of every document queries every block.  Terms are word bigrams:
single words of a language are shared by all its texts.  Scores are divided by
what an item scores against itself, so one threshold holds for all items, and
retrieval is complete: block-max WAND leaves out only what can't reach it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded, by_ids, hash_words, materialise, shingles, text_blocks

#: BM25 parameters, postings of a block, and the share of its own score from which an item is retrieved.
K1, B, POSTINGS, THRESHOLD = 1.2, 0.75, 32, 0.5
#: Share of the bigrams of the question, and of the answer, that a passage must have.
OVERLAP = 0.5
#: Shortest passage, in words; characters of benchmark text in one index.
PASSAGE, INDEX_CHARS = 128, 4_000_000


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is what follows a mark ("Answer:", "A:"), else the last third of the words."""
    marked = re.search(r"(?:^|\n|\s)(?:Answer|ANSWER|A)\s*:\s*", text)
    if marked and text[: marked.start()].strip() and text[marked.end() :].strip():
        return text[: marked.start()], text[marked.end() :]
    words = text.split()
    cut = max(1, len(words) - max(1, len(words) // 3))
    return " ".join(words[:cut]), " ".join(words[cut:])


def _words(text: str) -> np.ndarray:
    raw = text.encode()
    return hash_words(raw, np.array([0, len(raw)]), True, "plain")[0]


def _bigrams(text: str) -> np.ndarray:
    """Bigrams of a text in order; of a single word, the word."""
    h = _words(text)
    return shingles(h, 2) if len(h) > 1 else h


class Index:
    """Inverted index of a block of items with block maxima of normalised BM25 contributions.

    whole: (number of items, their mean length, the longest, items that have a
    term) of the whole benchmark; without it the block is the benchmark.
    """

    def __init__(self, items: list[tuple[int, str]], whole: tuple[int, float, int, dict[int, int]] | None = None):
        kept = [(i, _bigrams(t), t) for i, t in items if t]
        kept = [(i, g, t) for i, g, t in kept if len(g)]
        self.ids = [i for i, _, _ in kept]
        self.parts = [tuple(np.unique(_bigrams(x)) for x in split_item(t)) for _, _, t in kept]
        self.longest = max([len(g) + 1 for _, g, _ in kept], default=1)
        self.spans = [max(PASSAGE, 2 * (len(g) + 1)) for _, g, _ in kept]
        self.alone = [tuple(len(_words(x)) == 1 for x in split_item(t)) for _, _, t in kept]
        n, mean = len(kept), np.mean([len(g) for _, g, _ in kept]) if kept else 1.0
        n_all, n_with = n, None
        if whole:
            n_all, mean, self.longest, n_with = whole
        found: dict[int, list] = {}
        for k, (_, g, _) in enumerate(kept):
            terms, counts = np.unique(g, return_counts=True)
            part = counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(g) / mean))
            for t, c in zip(terms.tolist(), part.tolist()):
                found.setdefault(t, []).append((k, c))
        own = np.zeros(n)
        for t, posts in found.items():
            df = n_with[t] if n_with is not None else len(posts)
            idf = np.log(1 + (n_all - df + 0.5) / (df + 0.5))
            for j, (k, c) in enumerate(posts):
                posts[j] = (k, c * idf)
                own[k] += c * idf
        self.terms = np.array(sorted(found), np.uint64)
        self.postings, self.most = [], np.zeros(len(found))
        for j, t in enumerate(self.terms.tolist()):
            items_, part = np.array([k for k, _ in found[t]]), np.array([c / own[k] for k, c in found[t]])
            block_max = np.array([part[a : a + POSTINGS].max() for a in range(0, len(part), POSTINGS)])
            self.postings.append((items_, part, block_max))
            self.most[j] = part.max()
        owned: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for j, (items_, part, _) in enumerate(self.postings):
            for k, c in zip(items_.tolist(), part.tolist()):
                owned[k].append((j, c))
        #: Of each item its terms, in order, and what each adds to its score.
        self.owned = [(np.array([j for j, _ in o], np.int64), np.array([c for _, c in o])) for o in owned]
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.terms & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def places(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of bigrams that are terms, which terms)."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.table[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
        term = np.minimum(np.searchsorted(self.terms, grams[at]), len(self.terms) - 1)
        right = self.terms[term] == grams[at]
        return at[right], term[right]

    def retrieve(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """(item, score) of every item that distinct terms score at or above the threshold: block-max WAND."""
        lists = [[0, *self.postings[t]] for t in terms.tolist()]  # place, items, contributions, block maxima
        end = len(self.ids)
        here = lambda c: int(c[1][c[0]]) if c[0] < len(c[1]) else end
        least = threshold - 1e-9
        out = []
        while True:
            lists = sorted((c for c in lists if c[0] < len(c[1])), key=here)
            bound, pivot = 0.0, None
            for n, c in enumerate(lists):
                bound += float(c[3].max())
                if bound >= least:
                    pivot = n
                    break
            if pivot is None:
                return out
            item = here(lists[pivot])
            while pivot + 1 < len(lists) and here(lists[pivot + 1]) == item:
                pivot += 1
            ahead = lists[: pivot + 1]
            at = [int(np.searchsorted(c[1], item)) for c in ahead]
            in_block = [float(c[3][a // POSTINGS]) if a < len(c[1]) else 0.0 for c, a in zip(ahead, at)]
            if sum(in_block) < least:
                # no item up to the nearest block end, or up to the next list, can reach the threshold
                ends = [int(c[1][min(len(c[1]), (a // POSTINGS + 1) * POSTINGS) - 1]) + 1 for c, a in zip(ahead, at) if a < len(c[1])]
                if pivot + 1 < len(lists):
                    ends.append(here(lists[pivot + 1]))
                to = max(min(ends), item + 1)
                for c in ahead:
                    c[0] = int(np.searchsorted(c[1], to))
                continue
            score = 0.0
            for c, a in zip(ahead, at):
                if a < len(c[1]) and c[1][a] == item:
                    score += float(c[2][a])
                c[0] = int(np.searchsorted(c[1], item + 1))
            if score >= least:
                out.append((item, score))

    def search(self, words: np.ndarray, grams: np.ndarray, threshold: float, overlap: float):
        """(item id, score, question overlap, answer overlap, first word) of what a document's words and their bigrams contain.

        Passages long enough for the longest item are searched; an item found in
        one is then scored, and its question and answer looked for, in spans of
        its own size there, so that a long item makes no check of others lax.
        """
        at, term = self.places(grams)
        if not len(at):
            return
        size = max(PASSAGE, 2 * self.longest)
        total = np.concatenate(([0.0], np.cumsum(self.most[term])))
        for begin in range(0, max(1, len(grams) - size // 2 + 1), size // 2):
            a, b = np.searchsorted(at, (begin, begin + size))
            if total[b] - total[a] < threshold - 1e-9:
                continue
            for k, _ in self.retrieve(np.unique(term[a:b]), threshold):
                yield from self.spans_with(k, at, term, words, begin, begin + size, threshold, overlap)

    def spans_with(self, k: int, at: np.ndarray, term: np.ndarray, words: np.ndarray, begin: int, end: int, threshold: float, overlap: float):
        """What search() yields of one item: its spans that begin in a passage, or hold its beginning."""
        own, adds = self.owned[k]
        span = self.spans[k]
        step = span // 2
        mine = np.isin(term, own)
        at, term = at[mine], term[mine]
        for first in range(max(0, begin // step - 1) * step, end, step):
            a, b = np.searchsorted(at, (first, first + span))
            if a == b:
                continue
            found = np.unique(term[a:b])
            score = float(adds[np.searchsorted(own, found)].sum())
            if score < threshold - 1e-9:
                continue
            # a part of one word has no bigram: it is looked for among the span's words
            passage, within = self.terms[found], words[first : first + span + 1]
            q, r = (float(np.isin(part, within if alone else passage).mean()) if len(part) else 1.0 for part, alone in zip(self.parts[k], self.alone[k]))
            if q >= overlap and r >= overlap:
                yield self.ids[k], score, q, r, first


def index_blocks(benchmark: DataFrame, chars: int = INDEX_CHARS):
    """Indexes of blocks of the benchmark; each block's text is of bounded size, whatever the benchmark's.

    Lengths and document frequencies are those of the whole benchmark, so
    scores and passages don't depend on the blocks.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    whole = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    blocks = int(whole // chars + 1)
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)))
    if blocks > 1:

        def run(batches):
            for b in batches:
                grams = [_bigrams(t).view(np.int64) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("block"), pa.array([len(g) for g in grams], pa.int64()), pa.array([np.unique(g) for g in grams], pa.list_(pa.int64()))], names=["block", "n", "terms"])

        counted = materialise(dealt.select(F.col("block").cast("long").alias("block"), "text").mapInArrow(run, "block long, n long, terms array<long>").where("n > 0"), "benchmark-terms")
        t = counted.agg(F.count("*").alias("n"), F.sum("n").alias("total"), F.max("n").alias("most")).first()
        each = counted.select("block", F.explode("terms").alias("t"))
        # a term is once a block, with the number of its items in all blocks
        spread = materialise(each.groupBy("t").agg(F.count("*").alias("df"), F.collect_set("block").alias("blocks")), "benchmark-frequencies")
    for k in range(blocks):
        whole = None
        if blocks > 1 and t["n"]:
            df = {r["t"] & 0xFFFFFFFFFFFFFFFF: r["df"] for r in spread.where(F.array_contains("blocks", F.lit(k).cast("long"))).select("t", "df").collect()}
            whole = (t["n"], t["total"] / t["n"], t["most"] + 1, df)
        yield Index([(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == k).orderBy("item_id", "text").collect()], whole)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word) of the documents that contain test items.

    Words are letters and digits, lower-cased (A-Z).  An item is looked for in
    windows of twice its own length (PASSAGE words at least) at half their
    length, so it is whole in one of them, and other items' lengths don't
    matter.  A pair is reported once, with its best
    passage (highest score, then first), if it scores `threshold` of the item's
    own score and has `overlap` of the distinct bigrams of question and answer
    each; a question or answer of one word must be among the passage's words.
    An item of a single word matches only a document of that word alone.  Null and empty texts and null ids of items match nothing; repeated
    rows of a document are one; a row with a null doc_id is reported under null.
    """
    given = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    found = None
    for index in index_blocks(benchmark):

        def run(batches, index=index):
            for batch in bounded(batches):
                rows = []
                ids = batch.column("doc_id")
                for base, block, first in text_blocks(batch.column("text")):
                    h, start = hash_words(block, first, True, "plain")
                    cut = np.searchsorted(start, first)
                    for i in range(len(first) - 1):
                        words = h[cut[i] : cut[i + 1]]
                        grams = shingles(words, 2) if len(words) > 1 else words
                        rows += [(ids[base + i].as_py(), *x) for x in index.search(words, grams, threshold, overlap)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()))],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                )

        part = given.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "first_word", "question_overlap", "answer_overlap")).alias("b"))
    return best.select("doc_id", "item_id", (-F.col("b.s")).alias("score"), "b.question_overlap", "b.answer_overlap", "b.first_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that contain no test item.

    All rows of an id go when one of them contains an item; rows with a null id
    stay, as no id tells them apart.
    """
    return by_ids(docs, contaminated(docs, benchmark), "left_anti")
