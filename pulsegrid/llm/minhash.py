"""Near duplicates by b-bit MinHash.

One Arrow pass per document gives its number of distinct five-word shingles, a
128-bit fingerprint of the set, one key for each band of minima, and the low
bits of all minima packed into longs.  Documents with the same set are one
class from then on.  Band keys give candidate pairs; the packed bits give a
collision-corrected similarity that drops hopeless ones; the rest are compared
on their full sets.

Candidates are never all pairs of a bucket.  First each bucket proposes its
smallest member to all others, and confirmed links merge classes into
components.  Only buckets that then still hold more than one component are
looked at again: small ones give their cross pairs, large ones are dealt into
cells of two bounded blocks of members, each compared inside one task, which
emits nothing but links.  So no two classes that share a bucket stay in
different components without having been compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded, by_ids, hashed_texts, materialise, mix, shingle_set
from pulsegrid.llm.graph import components

SHINGLE = 5
#: Bands and minima a band: a pair at 0.75 shares no band once in 190,000 times, at 0.85 once in 10**10.
BANDS, ROWS = 32, 4
#: Minima kept in the signature (the first BANDS * ROWS also make the bands), and low bits kept of each.
MINIMA, BITS = 256, 4
#: Similarity of a link, in hundredths.
LINK = 75
#: Estimates below this go: nearly five standard deviations under a link.
HOPELESS = 0.62
#: Buckets up to this size give their cross pairs; larger ones go by blocks of about so many members or shingles.
SMALL, BLOCK, BLOCK_SHINGLES = 24, 1500, 1_500_000

_A = (mix(np.arange(1, MINIMA + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (mix(np.arange(1001, MINIMA + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_LONGS = MINIMA * BITS // 64
_LANES = 0x1111111111111111
_CHANCE = 1.0 / (1 << BITS)
_BAND = mix(np.arange(5001, 5001 + BANDS, dtype=np.uint64))

SIGNED = "n_shingles long, fp1 long, fp2 long, bands array<long>, bits array<long>"


def minima(shingled: np.ndarray) -> np.ndarray:
    """The least value of each of the hash functions over a set."""
    low = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    h = (shingled >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(h), 1024):
        part = h[at : at + 1024]
        np.minimum(low, (_A[:, None] * part[None, :] + _B[:, None]).min(axis=1), out=low)
    return low


def signature(shingled: np.ndarray):
    """(fingerprint halves, band keys, packed low bits) of a non-empty set."""
    low = minima(shingled).astype(np.uint64)
    with np.errstate(over="ignore"):
        fp1, fp2 = shingled.sum(dtype=np.uint64), mix(shingled).sum(dtype=np.uint64)
        keys = _BAND.copy()
        for row in low[: BANDS * ROWS].reshape(BANDS, ROWS).T:
            keys = mix(keys ^ row)
    per = 64 // BITS
    kept = (low & np.uint64((1 << BITS) - 1)).reshape(_LONGS, per)
    bits = np.bitwise_or.reduce(kept << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=1)
    return fp1, fp2, keys.view(np.int64), bits.view(np.int64)


def _sign(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
    for batch in bounded(batches):
        out = ([], [], [], [], [])
        for words, *_ in hashed_texts(batch.column("text"), lower=True):
            shingled = shingle_set(words, SHINGLE)
            if len(shingled):
                fp1, fp2, keys, bits = signature(shingled)
                row = (len(shingled), int(fp1.view(np.int64)), int(fp2.view(np.int64)), keys, bits)
            else:
                row = (0, None, None, None, None)
            for column, value in zip(out, row):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, schema.types[1:]))], schema=schema
        )


def _sets(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("shingled", pa.list_(pa.int64()))])
    for batch in bounded(batches):
        found = [np.sort(shingle_set(words, SHINGLE).view(np.int64)) for words, *_ in hashed_texts(batch.column("text"), lower=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, schema.types[1])], schema=schema)


def estimated(x: str = "x", y: str = "y"):
    """Collision-corrected similarity of two packed signatures: differing lanes are counted by bits, and chance equals taken off."""
    differing = F.lit(0)
    for i in range(_LONGS):
        z = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2))
        differing = differing + F.bit_count(z.bitwiseAND(F.lit(_LANES)))
    return (F.lit(1.0 - _CHANCE) - differing / F.lit(float(MINIMA))) / (1 - _CHANCE)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingled) of the documents named."""
    found = by_ids(docs, ids, "left_semi")
    return materialise(found.mapInArrow(_sets, "doc_id long, shingled array<long>"), "sets")


def _confirmed(pairs: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the full sets are similar enough."""
    bits = own.select("doc_id", "bits")
    near = (
        pairs.join(bits.toDF("b", "y"), "b").join(bits.toDF("a", "x"), "a").where(estimated() >= HOPELESS).select("a", "b")
    )
    near = materialise(near, "near")
    sets = _texts_of(docs, near.select(F.explode(F.array("a", "b")).alias("doc_id")))
    common = F.size(F.array_intersect("p", "q"))
    return (
        near.join(sets.toDF("b", "q"), "b")
        .join(sets.toDF("a", "p"), "a")
        .where(100 * common >= LINK * (F.size("p") + F.size("q") - common))
        .select("a", "b")
    )


def _lists(column) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _cell(table: pa.Table) -> pa.Table:
    """The links between different components in one cell of a large bucket."""
    ids, comp, blk = (table.column(c).to_numpy() for c in ("doc_id", "component", "blk"))
    band, lo, hi = (table.column(c)[0].as_py() for c in ("band", "lo", "hi"))
    bits, keys = _lists(table.column("bits")).view(np.uint64), _lists(table.column("bands"))
    sets = table.column("shingled")
    of: dict[int, np.ndarray] = {}

    def get(i):
        if i not in of:
            of[i] = sets[i].values.to_numpy(zero_copy_only=False)
        return of[i]

    a, b = [], []
    for i in np.flatnonzero(blk == lo):
        other = (comp != comp[i]) & (ids > ids[i] if lo == hi else blk == hi)
        at = np.flatnonzero(other)
        if not len(at):
            continue
        z = bits[at] ^ bits[i]
        z |= z >> np.uint64(1)
        z |= z >> np.uint64(2)
        differing = np.bitwise_count(z & np.uint64(_LANES)).sum(axis=1)
        at = at[(1 - _CHANCE - differing / MINIMA) / (1 - _CHANCE) >= HOPELESS]
        at = at[~(keys[at, :band] == keys[i, :band]).any(axis=1)]  # an earlier band has compared those
        for j in at:
            p, q = get(i), get(j)
            if 100 * min(len(p), len(q)) < LINK * max(len(p), len(q)):
                continue
            common = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * common >= LINK * (len(p) + len(q) - common):
                a.append(min(ids[i], ids[j]))
                b.append(max(ids[i], ids[j]))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _inside_large(entries: DataFrame, own: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components inside large mixed buckets: entries has key, band, doc_id, component, members, weight."""
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    dealt = (
        entries.withColumn("blocks", blocks)
        .withColumn("blk", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", "band", "doc_id", "component", "blk", F.least("blk", "x").alias("lo"), F.greatest("blk", "x").alias("hi"))
    )
    sets = _texts_of(docs, entries)
    full = dealt.join(own.select("doc_id", "bits", "bands"), "doc_id").join(sets.groupBy("doc_id").agg(F.first("shingled").alias("shingled")), "doc_id")
    return full.groupBy("key", "lo", "hi").applyInArrow(_cell, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and split at ASCII blanks; documents are linked
    if their distinct five-word shingle sets have a Jaccard similarity of 0.75
    or more.  A document with fewer words has its whole sequence as its one
    shingle; one without text or words has n_shingles 0 and is its own
    component.  Rows with the same doc_id get the component of that id's rows
    together; a row with a null doc_id takes part in nothing: its component_id
    is null and it is kept.  kept: doc_id = component_id.  Other columns are ignored.
    Links are found by bands of minima: a pair at exactly 0.75 shares none once
    in 190,000 times, and is dropped by the estimate once in some 500,000; more
    similar pairs are lost more rarely still.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = materialise(docs.mapInArrow(_sign, f"doc_id long, {SIGNED}"), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")

    # classes of equal sets: the smallest id stands for all
    same = ["fp1", "fp2", "n_shingles"]
    classes = some.groupBy(same).agg(F.min("doc_id").alias("rep"))
    member = materialise(some.select("doc_id", *same).join(classes, same).select("doc_id", "rep", "n_shingles").distinct(), "classes")
    own = some.join(member.where("doc_id = rep").select("doc_id", "n_shingles").distinct(), ["doc_id", "n_shingles"], "left_semi")
    entries = own.select("doc_id", "n_shingles", F.posexplode("bands").alias("band", "key"))
    shared = entries.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead <> last")
    held = materialise(entries.join(shared.select("key", "lead"), "key"), "buckets")

    tried = held.where("lead <> doc_id").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = materialise(_confirmed(tried, own, docs), "links")
    label = components(links)

    # buckets that still hold several components
    placed = held.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = placed.groupBy("key").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("members"), F.sum("n_shingles").alias("weight")
    ).where("c0 <> c1").drop("c0", "c1")
    placed = materialise(placed.join(mixed, "key"), "mixed")
    few = placed.where(F.col("members") <= SMALL).select("key", "doc_id", "component")
    cross = (
        few.toDF("key", "a", "ca").join(few.toDF("key", "b", "cb"), "key").where("a < b and ca <> cb").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    )
    more = materialise(_confirmed(cross, own, docs), "links")
    large = placed.where(F.col("members") > SMALL)
    most = materialise(_inside_large(large, own, docs), "links")
    if not (more.isEmpty() and most.isEmpty()):
        label = components(links.unionByName(more).unionByName(most))

    of_class = member.select("doc_id", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    of_id = of_class.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    found = F.coalesce("component_id", "doc_id")
    return signed.select("doc_id", "n_shingles").join(of_id, "doc_id", "left").select(
        "doc_id", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept")
    )
