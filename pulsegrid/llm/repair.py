"""Conversation structure repair: each distinct sequence of roles and faults is solved once.

A turn becomes one letter (its role; capital: truncated; x: must go).  Turns are
sorted over all partitions at once, and every run of one conversation inside a
partition is cut into segments of at most SEGMENT letters, so a conversation of
any length is spread over tasks.  Distinct segments are solved once each by
memoised recursion.  Segments of a long conversation are joined level by level:
for two states, the cheapest edits between them with the least audit.  As an
insertion always stands before a turn's edit, no audit of a segment is the
beginning of another one, so the least audits of parts make the least whole.
Audits are then replayed on the turns' texts as a stream, since a hash over a
conversation's repaired text is sequential by definition.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import bounded, materialise

#: Letters of a segment, and segments joined at once.
SEGMENT, FAN = 64, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn.
STATES = range(4)
_NEEDS = ("u", "u", "a", "u")  # the role that an inserted or changed turn takes
_AFTER = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What makes a whole of each state.
_END = ((0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, ""))
_NAMES = {"u": "user", "a": "assistant"}

_BLANK_CHARS = " \t\n\x0b\x0c\r"


# ---------------------------------------------------------------- turns


def damaged(conversations: DataFrame) -> DataFrame:
    """The table with planted faults, by crc32 of `conv_id:turn` modulo 20; null values count as one space there, in roles and in texts."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


def _described(turns: DataFrame) -> DataFrame:
    """Each turn with its place (timed, at), the hash of its text and what is wrong with the text by itself."""
    return turns.select(
        "conv_id", F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.unhex(F.md5(F.coalesce("text", F.lit(" ")))).alias("digest"), F.col("copies").cast("long").alias("copies"),
    )


_KEY = ["conv_id", "timed", "at", "role", "digest"]


def _matched(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join in which null keys meet, with the columns of left and what else right has."""
    other = right.select(*[F.col(k).alias(f"{k}_") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(other, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]), how).drop(*[f"{k}_" for k in keys])


def _lettered(turns: DataFrame) -> DataFrame:
    """One row for each distinct turn: copies, blank, first (no equal role and text at an earlier turn), truncated, initial."""
    last = F.substring(F.rtrim("text", F.lit(_BLANK_CHARS)), -1, 1)
    blank, ends = last == "", last.isin(".", "!", "?")
    rows = turns.select(*_KEY, "copies", blank.alias("blank"), ends.alias("ends"), F.substring("role", 1, 1).alias("initial"))
    rows = materialise(rows.groupBy(*_KEY).agg(F.sum("copies").alias("copies"), F.bool_and("blank").alias("blank"), F.bool_and("ends").alias("ends"), F.first("initial").alias("initial")), "turns")
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("timed", "at")).alias("m")).select("conv_id", "role", "digest", F.col("m.timed").alias("timed"), F.col("m.at").alias("at"), F.lit(True).alias("first"))
    return _matched(rows, firsts, _KEY, "left").select(*_KEY, "copies", "blank", F.coalesce("first", F.lit(False)).alias("first"), (~F.col("ends") & ~F.col("blank")).alias("truncated"), "initial")


def _segments(rows: DataFrame) -> DataFrame:
    """Runs of at most SEGMENT letters in the order of turns: conv_id, part, place, signature, initials of the ends, illegal neighbours inside."""
    copy = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    role = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    gone = F.col("blank") | ~F.col("first") | (F.col("copy") > 1)
    letter = F.when(gone, "x").when(F.col("truncated"), F.upper(role)).otherwise(role)
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = copy.select(*_KEY, "copy", letter.alias("letter"), role.alias("initial")).repartitionByRange(n, *_KEY, "copy").sortWithinPartitions(*_KEY, "copy")
    return ordered.select("conv_id", "letter", "initial", F.spark_partition_id().alias("part")).mapInArrow(_cut, "conv_id long, part int, place long, signature string, head string, tail string, illegal long")


_CUT = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("place", pa.int64()), ("signature", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("illegal", pa.int64())])
_LEGAL = {"su", "ua", "au"}


def _cut(batches):
    place, open_, done = 0, None, []

    def close():
        conv, part, letters, initials = open_
        done.append((conv, part, place, "".join(letters), initials[0], initials[-1], sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))))

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[]] * len(_CUT), _CUT)], schema=_CUT)
        done.clear()
        return out

    for rows in batches:
        for conv, letter, initial, part in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "letter", "initial", "part"))):
            if open_ and (open_[0] != conv or len(open_[2]) == SEGMENT):
                close()
                place += 1
                open_ = None
            open_ = open_ or (conv, part, [], [])
            open_[2].append(letter)
            open_[3].append(initial)
        yield batch()
    if open_:
        close()
        yield batch()


# ---------------------------------------------------------------- edits


def solve(signature: str, start: int) -> dict[int, tuple[int, str]]:
    """For each state that edits of a sequence can lead to from `start`: the least cost, and its least audit."""
    known: dict[tuple[int, int], dict[int, tuple[int, str]]] = {}

    def best(at: int, state: int) -> dict[int, tuple[int, str]]:
        if at == len(signature):
            return {state: (0, "")}
        if (at, state) in known:
            return known[at, state]
        found: dict[int, tuple[int, str]] = {}
        letter, now, before, cost = signature[at], state, "", 0
        for _ in range(3):  # none, one or two insertions; a third leads back
            ways = [(DELETE, "D", now)]
            if letter != "x":
                more = TRUNCATED if letter.isupper() else 0
                if (now, letter.lower()) in _AFTER:
                    ways.append((KEEP + more, "K", _AFTER[now, letter.lower()]))
                ways.append((REROLE + more, "R", _AFTER[now, _NEEDS[now]]))
            for price, edit, then in ways:
                for end, (rest, audit) in best(at + 1, then).items():
                    way = (cost + price + rest, before + edit + audit)
                    if end not in found or way < found[end]:
                        found[end] = way
            now, before, cost = _AFTER[now, _NEEDS[now]], before + "I", cost + INSERT
        known[at, state] = found
        return found

    return best(0, start)


def whole(parts: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least cost and audit of a whole conversation, from those that lead to each state."""
    return min((cost + _END[state][0], audit + _END[state][1]) for state, (cost, audit) in parts.items())


def join(first: list, second: list) -> list:
    """The edits of two sequences in a row: for each start the states reached, as {state: (cost, audit)}."""
    out = []
    for start in STATES:
        found: dict[int, tuple[int, str]] = {}
        for middle, (cost, audit) in first[start].items():
            for end, (more, rest) in second[middle].items():
                way = (cost + more, audit + rest)
                if end not in found or way < found[end]:
                    found[end] = way
        out.append(found)
    return out


_WAYS = "array<struct<start:int,state:int,cost:long,audit:string>>"


def _flat(table: list) -> list:
    return [{"start": q, "state": s, "cost": c, "audit": a} for q in STATES for s, (c, a) in table[q].items()]


def _table(flat) -> list:
    out: list = [{} for _ in STATES]
    for w in flat:
        out[w["start"]][w["state"]] = (w["cost"], w["audit"])
    return out


def _solved_whole(batches):
    for b in batches:
        found = [whole(solve(s, 0)) for s in b.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])


_WAYS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _solved_parts(batches):
    for b in batches:
        ways = [_flat([solve(s, q) for q in STATES]) for s in b.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("signature"), pa.array(ways, _WAYS_ARROW)], names=["signature", "ways"])


def _joined(batches):
    for b in batches:
        ways = [_flat(reduce(join, map(_table, tables))) for tables in b.column("tables").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("place"), pa.array(ways, _WAYS_ARROW)], names=["conv_id", "place", "ways"])


def _ended(batches):
    for b in batches:
        found = [whole(_table(w)[0]) for w in b.column("ways").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["conv_id", "cost", "audit"])


def _audits(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, cost, audit) of each conversation, and (conv_id, illegal)."""
    counted = segments.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("illegal").alias("illegal"))
    long = materialise(counted.where("n > 1").select("conv_id", "n"), "long")
    short = counted.where("n = 1").select("conv_id")
    # a conversation of one segment: its signature is the whole
    single = _matched(segments, short, ["conv_id"], "left_semi")
    solved = single.select("signature").distinct().mapInArrow(_solved_whole, "signature string, cost long, audit string")
    audits = single.join(solved, "signature").select("conv_id", "cost", "audit")
    most = long.agg(F.max("n")).head()[0] or 0
    if not most:
        return audits, counted.select("conv_id", "illegal")
    several = _matched(segments, long, ["conv_id"], "left_semi")
    # segments are numbered, and the letters that meet between two of them compared, over light rows
    order = Window.partitionBy("conv_id").orderBy("part", "place")
    several = materialise(several.select("conv_id", "signature", (F.row_number().over(order) - 1).cast("long").alias("place"), F.lag("tail").over(order).alias("before"), "head"), "segments")
    between = several.where("before is not null").groupBy("conv_id").agg(F.sum(F.when(F.concat("before", "head").isin(*sorted(_LEGAL)), 0).otherwise(1)).alias("between"))
    known = several.select("signature").distinct().mapInArrow(_solved_parts, f"signature string, ways {_WAYS}")
    level = several.join(known, "signature").select("conv_id", "place", "ways")
    while most > 1:
        groups = level.groupBy("conv_id", F.floor(F.col("place") / FAN).alias("up")).agg(F.sort_array(F.collect_list(F.struct("place", "ways"))).alias("t"))
        level = materialise(groups.select("conv_id", F.col("up").alias("place"), F.transform("t", lambda x: x["ways"]).alias("tables")).mapInArrow(_joined, f"conv_id long, place long, ways {_WAYS}"), "level")
        most = -(-most // FAN)
    audits = audits.unionByName(level.select("conv_id", "ways").mapInArrow(_ended, "conv_id long, cost long, audit string"))
    illegal = _matched(counted, between, ["conv_id"], "left").select("conv_id", (F.col("illegal") + F.coalesce("between", F.lit(0))).alias("illegal"))
    return audits, illegal


# ---------------------------------------------------------------- replay


class _Replay:
    """Edits of one conversation, taken turn by turn."""

    def __init__(self, conv, audit: str):
        self.conv, self.audit, self.at, self.state = conv, audit, 0, 0

    def _inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            need = _NEEDS[self.state]
            self.state = _AFTER[self.state, need]
            yield _NAMES[need], ""

    def turn(self, role: str, text: str):
        """The repaired turns that one turn gives."""
        yield from self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _AFTER[self.state, role[:1]]
            yield role, text
        elif edit == "R":
            need = _NEEDS[self.state]
            self.state = _AFTER[self.state, need]
            yield _NAMES[need], text

    def rest(self):
        yield from self._inserted()


def _stream(batches):
    """(conv_id, role, text) of repaired turns, from audits followed by their turns; one conversation after the other."""
    now = None
    for b in bounded(batches):
        for conv, kind, role, text, copies in zip(*(b.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text", "copies"))):
            if not kind:
                if now:
                    yield now.conv, now.rest(), True
                now = _Replay(conv, text)
            else:
                for _ in range(copies):
                    yield conv, now.turn(role, text), False
    if now:
        yield now.conv, now.rest(), True


_HASHES = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _hashed(batches):
    out, digest, empty = [], hashlib.sha256(), True
    for conv, turns, last in _stream(batches):
        for role, text in turns:
            digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
            empty = False
        if last:
            out.append((conv, digest.hexdigest()))
            digest, empty = hashlib.sha256(), True
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _HASHES)], schema=_HASHES)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _HASHES)], schema=_HASHES)


_TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def _written_out(batches):
    out, held, position = [], 0, 0
    for conv, turns, last in _stream(batches):
        for role, text in turns:
            out.append((conv, position, role, text))
            held += len(text)
            position += 1
        position = 0 if last else position
        if held > 1 << 20 or len(out) >= 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TURNS)], schema=_TURNS)
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _TURNS)], schema=_TURNS)


def _replayable(turns: DataFrame, audits: DataFrame) -> DataFrame:
    edits = audits.select("conv_id", F.lit(False).alias("kind"), F.lit(False).alias("timed"), F.lit(0).cast("long").alias("at"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(1).cast("long").alias("copies"), F.col("audit").alias("text"))
    texts = turns.select("conv_id", F.lit(True).alias("kind"), "timed", "at", "role", "digest", "copies", "text")
    both = edits.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "timed", "at", "role", "digest")
    return both.select("conv_id", "kind", "role", "text", "copies")


def _prepared(conversations: DataFrame) -> DataFrame:
    turns = conversations if "copies" in conversations.columns else conversations.withColumn("copies", F.lit(1))
    return _described(turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), "copies"))


def audit(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(conv_id, cost, audit), (conv_id, illegal) and the distinct turns with their faults; see repaired()."""
    rows = materialise(_lettered(_prepared(turns)), "lettered")
    audits, illegal = _audits(materialise(_segments(rows), "signatures"))
    return materialise(audits, "audits"), illegal, rows


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role, text.

    turns: conv_id, turn, role, text; a row counts `copies` times where there is
    such a column.  Rows are taken by turn (nulls first), ties by role and then
    by the MD5 of the text; null roles and texts count as one space, null ids
    are one conversation.  A turn that is blank or repeats an earlier one's role
    and text goes; others are kept, given the role that the order needs, or
    removed, and empty turns inserted, at the least cost that makes the roles
    an optional system turn and user and assistant in turns.  A conversation
    from which all goes has no rows.
    """
    audits, _, _ = audit(turns)
    return _replayable(_prepared(turns), audits).mapInArrow(_written_out, "conv_id long, position long, role string, text string")


def report(original: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each conv_id of `original`: faults of its `turns`, cost and audit of their repair, hash of the repaired text.

    gaps (null where no long holds the span), blank, duplicate, truncated (each
    turn counts for its first fault), illegal (neighbours whose initials are not
    su, ua or au), cost, audit, repaired_sha256.  A conversation without turns
    has zeros, no audit and the hash of the empty text.  See repaired() for
    nulls, ties and repeated rows.
    """
    audits, illegal, rows = audit(turns)
    timed = rows.where("timed").groupBy("conv_id", "at").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.max("at").alias("b"), F.min("at").alias("a"), F.count("*").alias("d"))
    span = F.col("b").cast("decimal(20,0)") - F.col("a") + 1 - F.col("d")
    gaps = timed.select("conv_id", span.cast("decimal(38,0)").try_cast("long").alias("gaps"), F.lit(True).alias("timed_"))
    first = F.col("first") & ~F.col("blank")
    faults = rows.groupBy("conv_id").agg(
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).when(F.col("first"), F.col("copies") - 1).otherwise(F.col("copies"))).alias("duplicate"),
        F.sum(F.when(first & F.col("truncated"), 1).otherwise(0)).alias("truncated"),
    )
    hashes = _replayable(_prepared(turns), audits).mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    out = original.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for more in (faults, gaps, illegal, audits, hashes):
        out = _matched(out, more, ["conv_id"], "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(
        "conv_id", F.when(F.coalesce("timed_", F.lit(False)), F.col("gaps")).otherwise(0).cast("long").alias("gaps"), *zero,
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
