"""Packing, conversation repair and whitening against brute force and odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from pulsegrid.llm import packing, queries, repair, whitening
from pulsegrid.llm.common import read

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_BPE = str(public_tokenizers.path("word_bpe_49k.json"))


# ---------------------------------------------------------------- 11


def best_fit(lengths, capacity):
    """Sequences of best fit by falling length, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def gapless(rows, capacity):
    """rows: (sequence, offset, length)."""
    held = collections.defaultdict(list)
    for s, o, n in rows:
        held[s].append((o, n))
    for parts in held.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= capacity
    return len(held)


def test_plan_is_best_fit_piece_by_piece():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, rng.choice([3, capacity])) for _ in range(rng.randint(0, 120))]
        counts = collections.Counter(lengths)
        taken, rows = collections.Counter(), []
        for n, first, pieces, each, sequence, offset in packing.plan(counts, capacity):
            assert first == taken[n]
            taken[n] += pieces
            rows += [(sequence + i // each, offset + i % each * n, n) for i in range(pieces)]
        assert taken == counts and gapless(rows, capacity) == best_fit(lengths, capacity)


def test_plan_is_small_whatever_the_counts():
    rng = random.Random(5)
    counts = {n: rng.randint(1, 10**9) for n in range(1, 2049)}
    found = packing.plan(counts)
    assert len(found) < 60_000
    room = sum(n * c for n, c in counts.items()) / 2048
    assert max(s + -(-p // e) for _, _, p, e, s, _ in found) <= room * 1.01 + 1


def wanted_pieces(rows, capacity):
    from tokenizers import Tokenizer

    out, tokenizer = [], Tokenizer.from_file(WORD_BPE)
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(doc, i, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for i, at in enumerate(range(0, len(ids), capacity))]
    return sorted(out, key=str)


def test_pack_holds_every_token_of_odd_rows(spark):
    rng = random.Random(1)
    odd = ["", None, " \n", "x", "It's I'LL don't 12345 a_b <|endoftext|> <|startoftext|>x", "é É ﬁ Straße ΑΣ 漢字かな　b", "\x1c\x85   ​\x00z", "y" * 5000, "a" * 64 + " " + "b" * 65]
    odd += [" ".join(rng.choice(["word", "the", "Ünï", "a,b.c!", "9"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(odd)] + [(0, ""), (None, "no id"), (3, "x")]
    docs = spark.createDataFrame([(*r, "s", 7) for r in rows], "doc_id long, text string, sequence_id string, length long")
    for capacity in (16, 2048):
        got = packing.pack(docs, WORD_BPE, capacity, with_ids=True)
        found = got.collect()
        assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], key=str) == wanted_pieces(rows, capacity)
        assert gapless([(r.sequence_id, r.offset, r.length) for r in found], capacity) == best_fit([r.length for r in found], capacity)
        for s in packing.sequences(got).collect():
            assert len(s.ids) == 4 * s.length <= 4 * capacity
            for p in s.documents:
                assert any(bytes(r.ids) == bytes(s.ids[4 * p.offset : 4 * (p.offset + p.length)]) for r in found if (r.doc_id, r.piece) == (p.doc_id, p.piece))
    assert packing.pack(docs.limit(0), WORD_BPE).collect() == []


def test_words_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(packing, "BLOCK", 10)
    ids_of = packing.Ids(WORD_BPE)
    for more in ("", " Ж"):
        text = " ".join(f"w{i % 11} Über{i % 5}," for i in range(200)) + more
        ids = b"".join(i for _, i in packing.pieces_of(text.encode(), ids_of, 7))
        assert np.frombuffer(ids, "<u4").tolist() == [*ids_of.tokenizer.encode(text, add_special_tokens=False).ids, 0] and len(ids_of.pieces) <= 3


def test_ids_of_every_latin_character_and_of_odd_mixtures():
    ids_of, rng = packing.Ids(WORD_BPE), random.Random(9)
    assert ids_of.known
    letters = [chr(c) for c in range(1, 0x260)]
    texts = [f"{a}{b}" for a in letters for b in ("", "a", "1", "'s", " x")] + ["".join(rng.choices([*letters, *"aaabbee  ''sstt123.,\n", "'ll", "'VE", "\u0301", "Ж"], k=rng.randint(1, 30))) for _ in range(4000)]
    for text, want in zip(texts, ids_of.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids_of.of(text), "<u4").tolist() == want.ids, repr(text)


def test_op11_over_its_table(spark, data):
    rows = [(r.doc_id, r.text) for r in read(spark, data, "documents").collect()]
    found = queries.op11_best_fit_packing(spark, data).collect()
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found], key=str) == wanted_pieces(rows, 2048)
    assert gapless([(r.sequence_id, r.offset, r.length) for r in found], 2048) == best_fit([r.length for r in found], 2048)


# ---------------------------------------------------------------- 12


def damaged(rows):
    name = lambda v: " " if v is None else str(v)
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        out[conv] += []
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


_STEP = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
_ROLE = {"u": "user", "a": "assistant"}


def cheapest(turns, faults):
    """(cost, audit, repaired turns), tried edit by edit from the end, whatever the place of insertions."""
    n = len(turns)
    after = {}
    for i in range(n, -1, -1):
        here = {}
        for _ in range(4):  # insertions lead from one end to another at the same turn
            for last in ("", "s", "u", "a"):
                ways = [here[last]] if last in here else []
                if i == n and last in ("", "a"):
                    ways.append((0, "", ()))
                for z, name in _ROLE.items():
                    if (last, z) in _STEP and z in here:
                        cost, audit, rest = here[z]
                        ways.append((cost + 3, "I" + audit, ((name, ""), *rest)))
                if i < n:
                    _, role, text = turns[i]
                    if last in after:
                        cost, audit, rest = after[last]
                        ways.append((cost + 4, "D" + audit, rest))
                    if faults[i] not in ("blank", "duplicate"):
                        more = 3 * (faults[i] == "truncated")
                        for z, name, price, edit in [(role[:1], role, 0, "K"), *((z, name, 3, "R") for z, name in _ROLE.items())]:
                            if (last, z) in _STEP and z in after:
                                cost, audit, rest = after[z]
                                ways.append((cost + price + more, edit + audit, ((name, text), *rest)))
                if ways:
                    here[last] = min(ways)
        after = here
    return after[""]


def wanted_report(rows):
    out = {}
    for conv, turns in damaged(rows).items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        times = [t for t, _, _ in turns if t is not None]
        cost, audit, repaired = cheapest(turns, faults)
        out[conv] = (
            max(times) - min(times) + 1 - len(set(times)) if times else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        )
    return out


def reported(frame):
    found = frame.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}
    assert len(out) == len(found)
    return out


ROWS = "conv_id long, turn long, role string, text string"


def test_repair_of_odd_conversations(spark, monkeypatch):
    monkeypatch.setattr(repair, "FAN", 3)
    rng = random.Random(1)
    rows = []
    for conv in [None, *range(40)]:
        for i in range(rng.choice([1, 1, 3, 9, 20, 300])):
            rows.append((conv, rng.choice([None, i, i, i, 7]), rng.choice(["user", "assistant", "system", None, "", "tool", "a"]), rng.choice([None, "", "x.", "y", "z?! ", "\t\n", "u.", "same."])))
    frame = spark.createDataFrame([(*r, 5, "x") for r in rows], ROWS + ", copy int, digest string")
    assert reported(repair.report(frame, repair.damaged(frame))) == wanted_report(rows)
    none = frame.limit(0)
    assert reported(repair.report(none, repair.damaged(none))) == {}
    assert reported(repair.report(frame, repair.damaged(none)))[3] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_edits_of_a_sequence_in_parts_are_those_of_the_whole():
    rng = random.Random(2)
    for _ in range(300):
        signature = "".join(rng.choices("suaoSUAOx", k=rng.randint(0, 14)))
        cuts = sorted(rng.randint(0, len(signature)) for _ in range(2))
        parts = [signature[a:b] for a, b in zip([0, *cuts], [*cuts, len(signature)])]
        tables = [[repair.solve(p, q) for q in repair.STATES] for p in parts]
        joined = repair.join(repair.join(tables[0], tables[1]), tables[2])
        assert repair.whole(joined[0]) == repair.whole(repair.solve(signature, 0))


def test_repaired_turns_are_those_hashed(spark, data):
    conversations = read(spark, data, "conversations")
    turns = repair.damaged(conversations)
    texts = collections.defaultdict(list)
    for r in sorted(repair.repaired(turns).collect(), key=lambda r: (r.conv_id, r.position)):
        assert r.position == len(texts[r.conv_id])
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    want = wanted_report([(r.conv_id, r.turn, r.role, r.text) for r in conversations.collect()])
    got = reported(queries.op12_structure_repair(spark, data))
    assert got == want
    for conv, row in got.items():
        assert hashlib.sha256("\n".join(texts[conv]).encode()).hexdigest() == row[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(t[0] for t in texts[conv]))


# ---------------------------------------------------------------- 13


def test_whitening_against_numpy(spark, data):
    table = read(spark, data, "embeddings")
    rows = [(r.vec_id, r.embedding) for r in table.select("vec_id", "embedding").collect()]
    x = np.floor(1024 * np.array([v for _, v in rows], float)).astype(np.int64) + 100_000
    n, values = len(x), np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    deviation = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, x.sum(axis=0))) for (i, _), v in zip(rows, x)}
    found = queries.op13_whitening(spark, data).toPandas()
    assert len(found) == 8 * n and (found.n == n).all() and (found.identity_error < 1e-9).all()
    assert all(deviation[r.vec_id] == r.deviation for r in found.itertuples())
    assert np.allclose(found.groupby("component").explained.first().to_numpy(), values[:8] / values.sum(), rtol=1e-9)
    white = found.pivot(index="vec_id", columns="component", values="whitened").loc[[i for i, _ in rows]].to_numpy()
    assert np.allclose(np.cov(white.T, bias=True), np.eye(8), atol=1e-9)
    covariance = np.cov(x.T, bias=True)
    onto = (x - x.mean(axis=0)).T @ white / n  # covariance @ component / root of its eigenvalue
    assert np.allclose(covariance @ onto, onto * values[:8], rtol=1e-6, atol=1e-6 * abs(onto).max() * values[0])


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    kinds = "vec_id long, embedding array<double>, whitened string, x int"
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (2, [2.0, 4.0]), (None, [0.0, 7.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, []), (8, [1.0, 2.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame([(*r, "w", 1) for r in rows], kinds)).collect()
    assert collections.Counter(r.vec_id for r in got) == {1: 2, 2: 4, None: 2} and {r.n for r in got} == {4} and got[0].identity_error < 1e-9
    assert abs(sum(r.explained for r in got) / 4 - 1) < 1e-9
    same = spark.createDataFrame([(i, [0.5, 0.25], "", 1) for i in range(5)], kinds)
    assert whitening.whiten(same).collect() == [] and whitening.whiten(same.limit(0)).collect() == []
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], "", 1) for i in range(5)], kinds)).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-9
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0], "", 1), (2, [-1e300, 2.0], "", 1), (3, [1e9, 9.0], "", 1)], kinds)).collect()
    assert {r.n for r in huge} == {3} and huge[0].deviation is None
