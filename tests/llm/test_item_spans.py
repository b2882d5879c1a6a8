"""Items are looked for in spans of their own size, whatever the lengths of the others; whole results against a direct search."""

import random

import numpy as np

from pulsegrid.llm import decontaminate as D


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, text string")


def test_a_long_item_makes_no_check_lax(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(10**6)}"
    short, long = [word() for _ in range(14)], [word() for _ in range(4000)]
    scattered = [word() for _ in range(6300)]
    for n, at in enumerate(range(0, 14, 2)):
        scattered[n * 900 : n * 900 + 2] = short[at : at + 2]
    whole = [word() for _ in range(6300)]
    whole[3001:3015] = short
    docs = frame(spark, [(1, " ".join(scattered)), (2, " ".join(whole)), (3, " ".join([word(), *long, word()])), (4, " ".join(short))], "doc_id")
    for items in ([(7, " ".join(short))], [(7, " ".join(short)), (8, " ".join(long))]):
        got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, frame(spark, items, "item_id")).collect()}
        assert got == {(2, 7), (4, 7)} | ({(3, 8)} if len(items) > 1 else set())


def direct(docs, items, threshold=D.THRESHOLD, overlap=D.OVERLAP):
    """Every span of every document against every item, scored by the definition."""
    grams = {i: [str(x) for x in D._bigrams(t)] for i, t in items}
    n, mean = len(items), np.mean([len(g) for g in grams.values()])
    df = {}
    for g in grams.values():
        for t in set(g):
            df[t] = df.get(t, 0) + 1
    idf = {t: np.log(1 + (n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    out = {}
    for d, text in docs:
        have, words = [str(x) for x in D._bigrams(text)], [str(x) for x in D._words(text)]
        for i, t in items:
            g = grams[i]
            adds = {x: idf[x] * g.count(x) * (D.K1 + 1) / (g.count(x) + D.K1 * (1 - D.B + D.B * len(g) / mean)) for x in set(g)}
            q, r = ([str(x) for x in set(D._bigrams(p).tolist())] for p in D.split_item(t))
            span = max(D.PASSAGE, 2 * (len(g) + 1))
            for first in range(0, len(have), span // 2):
                seen = set(have[first : first + span])
                near = set(words[first : first + span + 1])  # for a part of one word
                score = sum(v for x, v in adds.items() if x in seen) / sum(adds.values())
                parts = [np.mean([x in (seen if len(p) > 1 or len(part.split()) > 1 else near) for x in p]) for p, part in zip((q, r), D.split_item(t))]
                if score >= threshold - 1e-9 and min(parts) >= overlap:
                    rank = (-round(score, 9), first)
                    out[d, i] = min(out.get((d, i), rank), rank)
    return out


def test_whole_results_are_those_of_a_direct_search(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([4, 9, 15, 40, 200])))) for i in range(25)]
    docs = []
    for d in range(110):
        text = [word() for _ in range(rng.randint(3, 700))]
        for _ in range(rng.randint(0, 3)):
            piece = rng.choice(items)[1].split()
            at = rng.randrange(len(text))
            text[at:at] = piece[: rng.choice([len(piece), 2 * len(piece) // 3])]
        docs.append((d, " ".join(text)))
    got = {(r.doc_id, r.item_id): (-round(r.score, 9), r.first_word) for r in D.contaminated(frame(spark, docs, "doc_id"), frame(spark, items, "item_id")).collect()}
    want = direct(docs, items)
    assert len(want) > 30 and got == want
