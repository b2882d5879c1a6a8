"""Cases in which an operator once did less than its whole job."""

import re

import numpy as np
from test_operators import benchmark, frame, mixture_rows

from pulsegrid.llm import chat, decontaminate, mixing, pii, toxicity

# ------------------------------------------------------------------ 3


def test_secrets_in_quotes(spark):
    texts = {
        'password = "hunter2abc" and more': "hunter2abc",
        "api_key='Zx81kLmnop', next": "Zx81kLmnop",
        '{"user": 1, "password": "S3cr3tPw"}': "S3cr3tPw",
        '{"token": "ab\\"c, d;e"} "x"': 'ab\\"c, d;e',
        "pwd: 'two words' isn't": "two words",
        'secret="unclosed9 and more': "unclosed9",
        "password=plain=9": "plain=9",
        'token = "' + "0f" * 20 + '"': "0f" * 20,
        "sum " + "AB12" * 8 + " end": "AB12" * 8,
        "long " + "0a1b" * 32 + " end": "0a1b" * 32,
    }
    rows = pii.surrogates(frame(spark, list(enumerate(texts))), "k").orderBy("doc_id").collect()
    for r, (text, value) in zip(rows, texts.items()):
        before, after = text.split(value)
        assert len(r["entities"]) == 1 and value not in r["text"], text
        assert r["text"].startswith(before) and r["text"].endswith(after) and len(r["text"]) == len(text), r["text"]
    assert rows[7]["entities"][0]["k"] == "key"  # a key in quotes and one without are the same entity
    same = pii.surrogates(frame(spark, [(1, 'password="abcd12345" password=abcd12345'), (2, 'password = ""\ntoken: \'abc\'')]), "k").orderBy("doc_id").collect()
    assert len({e["s"].replace('"', "") for e in same[0]["entities"]}) == 1 and same[1]["entities"] == []



def test_distinct_stays_distinct(spark):
    given = ["John", "Peter", "Paul", "Mark", "Luke", "Simon", "Otto", "Max", "Tim", "Tom", "Jan", "Rolf", "Kurt", "Fritz", "Hans", "Georg", "Anton", "Bernd", "Claus", "Dirk"]
    people = [f"{t} {g} {s}" for t in ("Mr", "Frau", "Dr") for g in given for s in ("Smith", "Meier", "Li")]
    addresses = [f"192.168.{a}.{b}" for a in range(0, 256, 5) for b in range(256)] + [f"{a}.9.8.7" for a in range(256)] + [f"172.{a}.1.1" for a in range(256)] + [f"192.{a}.1.1" for a in range(256)]
    addresses = list(dict.fromkeys(addresses))
    mails = [f"u{i}@{d}.example.{t}" for i in range(40) for d in ("aa", "ab", "b-c") for t in ("org", "com")]
    cards = [f"4{i:015d}" for i in range(0, 9000, 7)]
    phones = [f"+{c} 555-{i:04d}" for c in (1, 2, 49) for i in range(0, 10000, 97)] + ["(212) 555-0101", "(312) 555-0101"]
    texts = [(i, "; ".join(x)) for i, x in enumerate((people, people[::-1], ["Mr. Smith", "MR. SMITH", "Mr SMITH", "Mr JOHN SMITH"], *(addresses[a : a + 3000] for a in range(0, len(addresses), 3000)), mails, cards, phones))]
    found = {}
    for r in pii.surrogates(frame(spark, texts), "k").collect():
        for e in r["entities"]:
            assert found.setdefault((e["k"], e["e"]), e["s"]) == e["s"] != e["e"]
    of = lambda k: {e: s for (x, e), s in found.items() if x == k}
    names = of("person")
    full = [names[p] for p in people]
    assert len(set(full)) == len(people)
    assert names["MR. SMITH"] == names["Mr. Smith"].upper() and names["Mr JOHN SMITH"] == "Mr" + names["Mr John Smith"].upper()[2:]
    assert len({names[p].split()[-1] for p in people if p.endswith("Smith")} | {names["Mr. Smith"].split()[-1]}) == 1
    assert all(names[p].split()[0] == p.split()[0] and names[p].split()[1].split("-")[0] in pii.GIVEN[g, "latin"] for p in people for g in [{"Mr": "m", "Frau": "f", "Dr": "n"}[p.split()[0]]])
    ips = of("ip")
    assert set(ips) == set(addresses) and len(set(ips.values())) == len(addresses)
    special = lambda a: re.match(r"(10|127|192\.168|172\.(1[6-9]|2\d|3[01]))\.", a) is not None
    assert all(special(a) == special(s) and all(int(o) < 256 for o in s.split(".")) for a, s in ips.items())
    assert len(set(of("email").values())) == len(mails) and len({s.split("@")[1] for s in of("email").values()}) == 6
    assert len(set(of("card").values())) == len(cards)
    valid = lambda c: (sum(map(int, c[::-2])) + sum(int(x) * 2 - 9 * (int(x) > 4) for x in c[-2::-2])) % 10 == 0
    assert all(valid(c) == valid(s) and s[0] == "4" for c, s in of("card").items())
    assert len({re.sub(r"\D", "", s) for s in of("phone").values()}) == len({re.sub(r"\D", "", p) for p in of("phone")}) == len(phones)


def test_a_permutation_is_one(spark):
    from pyspark.sql import functions as F

    values = [f"{i:03d}" for i in range(1000)]
    places = F.array(F.struct(pii._places(F.col("text"), pii._sets(pii.DIGITS), F.lit(1), F.lit(3)).alias("places"), F.lit("t").alias("tweak")))
    rows = pii.permuted(frame(spark, list(enumerate(values))).withColumn("x", places), "x", "k").select("text", pii._text(F.col("x")[0]).alias("s")).collect()
    assert sorted(r["s"] for r in rows) == values and all(r["s"] != r["text"] for r in rows)


# ------------------------------------------------------------------ 6


def test_mixing_counts_labels_of_documents_that_are_there(spark):
    rows = mixture_rows(spark)
    marks = frame(spark, [(d, k) for d, k, _ in rows], "doc_id long, domain string")
    some = [r for r in rows if r[1] != "c" or r[0] % 100 == 9]  # 9 of 90 labelled rows of c are left
    docs = frame(spark, [(d, t) for d, _, t in some])
    here = frame(spark, [(d, k) for d, k, _ in some], "doc_id long, domain string")
    for most in (3000, 60):  # 60: labels of absent documents take no place in the sample
        got, want = (mixing.fit_domains(docs, m, ["a", "b", "c"], per_class=most) for m in (marks, here))
        assert (got.hashes == want.hashes).all() and np.allclose(got.weights, want.weights) and np.allclose(got.bias, want.bias)


def test_mixing_stage_without_the_labelled_rows_of_a_domain(spark, data):
    import corpus_pipeline
    from pulsegrid.llm.common import read

    junk = mixing.label_domains(read(spark, data, "labels")).where("domain = 'junk'")
    docs = read(spark, data, "documents").join(junk, "doc_id", "left_anti")
    out = corpus_pipeline.mixture(spark, docs, data)
    assert out.count() == docs.count() and out.where("rate is null or rate < 0").count() == 0
    assert out.where("domain = 'junk'").count() == 0  # nothing tells of junk, so nothing is lifted to it


# ------------------------------------------------------------------ 7


def test_levels_of_long_chains_and_of_references_that_meet(spark):
    turns = [(1, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(800)]
    calls, results = chat.dialogue_calls(frame(spark, turns, "conv_id long, turn long, role string, text string"))
    got = {r["turn"]: (r["level"], r["status"]) for r in chat.link_calls(calls, results, {"respond": chat.RESPOND}).collect()}
    assert got == {t: (t // 2, "ok") for t in range(0, 800, 2)}
    # two references each, to the last and the one three before; behind a ring of three nothing has a level
    needs = {i: {i - 1, i - 3} & set(range(12)) for i in range(12)} | {20: {22}, 21: {20}, 22: {21}, 23: {22, 5}, 24: {23}}
    edges = frame(spark, [(1, str(a), str(b)) for a, bs in needs.items() for b in bs], "conv_id long, call_id string, needs string")
    nodes = frame(spark, [(1, a, str(a)) for a in needs], "conv_id long, turn long, call_id string")
    assert {r["turn"]: r["level"] for r in chat.order_calls(nodes, edges).collect()} == {i: i if i < 12 else None for i in needs}


def test_calls_against_brute_force(spark):
    import json
    import random

    rng = random.Random(11)
    calls, results = [], []
    for conv in range(40):
        n = rng.randint(1, 12)
        for i in range(n):
            needs = [f"c{rng.randrange(i)}" for _ in range(rng.randint(0, 2)) if i] + ([f"c{rng.randrange(n)}"] if rng.random() < 0.1 else []) + (["gone"] if rng.random() < 0.05 else [])
            value = {"text": "x" if rng.random() < 0.9 else 5, "after": [{"$ref": r} for r in needs]}
            calls.append((conv, i, f"c{i}", "respond" if rng.random() < 0.95 else "other", json.dumps(value) if rng.random() < 0.97 else "{broken"))
            results += [(conv, 100 + i + j, f"c{i}", f"r{j}") for j in range(rng.choice([0, 1, 1, 2]))]
    schema = {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}}}
    got = {(r["conv_id"], r["call_id"]): (r["level"], r["status"], r["n_results"], json.loads(r["message"]).get("result")) for r in chat.link_calls(
        frame(spark, calls, "conv_id long, turn long, call_id string, name string, arguments string"), frame(spark, results, "conv_id long, turn long, call_id string, content string"), {"respond": schema}).collect()}
    want = {}
    for conv in range(40):
        own = {c[2]: c for c in calls if c[0] == conv}
        refs, bad = {}, {}
        for k, (_, _, _, name, text) in own.items():
            value = None if text == "{broken" else json.loads(text)
            refs[k] = {r["$ref"] for r in value["after"]} if value else set()
            bad[k] = value is None or name == "other" or not isinstance(value["text"], str)
        level = {}
        while True:
            new = {k: max([level[r] + 1 for r in refs[k] if r in own], default=0) for k in own if k not in level and all(r in level for r in refs[k] if r in own)}
            if not new:
                break
            level |= new
        for k in own:
            found = sorted((t, c) for v, t, i, c in results if v == conv and i == k)
            status = "invalid" if bad[k] else "unresolved" if refs[k] - set(own) else "cyclic" if k not in level else "ok" if found else "unanswered"
            want[conv, k] = (level.get(k), status, len(found), found[0][1] if found else None)
    assert got == want and {v[1] for v in want.values()} == {"ok", "unanswered", "invalid", "unresolved", "cyclic"}


def test_no_arguments_end_the_job(spark):
    odd = ["9" * 400, "9" * 5000, "[" * 100_000, '{"a":' * 600 + "1" + "}" * 600, '{"text": "\\ud800"}', '{"\\ud800": {"$ref": "\\udfff"}}', "1e400", "NaN", "", "null", '{"text": 1.0}']
    rows = [(1, i, str(i), "t", a) for i, a in enumerate(odd)]
    none = frame(spark, [], "conv_id long, turn long, call_id string, content string")
    schema = {"properties": {"text": {"type": ["integer", "string"], "minimum": 1, "exclusiveMaximum": 2, "pattern": ""}}, "anyOf": [{"type": "integer"}, {"type": "object"}]}
    got = {int(r["call_id"]): (r["status"], r["error"]) for r in chat.link_calls(frame(spark, rows, "conv_id long, turn long, call_id string, name string, arguments string"), none, {"t": schema}).collect()}
    assert len(got) == len(odd) and got[0] == got[8] == got[10] == ("unanswered", None) and got[1][1] == "arguments are not JSON" and got[9][1] == "$: none of anyOf"
    try:
        chat.link_calls(frame(spark, rows, "conv_id long, turn long, call_id string, name string, arguments string"), none, {"t": {"type": "float"}})
        raise AssertionError("an unknown type passed")
    except ValueError:
        pass


# ------------------------------------------------------------------ 2


def test_answers_of_one_word(spark):
    items = frame(spark, [(1, "Which city is the capital of France? Answer: Paris"), (2, "red green blue")], "item_id long, text string")
    docs = [(1, "so which city is the capital of France? answer: Paris, of course"), (2, "so which city is the capital of France? answer: London"), (3, "the red green blue flag")]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, docs), items).collect()} == {(1, 1), (3, 2)}


def test_blocks_score_as_one_index_does(spark):
    _, table = benchmark(spark)
    (one,) = decontaminate.index_blocks(table)
    weights = lambda x: {(x.ids[k], t): c for t, (ks, part, _) in zip(x.terms.tolist(), x.postings) for k, c in zip(ks.tolist(), part.tolist())}
    parts, longest = {}, set()
    for x in decontaminate.index_blocks(table, chars=6000):
        parts |= weights(x)
        longest.add(x.longest)
    want = weights(one)
    assert longest == {one.longest} and parts.keys() == want.keys() and all(abs(parts[k] - want[k]) < 1e-12 for k in want)


# ------------------------------------------------------------------ 6 and 9 against other ways to the same optimum


def test_rates_are_the_least_squares_solution(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.4, 0.4], 40)
    w, pull = rng.integers(1, 200, 40).astype(float), 1e-2
    goal = np.array([0.7, 0.2, 0.1])
    share, scale = w / w.sum(), (w @ p) / w.sum()
    cost = lambda r: 0.5 * ((((r * share) @ p - goal) ** 2) / scale).sum() + 0.5 * pull * (share * (r - 1) ** 2).sum()
    best = np.ones(40)
    for _ in range(3000):  # exact steps along one rate at a time
        for i in range(40):
            off = ((best * share) @ p - goal) / scale
            slope = share[i] * (p[i] @ off + pull * (best[i] - 1))
            best[i] = max(0.0, best[i] - slope / (share[i] ** 2 * (p[i] ** 2 / scale).sum() + share[i] * pull))
    members = spark.createDataFrame([(int(n), list(map(float, x))) for n, x in zip(w, p)], "n_tokens long, posteriors array<double>")
    misses = mixing.fit_rates(members, goal.tolist(), pull, rounds=400, miss=0)
    rates = mixing._rates(p, misses, pull)[0]
    assert (rates >= 0).all() and abs(cost(rates) - cost(best)) < 1e-8 and np.abs(rates - best).max() < 1e-3


def test_ordinal_fit_is_near_a_dense_optimum():
    rng = np.random.default_rng(6)
    has = rng.random((160, 4)) < 0.4
    grades = np.clip(np.searchsorted([0.2, 1.4, 2.6], has @ np.array([2.0, 1.0, -1.0, 0.0]) + rng.logistic(0, 0.5, 160)), 0, 3)
    starts, places = np.concatenate(([0], np.cumsum(has.sum(axis=1)))), np.nonzero(has)[1]
    weight = 1 / np.bincount(grades, minlength=4)[grades]
    weight /= weight.sum()

    def cost(x):
        cuts = x[4] + np.concatenate(([0.0], np.cumsum(np.exp(x[5:7]))))
        above = 1 / (1 + np.exp(cuts[None, :] - (has @ x[:4])[:, None]))
        full = np.concatenate((np.ones((160, 1)), above, np.zeros((160, 1))), axis=1)
        own = full[np.arange(160), grades] - full[np.arange(160), grades + 1]
        return -(weight * np.log(np.maximum(own, 1e-12))).sum() + 0.5 * toxicity.PENALTY * (x[:4] ** 2).sum()

    x, eye = np.array([0.0, 0, 0, 0, 0.5, 0, 0]), np.eye(7) * 1e-5
    for _ in range(3000):
        x = x - 0.5 * np.array([(cost(x + e) - cost(x - e)) / 2e-5 for e in eye])
    w, cuts = toxicity.fit_ordinal(grades, starts, places, 4, 4)
    assert (np.diff(cuts) > 0).all()
    fitted = cost(np.concatenate((w, cuts[:1], np.log(np.diff(cuts)))))
    assert cost(x) - 1e-6 <= fitted < cost(x) + 5e-3 and np.corrcoef(w, x[:4])[0, 1] > 0.99
