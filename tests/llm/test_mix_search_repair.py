"""Mixing, ranked search and conversation repair against plain versions of what they must return."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from check import difference, oracle
from curbside.llm import lexical, mixing, repair

SCHEMA = "doc_id bigint, text string, source string, size string, start string, words string, term string, unnamed string, `range` string"
BLANKS = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    """`rows` (doc_id, text, source) with further columns named as the operators name theirs."""
    return spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_levels(sizes, weights, repeats, budget):
    """Targets by sharing what is above again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, full, left = dict.fromkeys(sizes, 0.0), set(), min(budget, repeats * sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        rest = left - sum(repeats * sizes[s] for s in full)
        for s in open_:
            target[s] = rest * weight[s] / sum(weight[o] for o in open_)
        above = {s for s in open_ if target[s] > repeats * sizes[s] + 1e-9}
        if not above:
            return {s: repeats * sizes[s] if s in full else target[s] for s in order}
        full |= above


ROWS = [
    *[(i, "w " * (i % 7), "a") for i in range(40)], (100, "long " * 900, "b"), (101, "one", "b"), (102, None, "b"), (103, "", None),
    (104, "two words", None), (104, "two words", None), (105, "x y z", ""), (None, "no id", "é"), (None, "no id", "é"), (106, " \t\n", "empty"),
]


@pytest.mark.parametrize("budget", [None, 500, 10**6])
def test_mix(spark, budget):
    docs = frame(spark, ROWS)
    queues = mixing.shuffled_queues(docs, (5, 2, 1), 3, budget)
    mix = mixing.fair_mix(queues, budget).orderBy("position").collect()
    rows = mixing.mix_sources(docs, budget=budget).collect()
    assert len(rows) == len(ROWS)
    assert collections.Counter((r.doc_id, r.size, r.source) for r in rows) == collections.Counter((d, size_of(t), s) for d, t, s in ROWS)
    sizes = collections.Counter()
    for _, text, source in ROWS:
        sizes[source] += size_of(text)
    want = water_levels(sizes, (5, 2, 1), 3, sum(sizes.values()) if budget is None else budget)
    taken = collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert want[source] - 1.001 <= taken[source] <= want[source] + 1e-6
    at, before = 0, 0.0
    for r in mix:  # gapless, in order of the virtual clock
        assert r.position == at and r.finish >= before
        at, before = at + r.words, r.finish
    assert at == sum(taken.values())
    again = mixing.mix_sources(docs.repartition(5), budget=budget).collect()
    assert collections.Counter(map(tuple, rows)) == collections.Counter(map(tuple, again))


def test_mix_of_nothing(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    only = mixing.mix_sources(frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in only) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    """[(item, rank, doc_id, score)] by scoring every document."""
    counted = [(i, collections.Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, length = len(counted), sum(x for _, _, x in counted)
    df = collections.Counter(t for _, c, _ in counted for t in c)
    asked = collections.defaultdict(set)
    for i, text in items:
        asked[i] |= set(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, c, size in counted:
            m = 10 + 90 * size * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in wanted if t in c
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -score) for r, (score, none, doc) in enumerate(sorted(scored)[:k])]
    return out


def prose(rng, most):
    return " ".join(f"{rng.choice('abcdefgh')}{int(rng.paretovariate(0.7)) % 40}" for _ in range(rng.randrange(1, most)))


def test_terms_of_odd_texts():
    texts = ["", None, "A-b_C\x00d\x7fE[f]", "Ünï ÇÖDE 日本語 ﬁ🤖x", "  ", "x" * 70_000 + "!", "İstanbul ẞ 9a9"]
    for array in (pa.array(texts), pa.array(["cut", *texts, "cut"]).slice(1, len(texts))):
        at, found = lexical.split_terms(array)
        assert [[x.decode() for x in found[a:b].to_pylist()] for a, b in zip(at, at[1:])] == [terms(t) for t in texts]


@pytest.mark.parametrize("seed", range(3))
def test_block_max_search(monkeypatch, seed):
    """Small blocks and steps, so that bounds decide often; many ties, and bytes of every width."""
    monkeypatch.setattr(lexical, "BLOCK", 4)
    monkeypatch.setattr(lexical, "STEP", 16)
    rng = random.Random(seed)
    docs = [(i // 2 if i % 5 else None, prose(rng, 60)) for i in range(400)] + [(900, "a1 " * 70_000), (901, "a1 " * 300), (902, "")]
    rng.shuffle(docs)
    shards = [docs[:150], docs[150:160], docs[160:]]
    made = [lexical._shard(n, [(pa.array([i for i, _ in s], pa.int64()), *lexical.split_terms(pa.array([t for _, t in s])))]) for n, s in enumerate(shards)]
    rows = [r for b in made for r in b.to_pylist()]
    n = sum(r["n_docs"] or 0 for r in rows)
    length = sum(r["n_terms"] or 0 for r in rows)
    df = collections.Counter()
    for r in rows:
        df[r["term"]] += r["df"]
    items = [(k, prose(rng, 25)) for k in range(30)] + [(99, "a1"), (98, "never")]
    weights = {i: {t.encode(): math.floor(1000 * math.log((2 * n + 2) / (2 * df[t.encode()] + 1))) for t in set(terms(x))} for i, x in items}
    engine = lexical.Search(weights, n, length, 10)
    for number in range(len(shards)):
        mine = [r for r in rows if r["shard"] == number]
        engine.shard({r["term"]: r for r in mine if r["term"] is not None}, next(r["payload"] for r in mine if r["term"] is None))
    found = collections.defaultdict(list)
    for r in engine.found().to_pylist():
        found[r["item"]].append((-r["score"], r["doc_id"] is None, r["doc_id"] or 0))
    want = collections.defaultdict(list)
    for item, _, doc, score in ranked(docs, items):
        want[item].append((-score, doc is None, doc or 0))
    assert {i: sorted(x) for i, x in found.items() if x} == dict(want)


def test_ranked_search(spark):
    rng = random.Random(5)
    docs = [(i, prose(rng, 40), "s") for i in range(300)]
    docs += [(7, "twin a1 b1", "s"), (7, "twin a1 b1", "s"), (None, "twin a1 b1", "s"), (400, None, "s"), (401, "", "s"), (402, "a1 " * 40_000, "s"), (403, "—!?", "s")]
    items = [(1, "A1, b1; TWIN"), (1, "c1"), (2, None), (3, "..."), (4, prose(rng, 30)), (4, prose(rng, 30)), (None, "twin")]
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, term string")
    got = lexical.rank_documents(frame(spark, docs).repartition(4), asked).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(ranked([(i, t) for i, t, _ in docs], items), key=key)
    assert lexical.rank_documents(frame(spark, []), asked).count() == 0
    assert lexical.rank_documents(frame(spark, docs), asked.limit(0)).count() == 0


def plain_edits(signs):
    """(cost, audit) of the cheapest edits of whole `signs`, by a table over all ways."""
    fits, following, legal = "s?(ua)+", {"": "u", "s": "u", "u": "a", "a": "u"}, {("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")}
    best = {"": (0, "")}

    def inserted(ways):
        out = {}
        for state, (cost, audit) in ways.items():
            for _ in range(3):
                out[state] = min(out.get(state, (9**9, "")), (cost, audit))
                cost, audit, state = cost + 2, audit + "I", following[state]
        return out

    for sign in signs:
        after = {}
        for state, (cost, audit) in inserted(best).items():
            ways = [(state, cost + 3, "D")]
            if sign != "-":
                cut = int(sign.isupper())
                ways.append((following[state], cost + 2 + cut, "R"))
                if (sign.lower(), state) in legal:
                    ways.append((sign.lower(), cost + cut, "K"))
            for end, c, e in ways:
                after[end] = min(after.get(end, (9**9, "")), (c, audit + e))
        best = after
    assert fits
    return min(x for s, x in inserted(best).items() if s in ("", "a"))


def test_edits_of_all_short_conversations():
    for size in range(5):
        for signs in itertools.product("suaxSUAX-", repeat=size):
            signs = "".join(signs)
            ways = repair.cheapest_edits(signs, repair.NOTHING)
            ends = [(c + 2 * len(repair.TRAIL[s]), a + repair.TRAIL[s]) for s, (c, a) in ways.items()]
            assert min(ends) == plain_edits(signs), signs


def plain_repair(rows):
    """The report of each conversation from rows (conv_id, turn, role, text, copies)."""
    conversations = collections.defaultdict(list)
    for conv, turn, role, text, copies in rows:
        role, text = " " if role is None else role, " " if text is None else text
        place = (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest())
        conversations[conv] += [(place, turn, role, text)] * copies
    out = []
    for conv, turns in conversations.items():
        turns.sort(key=lambda x: x[0])
        seen, signs, counts = set(), "", collections.Counter()
        for _, _, role, text in turns:
            end = text.strip(BLANKS)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            sign = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signs += "-" if fault in ("blank", "duplicate") else sign.upper() if fault else sign
        roles = [r[:1] for _, _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        numbers = {t for _, t, _, _ in turns if t is not None}
        cost, audit = plain_edits(signs)
        lines, at, last = [], 0, ""
        for edit in audit:
            name = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if edit == "I":
                lines.append(f"{name}:")
            else:
                _, _, role, text = turns[at]
                at += 1
                if edit == "D":
                    continue
                lines.append(f"{role if edit == 'K' else name}:{text}")
            last = lines[-1][0]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, digest))
    return out


def test_repair(spark):
    rng = random.Random(3)
    texts = ["Fine.", "Really?", "cut", "", " \n", None, "Ünï 日本!", "again.", "x" * 50_000, "done. \t"]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant"]
    rows = [
        (conv if conv else None, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts), rng.choice([0, 1, 1, 1, 2]))
        for conv in range(60) for _ in range(rng.randrange(9))
    ]
    rows += [(500, t, rng.choice(roles), rng.choice(texts[:3]) + str(t % 170), 1) for t in range(700)]  # many chunks, and pieces
    rows += [(501, None, "user", "same.", 150), (502, 1, "user", "Hi.", 0), (503, -5, "system", "Be kind.", 1), (503, 10**12, "user", "Yes.", 1)]
    turns = spark.createDataFrame(
        [(*r, "x", True, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, copies bigint, digest string, nameless boolean, segment string"
    )
    got = repair.repair_conversations(turns.repartition(5)).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got), key=key) == sorted(plain_repair(rows), key=key)
    ranged, plan = repair.plan_repairs(turns)
    assert plan.where("segment >= 0 and conv_id = 500").count() >= 1
    assert repair.repair_conversations(turns.limit(0)).count() == 0


def test_pieces_of_one_conversation(spark):
    """One conversation over all ranges, so that pieces meet."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", "b", "c?"]) + str(t % 400), 1) for t in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, copies bigint")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranged, plan = repair.plan_repairs(turns)
        assert plan.where("segment >= 0").count() > 3
        assert [tuple(r) for r in repair.repair_conversations(turns).collect()] == plain_repair(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B! c?") for c in range(40) for t in range(3)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want.append((c, t, "user" if kind == 4 else role, text, 0 if kind == 0 else 2 if kind == 3 else 1))
    assert {x[4] for x in want} == {0, 1, 2}
    assert [tuple(r) for r in repair.damage(turns).collect()] == want


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op4_embedding_dedup", "op7_pii", "op11_mixing", "op12_lexical_search", "op13_conversation_repair"])
def test_query_gives_the_rows_of_its_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    assert difference(entry.queries()[name](spark, sf_dir).toPandas(), oracle(sf_dir, entry.oracle_sql()[name])) is None
