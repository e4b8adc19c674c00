"""Operators against plain versions of what they compute."""

import heapq
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomwork.llm import _shared, _trie, audio, flat_graph, language_id, line_chunks, lsh_forest, mixing, packing, pitman_yor, token_counts, toxicity

VOCABULARY = [f"{a}{b}{c}" for a in ("ba", "do", "ki", "lu") for b in ("men", "rat", "sol", "tig") for c in ("a", "en", "or", "us")]


def prose(rng, n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", "", ".", ","]) for _ in range(n))


class Sets:
    def __init__(self, items):
        self.parent = {x: x for x in items}

    def root(self, x):
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.parent[b] = a


def test_components(spark):
    rng = random.Random(1)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(k, k + 1) for k in range(500, 560)] + [(900, 900 + k) for k in range(40)]
    plain = Sets({x for p in e for x in p})
    for a, b in e:
        plain.join(a, b)
    d = spark.createDataFrame([*e, (None, 3), (4, 4)], "a long, b long")
    want = {x: plain.root(x) for p in e if p[0] != p[1] for x in p}
    for few in (0, 100_000):
        assert {r["id"]: r["component"] for r in _shared.components(d, few).collect()} == want


def test_near_duplicates(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(25):
        base = prose(rng, rng.randrange(30, 160)).split()
        for _ in range(rng.randrange(1, 7)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
            texts.append(" ".join(w))
    base = prose(rng, 120).split()  # a dense group
    texts += [" ".join(w if rng.random() > 0.01 else rng.choice(VOCABULARY) for w in base) for _ in range(120)]
    texts += ["one two", "One  TWO", "", "alone"]
    sets = {}
    for i, t in enumerate(texts):
        w = t.lower().split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    plain = Sets(sets)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 85 * len(sets[a] | sets[b]):
            plain.join(a, b)
    got = lsh_forest.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {i: (len(s), plain.root(i), plain.root(i) == i) for i, s in sets.items()}


def test_no_link_of_a_dense_region_is_lost(spark):
    """Documents of one template (0.75 alike), each with one partner just over the threshold, in regions of many blocks."""
    rng, n = random.Random(21), 1000
    template = [f"w{rng.randrange(10**6)}" for _ in range(200)]

    def changed(words, k):
        words = list(words)
        for at in rng.sample(range(2, 198), k):
            words[at] = f"x{rng.randrange(10**9)}"
        return words

    rows = []
    for i in range(n // 2):
        a = changed(template, 3)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(changed(a, 3)))]
    sets = {i: lsh_forest.shingle_hashes(t, {}) for i, t in rows}
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b]))
    linked = [i for i in range(0, n, 2) if alike(i, i + 1) >= 0.85]
    got = {r["doc_id"]: r["component_id"] for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_rows=64).collect()}
    assert len(linked) > 50 and all(got[i] == got[i + 1] for i in linked)


def test_pipeline_links_from_four_fifths(spark):
    """Pairs of a similarity from 0.80 to 0.85: the near dedup stage keeps the first, the query op1 both."""
    rng, rows = random.Random(12), []
    for i in range(30):
        base = rng.choices(VOCABULARY, k=100)
        other = list(base)
        for at in (20, 60):  # ten of 96 shingles differ on each side: 86 / 106
            other[at] = f"new{i}x{at}"
        rows += [(2 * i, " ".join(base), "en", "s", 1), (2 * i + 1, " ".join(other), "en", "s", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, d, None).collect()) == list(range(0, 60, 2))
    assert lsh_forest.keep_one(d).count() == 60


def test_toxicity_held_out(spark):
    rng, bad = random.Random(3), ["nasgor", "nasgoren", "plofta", "ploftin"]
    rows = []
    for i in range(1500):
        w = prose(rng, rng.randrange(5, 120)).split()
        toxic = rng.random() < 0.15
        for _ in range(rng.randrange(1, 6) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(w), int(toxic)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d, d.where("doc_id < 1000").withColumn("toxic", F.when(F.hash("doc_id") % 20 == 0, 1).otherwise(F.col("toxic"))).select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    assert all(got[i]["rejected"] == bool(t) for i, _, t in rows if i >= 1000)
    assert list(model.thresholds) == sorted(model.thresholds)
    assert all(0 <= r["severity"] <= 2 and abs(r["severity"] - model.above([t])[0].sum()) < 1e-9 for (i, t, _), r in ((x, got[x[0]]) for x in rows[:50]))


def test_bucket_boundaries():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = rng.integers(1, 9)
        x, c, k = np.sort(rng.choice(40, n, replace=False) + 1), rng.integers(1, 9, n), rng.integers(1, 5)
        cost = lambda e: sum(m * (min(b for b in e if b >= v) - v) for v, m in zip(x, c, strict=True))  # noqa: B023, E731
        best = min(cost([*s, x[-1]]) for r in range(k) for s in itertools.combinations(x[:-1], min(r, n - 1)))
        edges = packing.boundaries(x, c, k)
        assert len(edges) <= k and cost(edges) == best


def test_batches(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 3, 10, 40, 90, 250]) + rng.randrange(5) for _ in range(400)]
    d = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate(sizes)], "doc_id long, text string")
    got = packing.pack(d, n_buckets=4, max_len=100, budget=400, rows_per_shard=60).collect()
    per = defaultdict(list)
    for r in got:
        per[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
        assert r["bucket_len"] is None if r["n_tokens"] == 0 else r["bucket_len"] >= r["n_tokens"]
    assert all(sum(n for _, n in per[i]) == n and [a for a, _ in sorted(per[i])] == list(range(0, max(n, 1), 100)) for i, n in enumerate(sizes))
    slots = Counter((r["bucket_len"], r["batch_id"]) for r in got if r["n_tokens"])
    assert len({(r["bucket_len"], r["batch_id"], r["slot"]) for r in got if r["n_tokens"]}) == sum(slots.values())
    for length in {b for b, _ in slots}:
        full = [n for (b, k), n in sorted(slots.items()) if b == length]
        assert all(n == max(1, 400 // length) for n in full[:-1]) and full[-1] <= max(1, 400 // length)
    lengths = Counter(n for p in per.values() for _, n in p if n)
    assert sorted({r["bucket_len"] for r in got} - {None}) == packing.boundaries(sorted(lengths), [lengths[k] for k in sorted(lengths)], 4)


def test_language_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in pitman_yor.score_texts(docs, block_chars=50_000, part_chars=60_000).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b""] for r in docs.collect()}
    count = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(count.values()), len(count)
    for i, t in texts.items():
        r, base = got[i], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(w in count for w in t), n, zlib.crc32(str(i).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    again = {r["doc_id"]: r["score"] for r in pitman_yor.score_texts(docs, block_chars=50_000, part_chars=60_000).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_language_model_is_the_same_in_parts(spark):
    """Scores don't lean to one side with a word a part, where one word has a third of all tokens; another seed moves the mean by some 1e-4."""
    rng = random.Random(15)
    words, weights = [f"w{k}" for k in range(300)], [1 / (k + 2) for k in range(300)]
    rows = [(i, " ".join("the" if rng.random() < 0.35 else w for w in rng.choices(words, weights, k=40))) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string").cache()
    one, many = ({r["doc_id"]: r["score"] / r["n_tokens"] for r in pitman_yor.score_texts(d, part_chars=n).collect()} for n in (10**9, 100))
    assert abs(sum(many[i] - one[i] for i in one) / len(one)) < 0.002


def test_language_model_is_normalised(spark):
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][:30]
    held = [i for i in range(100, 900) if zlib.crc32(str(i).encode()) % 10 == 0]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(VOCABULARY[:12], k=8))) for i in train]
    known = sorted({w for _, t in rows for w in t.split()})
    rows += list(zip(held, ["", *known, "unseen"], strict=False))
    part = pitman_yor.Block([t for _, t in rows], 0, 1)
    # of all words that may follow the beginning, chances sum to one: the known ones, the end and one for all unseen words
    frame = pd.DataFrame([(0, 0, len(part.hashes), len(part.pairs), pitman_yor._pack(
        part.hashes, np.bincount(part.pairs >> pitman_yor.G_BITS, minlength=len(part.hashes)).astype(np.uint32), (part.pairs & (1 << pitman_yor.G_BITS) - 1).astype(np.uint32),
        np.bincount(part.pair_of, np.repeat([float(i in train) for i, _ in rows], part.lengths), len(part.pairs)).astype(np.uint32)))], columns=["block", "part", "n", "m", "blob"])
    merged = pitman_yor._merge(frame).iloc[0]
    state, v = pitman_yor.Part(merged["n"], merged["m"], merged["blob"]), len(known) + 1
    width = 1 << pitman_yor.SUB_BITS

    def totals(t3, t2, t1):
        return pitman_yor.Totals(np.bincount(state.h, t3, width).astype(np.int64), np.bincount(state.mid_g, t2, 1).astype(np.int64), t1.sum())

    tables = pitman_yor._burnt_in(state, 0, v, [], 4)
    for k in range(3):
        assert (tables[0] <= state.c).all() and (tables[0] >= (state.c > 0)).all()
        p1, p2, p3, _ = pitman_yor._chances(state, *tables, v, totals(*tables), np.bincount(state.h, state.c, width).astype(np.int64))
        occurring = np.flatnonzero((state.total > 0) | (np.arange(state.n) == state.w[np.flatnonzero(state.c == 0)][0]))
        seen, unseen = state.total > 0, np.flatnonzero(state.total == 0)
        # "unseen" and the beginning's mark are unseen words, all of one outcome
        assert p1[seen].sum() + p1[unseen[0]] == pytest.approx(1) and len(occurring)
        assert (p3 > 0).all() and (p2 > 0).all()
        tables = pitman_yor._sweep(state, tables, 0, v, totals(*tables), (4, k))
    got = {r["doc_id"]: r for r in pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), class_bits=0).collect()}
    start = [i for i, t in rows if i in held]
    assert all(got[i]["score"] < 0 for i in start) and got[held[0]]["n_tokens"] == 1


def plain_tables(rng, counts, sweeps, share):
    """Gibbs by single customers in one restaurant with a fixed base: mean tables of each dish."""
    (d, s), seats = pitman_yor.TWO, {w: [1] * n for w, n in counts.items()}
    mean = Counter()
    for k in range(sweeps):
        for w, n in counts.items():
            for _ in range(n):
                at = rng.choices(range(len(seats[w])), seats[w])[0]
                seats[w][at] -= 1
                if not seats[w][at]:
                    del seats[w][at]
                weights = [x - d for x in seats[w]] + [(s + d * sum(map(len, seats.values()))) * share]
                at = rng.choices(range(len(weights)), weights)[0]
                if at == len(seats[w]):
                    seats[w].append(0)
                seats[w][at] += 1
        if k >= sweeps // 4:
            mean.update({w: len(x) for w, x in seats.items()})
    return {w: m / (sweeps - sweeps // 4) for w, m in mean.items()}


def test_seating_agrees_with_single_customers():
    """Table counts drawn dish by dish, given all tables, have the means of a plain sampler that reseats one customer at a time."""
    (d, s), counts, share = pitman_yor.TWO, {0: 2, 1: 3, 2: 6, 3: 9}, 0.05
    want = plain_tables(random.Random(3), counts, 4000, share)
    rng, c = np.random.default_rng(3), np.array(list(counts.values()))
    t, mean = np.ones(4, np.int64), np.zeros(4)
    for k in range(4000):
        t = pitman_yor.seat(rng, c, np.full(4, (s + d * t.sum()) * share), d, pitman_yor._stirling(d))
        mean += t if k >= 1000 else 0
    assert np.abs(mean / 3000 - [want[w] for w in counts]).max() < 0.2


def test_seating_follows_its_distribution():
    rng, c, a, d = np.random.default_rng(6), 5, 0.7, 0.5
    s = pitman_yor._stirling(d)
    w = np.array([a**t * math.exp(s[c, t]) for t in range(1, c + 1)])
    t = pitman_yor.seat(rng, np.full(40_000, c), np.full(40_000, a), d, s)
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / 40_000 - w / w.sum()).max() < 0.01
    # generalised Stirling numbers: weights of all seatings of 4 customers at 2 tables
    assert math.exp(s[4, 2]) == pytest.approx(4 * (1 - d) * (2 - d) + 3 * (1 - d) ** 2)
    big = pitman_yor.seat(rng, np.full(100, 5000), np.full(100, a), d, s)
    assert (big >= 1).all() and (big < 5000).all()


def test_dishes_are_seated_together():
    """Dishes of like numbers of customers are drawn at once, each as it is by itself; those of one customer aren't worked on."""

    class Counted:
        def __init__(self):
            self.rng, self.sizes = np.random.default_rng(9), []

        def random(self, n):
            self.sizes.append(n)
            return self.rng.random(n)

    rng, d = np.random.default_rng(1), 0.6
    s, customers = pitman_yor._stirling(d), rng.permutation(np.r_[np.ones(50, np.int64), np.repeat(np.arange(2, 513), 3)])
    weight, counted = rng.gamma(1, 5, len(customers)), Counted()
    got, alone, want = pitman_yor.seat(counted, customers, weight, d, s), np.random.default_rng(9), np.ones(len(customers), np.int64)
    for i in np.argsort(customers, kind="stable")[50:].tolist():
        p = np.log(weight[i]) * np.arange(1, customers[i] + 1) + s[customers[i], 1 : customers[i] + 1]
        p = np.cumsum(np.exp(p - p.max()))
        want[i] = 1 + (p < alone.random() * p[-1]).sum()
    assert (got == want).all() and sum(counted.sizes) == len(customers) - 50
    assert len(counted.sizes) < 60  # not one for each of 511 numbers of customers


def test_discount_and_strength_are_drawn():
    """Restaurants seated plainly by a known discount and strength, each table with a dish of its own: draws of the level come back to both, from far away."""
    rng, d, s, sizes = random.Random(9), 0.6, 5.0, []
    for _ in range(300):
        at = []
        for _ in range(200):
            k = rng.choices(range(len(at) + 1), [*(x - d for x in at), s + d * len(at)])[0]
            at[k : k + 1] = [at[k] + 1 if k < len(at) else 1]
        sizes.append(at)
    gen, level, mean = np.random.default_rng(9), (0.2, 50.0), np.zeros(2)
    c, tables = np.array([x for at in sizes for x in at]), np.array([len(at) for at in sizes])
    for k in range(120):
        ones = pitman_yor._ones(gen, c, np.ones(len(c), np.int64), level[0], pitman_yor._stirling(level[0]))
        level = pitman_yor.draw_level(gen, *level, np.full(300, 200), tables, ones)
        mean += level if k >= 40 else (0, 0)
    assert abs(mean[0] / 80 - d) < 0.03 and abs(mean[1] / 80 - s) < 1


def test_dishes_of_a_restaurant_are_drawn_from_their_joint_distribution():
    """Seated by a gamma variable, the numbers of tables of two dishes have the exact probabilities; by its mean they haven't."""
    (d, s), c, share = (0.5, 0.3), 3, np.array([0.3, 0.4])
    st, away = pitman_yor._stirling(d), []
    rising = lambda n: math.prod(s + d * k for k in range(n))
    want = np.array([[rising(a + b) * share[0] ** a * share[1] ** b * math.exp(st[c, a] + st[c, b]) for b in (1, 2, 3)] for a in (1, 2, 3)])
    for exact in (True, False):
        rng, t, seen = np.random.default_rng(2), np.ones(2, np.int64), np.zeros((3, 3))
        for _ in range(30_000):
            x = pitman_yor.Totals(np.array([0]), np.array([0]), t.sum(), (pitman_yor.TWO, pitman_yor.ONE, (d, s)), int(rng.integers(2**31))).new_tables[2][0] if exact else s + d * t.sum()
            t = pitman_yor.seat(rng, np.full(2, c), x * share, d, st)
            seen[t[0] - 1, t[1] - 1] += 1
        away.append(np.abs(seen / seen.sum() - want / want.sum()).max())
    assert away[0] < 0.012 < away[1]


def plain_chunks(texts):
    """The rules of the module in plain Python over {doc_id: text}: the texts left."""
    size, context = line_chunks.CHUNK, line_chunks.CONTEXT
    cut_at = rf"(?<=\n)|(?<={line_chunks.UNCOMMON} )|(?<= )(?={line_chunks.BEGINS})"
    pieces = {i: re.split(cut_at, t) if t else [] for i, t in texts.items()}
    lines = {i: re.split(line_chunks.ENDS, t) if t else [] for i, t in texts.items()}
    code = lambda x: (xxhash.xxh64_intdigest(x.encode(), 42) + 2**63) % 2**64 - 2**63
    first, later = {}, []
    for i in sorted(texts):
        h, n = [code(x) for x in lines[i]], len(lines[i])
        roll = [(h[k] << 1 ^ h[k + 1]) + 2**63 & 2**64 - 1 if k + 1 < n else None for k in range(n)]
        for s in range(max(0, n - size + 1) if n >= size else 0):
            if s == 0 or (s + 1 < n - 1 + 1 and roll[s] is not None and roll[s + 1] is not None and roll[s] < roll[s - 1] and roll[s] <= roll[s + 1]):
                chunk = tuple(lines[i][s : s + size])
                if chunk in first:
                    later.append((i, *first[chunk], s))
                else:
                    first[chunk] = (i, s)
    stretches = defaultdict(list)
    for i, f, fs, s in sorted(later, key=lambda x: (x[0], x[1], x[3] - x[2], x[3])):
        group = stretches[i, f, s - fs]
        if group and s - group[-1][1] + size <= size + context:
            group[-1][1] = s + size
        else:
            group.append([s, s + size])
    gone = defaultdict(set)
    for (i, f, delta), group in stretches.items():
        for lo, hi in group:
            same = lambda k: 0 <= k < len(lines[i]) and 0 <= k - delta < len(lines[f]) and lines[i][k] == lines[f][k - delta]  # noqa: B023, E731
            gone[i] |= {k for k in range(lo, hi) if same(k)}
            for step, begin in ((-1, lo - 1), (1, hi)):
                near, k = [], begin
                while len(near) < context and same(k):
                    near.append(k)
                    k += step
                while near and len(lines[i][near[-1]]) < line_chunks.LONG_LINE:
                    near.pop()
                gone[i] |= set(near)
    return {i: "".join(p for k, p in enumerate(pieces[i]) if k not in gone[i]) if gone[i] else texts[i] for i in texts}


def test_line_chunks_against_plain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in line_chunks.drop_repeated_chunks(docs).collect()}
    assert {i: r["text"] for i, r in got.items()} == plain_chunks(texts) and sum(r["n_removed"] > 0 for r in got.values()) > 5


def test_often_repeated_chunks(spark, monkeypatch):
    """Chunks known from the sample to be frequent give the same result as others."""
    rng = random.Random(23)
    common = prose(rng, 80)
    texts = {i: f"{prose(rng, 40)} {common} {prose(rng, 40)}" if i % 3 else prose(rng, 100) for i in range(90)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(line_chunks, "SAMPLE", 2)
    monkeypatch.setattr(line_chunks, "HOT_SEEN", 5)
    assert {r["doc_id"]: r["text"] for r in line_chunks.drop_repeated_chunks(d).collect()} == plain_chunks(texts)


def test_line_chunks_with_equal_short_hashes(spark):
    """Different texts of one doc_id whose 32-bit hashes are equal: only what is repeated goes."""
    sentence = lambda name, n: " ".join(f"{name}{i % 89}{'zxq'[i % 3]}{i}" for i in range(n))
    shared = sentence("passage", 60)
    bodies = [shared + " " + sentence("left", 40), sentence("other", 110)]
    made = spark.range(300_000).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.concat(F.lit(b + " "), F.col("id").cast("string")).alias("text")) for k, b in enumerate(bodies)])).alias("x")).select("x.*")
    pair = made.groupBy(F.hash("text").alias("r")).agg(F.min(F.when(F.col("k") == 0, F.col("text"))).alias("a"), F.min(F.when(F.col("k") == 1, F.col("text"))).alias("b")).where("a is not null and b is not null").first()
    assert pair is not None
    rows = [(1, shared + " " + sentence("first", 30)), (7, pair["a"]), (7, pair["b"])]
    got = [r for r in line_chunks.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] == 7]
    cut, whole = sorted(got, key=lambda r: -r["n_removed"])
    assert cut["n_removed"] > 0 and shared not in cut["text"] and pair["a"].endswith(cut["text"][-200:])
    assert whole["n_removed"] == 0 and whole["text"] == pair["b"]


def test_line_chunks(spark):
    rng = random.Random(7)
    line = lambda: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(6, 14))).capitalize() + "."
    passage = " ".join(line() for _ in range(9))
    rows, own = [], {}
    for i in range(40):
        # lines of its own show the document's number, also beside the passage, so no words of them are shared
        head, tail = [f"{i}{line()} {i}" for _ in range(4)], [f"{i}{line()} {i}" for _ in range(4)]
        own[i] = head + tail
        rows.append((i, "\n".join([*head, *([passage] if i % 2 else []), *tail])))
    got = {r["doc_id"]: r for r in line_chunks.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert all(x in got[i]["text"] for x in own[i])  # what is a document's own stays
        if i % 2 == 0 or i == 1:  # no passage, or its first place
            assert got[i]["text"] == text and got[i]["n_removed"] == 0
        else:
            assert sum(x in got[i]["text"] for x in passage.split(". ")) <= 2


@pytest.mark.parametrize("ends", [True, False])
def test_lone_passages_between_documents(spark, ends):
    """Passages of 50 to 60 words, whole copies left out: between unrelated words in two documents, also without sentence ends."""
    rng = random.Random(17)
    some = lambda n: (prose(rng, n) if ends else " ".join(rng.choices(VOCABULARY, k=n))).split()
    rows, planted = [], []
    for _ in range(60):
        passage = some(rng.randrange(50, 61))
        for _ in range(2):
            # no word of a passage, and beside it a word of this document alone
            own = [["vo" + w for w in some(rng.randrange(20, 80))] for _ in range(2)]
            own[0][-1], own[1][0] = f"vo{len(rows)}x", f"vo{len(rows)}y"
            planted.append((own, passage))
            rows.append((len(rows), " ".join([*own[0], *passage, *own[1]])))
    got = {r["doc_id"]: r["text"] for r in line_chunks.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cut = []
    for i, text in rows:
        (head, tail), passage = planted[i]
        left = got[i].split()
        assert left[: len(head)] == head and left[-len(tail) :] == tail  # what is a document's own stays
        if i % 2 == 0:
            assert got[i] == text
        else:
            cut.append((len(head) + len(passage) + len(tail) - len(left)) / len(passage))
    assert sum(c > 0 for c in cut) >= 0.95 * len(cut) and sum(cut) >= 0.8 * len(cut)


def segmentations(word, ids):
    if not word:
        yield ()
    for n in range(1, len(word) + 1):
        if word[:n] in ids:
            yield from ((word[:n], *rest) for rest in segmentations(word[n:], ids))


def test_trie():
    given = [b"a", b"b", b"ab", b"abc", b"ca", b"bca"]
    pieces = _trie.Pieces(given)
    ids = {p: i for i, p in enumerate([*given, *(bytes([b]) for b in range(256) if bytes([b]) not in given)])}
    logp = np.log(np.random.default_rng(0).random((pieces.size, 2)))
    words = sorted({b"abcab", b"abca", b"ab", b"cabz", b"abc", b"zz", b"b", b"bcabca"})
    trie, want = _trie.Trie(words, pieces), np.zeros(pieces.size)
    forward, best = trie.at_ends(trie.forward(logp)), trie.at_ends(trie.best(logp[:, 1])[1], np.int64)
    for i, w in enumerate(words):
        segs = list(segmentations(w, ids))
        for m in (0, 1):
            assert forward[i, m] == pytest.approx(np.logaddexp.reduce([sum(logp[ids[p], m] for p in s) for s in segs]))
        assert best[i] == len(max(segs, key=lambda s: sum(logp[ids[p], 1] for p in s)))
        total = np.exp([sum(logp[ids[p], 0] for p in s) for s in segs])
        for s, share in zip(segs, total / total.sum(), strict=True):
            for p in s:
                want[ids[p]] += 2 * share
    assert trie.expected(logp, np.full((len(words), 2), 2.0))[:, 0] == pytest.approx(want)


def test_long_words(monkeypatch):
    pieces, rng = _trie.Pieces([b"a", b"b", b"ab", b"abc", b"ca", b"bca"]), random.Random(8)
    logp = np.log(np.random.default_rng(1).random((pieces.size, 3)))
    for stretch in (7, 1000):
        monkeypatch.setattr(_trie, "STRETCH", stretch)
        for n in (1, 6, 50, 333):
            word = bytes(rng.choice(b"abcz") for _ in range(n))
            trie = _trie.Trie([word], pieces)
            assert _trie.forward_long(word, pieces, logp) == pytest.approx(trie.at_ends(trie.forward(logp))[0])
            assert _trie.best_long(word, pieces, logp[:, 0]) == trie.at_ends(trie.best(logp[:, 0])[1], np.int64)[0]


def test_token_counts(spark):
    given = _trie.vocabulary(token_counts.VOCABULARY)
    pieces = _trie.Pieces(given)
    ids = {p: i for i, p in reversed(list(enumerate([*given, *(bytes([b]) for b in range(256) if bytes([b]) not in set(given))])))}
    logp = token_counts.unigram_scores(pieces)
    rows = [(1, "the cat sat"), (2, "the über  cat"), (3, "xq zzé")]
    for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        words = [token_counts.BEGIN + w for w in dict(rows)[r["doc_id"]].encode().split()]
        scores = [[(sum(logp[ids[p]] for p in s), -len(s)) for s in segmentations(w, ids)] for w in words]
        assert r["n_tokens"] == sum(-max(s)[1] for s in scores) and r["n_pretokens"] == len(words)
        assert r["forward_score"] == pytest.approx(sum(np.logaddexp.reduce([x for x, _ in s]) for s in scores))


@pytest.mark.parametrize("held", [1 << 20, 0])
def test_languages_against_each_word(monkeypatch, held):
    """Posteriors against each word by itself; a word that an earlier batch held isn't worked on again."""
    trie, worked = _trie.Trie, []
    monkeypatch.setattr(_trie, "Trie", lambda words, pieces: worked.extend(words) or trie(words, pieces))
    monkeypatch.setattr(language_id, "HELD", held)
    pieces = _trie.Pieces([b"ab", b"abc", "▁".encode(), "über".encode(), "▁ca".encode()])
    prior, logp = np.log([0.3, 0.7]), np.log(np.random.default_rng(2).dirichlet(np.ones(pieces.size), 2).T)
    model, known = language_id.Languages(["x", "y"], prior, logp), language_id.Words(2)
    texts = [None, "", "² 12 _", "AB cab_über1abc", "ÜBER ab² ²b", "ab\x1fAbc\tcab", "b" * 300, "ſtraße İb", "ab " * 40]
    for part in (texts, texts[::-1], [*texts, "cabab"]):
        for t, lang, score in zip(part, *model.predict(part, pieces, known), strict=True):
            found = [w.encode() for w in language_id.words(t)]
            total = prior + sum(trie([w], pieces).forward(logp)[-1][0] for w in found)
            assert lang == (("x", "y")[int(total.argmax())] if found else "und")
            assert score == pytest.approx(1 / np.exp(total - total.max()).sum() if found else 0)
    assert {"▁über".encode(), "▁cabab".encode()} < set(worked) and not any(len(w) > _trie.LONG for w in worked)
    assert (len(worked) == len(set(worked))) == (held != 0) and known.held > sum(map(len, known.ids)) > 300


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    got = language_id.op6_language_id(spark, sf_dir.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got) > 0
    assert all(0 <= r["score"] <= 1 for r in got)


@pytest.mark.parametrize("group", [4096, 16])
def test_vectors(spark, monkeypatch, group):
    monkeypatch.setattr(flat_graph, "GROUP", group)
    monkeypatch.setattr(flat_graph, "SHARD_ROWS", 60)
    rng = np.random.default_rng(8)
    x = [rng.standard_normal(16) for _ in range(150)]
    for spread in (0.02, 0.06, 0.1):
        centre = rng.standard_normal(16)
        x += [centre + spread * rng.standard_normal(16) for _ in range(60)]
    x += [x[0] * 2, x[0], x[200]]
    x = np.array(x, np.float32)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    plain = Sets(range(len(x)))
    for a, b in zip(*np.nonzero(near), strict=True):
        plain.join(int(a), int(b))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in flat_graph.near_vectors(d).collect()}
    assert got == {i: (int(near[i].sum()) - 1, plain.root(i)) for i in range(len(x))}


def test_sainte_lague(spark):
    rng = random.Random(9)
    for seats in (0, 1, 7, 50, 333):
        votes = [rng.choice([0, 1, 5, 1000, rng.random() * 300]) for _ in range(12)] + [9.0]
        heap = [(-v, k, 0) for k, v in enumerate(votes) if v]
        heapq.heapify(heap)
        want = [0] * len(votes)
        for _ in range(seats):
            _, k, n = heap[0]
            want[k] += 1
            heapq.heapreplace(heap, (-votes[k] / (2 * n + 3), k, n + 1))
        rows = spark.createDataFrame([(k, float(v)) for k, v in enumerate(votes)], "k long, v double")
        got = mixing.sainte_lague(rows, "k", F.col("v"), F.lit(float(seats))).orderBy("k").collect()
        assert [r["quota"] for r in got] == want


def test_mixing(spark):
    rng = random.Random(10)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 7, 60, 400])), rng.choice(["b", "B", "a", "é", None, *["big"] * 6])) for i in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.mix(d, words_per_shard=5000).collect()}
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, free, rest = dict.fromkeys(names, 0.0), set(names), 1.5 * sum(size.values())
    while free and rest > 1e-9:
        share = rest / sum(weight[s] for s in free)
        over = {s for s in free if share * weight[s] > 2 * size[s]}
        for s in over or free:
            target[s] = 2 * size[s] if over else share * weight[s]
        rest -= sum(target[s] for s in over or free)
        free -= over or free
    taken = Counter()
    for i, t, s in rows:
        r = got[i]
        assert (r["size"], r["source_size"]) == (len(t.split()), size[s]) and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] + 16 * 8 for s in names)
    assert {i: r["taken"] for i, r in got.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(d.repartition(7), words_per_shard=5000).collect()}
    texts = Counter()
    for r in mixing.take(d, words_per_shard=5000).collect():
        texts[r["doc_id"]] += len(r["text"].split())
    assert texts == {i: r["taken"] for i, r in got.items() if r["taken"]}


def test_audio(spark):
    x = np.random.default_rng(0).standard_normal(999)
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    plain, y = np.convolve(up, audio.PHASES.T.reshape(-1)), audio.resample(x)
    k = np.arange(40, 600)
    assert np.abs(y[k] - plain[k * audio.DOWN + audio.PHASES.shape[1]]).max() < 1e-9
    tone = np.sin(2 * np.pi * 1000 * np.arange(12_000) / audio.RATE)
    assert audio.log_mel(audio.resample(tone))[0].mean(0).argmax() == (audio.BANK[32]).argmax()  # 1000 Hz is bin 32 at 8 kHz
    quiet = np.r_[np.full(20, -60.0), np.full(5, -10.0), -35.5 * np.ones(3), np.full(20, -60.0)]
    assert [v.tolist() for v in audio.segments(quiet)] == [[20], [28]]
    data, n = audio.payload("héllo")
    assert len(data) == 192 and n == 6 and audio.decode(audio.encode(data)) == data
    with pytest.raises(ValueError):
        audio.decode(b"RIFFxxxxWAVE")
    rows = spark.createDataFrame([(1, "some text " * 600), (2, "some text " * 600)], "doc_id long, text string")
    a, b = audio.audio_columns(rows).orderBy("doc_id").collect()
    assert a.asDict() | {"doc_id": 2} == b.asDict()
    tensors = audio.read_tensors(a["tensors"])
    assert tensors.column("log_mel").type.shape == [audio.WINDOW, audio.MELS]
    frames = int(a["feature"].split()[0].split("=")[1])
    assert tensors.num_rows == -(-frames // audio.WINDOW) and tensors.column("start_s")[0].as_py() == 0.0
    assert audio.decode(a["media"]) == audio.payload("some text " * 600)[0] and json.dumps([s.asDict() for s in a["segments"]])
