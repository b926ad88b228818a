"""Learned scores: held-out accuracy on planted signals, and the parts that have a closed form."""

import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from llm.conftest import clashing, messy_rows, prose

from arcweave.llm import language_model, quality, toxicity
from arcweave.llm.language_model import Model, scores
from arcweave.llm.textkit import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remainder(i, mod):
    return zlib.crc32(str(i).encode() if i is not None else b"") % mod


@pytest.fixture(scope="module")
def graded(spark):
    """Documents of three grades; the lowest are shouting, the middle ones have a bad sentence."""
    rng = random.Random(11)
    docs, labels = [], []
    for k in range(900):
        grade = k % 3
        parts = [prose(rng, rng.randrange(4, 12)) for _ in range(rng.randrange(3, 9))]
        if grade == 1:
            parts.insert(rng.randrange(len(parts)), f"you {rng.choice(['vile', 'filthy', 'rotten'])} {rng.choice(['worm', 'toad'])}")
        if grade == 0:
            parts = [p.upper() + "!!!" for p in parts]
        docs.append((k, ". ".join(parts) + ".", "en", "web", 0))
        labels.append((k, int(grade != 0), int(grade == 1)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxicity(spark, graded, messy, empty):
    docs, labels = graded
    model = toxicity.train(docs, labels)
    rows = toxicity.score(clashing(docs), model).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (remainder(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(held) > 150 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    found = [r for r in held if truth[r.doc_id]]
    assert np.mean([bool(re.search("vile|filthy|rotten|worm|toad", r.worst_sentence)) for r in found]) > 0.97
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in found[:20]:
        assert text[r.doc_id].encode()[r.worst_byte :].decode().startswith(r.worst_sentence[:10])
    odd = toxicity.score(messy, model).collect()
    assert len(odd) == len(messy_rows()) and all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.remove_toxic(clashing(docs), model)
    assert kept.columns == clashing(docs).columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.score < 0.3}
    none = toxicity.train(empty, labels.filter("false"))
    assert toxicity.score(empty, none).count() == 0 and all(r.predicted == 0 for r in toxicity.score(messy, none).collect())
    # labels of the held-out rows never matter
    spoiled = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) AS toxic").union(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    assert np.array_equal(toxicity.train(docs, spoiled).weights, model.weights)


def test_length_alone_is_not_toxic(spark, graded):
    docs, labels = graded
    model = toxicity.train(docs, labels)
    rng = random.Random(3)
    clean = ". ".join(f"w{rng.randrange(10**9)} x{k}" for k in range(20_000))
    rows = spark.createDataFrame([(1, clean), (2, f"{clean}. you vile worm. {clean}")], docs.select("doc_id", "text").schema)
    got = {r.doc_id: r for r in toxicity.score(rows, model).collect()}
    assert got[1].score < 0.01 and not got[1].predicted and got[1].worst_score < 0.01
    assert got[2].predicted and "vile" in got[2].worst_sentence
    assert [r.doc_id for r in toxicity.remove_toxic(rows, model).collect()] == [1]
    clean_only = toxicity.train(docs, labels.withColumn("toxic", labels.toxic * 0))
    assert not any(r.predicted for r in toxicity.score(rows, clean_only).collect())


def test_toxicity_slope_by_differences():
    rng = np.random.default_rng(2)
    text = np.sort(rng.integers(0, 12, 40))
    sentence = np.sort(rng.integers(0, 40, 150))
    word, x = rng.integers(0, 9, 150), rng.normal(0, 0.7, 10)
    positive, decay = rng.random(12) < 0.5, 0.3

    def value(x):
        keep = np.zeros(12)
        for t in range(12):
            keep[t] = math.prod(1 - 1 / (1 + math.exp(-(x[9] + sum(x[w] for w, s in zip(word, sentence) if s == k)))) for k in range(40) if text[k] == t)
        return np.mean([math.log(1 - k) if p else math.log(k) for k, p in zip(np.clip(keep, 1e-9, 1 - 1e-9), positive)]) - decay * (x[:9] ** 2).sum() / 24

    got = toxicity.slope(x, word, sentence, text, positive, decay)
    own = np.array([(value(x + e) - value(x - e)) / 2e-6 for e in 1e-6 * np.eye(10)])
    assert set(text) == set(range(12)) and np.allclose(got, own, atol=1e-6)


def test_toxicity_scores_by_hand(spark):
    """Every row's score and worst sentence from the weights, in plain Python."""
    rows = [r[:2] for r in messy_rows()] + [(900, "Bad bad WORD. fine here! bad? bad-word\nno"), (901, "...!?"), (902, "word")]
    known = ["bad", "word", "one", "changed", "tail"]
    hashes = {}
    for w in known:
        raw = np.frombuffer(w.encode(), np.uint8)
        hashes[w] = toxicity.instances(raw, np.array([0, len(raw)]))[0][0]
    order = sorted(known, key=hashes.get)
    weight = {w: 0.5 + 0.3 * k for k, w in enumerate(order)}
    model = toxicity.Model(np.array([hashes[w] for w in order]), np.array([weight[w] for w in order]), -2.0)
    got = {}
    for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        got.setdefault(r.doc_id, []).append((r.score, r.predicted, r.worst_score))
    want = {}
    for i, t in rows:
        found = [re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", s) for s in re.split("[.!?\n]", t or "")]
        found = [["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in s] for s in found if s]
        p = [1 / (1 + math.exp(2 - sum(weight.get(w, 0) for w in s))) if any(w in weight for w in s) else 0.0 for s in found]
        score = 1 - math.prod(1 - x for x in p)
        want.setdefault(i, []).append((score, int(score >= 0.3), max(p, default=0.0)))
    assert got.keys() == want.keys() and all(np.allclose(sorted(got[i]), sorted(want[i]), atol=1e-9) for i in want) and any(x[1] for v in want.values() for x in v)


def test_tied_labels(spark):
    """Equal texts with different labels: toxic if one is, and the lowest grade, in any order of rows."""
    rng = random.Random(14)
    texts = [f"{prose(rng, 12)} {'vile toad' if k % 4 == 0 else ''}" for k in range(200)]
    docs = [(i, t) for i, t in enumerate(texts * 2)]
    labels = [(i, int(i % 200 % 4 == 0 and i < 200), 1 - int(i % 200 % 8 == 0 and i >= 200)) for i, _ in docs]
    models = []
    for rows in (docs, docs[::-1]):
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        marks = spark.createDataFrame(labels, "doc_id long, toxic int, quality int")
        tox, good = toxicity.train(table, marks), quality.train(table, marks.selectExpr("doc_id", "quality AS grade"), 2)
        models.append((sorted(zip(tox.keys.tolist(), tox.weights)), good.weights, good.thresholds))
    assert np.allclose([w for _, w in models[0][0]], [w for _, w in models[1][0]], atol=1e-6) and len(models[0][0]) >= 2
    assert np.allclose(models[0][1], models[1][1], atol=1e-4) and np.allclose(models[0][2], models[1][2], atol=1e-4)


def test_quality_slope_by_differences():
    rng = np.random.default_rng(4)
    text, feature, value = np.repeat(np.arange(10), 5), rng.integers(0, 6, 50), rng.random(50)
    grade, x, decay = rng.integers(0, 4, 10), rng.normal(0, 0.8, 9), 0.2

    def likelihood(x):
        theta = [x[6], x[6] + math.exp(x[7]), x[6] + math.exp(x[7]) + math.exp(x[8])]
        total = 0.0
        for t in range(10):
            z = sum(x[f] * v for s, f, v in zip(text, feature, value) if s == t)
            tails = [1.0, *(1 / (1 + math.exp(c - z)) for c in theta), 0.0]
            total += math.log(tails[grade[t]] - tails[grade[t] + 1])
        return total / 10 - decay / 2 * (x[:6] ** 2).sum()

    got = quality.slope(x, 6, text, feature, value, grade, 4, decay)
    assert np.allclose(got, [(likelihood(x + e) - likelihood(x - e)) / 2e-6 for e in 1e-6 * np.eye(9)], atol=1e-6)


def test_quality_scores_by_hand(spark):
    """Features and tails of every row in plain Python."""
    rng = np.random.default_rng(9)
    model = quality.Model(rng.normal(0, 1, quality.SIZE).astype(np.float32), np.array([-0.5, 1.0]))
    rows = [r[:2] for r in messy_rows() if len(r[1] or "") < 3000] + [(950, "SHOUT shout 12 12 !!"), (951, "x")]
    hashed = {}

    def bucket(w):
        if w not in hashed:
            raw = np.frombuffer(w.encode(), np.uint8)
            hashed[w] = int(quality.words(raw, np.array([0, len(raw)]), True, quality.ALNUM).hash[0]) % quality.WORDS
        return hashed[w]

    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        found = [w.lower() if w.isascii() else w for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")]
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in found]
        kind = [int(quality.KIND[b]) for b in raw]
        z = 0.0
        for bag in (Counter(bucket(w) for w in found), Counter(quality.WORDS + a * quality.KINDS**2 + b * quality.KINDS + c for a, b, c in zip(kind, kind[1:], kind[2:]))):
            norm = math.sqrt(sum(bag.values()))
            z += sum(model.weights[f] * math.sqrt(n) for f, n in bag.items()) / norm if bag else 0.0
        n, size = len(found), max(len(raw), 1)
        own = [1.0, math.log1p(n) / 8, sum(a == b for a, b in zip(found, found[1:])) / max(n, 1), len({bucket(w) for w in found}) / max(n, 1), sum(k in (1, 2, 4) for k in kind) / size, sum(k == 2 for k in kind) / size, float(not raw), len(raw) / max(n, 1) / 16]
        z += sum(model.weights[quality.SIZE - 8 + k] * v for k, v in enumerate(own))
        tails = [1 / (1 + math.exp(c - z)) for c in model.thresholds]
        want.setdefault(i, []).append((sum(tails), tails[0], float(tails[0] >= 0.5)))
    got = {}
    for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        got.setdefault(r.doc_id, []).append((r.expected_grade, r.tail, float(r.keep)))
    assert got.keys() == want.keys() and all(np.allclose(sorted(got[i]), sorted(want[i]), atol=1e-5) for i in want)


def test_noisy_or():
    z, text = np.array([0.3, -2.0, 1.5]), np.array([0, 0, 2])
    p = 1 / (1 + np.exp(-z))
    assert np.allclose(toxicity.noisy_or(z, text, 3), [1 - (1 - p[0]) * (1 - p[1]), 0, p[2]])


def test_quality(graded, messy, empty):
    docs, labels = graded
    grades = quality.graded(labels)
    model = quality.train(docs, grades, 3)
    assert model.thresholds[0] < model.thresholds[1]
    rows = quality.score(clashing(docs), model).collect()
    truth = {r.doc_id: r.grade for r in grades.collect()}
    held = [r for r in rows if r.held_out]
    assert np.mean([abs(r.expected_grade - truth[r.doc_id]) < 0.5 for r in held]) > 0.8 and np.mean([r.keep == (truth[r.doc_id] >= 1) for r in held]) > 0.97
    assert all(r.keep == (r.tail >= 0.5) and 0 <= r.expected_grade <= 2 for r in rows)
    assert quality.score(messy, model).count() == len(messy_rows()) and quality.score(empty, quality.train(empty, grades.filter("false"), 3)).count() == 0


def test_cumulative_links_by_numbers():
    """The gradient: fitted tails of one feature meet the shares of each grade."""
    rng = np.random.default_rng(5)
    grade = rng.choice(3, 3000, p=[0.2, 0.3, 0.5])
    n = np.arange(3000)
    model = quality.fit(n, np.zeros(3000, np.int64), np.ones(3000), grade, 3, steps=600)
    tails = model.tails(np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(1), 1)[0]
    assert np.allclose(tails, [(grade > 0).mean(), (grade > 1).mean()], atol=0.02)


def tokens(t):
    return [*WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]


def brute_base(rows, mod=10):
    counts = Counter(w for i, t in rows if remainder(i, mod) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = tokens(t)
        out.append((i, remainder(i, mod) == 0, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return out


def order(x):
    return (x[0] is not None, x[0] or 0, x[2], x[5])


def test_base_scores(messy, empty):
    rows = [r[:2] for r in messy_rows()]
    want = sorted(brute_base(rows), key=order)
    for top in (1 << 17, 1200):  # all counts broadcast; the rest joined
        got = sorted(map(tuple, scores(clashing(messy), top=top).collect()), key=order)
        assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want], atol=1e-6)
        assert all(g[6] < 0 for g in got)
    assert scores(empty).count() == 0 and scores(messy.filter("doc_id = 31")).count() == 1


def test_nothing_to_learn_from(spark):
    held = [i for i in range(60) if not remainder(i, 10)]
    got = scores(spark.createDataFrame([(i, "one two") for i in held], "doc_id long, text string")).collect()
    assert len(got) == len(held) > 0 and all(r.train_tokens == 0 and r.n_known == 0 and abs(r.score - r.base_score) < 1e-6 for r in got)


def test_scores_do_not_follow_the_layout(spark):
    rng = random.Random(21)
    docs = [(i, prose(rng, rng.randrange(0, 120), 900)) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    one, *others = ({r.doc_id: r.score for r in scores(table.repartition(n)).collect()} for n in (1, 8, 32))
    assert len(one) == 400 and all(math.isclose(x[i], one[i], rel_tol=1e-6) for x in others for i in one)


def test_model_beats_its_base_on_held_out_text(spark):
    """Words that follow one another are learned."""
    rng = random.Random(8)
    pairs = [(f"a{k}", f"b{k}") for k in range(60)]
    texts = [" ".join(w for _ in range(40) for w in rng.choice(pairs)) for _ in range(600)]
    got = scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 30 and sum(r.score for r in held) > 0.75 * sum(r.base_score for r in held)


def test_rare_words_are_learned_from_their_context(spark):
    """Of 4,000 words that each follow a word of their own, none is frequent."""
    rng = random.Random(12)
    texts = [" ".join(f"a{k} b{k}" for k in (rng.randrange(2000) for _ in range(40))) for _ in range(3000)]
    got = scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 200 and sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def test_probabilities_sum_to_one():
    """Over all known words, in any context, with any weights."""
    rng = np.random.default_rng(0)
    data = np.frombuffer(" ".join(f"w{k}" for k in range(3000)).encode(), np.uint8)
    own = language_model.Tokens(data, np.array([0, len(data)])).hash
    counts = rng.integers(1, 50, len(own)).astype(float)
    total = counts.sum()
    k, _ = language_model.shape(total)
    c, g = language_model.groups_of(own, k)
    seen, kinds = np.bincount(c * k + g, counts, k * k).reshape(k, k), np.bincount(c * k + g, minlength=k * k).reshape(k, k)
    model = Model.start(own[:500], counts[:500], seen, kinds, total)
    model.weights = rng.normal(0, 1, model.weights.shape).astype(np.float32)
    after = language_model.context_hash(own[9:10], own[7:8])
    some = np.array([3, 9, 1200, 2999])
    model.follows = language_model.Follows.fitted(np.repeat(after, 4), own[some], np.array([5, 1, 1, 2]), counts[some], seen + 0.1 * kinds + 0.1 / k**2)
    p = np.zeros(len(own))
    for s in range(0, len(own), 1000):  # the context "w7 w9" before each word
        texts = [f"w7 w9 w{j}" if j < 3000 else "w7 w9" for j in range(s, min(s + 1000, len(own)))]
        off = np.cumsum([0, *map(len, texts)])
        t = language_model.Tokens(np.frombuffer("".join(texts).encode(), np.uint8), off)
        p[s : s + len(texts)] = model.gains(t)[t.first + 2]
    base = (counts + 0.1) / (total + 0.1 * (len(own) + 1))
    assert abs((10**p * base).sum() - 1) < 1e-3
    assert (10**p * base)[some].sum() > 0.5


def one_mix(x):
    return int(mix(np.array([x % 2**64], np.uint64))[0])


def brute_scores(rows):
    """The model over plain lists and dictionaries, one token and one weight at a time."""
    m = language_model
    fit = [(i, t) for i, t in rows if remainder(i, 10)]
    hashed = {}

    def ids(t):
        w = tokens(t)
        new = [x for x in w if x is not None and x not in hashed]
        for x in new:
            raw = np.frombuffer(x.encode(), np.uint8)
            hashed[x] = int(m.Tokens(raw, np.array([0, len(raw)])).hash[0])
        return [int(m.END) if x is None else hashed[x] for x in w]

    counts = Counter(h for _, t in fit for h in ids(t))
    n, v = sum(counts.values()), len(counts)
    k, size = m.shape(n)
    den = n + 0.1 * (v + 1)
    group = lambda h: ((x := one_mix(h + 77)) % k, (x >> 32) % k)
    mass = {(a, b): 0.1 / k**2 / den for a in range(k) for b in range(k)}
    for h, c in counts.items():
        mass[group(h)] += (c + 0.1) / den
    share = [sum(mass[a, b] for b in range(k)) for a in range(k)]
    mean = [sum(mass[a, b] for a in range(k)) for b in range(k)]
    rank = {h: r for r, h in enumerate(sorted(counts, key=lambda h: (-counts[h], h)))}
    weights = {}

    def contexts(h):
        for i, x in enumerate(h):
            a, b = group(x)
            one = h[i - 1] if i else int(m.BOS)
            two = h[i - 2] if i > 1 else int(m.BOS)
            some = [y for y in h[max(0, i - m.REACH) : i] if y in rank]
            often = int(m.BOS) if not i else min(some, key=rank.get) if some else int(m.NONE)
            both = one_mix(one * 0x9E3779B97F4A7C15 + one_mix(often))
            yield a, b, [(j, one_mix(y + j) % size) for j, y in enumerate((one, two, often, both))], deep_rows(one, often, a), (one, two, often)

    def deep_rows(one, often, a):
        return [(4 + j, one_mix(one_mix(y + 50 + j) + a) % size) for j, y in enumerate((one, often))]

    def soft(rows_, start):
        z = [s * math.exp(sum(weights[r][c] for r in rows_ if r in weights)) for c, s in enumerate(start)]
        return [x / sum(z) for x in z]

    used = Counter()
    for r in range(m.ROUNDS):
        grad = {}
        for i, t in fit:
            if part_of[i] != r:
                continue
            for a, b, wide, deep, _ in contexts(ids(t)):
                for own, taken, start in ((wide, a, share), (deep, b, [mass[a, x] / share[a] for x in range(k)])):
                    p = soft(own, start)
                    for row in own:
                        g = grad.setdefault(row, [0.0] * k)
                        used[row] += 1
                        for c in range(k):
                            g[c] += (c == taken) - p[c]
        for row, g in grad.items():
            q = soft([row], share if row[0] < 4 else mean)
            w = weights.setdefault(row, [0.0] * k)
            for c in range(k):
                w[c] += min(max(m.RATE * math.log1p(max(g[c] / (used[row] * q[c] + m.PRIOR), -0.95)), -m.STEP), m.STEP)
    after = {}
    for _, t in fit:
        h = ids(t)
        for x, c in zip(h, contexts(h)):
            after.setdefault(c[4][:2], Counter())[x] += 1

    def odds(words):
        if len(words) > m.FOLLOW:
            return {}
        aim = {x: (c - m.DISCOUNT) / sum(words.values()) for x, c in words.items()}
        base = {x: (counts[x] + 0.1) / den for x in words}
        return {x: aim[x] / base[x] * (1 - sum(base.values())) / (1 - sum(aim.values())) for x in words}

    out = {}
    for i, t in rows:
        h = ids(t)
        total = 0.0
        for x, (_, _, wide, _, (one, two, often)) in zip(h, contexts(h)):
            classes = soft(wide, share)

            def softmaxes(y):
                a, b = group(y)
                inner = soft(deep_rows(one, often, a), [mass[a, z] / share[a] for z in range(k)])  # noqa: B023
                return (counts[y] + 0.1) / den / mass[a, b] * classes[a] * inner[b]  # noqa: B023

            own = odds(after.get((one, two), {}))
            total += math.log10(softmaxes(x) * own.get(x, 1.0) / (1 + sum(softmaxes(y) * (e - 1) for y, e in own.items())))
        out[i] = total
    return out


def test_better_than_a_bigram_on_held_out_text(spark):
    """The documents of the 0.01 tables, against a bigram with absolute discounts that backs off to the base."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r.doc_id: [None, *tokens(r.text)] for r in docs.collect()}
    fit = [t for i, t in rows.items() if remainder(i, 10)]
    words, pairs = Counter(w for t in fit for w in t[1:]), Counter(p for t in fit for p in zip(t, t[1:]))
    seen, kinds = Counter(), Counter()
    for (a, _), c in pairs.items():
        seen[a] += c
        kinds[a] += 1
    den = sum(words.values()) + 0.1 * (len(words) + 1)
    gain = n = 0
    for i, t in rows.items():
        if not remainder(i, 10):
            for a, b in zip(t, t[1:]):
                q = (words[b] + 0.1) / den
                gain += math.log10((max(pairs[a, b] - 0.75, 0) + 0.75 * kinds[a] * q) / seen[a] / q) if a in seen else 0.0
                n += 1
    held = [r for r in scores(docs).collect() if r.held_out]
    assert sum(r.n_tokens for r in held) == n
    assert sum(r.score - r.base_score for r in held) / n > max(0.72, gain / n)


def test_contexts_with_few_followers(spark):
    """Counts by brute force in any layout; a context that many words follow is left out, in one batch or over several."""
    rng = random.Random(3)
    texts = [f"x y {rng.choice('abcdefgh')} {rng.choice('pq')} z" for _ in range(60)] + ["", None, "x"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = language_model
    want = {}
    for t in texts:
        raw = (t or "").encode()
        own = m.Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        for c, h in zip(m.context_hash(*m.contexts(own)), own.hash):
            want.setdefault(int(c), Counter())[int(h.view(np.int64))] += 1
    assert any(len(w) > m.FOLLOW for w in want.values())
    flat = {(c, h): n for c, w in want.items() if len(w) <= m.FOLLOW for h, n in w.items()}
    for parts in (1, 40):
        assert {(r.context, r.h): r.c for r in m.follow_counts(table.repartition(parts), 2**32).collect()} == flat
    half = {x: n for x, n in flat.items() if x[0] < 2**31}
    assert {(r.context, r.h): r.c for r in m.follow_counts(table, 2**31).collect()} == half
    counts = m.word_counts(table)
    some = m.follows(table, counts, 240.0, np.ones((16, 16)), most=len(flat) // 2)
    assert 0 < len(some.context) <= len(flat) // 2 and set(some.context.tolist()) <= {c for c, _ in flat}


part_of = {}


def test_scores_against_plain_loops(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 22), 40)) for i in range(80)] + [(80, ""), (81, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    part_of.update({r[0]: r[1] for r in table.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {language_model.ROUNDS}) AS p").collect()})
    want = brute_scores(rows)
    got = {r.doc_id: r.score for r in scores(table).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-4) for i in want)


def test_no_context_is_left_out_of_a_large_corpus(spark, monkeypatch):
    """However many trigrams there are beside what one table of weights may hold, all contexts that few words follow have
    theirs; blocks and buckets of any size, and words whose counts are asked for, give the same."""
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 22), 40)) for i in range(80)] + [(80, ""), (81, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    part_of.update({r[0]: r[1] for r in table.selectExpr("doc_id", f"pmod(xxhash64(doc_id), {language_model.ROUNDS}) AS p").collect()})
    want = brute_scores(rows)
    rare = {r.doc_id: tuple(r) for r in scores(table, top=15).collect()}
    gathered = language_model.follows
    monkeypatch.setattr(language_model, "follows", lambda *x: gathered(*x, most=40))  # what a driver may gather bounds no score
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 120, raising=False)
    monkeypatch.setattr(language_model, "BUCKET_TOKENS", 90, raising=False)
    got = {r.doc_id: r.score for r in scores(table).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-4) for i in want)
    again = {r.doc_id: tuple(r) for r in scores(table, top=15).collect()}
    assert again.keys() == rare.keys() and all(a == b or math.isclose(a, b, rel_tol=1e-6) for i in rare for a, b in zip(again[i], rare[i]))


def test_what_scores_leave_on_disk(spark):
    """Under 5 bytes a token of shuffle files for texts, questions and answers, and none of the gradients of training."""

    def files():
        dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p: p.stat().st_size for d in dirs for p in Path(d.getPath()).rglob("shuffle_*.data")}

    rng = random.Random(8)
    texts = [" ".join(f"w{min(int(1 / (rng.random() + 1e-5)), 20000)}" for _ in range(200)) for _ in range(1500)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()
    assert table.count() == 1500
    before = files()
    got = scores(table)
    assert len(got.collect()) == 1500
    left = sum(n for p, n in files().items() if p not in before)
    assert 0 < left < 5 * 1500 * 201
    table.unpersist()


@pytest.mark.parametrize("kind", [np.uint32, np.uint64])
def test_cells_find_what_a_set_has(kind):
    rng = np.random.default_rng(5)
    most = np.iinfo(kind).max
    for n in (0, 1, 2, 3000):
        keys = np.unique(np.append(rng.integers(0, most, n, kind), np.array([0, most], kind)[: n // 2]))
        asked = np.concatenate([keys, keys + kind(1), rng.integers(0, most, 50, kind), np.array([0, most], kind)])
        hit, at = language_model.Cells(keys).find(asked)
        own = set(keys.tolist())
        assert hit.tolist() == [x in own for x in asked.tolist()] and (keys[at[hit]] == asked[hit]).all()
    crowd = np.arange(500, dtype=kind)  # all in one cell
    hit, at = language_model.Cells(crowd).find(np.arange(600, dtype=kind))
    assert hit.sum() == 500 and (at[:500] == np.arange(500)).all()


def test_gradient_of_repeated_words(monkeypatch):
    """Rows of weights that a few and that thousands of tokens pick, over more tokens than are summed at once."""
    monkeypatch.setattr(language_model, "SUMMED", 1 << 14)
    rng = np.random.default_rng(6)
    data = np.frombuffer(" ".join(f"w{int(x)}" for x in np.minimum(1 / (rng.random(40000) + 1e-5), 5000)).encode(), np.uint8)
    t = language_model.Tokens(data, np.array([0, len(data) // 2, len(data)]))
    own, counts = np.unique(t.hash, return_counts=True)
    k, _ = language_model.shape(len(t.hash))
    c, g = language_model.groups_of(own, k)
    model = Model.start(own[::2], counts[::2].astype(float), np.bincount(c * k + g, counts, k * k).reshape(k, k), np.bincount(c * k + g, minlength=k * k).reshape(k, k), float(len(t.hash)))
    model.weights = rng.normal(0, 1, model.weights.shape).astype(np.float32)
    got = language_model.Gradient(model)
    got.add(t)
    want, used = np.zeros_like(got.sums), np.zeros_like(got.used)
    for part, p, rows, taken in model.parts(t, model.often(t)):
        for r in rows:
            np.add.at(want, (r, taken), 1.0)
            np.add.at(want, r, -p.astype(float))
            np.add.at(used, r, 1)
    assert (used == got.used).all() and used.max() > 2 * language_model.SUMMED / 3
    assert np.allclose(got.sums, want, rtol=1e-5, atol=1e-3)


def test_coded_texts_open_as_they_were(spark):
    """Texts coded by ranks and rare hashes have the tokens that they had, however many are opened at once."""
    rng = random.Random(9)
    texts = [prose(rng, rng.randrange(0, 30), 60) for _ in range(40)] + ["", "é A a", " "]
    raw = [x.encode() for x in texts]
    t = language_model.Tokens(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    own, counts = np.unique(t.hash, return_counts=True)
    for top in (0, 9, len(own)):
        keys, n = own[:top], counts[:top]
        m = Model.start(keys, n, np.ones((16, 16)), np.ones((16, 16)), 1.0)
        often = np.empty(top)
        often[m.ranks] = n
        e = language_model.Exchange(SimpleNamespace(value=(often, m.keys, m.ranks, m.bias, m.inner, m.weights)), np.ones((16, 16)), 100, 10)
        batch = pa.RecordBatch.from_arrays([pa.array([0] * 43, pa.int32()), pa.array(range(43)), pa.array([i % 3 == 0 for i in range(43)]), pa.array(texts)], ["block", "doc_id", "held_out", "text"])
        table = pa.Table.from_batches(list(e.code([batch])))
        for most in (1, 50, 1 << 17):
            with pytest.MonkeyPatch.context() as patch:
                patch.setattr(language_model, "OPEN", most)
                got = e.tokens(table)
            assert (np.concatenate([x.hash for _, x, _ in got]) == t.hash).all()
            assert sum((x.counts.tolist() for _, x, _ in got), []) == t.counts.tolist()
            assert sum((b.column(1).to_pylist() for b, _, _ in got), []) == list(range(43))
            assert (np.concatenate([x for _, _, x in got]) == (t.doc % 3 != 0)).all()
