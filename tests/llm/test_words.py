"""Spelling variants, languages and periodic runs against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.conftest import SCHEMA, clashing, messy_rows, prose

from arcweave.llm import language_id, periodic_runs, spelling
from arcweave.llm.frames import table

SF = "/root/testdata/sf0.001"


# --- periodic runs


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                found.setdefault((s, i + q - s), q)
    return sorted((s, size, q) for (s, size), q in found.items())


def word_lists():
    rng = random.Random(3)
    out = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 3000, list("ab" * 40), list("ab" * 3 + "a"), list("aab" * 9 + "aac" * 9)]
    for size in (1, 2, 3, 30):
        out += [[f"w{rng.randrange(size + 1)}" for _ in range(rng.randrange(300))] for _ in range(60)]
    for _ in range(80):  # runs with random ends beside and within one another
        w = []
        for _ in range(rng.randrange(1, 6)):
            unit = [f"w{rng.randrange(4)}" for _ in range(rng.randrange(1, 40))]
            w += (unit * 12)[: rng.randrange(1, 12 * len(unit))] + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(20))]
        out.append(w)
    return out


def test_runs_are_those_of_a_plain_search():
    for w in word_lists():
        assert periodic_runs.runs_of(periodic_runs.exact_ids([x.encode() for x in w])) == brute_runs(w)


def test_many_probes_come_in_blocks(monkeypatch):
    lists = word_lists()[-40:]
    want = [periodic_runs.runs_of(periodic_runs.exact_ids([x.encode() for x in w])) for w in lists]
    monkeypatch.setattr(periodic_runs, "BLOCK", 7)
    monkeypatch.setattr(periodic_runs, "CHUNK", 2)
    assert [periodic_runs.runs_of(periodic_runs.exact_ids([x.encode() for x in w])) for w in lists] == want and any(want)


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g = h // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[a + (i - a) % p] if i >= a else w[i] for i in range(len(w))]


def collapsed(w, runs):
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_periodic_runs_of_documents(spark, messy, empty):
    docs = clashing(messy)
    rows = messy_rows() + [(9_000 + k, " \n".join(w), None, None, None) for k, w in enumerate(word_lists())]
    more = spark.createDataFrame(rows, SCHEMA).repartition(4)
    for df, source in ((docs, messy_rows()), (more, rows)):
        want = []
        for doc_id, text, *_ in source:
            w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
            want.append((doc_id, len(w), tuple(brute_runs(w)), collapsed(w, brute_runs(w))))
        got = [(r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in periodic_runs.periodic_runs(df).collect()]
        assert Counter(got) == Counter(want)
        edits = [(r.doc_id, tuple((r.text or "").split())) for r in periodic_runs.with_planted_runs(df).collect()]
        assert Counter(edits) == Counter((r[0], tuple(planted(r[0], r[1]))) for r in source)
    assert periodic_runs.periodic_runs(empty).count() == 0


def test_op13_digests(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for doc_id, text in table(spark, SF, "documents").select("doc_id", "text").collect():
        w = planted(doc_id, text)
        runs = brute_runs(w)
        best = min(((-size, s, q) for s, size, q in runs), default=None)
        head = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want.append((doc_id, len(runs), *head, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(collapsed(w, runs))))
    got = periodic_runs.op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(want) and any(w[1] for w in want)


# --- spelling variants


def one_edit(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1 or x == y:
        return False
    p = next((k for k in range(len(x)) if x[k] != y[k]), len(x))
    return x[p + 1 :] == y[p + 1 :] if len(x) == len(y) else x[p:] == y[p + 1 :]


def brute_near(words):
    out = {}
    for x, n in words.items():
        near = [(-m, y) for y, m in words.items() if one_edit(x, y)]
        out[x] = (n, len(near), *((-min(near)[0], min(near)[1]) if near else (None, None)))
    return out


def brute_variants(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    near = brute_near({w: n for w, n in count.items() if len(w) >= 5 and n >= 3})
    form = {w: best if m is not None and m >= 2 * n else None for w, (n, _, m, best) in near.items()}
    out = []
    for w, (n, k, m, _) in near.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, k, m if form[w] else None))
    return out


def some_words():
    rng = random.Random(5)
    words = {}
    for letters, low, high, m in (("ab", 5, 9, 300), ("abcdéÿ", 5, 12, 500), ("aé", 44, 56, 60)):
        pool = ["".join(rng.choice(letters) for _ in range(rng.randrange(low, high))) for _ in range(m)]
        for w in pool:
            for _ in range(3):
                k = rng.randrange(len(w))
                words[rng.choice([w, w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])] = rng.randrange(3, 9)
    return {w: n for w, n in words.items() if len(w) >= 5}


@pytest.mark.parametrize(("block", "batch"), [(128, 10_000), (2, 10_000), (8, 7)])
def test_near_words_are_all_found_once(spark, block, batch):
    words = some_words()
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = {r.word: (r.n, r.n_near, r.best_n, r.best) for r in spelling.near_words(df, block).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_near(words) and max(v[1] for v in got.values()) > 5


def test_forms_are_followed_to_the_end(spark):
    links = [(f"w{k}", f"w{k + 1}") for k in range(37)] + [(f"x{k}", "w0") for k in range(50)] + [("y", "z")]
    got = {r.word: r.root for r in spelling.followed(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {a: "z" if a == "y" else "w37" for a, _ in links}
    assert spelling.followed(spark.createDataFrame([], "word string, form string")).count() == 0


def test_spelling_variants_of_documents(spark, messy, empty):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdeéñÜXY") for _ in range(rng.randrange(4, 9))) for _ in range(60)]
    rows = messy_rows()
    for k in range(300):
        words = []
        for w in rng.choices(base, [1 / (i + 1) for i in range(60)], k=30):
            i = rng.randrange(len(w))
            words.append(w if rng.random() < 0.7 else w[:i] + rng.choice("abÉ") + w[i + 1 :])
        rows.append((None if k % 50 == 0 else k, " ".join(words) + rng.choice(["", "×÷", "K2x", ",Straße"]), None, None, None))
    rows.append((7_001, "qqqqz " * 3 + "qqqzz " * 7 + "Qqzzz " * 20, None, None, None))  # a chain of forms
    docs = clashing(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = spelling.spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = brute_variants(rows)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert any(w[1] and w[1] != w[2] for w in want) and any(w[1] is None and w[4] for w in want)
    assert spelling.spelling_variants(empty).count() == 0 and Counter(map(tuple, spelling.spelling_variants(messy).collect())) == Counter(brute_variants(messy_rows()))


# --- languages


def brute_grams(text):
    out = set()
    for word in re.findall("#+", "".join("#" if c.isalpha() else " " for c in text)) and "".join(c if c.isalpha() else " " for c in text).split(" "):
        if word:
            low = " " + "".join(c.lower() if len(c.lower()) == 1 else c for c in word) + " "
            out |= {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)} - {" "}
    return out


def test_kernel_rows_are_those_of_sets(monkeypatch):
    marks = ["the cat, the Dog", "le chat noir É", "a", "der Hund\nläuft", "東京 x", ""]
    texts = ["The dog", "", "noir noir 12", "東京に", "𝔞 x-y", "a b c", "İstanbul ẞ", prose(random.Random(1), 200), *marks]
    own = [brute_grams(t) for t in marks]
    every = set().union(*own)
    for direct in (language_id.DIRECT, 1):
        monkeypatch.setattr(language_id, "DIRECT", direct)
        monkeypatch.setattr(language_id, "CELLS", 300)
        m = language_id.Landmarks(marks).opened()
        assert len(m.keys) == len(every)
        raw = [t.encode() for t in texts]
        data, off = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))
        got = list(m.rows(data, off))
        kernel = np.concatenate([k for *_, k in got])
        assert np.concatenate([s for _, _, s, _ in got]).tolist() == [any(c.isalpha() for c in t) for t in texts]
        for t, row in zip(texts, kernel):
            x = brute_grams(t) & every
            want = [len(x & z) / max(1, len(x)) ** 0.5 / max(1, len(z)) ** 0.5 for z in own]
            assert np.allclose(row, want, atol=1e-6)


def test_ridge_on_the_map_of_landmarks():
    """With all learned texts as landmarks it is kernel ridge regression itself."""
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(6)) for letters in ("abc", "cde", "efg") for _ in range(8)]
    marks = language_id.Landmarks(texts).opened()
    raw = [t.encode() for t in texts]
    k = np.concatenate([k for *_, k in marks.rows(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(r) for r in raw])))])
    label = np.repeat(np.arange(3), 8)
    d = language_id.solved(marks, k, label, ["a", "b", "c"], 0.5).decisions(k)
    y = np.where(label[:, None] == np.arange(3), 1.0, -1.0)
    c = np.eye(24) - 1 / 24
    want = c @ k @ c @ np.linalg.solve(c @ k.astype(float) @ c + 0.5 * np.eye(24), y - y.mean(0)) + y.mean(0)
    assert np.abs(d - want).max() < 2e-3 and (d.argmax(1) == label).all()


def test_languages_of_held_out_documents(spark):
    got = {r.doc_id: r for r in language_id.op12_language_id(spark, SF).collect()}
    rows = table(spark, SF, "documents").select("doc_id", "text", "lang").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(got) == len(rows) and held and {r.doc_id for r in held} == {k for k, r in got.items() if r.held_out}
    share = [got[r.doc_id].lang_pred == r.lang for r in held if any(c.isalpha() for c in r.text or "")]
    assert sum(share) >= 0.97 * len(share) and all(0 <= r.score <= 1 for r in got.values())


def test_what_languages_are_learned_from(spark, messy, empty):
    docs = table(spark, SF, "documents")
    learned = docs.select("text", "lang")
    model = language_id.train(learned)
    sums = language_id.train(learned.repartition(7))
    assert model.languages == sums.languages and np.allclose(model.coefficients, sums.coefficients, atol=1e-4)
    few = language_id.train(learned, rows=80, landmarks=8)
    assert len(few.landmarks.has) == 8
    got = language_id.languages(clashing(messy), model).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert len(got) == messy.count()
    for doc_id, text, *_ in messy_rows():
        und = not any(c.isalpha() for c in text or "")
        if not (doc_id is None or len(by_id[doc_id]) > 1):
            assert (by_id[doc_id][0].lang_pred == "und") == und and (not und or by_id[doc_id][0].score == 0)
    # equal texts get equal results, in any layout
    pairs = lambda df: Counter((r.doc_id, r.lang_pred, round(r.score, 5)) for r in language_id.languages(df, model).collect())
    assert pairs(messy) == pairs(messy.repartition(9))
    assert language_id.languages(empty, model).count() == 0 and language_id.train(empty.select("text", "lang")) is None
    nothing = spark.createDataFrame([(None, "en"), ("12 3", "fr"), ("words", None)], "text string, lang string")
    assert language_id.train(nothing) is None
    assert {r.lang_pred for r in language_id.languages(messy, None).collect()} == {"und"}
    many = spark.createDataFrame([(f"word {k}", f"l{k}") for k in range(1001)], "text string, lang string")
    with pytest.raises(ValueError):
        language_id.train(many)
