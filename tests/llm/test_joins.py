"""Similarity join, substring dedup and decontamination against plain Python."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import pytest
from llm.conftest import clashing, messy_rows, prose

from arcweave.llm.components import components
from arcweave.llm.decontamination import MASKS, SHORT_MASKS, decontaminated, overlaps
from arcweave.llm.jaccard_join import divide_skip, merged_runs, near_duplicates_removed, similar_sets
from arcweave.llm.substring_dedup import COVER, PERIOD, check_cover, substring_dedup, substring_report

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, k):
    w = WORD.findall(lowered(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_links(rows, k, percent):
    """(doc_id, n_shingles, component_id, n_links) of each row."""
    sets = [(LAST if r[0] is None else r[0], frozenset(shingles(r[1], k))) for r in rows]
    kinds = sorted({s for _, s in sets if s}, key=lambda s: sorted(s))
    root, links = {s: s for s in kinds}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(kinds)):
        for b in range(a):
            x, y = kinds[a], kinds[b]
            if 100 * len(x & y) >= percent * len(x | y):
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    least = defaultdict(lambda: LAST)
    for i, s in sets:
        if s:
            least[find(s)] = min(least[find(s)], i)
    known = lambda i: None if i == LAST else i
    return [(known(i), len(s), known(least[find(s)] if s else i), links[s]) for i, s in sets]


def key(x):
    return tuple((v is not None, v) if not isinstance(v, str) else (True, v) for v in x)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


@pytest.mark.parametrize("k, percent, shard", [(4, 85, 1 << 18), (5, 80, 300), (4, 30, 200)])
def test_similar_sets(messy, k, percent, shard):
    same(similar_sets(messy, k, percent, shard=shard).collect(), brute_links(messy_rows(), k, percent))
    same(similar_sets(messy, k, percent, shard=shard, links=False).collect(), [r[:3] for r in brute_links(messy_rows(), k, percent)])


def test_links_of_many_near_copies(spark):
    import random

    rng = random.Random(3)
    base = prose(rng, 120).split(" ")
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = f"z{rng.randrange(50)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (1 << 18, 4000):
        same(similar_sets(docs, 4, 85, shard=shard).collect(), brute_links(rows, 4, 85))


def test_links_between_size_levels(spark, monkeypatch):
    """Near copies that grow: their sizes lie on several levels of a group cut into shards."""
    from arcweave.llm import jaccard_join

    base = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(base[: 100 + k])) for k in range(0, 200, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "MOST", 3000)
    for percent in (85, 97, 100):
        same(similar_sets(docs, 4, percent, shard=2000).collect(), brute_links(rows, 4, percent))


def test_twenty_thousand_near_copies(spark):
    """One group of different texts; words are changed where each shingle they touch becomes one of its own."""
    import random

    import numpy as np

    rng = random.Random(17)
    base = [f"w{k}" for k in range(60)]
    rows, whole = [], np.ones((20_000, 57), np.float32)
    for k in range(len(whole)):
        own = list(base)
        for at in rng.sample(range(60), k % 3):
            own[at] = f"x{k}y{at}"
            whole[k, max(0, at - 3) : at + 1] = 0
        rows.append((k, " ".join(own)))
    sets = {}
    for k, (_, t) in enumerate(rows):
        sets.setdefault(t, k)
    kinds = np.array(sorted(sets.values()))
    m = whole[kinds]
    own = m.sum(1)
    linked = np.zeros(len(m), np.int64)
    to_first = None
    for s in range(0, len(m), 1000):
        # all sets have 57 shingles; those changed belong to one text alone
        both = m[s : s + 1000] @ m.T
        near = 100 * both >= 85 * (114 - both)
        near[np.arange(len(near)), s + np.arange(len(near))] = False
        linked[s : s + 1000] = near.sum(1)
        to_first = near[0] if s == 0 else to_first
    assert len(kinds) > 13_000 and own.min() > 40
    links = {rows[i][1]: int(n) for i, n in zip(kinds, linked)}
    assert {t: links[t] for t in links if links[t]}.keys() == {t for t in links if to_first[np.searchsorted(kinds, sets[t])] or sets[t] == 0}  # one component
    got = similar_sets(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), shard=1 << 17).collect()
    assert {r.doc_id: (r.n_links, r.component_id) for r in got} == {i: (links[t], 0 if links[t] else sets[t]) for i, t in rows}


def test_merged_runs():
    import random

    import numpy as np

    rng = random.Random(5)
    for n in (1, 5, 40, 400):
        runs = [np.array(sorted(rng.sample(range(1000), rng.randrange(n + 1))), np.int64) for _ in range(6)]
        value, count = merged_runs(runs)
        assert dict(zip(value.tolist(), count.tolist())) == Counter(x for r in runs for x in r.tolist()) and (np.diff(value) > 0).all()


def brute_candidates(rows, k, percent):
    """Pairs of rows that link, compared exactly wherever they share a shingle."""
    sets = {}
    for i, t in rows:
        if own := frozenset(shingles(t, k)):
            sets.setdefault(own, []).append(i)
    kinds, lists, out = list(sets), defaultdict(list), {}
    for a, s in enumerate(kinds):
        both = Counter(b for x in s for b in lists[x])
        out[a] = [b for b, n in both.items() if 100 * n >= percent * (len(s) + len(kinds[b]) - n)]
        for x in s:
            lists[x].append(a)
    return kinds, sets, out


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_no_link_of_the_documents_is_lost(spark, k, percent):
    """All documents of the small tables against exact comparison: what stays unlinked lies below the threshold."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    kinds, sets, near = brute_candidates(rows, k, percent)
    root, links = list(range(len(kinds))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, found in near.items():
        for b in found:
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = {}
    for a, s in enumerate(kinds):
        least[find(a)] = min([least.get(find(a), LAST), *sets[s]])
    want = {i: (least[find(a)], links[a]) for a, s in enumerate(kinds) for i in sets[s]}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.n_links) for r in similar_sets(docs, k, percent).collect() if r.n_shingles}
    assert got == want and sum(links.values())

def test_divide_skip_finds_every_pair():
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    for percent in (20, 50, 80, 100):
        for mu in (0.001, 0.01, 1.0):
            _, links = divide_skip(sets, sizes, percent, mu=mu)
            want = [sum(100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
            assert links.tolist() == want


def test_components_without_links_are_the_same():
    """Passing over what a component holds already changes no component: near copies, chains and unrelated sets, with sides or not."""
    import numpy as np

    rng = np.random.default_rng(3)
    for trial in range(30):
        base = rng.choice(10_000, 60, replace=False)
        sets = []
        for _ in range(70):
            kind = rng.integers(0, 4)
            if kind == 0:
                sets.append(np.unique(rng.integers(0, 40, rng.integers(1, 25))))
            elif kind == 1 or not sets:
                own = base.copy()
                own[rng.integers(0, 60, rng.integers(0, 12))] = rng.integers(10_000, 20_000)
                sets.append(np.unique(own))
            else:  # a link of a chain
                own = sets[rng.integers(0, len(sets))].copy()
                own[rng.integers(0, len(own), 1 + len(own) // 12)] = rng.integers(20_000, 90_000)
                sets.append(np.unique(own))
        sizes = np.array([len(x) for x in sets])
        sides = np.sort(rng.integers(0, 2, 70)) if trial % 2 else None
        for percent in (50, 80, 85):
            one, counts = divide_skip(sets, sizes, percent, sides)
            two, _ = divide_skip(sets, sizes, percent, sides, count=False)
            near = [[100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)) and i != j and (sides is None or sides[i] != sides[j]) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
            root = list(range(70))
            for _ in range(70):
                root = [min([root[i]] + [root[j] for j in range(70) if near[i][j]]) for i in range(70)]
            assert one.tolist() == two.tolist() == root and counts.tolist() == [sum(x) for x in near]


def test_work_in_a_group_of_near_copies():
    """Four times as many near copies take far less than sixteen times as long, within a shard and between two."""
    import time

    import numpy as np

    rng = np.random.default_rng(2)
    base = rng.choice(1 << 40, 120, replace=False)

    def copies(n):
        out = []
        for _ in range(n):
            own = base.copy()
            at = rng.integers(0, 110)
            own[at : at + 4] = rng.integers(1 << 41, 1 << 42, 4)
            out.append(np.unique(own))
        return out

    for sided in (False, True):
        took = []
        for n in (2_500, 10_000):
            sets = copies(n)
            sides = np.repeat([0, 1], n // 2) if sided else None
            began = time.process_time()
            root, _ = divide_skip(sets, np.array([len(x) for x in sets]), 85, sides, count=False)
            took.append(time.process_time() - began)
            assert (root == 0).all()
        assert took[1] < 7 * took[0], took


def brute_kept(rows, k, percent):
    """(id, text) of the rows that stay: of each component the smallest id, then the text with the smallest hash."""
    known = lambda r: LAST if r[0] is None else r[0]
    sets = [frozenset(shingles(r[1], k)) for r in rows]
    kinds = sorted({s for s in sets if s}, key=lambda s: sorted(s))
    root = {s: s for s in kinds}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in itertools.combinations(kinds, 2):
        if 100 * len(x & y) >= percent * len(x | y):
            root[find(x)] = find(y)
    best, out = {}, set()
    for r, s in zip(rows, sets):
        own = (known(r), text_hash(r[1]), r[0], r[1] or "")
        if s:
            best[find(s)] = min(best.get(find(s), own), own)
        else:
            out.add((r[0], r[1] or ""))
    return out | {x[2:] for x in best.values()}


def text_hash(t):
    import xxhash

    x = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return x - (x >> 63 << 64)


def test_one_of_each_group_stays(spark, messy):
    import random

    rng = random.Random(41)
    x, y, z = (prose(rng, 40, 9000) for _ in range(3))
    odd = [(5, z), (5, y + " tail"), (None, y), (None, y + " tail two"), (None, x + " extra"), (1, x), (None, prose(rng, 30)), (None, ""), (None, None), (8, " "), (8, " "), (9, None)]
    for rows in ([(r[0], r[1]) for r in messy_rows()], odd):
        docs = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
        got = near_duplicates_removed(docs, 5, 80)
        assert got.columns == docs.columns
        found = Counter((r.doc_id, r.text or "") for r in got.collect())
        assert set(found) == brute_kept(rows, 5, 80) and set(found.values()) == {1}


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (12, 10), (7, 7), *((k, k + 1) for k in range(100, 160))]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, **{k: 100 for k in range(100, 161)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_cut(rows, width):
    """(doc_id, n_words, n_removed, digest, text) of each row."""
    words = [WORD.findall(r[1] or "") for r in rows]
    ids = [LAST if r[0] is None else r[0] for r in rows]
    least = {}
    for i, w in zip(ids, words):
        for s in range(len(w) - width + 1):
            t = tuple(w[s : s + width])
            least[t] = min(least.get(t, LAST), i)
    out = []
    for r, i, w in zip(rows, ids, words):
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if least[tuple(w[s : s + width])] < i:
                gone[s : s + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if any(gone) else r[1]))
    return out


@pytest.mark.parametrize("width", [50, 35])
def test_substring_report(messy, width):
    same(substring_report(messy, width).collect(), [x[:4] for x in brute_cut(messy_rows(), width)])


def test_a_task_sends_a_shared_hash_once():
    """Of 40 batches that all hold one passage, the first rows go out and the others are settled."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    from arcweave.llm.substring_dedup import _anchor_rows, _anchors, _window_rows
    from arcweave.llm.textkit import words

    text = " ".join(f"w{k}" for k in range(60)).encode()
    w = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    _, h = _anchors(w, 50, PERIOD, COVER)
    press = zstandard.ZstdCompressor()
    shared = pa.array([h.view(np.int64).tolist()] * 3, pa.list_(pa.int64()))
    batches = [pa.RecordBatch.from_arrays([pa.array([3 * k, 3 * k + 1, 3 * k + 2]), pa.array([7, 8, 9]), pa.array([press.compress(text)] * 3), shared], ["id", "sig", "text", "shared"]) for k in range(40)]
    for run, column in ((_anchor_rows, "many"), (_window_rows, "s")):
        out = pa.Table.from_batches(run(50, PERIOD, COVER)(iter(batches))).to_pylist()
        single = [r for r in out if (r["done"] is None if column == "many" else r["s"] is not None)]
        assert len(single) == len({r["h" if column == "many" else "h1"] for r in single}) <= 60 and all(r["id"] == 0 for r in single)
        assert {r["id"] for r in out if r["done"]} == set(range(1, 120))


def test_overlapping_repeats_across_many_documents(spark):
    import random

    rng = random.Random(5)
    pool = [prose(rng, 90, 50) for _ in range(3)]
    rows = []
    for k in range(120):
        parts = [prose(rng, rng.randrange(0, 30), 5000)]
        for p in rng.sample(pool, rng.randrange(1, 3)):
            w = p.split(" ")
            a = rng.randrange(0, 40)
            parts += [" ".join(w[a : a + rng.randrange(45, 70)]), prose(rng, rng.randrange(0, 20), 5000)]
        rows.append((rng.randrange(200), " ".join(parts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    same(substring_report(docs).collect(), [x[:4] for x in brute_cut(rows, 50)])


def test_passages_shared_by_all_tasks(spark):
    """A passage in every document, repeated within some, in many Arrow batches of few tasks."""
    import random

    rng = random.Random(23)
    passage, line = prose(rng, 80, 9000), prose(rng, 7, 9000)
    rows = [(rng.randrange(150), f"{prose(rng, rng.randrange(30), 5000)} {passage} {' '.join([line] * rng.randrange(0, 40))} {passage if k % 9 == 0 else ''}") for k in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = [x[:4] for x in brute_cut(rows, 50)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        same(substring_report(docs).collect(), want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_substring_dedup_keeps_columns(messy):
    docs = clashing(messy)
    got = substring_dedup(docs)
    assert got.columns == docs.columns
    want = [(r[0], r[4]) for r in brute_cut(messy_rows(), 50) if not (r[1] and r[1] == r[2])]
    same(got.select("doc_id", "text").collect(), want)
    assert all(r.id == "x" and r["__id"] == "x" for r in got.collect())


def test_cover():
    check_cover(PERIOD, COVER, 50)
    with pytest.raises(ValueError):
        check_cover(31, (1, 2, 3), 50)
    with pytest.raises(ValueError):
        check_cover(PERIOD, COVER, 20)


def split(t):
    return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]


def brute_windows(rows, items, window=13, share=0.8):
    """How many aligned windows of each row and item have enough equal tokens: all of them are compared, without masks."""
    out = Counter()
    for r in rows:
        h = split(r[1])
        for item, text in items:
            g = split(text)
            w = min(window, len(g))
            need = len(g) if len(g) < 9 else -(-w * 8 // 10)
            for d in range(-len(g), len(h)) if g else ():
                equal = [0 <= q + d < len(h) and h[q + d] == g[q] for q in range(len(g))]
                if sum(equal) >= need:
                    n = sum(0 <= q + d and q + d + w <= len(h) and sum(equal[q : q + w]) >= need for q in range(len(g) - w + 1))
                    if n:
                        out[r[0], item] += n
    return out


def brute_overlaps(rows, items):
    return set(brute_windows(rows, items))


def test_decontamination(spark, messy, empty):
    import random

    rng = random.Random(2)
    items = [(k, prose(rng, n, 3000)) for k, n in enumerate((30, 20, 13, 9, 8, 5))] + [(90, None), (91, "")]
    w = items[0][1].split(" ")
    swapped = [*w[:5], "other", *w[6:10], "word", *w[11:]]
    rows = [r for r in messy_rows() if len(r[1] or "") < 5000]
    rows += [(1000, f"{prose(rng, 30)} {items[0][1]} {prose(rng, 8)}", "en", "web", 1), (1001, " ".join(swapped).upper(), "en", "web", 1), (1002, prose(rng, 9) + ", " + items[3][1].replace(" ", " - "), "en", "web", 1), (1003, " ".join(w[:12]), "en", "web", 1), (1004, " ".join(x if k % 3 else "q" for k, x in enumerate(w)), "en", "web", 1), (None, items[1][1], None, None, 1)]
    docs = spark.createDataFrame(rows, messy.schema)
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    want = brute_overlaps(rows, items)
    assert {(1000, 0), (1001, 0), (1002, 3), (None, 1)} <= want and not any(i in (1003, 1004) for i, _ in want)
    for limit in (200_000, 0):  # both ways to join
        assert {(r.doc_id, r.item_id) for r in overlaps(docs, bench, broadcast_seeds=limit).collect()} == want
    own = clashing(docs)
    got = decontaminated(own, bench)
    assert got.columns == own.columns and decontaminated(own, bench, 0).count() == got.count()
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in rows if not brute_overlaps([r], items))
    assert overlaps(empty, bench).count() == 0 and overlaps(docs, bench.filter("false")).count() == 0 and decontaminated(docs, bench.filter("false")).count() == len(rows)


def test_every_allowed_substitution_is_met():
    for masks, w, subs in ((MASKS, 13, 2), (SHORT_MASKS, 12, 2), (SHORT_MASKS, 11, 2), (SHORT_MASKS, 10, 2), (SHORT_MASKS, 9, 1)):
        for changed in itertools.combinations(range(w), subs):
            assert any(not {p + o for o in m} & set(changed) for m in masks for p in range(w - m[-1])), (w, changed)


def test_substituted_items_of_every_length(spark):
    """Each pattern of allowed substitutions in items of 9 to 13 tokens, and one too many; short items whole."""
    import random

    rng = random.Random(6)
    rows, items = [], []
    for w in range(1, 14):
        item = [f"i{w}x{k}" for k in range(w)]
        items.append((w, " ".join(item)))
        subs = w - (w if w < 9 else -(-w * 8 // 10))
        for n in range(subs + 2):
            for changed in list(itertools.combinations(range(w), n))[: 200 if n <= subs else 20]:
                own = [f"other{rng.randrange(999)}" if k in changed else x for k, x in enumerate(item)]
                rows.append((len(rows), f"{prose(rng, rng.randrange(3))} {' '.join(own)} {prose(rng, rng.randrange(3))}"))
    want = brute_windows(rows, items)
    assert {i for _, i in want} == set(range(1, 14))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (200_000, 0):
        assert {(r.doc_id, r.item_id): r.n_hits for r in overlaps(docs, bench, broadcast_seeds=limit).collect()} == want


def test_item_ids_that_repeat_with_other_texts(spark):
    import random

    rng = random.Random(31)
    a = prose(rng, 24, 3000).split(" ")
    b = [x if k % 6 else "else" for k, x in enumerate(a)]
    items = [(1, " ".join(a)), (1, " ".join(b)), (1, " ".join(a)), (None, " ".join(a)), (2, prose(rng, 20, 3000))]
    docs = spark.createDataFrame([(7, " ".join(a)), (8, " ".join(b)), (9, prose(rng, 30, 3000))], "doc_id long, text string")
    rows = [tuple(r) for r in docs.collect()]
    one, two = brute_windows(rows, items[:1]), brute_windows(rows, items[1:2])
    want = {**{(d, 1): one[d, 1] + two[d, 1] for d in (7, 8)}, **{(d, None): one[d, 1] for d in (7, 8) if one[d, 1]}}
    for order in (items, items[::-1]):
        for limit in (200_000, 0):
            bench = spark.createDataFrame(order, "item_id long, text string").repartition(2)
            assert {(r.doc_id, r.item_id): r.n_hits for r in overlaps(docs, bench, broadcast_seeds=limit).collect()} == want


def test_empty_tables(empty):
    assert similar_sets(empty).count() == 0 and substring_report(empty).count() == 0 and substring_dedup(empty).count() == 0 and near_duplicates_removed(empty).count() == 0


def test_long_texts_are_searched_everywhere(spark):
    """Passages across the borders of chunks, in a text and in an item of many chunks."""
    import random

    from arcweave.llm.decontamination import CHUNK

    rng = random.Random(12)
    item = prose(rng, 300, 5000).split(" ")
    rows = []
    for k, (at, start, n) in enumerate([(CHUNK - 5, 60, 13), (CHUNK - 12, 0, 14), (5 * CHUNK - 1, 120, 20), (0, 287, 13), (991, 187, 9), (987, 190, 13), (700, 63, 12)]):
        w = prose(rng, 1000, 100_000).split(" ")
        part = item[start : start + n]
        if n == 13:
            part[4], part[8] = "x1", "x2"
        w[at : at + n] = part
        rows.append((k, " ".join(w)))
    items = [(1, " ".join(item))]
    want = brute_overlaps(rows, items)
    assert len(want) >= 4
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for limit in (200_000, 0):
        assert {(r.doc_id, r.item_id) for r in overlaps(docs, bench, broadcast_seeds=limit).collect()} == want
