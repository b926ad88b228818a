"""Fingerprints, token counts, packing and archives against plain Python and the libraries themselves."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.conftest import clashing, messy_rows, prose

from arcweave.llm.fingerprints import common_extension, edited_fingerprints, fingerprint_of, fingerprints, likeness, prefix, span_equal
from arcweave.llm.packing import best_fit_packing, best_two_fit
from arcweave.llm.token_counts import default_path, token_counts
from arcweave.llm.warc import lookup, read_back, reversed_host, round_trip, write_archives, write_index


def points(t):
    return np.frombuffer(t.encode("utf-32-le"), np.uint32)


def test_spans_and_extensions():
    a, b = "the quick brown fox jumps", "a quick brown fox sleeps"
    p, q = prefix(points(a)), prefix(points(b))
    assert span_equal(p, 4, q, 2, 15) and not span_equal(p, 4, q, 2, 17)
    assert common_extension(p, 3, q, 1) == len(" quick brown fox ")
    rng = random.Random(1)
    for _ in range(200):
        x, y = ("".join(rng.choice("ab") for _ in range(30)) for _ in range(2))
        i, j = rng.randrange(30), rng.randrange(30)
        n = 0
        while i + n < 30 and j + n < 30 and x[i + n] == y[j + n]:
            n += 1
        assert common_extension(prefix(points(x)), i, prefix(points(y)), j) == n


def test_likeness_follows_common_ends():
    rng = random.Random(4)
    t = prose(rng, 300)
    f = lambda x: fingerprint_of(points(x))
    assert likeness(f(t), f(t)) == 1 and f(t) == f(str(t)) and f(t) != f(t + ".")
    near = likeness(f(t), f(t[: 2 * len(t) // 3] + prose(rng, 100)[: len(t) // 3]))
    assert 0.5 < near <= 0.7 and likeness(f(t), f(prose(rng, 300))) < 0.05 and likeness(f(""), f("")) == 1 and likeness(f(""), f("a")) == 0


def test_likeness_sees_past_edits():
    rng = random.Random(9)
    f = lambda x: fingerprint_of(points(x))
    t = prose(rng, 600, 9000)
    assert likeness(f(t), f("#" + t[1:-1] + "#")) > 0.95
    words = t.split(" ")
    for k in range(20, 600, 50):
        words[k] = "edited" if k % 100 else "words put in"
    assert likeness(f(t), f(" ".join(words))) > 0.75
    assert likeness(f(t), f(f"{prose(rng, 9, 9000)} {t[1500:]} {prose(rng, 9, 9000)} {t[:1500]} {prose(rng, 9, 9000)}")) > 0.85  # moved
    other = prose(rng, 600, 9000)
    assert likeness(f(t), f(other)) < 0.05 and likeness(f(t + t), f("x" + t + other)) < 0.6  # each span is paired once
    for a, b in (("a" * 1000, "b" + "a" * 999), ("a" * 1000, "b" + "a" * 998 + "c"), ("ab" * 40, "b" + "ab" * 500), ("", "x" * 100)):
        got = likeness(f(a), f(b))
        assert 0 <= got < 1 and got == likeness(f(b), f(a))
        assert got <= (min(len(a), len(b))) / max(len(a), len(b))


def test_interior_spans_cover_the_text():
    rng = random.Random(2)
    for t in ["", "a", "ab" * 3, "a" * 700, *(prose(rng, n) for n in (2, 9, 90, 900)), "東京 naïve " * 30]:
        parts = fingerprint_of(points(t)).split(":")
        size = list(bytes.fromhex(parts[5]))
        assert sum(size) == len(t) and len(parts[4]) == 8 * len(size) and all(0 < x <= 64 for x in size)
        at = 0
        for k, n in enumerate(size):
            assert int(parts[4][8 * k : 8 * k + 8], 16) == int(prefix(points(t[at : at + n]))[-1])
            at += n


def plain_likeness(a, b):
    """The likeness by its definition, over strings: cuts from both ends, then spans between cuts by content, each paired once."""
    from arcweave.llm.fingerprints import BASES, LONGEST, REACH, STEPS, WIDTH, P

    if a == b:
        return 1.0
    long, short = max(len(a), len(b)), min(len(a), len(b))
    same = lambda x, y: max([0] + [int(c) for c in STEPS if c <= short and x[:c] == y[:c]])
    head = same(a, b)
    tail = min(same(a[::-1], b[::-1]), short - head)

    def spans(t):
        h = [sum((ord(c) + 1) * pow(BASES[0], k, P) for k, c in enumerate(t[i : i + WIDTH])) % P * 0x9E3779B1 % (1 << 32) for i in range(len(t) - WIDTH + 1)]
        marks = [i for i in range(1, len(h)) if all(h[i] < x for x in h[max(0, i - REACH) : i]) and all(h[i] <= x for x in h[i + 1 : i + REACH + 1])]
        cuts = [0, *marks, len(t)]
        out = []
        for s, e in zip(cuts, cuts[1:]):
            out += [(k, min(k + LONGEST, e)) for k in range(s, e, LONGEST)]
        left = {}
        for s, e in out:
            if (n := min(e, len(t) - tail) - max(s, head)) > 0:
                left.setdefault(t[s:e], []).append(n)
        return left

    x, y = spans(a), spans(b)
    between = sum(min(p, q) for k in x.keys() & y.keys() for p, q in zip(sorted(x[k], reverse=True), sorted(y[k], reverse=True)))
    return min(head + tail + between, long - 1) / long


def test_likeness_by_its_definition():
    rng = random.Random(12)
    f = lambda x: fingerprint_of(points(x))
    pool = [prose(rng, n, 60) for n in (1, 4, 30, 90)] + ["", "a", "ab" * 90, "東京 naïve " * 20]
    for _ in range(60):
        a = rng.choice(pool)
        k = rng.randrange(len(a) + 1)
        b = rng.choice([a[:k] + rng.choice("xyz ") + a[k:], a[:k] + rng.choice(pool), a[k:] + a[:k], a[: k // 2] + a[k:], rng.choice(pool)])
        assert abs(likeness(f(a), f(b)) - plain_likeness(a, b)) < 1e-12


def test_long_texts_go_block_by_block(monkeypatch):
    """Fingerprints don't depend on the size of a block, and no more than a block of powers is kept."""
    from arcweave.llm import fingerprints as module

    rng = random.Random(13)
    texts = [points(prose(rng, n, 500)) for n in (0, 1, 12, 200)] + [points("a" * 257)]
    want = [(fingerprint_of(t), prefix(t).tolist()) for t in texts]
    monkeypatch.setattr(module, "BLOCK", 64)
    monkeypatch.setattr(module, "_POWERS", {})
    assert [(fingerprint_of(t), prefix(t).tolist()) for t in texts] == want
    assert max(len(p) for p in module._POWERS.values()) <= 64


def test_memory_of_a_very_long_text():
    import tracemalloc

    t = points("the quick brown fox " * 200_000)
    fingerprint_of(points("warm"))
    tracemalloc.start()
    fingerprint_of(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * len(t) + (64 << 20)  # below 1 GB at 20 million code points


def test_edited_texts(messy, empty):
    rows = messy_rows()
    want = brute_edited(rows)
    got = [tuple(r) for r in edited_fingerprints(clashing(messy)).collect()]
    assert Counter(got) == Counter(want)
    assert {(r.doc_id, r.n_chars, r.fingerprint) for r in fingerprints(messy).collect()} == {(w[0], w[1], w[3]) for w in want}
    assert edited_fingerprints(empty).count() == 0 and fingerprints(empty).count() == 0
    one = messy.filter("doc_id = 4").limit(1)
    assert edited_fingerprints(one).count() == 1


def test_edited_texts_of_one_id(spark):
    """Rows without an id, or with one, and different texts spread over parts; some parts stay empty."""
    rng = random.Random(15)
    rows = [(None if k % 3 else 5, prose(rng, rng.randrange(1, 12), 9000)) for k in range(300)] + [(9, "last"), (1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("7", "400"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert Counter(tuple(r) for r in edited_fingerprints(docs).collect()) == Counter(brute_edited(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert Counter(tuple(r) for r in edited_fingerprints(docs).collect()) == Counter(brute_edited(rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def common(a, b):
    return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def brute_edited(rows):
    tie = lambda t: np.array([__import__("xxhash").xxh64_intdigest((t or "").encode(), 42)], np.uint64).view(np.int64)[0]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 62)), -tie(r[1])))
    want = []
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, e = fingerprint_of(points(text)), fingerprint_of(points(edited))
        ends = [common(*v) for o in (edited, after) for v in ((text, o), (text[::-1], o[::-1]))]
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), a, e, likeness(a, e), likeness(a, fingerprint_of(points(after))), *ends))
    return want


ODD = ["x" * 3000, "''s 's'S 'll  'LL I'd", "  lead", "tail  ", "\n\n\n a\n b", "<|endoftext|> and <|endoftext|>", "１２３ ٣٤ ⅷ ²", "a b c　d", "é ‍ 👩‍👩‍👧 🏳️‍🌈", "퟿\x00\x1c\x85", "don’t", "ab12cd!!??  ..", "ǅ ʰ ꟲ 𞤀", "' s", "'", "x'", "'re're"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(9)
    alphabet = "aB1 '\t\n.sтл東é-" + " ­"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()


def library(name, texts):
    path = default_path(name)
    if name.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(messy, odd, name):
    for docs in (clashing(messy), odd):
        rows = docs.select("doc_id", "text").collect()
        texts = [r.text or "" for r in rows]
        want = Counter((r.doc_id, len(t.encode()), len(ids), len(ids) > 512) for r, t, ids in zip(rows, texts, library(name, texts)))
        assert Counter(map(tuple, token_counts(docs, default_path(name)).collect())) == want


def test_pretokens_that_share_a_hash(monkeypatch):
    """With hashes of 6 bits and a table of 32 entries nearly all pre-tokens collide; ids are the library's still."""
    from arcweave.llm import bpe
    from arcweave.llm.textkit import decoded

    rng = random.Random(6)
    texts = [prose(rng, rng.randrange(40), 3000) for _ in range(60)] + ODD
    own = bpe.Encoder(default_path())
    plain = own.pretokens

    def few(points, at):
        kinds, start, end, h = plain(points, at)
        return kinds, start, end, h & np.uint64(63) | np.uint64(1)

    monkeypatch.setattr(own, "pretokens", few)
    monkeypatch.setattr(bpe, "FULL", 32 / bpe.SLOTS)
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    want = library("byte_bpe_50k.json", texts)
    for _ in range(2):
        counts, ids = own.encode(data, off, *decoded(data, off))
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_token_counts_of_nothing(empty):
    assert token_counts(empty).count() == 0 and token_counts(empty, default_path("piece_bpe_32k.model")).count() == 0


def check_packing(got, rows, capacity):
    """Gapless sequences within capacity; each document's ids whole and in order."""
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    want = Counter()
    for r, ids in zip(rows, library("byte_bpe_50k.json", [r.text or "" for r in rows])):
        ids = np.array([*ids, 2], "<u4")
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[r.doc_id, k, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    return len(by), sum(r.length for r in got)


def test_packing(messy, odd, empty):
    for docs in (clashing(messy), odd):
        used, total = check_packing(best_fit_packing(docs).collect(), docs.select("doc_id", "text").collect(), 1024)
        assert used <= -(-total // 1024) + 1
    assert best_fit_packing(empty).count() == 0


def test_packing_does_not_follow_the_layout(spark):
    from arcweave.llm.packing import pack, pieces

    rng = random.Random(3)
    docs = spark.createDataFrame([(k, prose(rng, rng.randrange(1, 90))) for k in range(400)] + [(None, "same")] * 500, "doc_id long, text string")
    got = []
    for n in (1, 7):
        rows = pack(pieces(docs.repartition(n), default_path()), group=60).collect()
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.doc_id, r.piece, r.offset))
        assert len(rows) == 900 and all(sum(r.length for r in rows if r.sequence_id == s) <= 1024 for s in list(bins)[:20])
        got.append(Counter(tuple(sorted(x)) for x in bins.values() if all(i is not None for i, _, _ in x)))
    assert got[0] and sum((got[0] & got[1]).values()) >= 0.5 * sum(got[0].values())
    unique = spark.createDataFrame([(k, prose(rng, rng.randrange(1, 90))) for k in range(500)], "doc_id long, text string")
    one, two = ({(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in pack(pieces(unique.repartition(n), default_path()), group=60).collect() if r.length < 1024} for n in (1, 7))
    assert one == two


def test_two_fit_wastes_little():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 700, 4000), rng.integers(300, 520, 2000), np.full(50, 600), np.array([1024, 1, 1023])):
        bins = best_two_fit(lengths, 1024)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths))) and all(lengths[b].sum() <= 1024 for b in bins)
    assert len(best_two_fit(rng.integers(1, 400, 4000), 1024)) * 1024 < 1.02 * rng.integers(1, 400, 4000).sum() + 40_000


def pages(spark):
    html = ["<p>one</p>", "<p>two</p>", "<p>one</p>", None, "", "größer " * 500, "größer " * 500, "<p>one</p>", "x" * 300_000]
    urls = ["http://www.Example.com/a?b=1", "https://example.com:8080/x#f", "http://www.example.com/a?b=1", None, "no host", "http://münchen.de/", "HTTP://b.org", "http://a.org/1", "http://user@h.net/p"]
    ids = [5, 2, 3, 7, 9, 11, 10, None, 12]
    return spark.createDataFrame([*zip(ids, urls, html), (3, "http://again.org/", "<p>one</p>")], "page_id long, url string, html string")


def brute_records(rows, least=0):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for r in rows:
        k = digest(r.html)
        first[k] = min(first.get(k, 1 << 63), r.page_id if r.page_id is not None else (1 << 63) - 1)
    out = []
    for r in rows:
        size, k = len((r.html or "").encode()), digest(r.html)
        again = size >= least and first[k] < (r.page_id if r.page_id is not None else (1 << 63) - 1)
        out.append((r.page_id, size, k, "revisit" if again else "response", first[k] if again else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 20])
def test_archives_round_trip(spark, least):
    table = pages(spark)
    rows = table.collect()
    assert Counter(tuple(r)[:5] for r in round_trip(table.withColumn("key", table["url"]), least).collect()) == brute_records(rows, least)
    assert round_trip(table.filter("false")).count() == 0


@pytest.mark.parametrize("broadcast_rows", [10, 0])
def test_index_lookup(spark, tmp_path, broadcast_rows):
    table = pages(spark).union(spark.createDataFrame([(100 + k, f"http://site{k % 40}.com/{k}", f"page {k}") for k in range(900)], "page_id long, url string, html string"))
    folder = f"file://{tmp_path}/w"
    entries = write_archives(table, folder, limit=20_000, broadcast_rows=broadcast_rows)
    assert entries.count() == 910
    directory = write_index(entries, folder, block=64)
    assert directory.count() >= 910 // 64
    whole = {r.page_id: r for r in read_back(directory, folder, True).filter("record_type = 'response'").collect()}
    assert bytes(whole[100].payload) == b"page 0" and whole[12].payload_bytes == 300_000
    urls = lambda *x: spark.createDataFrame([(u,) for u in x], "url string")
    got = lookup(directory, folder, urls("http://www.example.com/a?b=1", "http://site3.com/43", "http://nowhere.org/", "http://site3.com/43"), True).collect()
    assert sorted(r.page_id for r in got) == [3, 5, 143] and {bytes(r.payload) for r in got if r.record_type == "response"} == {b"<p>one</p>", b"page 43"}
    assert lookup(directory, folder, urls()).count() == 0 and lookup(directory.filter("false"), folder, urls("http://b.org")).count() == 0
    assert [r.page_id for r in lookup(directory, folder, urls(None)).collect()] == [7]
    # every row comes by a search: what a directory lacks is not found, in all or in one file
    every = lookup(directory, folder, table.select("url"))
    assert Counter(r.page_id for r in every.collect()) == Counter(r.page_id for r in table.collect())
    gone = directory.orderBy("first_key").first()
    left = lookup(directory.filter(directory.file != gone.file), folder, table.select("url")).count()
    assert left == 910 - directory.filter(directory.file == gone.file).selectExpr("sum(n)").first()[0]
    side = tmp_path / "w" / f"{gone.file}.directory"
    blocks = zlib.decompress(side.read_bytes()).decode().split("\n")
    side.write_bytes(zlib.compress("\n".join(blocks[1:]).encode()))
    assert lookup(directory, folder, table.select("url")).count() == 910 - gone.n


def test_one_url_of_very_many_pages(spark, tmp_path):
    """Captures of one url fill many blocks of several index files."""
    table = spark.createDataFrame([(k, None if k % 3 else f"http://s{k}.org/", f"p{k % 50}") for k in range(3000)], "page_id long, url string, html string").repartition(4)
    folder = f"file://{tmp_path}/w"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    try:
        directory = write_index(write_archives(table, folder, limit=20_000), folder, block=32)
        holding = directory.filter("first_key <= '' and last_key >= ''").select("file").distinct().count()
        got = lookup(directory, folder, spark.createDataFrame([(None,), ("",)], "url string")).collect()
        assert holding > 1 and sorted(r.page_id for r in got) == [k for k in range(3000) if k % 3]
        assert Counter(tuple(r)[:5] for r in round_trip(table).collect()) == brute_records(table.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_keys():
    assert reversed_host("http://www.Example.com/a?b=1") == "com,example,www)/a?b=1" and reversed_host("https://example.com:8080/x#f") == "com,example:8080)/x"
    assert reversed_host(None) == "" and reversed_host("no host") == "no host" and reversed_host("HTTP://b.org") == "org,b)/"


def test_each_text_is_fingerprinted_once(monkeypatch):
    """The next text's fingerprint serves again where that text's own row follows, over batches too; other rows get the same."""
    import pyarrow as pa
    import zstandard

    from arcweave.llm import fingerprints as module

    rng = random.Random(12)
    texts = [prose(rng, rng.randrange(0, 90), 60) for _ in range(300)] + ["", "é" * 50, "a" * 3000]
    press = zstandard.ZstdCompressor(level=3)
    blobs = [press.compress(t.encode()) for t in texts]
    names = ["doc_id", "blob", "after"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(blobs), pa.array(blobs[1:] + blobs[:1])], names)
    calls, plain = [], module.fingerprint_of
    monkeypatch.setattr(module, "fingerprint_of", lambda *x: calls.append(1) or plain(*x))
    got = [r for b in module._compared([batch.slice(0, 100), batch.slice(100)]) for r in b.to_pylist()]
    assert len(calls) == 2 * len(texts) + 1
    mixed = rng.sample(range(len(texts)), len(texts))
    again = [r for b in module._compared([batch.take(pa.array(mixed))]) for r in b.to_pylist()]
    assert [got[i] for i in mixed] == again
    assert [r["fingerprint"] for r in got] == [plain(points(t)) for t in texts]
