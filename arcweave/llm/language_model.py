"""A hashed maximum-entropy language model with a class-factored softmax, beside a smoothed unigram base.

Every word, known or not, belongs by its hash to one class and within it to one group:
P(word | context) = P(class | context) P(group | class, context) P(word | group), the last being the word's share of
the group in the base. The first two are softmaxes over sums of weight rows that hashed features of the context pick:
the word before, the word before that (a skip), the most frequent of the REACH words before (a longer skip, which
tells languages and subjects apart), and the first and the last of these together; within a class the first and the
third, hashed with the class. With all weights at 0 the model is the base.

On top of that stand trigram features of single words (`Follows`): a word that followed the same two words before has a
weight of its own, and P(word | context) is multiplied by its exponential and divided by what all words then sum to. That
sum is 1 plus a few terms, those of the words that have a weight there, so nothing is left out of it. Contexts of which
more than FOLLOW words are seen have no such features; they say little that the softmaxes don't.

Training goes in ROUNDS over a fixed split of the training rows by their ids. Each round is one job: tasks sum the
gradient (what was seen less what was expected) over their rows of that part, sums are dealt out by blocks of weight
rows and added up as they stream in, and each block takes a damped Newton step. Results follow the rows alone and
not how they lie in tasks. Weights of trigrams are one scaling step from the base over all training rows: counts,
less DISCOUNT, over what the base expects. Classes, groups and rows grow with the sixth root of the tokens, so the weights with the
cube root.

Counts of rare words and trigram weights grow with the corpus, so no task holds them all. Texts are dealt to blocks. A
block asks for what its own texts need, the counts first and then the counts of what follows each context: what it asks goes
to buckets, by the word's hash or by the context's, together with what its training texts add to the sums there, and the
answers come back to it. Texts are hashed once for that: they travel as ranks of the frequent words, which are broadcast,
and hashes of the rest, and so do the words in questions and answers. Weights are worked out where they are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.frames import cleared, crc_mod, shuffle_partitions, slices, table, written
from arcweave.llm.textkit import U, mix, words

#: Stands before a text's first word, for none of the most frequent words, and for a text's end.
BOS, NONE, END = U(0xB05B05B05B05B05B), U(0x0D0D0D0D0D0D0D0D), U(0x5EED0F0E0D0C0B0A)
#: Words with counts that are broadcast at most, the most frequent ones; counts of the rest are joined.
TOP = 1 << 17
#: Features of a class, and of a group within a class; words before that the frequent one is picked from.
WIDE, DEEP, REACH = 4, 2, 8
ROUNDS, RATE, PRIOR, STEP = 3, 0.5, 2.0, 3.0
#: Tokens handled at once, tokens whose gradient is summed at once, and weight rows of a block.
BATCH, SUMMED, BLOCK = 2048, 1 << 16, 512
#: Added to each count, as the base has it.
ALPHA = 0.1
LN10 = float(np.log(10))


#: Words that may follow a context with features of its own, and what is taken off each of their counts.
FOLLOW, DISCOUNT = 4, 0.5
#: Trigram features that are worked out at once.
PART = 1 << 16
#: Tokens of coded texts that are opened at once.
OPEN = 1 << 17
#: Tokens of a block of texts, and of a bucket of words or contexts, on average.
BLOCK_TOKENS, BUCKET_TOKENS = 1 << 18, 1 << 20


class Tokens:
    """The tokens of one slice, with an end after each text. Those that were opened have the ranks they were coded with."""

    rank: np.ndarray | None = None

    def __init__(self, data: np.ndarray, off: np.ndarray):
        w = words(data, off, True)
        n = len(w.lo)
        self.n = n
        self.counts = w.counts + 1
        self.hash = np.empty(len(w.hash) + n, np.uint64)
        self.doc = np.repeat(np.arange(n), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        end = np.zeros(len(self.hash), bool)
        end[self.first + w.counts] = True
        self.hash[end] = END
        self.hash[~end] = w.hash

    @classmethod
    def opened(cls, counts: np.ndarray, rank: np.ndarray, rare: np.ndarray, by_rank: np.ndarray) -> "Tokens":
        """Of texts of so many tokens, from their ranks and the hashes of those that have none."""
        t = cls.__new__(cls)
        t.n, t.counts, t.rank = len(counts), counts, rank
        t.hash = by_rank[rank]
        t.hash[rank == len(by_rank) - 1] = rare
        t.doc = np.repeat(np.arange(t.n), counts)
        t.first = np.cumsum(counts) - counts
        return t


class Cells:
    """Finds values among sorted ones that spread evenly, as hashes do: their first bits tell where to look."""

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, len(keys).bit_length() + 2
        self.shift = keys.dtype.type(8 * keys.itemsize - bits)
        self.lo = np.append(0, np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits))).astype(np.int32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each is there, where)."""
        if not len(self.keys):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int32)
        last = len(self.keys) - 1
        at = np.minimum(self.lo[(h >> self.shift).astype(np.int64)], last)
        low = np.flatnonzero((self.keys[at] < h) & (at < last))
        while len(low):
            at[low] += 1
            low = low[(self.keys[at[low]] < h[low]) & (at[low] < last)]
        return self.keys[at] == h, at


def shape(total: float) -> tuple[int, int]:
    """(classes, which is also groups in each; weight rows of each feature) for so many training tokens."""
    root = max(total, 1.0) ** (1 / 6)
    return 16 + int(0.75 * root), 1024 * max(4, round(root))


def groups_of(h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word, and its group in it."""
    x = mix(h + U(77))
    return (x % U(k)).astype(np.int64), ((x >> U(32)) % U(k)).astype(np.int64)


def contexts(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """The word before each token and the word before that."""
    h, n = t.hash, len(t.hash)
    place = np.arange(n) - t.first[t.doc]
    return np.where(place > 0, np.append(BOS, h[:-1])[:n], BOS), np.where(place > 1, np.append([BOS, BOS], h[:-2])[:n], BOS)


def context_hash(before: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """32 bits of the two words before."""
    return (mix(before * U(0xD1342543DE82EF95) + mix(skip + U(91))) >> U(32)).astype(np.uint32)


def short(h: np.ndarray) -> np.ndarray:
    """32 bits of a word's hash."""
    return (h >> U(32)).astype(np.uint32)


class Follows:
    """Weights of words after contexts, sorted by context: at most FOLLOW a context."""

    def __init__(self, context: np.ndarray, word: np.ndarray, place: np.ndarray, share: np.ndarray, weight: np.ndarray):
        self.context, self.word, self.place, self.share, self.weight = context, word, place, share, weight
        self.first = heads(context)
        self.cells = Cells(context[self.first])
        self.many = np.diff(np.append(self.first, len(context)))

    def find(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first entry, number of entries) of each context."""
        if not len(self.context):
            return np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        hit, at = self.cells.find(context)
        return self.first[at], np.where(hit, self.many[at], 0)

    @classmethod
    def none(cls) -> "Follows":
        return cls(np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, np.uint16), np.zeros(0, np.float32), np.zeros(0, np.float32))

    @classmethod
    def fitted(cls, context: np.ndarray, h: np.ndarray, c: np.ndarray, words: np.ndarray, mass: np.ndarray) -> "Follows":
        """From entries (context, word hash, count) by context, the words' counts in all training rows, and the base's mass by
        class and group."""
        k, group = groups_of(h, len(mass))
        return cls.placed(context, short(h), (k * len(mass) + group).astype(np.uint16), c, words, mass)

    @classmethod
    def placed(cls, context: np.ndarray, word: np.ndarray, place: np.ndarray, c: np.ndarray, words: np.ndarray, mass: np.ndarray) -> "Follows":
        """As fitted(), from the words' short hashes and their places: class and group in one. Contexts are worked out a
        PART at a time."""
        n = len(context)
        share, weight = np.empty(n, np.float32), np.empty(n, np.float32)
        total, lo = mass.sum(), 0
        while lo < n:
            hi = int(np.searchsorted(context, context[min(lo + PART, n) - 1], "right"))
            part = slice(lo, hi)
            own, seen = words[part] + ALPHA, c[part].astype(np.float64)
            cut = np.flatnonzero(np.append(True, context[part][1:] != context[part][:-1]))
            size = np.diff(np.append(cut, hi - lo))
            base = own / total
            aim = (seen - DISCOUNT) / np.repeat(np.add.reduceat(seen, cut), size)  # what the words of a context are to have
            rest = lambda x: np.repeat(1 - np.add.reduceat(x, cut), size)  # noqa: B023, E731
            share[part], weight[part] = np.log(own / mass.flat[place[part]]), np.log(aim / base * rest(base) / rest(aim))
            lo = hi
        return cls(context, word, place, share, weight)

    @property
    def parts(self) -> tuple:
        return self.context, self.word, self.place, self.share, self.weight


class Model:
    """Sorted hashes of the frequent words with their ranks, log shares of classes and groups, and one table of weights."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, bias: np.ndarray, inner: np.ndarray, weights: np.ndarray, follows: Follows | None = None):
        self.follows = Follows.none() if follows is None else follows
        self.keys, self.ranks, self.bias, self.inner, self.weights = keys, ranks, bias, inner, weights
        self.by_rank = np.append(np.zeros(len(keys), np.uint64), NONE)
        self.by_rank[ranks] = keys
        self.cells = Cells(keys)
        self.rows, self.k = len(weights) // (WIDE + DEEP), weights.shape[1]
        self.ones = np.ones(self.k, np.float32)

    @classmethod
    def start(cls, keys: np.ndarray, counts: np.ndarray, seen: np.ndarray, kinds: np.ndarray, total: float) -> "Model":
        """From hashes and counts of frequent words, tokens and distinct words of each group, and the count of all tokens."""
        k, rows = shape(total)
        mass = seen + ALPHA * kinds + ALPHA / (k * k)
        order = np.argsort(keys)
        ranks = np.empty(len(keys), np.int64)
        ranks[np.lexsort((keys, -counts))] = np.arange(len(keys))
        share = mass.sum(1)
        return cls(keys[order], ranks[order], np.log(share / share.sum()).astype(np.float32), np.log(mass / share[:, None]).astype(np.float32), np.zeros(((WIDE + DEEP) * rows, k), np.float32))

    def features(self, t: Tokens, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class, group, rows of weights of the class, and of the group) of each token."""
        before, skip = contexts(t)
        k, group = groups_of(t.hash, self.k)
        own = U(self.rows)
        both = mix(before * U(0x9E3779B97F4A7C15) + mix(often))
        wide = [mix(x + U(i)) % own + U(i) * own for i, x in enumerate((before, skip, often, both))]
        return k, group, np.stack(wide).astype(np.int64), self.deep(before, often, k)

    def deep(self, before: np.ndarray, often: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Rows of weights of a group within class k."""
        own = U(self.rows)
        return np.stack([mix(mix(x + U(50 + i)) + k.astype(U)) % own + U(WIDE + i) * own for i, x in enumerate((before, often))]).astype(np.int64)

    def rank(self, t: Tokens) -> np.ndarray:
        """The rank of each token, that after the last one for words that are not frequent."""
        if t.rank is not None:
            return t.rank
        hit, at = self.cells.find(t.hash)
        out = np.full(len(at), len(self.keys), np.int32)
        out[hit] = self.ranks[at[hit]]
        return out

    def often(self, t: Tokens) -> np.ndarray:
        """The most frequent of the REACH words before each token."""
        n = len(t.hash)
        place = np.arange(n) - t.first[t.doc]
        rank = self.rank(t)
        # later texts have lower numbers, so the least of a run belongs to the text at its end
        level = t.doc * np.int64(1 << 20)
        low, width = rank - level, 1
        while width < REACH:
            low = np.append(low[:width], np.minimum(low[width:], low[:-width]))
            width *= 2
        near = np.append(0, low[:-1])[:n] + level
        return np.where(place > 0, self.by_rank[np.where(place > 0, near, 0)], BOS)

    def shares(self, rows: np.ndarray, bias: np.ndarray) -> np.ndarray:
        """Softmax of the biases and the sum of these rows of weights, for each token."""
        z = self.weights.take(rows[0], 0)
        for r in rows[1:]:
            z += self.weights.take(r, 0)
        z += bias
        np.exp(z, out=z)  # weights are bounded by ROUNDS * STEP, so nothing overflows
        z /= (z @ self.ones)[:, None]
        return z

    def parts(self, t: Tokens, often: np.ndarray):
        """For each BATCH of tokens and each of the two softmaxes: (slice, shares, rows of weights, what was taken)."""
        k, group, wide, deep = self.features(t, often)
        for s in range(0, len(k), BATCH):
            part = slice(s, s + BATCH)
            yield part, self.shares(wide[:, part], self.bias), wide[:, part], k[part]
            yield part, self.shares(deep[:, part], self.inner[k[part]]), deep[:, part], group[part]

    def gains(self, t: Tokens) -> np.ndarray:
        """log10 of each token's probability less that of its base."""
        k, group = groups_of(t.hash, self.k)
        out = -(self.bias[k] + self.inner[k, group]).astype(np.float64)
        before, skip = contexts(t)
        context, own = context_hash(before, skip), self.follows
        lo, size = own.find(context)
        often = self.often(t)
        wide = None
        for step, (part, p, _, taken) in enumerate(self.parts(t, often)):
            out[part] += np.log(p[np.arange(len(taken)), taken])
            if step % 2 == 0:
                wide = p
                continue
            if not (some := np.flatnonzero(size[part])).size:
                continue
            # the words that have a weight here: what the softmaxes give each, and what the weights add to the sum
            many = size[part][some]
            at, first = np.repeat(some, many), np.cumsum(many) - many
            entry = np.repeat(lo[part][some] - first, many) + np.arange(len(at))
            c, g = np.divmod(own.place[entry].astype(np.int64), self.k)
            within = p[at, g]  # that of the token's own class
            other = np.flatnonzero(c != k[part][at])
            if len(other):
                x, y = at[other], c[other]
                within[other] = self.shares(self.deep(before[part][x], often[part][x], y), self.inner[y])[np.arange(len(x)), g[other]]
            each = wide[at, c].astype(np.float64) * within * np.exp(own.share[entry].astype(np.float64))
            weight = own.weight[entry].astype(np.float64)
            more = np.bincount(at, each * np.expm1(weight), len(taken))
            hit = own.word[entry] == short(t.hash[part][at])
            out[part] += np.bincount(at[hit], weight[hit], len(taken)) - np.log1p(more)
        return out / LN10


class Gradient:
    """Sums over tokens, for each row of weights: what was seen less what was expected, and how often the row was used."""

    def __init__(self, model: Model):
        self.model = model
        self.sums, self.used = np.zeros(model.weights.shape), np.zeros(len(model.weights))

    def add(self, t: Tokens) -> None:
        k, group, wide, deep = self.model.features(t, self.model.often(t))
        for s in range(0, len(k), SUMMED):
            part = slice(s, s + SUMMED)
            self.take(k[part], wide[:, part], None)
            self.take(group[part], deep[:, part], k[part])

    def take(self, taken: np.ndarray, each: np.ndarray, within: np.ndarray | None) -> None:
        """Of one of the two softmaxes: that over classes, or those over groups within these classes."""
        model, rows = self.model, self.model.rows
        small = np.uint16 if rows <= 1 << 16 else np.uint32
        p = np.empty((len(taken), model.k), np.float32)
        for s in range(0, len(taken), BATCH):
            part = slice(s, s + BATCH)
            p[part] = model.shares(each[:, part], model.bias if within is None else model.inner[within[part]])
        p[np.arange(len(taken)), taken] -= 1
        for r in each:
            base = int(r[0]) // rows * rows
            local = (r - base).astype(small)
            order = np.argsort(local, kind="stable")
            local = local[order]
            cut = heads(local)
            own, size = local[cut].astype(np.int64) + base, np.diff(np.append(cut, len(local)))
            got = np.zeros((len(cut), model.k), np.float32)
            for j in range(int(size.max()).bit_length()):  # runs in pieces of 1, 2, 4, ... tokens, which are summed together
                if len(has := np.flatnonzero(size >> j & 1)):
                    at = (cut[has] + (size[has] & ((1 << j) - 1)))[:, None] + np.arange(1 << j)
                    piece = p.take(order[at], 0)
                    got[has] += piece.reshape(len(has), -1, min(1 << j, 64), model.k).sum(2).sum(1) if j else piece[:, 0]
            self.sums[own] -= got
            self.used[own] += size

    def blocks(self):
        """(number, float32 rows of sums and uses) of each block of weight rows that was used."""
        for b in range(0, len(self.used), BLOCK):
            part = slice(b, b + BLOCK)
            if self.used[part].any():
                yield b // BLOCK, np.column_stack([self.sums[part], self.used[part]]).astype(np.float32)


def newton(weights: np.ndarray, used: np.ndarray, gradient: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A damped step of these rows: the gradient over the curvature that uses so far and the present shares give."""
    q = np.exp(weights + bias)
    q /= q.sum(1, keepdims=True)
    x = gradient / (used[:, None] * q + PRIOR)
    return (weights + np.clip(RATE * np.log1p(np.maximum(x, -0.95)), -STEP, STEP)).astype(np.float32)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token hash occurs, added up in each Arrow batch first. Null texts are their end alone."""

    def run(batches):
        for b in batches:
            found = [Tokens(data, off).hash for _, _, data, off in slices(b)]
            if found:
                h, c = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def group_sums(counts: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, distinct words) of each class and group: k * k numbers reach the driver."""

    def run(batches):
        seen, kinds = np.zeros(k * k), np.zeros(k * k)
        for b in batches:
            c, g = groups_of(b.column(0).to_numpy().view(U), k)
            seen += np.bincount(c * k + g, b.column(1).to_numpy(), k * k)
            kinds += np.bincount(c * k + g, minlength=k * k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(seen), pa.array(kinds)], ["g", "seen", "kinds"])

    got = counts.mapInArrow(run, "g long, seen double, kinds double").groupBy("g").agg(F.sum("seen").alias("seen"), F.sum("kinds").alias("kinds")).toPandas()
    out = np.zeros((2, k * k))
    out[:, got.g] = got.seen, got.kinds
    return out[0].reshape(k, k), out[1].reshape(k, k)


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of all words that occur so often that at most `most` do."""
    level = F.floor(F.log2("c") * 64)  # a histogram of a few thousand levels finds where to cut
    have = sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, cut = 0, None
    for r in have:
        total += r["count"]
        if total > most:
            break
        cut = r.level
    got = (counts.filter(level >= cut) if cut is not None else counts.limit(0)).toPandas()
    return got.h.to_numpy(np.int64).view(U), got.c.to_numpy(np.float64)


def follow_counts(docs: DataFrame, below: int) -> DataFrame:
    """(context, h, c) of all contexts with a hash under `below` that at most FOLLOW words follow: how often each does.

    Added up in each Arrow batch first; a context that more words follow within a batch sends one row without a word,
    so one that is in a third of all texts sends a few rows for each batch."""

    def run(batches):
        for b in batches:
            found = []
            for _, _, data, off in slices(b):
                t = Tokens(data, off)
                context = context_hash(*contexts(t))
                own = context < below
                found.append((context[own], t.hash[own]))
            if not found:
                continue
            context, h = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((h, context))
            context, h = context[order], h[order]
            cut = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            c = np.diff(np.append(cut, len(h)))
            context, h = context[cut], h[cut]
            head = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(h) else cut
            size = np.diff(np.append(head, len(h)))
            crowded = np.repeat(size > FOLLOW, size)
            keep = ~crowded
            keep[head] = True
            word = pa.array(h[keep].view(np.int64), mask=crowded[keep])
            yield pa.RecordBatch.from_arrays([pa.array(context[keep].astype(np.int64)), word, pa.array(c[keep].astype(np.int64))], ["context", "h", "c"])

    pairs = docs.select("text").mapInArrow(run, "context long, h long, c long").groupBy("context", "h").agg(F.sum("c").alias("c"))
    pairs = written(pairs)
    few = pairs.groupBy("context").agg(F.sum(F.when(F.col("h").isNull(), FOLLOW + 1).otherwise(1)).alias("n")).filter(F.col("n") <= FOLLOW)
    return pairs.join(few.select("context"), "context", "left_semi")


def follows(docs: DataFrame, counts: DataFrame, total: float, mass: np.ndarray, most: int | None = None) -> Follows:
    """The trigram features of the rows of `docs`, given the counts (h, c) of their words, all in the driver; where `most` is
    given only the contexts of the smallest hashes, with that many entries at most. scores() has all contexts and gathers
    none. Null and empty texts have their end alone; repeated rows count again."""
    below = 2**32 if most is None else int(2**32 * min(1.0, most / max(total, 1.0)))
    entries = written(follow_counts(docs, below))
    while most is not None and (n := entries.filter(F.col("context") < below).count()) > most:
        below = int(below * 0.9 * most / n)
    entries = entries.filter(F.col("context") < below)
    named = entries.select("h").distinct().join(counts, "h").toArrow()
    known, often = named.column("h").to_numpy(), named.column("c").to_numpy()
    order = np.argsort(known)
    known, often = known[order], often[order].astype(np.float64)
    got = entries.select("context", "h", "c").toArrow()
    context, h, c = (got.column(x).to_numpy() for x in got.column_names)
    del got, named
    order = np.lexsort((h, context))
    context, h, c = context[order].astype(np.uint32), h[order], c[order].astype(np.float32)
    words = often[np.searchsorted(known, h)] if len(h) else np.zeros(0)
    return Follows.fitted(context, h.view(U), c, words, mass)


def train(docs: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """`rounds` gradient steps, each over the rows of `docs` (doc_id, text) that fall to it by a hash of their id.

    Tasks are two for each core at most, so that the sums that travel follow the cluster and not the input. The
    driver gets the new weights of each round and nothing else. Null and empty texts are their end alone; rows of one id,
    null included, fall to one round; repeated rows count again; without rows the model stays as it is."""
    spark = docs.sparkSession
    sc, n = spark.sparkContext, shuffle_partitions(spark)
    used = np.zeros(len(model.weights))
    # log share of each group over all classes: where a row that several classes may share starts
    mean = np.log(np.exp(model.inner.astype(np.float64) + model.bias[:, None]).sum(0))
    for r in range(rounds):
        shared = sc.broadcast((model.keys, model.ranks, model.bias, model.inner, model.weights, used))

        def summed(batches):
            own = Gradient(Model(*shared.value[:5]))  # noqa: B023
            for b in batches:
                for _, _, data, off in slices(b):
                    own.add(Tokens(data, off))
            for block, part in own.blocks():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["block", "part"])

        def stepped(batches):
            _, _, bias, _, weights, used = shared.value  # noqa: B023
            rows, width = len(weights) // (WIDE + DEEP), weights.shape[1]
            total: dict[int, np.ndarray] = {}
            for b in batches:
                for block, part in zip(b.column(0).to_pylist(), b.column(1)):
                    own = np.frombuffer(part.as_buffer(), np.float32).reshape(-1, width + 1)
                    total[block] = total[block] + own if block in total else own.astype(np.float64)
            for block, own in total.items():
                part = slice(block * BLOCK, block * BLOCK + len(own))
                wide = (np.arange(part.start, part.stop) < WIDE * rows)[:, None]
                count = used[part] + own[:, -1]
                new = newton(weights[part], count, own[:, :-1], np.where(wide, bias, mean))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([new.tobytes()], pa.binary()), pa.array([count.tobytes()], pa.binary())], ["block", "weights", "used"])

        part = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text")
        sums = part.coalesce(2 * sc.defaultParallelism).mapInArrow(summed, "block int, part binary")
        got = sums.repartition(n, "block").mapInArrow(stepped, "block int, weights binary, used binary").toPandas()
        weights, used = model.weights.copy(), used.copy()
        for block, w, u in got.itertuples(index=False):
            own = np.frombuffer(u, np.float64)
            part = slice(block * BLOCK, block * BLOCK + len(own))
            used[part] = own
            weights[part] = np.frombuffer(w, np.float32).reshape(len(own), -1)
        model = Model(model.keys, model.ranks, model.bias, model.inner, weights, model.follows)
        shared.destroy()
    return model


def packed(*columns: np.ndarray) -> bytes:
    """Arrays of one length as one blob: the first bytes of all values, then the second ones, which compresses well."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns))


def unpacked(blobs: list[bytes], *types) -> tuple[np.ndarray, list[np.ndarray]]:
    """(length of each blob's columns, columns of all blobs, one after the other)."""
    wide, press = [np.dtype(t).itemsize for t in types], zstandard.ZstdDecompressor()
    out: list[list[np.ndarray]] = [[np.zeros(0, t)] for t in types]
    size = np.zeros(len(blobs), np.int64)
    for i, blob in enumerate(blobs):
        raw = np.frombuffer(press.decompress(blob), np.uint8)
        n, at = len(raw) // sum(wide), 0
        for x, t, w in zip(out, types, wide):
            x.append(raw[at : at + n * w].reshape(w, n).T.copy().view(t).reshape(n))
            at += n * w
        size[i] = n
    return size, [np.concatenate(x) for x in out]


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of a sorted uint32 array."""
    return np.diff(x, prepend=np.uint32(0))


def summed_steps(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What several steps(), of these lengths, came from."""
    out = np.cumsum(x, dtype=np.int64)
    first = np.cumsum(size) - size
    return (out - np.repeat(np.append(0, out)[first], size)).astype(np.uint32)


def heads(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class Exchange:
    """What blocks of texts and buckets of words or contexts do with one another. A block lists what it wants in an order
    that its texts alone fix, and answers keep to it, so that they need not name what they are for."""

    CODED = "block int, doc_id long, held_out boolean, ranks binary, rare binary"
    #: `rare` is of the words that have no rank.
    ASKED, ANSWER = "bucket int, block int, blob binary, rare binary", "block int, bucket int, kind int, blob binary, rare binary"
    #: Kinds of answers: counts of rare words; how many words follow each context; these words with their counts there.
    COUNTS, MANY, WORDS = range(3)
    #: In place of how many follow: one word, and this block alone has it there, once.
    ALONE = 255

    def __init__(self, shared, mass: np.ndarray, n: int, v: int):
        """`shared` is broadcast: counts of the frequent words by rank and a model's parts; n and v count training tokens and
        words."""
        self.shared, self.mass, self.n, self.base = shared, mass, n, float(np.log10(n + ALPHA * (v + 1)))
        self.buckets = 1 + n // BUCKET_TOKENS
        self.ready: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"ready": None}

    def made(self) -> tuple[Model, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The model; and by rank (0 after the last) the frequent words' short hashes, places and counts."""
        if self.ready is None:
            model = Model(*self.shared.value[1:])
            own = model.by_rank[:-1]
            self.ready = model, tuple(np.append(x, np.zeros(1, x.dtype)) for x in (short(own), self.place(own), self.shared.value[0].astype(np.uint32)))
        return self.ready

    @property
    def model(self) -> Model:
        return self.made()[0]

    def place(self, h: np.ndarray) -> np.ndarray:
        k, group = groups_of(h, len(self.mass))
        return (k * len(self.mass) + group).astype(np.uint16)

    def code(self, batches):
        """mapInArrow: (block, doc_id, held_out, text) as CODED."""
        top = len(self.model.keys)
        for b in batches:
            for lo, hi, data, off in slices(b):
                t = Tokens(data, off)
                rank = self.model.rank(t).astype(np.uint32)
                ranks = [packed(rank[i : i + n]) for i, n in zip(t.first.tolist(), t.counts.tolist())]
                rare = np.flatnonzero(rank == top)
                edge = np.searchsorted(rare, np.append(t.first, len(rank))).tolist()
                hashes = t.hash[rare]
                rest = [hashes[i:j].tobytes() for i, j in zip(edge, edge[1:])]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(ranks, pa.binary()), pa.array(rest, pa.binary())], [x.split()[0] for x in self.CODED.split(", ")])

    def tokens(self, texts: pa.Table) -> list[tuple[pa.RecordBatch, Tokens, np.ndarray]]:
        """(rows, tokens, whether each is of a training row) of the coded texts of a block, about OPEN tokens at a time."""
        out = []
        for b in texts.combine_chunks().to_batches():
            train = ~b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            counts, (rank,) = unpacked(b.column(3).to_pylist(), np.uint32)
            rank, by_rank = rank.astype(np.int32), self.model.by_rank
            rare, end = np.frombuffer(b"".join(b.column(4).to_pylist()), U), np.cumsum(counts)
            seen = np.append(0, np.cumsum(rank == len(by_rank) - 1))
            lo = 0
            while lo < len(counts):
                first = int(end[lo] - counts[lo])
                hi = max(lo + 1, int(np.searchsorted(end, first + OPEN, "right")))
                t = Tokens.opened(counts[lo:hi], rank[first : end[hi - 1]], rare[seen[first] : seen[end[hi - 1]]], by_rank)
                out.append((b.slice(lo, hi - lo), t, train[lo:hi][t.doc]))
                lo = hi
        return out

    @staticmethod
    def rows(schema: str, *columns) -> pa.Table:
        fields = [x.split() for x in schema.split(", ")]
        return pa.table([pa.array(x, pa.binary() if kind == "binary" else pa.int32()) for x, (_, kind) in zip(columns, fields)], [name for name, _ in fields])

    def named(self, rank: np.ndarray, rare: list[np.ndarray]) -> list[np.ndarray]:
        """(short hash, place, count) of words by their ranks, and for those without one from `rare`, in their order."""
        without, out = rank == len(self.model.keys), []
        for of, x in zip(self.made()[1], rare):
            out.append(of[rank])
            out[-1][without] = x
        return out

    @staticmethod
    def answers(got: pa.Table, kind: int, *types) -> tuple[list[np.ndarray], list[bytes]]:
        """Those of a kind, and what comes with them of rare words, in the order of their buckets."""
        own = sorted((k, b, r) for k, of, b, r in zip(*(got.column(x).to_pylist() for x in ("bucket", "kind", "blob", "rare"))) if of == kind)
        return unpacked([b for _, b, _ in own], *types)[1], [r for _, _, r in own]

    def asked(self, texts: pa.Table, to: np.ndarray, *blobs) -> pa.Table:
        """A row for each bucket that rows go to, which are sorted by it; each of blobs makes one from a slice."""
        edge = np.searchsorted(to, np.arange(self.buckets + 1))
        some = np.flatnonzero(np.diff(edge)).tolist()
        return self.rows(self.ASKED, some, [texts.column("block")[0].as_py()] * len(some), *([blob(slice(edge[i], edge[i + 1])) for i in some] for blob in blobs))

    def rare(self, tokens: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, hash, tokens in training rows) of the rare words of a block, by bucket and hash."""
        found, fit = [], []
        for _, t, train in tokens:
            rare = t.rank == len(self.model.keys)
            found.append(t.hash[rare])
            fit.append(train[rare])
        h, inv = np.unique(np.concatenate(found), return_inverse=True)
        times = np.bincount(inv, np.concatenate(fit), len(h)).astype(np.uint32)
        to = (mix(h + U(5)) % U(self.buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        return to[order], h[order], times[order]

    def counter(self, got: pa.Table, tokens: list):
        """A function that gives words' counts by hash and rank, from the answers for the rare ones; and these answers."""
        _, rare, _ = self.rare(tokens)
        ((c,), _), often = self.answers(got, self.COUNTS, np.uint32), self.made()[1][2]
        order = np.argsort(rare)
        keys, counts = rare[order], c[order]

        def count(h: np.ndarray, rank: np.ndarray) -> np.ndarray:
            out = often[rank]
            if len(keys):
                without = rank == len(often) - 1
                out[without] = counts[np.searchsorted(keys, h[without])]
            return out

        return count, c

    @staticmethod
    def wanted(tokens: list) -> list[np.ndarray]:
        """The contexts of a block with the words that follow them in its training rows: (context, word, rank, times here), by
        context and word. A context of other rows alone has one row, with 0 times."""
        context, h, rank, train = (np.concatenate(x) for x in zip(*((context_hash(*contexts(t)), t.hash, t.rank, train) for _, t, train in tokens)))
        key, first, times = np.unique(context[train].astype(U) << U(32) | short(h[train]).astype(U), return_index=True, return_counts=True)
        own = (key >> U(32)).astype(np.uint32)
        more = np.unique(context[~train])
        more = more[~Cells(own[heads(own)]).find(more)[0]]
        context = np.append(own, more)
        order = np.argsort(context, kind="stable")
        return [context[order], *(np.append(x, np.zeros(len(more), x.dtype))[order] for x in (h[train][first], rank[train][first], times.astype(np.uint32)))]

    def ask_counts(self, texts: pa.Table) -> pa.Table:
        to, h, times = self.rare(self.tokens(texts))
        return self.asked(texts, to, lambda part: packed(h[part], times[part]), lambda part: b"")

    def answer_counts(self, asked: pa.Table) -> pa.Table:
        """Counts in all training rows."""
        size, (h, times) = unpacked(asked.column("blob").to_pylist(), U, np.uint32)
        _, inv = np.unique(h, return_inverse=True)
        c, end = np.bincount(inv, times)[inv].astype(np.uint32), np.cumsum(size)
        return self.rows(self.ANSWER, asked.column("block"), asked.column("bucket"), [self.COUNTS] * len(size), [packed(c[i - n : i]) for i, n in zip(end, size)], [b""] * len(size))

    def ask_words(self, got: pa.Table, texts: pa.Table) -> pa.Table:
        """What is wanted, and in a row of its own, under a number below 0, the counts that came."""
        tokens = self.tokens(texts)
        count, rare = self.counter(got, tokens)
        context, h, rank, times = self.wanted(tokens)
        to = (context.astype(U) * U(self.buckets) >> U(32)).astype(np.int64)

        def without(part: slice) -> bytes:
            own = h[part][rank[part] == len(self.model.keys)]
            return packed(short(own), self.place(own), count(own, np.full(len(own), len(self.model.keys))))

        out = self.asked(texts, to, lambda part: packed(steps(context[part]), rank[part], times[part]), without)
        block = texts.column("block")[0].as_py()
        return pa.concat_tables([out, self.rows(self.ASKED, [-1 - block], [block], [packed(rare)], [b""])])

    def answer_words(self, asked: pa.Table) -> pa.Table:
        """For each context that at most FOLLOW words follow in all training rows, these words and how often each does."""
        blocks, buckets, blobs, rest = (asked.column(x).to_pylist() for x in ("block", "bucket", "blob", "rare"))
        if buckets[0] < 0:
            return self.rows(self.ANSWER, blocks, buckets, [self.COUNTS] * len(blobs), blobs, rest)
        size, (delta, rank, times) = unpacked(blobs, np.uint32, np.int32, np.uint32)
        word, place, own = self.named(rank, unpacked(rest, np.uint32, np.uint16, np.uint32)[1])
        context, sender = summed_steps(delta, size), np.repeat(np.arange(len(size)), size)
        seen = np.flatnonzero(times)
        key = context[seen].astype(U) << U(32) | word[seen].astype(U)
        order = np.argsort(key)
        seen, cut = seen[order], heads(key[order])
        c = np.add.reduceat(times[seen].astype(np.int64), cut) if len(cut) else cut
        seen = seen[cut]
        many = np.diff(np.append(heads(context[seen]), len(seen)))
        many = np.repeat(many, many)
        once = ((many == 1) & (c == 1))[many <= FOLLOW]
        seen, c = seen[many <= FOLLOW], c[many <= FOLLOW].astype(np.uint32)
        new = heads(sender, context)
        wanted, sender, times = context[new], sender[new], times[new]
        lo = np.searchsorted(context[seen], wanted)
        many = np.searchsorted(context[seen], wanted, "right") - lo
        alone = (times == 1) & (many == 1)
        alone[alone] = once[lo[alone]]
        code, many = np.where(alone, self.ALONE, many).astype(np.uint8), np.where(alone, 0, many)
        entry = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
        rows, ends = (np.searchsorted(x, np.arange(len(size) + 1)) for x in (sender, np.repeat(sender, many)))
        first, second, third, top = [], [], [], len(self.model.keys)
        for i in range(len(size)):
            first.append(packed(code[rows[i] : rows[i + 1]]))
            part = entry[ends[i] : ends[i + 1]]
            second.append(packed(rank[seen[part]], c[part]))
            without = seen[part[rank[seen[part]] == top]]
            third.append(packed(word[without], place[without], own[without]))
        return self.rows(self.ANSWER, blocks * 2, buckets * 2, [self.MANY] * len(size) + [self.WORDS] * len(size), first + second, [b""] * len(size) + third)

    def score(self, got: pa.Table, texts: pa.Table) -> pa.Table:
        """The texts of a block, scored with the counts and words that came for it."""
        tokens = self.tokens(texts)
        count, _ = self.counter(got, tokens)
        context, h, rank, _ = self.wanted(tokens)
        (code,), _ = self.answers(got, self.MANY, np.uint8)
        first = heads(context)
        many = np.where(code == self.ALONE, 1, code)
        alone, mine = np.repeat(code == self.ALONE, many), first[code == self.ALONE]
        (ranks, c), rest = self.answers(got, self.WORDS, np.int32, np.uint32)
        columns = []
        for x, y in zip((*self.named(ranks, unpacked(rest, np.uint32, np.uint16, np.uint32)[1]), c), (short(h[mine]), self.place(h[mine]), count(h[mine], rank[mine]), 1)):
            both = np.empty(len(alone), x.dtype)
            both[alone], both[~alone] = y, x
            columns.append(both)
        word, place, own, c = columns
        self.model.follows = Follows.placed(np.repeat(context[first], many), word, place, c, own.astype(np.float64), self.mass)
        out = []
        for b, t, _ in tokens:
            c = count(t.hash, t.rank)
            add = lambda x: np.bincount(t.doc, x, t.n)  # noqa: B023, E731
            base = add(np.log10(c + ALPHA) - self.base)
            got = t.counts.astype(np.int64), add(c > 0).astype(np.int64), np.full(t.n, self.n), base, base + add(self.model.gains(t))
            out.append(pa.table([b.column(1), b.column(2), *map(pa.array, got)], [x.split()[0] for x in SCORED.split(", ")]))
        return pa.concat_tables(out)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, mod: int = 10, held: int = 0, top: int = TOP) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of `docs`.

    Learns from the rows whose crc32(doc_id) modulo `mod` is not `held`. Null and empty texts are the end
    alone; null ids count as the empty id; repeated rows are counted and scored one by one; an empty table
    gives an empty result; other columns are left out. Without training texts nothing is known, all tokens have one
    smoothed share, and score is base_score. Texts are read whole."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod("doc_id", mod) == held).alias("held_out"), "text")
    fit = rows.filter(~F.col("held_out"))
    with cleared(spark):
        counts = written(word_counts(fit))
        n, v = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*")).first())
        keys, c = frequent(counts, top)
        k, _ = shape(n)
        seen, kinds = group_sums(counts, k)
        model = train(fit, Model.start(keys, c, seen, kinds, float(n)))
    often = np.empty(len(keys))
    often[model.ranks] = c[np.argsort(keys)]
    shared = spark.sparkContext.broadcast((often, model.keys, model.ranks, model.bias, model.inner, model.weights))
    own = Exchange(shared, seen + ALPHA * kinds + ALPHA / (k * k), n, v)
    # blocks by the rows' own content, so all readings deal alike and share the exchange of the texts
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + n // BLOCK_TOKENS)).cast("int")
    texts = rows.select(block.alias("block"), "doc_id", "held_out", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(own.code, own.CODED)
    texts = texts.repartition(shuffle_partitions(spark), "block")
    each = texts.groupBy("block")
    # plain functions, whose arguments Spark counts
    got = each.applyInArrow(lambda x: own.ask_counts(x), own.ASKED).groupBy("bucket").applyInArrow(lambda x: own.answer_counts(x), own.ANSWER)
    got = got.groupBy("block").cogroup(each).applyInArrow(lambda x, y: own.ask_words(x, y), own.ASKED)
    got = got.groupBy("bucket").applyInArrow(lambda x: own.answer_words(x), own.ANSWER)
    return got.groupBy("block").cogroup(each).applyInArrow(lambda x, y: own.score(x, y), SCORED)


def op8_language_model(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by scores(); nulls, ties, repeated rows and empty tables as stated there."""
    return scores(table(spark, sf_dir, "documents"))
