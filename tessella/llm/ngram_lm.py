"""Katz backoff language model of any order: Good-Turing discounted counts, exactly normalised backoff weights.

    P(w | h) = d(c(h,w)) c(h,w) / c(h)      if the n-gram was seen in training; h: the words before, order - 1 of them at first
               alpha(h) P(w | h')           otherwise; h': h without its first word; alpha = 1 for a context that was not seen
    P(w)     = d(c(w)) c(w) / N             if the word was seen
               the mass that discounting freed, for the one class of all other words

d(r) discounts counts of 1 to K by Good-Turing (Katz 1987), by level, and is 1 above, and where the counts of counts don't give a ratio in (0, 1].
At least one count of 1 keeps a little mass free, so that every probability is positive. alpha(h) spreads what h's discounts freed over
the words not seen after h, so that P(. | h) sums to 1 over the vocabulary and the class of other words. Documents start with order - 1 starts.

How it runs: documents are packed into blocks (an Arrow table of some 700 000 tokens: its distinct word hashes, and tokens as indices), written once.
Blocks ask for what they need by key, in a round for each level: the ids and counts of their words (dealt by word; ids rise as counts fall), then the
counts and context sums of their bigrams, trigrams and so on (dealt by context, split by a salt of the next word so that a frequent context is many
tasks' work). N-grams travel as ids in sorted order, packed by byte plane, so frequent words cost little. An n-gram's training count after the shorter
history travels too: of n-grams that were seen it gives P(w | h') but for a factor of h', which the block knows. Answers come back as arrays in the
order of the question. Each block is then scored by itself, level by level. Shuffled volume grows with the tokens and the order, a task's with the block.
Blocks and buckets both grow with the input, so messages grow with its square (each smaller): at 30 GB some hundred n-grams are in one.

The model: a table of words (kind = 'word') and one of each longer level (kind = 'gram'), packed by bucket; `opened_words` and `opened_grams` give them as rows.

Words and contexts are identified by 64-bit hashes, the latter of exact ids. Rows of one doc_id make one document (their sums are
added); null ids are one document; a null text is empty and has the end token alone. An empty table gives no rows; without any training
text every word is unknown. Other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bucketed, hashes, mix, slices, words_of, written

#: Counts up to this are discounted.
K = 5
#: Tokens after which a block is closed.
BLOCK_TOKENS = 700_000
#: Bytes of text that are tokenised at once; a block is closed after one of these.
SLICE = 2 << 20
#: Parts, by bucket, in which levels from the third on are asked, so that only a part of their questions is on disk at once.
PASSES = 2
#: Contexts, of a level, whose sums are brought to the driver at most: a context is frequent from 1 / MOST_FREQUENT of all training tokens on.
MOST_FREQUENT = 10_000
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
START, END = "\n", ""  # no word is spelt so
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BLOCKS = "block string, ids binary, nulls binary, train binary, ends binary, words binary, tokens binary"


def packed(a: np.ndarray) -> bytes:
    """An array's bytes by plane (all lowest bytes, then all second ones), compressed."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes() if len(a) else b""
    return len(planes).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(b: bytes, dtype: str) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(b[8:], decompressed_size=n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).reshape(-1).view(dtype)


def word_keys(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words that are not null, eight bytes of all at a time."""
    wide = pa.types.is_large_string(words.type)
    at = np.frombuffer(words.buffers()[1], np.int64 if wide else np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.concatenate((np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], np.zeros(8, np.uint8)))
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    at, size = at - at[0], np.diff(at)
    with np.errstate(over="ignore"):
        out = mix((size.astype(np.uint64) + np.uint64(1)) * GOLDEN)
        left, step = np.flatnonzero((size > 0) & (size <= LONG_WORD)), 0
        while len(left):
            unused = np.maximum(8 - size[left] + step, 0).astype(np.uint64) * np.uint64(8)
            out[left] = mix(out[left] * GOLDEN + (eights[at[left] + step] << unused))
            step += 8
            left = left[size[left] > step]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = hashes([data[at[i] : at[i + 1]].tobytes()])[0]
    return out


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique() and its inverse of codes of two numbers, high and low half; small ones are sorted together with their places, which is faster."""
    n = len(codes)
    high, low = codes >> np.uint64(32), codes & np.uint64(0xFFFFFFFF)
    a, b, c = (int(x).bit_length() for x in (high.max(initial=0), low.max(initial=0), n))
    if a + b + c > 64:
        values, index = np.unique(codes, return_inverse=True)
        return values, index.astype(np.int32)
    x = np.sort(high << np.uint64(b + c) | low << np.uint64(c) | np.arange(n, dtype=np.uint64))
    place = (x & np.uint64((1 << c) - 1)).astype(np.int64)
    x >>= np.uint64(c)
    first = _firsts(x)
    new = np.zeros(n, np.int32)
    new[first[1:]] = 1
    index = np.empty(n, np.int32)
    index[place] = np.cumsum(new, dtype=np.int32)
    return codes[place[first]], index


class Discounts:
    """Good-Turing ratios d(1..K) from the counts of counts n(1..K+1), and one for a text that frees no mass otherwise."""

    def __init__(self, n: list[int], k: int = K):
        self.ratio = np.ones(k + 1)
        top = (k + 1) * n[k] / n[0] if n[0] else 1.0
        for r in range(1, k + 1):
            if n[0] and n[r - 1] and n[r] and top < 1:
                d = ((r + 1) * n[r] / (r * n[r - 1]) - top) / (1 - top)
                self.ratio[r] = d if 0 < d <= 1 else 1.0
        self.freed = np.arange(k + 1) * (1 - self.ratio)

    def kept(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * np.where(counts <= K, self.ratio[np.minimum(counts, K)], 1.0)


class Words:
    """P(w) by training count. Where discounting frees nothing, all are scaled by N / (N + 1)."""

    def __init__(self, total: int, distinct: int, n: list[int]):
        self.total, self.distinct, self.d = total, distinct, Discounts(n)
        self.unknown = sum(n[r - 1] * self.d.freed[r] for r in range(1, K + 1)) / total if total else 1.0
        self.scale = 1.0
        if self.unknown <= 0:
            self.scale, self.unknown = total / (total + 1), 1 / (total + 1)

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.d.kept(counts) * self.scale / max(self.total, 1), self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def backoff(counts: np.ndarray, freed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(free, scale) of contexts: their counts, and how many of these the discounts of their n-grams free.

    A context whose counts free nothing gives up 1 / (count + 1) of its mass, all its n-grams being scaled.
    """
    free = freed / np.maximum(counts, 1)
    return np.where(free > 0, free, 1 / (counts + 1.0)), np.where(free > 0, 1.0, counts / (counts + 1.0))


class Block:
    """A block's arrays."""

    def __init__(self, row: dict):
        self.ids, self.nulls, self.train = unpacked(row["ids"], "<i8"), unpacked(row["nulls"], "u1") > 0, unpacked(row["train"], "u1") > 0
        self.ends, self.words, self.tokens = unpacked(row["ends"], "<i8"), np.cumsum(unpacked(row["words"], "<u8"), dtype=np.uint64), unpacked(row["tokens"], "<u4").astype(np.int32)
        self.starts = np.concatenate(([0], self.ends[:-1]))
        self.trained = np.repeat(self.train, np.diff(np.concatenate(([0], self.ends))))

    def by_word(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """An order of the words by bucket, and where each bucket starts in it."""
        return dealt(mix(self.words), buckets)

    def grams(self, below: "Level") -> np.ndarray:
        """A code of each token's n-gram: index of the shorter n-gram that ends before it (or that of starts only), index of the word."""
        context = np.empty(len(self.tokens), np.uint64)
        context[1:] = below.index[:-1]
        context[self.starts] = len(below.counts)
        return context << np.uint64(32) | self.tokens.astype(np.uint64)


@dataclass
class Level:
    """A block's n-grams of one length in the order of their words' ids: each token's (index), their training counts and probabilities.

    As contexts, that of starts only last: columns (ids of their words), keys (hashes of these), ofcontext (counts), and `lower`: P(w | h') of a
    seen w over its discounted count after h', the context without its first word.
    """

    index: np.ndarray
    counts: np.ndarray
    p: np.ndarray
    columns: list[np.ndarray]
    ofcontext: np.ndarray
    lower: np.ndarray

    def keys(self) -> np.ndarray:
        return context_keys(self.columns)


def context_keys(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of contexts, given the ids of their words."""
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = mix(out * GOLDEN + c + np.uint64(1))
    return out


def asked(codes: np.ndarray, below: Level, ids: np.ndarray, buckets: int, frequent: int) -> tuple:
    """(own, v, w, order, starts, parts): places of distinct n-grams whose contexts were seen, their context and word, an order by bucket, where buckets start.

    parts: in how many parts each context is dealt, by its next word; a context of more than `frequent` tokens is several.
    """
    v = (codes >> np.uint64(32)).astype(np.int32)
    own = np.flatnonzero(below.ofcontext[v] > 0)
    v, w = v[own], (codes[own] & np.uint64(0xFFFFFFFF)).astype(np.int32)
    parts = below.ofcontext // frequent + 1
    salt = mix(ids)[w] % parts[v].astype(np.uint64)
    with np.errstate(over="ignore"):
        order, starts = dealt(mix(below.keys()[v] + salt * GOLDEN), buckets)
    return own, v, w, order, starts, parts


def dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    b = (h % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # 16 bits are sorted by radix
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(buckets + 1))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    end = word_keys(pa.array([END]))[0]
    parts: list[tuple] = []
    size = 0

    def block() -> pa.RecordBatch:
        ids, nulls, train, lengths, tokens = (np.concatenate(x) for x in zip(*parts, strict=True))
        coded = pa.array(tokens).dictionary_encode()
        words, index = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        by = np.lexsort((words, -np.bincount(index, minlength=len(words))))  # frequent words first, equally frequent ones by hash
        place = np.empty(len(by), np.uint32)
        place[by] = np.arange(len(by))
        arrays = (ids.astype("<i8"), nulls.astype("u1"), train.astype("u1"), np.cumsum(lengths).astype("<i8"), np.diff(words[by], prepend=np.uint64(0)), place[index])
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([packed(a)], pa.binary()) for a in arrays)], [x.split()[0] for x in BLOCKS.split(", ")])

    for batch in slices(batches, "text", SLICE):
        flat, at = words_of(batch.column("text"))
        tokens = word_keys(flat)
        own = batch.column("id")
        parts.append((own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False), batch.column("train").to_numpy(zero_copy_only=False), np.diff(at) + 1, np.insert(tokens, at[1:], end)))
        size += len(tokens) + batch.num_rows
        if size >= BLOCK_TOKENS:
            yield block()
            parts, size = [], 0
    if parts:
        yield block()


def _rows(names: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


ASK1 = "bucket int, block string, words binary, counts binary"
TABLE1 = "kind string, bucket int, block string, words binary, ranks binary, counts binary, n array<long>, total long, distinct long"
ASK2 = "bucket int, block string, contexts binary, sizes binary, nexts binary, lower binary, counts binary, shared binary"
TABLE2 = "kind string, bucket int, block string, contexts binary, sizes binary, nexts binary, counts binary, held binary, backs binary, sums binary, seen binary, n array<long>"


def _ask_words(buckets: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                counts = np.bincount(b.tokens[b.trained], minlength=len(b.words)).astype("<i8")
                order, starts = b.by_word(buckets)
                yield _rows(ASK1, [(i, row["block"], packed(b.words[order[lo:hi]]), packed(counts[order[lo:hi]])) for i, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)) if hi > lo])

    return run


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(counts[counts <= K + 1], minlength=K + 2)[1 : K + 2].tolist()


def _answer_words(table: pa.Table) -> pa.Table:
    """Counts of words, and their ranks by descending count within the bucket."""
    blocks, bucket = table["block"].to_pylist(), table["bucket"][0].as_py()
    words = [unpacked(x, "<u8") for x in table["words"].to_pylist()]
    keys, index = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, index, np.concatenate([unpacked(x, "<i8") for x in table["counts"].to_pylist()]))
    by = np.argsort(-counts, kind="stable")
    ranks = np.empty(len(keys), np.int64)
    ranks[by] = np.arange(len(keys))
    ends = np.cumsum([len(w) for w in words])
    rows = [("answer", bucket, block, None, packed(ranks[index[e - len(w) : e]]), packed(counts[index[e - len(w) : e]]), None, None, None) for block, w, e in zip(blocks, words, ends, strict=True)]
    own = by[counts[by] > 0]
    rows.append(("word", bucket, None, packed(keys[own]), None, packed(counts[own]), _of_counts(counts), int(counts.sum()), len(own)))
    return pa.Table.from_batches([_rows(TABLE1, rows)])


def word_id(ranks: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """0 is the start; then the first of each bucket, the second of each and so on."""
    return ranks.astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket + 1)


def _words_of(b: Block, answers: list[dict], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The answers of round 1 in the order of the block's words: ids and counts."""
    order, starts = b.by_word(buckets)
    ids, counts = np.zeros(len(b.words), np.uint64), np.zeros(len(b.words), np.int64)
    for a in answers:
        at = order[starts[a["bucket"]] : starts[a["bucket"] + 1]]
        ids[at], counts[at] = word_id(unpacked(a["ranks"], "<i8"), a["bucket"], buckets), unpacked(a["counts"], "<i8")
    return ids, counts


@dataclass
class Known:
    """What is known of the levels below the next one: the words' model, and the discounts and frequent contexts (keys, sums, seen) of the longer n-grams whose rounds have been answered."""

    word_buckets: int
    frequent: int
    model: Words
    discounts: list[Discounts]
    shared: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def buckets(self, n: int) -> int:
        """Longer n-grams are more of them."""
        return self.word_buckets * (n - 1)

    def level(self, b: Block, row: dict) -> tuple[Level, np.ndarray]:
        """The block's n-grams of the longest length known; ids of its words, which are sorted by them now."""
        ids, counts = _words_of(b, row["answers"], self.word_buckets)
        end = int(np.flatnonzero(b.words == word_keys(pa.array([END]))[0])[0])
        starts = counts[end]  # as many starts as ends
        order = np.argsort(ids)
        place = np.empty(len(ids), np.int32)
        place[order] = np.arange(len(ids))
        b.tokens, ids, counts = place[b.tokens], ids[order], counts[order]
        lower = np.full(len(ids) + 1, self.model.scale / max(self.model.total, 1))
        out = Level(b.tokens, counts, self.model.p(counts), [np.append(ids, np.uint64(0))], np.append(counts, starts), lower)
        before = None
        for n, (d, shared) in enumerate(zip(self.discounts, self.shared, strict=True), 2):
            before, out = out, self._longer(b, before, out, ids, row[f"grams{n}"] or [], n, d, shared)
        return out, ids

    def _longer(self, b: Block, before: Level | None, below: Level, ids: np.ndarray, answers: list[dict], n: int, d: Discounts, shared: tuple) -> Level:
        codes, index = distinct(b.grams(below))
        own, v, w, order, starts, parts = asked(codes, below, ids, self.buckets(n), self.frequent)
        total = np.zeros(len(codes), np.int64)
        freed, mass = np.zeros(len(below.ofcontext)), np.zeros(len(below.ofcontext))
        smaller = self.discounts[n - 3] if n > 2 else self.model.d
        some_freed = ((np.arange(1 << K)[:, None] >> np.arange(K) & 1) * d.freed[1:]).sum(axis=1)

        def put(context: np.ndarray, sums: np.ndarray, seen: np.ndarray) -> None:
            freed[context] = (sums * d.freed[1:]).sum(axis=1)
            mass[context] = (seen[:, :K] * (np.arange(1, K + 1) * smaller.ratio[1:])).sum(axis=1) + seen[:, K]

        for a in answers:
            at = order[starts[a["bucket"]] : starts[a["bucket"] + 1]]
            total[own[at]] = unpacked(a["counts"], "<u4")
            context = v[at[_firsts(v[at])]]
            freed[context] = some_freed[unpacked(a["held"], "u1")]  # where nothing backs off it is enough to know which are there
            put(context[unpacked(a["backs"], "u1") > 0], _table(a["sums"], K), _table(a["seen"], K + 1))
        keys, some, more = shared
        split = np.flatnonzero(parts > 1)
        if len(split) and len(keys):
            wanted = context_keys([c[split] for c in below.columns])
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted  # the end is no context
            put(split[hit], some[at[hit]], more[at[hit]])
        free, scale = backoff(below.ofcontext, freed)
        alpha = np.where(below.ofcontext > 0, free / np.maximum(1 - below.lower * mass, 1e-300), 1.0)
        context = (codes >> np.uint64(32)).astype(np.int32)
        p = np.empty(len(codes))
        p[index] = below.p[below.index]
        p *= alpha[context]
        hit = np.flatnonzero(total)
        factor = scale / np.maximum(below.ofcontext, 1)
        p[hit] = d.kept(total[hit]) * factor[context[hit]]
        word = (codes & np.uint64(0xFFFFFFFF)).astype(np.int32)
        columns = [np.append(c[context], np.uint64(0)) for c in below.columns] + [np.append(ids[word], np.uint64(0))]
        lower = np.empty(len(codes) + 1)
        lower[index], lower[-1] = factor[below.index], factor[-1]  # h' of an n-gram as a context is the shorter one that ends with it
        return Level(index, total, p, columns, np.append(total, below.ofcontext[-1]), lower)


def _ask_grams(known: Known, part: int = 0, parts_of: int = 1):  # noqa: ANN202
    """Questions to one of several parts of the buckets."""
    n = len(known.discounts) + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                below, ids = known.level(b, row)
                codes, index = distinct(b.grams(below))
                train = np.bincount(index[b.trained], minlength=len(codes))
                lower = np.zeros(len(codes), np.int64)
                lower[index[b.trained]] = below.counts[below.index[b.trained]]
                own, v, w, order, starts, parts = asked(codes, below, ids, known.buckets(n), known.frequent)
                train, lower, out = train[own], lower[own], []
                for i, (lo, hi) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
                    if hi > lo and i % parts_of == part:
                        at = order[lo:hi]
                        new = _firsts(v[at])
                        context = v[at[new]]
                        blobs = [_columns([c[context] for c in below.columns]), packed(np.diff(np.append(new, len(at))).astype("<u4")), packed(ids[w[at]]), packed(lower[at]), packed(train[at]), packed((parts[context] > 1).astype("u1"))]
                        out.append((i, row["block"], *blobs))
                yield _rows(ASK2, out)

    return run


def _columns(columns: list[np.ndarray]) -> bytes:
    """Ids of contexts; the first column, which is sorted, as differences."""
    return packed(np.concatenate([np.diff(columns[0], prepend=columns[0].dtype.type(0)), *columns[1:]]))


def _open_columns(b: bytes, width: int) -> list[np.ndarray]:
    first, *others = unpacked(b, "<u8").reshape(width, -1)
    return [np.cumsum(first, dtype=np.uint64), *others]


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _answer_grams(n: int):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        bucket, names = table["bucket"][0].as_py(), ("sizes", "nexts", "lower", "counts", "shared")
        asks = [_open_columns(x, n - 1) for x in table["contexts"].to_pylist()]
        columns = [np.concatenate(x) for x in zip(*asks, strict=True)]
        each = [unpacked(x, "<u4").astype(np.int64) for x in table["sizes"].to_pylist()]
        sizes, nexts, lower, counts, shared = (np.concatenate([unpacked(x, d) for x in table[c].to_pylist()]) for c, d in zip(names, ("<u4", "<u8", "<i8", "<i8", "u1"), strict=True))
        narrow = n <= 3 and int(max(c.max() for c in columns)) < 1 << 32  # then contexts are numbers, in the order of their ids
        codes = (columns[0] << np.uint64(32) | columns[-1] if n == 3 else columns[0]) if narrow else context_keys(columns)
        keys, firsts, context = np.unique(codes, return_index=True, return_inverse=True)
        v = np.repeat(context, sizes)
        small = len(keys) < 1 << 24 and (not len(nexts) or int(nexts.max()) < 1 << 40)
        order = np.argsort(v.astype(np.uint64) << np.uint64(40) | nexts) if small else np.lexsort((nexts, v))
        vs, ns = v[order], nexts[order]
        new = np.concatenate(([True], (vs[1:] != vs[:-1]) | (ns[1:] != ns[:-1])))
        first = np.flatnonzero(new)
        index = np.empty(len(order), np.int64)
        index[order] = np.cumsum(new) - 1
        total, below = np.add.reduceat(counts[order], first), np.maximum.reduceat(lower[order], first)
        hit = np.flatnonzero(total)
        pv, ns, below, own = vs[first][hit], ns[first][hit], below[hit], total[hit]
        sums, seen = np.zeros((len(keys), K), np.int64), np.zeros((len(keys), K + 1), np.int64)
        few, rare = own <= K, below <= K
        np.add.at(sums, (pv[few], own[few] - 1), 1)
        np.add.at(seen, (pv[rare], below[rare] - 1), 1)
        np.add.at(seen, (pv[~rare], K), below[~rare])
        held = ((sums > 0) << np.arange(K)).sum(axis=1).astype("u1")
        rows, lo, clo, total = [], 0, 0, total.astype(np.uint32)
        for block, s in zip(table["block"].to_pylist(), each, strict=True):
            m, at = int(s.sum()), context[clo : clo + len(s)]
            found = total[index[lo : lo + m]]
            backs = np.add.reduceat(found == 0, np.cumsum(s) - s) > 0  # only there the block needs alpha
            rows.append(("answer", bucket, block, None, None, None, packed(found), packed(held[at]), packed(backs.astype("u1")), _flat(sums[at[backs]]), _flat(seen[at[backs]]), None))
            lo, clo = lo + m, clo + len(s)
        at = _firsts(pv)
        size, mine, place = np.diff(np.append(at, len(pv))), pv[at], slice(None)
        if not narrow:  # contexts in the order of their ids
            by = np.lexsort(tuple(c[firsts[mine]] for c in reversed(columns)))
            place = np.repeat(at[by], size[by]) + np.arange(len(pv)) - np.repeat(np.cumsum(size[by]) - size[by], size[by])
            size, mine = size[by], mine[by]
        rows.append(("gram", bucket, None, _columns([c[firsts[mine]] for c in columns]), packed(size.astype("<u4")), packed(ns[place]), packed(own[place]), None, None, None, _flat(seen[mine]), _of_counts(own)))
        several = np.unique(context[shared > 0])
        keys = context_keys([c[firsts[several]] for c in columns])
        rows.append(("part", bucket, None, packed(keys), None, None, None, None, None, _flat(sums[several]), _flat(seen[several]), None))
        return pa.Table.from_batches([_rows(TABLE2, rows)])

    return run


def _flat(table: np.ndarray) -> bytes:
    """A table of counts, packed by column."""
    return packed(np.ascontiguousarray(table.T).reshape(-1))


def _table(b: bytes, width: int) -> np.ndarray:
    return unpacked(b, "<i8").reshape(width, -1).T


PART = "context long, sums array<long>, seen array<long>"


def _open_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            sums, seen = _table(row["sums"], K).tolist(), _table(row["seen"], K + 1).tolist()
            yield _rows(PART, list(zip(unpacked(row["contexts"], "<u8").view(np.int64).tolist(), sums, seen, strict=True)))


def _frequent(grams: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sums and seen of the contexts that several buckets hold: MOST_FREQUENT at most."""
    parts = grams.where("kind = 'part'").select("contexts", "sums", "seen").mapInArrow(_open_parts, PART)
    rows = parts.groupBy("context").agg(F.array(*(F.sum(F.col("sums")[r]) for r in range(K))).alias("sums"), F.array(*(F.sum(F.col("seen")[r]) for r in range(K + 1))).alias("seen")).collect()
    keys = np.array([r.context for r in rows], np.int64).view(np.uint64)
    by = np.argsort(keys)
    return keys[by], np.array([r.sums for r in rows], np.int64).reshape(-1, K)[by], np.array([r.seen for r in rows], np.int64).reshape(-1, K + 1)[by]


SCORES = "id long, n_tokens long, n_known long, base_score double, score double"


def _score(known: Known):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                counts = _words_of(b, row["answers"], known.word_buckets)[1]
                out = [np.diff(b.ends, prepend=0), np.add.reduceat((counts > 0).astype(np.int64)[b.tokens], b.starts), np.add.reduceat(known.model.base(counts)[b.tokens], b.starts)]
                longest, _ = known.level(b, row)
                out.append(np.add.reduceat(np.log10(longest.p)[longest.index], b.starts))
                yield pa.RecordBatch.from_arrays([pa.array(b.ids, mask=b.nulls), *map(pa.array, out)], [x.split()[0] for x in SCORES.split(", ")])

    return run


def _with(blocks: DataFrame, *answers: DataFrame) -> DataFrame:
    """The blocks and what they were answered; the blocks are bucketed by their name, so only the answers move."""
    for a in answers:
        blocks = blocks.join(a.hint("shuffle_hash"), "block", "left")
    return blocks


def _gathered(table: DataFrame, name: str, *columns: str) -> DataFrame:
    return table.groupBy("block").agg(F.collect_list(F.struct(*columns)).alias(name))


def scored(documents: DataFrame, held_out, frequent: int = 200_000, order: int = 2) -> tuple[DataFrame, dict]:  # noqa: ANN001
    """((id, n_tokens, n_known, base_score, score) per doc_id, the model: its tables and totals).

    held_out: a condition on doc_id; documents for which it holds are scored but not learned from.
    order: the length of the longest n-grams.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string"), (~F.coalesce(held_out, F.lit(False))).alias("train"))
    with arrow_rows(spark, 2000):
        blocks, n = bucketed(rows.mapInArrow(_pack, BLOCKS), "lm_blocks")
    with arrow_rows(spark, 1):  # a row is a block, or a bucket's part of one
        return _scored(blocks, max(12, n // 3), frequent, order)


def _scored(blocks: DataFrame, buckets: int, frequent: int, order: int) -> tuple[DataFrame, dict]:
    asked = blocks.mapInArrow(_ask_words(buckets), ASK1)
    words = written(asked.groupBy("bucket").applyInArrow(_answer_words, TABLE1), "lm-words", "kind")
    of = words.where("kind = 'word'").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct"), *(F.sum(F.col("n")[r]).alias(f"n{r}") for r in range(K + 1))).first()
    model = Words(of["total"] or 0, of["distinct"] or 0, [of[f"n{r}"] or 0 for r in range(K + 1)])
    answers = _gathered(words.where("kind = 'answer'"), "answers", "bucket", "ranks", "counts")
    known, tables, told = Known(buckets, max(frequent, model.total // MOST_FREQUENT), model, [], []), [], [answers]
    for n in range(2, order + 1):
        parts = 1 if n == 2 else PASSES
        passes = [_with(blocks, *told).mapInArrow(_ask_grams(known, part, parts), ASK2).groupBy("bucket").applyInArrow(_answer_grams(n), TABLE2) for part in range(parts)]
        grams = reduce(DataFrame.unionByName, [written(x, f"lm-grams{n}", "kind") for x in passes])
        of = grams.where("kind = 'gram'").agg(*(F.sum(F.col("n")[r]).alias(f"n{r}") for r in range(K + 1))).first()
        told = [*told, _gathered(grams.where("kind = 'answer'"), f"grams{n}", "bucket", "counts", "held", "backs", "sums", "seen")]
        discounts = Discounts([of[f"n{r}"] or 0 for r in range(K + 1)])
        known = replace(known, discounts=[*known.discounts, discounts], shared=[*known.shared, _frequent(grams)])
        tables.append(grams)
    scores = _with(blocks, *told).mapInArrow(_score(known), SCORES)
    out = written(scores, "lm-scores").groupBy("id").agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
    return out, {"words": words, "grams": tables, "totals": model, "discounts": known.discounts, "buckets": buckets}


def opened_words(model: dict) -> DataFrame:
    """(id, hash, count) of the words that were seen in training."""
    buckets = model["buckets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = unpacked(row["words"], "<u8"), unpacked(row["counts"], "<i8")
                ids = word_id(np.arange(len(words)), row["bucket"], buckets)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (ids, words, counts)], ["id", "hash", "count"])

    return model["words"].where("kind = 'word'").select("bucket", "words", "counts").mapInArrow(run, "id long, hash long, count long")


def opened_grams(model: dict, n: int) -> DataFrame:
    """(w1, ..., wn, count) of the n-grams that were seen in training; words by their ids, 0 for the start."""
    names = [*(f"w{i}" for i in range(1, n + 1)), "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = unpacked(row["sizes"], "<u4")
                columns = [*(np.repeat(c, sizes) for c in _open_columns(row["contexts"], n - 1)), unpacked(row["nexts"], "<u8"), unpacked(row["counts"], "<i8")]
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in columns], names)

    return model["grams"][n - 2].where("kind = 'gram'").select("contexts", "sizes", "nexts", "counts").mapInArrow(run, ", ".join(f"{x} long" for x in names))
