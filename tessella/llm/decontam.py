"""Benchmark decontamination by greedy string tiling.

Documents and test items join on shared seeds of `least` words. For each pair found, running Karp-Rabin searches for common substrings,
long ones first, mark the longest non-overlapping matches again and again, so passages whose parts were reordered still count. The
share of the item's words under marks, its coverage, is held against a threshold. A round takes time in proportion to the item's words times
the document's places where a seed begins, and each round marks a seed's words at least, also where a text repeats one word.

The items are broadcast in parts of at most PART_BYTES of text each; more parts mean more passes over the documents. `matched` writes each pass and
keeps one part; `cleaned` is one plan, so the driver holds the text of all items.
Nulls: items or documents with a null or empty text match nothing; null ids are kept as null. Items of fewer words than a seed match as a
whole. Repeated documents match each on their own; items that repeat are items of their own. Empty tables give no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, rolling, slices, word_hashes, written

PART_BYTES = 8 << 20
#: Places times items that hold their seed, counted at once.
SEED_PAIRS = 1 << 20
#: An odd factor and its inverse modulo 2^64, for running hashes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MATCHES = "doc_id long, item_id long, coverage double, tiles int, longest int"


def tiles(item, doc, least: int, near=None) -> list[tuple[int, int, int]]:  # noqa: ANN001
    """Greedy string tiling: (item start, document start, length) of the marked matches of `least` words or more; words are numbers.

    Always the longest match of unmarked words is marked next; of equally long ones that with the earlier item start, then document
    start. Running Karp-Rabin finds the matches of a search length or more; when there is none left, that length is halved.
    near: the only document positions where a match can start.
    """
    item, doc = np.asarray(item, np.uint64), np.asarray(doc, np.uint64)
    starts = np.arange(len(doc)) if near is None else np.asarray(near)
    marked_item, marked_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    length = max(least, min(len(item), 20))
    while True:
        size, i, j = _search(item, doc, marked_item, marked_doc, length, starts)
        most = int(size.max(initial=0))
        i, j = i[size == most], j[size == most]
        for at in np.unique(i).tolist() if most else ():
            if marked_item[at : at + most].any():
                continue
            places = j[i == at]
            upto = np.concatenate(([0], np.cumsum(marked_doc)))
            free = places[upto[places + most] == upto[places]]
            if len(free):
                first = int(free.min())
                marked_item[at : at + most] = marked_doc[first : first + most] = True
                out.append((at, first, most))
        if not most:
            if length == least:
                return out
            length = max(least, length // 2)


def _search(item: np.ndarray, doc: np.ndarray, mi: np.ndarray, md: np.ndarray, length: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, item start, document start) of matches of `length` unmarked words or more, as long as they can get; those that a longer one ends with are left out."""
    none = np.zeros(0, np.int64)
    mine, places, hashed = _windows(item, mi, length), _windows(doc, md, length), _running(doc, length)
    places = starts[np.isin(starts, places, assume_unique=True)] if len(places) < len(doc) - length + 1 else starts[starts <= len(doc) - length]
    if not len(mine) or not len(places):
        return none, none, none
    own, h = _running(item, length), hashed[places]
    by = np.argsort(h, kind="stable")
    h, places = h[by], places[by]
    found_i, found_j = [none], [none]
    for i in mine.tolist():
        j = places[np.searchsorted(h, own[i]) : np.searchsorted(h, own[i], side="right")]
        if i and not mi[i - 1] and len(j):
            j = j[(j == 0) | md[j - 1] | (doc[j - 1] != item[i - 1])]
        found_i.append(np.full(len(j), i))
        found_j.append(j)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    size, active = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(active):
        a, b = i[active] + size[active], j[active] + size[active]
        active, a, b = (x[(a < len(item)) & (b < len(doc))] for x in (active, a, b))
        active = active[(item[a] == doc[b]) & ~mi[a] & ~md[b]]
        size[active] += 1
    whole = size >= length
    return size[whole], i[whole], j[whole]


def _windows(words: np.ndarray, marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the unmarked substrings of a length."""
    upto = np.concatenate(([0], np.cumsum(marked)))
    return np.flatnonzero(upto[length:] == upto[:-length]) if len(words) >= length else np.zeros(0, np.int64)


def _running(words: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all substrings of a length, from running sums of words times powers."""
    if len(words) < length:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power, back = np.full(len(words), BASE, np.uint64), np.full(len(words) - length + 1, INVERSE, np.uint64)
        power[0] = back[0] = 1
        power, back = power.cumprod(dtype=np.uint64), back.cumprod(dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), (mix(words) * power).cumsum(dtype=np.uint64)))
        return mix((sums[length:] - sums[:-length]) * back)


def matched(documents: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6) -> DataFrame:
    """(doc_id, item_id, coverage, tiles, longest) of the pairs whose coverage reaches the threshold."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found, parts = [], _part_count(benchmark)
    for items in _parts(benchmark, parts):
        more = docs.mapInArrow(_matches(items, least, threshold), MATCHES)
        found.append(written(more, "matches") if parts > 1 else more)
    return reduce(DataFrame.unionByName, found)


def cleaned(documents: DataFrame, benchmark: DataFrame, least: int = 5, threshold: float = 0.6) -> DataFrame:
    """The rows, with all their columns, of documents that match no item. Each part of the items is one pass, and no row is shuffled."""
    for items in _parts(benchmark, _part_count(benchmark)):
        documents = documents.mapInArrow(_clean(items, least, threshold), documents.schema)
    return documents


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text IS NOT NULL")


def _part_count(benchmark: DataFrame) -> int:
    return 1 + int(_items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES


def _parts(benchmark: DataFrame, parts: int) -> Iterator[list[tuple]]:
    """The items' ids and texts in lists of about PART_BYTES of text; one empty list if there are none."""
    for part in range(parts):
        yield [(r.item_id, r.text) for r in _items(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()]


def _matches(rows: list[tuple], least: int, threshold: float):  # noqa: ANN202
    search = _tiler(rows, least, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id")
            out = [(ids[d].as_py(), *x) for d, *x in search(batch.column("text"))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "coverage", "tiles", "longest"])

    return run


def _clean(rows: list[tuple], least: int, threshold: float):  # noqa: ANN202
    search = _tiler(rows, least, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            keep = np.ones(batch.num_rows, bool)
            keep[[d for d, *_ in search(batch.column("text"))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _tiler(rows: list[tuple], least: int, threshold: float):  # noqa: ANN202
    """A function from texts to (row, item id, coverage, tiles, longest tile) of all matches."""
    hashed, at = word_hashes(pa.array([t for _, t in rows], pa.string())) if rows else (np.zeros(0, np.uint64), np.zeros(1, int))
    items = [(i, hashed[a:b]) for (i, _), a, b in zip(rows, at[:-1], at[1:], strict=True) if b > a]
    lengths = np.array([len(words) for _, words in items])
    by_length: dict[int, list[int]] = defaultdict(list)
    for n, (_, words) in enumerate(items):
        by_length[min(least, len(words))].append(n)
    seeds, grams_of = {}, {}
    for k, own in by_length.items():
        values = [np.unique(rolling(items[n][1], k)) for n in own]
        grams_of |= dict(zip(own, values, strict=True))
        seed, owner = np.concatenate(values), np.repeat(own, [len(v) for v in values])
        order = np.argsort(seed, kind="stable")
        seeds[k] = seed[order], owner[order]

    def search(texts: pa.Array) -> Iterator[tuple]:
        words, at = word_hashes(texts)
        near: dict[tuple[int, int], np.ndarray] = {}
        for k, (seed, owner) in seeds.items():
            grams = rolling(words, k)
            lo = np.searchsorted(seed, grams)
            hit = np.flatnonzero(seed[np.minimum(lo, len(seed) - 1)] == grams) if len(grams) else np.zeros(0, int)
            doc = np.searchsorted(at, hit, side="right") - 1
            hit, doc = hit[hit + k <= at[doc + 1]], doc[hit + k <= at[doc + 1]]  # grams within one document
            lo, many = lo[hit], np.searchsorted(seed, grams[hit], side="right") - lo[hit]
            for d in np.unique(doc).tolist():
                mine = slice(*np.searchsorted(doc, (d, d + 1)))
                places = np.zeros(len(items), np.int64)  # of each item's seeds in the document
                for part in np.array_split(np.arange(mine.start, mine.stop), 1 + int(many[mine].sum()) // SEED_PAIRS):
                    ends = np.cumsum(many[part])
                    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo[part] - (ends - many[part]), many[part])
                    places += np.bincount(owner[index], minlength=len(items))
                for n in np.flatnonzero(places * k >= threshold * lengths):  # all others can't cover enough
                    if places[n]:
                        near[d, int(n)] = hit[mine][np.isin(grams[hit[mine]], grams_of[n])] - at[d]
        for (d, n), starts in sorted(near.items(), key=lambda x: x[0]):
            item_id, item = items[n]
            least_own = min(least, len(item))
            runs = 1 + int((np.diff(starts) > 1).sum())
            if len(starts) + runs * (least_own - 1) < threshold * len(item):  # more words than all matches together can cover
                continue
            found = tiles(item, words[at[d] : at[d + 1]], least_own, starts)
            coverage = sum(x[2] for x in found) / len(item)
            if coverage >= threshold:
                yield d, item_id, coverage, len(found), max(x[2] for x in found)

    return search
