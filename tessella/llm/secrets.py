"""Secret scan: fixed patterns, and guess costs of values in credential contexts by dynamic programming.

The words of the segmentation are ranked: some common passwords, and the VOCABULARY most frequent words of all texts given, counted without the
values in credential contexts, so a secret doesn't make itself a word. Ordinary prose after "token is" so costs little, and stays.

Every whole text is searched; a null text counts as empty, repeated rows give a row each, an empty table gives none, other columns
are ignored. Spans are in code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, slices, written

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 and more: a shorter run can't hold a match
#: Wider contexts than ASSIGN: more names, "is" and arrows, values with any printable characters.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|client|auth)[_-]?key|credentials?|authorization)["']?\x20*(?:[:=]>?|->|\x20is\x20)\x20*(?:bearer\x20|basic\x20)?["']?([^\s"'<>,;]+)""",
    re.I | re.A,
)
#: A text without any of these has no span of any kind.
HINT = r"(?i)pass|pwd|secret|token|key|credential|authorization|akia|[0-9a-f]{32}"

WORDS = {
    w: i + 1
    for i, w in enumerate(
        """password admin welcome login secret letmein master dragon monkey qwerty abc iloveyou sunshine princess football baseball shadow
        superman batman hello freedom whatever trustno ninja mustang access flower starwars computer michael jordan hunter soccer harley
        ranger thomas robert summer winter spring autumn ginger cheese matrix pepper killer tigger charlie orange banana cookie purple
        silver golden yellow test user guest root default changeme example sample demo token key api none null true false value your my
        the and for with this that from have here insert replace placeholder todo redacted hidden string text data server client service
        production staging development local home office london paris january february march april june july august september october
        november december monday tuesday wednesday thursday friday saturday sunday love money happy blue green black white""".split()
    )
}
#: Words that are learned at most, and their lengths: with it, the list that tasks are sent has a bound.
VOCABULARY, LENGTHS = 50_000, (3, 24)
LETTERS = re.compile(r"[^\W\d_]{%d,%d}" % LENGTHS)
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {(b, a) for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {pair for up, low in zip(ROWS, ROWS[1:], strict=False) for a, b in zip(up, low, strict=False) for pair in ((a, b), (b, a))}
PLACE = {c: (y, x) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
LEET = str.maketrans("@430157$", "aaeoists")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
#: What a change of segments costs a guesser, as log10.
SWITCH = math.log10(2)


def _each(value: str) -> float:
    """log10 of the characters to try at each place of a brute-force span."""
    n = 10 * bool(re.search(r"\d", value)) + 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 33 * bool(re.search(r"[^0-9A-Za-z]", value))
    if re.fullmatch("[0-9a-f]+", value):
        n = 16 if re.search("[a-f]", value) else 10
    return math.log10(max(n, 2))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in slices(batches, "text", 4 << 20):
        texts = pc.fill_null(batch.column("text"), "")
        hits = pc.indices_nonzero(pc.match_substring_regex(texts, HINT)).to_pylist()
        if hits:
            values = texts.to_pylist()
            for i in hits:
                values[i] = CONTEXT.sub(lambda m: m[0][: m.start(1) - m.start()], values[i])
            texts = pa.array(values, pa.string())
        tokens = pc.value_counts(pc.split_pattern_regex(texts, r"\s+").flatten())
        for token, n in zip(tokens.field("values").to_pylist(), tokens.field("counts").to_pylist(), strict=True):
            for word in LETTERS.findall(token.lower()):
                held[word] += n
        if len(held) > HELD:
            yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
            held = Counter()
    yield pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n): how often words of letters, in lower case, stand in the texts but for values in credential contexts."""
    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ranked(documents: DataFrame) -> dict[str, int]:
    """Ranks of the most frequent words, and those of the fixed list: all words from the least count on, of some steps, that VOCABULARY words at most reach."""
    with arrow_rows(documents.sparkSession, 2000):
        words = written(word_counts(documents), "words")
    steps = sorted({int(2 ** (k / 4)) for k in range(200)})
    many = words.agg(*(F.count_if(F.col("n") >= t) for t in steps)).first()
    least = next(t for t, n in zip(steps, many, strict=True) if n <= VOCABULARY)
    rows = words.where(F.col("n") >= least).collect()
    return {r.word: i for i, r in enumerate(sorted(rows, key=lambda r: (-r.n, r.word)), 1)} | WORDS


def _runs(i: int, j: int, least: int) -> Iterator[tuple[int, int]]:
    """Parts of a run that have `least` characters or more: all if it is short, else those that leave out a few characters at an end."""
    few = j - i if j - i <= 32 else 8
    for a in range(i, min(i + few, j - least) + 1):
        for b in range(j, max(j - few, a + least) - 1, -1):
            yield a, b


def matches(value: str, ranks: dict[str, int] = WORDS) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the words, dates, repeats and keyboard walks in a value."""
    low = value.lower()
    plain = low.translate(LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + LENGTHS[0], min(n, i + LENGTHS[1]) + 1):
            rank = ranks.get(low[i:j]) or ranks.get(plain[i:j])
            if rank:
                part = value[i:j]
                yield i, j, math.log10(rank) + (low[i:j] not in ranks) * math.log10(2 ** (j - i)) + (part != low[i:j]) * math.log10(4)
        if m := DATE.match(value, i):
            yield i, m.end(), math.log10(365 * 120 if m.end() - i > 4 else 120)
    for unit in range(1, 9):  # runs of a repeated unit
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            least = 3 if unit == 1 else 2 * unit
            if j - i >= least:
                for a, b in _runs(i, j, least):
                    if (b - a) % unit == 0:
                        yield a, b, unit * _each(value[a : a + unit]) + math.log10((b - a) // unit)
                i = j - unit + 1
            else:
                i += 1
    i = 0
    while i < n - 2:
        j = i + 1
        while j < n and (low[j - 1], low[j]) in NEXT:
            j += 1
        if j - i >= 3:
            for a, b in _runs(i, j, 3):
                steps = [tuple(q - p for p, q in zip(PLACE[x], PLACE[y], strict=True)) for x, y in zip(low[a:b], low[a + 1 : b], strict=False)]
                yield a, b, math.log10(47 * (b - a)) + sum(x != y for x, y in zip(steps, steps[1:], strict=False)) * math.log10(4)
            i = j - 1
        else:
            i += 1


def guess_cost(value: str, ranks: dict[str, int] = WORDS) -> float:
    """log10 of the guesses that the cheapest segmentation of the value needs; 0 for ''.

    best[j] is the least cost of value[:j]; a segment is a match or a brute-force span, and each new segment costs a switch. A
    brute-force span grows a character at a time, so time is linear in the value's length and its matches.
    """
    n, each = len(value), _each(value) if value else 0.0
    ending: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
    for i, j, cost in matches(value, ranks):
        ending[j].append((i, cost))
    closed, brute = [0.0] + [math.inf] * n, [math.inf] * (n + 1)  # cost where value[:j] ends with a match, with brute force
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1] + each, closed[j - 1] + each + (SWITCH if j > 1 else 0.0))
        closed[j] = min((min(closed[i], brute[i]) + cost + (SWITCH if i else 0.0) for i, cost in ending[j]), default=math.inf)
    return min(closed[n], brute[n])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The fixed patterns' spans by start, then kind as listed."""
    found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def guess_spans(text: str, least: float, ranks: dict[str, int] = WORDS, shortest: int = 8) -> list[tuple[int, int, str, float]]:
    """Values in credential contexts of `shortest` characters or more that cost 10**least guesses or more."""
    return [(*m.span(1), "guess", cost) for m in CONTEXT.finditer(text) if m.end(1) - m.start(1) >= shortest and (cost := guess_cost(m[1], ranks)) >= least]


def _joined(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k, *_ in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, most_guesses double"


def scanned(documents: DataFrame, least: float = 10.0, ranks: dict[str, int] | None = None) -> DataFrame:
    """A row per document: counts by kind, sha256 of the base spans, all spans, and log10 of the costliest value's guesses (null: none).

    ranks: of words; None: those of the documents.
    """
    ranks = ranked(documents) if ranks is None else ranks
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = pc.fill_null(batch.column("text"), "")
            rows = [(0, 0, 0, 0, empty, "", None)] * len(texts)
            for i in pc.indices_nonzero(pc.match_substring_regex(texts, HINT)).to_pylist():
                text = texts[i].as_py()
                base, more = base_spans(text), guess_spans(text, least, ranks)
                counts = [sum(x[2] == k for x in (*base, *more)) for k in KINDS]
                every = sorted([*base, *more], key=lambda x: (x[0], KINDS.index(x[2])))
                rows[i] = (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), max((x[3] for x in more), default=None))
            columns = list(zip(*rows, strict=True))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [x.split()[0] for x in FOUND.split(", ")])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def redacted(documents: DataFrame, least: float = 10.0, mark: str = "[secret]", ranks: dict[str, int] | None = None) -> DataFrame:
    """The same rows and columns, every span of `scanned` replaced by the mark (overlapping spans by one) and n_chars set to the new length."""
    names = documents.columns
    ranks = ranked(documents) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column("text")
            hits = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, HINT), False)).to_pylist()
            if hits:
                values = texts.to_pylist()
                for i in hits:
                    spans = sorted((a, b) for a, b, *_ in (*base_spans(values[i]), *guess_spans(values[i], least, ranks)))
                    out, at = [], 0
                    for a, b in spans:
                        if a >= at:
                            out += [values[i][at:a], mark]
                        at = max(at, b)
                    values[i] = "".join(out) + values[i][at:]
                batch = batch.set_column(names.index("text"), "text", pa.array(values, texts.type))
            yield batch

    out = documents.mapInArrow(run, documents.schema)
    return out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in names else out
