"""Operator 6: secrets, by fixed patterns and by the guess cost of credential-context values.

The patterns give the base spans. The method adds ``cred`` spans: a value that stands after a
credential word is cut into dictionary words, dates, repeats, keyboard walks, sequences and
brute-force characters so that the product of the guesses each part takes is least (a dynamic
program over the value's length); a value whose least cost is high is a secret, while
``changeme`` or ``qwerty123`` is not. Every span of a kind is a part, at every start and of any
length. The dictionary is ``WORDS``, then the words that most documents hold, ranked by Spark;
values in credential context are not counted, so that a secret told often does not become a word.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrkit.llm.common import in_slices, texts_of, written

KINDS = ["assign", "access", "hex", "cred"]
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE, ACCESS_CHARS = 12, 18

#: A credential word, what may stand between, and the value.
CONTEXT = re.compile(
    r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key"""
    r"""|auth(?:orization)?)["']?[\x20\t]*(?:[:=]|:=|=>)[\x20\t]*(?:(?ai:bearer|basic)[\x20\t]+)?["']?([^\s"'<>,;]{6,})""")
#: log10 of the guesses from which a value counts as a secret.
LEAST_COST = 10.0

# Common words of passwords and placeholders, most common first; the rank is the guess number.
WORDS = """password pass admin user test login welcome secret token key api root guest master default change
changeme example sample demo dummy placeholder your my here insert replace enter none null true false letmein
monkey dragon love hello shadow sunshine princess football baseball superman batman qwerty abc iloveyou
trustno server database access private public account name value string hash auth service client local host
temp new old dev prod stage staging live foo bar baz xxx the and for you me it is in of to no not""".split()
#: Words of the documents that are ranked after these, and the documents that must hold each.
TABLE_WORDS, TABLE_DOCS = 30_000, 2
TERM = re.compile(r"\w+")
# The rows of a keyboard.
ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
DATE_FORMS = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])"
                  r"|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)\d\d|(?:19|20)\d\d")
DATE_CHARS = range(4, 11)


DATE_GUESSES = 365 * 100
YEAR_GUESSES = 120
#: Characters of a value whose repeats are sought at every distance, and the base of the prefix hashes for longer ones.
DIRECT_CHARS = 512
HASH_BASE = 0x9E3779B97F4A7C15


class DATE:
    """Dates and years in a value."""

    @staticmethod
    def finditer(value: str):
        """The match of every span that is one."""
        for i in range(len(value) - DATE_CHARS[0] + 1):
            if value[i].isdigit():
                for n in DATE_CHARS[:len(value) - i - DATE_CHARS[0] + 1]:
                    if m := DATE_FORMS.fullmatch(value, i, i + n):
                        yield m


def shortest(stretches: list[tuple[int, int, int]]):
    """Sorted stretches without those that lie in one of a size that divides theirs."""
    known: dict[int, tuple[list[int], list[int]]] = {}
    for size, a, b in stretches:
        if any(size % d == 0 and d < size and (at := bisect_right(starts, a)) and b + size <= ends[at - 1]
               for d, (starts, ends) in known.items()):
            continue
        starts, ends = known.setdefault(size, ([], []))
        starts.append(a)
        ends.append(b + size)
        yield size, a, b


def alike_stretches(codes: np.ndarray, direct: int = DIRECT_CHARS) -> list[tuple[int, int, int]]:
    """(size, a, b): the longest stretches of ``size`` places or more whose every place a to b - 1 holds what
    stands ``size`` places later; by size, then place; without those that lie in one of a size that
    divides theirs.

    Short values are compared at every distance. In longer ones a stretch holds a multiple of its
    size, so only those places are compared, n / size of them: how far they agree either way follows
    from prefix hashes by bisection, and the stretch found is compared in full.
    """
    n = len(codes)
    if n <= direct:
        found = []
        for size in range(1, n // 2 + 1):
            same = np.concatenate([[False], codes[size:] == codes[:-size], [False]])
            edges = np.flatnonzero(same[1:] != same[:-1])
            found += [(size, a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= size]
        return list(shortest(found))
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, HASH_BASE, np.uint64)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n])])

    def agree(i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (sums[i + length] - sums[i]) * power[j - i] == sums[j + length] - sums[j]

    def extent(i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """The longest agreement of the places from i and from j on, or of those before them."""
        low, high = np.zeros_like(i), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            ok = agree(i - mid, j - mid, mid) if back else agree(i, j, mid)
            low, high = np.where(ok, mid, low), np.where(ok, high, mid - 1)
        return low

    found, size = [], 1
    while size <= n // 2:
        # Sizes whose places are about a million together.
        last, places = size, 0
        while last <= n // 2 and places < 1 << 20:
            places += -(-(n - last) // last)
            last += 1
        sizes = np.concatenate([np.full(-(-(n - p) // p), p, np.int64) for p in range(size, last)])
        i = np.concatenate([np.arange(0, n - p, p, dtype=np.int64) for p in range(size, last)])
        first = codes[i] == codes[i + sizes]
        i, sizes = i[first], sizes[first]
        j = i + sizes
        ahead, before = extent(i, j, n - j, False), extent(i, j, i, True)
        long = ahead + before >= sizes
        each = np.stack([sizes, i - before, i + ahead], axis=1)[long]
        # The places of one stretch follow one another.
        found += map(tuple, each[np.concatenate([[True], (np.diff(each, axis=0) != 0).any(axis=1)])[:len(each)]].tolist())
        size = last
    return [x for x in shortest(sorted(set(found))) if np.array_equal(codes[x[1]:x[2]], codes[x[1] + x[0]:x[2] + x[0]])]


class REPEAT:
    """Blocks of any length told twice or more in a row."""

    FORM = re.compile(r"(.+?)\1+", re.DOTALL)

    @staticmethod
    def ending(value: str) -> dict[int, list[tuple[int, int]]]:
        """By the end: (block length, times), where fewer times, two at least, end there too.

        Of a stretch that a shorter block repeats, only the shorter one, which takes fewer guesses."""
        out: dict[int, list[tuple[int, int]]] = {}
        codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
        for size, a, b in alike_stretches(codes):
            for k in range(a + size, b + 1):
                out.setdefault(k + size, []).append((size, 1 + (k - a) // size))
        return out

    @classmethod
    def finditer(cls, value: str):
        """The match of every span that is one, with its shortest block."""
        for end, found in cls.ending(value).items():
            for start in sorted({end - size * n for size, times in found for n in range(2, times + 1)}):
                yield cls.FORM.fullmatch(value, start, end)


def alphabet_size(value: str) -> int:
    """Characters that a brute-force search of this value's kind goes through at each place."""
    if re.fullmatch(r"[0-9a-f]+", value) and not value.isdigit():
        return 16
    kinds = [(r"[0-9]", 10), (r"[a-z]", 26), (r"[A-Z]", 26), (r"[^0-9a-zA-Z]", 33)]
    return sum(n for pattern, n in kinds if re.search(pattern, value))


def walks(value: str) -> list[tuple[int, int, np.ndarray, float, float]]:
    """The longest keyboard walks and character sequences, of three or more: (start, end, turns up to
    each place, guesses of a start, log10 guesses of a turn). Every part of three or more is one too."""
    at = {c: (r, x) for r, row in enumerate(ROWS) for x, c in enumerate(row)}
    low = value.lower() if len(value.lower()) == len(value) else value

    def key_step(a: str, b: str):
        if a in at and b in at and a != b:
            (r, x), (s, y) = at[a], at[b]
            return (s - r, y - x) if abs(s - r) <= 1 and abs(y - x) <= 1 else None
        return None

    def char_step(a: str, b: str):
        return ord(b) - ord(a) if abs(ord(b) - ord(a)) == 1 else None

    out = []
    for step, start_guesses, turn_guesses, free in ((key_step, 47, 4, True), (char_step, 30, 1, False)):
        i = 0
        while i < len(low) - 1:
            first = step(low[i], low[i + 1])
            if first is None:
                i += 1
                continue
            j, last, turns = i + 1, first, [0, 0]
            while j + 1 < len(low):
                now = step(low[j], low[j + 1])
                if now is None or not free and now != first:
                    break
                turns.append(turns[-1] + (now != last))
                last, j = now, j + 1
            if j - i >= 2:
                out.append((i, j + 1, np.array(turns), start_guesses, log10(turn_guesses + 1)))
            i = j
    return out


def walk_costs(walk: tuple[int, int, np.ndarray, float, float], end: int) -> np.ndarray:
    """log10 guesses of the walk's parts that end there, by their start from the walk's own on."""
    start, _, turns, guesses, turn = walk
    sizes = np.arange(end - start, 2, -1)
    # The step into a part's second place is no turn of the part.
    return np.log10(guesses * sizes) + (turns[end - start - 1] - turns[1:len(sizes) + 1]) * turn


def runs(value: str):
    """(start, end, log10 guesses) of all keyboard walks and character sequences of three or more."""
    for walk in walks(value):
        for end in range(walk[0] + 3, walk[1] + 1):
            for k, cost in enumerate(walk_costs(walk, end).tolist()):
                yield walk[0] + k, end, cost


def ranked(words: list[str]) -> dict[str, int]:
    """The guess number of each word, the first place of repeated ones."""
    return {w: i + 1 for i, w in reversed(list(enumerate(words)))}


def word_table(docs: DataFrame, text_col: str = "text", size: int = TABLE_WORDS) -> dict[str, int]:
    """Guess numbers of ``WORDS`` and then of the ``size`` words that most documents hold."""
    def count(batches):
        for batch in in_slices(batches, "text"):
            held: Counter[str] = Counter()
            for text in texts_of(batch, "text").to_pylist():
                if ":" in text or "=" in text:
                    text = CONTEXT.sub(" ", text)
                held.update(set(TERM.findall(text.lower())))
            words = [w for w in held if len(w) > 1 and w.isalpha()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([held[w] for w in words], pa.int64())], ["word", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    best = (counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TABLE_DOCS)
            .orderBy(F.desc("n"), "word").limit(size))
    # Written first: a limit that is collected sends every task's best words to the driver.
    return ranked(WORDS + [r.word for r in sorted(written(best, "secret-words").collect(), key=lambda r: (-r.n, r.word))])


def guess_cost(value: str, ranks: dict[str, int] | None = None, longest: int | None = None) -> float:
    """log10 of the guesses of the cheapest segmentation; 0 for the empty value."""
    per_char = log10(max(2, alphabet_size(value))) if value else 0.0
    ranks = ranked(WORDS) if ranks is None else ranks
    longest = longest or max(map(len, ranks))
    ending: dict[int, list[tuple[int, float]]] = {}

    def add(i: int, j: int, cost: float) -> None:
        ending.setdefault(j, []).append((i, cost))

    low = value.lower() if len(value.lower()) == len(value) else value
    for i in range(len(value)):
        for j in range(i + 2, min(len(value), i + longest) + 1):
            if low[i:j] in ranks:
                case = 0 if value[i:j].islower() else log10(2 if value[i:j].isupper() or value[i:j].istitle() else 2 ** (j - i))
                add(i, j, log10(1 + ranks[low[i:j]]) + case)
    for m in DATE.finditer(value):
        add(m.start(), m.end(), log10(YEAR_GUESSES if m.end() - m.start() == 4 else DATE_GUESSES))
    on: dict[int, list] = {}
    for walk in walks(value):
        for j in range(walk[0] + 3, walk[1] + 1):
            on.setdefault(j, []).append(walk)
    repeats = REPEAT.ending(value)
    starts: dict[tuple[int, int], list[int]] = {}
    best = np.zeros(len(value) + 1)
    for j in range(1, len(value) + 1):
        least = min([best[j - 1] + per_char, *(best[i] + cost for i, cost in ending.get(j, ()))])
        for walk in on.get(j, ()):
            costs = walk_costs(walk, j)
            least = min(least, (best[walk[0]:walk[0] + len(costs)] + costs).min())
        for size, times in repeats.get(j, ()):
            # Starts that an earlier one undercuts never get ahead of it: its lead in blocks counts ever less.
            begun = starts.setdefault((size, j - size * times), [])
            begun.append(j - 2 * size)
            kept, lowest = [], np.inf
            for i in begun:
                cost = best[i] + log10((j - i) // size)
                if cost < lowest:
                    kept.append(i)
                    lowest = cost
            begun[:] = kept
            least = min(least, lowest + size * per_char)
        best[j] = least
    return float(best[-1])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_CHARS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def cred_spans(text: str, least: float = LEAST_COST, ranks: dict[str, int] | None = None,
               longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the values in credential context that are dear to guess."""
    if ":" not in text and "=" not in text:
        return []
    return [(m.start(1), 3, m.end(1)) for m in CONTEXT.finditer(text) if guess_cost(m[1], ranks, longest) >= least]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every stretch that spans cover replaced by one mask."""
    out, end, open_at = [], 0, 0
    for a, _, b in sorted(spans):
        if a >= open_at:
            out += [text[end:a], mask]
            end = b
        end = max(end, b)
        open_at = end
    return "".join([*out, text[end:]]) if spans else text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST_COST,
         mask: str = "[secret]") -> DataFrame:
    """Per row: (doc_id, n_assign, n_access, n_hex, base_sha256, spans, masked).

    Spans are code points, end exclusive, ``kind:start:end`` in order of start and then kind,
    joined by commas; ``base_sha256`` hashes those of the fixed patterns alone; ``masked`` is the
    text with every span replaced, null where the row has no span. A null text is empty; null
    and repeated ids keep their rows; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(word_table(docs, text_col))

    def search(batches):
        ranks = shipped.value
        longest = max(map(len, ranks))
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "masked"]
        for batch in in_slices(batches, "text"):
            rows = []
            for text in texts_of(batch, "text").to_pylist():
                base = base_spans(text)
                every = sorted(base + cred_spans(text, least, ranks, longest))
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2),
                             hashlib.sha256(joined(base).encode()).hexdigest(), joined(every),
                             masked(text, every, mask) if every else None))
            types = [pa.int64()] * 3 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names)

    return rows.mapInArrow(search, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
                                   "spans string, masked string")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars",
           least: float = LEAST_COST, mask: str = "[secret]") -> DataFrame:
    """``docs`` with its secrets masked and ``chars_col`` counted anew; all rows and columns stay."""
    names, schema = docs.columns, docs.schema
    shipped = docs.sparkSession.sparkContext.broadcast(word_table(docs, text_col))

    def search(batches):
        ranks = shipped.value
        longest = max(map(len, ranks))
        at = names.index(text_col)
        for batch in in_slices(batches, text_col):
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            for i, text in enumerate(texts):
                spans = base_spans(text or "") + cred_spans(text or "", least, ranks, longest)
                if spans:
                    texts[i] = masked(text, spans, mask)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    out = docs.mapInArrow(search, schema)
    return out.withColumn(chars_col, F.length(text_col).cast(schema[chars_col].dataType)) if chars_col else out
