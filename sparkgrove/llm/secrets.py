"""Secret scans: exact base patterns, and password guess costs for values in credential contexts.

The guess cost of a value is found by dynamic programming: the cheapest segmentation into words, dates, repeats, keyboard
walks, sequences and brute-force spans, in log10 of guesses. A word costs its rank among the words of the corpus, counted
over all texts, or in a short list of common passwords. The scan is row-wise; only the count of words shuffles.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut, fresh

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Maximal runs, so a length in the pattern keeps and drops the same matches as a length test afterwards.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Further credential contexts, also as the end of a longer name (DB_PASS), whose values the guess cost judges.
_CONTEXT = re.compile(
    r"""(?:pwd|pass|passphrase|passcode|password|passwd|secret|token|credentials?|auth|bearer|api_?key|access[_-]?key|private[_-]?key|client[_-]?secret)["']?\x20*(?::|=>?)\x20*(?:bearer\x20+)?["']?([^\s"'<>,;]{8,})""",
    re.IGNORECASE | re.ASCII,
)
#: Log10 of guesses from which a value in such a context counts as a secret.
LEAST_COST = 8.0

#: Words of the corpus that are ranked, and their lengths in letters: shorter ones are guessed as fast letter by letter.
DICTIONARY, SHORTEST, LONGEST = 50_000, 3, 24

_WORDS = (
    "password the and you that for love admin welcome monkey dragon master login letmein princess football baseball sunshine shadow superman "
    "qwerty test user guest root secret token summer winter spring autumn hello freedom whatever trustno computer internet server "
    "database default changeme temp demo example sample michael jordan daniel thomas jessica charlie andrew purple orange silver golden "
    "flower banana cookie cheese pepper ginger tiger eagle hunter ranger killer hockey soccer batman access key pass word correct horse "
    "battery staple none null true false your here value string placeholder redacted hidden removed"
).split()
_RANK = {w: i + 1 for i, w in enumerate(_WORDS)}
_LEET = str.maketrans("@4301$5!7", "aaeoissit"[:9])
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_NEXT = {a + b for row in _ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:])} | {a + b for r, s in zip(_ROWS, _ROWS[1:]) for a, b in (*zip(r, s), *zip(s, r))}
_MONTH, _DAY = r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12]\d|0?[1-9])"
#: Dates and years, longest forms first; each is tried at every digit that follows none.
_DATES = tuple(re.compile(p) for p in (rf"(?:19|20)\d\d[-/._]?{_MONTH}[-/._]?{_DAY}", rf"{_DAY}[-/._]{_MONTH}[-/._](?:(?:19|20)\d\d|\d\d)", r"(?:19|20)\d\d"))


def corpus_ranks(df: DataFrame, text: str = "text", most: int = DICTIONARY) -> dict[str, int]:
    """Ranks of the commonest words of all texts, by count, then by code point, and of the common passwords.

    A word is a run of letters, lower-cased, of SHORTEST to LONGEST letters. Counts fall into steps of about 4 %, and whole steps are
    taken from the top as long as they hold at most `most` words together. Counts are summed before the shuffle, so common words make no large
    groups; the driver gets a row a step, and at most `most` words.
    """
    word = df.select(F.explode(F.split(F.lower(df[text]), r"[^\p{L}]+")).alias("w")).where(F.length("w").between(SHORTEST, LONGEST))
    counts = cut(word.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("step", F.floor(16 * F.log2("n")).cast("int")))
    taken, lowest = 0, None
    for r in sorted(counts.groupBy("step").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r["step"]):
        taken += r["words"]
        if taken > most:
            break
        lowest = r["step"]
    top = [] if lowest is None else sorted(counts.where(F.col("step") >= lowest).select("w", "n").collect(), key=lambda r: (-r["n"], r["w"]))
    drop_cut(counts)
    ranks = {r["w"]: i + 1 for i, r in enumerate(top)}
    return ranks | {w: min(i, ranks.get(w, i)) for w, i in _RANK.items()}


def guess_cost(value: str, ranks: dict[str, int] = _RANK) -> float:
    """Log10 of the guesses that the cheapest segmentation needs. Empty: 0. Time and memory grow with the length."""
    n = len(value)
    if not n:
        return 0.0
    low = value.lower()
    plain = low.translate(_LEET)
    starts = [i for i in range(n) if value[i].isdigit() and (i == 0 or not value[i - 1].isdigit())]
    dates = {i: {m.end() for p in _DATES if (m := p.match(value, i))} for i in starts}
    best = [0.0] + [math.inf] * n
    step = math.log10(2)  # each further segment doubles the orders to try
    runs: list[tuple[int, float, int]] = [(0, 0.0, 0)] * n  # end of a repeat, a keyboard walk and a sequence from here
    repeat, walk, row = n, n, n
    for i in range(n - 1, -1, -1):
        repeat = repeat if i + 1 < n and value[i] == value[i + 1] else i + 1
        walk = walk if i + 1 < n and low[i] + low[i + 1] in _NEXT else i + 1
        row = row if i + 1 < n and i + 2 <= row and ord(value[i + 1]) - ord(value[i]) in (1, -1) and (row == i + 2 or ord(value[i + 2]) - ord(value[i + 1]) == ord(value[i + 1]) - ord(value[i])) else i + 2 if i + 1 < n and abs(ord(value[i + 1]) - ord(value[i])) == 1 else i + 1
        runs[i] = repeat, walk, row
    for i in range(n):
        base = best[i] + (step if i else 0.0)
        c = value[i]
        one = 1.0 if c.isdigit() else math.log10(26) if c.isalpha() and c.isascii() else math.log10(33) if c.isascii() else 2.0
        if c.isalpha() and value[i : i + 1] != low[i : i + 1]:
            one += step
        brute = best[i] + one  # a brute-force span grows by a character without a new segment
        best[i + 1] = min(best[i + 1], brute)
        for j in range(i + SHORTEST, min(n, i + LONGEST) + 1):
            rank = ranks.get(low[i:j]) or (plain[i:j] != low[i:j] and 2 * ranks.get(plain[i:j], 0))
            if rank:
                case = 0.0 if value[i:j] == low[i:j] else step if value[i:j] in (low[i:j].title(), low[i:j].upper()) else step * (j - i) / 2
                best[j] = min(best[j], base + math.log10(rank + 1) + case)
        for last, width in zip(runs[i], (12.0, 40.0, 8.0)):
            # a run may also end early, where another segment is cheaper; of long runs only the whole one is tried beyond LONGEST
            for end in (*range(i + 3, min(last, i + LONGEST + 1)), *[last] * (last - i >= 3)):
                best[end] = min(best[end], base + math.log10(width * (end - i)))
        for end in dates.get(i, ()):
            best[end] = min(best[end], base + math.log10(365 * 120 if end - i > 4 else 120))
    return best[n]


def spans_of(text: str | None, least: float = LEAST_COST, ranks: dict[str, int] = _RANK) -> list[tuple[str, int, int, float | None]]:
    """Spans (kind, start, end, guess cost of a credential value) in code points, by start, then kind as listed."""
    if not text:
        return []
    found: list[tuple[int, int, int, float | None]] = []
    values = set()
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 8:
            found.append((m.start(), 0, m.end(), guess_cost(m[2], ranks)))
            values.add(m.start(2))
    found += [(m.start(), 1, m.end(), None) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), None) for m in _HEX.finditer(text)]
    for m in _CONTEXT.finditer(text):
        if m.start(1) not in values and (cost := guess_cost(m[1], ranks)) >= least:
            found.append((m.start(1), 3, m.end(1), cost))
    found.sort()
    return [(KINDS[k], s, e, cost) for s, k, e, cost in found]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("cost", T.DoubleType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]))


def find_secrets(df: DataFrame, text: str = "text", spans: str = "spans", least: float = LEAST_COST, keep_text: bool = True, ranks: dict[str, int] | None = None) -> DataFrame:
    """df with `spans`: kind, start, end (code points, end exclusive) and guess cost of every secret in the whole text.

    ranks: what corpus_ranks() returned; without it, common passwords alone count as words. Null and empty texts have no spans (an
    empty array). Spans that start together come in the order of KINDS. A column of df called like `spans` is replaced. Rows are
    independent, so repeated rows get equal spans and an empty table stays empty.
    """
    held = df.sparkSession.sparkContext.broadcast(ranks or _RANK)  # at most DICTIONARY words and the common passwords
    keep = [c for c in df.columns if c != spans and (keep_text or c != text)]
    (whole,) = fresh(df, "text")
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(spans, SPANS)])

    def run(batches):
        for batch in batches:
            out = [[{"kind": k, "start": s, "end": e, "cost": c} for k, s, e, c in spans_of(x.as_py(), least, held.value)] for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + [pa.array(out, _SPANS)], names=[*keep, spans])

    return df.select(*keep, df[text].alias(whole)).mapInArrow(run, schema)


def joined(spans) -> F.Column:
    """`kind:start:end` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "spans", mark: str = "[SECRET]") -> DataFrame:
    """df with every union of overlapping spans of the text replaced by one mark; the other text stays as it is.

    Null texts stay null; texts without spans are not touched.
    """
    start = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"), s["end"].alias("at"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))),
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, start).otherwise(F.col(text)))
