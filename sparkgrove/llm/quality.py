"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base features come from the whole text. The method's verdict rejects a document when one of the ratios in RULES is above
its stratum's cutoff. The cutoffs are tightened along one fixed path, PATH: every step makes the cutoff of one rule
stricter by one notch, the rules in turn, from none at all to the strictest of all. Labelled documents are a holdout: nothing
is fitted to them but how far each stratum goes. A step is certified for a stratum if the exact (Clopper-Pearson) upper bound
on the share of good documents that any of its cutoffs rejects is at most `risk` at confidence 1 - delta / strata; the stratum goes
up to the first step that is not. Testing in a fixed order needs no correction over the steps, and the division by the number of
strata corrects for these, so with probability 1 - delta no stratum's false rejections, all rules together, exceed `risk`. The
bound is at most `risk` exactly if the binomial probability of no more false rejections than seen, at true rate `risk`, is at
most delta / strata; that sum is what the expressions below compute. Even without a false rejection a stratum needs
ln(strata / delta) / risk good labels, 877 for four strata, to certify a step; one with fewer has the base rules only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, cut, fresh, words

WINDOW = 8
#: Ratio of base features to test, and the grid of cutoffs; a document is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols / n_words", (0.02, 0.05, 0.1, 0.2, 0.5, 1.0)),
    "dup_lines": ("n_dup_lines / n_lines", (0.2, 0.3, 0.4, 0.5, 0.7, 0.9)),
    "repeats": ("n_repeat_words / n_words", (0.05, 0.1, 0.15, 0.2, 0.25)),
    "word_length": ("word_chars / n_words", (5.5, 6.0, 6.5, 7.0, 8.0, 10.0)),
}
#: Largest share of good documents that a stratum's cutoffs reject together, and the chance that any bound fails.
RISK, DELTA = 0.005, 0.05
#: (rule, cutoff) of each step: the loosest cutoff of every rule, then the next of every rule, and so on.
PATH = tuple((r, c) for level in range(max(len(cs) for _, cs in RULES.values())) for r, (_, cs) in RULES.items() for c in sorted(cs)[::-1][level : level + 1])
#: Strata whose steps are broadcast at most; more are joined by shuffle.
BROADCAST_STRATA = 100_000


def features(text) -> dict[str, F.Column]:
    """Base features of a string column: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines.

    Null and empty texts have zeros. A word is `[^\\x20\\x09-\\x0D]+`; lines are \\n-split and count if they hold a word.
    """
    text = F.coalesce(text, F.lit(""))
    token = words(text)
    line = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\n\x0b\x0c\r", "") != "")
    return {
        "n_words": F.size(token).cast("long"),
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size(line).cast("long"),
        "n_dup_lines": (F.size(line) - F.size(F.array_distinct(line))).cast("long"),
        "n_repeat_words": repeated(token),
    }


def repeated(token, width: int = WINDOW) -> F.Column:
    """Words inside windows of `width` words, a power of two, that occur twice or more in the array, the first occurrence included.

    Windows are compared by 64-bit hashes within one text. Their sorted (hash, position) pairs put equal windows side by
    side, so the cost is n log n; texts without a repeated window, nearly all, stop at a distinct count.
    """

    def covered(hashes):
        pair = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(pairs):
            same = lambda x, j: F.coalesce(F.get(pairs, j)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(pairs, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

        def total(at):
            return F.aggregate(F.transform(at, lambda x, j: F.coalesce(F.least(F.get(at, j + 1) - x, F.lit(width)), F.lit(width))), F.lit(0), lambda a, b: a + b)

        return let(pair, lambda p: let(positions(p), total))

    def count(hashes):
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    def doubled(hashes, far):
        """Hashes of the runs twice as long: of each run and the one that follows it."""
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + far)))

    def windows(hashes, far=1):
        if far < width:
            return let(doubled(hashes, far), lambda h: windows(h, 2 * far))
        return let(F.slice(hashes, 1, F.size(hashes) - width + 1), count)

    def whole(t):
        return F.when(F.size(t) <= width, F.lit(0)).otherwise(let(F.transform(t, lambda w: F.xxhash64(w)), lambda h: windows(h)))

    return let(token, whole).cast("long")


def let(value, body) -> F.Column:
    """body(value) with value computed once: a higher-order function over a single element binds it."""
    return F.get(F.transform(F.array(value), body), 0)


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumns(features(F.col(text)))


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _ratio(name: str) -> F.Column:
    over, under = RULES[name][0].split(" / ")
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(0.0)


def certified(n, k, risk: float, level) -> F.Column:
    """True if k false rejections among n bound their rate by risk at confidence 1 - level: P(Bin(n, risk) <= k) <= level."""
    odds = math.log(risk / (1 - risk))
    first = n * F.lit(math.log1p(-risk))
    sum_ = F.aggregate(
        F.sequence(F.lit(0), F.least(k, n).cast("int")),
        F.struct(first.alias("term"), F.lit(0.0).alias("cdf")),
        lambda a, i: F.struct((a["term"] + F.log((n - i) / (i + 1.0)) + odds).alias("term"), (a["cdf"] + F.exp(a["term"])).alias("cdf")),
        lambda a: a["cdf"],
    )
    return (n > k) & (k <= n * risk) & (sum_ <= level)


def first_step() -> F.Column:
    """The first step of PATH, from 1, whose cutoffs reject a row; none: one more than there are."""
    out = F.lit(len(PATH) + 1)
    for i in range(len(PATH), 0, -1):
        rule, cutoff = PATH[i - 1]
        out = F.when(_ratio(rule) > cutoff, F.lit(i)).otherwise(out)
    return out


def cutoffs_of(step: int) -> dict[str, float]:
    """The cutoffs in force after a number of steps; rules without one are off."""
    return dict(PATH[:step])


def certified_steps(rated: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "stratum", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """stratum, n (good labels), step: how many steps of PATH are certified for each stratum with labels.

    rated: features by key, and a stratum. labels: key and quality; a document is good if every label it has says 1, and
    documents that the base rules reject are left out. Null labels and keys count for nothing.
    """
    (one,) = fresh(rated, "key")
    good = labels.where(F.col("quality").isNotNull()).groupBy(labels[key].alias(one)).agg(F.min("quality").alias("q")).where("q = 1").select(one)
    held = rated.where(~base_failed()).join(good, rated[key] == good[one]).select(rated[stratum].alias("stratum"), first_step().alias("at"))
    # one pass: for each stratum the number of good documents, and for each step of those that it rejects
    counts = cut(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("at") <= i).alias(f"k{i}") for i in range(1, len(PATH) + 1)]))
    level = F.lit(delta / max(1, counts.count()))
    passed = F.array(*[certified(F.col("n"), F.col(f"k{i}"), risk, level) for i in range(1, len(PATH) + 1)], F.lit(False))
    return counts.select("stratum", "n", (F.array_position(passed, F.lit(False)) - 1).cast("int").alias("step"))


def judge(rated: DataFrame, steps: DataFrame, stratum: str = "stratum") -> DataFrame:
    """rated with base_failed and kept. steps: what certified_steps() returned; strata that it lacks have the base rules only."""
    mine, go = fresh(rated, "mine", "go")
    steps = cut(steps.where("step > 0").select(F.col("stratum").alias(mine), F.col("step").alias(go)))
    if steps.count() <= BROADCAST_STRATA:
        steps = F.broadcast(steps)
    joined = rated.join(steps, rated[stratum] == steps[mine], "left")
    out = joined.withColumns({"base_failed": base_failed(), "kept": ~base_failed() & (first_step() > F.coalesce(F.col(go), F.lit(0)))})
    return out.drop(mine, go)


def rate(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """key, features, stratum, base_failed and kept of every row of df; carry: columns that come along in a struct `row`.

    Null strata form a stratum of their own, and any number of strata is judged; an empty labels table certifies nothing, so only the base rules reject. Repeated
    keys are judged row by row. The features are computed once and cut in the shared folder, as thresholds need them first.
    """
    row = [F.struct(*[df[c] for c in carry]).alias("row")] if carry else []
    rated = df.select(F.col(key), *row, F.coalesce(F.concat(F.lit("="), F.col(stratum)), F.lit("null")).alias("stratum"), *[c.alias(n) for n, c in features(F.col(text)).items()])
    rated = cut(rated)
    return judge(rated, certified_steps(rated, labels, key))
