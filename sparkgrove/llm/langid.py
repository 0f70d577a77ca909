"""Language identification: the language family first, then one-versus-one linear SVMs within the family.

Features are hashed byte trigrams of the whole text, square-rooted and of unit length; letters are lower-cased in ASCII and
all that is not a letter or a byte beyond ASCII counts as a space. Models are squared-hinge linear SVMs, fitted on the
driver on a bounded draw of labelled rows (PER_LANGUAGE a language); every row is then predicted row-wise.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .minhash import _steps

#: Labelled rows that each language's models are fitted on at most, features.
PER_LANGUAGE, FEATURES = 800, 2048
#: Documents whose features are held at once.
LOT = 1024
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn ur mr gu pa ne si",
    "semitic": "ar he mt am",
    "sinitic": "zh yue wuu",
}
FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
for _a, _z in ((65, 90), (97, 122)):
    _FOLD[_a : _z + 1] = np.arange(97, 123)


def family_of(lang: str) -> str:
    """The family of a language code; a language without a known family is one of its own."""
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


def vectors(data: bytes, sizes: np.ndarray, width: int = FEATURES) -> np.ndarray:
    """Feature rows of the documents that lie one after another in data."""
    n = len(sizes)
    raw = _FOLD[np.frombuffer(data, np.uint8)]
    if len(raw) < 3:
        return np.zeros((n, width), np.float32)
    code = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - width.bit_length() + 1)
    ends = np.cumsum(sizes)
    doc = np.repeat(np.arange(n), sizes)[:-2]
    inside = np.arange(len(code)) + 2 < ends[doc]
    doc, code = doc[inside], code[inside]
    x = np.empty((n, width), np.float32)
    for i in range(0, n, LOT):  # counts are 8 bytes each, so they are made for a lot of documents at a time
        a, b = np.searchsorted(doc, (i, i + LOT))
        rows = min(LOT, n - i)
        x[i : i + rows] = np.sqrt(np.bincount((doc[a:b] - i) * width + code[a:b], minlength=rows * width).reshape(rows, width))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def svm(x: np.ndarray, y: np.ndarray, c: float = 30.0, rounds: int = 120) -> np.ndarray:
    """Weights (the last is the bias) of a linear SVM with squared hinge loss; y is -1 or 1. Accelerated gradient descent.

    Classes count alike, however many rows each has.
    """
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], axis=1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = v = np.zeros(x.shape[1], np.float32)
    step = np.float32(1 / (1 + 4 * c))  # rows have length sqrt(2)
    t = 1.0
    for _ in range(rounds):
        gap = np.maximum(0, 1 - y * (x @ v))
        after = v - step * (v - 2 * c * (x.T @ (share * y * gap)))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = after + np.float32((t - 1) / t2) * (after - w), after, t2
    return w


class Model:
    """One-versus-one SVMs among families, and among the languages of each family."""

    def __init__(self, langs: list[str], x: np.ndarray, y: np.ndarray):
        """langs: the learned languages in order; y: the number of each row's language."""
        self.langs = langs
        self.families = sorted({family_of(lang) for lang in langs})
        self.member = {f: [i for i, lang in enumerate(langs) if family_of(lang) == f] for f in self.families}
        fam = np.array([self.families.index(family_of(lang)) for lang in langs], np.int64)
        self.between = self._pairs(x, fam[y], list(range(len(self.families)))) if len(y) else []
        self.within = {f: self._pairs(x, y, ids) for f, ids in self.member.items()}

    @staticmethod
    def _pairs(x, y, ids):
        out = []
        for a, b in itertools.combinations(ids, 2):
            use = (y == a) | (y == b)
            out.append((a, b, svm(x[use], np.where(y[use] == a, 1, -1).astype(np.float32))))
        return out

    @staticmethod
    def _decide(x: np.ndarray, ids: list[int], pairs) -> tuple[np.ndarray, np.ndarray]:
        """The id with most wins, ties by the sum of margins, and the least probability of its wins."""
        votes, sure = np.zeros((len(x), len(ids))), np.ones((len(x), len(ids)))
        for a, b, w in pairs:
            p = 1 / (1 + np.exp(-np.clip(4 * (x @ w[:-1] + w[-1]), -30, 30)))
            i, j = ids.index(a), ids.index(b)
            votes[:, i] += (p >= 0.5) + p * 1e-3
            votes[:, j] += (p < 0.5) + (1 - p) * 1e-3
            sure[:, i], sure[:, j] = np.minimum(sure[:, i], p), np.minimum(sure[:, j], 1 - p)
        best = votes.argmax(axis=1)
        return np.array(ids)[best], sure[np.arange(len(x)), best]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fam, p = self._decide(x, list(range(len(self.families))), self.between)
        lang, score = np.zeros(len(x), np.int64), p.copy()
        for i, f in enumerate(self.families):
            at = np.flatnonzero(fam == i)
            if len(at):
                lang[at], q = self._decide(x[at], self.member[f], self.within[f])
                score[at] *= q
        return lang, score


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, seed: int = 3) -> Model:
    """A model from rows with a text and a label. The draw depends on a hash of the key, about per_language rows of each language."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), lang).collect()  # every language that occurs
    langs = sorted(r[lang] for r in counts)
    rates = labelled.sparkSession.createDataFrame([(r[lang], min(1.0, per_language / r["n"])) for r in counts], "l string, rate double")

    def run(batches):
        for batch in batches:
            for i, j, data, sizes in _steps(batch.column(1)):
                x = vectors(data, sizes).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([v.tobytes() for v in x], pa.binary()), batch.column(2).slice(i, j - i)], names=["lang", "x", "at"])

    given = rows.select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(F.lit(seed), F.col(key)).alias("at"))
    drawn = given.join(F.broadcast(rates), given["lang"] == rates["l"]).where(F.pmod("at", F.lit(1 << 30)) < F.col("rate") * (1 << 30)).select("lang", "t", "at")
    # the draw's size varies a little; the order makes what stays beyond twice that size, and so the model, the same at each run
    most = per_language * max(1, len(langs)) * 2
    got = sorted(drawn.mapInArrow(run, "lang string, x binary, at long").orderBy(F.pmod("at", F.lit(1 << 30)), "at", "lang", "x").limit(most).collect(), key=lambda r: (r["at"], r["lang"], r["x"]))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, FEATURES), np.float32)
    return Model(langs, x, np.array([langs.index(r["lang"]) for r in got], np.int64))


def predict(df: DataFrame, model: Model, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", keep_text: bool = True) -> DataFrame:
    """df with lang_pred and score (0 to 1), from the whole text.

    Null texts and texts without a letter, and all texts if nothing was learned: `und`, score 0. Equal votes go to the larger sum of
    probabilities, then to the language that comes first by code point. Columns of df with these names are replaced. Row-wise; an empty table stays empty.
    """
    held = df.sparkSession.sparkContext.broadcast(model)  # (languages choose 2) vectors
    keep = [c for c in df.columns if c not in (lang_pred, score) and (keep_text or c != text)]
    (whole,) = fresh(df, "text")
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])

    def run(batches):
        m = held.value
        for batch in batches:
            column = batch.column(len(keep))
            letters = [_has_letter(t) for t in column.to_pylist()]
            langs, scores = [], []
            for _, _, data, sizes in _steps(column):
                if m.langs:
                    y, p = m.predict(vectors(data, sizes))
                    langs += [m.langs[i] for i in y.tolist()]
                    scores += p.tolist()
                else:
                    langs, scores = langs + [UNKNOWN] * len(sizes), scores + [0.0] * len(sizes)
            langs = [a if ok else UNKNOWN for a, ok in zip(langs, letters, strict=True)]
            scores = [float(p) if ok else 0.0 for p, ok in zip(scores, letters, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(len(keep))] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, lang_pred, score])

    return df.select(*keep, df[text].alias(whole)).mapInArrow(run, schema)
