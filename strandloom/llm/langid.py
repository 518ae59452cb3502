"""Language ID by hierarchical discrimination: family first, then one-versus-one linear support vector machines within it.

Features are hashed byte n-grams (1 to 3) of the lower-cased letters of the whole text, square-rooted and scaled to unit
length; executors compute them for training and for prediction alike. The classifier is fitted on the driver from at most
`per_language` rows of each language (chosen by a hash of the row), whatever the size of the table: so many vectors of
`DIMS` floats and no more are collected. Prediction is one Python pass per Arrow batch without a shuffle.

Defined results: null text, empty text and text without a letter give `und` with score 0; rows with null lang are not
learnt from; with no rows to learn from all is `und`; repeated rows are predicted alike; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import pick, pieces

DIMS, BUCKETS = 2048, 4096
#: Language families; a language that is in none forms its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "bg", "sr"),
}
_LETTER = re.compile(r"[^\W\d_]")
_CLEAN = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256))


def family_of(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v), lang)


def features(text: str) -> np.ndarray:
    """Unit vector of hashed n-grams."""
    raw = b" " + b" ".join(text.lower().encode().translate(_CLEAN).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    count = np.zeros(DIMS)
    for gram, salt in ((b, 0x9E3779B1), (two, 0x85EBCA6B), (three, 0xC2B2AE35)):
        at = (gram * np.uint32(salt)) >> np.uint32(32 - DIMS.bit_length() + 1)
        count += np.sqrt(np.bincount(at, minlength=DIMS))
    return (count / (np.linalg.norm(count) or 1.0)).astype(np.float32)


def svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of a linear support vector machine; y is -1 or 1. Dual coordinate descent, L2-loss."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    norm = (x * x).sum(1) + 0.5 / cost
    order, rng = np.arange(len(x)), np.random.default_rng(seed)
    for _ in range(rounds):
        rng.shuffle(order)
        for i in order:
            new = max(0.0, alpha[i] - (y[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost) / norm[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


class Hierarchy:
    """Pairwise machines between families, and between the languages of each family."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        fam = np.array([family_of(k) for k in lang.tolist()])
        self.families = {f: [k for k in self.langs if family_of(k) == f] for f in sorted(set(fam.tolist()))}
        self.between = self._pairs(x, fam, list(self.families))
        self.within = {f: self._pairs(x, lang, ks) for f, ks in self.families.items()}

    @staticmethod
    def _pairs(x: np.ndarray, label: np.ndarray, names: list[str]) -> dict[tuple[str, str], np.ndarray]:
        out = {}
        for a, b in combinations(names, 2):
            m = (label == a) | (label == b)
            out[a, b] = svm(x[m], np.where(label[m] == a, 1.0, -1.0))
        return out

    @staticmethod
    def _vote(x: np.ndarray, names: list[str], pairs: dict) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of the winner by votes, then by margins, and how sure (0 to 1)."""
        votes, margin = np.zeros((len(x), len(names))), np.full((len(x), len(names)), 9.0)
        total = np.zeros_like(votes)
        for (a, b), w in pairs.items():
            i, j = names.index(a), names.index(b)
            m = x @ w[:-1] + w[-1]
            votes[:, i] += m >= 0
            votes[:, j] += m < 0
            total[:, i] += m
            total[:, j] -= m
            margin[:, i], margin[:, j] = np.minimum(margin[:, i], m), np.minimum(margin[:, j], -m)
        best = np.argmax(votes + np.tanh(total) / 4, axis=1)
        return best, 1 / (1 + np.exp(-3 * margin[np.arange(len(x)), best]))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fams = list(self.families)
        fam, score = self._vote(x, fams, self.between)
        lang = np.empty(len(x), object)
        for i, f in enumerate(fams):
            if (m := fam == i).any():
                k, s = self._vote(x[m], self.families[f], self.within[f])
                lang[m] = np.array(self.families[f], object)[k]
                score[m] = np.minimum(score[m], s)
        return lang, score


def fit(labelled: DataFrame, per_language: int = 750) -> Hierarchy | None:
    """From the columns doc_id, text, lang. per_language bounds the rows of each language that are learnt from: of BUCKETS
    groups of a language's rows by hash, the first row of each, and of these the first ones. Equal rows count once."""
    rows = pick(labelled, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("key", F.xxhash64("doc_id", "lang", "text"))
    ids = rows.groupBy("lang", F.pmod("key", F.lit(BUCKETS)).alias("bucket")).agg(F.min("key").alias("key"))  # combined before the shuffle
    first = Window.partitionBy("lang").orderBy(F.hash("key"), "key")
    ids = ids.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language)
    sample = rows.join(F.broadcast(ids.select("lang", "key")), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"]).select("lang", "text")  # per_language rows of each language at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(k, features(t)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if _LETTER.search(t)]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k for k, _ in keep], pa.string()), "x": pa.array([x.tobytes() for _, x in keep], pa.binary())})

    got = sample.mapInArrow(run, "lang string, x binary").toPandas().sort_values(["lang", "x"])
    if got.empty:
        return None
    return Hierarchy(np.stack([np.frombuffer(x, np.float32) for x in got["x"]]), got["lang"].to_numpy())


def predict(docs: DataFrame, model: Hierarchy | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(doc_id, lang_pred, score)` of every text."""
    src = pick(docs, **{"doc_id": id_col, "text": text_col})
    kind = src.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 500):
            texts = [t or "" for t in b.column(1).to_pylist()]
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            at = [i for i, t in enumerate(texts) if _LETTER.search(t)] if sent.value else []
            if at:
                lang[at], score[at] = sent.value.predict(np.stack([features(texts[i]) for i in at]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return src.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id):
    """Whether a document is kept for testing: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(doc_id.cast("string")) % 5 == 0
