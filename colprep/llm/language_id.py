"""Hierarchical language identification: family first, then one-versus-one linear support vector machines.

Features are frequencies of hashed byte n-grams (1 to 4 bytes of lower-case text, anything but letters counts as
a blank), taken over the whole text. As frequencies add up to one, an intercept folds into the weights and a
machine's margin is the mean weight of a text's n-grams: prediction needs no vectors, only table look-ups.

Level one holds one-versus-one machines between families, level two between the languages of each family with
several. Squared-hinge machines are fitted by accelerated gradient steps on a bounded sample of labelled rows:
about ``per_language`` rows of each language, drawn by a hash of the row number column from all of them.

Cases: a null text or one without a letter is ``und`` with score 0; a learned language is returned otherwise;
no labelled row at all gives ``und`` everywhere; one language alone is always predicted; rows are handled one by
one, so repeated rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colprep.llm.common import classes, lower_bytes, mixed, slices

BINS = 1 << 13
ORDERS = (1, 2, 3, 4)
PER_LANGUAGE = 300

# Families of languages; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}


def family(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def _grams(data: np.ndarray, offsets: np.ndarray):
    """(n-gram bins per order at every place of the padded text, offsets of the padded rows)."""
    rows = len(offsets) - 1
    padded = np.full(len(data) + 2 * rows + 4, 32, np.uint64)
    row = np.repeat(np.arange(rows), np.diff(offsets))
    kind = classes(data)
    letters = np.where((kind == 1) | (data >= 128), lower_bytes(data), 32)
    padded[np.arange(len(data)) + 2 * row + 1] = letters
    at = offsets + 2 * np.arange(rows + 1)
    bins = []
    code = np.zeros(at[-1], np.uint64)
    for order in ORDERS:
        code = (code << np.uint64(8)) | padded[order - 1 : order - 1 + at[-1]]
        bins.append((mixed(code + np.uint64(order << 40)) & np.uint64(BINS - 1)).astype(np.int64))
    return bins, at


def frequencies(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of n-gram frequencies, each adding up to one."""
    bins, at = _grams(data, offsets)
    out = np.zeros((len(offsets) - 1, BINS), np.float32)
    for row in range(len(offsets) - 1):
        for found in bins:
            out[row] += np.bincount(found[at[row] : at[row + 1]], minlength=BINS)
    return out / out.sum(1, keepdims=True)


def margins(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(rows, machines): mean weights of the n-grams."""
    bins, at = _grams(data, offsets)
    out = np.zeros((len(offsets) - 1, len(weights)))
    for k, table in enumerate(weights):
        total = np.zeros(at[-1], np.float32)
        for found in bins:
            total += table[found]
        out[:, k] = np.add.reduceat(total, at[:-1], dtype=np.float64)
    return out / (len(ORDERS) * np.diff(at))[:, None]


def fit_machine(x: np.ndarray, positive: np.ndarray, steps: int = 80, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge); the intercept is folded in."""
    y = np.where(positive, 1.0, -1.0).astype(np.float32)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())).astype(np.float32)
    # one copy of the matrix, in place; scalars come from math, as those of NumPy would make all that follows 64 bits wide
    centre = x.mean(0)
    scale = np.sqrt(np.concatenate([x[:, k : k + 512].std(0) for k in range(0, x.shape[1], 512)]) + 1e-6)
    z = x - centre
    z /= scale
    factor = float(np.sqrt(np.concatenate([(z[k : k + 64] ** 2).sum(1) for k in range(0, len(z), 64)]).mean()))
    z /= max(1e-12, factor)
    # the largest eigenvalue of the curvature bounds the step
    v = np.ones(z.shape[1], np.float32) / math.sqrt(z.shape[1])
    for _ in range(20):
        v = z.T @ (share * (z @ v))
        norm = float(np.linalg.norm(v))
        v /= max(norm, 1e-12)
    rate = 1.0 / (2 * norm + penalty)
    w, ahead, momentum = np.zeros(z.shape[1], np.float32), np.zeros(z.shape[1], np.float32), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ ahead))
        new = ahead - rate * (penalty * ahead - 2 * (z.T @ (share * y * slack)))
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    folded = w / scale / max(factor, 1e-12)
    return (folded - float(folded @ centre)).astype(np.float32)


class Model:
    """Pairs of labels with their machines, for families and for the languages of each family."""

    def __init__(self, languages: list[str], pairs: list[tuple[str, str, str]], weights: np.ndarray):
        self.languages, self.pairs, self.weights = languages, pairs, weights
        self.families = defaultdict(list)
        for language in languages:
            self.families[family(language)].append(language)

    def _vote(self, level: str, labels: list[str], margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Winner of the one-versus-one votes of a level, and its least certain vote."""
        votes = np.zeros((len(margin), len(labels)))
        sure = np.ones((len(margin), len(labels)))
        for k, (at, a, b) in enumerate(self.pairs):
            if at == level:
                chance = 1 / (1 + np.exp(-4 * np.clip(margin[:, k], -8, 8)))
                i, j = labels.index(a), labels.index(b)
                votes[:, i] += (chance >= 0.5) + chance / 1000
                votes[:, j] += (chance < 0.5) + (1 - chance) / 1000
                sure[:, i] = np.minimum(sure[:, i], chance)
                sure[:, j] = np.minimum(sure[:, j], 1 - chance)
        winner = votes.argmax(1)
        return winner, sure[np.arange(len(margin)), winner]

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names = list(self.families)
        margin = margins(data, offsets, self.weights) if len(self.weights) else np.zeros((len(offsets) - 1, 0))
        top, score = self._vote("", names, margin)
        out = np.empty(len(top), object)
        for k, name in enumerate(names):
            at = np.flatnonzero(top == k)
            if len(at):
                winner, sure = self._vote(name, self.families[name], margin[at])
                out[at] = np.array(self.families[name], object)[winner]
                score[at] = np.minimum(score[at], sure)
        return out, score


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fit on ``per_language`` texts of every language at most; None if there is no labelled text.

    Texts are drawn by their hash, so ids of any kind do not matter and a repeated text counts once.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    if not counts:
        return None
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])[F.col("lang")]

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                for row, vector in zip(range(low, high), frequencies(data, offsets), strict=True):
                    at = np.flatnonzero(vector)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([vector[at].tobytes()], pa.binary())], names=["lang", "bins", "x"])

    # some per_language rows of a language are left for the window: copies are put together before
    drawn = rows.where(draw < share).select("lang", F.xxhash64("text").alias("row"), "text").dropDuplicates(["lang", "row"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("row"))
    sample = drawn.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "text").mapInArrow(run, "lang string, bins binary, x binary").toArrow()
    lang = np.array(sample.column("lang").to_pylist(), object)
    x = np.zeros((len(lang), BINS), np.float32)
    for row, (bins, values) in enumerate(zip(sample.column("bins"), sample.column("x"), strict=True)):
        x[row, np.frombuffer(bins.as_py(), np.uint16)] = np.frombuffer(values.as_py(), np.float32)
    del sample
    languages = sorted(set(lang.tolist()))
    families = np.array([family(v) for v in lang], object)
    groups = [("", families)] + [(name, np.where(families == name, lang, None)) for name in sorted(set(families.tolist()))]
    pairs, weights = [], []
    for level, label in groups:
        for a, b in combinations(list(dict.fromkeys(sorted({v for v in label if v is not None}))), 2):
            of = (label == a) | (label == b)
            pairs.append((level, a, b))
            weights.append(fit_machine(x if of.all() else x[of], label[of] == a))
    return Model(languages, pairs, np.array(weights, np.float32).reshape(len(pairs), BINS))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score for every row."""

    def run(batches):
        for batch in batches:
            for low, high, data, offsets in slices(batch.column(1)):
                letter = np.concatenate([[0], np.cumsum(classes(data) == 1)])
                some = letter[offsets[1:]] > letter[offsets[:-1]]
                for row in np.flatnonzero(~some):
                    some[row] = any(c.isalpha() for c in batch.column(1)[low + int(row)].as_py() or "")
                language, score = model.predict(data, offsets) if model else (np.full(high - low, "und", object), np.zeros(high - low))
                language[~some], score[~some] = "und", 0.0
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(language.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def remainder(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; rows where it is 2 are held out."""
    return F.crc32(F.col(id_col).cast("string")) % 4


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Fit on the rows that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(F.coalesce(remainder(), F.lit(0)) != 2), per_language)
    return predict(docs, model).select("doc_id", (F.coalesce(remainder(), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score")


def drop_undetermined(docs: DataFrame) -> DataFrame:
    """Documents with a language: the filter of the pipeline, with all their columns.

    Only texts without a letter go (all, if no language can be learned); the machines' score rejects nothing.
    Rows are told apart by a hash of id and text.
    """
    model = fit(docs.where(F.coalesce(remainder(), F.lit(0)) != 2))
    rows = docs.select(F.xxhash64("doc_id", F.col("text").cast("string")).alias("doc_id"), "text")
    rejected = predict(rows, model).where("lang_pred = 'und'").select(F.col("doc_id").alias("rejected_row")).distinct()
    return docs.join(rejected, F.xxhash64(docs["doc_id"], docs["text"].cast("string")) == rejected["rejected_row"], "left_anti").select(*docs.columns)
