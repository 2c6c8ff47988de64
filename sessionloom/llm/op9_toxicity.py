"""Toxicity by compression distance: text windows under two zstandard dictionaries.

The ordinary dictionary is trained on ordinary text. The toxic one holds the same bytes and, in front of them, the words of
toxic text that ordinary text lacks, so both compress ordinary windows alike, and a window that the toxic dictionary
makes shorter holds toxic text. A document's saved bytes over its windows become a probability by a logistic curve, which
is calibrated on labelled documents that neither dictionary has seen and moved to the share of toxic labels.

Learning takes a bounded sample: at most ``SAMPLE`` labelled rows of either label with texts of up to ``LONGEST`` characters,
lowest hash of the id first, half for the dictionaries, half for the calibration. Scoring reads every whole text.

Defined cases: null and empty texts have no saved bytes and get the curve's value for that; repeated rows get equal scores;
without toxic or without ordinary labels to learn from every score is 0. Null labels are not learned from. Other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

#: Labelled rows of either label that are learned from, and the longest text taken.
SAMPLE = 2_000
LONGEST = 65_536
#: Words of a window; windows don't overlap.
WINDOW = 4
DICTIONARY = 8_192
#: A stem is toxic that stands in so many different contexts and is so many times as frequent as in ordinary text.
CONTEXTS, LIFT = 8, 15.0
_words = re.compile(r"\w+").findall


def _stems(word: str) -> list[str]:
    return [word] if len(word) < 5 else [word[:k] for k in range(4, min(len(word), 12) + 1)] + ([word] if len(word) > 12 else [])


def _toxic_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Words of toxic texts, rarest first, whose stems stand in many contexts there and in few of ordinary texts.

    Contexts (the words before and after) are counted once, so that copies of a text don't make its words frequent.
    """
    often = Counter(s for t in toxic for w in set(_words(t.lower())) for s in _stems(w))
    often = {s for s, n in often.items() if n >= 3}

    def contexts(texts: list[str]) -> tuple[Counter, int]:
        seen, total = set(), 0
        for t in texts:
            w = ["", *_words(t.lower()), ""]
            total += len(w)
            for before, word, after in zip(w, w[1:], w[2:]):
                for s in _stems(word):
                    if s in often:
                        seen.add((s, hash((before, after))))
        return Counter(s for s, _ in seen), total

    here, n = contexts(toxic)
    there, m = contexts(ordinary)
    good = {s for s, k in here.items() if k >= CONTEXTS and (k / n) / ((there[s] + 0.5) / m) >= LIFT}
    found = Counter(w for t in toxic for w in _words(t.lower()) if any(s in good for s in _stems(w)))
    return sorted((w for w, k in found.items() if w in good or k >= 2), key=lambda w: (found[w], w))


def _ordinary_bytes(texts: list[str]) -> bytes:
    samples = []
    for t in texts:
        w = _words(t.lower())
        samples += [" ".join(w[i:i + 12]).encode() for i in range(0, len(w), 40)]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself
        return b" ".join(samples)[-DICTIONARY:]


@dataclass(frozen=True)
class Model:
    """Two dictionaries and a curve: all that scoring needs, some ten thousand bytes."""

    ordinary: bytes
    toxic: bytes
    center: tuple = ()
    scale: tuple = ()
    weights: tuple = ()

    def compressors(self):
        def of(content: bytes):
            params = zstandard.ZstdCompressionParameters.from_level(
                9, window_log=17, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
            return zstandard.ZstdCompressor(
                compression_params=params, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress
        return of(self.ordinary), of(self.toxic)

    def features(self, text: str | None, compressors) -> list[float]:
        plain, toxic = compressors
        w = _words((text or "").lower())
        windows = [(" " + " ".join(w[i:i + WINDOW])).encode("utf-8", "replace") for i in range(0, len(w), WINDOW)] or [b""]
        saved = np.fromiter((len(plain(x)) - len(toxic(x)) for x in windows), np.float64, len(windows))
        return [saved.max(), np.sort(saved)[-3:].mean(), saved.mean() * 3, (saved >= 3).mean() * 10, np.log1p((saved >= 3).sum())]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(rows))
        z = (rows - np.asarray(self.center)) / np.asarray(self.scale)
        return 1 / (1 + np.exp(-np.clip(z @ np.asarray(self.weights[:-1]) + self.weights[-1], -30, 30)))


def fit(rows: list[tuple[str, int, bool]], share: float) -> Model:
    """A model from ``(text, label, whether for the dictionaries)``; ``share`` is the part of toxic labels in all."""
    learn = {y: [t for t, label, first in rows if first and label == y] for y in (0, 1)}
    if not learn[0] or not learn[1] or not 0 < share < 1:
        return Model(b" " * 8, b" " * 8)
    base = _ordinary_bytes(learn[0]) or b" " * 8
    model = Model(base, " ".join(["", *_toxic_words(learn[1], learn[0]), ""]).encode() + base)
    held = [(t, y) for t, y, first in rows if not first]
    if len({y for _, y in held}) < 2:
        held = [(t, y) for t, y, _ in rows]
    both = model.compressors()
    x = np.asarray([model.features(t, both) for t, _ in held])
    y = np.asarray([y for _, y in held], float)
    center, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - center) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton steps for the penalized logistic fit
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), z.T @ (p - y) + 0.1 * w)
    w[-1] += np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean()))
    return Model(model.ordinary, model.toxic, tuple(center), tuple(scale), tuple(w))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from the rows of ``labels (doc_id, toxic)`` and their texts."""
    rows = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    shares = rows.agg(F.sum("toxic").alias("k"), F.count("*").alias("n")).first()
    mark = F.xxhash64("doc_id")
    taken = [rows.where(F.col("toxic") == y).orderBy(mark, "doc_id").limit(sample) for y in (0, 1)]
    # at most 2 * sample rows on the small side
    texts = docs.where(F.length("text") <= LONGEST).select("doc_id", "text").join(F.broadcast(taken[0].union(taken[1])), "doc_id")
    got = sorted((r.text, r.toxic, r.first) for r in texts.select("text", "toxic", (mark % 2 == 0).alias("first")).toLocalIterator())
    return fit(got, shares.k / shares.n if shares.n else 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (``text`` and others) with ``score``, 0 to 1."""
    kept = [c for c in docs.columns if c != "score"]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        both = model.compressors()
        for batch in batches:
            x = np.asarray([model.features(t.as_py(), both) for t in batch.column("text")]).reshape(batch.num_rows, -1)
            values = model.scores(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*kept, "score"])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels are learned from three quarters of the rows."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out))
    done = score(docs.withColumn("held_out", held_out), model)
    return done.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


QUERIES = {"op9_toxicity": op9_toxicity}
SQL: dict[str, str] = {}
