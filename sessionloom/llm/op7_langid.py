"""Language identification by rank-order profiles of character n-grams.

A profile is the list of a language's (or a document's) most frequent n-grams of one to three characters, most frequent
first. A document's distance to a language is the sum, over the document's profile, of how far each n-gram's rank is out of
place in the language's profile; an n-gram that is not there counts the length of the profile. The nearest language wins.

Training counts the n-grams of all labelled texts: each task sums its own texts before anything is shuffled. Profiles hold
at most ``PROFILE`` n-grams for each language name, which is all that the scoring tasks receive.

Defined cases: null texts and texts without a letter are ``und`` with score 0. Distances tie in favour of the first name in
order of code points. Repeated rows get equal answers; in training they count as often as they stand there. Rows with null
``lang`` are not learned from. Without any training text every answer is ``und``. Other columns are ignored. The score is
the part by which the second nearest language is further away, 0 for a tie; with one language alone, its closeness.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import table, text_blocks

LENGTHS = (1, 2, 3)
#: N-grams of a language's profile and of a document's.
PROFILE = 400
#: Distinct n-grams a task sums before it hands them on; bounds its memory.
HELD = 400_000
_BITS = 21
_letters: list[np.ndarray] = []


def _codes(data: np.ndarray) -> np.ndarray:
    """Code points in lower case, with everything but letters as a space."""
    if not _letters:
        fold = np.full(0x110000, 0x20, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                fold[c] = ord(low[0])
        _letters.append(fold)
    return _letters[0][np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]


def _grams(code: np.ndarray) -> np.ndarray:
    """All n-grams of one text, packed 21 bits a character; words are padded by one space."""
    code = code.astype(np.int64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0x20) | (code[:-1] != 0x20)  # one space between words
    code = np.concatenate([[0x20], code[keep], [0x20]])
    out, gram = [], np.zeros(len(code), np.int64)
    for n in LENGTHS:
        gram = (gram[:len(code) - n + 1] << _BITS) | code[n - 1:]
        inner = np.ones(len(gram), bool)
        for i in range(1, n - 1):  # n-grams don't reach over a space
            inner &= code[i:i + len(gram)] != 0x20
        if n == 1:
            inner = code != 0x20
        elif n == 2:
            inner = (code[:-1] != 0x20) | (code[1:] != 0x20)
        out.append(gram[inner])
    return np.concatenate(out)


def _documents(batches):
    """``(batch, row, n-grams of the row's text)``; texts without a letter give no n-grams."""
    for batch, data, off in text_blocks(batches):
        code = _codes(data)
        begin = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]
        for i, (a, b) in enumerate(zip(begin[:-1].tolist(), begin[1:].tolist())):
            own = code[a:b]
            yield batch, i, _grams(own) if (own != 0x20).any() else np.zeros(0, np.int64)


def _count(batches):
    totals: dict[str, list] = {}

    def fold(parts):
        grams = np.concatenate([p[0] for p in parts])
        counts = np.concatenate([p[1] for p in parts])
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order]
        cut = np.flatnonzero(np.diff(grams, prepend=-1))
        return [(grams[cut], np.add.reduceat(counts, cut))] if len(cut) else []

    def hand_on():
        for lang, parts in totals.items():
            for grams, counts in fold(parts):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])
        totals.clear()

    held, langs, last = 0, [], None
    for batch, i, grams in _documents(batches):
        if batch is not last:
            last, langs = batch, batch.column("lang").to_pylist()
        if not len(grams):
            continue
        parts = totals.setdefault(langs[i], [])
        parts.append(np.unique(grams, return_counts=True))
        held += len(parts[-1][0])
        if held > 10 * HELD:
            for key in totals:
                totals[key] = fold(totals[key])
            held = sum(len(p[0]) for parts in totals.values() for p in parts)
            if held > HELD:
                yield from hand_on()
                held = 0
    yield from hand_on()


def train(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """``(lang, gram, rank)``: the ``size`` most frequent n-grams of each language of ``labelled (text, lang)``; ties by code."""
    rows = labelled.where("lang is not null and text is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", (F.col("rank") - 1).alias("rank"))


def identify(docs: DataFrame, profiles: DataFrame, size: int = PROFILE) -> DataFrame:
    """``docs`` (``text`` and others) with ``lang_pred`` and ``score``; at most ``size`` rows a language go to the tasks."""
    rows = sorted((r.lang, r.gram, r.rank) for r in profiles.collect())
    names = sorted({r[0] for r in rows})
    order = []
    for name in names:
        own = sorted((g, k) for lang, g, k in rows if lang == name)
        order.append((np.asarray([g for g, _ in own]), np.asarray([k for _, k in own])))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        last, langs, scores = None, [], []

        def done():
            cols = [last.column(c) for c in kept]
            return pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"])

        for batch, _, grams in _documents(batches):
            if batch is not last:
                if last is not None:
                    yield done()
                last, langs, scores = batch, [], []
            if not len(grams) or not names:
                langs.append("und")
                scores.append(0.0)
                continue
            g, n = np.unique(grams, return_counts=True)
            top = np.argsort(-n, kind="stable")[:size]  # ties by code, as in the profiles
            mine = g[top]
            far = []
            for known, ranks in order:
                at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                far.append(int(np.where(known[at] == mine, np.abs(ranks[at] - np.arange(len(mine))), size).sum()))
            near = min(range(len(far)), key=far.__getitem__)
            other = min((f for i, f in enumerate(far) if i != near), default=size * len(mine))
            langs.append(names[near])
            scores.append(1.0 - far[near] / other if other else 0.0)
        if last is not None:
            yield done()

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.select(*[F.col(f"`{c}`") for c in kept]).dtypes)
    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, f"{fields}, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four fifths of the documents."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold.alias("held_out"))
    profiles = train(docs.where(~F.col("held_out")).select("text", "lang"))
    return identify(docs.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
SQL: dict[str, str] = {}
