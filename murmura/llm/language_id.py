"""Language identification with a string kernel: Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts counts the character n-grams (n = 1..3, blended) that both have, whatever how often, divided by
the geometric mean of how many each has. N-grams are taken of the lower-cased letters, all else being one space, and
hashed to ``BUCKETS`` presence bits. Predictions are two matrix products a batch: presence times landmarks' presence (the
kernel), then times the weights.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import make_room, shared, slices, small_batches

BUCKETS = 1 << 14
_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """By code point of the first plane: whether it is a letter."""
    global _letter
    if _letter is None:
        _letter = np.array([chr(c).isalpha() for c in range(1 << 16)])
    return _letter


def presence(text: str | None) -> np.ndarray | None:
    """The presence bits of a whole text as booleans; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[np.minimum(points, 0xFFFF)]
    if len(far := np.flatnonzero(points > 0xFFFF)):
        is_letter[far] = [chr(c).isalpha() for c in points[far].tolist()]
    if not is_letter.any():
        return None
    points = np.where(is_letter, points, np.uint32(32))
    points = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]])
    points = points[np.concatenate([[True], (points[1:] != 32) | (points[:-1] != 32)])]
    bits, top = np.zeros(BUCKETS, bool), np.uint32(32 - BUCKETS.bit_length() + 1)
    a, b = points[:-1], points[1:]
    two = (a * np.uint32(0x9E3779B1) + b) * np.uint32(0x85EBCA77)
    for h in (points * np.uint32(0xC2B2AE3D), two ^ (two >> np.uint32(15)), (two[:-1] ^ (two[:-1] >> np.uint32(13))) + points[2:] * np.uint32(0x27D4EB2F)):
        bits[(h * np.uint32(0x165667B1)) >> top] = True
    return bits


@dataclass
class KernelRidge:
    """Landmarks' presence (rows) with their sizes, weights (landmarks x languages), and the languages in order."""

    landmarks: np.ndarray
    weights: np.ndarray
    languages: list[str]

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_wide"):
            self._wide, self._size = np.ascontiguousarray(self.landmarks.T.astype(np.float32)), np.sqrt(self.landmarks.sum(axis=1))
        rows = bits.astype(np.float32)
        return (rows @ self._wide) / (np.sqrt(rows.sum(axis=1))[:, None] * self._size)

    def kernels(self, bits: np.ndarray, at_once: int = 512) -> np.ndarray:
        """The same for many rows."""
        return np.concatenate([self.kernel(bits[i : i + at_once]) for i in range(0, len(bits), at_once)])

    def scores(self, bits: np.ndarray) -> np.ndarray:
        return self.kernel(bits) @ self.weights

    def __getstate__(self):
        return {"landmarks": np.packbits(self.landmarks, axis=1), "weights": self.weights, "languages": self.languages}

    def __setstate__(self, state):
        self.__dict__ |= state | {"landmarks": np.unpackbits(state["landmarks"], axis=1).astype(bool)}


def fit(bits: np.ndarray, langs: list[str], landmarks: int = 96, ridge: float = 1e-3) -> KernelRidge:
    """The first rows of each language, ``landmarks`` in all, spread evenly, span the Nystroem map of the kernel; on it, one ridge
    regression a language of 1 against 0, rows weighted so that each language counts alike."""
    languages = sorted(set(langs))
    truth = np.array([languages.index(x) for x in langs])
    of = [np.flatnonzero(truth == k) for k in range(len(languages))]
    each = max(1, landmarks // len(languages))
    chosen = np.concatenate([rows[:each] for rows in of])
    model = KernelRidge(bits[chosen], np.zeros((len(chosen), len(languages))), languages)
    values, vectors = np.linalg.eigh(model.kernel(bits[chosen]).astype(np.float64))
    keep = values > 1e-6 * values.max()
    to_map = vectors[:, keep] / np.sqrt(values[keep])
    mapped = model.kernels(bits) @ to_map
    weight = 1.0 / np.array([len(of[k]) for k in truth])
    target = (truth[:, None] == np.arange(len(languages))).astype(np.float64)
    gram = mapped.T @ (mapped * weight[:, None])
    solved = np.linalg.solve(gram + ridge * np.trace(gram) / len(gram) * np.eye(len(gram)), mapped.T @ (target * weight[:, None]))
    model.weights = to_map @ solved
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning: its id's crc32 is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def lowest_ids(ids: DataFrame, sizes: dict[str, int], per_language: int) -> set[int]:
    """The doc_ids of each language's ``per_language`` rows whose ids hash lowest, of rows (doc_id, lang); ``sizes`` counts the
    rows of the languages asked for. About four times as many rows hash below a language's limit, so no task puts more in
    order, whatever the table's size; only where ids repeat so much that too few do, all rows are."""
    some = ids.where(F.col("lang").isin([*sizes])).withColumn("h", F.xxhash64("doc_id"))
    share = {x: min(1.0, (4 * per_language + 100) / n) for x, n in sizes.items()}
    limits = F.create_map(*[F.lit(y) for x, part in share.items() for y in (x, int(part * 2**64) - 2**63 - 1)])
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id"))
    for rows in (some.where(F.col("h") <= F.try_element_at(limits, F.col("lang"))), some):
        taken = rows.withColumn("r", place).where(F.col("r") <= per_language).select("lang", "doc_id").collect()
        found = Counter(r["lang"] for r in taken)
        if all(found[x] >= min(per_language, n) for x, n in sizes.items()):
            break
    return {r["doc_id"] for r in taken}


def learn(docs: DataFrame, per_language: int = 300, max_languages: int = 64, landmarks: int = 96) -> KernelRidge | None:
    """Fit on a bounded sample: of each language the ``per_language`` rows whose ids hash lowest, of the ``max_languages``
    commonest languages; held-out documents, null languages and texts without a letter are left out. The sample is chosen by
    ids alone (of rows that repeat one, by their bits), its texts are turned into bits where they are, and its order, by
    which the landmarks are taken, is that of the hashes. None if there is nothing to learn from."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not sizes:
        return None
    chosen = sorted(lowest_ids(known.select("doc_id", "lang"), sizes, per_language))

    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                got = [(doc, lang, np.packbits(bits).tobytes()) for doc, lang, text in zip(*(part.column(i).to_pylist() for i in range(3))) if (bits := presence(text)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary()))], ["doc_id", "lang", "bits"])

    rows = known.where(F.col("doc_id").isin(chosen) & F.col("lang").isin([*sizes])).mapInArrow(run, "doc_id long, lang string, bits binary").withColumn("h", F.xxhash64("doc_id"))
    place = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "bits"))  # ids may repeat
    rows = rows.withColumn("r", place).where(F.col("r") <= per_language).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], r["r"]))
    return fit(np.unpackbits(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1), axis=1).astype(bool), [r["lang"] for r in rows], landmarks)


def predict(docs: DataFrame, model: KernelRidge | None) -> DataFrame:
    """(doc_id, lang_pred, score 0..1) of each row's whole text; ``und`` with score 0 for a null text, one without a
    letter, or if nothing could be learnt. Nothing but the text is looked at; doc_ids may repeat or be null."""
    box = shared(docs.sparkSession, "language", model)

    small_batches(docs.sparkSession)

    def run(batches):
        make_room("language")
        model = box.value
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                bits = [presence(t) if model else None for t in part.column(1).to_pylist()]
                has = [i for i, b in enumerate(bits) if b is not None]
                lang, score = ["und"] * len(bits), [0.0] * len(bits)
                for at in range(0, len(has), 64):
                    some = has[at : at + 64]
                    marks = model.scores(np.array([bits[i] for i in some]))
                    for i, k, s in zip(some, marks.argmax(axis=1).tolist(), marks.max(axis=1).tolist()):
                        lang[i], score[i] = model.languages[k], min(1.0, max(0.0, s))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the documents that aren't held out, predict all."""
    return predict(docs, learn(docs, **settings)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
