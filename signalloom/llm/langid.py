"""Language identification with string kernels.

Blended-spectrum presence kernel: a text is the set of its byte n-grams of every length 1..3
(of the lower-cased UTF-8 text, hashed into ``dims`` features), and the kernel of two texts is
the size of the common set over the geometric mean of the set sizes.  Nystrom landmarks
(training texts, dealt evenly over the languages) turn it into features; one-versus-rest kernel
ridge regression is solved on the driver from sums that the executors add up.  Since the
kernel is linear in the presence vector, landmarks and coefficients fold into one weight per
n-gram and language, and scoring is a product of a batch's presence matrix with them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fresh, small

#: Undetermined: null text or no letter.
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BATCH = 256
#: Bytes hashed at once, so that a very long text needs no more memory than a long one.
_STEP = 1 << 20


def presence(text: str, out: np.ndarray) -> None:
    """Set out[f] = 1 for every hashed n-gram (1..3 bytes) of the whole lower-cased text."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", dtype=np.uint8)
    mask = np.uint32(out.size - 1)
    for at in range(0, len(data), _STEP):
        b = data[at : at + _STEP + 2].astype(np.uint32)
        out[(b * np.uint32(2654435761)) >> np.uint32(12) & mask] = 1
        two = (b[:-1] << np.uint32(8)) | b[1:]
        out[((two + np.uint32(0x9E37)) * np.uint32(2246822519)) >> np.uint32(12) & mask] = 1
        three = (two[:-1] << np.uint32(8)) | b[2:]
        out[((three ^ np.uint32(0x5BD1E995)) * np.uint32(3266489917)) >> np.uint32(12) & mask] = 1


@dataclass
class StringKernelModel:
    langs: list[str]
    weights: np.ndarray  # dims x langs
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the softmax of its ridge outputs, so 0 to 1."""
        out, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return out, scores
        for a in range(0, len(texts), _BATCH):
            rows = [i for i in range(a, min(a + _BATCH, len(texts))) if texts[i] is not None and _LETTER.search(texts[i])]
            if not rows:
                continue
            x = np.zeros((len(rows), self.weights.shape[0]), dtype=np.uint8)
            for r, i in enumerate(rows):
                presence(texts[i], x[r])
            x = x.astype(np.float32)
            z = (x @ self.weights) / np.sqrt(x.sum(axis=1, keepdims=True)) + self.bias
            e = np.exp(6.0 * (z - z.max(axis=1, keepdims=True)))
            e /= e.sum(axis=1, keepdims=True)
            for r, i in enumerate(rows):
                k = int(e[r].argmax())
                out[i], scores[i] = self.langs[k], float(e[r, k])
        return out, scores


def fit(
    rows: list[tuple[str, str]], dims: int = 1 << 14, landmarks: int | None = None, ridge: float = 1e-3
) -> StringKernelModel:
    """Train on (text, language) pairs, with 96 landmarks or 8 a language if that is more.  No
    usable row: a model that answers ``und``."""
    rows = [(t, y) for t, y in rows if t is not None and y is not None and _LETTER.search(t)]
    langs = sorted({y for _, y in rows})
    if not langs:
        return StringKernelModel([], np.zeros((dims, 0), np.float32), np.zeros(0))
    landmarks = max(96, 8 * len(langs)) if landmarks is None else landmarks

    def unit(part: list[int]) -> np.ndarray:
        x = np.zeros((len(part), dims), dtype=np.uint8)
        for r, i in enumerate(part):
            presence(rows[i][0], x[r])
        norm = np.sqrt(x.sum(axis=1, dtype=np.int64))
        return x.astype(np.float32) / norm[:, None].astype(np.float32)

    by_lang = {lang: [] for lang in langs}
    for i, (_, y) in enumerate(rows):
        by_lang[y].append(i)
    picked = [i for r in range(landmarks) for own in by_lang.values() if r < len(own) for i in [own[r]]][:landmarks]
    # Nystrom map: K(x, L) K(L, L)^(-1/2).
    marks = unit(picked)
    vals, vecs = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = vals > 1e-8 * vals[-1]
    whiten = vecs[:, keep] / np.sqrt(vals[keep])
    # By blocks, so that many languages need no more memory than their features.
    feats = np.concatenate([(unit(list(range(i, min(i + 1024, len(rows))))) @ marks.T).astype(np.float64) @ whiten for i in range(0, len(rows), 1024)])
    y = np.array([[1.0 if lang == own else -1.0 for lang in langs] for _, own in rows])
    centre, y_mean = feats.mean(axis=0), y.mean(axis=0)
    f = feats - centre
    beta = np.linalg.solve(f.T @ f + ridge * len(rows) * np.eye(f.shape[1]), f.T @ (y - y_mean))
    return StringKernelModel(langs, (marks.T @ (whiten @ beta)).astype(np.float32), y_mean - centre @ beta)


def training_rows(docs: DataFrame, per_lang: int, max_chars: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """A seeded sample: at most ``per_lang`` distinct labelled texts of every language, those of at
    most ``max_chars`` characters with the smallest hashes, then, if these are too few, the
    shortest of the longer ones."""
    known = docs.where(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2)
    ).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    n = F.char_length("text")
    known = known.withColumn("h", F.xxhash64(F.lit(4), "text")).withColumn("over", F.when(n > max_chars, n).otherwise(0))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("over", "h"))
    best = known.select("lang", "over", "h").distinct().withColumn("_place", place).where(F.col("_place") <= per_lang).drop("_place")  # hashes only: few bytes from each task
    rows = known.join(small(best), ["lang", "over", "h"]).groupBy("lang", "over", "h").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["over"], r["h"]))]


def identify(
    docs: DataFrame, per_lang: int = 300, max_chars: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    keep: bool = False,
) -> DataFrame:
    """Predict the language of every whole text.

    Trains on at most ``per_lang`` labelled documents of each language, whole texts, those of up to
    ``max_chars`` characters before longer ones, of those whose crc32(id as text) mod 4 is not 2; only their text and language are
    used, and predictions see only the text.  Returns doc_id, held_out, lang_pred, score, or
    with ``keep`` all input columns plus ``_lang_pred`` and ``_score`` (with more underscores in front
    where the input has such a column).  A null text, or one
    without a letter, is ``und`` with score 0; null ids are not held out; a table without labels
    gives ``und`` everywhere; repeated rows get the same prediction; an empty table no rows.
    """
    model = fit(training_rows(docs, per_lang, max_chars, id_col, text_col, lang_col))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _BATCH):
                part = batch.slice(a, _BATCH)
                langs, scores = model.predict(part.column(part.schema.get_field_index("_text")).to_pylist())
                columns = [c for n, c in zip(part.schema.names, part.columns) if n != "_text"]
                names = [n for n in part.schema.names if n != "_text"]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "_lang_pred", "_score"])

    if keep:
        rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("_text"))
        schema = StructType([StructField("row", StructType(docs.schema.fields)), StructField("_lang_pred", StringType()), StructField("_score", DoubleType())])
        names = [(c, fresh(c, docs.columns)) for c in ("_lang_pred", "_score")]
        told = rows.mapInArrow(score, schema)
        return told.select(*(F.col("row").getField(c).alias(c) for c in docs.columns), *(F.col(c).alias(n) for c, n in names))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        F.col(text_col).alias("_text"),
    )
    rows = rows.mapInArrow(score, "doc_id long, held_out boolean, _lang_pred string, _score double")
    return rows.withColumnsRenamed({"_lang_pred": "lang_pred", "_score": "score"})
