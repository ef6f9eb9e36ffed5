"""Language identification as a mixture of languages.

Byte 4-gram counts by language give n-gram likelihoods.  Each text is taken as a
mixture: expectation-maximisation estimates its language proportions, languages
that do not repay a penalty in log likelihood are dropped one by one, and the
prediction is the language with the largest proportion of the set that is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import small_batches, text_bytes

#: Buckets of hashed n-grams; the model has this many floats for each language.
BUCKETS = 1 << 15
GRAM = 4
SMOOTHING = 0.5
ROUNDS = 30
#: EM ends when no proportion moves by more.
SETTLED = 1e-3
#: Log likelihood a further language has to add, for each log of the n-grams.
PENALTY = 3.0
#: Languages beyond this would make the model too large to send to executors.
MOST_LANGUAGES = 400
UNKNOWN = "und"

_FOLD = np.zeros(256, dtype=np.uint8)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[_FOLD == 0] = ord(" ")


def grams(text: bytes) -> np.ndarray:
    """Buckets of the byte n-grams of a text's letters, in order."""
    folded = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    spaces = folded == 32
    folded = folded[np.concatenate(([True], ~(spaces[1:] & spaces[:-1])))].astype(np.uint32)
    # one letter of one byte has a gram of its own, filled up with a space
    if len(folded) == GRAM - 1:
        folded = np.append(folded, np.uint32(32))
    if len(folded) < GRAM:
        return np.zeros(0, dtype=np.int64)
    code = folded[:-3] | (folded[1:-2] << np.uint32(8)) | (folded[2:-1] << np.uint32(16)) | (folded[3:] << np.uint32(24))
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def has_letter(text: bytes) -> bool:
    return text.isascii() and any(map(bytes.isalpha, text.split())) or any(map(str.isalpha, text.decode("utf-8", "replace"))) if text else False


def in_fold(doc_id: object, folds: int = 4, fold: int = 2) -> bool:
    return zlib.crc32(str(doc_id).encode()) % folds == fold


def count_grams(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, bucket, n) over all texts with a language, summed in each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                found = grams(text)
                into = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                if len(found) > BUCKETS // 4:
                    into += np.bincount(found, minlength=BUCKETS)
                else:
                    np.add.at(into, found, 1)
        for lang, counts in sums.items():
            at = np.nonzero(counts)[0]
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": counts[at]})

    labelled = docs.select(text_bytes(F.col(text_col)).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    return labelled.mapInPandas(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Log likelihoods of n-grams under each language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.share = (smooth / smooth.sum(axis=1, keepdims=True)).T.copy() if langs else np.zeros((BUCKETS, 0))

    def _fit(self, likelihood: np.ndarray, n: np.ndarray, mix: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log likelihood by EM from the proportions ``mix``."""
        for _ in range(ROUNDS if len(mix) > 1 else 0):
            after = mix * (likelihood.T @ (n / (likelihood @ mix)))
            after /= after.sum()
            moved = np.abs(after - mix).max()
            mix = after
            if moved < SETTLED:
                break
        return mix, float(n @ np.log(likelihood @ mix))

    def mixture(self, text: bytes) -> tuple[str, float, dict[str, float]]:
        """(language, its proportion, proportions of the chosen set)."""
        found = grams(text) if text else np.zeros(0, dtype=np.int64)
        if not len(found) or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, {}
        kinds, n = np.unique(found, return_counts=True)
        likelihood, n = self.share[kinds], n.astype(np.float64)
        chosen = np.arange(len(self.langs))
        mix, fit = self._fit(likelihood, n, np.full(len(chosen), 1 / len(chosen)))
        price = PENALTY * np.log(len(found) + 1)
        while len(chosen) > 1:
            rest = np.delete(np.arange(len(chosen)), int(mix.argmin()))
            fewer = np.ascontiguousarray(likelihood[:, rest])
            less, worse = self._fit(fewer, n, mix[rest] / max(mix[rest].sum(), 1e-300))
            if fit - worse > price:
                break
            chosen, likelihood, mix, fit = chosen[rest], fewer, less, worse
        best = int(mix.argmax())
        return self.langs[chosen[best]], float(mix[best]), {self.langs[c]: float(m) for c, m in zip(chosen, mix)}


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model from every labelled text; what reaches the driver has a row for
    each language and bucket at most."""
    counted = count_grams(docs, text_col, lang_col)
    langs = sorted(r["lang"] for r in docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang")).distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages: the model would be too large to broadcast")
    counts, place = np.zeros((len(langs), BUCKETS)), {l: i for i, l in enumerate(langs)}
    rows = counted.toPandas()
    counts[rows["lang"].map(place).to_numpy(dtype=np.int64), rows["bucket"].to_numpy(dtype=np.int64)] = rows["n"]
    return Model(langs, counts)


PREDICTED = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("mixture", StringType())])


def predict_udf(model: Model, spark):
    """A column function from binary text to ``PREDICTED``."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(PREDICTED)
    def predicted(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            lang, score, mix = sent.value.mixture(text)
            rows.append((lang, min(1.0, max(0.0, score)), ",".join(f"{l}:{m:.3f}" for l, m in sorted(mix.items()))))
        return pd.DataFrame(rows, columns=PREDICTED.names)

    return predicted


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, mixture), a row for each row of ``docs``.

    Learns from rows outside the fold only.  A null text or one without letters
    is ``und`` with score 0, and so is every text if nothing has a language.
    Repeated rows give repeated rows; ties go to the language first in order; an
    empty table gives no rows; whole texts are read, whatever their length.
    """
    small_batches(docs.sparkSession)
    model = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict_udf(model, docs.sparkSession)(text_bytes(F.col(text_col))).alias("p"))
    return found.select("doc_id", "held_out", "p.*")
