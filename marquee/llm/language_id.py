"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams (blended: all
orders from 1 up) that both contain, over the root of the product of the numbers each
contains.  Nystroem landmarks turn it into an explicit map, one ridge
regression per language is fitted on 0/1 targets.  The map and the weights
collapse into one weight per n-gram and language, so a batch of texts is scored by one
product of its presence matrix with the weight matrix.

Fitting uses a bounded sample (``per_language`` texts a language, at most ``longest``
characters of each); predicting reads whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

ORDERS = 3
PER_LANGUAGE, LONGEST = 300, 20_000  # bound of the sample that is fitted on
LANDMARKS = 200  # bound on Nystroem landmarks, shared by the languages
ALPHABET = 160  # characters told apart; the rest count as one
RIDGE = 1e-2
UNKNOWN = "und"
LEAST_SCORE = 0.25  # a document below it is rejected by the filter

_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return text is not None and any(m.group().isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    """Languages in order, the alphabet, the n-gram codes and their weights."""

    languages: list[str]
    alphabet: np.ndarray
    codes: np.ndarray
    weights: np.ndarray

    @cached_property
    def _symbol(self) -> np.ndarray:
        table = np.full(0x110000, len(self.alphabet) + 1, np.uint8)
        table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return table

    @cached_property
    def _slot(self) -> np.ndarray:
        table = np.full((len(self.alphabet) + 2) ** ORDERS, len(self.codes), np.int32)
        table[self.codes] = np.arange(len(self.codes))
        return table

    def grams(self, text: str) -> list[np.ndarray]:
        """Codes of the n-grams of every order.  Symbols start at 1, so codes
        of different orders differ."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self._symbol[points].astype(np.int32)
        base, out, code = len(self.alphabet) + 2, [], np.zeros(len(symbols), np.int32)
        for n in range(min(ORDERS, len(symbols))):
            code = code[: len(symbols) - n] * base + symbols[n:]
            out.append(code)
        return out

    def presence(self, texts: list[str]) -> np.ndarray:
        """One row per text: which known n-grams it has, over the root of their number."""
        present = np.zeros((len(texts), len(self.codes) + 1), np.float32)
        for i, text in enumerate(texts):
            for code in self.grams(text):
                present[i, self._slot[code]] = 1
        present = present[:, :-1]
        return present / np.sqrt(np.maximum(present.sum(axis=1, keepdims=True), 1))

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred and score (0 to 1); ``und`` and 0 for null or letterless texts."""
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for at in range(0, len(known), 128):
            rows = known[at : at + 128]
            values = self.presence([texts[i] for i in rows]) @ self.weights
            for i, best, value in zip(rows, values.argmax(axis=1), values.max(axis=1), strict=True):
                langs[i] = self.languages[best]
                scores[i] = min(max(float(value), 0.0), 1.0)
        return pd.DataFrame({"lang_pred": langs, "score": scores})


def held_out(doc_id: str = "doc_id") -> Column:
    """Every fifth document by crc32 of its id is never learned from; a null id is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> pd.DataFrame:
    """Up to ``per_language`` (lang, text) a language, chosen by hash of doc_id,
    texts of at most ``longest`` characters first."""
    order = [F.length("text") > longest, F.xxhash64("doc_id"), "doc_id"]
    ranked = (
        docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
        .select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).alias("rank"))
        .filter(F.col("rank") <= per_language)
        .select("doc_id", "lang")
        .distinct()
    )
    # At most per_language rows a language.
    texts = docs.select("doc_id", "lang", F.substring("text", 1, longest).alias("text"))
    sample = texts.filter(~held_out()).join(F.broadcast(ranked), ["doc_id", "lang"]).groupBy("doc_id", "lang")
    rows = sample.agg(F.min("text").alias("text")).collect()
    rows = sorted((r.lang, r.doc_id, r.text) for r in rows if has_letter(r.text))
    return pd.DataFrame(rows, columns=["lang", "doc_id", "text"])


def fit(sample: pd.DataFrame, landmarks: int = LANDMARKS, alphabet: int = ALPHABET, ridge: float = RIDGE) -> Model:
    """One-versus-rest kernel ridge regression on Nystroem landmarks."""
    languages = sorted(sample["lang"].unique())
    none = np.zeros(0, np.int64)
    if not languages:
        return Model([], none, none, np.zeros((0, 0), np.float32))
    texts = sample["text"].tolist()
    points = np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols, counts = np.unique(points, return_counts=True)
    symbols = np.sort(symbols[np.lexsort((symbols, -counts))][:alphabet]).astype(np.int64)
    each = max(1, landmarks // len(languages))
    chosen = np.flatnonzero((sample.groupby("lang").cumcount() < each).to_numpy())
    model = Model(languages, symbols, none, np.zeros((0, 0), np.float32))
    found = [np.unique(np.concatenate(model.grams(texts[i]))) for i in chosen]
    codes, holders = np.unique(np.concatenate(found), return_counts=True)
    model = Model(languages, symbols, codes[holders > 1] if (holders > 1).any() else codes, model.weights)
    marks = model.presence([texts[i] for i in chosen])
    kernel = np.concatenate(
        [model.presence(texts[at : at + 128]) @ marks.T for at in range(0, len(texts), 128)]
    ).astype(float)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(float))
    solid = values > 1e-6 * values.max()
    root = vectors[:, solid] / np.sqrt(values[solid])
    mapped = kernel @ root
    targets = (sample["lang"].to_numpy()[:, None] == np.array(languages)[None, :]).astype(float)
    gram = mapped.T @ mapped + ridge * len(texts) / len(chosen) * np.eye(mapped.shape[1])
    model.weights = (marks.T @ (root @ np.linalg.solve(gram, mapped.T @ targets))).astype(np.float32)
    return model


def language(model: Model, text: str = "text") -> Column:
    """struct<lang_pred, score> of every whole text."""

    @pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return model.predict(texts.tolist())

    return predict(F.col(text))


def learned(docs: DataFrame) -> Model:
    return fit(training_sample(docs))


def predict_language(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs`` (doc_id, text, lang).

    Null, empty and letterless texts are ``und`` with score 0, and so is every
    text when there is nothing to learn from.  Null langs are not learned from, nor
    documents without an id (held out).  Repeated rows are predicted alike; other
    columns are ignored; an empty table gives no rows.
    """
    model = model or learned(docs)
    found = docs.select("doc_id", held_out().alias("held_out"), language(model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def keep_known_languages(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents with a recognised language: not ``und`` and not scored
    below ``least_score``."""
    found = language(learned(docs))
    return docs.filter((found["lang_pred"] != UNKNOWN) & (found["score"] >= least_score))
