"""Language identification with a string kernel.

The kernel is the blended-spectrum presence kernel: the share of distinct character n-grams
(n = 1, 2, 3, hashed to 32,768 places) that two texts have in common, normalised by the cosine.
Nyström landmarks stand for the corpus, and one ridge regression a language (one versus the rest)
is fitted on the landmark features. As the kernel is linear in the presence vectors, landmarks and
weights fold into one matrix, and a batch of texts is scored by one matrix product.

The classifier is fitted on at most ``sample`` labelled documents, as many of each language as there are
(in hash order of doc_id), so that rare languages are learned on large tables as well; what reaches
the driver is 4 kB a sampled document. Only text and non-null lang are used, and only of documents whose
crc32(doc_id) mod 4 isn't 2; of rows that repeat a doc_id one is learned from. Texts that are null or hold no letter are `und` with score 0; so is
everything when there is nothing to learn from. Ties go to the language that sorts first. Repeated
rows get equal results, empty tables give empty ones, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.llm.common import prepare, text_or_empty

PLACES = 1 << 15
SAMPLE, LANDMARKS, RIDGE = 4000, 256, 1e-2
_LETTER = regex.compile(r"\p{L}")


def presence(text: str) -> np.ndarray:
    """0/1 for each hashed n-gram of the whole text (lower case), as bytes."""
    row = np.zeros(PLACES, np.uint8)
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    h = x * np.uint32(2654435761)
    row[h >> np.uint32(17)] = 1
    two = (h[:-1] ^ (h[1:] >> np.uint32(3))) * np.uint32(2246822519) if len(h) > 1 else h[:0]
    row[two >> np.uint32(17)] = 1
    three = (two[:-1] ^ (h[2:] >> np.uint32(5))) * np.uint32(3266489917) if len(h) > 2 else h[:0]
    row[three >> np.uint32(17)] = 1
    return row


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # PLACES x languages: landmarks and ridge weights folded together
    offset: np.ndarray

    def score(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        known = [k for k, t in enumerate(texts) if self.languages and _LETTER.search(t)]
        if known:
            rows = np.stack([presence(texts[k]) for k in known]).astype(np.float32)
            raw = rows @ self.weights / np.sqrt(rows.sum(axis=1, keepdims=True)) + self.offset
            best = raw.argmax(axis=1)
            for k, b, r in zip(known, best.tolist(), raw.max(axis=1).tolist()):
                out[k] = (self.languages[b], round(min(1.0, max(0.0, (r + 1) / 2)), 6))
        return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Learns from a bounded sample of the labelled rows that aren't held out."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"lang": batch["lang"], "bits": [np.packbits(presence(t)).tobytes() for t in batch["text"]]})

    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}") & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    # ids are chosen first, so that no task gathers texts; at most ``sample`` ids are joined to them. Of each
    # language so many rows at most leave a task
    usable = usable.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    ids = usable.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("place", place).where(F.col("place") <= sample)
    chosen = ids.orderBy("place", F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "lang")
    texts = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id").agg(F.min("lang").alias("lang"), F.min("text").alias("text"))
    rows = texts.select("lang", "text").mapInPandas(run, "lang string, bits binary").toPandas()
    languages = sorted(rows["lang"].unique())
    if not languages:
        return Model([], np.zeros((PLACES, 0), np.float32), np.zeros(0))
    rows = rows.sort_values(["lang", "bits"]).reset_index(drop=True)
    bits = np.frombuffer(b"".join(rows["bits"]), np.uint8).reshape(len(rows), -1)

    def unit(some: np.ndarray) -> np.ndarray:
        x = np.unpackbits(some, axis=1).astype(np.float32)
        return x / np.sqrt(x.sum(axis=1, keepdims=True))

    share = max(1, landmarks // len(languages))
    picked = np.concatenate([g.index.to_numpy()[np.unique(np.linspace(0, len(g) - 1, share).astype(int))] for _, g in rows.groupby("lang")])
    marks = unit(bits[picked])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    # rows are unpacked a few at a time: 128 kB each
    z = np.vstack([unit(bits[i : i + 256]) @ marks.T for i in range(0, len(bits), 256)]) @ root
    y = np.where(rows["lang"].to_numpy()[:, None] == np.array(languages), 1.0, -1.0)
    # each language's rows weigh as much as the rest
    weight = np.where(y > 0, 0.5 / (y > 0).mean(axis=0), 0.5 / np.maximum((y < 0).mean(axis=0), 1e-9))
    z1 = np.hstack([z, np.ones((len(z), 1))])
    solved = np.stack([np.linalg.solve((z1 * weight[:, [c]]).T @ z1 + ridge * len(z) * np.diag([1.0] * z.shape[1] + [1e-9]), (z1 * weight[:, [c]]).T @ y[:, c]) for c in range(len(languages))], axis=1)
    return Model(languages, (marks.T @ (root @ solved[:-1])).astype(np.float32), solved[-1].astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document. No shuffle."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = model.score(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": [f for f, _ in found], "score": [s for _, s in found]})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), text_or_empty().alias("text"))
    return picked.mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")
