"""Language ID by nearest centroids of normalised TF-IDF n-gram vectors.

A text's vector counts hashed byte bigrams and trigrams of its lower-cased UTF-8 (other ASCII than letters counts
as a space), log(1 + count) times the inverse document frequency, with length 1.  Each language has CLUSTERS
centroids, by spherical k-means.  A text gets the language of the centroid with the largest
cosine, which is also its score, over the whole text.  It is rejected if the distance 1 - cosine is beyond the
language's for texts of that length: SLACK times what all but a FAR_SHARE of the training texts, and of pieces of them, of about as
many n-grams keep to, and MOST_DISTANT at most.  Bands of length are powers of two; a longer band's limit is never wider, and texts of
fewer than 2 ** FIRST_BAND n-grams have SHORT_DISTANT, or the first band's if that is wider.

The centroids and document frequencies are fitted on a bounded sample, about SAMPLE texts of each
language chosen by the hash of their ids; each language is fitted in a task of its own, with at most
2 * SAMPLE vectors.

A null text, or one without a letter, is `und` with score 0, and rejected.  Languages are the label's
values; null ones don't train.  If nothing trains, everything is `und`.  Repeated rows give one row each.  Only
the named columns are looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches as B
from .common import keep, sampled, table

SAMPLE = 1000
CLUSTERS = 3
ROUNDS = 12
SLOTS = 1 << 12
#: Bytes of text whose n-grams are counted at a time, each by some 50 bytes of arrays.
PART = 1 << 18
FAR_SHARE = 0.002
SLACK = 1.15
MOST_DISTANT = 0.97
SHORT_DISTANT = 0.9
FIRST_BAND, BANDS = 6, 14
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def counts(batch: pa.RecordBatch, text: str) -> np.ndarray:
    """A row of n-gram counts for each text of a batch with one column of about a chunk of text."""
    _, data, offsets = next(B.chunks(batch, text, 1 << 62))
    n, size = len(offsets) - 1, len(data)
    x = _LETTERS[data].astype(np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    out = np.zeros(n * SLOTS, np.int64)
    two = x[:-1] * np.uint32(256) + x[1:]
    three = two[:-1] * np.uint32(256) + x[2:]
    for width, grams in ((2, two), (3, three)):
        if size < width:
            continue
        same = owner[: size - width + 1] == owner[width - 1 :]
        slot = ((grams * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64)
        out += np.bincount((owner[: size - width + 1] * SLOTS + slot)[same], minlength=n * SLOTS)
    return out.reshape(n, SLOTS)


def _lowered(batch: pa.RecordBatch, text: str):
    """(rows, texts in lower case) of about PART bytes each, at most 256."""
    column = pc.utf8_lower(batch.column(text).cast(pa.large_string()).fill_null(""))
    lowered = pa.RecordBatch.from_arrays([pa.array(np.arange(len(column))), column], ["row", "text"])
    for at in range(0, len(column), 256):
        for part, _, _ in B.chunks(lowered.slice(at, 256), "text", PART):
            yield part.column("row").to_numpy(), part


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def vectors(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(n.astype(np.float32)) * idf)


def k_means(x: np.ndarray, k: int = CLUSTERS) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next one the vector farthest from those there are."""
    centres = _unit(x.mean(axis=0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.concatenate([centres, x[[np.argmin((x @ centres.T).max(axis=1))]]])
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([x[nearest == i].mean(axis=0) if (nearest == i).any() else c for i, c in enumerate(centres)]))
    return centres


def _sample_counts(batches):
    for batch in batches:
        for rows, part in _lowered(batch, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(rows)), pa.array([r.astype("<u4").tobytes() for r in counts(part, "text")])], ["lang", "counts"])


def band(n: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(np.maximum(n.sum(axis=1), 1)).astype(int), 0, BANDS - 1)


def _pieces(text: str) -> list[str]:
    """The text, and for each band of shorter ones its beginning and its middle of such a length."""
    out = [text]
    for b in range(FIRST_BAND, BANDS):
        size = (1 << (b - 1)) + 2
        if size < len(text):
            middle = (len(text) - size) // 2
            out += [text[:size], text[middle : middle + size]]
    return out


def _limits(rows: list, languages: list[str]) -> np.ndarray:
    """For each centroid and band the largest distance; rows are of lang, band and far."""
    far = {(r.lang, r.band): r.far for r in rows}
    out = np.full((len(languages), BANDS), MOST_DISTANT)
    for i, name in enumerate(languages):
        at = MOST_DISTANT
        for b in range(FIRST_BAND, BANDS):
            out[i, b] = at = min(at, SLACK * far.get((name, b), at))
        out[i, :FIRST_BAND] = max(SHORT_DISTANT, out[i, FIRST_BAND])
    return out


class Model:
    """Centroids, the language of each and its largest distance for each band, and the inverse document frequencies."""

    def __init__(self, centres: np.ndarray, languages: list[str], distances: np.ndarray, idf: np.ndarray) -> None:
        self.centres, self.languages, self.distances, self.idf = centres, languages, distances, idf

    def nearest(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cosines = vectors(n, self.idf) @ self.centres.T
        best = cosines.argmax(axis=1)
        return best, np.clip(cosines[np.arange(len(best)), best].astype(float), 0, 1)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model | None:
    """From labelled rows; the number of languages must be one that the driver can hold centroids for."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    chosen = rows.where(sampled(F.col("key"), F.col("lang"), sizes, sample)).select("lang", "text")
    chosen = keep(chosen, "chosen")
    found = keep(chosen.mapInArrow(B.giving_back(_sample_counts), "lang string, counts binary"), "ngrams")
    as_matrix = lambda pdf: np.stack([np.frombuffer(x, "<u4") for x in pdf["counts"].iloc[: 2 * sample]])

    def frequencies(pdf: pd.DataFrame) -> pd.DataFrame:
        n = as_matrix(pdf)
        return pd.DataFrame({"n": [len(n)], "df": [(n > 0).sum(axis=0).astype("<i8").tobytes()]})

    counted = found.groupBy("lang").applyInPandas(frequencies, "n bigint, df binary").collect()  # a row for each language
    idf = (np.log((1 + sum(r.n for r in counted)) / (1 + sum(np.frombuffer(r.df, "<i8") for r in counted))) + 1).astype(np.float32)

    def centroids(pdf: pd.DataFrame) -> pd.DataFrame:
        x = vectors(as_matrix(pdf), idf)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "centre": [c.astype("<f4").tobytes() for c in k_means(x)]})

    made = sorted(found.groupBy("lang").applyInPandas(centroids, "lang string, centre binary").collect(), key=lambda r: (r.lang, r.centre))
    if not made:
        return None
    model = Model(np.stack([np.frombuffer(r.centre, "<f4") for r in made]), [r.lang for r in made], np.full((len(made), BANDS), MOST_DISTANT), idf)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def distances(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                texts = [p for t in batch.column("text").slice(at, 64).to_pylist() if LETTER.search(t) for p in _pieces(t)]
                for _, part in _lowered(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), "text"):
                    n = counts(part, "text")
                    best, cosine = shared.value.nearest(n)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([shared.value.languages[i] for i in best], pa.string()), "band": pa.array(band(n)), "d": pa.array(1 - cosine)})

    seen = chosen.mapInArrow(B.giving_back(distances), "lang string, band bigint, d double")
    # a row for each language and band
    model.distances = _limits(seen.groupBy("lang", "band").agg(F.percentile("d", 1 - FAR_SHARE).alias("far")).collect(), model.languages)
    return model


def predict(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """docs with the predicted language, its score, and whether it is rejected; columns of these names are replaced.  Of languages at
    the same distance the first centroid's counts: by name, then by the centroid's bytes."""
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CLUSTERS vectors of SLOTS numbers for each language

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column(text)
            lang, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            for rows, part in _lowered(batch, text) if model else ():
                n = counts(part, "text")
                best, cosine = model.nearest(n)
                for row, b, c, limit, low in zip(rows, best, cosine, model.distances[best, band(n)], part.column("text").to_pylist(), strict=True):
                    if LETTER.search(low):
                        lang[row], score[row], rejected[row] = model.languages[b], c, 1 - c > limit
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(B.giving_back(run), f"{schema}, {names[0]} string, {names[1]} double, {names[2]} boolean")


def held_out(key: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def keep_known(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that aren't rejected, all columns as they were."""
    model = fit(docs.where(~held_out(F.col(key))), key, text, lang)
    names = ("_gaugeloom_lang", "_gaugeloom_score", "_gaugeloom_rejected")
    return predict(docs, model, text, names).where(f"NOT {names[2]}").drop(*names)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(docs.where("NOT held_out"))
    return predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


QUERIES = {"op4_language": op4_language}
