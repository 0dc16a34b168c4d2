"""Language identification by nearest centroids of TF-IDF vectors of letter 3-grams.

A text's vector counts its hashed 3-grams of UTF-8 bytes, lower-cased, with everything but letters
as blanks; counts are damped by a logarithm, weighted by inverse document frequency over all
learning documents, and normalised. Each language has several centroids, found by spherical
k-means on a bounded sample of its documents. A text gets the language of the centroid with the
largest cosine; a text further from it than nearly all of the centroid's own members is marked as
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culvert.llm import words as wd
from culvert.llm.exchange import bounded_batches, packed, unpacked

#: Cells of the 3-gram hash (a power of two): the width of all vectors.
CELLS = 4096
#: Documents of a language that its centroids are fitted on at most (in expectation: rows are
#: chosen by a hash of their id and text), and the number of its centroids.
MAX_SAMPLE, CENTROIDS = 2000, 4
#: Languages that are learned at most, those with the most documents: a table's lang may be dirty.
MAX_LANGS = 500
UNKNOWN = "und"
_ROUNDS, _OUTLIERS, _SLACK = 12, 0.005, 0.1
#: A cosine under this is rejected whatever the members of the centroid reach.
_LEAST_COSINE = 0.08
_BATCH = 250
# Letters: a-z and all bytes of longer characters; the rest is 0, a blank.
_LETTER = np.array([b if 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], dtype=np.uint32)


def counts(texts: pa.Array, cells: int = CELLS) -> np.ndarray:
    """A row of 3-gram counts for each text."""
    buf, at = wd.text_buffer(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    if not len(buf):
        return np.zeros((len(texts), cells))
    now = _LETTER[buf]
    before, after = np.zeros_like(now), np.zeros_like(now)
    before[1:], after[:-1] = now[:-1], now[1:]
    filled = at[:-1] < at[1:]
    before[at[:-1][filled]] = after[at[1:][filled] - 1] = 0
    code = (before << np.uint32(16)) + (now << np.uint32(8)) + after
    code *= np.uint32(0x9E3779B1)
    code >>= np.uint32(33 - cells.bit_length())
    place = np.repeat(np.arange(len(texts)) * cells, np.diff(at)) + code
    return np.bincount(place[now > 0], minlength=len(texts) * cells).reshape(len(texts), cells).astype(np.float64)


def vectors(texts: pa.Array, idf: np.ndarray) -> np.ndarray:
    rows = np.log1p(counts(texts, len(idf))) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _seen(cells: int):
    """In how many of a partition's documents each cell occurs; at -1, the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(cells + 1, np.int64)
        for whole in batches:
            for k in range(0, len(whole), _BATCH):
                batch = whole.slice(k, _BATCH)
                df[:-1] += (counts(batch.column("text"), cells) > 0).sum(axis=0)
                df[-1] += len(batch)
        yield pa.RecordBatch.from_arrays([pa.array([*range(cells), -1], pa.int32()), pa.array(df)], names=["cell", "n"])

    return run


def _centroids(k: int, idf: np.ndarray):
    """A language's centroids and the cosine that all but a few of each one's members reach."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])  # the result doesn't depend on the order of arrival
        x = np.concatenate([vectors(b.column("text"), idf) for b in table.to_batches(max_chunksize=_BATCH)])
        chosen = [int(np.argmax(x @ x.mean(axis=0)))]
        for _ in range(1, min(k, len(x))):  # the next start is the text furthest from all so far
            chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
        centres = x[chosen]
        for _ in range(_ROUNDS):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.stack([x[near == i].sum(axis=0) if (near == i).any() else centres[i] for i in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        cosines = x @ centres.T
        near, best = cosines.argmax(axis=1), cosines.max(axis=1)
        least = [float(np.quantile(best[near == i], _OUTLIERS)) - _SLACK if (near == i).any() else 0.0 for i in range(len(centres))]
        lang = table.column("lang")[0].as_py()
        return pa.table({"lang": pa.array([lang] * len(centres), pa.string()), "least": pa.array(least), "centre": pa.array([packed(c) for c in centres], pa.binary())})

    return run


class Model:
    """Centroids by language: idf, langs (one a centroid), centres, least (cosines)."""

    def __init__(self, idf: np.ndarray, langs: list[str], centres: np.ndarray, least: np.ndarray) -> None:
        self.idf, self.langs, self.centres, self.least = idf, langs, centres, least


def fit(docs: DataFrame, cells: int = CELLS, centroids: int = CENTROIDS, max_sample: int = MAX_SAMPLE) -> Model:
    """A model from documents (doc_id, text, lang). Rows with a null lang or text are left out.

    Document frequencies count every document; centroids are fitted on about max_sample documents
    of each language, of the MAX_LANGS languages with the most documents. Of rows that repeat id and
    text all or none are in the sample. What comes to the driver is a number for each cell and a few
    centroids for each language.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.filter("lang is not null and text is not null").select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.col("text").cast("string"), F.col("lang").cast("string"))
    seen = {r.cell: r.n for r in docs.select("text").mapInArrow(_seen(cells), "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    n = seen.get(-1, 0)
    idf = np.log((1 + n) / (1 + np.array([seen.get(c, 0) for c in range(cells)]))) + 0.1
    share = {r.lang: max_sample / max(max_sample, r["count"]) for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()}
    if not share:
        return Model(idf, [], np.zeros((0, cells)), np.zeros(0))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / F.lit(1 << 30)
    shares = F.create_map(*[F.lit(x) for pair in sorted(share.items()) for x in pair])
    sample = docs.filter(place < shares[F.col("lang")])
    found = sample.groupBy("lang").applyInArrow(_centroids(centroids, idf), "lang string, least double, centre binary").collect()
    found.sort(key=lambda r: (r.lang, bytes(r.centre)))
    return Model(idf, [r.lang for r in found], np.array([unpacked(r.centre, np.float64) for r in found]).reshape(-1, cells), np.array([r.least for r in found]))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        langs = np.array(model.langs, dtype=object)
        for whole in batches:
            for k in range(0, len(whole), _BATCH):
                batch = whole.slice(k, _BATCH)
                text = batch.column("text").fill_null("")
                lettered = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
                if len(langs) and len(batch):
                    cosines = vectors(text, model.idf) @ model.centres.T
                    near, best = cosines.argmax(axis=1), cosines.max(axis=1)
                    lang, rejected = np.where(lettered, langs[near], UNKNOWN), ~lettered | (best < np.maximum(model.least[near], _LEAST_COSINE))
                else:
                    best = np.zeros(len(batch))
                    lang, rejected = np.full(len(batch), UNKNOWN, dtype=object), np.ones(len(batch), bool)
                score = np.where(lettered, np.clip(best, 0, 1), 0.0)
                cols = [batch.column(c) for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=[*(c for c in batch.schema.names if c != "text"), "lang_pred", "score", "rejected"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of each row of docs (doc_id, text).

    lang_pred is the language of the nearest centroid, of the first language in order on ties, and
    `und` for a null text or one without a letter; score is the cosine (0 for `und`); rejected
    tells whether the text is unlike the language's learning documents. A model without languages
    answers `und`. Texts of any length count whole. Repeated rows are answered each; an empty table gives an empty table; other
    columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return docs.mapInArrow(_predict(shared), "doc_id bigint, lang_pred string, score double, rejected boolean")
