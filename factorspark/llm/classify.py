"""Language ID and quality scores: subword models fitted on a bounded sample, applied to every text.

The sample holds about `max_rows` labelled rows, spread evenly over the classes and chosen by
a hash of their ids; rows of more than `max_chars` characters are not sampled. Both bounds
only concern fitting: each text is scored whole, whatever its length.

Defined results: a null or empty text has the class that the bias favours (quality) or `und`
with score 0 (language); a null id is never learned from and not held out; repeated rows get
equal results; extra columns are ignored or, in `keep_identified`, kept; without labelled rows
every language is `und` and every quality score 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import byte_column, hashed_share, private, uniform
from .subword import Features, Model, counts, fit, letter_table, plain_table

UNKNOWN = "und"
MAX_ROWS = 4000
MAX_CHARS = 100_000
#: Documents with this remainder of crc32(id as text) are not learned from.
LANGUAGE_FOLD = (4, 2)
QUALITY_FOLD = (5, 0)


def held_out(id_: Column, fold: tuple[int, int]) -> Column:
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))


def _sample(rows: DataFrame, max_rows: int, max_chars: int) -> pa.Table:
    """A bounded sample of rows (id, text, label): the same number expected of each class."""
    number = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}
    draw = uniform(F.lit(3), F.col("id"))
    chosen = F.lit(False)
    for label, count in number.items():
        chosen = chosen | ((F.col("label") == label) & (draw < hashed_share(count, max_rows // len(number))))
    return (
        rows.where(chosen & (F.length("text") <= max_chars)).withColumn("draw", draw)
        .orderBy("draw", "id", "text").limit(2 * max_rows).select("text", "label").toArrow())


def _fitted(sample: pa.Table, features: Features) -> Model | None:
    if sample.num_rows == 0:
        return None
    data, offsets = byte_column(sample.column("text"))
    return fit(features, counts(features, data, offsets), np.array(sample.column("label").to_pylist()))


def language_features() -> Features:
    return Features(orders=(2, 3, 4), words=False, buckets=1 << 14, table=letter_table())


def quality_features() -> Features:
    return Features(orders=(1, 2, 3, 4), words=True, buckets=1 << 15, table=plain_table())


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
                   max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model | None:
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("id"), LANGUAGE_FOLD))
    return _fitted(_sample(rows, max_rows, max_chars), language_features())


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, accepted) of every document."""
    source = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), LANGUAGE_FOLD).alias("held_out"),
                         F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("has_letter"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]

    def languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.asarray(batch.column(2).to_pylist(), bool)
            if model is None or not len(known):
                known = np.zeros(len(known), bool)
                names, best = [], np.zeros(len(known))
            else:
                shares, number = model.predict(*byte_column(batch.column(3)))
                names, best = [model.classes[i] for i in shares.argmax(axis=1)], shares.max(axis=1)
            lang = [names[i] if known[i] else UNKNOWN for i in range(len(known))]
            score = np.where(known, best, 0.0)
            accepted = known & (score >= (model.threshold if model else 1.0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)],
                ["id", "held_out", "lang_pred", "score", "accepted"])

    done = source.mapInArrow(languages, f"id {kind}, held_out boolean, lang_pred string, score double, accepted boolean")
    return done.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents whose language the model accepts, unchanged."""
    (letter,) = private(docs, "has_letter_")
    source = docs.withColumn(letter, F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    at, columns = docs.columns.index(text_col), len(docs.columns)

    def accepted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.asarray(batch.column(columns).to_pylist(), bool)
            if model is None or not len(known):
                continue
            shares, _ = model.predict(*byte_column(batch.column(at)))
            yield batch.select(range(columns)).filter(pa.array(known & (shares.max(axis=1) >= model.threshold)))

    return source.mapInArrow(accepted, docs.schema)


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model | None:
    """Learned from labelled rows outside the fold; a document labelled twice has its smallest label."""
    of = F.col(id_col)
    marked = labels.where(of.isNotNull() & F.col(label_col).isNotNull() & ~held_out(of, QUALITY_FOLD))
    marked = marked.groupBy(of.alias("id")).agg(F.min(label_col).alias("label"))
    texts = docs.select(of.alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    number = {row["label"]: row["count"] for row in marked.groupBy("label").count().collect()}
    draw = uniform(F.lit(5), F.col("id"))
    chosen = F.lit(False)
    for label, count in number.items():
        chosen = chosen | ((F.col("label") == label) & (draw < hashed_share(count, max_rows // len(number))))
    few = marked.where(chosen).orderBy(draw, "id").limit(2 * max_rows)  # hence small enough to broadcast
    sample = (
        texts.join(F.broadcast(few), "id").where(F.length("text") <= max_chars)
        .orderBy(draw, "id", "text").limit(2 * max_rows).select("text", "label").toArrow())
    return _fitted(sample, quality_features())


def quality_scores(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
                   good=1, least: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    source = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), QUALITY_FOLD).alias("held_out"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]
    at = model.classes.index(good) if model and good in model.classes else None

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if model is None:
                score = np.full(batch.num_rows, 0.5)
            elif at is None:
                score = np.zeros(batch.num_rows)
            else:
                score = model.predict(*byte_column(batch.column(2)))[0][:, at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= least).astype(np.int32))],
                ["id", "held_out", "score", "predicted"])

    done = source.mapInArrow(scored, f"id {kind}, held_out boolean, score double, predicted int")
    return done.withColumnRenamed("id", id_col)
