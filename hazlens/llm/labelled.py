"""Labelled rows for training, and those held out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: F.Column) -> F.Column:
    """True for the fold that is never learned from. A null doc_id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def known(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of the labelled documents outside the held-out fold. A doc_id with several labels has the least of them."""
    found = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return found.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col(label).cast("int")).alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int | None, parts: int = 1) -> DataFrame:
    """doc_id, text, lang, label and h, a hash of the text, of the rows of at most ``rows`` labelled documents
    outside the held-out fold; of all of them for None.

    The documents are those of the least hashes of doc_id, the same on every run; their number
    bounds the broadcast. Without a bound both tables are dealt over ``parts`` by doc_id, each text once, and stay so. One that several rows
    have is still here with each; :func:`one_a_document` takes what was made of one of them.
    """
    chosen = known(labels, label)
    if rows is None:
        # by one way at any size: a broadcast would grow with the labels
        chosen = chosen.repartition(parts, "doc_id").hint("merge")
    else:
        chosen = F.broadcast(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    outside = docs.where(~held_out(F.col("doc_id")))
    texts = outside.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lang.cast("string").alias("lang"), F.xxhash64("text").alias("h"))
    return (texts.repartition(parts, "doc_id") if rows is None else texts).join(chosen, "doc_id")


def one_a_document(made: DataFrame) -> DataFrame:
    """One row of each doc_id, that of the least (h, lang), without h."""
    kept = [c for c in made.columns if c not in ("doc_id", "h")]
    first = F.struct("h", *(c for c in kept if c == "lang"))
    return made.groupBy("doc_id").agg(F.min_by(F.struct(*kept), first).alias("r")).select("doc_id", "r.*")
