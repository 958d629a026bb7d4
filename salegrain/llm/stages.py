"""The operators as stages of a corpus pipeline: (spark, docs, sf_dir) to the documents that go on.

All but the last return the columns of ``docs`` in their order, whatever else they are named, and an empty table for an empty one. Rows are judged
as the operators say: null ids and texts, repeated rows and very long texts are rows like any other, and a text is never cut. Each
docstring tells what that means for its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import remove_contaminated
from .line_dedup import dedup_lines
from .near_dedup import near_dedup
from .packing import pack
from .quality import keep_quality, learn_quality
from .queries import table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the folder's labels, does not reject.

    Null and empty texts are scored like any other; repeated rows stay or go together; a score of just 0.5 stays.
    """
    return keep_quality(docs, learn_quality(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many repeat; n_chars, where there is one, follows the text.

    Every row stays. A null text becomes an empty one; a null id is the smallest; rows with the same largest id all keep a line.
    """
    lines = dedup_lines(docs, carry=True)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return lines.select(*[changed.get(name, F.col(f"_row.`{name}`")).alias(name) for name in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Rows without an id, and texts without a word or null, stay. Rows that share an id are one document: they stay or go together.
    """
    gone = near_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts stay; repeated rows stay or go together."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed. Null and empty texts are one token; repeated rows and rows without an id are packed each for itself."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
