"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_fold
from .words import slices

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_compressors: dict[int, dict] = {}


def normalise(text: str) -> str:
    """Lower-cased letters, everything else as single spaces."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


@dataclass(frozen=True)
class LanguageModel:
    """A raw-content dictionary for each language, and how texts are compressed with it."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = 3
    piece: int = 512
    margin: float = 0.01

    def compressors(self) -> dict:
        import zstandard

        key = hash(self)
        if key not in _compressors:
            made = {}
            for lang, content in self.dictionaries:
                shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                shared.precompute_compress(level=self.level)
                made[lang] = zstandard.ZstdCompressor(
                    dict_data=shared, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            _compressors.clear()
            _compressors[key] = made
        return _compressors[key]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, accepted). Score rises from 0 with the margin to the next language, 1 is its limit."""
        plain = normalise(text or "")
        if not self.dictionaries or not any(map(str.isalpha, plain)):
            return "und", 0.0, False
        data = plain.encode()
        pieces = [data[at : at + self.piece] for at in range(0, len(data), self.piece)]
        sizes = [(sum(len(c.compress(p)) for p in pieces), lang) for lang, c in self.compressors().items()]
        best = min(size for size, _ in sizes)
        lang = next(lang for size, lang in sizes if size == best)
        following = min((size for size, other in sizes if other != lang), default=None)
        margin = 1.0 if following is None else (following - best) / following
        return lang, margin / (margin + 0.02), margin >= self.margin


def fill(pieces: list[bytes], most: int) -> list[bytes]:
    """The pieces, the longest cut to one common length, so that together they have at most ``most`` bytes, and all of them if they can."""
    sizes, left = sorted(map(len, pieces)), most
    for i, size in enumerate(sizes):
        if size * (len(sizes) - i) > left:
            return [piece[: left // (len(sizes) - i)] for piece in pieces]
        left -= size
    return pieces


def learn_languages(train: DataFrame, docs_per_language: int = 400, dictionary_bytes: int = 200_000, margin: float = 0.01) -> LanguageModel:
    """Dictionaries from ``train`` (doc_id, text, lang); rows with null text or lang are left out.

    Bounded sample: for each language at most ``docs_per_language`` documents, those with the least hash of their id (ties by text), and of
    each up to ten equal shares of ``dictionary_bytes`` from a hashed place of its whole text on. All give the same, the short ones all they
    have, until the dictionary is full. Languages go by falling number of documents, so that ties of
    sizes go to the commoner one. Their number is that of the distinct values of ``lang``.
    """
    able = train.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counts = sorted(((r["lang"], r["n"]) for r in able.groupBy("lang").agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[1], x[0]))
    if not counts:
        return LanguageModel((), margin=margin)
    share = 10 * dictionary_bytes // docs_per_language
    limits = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, min(1.0, 2 * docs_per_language / n))])
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    place = 1 + F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.greatest(F.length("text") - share + 1, F.lit(1)))
    chosen = able.withColumn("_rank", rank).where(F.col("_rank") <= F.element_at(limits, F.col("lang")) * (1 << 40))
    piece = F.substring("text", place.cast("int"), F.lit(share)).alias("_piece")
    rows = chosen.select(F.col("lang").alias("_lang"), "_rank", piece)
    first = Window.partitionBy("_lang").orderBy("_rank", "_piece")
    rows = rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= docs_per_language).orderBy("_lang", "_n").collect()
    made = []
    for lang, _ in counts:
        pieces = [piece for r in rows if r["_lang"] == lang if (piece := normalise(r["_piece"]).encode())]
        content = b" ".join(fill(pieces, dictionary_bytes - len(pieces)))
        if len(content) >= 8:
            made.append((lang, content))
    return LanguageModel(tuple(made), margin=margin)


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score, accepted for every row of ``docs`` (doc_id, text).

    Texts are lower-cased, cut to letters and compressed whole, piece by piece. ``accepted`` is false where the margin
    between the two smallest sizes is under the model's. Null texts, texts without a letter, and all texts under a model that learned no
    language are "und" with score 0; of equal sizes the commoner language wins. Repeated rows and null ids are treated like any row; very long
    texts are compressed whole; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            langs, scores, accepted = zip(*(shared.value.predict(text.as_py()) for text in batch.column("text")), strict=True)
            columns = [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "accepted"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows outside the held-out fold; rows with a null id belong to no fold and are left out."""
    return docs.where(crc_fold(F.col("doc_id")) != 1)
