"""Language by compression: a text belongs to the language whose dictionary packs it smallest.

Each language's zstandard raw-content dictionary holds slices of a bounded, hash-chosen sample of
labelled documents (``docs_per_lang`` rows a language, ``slice_chars`` each; these alone bound what
the driver fits). A text's letters are compressed whole, in pieces of ``piece_bytes``, so that the dictionary and not
the text's own past decides. A narrow margin to the runner-up rejects the document: under NARROW of
its size or, in short texts, under TIE_BYTES or TIE_SHARE, whichever is less.

Defined cases: null text, or text without a letter: ``und``, score 0, rejected; no labelled
document at all: ``und`` throughout; null doc_id: predicted like any other, never learned from,
not held out; repeated rows count once in the sample and are predicted each by itself; equal sizes
go to the language that comes first by name, and are rejected; very long texts are compressed whole,
piece by piece; empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import on_workers

LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = re.compile(r"[\W\d_]+")
UND = "und"
#: Lazy matching down to four bytes: short matches are what tells languages apart.
PARAMETERS = {"window_log": 18, "chain_log": 16, "hash_log": 16, "search_log": 4, "min_match": 4, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}

#: From the margins of labelled documents that aren't held out, and of random letters, whose margins
#: are some bytes at any length: relative ones shrink with the text, so short texts need a wider bound.
NARROW = 0.03
TIE_BYTES = 8
TIE_SHARE = 0.06


def letters_only(text: str) -> str:
    """Lower case, with each run of other characters as one space: marks and capitals tell no language."""
    return NOT_LETTERS.sub(" ", text.lower())


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, docs_per_lang: int = 64, slice_chars: int = 2000) -> dict[str, bytes]:
    """Dictionary content by language, from ``docs_per_lang`` distinct rows (doc_id, text) of each that
    are not held out, have lang, and a letter in the slice: those of the least hashes.

    Languages are counted first, so that only rows whose hash is about that small are sorted; where
    too few of them have letters, the bound is widened until they suffice or all have been looked at.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    rank = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11) / float(1 << 53)  # from 0 to 1
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - slice_chars, F.lit(0)) + 1) + 1
    part = F.substring(F.col("text"), at.cast("int"), F.lit(slice_chars))
    found: dict[str, list[str]] = {}
    open_, share = dict(counts), {lang: min(1.0, 4 * docs_per_lang / n) for lang, n in counts.items()}
    while open_:
        below = F.lit(False)
        for lang in sorted(open_):
            below = below | ((F.col("lang") == lang) & (rank <= share[lang]))
        rows = usable.where(below).select("lang", rank.alias("rank"), part.alias("part")).where(F.col("part").rlike(r"\p{L}"))
        rows = rows.groupBy("lang", "rank").agg(F.min("part").alias("part"))
        first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("lang").orderBy("rank"))).where(F.col("_n") <= docs_per_lang)
        chosen: dict[str, list[str]] = {}
        for r in sorted(first.collect(), key=lambda r: (r["lang"], r["_n"])):
            chosen.setdefault(r["lang"], []).append(r["part"])
        for lang in list(open_):
            if len(chosen.get(lang, [])) >= docs_per_lang or share[lang] >= 1:
                found[lang] = chosen.get(lang, [])
                del open_[lang]
            share[lang] = min(1.0, 8 * share[lang])
    return {lang: "\n".join(dict.fromkeys(letters_only(t) for t in parts)).encode() for lang, parts in sorted(found.items()) if parts}


class Classifier:
    def __init__(self, content: dict[str, bytes], piece_bytes: int, narrow: float):
        self.langs, self.piece, self.narrow = list(content), piece_bytes, narrow
        self.packers = []
        for raw in content.values():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(**PARAMETERS, write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            self.packers.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, rejected); the score is 0.5 where rejecting begins."""
        if not self.langs or text is None or not LETTER.search(text):
            return UND, 0.0, True
        raw = letters_only(text).encode("utf-8", "surrogatepass")
        n = -(-len(raw) // self.piece)
        step = -(-len(raw) // n)
        sizes = [sum(len(p.compress(raw[i : i + step])) for i in range(0, len(raw), step)) for p in self.packers]
        best = min(range(len(sizes)), key=lambda i: (sizes[i], self.langs[i]))
        rest = sizes[:best] + sizes[best + 1 :]
        if not rest:
            return self.langs[best], 1.0 / (1.0 + self.narrow), False
        margin = (min(rest) - sizes[best]) / min(rest)
        bound = max(self.narrow, min(TIE_SHARE, TIE_BYTES / min(rest)))
        return self.langs[best], margin / (margin + bound), margin < bound


def predict(docs: DataFrame, content: dict[str, bytes], piece_bytes: int = 4096, narrow: float = NARROW) -> DataFrame:
    """Adds lang_pred, score and rejected to the given columns; only ``text`` is looked at."""
    on_workers(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(content, piece_bytes, narrow)
        for batch in batches:
            found = [classify(t.as_py()) for t in batch.column("text")]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*names, "lang_pred", "score", "rejected"]
            )

    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every document."""
    content = fit(docs, **{k: v for k, v in options.items() if k in ("docs_per_lang", "slice_chars")})
    found = predict(docs.select("doc_id", "text"), content, **{k: v for k, v in options.items() if k in ("piece_bytes", "narrow")})
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame, **options) -> DataFrame:
    """The documents that aren't rejected, with their columns; a missing lang is filled in."""
    content = fit(docs, **options)
    found = predict(docs, content).where("NOT rejected").withColumn("lang", F.coalesce("lang", "lang_pred"))
    return found.select(docs.columns)
