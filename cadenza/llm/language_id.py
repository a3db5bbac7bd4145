"""Language identification by compression.

Each language has a raw-content dictionary for zstandard, made of a bounded sample of its labelled
documents. A text is cut into blocks, every block is compressed with every dictionary, and the
language whose dictionary gives the fewest bytes in all is chosen. Where the best and the second
best language differ by less than a margin, the choice is marked as not accepted.

Null texts, and texts without a letter, are `und` with score 0 and not accepted. Ties go to the
language that comes first by name. Without any labelled document every text is `und`. Repeated
rows are judged one by one.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import small_batches, texts_of

UNKNOWN = "und"
SCORES = "doc_id long, lang_pred string, score double, margin double, accepted boolean"
LETTER = re.compile(r"[^\W\d_]")


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(modulus))


def dictionaries(learn: DataFrame, text_col: str, lang_col: str, sample_rows: int, sample_bytes: int) -> dict[str, bytes]:
    """For each language, up to sample_rows different whole texts, the first in hash order, of sample_bytes together at most.

    A text that would go over the bytes is passed over for the next. The sample is bounded by the number of languages. Different
    texts are counted first; a bound on the hash then leaves about four times as many as are needed of each language before
    any row is sent on, and copies of a text are one, so neither a language with most of the corpus nor a text
    with very many copies weighs more than others.
    """
    rows = learn.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).withColumn("size", F.octet_length("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("size").between(1, sample_bytes)).withColumn("h", F.xxhash64("text"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row for each language
    cuts = {k: int(-(2**63) + 2**64 * (4 * sample_rows + 50) / n) for k, n in counts.items() if n > 4 * sample_rows + 50}
    if cuts:
        bounds = F.create_map(*(F.lit(x) for p in cuts.items() for x in p))
        rows = rows.filter(F.col("h") <= F.coalesce(F.try_element_at(bounds, "lang"), F.lit(2**63 - 1)))
    sizes = rows.groupBy("lang", "h").agg(F.min("size").alias("size"))  # about five times sample_rows a language
    taken: dict[str, set[int]] = {}
    total: dict[str, int] = {}
    for r in sorted(sizes.collect(), key=lambda r: (r.lang, r.h)):
        if len(taken.setdefault(r.lang, set())) < sample_rows and total.get(r.lang, 0) + r.size <= sample_bytes:
            taken[r.lang].add(r.h)
            total[r.lang] = total.get(r.lang, 0) + r.size
    chosen = rows.sparkSession.createDataFrame([(k, h) for k, hs in taken.items() for h in hs], "lang string, h long")
    texts = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(texts.collect(), key=lambda r: (r.lang, r.h)):
        out.setdefault(r.lang, []).append(r.text)
    return {k: "\n".join(v).lower().encode(errors="replace") for k, v in sorted(out.items())}


class Classifier:
    def __init__(self, content: dict[str, bytes], level: int, block_chars: int, margin: float, sharpness: float):
        self.content, self.level, self.block_chars, self.margin, self.sharpness = content, level, block_chars, margin, sharpness
        self.compressors: list = []

    def __getstate__(self):
        return {**self.__dict__, "compressors": []}

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, margin over the second best, and whether the margin is wide enough."""
        import zstandard

        if not text or not self.content or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0, False
        if not self.compressors:
            for x in self.content.values():
                d = zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self.compressors.append(zstandard.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_dict_id=False))
        low = text.lower()
        blocks = [low[i : i + self.block_chars].encode(errors="replace") for i in range(0, len(low), self.block_chars)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in self.compressors]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        shares = [math.exp(-self.sharpness * (s / sizes[best] - 1)) for s in sizes]
        second = min((s for i, s in enumerate(sizes) if i != best), default=sizes[best] * 2)
        margin = (second - sizes[best]) / second
        return list(self.content)[best], shares[best] / sum(shares), margin, margin >= self.margin


def learn_languages(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = 256, sample_bytes: int = 1 << 20, level: int = 6, block_chars: int = 4096, margin: float = 0.01, sharpness: float = 20.0
) -> Classifier:
    """A classifier from labelled documents."""
    return Classifier(dictionaries(docs, text_col, lang_col, sample_rows, sample_bytes), level, block_chars, margin, sharpness)


def identify(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: lang_pred, score in [0, 1], margin, accepted. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # bounded by languages x sample size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCORES.split(", ")]
        for b in small_batches(batches):
            found = [shared.value.predict(t) for t in b.column(1).to_pylist()]
            columns = zip(*found, strict=True) if found else [[]] * 4
            types = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return texts_of(docs, id_col, text_col).mapInArrow(judge, SCORES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose remainder by 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = docs.filter(F.col("lang").isNotNull() & (remainder("doc_id", 4) != 2))
    found = identify(docs, learn_languages(learn))
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "accepted")
