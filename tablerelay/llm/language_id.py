"""Language identification by compression.

For each language a zstandard dictionary of raw content is cut from labelled texts. A text is
compressed, piece by piece, with each of them; the smallest sum is its language. How much
smaller it is than the next is the score, and a narrow margin rejects the text.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablerelay.llm.common import add_columns, written

#: The sample that the dictionaries are fitted on: of every language at most so many documents,
#: chosen by a hash of their id, and a window of each document.
DOCUMENTS, WINDOW = 64, 4096
#: Letters of the sample; more languages than fill it get narrower windows, down to the least one.
SAMPLE, LEAST_WINDOW = 64 * DOCUMENTS * WINDOW, 256
#: Bytes of a dictionary.
DICTIONARY = 64 << 10
#: Where the margin is narrow, as in very short texts, so many parts of each dictionary are
#: asked as well, each on its own, and the sizes added up.
PARTS = 8
#: Letters compressed at a time, so that a long text can't lean on itself alone.
CHUNK = 2048
LEVEL = 6
#: Margin, as a share of the second smallest size, below which a text is rejected.
NARROW = 0.002
UNKNOWN = "und"

_NO_LETTERS = re.compile(r"[\W\d_]+")

PREDICTED = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
])


def letters(text: str | None) -> str:
    """The words of a text in lower case with single spaces; empty where there is no letter."""
    words = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    return words if any(c.isalpha() for c in words) else ""


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language, the most common first, from ``doc_id``, ``text`` and ``lang``.

    Two passes: counts by language, which give each one its share of ids, and the sample.
    Every language with letters gets a dictionary. What reaches the driver is bounded by SAMPLE
    up to 1,024 languages, and by DOCUMENTS times LEAST_WINDOW for each one beyond.
    """
    usable = labelled.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = written(usable.groupBy("lang").agg(F.count("*").alias("rows")), "language-counts")
    languages = counts.orderBy(F.desc("rows"), "lang").collect()
    if not languages:
        return {}
    window = max(LEAST_WINDOW, min(WINDOW, SAMPLE // (DOCUMENTS * len(languages))))
    texts = defaultdict(dict)

    def take(chosen: DataFrame, at: Column) -> None:
        order = F.expr("row_number() over (partition by lang order by place, text)")
        sample = chosen.select("lang", "place", F.substring("text", at, F.lit(window)).alias("text"))
        for row in sample.withColumn("n", order).filter(F.col("n") <= DOCUMENTS).orderBy("lang", "n").collect():
            if words := letters(row["text"]):
                texts[row["lang"]][words] = None

    scale = 1 << 30
    share = F.expr(f"least({scale}L, {2 * DOCUMENTS * scale}L div rows)")
    start = F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(F.lit(1), F.length("text") - window + 1)).cast("int") + 1
    placed = usable.withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(scale)))
    take(placed.join(counts, "lang").filter(F.col("place") < share), start)
    # Where few ids are shared by all, none may fall into the share, and a window may have no letter.
    missed = [r["lang"] for r in languages if r["lang"] not in texts]
    if missed:
        by_text = usable.filter(F.col("lang").isin(missed)).withColumn("place", F.pmod(F.xxhash64("text"), F.lit(scale)))
        take(by_text, F.regexp_instr("text", F.lit(r"\p{L}")))
    by_count = [r["lang"] for r in languages if r["lang"] in texts]
    return {lang: "\n".join(texts[lang]).encode()[-DICTIONARY:].decode(errors="ignore").encode() for lang in by_count}


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """Frames without anything but the compressed bytes."""
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=CHUNK, dict_size=len(content), format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


class Compressors:
    """The dictionaries of each language, ready to compress."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.whole = {lang: compressor(content) for lang, content in dictionaries.items()}
        self.dictionaries, self.parts = dictionaries, {}

    def parts_of(self, lang: str) -> list[zstandard.ZstdCompressor]:
        """Those of the eighths, made when a narrow margin first asks for them."""
        if lang not in self.parts:
            content = self.dictionaries[lang]
            self.parts[lang] = [compressor(content[k * len(content) // PARTS:(k + 1) * len(content) // PARTS] or b" ") for k in range(PARTS)]
        return self.parts[lang]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is too narrow. Equal sizes go to the
        more common language, with score 0."""
        words = letters(text)
        if not words or not self.whole:
            return UNKNOWN, 0.0, True
        chunks = [words[i:i + CHUNK].encode() for i in range(0, len(words), CHUNK)]
        sizes = {lang: sum(len(by.compress(x)) for x in chunks) for lang, by in self.whole.items()}
        lang, score = _smallest(sizes)
        if score < NARROW:
            lang, score = _smallest({k: n + sum(len(by.compress(x)) for by in self.parts_of(k) for x in chunks) for k, n in sizes.items()})
        return lang, score, score < NARROW


def _smallest(sizes: dict[str, int]) -> tuple[str, float]:
    (lang, best), *others = sorted(sizes.items(), key=lambda x: x[1])
    return lang, (others[0][1] - best) / others[0][1] if others else 1.0


def identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    Nothing but the text is looked at, and all of it. Null texts and texts without a letter
    are ``und``, with score 0, and rejected; so is every text where no language was learned.
    Rows that repeat stay; existing columns with these names are replaced.
    """

    def make():
        by = Compressors(dictionaries)

        def work(texts):
            langs, scores, rejected = zip(*(by.predict(t) for t in texts)) if texts else ((), (), ())
            return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]

        return work

    return add_columns(docs, text, PREDICTED, make)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: CRC-32 of the id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
