"""Language ID by compression: each text is encoded with a raw-content dictionary of every language, and the smallest wins.

Texts are encoded in blocks, so that a long text is judged by the dictionaries and not by what it repeats itself; each block votes with
its bytes, and the sums of the sizes settle ties and give the margin.
"""

from __future__ import annotations

from dataclasses import dataclass

import zstandard as zstd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from .text import annotate, raw_text

#: Bytes of text per language that a dictionary is made of: the documented bound of the sample that is learned from.
DICTIONARY_BYTES = 32 << 10
#: Characters that one document gives to a dictionary at most.
EXCERPT = 1000
LEVEL = 6
BLOCK = 512
#: Documents whose margin is smaller are rejected. Chosen on the labelled rows of sf0.1 that aren't held out.
MIN_MARGIN = 0.02

_LETTER_TABLE = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def letters_only(text: str) -> bytes:
    """Lower case, with every run of ASCII characters that are no letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTER_TABLE).split())


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


@dataclass(frozen=True)
class Model:
    """Languages by falling frequency, then name, each with its dictionary; the earlier wins a tie."""

    languages: list[str]
    dictionaries: list[bytes]

    def compressors(self):
        return [zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(d, dict_type=zstd.DICT_TYPE_RAWCONTENT),
                                    write_checksum=False, write_content_size=False, write_dict_id=False).compress
                for d in self.dictionaries]


def learn(docs: DataFrame, usable: Column, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Make a dictionary per language from about `dictionary_bytes` of the documents that are `usable`, in the order of a digest.

    A document gives an excerpt of at most EXCERPT characters, at a place set by its digest and the text's length.
    Rows with a null text or lang teach nothing. Language frequencies are counted over all usable rows.
    """
    labelled = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Model([], [])
    # enough documents even of 30 characters; a share of each language by digest keeps the sort of a frequent one small
    wanted = dictionary_bytes // 30
    digest = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("place")), F.greatest(F.length("text") - EXCERPT + 1, F.lit(1)).cast("bigint"))
    spread = (1 << 62) - 1
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(spread * min(1.0, 2 * wanted / n))))])
    drawn = (labelled.select("lang", digest.bitwiseAND(spread).alias("at"), F.col("doc_id").cast("string").alias("id"),
                             F.substring(F.col("text"), (place + 1).cast("int"), F.lit(EXCERPT)).alias("text"))
             .filter(F.col("at") <= share[F.col("lang")])
             .withColumn("size", F.sum(F.length("text")).over(W.partitionBy("lang").orderBy("at", "id", "text")
                                                               .rowsBetween(W.unboundedPreceding, -1)))
             .filter(F.coalesce("size", F.lit(0)) < 2 * dictionary_bytes))
    texts: dict[str, list] = {lang: [] for lang in counts}
    for r in drawn.collect():
        texts[r.lang].append((r.at, r.id, r.text))
    order = sorted(counts, key=lambda lang: (-counts[lang], lang))
    return Model(order, [b" ".join(letters_only(t) for _, _, t in sorted(texts[lang]))[:dictionary_bytes] or b" " * 8 for lang in order])


def predict(docs: DataFrame, model: Model, min_margin: float = MIN_MARGIN, into: str = "language") -> DataFrame:
    """Add struct `into`: lang (`und` for null texts, texts without a letter, or an empty model), score (share of the bytes whose
    blocks vote for it), margin (by how much the next language needs more bytes, below zero where it needs fewer), accepted (not `und`, and no narrow margin).

    Only the text decides. Repeated rows give equal results each; all other columns pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        languages, compress = shared.value.languages, shared.value.compressors()

        def row(text):
            if not text or not languages or not any(map(str.isalpha, text)):
                return "und", 0.0, 0.0, False
            raw = letters_only(text)
            votes, sizes = [0] * len(languages), [0] * len(languages)
            for at in range(0, len(raw), BLOCK):
                block = raw[at:at + BLOCK]
                each = [len(c(block)) for c in compress]
                votes[each.index(min(each))] += len(block)
                for i, size in enumerate(each):
                    sizes[i] += size
            best = min(range(len(languages)), key=lambda i: (-votes[i], sizes[i], i))
            others = [s for i, s in enumerate(sizes) if i != best]
            margin = 1 - sizes[best] / min(others) if others and min(others) else 1.0
            return languages[best], votes[best] / max(1, len(raw)), max(-1.0, margin), margin > 0 and margin >= min_margin

        return row

    return annotate(docs, into, "lang string, score double, margin double, accepted boolean", [F.col("text")], make)
