"""Language identification by compression.

Each language has a raw-content zstandard dictionary of sample texts. A text is
encoded with each; the language whose dictionary gives the fewest bytes wins,
and a narrow margin marks the decision as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_text_batches, to_batch

#: For each language, one document of each of so many hash strata; the dictionary has an equal share of its bytes for
#: each, which a longer text gives in pieces of SAMPLE_PIECE bytes from all over it.
SAMPLE_DOCS, DICTIONARY_BYTES, SAMPLE_PIECE = 128, 200_000, 250
FOLDS, HELD_OUT = 4, 2
LEVEL = 5
#: Decisions whose second-best size is less than this part above the best are rejected.
MARGIN = 0.01
#: Texts are encoded in pieces of this many bytes, so a long text's own history does not outweigh the dictionary.
PIECE = 4096
LETTERS = regex.compile(r"\p{L}+")  # not numbers such as ² or Ⅷ, which are no letters

SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())])


def plain(text: str) -> bytes:
    """The words of a text in lower case: markup and capitals say nothing of the language."""
    return " ".join(LETTERS.findall(text.lower())).encode("utf-8", "replace")


def fold(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS))


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language, from rows with a language outside the held-out fold.

    At most SAMPLE_DOCS documents of each language reach the driver, and of each
    no more than four shares of DICTIONARY_BYTES.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    strata = rows.where("text is not null").groupBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_DOCS)).alias("stratum"))
    picked = strata.agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(1))).alias("doc_id"))
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in picked.select("doc_id", "lang").collect()], "doc_id long, lang string")
    found = rows.join(F.broadcast(ids), ["doc_id", "lang"])  # SAMPLE_DOCS rows for each language
    found = found.mapInArrow(sample_pieces, "doc_id long, lang string, sample binary")
    found = found.groupBy("doc_id", "lang").agg(F.min("sample").alias("sample"))  # a doc_id that repeats is one document
    samples: dict[str, list[bytes]] = {}
    for r in found.select("lang", "sample").collect():
        samples.setdefault(r.lang, []).append(bytes(r.sample))
    return {lang: dictionary(samples[lang]) for lang in sorted(samples)}


def pieces_of(body: bytes, room: int) -> bytes:
    """body, or pieces of it that start at even distances and fill the room."""
    if len(body) <= room:
        return body
    n = max(1, room // SAMPLE_PIECE)
    starts = np.linspace(0, len(body) - SAMPLE_PIECE, n).astype(int).tolist() if n > 1 else [(len(body) - SAMPLE_PIECE) // 2]
    return b" ".join(body[s : s + SAMPLE_PIECE] for s in starts)


def sample_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, lang and up to four shares of each text's words; what short texts leave free goes to longer ones."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("sample", pa.binary())])
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield to_batch(schema, batch.column("doc_id"), batch.column("lang"), [pieces_of(plain(t or ""), 4 * DICTIONARY_BYTES // SAMPLE_DOCS) for t in texts])


def dictionary(samples: list[bytes]) -> bytes:
    """Equal shares of the samples, the shortest giving way to longer ones."""
    ordered = sorted(set(samples), key=lambda b: (len(b), b))
    out, room = [], DICTIONARY_BYTES
    for i, b in enumerate(ordered):
        out.append(pieces_of(b, room // (len(ordered) - i)))
        room -= len(out[-1])
    return b"\n".join(out)


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = list(dictionaries)
        self.coders = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected)"""
        data = plain(text or "")
        if not data or not self.langs:
            return "und", 0.0, 0.0, True
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        sizes = np.array([sum(len(c.compress(p)) for p in pieces) for c in self.coders], np.float64)
        order = np.argsort(sizes, kind="stable")
        best = sizes[order[0]]
        margin = float(sizes[order[1]] / best - 1) if len(order) > 1 else 1.0
        odds = np.exp2(-np.minimum(8 * (sizes - best) / max(1.0, np.sqrt(len(data))), 60))
        return self.langs[order[0]], float(1 / odds.sum()), margin, margin < MARGIN


def classify_all(dictionaries: dict[str, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(dictionaries)
        for batch in batches:
            if batch.num_rows:
                yield to_batch(SCORED, batch.column(0), batch.column(2), *zip(*map(classify, batch.column(1).to_pylist())))

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected for every row of docs.

    Dictionaries come only from text and non-null lang of rows whose
    crc32(doc_id as text) mod 4 is not 2; predictions use nothing but the text.
    lang_pred is the language of the smallest encoding, ties to the first by
    name, and `und` (score 0) for a null text, one without letters, or where no
    language could be learned. rejected marks a margin below MARGIN. A null
    doc_id counts as not held out. An empty table gives no rows.
    """
    small_text_batches(docs.sparkSession)
    held = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    return id_text(docs).select("doc_id", "text", held).mapInArrow(
        classify_all(fit(docs)), "doc_id long, held_out boolean, lang_pred string, score double, margin double, rejected boolean"
    )
