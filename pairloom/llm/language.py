"""Language identification by compression.

Each language has a raw-content dictionary of zstandard made from a bounded sample of its texts. A text is
compressed with every dictionary, and the language whose dictionary leaves fewest bytes is chosen.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.common import share, slices

UNKNOWN = "und"
# The sample that dictionaries are made from: so many texts a language, so many characters of each.
SAMPLE_TEXTS, SAMPLE_CHARACTERS = 200, 1_000
# Texts of all languages together: above 64 languages each has fewer, so that what is broadcast stays below 13 MB.
ALL_TEXTS = 64 * SAMPLE_TEXTS
# Bytes of a text that are compressed at a time: longer stretches would become their own dictionary.
STRETCH = 2_048
LEVEL = 3
# The second best must leave so much more than the best, as a share of the second, else the text is rejected.
MARGIN = 0.004

LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}']+")


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """Rows whose id, as text, has a CRC-32 divisible by ``folds``; NULL ids are not held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def plain(text: str) -> bytes:
    """Lower-case words of letters, a space between them: case, figures and signs tell no language."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS) -> dict[str, list[str]]:
    """Up to ``texts`` texts of every language, chosen by a hash of the text alone, whatever the table's order or size.

    First the distinct texts of each language are counted, about, so that copies do not crowd a language out; then rows pass
    whose hash lies below four times the share wanted, and of these the smallest hashes are taken. No language is left out: the
    more there are, the fewer texts each has, ``ALL_TEXTS`` at most together. More languages than that raise.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    h = F.xxhash64("text")
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).orderBy(F.desc("n"), "lang").limit(ALL_TEXTS + 1).collect()
    if not counts:
        return {}
    if len(counts) > ALL_TEXTS:
        raise ValueError(f"more than {ALL_TEXTS} languages")
    texts = min(texts, ALL_TEXTS // len(counts))
    wanted = rows.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * texts / max(r["n"], 1))) for r in counts], "lang string, share double")
    some = (
        rows.join(F.broadcast(wanted), "lang").where(F.pmod(h, F.lit(1 << 40)) < F.col("share") * float(1 << 40))
        .select("lang", F.substring("text", 1, SAMPLE_CHARACTERS).alias("text"), h.alias("h")).distinct()
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("n") <= texts)
    )
    out: dict[str, list[str]] = {}
    for r in sorted(some.collect(), key=lambda r: (r["lang"], r["n"])):
        out.setdefault(r["lang"], []).append(r["text"])
    return out


class Compressors:
    """One compressor a language; a worker digests the dictionaries once."""

    def __init__(self, texts: dict[str, list[str]]):
        self.raw = {lang: b" ".join(plain(t) for t in some) for lang, some in sorted(texts.items())}
        self.raw = {lang: raw for lang, raw in self.raw.items() if len(raw) >= 8}
        self.made = None

    def __getstate__(self):
        return {"raw": self.raw, "made": None}

    def sizes(self, text: bytes) -> list[int]:
        """Bytes left of the text, by language; without a frame's header."""
        import zstandard as z

        if self.made is None:
            self.made = []
            for raw in self.raw.values():
                d = z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self.made.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        parts = [text[i : i + STRETCH] for i in range(0, len(text), STRETCH)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.made]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); the score is the share by which the best undercuts the second."""
        if not text or not LETTER.search(text) or not self.raw:
            return UNKNOWN, 0.0, True
        sizes = self.sizes(plain(text))
        order = sorted(range(len(sizes)), key=sizes.__getitem__)
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else math.inf
        score = 1.0 if second == math.inf else 1 - best / second
        return list(self.raw)[order[0]], score, score < MARGIN


def learn(labelled: DataFrame) -> Compressors:
    """Dictionaries from the rows of ``labelled(text, lang)``; rows without text or language teach nothing."""
    return Compressors(sample(labelled))


def identify(docs: DataFrame, model: Compressors) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``rejected``.

    Only ``text`` is looked at, all of it. All rows and other columns stay; columns named as the new ones are
    replaced. NULL, empty and letterless texts are ``und``, score 0, rejected; so is everything if no language
    was learned. A tie goes to the first language by name, with score 0, and is rejected like any margin below ``MARGIN``.
    No shuffle.
    """
    held = share(docs.sparkSession, model)
    added = {"lang_pred": "string", "score": "double", "rejected": "boolean"}
    kept = docs.select(*[c for c in docs.columns if c not in added])
    schema = kept.withColumns({c: F.lit(None).cast(t) for c, t in added.items()}).schema

    def run(batches):
        for batch in slices(batches):
            columns = {n: batch.column(n) for n in batch.schema.names}
            found = [held().predict(t) for t in columns["text"].to_pylist()]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            columns |= {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return kept.mapInArrow(run, schema)
