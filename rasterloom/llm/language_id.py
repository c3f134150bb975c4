"""Operator 7, language identification by compression.

Method: each language has a raw-content zstandard dictionary, made of labelled documents. A text is encoded with
every dictionary, and the language whose encoding is smallest is chosen. The score is the lead over the second
smallest, as a share of it, times SCALE and 1 at most; `rejected` marks leads under NARROW.

Fitting reads text and lang of documents with a lang whose crc32(doc_id as text) mod 3 is not 1. The sample is
bounded: per language, whole texts in the order of a hash until DICT_BYTES are full; empty texts and texts longer than
that take part only where a language has no other, cut to DICT_BYTES. Every language that has a labelled text gets a
dictionary, whatever the draw (sampled() draws again where chance left one short); more than MOST_LANGUAGES are an
error, as the dictionaries are sent to all workers. Prediction reads every whole text and
nothing but the text.

Defined results: null text, or one without a letter (Unicode categories L*, so that digits, fractions and
numerals are none), is `und` with score 0; so is every text if nothing labelled was found. With one learned
language the score is 1. Equal sizes go to the first language in order, with score 0. A null doc_id is not held
out. Repeated rows give repeated rows, and count once in the sample; an empty table gives an empty one; columns
besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import map_texts, table

DICT_BYTES = 64 << 10
#: A first draw fills so many dictionaries on average, and each further one so many times as much.
SPARE = 3
LEVEL = 1
SCALE = 10.0
NARROW = 0.02
MOST_LANGUAGES = 500


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def sampled(known: DataFrame) -> dict[str, list[tuple[int, str]]]:
    """Hash and text of labelled rows, for each language the first in the order of hashes, and enough of them: DICT_BYTES,
    or all that it has. Only of a language without texts of 1 to DICT_BYTES bytes others are taken, one at least.

    One pass sums sizes per language; one reads the rows whose hash lies under the language's share of all hashes. Chance
    may leave a language short (a share of three long texts leaves none of them once in twenty times), so that those that
    came out short are drawn again with SPARE times the share, until they have enough or their share is everything."""
    size = F.octet_length("text")
    fits = size.between(1, DICT_BYTES)
    sums = known.groupBy("lang").agg(F.sum(F.when(fits, size)).alias("bytes"), F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(sums) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    other = [r["lang"] for r in sums if not r["bytes"]]
    spread = 1 << 30
    hashed = F.xxhash64("doc_id", "text")
    taken = fits | F.array_contains(F.array(*map(F.lit, other)).cast("array<string>"), F.col("lang"))
    short = {r["lang"]: SPARE * DICT_BYTES / r["bytes"] if r["bytes"] else SPARE / r["n"] for r in sums}
    found: dict[str, list[tuple[int, str]]] = {}
    while short:
        limits = F.create_map(*[F.lit(x) for lang, share in short.items() for x in (lang, min(spread, int(spread * share) + 1))])
        drawn = known.filter((F.pmod(hashed, F.lit(spread)) < F.try_element_at(limits, F.col("lang"))) & taken)
        rows = drawn.select("lang", hashed.alias("h"), F.substring("text", 1, DICT_BYTES).alias("t")).groupBy("lang", "h").agg(F.min("t").alias("t")).collect()
        got: dict[str, list[tuple[int, str]]] = {lang: [] for lang in short}
        for r in rows:
            got[r["lang"]].append((r["h"] % spread, r["h"], r["t"]))
        enough = lambda lang, texts: texts if lang in other else sum(len(t.encode()) for *_, t in texts) >= DICT_BYTES
        done = {lang: [(h, t) for _, h, t in sorted(texts)] for lang, texts in got.items() if short[lang] >= 1 or enough(lang, texts)}
        found |= done
        short = {lang: share * SPARE for lang, share in short.items() if lang not in done}
    return found


def dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """A raw-content dictionary for each language, from a bounded sample of labelled documents: its texts in the order of
    their hashes, those left out that would run over DICT_BYTES."""
    out = {}
    for lang, texts in sorted(sampled(docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())).items()):
        data = b""
        for _, t in texts:
            t = t.encode()[:DICT_BYTES] + b"\n"
            if not data or len(data) + len(t) <= DICT_BYTES:
                data += t
        out[lang] = data
    return out


class Classifier:
    def __init__(self, dicts: tuple[tuple[str, bytes], ...]) -> None:
        import zstandard as z

        self.langs, self.encoders = [], []
        for lang, data in dicts:
            d = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.langs.append(lang)
            self.encoders.append(z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not has_letter(text):
            return "und", 0.0, True
        data = text.encode()
        sizes = [(len(e.compress(data)), k) for k, e in enumerate(self.encoders)]
        best, k = min(sizes)
        if len(sizes) == 1:
            return self.langs[k], 1.0, False
        second = min(s for s, j in sizes if j != k)
        lead = (second - best) / second
        return self.langs[k], min(1.0, SCALE * lead), lead < NARROW


@lru_cache(maxsize=2)
def classifier(dicts: tuple[tuple[str, bytes], ...]) -> Classifier:
    return Classifier(dicts)


def languages(docs: DataFrame, dicts: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score and rejected for each row; only the text is looked at."""
    fixed = tuple(sorted(dicts.items()))
    return map_texts(docs, lambda _, text: classifier(fixed)(text), "lang_pred string, score double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return languages(docs, dictionaries(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
