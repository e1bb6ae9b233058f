"""I-Match fingerprints with randomised lexicon subsets, with DataFrame functions only.

A lexicon holds the terms within a band of inverse document frequency: not so frequent that many documents have
them, nor so rare that hardly one has.  A document keeps its different lexicon terms, sorted.  Each random part of the
lexicon gives one hash of the document's terms in that part; the fingerprint is their list.  Parts come in ``LEVELS``
sizes, a half, a quarter, ... of the lexicon, ``PER_LEVEL`` of each: small ones survive large edits of long texts,
large ones tell short texts apart.  The likeness of two fingerprints is the share of equal hashes at one size: the
smallest at which half of the parts or more have a term of either document.

Terms are counted in ``SLOTS`` hashed slots, so counts and lexicon have a fixed size, and the lexicon goes into the
plan as one bit per slot (150 KB).  Rare terms fill all slots alike, to about 250 in a million documents; the upper
end of the band lies below that, so it means the same at every size of the corpus.

The next document (descending doc_id) is found on ids alone, dealt to ranges; inside a range it is the neighbour, and over
its limit the largest id of the range below.  A text is signed once and sent to its id once, whence its neighbour gets the
part of the text that it asks for and the hashes.

Defined results: words are runs without 09-0D and 20, lower-cased; null text is empty; texts without a lexicon term
have the hash of all their words for a fingerprint, like only to equal ones; rows with a null doc_id come last in the
order, as if they shared an id; of rows that share a doc_id, that with the smallest text is the next document; a single
document is its own next one; empty tables give empty results; further columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortloom.session import written

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
LEAST_IDF, MOST_IDF = 2.0, 8.0  # natural logarithms; a slot of a single document is never in the band
LEVELS, PER_LEVEL = 10, 10
SEED = 29
NO_ID = -(1 << 63) - 1  # stands for a null doc_id, below all others


def term_hashes(text: Column) -> Column:
    """The different terms of a text as sorted 64-bit hashes."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+")
    hashed = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w, F.lit(SEED)))
    return F.array_sort(F.array_distinct(hashed))


def _slot(term: Column) -> Column:
    return F.shiftrightunsigned(term, 64 - SLOT_BITS).cast("int")


def lexicon(docs: DataFrame, least: float = LEAST_IDF, most: float = MOST_IDF) -> bytes:
    """Seven slots a byte: is the inverse document frequency, ln(documents / frequency), of a slot within the band?

    The driver gets at most SLOTS / 7 numbers, whatever the corpus.
    """
    slots = F.array_distinct(F.transform(term_hashes(F.col("text")), _slot))
    counts = docs.select(F.explode(slots).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(float(max(docs.count(), 1))) / F.col("df"))
    chosen = counts.where((F.col("df") > 1) & idf.between(least, most))
    at, bit = F.floor(F.col("slot") / 7).cast("int"), F.pow(F.lit(2), F.col("slot") % 7).cast("int")
    out = bytearray(SLOTS // 7 + 1)
    for row in chosen.groupBy(at.alias("at")).agg(F.sum(bit).alias("bits")).collect():
        out[row["at"]] = row["bits"]
    return bytes(out)


def _in_lexicon(term: Column, words: bytes) -> Column:
    slot = _slot(term)
    byte = F.ascii(F.substring(F.lit(words), F.floor(slot / 7).cast("int") + 1, F.lit(1)).cast("string"))
    return F.floor(byte / F.pow(F.lit(2), slot % 7)).cast("int").bitwiseAND(F.lit(1)) == 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, whatever the optimiser makes of the columns around it."""
    return F.transform(F.array(value), body)[0]


def with_signature(df: DataFrame, text: str, words: bytes, name: str) -> DataFrame:
    """Add ``<name>_hashes`` (by size, one a part; null where the text has no term there) and ``<name>_plain``.

    The second is the hash of all words of a text without a lexicon term, else null.
    Parts with the same number are nested: the terms whose hash has one zero bit at its end, two, and so on.
    """

    def nested(band: Column, number: Column) -> Column:
        hashed = F.transform(band, lambda t: F.xxhash64(t, number))
        start = F.struct(F.filter(hashed, lambda h: h.bitwiseAND(F.lit(1)) == 0).alias("rest"), F.array().cast("array<int>").alias("found"))

        def halved(acc: Column, zeros: Column) -> Column:
            here = F.when(F.size(acc["rest"]) > 0, F.hash(acc["rest"]))
            rest = F.filter(acc["rest"], lambda h: F.getbit(h, zeros) == 0)
            return F.struct(rest.alias("rest"), F.concat(acc["found"], F.array(here)).alias("found"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, halved)["found"]

    def signature(terms: Column, band: Column) -> Column:
        by_number = F.transform(F.sequence(F.lit(1), F.lit(PER_LEVEL)), lambda number: nested(band, number))
        by_size = lambda numbered: F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda k: F.transform(numbered, lambda found: found[k]))
        plain = F.when(F.size(band) == 0, F.concat(F.lit("w"), F.lower(F.hex(F.xxhash64(terms)))))
        return _let(by_number, lambda numbered: F.struct(by_size(numbered).alias("hashes"), plain.alias("plain")))

    in_band = lambda terms: F.filter(terms, lambda t: _in_lexicon(t, words))
    found = _let(term_hashes(F.col(text)), lambda terms: _let(in_band(terms), lambda band: signature(terms, band)))
    return df.withColumn(name, found).withColumns({f"{name}_{part}": F.col(name)[part] for part in ("hashes", "plain")}).drop(name)


def shown(name: str) -> Column:
    """A fingerprint as text: its hashes with points between them, or that of all words."""
    listed = F.transform(F.flatten(f"{name}_hashes"), lambda h: F.lower(F.hex(h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))
    return F.coalesce(f"{name}_plain", F.array_join(listed, ".", "-"))


def likeness(a: str, b: str) -> Column:
    """Share of equal hashes at the smallest size at which half of the parts have a term; 1 for equal fingerprints."""

    def of_size(x: Column, y: Column) -> Column:
        used = F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda p: p["x"].isNotNull() | p["y"].isNotNull())
        return F.struct(F.size(used).alias("used"), F.size(F.filter(used, lambda p: p["x"] == p["y"])).alias("equal"))

    sizes = F.zip_with(f"{a}_hashes", f"{b}_hashes", of_size)

    def last_telling(found: Column) -> Column:
        telling = F.filter(found, lambda s: s["used"] * 2 >= PER_LEVEL)
        return F.when(F.size(telling) > 0, F.try_element_at(telling, F.lit(-1))).otherwise(found[0])

    share = _let(_let(sizes, last_telling), lambda s: F.when(s["used"] > 0, s["equal"] / s["used"]).otherwise(0.0))
    same = F.col(f"{a}_plain").eqNullSafe(F.col(f"{b}_plain")) & (F.col(f"{a}_hashes") == F.col(f"{b}_hashes"))
    return F.when(same, 1.0).otherwise(share)


def next_ids(ids: DataFrame) -> DataFrame:
    """doc_id and next_id, the next smaller one, of different ids; the smallest is followed by the largest."""
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(ids.repartitionByRange(n, "doc_id").withColumn("range", F.spark_partition_id()), "imatch_ids")
    tops = sorted(ranged.groupBy("range").agg(F.max("doc_id").alias("top")).collect())  # a row per partition
    below = [(t["range"], tops[k - 1]["top"]) for k, t in enumerate(tops)]  # the lowest gets the highest
    below = spark.createDataFrame(below, f"range int, below {ids.schema['doc_id'].dataType.simpleString()}")
    inside = F.lead("doc_id").over(Window.partitionBy("range").orderBy(F.desc("doc_id")))
    return ranged.withColumn("inside", inside).join(below, "range").select("doc_id", F.coalesce("inside", "below").alias("next_id"), *[c for c in ids.columns if c != "doc_id"])


def neighbour_report(docs: DataFrame, least: float = LEAST_IDF, most: float = MOST_IDF) -> DataFrame:
    """Fingerprints of every text, of the text with its second half replaced from the next document, and likenesses."""
    words = lexicon(docs.select("text"), least, most)
    key = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(NO_ID)).cast("decimal(20,0)"))
    own = docs.select(key.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    ids = own.groupBy("doc_id").agg(F.max(half).alias("asked"), F.count(F.lit(1)).alias("rows"))
    wanted = written(next_ids(ids), "imatch_next")
    asked = wanted.select(F.col("doc_id").alias("to"), F.col("next_id").alias("doc_id"), "asked")
    own = with_signature(own, "text", words, "own")
    # both joins read the same columns of ``own`` by the same key, so its texts are signed and shuffled once
    heads = own.join(asked.hint("merge"), "doc_id").select(
        F.col("to").alias("doc_id"), F.substring("text", F.lit(1), F.col("asked")).alias("head"),
        F.col("own_hashes").alias("next_hashes"), F.col("own_plain").alias("next_plain"),
    )
    if not wanted.where("rows > 1").isEmpty():
        heads = heads.groupBy("doc_id").agg(F.min(F.struct("head", "next_hashes", "next_plain")).alias("h")).select("doc_id", "h.*")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("head", F.lit(1), half))
    both = with_signature(own.join(heads.hint("merge"), "doc_id").withColumn("edited_text", edited), "edited_text", words, "edited")
    return both.select(
        F.when(F.col("doc_id") >= -(1 << 63), F.col("doc_id").cast("long")).alias("doc_id"),
        F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        shown("own").alias("fingerprint"), shown("edited").alias("edited_fingerprint"),
        likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"),
    )
