"""Document fingerprints by consistent weighted sampling, in DataFrame functions alone.

A text's terms are its pairs of consecutive words (split at white space), each
known by its 64-bit hash; a term's weight S is its count.  Weights are whole
numbers, so a term of weight S stands for the S places (term, 1) to (term, S),
and each of ``SAMPLES`` samples ranks a place by a 64-bit hash of term, number
and sample alone.  The place of least rank is the sample: every place is as
likely as any other, and two texts draw the same with a probability of their
generalised Jaccard similarity, sum of least weights over sum of greatest
weights, whatever the texts' lengths, so the share of equal samples estimates
it.  Only texts of billions of words would share hashes that their terms don't.

A place costs one hash and one minimum of a long for each sample, the whole
fingerprint is one hash aggregate, and there are as many places as words.
A sample keeps the lower 32 bits of the least rank; fingerprints and hashes are stored and shuffled as
bytes, one row per document.  Texts are dealt once, by doc_id; what a
neighbour needs of a text (its first characters) is dealt to that neighbour.

Defined results: a null text is an empty one; a text's last word, with
nothing after it, is a term too, so every text has terms; rows with equal
doc_id stay separate and follow each other in the order of their texts'
hashes; a null doc_id comes last; a table with one row is its own neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actlens.functions.order import with_position
from actlens.llm.common import stored, table

SAMPLES = 32

_NO_ID = -(1 << 63)


def fingerprints(texts: DataFrame, key: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``key`` and ``sample`` (array of long) of each row of ``texts``, where ``key`` tells rows apart.
    A frame that is dealt by a column of ``key`` is not dealt again."""
    words = F.split(F.col(text), r"\s+")
    # a word and the one after it; nothing follows the last
    pairs = texts.select(*key, F.explode(F.arrays_zip(words.alias("w"), F.slice(words, 2, F.size(words)).alias("v"))).alias("p"))
    weights = pairs.select(*key, F.xxhash64("p.w", "p.v").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("n"))
    places = weights.select(*key, "term", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy_no")).select(
        *key, F.xxhash64("term", "copy_no").alias("place"))
    taken = places.groupBy(*key).agg(
        *[F.min(F.xxhash64(F.col("place").bitwiseXOR(F.xxhash64(F.lit(k))))).alias(f"s{k}") for k in range(samples)])
    return taken.select(*key, F.array(*[F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(samples)]).alias("sample"))


def as_text(sample: str) -> Column:
    """A fingerprint as a string: eight hexadecimal digits for each sample."""
    return F.lower(F.array_join(F.transform(sample, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def packed(sample: str) -> Column:
    """A fingerprint as bytes, four for each sample."""
    return F.unhex(as_text(sample))


def likeness(a: str, b: str) -> Column:
    """The share of equal samples of two packed fingerprints."""
    n = F.length(a) / F.lit(4)
    one = lambda c, k: F.substring(F.col(c), k * 4 + 1, F.lit(4))
    return F.size(F.filter(F.sequence(F.lit(0), (n - 1).cast("int")), lambda k: one(a, k) == one(b, k))) / n


def _placed(docs: DataFrame) -> DataFrame:
    """Rows (id, copy, size, pos, and the same of the row before as prev_...; next_id, next_copy), without texts."""
    small = docs.select("id", F.xxhash64("text").alias("h"), F.length("text").alias("size"))
    small = small.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("h"))).drop("h")
    # descending ids; the smallest number stands for a missing one
    rows = stored(with_position(small, F.desc("id"), F.col("copy"), total_col="total"), "positions")
    names = ["id", "copy", "size"]
    before = rows.select((F.col("pos") % F.col("total") + 1).alias("pos"), *[F.col(c).alias(f"prev_{c}") for c in names])
    after = rows.select(((F.col("pos") - 2 + F.col("total")) % F.col("total") + 1).alias("pos"),
                        *[F.col(c).alias(f"next_{c}") for c in names[:2]])
    return stored(rows.join(before, "pos").join(after, "pos"), "neighbours")


def edited_texts(docs: DataFrame) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): id (doc_id or the smallest number), copy, text, edited, next_id,
    next_copy.  edited: the last floor(n/2) characters replaced by as many (or all) first ones of the next
    document, descending doc_id, after the last the first."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = _placed(base)
    own = base.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("text"))))
    # equal ids meet by id alone, so that the texts stay where they are dealt
    at = at.withColumnRenamed("id", "at_id").withColumnRenamed("copy", "at_copy")
    rows = own.join(at, (F.col("id") == F.col("at_id")) & (F.col("copy") - F.col("at_copy") == 0))
    heads = rows.select(F.col("prev_id").alias("to_id"), F.col("prev_copy").alias("to_copy"),
                        F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_size") / 2).cast("int")).alias("head"))
    both = rows.join(heads, (F.col("id") == F.col("to_id")) & (F.col("copy") - F.col("to_copy") == 0))
    kept = F.substring(F.col("text"), F.lit(1), (F.col("size") - F.floor(F.col("size") / 2)).cast("int"))
    return both.select("id", "copy", "size", "next_id", "next_copy", "text", F.concat(kept, "head").alias("edited"))


def _compared(docs: DataFrame) -> DataFrame:
    """One stored row per document: id, copy, size, next_id, next_copy, sha (bytes), sample, edited_sample (packed)."""
    texts = edited_texts(docs)
    which = F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col("text")),
                              F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")))).alias("x")
    samples = fingerprints(texts.select("id", "copy", which).select("id", "copy", "x.edit", "x.text"), ["id", "copy", "edit"])
    # both samples of a document lie where its text was dealt
    pairs = samples.select("id", "copy", "edit", packed("sample").alias("sample")).groupBy("id", "copy").agg(
        *[F.max(F.when(F.col("edit") == k, F.col("sample"))).alias(c) for k, c in enumerate(["sample", "edited_sample"])])
    facts = texts.select(F.col("id").alias("f_id"), F.col("copy").alias("f_copy"), "size", "next_id", "next_copy",
                         F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha"))
    return stored(pairs.join(facts, (F.col("id") == F.col("f_id")) & (F.col("copy") - F.col("f_copy") == 0)).drop("f_id", "f_copy"),
                  "fingerprints")


def compared(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    own = _compared(docs)
    after = own.select(F.col("id").alias("next_id"), F.col("copy").alias("next_copy"), F.col("sample").alias("next_sample"))
    hexed = lambda c: F.lower(F.hex(c))
    return own.join(after, ["next_id", "next_copy"]).select(
        F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), F.col("size").cast("long").alias("n_chars"), hexed("sha").alias("edited_sha256"),
        hexed("sample").alias("fingerprint"), hexed("edited_sample").alias("edited_fingerprint"),
        likeness("sample", "edited_sample").alias("near_edited"),
        likeness("sample", "next_sample").alias("near_next"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of its edited text, compared."""
    return compared(table(spark, sf_dir, "documents"))
