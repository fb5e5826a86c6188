"""Order MinHash document fingerprints, with DataFrame functions only.

A text is cut into words, its k-mers of words are numbered by occurrence, and for each of
``components`` orders of the numbered k-mers the ``per_component`` (two) smallest are taken, put
back in text order and hashed together.  The orders are rotations of one hash order
(pi_j(x) = h(x) - j * 2**64 / components, modulo 2**64): one sort serves them all, and short
texts never leave a component empty.  The estimate's deviation from that of independent orders is
measured in the tests: as large for long texts, larger where there are fewer k-mers than
components.  Because a component remembers the order of its k-mers,
it is sensitive to edit distance and not only to which k-mers occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_below, long_array, range_bucket, range_splitters

#: Low bits of a packed k-mer hold its position, high bits its hash; a string of 2 GB has no more words.
POSITION_BITS = 30
POSITION_MASK = (1 << POSITION_BITS) - 1
#: Words with more characters are cut into overlapping pieces.
LONG_WORD = 64
#: What separates words, besides the space.
WHITE_SPACE = "\t\n\x0b\x0c\r"


def _shift(x: Column) -> Column:
    return F.shiftright(x, POSITION_BITS)


def with_fingerprint(df: DataFrame, text_col: str, out_col: str, k: int = 3, components: int = 64) -> DataFrame:
    """Add ``out_col``: ``components`` groups of four hex digits; '' for a text without words.

    Null counts as empty.  Words are runs of characters other than white space; for a word of
    more than 64 all its runs of four characters stand, whatever the rest of the text.  A text with
    fewer than k words has one k-mer, the whole sequence.  Equal texts have equal fingerprints.
    Other columns pass through.
    """
    w, h, a, t, g = (f"_{x}_{out_col}" for x in "whatg")
    text = F.col(text_col)
    no_words, no_hashes = F.expr("cast(array() as array<string>)"), F.expr("cast(array() as array<bigint>)")
    words = F.split(F.translate(text, WHITE_SPACE, " " * len(WHITE_SPACE)), " ")
    df = df.withColumn(w, F.filter(words, lambda x: x != ""))
    # A script without spaces: overlapping pieces of such a word alone, whatever else the text has.
    pieces = lambda x: F.when(F.length(x) > LONG_WORD, F.regexp_extract_all(x, F.lit(r"(?s)(?=(.{4}))."), F.lit(1))).otherwise(F.array(x))
    long = F.exists(F.col(w), lambda x: F.length(x) > LONG_WORD)
    df = df.withColumn(w, F.when(long, F.flatten(F.transform(F.col(w), pieces))).otherwise(F.col(w)))
    short = (F.size(w) > 0) & (F.size(w) < k)
    df = df.withColumn(w, F.when(short, F.concat(w, F.array_repeat(F.lit(""), F.lit(k) - F.size(w)))).otherwise(F.coalesce(w, no_words)))

    mask = F.lit(~POSITION_MASK)

    def kmer(i):
        return F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)])

    def pack(x, i):
        return x.bitwiseAND(mask).bitwiseOR(i.cast("long").bitwiseAND(F.lit(POSITION_MASK)))

    kmers = F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), kmer)).otherwise(no_hashes)
    df = df.withColumn(h, kmers).drop(w)
    # Packed with their positions and sorted, equal k-mers are neighbours in text order.
    repeats = F.size(F.array_distinct(F.col(h))) < F.size(h)
    df = df.withColumn(g, repeats).withColumn(a, F.sort_array(F.transform(F.col(h), pack))).drop(h)
    run_starts = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda i: (i == 0) | (_shift(F.get(F.col(a), i)) != _shift(F.get(F.col(a), i - 1))))
    df = df.withColumn(g, F.when(F.col(g), run_starts))

    def numbered(start, r):
        end = F.coalesce(F.get(F.col(g), r + 1), F.size(a))
        run = F.slice(F.col(a), start + 1, end - start)
        return F.transform(run, lambda x, o: F.when(o == 0, x).otherwise(pack(F.xxhash64(_shift(x), o), x)))

    many = F.sort_array(F.flatten(F.transform(F.col(g), numbered)))
    df = df.withColumn(t, F.when(F.col(g).isNull(), F.col(a)).otherwise(many)).drop(a, g)
    bounds = [-(1 << 63) + j * ((1 << 64) // components) for j in range(components)]
    firsts = F.transform(long_array(bounds), lambda bound: count_below(F.col(t), F.size(t), bound, strict=True))
    df = df.withColumn(g, F.when(F.size(t) > 0, firsts))

    def tuple_hash(p):
        x, y = F.get(F.col(t), p % F.size(t)), F.get(F.col(t), (p + 1) % F.size(t))
        in_order = x.bitwiseAND(F.lit(POSITION_MASK)) <= y.bitwiseAND(F.lit(POSITION_MASK))
        both = F.xxhash64(_shift(F.when(in_order, x).otherwise(y)), _shift(F.when(in_order, y).otherwise(x)))
        return F.lpad(F.hex(both.bitwiseAND(F.lit(0xFFFF))), 4, "0")

    return df.withColumn(out_col, F.coalesce(F.lower(F.array_join(F.transform(F.col(g), tuple_hash), "")), F.lit(""))).drop(t, g)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components of two fingerprints; 1 for equal ones, 0 if just one is empty."""
    def equal(i):
        return F.substr(a, i, F.lit(4)) == F.substr(b, i, F.lit(4))

    shared = F.size(F.filter(F.sequence(F.lit(1), F.length(a), F.lit(4)), equal)) / (F.length(a) / 4)
    return F.when(a == b, F.lit(1.0)).when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(shared)


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_bucket: int = 500) -> DataFrame:
    """Fingerprint each text and its edited text, in which the last half (rounded down) of the
    code points is replaced by as many from the start of the next document by ascending id (the
    first after the last).

    Null text: empty.  Null ids come first; rows with the same id are ordered by text.  One document: it is its own next.  Empty
    input: no rows.  Further columns are ignored.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    docs = docs.withColumn("_key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    splitters = range_splitters(docs.select("_key"), "_key", rows_per_bucket)
    docs = docs.withColumn("_bucket", range_bucket(F.col("_key"), splitters))
    # Each bucket also gets the first row of the next one (the last bucket that of the first).
    heads = sorted((r["_bucket"], r["k"]) for r in docs.groupBy("_bucket").agg(F.min("_key").alias("k")).collect())
    head_key, previous = [], []
    if heads:
        at = {b: i for i, (b, _) in enumerate(heads)}
        for b in range(heads[-1][0] + 1):
            head_key.append(heads[at[b]][1] if b in at else 0)
            previous.append(heads[at[b] - 1][0] if b in at else 0)
    docs = with_fingerprint(docs, "_text", "fingerprint")
    homes = F.when(
        F.col("_key") == F.get(long_array(head_key), F.col("_bucket")),
        F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest")), F.struct(F.get(long_array(previous), F.col("_bucket")).cast("int").alias("b"), F.lit(1).alias("guest"))),
    ).otherwise(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest"))))
    rows = docs.select("doc_id", "_key", "_text", "fingerprint", F.explode(homes).alias("_h")).select("*", "_h.b", "_h.guest").drop("_h")
    w = Window.partitionBy("b").orderBy("guest", "_key", "_text")
    rows = rows.select("*", F.lead("_text").over(w).alias("_next"), F.lead("fingerprint").over(w).alias("_next_fp")).where("guest = 0")
    n = F.char_length("_text").cast("long")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn(
        "_edited", F.concat(F.substr("_text", F.lit(1), F.char_length("_text") - half), F.substr(F.coalesce("_next", F.lit("")), F.lit(1), half))
    )
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "_next_fp", "_edited")
    rows = with_fingerprint(rows, "_edited", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("_next_fp", F.lit(""))).alias("near_next"),
    )
