"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each five-word shingle is hashed once; the upper bits of its hash name one of ``BINS`` bins, which keeps its
smallest hash. Empty bins are filled by optimal densification: each probes the bins in an order of its own
until it meets one that was filled by a shingle. The low ``BITS`` bits of each bin are stored, packed as bytes and shown as hex.
Likeness is the share of equal stored values p, corrected for chance: (p - c) / (1 - c) with c = 2^-BITS, at
least 0.

Words are runs of anything but ASCII white space; fewer than five words are one shingle. Null texts count as
empty; texts without words have the fingerprint of zeros, like one another and unlike any other text. Equal
texts have equal fingerprints. Repeated rows are ordered by id, then text; null ids come first. The only row
of a table is followed by itself. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

WORDS, BINS, BITS = 5, 256, 8
#: Rows of a stretch of neighbouring ids on average, and the most stretches, whose bounds are broadcast.
STRETCH, STRETCHES = 48, 65_536
_SHIFT = 64 - BINS.bit_length() + 1  # the bin is in the upper bits
_LOW = (1 << _SHIFT) - 1
#: Probes of an empty bin that are tried one by one, before all are.
_PROBES = 16


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def shingles(words: Column, n: int = WORDS) -> Column:
    """XXH64 of the hashes of each ``n`` successive words, or of all where there are fewer; none without words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return let(
        hashed,
        lambda h: F.when(F.size(h) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(n)))))
        .when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " "))))
        .otherwise(F.array().cast("array<long>")),
    )


def bins(hashes: Column) -> Column:
    """The smallest hash of each bin, in order; a bin that no shingle fills has the largest value it could."""
    ends = F.array(*(_long((b << _SHIFT) | _LOW) for b in range(BINS)))
    return let(
        F.sort_array(F.concat(hashes, ends)),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, _SHIFT) != F.shiftrightunsigned(F.get(s, i - 1), _SHIFT))),
    )


def densified(binned: Column) -> Column:
    """Fill the empty bins. The t-th probe of bin b is b's own offset plus t of its own odd steps, modulo the
    number of bins, a power of two: so each order visits all bins. Only what a bin holds is kept, not the bin."""
    filled = F.transform(binned, lambda x: F.nullif(x.bitwiseAND(_long(_LOW)), _long(_LOW)))

    def probed(d: Column, b: Column) -> Column:
        own = F.struct(F.pmod(F.xxhash64(b, F.lit(1)), F.lit(BINS)).alias("o"), (F.pmod(F.xxhash64(b, F.lit(2)), F.lit(BINS // 2)) * 2 + 1).alias("s"))
        at = lambda p, t: F.get(d, F.pmod(p["o"] + p["s"] * t, F.lit(BINS)).cast("int"))
        rest = lambda p: F.element_at(F.array_compact(F.transform(F.sequence(F.lit(_PROBES), F.lit(BINS - 1)), lambda t: at(p, t))), 1)
        return let(own, lambda p: F.coalesce(*(at(p, F.lit(t)) for t in range(_PROBES)), rest(p)))

    return let(filled, lambda d: F.transform(d, lambda x, b: F.coalesce(x, probed(d, b))))


def sketch(text: Column) -> Column:
    """The low bits of each bin less 128, as bytes; empty for a text without words."""
    low = lambda x: (x.bitwiseAND(F.lit((1 << BITS) - 1)) - 128).cast("tinyint")
    return let(shingles(words_of(text)), lambda h: F.when(F.size(h) > 0, F.transform(densified(bins(h)), low)).otherwise(F.array().cast("array<tinyint>")))


def packed(sketched: Column) -> Column:
    """A sketch as a hex string; zeros where it is empty."""
    digits = F.array(*(F.lit(f"{x:02x}") for x in range(1 << BITS)))
    return F.when(F.size(sketched) == 0, "0" * (BINS * BITS // 4)).otherwise(let(digits, lambda d: F.array_join(F.transform(sketched, lambda x: F.get(d, x.cast("int") + 128)), "")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles of two sketches, corrected for values that agree by chance."""
    same, chance = F.size(F.filter(a, lambda x, i: x == F.get(b, i))), 2.0**-BITS
    return F.when(a == b, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest((same / BINS - chance) / (1 - chance), F.lit(0.0)))


def stretches(docs: DataFrame) -> list[int]:
    """Ids at which stretches of neighbouring ids begin, the smallest first: at most ``STRETCHES``, whatever the
    size of the table. They are ids of the table itself. Nulls are in the first stretch."""
    n = docs.count()
    if not n:
        return []
    k = min(STRETCHES, -(-n // STRETCH))
    found = docs.agg(F.min("doc_id"), F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], 4 * k)).first()
    return sorted({found[0], *found[1]} - {None}) if found[0] is not None else []


def with_next(docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``doc_id, text`` and ``columns`` of each row of ``docs``, and those of the row with the next id as
    ``next_...``; the last row is followed by the first.

    Rows are dealt by stretches of ids, and the first row of a stretch goes to the stretch before as well, so
    neighbours meet in one window without ordering the whole table in one task.
    """
    starts = stretches(docs)
    wide = 1 + int(len(starts) ** 0.5)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if starts:
        blocks = [starts[i : i + wide] for i in range(0, len(starts), wide)]
        heads = F.lit([b[0] for b in blocks])
        fine = F.lit(blocks)
        at = lambda i: F.element_at(fine, i)
        block = F.greatest(F.size(F.filter(heads, lambda h: h <= F.col("doc_id"))), F.lit(1))
        place = let(block, lambda i: F.struct(((i - 1) * wide + F.greatest(F.size(F.filter(at(i), lambda h: h <= F.col("doc_id"))), F.lit(1))).alias("no"), at(i).alias("ids")))
        home = F.when(F.col("doc_id").isNull(), F.struct(F.lit(1).alias("no"), F.lit(False).alias("first"))).otherwise(
            let(place, lambda p: F.struct(p["no"].alias("no"), (F.element_at(p["ids"], p["no"] - F.floor((p["no"] - 1) / wide).cast("int") * wide) == F.col("doc_id")).alias("first"))))
    else:
        home = F.struct(F.lit(1).alias("no"), F.lit(True).alias("first"))
    # With null ids the first row of all is one of them; every null goes to the last stretch as well.
    last = max(1, len(starts))
    before = F.when(F.col("home.no") == 1, F.lit(last)).otherwise(F.col("home.no") - 1)
    copies = F.when(F.col("home.first") | F.col("doc_id").isNull(), F.array(F.struct(F.col("home.no").alias("no"), F.lit(False).alias("ghost")), F.struct(before.alias("no"), F.lit(True).alias("ghost")))).otherwise(F.array(F.struct(F.col("home.no").alias("no"), F.lit(False).alias("ghost"))))
    dealt = rows.withColumn("home", home).select("doc_id", "text", F.explode(copies).alias("at")).select("doc_id", "text", "at.*").repartition("no")
    dealt = dealt.select("*", *(c.alias(k) for k, c in columns.items()))
    order = Window.partitionBy("no").orderBy("ghost", "doc_id", "text")
    ahead = [F.lead(c).over(order).alias(f"next_{c}") for c in ("text", *columns)]
    return dealt.select("doc_id", "text", *columns, *ahead, "ghost").where("NOT ghost").drop("ghost")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text, and compare each with both its edit and its successor."""
    pairs = with_next(table(spark, sf_dir, "documents"), {"sketch": sketch(F.col("text"))})
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next_text, length(text) div 2)"))
    done = pairs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "sketch", "next_sketch")
    done = done.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited")).alias("edited_sketch"), "next_sketch")
    return done.select(
        "doc_id", "n_chars", "edited_sha256", packed(F.col("sketch")).alias("fingerprint"), packed(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
