"""Document fingerprints by winnowing, in DataFrame functions only.

The k-grams are runs of ``K_CHARS`` = 12 characters (code points), one starting at every character; each is hashed.
Minima over w = 16 consecutive hashes come from doubling (2, 4, 8, 16), linear in the text.  From each
window the smallest hash is selected, the rightmost of equal ones; hash and position share one long, the
position counted downwards below the hash, so that one minimum settles both.  Guarantee: two texts that
share ``K_CHARS + w - 1`` = 27 consecutive characters share a selected hash, at positions that both keep,
whether or not they have spaces.

A text with fewer than k characters gives one hash of the whole text, one with fewer than w k-grams the
minimum of them all, an empty or null text no hash.  Likeness of two fingerprints is the Jaccard
index of their selected hashes; of two empty ones 1, of an empty and another one 0.

``word_grams`` is a coarser form for callers that ask for it: units are words (in pieces of at most ``PIECE``
code points), k-grams 4 consecutive units.

The *next* document is the one with the next smaller id; after the smallest comes the largest.  Equal ids are
ordered by text; null ids come last.  Documents are dealt into ranges of about ``RANGE_ROWS`` ids, cut at quantiles
of the ids that occur, so sparse ids and outliers don't matter; each range is ordered by itself, and a copy of its first
document follows the last of the range above.

Winnowing is local, so a spliced text needs no second pass (``spliced``): where all windows lie within the half that a
text gave, the selection is the one made for that text; only the windows at the seam and at the end are made anew, from
at most ``4 * (k + w)`` characters each.

Null texts count as empty.  Texts of any length are taken whole.  Rows that share an id are documents of their own, one
after the other by text; equal rows have equal fingerprints.  An empty table gives an empty result.  Other columns of
the input are ignored, whatever their names.  All rows with null ids share one range, as do those of one id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

K_CHARS, K_DOUBLINGS, W_DOUBLINGS, PIECE = 12, 2, 4, 16
#: Rows of a range; the number of ranges beyond which they grow instead (their borders travel in the plan, 8 bytes each);
#: bytes of text that a task of the one shuffle is meant to hold; sampled ids per range (4 million in all at most).
RANGE_ROWS, RANGES, TASK_BYTES, PER_RANGE = 512, 262_144, 24 << 20, 16
#: Low bits of a selected value hold the position (counted downwards), the others the hash.
POSITION_BITS = 30


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doubled(values: Column, step: int, merge) -> Column:
    """merge(values[i], values[i + step]) for every i; the array itself if it isn't longer than ``step``."""
    return let(values, lambda v: F.when(F.size(v) > step, F.zip_with(F.slice(v, 1, F.size(v) - step), F.slice(v, step + 1, F.size(v)), merge)).otherwise(v))


def units(text: Column, piece: int = PIECE) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{piece}}}"), F.lit(0))


def char_runs(text: Column, k: int = K_CHARS) -> Column:
    """All runs of k consecutive characters; the whole text, if it is shorter, and none of an empty one."""
    found = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{k}}}))."), F.lit(1))
    return F.when(F.char_length(text) >= k, found).when(F.char_length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def char_keys(text: Column) -> Column:
    """Keys of the character k-grams, one from every character on."""
    return F.transform(char_runs(text), lambda g, i: key_of(F.xxhash64(g), i))


def word_grams(text: Column, k_doublings: int = K_DOUBLINGS, piece: int = PIECE) -> Column:
    """Hashes of 2**k_doublings consecutive units; of all of them, if they are fewer."""
    k = 1 << k_doublings

    def grams(h: Column) -> Column:
        out = h
        for d in range(k_doublings):
            out = doubled(out, 1 << d, lambda a, b: F.xxhash64(a, b))
        return F.when(F.size(h) >= k, out).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(h)

    return let(F.transform(units(text, piece), lambda u: F.xxhash64(u)), grams)


TOP = (1 << POSITION_BITS) - 1


def key_of(h: Column, position: Column) -> Column:
    """Hash above, position counted down from the end of the range below."""
    return h.bitwiseAND(F.lit(-1 - TOP)).bitwiseOR(F.lit(TOP) - position)


def word_keys(text: Column) -> Column:
    return F.transform(word_grams(text), key_of)


def halfway(step: int):
    """From minima over ``step`` elements to those over twice as many."""
    return lambda x: F.zip_with(x, F.slice(x, step + 1, F.size(x)), lambda a, b: F.least(a, b))


def selected(keys: Column, w_doublings: int = W_DOUBLINGS) -> Column:
    """The minimum of each window of 2**w_doublings keys, each once, in order; of all keys, if they are fewer."""
    w = 1 << w_doublings

    def select(v: Column) -> Column:
        out = v
        for d in range(w_doublings):  # the ends' shorter windows are cut off below; ``least`` passes over the nulls there
            out = let(out, halfway(1 << d))
        return F.when(F.size(v) >= w, F.array_distinct(F.slice(out, 1, F.size(v) - w + 1))).when(F.size(v) > 0, F.array(F.array_min(v))).otherwise(v)

    return let(keys, select)


def winnow(text: Column, w_doublings: int = W_DOUBLINGS, keys=char_keys) -> Column:
    """Selected values in the order of the text."""
    return selected(keys(F.coalesce(text, F.lit(""))), w_doublings)


def position_of(value: Column) -> Column:
    return F.lit(TOP) - value.bitwiseAND(F.lit(TOP))


def moved(values: Column, by: Column) -> Column:
    """The same values ``by`` places further on."""
    return F.transform(values, lambda v: v - by)


def spliced(text: Column, own: Column, cut: Column, after: Column, other: Column, more: Column) -> Column:
    """winnow(first ``cut`` characters of ``text`` + first ``more`` of ``after``), from the selections ``own`` and ``other`` of both.

    A window of w k-grams covers k + w - 1 characters.  Those within the first part select from positions up to
    ``cut - (k - 1)`` exclusive; a selected position at least w before that end is selected by a window that lies in it
    whole.  The same holds from the start of the second part (w places in) to the end.  The stretches between are read anew.
    """
    k, w = K_CHARS, 1 << W_DOUBLINGS
    edge = k + 2 * w
    whole = winnow(F.concat(F.substring(text, F.lit(1), cut), F.substring(after, F.lit(1), more)))

    def stretch(a: Column, b: Column) -> Column:
        """Selections of the windows between characters a (inclusive) and b of the spliced text, at their places there."""
        left = F.when(a < cut, F.substring(text, a + 1, F.least(b, cut) - a)).otherwise(F.lit(""))
        right = F.when(b > cut, F.substring(after, F.greatest(a - cut, F.lit(0)) + 1, b - F.greatest(a, cut))).otherwise(F.lit(""))
        return moved(winnow(F.concat(left, right)), a)

    first = F.filter(own, lambda v: position_of(v) <= cut - (k - 1) - w)
    second = F.filter(other, lambda v: (position_of(v) >= w - 1) & (position_of(v) <= more - (k - 1) - w))
    size = cut + more
    parts = F.concat(first, stretch(cut - edge, cut + edge), moved(second, cut), stretch(size - edge, size))
    return F.when((cut < 2 * edge) | (more < 2 * edge), whole).otherwise(F.array_distinct(parts))


def hashes(selected: Column) -> Column:
    """The distinct selected hashes."""
    return F.array_distinct(F.transform(selected, lambda v: F.shiftright(v, POSITION_BITS)))


def positions(selected: Column) -> Column:
    """Positions (from 0) of the selected k-grams."""
    return F.transform(selected, position_of)


def as_string(selected: Column) -> Column:
    """hash@position of every selected k-gram; hashes as nine hexadecimal digits."""
    mask = (1 << (64 - POSITION_BITS)) - 1
    return F.array_join(F.transform(selected, lambda v: F.concat(F.lower(F.lpad(F.hex(F.shiftright(v, POSITION_BITS).bitwiseAND(F.lit(mask))), 9, "0")), F.lit("@"), position_of(v).cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    return let(F.size(F.array_intersect(a, b)), lambda n: F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(n / (F.size(a) + F.size(b) - n)))


def borders(ids: DataFrame, ranges: int, known: int) -> list[int]:
    """The least id of each range but the first: quantiles of the ids with the smallest hashes, ``PER_RANGE`` for each range."""
    share = min(1.0, PER_RANGE * ranges / max(1, known))
    few = ids.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) < math.ceil(share * (1 << 40))))
    found = few.distinct().agg(F.sort_array(F.collect_list("doc_id")).alias("v")).select(F.filter("v", lambda _, i: F.pmod(i, F.lit(max(1, round(share * known / ranges)))) == 0).alias("v")).first()["v"]
    return found[1:]


def range_of(doc_id: Column, lows: list[int]) -> Column:
    """Number of borders at or below the id, by bisection; -1 for a null id."""
    if not lows:
        return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.lit(0))
    table = F.split(F.lit(",".join(map(str, lows))), ",").cast("array<bigint>")  # folded into one literal
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(lows).bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(lows)) & (F.get(table, at + s - 1) <= doc_id), at + s).otherwise(at))
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(found)


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, keys=char_keys) -> DataFrame:
    """doc_id, text, fp, and next_text, next_fp of the next document in descending order of ids."""
    base = shared.keyed_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n, size, known = base.agg(F.count("*"), F.sum(F.octet_length("text")), F.count("doc_id")).first()
    ranges = max(1, min(RANGES, -(-known // range_rows)))
    lows = borders(base.select("doc_id"), ranges, known) if ranges > 1 else []
    base = base.withColumn("range", range_of(F.col("doc_id"), lows))
    # The first document of a range follows the last of the range above; after the last of all comes the first of all.
    top, last = len(lows), -1 if n > known else 0
    above = F.when(F.col("range") == top, F.lit(last)).otherwise(F.col("range") + 1) if known else F.lit(-1)
    tops = base.groupBy("range").agg(F.max("doc_id").alias("top")).withColumnRenamed("range", "_range")  # at most RANGES + 1 rows
    ghosts = base.join(F.broadcast(tops), (F.col("range") == F.col("_range")) & F.col("doc_id").eqNullSafe(F.col("top")))
    ghosts = ghosts.groupBy("range").agg(F.min("text").alias("text")).select(F.lit(None).cast("long").alias("doc_id"), "text", above.alias("range"), F.lit(1).alias("ghost"))
    parts = max(8, -(-(size or 0) // TASK_BYTES))
    both = base.withColumn("ghost", F.lit(0)).unionByName(ghosts).repartition(parts, "range").withColumn("fp", winnow(F.col("text"), keys=keys))  # after the shuffle, which holds texts only
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return both.select("doc_id", "text", "fp", "ghost", F.lead("text").over(order).alias("next_text"), F.lead("fp").over(order).alias("next_fp")).where("ghost = 0").drop("ghost")


def fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS, keys=char_keys) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row."""
    rows = with_next(docs, range_rows, keys).withColumn("n_chars", F.char_length("text").cast("long"))
    rows = rows.withColumn("half", F.expr("cast(div(n_chars, 2) as int)")).withColumn("more", F.least("half", F.char_length("next_text"))).withColumn("cut", F.col("n_chars").cast("int") - F.col("half"))
    edited = F.expr("concat(left(text, cut), left(next_text, more))")
    efp = spliced(F.col("text"), F.col("fp"), F.col("cut"), F.col("next_text"), F.col("next_fp"), F.col("more")) if keys is char_keys else winnow(edited, keys=keys)
    rows = rows.select("doc_id", "n_chars", "fp", hashes(F.col("fp")).alias("h"), hashes(F.col("next_fp")).alias("next_h"), F.sha2(F.encode(edited, "UTF-8"), 256).alias("edited_sha256"), efp.alias("efp"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("fp")).alias("fingerprint"), as_string(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("h"), hashes(F.col("efp"))).alias("near_edited"), likeness(F.col("h"), F.col("next_h")).alias("near_next"))
