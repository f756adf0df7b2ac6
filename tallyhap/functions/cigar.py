"""CIGAR arithmetic as column expressions.

A block is a run of aligned bases: struct(s, e, q) covers reference positions
[s, e) with query offset q (from 0). M, = and X align, I and S only consume the
query, D and N only the reference, H and P neither.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = r"(\d+)([MIDNSHP=X])"
_BLOCKS = "array<struct<s:bigint,e:bigint,q:bigint>>"


def cigar_blocks(cigar: Column, pos: Column) -> Column:
    """Aligned blocks of a read that starts at pos; empty without a CIGAR."""
    lengths = F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit(_OPS), F.lit(2))
    steps = F.zip_with(lengths, ops, lambda n, o: F.struct(n.cast("long").alias("n"), o.alias("o")))
    start = F.struct(pos.cast("long").alias("r"), F.lit(0).cast("long").alias("q"), F.array().cast(_BLOCKS).alias("b"))

    def step(acc: Column, x: Column) -> Column:
        aligned = x["o"].isin("M", "=", "X")
        r = acc["r"] + F.when(aligned | x["o"].isin("D", "N"), x["n"]).otherwise(0)
        q = acc["q"] + F.when(aligned | x["o"].isin("I", "S"), x["n"]).otherwise(0)
        block = F.struct(acc["r"].alias("s"), (acc["r"] + x["n"]).alias("e"), acc["q"].alias("q"))
        return F.struct(r.alias("r"), q.alias("q"), F.when(aligned & (x["n"] > 0), F.concat(acc["b"], F.array(block))).otherwise(acc["b"]).alias("b"))

    return F.coalesce(F.aggregate(steps, start, step, lambda acc: acc["b"]), F.array().cast(_BLOCKS))


def ref_end(cigar: Column, pos: Column) -> Column:
    """End (exclusive) of the span on the reference."""
    lengths = F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return pos + F.coalesce(F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n.cast("long")), F.lit(0).cast("long"))


def aligned_length(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + b["e"] - b["s"])


def aligned_place(blocks: Column, k: Column) -> Column:
    """The reference position of the k-th aligned base, from 0."""
    start = F.struct(k.cast("long").alias("left"), F.lit(None).cast("long").alias("at"))

    def step(acc: Column, b: Column) -> Column:
        here = acc["at"].isNull() & (acc["left"] < b["e"] - b["s"])
        return F.struct((acc["left"] - (b["e"] - b["s"])).alias("left"), F.when(here, b["s"] + acc["left"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(blocks, start, step, lambda acc: acc["at"])


def included_length(blocks: Column, start: Column, end_excl: Column) -> Column:
    """Aligned positions inside [start, end_excl)."""
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.greatest(F.lit(0), F.least(b["e"], end_excl) - F.greatest(b["s"], start)))


def included_fraction(blocks: Column, start: Column, end_excl: Column) -> Column:
    n = aligned_length(blocks)
    return F.when(n > 0, included_length(blocks, start, end_excl) / n)


def query_bases(blocks: Column, seq: Column, full_length: Column | None = None) -> Column:
    """Aligned query bases in order; with full_length (the read's length), one
    entry per query base with null where it is not aligned."""
    bases = F.flatten(F.transform(blocks, lambda b: F.transform(F.sequence(b["q"], b["q"] + b["e"] - b["s"] - 1), lambda k: F.substr(seq, (k + 1).cast("int"), F.lit(1)))))
    if full_length is None:
        return bases
    inside = lambda k: F.exists(blocks, lambda b: (k >= b["q"]) & (k < b["q"] + b["e"] - b["s"]))
    every = F.transform(F.sequence(F.lit(0).cast("long"), full_length.cast("long") - 1), lambda k: F.when(inside(k), F.substr(seq, (k + 1).cast("int"), F.lit(1))))
    return F.when(full_length > 0, every).otherwise(F.array().cast("array<string>"))


def query_qualities(blocks: Column, qual: Column, full_length: Column | None = None) -> Column:
    """Like query_bases, over Phred+33 characters, as integers."""
    return F.transform(query_bases(blocks, qual, full_length), lambda c: F.ascii(c) - 33)


def _character_at(blocks: Column, text: Column, pos: Column) -> Column:
    hit = F.filter(blocks, lambda b: (pos >= b["s"]) & (pos < b["e"]))
    at = F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["q"] + pos - F.get(hit, F.lit(0))["s"] + 1)
    return F.substr(text, at.cast("int"), F.lit(1))


def base_at(blocks: Column, seq: Column, pos: Column) -> Column:
    """The upper-case base aligned to a reference position; null in an intron,
    a deletion or outside."""
    return F.upper(_character_at(blocks, seq, pos))


def quality_at(blocks: Column, qual: Column, pos: Column) -> Column:
    return F.ascii(_character_at(blocks, qual, pos)) - 33


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length of two half-open ranges."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))
