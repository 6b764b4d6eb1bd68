"""Document fingerprints: a homomorphic multiset hash of the paragraphs of a text.

A paragraph's vector has 16 wide components, hashed from the whole paragraph, and `LANES` narrow
ones, which its pieces of `PIECE` code points (counted from the paragraph's start) hash to 0 or 1.
A fingerprint is the sum of these vectors modulo 2**32 for each component, so it does not depend
on the order of paragraphs, and adding or taking away a paragraph's vector inserts or deletes
that paragraph (`combine`). Equal multisets of paragraphs have equal fingerprints, others differ
but for accidents of a 512-bit sum.

The narrow components also tell how alike two texts are: read as sums of +1 and -1, their squared
distance estimates how many pieces differ, and `likeness` is 1 - |a-b|^2 / (|a|^2 + |b|^2), cut to
[0, 1]: about the share of pieces that both have.

Everything is DataFrame functions. `edited` takes a document's successor in the order of
descending doc_id from ranges of ids: one shuffle of the texts by range, in which the first row of
the next range is repeated, and all windows and sums run inside the ranges.

Defined cases: a null text is an empty one, which is one empty paragraph; rows that repeat a
doc_id follow each other in the order of their texts' hashes, then their texts; null doc_ids come last; with a single row
the successor is the row itself; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 128  # narrow components, two to a sum
WIDE = 16
PIECE = 24

#: Most ranges of ids; beyond that many times `rows` a range has more rows, which its sort may spill.
_MOST = 100_000

_LOW = 0xFFFFFFFF
_PAIR = 0x0000000100000001


def _hash(text: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(text))


def sums(rows: DataFrame, *by: str, text: str = "text") -> DataFrame:
    """`by` columns and `fp`, the fingerprint's sums, of each group's texts. Texts are cut into
    paragraphs and pieces; the rows of a group are one document."""
    # a paragraph is what stands before a line end or the end of the text
    paragraphs = rows.select(*by, F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_paragraph"))
    pieces = paragraphs.select(*by, "_paragraph", F.posexplode_outer(F.regexp_extract_all("_paragraph", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("_at", "_piece"))
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    some = F.col("_piece").isNotNull()
    # each hash is worked out once for each piece, and its bits are dealt to the sums
    hashed = pieces.select(*by, first.alias("_first"), some.alias("_some"), *[F.when(first, _hash("_paragraph", 100 + k)).alias(f"_w{k}") for k in range(WIDE // 2)], *[F.when(some, _hash("_piece", k)).alias(f"_n{k}") for k in range(LANES // 64)])
    wide = [x for k in range(WIDE // 2) for x in (F.col(f"_w{k}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"_w{k}", 32))]
    narrow = [F.shiftrightunsigned(f"_n{k}", b).bitwiseAND(F.lit(_PAIR)) for k in range(LANES // 64) for b in range(32)]
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    names = [f"_s{k}" for k in range(len(wide) + len(narrow))]
    added = hashed.groupBy(*by).agg(F.sum(F.col("_some").cast("long")).alias("_n"), *[total(c).alias(k) for c, k in zip([*wide, *narrow], names, strict=True)])
    parts = [F.col("_n"), *[F.col(k).bitwiseAND(F.lit(_LOW)) for k in names[:WIDE]], *[x for k in names[WIDE:] for x in (F.col(k).bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(k, 32))]]
    return added.select(*by, F.array(*parts).alias("fp"))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of all paragraphs of both (sign 1), or of a's without b's (sign -1)."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))


def text_of(fp: Column) -> Column:
    """A fingerprint as hexadecimal text, 8 digits a component."""
    return F.array_join(F.transform(fp, lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(_LOW)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1; 1 if they are equal."""
    start, n = WIDE + 2, LANES
    signed = lambda fp: F.transform(F.slice(fp, start, n), lambda x: 2.0 * x - F.element_at(fp, 1))
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    apart = square(F.zip_with(signed(a), signed(b), lambda x, y: x - y))
    both = square(signed(a)) + square(signed(b))
    return F.when(a == b, 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - apart / both))


def _bounds(docs: DataFrame, rows: int) -> tuple[list[int], bool]:
    """(existing ids that close ranges of about `rows` rows, increasing, the last being the largest; whether there are null ids).

    At most `_MOST` + 1 ids, whatever the table's size."""
    n, known, top = docs.agg(F.count("*"), F.count("doc_id"), F.max("doc_id")).first()
    parts = max(1, min(_MOST, -(-known // rows)))
    shares = F.split(F.lit(",".join(str(k / parts) for k in range(1, parts + 1))), ",").cast("array<double>")
    some = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, known // (100 * parts)))) == 0  # about a hundred ids for each range place its bound
    found = docs.where(some).select(F.percentile_approx("doc_id", shares, 10 * parts)).first()[0] if known else None
    return sorted({*(found or ()), *([top] if top is not None else ())}), n > known


def _longs(values) -> Column:
    """Whole numbers as one literal array, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def _crowded(docs: DataFrame, rows: int) -> dict[int | None, int]:
    """Rows of each id, or of none, that has more than two ranges should have; `_MOST` ids at most."""
    n = docs.count()
    found = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > max(2 * rows, n // _MOST))
    return {r["doc_id"]: r["n"] for r in found.collect()}


def _ranges(docs: DataFrame, rows: int) -> DataFrame:
    """`docs` (doc_id, text) with `range` (by descending id; the last holds null ids) and `ghost`:
    true for a copy of a range's first row at the end of the range before it, in a circle.

    The rows of an id that has very many, or of none, make ranges of their own, by the hash of their texts."""
    bounds, nulls = _bounds(docs.select("doc_id"), rows)
    crowded = _crowded(docs.select("doc_id"), rows)
    bounds = sorted({*bounds, *(c for c in crowded if c is not None)})
    count = len(bounds)
    # from the largest id on: ranges of the bound's own rows, if it is crowded, and one of the ids below it
    own = [-(-crowded.get(b, 0) // rows) for b in bounds]
    first, upto = [0] * count, 0
    for a in range(count - 1, -1, -1):
        first[a], upto = upto, upto + own[a] + 1
    bare = -(-crowded.get(None, 0) // rows)  # ranges of rows without an id, if they are crowded
    spot = F.xxhash64("text")
    share = spot.cast("double") / 2.0**64 + 0.5
    if count:
        closing, steps = _longs(bounds), F.array(*[F.lit(1 << k) for k in range(count.bit_length() - 1, -1, -1)])
        below = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= count) & (F.try_element_at(closing, at + step) < F.col("doc_id")), at + step).otherwise(at))
        at_bound = F.try_element_at(closing, F.col("_at") + 1) == F.col("doc_id")
    else:
        below, at_bound = F.lit(0), F.lit(False)
    placed = docs.withColumn("_at", below)
    inside = F.try_element_at(_longs(first or [0]), F.col("_at") + 1)
    if crowded:
        parts = F.try_element_at(_longs(own or [0]), F.col("_at") + 1)
        inside = inside + F.when(at_bound & (parts > 0), F.floor(share * parts)).otherwise(parts)
    last = upto + max(bare, int(nulls)) - 1
    number = F.when(F.col("doc_id").isNull(), F.lit(upto) + F.floor(share * F.lit(max(1, bare)))).otherwise(inside)
    placed = placed.withColumn("range", number.cast("int"))
    head = F.col("doc_id").isNull() | at_bound
    if crowded:
        # where ranges begin is only known of bounds: ask for the others, and leave out those without rows
        several = F.when(F.col("doc_id").isNull(), F.lit(bare > 0)).otherwise(parts > 0)
        starts = placed.where(several).groupBy("range").agg(F.max("doc_id").alias("id"), F.min(spot).alias("spot")).collect()
        starts = {r["range"]: r for r in starts}
        plain = {f for f, k in zip(first, own, strict=True) if not k} | ({upto} if nulls and not bare else set())
        left = sorted(plain | starts.keys())
        renamed, kind, begin = [0] * (last + 1), [0] * (last + 1), [0] * (last + 1)
        ends = {f + k for f, k in zip(first, own, strict=True) if k}
        for k, r in enumerate(left):
            renamed[r] = k
            if r in starts:
                kind[r], begin[r] = (2, starts[r]["id"]) if r in ends else (1, starts[r]["spot"])
        here = F.col("range") + 1
        what, begins = F.try_element_at(_longs(kind), here), F.try_element_at(_longs(begin), here)
        head = F.when(what == 1, begins == spot).when(what == 2, begins == F.col("doc_id")).otherwise(head)
        placed = placed.withColumn("_head", head).withColumn("range", F.try_element_at(_longs(renamed), here).cast("int"))
        last = len(left) - 1
    else:
        placed = placed.withColumn("_head", head)
    last = max(0, last)
    before = F.pmod(F.col("range") + last, F.lit(last + 1)).cast("int")
    kept = F.struct(F.col("range").alias("range"), F.lit(False).alias("ghost"))
    copies = F.when(F.col("_head"), F.array(kept, F.struct(before.alias("range"), F.lit(True).alias("ghost")))).otherwise(F.array(kept))
    return placed.select("doc_id", "text", F.explode(copies).alias("_r")).select("doc_id", "text", "_r.range", "_r.ghost")


def edited(docs: DataFrame, rows: int = 2000) -> DataFrame:
    """Of every row: doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp (sums), near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first as many of
    the next text by descending doc_id. `rows`: about so many rows make a range."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    inside = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    placed = _ranges(docs, rows).withColumn("place", F.row_number().over(inside)).withColumn("_next", F.lead("text").over(inside))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("_next"), F.lit(1), half))
    made = placed.select("range", "place", "ghost", "doc_id", "text", n.cast("long").alias("n_chars"), changed.alias("_edited"))
    kinds = F.when(F.col("ghost"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("_edited").alias("text"))))
    digest = F.when(~F.col("ghost"), F.sha2(F.col("_edited").cast("binary"), 256)).alias("edited_sha256")
    keys = ["range", "place", "ghost", "doc_id", "n_chars", "edited_sha256"]
    both = made.select(*keys[:-1], digest, F.explode(kinds).alias("_k")).select(*keys, "_k.kind", "_k.text")
    found = sums(both, *keys, "kind")  # grouped by range and more: no further shuffle
    along = Window.partitionBy("range").orderBy("place", "kind")
    found = found.withColumn("edited_fp", F.lead("fp", 1).over(along)).withColumn("next_fp", F.lead("fp", 2).over(along)).where((F.col("kind") == 0) & ~F.col("ghost"))
    return found.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp", likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
