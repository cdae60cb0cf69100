"""Comparing two independently made datasets.

The looked-up side is always reduced to one row per key first, with map-side combine, so a key with
very many rows meets the other side as a single row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import text
from muster.operators.ordering import same_key


def reconcile_slots(
    left: DataFrame, right: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Each left slot with the number of right rows at its key, and the values of the first of them.

    A slot is reconciled when ``matches`` is one, whether or not its attributes agree.
    """
    found = right.groupBy(*key).agg(
        F.count(F.lit(1)).alias("matches"), F.min_by(F.struct(*values), F.struct(*order)).alias("_right")
    )
    joined = left.join(found, list(key), "left")
    return joined.select(
        *left.columns,
        F.coalesce("matches", F.lit(0)).alias("matches"),
        *[F.when(F.col("matches") == 1, F.col("_right")[v]).alias(f"other_{v}") for v in values],
    )


def slot_status(matches: Column) -> Column:
    return F.when(matches == 1, "matched").otherwise("missingOrMultiple")


def label_fits(label: Column, whole: Column) -> Column:
    """Every word of a short label, taken as a join key, occurs in ``whole``, the key of a full name.

    Both come in NFKC form already.
    """
    words = F.filter(F.split(label, text.WHITESPACE + "+"), lambda t: t != "")
    return F.forall(words, lambda t: F.contains(whole, text.join_key(t, canonical=True)))


def attribute_mismatches(matched: DataFrame, subject: tuple[str, str], name: tuple[str, str]) -> DataFrame:
    """One row per attribute that differs on a reconciled slot: subject by key, label by containment."""
    keyed = matched.filter(F.col("matches") == 1).withColumns(
        {
            "_subject": text.join_key(F.col(subject[0])),
            "_other": text.join_key(F.col(subject[1])),
            "_label": text.nfkc(F.col(name[0])),
            "_name": text.join_key(F.col(name[1])),
        }
    )

    def row(kind: str, pair: tuple[str, str]) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.col(pair[0]).alias("source"), F.col(pair[1]).alias("candidate"))

    found = F.array_compact(
        F.array(
            F.when(F.col("_subject") != F.col("_other"), row("subjectMismatch", subject)),
            F.when(~label_fits(F.col("_label"), F.col("_name")), row("nameMismatch", name)),
        )
    )
    return keyed.withColumn("_found", F.explode(found)).select(*matched.columns, "_found.*")


def resolve_blocks(slots: DataFrame, block: Sequence[str], owner: str) -> DataFrame:
    """The owner of each block when the reconciled slots of the block name exactly one, else null."""
    named = slots.groupBy(*block).agg(F.min(owner).alias("_lo"), F.max(owner).alias("_hi"))
    return named.select(*block, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("resolved"))


def slot_set_diff(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys on one side only: one aggregate over both sides."""
    both = left.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    sides = both.groupBy(*key).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r")).filter(F.col("_l") != F.col("_r"))
    return sides.select(*key, F.when(F.col("_l") == 1, "left").otherwise("right").alias("side"))


def diff_records(source: DataFrame, candidate: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per differing field, null-safe; whole missing or unexpected records give one row each."""
    s = source.select(key, F.struct(*fields).alias("s"))
    c = candidate.select(key, F.struct(*fields).alias("c"))

    def row(kind: str, field: str, left: Column, right: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("type"), F.lit(field).alias("field"),
            left.cast("string").alias("source"), right.cast("string").alias("candidate"),
        )

    none = F.lit(None)
    per_field = [
        F.when(~F.col("s")[f].eqNullSafe(F.col("c")[f]), row("fieldMismatch", f, F.col("s")[f], F.col("c")[f])) for f in fields
    ]
    rows = (
        F.when(F.col("c").isNull(), F.array(row("missingRecord", "", none, none)))
        .when(F.col("s").isNull(), F.array(row("unexpectedRecord", "", none, none)))
        .otherwise(F.array_compact(F.array(*per_field)))
    )
    return s.join(c, key, "full_outer").select(key, F.explode(rows).alias("d")).select(key, "d.*")


def coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected keys that are missing, and keys that were not expected."""
    sides = slot_set_diff(expected, actual, [key])
    return sides.select(key, F.when(F.col("side") == "left", "missing").otherwise("unexpected").alias("status"))


def multiset_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side beyond those of the other, as often as they are in excess."""
    signed = left.withColumn("_n", F.lit(1)).unionByName(right.withColumn("_n", F.lit(-1)))
    excess = signed.groupBy(*left.columns).agg(F.sum("_n").alias("_n")).filter("_n != 0")
    times = F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("_n")))
    return excess.withColumn("side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("_time", times).drop("_n", "_time")


def metadata_mismatches(source: DataFrame, candidate: DataFrame, key: Sequence[str], meta: str) -> DataFrame:
    """Entries of a string map that differ between two sides, a missing key being a null value."""
    s = source.select(*key, F.explode(meta).alias("field", "source"))
    c = candidate.select(*key, F.explode(meta).alias("field", "candidate"))
    both = s.alias("l").join(c.alias("r"), same_key([*key, "field"], "l", "r"), "full_outer")
    return both.filter(~F.col("source").eqNullSafe(F.col("candidate"))).select(
        *[F.coalesce(F.col(f"l.{k}"), F.col(f"r.{k}")).alias(k) for k in [*key, "field"]], "source", "candidate"
    )


# A digest part is eight of the 64 hex digits, so sums of them stay exact in a decimal.
PARTS, _PART = 8, 8


def hash_part(h: Column, i: int) -> Column:
    """Part ``i`` of a hash in hex digits, as a number."""
    return F.conv(F.substring(h, 1 + i * _PART, _PART), 16, 10).cast("decimal(20,0)")


def digest_of(records: Column, sums: Sequence[Column]) -> Column:
    """The digest of a number of rows and the sums of the parts of their hashes."""
    return F.sha2(F.concat_ws("|", records.cast("string"), *[F.coalesce(s, F.lit(0)).cast("string") for s in sums]), 256)


def dataset_digest(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row (records, digest) for a whole dataset; equal for equal multisets of rows, whatever their order.

    Each row gives the SHA-256 of its canonical JSON; its parts, all 64 digits of it, are summed over all rows
    and the sums are hashed. Different multisets differ but for a chance collision. Sums combine map-side
    and need no order, so nothing is put in one place.
    """
    row = df.select(F.sha2(text.canonical_json(*fields), 256).alias("h"))
    sums = row.agg(F.count(F.lit(1)).alias("records"), *[F.sum(hash_part(F.col("h"), i)).alias(f"p{i}") for i in range(PARTS)])
    return sums.select("records", digest_of(F.col("records"), [F.col(f"p{i}") for i in range(PARTS)]).alias("digest"))


def summary(issues: Mapping[str, DataFrame]) -> DataFrame:
    """Number of issues per rule, with a row for every rule, also for those without issues."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n") for name, df in issues.items()
    ]
    merged = counted[0]
    for more in counted[1:]:
        merged = merged.unionByName(more)
    return merged
