"""Members resolved to points by a cascade of address sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tractloom.fixed_values import RAW_MEMBER_COLUMNS, RETRY_SUFFIXES
from tractloom.functions.text import normalised_address, postal_address
from tractloom.operators.projection import fill_text, quoted
from tractloom.operators.relate import first_per_key, spread_left_join
from tractloom.sources.sinks import append_csv

MEMBER_COLUMNS = ["uid", "name", "pronouns", "phone", "email", "address"]


class UnresolvedAddresses(RuntimeError):
    """Some members have an address that no source could place."""

    def __init__(self, count: int, where: str):
        super().__init__(f"{count} addresses need coordinates; fill them in at {where} and run again")
        self.count = count
        self.where = where


def shape_members(records: DataFrame) -> DataFrame:
    """Named members with one address text, from the raw member table."""
    *own, street, postcode = [F.col(quoted(c)) for c in RAW_MEMBER_COLUMNS]
    named = [column.alias(name) for column, name in zip(own, MEMBER_COLUMNS, strict=False)]
    shaped = records.select(*named, postal_address(street, postcode).alias("address"))
    return shaped.filter(F.col("name").isNotNull())


def first_overrides(overrides: DataFrame) -> DataFrame:
    """The first line per member, also when its coordinates are blank."""
    lines = overrides.select("line", "uid", "latitude", "longitude")
    return first_per_key(lines, "uid", "line").drop("line")


def address_book(reference: DataFrame, suffixes: Sequence[str] = RETRY_SUFFIXES) -> DataFrame:
    """The best reference entry for each address, over all retries at once.

    Retry ``n`` asks for the address followed by ``suffixes[n]``. Instead of
    asking repeatedly, entries ending with a suffix are also filed under the
    text before it, and the earliest retry that has coordinates wins. One
    lookup by address then answers the whole cascade.
    """
    filings = []
    for attempt, suffix in enumerate(suffixes, start=1):
        stem = F.expr(f"left(q, length(q) - {len(suffix)})") if suffix else F.col("q")
        filing = F.struct(stem.alias("address"), F.lit(attempt).alias("attempt"))
        filings.append(F.when(F.col("q").endswith(suffix), filing))
    entries = reference.filter(F.col("latitude").isNotNull()).select(
        F.explode(F.array_compact(F.array(*filings))).alias("filing"),
        "latitude",
        "longitude",
        normalised_address(F.col("house_number"), F.col("street"), F.col("zip")).alias("clean_address"),
    )
    best = F.min(F.struct("filing.attempt", "latitude", "longitude", "clean_address"))
    return entries.groupBy("filing.address").agg(best.alias("found"))


def geocode_pass(rows: DataFrame, reference: DataFrame, suffix: str = "") -> DataFrame:
    """One attempt on its own: the rows that ``address + suffix`` places."""
    found = spread_left_join(rows, address_book(reference, [suffix]), "address", by="uid")
    return found.filter(F.col("found").isNotNull()).select(
        *rows.columns, "found.clean_address", "found.latitude", "found.longitude"
    )


@dataclass(frozen=True)
class Cascade:
    """Where every named member ended up.

    Persist ``placed`` before using several of the views below.
    ``outcome`` is one of ``override``, ``blank override``, ``no address``,
    ``attempt <n>`` and ``unresolved``; one row per member.
    """

    placed: DataFrame

    @property
    def resolved(self) -> DataFrame:
        """Members with coordinates, addresses normalised, empty text as ``-``."""
        located = self.placed.filter(F.col("latitude").isNotNull())
        address = F.coalesce("clean_address", "address")
        return fill_text(
            located.withColumn("address", address).select(*MEMBER_COLUMNS, "latitude", "longitude")
        )

    @property
    def work_list(self) -> DataFrame:
        """Members someone has to place by hand."""
        return self.placed.filter(F.col("outcome") == "unresolved").select("uid", "address")

    def outcomes(self) -> DataFrame:
        return self.placed.groupBy("outcome").agg(F.count("*").alias("n_members"))


def resolve_cascade(
    members: DataFrame,
    overrides: DataFrame,
    reference: DataFrame,
    suffixes: Sequence[str] = RETRY_SUFFIXES,
    spread: int = 4,
) -> Cascade:
    """Overrides first, then the address as given, then each retry.

    ``uid`` identifies a member. An override replaces any lookup, even when
    its coordinates are blank, and needs no address.
    """
    fixed = first_overrides(overrides).select(
        "uid",
        F.lit(True).alias("overridden"),
        F.col("latitude").alias("fixed_latitude"),
        F.col("longitude").alias("fixed_longitude"),
    )
    known = spread_left_join(
        members.withColumnRenamed("address", "own_address"), fixed, "uid", "own_address", spread
    ).withColumn("overridden", F.coalesce("overridden", F.lit(False)))
    # Rows that need no lookup get a text no address has, one per member: NULL
    # or a shared text would send them all to the same task.
    searched = F.coalesce(
        F.when(~F.col("overridden"), F.col("own_address")),
        F.concat(F.lit("\u0000"), F.col("uid")),
    )
    rows = known.withColumn("address", searched)
    found = spread_left_join(rows, address_book(reference, suffixes), "address", "uid", spread)
    outcome = (
        F.when(F.col("overridden") & F.col("fixed_latitude").isNotNull(), F.lit("override"))
        .when(F.col("overridden"), F.lit("blank override"))
        .when(F.col("own_address").isNull(), F.lit("no address"))
        .when(F.col("found").isNotNull(), F.concat(F.lit("attempt "), F.col("found.attempt")))
        .otherwise(F.lit("unresolved"))
    )
    return Cascade(
        found.select(
            *[c for c in MEMBER_COLUMNS if c != "address"],
            F.col("own_address").alias("address"),
            F.col("found.clean_address").alias("clean_address"),
            F.coalesce("fixed_latitude", "found.latitude").alias("latitude"),
            F.coalesce("fixed_longitude", "found.longitude").alias("longitude"),
            outcome.alias("outcome"),
        )
    )


def work_sheet(work_list: DataFrame) -> DataFrame:
    """The work list with blank coordinates to fill in."""
    return work_list.withColumns({"latitude": F.lit(""), "longitude": F.lit("")})


def require_resolved(work_list: DataFrame, path: str) -> None:
    """Append the work list to the override file and stop if it has rows."""
    work_list = work_list.persist()
    try:
        count = work_list.count()
        if count:
            append_csv(work_sheet(work_list), path)
            raise UnresolvedAddresses(count, path)
    finally:
        work_list.unpersist()


def member_points(resolved: DataFrame) -> DataFrame:
    """Coordinates as one point column, x being the longitude."""
    point = F.struct(F.col("longitude").alias("x"), F.col("latitude").alias("y"))
    return resolved.withColumn("point", point).drop("longitude", "latitude")
