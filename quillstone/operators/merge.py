"""Writes as pure functions of frames: patches, publication, archiving and refusals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def non_erasing_patch(base: DataFrame, patch: DataFrame, key: str, columns: Sequence[str], never: Mapping[str, str] | None = None) -> DataFrame:
    """base with the patch's values where it states one: null never erases, nor does a column's ``never`` value."""
    never = never or {}
    side = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    new = {c: F.coalesce(F.when(F.col(f"_{c}") != never[c], F.col(f"_{c}")) if c in never else F.col(f"_{c}"), F.col(c)) for c in columns}
    joined = base.join(side, key, "left")
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns])


def publish(items: DataFrame, upload: int, replaces: Sequence[int], columns: Sequence[str]) -> DataFrame:
    """items after an upload goes live: held-back patches, then promotion, then archiving; the order matters.

    A row with pending_upload = upload takes the patch's values (patch_<column>, null keeps) and now belongs to the
    upload; rows staged by it become active; active rows that still belong to a replaced upload are archived.
    Publishing again changes nothing.
    """
    patched = F.col("pending_upload").eqNullSafe(F.lit(upload))
    one = items.select(
        *[
            F.when(patched, F.coalesce(f"patch_{c}", c)).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.when(patched, F.lit(upload)).otherwise(F.col(c)).alias(c)
            if c == "upload"
            else F.when(~patched, F.col(c)).alias(c)
            if c == "pending_upload" or c.startswith("patch_")
            else F.col(c)
            for c in items.columns
        ]
    )
    two = one.withColumn("lifecycle", F.when((F.col("upload") == upload) & (F.col("lifecycle") == "staged"), "active").otherwise(F.col("lifecycle")))
    gone = (F.col("lifecycle") == "active") & F.col("upload").isin(*[u for u in replaces if u != upload]) if [u for u in replaces if u != upload] else F.lit(False)
    return two.withColumn("lifecycle", F.when(gone, "archived").otherwise(F.col("lifecycle")))


def archive_source(items: DataFrame, upload: int) -> DataFrame:
    """items after their source is deleted: what it supplies now is archived, all else is retained."""
    return items.withColumn("lifecycle", F.when((F.col("upload") == upload) & (F.col("lifecycle") != "archived"), "archived").otherwise(F.col("lifecycle")))


def blockers(parents: DataFrame, key: str, dependents: Mapping[str, DataFrame]) -> DataFrame:
    """key, dependent and n: why a parent can't be deleted, a row for each dependent table with rows of it."""
    held = [df.select(key).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit(name).alias("dependent"), "n") for name, df in dependents.items()]
    return reduce(DataFrame.unionByName, held).join(parents.select(key), key, "left_semi")


def upsert_latest(current: DataFrame, incoming: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Last version wins for each key; an incoming row of the same version replaces what is held."""
    both = current.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    names = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*names), F.struct(version, "_in")).alias("b"))
    return best.select(*keys, "b.*").select(*current.columns)


def guarded_upsert(base: DataFrame, commands: DataFrame, columns: Sequence[str], parent: str) -> tuple[DataFrame, DataFrame]:
    """(new state, outcomes) of commands: command, id, new_id, ``parent``, expected_version and payload (map of strings).

    A command without an id inserts a row, new_id, below its parent. One with an id needs the version it expects and
    sets the columns that its payload names, to null too; its parent counts where it is stated. Of several commands for
    a row the first counts, the others are SUPERSEDED. Columns that ``columns`` leaves out can't be written.
    """
    types = dict(base.dtypes)
    held = base.select("id", F.col("row_version").alias("_version"))
    turn = F.row_number().over(Window.partitionBy("id").orderBy("command"))
    outcome = (
        F.when(F.col("id").isNull(), F.when(F.col(parent).isNull(), "PARENT_REQUIRED").otherwise("INSERTED"))
        .when(F.col("_version").isNull(), "NOT_FOUND")
        .when(F.col("_turn") > 1, "SUPERSEDED")
        .when(F.col("expected_version").eqNullSafe(F.col("_version")), "PATCHED")
        .otherwise("STALE_WRITE")
    )
    # Inserts have no id to be numbered by, so they don't go to the window, where they would be one group.
    patches = commands.where(F.col("id").isNotNull()).withColumn("_turn", turn)
    judged = patches.unionByName(commands.where(F.col("id").isNull()).withColumn("_turn", F.lit(1))).join(held, "id", "left").withColumn("outcome", outcome)
    patch = judged.where("outcome = 'PATCHED'").select("id", F.col("payload").alias("_payload"), F.col(parent).alias("_parent"))
    stated = lambda c, payload: F.col(payload)[c].cast(types[c])
    new = {c: F.when(F.map_contains_key("_payload", c), stated(c, "_payload")).otherwise(F.col(c)) for c in columns}
    new |= {parent: F.coalesce("_parent", parent), "row_version": F.when(F.col("_payload").isNotNull(), F.col("row_version") + 1).otherwise(F.col("row_version"))}
    changed = base.join(patch, "id", "left").select(*[new.get(c, F.col(c)).alias(c) for c in base.columns])
    first = {"id": F.col("new_id"), parent: F.col(parent), "row_version": F.lit(1)} | {c: stated(c, "payload") for c in columns}
    inserted = judged.where("outcome = 'INSERTED'").select(*[first.get(c, F.lit(None)).cast(types[c]).alias(c) for c in base.columns])
    return changed.unionByName(inserted), judged.select("command", "outcome")


def change_prices(prices: DataFrame, units: DataFrame, commands: DataFrame, bases: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(new prices, outcomes) of commands: command, unit, price, basis and at. History is closed, never edited.

    A valid command closes the unit's current price at its time and becomes the current one until the next command.
    """
    outcome = (
        F.when(F.col("_known").isNull(), "UNIT_NOT_FOUND")
        .when(F.coalesce(F.col("price") < 0, F.lit(True)), "INVALID_PRICE")
        .when(~F.coalesce(F.col("basis").isin(*bases), F.lit(False)), "INVALID_PRICE_BASIS")
        .otherwise("SET")
    )
    judged = commands.join(units.select("unit", F.lit(True).alias("_known")).distinct(), "unit", "left").withColumn("outcome", outcome)
    after = F.lead("at").over(Window.partitionBy("unit").orderBy("command"))
    added = judged.where("outcome = 'SET'").select("unit", "price", "basis", F.col("at").alias("effective_from"), after.alias("effective_to"))
    added = added.withColumn("is_current", F.col("effective_to").isNull())
    first = judged.where("outcome = 'SET'").groupBy("unit").agg(F.min_by("at", "command").alias("_at"))
    closing = F.col("is_current") & F.col("_at").isNotNull()
    closed = prices.join(first, "unit", "left").withColumns({"effective_to": F.when(closing, F.col("_at")).otherwise(F.col("effective_to")), "is_current": F.col("is_current") & ~closing})
    return closed.select(prices.columns).unionByName(added.select(prices.columns)), judged.select("command", "outcome")


def staged_import(items: DataFrame, rows: DataFrame, upload: int, columns: Sequence[str]) -> DataFrame:
    """items after rows (org, id of the matched item or null, new_id, and ``columns``) of an upload were read.

    In an organisation with active items new ones are staged, and what a row says of an active item is held back as
    pending_upload and patch_<column> until the upload is published; without active items new ones are active at once.
    Staged items take the values and stay staged, archived ones come back as new ones would. Null never erases.
    """
    live = items.where("lifecycle = 'active'").select("org").distinct().withColumn("_live", F.lit(True))
    fresh = F.when(F.col("_live"), "staged").otherwise("active")
    side = rows.where(F.col("id").isNotNull()).select("org", "id", F.lit(True).alias("_seen"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = items.join(live, "org", "left").join(side, ["org", "id"], "left")
    seen, active = F.coalesce("_seen", F.lit(False)), F.col("lifecycle") == "active"
    new = {c: F.when(seen & ~active, F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)) for c in columns}
    new |= {f"patch_{c}": F.when(seen & active, F.col(f"_new_{c}")).otherwise(F.col(f"patch_{c}")) for c in columns}
    new["pending_upload"] = F.when(seen & active, F.lit(upload)).otherwise(F.col("pending_upload"))
    new["upload"] = F.when(seen & ~active, F.lit(upload)).otherwise(F.col("upload"))
    new["lifecycle"] = F.when(seen & (F.col("lifecycle") == "archived"), fresh).otherwise(F.col("lifecycle"))
    types = dict(items.dtypes)
    first = {"org": F.col("org"), "id": F.col("new_id"), "upload": F.lit(upload), "lifecycle": fresh} | {c: F.col(c) for c in columns}
    inserted = rows.where(F.col("id").isNull()).join(live, "org", "left").select(*[first.get(c, F.lit(None)).cast(types[c]).alias(c) for c in items.columns])
    return joined.select(*[new.get(c, F.col(c)).cast(types[c]).alias(c) for c in items.columns]).unionByName(inserted)


def write_back(parents: DataFrame, chosen: DataFrame, key: str, column: str, choice: str) -> DataFrame:
    """parents with ``column`` as their chosen child says, null where none is left, and changed: whether that is news."""
    joined = parents.join(chosen.select(key, F.col(choice).alias("_choice")), key, "left")
    changed = (~F.col(column).eqNullSafe(F.col("_choice"))).alias("changed")
    return joined.select(*[F.col("_choice").alias(c) if c == column else F.col(c) for c in parents.columns], changed)
