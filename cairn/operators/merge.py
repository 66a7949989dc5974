"""Merge loaders (LD-1 to LD-6) as joins that classify rows and build the next state of a table.

A load is one batch: the first row of a key hash, in the order given, wins. Each loader returns a
``LoadResult``: rows to insert, changed target rows with the names of the changed fields, and the
table's next state. Nothing is written here; sinks do that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..entity import BOOKKEEPING, Entity
from ..functions.scalars import date_key
from .surrogate import assign_keys

INSERT, UPDATE, DELETE, UNDELETE, NOOP, NO_KEY, TYPE1, TYPE2 = "insert", "update", "delete", "undelete", "noop", "no_key", "type1", "type2"


@dataclass
class LoadResult:
    """``inserts``: new rows without keys. ``updates``: rows of the target with new values, _changed and _updates
    (how many updates a row stands for). ``classified``: KeyHash, key and action of each incoming row."""

    entity: Entity
    target: DataFrame | None
    inserts: DataFrame
    updates: DataFrame | None
    classified: DataFrame

    def keyed_inserts(self, natural: list[str], key_from: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The new rows, with keys in the order of ``natural``."""
        key = self.entity.single_key.name
        new = key_from(self.inserts) if key_from else assign_keys(self.inserts, self.target, key, natural)
        return new.withColumn(key, F.col(key).cast(self.entity.single_key.spark_type)).select(*[f.name for f in self.entity.mapped])

    def next_state(self, natural: list[str], key_from: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The target after the load; new rows get keys in the order of ``natural``."""
        key = self.entity.single_key.name
        names = [f.name for f in self.entity.mapped]
        new = self.keyed_inserts(natural, key_from)
        if self.target is None:
            return new
        kept = apply_updates(self.target, self.updates, key) if self.updates is not None else self.target
        return kept.select(*names).unionByName(new.select(*names))


def first_wins(rows: DataFrame, key: str | list[str], order: Iterable[str | Column]) -> DataFrame:
    """AGG-3: the first row of each key in ``order``, which must be total."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def apply_updates(target: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """SNK-7: only the fields named in _changed take the update's value."""
    u = updates.select(F.col(key).alias("_uk"), F.col("_changed"), *[F.col(c).alias(f"_u_{c}") for c in target.columns if c != key])
    joined = target.join(u, target[key] == F.col("_uk"), "left")
    return joined.select(*[F.col(key) if c == key else F.when(F.array_contains("_changed", c), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) for c in target.columns])


def load_default(entity: type | Entity, incoming: DataFrame, target: DataFrame | None = None) -> LoadResult:
    """LD-1: inserts everything."""
    e = Entity.of(entity)
    rows = e.complete(incoming)
    keys = e.key_fields
    actions = rows.select(*[f.name for f in keys], F.lit(INSERT).alias("action"))
    return LoadResult(e, target, rows, None, actions)


def load_inline(entity: type | Entity, incoming: DataFrame, target: DataFrame | None, fn: Callable[[DataFrame, DataFrame | None], LoadResult]) -> LoadResult:
    """LD-2, LD-6: the user's own loader."""
    return fn(incoming, target)


def load_transaction(entity: type | Entity, incoming: DataFrame, target: DataFrame | None, order: list, as_of: Column | None = None) -> LoadResult:
    """LD-3: inserts rows whose key hash the target lacks; never updates."""
    e = Entity.of(entity)
    e.single_key
    rows = e.complete(first_wins(incoming, "KeyHash", order), as_of)
    if target is None:
        return LoadResult(e, None, rows, None, rows.select("KeyHash", F.lit(INSERT).alias("action")))
    new = rows.join(target.select("KeyHash"), "KeyHash", "left_anti")
    known = target.select(F.col("KeyHash").alias("_k")).distinct()
    actions = rows.join(known, F.col("KeyHash") == F.col("_k"), "left").select("KeyHash", F.when(F.col("_k").isNull(), INSERT).otherwise(NOOP).alias("action"))
    return LoadResult(e, target, new.select(*rows.columns), None, actions)


def _match(e: Entity, incoming: DataFrame, target: DataFrame, order: list, as_of: Column | None, on: list[str]) -> DataFrame:
    """Incoming rows as struct i beside the first matching target row as struct t, or NULL."""
    key = e.single_key.name
    names = [f.name for f in e.mapped]
    rows = e.complete(first_wins(incoming, "KeyHash", order), as_of).select(F.struct(*names).alias("i"))
    held = first_wins(target.select(*names), on, [key]).select(F.struct(*names).alias("t"))
    condition = [F.col(f"i.{c}") == F.col(f"t.{c}") for c in on]
    return rows.join(held, condition, "left")


def load_snapshot(entity: type | Entity, incoming: DataFrame, target: DataFrame | None, order: list, as_of: Column | None = None) -> LoadResult:
    """LD-4: insert, update of changed fields, soft delete, undelete.

    An undelete applies no other change; that comes with the next load. A delete is reported even where
    the row is deleted already.
    """
    e = Entity.of(entity)
    key = e.single_key.name
    if target is None:
        rows = e.complete(first_wins(incoming, "KeyHash", order), as_of)
        return LoadResult(e, None, rows, None, rows.select("KeyHash", F.lit(INSERT).alias("action")))
    names = [f.name for f in e.mapped]
    comparable = [n for n in names if n != "Created" and not e.field(n).key]
    m = _match(e, incoming, target, order, as_of, ["KeyHash"])
    action = (
        F.when(F.col("t").isNull(), INSERT)
        .when(F.col(f"t.{key}").isNull(), NO_KEY)
        .when(F.col("i.IsDeleted"), DELETE)
        .when(F.col("t.IsDeleted"), UNDELETE)
        .when(~F.col("i.ChangeHash").eqNullSafe(F.col("t.ChangeHash")), UPDATE)
        .otherwise(NOOP)
    )
    m = m.withColumn("action", action)
    differs = F.array_compact(F.array(*[F.when(~F.col(f"i.{n}").eqNullSafe(F.col(f"t.{n}")), F.lit(n)) for n in comparable]))
    changed = F.when(F.col("action").isin(DELETE, UNDELETE), F.array(F.lit("IsDeleted"))).when(F.col("action") == UPDATE, differs)
    m = m.withColumn("_changed", changed)
    inserts = m.where(F.col("action") == INSERT).select("i.*")
    values = []
    for n in names:
        if n == "IsDeleted":
            v = F.when(F.col("action") == DELETE, True).when(F.col("action") == UNDELETE, False).otherwise(F.col("i.IsDeleted"))
        else:
            v = F.col(f"t.{n}") if n == key else F.when(F.array_contains("_changed", n), F.col(f"i.{n}")).otherwise(F.col(f"t.{n}"))
        values.append(v.alias(n))
    updates = m.where(F.size("_changed") > 0).select(*values, "_changed", F.lit(1).alias("_updates"))
    classified = m.select(F.col("i.KeyHash").alias("KeyHash"), F.col(f"t.{key}").alias(key), "action", F.coalesce("_changed", F.array().cast("array<string>")).alias("changed"))
    return LoadResult(e, target, inserts, updates, classified)


def load_scd(
    entity: type | Entity,
    incoming: DataFrame,
    target: DataFrame | None,
    order: list,
    as_of: Column | None = None,
    override_delete: bool = False,
    fields_on_delete: tuple[str, ...] = (),
) -> LoadResult:
    """LD-5, LD-5a, LD-5b: slowly changing dimension, types 1 and 2.

    A row meets the target row with its key hash and its IsActive. Deletes set IsDeleted (or clear IsActive,
    with ``override_delete``), ToDate and the chosen fields. An undelete goes on to the change test. A change
    of a type 2 field closes the target row and inserts the incoming one; other changes update in place.
    """
    e = Entity.of(entity)
    key = e.single_key.name
    now = as_of if as_of is not None else F.current_timestamp()
    if target is None:
        rows = _dated(e.complete(first_wins(incoming, "KeyHash", order), now))
        return LoadResult(e, None, rows, None, rows.select("KeyHash", F.lit(INSERT).alias("action")))
    names = [f.name for f in e.mapped]
    fixed = {"KeyHash", "FromDate", "FromDateKey", "ToDate", "ToDateKey", key, *(f.name for f in e.key_fields)}
    comparable = [n for n in names if n not in fixed]
    m = _match(e, incoming, target, order, now, ["KeyHash", "IsActive"])
    found = F.col("t").isNotNull() & F.col(f"t.{key}").isNotNull()
    m = m.withColumn("_delete", found & F.col("i.IsDeleted") & F.col("t.ToDate").isNull())
    m = m.withColumn("_undelete", found & ~F.col("i.IsDeleted") & F.col("t.IsDeleted"))
    held_deleted = F.when(F.col("_undelete"), False).otherwise(F.col("t.IsDeleted"))
    differs = F.array_compact(F.array(*[F.when(~F.col(f"i.{n}").eqNullSafe(held_deleted if n == "IsDeleted" else F.col(f"t.{n}")), F.lit(n)) for n in comparable]))
    tested = found & ~F.col("_delete") & ~F.col("i.ChangeHash").eqNullSafe(F.col("t.ChangeHash"))
    m = m.withColumn("_differs", F.when(tested, differs).otherwise(F.array().cast("array<string>")))
    matters = F.size(F.array_except("_differs", F.array(*[F.lit(b) for b in BOOKKEEPING]))) > 0
    versions = F.arrays_overlap("_differs", F.array(*[F.lit(n) for n in e.type2_fields])) if e.type2_fields else F.lit(False)
    m = m.withColumn("_type2", matters & versions).withColumn("_type1", matters & ~versions)
    base = F.when(F.col("t").isNull(), INSERT).when(~found, NO_KEY).when(F.col("_delete"), DELETE)
    rest = F.when(F.col("_type2"), TYPE2).when(F.col("_type1"), TYPE1)
    action = base.otherwise(F.when(F.col("_undelete") & rest.isNotNull(), F.concat(F.lit(UNDELETE + "+"), rest)).when(F.col("_undelete"), UNDELETE).otherwise(F.coalesce(rest, F.lit(NOOP))))
    m = m.withColumn("action", action)
    deleted = ["IsActive" if override_delete else "IsDeleted", "ToDate", "ToDateKey", *e.select(*fields_on_delete)] if fields_on_delete else ["IsActive" if override_delete else "IsDeleted", "ToDate", "ToDateKey"]

    def listed(ns: list[str]) -> Column:
        return F.array(*[F.lit(n) for n in ns])

    none = F.array().cast("array<string>")
    changed = F.when(F.col("_delete"), listed(deleted)).otherwise(
        F.array_distinct(
            F.concat(
                F.when(F.col("_undelete"), listed(["IsDeleted", "ToDate", "ToDateKey"])).otherwise(none),
                F.when(F.col("_type2"), listed(["IsActive", "ToDate", "ToDateKey"])).when(F.col("_type1"), F.col("_differs")).otherwise(none),
            )
        )
    )
    m = m.withColumn("_changed", F.when(found, changed).otherwise(none))
    values = []
    for n in names:
        t, i = F.col(f"t.{n}"), F.col(f"i.{n}")
        in_place = F.col("_type1") & F.array_contains("_differs", n)
        if n == key:
            v = t
        elif n in ("ToDate", "ToDateKey"):
            closed = now if n == "ToDate" else date_key(now)
            v = F.when(F.col("_delete") | F.col("_type2"), closed.cast(e.field(n).spark_type)).when(F.col("_undelete"), F.lit(None)).otherwise(t)
        elif n == "IsDeleted":
            v = F.when(F.col("_delete") & F.lit(not override_delete), True).when(in_place, i).when(F.col("_undelete"), False).otherwise(t)
        elif n == "IsActive":
            v = F.when(F.col("_type2") | (F.col("_delete") & F.lit(override_delete)), False).when(in_place, i).otherwise(t)
        elif n in deleted:
            v = F.when(F.col("_delete") | in_place, i).otherwise(t)
        else:
            v = F.when(in_place, i).otherwise(t)
        values.append(v.alias(n))
    count = F.col("_delete").cast("int") + F.col("_undelete").cast("int") + F.col("_type2").cast("int") + F.col("_type1").cast("int")
    updates = m.where(F.size("_changed") > 0).select(*values, "_changed", count.alias("_updates"))
    inserts = _dated(m.where((F.col("action") == INSERT) | F.col("_type2")).select("i.*"))
    classified = m.select(F.col("i.KeyHash").alias("KeyHash"), F.col(f"t.{key}").alias(key), "action", F.col("_changed").alias("changed"))
    return LoadResult(e, target, inserts, updates, classified)


def _dated(rows: DataFrame) -> DataFrame:
    """Date keys from the dates, where the entity has them."""
    for date, key in (("FromDate", "FromDateKey"), ("ToDate", "ToDateKey")):
        if date in rows.columns and key in rows.columns:
            rows = rows.withColumn(key, date_key(F.col(date)))
    return rows


def fold_batches(entity: type | Entity, incoming: DataFrame, target: DataFrame, batch: str, order: list, load: Callable[..., LoadResult], natural: list[str], save: Callable[[DataFrame, int], DataFrame], **kw) -> DataFrame:
    """Loads the numbered batches of ``incoming`` one after the other; a batch sees what the ones before it wrote.

    ``save`` writes a state and reads it back, so that lineage does not grow.
    """
    last = incoming.agg(F.max(batch)).first()[0]
    state = target
    for b in range(0 if last is None else int(last) + 1):
        part = incoming.where(F.col(batch) == b).drop(batch)
        state = save(load(entity, part, state, order, **kw).next_state(natural), b)
    return state


def fold_in_place(incoming: DataFrame, key: str, batch: str, order: list) -> DataFrame:
    """What numbered batches leave where changes only update in place: of each key, the first row of its last batch.

    The same as ``fold_batches`` for such loads, in one pass over the rows.
    """
    first = first_wins(incoming, [key, batch], order)
    return first_wins(first, key, [F.col(batch).desc()])
