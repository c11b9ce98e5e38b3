"""Inferred edges after a change, from what they were before it: only what the change touches is worked out again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.inference import dispatch, event_classes
from codeloom.operators.traversal import owner_of
from codeloom.plans.staging import staged

METHODS = ("Method",)


def _semi(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    return rows.join(ids.select(F.col("id").alias(column)), column, "left_semi")


def touched_interfaces(changed: DataFrame, edges_before: DataFrame, edges: DataFrame) -> DataFrame:
    """id of the types whose dispatch a change of types (id) may alter: themselves, and what they implement before or after it."""
    implemented = edges_before.where("type = 'IMPLEMENTS'").select("source", "target").unionAll(edges.where("type = 'IMPLEMENTS'").select("source", "target"))
    return staged(changed.select("id").unionAll(_semi(implemented, "source", changed).select(F.col("target").alias("id"))).distinct())


def dispatch_after(known: DataFrame, nodes: DataFrame, edges_before: DataFrame, edges: DataFrame, changed: DataFrame) -> DataFrame:
    """What `dispatch` gives for nodes and edges, from what it gave before (known) and the types that changed (id).

    changed: types whose node, methods or IMPLEMENTS edges were added, removed or altered, those that are gone included. The
    rows of interfaces that no change touches are kept as they are; for the others only their methods and those of
    the classes that implement them are joined again.
    """
    touched = touched_interfaces(changed, edges_before, edges)
    implementing = staged(_semi(edges.where("type = 'IMPLEMENTS'"), "target", touched))
    types = staged(touched.unionAll(implementing.select(F.col("source").alias("id"))).distinct())
    own_types = _semi(nodes.where(F.col("type").isin("Class", "Interface")), "id", types)
    methods = nodes.where(F.col("type").isin(*METHODS)).withColumn("__owner", owner_of(F.col("full_name")))
    own_methods = _semi(methods, "__owner", types).select(nodes.columns)
    # An interface that isn't touched gives none of its rows here: its own methods are left out with the IMPLEMENTS edges to it.
    fresh = dispatch(own_types.select(nodes.columns).unionByName(own_methods), implementing.select(edges.columns))
    kept = known.withColumn("__owner", owner_of(F.col("source"))).join(touched.select(F.col("id").alias("__owner")), "__owner", "left_anti").select(known.columns)
    return kept.unionByName(fresh)


def event_classes_after(classes: DataFrame, members: DataFrame, removed: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What `event_classes` gives after a change: members (event, id, role) without those removed and with those added.

    Only the events of removed and added members are counted again.
    """
    key = ["event", "id", "role"]
    now = staged(members.join(removed.select(*key), key, "left_anti").select(*key).unionAll(added.select(*key)).distinct())
    events = staged(removed.select("event").unionAll(added.select("event")).distinct())
    again = now.join(events, "event", "left_semi")
    fresh = event_classes(again.where("role = 'publisher'").select("event", "id"), again.where("role = 'listener'").select("event", "id"))[0]
    return classes.join(events, "event", "left_anti").unionByName(fresh), now
