"""Customer flow: edges between consecutive events, and the nodes they connect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import lookup
from tidemark.operators.scan import ordered_scan
from tidemark.plans.ledger import LEDGER_ORDER, event_slices

# States by column of the flow chart, and the states a customer stays in.
ACQUISITION_LEVELS = {"verify": 1, "reject": 1, "activate": 2, "dropped": 2, "others": 3}
SERVICE_LEVELS = {
    "open": 1, "cross-open": 1, "renew": 2, "ongoing": 3, "mature": 3, "break": 3, "re-open": 4,
}
GAIN_STATES = ["activate", "verify", "signup", "renew", "open", "cross-open", "re-open", "ongoing"]
SERVICE_LEVEL = 3
NEAR, FAR = 0.05, 0.95


def _edges(events: DataFrame, group: Sequence[str], keys, order) -> DataFrame:
    """Counted steps from the previous event (or the channel, for the first) to the event."""
    stepped = ordered_scan(
        events, keys, order, event_slices(), previous={"source": F.col("trxn_type")})
    return (
        stepped.withColumn("source", F.coalesce("source", "channel"))
        .groupBy(*group, "source", F.col("trxn_type").alias("target"))
        .agg(F.count(F.lit(1)).alias("len"))
    )


def complete_edges(edges: DataFrame, group: Sequence[str], end: Column) -> DataFrame:
    """Adds, for each state entered and left a different number of times, the difference as
    an edge to ``end`` (an expression on ``source``; NULL discards it). Negative
    differences keep their sign; states that are only entered or only left add nothing."""
    group, none = list(group), F.lit(None).cast("bigint")
    source, target, n = F.col("source"), F.col("target"), F.col("len")

    def part(kind: str, node: Column, to: Column, length: Column, into: Column, out: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), node.alias("node"), to.alias("to"),
                        length.alias("length"), into.alias("into"), out.alias("out"))

    # every edge also counts for its two states, so the edges are worked out once only
    nowhere = F.lit(None).cast("string")
    parts = edges.select(*group, F.inline(F.array(
        part("edge", source, target, n, none, none),
        part("state", target, nowhere, none, n, none),
        part("state", source, nowhere, none, none, n))))
    sums = parts.groupBy(*group, "kind", F.col("node").alias("source"), "to").agg(
        *[F.sum(c).alias(c) for c in ("length", "into", "out")])
    is_edge, rest = F.col("kind") == "edge", F.col("into") - F.col("out")
    ended = source.isNotNull() & (rest != 0) & end.isNotNull()
    return sums.where(is_edge | ended).select(
        *group, "source", F.when(is_edge, F.col("to")).otherwise(end).alias("target"),
        F.when(is_edge, F.col("length")).otherwise(rest).alias("len"))


def acquisition_flow(registrations: DataFrame, trxns: DataFrame) -> DataFrame:
    """Edges from channel through verification and activation to the service opened."""
    steps = registrations.where(F.col("trxn_type") != "signup").select(
        "user_id", "channel", "trxn_type", "trxn_datetime",
        F.coalesce("trxn_id", F.lit(-1)).alias("trxn_id"), F.lit(0).alias("stage"))
    opened = trxns.where(F.col("trxn_type") == "open").select(
        "user_id", F.lit(None).cast("string").alias("channel"), F.col("service").alias("trxn_type"),
        "trxn_datetime", "trxn_id", F.lit(1).alias("stage"))
    # an opening follows the activation it comes with
    edges = _edges(steps.unionByName(opened), [], ["user_id"], [*LEDGER_ORDER, "stage", "trxn_type"])
    source = F.col("source")
    end = F.when(source.isin("verify", "reject"), "dropped").when(source.isin("activate", "dropped"), "others")
    return complete_edges(edges, [], end)


def service_flow(trxns: DataFrame) -> DataFrame:
    """Edges between account events within each service, in one job for all services."""
    kept = trxns.where(~F.col("trxn_type").isin("top_up", "withdraw") & F.col("service").isNotNull())
    edges = _edges(kept, ["service"], ["service", "user_id"], LEDGER_ORDER).na.drop("any")
    return complete_edges(edges, ["service"], F.when(F.col("source").isin(GAIN_STATES), "ongoing"))


def flow_nodes(
    edges: DataFrame,
    places: dict[str, int],
    named: DataFrame,
    group: Sequence[str] = (),
    fixed_y: dict[str, float] | None = None,
) -> DataFrame:
    """Distinct end points of the edges with a dense ``node_id`` and a chart position.

    Ids follow first appearance: sources in edge order, then targets. The chart column of
    a state comes from ``places``, that of channels and services from ``named`` (node,
    place); others have none. Edge frames are as small as the set of states."""
    group = list(group)
    whole = Window.partitionBy(*(group or [F.lit(1)]))
    ends = edges.select(*group, "source", "target", F.inline(F.array(
        F.struct(F.col("source").alias("node"), F.lit(0).alias("side")),
        F.struct(F.col("target").alias("node"), F.lit(1).alias("side")))))
    nodes = ends.groupBy(*group, "node").agg(F.min(F.struct("side", "source", "target")).alias("at"))
    places_by_name = named.where(F.col("node").isNotNull()).groupBy("node").agg(F.max("place").alias("place"))
    nodes = nodes.join(places_by_name, "node", "left")
    nodes = nodes.withColumns({
        "node_id": F.row_number().over(whole.orderBy("at")) - 1,
        "level": F.coalesce("place", lookup(F.col("node"), places)),
    })
    column = Window.partitionBy(*group, "level")
    nodes = nodes.withColumns({
        "x": clip((F.col("level") + 1) / (F.max("level").over(whole) + 2)),
        "k": F.row_number().over(column.orderBy("node_id")) - 1,
    })
    y = F.when(F.col("level").isNull(), 0.5).otherwise((F.col("k") + 1) / (F.max("k").over(column) + 2))
    nodes = nodes.withColumn("y", clip(y))
    if fixed_y:
        nodes = nodes.withColumn("y", F.coalesce(lookup(F.col("node"), fixed_y), "y"))
    return nodes.select(*group, "node_id", "node", "x", "y")


def clip(x: Column, low: float = NEAR, high: float = FAR) -> Column:
    # greatest and least skip nulls, so a null is kept by hand
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def _places(frame: DataFrame, column: str, place: int) -> DataFrame:
    return frame.select(F.col(column).alias("node"), F.lit(place).alias("place")).distinct()


def acquisition_nodes(edges: DataFrame, registrations: DataFrame, trxns: DataFrame) -> DataFrame:
    named = _places(registrations, "channel", 0).unionByName(_places(trxns, "service", SERVICE_LEVEL))
    return flow_nodes(edges, ACQUISITION_LEVELS, named)


def service_nodes(edges: DataFrame, registrations: DataFrame) -> DataFrame:
    named = _places(registrations, "channel", 0)
    return flow_nodes(edges, SERVICE_LEVELS, named, ["service"], fixed_y={"re-open": 0.33})


def numbered_edges(edges: DataFrame, nodes: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Edges with the ids of both end points."""
    group = list(group)
    ids = nodes.select(*group, "node", "node_id")
    source = ids.withColumnsRenamed({"node": "source", "node_id": "source_id"})
    target = ids.withColumnsRenamed({"node": "target", "node_id": "target_id"})
    return edges.join(source, [*group, "source"], "left").join(target, [*group, "target"], "left")
