"""A graph of tasks: cycle checks, cascades, pruning of leaves, retries. dependencies: task, needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.traversal import COMPACT, closure
from codeloom.plans.staging import staged

#: States in which a task still takes part in cascades, and those that pruning may remove.
ACTIVE = ("PENDING", "IN_PROGRESS", "BLOCKED_ON_MERGE", "BLOCKED_ESCALATED", "BLOCKED_UPSTREAM_ESCALATION")
ENDED = ("COMPLETED", "SUPERSEDED", "FAILED_TERMINAL")


def would_cycle(dependencies: DataFrame, links: DataFrame) -> DataFrame:
    """task, needs, cycle of links: whether a link makes a task need itself, through what the task it needs depends on.

    First whole sets of nodes are walked, one row a node: forwards from all that links need, and backwards from all their
    tasks. Only links between both sets can close a cycle, and only dependencies inside both are walked for them, link by
    link, until a link has met its task. A walk leaves out nodes from which the task cannot be reached, by their ranks.
    """
    all_ = staged(links.select("task", "needs").distinct())
    e = staged(dependencies.select(F.col("task").alias("source"), F.col("needs").alias("target")).distinct())
    ahead = closure(all_.select(F.col("needs").alias("id")), e)
    behind = closure(all_.select(F.col("task").alias("id")), e, "in")
    between = staged(ahead.join(behind, "id", "left_semi").select("id"))
    step = staged(e.join(between.withColumnRenamed("id", "source"), "source", "left_semi").join(between.withColumnRenamed("id", "target"), "target", "left_semi"))
    rank = ranks(between, step)
    step = staged(step.join(rank.select(F.col("id").alias("target"), F.col("rank").alias("at_rank")), "target", "left"))
    may = (F.col("at") == F.col("task")) | F.col("rank").isNull() | F.coalesce(F.col("at_rank") < F.col("rank"), F.lit(False))
    of_task = rank.select(F.col("id").alias("task"), "rank")
    open_ = all_.join(between.withColumnRenamed("id", "needs"), "needs", "left_semi").join(between.withColumnRenamed("id", "task"), "task", "left_semi").join(of_task, "task", "left")
    open_ = open_.join(rank.select(F.col("id").alias("needs"), F.col("rank").alias("at_rank")), "needs", "left")
    seen = frontier = staged(open_.select("task", "needs", "rank", F.col("needs").alias("at"), "at_rank").where(may).select("task", "needs", "rank", "at"))
    met, rounds = staged(seen.where("at = task").select("task", "needs")), 0
    while not frontier.isEmpty():
        left = frontier.join(met, ["task", "needs"], "left_anti")
        found = left.join(step, F.col("at") == F.col("source")).select("task", "needs", "rank", F.col("target").alias("at"), "at_rank").where(may).select("task", "needs", "rank", "at").distinct()
        frontier = staged(found.join(seen, ["task", "needs", "at"], "left_anti"))
        seen, met, rounds = seen.unionByName(frontier), met.unionAll(frontier.where("at = task").select("task", "needs")), rounds + 1
        if rounds % COMPACT == 0:
            seen, met = staged(seen), staged(met)
    closes = met.distinct().withColumn("cycle", F.lit(True))
    return all_.join(closes, ["task", "needs"], "left").select("task", "needs", F.coalesce("cycle", F.lit(False)).alias("cycle"))


#: Rounds in which nodes are ranked; what is left has no rank, such as nodes on cycles and what they lead to.
RANKED = 40


def ranks(nodes: DataFrame, step: DataFrame, rounds: int = RANKED) -> DataFrame:
    """id, rank of nodes (id) of a graph (source, target): 1 for those that no step leads to, then for those that only ranked nodes lead to.

    What leads to a ranked node is ranked and has a lower rank, so a node reaches another one of rank r only if its own rank is below r.
    """
    left, edges, out = nodes, step.select("source", "target"), nodes.select("id", F.lit(0).alias("rank")).limit(0)
    for k in range(1, rounds + 1):
        gone = staged(left.join(edges.select(F.col("target").alias("id")), "id", "left_anti"))
        if gone.isEmpty():
            break
        out = out.unionAll(gone.select("id", F.lit(k).alias("rank")))
        if k % COMPACT == 0:
            out = staged(out)
        left, edges = staged(left.join(gone, "id", "left_anti")), staged(edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti"))
    return staged(out)


def escalated(tasks: DataFrame, dependencies: DataFrame, failed: DataFrame) -> DataFrame:
    """id of active tasks that a failed task (id) blocks, directly or through other active tasks."""
    active = tasks.where(F.col("status").isin(*ACTIVE)).select("id")
    e = dependencies.join(active, dependencies.task == active.id, "left_semi").select(F.col("needs").alias("source"), F.col("task").alias("target"))
    return closure(failed, e).join(failed, "id", "left_anti")


def recovered(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """id of blocked tasks all of whose dependencies are COMPLETED."""
    blocked = tasks.where("status = 'BLOCKED_UPSTREAM_ESCALATION'").select("id")
    needs = dependencies.join(tasks.select(F.col("id").alias("needs"), "status"), "needs", "left")
    ready = needs.groupBy(F.col("task").alias("id")).agg(F.every(F.coalesce(F.col("status") == "COMPLETED", F.lit(False))).alias("ready"))
    return blocked.join(ready, "id", "left").where(F.coalesce("ready", F.lit(True))).select("id")


def prunable(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """id of ended tasks that no other task needs."""
    return tasks.where(F.col("status").isin(*ENDED)).select("id").join(dependencies.select(F.col("needs").alias("id")), "id", "left_anti")


def pruned(tasks: DataFrame, dependencies: DataFrame, rounds: int | None = None) -> DataFrame:
    """id, round of the tasks that go when leaves are removed again and again, until a round removes none or for so many rounds."""
    left, edges, out, k = tasks, dependencies, None, 0
    while rounds is None or k < rounds:
        k += 1
        gone = staged(prunable(left, edges).withColumn("round", F.lit(k)))
        if gone.isEmpty():
            break
        out = gone if out is None else out.unionAll(gone)
        if k % COMPACT == 0:
            out = staged(out)
        left, edges = staged(left.join(gone, "id", "left_anti")), staged(edges.join(gone.select(F.col("id").alias("task")), "task", "left_anti"))
    return out if out is not None else tasks.select("id", F.lit(0).alias("round")).limit(0)


def retried(dependencies: DataFrame, replaced: DataFrame) -> DataFrame:
    """Dependencies in which replacements (id, by) stand for the tasks that they supersede, each once."""
    r = replaced.select("id", "by")
    moved = dependencies.join(r.select(F.col("id").alias("task"), F.col("by").alias("t")), "task", "left").join(r.select(F.col("id").alias("needs"), F.col("by").alias("n")), "needs", "left")
    return moved.select(F.coalesce("t", "task").alias("task"), F.coalesce("n", "needs").alias("needs")).distinct()
