"""Quorum analytics over replicated logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def commit_index(matches: DataFrame, log: DataFrame, term: int) -> DataFrame:
    """One row ``commit_index``: the largest index that a majority of nodes has (``node, match_index``) and that is of this term (``index, term``)."""
    # the number of nodes is small, so their matches fit one row
    ranked = matches.agg(F.sort_array(F.collect_list("match_index"), False).alias("m"))
    most = ranked.select(F.element_at("m", (F.size("m") / 2).cast("int") + 1).alias("most"))
    return log.join(F.broadcast(most)).where((F.col("index") <= F.col("most")) & (F.col("term") == F.lit(term))).agg(F.max("index").cast("bigint").alias("commit_index"))


def elected(votes: DataFrame) -> DataFrame:
    """Per ``candidate`` whether more than half of the nodes granted their vote."""
    return votes.groupBy("candidate").agg((F.count_if("granted") * 2 > F.count("*")).alias("elected"))


def up_to_date(candidate_term, candidate_index, term, index):
    """Whether a candidate's log is at least as new as a voter's."""
    return F.struct(candidate_term.alias("t"), candidate_index.alias("i")) >= F.struct(term.alias("t"), index.alias("i"))


def votes(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """``candidate, term, node, granted``: how each node answers each request ``(candidate, term, last_index, last_term)``.

    ``nodes``: ``node, current_term, voted_for, last_index, last_term``, a few rows. A node grants if the request's term is not below its own, it has
    not voted for another in that term, and the candidate's log is at least as new as its own.
    """
    n = nodes.select("node", "current_term", "voted_for", F.col("last_index").alias("own_index"), F.col("last_term").alias("own_term"))
    free = F.col("voted_for").isNull() | (F.col("voted_for") == F.col("candidate")) | (F.col("term") > F.col("current_term"))
    granted = (F.col("term") >= F.col("current_term")) & free & up_to_date(F.col("last_term"), F.col("last_index"), F.col("own_term"), F.col("own_index"))
    return requests.join(F.broadcast(n)).select("candidate", "term", "node", granted.alias("granted"))


def truncated(log: DataFrame, snapshot_index: int) -> DataFrame:
    """What a log keeps after a snapshot."""
    return log.where(F.col("index") > F.lit(snapshot_index))


def node_state(log: DataFrame, node: str = "node") -> DataFrame:
    """Per node the state that its log ``(node, index, term)`` gives: first and last index, last term, number of entries."""
    last = F.max(F.struct("index", "term"))
    out = log.groupBy(node).agg(F.min("index").alias("first_index"), last.alias("last"), F.count("*").alias("n_entries"))
    return out.select(node, "first_index", F.col("last.index").alias("last_index"), F.col("last.term").alias("last_term"), "n_entries")
