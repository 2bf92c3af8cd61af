"""Content-addressed snapshots: blobs, commits as deltas, two-level tree hashes, diffs, history, state at a commit.

A commit stores only what it adds and removes; the state at a commit is the last change of each path up to it.
Commits of a branch carry a sequence number, so history and state are range filters and not walks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.tables import latest, written


def blob_hash(*columns: str, parity: bool = False, created: str = "created_at") -> Column:
    """sha256 of the JSON of the columns in order of their names. parity also takes in the creation time, as the
    reference results do, so that equal contents never share a blob."""
    return F.sha2(F.to_json(F.struct(*sorted([*columns, created] if parity else columns))), 256)


def tree_hash(entries: DataFrame, keys: list[str], digits: int = 8) -> DataFrame:
    """(keys, tree_sha) of entries (keys, sha): a trie over the first digits of the hashes, two at a level, so that a node
    gathers 256 children at most. A leaf holds each of its hashes with how often it stands there, counted before the shuffle."""
    count = entries.groupBy(*keys, "sha").agg(F.count("*").alias("n"))
    name, value = F.substring("sha", 1, digits), F.concat_ws("x", "sha", F.col("n").cast("string"))
    nodes = count.select(*keys, name.alias("node"), value.alias("child"), value.alias("h"))
    for left in range(digits - 2, -3, -2):
        hashed = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child", "h"))), lambda x: F.concat_ws(":", x["child"], x["h"])), ","), 256)
        up = nodes.groupBy(*keys, "node").agg(hashed.alias("h"))
        nodes = up.select(*keys, F.substring("node", 1, max(left, 0)).alias("node"), F.col("node").alias("child"), "h") if left >= 0 else up
    return nodes.select(*keys, F.col("h").alias("tree_sha"))


def diff_snapshots(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, file_path, sha): blobs of only one side, by path and hash; each side (file_path, sha)."""
    added = after.join(before.select("file_path", "sha").hint("merge"), ["file_path", "sha"], "left_anti")
    removed = before.join(after.select("file_path", "sha").hint("merge"), ["file_path", "sha"], "left_anti")
    return added.select(F.lit("added").alias("change"), "file_path", "sha").unionByName(removed.select(F.lit("removed").alias("change"), "file_path", "sha"))


def commit_delta(before: DataFrame, after: DataFrame, seq: int) -> DataFrame:
    """Log rows (seq, file_path, sha, deleted) of the commit that leads from one state (file_path, sha) to another."""
    both = before.select("file_path", F.col("sha").alias("x")).join(after.select("file_path", F.col("sha").alias("y")).hint("merge"), "file_path", "full")
    changed = both.where(~F.col("x").eqNullSafe(F.col("y")))
    return changed.select(F.lit(seq).alias("seq"), "file_path", F.coalesce("y", "x").alias("sha"), F.col("y").isNull().alias("deleted"))


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The state (file_path, sha) at a commit: the last change of each path up to it, without deleted ones."""
    return latest(log.where(F.col("seq") <= seq), ["file_path"], ["seq"]).where(~F.col("deleted")).select("file_path", "sha")


def commit(log: DataFrame, refs: DataFrame, staged: DataFrame, name: str, seq: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log, refs, stats) after a commit of staged rows (file_path, sha) on a branch: the log with what they add to the state
    before, the refs with the branch's new target (a hash of its number and name), and (added, total). Nothing staged is an error."""
    if staged.isEmpty():
        raise ValueError("nothing to commit")
    before = as_of(log, seq - 1)
    new = staged.select("file_path", "sha").join(before.hint("merge"), ["file_path", "sha"], "left_anti")
    after = log.unionByName(new.select(F.lit(seq).cast(log.schema["seq"].dataType).alias("seq"), "file_path", "sha", F.lit(False).alias("deleted")))
    head = log.sparkSession.range(1).select(F.lit("branch").alias("kind"), F.lit(name).alias("name"), F.sha2(F.lit(f"{name}:{seq}"), 256).alias("sha"), F.lit(seq).cast(refs.schema["seq"].dataType).alias("seq"))
    stats = staged.agg(F.count("*").alias("added")).crossJoin(F.broadcast(as_of(after, seq).agg(F.count("*").alias("total"))))  # one row each
    return after, refs.select("kind", "name", "sha", "seq").unionByName(head), stats


def history(log: DataFrame) -> DataFrame:
    """Of each commit: paths set and removed."""
    return log.groupBy("seq").agg(F.count_if(~F.col("deleted")).alias("written"), F.count_if("deleted").alias("deleted"))


def walk(commits: DataFrame, heads: DataFrame, limit: int = 10) -> DataFrame:
    """(name, sha, depth): from each head (name, sha) along first parents, of commits (sha, parent), `limit` commits at most, whatever
    the limit: a round doubles the depth and the length of the jumps from a commit to its ancestor."""
    parents = commits.select("sha", "parent")
    found = written(heads.select("name", "sha").join(parents.select("sha").hint("merge"), "sha").select("name", "sha", F.lit(0).alias("depth")), "walk")
    jumps, length = parents.where("parent is not null").join(parents.select(F.col("sha").alias("parent")).hint("merge"), "parent").select("sha", F.col("parent").alias("to")), 1
    while length < limit:
        further = found.where(F.col("depth") + length < limit).join(jumps.hint("merge"), "sha").select("name", F.col("to").alias("sha"), (F.col("depth") + length).alias("depth"))
        if further.isEmpty():
            break
        found = written(found.unionByName(further), "walk")
        jumps = written(jumps.select("sha", F.col("to").alias("over")).join(jumps.select(F.col("sha").alias("over"), "to").hint("merge"), "over").select("sha", "to"), "jumps")
        length *= 2
    return found


def list_refs(refs: DataFrame) -> DataFrame:
    """The last target (sha) of each (kind, name) by seq: branches, tags, and an agent's place after a checkout or rollback."""
    return latest(refs.select("kind", "name", "sha", "seq"), ["kind", "name"], ["seq"])


def checkpoint_counts(memories: DataFrame) -> DataFrame:
    """Of each agent: rows and a map of rows by type, as a checkpoint keeps them."""
    n = memories.groupBy("agent_id", "memory_type").agg(F.count("*").alias("n"))
    return n.groupBy("agent_id").agg(F.sum("n").alias("memories"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("memory_type", "n")))).alias("counts"))


def snapshot_text_search(state: DataFrame, blobs: DataFrame, text: str, k: int = 10, kind: str | None = None) -> DataFrame:
    """Best k blobs of a state by occurrences / length of a text, case folded: (file_path, score). kind: only entries of that mode."""
    state = state if kind is None else state.where(F.col("mode") == kind)
    held = state.select("file_path", "sha").join(blobs.select("sha", F.lower("content").alias("c")).hint("merge"), "sha")
    count = (F.length("c") - F.length(F.replace(F.col("c"), F.lit(text.lower()), F.lit("")))) / len(text)
    return held.where(F.contains("c", F.lit(text.lower()))).select("file_path", F.round(count / F.length("c"), 6).alias("score")).orderBy(F.desc("score"), "file_path").limit(k)
