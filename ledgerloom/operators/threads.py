"""The forest of threads: closures over parent links, recent main threads, semi-joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import is_uuid_v7
from ledgerloom.sources.staging import cut


def second_name() -> Column:
    """The second name that children may give a rollout as their parent: main threads also go by their conversation."""
    return F.when(F.col("thread_type") == "main", F.col("conversation_id"))


#: Levels of the forest that one written table adds.
LEVELS = 8


def closure(rollouts: DataFrame, roots: DataFrame) -> DataFrame:
    """root, rollout_id: everything below the rollouts of roots (root, rollout_id), themselves included.

    What is followed are the names by which children call a parent, each once for a root: a conversation's children
    are not met again by each of its main threads, so the work grows with the rows of the result. Semi-naive: only
    names found last are extended, names known already are dropped, so cycles end. Some levels are planned together
    and written at once; a name that is found twice within them is dropped with the next ones.
    """
    own, conversations = F.struct(F.col("rollout_id").alias("name"), F.lit(True).alias("own")), F.collect_set(second_name()).over(Window.partitionBy("rollout_id"))
    names = F.concat(F.array(own), F.transform(conversations, lambda c: F.struct(c.alias("name"), F.lit(False).alias("own"))))
    named = cut(rollouts.where("rollout_id is not null").select("rollout_id", names.alias("names"), F.col("parent_thread_id").alias("name")))
    children = named.where("name is not null").select("name", "names")
    roots = cut(roots.select("root", "rollout_id").distinct())
    new = found = roots.join(named.drop("name"), "rollout_id").select("root", F.inline("names")).distinct()
    while True:
        steps = [new]
        for _ in range(LEVELS):
            below = steps[-1].select("root", "name").distinct().join(children, "name")
            steps.append(below.select("root", F.inline("names")).distinct())
        levels = [x.select("root", "name", "own", F.lit(i).alias("level")) for i, x in enumerate(steps)]
        more = reduce(DataFrame.unionByName, levels[1:] if found is not new else levels).groupBy("root", "name", "own").agg(F.max("level").alias("level"))
        more = cut(more if found is new else more.join(found, ["root", "name", "own"], "left_anti"))
        found = more.drop("level") if found is new else found.unionByName(more.drop("level"))
        new = more.where(F.col("level") == LEVELS).drop("level")
        if new.isEmpty():
            unknown = roots.join(named, "rollout_id", "left_anti")
            return found.where("own").select("root", F.col("name").alias("rollout_id")).unionByName(unknown.select("root", "rollout_id"))


def main_roots(rollouts: DataFrame) -> DataFrame:
    return rollouts.where("thread_type = 'main'").select(F.col("conversation_id").alias("root"), "rollout_id")


def thread_closure(rollouts: DataFrame, conversation_id: str) -> DataFrame:
    """rollout_id of one main conversation's whole thread tree; empty unless the id is a version-7 UUID."""
    roots = main_roots(rollouts).where((F.col("root") == conversation_id) & is_uuid_v7(F.lit(conversation_id)))
    return closure(rollouts, roots).select("rollout_id").distinct()


def events_of_thread(events: DataFrame, rollouts: DataFrame, conversation_id: str) -> DataFrame:
    return events.join(thread_closure(rollouts, conversation_id), "rollout_id", "left_semi")


def recent_main_threads(rollouts: DataFrame, most: int) -> DataFrame:
    """conversation_id, project_name, thread_title, last_activity_epoch_ms of the most recently active main threads
    that are no voice sessions. Activity is that of the whole tree, voice rollouts of the conversation included."""
    shown = rollouts.where((F.col("thread_type") == "main") & ~F.col("is_realtime_voice") & is_uuid_v7(F.col("conversation_id")))
    latest = F.max_by(F.struct("project_name", "thread_title"), F.struct("last_activity_epoch_ms", "rollout_id"))
    shown = shown.groupBy("conversation_id").agg(latest.alias("_shown")).select("conversation_id", "_shown.project_name", "_shown.thread_title")
    roots = main_roots(rollouts).join(shown.select(F.col("conversation_id").alias("root")), "root", "left_semi")
    activity = closure(rollouts, roots).join(rollouts.select("rollout_id", "last_activity_epoch_ms"), "rollout_id").groupBy(F.col("root").alias("conversation_id")).agg(F.max("last_activity_epoch_ms").alias("last_activity_epoch_ms"))
    return shown.join(activity, "conversation_id").orderBy(F.desc("last_activity_epoch_ms"), F.desc("conversation_id")).limit(most)


def with_rollouts(events: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Events with the attributes of their rollout. The dimension is joined by the optimiser's choice: broadcast where
    its statistics allow, else by a shuffle that AQE splits on skew."""
    return events.join(rollouts, "rollout_id")


def unknown_model_sources(events: DataFrame, rollouts: DataFrame) -> DataFrame:
    """file_path: canonical sources, present or not, of the rollouts that have an event of unknown model."""
    unknown = events.where("model = 'unknown'").select("rollout_id").distinct()
    named = rollouts.where("canonical_source_path is not null")
    return named.join(unknown, "rollout_id", "left_semi").select(F.col("canonical_source_path").alias("file_path")).distinct().orderBy("file_path")


def present_voice_rollouts(rollouts: DataFrame, sources: DataFrame) -> DataFrame:
    """Voice rollouts that have a present source."""
    return rollouts.where("is_realtime_voice").join(sources.where("is_present"), "rollout_id", "left_semi")
