"""Messages, reactions, threads, pages, analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.files import stored


def latest(rows: DataFrame, by: list[str], n: int, time: str = "created_at", tie: str = "message_id") -> DataFrame:
    """The newest n rows of each group, newest first by column rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def page_before(messages: DataFrame, before: tuple | None, n: int) -> DataFrame:
    """One page of n messages older than the cursor (time, id), oldest first, with has_more and oldest_id.

    Keyset, not offset: the filter reaches the scan and one row more than the
    page is read to tell whether there is more.
    """
    older = messages if before is None else messages.where((F.col("created_at") < F.lit(before[0])) | ((F.col("created_at") == F.lit(before[0])) & (F.col("message_id") < before[1])))
    some = older.orderBy(F.desc("created_at"), F.desc("message_id")).limit(n + 1)
    ranked = some.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("message_id"))))  # at most n + 1 rows
    page = Window.partitionBy()
    return (
        ranked.withColumn("has_more", F.max("rank").over(page) > n)
        .where(F.col("rank") <= n)
        .withColumn("oldest_id", F.max_by("message_id", "rank").over(page))
        .orderBy("created_at", "message_id")
    )


def connection_list(joins: DataFrame, viewer: int) -> DataFrame:
    """A row for each member of a room: place (the viewer first, then by joined_at and id), who (the id, masked), connections, the room's users and all_connections.

    ``joins``: room_id, user_id, ts, a row for each connection made. Members are
    counted by room and user before anything is ordered. A room's places are given
    in one task, a narrow row a member.
    """
    members = joins.where("room_id IS NOT NULL AND user_id IS NOT NULL").groupBy("room_id", "user_id").agg(F.min("ts").alias("joined_at"), F.max("ts").alias("active_at"), F.count("*").alias("connections"))
    totals = members.groupBy("room_id").agg(F.count("*").alias("users"), F.sum("connections").alias("all_connections"))
    place = F.row_number().over(Window.partitionBy("room_id").orderBy(F.desc(F.col("user_id") == viewer), "joined_at", "user_id"))
    placed = members.withColumn("place", place).withColumn("who", F.concat(F.substring(F.col("user_id").cast("string"), 1, 8), F.lit("...")))
    return placed.join(totals, "room_id").select("room_id", "users", "all_connections", "place", "who", "connections", "joined_at", "active_at")


def grouped_reactions(reactions: DataFrame, viewer: int) -> DataFrame:
    """message_id, emoji, n, users (by time), has_reacted."""
    return reactions.groupBy("message_id", "emoji").agg(
        F.count("*").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("created_at", "user_id"))), lambda r: r["user_id"]).alias("users"),
        F.max(F.col("user_id") == viewer).alias("has_reacted"),
    )


def folded_reactions(events: DataFrame) -> DataFrame:
    """message_id, emoji, n after all adds and removes: the last event of each user decides; nothing at 0."""
    last = events.groupBy("message_id", "emoji", "user_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"))
    return last.where("action = 'add'").groupBy("message_id", "emoji").agg(F.count("*").alias("n"))


def _climbed(parents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """message_id, root_id, depth by pointer doubling, of the messages whose walk ends; and the message_ids that walk into a cycle, if any.

    A round ends the walks of up to twice as many steps. While walks to a root
    are left, some of them end in each round: those that are left when none does
    go round in cycles. Walks that ended stay as they were written; a round moves
    the others only.
    """
    at = parents.select("message_id", F.coalesce("parent", "message_id").alias("root_id"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"))
    done, walking, before = at.where("depth = 0"), at.where("depth > 0"), None
    while True:
        up = done.where("depth > 0").unionByName(walking).select(F.col("message_id").alias("root_id"), F.col("root_id").alias("next"), F.col("depth").alias("more"))
        moved = stored(walking.join(up, "root_id", "left"), "threads")
        at = moved.select("message_id", F.coalesce("next", "root_id").alias("root_id"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "more")
        done, walking = done.unionByName(at.where("more IS NULL").drop("more")), at.where("more > 0").drop("more")
        left = walking.count()
        if not left or left == before:
            return done, walking.select("message_id") if left else None
        before = left


def _cycle_members(links: DataFrame) -> DataFrame:
    """message_id: all members of cycles, of links (message_id, parent) that all lead into one.

    What is reached in ever more steps shrinks to the cycles: once twice the steps
    reach as many messages as before, these are their members.
    """
    at, before = links.select("message_id", F.col("parent").alias("to")), links.count()
    while (n := at.select("to").distinct().count()) < before:
        on = at.select(F.col("message_id").alias("to"), F.col("to").alias("next"))
        at, before = stored(at.join(on, "to").select("message_id", F.col("next").alias("to")), "threads"), n
    return at.select(F.col("to").alias("message_id")).distinct()


def thread_roots(messages: DataFrame) -> DataFrame:
    """message_id, root_id, depth: up the replies by pointer doubling until all are at their roots, however deep.

    A missing parent ends the walk. A walk that comes to a message again ends there:
    the members of a cycle are their own roots, and a reply outside leads to the
    member where its walk enters. A round is one join over narrow rows, written to
    the shared folder so that plans do not double with the pointers.
    """
    linked = messages.alias("m").join(messages.select(F.col("message_id").alias("p")), F.col("m.reply_to") == F.col("p"), "left")
    parents = stored(linked.select(F.col("m.message_id").alias("message_id"), F.col("p").alias("parent")), "threads")
    at, circling = _climbed(parents)
    if circling is not None:
        links = stored(parents.join(circling, "message_id"), "threads")  # a walk into a cycle meets no others
        tops = _cycle_members(links).withColumn("top", F.lit(True))
        cut = links.join(tops, "message_id", "left").select("message_id", F.when(F.col("top").isNull(), F.col("parent")).alias("parent"))
        at = at.unionByName(_climbed(stored(cut, "threads"))[0])
    return at


def thread_replies(messages: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """A row per reply: root_id, created_at, message_id, answers (the parent's author, if the parent is not the root)."""
    roots = messages.join(thread_roots(messages), "message_id") if roots is None else roots
    parents = messages.select(F.col("message_id").alias("reply_to"), F.col("user_id").alias("parent_author"))
    replies = roots.join(parents, "reply_to", "left").where("message_id <> root_id")
    return replies.select("root_id", "created_at", "message_id", F.when(F.col("reply_to") != F.col("root_id"), F.col("parent_author")).alias("answers"))


def threads(messages: DataFrame) -> DataFrame:
    """A row per root in time order: its replies by time; a reply whose parent is not the root names the parent's author.

    A thread is one row here; ``thread_replies`` has a row for each reply.
    """
    roots = messages.join(thread_roots(messages), "message_id")
    grouped = thread_replies(messages, roots).groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "message_id", "answers"))).alias("replies"))
    tops = roots.where("message_id = root_id").select("root_id", F.col("created_at").alias("started"))
    return tops.join(grouped, "root_id", "left").withColumn("n_replies", F.coalesce(F.size("replies"), F.lit(0)))


def room_statistics(messages: DataFrame) -> DataFrame:
    return messages.groupBy("room_id").agg(F.count("*").alias("n_messages"), F.countDistinct("user_id").alias("n_users"), F.max("created_at").alias("last_activity"), F.min("created_at").alias("first_activity"))


def user_statistics(users: DataFrame, messages: DataFrame, now: Column) -> DataFrame:
    sums = messages.groupBy("user_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_message"), F.max("created_at").alias("last_message"))
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("joined_at").cast("timestamp"))) / 86_400_000_000)
    return users.join(sums, "user_id", "left").select("user_id", F.coalesce("n", F.lit(0)).alias("n_messages"), "first_message", "last_message", age.cast("int").alias("age_days"))


def analytics(messages: DataFrame, users: DataFrame) -> DataFrame:
    """One row: messages, distinct devices, success rate, mean confidence of the ten newest scored messages."""
    rate = F.when(F.count("*") > 0, F.round(F.count_if("scored") / F.count("*") * 100, 1)).otherwise(0.0)
    totals = messages.agg(F.count("*").alias("n_messages"), F.count("confidence").alias("n_scored"), rate.alias("success_rate"))
    devices = users.agg(F.countDistinct("ip_hash").alias("n_devices"))
    newest = messages.where("scored").orderBy(F.desc("created_at"), F.desc("message_id")).limit(10).agg(F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 2).alias("mean_confidence"))
    return totals.join(devices).join(newest)  # three tables of one row


def audience(members: DataFrame, sender_conn: int, room: int) -> DataFrame:
    """Connections of the room but the sender's."""
    return members.where((F.col("room_id") == room) & (F.col("conn_id") != sender_conn))


def merged_pages(have: DataFrame, more: DataFrame) -> DataFrame:
    return have.unionByName(more.join(have.select("message_id"), "message_id", "left_anti")).orderBy("created_at", "message_id")


def catalog_tables(spark: SparkSession) -> list[tuple[str, bool]]:
    return [(t.name, t.isTemporary) for t in spark.catalog.listTables()]
