"""Conversation and message operators.

Messages stay in long form (one row per message, ordered by ``turn``); no
operator gathers a whole conversation into one array.  The prompt context
(W1) is a per-conversation top-20, which Spark runs as a partial
``WindowGroupLimit`` before the shuffle, so a very long conversation
contributes at most 20 rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import DEFAULT_TITLE, HISTORY_LIMIT, SYSTEM_PROMPT, TITLE_CHARS

KNOWN_CHAT_PROVIDERS = ("openai", "anthropic", "google")


def title_from_message(first_message) -> F.Column:
    """First 60 code points of the first message; default title when empty/NULL."""
    c = F.col(first_message) if isinstance(first_message, str) else first_message
    return F.coalesce(F.nullif(F.substring(c, 1, TITLE_CHARS), F.lit("")), F.lit(DEFAULT_TITLE))


def chat_provider(provider) -> F.Column:
    """A conversation keeps the provider only when it is one of the three known ones."""
    p = F.col(provider) if isinstance(provider, str) else provider
    return F.when(p.isin(*KNOWN_CHAT_PROVIDERS), F.upper(p))


def assistant_log_link(log_id) -> F.Column:
    """A message links to its log only when the id is 36 chars long (UUID text)."""
    c = F.col(log_id) if isinstance(log_id, str) else log_id
    return F.when(F.length(c) == 36, c)


def conversation_dim(messages: DataFrame, logs: DataFrame) -> DataFrame:
    """Conversation rows from messages (+ their call logs for times and provider).

    title (P14) from the first USER message, message count, first/last turn,
    created/updated time from the conversation's calls, status ACTIVE.
    Both sides are aggregated by conversation before they are joined.
    """
    m = messages.groupBy("conversation_id").agg(
        F.min_by(F.when(F.col("role") == "USER", F.col("content")),
                 F.when(F.col("role") == "USER", F.col("turn"))).alias("first_user"),
        F.count(F.lit(1)).alias("message_count"),
        F.max_by("content", "turn").alias("last_message_preview"),
        F.max("turn").alias("last_turn"))
    lg = logs.groupBy("conversation_id").agg(
        F.min("created_at").alias("created_at"), F.max("created_at").alias("updated_at"),
        F.min_by("provider", "created_at").alias("provider"), F.min_by("model", "created_at").alias("model"))
    return (m.join(lg, "conversation_id", "left")
            .select("conversation_id", title_from_message("first_user").alias("title"),
                    F.lit("ACTIVE").alias("status"), "provider", "model", "message_count", "last_turn",
                    "last_message_preview", "created_at", "updated_at"))


def list_conversations(convs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """F5 + T4 + P16: status filter (default: not ARCHIVED), newest updated first."""
    f = (convs.filter(F.col("status") == status.upper()) if status
         else convs.filter(F.col("status") != "ARCHIVED"))
    return f.orderBy(F.desc_nulls_last("updated_at"), F.asc("conversation_id")).limit(limit)


def last_message(messages: DataFrame) -> DataFrame:
    """Newest message per conversation (max_by combines map-side)."""
    return messages.groupBy("conversation_id").agg(
        F.max("turn").alias("last_turn"),
        F.max_by("role", "turn").alias("last_role"),
        F.max_by("content", "turn").alias("last_message_preview"))


def thread(convs: DataFrame, messages: DataFrame) -> DataFrame:
    """J1 + T5: conversation header joined to each of its messages, in turn order.

    Rows are sorted by (conversation, turn) within each partition rather than
    globally: a global sort would add a sampled range shuffle of every message
    (and cannot split a hot conversation either), while readers of one
    conversation filter it and get its messages in order.
    """
    head = convs.select("conversation_id", "title", "status")
    # a conversation without messages keeps its header, with NULL message columns
    return (head.join(messages, "conversation_id", "left")
            .select("conversation_id", "title", "status", "turn", "role", "content")
            .sortWithinPartitions("conversation_id", "turn"))


def context_window(messages: DataFrame, new_message: str = "continue",
                   limit: int = HISTORY_LIMIT, system_prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """System message, last ``limit`` messages in time order, then the new user message.

    Long form ``(conversation_id, pos, role, content)``; pos 0 is the system
    message, the user message comes last.  One pass: a per-conversation top-k
    (partial WindowGroupLimit before the shuffle), a count over the <= k kept
    rows (same partitioning, no new exchange), and a generator that adds the
    system and user rows next to the newest message.
    """
    w = Window.partitionBy("conversation_id").orderBy(F.desc("turn"))
    recent = messages.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= limit)
    n = F.count(F.lit(1)).over(Window.partitionBy("conversation_id"))
    ranked = recent.withColumn("__n", n)
    own = F.struct((F.col("__n") - F.col("__rn") + 1).cast("int").alias("pos"),
                   F.lower("role").alias("role"), F.col("content").alias("content"))
    system = F.struct(F.lit(0).alias("pos"), F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))
    user = F.struct((F.col("__n") + 1).cast("int").alias("pos"), F.lit("user").alias("role"),
                    F.lit(new_message).alias("content"))
    rows = F.when(F.col("__rn") == 1, F.array(system, own, user)).otherwise(F.array(own))
    return ranked.select("conversation_id", F.inline(rows))


def usage_per_conversation(logs: DataFrame, convs: DataFrame) -> DataFrame:
    """Calls, errors, tokens and cost per conversation (aggregate, then join)."""
    per = logs.filter(F.col("conversation_id").isNotNull()).groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("status") == "ERROR").alias("errors"),
        F.sum("total_tokens").cast("long").alias("total_tokens"),
        F.sum("cost_usd").cast("double").alias("cost_usd"))
    # a conversation without calls has 0 calls and errors and no sums
    return (convs.select("conversation_id", "title").join(per, "conversation_id", "left")
            .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("calls", "errors")}))


def message_log_links(messages: DataFrame, logs: DataFrame, link_col: str = "inference_log_id") -> DataFrame:
    """Left join of messages to the call they produced (nullable link)."""
    lg = logs.select(F.col("id").alias("__lid"), F.col("status").alias("log_status"),
                     F.col("latency_ms").alias("log_latency_ms"))
    return messages.join(lg, F.col(link_col) == F.col("__lid"), "left").drop("__lid")


def apply_chat_turns(convs: DataFrame, messages: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S9 + P14 + P15 + M5 over a table of chat turns.

    ``turns``: (turn_id, conversation_id nullable, message, provider, model,
    response, log_id, ts).  A turn whose conversation is missing opens a new
    conversation (id = turn_id, title from the message, provider kept only
    when known); every turn appends its user message and, when the response
    is non-empty, the assistant message (linked to the log only for 36-char
    ids); conversations are touched with their newest turn time.
    Returns (conversations, messages) as new DataFrames (append + update by join).
    """
    known = convs.select(F.col("conversation_id").alias("__cid"))
    t = (turns.join(known, F.col("conversation_id") == F.col("__cid"), "left")
         .withColumn("__new", F.col("__cid").isNull())
         .withColumn("conv", F.when(F.col("__new"), F.col("turn_id")).otherwise(F.col("conversation_id")))
         .drop("__cid"))
    conv_type = convs.schema["conversation_id"].dataType
    new_convs = t.filter("__new").select(
        F.col("conv").cast(conv_type).alias("conversation_id"),
        title_from_message("message").alias("title"), F.lit("ACTIVE").alias("status"),
        chat_provider("provider").alias("provider"), F.col("model"),
        F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"))
    cols = convs.columns
    new_convs = new_convs.select(*[F.col(c) if c in new_convs.columns else F.lit(None).cast(convs.schema[c].dataType)
                                   .alias(c) for c in cols])
    msg_cols = messages.columns
    ts_type = messages.schema["created_at"].dataType
    user = t.select(F.col("conv").alias("conversation_id"), F.lit("USER").alias("role"),
                    F.col("message").alias("content"), F.lit(None).cast("string").alias("inference_log_id"),
                    F.col("ts").cast(ts_type).alias("created_at"))
    assistant = t.filter(F.coalesce(F.length("response"), F.lit(0)) > 0).select(
        F.col("conv").alias("conversation_id"), F.lit("ASSISTANT").alias("role"), F.col("response").alias("content"),
        assistant_log_link("log_id").alias("inference_log_id"),
        (F.col("ts").cast(ts_type) + F.expr("INTERVAL 1 MICROSECOND")).alias("created_at"))
    added = user.unionByName(assistant)
    added = added.select(*[F.col(c).cast(messages.schema[c].dataType) if c in added.columns
                           else F.lit(None).cast(messages.schema[c].dataType).alias(c) for c in msg_cols])
    all_msgs = messages.unionByName(added)
    touched = (convs.unionByName(new_convs)
               .join(t.groupBy(F.col("conv").cast(conv_type).alias("conversation_id"))
                     .agg(F.max("ts").alias("__last")), "conversation_id", "left")
               .withColumn("updated_at", F.greatest("updated_at", F.col("__last").cast(convs.schema["updated_at"].dataType)))
               .drop("__last"))
    return touched, all_msgs
