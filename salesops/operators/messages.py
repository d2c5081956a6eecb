"""Topic rule over a conversation's history, history trimming, and the
chat request payload, for whole tables of messages (conv_id, turn, role, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesops.constants import (
    BUSINESS_KEYWORDS,
    CHAT_MAX_TOKENS,
    CHAT_TEMPERATURE,
    HISTORY_KEEP,
    HISTORY_ROLES,
    TOPIC_LOOKBACK,
)
from salesops.functions.messages import has_business_keyword, is_short_follow_up
from salesops.functions.text import py_strip
from salesops.plans.numbering import number_within

# Our own default instructions for the assistant; pass your own.
DEFAULT_SYSTEM_PROMPT = (
    "You are a business assistant for a retail management platform. Answer only questions about "
    "sales, profit, inventory, pricing, promotions, customers, forecasting and costs; politely "
    "decline other topics. Keep answers short and practical."
)
DEFAULT_DATASET_PROMPT = (
    "Answer using only the dataset context provided. If the answer cannot be derived from it, "
    "say so and name the columns or data that would be needed."
)


def message_flags(messages: DataFrame, keywords=BUSINESS_KEYWORDS) -> DataFrame:
    """C1 and C2 per message: adds ``has_keyword`` and ``is_follow_up``."""
    return messages.withColumn("has_keyword", has_business_keyword(F.col("text"), keywords)).withColumn(
        "is_follow_up", is_short_follow_up(F.col("text"))
    )


def is_business_query(messages: DataFrame, keywords=BUSINESS_KEYWORDS, lookback: int = TOPIC_LOOKBACK) -> DataFrame:
    """A message is on topic when it has a keyword, or it is a short
    follow-up and one of the ``lookback`` messages before it (by turn) has one.

    No per-conversation window: messages get dense positions per conversation
    (skew-safe numbering), each keyword message marks the ``lookback``
    positions after it, and follow-ups are matched to the marks by an
    equi-join on (conv_id, position). A long conversation is spread over many
    tasks; the marks are at most ``lookback`` rows per message.
    """
    flagged = message_flags(messages, keywords)
    pos = number_within(flagged, ["conv_id"], ["turn"], "pos")
    marks = (
        pos.where("has_keyword")
        .select(F.col("conv_id").alias("_conv"), F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + lookback)).alias("_pos"))
        .distinct()
        .withColumn("after_keyword", F.lit(True))
    )
    j = pos.join(marks, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left")
    on_topic = F.col("has_keyword") | (F.col("is_follow_up") & F.coalesce(F.col("after_keyword"), F.lit(False)))
    return j.select("conv_id", "turn", "role", "has_keyword", "is_follow_up", on_topic.alias("is_business"))


def recent_history(messages: DataFrame, keep: int = HISTORY_KEEP) -> DataFrame:
    """C4: per conversation the last ``keep`` messages, *then* only user or
    assistant roles (trimmed, lower case) with non-empty trimmed content.

    ``row_number() <= keep`` is planned with a map-side group limit: every task
    keeps at most ``keep`` rows per conversation before the shuffle.
    """
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep)
    role = F.lower(py_strip(F.col("role").cast("string")))
    content = py_strip(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return last.select("conv_id", "turn", role.alias("role"), content.alias("content")).where(
        F.col("role").isin(*HISTORY_ROLES) & (F.col("content") != "")
    )


def chat_payload(
    messages: DataFrame,
    model: str,
    system_prompt: str = DEFAULT_SYSTEM_PROMPT,
    dataset_context: DataFrame | None = None,
    dataset_prompt: str = DEFAULT_DATASET_PROMPT,
) -> DataFrame:
    """One JSON request per conversation for its last user message.

    The last *user* message (highest turn with that role) is the new message;
    the messages before it are the history, trimmed by C4. One window ranks a
    conversation's messages once. With ``dataset_context`` (conv_id, context)
    the dataset instructions and context come first, else the general
    instructions. Output: (conv_id, payload).
    """
    role = F.lower(py_strip(F.col("role").cast("string")))
    asked = messages.where(role == "user").groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("_q"))
    asked = asked.select(F.col("conv_id").alias("_conv"), F.col("_q.turn").alias("_last"), F.col("_q.text").alias("_new"))
    new = asked.select(F.col("_conv").alias("conv_id"), "_new")
    m = messages.join(asked.drop("_new"), F.col("conv_id").eqNullSafe(F.col("_conv"))).where(F.col("turn") < F.col("_last"))
    hist = recent_history(m.drop("_last", "_conv"))
    hist_arr = hist.groupBy("conv_id").agg(  # at most HISTORY_KEEP rows per conversation
        F.sort_array(F.collect_list(F.struct("turn", "role", "content"))).alias("_h")
    )
    base = new.join(hist_arr.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    if dataset_context is not None:
        base = base.join(dataset_context.select("conv_id", "context"), "conv_id", "left")
        system = F.when(
            F.col("context").isNotNull() & (F.col("context") != ""),
            F.array(
                F.struct(F.lit("system").alias("role"), F.lit(dataset_prompt).alias("content")),
                F.struct(F.lit("system").alias("role"), F.concat(F.lit("DATASET_CONTEXT:\n"), F.col("context")).alias("content")),
            ),
        ).otherwise(F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content"))))
    else:
        system = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
    history = F.transform(F.coalesce(F.col("_h"), F.array().cast("array<struct<turn:bigint,role:string,content:string>>")),
                          lambda h: F.struct(h.role.alias("role"), h.content.alias("content")))
    new_msg = F.array(F.struct(F.lit("user").alias("role"), F.col("_new").alias("content")))
    payload = F.struct(
        F.lit(model).alias("model"),
        F.lit(CHAT_TEMPERATURE).alias("temperature"),
        F.lit(CHAT_MAX_TOKENS).alias("max_tokens"),
        F.concat(system, history, new_msg).alias("messages"),
    )
    return base.select("conv_id", F.to_json(payload).alias("payload"))
