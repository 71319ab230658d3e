"""Event -> fact normalisation (P1-P10, P13, C3) and the ingest step as a whole.

``to_facts`` maps a parsed call-event struct to fact columns with column
expressions only.  ``ingest`` = parse -> validate -> normalise, returning the
accepted fact rows and the per-event lifecycle rows (M2) from one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cost import call_cost
from ..functions.pii import PII_TYPES, detections
from ..functions.normalize import (input_hash, input_preview, output_preview, provider_enum,
                                   provider_raw, status_upper, total_tokens, truncate_error_message)
from ..schemas import DETECTION, ERROR_MESSAGE_CHARS
from ..sources.events import BAD, CORRUPT
from .redact import SEPARATOR, SEPARATOR_RX, barrier, pack_text, redact_column, unpack_text
from .validate import call_event_rules, with_reasons


def to_facts(parsed: DataFrame, e: str = "e", received_at: str = "received_at",
             recompute_cost: bool = False) -> DataFrame:
    """Fact rows from parsed events; ``created_at`` = receive time (replays are deterministic)."""
    return parsed.select(*fact_columns(parsed.columns, e, received_at, recompute_cost))


def fact_columns(names: list[str], e: str = "e", received_at: str = "received_at", recompute_cost: bool = False) -> list[Column]:
    """The columns of ``to_facts``; a job builds them once and selects them from each batch."""
    c = lambda f: F.col(f"{e}.{f}")
    prompt = c("usage.prompt_tokens")
    completion = c("usage.completion_tokens")
    cost = (call_cost(provider_raw(c("provider")), F.coalesce(c("model"), F.lit("unknown")), prompt, completion)
            if recompute_cost else c("cost_usd").try_cast("decimal(12,6)"))
    return [
        *[F.col(x) for x in ("event_id",) if x in names],
        c("id").alias("id"),
        c("conversation_id").alias("conversation_id"),
        c("session_id").alias("session_id"),
        provider_enum(c("provider")).alias("provider"),
        provider_raw(c("provider")).alias("provider_raw"),
        F.coalesce(c("model"), F.lit("unknown")).alias("model"),
        status_upper(c("status")).alias("status"),
        c("error.type").alias("error_type"),
        truncate_error_message(c("error.message")).alias("error_message"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        total_tokens(prompt, completion).alias("total_tokens"),
        cost.alias("cost_usd"),
        F.coalesce(c("latency_ms").try_cast("int"), F.lit(0)).alias("latency_ms"),
        c("ttft_ms").try_cast("int").alias("ttft_ms"),
        F.coalesce(c("streamed"), F.lit(False)).alias("streamed"),
        input_preview(c("request.messages"), c("request.prompt")).alias("input_preview"),
        output_preview(c("response.content")).alias("output_preview"),
        input_hash(c("request")).alias("input_hash"),
        F.coalesce(F.to_json(c("request")), F.lit("{}")).alias("request_payload"),
        F.coalesce(F.to_json(c("response")), F.lit("{}")).alias("response_payload"),
        F.coalesce(F.to_json(c("pii_detections")), F.lit("[]")).alias("pii_detections"),
        c("sdk_version").alias("sdk_version"),
        F.coalesce(c("environment"), F.lit("dev")).alias("environment"),
        F.try_to_timestamp(c("started_at")).alias("started_at"),
        F.try_to_timestamp(c("ended_at")).alias("ended_at"),
        F.col(received_at).alias("created_at"),
        c("metadata").alias("metadata"),
    ]


def check_events(raw: DataFrame, e: str = "e", parents: DataFrame | None = None, parent_key: str = "conversation_id") -> DataFrame:
    """V1-V8 on parsed events: adds ``reject_reasons`` (malformed JSON is a reason, not a drop).

    With ``parents``, an event that names a conversation they do not hold gets the reason ``unknown_conversation``
    (V8); one without a conversation needs none.
    """
    ok_json = F.col(e).isNotNull()
    fields = parsed_fields(raw, e)
    if CORRUPT in fields:
        ok_json = ok_json & F.col(f"{e}.{CORRUPT}").isNull()
    out = with_reasons(raw, [("malformed_json", ok_json)] + call_event_rules(e))
    if BAD in fields:
        out = out.withColumn("reject_reasons", F.concat("reject_reasons", F.coalesce(F.col(f"{e}.{BAD}"), F.array().cast("array<string>"))))
    return out if parents is None else check_parents(out, parents, e, parent_key)


def check_parents(checked: DataFrame, parents: DataFrame, e: str = "e", parent_key: str = "conversation_id") -> DataFrame:
    """V8: adds the reason ``unknown_conversation`` to checked events that name a conversation ``parents`` do not hold."""
    known = parents.select(F.col(parent_key).cast("string").alias("__parent")).distinct()
    out = checked.join(known, F.col(f"{e}.conversation_id") == F.col("__parent"), "left")
    orphan = F.col(f"{e}.conversation_id").isNotNull() & F.col("__parent").isNull()
    return out.withColumn("reject_reasons", F.when(orphan, F.array_append("reject_reasons", F.lit("unknown_conversation")))
                          .otherwise(F.col("reject_reasons"))).drop("__parent")


def lifecycle_of(checked: DataFrame, received_at: str = "received_at") -> DataFrame:
    """M2: PROCESSED with processed_at, or FAILED with the reasons (<= 500 chars) as error; a count of earlier attempts
    goes up by one."""
    ok = F.size("reject_reasons") == 0
    return checked.select(
        *[x for x in ("event_id",) if x in checked.columns], F.col(received_at),
        F.when(ok, F.lit("PROCESSED")).otherwise(F.lit("FAILED")).alias("status"),
        F.when(ok, F.col(received_at)).alias("processed_at"),
        F.when(~ok, F.substring(F.array_join("reject_reasons", ","), 1, ERROR_MESSAGE_CHARS)).alias("error"),
        *([(F.col("attempts") + 1).alias("attempts")] if "attempts" in checked.columns else []),
        F.col("reject_reasons"))


def facts_of(checked: DataFrame, e: str = "e", received_at: str = "received_at",
             recompute_cost: bool = False, columns: list[Column] | None = None) -> DataFrame:
    """The fact rows of accepted events; ``columns`` are their ``fact_columns`` if these are built already."""
    accepted = checked.filter(F.size("reject_reasons") == 0)
    return to_facts(accepted, e, received_at, recompute_cost) if columns is None else accepted.select(*columns)


def redact_events(parsed: DataFrame, e: str = "e") -> DataFrame:
    """R12 on parsed events: every string of the request (messages, names, prompt, extra values) and of the response
    is redacted before a fact is stored; what was found in the request, then in the response, follows the event's
    own detections.

    The strings of each part are joined, redacted in one pass of the chain and put back by place; an event
    without findings keeps its columns as they are.
    """
    request, response = F.col(f"{e}.request"), F.col(f"{e}.response")
    messages, extra = request["messages"], F.map_values(request["extra"])
    none = F.array().cast("array<string>")
    asked = F.concat(
        F.coalesce(F.flatten(F.transform(messages, lambda m: F.array(m["role"], m["content"], m["name"]))), none),
        F.array(request["prompt"]), F.coalesce(extra, none))
    told = F.array(response["content"], response["finish_reason"])

    def joined(texts):
        return F.array_join(F.transform(texts, lambda t: F.coalesce(pack_text(t), F.lit(""))), SEPARATOR)

    out = barrier(parsed.withColumns({"__ask": joined(asked), "__tell": joined(told)}))
    for col in ("__ask", "__tell"):
        out = redact_column(out, col, count_prefix=col, with_detections=False)
    found = {col: detections({n: F.col(col + n) for n in PII_TYPES}) for col in ("__ask", "__tell")}
    out = barrier(out.select(*parsed.columns, *(d.alias(c + "_found") for c, d in found.items()),
                             *(F.split(c, SEPARATOR_RX, -1).alias(c) for c in found)))
    n = F.coalesce(F.size(messages), F.lit(0))

    def put(old, col, at):
        return F.when(old.isNotNull(), unpack_text(F.element_at(col, at.cast("int") + F.lit(1))))

    names = ("role", "content", "name")
    clean_messages = F.transform(messages, lambda m, i: F.when(m.isNotNull(), F.struct(
        *(put(m[f], "__ask", i * F.lit(3) + F.lit(k)).alias(f) for k, f in enumerate(names)))))
    clean_extra = F.map_from_arrays(F.map_keys(request["extra"]), F.transform(extra, lambda v, i: put(v, "__ask", n * F.lit(3) + F.lit(1) + i)))
    clean_request = (request.withField("messages", clean_messages).withField("prompt", put(request["prompt"], "__ask", n * F.lit(3)))
                     .withField("extra", clean_extra))
    clean_response = response
    for k, f in enumerate(("content", "finish_reason")):
        clean_response = clean_response.withField(f, put(response[f], "__tell", F.lit(k)))
    all_found = F.concat(F.coalesce(F.col(f"{e}.pii_detections"), F.array().cast(T.ArrayType(DETECTION))), F.col("__ask_found"), F.col("__tell_found"))
    event = (F.col(e).withField("request", F.when(F.size("__ask_found") > 0, clean_request).otherwise(request))
             .withField("response", F.when(F.size("__tell_found") > 0, clean_response).otherwise(response))
             .withField("pii_detections", F.when(F.size(all_found) > 0, all_found)))
    return barrier(out.withColumn(e, F.when(F.col(e).isNotNull(), event)).drop("__ask", "__tell", "__ask_found", "__tell_found"))


def audit_rows(checked: DataFrame, e: str = "e", redact: bool = True) -> DataFrame:
    """Checked events as they are stored for audit, redacted unless switched off.

    The payload of a record that cannot be read is redacted as text, one with findings is written anew from the
    redacted event, any other stays byte for byte.
    """
    if not redact:
        return checked
    found = lambda: F.size(F.coalesce(F.col(f"{e}.pii_detections"), F.array().cast(T.ArrayType(DETECTION))))
    broken = F.col(e).isNull() | F.col(f"{e}.{CORRUPT}").isNotNull()
    own = checked.withColumns({"__own": found(), "__broken": F.when(broken, F.col("payload"))})
    own = redact_events(redact_column(own, "__broken", count_prefix="__n_", with_detections=False), e)
    clean = F.to_json(F.col(e).dropFields(CORRUPT, BAD))
    payload = F.when(F.col("__broken").isNotNull(), F.col("__broken")).when(found() > F.col("__own"), clean).otherwise(F.col("payload"))
    event = F.when(F.col(e).isNotNull(), F.col(e).withField(CORRUPT, F.col("__broken")))
    return own.withColumns({"payload": payload, e: event}).select(*checked.columns)


def ingest(raw: DataFrame, e: str = "e", received_at: str = "received_at",
           recompute_cost: bool = False, redact: bool = True, parents: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Validate parsed events (V8 against ``parents``, if given) and redact (R13: unless switched off) those accepted;
    return (fact rows, event lifecycle rows).  Both come from one evaluation of the rules."""
    checked = check_events(raw, e, parents)
    accepted = checked.filter(F.size("reject_reasons") == 0)
    return to_facts(redact_events(accepted, e) if redact else accepted, e, received_at, recompute_cost), lifecycle_of(checked, received_at)


def parsed_fields(df: DataFrame, e: str) -> list[str]:
    t = df.schema[e].dataType
    return [f.name for f in t.fields] if hasattr(t, "fields") else []


def live_row(facts: DataFrame) -> DataFrame:
    """Lean live-feed row (raw lower-case provider and status)."""
    return facts.select("id", F.col("provider_raw").alias("provider"), "model",
                        F.lower("status").alias("status"), "latency_ms", "ttft_ms", "prompt_tokens",
                        "completion_tokens", F.col("cost_usd").cast("double").alias("cost_usd"),
                        "conversation_id", "created_at")
