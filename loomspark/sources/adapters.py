"""Seven session formats to raw events, declared as column expressions.

A format is a probe on a file's first record and a function from one parsed record to an array of outputs (events and exclusions).
Lines are parsed to VARIANT once; context that earlier records of a file set (session, parent, folder, title) is
carried forward per block of a file and then across blocks, and events are numbered the same way, so that one
huge file is many groups.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions.text import session_from_filename

OUT = "struct<kind:string,suffix:string,role:string,event_type:string,content:string,call_id:string,tool_name:string,actor_hint:string,flags:array<string>,lane:string>"
CONTEXT = ("session_id", "parent_session_id", "working_dir", "title")
#: Bytes of a file whose records are ordered together.
BLOCK_BYTES = 32 << 20


def text_at(path: str, v: str = "v") -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', 'string')")


def raw_at(path: str, v: str = "v") -> Column:
    """A value as text: strings as they are, anything else as JSON with sorted keys, null for none."""
    value = F.expr(f"try_variant_get({v}, '$.{path}', 'variant')")
    kind = F.expr(f"schema_of_variant(try_variant_get({v}, '$.{path}', 'variant'))")
    return F.when(kind == "STRING", text_at(path, v)).when(value.isNotNull() & (kind != "VOID"), F.to_json(value))


def array_at(path: str, v: str = "v") -> Column:
    return F.expr(f"try_variant_get({v}, '$.{path}', 'array<variant>')")


def subset(keys: str, base: str = "", v: str = "v") -> Column:
    """JSON of the listed fields that are there."""
    fields = [F.expr(f"CASE WHEN NOT is_variant_null(try_variant_get({v}, '$.{base}{k}', 'variant')) THEN try_variant_get({v}, '$.{base}{k}', 'variant') END").alias(k) for k in sorted(keys.split())]
    return F.to_json(F.struct(*fields))


def block_text(block: str) -> Column:
    """The text of a content block: itself, or its first text field."""
    plain = F.expr(f"CASE WHEN schema_of_variant({block}) = 'STRING' THEN {block}::string END")
    named = [F.expr(f"CASE WHEN schema_of_variant(try_variant_get({block}, '$.{k}', 'variant')) = 'STRING' THEN try_variant_get({block}, '$.{k}', 'string') END") for k in ("text", "content", "input_text", "output_text", "message")]
    return F.coalesce(plain, *named, F.lit(""))


def message_text(path: str, v: str = "v") -> Column:
    """The texts of a message's blocks joined by line feeds, or its plain text."""
    parts = F.transform(array_at(path, v), lambda b: _block_text_of(b))
    return F.coalesce(F.array_join(F.filter(parts, lambda s: s != ""), "\n"), raw_at(path, v), F.lit(""))


def _block_text_of(b: Column) -> Column:
    string = lambda c, k: F.when(F.schema_of_variant(F.try_variant_get(c, f"$.{k}", "variant")) == "STRING", F.try_variant_get(c, f"$.{k}", "string"))
    return F.coalesce(F.when(F.schema_of_variant(b) == "STRING", F.try_variant_get(b, "$", "string")), *[string(b, k) for k in ("text", "content", "input_text", "output_text", "message")], F.lit(""))


def out(kind="event", suffix="", role=None, event_type=None, content=None, call_id=None, tool_name=None, actor_hint=None, flags=None, lane=None) -> Column:
    """One output; for exclusions ``content`` is the reason."""
    c = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(
        c(kind).alias("kind"), c(suffix).alias("suffix"), c(role).alias("role"), c(event_type).alias("event_type"), c(content).alias("content"), c(call_id).alias("call_id"), c(tool_name).alias("tool_name"),
        c(actor_hint).alias("actor_hint"), (flags if flags is not None else F.array().cast("array<string>")).alias("flags"), c(lane).alias("lane"),
    ).cast(OUT)


def excluded(reason, suffix="") -> Column:
    return out("excluded", suffix, content=reason)


def one(c: Column) -> Column:
    return F.array(c)


def cases(*pairs: tuple[Column, Column], otherwise: Column) -> Column:
    """The array of the first condition that holds."""
    return reduce(lambda chain, p: chain.when(*p), pairs[1:], F.when(*pairs[0])).otherwise(otherwise)


_FLAGS = lambda *names: F.array(*map(F.lit, names))


def codex(v: str = "v") -> Column:
    kind, item, event, role = text_at("type"), text_at("payload.type"), F.coalesce(text_at("payload.type"), F.lit("")), F.coalesce(text_at("payload.role"), F.lit("unknown"))
    lane, call = "codex-response-item", F.coalesce(text_at("payload.call_id"), text_at("payload.id"))
    block_type = lambda b: F.try_variant_get(b, "$.type", "string")
    blocks = F.coalesce(array_at("payload.content"), F.array().cast("array<variant>"))
    visible = F.filter(blocks, lambda b: F.coalesce(block_type(b), F.lit("text")).isin("input_text", "output_text", "text"))
    body = F.array_join(F.filter(F.transform(visible, _block_text_of), lambda s: s != ""), "\n")
    hint = F.when(role == "user", "unknown_user")
    said = F.when(body != "", one(out(role=F.when(role.isin("user", "assistant"), role).otherwise("unknown"), event_type="message", content=body, actor_hint=hint, flags=_FLAGS("possible_duplicate"), lane=lane))).otherwise(F.array().cast(f"array<{OUT}>"))
    files = F.transform(F.filter(blocks, lambda b: block_type(b).isin("input_image", "image", "audio", "input_audio")), lambda b: out(role=F.when(role.isin("user", "assistant"), role).otherwise("observer"), event_type="attachment", content=F.to_json(b), actor_hint=hint, lane=lane))
    name = F.coalesce(text_at("payload.name"), text_at("payload.tool_name"), item)
    response = cases(
        ((item == "message") & role.isin("developer", "system"), one(excluded("runtime_instruction"))),
        (item == "message", F.concat(said, files)),
        (item.isin("function_call", "custom_tool_call", "local_shell_call", "mcp_tool_call"), one(out(role="assistant", event_type=F.when(name.isin("apply_patch", "patch"), "patch").otherwise("tool_call"), content=F.coalesce(raw_at("payload.arguments"), raw_at("payload.input"), F.lit("")), call_id=call, tool_name=name, lane=lane))),
        (item.isin("function_call_output", "custom_tool_call_output", "mcp_tool_call_output"), one(out(role="tool", event_type="tool_result", content=F.coalesce(raw_at("payload.output"), raw_at("payload.result"), F.lit("")), call_id=call, lane=lane))),
        (item.isin("web_search_call", "computer_call", "computer_tool_call"), one(out(role="assistant", event_type="browser", content=subset("action query status url", "payload.")))),
        (item == "tool_search_call", one(out(role="assistant", event_type="tool_call", content=subset("query name result output status", "payload."), call_id=call, tool_name=item))),
        (item == "tool_search_output", one(out(role="tool", event_type="tool_result", content=subset("query name result output status", "payload."), call_id=call, tool_name=item))),
        (item == "agent_message", one(out(role="assistant", event_type="message", content=F.coalesce(raw_at("payload.message"), raw_at("payload.content"), subset("text status", "payload.")), actor_hint="subagent", flags=_FLAGS("subagent"), lane="codex-inter-agent"))),
        (item == "reasoning", one(excluded("hidden_reasoning_or_summary"))),
        otherwise=one(excluded(F.concat(F.lit("unsupported_codex_response_item:"), F.coalesce(item, F.lit("None"))))),
    )
    spoken = F.coalesce(raw_at("payload.message"), raw_at("payload.content"), F.lit(""))
    lane = "codex-event-message"
    seen = lambda kind, keys, role="observer": one(out(role=role, event_type=kind, content=subset(keys, "payload.")))
    happened = cases(
        (event == "context_compacted", one(excluded("compacted_summary"))),
        (event.isin("agent_reasoning", "token_count", "thread_settings_applied"), one(excluded("runtime_or_reasoning"))),
        (event == "user_message", one(out(role="user", event_type="message", content=spoken, actor_hint="native_user", lane=lane))),
        (event == "agent_message", one(out(role="assistant", event_type="message", content=spoken, lane=lane))),
        (event.isin("patch_apply_begin", "patch_apply_end"), seen("patch", "changes stdout stderr status success", "tool")),
        (event.contains("web_search") | event.contains("browser"), seen("browser", "query url status result")),
        (event.contains("device") | event.contains("computer"), seen("device", "action status result device")),
        (event.isin("task_complete", "task_completed"), one(out(role="observer", event_type="delivery", content=F.coalesce(raw_at("payload.last_agent_message"), raw_at("payload.message"), subset("status result", "payload."))))),
        (event.isin("turn_aborted", "error"), seen("error", "reason error message")),
        (event.isin("task_started", "goal_status", "thread_rolled_back"), seen("status", "status goal reason")),
        (event == "sub_agent_activity", one(out(role="observer", event_type="status", content=subset("status task_name message agent_id result", "payload."), actor_hint="subagent", flags=_FLAGS("subagent")))),
        (event == "mcp_tool_call_end", seen("browser", "action query url status tool_name result")),
        (event == "image_generation_end", seen("attachment", "saved_path status revised_prompt call_id")),
        otherwise=one(excluded(F.concat(F.lit("unsupported_codex_event:"), event))),
    )
    return cases(
        (kind == "session_meta", one(excluded("session_metadata"))),
        (kind == "compacted", one(excluded("compacted_summary"))),
        (kind.isin("turn_context", "world_state"), one(excluded("runtime_context"))),
        (kind == "response_item", response),
        (kind == "event_msg", happened),
        otherwise=one(excluded(F.concat(F.lit("unsupported_codex_envelope:"), F.coalesce(kind, F.lit("None"))))),
    )


def _blocks(role: Column, each: Callable[[Column, Column], Column], path: str = "message.content") -> Column:
    """Outputs of a message's content blocks; a plain text is one block."""
    plain = F.array(F.expr(f"try_variant_get(v, '$.{path}', 'variant')"))
    return F.transform(F.coalesce(array_at(path), plain), lambda b, i: each(b, F.concat(F.lit(".content["), i, F.lit("]"))))


def _block_out(b: Column, suffix: Column, role: Column, hint: Column | None, flags: Column, lane: str, patches: tuple[str, ...], brand: str, call_hint: Column | None = None, tool_lane: str | None = None) -> Column:
    get = lambda k: F.try_variant_get(b, f"$.{k}", "string")
    body = lambda k: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(b, f"$.{k}", "variant")) == "STRING", get(k)), F.to_json(F.try_variant_get(b, f"$.{k}", "variant")), F.lit(""))
    kind, name = get("type"), F.coalesce(get("name"), F.lit("tool"))
    inner = F.coalesce(F.array_join(F.filter(F.transform(F.try_variant_get(b, "$.content", "array<variant>"), _block_text_of), lambda s: s != ""), "\n"), body("content"))
    is_text = (F.schema_of_variant(b) == "STRING") | (kind == "text")
    return (
        F.when(is_text, out(suffix=suffix, role=role, event_type="message", content=_block_text_of(b), actor_hint=hint, flags=flags, lane=lane))
        .when(kind.isin("thinking", "reasoning"), excluded("hidden_reasoning", suffix))
        .when(kind == "tool_use", out(suffix=suffix, role="assistant", event_type=F.when(name.isin(*patches), "patch").otherwise("tool_call"), content=body("input"), call_id=get("id"), tool_name=name, actor_hint=call_hint, flags=flags, lane=tool_lane))
        .when(kind == "tool_result", out(suffix=suffix, role="tool", event_type=F.when(F.coalesce(F.try_variant_get(b, "$.is_error", "boolean"), F.lit(False)), "error").otherwise("tool_result"), content=inner, call_id=F.coalesce(get("tool_use_id"), get("id") if brand == "cursor" else F.lit(None)), actor_hint=call_hint, flags=flags, lane=tool_lane))
        .when(kind.isin("image", "document", "attachment", "file"), out(suffix=suffix, role=role, event_type="attachment", content=F.to_json(b), flags=flags, lane=tool_lane))
        .otherwise(excluded(F.concat(F.lit(f"unsupported_{brand}_block:"), F.coalesce(kind, F.lit(""))), suffix))
    )


def claude(v: str = "v", lane: str = "claude-code") -> Column:
    kind = text_at("type")
    side = F.coalesce(F.expr("try_variant_get(v, '$.isSidechain', 'boolean')"), F.lit(False))
    role = F.coalesce(text_at("message.role"), kind)
    flags = F.when(side, _FLAGS("sidechain", "subagent")).otherwise(F.array().cast("array<string>"))
    hint, call_hint = F.when(side, "subagent").when(role == "user", "native_user"), F.when(side, "subagent")
    other = lane if lane != "claude-code" else None
    told = _blocks(role, lambda b, s: _block_out(b, s, role, hint, flags, lane, ("Edit", "Write", "apply_patch"), "claude", call_hint, other))
    plain = lambda role, event_type, keys: one(out(role=role, event_type=event_type, content=subset(keys), flags=flags, lane=other))
    return cases(
        (kind == "ai-title", one(excluded("session_title_metadata"))),
        (kind.isin("mode", "permission-mode", "last-prompt"), one(excluded("runtime_or_duplicate_metadata"))),
        ((kind == "system") & F.coalesce(text_at("subtype"), F.lit("")).isin("compact_boundary", "summary"), one(excluded("compacted_summary"))),
        (kind == "system", one(excluded("runtime_instruction"))),
        (kind.isin("user", "assistant"), told),
        (kind == "attachment", plain("user", "attachment", "fileName filePath mimeType size")),
        (kind == "file-history-snapshot", plain("observer", "patch", "snapshot messageId trackedFileBackups")),
        (kind == "queue-operation", plain("observer", "status", "operation status")),
        otherwise=one(excluded(F.concat(F.lit("unsupported_claude_record:"), F.coalesce(kind, F.lit("None"))))),
    )


def neo(v: str = "v") -> Column:
    return claude(v, "neo-claude-runtime")


def workbuddy(v: str = "v") -> Column:
    kind, role, name, call = text_at("type"), F.coalesce(text_at("role"), F.lit("unknown")), text_at("name"), F.coalesce(text_at("callId"), text_at("id"))
    body = message_text("content")
    return cases(
        (kind == "ai-title", one(excluded("session_title_metadata"))),
        ((kind == "message") & (body != ""), one(out(role=role, event_type="message", content=body, actor_hint=F.when(role == "user", "native_user"), lane="workbuddy"))),
        (kind == "message", F.array().cast(f"array<{OUT}>")),
        (kind == "function_call", one(out(role="assistant", event_type=F.when(name.isin("apply_patch", "Edit", "Write"), "patch").otherwise("tool_call"), content=F.coalesce(raw_at("arguments"), F.lit("")), call_id=call, tool_name=F.coalesce(name, F.lit("tool"))))),
        (kind == "function_call_result", one(out(role="tool", event_type="tool_result", content=F.coalesce(raw_at("output"), F.lit("")), call_id=call, tool_name=name))),
        (kind == "reasoning", one(excluded("hidden_reasoning"))),
        (kind == "file-history-snapshot", one(out(role="observer", event_type="patch", content=subset("snapshot messageId files")))),
        otherwise=one(excluded(F.concat(F.lit("unsupported_workbuddy_record:"), F.coalesce(kind, F.lit("None"))))),
    )


def cursor(v: str = "v") -> Column:
    kind, role, lane = text_at("type"), F.coalesce(text_at("role"), F.lit("unknown")), "cursor-agent-transcript"
    has_message = F.expr("schema_of_variant(try_variant_get(v, '$.message', 'variant'))").startswith("OBJECT")
    none = F.array().cast("array<string>")
    told = _blocks(role, lambda b, s: _block_out(b, s, role, F.when(role == "user", "native_user"), none, lane, ("apply_patch", "Edit", "Write"), "cursor", None, lane))
    return cases(
        (role.isin("user", "assistant") & has_message, told),
        (kind == "turn_ended", one(out(role="observer", event_type="status", content=subset("status reason"), lane=lane))),
        (kind == "system", one(excluded("runtime_instruction"))),
        (kind.isin("summary", "compaction"), one(excluded("compacted_summary"))),
        otherwise=one(excluded(F.concat(F.lit("unsupported_cursor_record:"), F.coalesce(kind, role)))),
    )


def _context_codex() -> dict[str, Column]:
    meta = lambda c: F.when(text_at("type") == "session_meta", c)
    return {"session_id": meta(F.coalesce(text_at("payload.session_id"), text_at("payload.id"))), "parent_session_id": meta(F.coalesce(text_at("payload.parent_thread_id"), text_at("payload.parent_session_id"))), "working_dir": meta(text_at("payload.cwd")), "title": meta(text_at("payload.title"))}


def _context_plain() -> dict[str, Column]:
    return {"session_id": text_at("sessionId"), "parent_session_id": text_at("parentSessionId"), "working_dir": text_at("cwd"), "title": F.when(text_at("type") == "ai-title", F.coalesce(text_at("title"), text_at("content")))}


def _context_none() -> dict[str, Column]:
    return {c: F.lit(None).cast("string") for c in CONTEXT}


#: Line formats: record to outputs, record to context.
LINE_FORMATS: dict[str, tuple[Callable[[], Column], Callable[[], dict[str, Column]]]] = {
    "codex-jsonl": (codex, _context_codex), "claude-code-jsonl": (claude, _context_plain), "neo-claude-jsonl": (neo, _context_plain), "workbuddy-jsonl": (workbuddy, _context_plain), "cursor-agent-jsonl": (cursor, _context_none),
}


#: The seven formats: five of lines, two of whole documents.
ADAPTERS = (*LINE_FORMATS, "clacky-json", "clacky-chunk")


def probe_scores(first: DataFrame) -> DataFrame:
    """path, adapter, score of files by their first record: path, v (variant of the first record), head (first lines as text)."""
    kind, has = text_at("type"), lambda p: F.expr(f"try_variant_get(v, '$.{p}', 'variant') IS NOT NULL")
    low = F.lower("path")
    claude_like = kind.isin("mode", "user", "assistant", "permission-mode", "file-history-snapshot") & (has("sessionId") | has("message"))
    queue = F.col("head").rlike(r'"type"\s*:\s*"queue-operation"')
    sdk = F.col("head").rlike(r'"entrypoint"\s*:\s*"sdk-ts"') & F.col("head").rlike(r'"userType"\s*:\s*"external"')
    in_neo = low.contains("/.neo/") & low.contains("/projects/")
    scores = {
        "codex-jsonl": F.when(kind.isin("session_meta", "response_item", "event_msg", "turn_context") & has("payload"), 100),
        "claude-code-jsonl": F.when(claude_like, 98),
        "workbuddy-jsonl": F.when(kind.isin("message", "function_call", "function_call_result", "reasoning", "ai-title") & has("sessionId") & (has("providerData") | has("role")), 99),
        "neo-claude-jsonl": F.when(in_neo & (claude_like | queue | sdk), 100).when(queue & sdk, 97),
        "cursor-agent-jsonl": F.when(text_at("role").isin("user", "assistant") & (F.size(F.coalesce(array_at("message.content"), F.array().cast("array<variant>"))) > 0), F.when(low.contains("/agent-transcripts/"), 100).otherwise(96)),
    }
    pairs = F.array(*[F.struct(F.lit(a).alias("adapter"), F.coalesce(s, F.lit(0)).alias("score")) for a, s in scores.items()])
    return first.select("path", F.explode(pairs).alias("p")).select("path", "p.*").filter("score > 0")


def identify(first: DataFrame) -> DataFrame:
    """path, adapter of the files one adapter wins; a tie at the top identifies nothing."""
    ranked = probe_scores(first).groupBy("path").agg(F.max("score").alias("top"), F.collect_list(F.struct("adapter", "score")).alias("all"))
    best = F.filter("all", lambda a: a["score"] == F.col("top"))
    return ranked.withColumn("best", best).filter("size(best) = 1").select("path", F.col("best")[0]["adapter"].alias("adapter"))


def _carried_and_numbered(rows: DataFrame) -> DataFrame:
    """Context and sequence across the blocks of a file: within a block by a window, before it by the blocks' own summaries."""
    order = ["byte_offset", "at"]
    rows = rows.withColumn("block", F.floor(F.col("byte_offset") / BLOCK_BYTES))
    ends = rows.groupBy("path", "block").agg(F.count_if(F.col("o.kind") == "event").alias("n"), *[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in CONTEXT])
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), *[F.last(c, ignorenulls=True).over(before).alias(f"{c}0") for c in CONTEXT])
    here = Window.partitionBy("path", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(starts, ["path", "block"])
    carried = {c: F.coalesce(F.last(c, ignorenulls=True).over(here), F.col(f"{c}0")) for c in CONTEXT}
    return joined.withColumns({**carried, "sequence": F.col("n0") + F.count_if(F.col("o.kind") == "event").over(here)})


def parse_lines(lines: DataFrame, files: DataFrame) -> DataFrame:
    """Tagged rows of line-format files: kind (event, excluded, error), and a raw event's fields; ``reason`` for the other kinds.

    lines: path, byte_offset, line, terminated; files: path, adapter.  Blank lines are no records.
    """
    rows = lines.join(files, "path").filter(r"NOT line RLIKE '^\\s*\\z'").withColumn("v", F.expr("try_parse_json(line)"))
    last = lines.filter("NOT terminated").select("path", "byte_offset", F.lit(True).alias("is_tail"))
    rows = rows.join(last, ["path", "byte_offset"], "left")
    kind = F.expr("schema_of_variant(v)")
    broken = F.when(F.col("v").isNull(), F.when(F.col("is_tail"), excluded("incomplete_jsonl_tail")).otherwise(out("error", content="json_decode_error"))).when(~kind.startswith("OBJECT"), out("error", content="jsonl_record_not_object"))
    none = F.lit(None).cast(f"array<{OUT}>")
    outs, context = none, {c: F.lit(None).cast("string") for c in CONTEXT}
    for adapter, (parse, carry) in LINE_FORMATS.items():
        outs = F.when(F.col("adapter") == adapter, parse()).otherwise(outs)
        context = {c: F.when(F.col("adapter") == adapter, value).otherwise(context[c]) for c, value in carry().items()}
    # a record without outputs still carries context
    nothing = F.array(out("none"))
    outs = F.when(broken.isNotNull(), F.array(broken)).otherwise(F.coalesce(F.when(F.size(outs) > 0, outs), nothing))
    flat = rows.select("path", "adapter", "byte_offset", F.coalesce(text_at("timestamp"), text_at("payload.timestamp")).alias("timestamp"), *[v.alias(c) for c, v in context.items()], F.posexplode(outs).alias("at", "o"))
    done = _carried_and_numbered(flat).filter("o.kind <> 'none'")
    return done.select(
        F.col("o.kind").alias("kind"), "path", "adapter", F.coalesce("session_id", session_from_filename(F.col("path"))).alias("session_id"), "parent_session_id", F.when(F.col("o.kind") == "event", F.col("sequence")).alias("sequence"),
        F.concat(F.lit("byte:"), F.col("byte_offset"), F.col("o.suffix")).alias("record_locator"), F.when(F.col("adapter") != "cursor-agent-jsonl", F.col("timestamp")).alias("timestamp"), "o.role", "o.event_type",
        F.when(F.col("o.kind") == "event", F.col("o.content")).alias("content"), F.when(F.col("o.kind") != "event", F.col("o.content")).alias("reason"), "o.call_id", "o.tool_name", "o.actor_hint", "o.flags", "working_dir", F.col("title").alias("session_title"),
        F.when(F.col("o.lane").isNotNull(), F.create_map(F.lit("transport_lane"), F.col("o.lane"))).otherwise(F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def parse_clacky_json(docs: DataFrame) -> DataFrame:
    """Events of whole-document sessions: path, value (the file's text).  Columns path, session_id, sequence, record_locator, role, event_type, content, call_id, tool_name, timestamp."""
    doc = docs.withColumn("d", F.expr("try_parse_json(value)")).withColumn("messages", array_at("messages", "d")).filter("messages IS NOT NULL")
    rows = doc.select("path", F.coalesce(text_at("session_id", "d"), session_from_filename(F.col("path"))).alias("session_id"), text_at("working_dir", "d").alias("working_dir"), text_at("created_at", "d").alias("created_at"), F.posexplode("messages").alias("n", "v"))
    role = F.coalesce(text_at("role"), F.lit("unknown"))
    kept = rows.filter((role != "system") & text_at("compressed_summary").isNull() & ~F.coalesce(F.expr("try_variant_get(v, '$.system_injected', 'boolean')"), F.lit(False)))
    body = message_text("content")
    said = F.when(body != "", F.array(out(role=F.when(role.isin("user", "assistant", "tool"), role).otherwise("unknown"), event_type=F.when(role == "tool", "tool_result").otherwise("message"), content=body, call_id=text_at("tool_call_id"), actor_hint=F.when(role == "user", "native_user"), lane="clacky-json"))).otherwise(F.array().cast(f"array<{OUT}>"))
    get = lambda c, k: F.try_variant_get(c, f"$.{k}", "string")

    def call(c: Column, i: Column) -> Column:
        name = F.coalesce(get(c, "function.name"), get(c, "name"), F.lit("tool"))
        return out(suffix=F.concat(F.lit(".tool_calls["), i, F.lit("]")), role="assistant", event_type=F.when(name.isin("apply_patch", "patch"), "patch").otherwise("tool_call"), content=F.coalesce(get(c, "function.arguments"), get(c, "arguments"), F.lit("")), call_id=F.coalesce(get(c, "id"), get(c, "tool_call_id")), tool_name=name, lane="clacky-json")

    calls = F.transform(F.coalesce(array_at("tool_calls"), F.array().cast("array<variant>")), call)
    flat = kept.select("path", "session_id", "working_dir", F.coalesce(text_at("timestamp"), F.col("created_at")).alias("timestamp"), "n", F.posexplode(F.concat(said, calls)).alias("at", "o"))
    number = F.row_number().over(Window.partitionBy("path").orderBy("n", "at")).cast("bigint")
    return flat.select("path", "session_id", number.alias("sequence"), F.concat(F.lit("messages["), F.col("n"), F.lit("]"), F.col("o.suffix")).alias("record_locator"), "o.role", "o.event_type", "o.content", "o.call_id", "o.tool_name", "timestamp", "working_dir")


def parse_clacky_chunk(docs: DataFrame) -> DataFrame:
    """Events of Markdown chunks: sections by speaker, with embedded calls and results.  path, value as above.

    What stands before the first speaker's heading (all of it, where there is none) is a section of an unknown speaker, without its front matter.
    """
    session = F.nullif(F.regexp_extract("value", r"(?m)\A[\s\S]{0,4000}?^session_id:\s*['\"]?([^'\"\s]+)", 1), F.lit(""))
    sections = F.split(F.concat(F.lit("\n"), F.col("value")), r"(?im)^##\s+(?=(?:User|Assistant)\s*$)")
    rows = docs.select("path", F.coalesce(session, session_from_filename(F.col("path"))).alias("session_id"), F.posexplode(sections).alias("n", "section"))
    headed = F.col("section").rlike(r"(?i)^(?:user|assistant)[ \t]*(?:\r?\n|\z)") & (F.col("n") > 0)
    front = r"^\s*(?:---[ \t]*\r?\n[\s\S]*?\r?\n---[ \t]*(?:\r?\n|\z)|(?:[A-Za-z_]+:[^\n]*(?:\r?\n|\z))+)"
    rows = rows.withColumn("role", F.when(headed, F.lower(F.regexp_extract("section", r"^(\w+)", 1))).otherwise("unknown"))
    rows = rows.withColumn("section", F.when(headed, F.regexp_replace("section", r"^\w+[^\n]*\n?", "")).otherwise(F.regexp_replace("section", front, "")))
    parts = rows.select("path", "session_id", "n", "role", F.posexplode(F.split("section", r"(?im)(?=^_Tool calls?:|^###\s+Tool Result:)")).alias("at", "part"))
    call, result = F.regexp_extract("part", r"(?i)^_(?:Tool calls?:)?\s*(.*?)_[ \t]*(?:\n|\z)", 1), F.regexp_extract("part", r"(?i)^###\s+Tool Result:[ \t]*([^\n]+)", 1)
    is_call, is_result = F.col("part").rlike(r"(?i)^_Tool calls?:"), result != ""
    rest = F.trim(F.regexp_replace("part", r"(?i)^_Tool calls?:[^\n]*\n?", ""), F.lit(" \n\r\t"))
    none = F.array().cast(f"array<{OUT}>")
    spoken = lambda c: F.when(c != "", F.array(out(role=F.col("role"), event_type="message", content=c, actor_hint=F.when(F.col("role") == "user", "unknown_user"), flags=_FLAGS("possible_duplicate"), lane="clacky-chunk"))).otherwise(none)
    told = (
        F.when(is_call, F.concat(F.array(out(role="assistant", event_type="tool_call", content=F.trim(call), tool_name="clacky-embedded-tools", lane="clacky-chunk")), spoken(rest)))
        .when(is_result, F.array(out(role="tool", event_type="tool_result", content=F.trim(F.regexp_replace("part", r"(?i)^###[^\n]*\n?", ""), F.lit(" \n\r\t")), tool_name=F.trim(result), lane="clacky-chunk")))
        .otherwise(spoken(F.trim("part", F.lit(" \n\r\t"))))
    )
    flat = parts.select("path", "session_id", "n", "at", F.posexplode(told).alias("k", "o")).filter("o.content <> ''")
    number = F.row_number().over(Window.partitionBy("path").orderBy("n", "at", "k")).cast("bigint")
    return flat.select("path", "session_id", number.alias("sequence"), F.concat(F.lit("section:"), F.col("n"), F.lit(".part:"), F.col("at") + 1).alias("record_locator"), "o.role", "o.event_type", "o.content", "o.tool_name")


def read_sessions(spark: SparkSession, root: str) -> DataFrame:
    """All line-format session files under ``root`` as tagged rows."""
    from loomspark.sources.lines import register

    register(spark)
    lines = spark.read.format("session_lines").load(root)
    heads = lines.filter(r"byte_offset < 131072 AND NOT line RLIKE '^\\s*\\z'")
    first = heads.groupBy("path").agg(F.min_by("line", "byte_offset").alias("first"), F.array_join(F.slice(F.array_sort(F.collect_list(F.struct("byte_offset", "line"))), 1, 32)["line"], "\n").alias("head"))
    files = identify(first.withColumn("v", F.expr("try_parse_json(first)")).filter("v IS NOT NULL"))
    return parse_lines(lines, files)
