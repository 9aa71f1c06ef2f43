"""Queries of the evidence operators over the whole tables, named by the operator's id, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as fx
from loomspark.functions import tokens as tk
from loomspark.operators import evidence as ev
from loomspark.operators import context_units as cu
from loomspark.operators import lifecycle, ranges, retrieval, review, sanitize, search
from loomspark.operators.timestamps import known_zones, with_utc_micros
from loomspark.session import Scratch, spread, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table, each event once; copies of an event are equal but for the run that delivered them."""
    return table(spark, sf_dir, "unified_events").dropDuplicates(["event_id"])


_ONCE = "e AS (SELECT * FROM unified_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY source_file_id) = 1)"
_RAW_ONCE = "r AS (SELECT * FROM raw_events QUALIFY row_number() OVER (PARTITION BY raw_event_id ORDER BY source_file_id) = 1)"
_FILES_ONCE = "f AS (SELECT source_file_id, min(agent_name) AS agent_name FROM source_files GROUP BY 1)"
_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_COLLAPSED = f"trim(regexp_replace(content, '{_SPACE}', ' ', 'g'))"
_SEMANTIC = f"sha256({_COLLAPSED})"


# ---- projections -------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_ONCE} SELECT event_id, 'evt-' || substr(sha256(concat(source_file_id, chr(0), record_locator, chr(0), role, chr(0), event_type, chr(0), content_sha256, chr(0),
    coalesce(call_id, 'None'), chr(0))), 1, 32) AS content_id FROM e"""
)
def r_p01_event_ids(spark, sf_dir):
    """Content-addressed ids of all events."""
    return _events(spark, sf_dir).select("event_id", fx.event_id(*[F.col(c) for c in ("source_file_id", "record_locator", "role", "event_type", "content_sha256", "call_id")]).alias("content_id"))


@query(
    rf"""WITH {_RAW_ONCE}, {_FILES_ONCE},
    c AS (SELECT r.*, f.agent_name, rtrim(regexp_replace(trim(working_dir), '[\\/]+', '/', 'g'), '/') AS s FROM r LEFT JOIN f USING (source_file_id)),
    d AS (SELECT *, CASE WHEN regexp_matches(s, '^[A-Za-z]:/') THEN lower(s[1]) || s[2:] ELSE s END AS canonical, regexp_replace(working_dir, '[\\/]+$', '') AS tail,
      coalesce(working_dir, '') <> '' AND working_dir NOT IN ('~', '/', '.', 'unknown') AS by_dir, coalesce(project_id, '') <> '' AS by_id FROM c)
    SELECT raw_event_id, CASE WHEN by_dir THEN 'cwd:' || substr(sha256(concat(canonical, chr(0))), 1, 24)
      WHEN by_id THEN 'project:' || substr(sha256(concat(coalesce(agent_name, 'None'), chr(0), project_id, chr(0))), 1, 24) ELSE '' END AS key,
      CASE WHEN by_dir THEN string_split_regex(tail, '[\\/]')[-1] WHEN by_id THEN project_id ELSE 'Session ' || session_id[1:12] END AS label FROM d"""
)
def r_p08_project_identity(spark, sf_dir):
    """The project a raw event proposes, by its directory, its project id, or none."""
    files = table(spark, sf_dir, "source_files").groupBy("source_file_id").agg(F.min("agent_name").alias("agent_name"))
    raw = table(spark, sf_dir, "raw_events").dropDuplicates(["raw_event_id"]).join(files, "source_file_id", "left")
    return raw.select("raw_event_id", fx.project_identity(F.col("project_id"), F.col("working_dir"), F.col("agent_name"), F.col("session_id")).alias("i")).select("raw_event_id", "i.*")


@query(
    f"""WITH {_ONCE} SELECT event_id, CASE WHEN record_locator LIKE 'byte:%' OR record_locator LIKE 'section:%' THEN split_part(record_locator, '.', 1)
    WHEN regexp_matches(record_locator, '^messages\\[[0-9]+\\]') THEN regexp_extract(record_locator, '^messages\\[[0-9]+\\]') ELSE record_locator END AS locator FROM e"""
)
def r_p09_locators(spark, sf_dir):
    """The transport record of every event."""
    return _events(spark, sf_dir).select("event_id", fx.canonical_locator(F.col("record_locator")).alias("locator"))


@query(f"WITH {_ONCE} SELECT event_id, coalesce(tool_name, '') AS tool, CASE WHEN event_type IN ('message', 'attachment') THEN '' ELSE coalesce(call_id, '') END AS linkage, {_SEMANTIC} AS body FROM e")
def r_p10_semantic_keys(spark, sf_dir):
    """What mirrored copies of an event have in common."""
    key = fx.semantic_key(*[F.col(c) for c in ("logical_session_id", "role", "event_type", "tool_name", "call_id", "content")])
    return _events(spark, sf_dir).select("event_id", key.alias("k")).select("event_id", F.col("k.tool_name").alias("tool"), F.col("k.call_id").alias("linkage"), F.col("k.content").alias("body"))


@query(f"WITH {_ONCE} SELECT event_id, CASE WHEN length(content) > 200 THEN concat(content[1:200], ' … [sha256=', sha256(content), ']') ELSE content END AS excerpt FROM e")
def r_p11_excerpts(spark, sf_dir):
    """Contents cut for a page, with the hash of the whole."""
    return _events(spark, sf_dir).select("event_id", fx.excerpt(F.col("content"), 200).alias("excerpt"))


@query(
    r"""SELECT DISTINCT path, coalesce(nullif(regexp_extract(n, '[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}'), ''), regexp_replace(n, '-chunk-[0-9]+$', '')) AS session
    FROM (SELECT path, regexp_replace(string_split(path, '/')[-1], '\.[A-Za-z0-9]+$', '') AS n FROM source_files)"""
)
def r_p07_sessions_from_names(spark, sf_dir):
    """Session names read off file names."""
    return table(spark, sf_dir, "source_files").select("path", fx.session_from_filename(F.col("path")).alias("session")).distinct()


@query(f"WITH {_ONCE} SELECT event_id, list_sort(list_distinct(list_filter(list_transform(flags, lambda x: trim(x)), lambda x: x <> ''))) AS flags FROM e")
def r_p20_normal_flags(spark, sf_dir):
    """Trimmed, distinct, sorted flags."""
    return _events(spark, sf_dir).select("event_id", fx.normal_values(F.col("flags")).alias("flags"))


@query(
    f"""WITH {_ONCE} SELECT event_id, epoch_us(TRY_CAST(regexp_replace(x, '([+-][0-9]{{2}})([0-9]{{2}})$', '\\1:\\2') AS TIMESTAMPTZ)) AS at_us FROM (SELECT event_id,
    nullif(regexp_extract(coalesce(timestamp, ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d{{1,6}})?(Z|[+-]\\d{{2}}:?\\d{{2}})$'), '') AS x FROM e) WHERE x IS NOT NULL"""
)
def r_p17_reliable_times(spark, sf_dir):
    """Timestamps that prove an order: ISO with an offset."""
    rows = _events(spark, sf_dir).select("event_id", "timestamp", fx.reliable_timestamp(F.col("timestamp")).alias("at"))
    return rows.filter(F.col("timestamp").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:?\d{2})\z")).select("event_id", F.unix_micros("at").alias("at_us"))


# ---- tokens, redaction, classification ---------------------------------------------------------------------------


@query(r"SELECT DISTINCT doc_id, list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9_.\-]*'), lambda t: length(t) >= 2) AS tokens FROM documents WHERE title IS NOT NULL AND title = regexp_replace(title, '[^\x00-\x7F]', '', 'g')")
def r_t01_title_tokens(spark, sf_dir):
    """Tokens of every title in ASCII, in order."""
    titles = table(spark, sf_dir, "documents").select("doc_id", "title").filter(r"title IS NOT NULL AND NOT title RLIKE '[^\\x00-\\x7F]'").distinct()
    return titles.select("doc_id", tk.tokens("title").alias("tokens"))


@query()
def r_t01_tokens(spark, sf_dir):
    """Number of tokens of every text, and how many of them differ."""
    return table(spark, sf_dir, "documents").select("doc_id", tk.tokens("text").alias("t")).select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query()
def r_t02_project_keywords(spark, sf_dir):
    """The 120 most frequent tokens of each project's events."""
    rows = _events(spark, sf_dir).filter("project_key IS NOT NULL")
    return tk.corpus_keywords(rows, "project_key", F.col("content"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ev.total_order())]))


@query()
def r_r10_sanitized(spark, sf_dir):
    """Every event's content after the whole redaction chain."""
    return sanitize.sanitize(_events(spark, sf_dir).select("event_id", "content")).select("event_id", "sanitized")


@query(
    r"""WITH x AS (SELECT event_id, unnest(regexp_extract_all(content, '\[REDACTED:([A-Z_]+)\]', 1)) AS label FROM (SELECT DISTINCT event_id, content FROM unified_events))
    SELECT label, count(*) AS n FROM x GROUP BY 1"""
)
def r_r17_placeholders(spark, sf_dir):
    """How many placeholders of each kind the contents hold already."""
    return sanitize.counters(_events(spark, sf_dir), "content")


@query()
def r_r17_counters(spark, sf_dir):
    """How often each redaction rule strikes in the contents."""
    return sanitize.counters(sanitize.sanitize(_events(spark, sf_dir).select("event_id", "content")), original="content")


@query(
    """WITH r AS (SELECT source_file_id, line_no, min(record) AS record FROM adapter_records WHERE record IS NOT NULL GROUP BY 1, 2), k AS (SELECT unnest(json_keys(record::JSON)) AS field FROM r)
    SELECT field, count(*) AS n FROM k WHERE regexp_matches(replace(lower(field), '-', '_'), 'token|password|cookie|secret|credential|api_key|apikey|private_key|access_key|passwd|密码|口令|密钥') GROUP BY 1"""
)
def r_r16_records(spark, sf_dir):
    """Fields of the adapter records that a nested redaction hides by their name."""
    rows = table(spark, sf_dir, "adapter_records").filter("record IS NOT NULL").groupBy("source_file_id", "line_no").agg(F.min("record").alias("record"))
    fields = rows.select(F.explode(F.from_json(sanitize.sanitized_json("record"), "map<string,string>")).alias("field", "value"))
    return fields.filter("value = '[REDACTED:CREDENTIAL_FIELD]'").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


@query()
def r_p03_shown_paths(spark, sf_dir):
    """The working directories as they may be shown."""
    return table(spark, sf_dir, "raw_events").select("working_dir").distinct().select("working_dir", sanitize.display_path(F.col("working_dir")).alias("shown"))


# The SQL states its own lists, so that a slip in the operators' shows.
_SQL_MARKERS = {
    "runtime_injection": "<environment_context>|<permissions instructions>|<recommended_plugins>|# agents.md instructions|<apps_instructions>|<plugins_instructions>|<collaboration_mode>|<skills_instructions>|<codex_internal_context|<turn_aborted>",
    "delegated_transcript": "<codex_delegation>|<delegated_task>|source_thread_id|sub_agent_activity",
    "nested_approval": "<approval|sandbox approval|approval transcript|approvals_reviewer|>>> approval request start|reviewed codex session id:",
    "imported_transcript": "the following is the codex agent history|<external session imported>|>>> transcript start|>>> transcript delta start|begin external transcript",
    "external_material": "quoted third-party|third-party material|external article|reference article",
}
_SQL_COMPACTION = "this session is being continued from a previous conversation that ran out of context.|[compressed conversation summary|<summary>|## previous session archives|conversation summary"
_SQL_QUARANTINE = "runtime_injection:runtime_injection|compacted_summary:compacted_summary|imported_transcript:imported_transcript|nested_approval:nested_approval_transcript|delegated_transcript:delegated_transcript|synthetic_fixture:synthetic_fixture"
_any_sql = lambda test, words: " OR ".join(f"{test}(low, '{w}')" for w in words.split("|"))
_FLAG_TESTS = {flag: _any_sql("contains", words) for flag, words in _SQL_MARKERS.items()}
_FLAG_TESTS["runtime_injection"] += " OR " + _any_sql("starts_with", "base directory for this skill:|<!-- maintenance-runner · crystallize ·")
_FLAG_TESTS["nested_approval"] += (
    " OR (json_valid(content) AND TRY_CAST(content AS JSON)->>'$.outcome' IN ('allow', 'deny', 'ask') AND len(list_filter(json_keys(TRY_CAST(content AS JSON)), lambda k: k NOT IN ('outcome', 'risk_level', 'user_authorization', 'rationale'))) = 0)"
)
_FLAG_TESTS["compacted_summary"] = _any_sql("contains", _SQL_COMPACTION).replace("(low,", "(low[1:2000],")
_FLAG_TESTS["synthetic_fixture"] = _any_sql("starts_with", "short message |conversation message |this is a detailed message number ") + r" OR regexp_full_match(trim(content) || ' ', 'Response \d+: (?:Answer |Detailed response )+')"
_ROLE_LINE = r"regexp_replace(content[1:2000], '^\s+|\n$', '', 'g')"
_FLAG_TESTS["test_role"] = (
    r"regexp_matches(content[1:2000], '(?i)\bonly (reply|respond) (with )?(ok|yes|no)\b') OR regexp_matches(content[1:2000], '(?i)只回复\s*[`''\x22]?(ok|好的|是|否)')"
    rf" OR (NOT contains({_ROLE_LINE}, chr(10)) AND regexp_matches({_ROLE_LINE}, '(?i)^(you are|act as)\s') AND length(regexp_replace({_ROLE_LINE}, '(?i)^(you are|act as)\s+', '')) <= 80)"
)
_FLAG_TESTS["old_memory_reference"] = r"regexp_matches(content[1:8000], '(?i)(^|[/\\])(memory|memories|memorie|old[-_ ]?knowledge[-_ ]?base)([^a-z0-9_]|$)')"
_FLAG_TESTS["binary_removed"] = "contains(content, '[BINARY_REMOVED')"
_FLAG_TESTS["private_data_redacted"] = "contains(content, '[REDACTED:')"
#: Markers put before the contents of some rows, so that every reason of a quarantine occurs.
_PLANTED = ("", "<environment_context> ", "conversation summary ", "begin external transcript ", "sandbox approval ", "<delegated_task> ", "short message ", "quoted third-party ")
_PLANTED_SQL = f"q AS (SELECT * REPLACE ([{', '.join(repr(m) for m in _PLANTED)}][sequence % {len(_PLANTED)} + 1] || coalesce(content, '') AS content) FROM r)"


def _planted(rows: DataFrame) -> DataFrame:
    marks = F.array(*map(F.lit, _PLANTED))
    return rows.withColumn("content", F.concat(F.get(marks, F.pmod("sequence", F.lit(len(_PLANTED))).cast("int")), F.coalesce("content", F.lit(""))))


_FLAGS_SQL = (
    f"WITH {_RAW_ONCE}, {_PLANTED_SQL}, l AS (SELECT *, lower(trim(coalesce(content, ''))) AS low FROM q), k AS (SELECT raw_event_id, role, event_type, actor_hint, list_sort(list_distinct(list_concat(coalesce(flags, []), list_filter(["
    + ", ".join(f"CASE WHEN {test} THEN '{flag}' END" for flag, test in _FLAG_TESTS.items())
    + "], lambda x: x IS NOT NULL)))) AS flags FROM l)"
)
_ACTOR_SQL = """CASE WHEN list_has_any(flags, ['delegated_transcript', 'nested_approval', 'imported_transcript']) THEN 'orchestrator' WHEN list_contains(flags, 'external_material') THEN 'third_party'
    WHEN list_has_any(flags, ['test_role', 'synthetic_fixture']) THEN 'test_actor' WHEN list_contains(flags, 'runtime_injection') OR role = 'system' THEN 'runtime'
    WHEN coalesce(actor_hint, '') <> '' THEN actor_hint WHEN list_has_any(flags, ['subagent', 'sidechain']) THEN 'subagent' WHEN role IN ('user', 'unknown') THEN 'unknown_user'
    WHEN role = 'assistant' THEN 'primary_agent' WHEN role = 'tool' THEN 'tool' ELSE 'observer' END"""
_TYPES_SQL = "'tool_call', 'tool_result', 'patch', 'browser', 'device', 'attachment', 'status', 'delivery', 'error'"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _planted(table(spark, sf_dir, "raw_events").dropDuplicates(["raw_event_id"]))
    rows = rows.withColumn("flags", ev.classify_flags(F.coalesce("content", F.lit("")), F.col("flags")))
    rows = rows.withColumn("actor", ev.actor_kind(F.col("role"), F.col("flags"), F.col("actor_hint")))
    return rows.withColumn("grade", ev.evidence_grade(F.col("role"), F.col("event_type"), F.col("actor")))


@query(_FLAGS_SQL + " SELECT raw_event_id, flags FROM k")
def r_k01_flags(spark, sf_dir):
    """Flags of raw events: those given and those their text shows."""
    return _classified(spark, sf_dir).select("raw_event_id", "flags")


@query(
    _FLAGS_SQL
    + f", a AS (SELECT *, {_ACTOR_SQL} AS actor FROM k) SELECT raw_event_id, actor, CASE WHEN role = 'user' AND actor = 'primary_user' THEN 'A' WHEN event_type IN ({_TYPES_SQL}) THEN 'B' WHEN role = 'assistant' AND actor IN ('primary_agent', 'subagent') THEN 'C' ELSE 'D' END AS grade FROM a"
)
def r_k02_actors_and_grades(spark, sf_dir):
    """Actor kind and evidence grade of raw events."""
    return _classified(spark, sf_dir).select("raw_event_id", "actor", "grade")


# ---- filters, joins, aggregates ----------------------------------------------------------------------------------


@query(
    _FLAGS_SQL
    + ", z AS (SELECT CASE "
    + " ".join("WHEN list_contains(flags, '{}') THEN '{}'".format(*pair.split(":")) for pair in _SQL_QUARANTINE.split("|"))
    + " END AS reason FROM k) SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM z GROUP BY 1"
)
def r_f01_quarantine(spark, sf_dir):
    """Raw events kept, and quarantined by their first reason."""
    return _classified(spark, sf_dir).groupBy(F.coalesce(ev.quarantine_reason(F.col("flags")), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_ONCE}, c AS (SELECT source_file_id, call_id, min(sequence) AS called_at FROM e WHERE tool_name = 'memory_lookup' AND event_type = 'tool_call' AND call_id IS NOT NULL GROUP BY 1, 2)
    SELECT e.event_id FROM e JOIN c USING (source_file_id, call_id) WHERE e.sequence = called_at OR (e.event_type IN ('tool_result', 'error') AND e.sequence > called_at)"""
)
def r_f02_memory_rows(spark, sf_dir):
    """Lookups of old memory and their results."""
    return ev.memory_rows(_events(spark, sf_dir), (F.col("tool_name") == "memory_lookup") & (F.col("event_type") == "tool_call")).select("event_id")


@query(
    r"""WITH e AS (SELECT * REPLACE (CASE WHEN event_type = 'error' AND sequence % 3 = 0 THEN content || ' wrote review/x and completion-report.json' ELSE content END AS content) FROM unified_events QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY source_file_id) = 1),
    m AS (SELECT DISTINCT source_agent, session_id FROM e WHERE contains(content, 'review/') AND regexp_matches(content, 'session_kb\.py|audit/events\.jsonl|completion-report\.json|review/review\.json|review-init|validate-review'))
    SELECT source_agent, count(*) AS kept, count(DISTINCT session_id) AS sessions FROM e WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.source_agent = e.source_agent AND m.session_id = e.session_id) GROUP BY 1"""
)
def r_f03_without_own_work(spark, sf_dir):
    """Events outside sessions that rebuild the knowledge base itself (which some errors are made to mention)."""
    own = (F.col("event_type") == "error") & (F.col("sequence") % 3 == 0)
    events = _events(spark, sf_dir).withColumn("content", F.when(own, F.concat("content", F.lit(" wrote review/x and completion-report.json"))).otherwise(F.col("content")))
    return ev.without_self_reconstruction(events, ("review/",)).groupBy("source_agent").agg(F.count(F.lit(1)).alias("kept"), F.countDistinct("session_id").alias("sessions"))


@query(
    f"""WITH {_ONCE}, t AS (SELECT DISTINCT project_key FROM e WHERE starts_with(project_key, 'prj-0')), s AS (SELECT DISTINCT source_file_id FROM e WHERE starts_with(source_file_id, '0'))
    SELECT project_key, count(*) AS n, count(DISTINCT logical_session_id) AS sessions FROM e WHERE coalesce(project_key, '') NOT IN (SELECT project_key FROM t) AND source_file_id NOT IN (SELECT source_file_id FROM s) GROUP BY 1"""
)
def r_f04_forgotten(spark, sf_dir):
    """What is left after forgetting projects and sources by hashed tombstones."""
    events = _events(spark, sf_dir)
    projects = events.filter("project_key LIKE 'prj-0%'").select(F.lit("projects").alias("kind"), F.sha2("project_key", 256).alias("sha256"))
    sources = events.filter("source_file_id LIKE '0%'").select(F.lit("sources").alias("kind"), F.sha2("source_file_id", 256).alias("sha256"))
    return ev.without_forgotten(events, projects.unionByName(sources).distinct()).groupBy("project_key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("logical_session_id").alias("sessions"))


@query(
    f"""WITH {_ONCE} SELECT source_file_id, session_id, arg_min(project_key, (sequence, event_id)) AS project_key, arg_min(coalesce(project_label, ''), (sequence, event_id)) AS project_label
    FROM e WHERE project_key IS NOT NULL GROUP BY 1, 2"""
)
def r_j02_first_identity(spark, sf_dir):
    """The identity each session showed first."""
    return ev.first_identity(_events(spark, sf_dir)).withColumn("project_label", F.coalesce("project_label", F.lit("")))


@query("SELECT lower(replace(trim(adapter), '_', '-')) AS adapter, count(DISTINCT source_file_id) AS files, sum(frozen_size) AS bytes FROM (SELECT source_file_id, min(adapter) AS adapter, max(frozen_size) AS frozen_size FROM source_files GROUP BY 1) GROUP BY 1")
def r_g01_files_by_adapter(spark, sf_dir):
    """Files and bytes of each adapter."""
    files = table(spark, sf_dir, "source_files").groupBy("source_file_id").agg(F.min("adapter").alias("adapter"), F.max("frozen_size").alias("frozen_size"))
    return files.groupBy(F.lower(F.replace(F.trim("adapter"), F.lit("_"), F.lit("-"))).alias("adapter")).agg(F.count(F.lit(1)).alias("files"), F.sum("frozen_size").alias("bytes"))


#: The counters of a run: name, and the test of the rows it counts (the same in both languages).
_COUNTERS = {
    **{f"type_{t}": f"event_type = '{t}'" for t in ("message", "tool_call", "tool_result", "patch", "browser", "device", "attachment", "status", "delivery", "error")},
    **{f"grade_{g.lower()}": f"evidence_grade = '{g}'" for g in "ABCD"},
    **{f"actor_{a}": f"actor_kind = '{a}'" for a in ("primary_user", "native_user", "unknown_user", "primary_agent", "subagent", "tool", "runtime", "observer")},
    "users": "role = 'user'", "assistants": "role = 'assistant'", "with_call": "call_id IS NOT NULL", "with_parent": "parent_session_id IS NOT NULL AND parent_session_id <> ''", "without_project": "project_key IS NULL", "without_title": "session_title IS NULL", "without_directory": "working_dir IS NULL",
    "redacted": "content LIKE '%[REDACTED:%'", "binary_removed": "content LIKE '%[BINARY_REMOVED%'", "empty": "content = ''",
}


@query(
    f"WITH {_ONCE} SELECT count(*) AS events, count_if(list_contains(flags, 'sidechain')) AS sidechains, count(DISTINCT session_id) AS sessions, count(DISTINCT source_file_id) AS sources, count(DISTINCT project_key) AS projects, sum(length(content)) AS chars, "
    + ", ".join(f"count_if({test}) AS {name}" for name, test in _COUNTERS.items()) + " FROM e"
)
def r_g02_counters(spark, sf_dir):
    """The counters of a run, in one pass."""
    distinct = [F.countDistinct(c).alias(n) for c, n in (("session_id", "sessions"), ("source_file_id", "sources"), ("project_key", "projects"))]
    return _events(spark, sf_dir).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.array_contains("flags", "sidechain")).alias("sidechains"), *distinct, F.sum(F.length("content")).alias("chars"), *[F.count_if(F.expr(test)).alias(name) for name, test in _COUNTERS.items()])


@query(
    f"""WITH {_ONCE}, d AS (SELECT source_file_id, count(DISTINCT CASE WHEN record_locator LIKE 'byte:%' OR record_locator LIKE 'section:%' THEN split_part(record_locator, '.', 1) ELSE record_locator END) AS n FROM e GROUP BY 1),
    s AS (SELECT source_file_id, max(coalesce(records_seen, 0)) AS seen FROM parse_results GROUP BY 1)
    SELECT source_file_id, seen, least(seen, coalesce(n, 0)) AS accounted, seen - least(seen, coalesce(n, 0)) AS unaccounted FROM s LEFT JOIN d USING (source_file_id)"""
)
def r_g03_accounting(spark, sf_dir):
    """Records read against records with an outcome, per file."""
    seen = table(spark, sf_dir, "parse_results").groupBy("source_file_id").agg(F.max("records_seen").alias("records_seen"))
    return ev.transport_accounting(_events(spark, sf_dir), seen)


def _set_hash(x: str) -> str:
    part = lambda at: f"sum(('0x' || substr(sha256({x}), {at}, 15))::BIGINT::HUGEINT)::VARCHAR"
    return f"sha256(concat(count(*)::VARCHAR, ':', {part(1)}, ':', {part(16)}))"


@query(f"WITH {_ONCE} SELECT coalesce(project_key, 'session:' || logical_session_id) AS project_key, count(*) AS event_count, {_set_hash('event_id')} AS event_set_sha256 FROM e GROUP BY 1")
def r_g05_manifest(spark, sf_dir):
    """Number and set hash of each project's events."""
    return ev.project_manifest(_events(spark, sf_dir))


@query(
    f"""WITH {_ONCE} SELECT project_key, list_sort(list(DISTINCT source_agent)) AS agents, count(DISTINCT session_id) AS sessions, min(coalesce(timestamp, '')) AS first_at, max(coalesce(timestamp, '')) AS last_at,
    count_if(event_type = 'message' AND role = 'user') AS asked, count_if(event_type = 'delivery') AS delivered, count_if(event_type = 'error') AS errors FROM e WHERE project_key IS NOT NULL GROUP BY 1"""
)
def r_g06_dossiers(spark, sf_dir):
    """The figures of each project's dossier."""
    ts = F.coalesce("timestamp", F.lit(""))
    return _events(spark, sf_dir).filter("project_key IS NOT NULL").groupBy("project_key").agg(
        F.array_sort(F.collect_set("source_agent")).alias("agents"), F.countDistinct("session_id").alias("sessions"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"),
        F.count_if((F.col("event_type") == "message") & (F.col("role") == "user")).alias("asked"), F.count_if(F.col("event_type") == "delivery").alias("delivered"), F.count_if(F.col("event_type") == "error").alias("errors"),
    )


@query(
    f"""WITH {_ONCE}, b AS (SELECT event_id, content, role FROM e WHERE event_type <> 'status'), a AS (SELECT event_id, CASE WHEN event_type = 'error' THEN upper(content) ELSE content END AS content, role FROM e WHERE event_type <> 'delivery')
    SELECT change, count(*) AS n FROM (SELECT CASE WHEN b.event_id IS NULL THEN 'added' WHEN a.event_id IS NULL THEN 'removed' WHEN a.content <> b.content OR a.role <> b.role THEN 'modified' END AS change
    FROM b FULL OUTER JOIN a USING (event_id)) WHERE change IS NOT NULL GROUP BY 1"""
)
def r_g08_changes(spark, sf_dir):
    """Added, removed and modified events between two versions."""
    events = _events(spark, sf_dir)
    before = events.filter("event_type <> 'status'")
    after = events.filter("event_type <> 'delivery'").withColumn("content", F.when(F.col("event_type") == "error", F.upper("content")).otherwise(F.col("content")))
    return ev.changes(before, after, ["content", "role"]).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {_ONCE}, f AS (SELECT project_key, tool_name AS object, lower({_COLLAPSED}) AS statement, event_id FROM e WHERE event_type = 'tool_call' AND project_key IS NOT NULL AND tool_name IS NOT NULL)
    SELECT 'project' AS scope, object, '' AS applies_to, statement, count(DISTINCT event_id) AS signals, min(event_id) AS first_id, {_set_hash('event_id')} AS members_sha256, count(DISTINCT project_key) AS projects, count(DISTINCT project_key) >= 2 AS promotable FROM f GROUP BY object, statement"""
)
def r_g10_clusters(spark, sf_dir):
    """Signals that say the same, with the number of projects they come from."""
    rows = _events(spark, sf_dir).filter("event_type = 'tool_call' AND project_key IS NOT NULL AND tool_name IS NOT NULL")
    return review.feedback_clusters(rows.select(F.lit("project").alias("scope"), F.col("tool_name").alias("object"), F.col("content").alias("statement"), F.col("event_id").alias("feedback_id"), "project_key"))


# ---- sequences and order -----------------------------------------------------------------------------------------

_RANK_SQL = "CASE coalesce(nullif(metadata['transport_lane'], ''), 'unknown') WHEN 'codex-event-message' THEN 100 WHEN 'clacky-json' THEN 90 WHEN 'claude-code' THEN 80 WHEN 'workbuddy' THEN 80 WHEN 'codex-response-item' THEN 60 WHEN 'clacky-chunk' THEN 50 ELSE 70 END + CASE WHEN actor_kind = 'primary_user' THEN 10 ELSE 0 END"
_MIRROR_SQL = "(list_contains(lanes, 'codex-event-message') AND list_contains(lanes, 'codex-response-item')) OR (list_contains(lanes, 'clacky-json') AND list_contains(lanes, 'clacky-chunk'))"


@query(
    f"""WITH {_ONCE}, k AS (SELECT event_id, coalesce(timestamp, '') AS ts, sequence, coalesce(nullif(metadata['transport_lane'], ''), 'unknown') AS lane, (({_RANK_SQL}), -sequence, event_id) AS rank,
      (logical_session_id, role, event_type, coalesce(tool_name, ''), CASE WHEN event_type IN ('message', 'attachment') THEN '' ELSE coalesce(call_id, '') END, {_SEMANTIC}) AS key FROM e),
    g AS (SELECT key, list(DISTINCT lane) AS lanes, arg_max(lane, rank) AS keep FROM k GROUP BY 1), h AS (SELECT * FROM g WHERE {_MIRROR_SQL}),
    n AS (SELECT k.*, h.keep, row_number() OVER (PARTITION BY k.key, lane ORDER BY ts, sequence, event_id) AS nth FROM k JOIN h ON k.key = h.key),
    d AS (SELECT a.event_id, b.event_id AS target FROM n a JOIN n b ON a.key = b.key AND a.nth = b.nth AND a.lane <> a.keep AND b.lane = b.keep)
    SELECT e.event_id, d.target IS NULL AS kept, d.target FROM e LEFT JOIN d ON d.event_id = e.event_id"""
)
def r_w01_mirrors(spark, sf_dir):
    """Every event, kept or dropped as the mirror of another."""
    return ev.mirrored(_events(spark, sf_dir))


@query("SELECT event_id, min(metadata['ingest_run']) AS run FROM unified_events GROUP BY 1")
def r_w02_replays(spark, sf_dir):
    """Each event once, as its first run delivered it."""
    return ev.without_replays(table(spark, sf_dir, "unified_events"), [F.col("metadata")["ingest_run"]]).select("event_id", F.col("metadata")["ingest_run"].alias("run"))


@query(
    f"""WITH {_ONCE} SELECT event_id, last_value(session_title IGNORE NULLS) OVER (PARTITION BY source_file_id, session_id ORDER BY sequence, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS title FROM e"""
)
def r_w04_carried_titles(spark, sf_dir):
    """The title a session has at each of its events."""
    return _events(spark, sf_dir).select("event_id", ev.carried("session_title", ["source_file_id", "session_id"], ["sequence", "event_id"]).alias("title"))


@query(
    f"""WITH {_ONCE}, c AS (SELECT project_key, event_id, row_number() OVER (PARTITION BY project_key ORDER BY coalesce(timestamp, ''), logical_session_id, sequence, event_id) - 1 AS nth FROM e WHERE project_key IS NOT NULL),
    p AS (SELECT project_key, nth // 50 AS packet, min(nth) AS start, max(nth) + 1 AS "end", arg_min(event_id, nth) AS first_id, arg_max(event_id, nth) AS last_id FROM c GROUP BY 1, 2)
    SELECT *, lag(last_id) OVER w AS previous_id, lead(first_id) OVER w AS next_id FROM p WINDOW w AS (PARTITION BY project_key ORDER BY packet)"""
)
def r_w08_packets(spark, sf_dir):
    """Each project's chain in reading packets of 50, with the ids on either side."""
    return ranges.packets(_events(spark, sf_dir).filter("project_key IS NOT NULL"), "project_key", ev.total_order(), 50)


@query(
    f"""WITH {_ONCE}, s AS (SELECT logical_session_id AS k, min(sequence) - 1 AS start, max(sequence) AS "end", session_id FROM e GROUP BY logical_session_id, session_id), l AS (SELECT k, max("end") AS length FROM s GROUP BY 1),
    o AS (SELECT s.k, start, "end", length, lag("end") OVER (PARTITION BY s.k ORDER BY start, "end") AS prev FROM s JOIN l ON l.k = s.k)
    SELECT k AS logical_session_id, bool_and(coalesce(prev, 0) = start AND "end" > start) AND max("end") = max(length) AS tiled FROM o GROUP BY 1"""
)
def r_w05_tiling(spark, sf_dir):
    """Whether the sessions of a conversation follow each other without gap or overlap."""
    spans = _events(spark, sf_dir).groupBy("logical_session_id", "session_id").agg((F.min("sequence") - 1).alias("start"), F.max("sequence").alias("end"))
    return ranges.tiles(spans.withColumn("length", F.max("end").over(Window.partitionBy("logical_session_id"))), "logical_session_id")


@query(
    f"""WITH {_ONCE}, d AS (SELECT project_key, event_id, row_number() OVER (PARTITION BY project_key ORDER BY coalesce(timestamp, '') DESC, logical_session_id DESC, sequence DESC, event_id DESC) AS n FROM e
    WHERE event_type = 'delivery' AND project_key IS NOT NULL) SELECT project_key, event_id, n FROM d WHERE n <= 40"""
)
def r_w10_last_deliveries(spark, sf_dir):
    """The last 40 deliveries of each project (a bounded list is the feature)."""
    order = Window.partitionBy("project_key").orderBy(*[c.desc() for c in ev.total_order()])
    rows = _events(spark, sf_dir).filter("event_type = 'delivery' AND project_key IS NOT NULL").withColumn("n", F.row_number().over(order))
    return rows.filter("n <= 40").select("project_key", "event_id", F.col("n").cast("bigint").alias("n"))


_STITCH = r"""
pairs AS (SELECT DISTINCT source_agent || ':' || session_id AS a, source_agent || ':' || session_id AS b FROM unified_events
  UNION SELECT source_agent || ':' || session_id, source_agent || ':' || parent_session_id FROM unified_events WHERE coalesce(parent_session_id, '') <> ''
  UNION SELECT source_agent || ':' || session_id, 'Clacky:file:' || regexp_replace(regexp_replace(source_relpath, '(?i)-chunk-[0-9]+\.md$', '.md'), '(?i)\.(json|md)$', '') FROM unified_events WHERE source_agent = 'Clacky'),
ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
members AS (SELECT a AS node, {hash} AS set_hash FROM (SELECT DISTINCT a, b FROM reach WHERE b NOT LIKE 'Clacky:file:%' AND a NOT LIKE 'Clacky:file:%') GROUP BY 1)
"""


_STITCH = _STITCH.format(hash=_set_hash("b"))


@query(
    f"""WITH RECURSIVE {_STITCH} SELECT DISTINCT e.source_agent, e.session_id, 'session-' || m.set_hash[1:24] AS logical_session_id
    FROM unified_events e JOIN members m ON m.node = e.source_agent || ':' || e.session_id"""
)
def r_h01_logical_sessions(spark, sf_dir):
    """Sessions stitched over parent links as written."""
    return ev.logical_sessions(table(spark, sf_dir, "unified_events"))


# ---- review, retrieval, lifecycle --------------------------------------------------------------------------------


def _claims(events: DataFrame) -> DataFrame:
    """Claims as the data has them: what assistants and tools state in a project, one row per event that says so."""
    rows = events.filter("project_key IS NOT NULL AND event_type IN ('message', 'delivery', 'error')")
    return rows.select("project_key", F.sha2(fx.collapsed(F.col("content")), 256).alias("claim_id"), F.when(F.col("event_type") == "message", "inferred").otherwise("observed").alias("status"), "event_id")


_CLAIMS_SQL = f"""claims AS (SELECT project_key, {_SEMANTIC} AS claim_id, CASE WHEN event_type = 'message' THEN 'inferred' ELSE 'observed' END AS status, list(DISTINCT event_id) AS ids
    FROM e WHERE project_key IS NOT NULL AND event_type IN ('message', 'delivery', 'error') GROUP BY ALL)"""


@query(
    f"""WITH {_ONCE}, {_CLAIMS_SQL}, x AS (SELECT claim_id, status, unnest(ids) AS event_id FROM claims), y AS (SELECT x.*, e.evidence_grade FROM x JOIN e USING (event_id))
    SELECT 'claim-id' AS rule, claim_id AS location, 'claim_id is not unique' AS message FROM claims GROUP BY claim_id HAVING count(*) > 1
    UNION ALL SELECT 'observed', claim_id, 'observed rests on statements only' FROM y WHERE status = 'observed' GROUP BY claim_id HAVING bool_and(evidence_grade IN ('C', 'D'))
    UNION ALL SELECT 'status', claim_id, 'status is not allowed' FROM claims WHERE status NOT IN ('observed', 'stale')"""
)
def r_v15_claim_checks(spark, sf_dir):
    """Violations of rules on claims: unique ids, allowed states, and evidence strong enough for what is called observed."""
    events = _events(spark, sf_dir)
    cited = _claims(events)
    claims = cited.drop("event_id").distinct()
    return review.union([review.repeated(claims, "claim_id", "claim-id"), review.weak_observed(cited, "claim_id", events, "observed"), review.outside(claims, "claim_id", "status", ("observed", "stale"), "status")])


def _search_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated tasks (titles of the documents whose id divides by 50) and all documents with their keywords; each text is read, and left behind, once."""
    words = tk.top_tokens(F.coalesce("text", F.lit("")), F.lit(120)).alias("keywords")
    docs = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("doc_key"), F.col("doc_id").alias("position"), "project_key", "title", "path", F.array(F.col("source")).alias("aliases"), words)
    docs = Scratch(spark, "titled").keep(docs.dropDuplicates(["doc_key"]), "documents")
    return docs.filter("position % 50 = 0 AND title IS NOT NULL").select(F.col("doc_key").alias("task_id"), F.col("title").alias("task")), docs


@query()
def r_q04_search(spark, sf_dir):
    """The documents a search returns for each stated task: the best projects by title, kind and whole text, their neighbours, and the rules first."""
    tasks, docs = _search_tables(spark, sf_dir)
    kind = F.when(F.col("position") == 1, "evidence").when(F.col("position") == 2, "identity").when(F.col("position") == 3, "collaboration").otherwise("project")
    docs = docs.withColumn("type", kind)
    after = docs.select("project_key", F.col("path").alias("target_path"), (F.col("position") - 1).alias("position"))
    edges = docs.join(after, ["project_key", "position"]).select("position", F.col("path").alias("source_path"), "target_path", F.lit("follows").alias("relation"), F.lit("directed").alias("direction"), F.lit("confirmed").alias("status"))
    return search.search(tasks, docs, edges)


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(title, '(?i)\\bour (?:past |previous )?collaboration\\b|\\bmy (?:(?:writing|communication|personal) (?:style|voice)|preferences)\\b') THEN 1 ELSE 0 END AS n FROM (SELECT DISTINCT doc_id, coalesce(title, '') AS title FROM documents)"""
)
def r_q01_base_context(spark, sf_dir):
    """How many base documents each title, as a task, asks for."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("title", F.lit("")).alias("title")).distinct().select("doc_id", F.size(retrieval.base_context(F.col("title"))).alias("n"))


def _fill_sql(rows: str, facts: int, chars: int) -> str:
    """The greedy fill over rows (k, pos, id, size): a step per fact, each the next row that still fits."""
    steps = [f"f1 AS (SELECT k, min(pos) AS last, arg_min([id], pos) AS ids, arg_min(size, pos) AS used FROM {rows} WHERE size <= {chars} GROUP BY k)"]
    for i in range(2, facts + 1):
        steps.append(f"n{i} AS (SELECT r.k, min(r.pos) AS pos, arg_min(r.id, r.pos) AS id, arg_min(r.size, r.pos) AS size FROM {rows} r JOIN f{i - 1} f ON f.k = r.k AND r.pos > f.last AND f.used + r.size <= {chars} GROUP BY r.k)")
        steps.append(f"f{i} AS (SELECT f.k, coalesce(n.pos, f.last) AS last, CASE WHEN n.k IS NULL THEN f.ids ELSE list_append(f.ids, n.id) END AS ids, f.used + coalesce(n.size, 0) AS used FROM f{i - 1} f LEFT JOIN n{i} n ON n.k = f.k)")
    return ", ".join(steps)


@query(
    f"""WITH {_ONCE}, m AS (SELECT logical_session_id AS k, row(coalesce(timestamp, ''), logical_session_id, sequence, event_id) AS pos, event_id AS id, length(content) AS size FROM e WHERE event_type = 'message'),
    {_fill_sql("m", 6, 1500)} SELECT k AS logical_session_id, ids AS event_ids, used FROM f6"""
)
def r_cu03_budget(spark, sf_dir):
    """The messages of each conversation, in order, that fit a budget of 6 facts and 1,500 characters, whole."""
    rows = _events(spark, sf_dir).filter("event_type = 'message'").select("logical_session_id", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(ev.total_order())]).alias("at"), F.col("event_id").alias("unit_id"), F.length("content").cast("bigint").alias("size"))
    return cu.fill(rows, ["logical_session_id"], "at", 6, 1500).select("logical_session_id", F.col("ids").alias("event_ids"), "used")


def _units(events: DataFrame) -> DataFrame:
    """Every project's messages, deliveries and errors as units of its document, the first of each content."""
    rows = events.filter("project_key IS NOT NULL AND event_type IN ('message', 'delivery', 'error')")
    status = F.when(F.col("event_type") == "message", "agent-reported").when(F.col("event_type") == "error", "odd").otherwise("observed")
    none = F.array().cast("array<string>")
    return rows.select(F.col("project_key").alias("doc_key"), F.struct("sequence", "event_id").alias("position"), F.substring(F.sha2("content", 256), 1, 12).alias("unit_id"), F.lit("history").alias("section"), F.col("content").alias("text"), status.alias("status"), F.array("event_id").alias("evidence_event_ids"), none.alias("conflicts"), none.alias("supersedes"))


@query(
    f"""WITH {_ONCE}, u AS (SELECT project_key AS doc_key, sha256(content)[1:12] AS unit_id, content, event_type FROM e WHERE project_key IS NOT NULL AND event_type IN ('message', 'delivery', 'error')),
    x AS (SELECT doc_key, unit_id, 'unit has no text' AS message FROM u WHERE trim(regexp_replace(content, '{_SPACE}', ' ', 'g')) = '' UNION ALL SELECT doc_key, unit_id, 'status is not allowed' FROM u WHERE event_type = 'error'
      UNION ALL SELECT doc_key, unit_id, 'unit id is not unique' FROM u GROUP BY 1, 2 HAVING count(*) > 1) SELECT message, count(*) AS n, count(DISTINCT doc_key) AS documents FROM x GROUP BY 1"""
)
def r_cu06_unit_errors(spark, sf_dir):
    """What is wrong with units made of events: blank texts, errors as a status of their own, contents said twice."""
    states = spark.createDataFrame([], "doc_key string, field string, unit_id string")
    return cu.unit_errors(_units(_events(spark, sf_dir)), states).groupBy("message").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_key").alias("documents"))


_TITLE_TOKENS = r"list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9_.\-]*'), lambda t: length(t) >= 2)"
_GENERIC_SQL = ", ".join(f"'{t}'" for t in "the a an and or to of for in on my our me we please continue help write writing style voice identity project task agent ai update test tests fix code".split())
_TITLED = f"""d AS (SELECT DISTINCT doc_id, title, path, source, project_key, {_TITLE_TOKENS} AS toks FROM documents WHERE title IS NOT NULL),
    t AS (SELECT doc_id::VARCHAR AS task_id, doc_id, project_key, lower(trim(title)) AS task, list_filter(list_distinct(toks), lambda x: x NOT IN ({_GENERIC_SQL})) AS terms FROM d WHERE doc_id % 50 IN (0, 25)),
    s AS (SELECT task_id, d.doc_id::VARCHAR AS doc_key, d.title, d.path, d.project_key, len(list_filter(terms, lambda x: list_contains(toks, x))) * 4 + len(list_filter(terms, lambda x: contains(lower(d.title), x))) * 3 + len(list_filter(terms, lambda x: contains(d.source, x))) * 4
      + CASE WHEN contains(lower(d.title), task) THEN 20 ELSE 0 END + CASE WHEN contains(d.source, task) THEN 24 ELSE 0 END AS score FROM t JOIN d ON true WHERE len(terms) > 0),
    best AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, title, path) AS rank FROM s WHERE score >= 4)"""


def _titled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Titles of the documents whose id divides by 25 as tasks, and all titled documents with the words of their titles as keywords."""
    docs = table(spark, sf_dir, "documents").filter("title IS NOT NULL").select("doc_id", "title", "path", "source", "project_key").distinct()
    tasks = docs.filter("doc_id % 50 IN (0, 25)").select(F.col("doc_id").cast("string").alias("task_id"), F.col("title").alias("task"), "doc_id", "project_key")
    return tasks, docs.select(F.col("doc_id").cast("string").alias("doc_key"), F.col("doc_id").alias("position"), "path", F.lit("project").alias("type"), "project_key", "title", F.array("source").alias("aliases"), tk.tokens("title").alias("keywords"))


@query(f"WITH {_TITLED} SELECT task_id, doc_key, score FROM s WHERE score > 0")
def r_q03_scores(spark, sf_dir):
    """Every score above 0 of the stated tasks against all documents, by title and kind."""
    return retrieval.scores(*_titled(spark, sf_dir)).select("task_id", "doc_key", "score")


@query(
    f"""WITH {_TITLED}, q AS (SELECT task_id, list(project_key) AS projects, count(*) AS n FROM best WHERE rank <= 3 GROUP BY 1), c AS (SELECT task_id, CASE WHEN doc_id % 50 = 0 THEN 'related' ELSE 'hard_negative' END AS kind, project_key FROM t
      UNION ALL SELECT 'n' || task_id, 'hard_negative', NULL FROM t) SELECT c.task_id AS case_id, kind, CASE WHEN kind = 'related' THEN coalesce(n, 0) >= 1 AND (c.project_key IS NULL OR coalesce(list_contains(projects, c.project_key), false)) ELSE q.task_id IS NULL END AS passed,
      coalesce(n, 0) AS project_matches FROM c LEFT JOIN q USING (task_id)"""
)
def r_z02_suite(spark, sf_dir):
    """Verdicts of a suite over the search: titles must find their project; titles called negative, and words nobody uses, must find nothing."""
    tasks, docs = _titled(spark, sf_dir)
    keys = F.array_compact(F.array("project_key"))
    none = F.array().cast("array<string>")
    asked = tasks.select(F.col("task_id").alias("case_id"), F.when(F.col("doc_id") % 50 == 0, "related").otherwise("hard-negative").alias("kind"), "task", F.when(F.col("doc_id") % 50 == 0, keys).otherwise(none).alias("expected_project_keys"))
    unused = tasks.select(F.concat(F.lit("n"), "task_id").alias("case_id"), F.lit("hard-negative").alias("kind"), F.concat(F.lit("zzqx"), "task_id", F.lit("qq")).alias("task"), none.alias("expected_project_keys"))
    ready = search.suite_cases(asked.unionByName(unused).withColumns({"expected_document_types": none, "min_project_matches": F.lit(None).cast("int"), "min_context_units": F.lit(None).cast("int")}))
    ready = Scratch(spark, "suite").keep(ready, "ready")  # a search reads its tasks several times
    found = search.search(ready.select(F.col("case_id").alias("task_id"), "task"), docs, spark.createDataFrame([], search.EDGES), base_context="none", max_related=0)
    return search.suite_verdicts(ready, found).select("case_id", "kind", "passed", "project_matches")


@query()
def r_cu05_views(spark, sf_dir):
    """What of each project's units a task about errors is given, under the usual budget."""
    events = _events(spark, sf_dir)
    documents = events.filter("project_key IS NOT NULL").groupBy(F.col("project_key").alias("doc_key")).agg(F.min("project_label").alias("title")).withColumn("aliases", F.array().cast("array<string>"))
    chosen = documents.select(F.lit("t").alias("task_id"), "doc_key", F.array(F.lit("error"), F.lit("ledger")).alias("terms"))
    states = spark.createDataFrame([], "doc_key string, field string, unit_id string")
    return cu.unit_views(chosen, documents, _units(events).dropDuplicates(["doc_key", "unit_id"]), states, cu.selection_options(view="facts"))


@query(
    f"""WITH {_ONCE}, {_CLAIMS_SQL}, h AS (SELECT * FROM e WHERE source_file_id IN (SELECT source_file_id FROM e WHERE event_type = 'error')), x AS (SELECT claim_id, unnest(ids) AS event_id FROM claims),
    f AS (SELECT event_id, {_SEMANTIC} AS rule FROM e WHERE event_type = 'message' AND role = 'user' AND project_key IS NOT NULL), hc AS (SELECT DISTINCT claim_id FROM x WHERE event_id IN (SELECT event_id FROM h)),
    more AS (SELECT event_id FROM h UNION SELECT event_id FROM x WHERE claim_id IN (SELECT claim_id FROM hc)), hp AS (SELECT DISTINCT coalesce(project_key, 'session:' || logical_session_id) AS project_key FROM e WHERE event_id IN (SELECT event_id FROM more)),
    hf AS (SELECT f.event_id, rule FROM f JOIN e USING (event_id) WHERE event_id IN (SELECT event_id FROM more) OR project_key IN (SELECT project_key FROM hp)), d AS (SELECT path FROM documents WHERE project_key IN (SELECT project_key FROM hp))
    SELECT 'event' AS kind, count(*) AS n FROM more UNION ALL SELECT 'project', count(*) FROM hp UNION ALL SELECT 'claim', count(*) FROM hc UNION ALL SELECT 'feedback', count(*) FROM hf UNION ALL SELECT 'rule', count(DISTINCT rule) FROM hf UNION ALL SELECT 'document', count(DISTINCT path) FROM d"""
)
def r_l02_impact(spark, sf_dir):
    """What forgetting all files with an error would touch: events, projects, claims, feedback, rules and documents."""
    fields = ("event_id", "source_file_id", "project_key", "logical_session_id", "event_type", "role", "content")
    events = Scratch(spark, "events").keep(_events(spark, sf_dir).select(*fields), "once")
    files = events.filter("event_type = 'error'").select("source_file_id").distinct()
    selected = events.join(files, "source_file_id", "left_semi")
    feedback = events.filter("event_type = 'message' AND role = 'user' AND project_key IS NOT NULL").select(F.col("event_id").alias("feedback_id"), "event_id", "project_key", "content")
    rules = feedback.select(F.sha2(fx.collapsed(F.col("content")), 256).alias("evolution_id"), "feedback_id")
    tables = lifecycle.Tables(events, _claims(events), feedback, rules, table(spark, sf_dir, "documents").select("path", "project_key"))
    return lifecycle.impact(tables, selected, "forget").groupBy("kind").agg(F.countDistinct("id").alias("n"))


@query(f"WITH {_ONCE} SELECT event_id, project_key, row_number() OVER (PARTITION BY project_key ORDER BY coalesce(timestamp, ''), logical_session_id, sequence, event_id) AS place FROM e")
def r_o01_total_order(spark, sf_dir):
    """Every event's place in its project's total order; events without a project have one of their own."""
    rows = _events(spark, sf_dir).select("event_id", "project_key", "timestamp", "logical_session_id", "sequence")
    return ranges.numbered(rows, ["project_key"], ev.total_order()).select("event_id", "project_key", "place")


@query()
def r_o01_real_time_order(spark, sf_dir):
    """Every event's place in its project by real time: instants first, then conversation, number and id."""
    rows = with_utc_micros(_events(spark, sf_dir).select("event_id", "project_key", "logical_session_id", "sequence", "timestamp", F.col("metadata")["tz"].alias("tz")), F.col("timestamp"), F.col("tz"), known_zones(spark))
    return ranges.numbered(rows.select("event_id", "project_key", "utc_us", "logical_session_id", "sequence"), ["project_key"], [F.col(c) for c in ("utc_us", "logical_session_id", "sequence", "event_id")]).select("event_id", "project_key", "place")
