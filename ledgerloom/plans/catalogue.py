"""The queries by name, and the DuckDB SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import presentation, pricing, text
from ledgerloom.operators import attribution, canonical, mutations, ordering, threads, usage
from ledgerloom.operators.filters import LedgerFilter, SelectionFilter
from ledgerloom.sources import records
from ledgerloom.sources.staging import cut

from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

START, END = 1_704_067_200_000, 1_706_745_600_000
MODELS = ("gpt-5.6-sol", "gpt-5.6-luna", "gpt-5.5", "Others")
SUBJECTS = (("main", "root"), ("subagent", "worker"))
MAIN_THREAD = "00000005-0000-7000-8000-000000000000"


def _priced_sql() -> str:
    """The view `priced`: categories, roles and nano-USD of every event."""
    rate = lambda i: "CASE model " + " ".join(f"WHEN '{m}' THEN {r[i]}" for m, r in pricing.RATES.items()) + " ELSE 0 END"
    family = " OR ".join(f"model = '{f}' OR model LIKE '{f}-%'" for f in pricing.FAMILIES)
    long_ = ", ".join(f"'{m}'" for m in pricing.LONG_CONTEXT)
    known = ", ".join(f"'{m}'" for m in pricing.RATES)
    return f"""a AS (SELECT *, CASE WHEN model = 'unknown' THEN 'Unknown attribution' WHEN model = 'codex-auto-review' THEN model WHEN {family} THEN model ELSE 'Others' END AS category,
      CASE WHEN thread_type = 'main' THEN 'root' ELSE agent_role END AS role, input_tokens - cached_input_tokens AS uncached_input_tokens,
      output_tokens - reasoning_output_tokens AS other_output_tokens, input_tokens + output_tokens AS canonical_tokens,
      input_tokens > {pricing.LONG_CONTEXT_ABOVE} AND model IN ({long_}) AS long_context, {rate(0)} AS r0, {rate(1)} AS r1, {rate(2)} AS r2 FROM usage_events),
    b AS (SELECT *, category = 'Others' OR model IN ({known}) AS priced, CASE WHEN long_context THEN 2 ELSE 1 END AS mi, uncached_input_tokens * r0 AS b0, cached_input_tokens * r1 AS b1,
      reasoning_output_tokens * r2 AS b2, other_output_tokens * r2 AS b3 FROM a),
    c AS (SELECT *, b0 * mi AS uncached_nano, b1 * mi AS cached_nano, CASE WHEN long_context THEN b2 * 3 // 2 ELSE b2 END AS reasoning_nano, CASE WHEN long_context THEN b3 * 3 // 2 ELSE b3 END AS other_nano,
      b0 + b1 + b2 + b3 AS baseline_nano FROM b),
    priced AS (SELECT *, uncached_nano + cached_nano + reasoning_nano + other_nano AS total_nano, uncached_nano + cached_nano + reasoning_nano + other_nano - baseline_nano AS premium_nano FROM c)"""


WITH = f"WITH RECURSIVE {views.sql_views()}, {_priced_sql()}"
MEASURES = ", ".join(
    ["count(*) AS calls", *[f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in usage.TOKENS], "CAST(coalesce(sum(CASE WHEN priced THEN 0 ELSE canonical_tokens END), 0) AS BIGINT) AS unpriced_tokens"]
    + [f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in pricing.COSTS]
)
_IN_TIME = f"timestamp_epoch_ms >= {START} AND timestamp_epoch_ms < {END}"
_CHOSEN = f"{_IN_TIME} AND category IN ({', '.join(repr(m) for m in MODELS)}) AND (thread_type, role) IN (('main', 'root'), ('subagent', 'worker'))"
_THREAD = "CASE WHEN thread_type = 'main' THEN conversation_id ELSE rollout_id END"
_FACET = "CAST(sum(canonical_tokens) AS BIGINT) AS tokens, CAST(sum(total_nano) AS BIGINT) AS total_nano"
_CLOSURE = """keys AS (SELECT rollout_id, rollout_id AS parent_key FROM rollouts UNION SELECT rollout_id, conversation_id FROM rollouts WHERE thread_type = 'main'),
    closure AS (SELECT conversation_id AS root, rollout_id FROM rollouts WHERE thread_type = 'main'
      UNION SELECT c.root, r.rollout_id FROM closure c JOIN keys k ON k.rollout_id = c.rollout_id JOIN rollouts r ON r.parent_thread_id = k.parent_key)"""
_V7 = "regexp_full_match({c}, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-7[0-9a-f]{{3}}-[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _users_number() -> Column:
    """The user's number in a rollout's id."""
    return F.substring("rollout_id", 2, 20).cast("long")


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pricing.with_costs(views.usage_events(spark, sf_dir))


def _chosen(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return SelectionFilter(START, END, **more).apply(_priced(spark, sf_dir))


# --- summaries, groups, facets ----------------------------------------------------------------------------------------


@query(f"{WITH} SELECT thread_type, role, count(DISTINCT {_THREAD}) AS threads, {MEASURES} FROM priced WHERE {_IN_TIME} GROUP BY ALL")
def role_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_role(_chosen(spark, sf_dir))


@query(f"{WITH} SELECT {MEASURES} FROM priced")
def summary_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(_priced(spark, sf_dir))


@query(f"{WITH} SELECT {MEASURES} FROM priced WHERE {_CHOSEN}")
def summary_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(_chosen(spark, sf_dir, models=MODELS, subjects=SUBJECTS))


@query(f"{WITH} SELECT {MEASURES} FROM priced WHERE false")
def summary_empty_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.summary(_chosen(spark, sf_dir, models=()))


@query(f"{WITH} SELECT category, {MEASURES} FROM priced WHERE {_CHOSEN} GROUP BY category")
def by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_model(_chosen(spark, sf_dir, models=MODELS, subjects=SUBJECTS))


@query(f"{WITH} SELECT thread_type, role, agent_path, category, {MEASURES} FROM priced GROUP BY ALL")
def by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.by_agent(_priced(spark, sf_dir))


@query(f"{WITH} SELECT category, {_FACET} FROM priced WHERE {_IN_TIME} GROUP BY category")
def facet_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.dashboard(views.usage_events(spark, sf_dir), SelectionFilter(START, END, models=MODELS))["model_facet"]


@query(f"{WITH} SELECT thread_type, role, {_FACET} FROM priced WHERE {_IN_TIME} GROUP BY ALL")
def facet_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.dashboard(views.usage_events(spark, sf_dir), SelectionFilter(START, END, subjects=SUBJECTS))["subject_facet"]


_ROW = ("token_event_ordinal", "rollout_id", "category", "role", "priced", "long_context", "uncached_input_tokens", "other_output_tokens", "canonical_tokens", *pricing.COSTS)


@query(f"{WITH} SELECT {', '.join(c if not c.endswith('_nano') else f'CAST({c} AS BIGINT) AS {c}' for c in _ROW)}, CASE WHEN baseline_nano > 0 THEN CAST(total_nano AS DOUBLE) / CAST(baseline_nano AS DOUBLE) END AS multiplier FROM priced")
def priced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).select(*_ROW, pricing.multiplier(F.col("total_nano"), F.col("baseline_nano")).alias("multiplier"))


@query(
    f"{WITH}, s AS (SELECT {MEASURES} FROM priced), u AS (SELECT total_nano, unnest([{{'slice': 'uncached', 'nano': uncached_nano}}, {{'slice': 'cached', 'nano': cached_nano}}, {{'slice': 'reasoning', 'nano': reasoning_nano}}, {{'slice': 'other', 'nano': other_nano}}]) AS x FROM s) "
    "SELECT x.slice AS slice, x.nano AS nano, round(CAST(x.nano AS DOUBLE) / CAST(total_nano AS DOUBLE) * 100, 6) AS percent FROM u"
)
def cost_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presentation.cost_composition(usage.summary(_priced(spark, sf_dir))).withColumn("percent", F.round("percent", 6))


@query(
    f"{WITH}, g AS (SELECT category, {MEASURES} FROM priced GROUP BY category), t AS (SELECT sum(total_nano) AS all_nano FROM g) "
    "SELECT category, total_nano, round(CAST(total_nano AS DOUBLE) / CAST(all_nano AS DOUBLE), 6) AS share, unpriced_tokens < canonical_tokens AS priced, round(CASE WHEN baseline_nano > 0 THEN CAST(total_nano AS DOUBLE) / CAST(baseline_nano AS DOUBLE) END, 6) AS multiplier, "
    "CASE category WHEN 'gpt-5.6-sol' THEN 0 WHEN 'gpt-5.6-terra' THEN 1 WHEN 'gpt-5.6-luna' THEN 2 WHEN 'codex-auto-review' THEN 3 WHEN 'Others' THEN 4 ELSE 5 END AS place FROM g, t"
)
def model_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = usage.by_model(_priced(spark, sf_dir))
    rows = ordering.order_models(groups.withColumn("all_nano", F.sum("total_nano").over(Window.partitionBy())))  # a row a category
    return rows.select(
        "category", "total_nano", F.round(presentation.share(F.col("total_nano"), F.col("all_nano")), 6).alias("share"), presentation.row_priced(F.col("unpriced_tokens"), F.col("canonical_tokens")).alias("priced"),
        F.round(pricing.multiplier(F.col("total_nano"), F.col("baseline_nano")), 6).alias("multiplier"), ordering.model_rank(F.col("category")).alias("place"),
    )


@query(
    f"{WITH}, g AS (SELECT thread_type, role, count(DISTINCT {_THREAD}) AS threads, {MEASURES} FROM priced GROUP BY ALL) SELECT thread_type, role, total_nano, "
    "row_number() OVER (ORDER BY total_nano DESC, CASE WHEN thread_type = 'main' AND role = 'root' THEN 0 WHEN thread_type = 'subagent' THEN CASE role WHEN 'worker' THEN 1 WHEN 'reviewer' THEN 2 WHEN 'explorer' THEN 3 WHEN 'scout' THEN 4 WHEN 'unknown' THEN 8 ELSE 9 END ELSE 9 END, thread_type, role) AS place FROM g"
)
def role_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = usage.by_role(_priced(spark, sf_dir))
    order = Window.orderBy(F.desc("total_nano"), ordering.role_rank(F.col("thread_type"), F.col("role")), "thread_type", "role")  # a row a role
    return rows.select("thread_type", "role", "total_nano", F.row_number().over(order).cast("long").alias("place"))


# --- ledger scans and threads -----------------------------------------------------------------------------------------

_EVENT = ("timestamp_epoch_ms", "rollout_id", "token_event_ordinal", "model", "agent_role", "input_tokens", "output_tokens")


@query(
    f"{WITH} SELECT {', '.join('e.' + c for c in _EVENT)}, r.conversation_id AS thread_conversation, r.project_name FROM usage_events e JOIN rollouts r ON e.rollout_id = r.rollout_id "
    f"WHERE {_IN_TIME} AND model IN ('gpt-5.5', 'o3') AND agent_role IN ('worker', 'scout') AND e.thread_type IN ('main', 'subagent')"
)
def events_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = LedgerFilter(START, END, models=("gpt-5.5", "o3"), roles=("worker", "scout"), thread_types=("main", "subagent"))
    events = wanted.apply(views.usage_events(spark, sf_dir)).drop("conversation_id", "thread_type")
    rows = threads.with_rollouts(events, views.rollouts(spark, sf_dir)).orderBy("timestamp_epoch_ms", "rollout_id", "token_event_ordinal")
    return rows.select(*_EVENT, F.col("conversation_id").alias("thread_conversation"), "project_name")


@query(f"{WITH}, {_CLOSURE} SELECT DISTINCT rollout_id FROM closure WHERE root = '{MAIN_THREAD}'")
def thread_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.thread_closure(views.rollouts(spark, sf_dir), MAIN_THREAD)


@query(f"{WITH}, {_CLOSURE} SELECT DISTINCT root, rollout_id FROM closure")
def all_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollouts = views.rollouts(spark, sf_dir)
    return threads.closure(rollouts, threads.main_roots(rollouts))


@query(f"{WITH}, {_CLOSURE} SELECT {', '.join(_EVENT)} FROM usage_events WHERE rollout_id IN (SELECT rollout_id FROM closure WHERE root = '{MAIN_THREAD}')")
def events_by_main_thread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.events_of_thread(views.usage_events(spark, sf_dir), views.rollouts(spark, sf_dir), MAIN_THREAD).select(*_EVENT)


@query(
    f"{WITH}, {_CLOSURE}, shown AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY last_activity_epoch_ms DESC, rollout_id DESC) AS n FROM rollouts WHERE thread_type = 'main' AND NOT is_realtime_voice AND {_V7.format(c='conversation_id')}), "
    "act AS (SELECT c.root, max(r.last_activity_epoch_ms) AS la FROM closure c JOIN rollouts r ON r.rollout_id = c.rollout_id GROUP BY c.root) "
    "SELECT conversation_id, project_name, thread_title, la AS last_activity_epoch_ms FROM shown JOIN act ON root = conversation_id WHERE n = 1 ORDER BY la DESC, conversation_id DESC LIMIT 20"
)
def recent_main_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.recent_main_threads(views.rollouts(spark, sf_dir), 20).select("conversation_id", "project_name", "thread_title", "last_activity_epoch_ms")


@query(f"{WITH} SELECT DISTINCT file_path FROM source_files s JOIN usage_events e ON e.rollout_id = s.rollout_id WHERE e.model = 'unknown' AND canonical_status = 'canonical'")
def unknown_model_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every canonical source is the one that its rollout names, whether the file is still there or not."""
    named = views.sources(spark, sf_dir).where("canonical_status = 'canonical'").select("rollout_id", F.col("file_path").alias("canonical_source_path"))
    return threads.unknown_model_sources(views.usage_events(spark, sf_dir), views.rollouts(spark, sf_dir).join(named, "rollout_id", "left"))


@query(f"{WITH} SELECT count(*) AS sessions FROM rollouts r WHERE is_realtime_voice AND EXISTS (SELECT 1 FROM source_files s WHERE s.rollout_id = r.rollout_id AND is_present)")
def voice_sessions_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads.present_voice_rollouts(views.rollouts(spark, sf_dir), views.sources(spark, sf_dir)).agg(F.count("*").alias("sessions"))


@query(f"{WITH} SELECT count(*) FILTER (WHERE canonical_status = 'conflict' AND is_present) AS conflicts, count(*) FILTER (WHERE is_present) AS present FROM source_files")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.source_counts(views.sources(spark, sf_dir))


@query(f"{WITH} SELECT rollout_id, count(*) AS events, max(token_event_ordinal) + 1 AS next_ordinal FROM usage_events GROUP BY rollout_id")
def event_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.event_cursor(views.usage_events(spark, sf_dir))


@query(f"{WITH}, l AS (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY token_event_ordinal DESC) AS n FROM usage_events) SELECT rollout_id, token_event_ordinal, timestamp_epoch_ms, model, input_tokens FROM l WHERE n = 1")
def ledger_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations.ledger_tail(views.usage_events(spark, sf_dir)).select("rollout_id", "token_event_ordinal", "timestamp_epoch_ms", "model", "input_tokens")


@query(f"{WITH} SELECT rollout_id, string_agg(event_signature, '|' ORDER BY token_event_ordinal) AS signatures FROM usage_events GROUP BY rollout_id")
def signature_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = canonical.sequences(views.usage_events(spark, sf_dir), "rollout_id", F.col("event_signature"))
    return lists.select("rollout_id", F.array_join("sequence", "|").alias("signatures"))


# --- rules of the parser on tables -------------------------------------------------------------------------------------

_SNAPSHOT = "concat(CAST(input_tokens // 100000 AS VARCHAR), ':0:', CAST(output_tokens // 1000 AS VARCHAR), ':0:0')"


def _tuple(**values: Column | int) -> Column:
    return F.struct(*[F.lit(values.get(k, 0)).cast("long").alias(k) for k in ("input", "cached", "output", "reasoning", "total")])


def _counts(spark: SparkSession, sf_dir: str, usage_: Column, total: Column) -> DataFrame:
    """Each event as a token count of its rollout's log, as the parser sees it before it decides what counts."""
    rows = views.usage_events(spark, sf_dir).withColumns({"usage": usage_, "total": total, "ts": _iso(F.col("timestamp_epoch_ms")), "line": F.col("token_event_ordinal"), "path": F.col("rollout_id")})
    return rows.withColumns({"open": F.lit(True), "kind": F.lit("token_count"), "is_realtime_voice": F.lit(False)})


@query(f"{WITH}, s AS (SELECT rollout_id, token_event_ordinal, {_SNAPSHOT} AS snapshot FROM usage_events), l AS (SELECT *, lag(snapshot) OVER (PARTITION BY rollout_id ORDER BY token_event_ordinal) AS before FROM s) SELECT rollout_id, token_event_ordinal, snapshot FROM l WHERE before IS DISTINCT FROM snapshot")
def adjacent_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _tuple(input=F.expr("input_tokens DIV 100000"), output=F.expr("output_tokens DIV 1000"))
    kept = attribution.candidates(_counts(spark, sf_dir, _tuple(input=1), total)).where("drop_reason is null")
    return kept.select("rollout_id", "token_event_ordinal", F.col("cumulative_snapshot").alias("snapshot"))


@query(f"{WITH}, v AS (SELECT token_event_ordinal, input_tokens, output_tokens, cached_input_tokens + CASE WHEN token_event_ordinal % 7 = 0 THEN 1000000 ELSE 0 END AS cached, reasoning_output_tokens AS reasoning FROM usage_events) SELECT CASE WHEN input_tokens = 0 AND cached = 0 AND output_tokens = 0 AND reasoning = 0 THEN 'zero_breakdown' WHEN cached > input_tokens OR reasoning > output_tokens THEN 'invalid_relation' ELSE 'kept' END AS outcome, count(*) AS n FROM v GROUP BY 1")
def token_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    cached = F.col("cached_input_tokens") + F.when(F.col("token_event_ordinal") % 7 == 0, 1_000_000).otherwise(0)
    usage_ = _tuple(input=F.col("input_tokens"), cached=cached, output=F.col("output_tokens"), reasoning=F.col("reasoning_output_tokens"))
    counts = attribution.candidates(_counts(spark, sf_dir, usage_, _tuple(total=F.col("token_event_ordinal"))))
    return counts.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query(
    f"{WITH}, e AS (SELECT rollout_id, token_event_ordinal AS line, CASE WHEN agent_role = 'explorer' THEN concat('t', CAST(token_event_ordinal AS VARCHAR)) END AS turn_set, CASE WHEN agent_role = 'scout' THEN model END AS setting FROM usage_events) "
    "SELECT rollout_id, line, coalesce(last_value(turn_set IGNORE NULLS) OVER w, '') AS turn_id, coalesce(last_value(setting IGNORE NULLS) OVER w, 'unknown') AS model FROM e WINDOW w AS (PARTITION BY rollout_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
)
def turn_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of explorers state a turn, those of scouts a setting."""
    turn, setting = F.col("agent_role") == "explorer", F.col("agent_role") == "scout"
    lines = views.usage_events(spark, sf_dir).select(
        "rollout_id", F.col("rollout_id").alias("path"), F.col("token_event_ordinal").alias("line"), F.lit(True).alias("open"), F.lit(None).cast("string").alias("confirmed_turn"),
        F.when(turn, "turn_context").when(setting, "thread_settings_applied").otherwise("token_count").alias("kind"),
        F.when(turn, F.concat(F.lit("t"), F.col("token_event_ordinal").cast("string"))).alias("turn_id"), F.when(setting, F.col("model")).alias("settings_model"),
    )
    return attribution.with_turns(lines).select("rollout_id", "line", F.col("current_turn").alias("turn_id"), F.col("current_model").alias("model"))


@query(f"{WITH}, u AS (SELECT CAST(substr(rollout_id, 2) AS BIGINT) AS u, * FROM usage_events) SELECT concat(lpad(CAST(u AS VARCHAR), 8, '0'), '-0000-7000-8000-000000000000') AS conversation_id, arg_max(model, {{'a': timestamp_epoch_ms, 'b': token_event_ordinal}}) AS title FROM u WHERE u % 3 <> 0 GROUP BY u")
def title_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of titles in which each event names its rollout after its model; every third rollout has an id that the
    index may not have."""
    u = F.substring("rollout_id", 2, 20).cast("long")
    id_ = F.concat(F.lpad(u.cast("string"), 8, "0"), F.when(u % 3 == 0, "-0000-4000").otherwise("-0000-7000"), F.lit("-8000-000000000000"))
    rows = views.usage_events(spark, sf_dir).select(F.col("token_event_ordinal").alias("line"), id_.alias("id"), F.col("model").alias("title"), _iso(F.col("timestamp_epoch_ms")).alias("ts"))
    return records.latest_titles(rows)[0]


# a candidate copy lacks the last events of some rollouts and has other models or counts in some
_COPY = "SELECT rollout_id, token_event_ordinal, CASE WHEN CAST(substr(rollout_id, 2) AS BIGINT) % 7 = 3 AND token_event_ordinal % 50 = 0 THEN input_tokens + 1 ELSE input_tokens END AS v FROM usage_events"


@query(
    f"{WITH}, q AS ({_COPY}), x AS (SELECT rollout_id, max(token_event_ordinal) AS m FROM usage_events GROUP BY 1), q2 AS (SELECT q.* FROM q JOIN x USING (rollout_id) WHERE NOT (CAST(substr(rollout_id, 2) AS BIGINT) % 5 = 1 AND token_event_ordinal = m)), "
    "o AS (SELECT e.rollout_id, e.token_event_ordinal, input_tokens AS v FROM usage_events e JOIN x USING (rollout_id) WHERE NOT (CAST(substr(e.rollout_id, 2) AS BIGINT) % 5 = 2 AND e.token_event_ordinal = m)), "
    "l AS (SELECT rollout_id, list(v ORDER BY token_event_ordinal) AS s FROM o GROUP BY 1), n AS (SELECT rollout_id, list(v ORDER BY token_event_ordinal) AS s FROM q2 GROUP BY 1) "
    "SELECT rollout_id, CASE WHEN l.s[1:least(len(l.s), len(n.s))] <> n.s[1:least(len(l.s), len(n.s))] THEN 'diverged' WHEN len(l.s) = len(n.s) THEN 'equal' WHEN len(n.s) > len(l.s) THEN 'extension' ELSE 'shorter' END AS relation FROM l JOIN n USING (rollout_id)"
)
def sequence_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.usage_events(spark, sf_dir)
    user = F.substring("rollout_id", 2, 20).cast("long")
    last = F.max("token_event_ordinal").over(Window.partitionBy("rollout_id"))
    events = events.withColumn("_last", last == F.col("token_event_ordinal")).withColumn("_user", user)
    value = F.when((F.col("_user") % 7 == 3) & (F.col("token_event_ordinal") % 50 == 0), F.col("input_tokens") + 1).otherwise(F.col("input_tokens"))
    old = events.where(~((F.col("_user") % 5 == 2) & F.col("_last")))
    new = events.where(~((F.col("_user") % 5 == 1) & F.col("_last"))).withColumn("input_tokens", value).withColumn("path", F.col("rollout_id"))
    files = new.select("path", "rollout_id").distinct().join(old.select("rollout_id"), "rollout_id", "left_semi")
    return canonical.relations(files, new.drop("rollout_id"), old).select(F.col("path").alias("rollout_id"), F.col("identity_relation").alias("relation"))


_CANDIDATES = "SELECT concat('s', CAST(u % 40 AS VARCHAR)) AS rollout_id, CASE u % 3 WHEN 0 THEN 'extension' ELSE 'equal' END AS relation, u % 11 AS stable_length, la AS modified_at_epoch_ms, concat('/f', CAST(u AS VARCHAR)) AS file_path FROM (SELECT user_id AS u, max(epoch_us(ts) // 1000) AS la FROM events GROUP BY user_id) q"


@query(f"WITH c AS ({_CANDIDATES}), n AS (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY relation = 'extension' DESC, stable_length DESC, modified_at_epoch_ms DESC, file_path) AS n FROM c) SELECT rollout_id, file_path, relation FROM n WHERE n = 1")
def canonical_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = views._users(spark, sf_dir).selectExpr("concat('s', CAST(u % 40 AS STRING)) AS rollout_id", "CASE u % 3 WHEN 0 THEN 'extension' ELSE 'equal' END AS relation", "u % 11 AS stable_length", "la AS modified_at_epoch_ms", "concat('/f', CAST(u AS STRING)) AS file_path")
    return canonical.recovery_choice(u).select("rollout_id", "file_path", "relation")


_REVISIONS = "SELECT concat('s', CAST(u % 40 AS VARCHAR)) AS rollout_id, CASE WHEN u % 97 = 5 THEN 'canonical' ELSE 'candidate' END AS canonical_status, u % 7 AS byte_offset, u % 11 AS size_bytes, la AS modified_at_epoch_ms, concat('/f', CAST(u AS VARCHAR)) AS file_path FROM (SELECT user_id AS u, max(epoch_us(ts) // 1000) AS la FROM events GROUP BY user_id) q"


@query(f"WITH c AS ({_REVISIONS}), n AS (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY canonical_status = 'canonical' DESC, byte_offset DESC, size_bytes DESC, modified_at_epoch_ms DESC, file_path) AS n FROM c) SELECT rollout_id, file_path FROM n WHERE n = 1")
def revision_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The file that a rebuild takes, of all users' files dealt to forty rollouts."""
    u = views._users(spark, sf_dir).selectExpr("concat('s', CAST(u % 40 AS STRING)) AS rollout_id", "CASE WHEN u % 97 = 5 THEN 'canonical' ELSE 'candidate' END AS canonical_status", "u % 7 AS byte_offset", "u % 11 AS size_bytes", "la AS modified_at_epoch_ms", "concat('/f', CAST(u AS STRING)) AS file_path")
    return canonical.revision_choice(u).select("rollout_id", "file_path")


# --- ledger mutations ---------------------------------------------------------------------------------------------------

_STORED = ("rollout_id", "token_event_ordinal", "timestamp_epoch_ms", "model", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "event_signature")


@query(f"{WITH} SELECT rollout_id, count(*) AS events, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM usage_events GROUP BY rollout_id")
def append_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping batches of events, which together are all, appended: every event is there once."""
    events = views.usage_events(spark, sf_dir).select(*_STORED)
    old, new = events.where("token_event_ordinal % 10 < 5"), events.where("token_event_ordinal % 10 >= 3")
    table, _ = mutations.append_events(old, new)
    return table.groupBy("rollout_id").agg(F.count("*").alias("events"), F.sum("input_tokens").alias("input_tokens"))


@query(f"{WITH} SELECT rollout_id, count(*) AS events, max(model) AS model FROM (SELECT rollout_id, CASE WHEN thread_type = 'main' THEN 'replaced' ELSE model END AS model, thread_type, token_event_ordinal FROM usage_events) WHERE thread_type <> 'main' OR token_event_ordinal % 2 = 0 GROUP BY rollout_id")
def replace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.usage_events(spark, sf_dir)
    main = events.where("thread_type = 'main'")
    new = main.where("token_event_ordinal % 2 = 0").withColumn("model", F.lit("replaced"))
    table = mutations.replace_events(events.select(*_STORED), new.select(*_STORED), main.select("rollout_id"))
    return table.groupBy("rollout_id").agg(F.count("*").alias("events"), F.max("model").alias("model"))


def _full_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = {"agent_role": "'main'", "agent_path": "'/root'", "agent_nickname": "''", "canonical_source_path": "CAST(NULL AS STRING)", "created_at_epoch_ms": "1L", "updated_at_epoch_ms": "1L"}
    return views.rollouts(spark, sf_dir).selectExpr("*", *[f"{v} AS {k}" for k, v in blank.items()])


@query(
    f"{WITH}, u AS (SELECT *, CAST(substr(rollout_id, 2) AS BIGINT) AS k FROM rollouts) SELECT rollout_id, CASE WHEN k % 2 <> 0 OR k % 3 = 0 THEN 'new' ELSE project_name END AS project_name, "
    "CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN greatest(last_activity_epoch_ms, 1704500000000) WHEN k % 2 <> 0 THEN 1704500000000 ELSE last_activity_epoch_ms END AS last_activity_epoch_ms, CAST(CASE WHEN k % 2 = 0 THEN 1 ELSE 9 END AS BIGINT) AS created_at_epoch_ms FROM u"
)
def rollout_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rollout is old or new, and every sixth is both."""
    rollouts = _full_rollouts(spark, sf_dir).withColumn("_k", F.substring("rollout_id", 2, 20).cast("long"))
    old = rollouts.where("_k % 2 = 0").drop("_k")
    new = rollouts.where("_k % 2 <> 0 OR _k % 3 = 0").drop("_k").withColumn("project_name", F.lit("new")).withColumn("last_activity_epoch_ms", F.lit(1_704_500_000_000))
    return mutations.upsert_rollouts(old, new, 9).select("rollout_id", "project_name", "last_activity_epoch_ms", "created_at_epoch_ms")


@query(
    f"{WITH}, d AS (SELECT * FROM source_files UNION ALL SELECT concat(file_path, '.copy'), rollout_id, size_bytes, modified_at_epoch_ms, byte_offset, 'candidate', true, last_scanned_at_epoch_ms FROM source_files), "
    "p AS (SELECT rollout_id, concat(file_path, '.copy') AS path, CASE WHEN canonical_status = 'conflict' THEN file_path END AS resolved FROM source_files WHERE size_bytes % 3 = 0) "
    "SELECT file_path, CASE WHEN p.path IS NULL THEN canonical_status WHEN file_path = path THEN 'canonical' WHEN file_path = resolved OR canonical_status = 'canonical' THEN 'candidate' ELSE canonical_status END AS canonical_status FROM d LEFT JOIN p USING (rollout_id)"
)
def promote_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third source gives way to its copy."""
    first = views.sources(spark, sf_dir).withColumn("prefix_hash", F.lit("h")).withColumn("prefix_status", F.lit("verified")).withColumn("last_error", F.lit(None).cast("string"))
    copies = first.withColumn("file_path", F.concat("file_path", F.lit(".copy"))).withColumn("canonical_status", F.lit("candidate")).withColumn("is_present", F.lit(True))
    chosen = first.where("size_bytes % 3 = 0").select("rollout_id", F.concat("file_path", F.lit(".copy")).alias("path"), F.when(F.col("canonical_status") == "conflict", F.col("file_path")).alias("resolved"))
    none = spark.createDataFrame([], "file_path string, rollout_id string")
    _, sources, _ = mutations.promote(_full_rollouts(spark, sf_dir), first.unionByName(copies), none, chosen, 5)
    return sources.select("file_path", "canonical_status")


@query(f"{WITH} SELECT file_path, is_present AND size_bytes % 4 <> 2 AS is_present FROM source_files")
def mark_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = views.sources(spark, sf_dir)
    gone = mutations.missing_sources(sources, sources.where("size_bytes % 4 <> 2"))
    return mutations.mark_missing(sources, spark.createDataFrame([], "file_path string"), gone, 5)[0].select("file_path", "is_present")


@query(f"{WITH} SELECT rollout_id, CASE WHEN thread_type = 'main' AND NOT is_realtime_voice AND conversation_id LIKE '0000000%' THEN concat('title ', substr(conversation_id, 1, 8)) ELSE '' END AS thread_title FROM rollouts")
def titles_synchronised(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollouts = views.rollouts(spark, sf_dir)
    titles = rollouts.select("conversation_id").distinct().where("conversation_id like '0000000%'").select("conversation_id", F.concat(F.lit("title "), F.substring("conversation_id", 1, 8)).alias("title"))
    return mutations.synchronise_titles(rollouts, titles, authoritative=True)[0].select("rollout_id", "thread_title")


# --- scalar rules --------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id * 1000 + 7 END AS epoch_ms FROM events")
def uuidv7_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds back out of version-7 ids made from event ids; every third id has another version."""
    digits = F.lower(F.lpad(F.hex(F.col("event_id") * 1000 + 7), 12, "0"))
    made = F.concat(F.substring(digits, 1, 8), F.lit("-"), F.substring(digits, 9, 4), F.when(F.col("event_id") % 3 == 0, "-4").otherwise("-7"), F.lit("000-8000-000000000000"))
    return views.raw_events(spark, sf_dir).select("event_id", text.uuid_v7_epoch_ms(made).alias("epoch_ms"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) // 1000 WHEN 1 THEN epoch_us(ts) // 1000 - 19800000 ELSE NULL END AS epoch_ms FROM events")
def iso_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict timestamps: with Z, with +05:30, without a zone, with a blank for the T."""
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    kind = F.col("event_id") % 4
    value = F.when(kind == 0, F.concat(shown, F.lit("Z"))).when(kind == 1, F.concat(shown, F.lit("+05:30"))).when(kind == 2, shown).otherwise(F.replace(F.concat(shown, F.lit("Z")), F.lit("T"), F.lit(" ")))
    return views.raw_events(spark, sf_dir).select("event_id", text.timestamp_epoch_ms(value).alias("epoch_ms"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN event_type WHEN 3 THEN 'Codex' ELSE 'Codex' END AS project FROM events")
def project_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, name = F.col("event_id") % 5, F.col("event_type")
    cwd = F.when(kind == 0, F.concat(F.lit("/home/u/"), name)).when(kind == 1, F.concat(F.lit("  C:\\work\\"), name, F.lit("\\/ "))).when(kind == 2, name).when(kind == 3, " // ")
    return views.raw_events(spark, sf_dir).select("event_id", text.project_name(cwd).alias("project"))


_HOURS = "round(least(greatest({h}, 0.5), 336.0) / 0.5) * 0.5"


@query(
    f"WITH p AS (SELECT event_id, (event_id % 410) / 100.0::DOUBLE AS position FROM events), h AS (SELECT event_id, {_HOURS.format(h='CASE WHEN position < 1 THEN 0.5 + 11.5 * position WHEN position < 2 THEN 12 + 12 * (position - 1) WHEN position < 3 THEN 24 + 144 * (position - 2) WHEN position < 4 THEN 168 + 168 * (position - 3) ELSE 336 END')} AS hours FROM p) "
    "SELECT event_id, CAST(hours AS DOUBLE) AS hours, round(CASE WHEN hours <= 12 THEN (hours - 0.5) / 11.5 WHEN hours <= 24 THEN 1 + (hours - 12) / 12 WHEN hours <= 168 THEN 2 + (hours - 24) / 144 ELSE 3 + (hours - 168) / 168 END, 9) AS position FROM h"
)
def time_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = presentation.position_to_hours((F.col("event_id") % 410) / F.lit(100.0))
    return views.raw_events(spark, sf_dir).select("event_id", hours.alias("hours")).select("event_id", "hours", F.round(presentation.hours_to_position(F.col("hours")), 9).alias("position"))


@query("SELECT event_id, epoch_ms(CAST(ts AS DATE)) - 28800000 AS start_ms, epoch_ms(CAST(ts AS DATE) + CAST(event_id % 4 AS INTEGER)) - 28800000 AS end_ms, event_id % 4 > 0 AS valid FROM events")
def sgt_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("ts")
    start, end, valid = presentation.custom_range(day, F.date_add(day, (F.col("event_id") % 4).cast("int")))
    return views.raw_events(spark, sf_dir).select("event_id", start.alias("start_ms"), end.alias("end_ms"), valid.alias("valid"))


@query("WITH r AS (SELECT user_id, min(epoch_us(ts) // 1000) AS a FROM events GROUP BY user_id), l AS (SELECT user_id, a, lag(a + 1 + user_id % 3) OVER (ORDER BY a, concat('run', CAST(user_id AS VARCHAR))) AS before FROM r) SELECT concat('run', CAST(user_id AS VARCHAR)) AS run_id, before AS gap_start_ms, a AS gap_end_ms FROM l WHERE before < a")
def observation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short run for each user, at the user's first event; every third has no end but a last sign."""
    runs = views.raw_events(spark, sf_dir).groupBy("user_id").agg(F.min(F.expr("unix_millis(CAST(ts AS TIMESTAMP))")).alias("started_at_epoch_ms"))
    last, open_ = F.col("started_at_epoch_ms") + 1 + F.col("user_id") % 3, F.col("user_id") % 3 == 2
    return mutations.observation_gaps(runs.select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run_id"), "started_at_epoch_ms", F.when(~open_, last).alias("completed_at_epoch_ms"), F.when(open_, last).alias("heartbeat_at_epoch_ms")))




# --- whole logs -----------------------------------------------------------------------------------------------------------


def _logs(spark: SparkSession, sf_dir: str, first: Column, lines: list[Column]) -> DataFrame:
    """path, line, raw: a session log of each rollout, made of its events in the order of their time. `first` is the
    session_meta record, `lines` the records of an event; both are structs over the columns of the event view, `lo`
    and `hi` (the rollout's first and last time). No log is gathered in one value."""
    span = Window.partitionBy("rollout_id")
    order = span.orderBy("timestamp_epoch_ms", "token_event_ordinal")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # in the order of the places: one sort
    events = views.usage_events(spark, sf_dir).withColumns({"lo": F.min("timestamp_epoch_ms").over(whole), "hi": F.max("timestamp_epoch_ms").over(whole), "place": F.row_number().over(order) - 1})
    # the first event's row also brings the first line of its log
    shown = F.when(F.col("place") == 0, F.array(F.to_json(first))).otherwise(F.array().cast("array<string>"))
    rows = events.select("rollout_id", "place", F.posexplode(F.concat(shown, F.array(*[F.to_json(x) for x in lines]))).alias("at", "raw"))
    line = F.col("place") * len(lines) + F.col("at") + F.when(F.col("place") == 0, 0).otherwise(1)
    return rows.select(F.concat(F.lit("/logs/rollout-2026-x-"), F.col("rollout_id"), F.lit(".jsonl")).alias("path"), line.alias("line"), "raw")


def _record(kind: str, at: Column, **payload) -> Column:
    return F.struct(at.alias("timestamp"), F.lit(kind).alias("type"), F.struct(*[v.alias(k) for k, v in payload.items()]).alias("payload"))


def _iso(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _event_lines() -> list[Column]:
    at, turn = _iso(F.col("timestamp_epoch_ms")), F.concat(F.lit("t"), F.col("token_event_ordinal").cast("string"))
    tuple_ = lambda i, o: F.struct(i.alias("input_tokens"), F.col("cached_input_tokens"), o.alias("output_tokens"), F.col("reasoning_output_tokens"), (i + o).alias("total_tokens"))
    usage_ = tuple_(F.col("input_tokens"), F.col("output_tokens"))
    total = tuple_(F.col("token_event_ordinal"), F.col("output_tokens"))
    return [
        _record("event_msg", at, type=F.lit("task_started"), turn_id=turn, started_at=F.expr("timestamp_epoch_ms DIV 1000")), _record("turn_context", at, turn_id=turn, model=F.col("model")),
        _record("event_msg", at, type=F.lit("token_count"), info=F.struct(usage_.alias("last_token_usage"), total.alias("total_token_usage"))),
    ]


def _parse(lines: DataFrame) -> dict[str, DataFrame]:
    """The logs' lines (path, line, raw), read once and attributed."""
    rows = cut(records.typed(lines), "records")
    return attribution.parse(rows, tasks=attribution.spread(rows))


_PARSED = ("rollout_id", "token_event_ordinal", "timestamp_epoch_ms", "model", "input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")


def _parsed_sql(where: str) -> str:
    return (
        f"{WITH}, s AS (SELECT *, min(timestamp_epoch_ms) OVER (PARTITION BY rollout_id) AS lo, max(timestamp_epoch_ms) OVER (PARTITION BY rollout_id) AS hi FROM usage_events) "
        f"SELECT rollout_id, row_number() OVER (PARTITION BY rollout_id ORDER BY timestamp_epoch_ms, token_event_ordinal) - 1 AS token_event_ordinal, {', '.join(_PARSED[2:])} FROM s "
        f"WHERE (input_tokens > 0 OR output_tokens > 0) AND {where}"
    )


@query(_parsed_sql("true"))
def parse_rollout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs made of the events, split, read and attributed again: every event with tokens comes back."""
    first = _record("session_meta", _iso(F.col("lo")), id=F.col("rollout_id"), session_id=F.lit("s"), cwd=F.lit("/w/p"))
    return _parse(_logs(spark, sf_dir, first, _event_lines()))["events"].select(*_PARSED)


@query(_parsed_sql("timestamp_epoch_ms // 1000 > ((lo + hi) // 2) // 1000"))
def fork_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of forks at the middle of their time: only what started later counts."""
    first = _record("session_meta", _iso(F.expr("(lo + hi) DIV 2")), id=F.col("rollout_id"), forked_from_id=F.lit("parent"))
    return _parse(_logs(spark, sf_dir, first, _event_lines()))["events"].select(*_PARSED)


_KINDS = ("", "\0\0", "{", "[1]", '{"type": "note"}')


@query("SELECT concat('/logs/', CAST(event_id AS VARCHAR)) AS path, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS blank, CASE WHEN event_id % 5 = 1 THEN 1 ELSE 0 END AS null_padding, CASE WHEN event_id % 5 = 2 THEN 1 ELSE 0 END AS malformed, CASE WHEN event_id % 5 = 3 THEN 1 ELSE 0 END AS non_object, CASE WHEN event_id % 5 = 4 THEN 2 ELSE 1 END AS object FROM events")
def record_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of two lines for each event: one of five kinds, then an object."""
    counts = records.class_counts(records.typed(_two_lines(spark, sf_dir)))
    return counts.select("path", *[F.col(c).cast("int").alias(c) for c in ("blank", "null_padding", "malformed", "non_object", "object")])


@query("SELECT concat('/logs/', CAST(event_id AS VARCHAR)) AS path FROM events WHERE event_id % 5 IN (2, 3)")
def damaged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the same logs, those with a record that is neither parsed nor harmless."""
    return records.damaged_files(records.typed(_two_lines(spark, sf_dir)))


def _two_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(x) for x in _KINDS])
    lines = F.array(F.get(kinds, (F.col("event_id") % 5).cast("int")), F.lit(_KINDS[4]))
    return views.raw_events(spark, sf_dir).select(F.concat(F.lit("/logs/"), F.col("event_id").cast("string")).alias("path"), F.posexplode(lines).alias("line", "raw"))


@query(f"{WITH} SELECT rollout_id, concat(project_name, ' - ', substr(conversation_id, 1, 12), ' - untitled') AS label FROM rollouts")
def thread_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.rollouts(spark, sf_dir).select("rollout_id", text.thread_label(F.col("project_name"), F.col("conversation_id"), F.col("thread_title")).alias("label"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('0190', lower(lpad(hex(event_id), 4, '0')), '-0000-7000-8000-000000000000') ELSE concat('legacy-', CAST(event_id AS VARCHAR)) END AS rollout_id FROM events")
def fallback_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v7 = F.concat(F.lit("0190"), F.lpad(F.hex("event_id"), 4, "0"), F.lit("-0000-7000-8000-000000000000"))
    name = F.when(F.col("event_id") % 2 == 0, v7).otherwise(F.concat(F.lit("legacy-"), F.col("event_id").cast("string")))
    path = F.concat(F.lit("/logs/a-b/rollout-2026-"), name, F.lit(".jsonl"))
    return views.raw_events(spark, sf_dir).select("event_id", text.fallback_rollout_id(path).alias("rollout_id"))
