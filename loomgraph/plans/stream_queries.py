"""Queries over event sequences: bands, rates, presence, sessions, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X
from loomgraph.operators import access as A
from loomgraph.operators import folds as D
from loomgraph.operators import search as S
from loomgraph.sources.tables import table

_ORDER = ["ts", "event_id"]
#: The moment up to which presence and sessions are judged: the end of the events' month.
_NOW = 1706745600


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their time in microseconds."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", "user_id", micros.alias("ts"), "event_type", "value")


def deadband(spark: SparkSession, d: str) -> DataFrame:
    updates = _events(spark, d).withColumns({"x": F.col("value"), "v": F.col("value") / 100.0})
    return D.deadband(updates, "user_id", _ORDER, ["x"], ["v"], 50.0, 0.6).select("event_id", "user_id")


def throttle(spark: SparkSession, d: str) -> DataFrame:
    return D.throttle(_events(spark, d), "user_id", _ORDER, "ts", 8 * 3600 * 1_000_000).select("event_id", "user_id")


def debounce(spark: SparkSession, d: str) -> DataFrame:
    return D.debounce(_events(spark, d), "user_id", _ORDER, "ts", 6 * 3600 * 1_000_000).select("event_id", "user_id")


def adaptive_rate(spark: SparkSession, d: str) -> DataFrame:
    motions = _events(spark, d).withColumn("motion", F.col("value") / 200.0)
    return D.adaptive_rate(motions, "user_id", _ORDER, "motion").select("event_id", F.col("rate").cast("int").alias("rate"))


def ema_level(spark: SparkSession, d: str) -> DataFrame:
    levels = D.smoothed(_events(spark, d).withColumn("rms", F.col("value") / 1000.0), "user_id", _ORDER, "rms")
    return levels.select("event_id", X.rounded("level", 6).alias("level"), X.rounded("shown", 6).alias("shown"))


def hysteresis(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumns({"confidence": F.col("value") / 100.0, "active": F.col("event_id") % 2 == 0})
    return D.hysteresis(rows, "user_id", _ORDER, "confidence", "active").select("event_id", "state")


def selection_toggle(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("node", F.col("event_id") % 4)
    return D.selection(rows, "user_id", _ORDER, "node").select("event_id", "chosen")


def presence_active(spark: SparkSession, d: str) -> DataFrame:
    updates = _events(spark, d).select("user_id", (F.col("ts") / 1e6).alias("ts"), F.col("event_id").alias("seq"), "value")
    return A.live_presence(updates, F.lit(float(_NOW)), 72 * 3600.0, local=3).select("user_id", F.col("seq").alias("event_id"), "value")


def session_valid(spark: SparkSession, d: str) -> DataFrame:
    last = _events(spark, d).groupBy("user_id").agg(F.floor(F.max("ts") / 1_000_000).alias("last_seen"), F.max_by("event_type", F.struct(*_ORDER)).alias("presented"))
    sessions = last.withColumn("token", F.when(F.col("user_id") % 5 != 0, F.col("presented")))
    return A.session_valid(sessions, F.lit(_NOW), 72 * 3600).select("user_id", "last_seen", "valid")


def component_metrics(spark: SparkSession, d: str) -> DataFrame:
    renders = _events(spark, d).select(F.col("event_type").alias("component"), F.col("value").alias("ms"), "ts", F.col("event_id").alias("seq"))
    out = D.component_metrics(renders)
    return out.select("component", "renders", X.rounded("total", 4).alias("total"), X.rounded("mean", 6).alias("mean"), "peak", "last", "slow")


def recent_entries(spark: SparkSession, d: str) -> DataFrame:
    return S.recent(_events(spark, d).select(F.col("user_id").alias("id"), "ts", F.col("event_id").alias("seq")), 10)


def history_tail(spark: SparkSession, d: str) -> DataFrame:
    """A bounded history: the latest five events of each user."""
    return D.history_tail(_events(spark, d), "user_id", _ORDER, 5).select("event_id", "user_id")


_ACTION = {"view": "set", "signup": "set", "click": "undo", "purchase": "redo", "error": "set"}


def undo_history(spark: SparkSession, d: str) -> DataFrame:
    """Events as steps of a settings editor: views and errors set a value, clicks undo, purchases redo; 4 entries are kept."""
    action = F.when(F.col("event_id") % 97 == 0, "clear").otherwise(F.create_map(*[F.lit(x) for kv in _ACTION.items() for x in kv])[F.col("event_type")])
    steps = _events(spark, d).withColumns({"action": action, "setting": (F.col("event_id") % 3).cast("string")})
    return D.undo_history(steps, "user_id", _ORDER, "action", "setting", 4).select("event_id", "current", "position", "entries", "can_undo", "can_redo")


_LEVEL = {"view": "debug", "click": "info", "purchase": "warn", "error": "error"}


def _log(spark: SparkSession, d: str) -> DataFrame:
    """Events as log entries."""
    level = F.create_map(*[F.lit(x) for kv in _LEVEL.items() for x in kv])[F.col("event_type")]
    return _events(spark, d).withColumn("level", level)


def log_levels(spark: SparkSession, d: str) -> DataFrame:
    """Log entries that are shown from the level of warnings on."""
    rows = _log(spark, d).filter(X.at_least(F.col("level"), "warn"))
    return rows.groupBy("event_type", X.level_rank(F.col("level")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def log_tail(spark: SparkSession, d: str) -> DataFrame:
    """The log as it is kept: its latest thousand entries."""
    return D.log_tail(_log(spark, d), _ORDER).select("event_id", "level")


def rms_levels(spark: SparkSession, d: str) -> DataFrame:
    out = _events(spark, d).groupBy("user_id").agg(X.mean_square_root(F.col("value")).alias("rms"), (F.avg("value") / 255.0).alias("mean_level"))
    return out.select("user_id", X.rounded("rms", 6).alias("rms"), X.rounded("mean_level", 6).alias("mean_level"))


def session_cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Users seen in the last 36 hours of the month."""
    users = _events(spark, d).groupBy("user_id").agg(F.floor(F.max("ts") / 1_000_000).alias("last_seen"))
    return A.recent_sessions(users, F.lit(_NOW), 36)


def chat_answer_end(spark: SparkSession, d: str) -> DataFrame:
    """Turns as chunks; the first one whose number leaves 5 of 6 ends the answer."""
    return D.answers(table(spark, d, "conversations"), "conv_id", "turn", "text", end=F.col("turn") % 6 == 5)


def audio_answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns as spoken answers: a header and as many bytes as the text has; some with faults."""
    header = F.unhex(F.lit("52494646" + "24000000" + "57415645" + "666D7420" + "10000000" + "0100" + "0100" + "44AC0000" + "88580100" + "0200" + "1000" + "64617461" + "00000000"))
    kind = (F.col("conv_id") * 7 + F.col("turn")) % 7
    sound = F.when(kind == 0, F.unhex(F.repeat(F.lit("00"), 44))).when(kind == 1, F.substring(header, 1, 20)).otherwise(F.concat(header, F.col("text").cast("binary")))
    body = F.struct(F.col("text").alias("answer"), F.when(kind == 2, F.lit("%%%")).when(kind != 3, F.translate(F.base64(sound), "\r\n", "")).alias("audio"))
    json = F.when(kind == 4, F.to_json(F.struct(F.lit("down").alias("error"), body.alias("data")))).when(kind == 5, F.to_json(body)).otherwise(F.to_json(F.struct(body.alias("data"))))
    rows = table(spark, d, "conversations").filter("length(text) > 0").select("conv_id", "turn", json.alias("json"))
    out = D.audio_answers(rows)
    return out.select("conv_id", "turn", "status", "answer", F.octet_length("audio").cast("long").alias("bytes"), F.col("header.rate").alias("rate"))


def deflate_marks(spark: SparkSession, d: str) -> DataFrame:
    """Payloads whose first byte is x in some levels of compression, and others."""
    second = F.element_at(F.array(*map(F.lit, ["01", "5E", "9C", "DA", "9D"])), (F.col("event_id") % 5 + 1).cast("int"))
    raw = F.unhex(F.concat(F.when(F.col("user_id") % 2 == 0, "78").otherwise("79"), second, F.lit("AB")))
    return _events(spark, d).select("event_id", X.is_deflated(raw).alias("deflated"))


def chat_answer_fold(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "conversations").filter("role = 'assistant'")
    return D.answers(chunks, "conv_id", "turn", "text")


def sse_answers(spark: SparkSession, d: str) -> DataFrame:
    """Turns as server-sent lines: assistant turns carry answers, user turns are comments, the end has none."""
    body = F.to_json(F.struct(F.struct(F.col("text").alias("answer")).alias("data")))
    line = F.when(F.col("role") == "user", F.concat(F.lit(": "), "text")).when(F.col("turn") % 5 == 4, F.lit('data: {"data": true}')).otherwise(F.concat(F.lit("data: "), body))
    lines = table(spark, d, "conversations").select("conv_id", "turn", line.alias("line"))
    return D.stream_answers(lines).select("conv_id", "turn", "answer")


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Turns with something other than white space; some are blanks, tabs, line feeds or wide blanks alone."""
    blank = F.element_at(F.array(*map(F.lit, ["  ", "\n\t", "\u3000", "\u00a0 x", ""])), (F.col("conv_id") % 5 + 1).cast("int"))
    turns = table(spark, d, "conversations").withColumn("text", F.when(F.col("turn") % 3 == 1, blank).otherwise(F.col("text")))
    return D.transcripts(turns).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


def user_events_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling daily counts, the batch form of the streaming query."""
    day = F.window(F.col("ts").cast("timestamp"), "1 day")["start"]
    return table(spark, d, "events").groupBy(F.date_format(day, "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


_SEQ = "e AS (SELECT event_id, user_id, value, event_type, epoch_us(ts) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"
_LAST = "l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS b FROM events)"


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


CATALOG = {
    "deadband": (deadband, f"""WITH RECURSIVE {_SEQ}, f AS (SELECT event_id, user_id, r, value AS s, true AS sent FROM e WHERE r = 1 UNION ALL
      SELECT e.event_id, e.user_id, e.r, CASE WHEN (e.value - f.s) ** 2 > 2500 OR (e.value / {_d(100.0)} - f.s / {_d(100.0)}) ** 2 > {_d(0.6 * 0.6)} THEN e.value ELSE f.s END,
      (e.value - f.s) ** 2 > 2500 OR (e.value / {_d(100.0)} - f.s / {_d(100.0)}) ** 2 > {_d(0.6 * 0.6)} FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
      SELECT event_id, user_id FROM f WHERE sent"""),
    "throttle": (throttle, f"""WITH RECURSIVE {_SEQ}, f AS (SELECT event_id, user_id, r, ts AS a, true AS ok FROM e WHERE r = 1 UNION ALL
      SELECT e.event_id, e.user_id, e.r, CASE WHEN e.ts - f.a >= 28800000000 THEN e.ts ELSE f.a END, e.ts - f.a >= 28800000000 FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
      SELECT event_id, user_id FROM f WHERE ok"""),
    "debounce": (debounce, f"WITH {_SEQ}, n AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY r) AS nx FROM e) SELECT event_id, user_id FROM n WHERE nx IS NULL OR nx - ts >= 21600000000"),
    "adaptive_rate": (adaptive_rate, f"""WITH RECURSIVE {_SEQ}, m AS (SELECT *, CASE WHEN value / {_d(200.0)} > 0.05 THEN 60 ELSE 5 END AS t FROM e),
      f AS (SELECT event_id, user_id, r, least(greatest(CAST(trunc(5 * {_d(0.9)} + t * ({_d(1.0)} - {_d(0.9)})) AS INTEGER), 5), 60) AS rate FROM m WHERE r = 1 UNION ALL
      SELECT m.event_id, m.user_id, m.r, least(greatest(CAST(trunc(f.rate * {_d(0.9)} + m.t * ({_d(1.0)} - {_d(0.9)})) AS INTEGER), 5), 60) FROM f JOIN m ON m.user_id = f.user_id AND m.r = f.r + 1)
      SELECT event_id, rate FROM f"""),
    "ema_level": (ema_level, f"""WITH RECURSIVE {_SEQ}, f AS (SELECT event_id, user_id, r, ({_d(1.0)} - {_d(0.8)}) * value / {_d(1000.0)} AS level FROM e WHERE r = 1 UNION ALL
      SELECT e.event_id, e.user_id, e.r, {_d(0.8)} * f.level + ({_d(1.0)} - {_d(0.8)}) * e.value / {_d(1000.0)} FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
      SELECT event_id, round(level, 6) AS level, round(least(10 * level, 1), 6) AS shown FROM f"""),
    "hysteresis": (hysteresis, f"""WITH RECURSIVE {_SEQ}, f AS (SELECT event_id, user_id, r, value > 80 AND event_id % 2 = 0 AS state FROM e WHERE r = 1 UNION ALL
      SELECT e.event_id, e.user_id, e.r, CASE WHEN f.state THEN e.event_id % 2 = 0 OR e.value / {_d(100.0)} > 0.5 ELSE e.value / {_d(100.0)} > 0.8 AND e.event_id % 2 = 0 END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
      SELECT event_id, state FROM f"""),
    "selection_toggle": (selection_toggle, f"""WITH RECURSIVE {_SEQ}, f AS (SELECT event_id, user_id, r, [event_id % 4] AS c FROM e WHERE r = 1 UNION ALL
      SELECT e.event_id, e.user_id, e.r, CASE WHEN list_contains(f.c, e.event_id % 4) THEN list_filter(f.c, lambda x: x <> e.event_id % 4) WHEN len(f.c) >= 2 THEN list_append(f.c[2:], e.event_id % 4) ELSE list_append(f.c, e.event_id % 4) END
      FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) SELECT event_id, array_to_string(c, ',') AS chosen FROM f"""),
    "presence_active": (presence_active, f"WITH {_LAST} SELECT user_id, event_id, value FROM l WHERE b = 1 AND ({_NOW} - epoch_us(ts) / {_d(1e6)} < 259200 OR user_id = 3)"),
    "session_valid": (session_valid, f"WITH {_LAST} SELECT user_id, epoch_us(ts) // 1000000 AS last_seen, user_id % 5 <> 0 AND {_NOW} - epoch_us(ts) // 1000000 <= 259200 AS valid FROM l WHERE b = 1"),
    "component_metrics": (component_metrics, """SELECT event_type AS component, count(*) AS renders, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, max(value) AS peak,
      arg_max(value, row(ts, event_id)) AS last, count(*) FILTER (value > 16.67) AS slow FROM events GROUP BY event_type"""),
    "recent_entries": (recent_entries, f"WITH {_LAST} SELECT user_id AS id, epoch_us(ts) AS ts FROM l WHERE b = 1 ORDER BY ts DESC, event_id DESC LIMIT 10"),
    "history_tail": (history_tail, f"WITH {_LAST} SELECT event_id, user_id FROM l WHERE b <= 5"),
    "undo_history": (undo_history, f"""WITH RECURSIVE {_SEQ}, a AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'clear' WHEN event_type = 'click' THEN 'undo' WHEN event_type = 'purchase' THEN 'redo' ELSE 'set' END AS act,
      CAST(event_id % 3 AS VARCHAR) AS v FROM e), f AS (SELECT event_id, user_id, r, h, CASE WHEN len(h) = 1 THEN 1 ELSE 0 END AS c, h[1] AS last
      FROM (SELECT *, CASE WHEN act = 'set' THEN [v] ELSE CAST([] AS VARCHAR[]) END AS h FROM a WHERE r = 1) UNION ALL
      SELECT a.event_id, a.user_id, a.r, CASE WHEN act = 'clear' THEN CAST([] AS VARCHAR[]) WHEN act = 'set' AND f.last IS DISTINCT FROM v THEN list_append(f.h[greatest(f.c - 2, 1):f.c], v) ELSE f.h END,
      CASE act WHEN 'clear' THEN 0 WHEN 'undo' THEN least(greatest(f.c - 1, 1), f.c) WHEN 'redo' THEN least(f.c + 1, len(f.h)) ELSE CASE WHEN f.last IS DISTINCT FROM v THEN least(f.c + 1, 4) ELSE f.c END END,
      CASE act WHEN 'clear' THEN NULL WHEN 'set' THEN v ELSE f.last END FROM f JOIN a ON a.user_id = f.user_id AND a.r = f.r + 1)
      SELECT event_id, h[c] AS current, CAST(c AS BIGINT) AS position, len(h) AS entries, c > 1 AS can_undo, c < len(h) AS can_redo FROM f"""),
    "log_levels": (log_levels, "SELECT event_type, CASE event_type WHEN 'purchase' THEN 2 ELSE 3 END AS level, count(*) AS n FROM events WHERE event_type IN ('purchase', 'error') GROUP BY event_type"),
    "log_tail": (log_tail, "SELECT event_id, CASE event_type WHEN 'view' THEN 'debug' WHEN 'click' THEN 'info' WHEN 'purchase' THEN 'warn' WHEN 'error' THEN 'error' END AS level FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000"),
    "session_cleanup": (session_cleanup, f"WITH {_LAST} SELECT user_id, epoch_us(ts) // 1000000 AS last_seen FROM l WHERE b = 1 AND {_NOW} - epoch_us(ts) // 1000000 < 36 * 3600"),
    "chat_answer_end": (chat_answer_end, """WITH e AS (SELECT conv_id, min(turn) AS z FROM conversations WHERE turn % 6 = 5 GROUP BY conv_id)
      SELECT c.conv_id, string_agg(text, '' ORDER BY turn) AS answer, count(*) AS n FROM conversations c LEFT JOIN e ON e.conv_id = c.conv_id WHERE z IS NULL OR turn < z GROUP BY c.conv_id"""),
    "audio_answers": (audio_answers, """WITH k AS (SELECT *, (conv_id * 7 + turn) % 7 AS k FROM conversations WHERE length(text) > 0)
      SELECT conv_id, turn, CASE k WHEN 0 THEN 'bad header' WHEN 1 THEN 'too short' WHEN 2 THEN 'bad base64' WHEN 3 THEN 'no audio' WHEN 4 THEN 'error' ELSE 'ok' END AS status,
      CASE WHEN k > 4 THEN text END AS answer, CASE WHEN k > 4 THEN 44 + strlen(text) END AS bytes, CASE WHEN k > 4 THEN 44100 END AS rate FROM k"""),
    "deflate_marks": (deflate_marks, "SELECT event_id, user_id % 2 = 0 AND event_id % 5 < 4 AS deflated FROM events"),
    "rms_levels": (rms_levels, f"SELECT user_id, round(sqrt(avg(value * value)), 6) AS rms, round(avg(value) / {_d(255.0)}, 6) AS mean_level FROM events GROUP BY user_id"),
    "chat_answer_fold": (chat_answer_fold, "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS answer, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id"),
    "sse_answers": (sse_answers, "SELECT conv_id, turn, text AS answer FROM conversations WHERE role <> 'user' AND turn % 5 <> 4 AND length(text) > 0"),
    "transcripts": (transcripts, "SELECT role, count(*) AS n FROM conversations WHERE CASE WHEN turn % 3 = 1 THEN conv_id % 5 = 3 ELSE text IS NOT NULL AND regexp_replace(text, '\\s', '', 'g') <> '' END GROUP BY role"),
    "user_events_windows": (user_events_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
