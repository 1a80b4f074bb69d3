"""Queries over settings documents and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import exprs as X
from loomgraph.operators import graph as G
from loomgraph.operators import settings as N
from loomgraph.sources.tables import spread, table

#: Rows of a task where documents are taken apart row by row; a Parquet file of a few megabytes holds a million of them.
_DOCUMENTS = 1 << 14


def _dealt(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table of short rows, dealt evenly to tasks."""
    rows = table(spark, d, name)
    return spread(rows, rows.count(), most=_DOCUMENTS)


def settings_path_get(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", N.get_path(F.col("props"), "k").cast("long").alias("k"), N.get_path(F.col("props"), "missing.x").alias("missing"))


def settings_path_set(spark: SparkSession, d: str) -> DataFrame:
    """A new nested value beside the old one, read back by its path."""
    changed = N.set_path(F.col("props"), "view.sizes[1]", F.col("value").cast("string"))
    return _dealt(spark, d, "events").select("event_id", N.get_path(changed, "k").cast("long").alias("k"), N.get_path(changed, "view.sizes[1]").cast("double").alias("size"), N.set_path(F.col("props"), "k.deep", F.lit("1")).alias("through"), N.get_path(N.set_path(F.col("props"), "view.size", F.col("value").cast("string")), "view.size").cast("double").alias("named"))


def settings_deep_merge(spark: SparkSession, d: str) -> DataFrame:
    """props below a view section, overlaid with one that changes part of it."""
    first = F.concat(F.lit('{"view":'), F.col("props"), F.lit(',"name":"a"}'))
    size = F.concat(F.lit('{"view":{"size":'), F.col("value").cast("string"))
    second = F.when(F.col("event_id") % 2 == 0, F.concat(size, F.lit('},"name":"'), "event_type", F.lit('"}'))).otherwise(F.concat(size, F.lit("}}")))
    merged = N.deep_merged(first, second)
    return _dealt(spark, d, "events").select("event_id", N.get_path(merged, "view.k").cast("long").alias("k"), N.get_path(merged, "view.size").cast("double").alias("size"), N.get_path(merged, "name").alias("name"))


def partial_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    changes = rows.filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "renamed").alias("c_name"))
    return N.partial_merge(rows, changes, "c_custkey")


def section_merge(spark: SparkSession, d: str) -> DataFrame:
    new = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"physics":{"k":'), F.col("event_id").cast("string"), F.lit("}}")))
    old = F.concat(F.lit('{"physics":'), F.col("props"), F.lit("}"))
    merged = N.section_merge(old, new, {"physics": "struct<k:bigint>", "labels": "struct<size:double>"})
    return table(spark, d, "events").select("event_id", merged["physics"]["k"].alias("k"), merged["labels"]["size"].alias("size"))


def visible_settings(spark: SparkSession, d: str) -> DataFrame:
    props = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"other":"'), "event_type", F.lit('","hidden":1}'))).otherwise(F.col("props"))
    shown = N.visible(props, ["k", "other"])
    return table(spark, d, "events").select("event_id", F.array_join(F.map_keys(shown), ",").alias("names"), shown["k"].alias("k"), shown["other"].alias("other"))


def case_convert(spark: SparkSession, d: str) -> DataFrame:
    snake = F.regexp_replace("p_name", " ", "_")
    camel = X.camel(snake)
    return table(spark, d, "part").select("p_partkey", camel.alias("camel"), X.snake(camel).alias("snake"), X.spaced_title(camel).alias("title"))


def label_formats(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    return parts.select("p_partkey", X.slug(F.col("p_name")).alias("slug"), X.truncated(F.col("p_name"), 6).alias("short"), X.size_label(F.col("p_size") * 512).alias("size_label"))


def client_ids(spark: SparkSession, d: str) -> DataFrame:
    """Keys with and without digits in front; the key itself is the row's index."""
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.col("c_custkey").cast("string"), F.lit("abc"))).when(F.col("c_custkey") % 3 == 1, F.col("c_name")).otherwise(F.lit("99999999999"))
    return table(spark, d, "customer").select("c_custkey", X.client_id(text, F.col("c_custkey")).alias("client_id"))


def path_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """Everyone notified of a change at type.brand.key: how many changes touch each path."""
    path = F.concat_ws(".", "p_type", F.regexp_replace("p_brand", "#", ""), F.col("p_size").cast("string"))
    return table(spark, d, "part").select(F.explode(X.path_prefixes(path)).alias("path")).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


def encoded_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/pages/"), F.url_encode(F.col("p_name")))
    return table(spark, d, "part").select("p_partkey", path.alias("path"), F.base64(F.col("p_name").cast("binary")).alias("content"))


def csv_lists(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat_ws(" ,\t\u3000", "c_name", F.lit("\n"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")), F.when(F.col("c_custkey") % 2 == 0, F.lit("\u00a0x\r\n")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(X.csv_list(text), "|").alias("entries"), F.size(X.csv_list(text)).cast("long").alias("n"))


def backoff_series(spark: SparkSession, d: str) -> DataFrame:
    """Reconnect delays for each customer's number of orders, five attempts at most."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.least(F.count(F.lit(1)), F.lit(5)).alias("n"))
    return n.select("o_custkey", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("attempt")).withColumn("delay", X.rounded(X.backoff(F.col("attempt")), 6))


def palette(spark: SparkSession, d: str) -> DataFrame:
    """The colours of all customers in order of their keys; the one with the least key above 100 is the local user."""
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    local = users.filter("id > 100").agg(F.min("id")).first()[0]
    return G.coloured(users, local)


def gesture_confidence(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    return events.select("event_id", X.rounded(X.closeness(F.col("value"), 50.0), 6).alias("confidence"), X.rounded(X.extension(F.col("value") / 40.0, F.lit(0.25)), 6).alias("extension"))


def hand_gestures(spark: SparkSession, d: str) -> DataFrame:
    """Hands whose joints lie on the axes, some of them untracked, told as pinch, point and grip."""
    v, n = F.col("value") / 1000.0, F.col("event_id")
    joint = lambda x=0.0, y=0.0, z=0.0, seen=F.lit(True): F.when(seen, F.struct(F.lit(x).cast("double").alias("x"), (y if isinstance(y, Column) else F.lit(y)).alias("y"), (z if isinstance(z, Column) else F.lit(z)).alias("z")))
    tip = {"thumb": joint(), "index": joint(y=v / 2.0), "middle": joint(y=v / 3.0, seen=n % 11 != 0), "ring": joint(y=v / 4.0), "pinky": joint(y=v / 5.0)}
    base = {"thumb": joint(seen=n % 5 != 0), "index": joint(seen=n % 7 != 0), "middle": joint(), "ring": joint(), "pinky": joint()}
    wrist = joint(z=(n % 4) * F.lit(0.02), seen=n % 13 != 0)
    made = X.gestures(tip, base, wrist)
    return table(spark, d, "events").select("event_id", *((X.rounded(c, 6) if "_" in name else c).alias(name) for name, c in made.items()))


def settings_checked_set(spark: SparkSession, d: str) -> DataFrame:
    """Values set in typed settings: some lead through a number or a null, some have the wrong type, some make objects."""
    path = F.col("event_id") % 5
    tree = F.concat(F.lit('{"view":{"size":1.5,"name":"n"},"flag":true,"none":null,"count":'), F.col("user_id").cast("string"), F.lit("}"))
    types = {"view.size": "number", "view.name": "string", "flag": "boolean", "count": "whole"}
    put = lambda where, value: N.checked_set(tree, where, value, types)
    number, word = F.col("event_id").cast("string"), F.concat(F.lit('"'), "event_type", F.lit('"'))
    done = F.when(path == 0, put("view.size", number)).when(path == 1, put("view.size", word)).when(path == 2, put("count.deep.er", number)).when(path == 3, put("none.deep", number)).otherwise(put("view.new.part", word))
    rows = _dealt(spark, d, "events").select("event_id", done.alias("r"))
    read = lambda where: N.get_path(F.col("r.settings"), where)
    return rows.select("event_id", F.col("r.error").alias("error"), read("view.size").cast("double").alias("size"), read("view.new.part").alias("part"), read("view.name").alias("name"))


def setting_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Settings by category, in kebab-case and camelCase; null where there is none."""
    fields = [F.col("p_size").alias("base_size"), F.col("p_name").alias("label_text"), F.col("p_brand").alias("enable_s_s_a_o"), F.col("p_type").alias("enable_ssao")]
    tree = F.to_json(F.struct(F.struct(F.struct(*fields).alias("node_style")).alias("visual")))
    lookup = lambda c, s: N.get_setting(tree, c, s)
    category = N.get_category(tree, "visual.node_style")
    return table(spark, d, "part").select(
        "p_partkey", lookup("visual.node-style", "baseSize").cast("int").alias("size"), lookup("visual.nodeStyle", "label-text").alias("label"),
        lookup("visual", "missing").alias("missing"), lookup("visual.NodeStyle", "enableSSAO").alias("capitals"), N.get_path(category, "label_text").alias("by_category"), N.get_path(tree, "visual.none", default=F.lit("none")).alias("fallback"),
    )


def nested_case(spark: SparkSession, d: str) -> DataFrame:
    """Keys of nested documents to camelCase and back."""
    tree = F.to_json(F.struct(F.struct(F.col("p_name").alias("base_color"), F.array(F.struct(F.col("p_size").alias("edge_size_px"))).alias("some_items")).alias("node_style")))
    camel = N.keys_converted(tree, "camel")
    return _dealt(spark, d, "part").select("p_partkey", camel.alias("camel"), (N.keys_converted(camel, "snake") == tree).alias("same"))


def full_paths(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/"), F.when(F.col("p_partkey") % 2 == 0, F.url_encode("p_name")).otherwise(F.col("p_name")), F.lit("/"))
    base = F.when(F.col("p_partkey") % 3 == 0, "").otherwise("//main dir/")
    return table(spark, d, "part").select("p_partkey", X.full_path(base, path).alias("path"))


def default_sessions(spark: SparkSession, d: str) -> DataFrame:
    asked = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit("s"), F.col("conv_id").cast("string")))
    turns = table(spark, d, "conversations").select(X.session_or(asked, "main").alias("session"))
    return turns.groupBy("session").agg(F.count(F.lit(1)).alias("n"))


_P = "p_partkey"
_CAMEL = "split_part(p_name, ' ', 1) || upper(substring(split_part(p_name, ' ', 2), 1, 1)) || substring(split_part(p_name, ' ', 2), 2)"

CATALOG = {
    "settings_path_get": (settings_path_get, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events"),
    "settings_path_set": (settings_path_set, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS size, CAST(NULL AS VARCHAR) AS through, value AS named FROM events"),
    "settings_deep_merge": (settings_deep_merge, "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value AS size, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'a' END AS name FROM events"),
    "partial_merge": (partial_merge, "SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'renamed' ELSE c_name END AS c_name, c_acctbal FROM customer"),
    "section_merge": (section_merge, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CAST(NULL AS DOUBLE) AS size FROM events"),
    "visible_settings": (visible_settings, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'other' ELSE 'k' END AS names, CASE WHEN event_id % 3 <> 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 3 = 0 THEN event_type END AS other FROM events"),
    "case_convert": (case_convert, f"SELECT {_P}, {_CAMEL} AS camel, replace(p_name, ' ', '_') AS snake, upper(substring(p_name, 1, 1)) || substring(split_part(p_name, ' ', 1), 2) || ' ' || upper(substring(split_part(p_name, ' ', 2), 1, 1)) || substring(split_part(p_name, ' ', 2), 2) AS title FROM part"),
    "label_formats": (label_formats, f"SELECT {_P}, replace(lower(p_name), ' ', '%20') AS slug, CASE WHEN length(p_name) > 6 THEN substring(p_name, 1, 6) || '...' ELSE p_name END AS short, printf('%.1f', p_size * 512 / CAST(1024 AS DOUBLE)) || ' KB' AS size_label FROM part"),
    "client_ids": (client_ids, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE c_custkey + 1 END AS client_id FROM customer"),
    "path_prefixes": (path_prefixes, "WITH p AS (SELECT p_type AS a, replace(p_brand, '#', '') AS b, CAST(p_size AS VARCHAR) AS c FROM part) SELECT path, count(*) AS n FROM (SELECT unnest(['', a, a || '.' || b, a || '.' || b || '.' || c]) AS path FROM p) GROUP BY path"),
    "encoded_paths": (encoded_paths, f"SELECT {_P}, '/pages/' || replace(p_name, ' ', '+') AS path, to_base64(encode(p_name)) AS content FROM part"),
    "csv_lists": (csv_lists, "SELECT c_custkey, array_to_string(e, '|') AS entries, len(e) AS n FROM (SELECT c_custkey, list_filter([c_name, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN 'x' END], lambda v: v IS NOT NULL) AS e FROM customer)"),
    "backoff_series": (backoff_series, "WITH n AS (SELECT o_custkey, least(count(*), 5) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, a AS attempt, round(2000 * pow(1.5, a - 1), 6) AS delay FROM (SELECT o_custkey, CAST(unnest(range(1, n + 1)) AS INTEGER) AS a FROM n)"),
    "palette": (palette, """WITH u AS (SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)
      SELECT id, ['#ff0000', '#00ff00', '#0000ff', '#ffff00', '#ff00ff'][i % 5 + 1] AS colour FROM u WHERE id IS DISTINCT FROM (SELECT min(id) FROM u WHERE id > 100)"""),
    "gesture_confidence": (gesture_confidence, "SELECT event_id, round(greatest(0, least(1, CAST(1 AS DOUBLE) - value / CAST(50 AS DOUBLE))), 6) AS confidence, round(greatest(0, least(1, value / CAST(40 AS DOUBLE) - CAST(0.25 AS DOUBLE))), 6) AS extension FROM events"),
    "hand_gestures": (hand_gestures, """WITH v AS (SELECT event_id, value / 1000.0::DOUBLE AS v, (event_id % 4) * 0.02::DOUBLE AS w FROM events),
      d AS (SELECT *, v / 2::DOUBLE AS p, event_id % 13 <> 0 AS seen,
        event_id % 7 <> 0 AND sqrt((v / 2) ** 2 + w ** 2) > 0.08::DOUBLE AND ((CASE WHEN event_id % 11 = 0 THEN 0 ELSE v / 3 END) + v / 4 + v / 5) / 3 < 0.04::DOUBLE AS pt,
        (w + sqrt((v / 2) ** 2 + w ** 2) + sqrt((v / 3) ** 2 + w ** 2) + sqrt((v / 4) ** 2 + w ** 2) + sqrt((v / 5) ** 2 + w ** 2)) / 5 AS m FROM v),
      g AS (SELECT *, greatest(0::DOUBLE, least(1::DOUBLE, 1 - p / 0.025::DOUBLE)) AS pc, event_id % 11 <> 0 AND event_id % 5 <> 0 AND m < 0.04::DOUBLE AS gr FROM d)
      SELECT event_id, CASE WHEN seen THEN p < 0.025::DOUBLE AND pc > 0.7::DOUBLE END AS pinch, CASE WHEN seen THEN round(pc, 6) END AS pinch_confidence,
      CASE WHEN seen THEN pt END AS point, CASE WHEN seen THEN CASE WHEN pt THEN 0.8::DOUBLE ELSE 0 END END AS point_confidence,
      CASE WHEN seen THEN gr END AS grip, CASE WHEN seen THEN CASE WHEN gr THEN round(greatest(0::DOUBLE, least(1::DOUBLE, 1 - m / 0.04::DOUBLE)), 6) ELSE 0 END END AS grip_confidence FROM g"""),
    "settings_checked_set": (settings_checked_set, """SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'wrong type: view.size' WHEN 2 THEN 'not an object: count' WHEN 3 THEN 'not an object: none' END AS error,
      CASE WHEN event_id % 5 = 0 THEN CAST(event_id AS DOUBLE) ELSE 1.5::DOUBLE END AS size, CASE WHEN event_id % 5 = 4 THEN event_type END AS part, 'n' AS name FROM events"""),
    "setting_lookup": (setting_lookup, f"SELECT {_P}, p_size AS size, p_name AS label, CAST(NULL AS VARCHAR) AS missing, p_brand AS capitals, p_name AS by_category, 'none' AS fallback FROM part"),
    "nested_case": (nested_case, f"""SELECT {_P}, '{{"nodeStyle":{{"baseColor":"' || p_name || '","someItems":[{{"edgeSizePx":' || p_size || '}}]}}}}' AS camel, true AS same FROM part"""),
    "full_paths": (full_paths, f"SELECT {_P}, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'main+dir%2F' END || replace(p_name, ' ', '+') AS path FROM part"),
    "default_sessions": (default_sessions, "SELECT CASE WHEN conv_id % 3 <> 0 THEN 's' || conv_id ELSE 'main' END AS session, count(*) AS n FROM conversations GROUP BY 1"),
}
