"""Queries over positions: layout steps, geometry, binary frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomgraph.functions import codec, exprs as X
from loomgraph.operators import block_layout as B
from loomgraph.operators import far_field as T
from loomgraph.operators import graph as G
from loomgraph.operators import layout as L
from loomgraph.operators.folds import transfer_statistics
from loomgraph.sources.tables import table

_STATE = ["x", "y", "z", "vx", "vy", "vz"]


def _nodes(spark: SparkSession, d: str, scale: float = 3.0) -> DataFrame:
    """Vectors as nodes: three components are the position, three the velocity."""
    e = lambda i, k: (F.col("embedding")[i].cast("double") * k)
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        *(e(i, scale).alias(c) for i, c in enumerate(_STATE[:3])),
        *(e(i + 3, 0.01).alias(c) for i, c in enumerate(_STATE[3:])),
        (F.col("vec_id") % 256).cast("int").alias("mass"),
    )


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the next one of its label within blocks of ids."""
    following = F.lead("vec_id").over(W.partitionBy("label", F.floor(F.col("vec_id") / 1000)).orderBy("vec_id"))
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("source"), following.alias("target"), (F.lit(1.0) + F.col("label") % 3).alias("weight"))
    return rows.filter("target IS NOT NULL")


def _d(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


_BASE = f"""n0 AS (SELECT vec_id AS id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) * {_d(3.0 if i < 3 else 0.01)} AS {c}' for i, c in enumerate(_STATE))}, CAST(vec_id % 256 AS INTEGER) AS mass FROM embeddings),
edges AS (SELECT * FROM (SELECT vec_id AS source, lead(vec_id) OVER (PARTITION BY label, vec_id // 1000 ORDER BY vec_id) AS target, {_d(1.0)} + label % 3 AS weight FROM embeddings) WHERE target IS NOT NULL)"""


def _edge_step_sql(before: str, after: str, p: L.Params = L.Params()) -> str:
    """One step of the edge model over relation `before`."""
    d2 = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)"
    mass = lambda t: f"({t}.mass / {_d(255.0)} * {_d(10.0)} * {_d(p.mass_scale)})"
    parts = ", ".join(f"sum(-(b.{c} - a.{c}) * {_d(p.repulsion)} * {mass('a')} * {mass('b')} / (sqrt({d2}) * sqrt({d2}) * sqrt({d2}))) AS f{c}" for c in "xyz")
    pull = lambda s, t: ", ".join(f"(t.{c} - s.{c}) * {_d(p.spring)} * weight * {s} AS f{c}" for c in "xyz")
    e2 = "(t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) + (t.z - s.z) * (t.z - s.z) >= 0.0001"
    ends = " UNION ALL ".join(f"SELECT {end} AS id, {pull(sign, '')} FROM edges JOIN {before} s ON s.id = source JOIN {before} t ON t.id = target WHERE {e2}" for end, sign in (("source", "1"), ("target", "-1")))
    v = {c: f"(n.v{c} * {_d(p.damping)} + coalesce(f.f{c}, {_d(0.0)}) * {_d(p.time_step)})" for c in "xyz"}
    return f"""{after} AS (SELECT n.id, {', '.join(f'n.{c} + {v[c]} * {_d(p.time_step)} AS {c}' for c in 'xyz')}, {', '.join(f'{v[c]} AS v{c}' for c in 'xyz')}, n.mass
      FROM {before} n LEFT JOIN (SELECT id, sum(fx) AS fx, sum(fy) AS fy, sum(fz) AS fz FROM (
        SELECT a.id, {parts} FROM {before} a JOIN {before} b ON a.id <> b.id WHERE {d2} >= 0.0001 AND sqrt({d2}) <= {_d(p.reach)} GROUP BY a.id
        UNION ALL {ends}) GROUP BY id) f ON f.id = n.id)"""


def _out(relation: str, digits: int = 6) -> str:
    return f"SELECT id, {', '.join(f'round({c}, {digits}) AS {c}' for c in _STATE)}, mass FROM {relation}"


def _rounded(nodes: DataFrame, *others: str, digits: int = 6) -> DataFrame:
    return nodes.select("id", *(X.rounded(c, digits).alias(c) for c in _STATE), *others)


def layout_cpu_step(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.run_steps(_nodes(spark, d), _edges(spark, d), L.Params(), 1), "mass")


def layout_cpu_3steps(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.run_steps(_nodes(spark, d), _edges(spark, d), L.Params(), 3), "mass")


def layout_block_3steps(spark: SparkSession, d: str) -> DataFrame:
    """The three steps again, by blocks that keep their nodes and exchange border nodes."""
    return _rounded(B.run_in_blocks(_nodes(spark, d), _edges(spark, d), L.Params(), 3, block=256), "mass")


def _order_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders as nodes near the points of a grid, each linked to its customer's next order."""
    key = F.col("o_orderkey")
    off = F.pmod(F.col("o_totalprice"), F.lit(1.0)) * 0.3
    orders = table(spark, d, "orders")
    nodes = orders.select(
        key.alias("id"), ((key % 40) + off).alias("x"), (F.floor(key / 40) % 40 - off).alias("y"), (F.floor(key / 1600) + off * 0.5).alias("z"),
        *(F.lit(0.0).alias(f"v{c}") for c in "xyz"), (F.col("o_custkey") % 256).cast("int").alias("mass"),
    )
    following = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    return nodes, orders.select(key.alias("source"), following.alias("target"), F.lit(1.0).alias("weight")).filter("target IS NOT NULL")


def layout_large_steps(spark: SparkSession, d: str) -> DataFrame:
    """Two steps of all orders as nodes, by blocks."""
    return _rounded(B.run_in_blocks(*_order_nodes(spark, d), L.Params(), 2), "mass")


def layout_gpu_step(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(L.all_pairs_step(_nodes(spark, d, 8.0), L.Params(bounds=4.0), 40), "mass")


def layout_tree_bound(spark: SparkSession, d: str) -> DataFrame:
    """The all-pairs forces of widely spread nodes with far ones taken together: whether each is within its bound of the exact one, and near it."""
    nodes = _nodes(spark, d, 60.0).select("id", *"xyz", X.mass_unit(F.col("mass")).alias("m"))
    exact = L.all_pairs_forces(nodes, L.Params(), 40).select("id", *(F.col(f"f{c}").alias(f"e{c}") for c in "xyz"))
    both = T.tree_forces(nodes, L.Params(), 40, share=0.01).join(exact, "id")
    off = F.sqrt(sum(((F.col(f"f{c}") - F.col(f"e{c}")) * (F.col(f"f{c}") - F.col(f"e{c}")) for c in "xyz"), F.lit(0.0)))
    size = F.sqrt(sum((F.col(f"e{c}") * F.col(f"e{c}") for c in "xyz"), F.lit(0.0)))
    return both.select("id", (off <= F.col("bound") + 1e-9).alias("within"), (off <= 0.01 * size + 0.05).alias("close"))


def layout_gpu_start(spark: SparkSession, d: str) -> DataFrame:
    """The fourth step: nodes rest before it and nothing bounds them yet."""
    return _rounded(L.all_pairs_step(_nodes(spark, d, 8.0), L.Params(bounds=4.0), 3), "mass")


def layout_gpu_unbounded(spark: SparkSession, d: str) -> DataFrame:
    """A step after the warm-up, without bounds."""
    return _rounded(L.all_pairs_step(_nodes(spark, d, 8.0), L.Params(bounds=None), 120), "mass")


def layout_final_phase(spark: SparkSession, d: str) -> DataFrame:
    """One step with the parameters of the last phase, in which every node reaches every other."""
    return _rounded(L.edge_step(_nodes(spark, d), _edges(spark, d), L.Params.phase("finalize")), "mass", digits=2)


def _all_pairs_sql(iteration: int = 40, bounds: float | None = 4.0) -> str:
    p, warm = L.Params(bounds=bounds), min(iteration, 100) / 100
    ramp = 0.01 + 0.99 * iteration / 100 if iteration < 100 else 1.0
    damping = max(p.damping, 0.9 - 0.4 * warm) if iteration < 100 else p.damping
    rest = 0.0 if iteration < 5 else 1.0
    out = lambda c: f"abs({c}) > {_d(0.7 * bounds)}" if bounds and iteration > 10 else "false"
    unit = lambda t: f"(CASE WHEN {t}.mass = 0 THEN {_d(0.5)} ELSE ({t}.mass + {_d(1.0)}) / {_d(256.0)} END)"
    mm = f"{unit('a')} * {unit('b')}"
    repel = f"least({_d(p.repulsion)} * {mm} / greatest(d * d, {_d(0.15)}), {_d(p.repulsion)} * {mm} * {_d(2.0)})"
    spring = f"(-{_d(p.spring)} * {_d(ramp)} * (d - 1) * CASE WHEN d > 3 THEN {_d(1.0)} + (d - 3) * {_d(0.1)} ELSE {_d(1.0)} END * {mm})"
    sums = ", ".join(f"sum(-(b.{c} - a.{c}) / d * CASE WHEN d < {_d(p.reach)} THEN {repel} ELSE {spring} END) AS f{c}" for c in "xyz")
    dist = "sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z))"
    far = "sqrt(n.x * n.x + n.y * n.y + n.z * n.z)"
    centre = f"CASE WHEN {far} > 3 THEN {_d(0.015)} * {unit('n')} * {_d(ramp)} * ({far} - 3) / {far} ELSE {_d(0.0)} END"
    state = ", ".join(_STATE)
    scale = lambda c: f"CAST(embedding[{_STATE.index(c) + 1}] AS DOUBLE) * {_d(8.0 if len(c) == 1 else 0.01)} AS {c}"
    return f"""WITH n AS (SELECT vec_id AS id, {', '.join(map(scale, _STATE))}, CAST(vec_id % 256 AS INTEGER) AS mass FROM embeddings),
      pairs AS (SELECT a.id, {sums} FROM n a JOIN (SELECT *, 1 AS one FROM n) b ON a.id <> b.id, LATERAL (SELECT {dist} AS d) WHERE d > {_d(0.15)} GROUP BY a.id),
      f AS (SELECT n.*, {', '.join(f'coalesce(f{c}, {_d(0.0)}) - n.{c} * ({centre}) AS f{c}' for c in 'xyz')} FROM n LEFT JOIN pairs p ON p.id = n.id),
      g AS (SELECT *, CASE WHEN sqrt(fx * fx + fy * fy + fz * fz) > 3 THEN 3 / sqrt(fx * fx + fy * fy + fz * fz) ELSE {_d(1.0)} END AS k FROM f),
      v AS (SELECT id, x, y, z, mass, {', '.join(f'v{c} * {_d(rest)} * ({_d(1.0)} - {_d(damping)}) + least({_d(3.0)}, greatest({_d(-3.0)}, f{c} * k)) * {_d(p.time_step)} AS v{c}' for c in 'xyz')} FROM g),
      s AS (SELECT *, CASE WHEN sqrt(vx * vx + vy * vy + vz * vz) > {_d(0.02)} THEN {_d(0.02)} / sqrt(vx * vx + vy * vy + vz * vz) ELSE {_d(1.0)} END AS k FROM v),
      m AS (SELECT id, mass, {', '.join(f'{c} + v{c} * k * {_d(p.time_step)} AS {c}, v{c} * k AS v{c}' for c in 'xyz')} FROM s)
      SELECT id, mass, {', '.join(f'round(CASE WHEN {out(c)} THEN {c} * {_d(0.92)} ELSE {c} END, 6) AS {c}, round(CASE WHEN {out(c)} THEN v{c} * {_d(0.85)} ELSE v{c} END, 6) AS v{c}' for c in 'xyz')} FROM m"""


def fibonacci_init(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return L.on_sphere(docs, "doc_id").select("doc_id", *(X.rounded(c, 6).alias(c) for c in "xyz"))


def easing_tick(spark: SparkSession, d: str) -> DataFrame:
    targets = {f"t{c}": F.when(F.col("id") % 5 == 0, F.col(c) + 0.001).otherwise(F.col(c) * 0.5 + 1.0) for c in "xyz"}
    nodes = _nodes(spark, d).withColumns(targets | {"pinned": F.col("id") % 7 == 0})
    return _rounded(L.easing_tick(nodes, 5.0, 0.9, 0.05, 0.016))


def bounding_box(spark: SparkSession, d: str) -> DataFrame:
    return L.bounding_box(_nodes(spark, d))


def distance_fade(spark: SparkSession, d: str) -> DataFrame:
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    return _nodes(spark, d).select("id", X.rounded(X.distance_fade(far, 0.5, 1.5), 6).alias("opacity"))


def edge_geometry(spark: SparkSession, d: str) -> DataFrame:
    return L.edge_geometry(_nodes(spark, d), _edges(spark, d)).select("source", "target", X.rounded("length", 6).alias("length"))


def radius_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return L.neighbour_counts(_nodes(spark, d), 0.5)


def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Nodes packed into frames and read again."""
    decoded = codec.decode_frames(codec.frames(_nodes(spark, d, 1.0)))
    return decoded.select("frame_id", "id", *(X.rounded(F.col(c).cast("double"), 6).alias(c) for c in _STATE), F.col("mass").cast("int").alias("mass"), F.col("flags").cast("int").alias("flags"))


def frame_sizes(spark: SparkSession, d: str) -> DataFrame:
    return codec.frames(_nodes(spark, d)).select("frame_id", F.octet_length("payload").cast("long").alias("bytes"))


def moving_fraction(spark: SparkSession, d: str) -> DataFrame:
    return G.moving_share(_nodes(spark, d)).withColumn("fraction", X.rounded("fraction", 6))


def pinned_tick(spark: SparkSession, d: str) -> DataFrame:
    """One node is held at a place while the others ease towards twice their position."""
    nodes = _nodes(spark, d).withColumns({f"t{c}": F.col(c) * 2.0 for c in "xyz"} | {"pinned": F.lit(False)})
    return _rounded(L.easing_tick(L.pinned(nodes, 11, 1.0, 2.0, 3.0), 5.0, 0.9, 0.05, 0.016))


def jitter_bounds(spark: SparkSession, d: str) -> DataFrame:
    """How far seeded jitter moves each node at most, and whether it moves it at all."""
    nodes = _nodes(spark, d).select("id", "x", "y", "z")
    moved = L.jittered(nodes, 0.05, 7).select("id", *(F.col(c).alias(f"{c}2") for c in "xyz"))
    far = F.greatest(*(F.abs(F.col(f"{c}2") - F.col(c)) for c in "xyz"))
    return nodes.join(moved, "id").select("id", (far <= 0.05 + 1e-9).alias("within"), (far > 0).alias("moved"))


def origin_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth node starts at the origin, every seventh has no position: both land on the sphere."""
    lost = F.when(F.col("id") % 7 == 0, F.lit(None).cast("double")).when(F.col("id") % 4 == 0, 0.0)
    kept = (F.col("id") % 7 != 0) & (F.col("id") % 4 != 0)
    nodes = _nodes(spark, d).select("id", *(F.when(kept, F.col(c)).otherwise(lost).alias(c) for c in "xyz"))
    placed = L.off_origin(nodes)
    return placed.select("id", X.rounded(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), 6).alias("radius"))


def position_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Updates of which some components are missing or no number."""
    odd = F.when(F.col("id") % 3 == 0, F.lit(None).cast("double")).when(F.col("id") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("x"))
    updates = _nodes(spark, d).select("id", odd.alias("x"), F.when(F.col("id") % 2 == 0, F.col("y")).alias("y"), "z")
    return codec.position_array(updates).select("id", *(X.rounded(c, 6).alias(c) for c in "xyz"))


def lenient_decode(spark: SparkSession, d: str) -> DataFrame:
    """Frames with a few bytes too many, in which some nodes have a velocity that is no number."""
    broken = _nodes(spark, d, 1.0).withColumn("vx", F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("vx")))
    packed = codec.frames(broken).withColumn("payload", F.concat("payload", F.unhex(F.lit("0102"))))
    return codec.decode_frames(packed, strict=False).select("frame_id", "id", X.rounded(F.col("x").cast("double"), 6).alias("x"))


def transfer_stats(spark: SparkSession, d: str) -> DataFrame:
    sent = table(spark, d, "events").select(F.col("user_id").alias("client"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"), codec.frame_size(F.floor("value").cast("long")).alias("bytes"))
    out = transfer_statistics(sent)
    return out.select("client", "updates", "total_bytes", X.rounded("mean_bytes", 6).alias("mean_bytes"), "longest_pause")


def finite_motion(spark: SparkSession, d: str) -> DataFrame:
    """Positions and velocities of which one of six fields is not a number or infinite in six rows of nine."""
    odd = F.element_at(F.array(*(F.lit(float(v)) for v in ("nan", "inf", "-inf"))), (F.floor(F.col("event_id") / 9) % 3 + 1).cast("int"))
    fields = [F.when(F.col("event_id") % 9 == k, odd).otherwise(F.col("value") + k).alias(c) for k, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))]
    return X.finite_rows(table(spark, d, "events").select("event_id", *fields), ["x", "y", "z", "vx", "vy", "vz"]).select("event_id", X.rounded("vz", 6).alias("vz"))


def finite_positions(spark: SparkSession, d: str) -> DataFrame:
    """Components divided by a value that is sometimes 0: rows with a value that is not finite drop out."""
    x = F.try_divide(F.col("x"), (F.col("id") % 3).cast("double"))
    return _nodes(spark, d).select("id", x.alias("x")).filter(X.is_finite(F.col("x"))).select("id", X.rounded("x", 6).alias("x"))


_N = f"WITH {_BASE} "
_T = {c: f"CASE WHEN id % 5 = 0 THEN {c} + {_d(0.001)} ELSE {c} * {_d(0.5)} + {_d(1.0)} END" for c in "xyz"}
_V = {c: f"(v{c} + (t{c} - {c}) * {_d(5.0)} * {_d(0.016)}) * {_d(0.9)}" for c in "xyz"}
_REST = f"(tx - x) * (tx - x) + (ty - y) * (ty - y) + (tz - z) * (tz - z) < {_d(0.05 * 0.05)}"

CATALOG = {
    "layout_cpu_step": (layout_cpu_step, f"WITH {_BASE}, {_edge_step_sql('n0', 'n1')} {_out('n1')}"),
    "layout_cpu_3steps": (layout_cpu_3steps, f"WITH {_BASE}, {_edge_step_sql('n0', 'n1')}, {_edge_step_sql('n1', 'n2')}, {_edge_step_sql('n2', 'n3')} {_out('n3')}"),
    "layout_block_3steps": (layout_block_3steps, f"WITH {_BASE}, {_edge_step_sql('n0', 'n1')}, {_edge_step_sql('n1', 'n2')}, {_edge_step_sql('n2', 'n3')} {_out('n3')}"),
    "layout_large_steps": (layout_large_steps, f"""WITH n0 AS (SELECT o_orderkey AS id, o_orderkey % 40 + k AS x, o_orderkey // 40 % 40 - k AS y, o_orderkey // 1600 + k * {_d(0.5)} AS z, {_d(0.0)} AS vx, {_d(0.0)} AS vy, {_d(0.0)} AS vz,
      CAST(o_custkey % 256 AS INTEGER) AS mass FROM (SELECT *, (o_totalprice % {_d(1.0)}) * {_d(0.3)} AS k FROM orders)),
      edges AS (SELECT * FROM (SELECT o_orderkey AS source, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS target, {_d(1.0)} AS weight FROM orders) WHERE target IS NOT NULL),
      {_edge_step_sql('n0', 'n1')}, {_edge_step_sql('n1', 'n2')} {_out('n2')}"""),
    "layout_gpu_step": (layout_gpu_step, _all_pairs_sql()),
    "layout_tree_bound": (layout_tree_bound, "SELECT vec_id AS id, true AS within, true AS close FROM embeddings"),
    "layout_gpu_start": (layout_gpu_start, _all_pairs_sql(3)),
    "layout_gpu_unbounded": (layout_gpu_unbounded, _all_pairs_sql(120, None)),
    "layout_final_phase": (layout_final_phase, f"WITH {_BASE}, {_edge_step_sql('n0', 'n1', L.Params.phase('finalize'))} {_out('n1', 2)}"),
    "pinned_tick": (pinned_tick, f"""WITH {_BASE}, s AS (SELECT *, (x * x + y * y + z * z) < {_d(0.05 * 0.05)} AS still FROM n0)
      SELECT id, {', '.join(f'round(CASE WHEN id = 11 THEN {k} WHEN still THEN {c} ELSE {c} + (v{c} + {c} * {_d(5.0)} * {_d(0.016)}) * {_d(0.9)} * {_d(0.016)} END, 6) AS {c}' for k, c in enumerate('xyz', 1))},
      {', '.join(f'round(CASE WHEN id = 11 OR still THEN 0 ELSE (v{c} + {c} * {_d(5.0)} * {_d(0.016)}) * {_d(0.9)} END, 6) AS v{c}' for c in 'xyz')} FROM s"""),
    "jitter_bounds": (jitter_bounds, "SELECT vec_id AS id, true AS within, true AS moved FROM embeddings"),
    "origin_fallback": (origin_fallback, _N + "SELECT id, round(CASE WHEN id % 7 = 0 OR id % 4 = 0 THEN 10 ELSE sqrt(x * x + y * y + z * z) END, 6) AS radius FROM n0"),
    "position_defaults": (position_defaults, _N + "SELECT id, CASE WHEN id % 3 < 2 THEN 0 ELSE round(x, 6) END AS x, CASE WHEN id % 2 = 0 THEN round(y, 6) ELSE 0 END AS y, round(z, 6) AS z FROM n0"),
    "lenient_decode": (lenient_decode, "SELECT vec_id // 1024 AS frame_id, vec_id AS id, round(CAST(embedding[1] AS DOUBLE), 6) AS x FROM embeddings WHERE vec_id % 5 <> 0"),
    "fibonacci_init": (fibonacci_init, f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
      a AS (SELECT doc_id, 2 * pi() * i / ((1 + sqrt(5)) / 2) AS turn, acos(1 - 2 * (i + {_d(0.5)}) / n) AS tilt FROM r)
      SELECT doc_id, round(3 * sin(tilt) * cos(turn), 6) AS x, round(3 * sin(tilt) * sin(turn), 6) AS y, round(3 * cos(tilt), 6) AS z FROM a"""),
    "easing_tick": (easing_tick, f"""WITH {_BASE}, t AS (SELECT *, {', '.join(f'{e} AS t{c}' for c, e in _T.items())}, id % 7 = 0 AS pinned FROM n0)
      SELECT id, {', '.join(f'round(CASE WHEN pinned OR {_REST} THEN {c} ELSE {c} + {_V[c]} * {_d(0.016)} END, 6) AS {c}' for c in 'xyz')},
      {', '.join(f'round(CASE WHEN pinned THEN v{c} WHEN {_REST} THEN 0 ELSE {_V[c]} END, 6) AS v{c}' for c in 'xyz')} FROM t"""),
    "bounding_box": (bounding_box, _N + f"SELECT {', '.join(f'(max({c}) + min({c})) / {_d(2.0)} AS centre_{c}' for c in 'xyz')}, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), {_d(1.0)}) AS size FROM n0"),
    "distance_fade": (distance_fade, _N + f"SELECT id, round(CASE WHEN d >= 1.5 THEN 0 WHEN d <= 0.5 THEN 1 ELSE {_d(1.0)} - (d - {_d(0.5)}) / {_d(1.0)} END, 6) AS opacity FROM (SELECT id, sqrt(x * x + y * y + z * z) AS d FROM n0)"),
    "edge_geometry": (edge_geometry, _N + "SELECT source, target, round(sqrt((b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2), 6) AS length FROM edges JOIN n0 a ON a.id = source JOIN n0 b ON b.id = target"),
    "radius_neighbors": (radius_neighbors, _N + f"SELECT a.id, count(b.id) AS n FROM n0 a LEFT JOIN n0 b ON a.id <> b.id AND (b.x - a.x) ** 2 + (b.y - a.y) ** 2 + (b.z - a.z) ** 2 <= {_d(0.25)} GROUP BY a.id"),
    "codec_roundtrip": (codec_roundtrip, f"SELECT vec_id // 1024 AS frame_id, vec_id AS id, {', '.join(f'round(CAST(CAST(CAST(embedding[{i + 1}] AS DOUBLE) * {_d(1.0 if i < 3 else 0.01)} AS FLOAT) AS DOUBLE), 6) AS {c}' for i, c in enumerate(_STATE))}, 100 AS mass, 0 AS flags FROM embeddings"),
    "frame_sizes": (frame_sizes, "SELECT vec_id // 1024 AS frame_id, count(*) * 28 AS bytes FROM embeddings GROUP BY 1"),
    "moving_fraction": (moving_fraction, _N + "SELECT count(*) FILTER (m) AS moving, count(*) AS total, round(count(*) FILTER (m) / count(*), 6) AS fraction FROM (SELECT greatest(abs(vx), abs(vy), abs(vz)) > 0.001 AS m FROM n0)"),
    "transfer_stats": (transfer_stats, """SELECT client, count(*) AS updates, CAST(sum(b) AS BIGINT) AS total_bytes, round(avg(b), 6) AS mean_bytes, max(gap) AS longest_pause FROM (
      SELECT user_id AS client, CAST(floor(value) AS BIGINT) * 28 AS b, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY client"""),
    "finite_motion": (finite_motion, "SELECT event_id, round(value + 5, 6) AS vz FROM events WHERE event_id % 9 > 5"),
    "finite_positions": (finite_positions, _N + "SELECT id, round(x / CAST(id % 3 AS DOUBLE), 6) AS x FROM n0 WHERE id % 3 <> 0"),
}
