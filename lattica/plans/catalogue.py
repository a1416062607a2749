"""The library's own queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import scalars
from lattica.operators import index, support
from lattica.operators.pattern import Pattern
from lattica.plans import compare
from lattica.plans.mine import Options, mine
from lattica.plans.strategies import EdgeBottleneck, Unweighted, VertexBottleneck
from lattica.sources import derive
from lattica.sources.graph import Graph, largest_weight, make_graph
from lattica.sources.lg import merge_edges

#: Vertices up to which a threshold holds, and the support threshold of the trade graph.
SUPPORTS = ((1_000, 4), (10_000, 27), (1 << 62, 170))
LEAST = 100.0
LEAST_VERTEX = 62.0
EVENT_SUPPORT = 12

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

TRADE = """
n AS (SELECT n_nationkey, n_regionkey FROM nation),
vertices0 AS (
  SELECT 3 * c_custkey AS id, n_regionkey::INTEGER AS label FROM customer JOIN n ON c_nationkey = n_nationkey
  UNION ALL SELECT 3 * p_partkey + 1, (10 + regexp_extract(p_brand, '([0-9]+)', 1)::INTEGER % 5)::INTEGER FROM part
  UNION ALL SELECT 3 * s_suppkey + 2, (20 + n_regionkey)::INTEGER FROM supplier JOIN n ON s_nationkey = n_nationkey),
items AS (SELECT 3 * o_custkey AS c, 3 * l_partkey + 1 AS p, 3 * l_suppkey + 2 AS s, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
pairs AS (SELECT c AS x, p AS y, q FROM items UNION ALL SELECT p, s, q FROM items UNION ALL SELECT c, s, q FROM items),
edges AS (SELECT least(x, y) AS a, greatest(x, y) AS b, 0 AS el, sum(q) AS w FROM pairs GROUP BY 1, 2 HAVING count(*) >= 2),"""
EVENTS = """
slots AS (SELECT DISTINCT user_id, event_type, date_trunc('hour', ts) AS h FROM events),
vertices0 AS (SELECT DISTINCT user_id AS id, (user_id % 5)::INTEGER AS label FROM slots),
edges AS (SELECT x.user_id AS a, y.user_id AS b, 0 AS el, count(*)::DOUBLE AS w FROM slots x JOIN slots y
          ON x.event_type = y.event_type AND x.h = y.h AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) >= 4),"""
ADJ = """
adj0 AS (SELECT a AS src, b AS dst, el, w FROM edges UNION ALL SELECT b, a, el, w FROM edges),
vertices AS (SELECT id, label, coalesce(avg(w), 0.0) AS weight FROM vertices0 LEFT JOIN adj0 ON src = id GROUP BY id, label),
adj AS (SELECT src, dst, el, w, s.label AS ls, d.label AS ld, s.weight AS ws, d.weight AS wd
        FROM adj0 JOIN vertices s ON s.id = src JOIN vertices d ON d.id = dst),
k AS (SELECT CASE WHEN count(*) <= 1000 THEN 4 WHEN count(*) <= 10000 THEN 27 ELSE 170 END AS sup FROM vertices)"""


def trade_sql(body: str, more: str = "") -> str:
    return f"WITH {TRADE}{ADJ}{', ' + more if more else ''} {body}"


def event_sql(body: str, more: str = "") -> str:
    return f"WITH {EVENTS}{ADJ}{', ' + more if more else ''} {body}"


def min_sup(g: Graph) -> int:
    n = g.vertices.count()
    return next(s for most, s in SUPPORTS if n <= most)


def query(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


#: Queries that read the graph more than once, which is then cached.
READ_OFTEN = {"path2_mni", "path3_mni", "triangle_mni", "triangle_bottleneck", "arc_consistency_domains", "frequent_labels", "apriori_candidates", "edge_filter_candidates", "weighty_filter_candidates", "lookup_filter_candidates"}


def trade(name: str, body: str, more: str = ""):
    """Registers a query on the trade graph."""

    def put(f: Callable[[Graph], DataFrame]):
        def run(spark, sf_dir):
            g = derive.trade_graph(spark, sf_dir)
            return f(g.cached() if name in READ_OFTEN else g)

        QUERIES[name] = run
        SQL[name] = trade_sql(body, more)
        return f

    return put


# --- sources and aggregates

trade("graph_edges", "SELECT a, b, el, w FROM edges")(lambda g: g.edges)
trade("graph_stats", "SELECT (SELECT count(*) FROM vertices) AS n_vertices, (SELECT count(DISTINCT label) FROM vertices) AS n_labels, count(*) AS n_edges, min(w) AS min_w, max(w) AS max_w, sum(w) AS sum_w, sum(w) / count(*) AS mean_w FROM edges")(index.graph_stats)
trade("degree", "SELECT id, count(src) AS degree FROM vertices LEFT JOIN adj ON src = id GROUP BY id")(index.degrees)
trade("label_counts", "SELECT label, count(*) AS n FROM vertices GROUP BY label")(index.label_counts)
trade("frequent_labels", "SELECT label, count(*) AS n FROM vertices GROUP BY label HAVING count(*) >= 10 * (SELECT sup FROM k)")(lambda g: index.frequent_labels(g, 10 * min_sup(g)))
trade("edge_triples", "SELECT DISTINCT least(ls, ld) AS la, greatest(ls, ld) AS lb, el FROM adj")(index.edge_triples)
trade("edge_labels", "SELECT DISTINCT el FROM edges")(index.edge_labels)
trade("triple_max_weight", "SELECT least(ls, ld) AS la, greatest(ls, ld) AS lb, el, max(w) AS max_w FROM adj GROUP BY 1, 2, 3")(index.triple_max_weight)
trade("vertex_weight_avg", "SELECT id, label, weight FROM vertices")(lambda g: g.vertices)
trade("weighty_triples", f"SELECT DISTINCT least(ls, ld) AS la, greatest(ls, ld) AS lb, el FROM adj WHERE ws >= {LEAST_VERTEX} AND wd >= {LEAST_VERTEX}")(lambda g: index.weighty_triples(g, LEAST_VERTEX))
trade("distinct_weights_desc", "SELECT DISTINCT w FROM edges")(index.distinct_weights)
trade(
    "weight_percentile_grid",
    "SELECT q, w FROM d, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (0.9), (0.95), (0.99)) AS t(q) WHERE i = floor(q * (n - 1))",
    "d AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT w FROM edges))",
)(lambda g: index.weight_grid(g, [0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]))
trade(
    "degree_quantile_label",
    "SELECT id, least(4, floor(i * 5 / n))::INTEGER AS label FROM r",
    "r AS (SELECT src AS id, row_number() OVER (ORDER BY count(*), src) - 1 AS i, count(*) OVER () AS n FROM adj GROUP BY src)",
)(lambda g: derive.degree_labels(g.edges))


@query("vertex_weight_max", trade_sql("SELECT id, label, greatest(coalesce(max(w), 0.0), 0.0) AS weight FROM vertices0 LEFT JOIN adj0 ON src = id GROUP BY id, label"))
def vertex_weight_max(spark, sf_dir):
    g = derive.trade_graph(spark, sf_dir)
    return make_graph(g.vertices, g.edges, largest_weight).vertices


@query("event_graph_edges", event_sql("SELECT a, b, el, w FROM edges"))
def event_graph_edges(spark, sf_dir):
    return derive.event_edges(spark, sf_dir)


def _order_pairs(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select((F.col("o_custkey") % 97).alias("src"), (F.col("o_orderkey") % 89).alias("dst"), (F.length("o_orderpriority") % 21 - 10).alias("rating"), F.col("o_orderkey").alias("no"))


_PAIRS = "p AS (SELECT o_custkey % 97 AS src, o_orderkey % 89 AS dst, length(o_orderpriority) % 21 - 10 AS rating, o_orderkey AS no FROM orders)"


@query("interaction_threshold_edges", f"WITH {_PAIRS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, 0 AS el, count(*)::DOUBLE AS w FROM p WHERE src <> dst GROUP BY 1, 2 HAVING count(*) >= 3")
def interaction_threshold_edges(spark, sf_dir):
    return derive.interaction_edges(_order_pairs(spark, sf_dir), 3)


@query("mean_rating_edges", f"WITH {_PAIRS} SELECT least(src, dst) AS a, greatest(src, dst) AS b, 0 AS el, avg(rating) + 11 AS w FROM p WHERE src <> dst GROUP BY 1, 2")
def mean_rating_edges(spark, sf_dir):
    return derive.rating_edges(_order_pairs(spark, sf_dir))


@query("edge_dedupe_first", f"""WITH {_PAIRS},
  q AS (SELECT *, least(src, dst) AS a, greatest(src, dst) AS b, row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst), src ORDER BY no) AS nth,
               row_number() OVER (PARTITION BY least(src, dst), greatest(src, dst) ORDER BY no) AS anyway FROM p),
  f AS (SELECT *, CASE WHEN src = dst THEN 'loop' WHEN nth > 1 THEN 'parallel' WHEN anyway > 1 THEN 'reciprocal' ELSE 'kept' END AS fate FROM q)
  SELECT fate, count(*) AS n, sum(rating)::DOUBLE AS sum_w, min(no) AS first_no FROM f GROUP BY fate""")  # fmt: skip
def edge_dedupe_first(spark, sf_dir):
    rows = _order_pairs(spark, sf_dir).withColumn("raw", F.col("rating").cast("double"))
    return merge_edges(rows).groupBy("fate").agg(F.count("*").alias("n"), F.sum("w").alias("sum_w"), F.min("no").alias("first_no"))


@query("edge_label_round", "SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 100 - 40 + 0.5)::INTEGER AS el FROM lineitem")
def edge_label_round(spark, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select("l_orderkey", "l_linenumber", scalars.nearest_label(F.col("l_extendedprice") / 100 - 40).alias("el"))


@query("jaccard_edges", """
  WITH f AS (SELECT o_custkey AS id, list(DISTINCT l_partkey % 50) AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
  p AS (SELECT DISTINCT c_custkey AS a, c_custkey + 1 + c_nationkey % 5 AS b FROM customer)
  SELECT a, b, 0 AS el, CASE WHEN len(list_distinct(list_concat(coalesce(x.f, []), coalesce(y.f, [])))) = 0 THEN 0.0
    ELSE len(list_intersect(coalesce(x.f, []), coalesce(y.f, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(x.f, []), coalesce(y.f, [])))) * 100.0 END AS w
  FROM p LEFT JOIN f x ON x.id = a LEFT JOIN f y ON y.id = b""")  # fmt: skip
def jaccard_edges(spark, sf_dir):
    t = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    f = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.col("l_partkey") % 50).alias("f"))
    p = t("customer").select(F.col("c_custkey").alias("a"), (F.col("c_custkey") + 1 + F.col("c_nationkey") % 5).alias("b")).distinct()
    return derive.similarity_edges(p, f)




@query("priority_label", """SELECT p_partkey, CASE WHEN contains(t, 'promo') THEN 4 WHEN contains(t, 'large') THEN 3 WHEN contains(t, 'steel') THEN 2 WHEN contains(t, 'brass') THEN 1 ELSE 0 END::INTEGER AS label
  FROM (SELECT p_partkey, lower(coalesce(p_type, '') || ' ; ' || coalesce(p_name, '')) AS t FROM part)""")  # fmt: skip
def priority_label(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    joined = F.concat(F.coalesce("p_type", F.lit("")), F.lit(" ; "), F.coalesce("p_name", F.lit("")))
    return p.select("p_partkey", scalars.priority_label(joined, (("promo", 4), ("large", 3), ("steel", 2), ("brass", 1)), 0).alias("label"))


# --- fixed shapes

_EDGE = """e1 AS (SELECT ls AS la, ld AS lb, el, least(count(DISTINCT src), count(DISTINCT dst)) AS mni, max(w) AS max_w, max(least(ws, wd)) AS max_vw FROM adj WHERE ls <= ld GROUP BY 1, 2, 3)"""
_PATH2 = """r2 AS (SELECT p.ld AS a, p.ls AS b, q.ld AS c, p.el AS e1, q.el AS e2, p.dst AS v0, p.src AS v1, q.dst AS v2, least(p.w, q.w) AS w, least(p.wd, p.ws, q.wd) AS vw
       FROM adj p JOIN adj q ON p.src = q.src AND p.dst <> q.dst WHERE (p.ld, p.el) <= (q.ld, q.el)),
  f2 AS (SELECT a, b, c, e1, e2, least(count(DISTINCT v0), count(DISTINCT v1), count(DISTINCT v2)) AS mni, max(w) AS max_w, max(vw) AS max_vw FROM r2 GROUP BY ALL)"""
_TRIANGLE = """r3 AS (SELECT p.ls AS l0, p.ld AS l1, q.ld AS l2, p.src AS v0, p.dst AS v1, q.dst AS v2, least(p.w, q.w, r.w) AS w
       FROM adj p JOIN adj q ON p.dst = q.src AND q.dst <> p.src JOIN adj r ON r.src = p.src AND r.dst = q.dst WHERE p.ls <= p.ld AND q.ls <= q.ld)"""

trade("single_edge_mni", "SELECT la, lb, el, mni, max_w FROM e1 WHERE mni >= (SELECT sup FROM k)", _EDGE)(lambda g: support.edges(g, min_sup(g)))
trade("edge_bottleneck", "SELECT la, lb, el, max_w FROM e1", _EDGE)(lambda g: support.edges(g).select("la", "lb", "el", "max_w"))
trade("vertex_bottleneck", "SELECT la, lb, el, max_vw FROM e1", _EDGE)(support.edge_vertex_weights)
trade("path2_mni", "SELECT a, b, c, e1, e2, mni, max_w FROM f2 WHERE mni >= (SELECT sup FROM k)", _PATH2)(lambda g: support.two_paths(g, min_sup(g)))
trade("path_bottleneck", "SELECT a, b, c, e1, e2, max(w) AS max_w FROM r2 GROUP BY ALL", _PATH2)(
    support.two_path_weights
)
trade("triangle_mni", "SELECT l0, l1, l2, least(count(DISTINCT v0), count(DISTINCT v1), count(DISTINCT v2)) AS mni, max(w) AS max_w FROM r3 GROUP BY ALL HAVING mni >= 2", _TRIANGLE)(lambda g: support.triangles(g, 2))
trade("triangle_bottleneck", "SELECT l0, l1, l2, max(w) AS max_w FROM r3 GROUP BY ALL", _TRIANGLE)(
    lambda g: support.triangle_rows(g).groupBy("l0", "l1", "l2").agg(F.max("w1").alias("max_w"))
)
trade(
    "path3_mni",
    """SELECT l0, l1, l2, l3, least(count(DISTINCT v0), count(DISTINCT v1), count(DISTINCT v2), count(DISTINCT v3)) AS mni, max(w) AS max_w FROM (
         SELECT p.ld AS l0, p.ls AS l1, q.ld AS l2, r.ld AS l3, p.dst AS v0, p.src AS v1, q.dst AS v2, r.dst AS v3, least(p.w, q.w, r.w) AS w
         FROM adj p JOIN adj q ON p.src = q.src AND p.dst <> q.dst JOIN o ON o.a = p.ld AND o.b = p.ls AND o.c = q.ld
         JOIN adj r ON r.src = q.dst AND r.dst <> p.src AND r.dst <> p.dst JOIN o o2 ON o2.a = p.ls AND o2.b = q.ld AND o2.c = r.ld
         WHERE (p.ld, p.ls) <= (r.ld, q.ld)) GROUP BY ALL HAVING mni >= (SELECT sup FROM k)""",
    _PATH2 + ", o AS (SELECT a, b, c FROM f2 WHERE mni >= (SELECT sup FROM k) UNION SELECT c, b, a FROM f2 WHERE mni >= (SELECT sup FROM k))",
)(lambda g: support.three_paths(g, min_sup(g)))


@query("star3_mni", event_sql("""
  SELECT lc, a, b, c, least(count(DISTINCT v), count(DISTINCT x), count(DISTINCT y), count(DISTINCT z)) AS mni, max(w) AS max_w FROM (
    SELECT p.ls AS lc, p.ld AS a, q.ld AS b, r.ld AS c, p.src AS v, p.dst AS x, q.dst AS y, r.dst AS z, least(p.w, q.w, r.w) AS w
    FROM adj p JOIN adj q ON p.src = q.src AND p.dst <> q.dst JOIN adj r ON p.src = r.src AND r.dst <> p.dst AND r.dst <> q.dst
    WHERE p.ld <= q.ld AND q.ld <= r.ld) GROUP BY ALL HAVING mni >= 4"""))  # fmt: skip
def star3_mni(spark, sf_dir):
    return support.three_stars(derive.event_graph(spark, sf_dir), 4)


@query("cycle4_mni", event_sql("""
  SELECT l0, l1, l2, l3, least(count(DISTINCT v0), count(DISTINCT v1), count(DISTINCT v2), count(DISTINCT v3)) AS mni, max(w) AS max_w FROM (
    SELECT p.ld AS l0, p.ls AS l1, q.ld AS l2, r.ls AS l3, p.dst AS v0, p.src AS v1, q.dst AS v2, r.src AS v3, least(p.w, q.w, r.w, s.w) AS w
    FROM adj p JOIN adj q ON p.src = q.src AND p.dst <> q.dst JOIN adj r ON r.dst = p.dst AND r.src <> p.src JOIN adj s ON s.src = r.src AND s.dst = q.dst
    WHERE r.src <> q.dst) WHERE (l0, l1, l2, l3) <= (l1, l2, l3, l0) AND (l0, l1, l2, l3) <= (l2, l3, l0, l1) AND (l0, l1, l2, l3) <= (l3, l0, l1, l2)
    AND (l0, l1, l2, l3) <= (l3, l2, l1, l0) AND (l0, l1, l2, l3) <= (l2, l1, l0, l3) AND (l0, l1, l2, l3) <= (l1, l0, l3, l2) AND (l0, l1, l2, l3) <= (l0, l3, l2, l1)
  GROUP BY ALL HAVING mni >= 3"""))  # fmt: skip
def cycle4_mni(spark, sf_dir):
    return support.four_cycles(derive.event_graph(spark, sf_dir, upto=4), 3)


trade("embeds_min_weight", f"SELECT DISTINCT a, b, c, e1, e2 FROM r2 WHERE w >= {LEAST}", _PATH2)(lambda g: support.two_path_centres(support.heavy(g, LEAST)).select("a", "b", "c", "e1", "e2").distinct())
trade("embeds_min_vertex_weight", f"SELECT DISTINCT a, b, c, e1, e2 FROM r2 WHERE vw >= {LEAST_VERTEX}", _PATH2)(lambda g: support.two_path_centres(support.heavy_ends(g, LEAST_VERTEX)).select("a", "b", "c", "e1", "e2").distinct())

#: A path customer - part - supplier, all of the first labels.
_SHAPE = Pattern.of([0, 10, 20], [(0, 1, 0), (1, 2, 0)])
trade(
    "neighbor_profile_filter",
    """SELECT 0 AS pos, src AS v FROM adj WHERE ls = 0 GROUP BY src HAVING count(*) FILTER (ld = 10) >= 1
       UNION ALL SELECT 1, src FROM adj WHERE ls = 10 GROUP BY src HAVING count(*) FILTER (ld = 0) >= 1 AND count(*) FILTER (ld = 20) >= 1
       UNION ALL SELECT 2, src FROM adj WHERE ls = 20 GROUP BY src HAVING count(*) FILTER (ld = 10) >= 1""",
)(lambda g: support.first_domains(g, _SHAPE))
trade(
    "arc_consistency_domains",
    """SELECT 0 AS pos, p.dst AS v FROM o p GROUP BY 2 UNION ALL SELECT 1, src FROM o GROUP BY 2 UNION ALL SELECT 2, z FROM o GROUP BY 2""",
    "o AS (SELECT p.dst, p.src, q.dst AS z FROM adj p JOIN adj q ON p.src = q.src WHERE p.ls = 10 AND p.ld = 0 AND q.ld = 20)",
)(lambda g: support.arc_consistent(g, _SHAPE, support.first_domains(g, _SHAPE)))

# --- candidates and mining

_TEXT = "labels string, n_edges int, support long, bottleneck double"


def shape_text(p: Pattern) -> str:
    """A path, star or triangle by its labels, written the least way: a-b-c, c(a,b,d), or a,b,c."""
    degrees = sorted(p.degree(u) for u in range(p.n_vertices))
    if p.n_edges == 3 and p.n_vertices == 3:
        return "triangle " + ",".join(map(str, sorted(p.labels)))
    if p.n_edges == 3 and degrees[-1] == 3:
        centre = next(u for u in range(4) if p.degree(u) == 3)
        return f"star {p.labels[centre]}({','.join(map(str, sorted(p.labels[v] for v in p.links[centre])))})"
    at = next(u for u in range(p.n_vertices) if p.degree(u) == 1)
    way, before = [at], None
    while len(way) < p.n_vertices:
        following = next(v for v in p.links[way[-1]] if v != before)
        before = way[-1]
        way.append(following)
    labels = [p.labels[u] for u in way]
    return "path " + "-".join(map(str, min(labels, labels[::-1])))


_LABELS = """lab AS (SELECT label FROM vertices GROUP BY label HAVING count(*) >= (SELECT sup FROM k)),
  one AS (SELECT e1.* FROM e1 JOIN lab x ON x.label = la JOIN lab y ON y.label = lb),
  good AS (SELECT la, lb FROM one WHERE mni >= (SELECT sup FROM k) UNION SELECT lb, la FROM one WHERE mni >= (SELECT sup FROM k)),
  kids AS (SELECT DISTINCT least(x.lb, y.lb) AS a, x.la AS b, greatest(x.lb, y.lb) AS c FROM good x JOIN good y ON x.la = y.la)"""


def _candidates(g: Graph, strategy, **options) -> DataFrame:
    m = mine(g, min_sup(g), strategy, Options(max_edges=2, **options))
    spark = g.adj.sparkSession
    c = m.counters
    return spark.createDataFrame([(c.candidates, c.frequent, c.pruned_by_apriori, c.pruned_by_strategy, c.pruned_by_structure, c.pruned_by_weight)], "candidates long, frequent long, pruned_by_apriori long, pruned_by_strategy long, pruned_by_structure long, pruned_by_weight long")


# To two edges, an unweighted candidate is a triple of frequent labels, or a growth of a frequent edge by a present
# triple; apriori keeps the growths whose edges are both frequent.
_GROWTHS = _LABELS + """,
  present AS (SELECT la, lb FROM one UNION SELECT lb, la FROM one),
  grown AS (SELECT DISTINCT least(x.lb, y.lb) AS a, x.la AS b, greatest(x.lb, y.lb) AS c FROM good x JOIN present y ON x.la = y.la)"""
_FREQ2 = "(SELECT count(*) FROM f2 JOIN kids USING (a, b, c) WHERE mni >= (SELECT sup FROM k){})"
_FREQ1 = "(SELECT count(*) FROM one WHERE mni >= (SELECT sup FROM k){})"
trade(
    "apriori_candidates",
    f"SELECT (SELECT count(*) FROM one) + (SELECT count(*) FROM kids) AS candidates, {_FREQ1.format('')} + {_FREQ2.format('')} AS frequent, (SELECT count(*) FROM grown) - (SELECT count(*) FROM kids) AS pruned_by_apriori, 0::BIGINT AS pruned_by_strategy, 0::BIGINT AS pruned_by_structure, 0::BIGINT AS pruned_by_weight",
    f"{_EDGE}, {_PATH2}, {_GROWTHS}",
)(lambda g: _candidates(g, Unweighted()))

_EDGE_OK = """, ok AS (SELECT la, lb FROM one WHERE {w} >= {t}), ok2 AS (SELECT la, lb FROM ok UNION SELECT lb, la FROM ok),
  goodw AS (SELECT * FROM good JOIN ok2 USING (la, lb)),
  kidsw AS (SELECT DISTINCT least(x.lb, y.lb) AS a, x.la AS b, greatest(x.lb, y.lb) AS c FROM goodw x JOIN goodw y ON x.la = y.la),
  seenw AS (SELECT DISTINCT least(x.lb, y.lb) AS a, x.la AS b, greatest(x.lb, y.lb) AS c FROM goodw x JOIN present y ON x.la = y.la),
  ruled AS (SELECT * FROM seenw s WHERE NOT EXISTS (SELECT 1 FROM ok2 o WHERE o.la = s.b AND o.lb = s.a) OR NOT EXISTS (SELECT 1 FROM ok2 o WHERE o.la = s.b AND o.lb = s.c))"""
_EDGE_BODY = """SELECT (SELECT count(*) FROM ok) + (SELECT count(*) FROM kidsw) AS candidates,
  (SELECT count(*) FROM one WHERE mni >= (SELECT sup FROM k) AND {w} >= {t}) + (SELECT count(*) FROM f2 JOIN kidsw USING (a, b, c) WHERE mni >= (SELECT sup FROM k) AND {w} >= {t}) AS frequent,
  (SELECT count(*) FROM seenw) - (SELECT count(*) FROM ruled) - (SELECT count(*) FROM kidsw) AS pruned_by_apriori,
  (SELECT count(*) FROM one) - (SELECT count(*) FROM ok) + (SELECT count(*) FROM ruled) AS pruned_by_strategy, 0::BIGINT AS pruned_by_structure, 0::BIGINT AS pruned_by_weight"""
trade("edge_filter_candidates", _EDGE_BODY.format(w="max_w", t=LEAST), f"{_EDGE}, {_PATH2}, {_GROWTHS}{_EDGE_OK.format(w='max_w', t=LEAST)}")(lambda g: _candidates(g, EdgeBottleneck(LEAST, "edge", cut=False)))
trade("weighty_filter_candidates", _EDGE_BODY.format(w="max_vw", t=LEAST_VERTEX), f"{_EDGE}, {_PATH2}, {_GROWTHS}{_EDGE_OK.format(w='max_vw', t=LEAST_VERTEX)}")(lambda g: _candidates(g, VertexBottleneck(LEAST_VERTEX, cut=False)))
trade(
    "lookup_filter_candidates",
    f"""SELECT (SELECT count(*) FROM one) + count(*) FILTER (mni IS NOT NULL AND max_w >= {LEAST}) AS candidates,
          (SELECT count(*) FROM one WHERE mni >= (SELECT sup FROM k) AND max_w >= {LEAST}) + count(*) FILTER (mni IS NOT NULL AND max_w >= {LEAST}) AS frequent, 0::BIGINT AS pruned_by_apriori, 0::BIGINT AS pruned_by_strategy,
          count(*) FILTER (mni IS NULL) AS pruned_by_structure, count(*) FILTER (max_w < {LEAST}) AS pruned_by_weight
        FROM seenw LEFT JOIN (SELECT * FROM f2 WHERE mni >= (SELECT sup FROM k)) USING (a, b, c)""",
    f"""{_EDGE}, {_PATH2}, {_GROWTHS}, ok AS (SELECT la, lb FROM one WHERE mni >= (SELECT sup FROM k) AND max_w >= {LEAST}), ok2 AS (SELECT la, lb FROM ok UNION SELECT lb, la FROM ok),
    seenw AS (SELECT DISTINCT least(x.lb, y.lb) AS a, x.la AS b, greatest(x.lb, y.lb) AS c FROM ok2 x JOIN present y ON x.la = y.la)""",
)(lambda g: _candidates(g, EdgeBottleneck(LEAST)))

# All patterns to three edges of the event graph, by enumeration of paths, stars and triangles.
_ALL3 = f"""{_EDGE}, {_PATH2}, {_TRIANGLE},
  p3 AS (SELECT p.ld AS l0, p.ls AS l1, q.ld AS l2, r.ld AS l3, p.dst AS v0, p.src AS v1, q.dst AS v2, r.dst AS v3, least(p.w, q.w, r.w) AS w, least(p.wd, p.ws, q.wd, r.wd) AS vw
       FROM adj p JOIN adj q ON p.src = q.src AND p.dst <> q.dst JOIN adj r ON r.src = q.dst AND r.dst <> p.src AND r.dst <> p.dst WHERE (p.ld, p.ls) <= (r.ld, q.ld)),
  s3 AS (SELECT p.ls AS l0, p.ld AS l1, q.ld AS l2, r.ld AS l3, p.src AS v0, p.dst AS v1, q.dst AS v2, r.dst AS v3, least(p.w, q.w, r.w) AS w, least(p.ws, p.wd, q.wd, r.wd) AS vw
       FROM adj p JOIN adj q ON p.src = q.src AND p.dst <> q.dst JOIN adj r ON p.src = r.src AND r.dst <> p.dst AND r.dst <> q.dst WHERE p.ld <= q.ld AND q.ld <= r.ld),
  t3 AS (SELECT p.ls AS l0, p.ld AS l1, q.ld AS l2, p.src AS v0, p.dst AS v1, q.dst AS v2, least(p.w, q.w, r.w) AS w, least(p.ws, p.wd, q.wd) AS vw
       FROM adj p JOIN adj q ON p.dst = q.src AND q.dst <> p.src JOIN adj r ON r.src = p.src AND r.dst = q.dst WHERE p.ls <= p.ld AND q.ls <= q.ld),
  everything AS (
    SELECT 'path ' || la || '-' || lb AS labels, 1 AS n_edges, mni AS support, max_w AS bottleneck, max_vw AS vertex_bottleneck FROM e1
    UNION ALL SELECT 'path ' || a || '-' || b || '-' || c, 2, mni, max_w, max_vw FROM f2
    UNION ALL SELECT 'path ' || l0 || '-' || l1 || '-' || l2 || '-' || l3, 3, least(count(DISTINCT v0), count(DISTINCT v1), count(DISTINCT v2), count(DISTINCT v3)), max(w), max(vw) FROM p3 GROUP BY ALL
    UNION ALL SELECT 'star ' || l0 || '(' || l1 || ',' || l2 || ',' || l3 || ')', 3, least(count(DISTINCT v0), count(DISTINCT v1), count(DISTINCT v2), count(DISTINCT v3)), max(w), max(vw) FROM s3 GROUP BY ALL
    UNION ALL SELECT 'triangle ' || l0 || ',' || l1 || ',' || l2, 3, least(count(DISTINCT v0), count(DISTINCT v1), count(DISTINCT v2)), max(w), max(vw) FROM t3 GROUP BY ALL)"""


def _mined(name: str, make, condition: str, vertex_weights: bool = False):
    sql = event_sql(f"SELECT labels, n_edges, support, bottleneck FROM everything WHERE support >= {EVENT_SUPPORT}{condition}", _ALL3)

    @query(name, sql)
    def run(spark, sf_dir):
        m = mine(derive.event_graph(spark, sf_dir, upto=4), EVENT_SUPPORT, make(), Options(max_edges=3, vertex_weights=vertex_weights))
        return spark.createDataFrame([(shape_text(p), p.n_edges, x.mni, x.bottleneck) for p, x in m.patterns], _TEXT)


_mined("mine_unweighted", Unweighted, "")
_mined("mine_edge_weight", lambda: EdgeBottleneck(5.0), " AND bottleneck >= 5")
_mined("mine_edge_weight_per_edge", lambda: EdgeBottleneck(5.0, "edge"), " AND bottleneck >= 5")
_mined("mine_vertex_weight", lambda: VertexBottleneck(4.2), " AND vertex_bottleneck >= 4.2", vertex_weights=True)


@query("strategy_compare", event_sql(f"""
  SELECT 'none' AS algorithm, 'none' AS weight_model, count(*) AS freq FROM everything WHERE support >= {EVENT_SUPPORT}
  UNION ALL SELECT 'edge', 'edge', count(*) FROM everything WHERE support >= {EVENT_SUPPORT} AND bottleneck >= 5
  UNION ALL SELECT 'lookup', 'edge', count(*) FROM everything WHERE support >= {EVENT_SUPPORT} AND bottleneck >= 5
  UNION ALL SELECT 'vertex', 'vertex', count(*) FROM everything WHERE support >= {EVENT_SUPPORT} AND vertex_bottleneck >= 5""", _ALL3))  # fmt: skip
def strategy_compare(spark, sf_dir):
    return compare.compare(derive.event_graph(spark, sf_dir, upto=4), EVENT_SUPPORT, 5.0, options=Options(max_edges=3), shared=True).select("algorithm", "weight_model", F.col("freq").cast("long").alias("freq"))


@query("tau_sweep", event_sql(f"""
  SELECT q, d.w AS min_weight, count(labels) AS freq FROM d JOIN (VALUES (0.0::DOUBLE), (0.5), (1.0)) AS t(q) ON i = floor(q * (n - 1))
  LEFT JOIN everything ON n_edges <= 2 AND support >= {EVENT_SUPPORT} AND bottleneck >= d.w GROUP BY q, d.w""",
  _ALL3 + ", d AS (SELECT w, row_number() OVER (ORDER BY w) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT w FROM edges))"))
def tau_sweep(spark, sf_dir):
    out = compare.sweep(derive.event_graph(spark, sf_dir, upto=3), EVENT_SUPPORT, (0.0, 0.5, 1.0), Options(max_edges=2))
    return out.select("q", "min_weight", F.col("freq").cast("long").alias("freq"))


def labelled_event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The event graph with edges labelled by whether their weight is odd; of twins enough for patterns of two edges."""
    g = derive.event_graph(spark, sf_dir, upto=3)
    odd = (F.col("w") % 2).cast("int")
    return Graph(g.vertices, g.edges.withColumn("el", odd), g.adj.withColumn("el", odd), twins=g.twins)


def labelled_text(p: Pattern) -> str:
    """A single edge as la/el/lb, a two-path as centre(a/e1,c/e2)."""
    if p.n_edges == 1:
        return "{}/{}/{}".format(min(p.labels), p.edges[0][2], max(p.labels))
    u = next(u for u in range(3) if p.degree(u) == 2)
    return f"{p.labels[u]}({','.join(f'{a}/{e}' for a, e in sorted((p.labels[v], el) for v, el in p.links[u].items()))})"


@query("mine_edge_labels", event_sql(f"""
  SELECT la || '/' || el || '/' || lb AS labels, 1 AS n_edges, mni AS support, max_w AS bottleneck FROM e1 WHERE mni >= 6
  UNION ALL SELECT b || '(' || a || '/' || e1 || ',' || c || '/' || e2 || ')', 2, mni, max_w FROM f2 WHERE mni >= 6""", f"{_EDGE}, {_PATH2}").replace("0 AS el, count(*)::DOUBLE AS w", "(count(*) % 2)::INTEGER AS el, count(*)::DOUBLE AS w"))  # fmt: skip
def mine_edge_labels(spark, sf_dir):
    m = mine(labelled_event_graph(spark, sf_dir), 6, options=Options(max_edges=2))
    return spark.createDataFrame([(labelled_text(p), p.n_edges, x.mni, x.bottleneck) for p, x in m.patterns], _TEXT)


# --- results

@query("upper_median", "SELECT o_orderpriority, list_sort(list(o_totalprice))[floor(count(*) / 2)::BIGINT + 1] AS median FROM orders GROUP BY 1")
def upper_median(spark, sf_dir):
    return index.upper_median(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_orderpriority"], "o_totalprice")


_RESULTS = """r AS (SELECT 'd' || c_nationkey % 7 AS dataset, 'a' || c_custkey % 4 AS algorithm, (c_nationkey % 3)::INTEGER AS min_sup, 1.0::DOUBLE AS min_weight, 0::BIGINT AS budget,
  c_custkey AS limit_ms, CASE WHEN c_custkey % 5 < 3 THEN '1/1' ELSE '-' END AS timed_out FROM customer)"""


def _results(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.format_string("d%d", F.col("c_nationkey") % 7).alias("dataset"), F.format_string("a%d", F.col("c_custkey") % 4).alias("algorithm"), (F.col("c_nationkey") % 3).cast("int").alias("min_sup"), F.lit(1.0).alias("min_weight"), F.lit(0).cast("long").alias("budget"), F.col("c_custkey").alias("limit_ms"), F.when(F.col("c_custkey") % 5 < 3, "1/1").otherwise("-").alias("timed_out"))


@query("timed_out_cells", f"WITH {_RESULTS} SELECT dataset, min_sup, min_weight, budget, string_agg(algorithm, ',' ORDER BY algorithm) AS algorithms FROM r WHERE timed_out <> '-' AND (dataset, min_sup) NOT IN (SELECT dataset, min_sup FROM r WHERE limit_ms <= 5) GROUP BY ALL")
def timed_out_cells(spark, sf_dir):
    r = _results(spark, sf_dir)
    return compare.late_cells(r, r.where("limit_ms <= 5"))


@query("result_merge", f"WITH {_RESULTS} SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY dataset, algorithm, min_sup ORDER BY timed_out <> '-', limit_ms DESC) AS i FROM r) WHERE i = 1")
def result_merge(spark, sf_dir):
    return compare.merged_results(_results(spark, sf_dir))


@query("pattern_to_text", trade_sql("SELECT format('v 0 {}' || chr(10) || 'v 1 {}' || chr(10) || 'e 0 1 {}' || chr(10), la, lb, el) AS text, mni AS support FROM e1", _EDGE))
def pattern_to_text(spark, sf_dir):
    e = support.edges(derive.trade_graph(spark, sf_dir))
    edge = F.array(F.struct(F.lit(0).alias("u"), F.lit(1).alias("v"), F.col("el")))
    return e.select(scalars.pattern_text(F.array("la", "lb"), edge).alias("text"), F.col("mni").alias("support"))


@query("edge_sample", trade_sql("SELECT a, b, el, w FROM edges ORDER BY a, b LIMIT 10"))
def edge_sample(spark, sf_dir):
    return derive.trade_graph(spark, sf_dir).edges.orderBy("a", "b").limit(10)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent two-edge patterns of the trade graph with their bottleneck weights."""
    return QUERIES["path2_mni"](spark, sf_dir)
