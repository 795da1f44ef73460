"""Annotation mining: pen strokes and highlights of a page to clusters, pairs and fingerprints.

Everything is keyed by page and then by cluster, so pages spread over the cluster. Strokes meet in the cells of a grid
and not as all pairs of a page; clusters are the connected components of a page's edges,
found where the page's edges are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import entries as E, text as T
from ..plans.registry import query
from ..store import cut, placed_by_part_of_keys
from .graph import components_within

CLUSTER_GAP, PAIR_GAP, CELL = 40.0, 160.0, 128.0

GAP_SQL = "sqrt(pow(greatest(a.x0-b.x1, b.x0-a.x1, 0), 2) + pow(greatest(a.y0-b.y1, b.y0-a.y1, 0), 2))"
INK_SQL = "ink AS (SELECT * FROM v_strokes WHERE tool NOT IN ('highlighter','eraser','eraser_area','selection_brush'))"
EDGES_SQL = f"edges AS (SELECT a.page, a.stroke_no AS a, b.stroke_no AS b FROM ink a JOIN ink b ON a.page = b.page AND a.stroke_no < b.stroke_no WHERE {GAP_SQL} <= 40)"
REACH_SQL = f"""WITH RECURSIVE {INK_SQL}, {EDGES_SQL}, both_ways AS (SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges),
reach(a, b) AS (SELECT stroke_no, stroke_no FROM ink UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
label AS (SELECT a AS stroke_no, min(b) AS cluster FROM reach GROUP BY a),
clusters AS (SELECT i.page, l.cluster, CAST(count(*) AS BIGINT) AS strokes, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ink i JOIN label l USING (stroke_no) GROUP BY i.page, l.cluster)"""
PAIRED_SQL = f"""{REACH_SQL}, near AS (SELECT a.page, a.cluster, b.hl_no, {GAP_SQL} AS gap FROM clusters a JOIN v_highlights b ON a.page = b.page),
pairs AS (SELECT page, cluster, hl_no FROM (SELECT *, row_number() OVER (PARTITION BY page, cluster ORDER BY gap, hl_no) AS n FROM near WHERE gap <= 160) WHERE n = 1)"""


@query("scan_ink", "v_strokes", sql="SELECT page, stroke_no, tool, n_points, x1 - x0 AS width, y1 - y0 AS height FROM v_strokes WHERE n_points > 0")
def scan_ink(strokes: DataFrame) -> DataFrame:
    """Strokes that have points, with the size of their boxes."""
    return strokes.where("n_points > 0").select("page", "stroke_no", "tool", "n_points", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))


def stroke_boxes(strokes: DataFrame) -> DataFrame:
    """The box of each stroke from its points: array<struct<x, y>>; strokes without points are dropped."""
    side = lambda f, axis: f(F.transform("points", lambda p: p[axis].cast("double")))
    return strokes.where(F.size("points") > 0).withColumns({"x0": side(F.array_min, "x"), "y0": side(F.array_min, "y"), "x1": side(F.array_max, "x"), "y1": side(F.array_max, "y"), "n_points": F.size("points").cast("long")})


@query("handwriting_only", "v_strokes", sql="SELECT page, stroke_no, tool FROM v_strokes WHERE tool NOT IN ('highlighter','eraser','eraser_area','selection_brush')")
def handwriting_only(strokes: DataFrame) -> DataFrame:
    return strokes.where(E.handwriting(F.col("tool"))).select("page", "stroke_no", "tool")


@query("stroke_bbox", "v_strokes", sql="SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM v_strokes GROUP BY page")
def page_boxes(strokes: DataFrame) -> DataFrame:
    return strokes.groupBy("page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("bbox_gap", "v_highlights", sql=f"SELECT a.hl_no AS a, b.hl_no AS b, {GAP_SQL} AS gap FROM v_highlights a JOIN v_highlights b ON a.page = b.page AND a.hl_no < b.hl_no")
def highlight_gaps(highlights: DataFrame) -> DataFrame:
    """The distance of every pair of highlights of a page: the pairs are what is asked for here; what only needs near ones
    (clusters, the nearest highlight) goes by the grid."""
    box = ("hl_no", "x0", "y0", "x1", "y1")
    a, b = (highlights.select("page", *[F.col(c).alias(p + c) for c in box]) for p in ("a_", "b_"))
    return a.join(b, "page").where("a_hl_no < b_hl_no").select(F.col("a_hl_no").alias("a"), F.col("b_hl_no").alias("b"), E.box_gap("a_", "b_").alias("gap"))


def edges(strokes: DataFrame, gap: float = CLUSTER_GAP, cell: float = CELL) -> DataFrame:
    """(page, a, b) of strokes at most ``gap`` apart.

    Boxes grown by half the gap overlap whenever the boxes are that near, so both cover some cell of the grid: an equality
    join on (page, cell) finds every pair, and the distance decides.
    """
    cells = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - gap / 2) / cell), F.floor((F.col(high) + gap / 2) / cell)))
    placed = strokes.where(E.handwriting(F.col("tool"))).withColumn("cx", cells("x0", "x1")).withColumn("cy", cells("y0", "y1"))
    box = ("stroke_no", "x0", "y0", "x1", "y1")
    a, b = (placed.select("page", "cx", "cy", *[F.col(c).alias(p + c) for c in box]) for p in ("a_", "b_"))
    near = a.join(b, ["page", "cx", "cy"]).where((F.col("a_stroke_no") < F.col("b_stroke_no")) & (E.box_gap("a_", "b_") <= gap))
    return near.select("page", F.col("a_stroke_no").alias("a"), F.col("b_stroke_no").alias("b")).distinct()


@query("stroke_edges", "v_strokes", sql=f"WITH {INK_SQL}, {EDGES_SQL} SELECT page, a, b FROM edges")
def stroke_edges(strokes: DataFrame) -> DataFrame:
    return edges(strokes)


def labelled(strokes: DataFrame) -> DataFrame:
    """Handwriting with its cluster: the least stroke that it is linked with. The strokes are written once and read three times:
    as both sides of their edges, and to meet their labels. They meet on their page, so what follows by page needs no other shuffle."""
    inked = cut(strokes.where(E.handwriting(F.col("tool"))), "ink")
    with placed_by_part_of_keys(inked.sparkSession):
        label = cut(components_within(edges(inked.repartition("page")), "page").withColumnRenamed("node", "stroke_no"), "labels")
    both = inked.withColumn("_label", F.lit(None).cast("long")).unionByName(label.withColumnRenamed("label", "_label"), allowMissingColumns=True).repartition("page")
    found = both.withColumn("_found", F.max("_label").over(W.partitionBy("page", "stroke_no"))).where("_label IS NULL")
    return found.withColumn("cluster", F.coalesce("_found", "stroke_no")).drop("_label", "_found")


def clusters(strokes: DataFrame) -> DataFrame:
    return labelled(strokes).repartition("page").groupBy("page", "cluster").agg(F.count(F.lit(1)).alias("strokes"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@query("ink_clusters", "v_strokes", sql=f"{REACH_SQL} SELECT page, cluster, strokes, x0, y0, x1, y1 FROM clusters")
def ink_clusters(strokes: DataFrame) -> DataFrame:
    return clusters(strokes)


def nearest_highlight(found: DataFrame, highlights: DataFrame, gap: float = PAIR_GAP, cell: float = CELL) -> DataFrame:
    """``found`` with the nearest highlight (``hl_no``) within ``gap`` or null; of equally near ones the first.

    Boxes grown by half the gap meet in the cells of a grid. Clusters keep their rows in a left join, so they are computed once.
    Both sides go to their page first and to the cells there, so only the boxes are shuffled, and not their copies in every cell.
    """
    box = ("x0", "y0", "x1", "y1")
    cells = lambda low, high: F.explode(F.sequence(F.floor((F.col(low) - gap / 2) / cell), F.floor((F.col(high) + gap / 2) / cell)))
    grown = lambda rows, own, side: rows.select("page", *own, *[F.col(x).alias(side + x) for x in box]).withColumn("cx", cells(side + "x0", side + "x1")).withColumn("cy", cells(side + "y0", side + "y1"))
    kept = [c for c in found.columns if c not in ("page", "cluster", *box)]
    near = grown(found.repartition("page"), ["cluster", *kept], "a_").join(grown(highlights.repartition("page"), ["hl_no"], "b_"), ["page", "cx", "cy"], "left").withColumn("gap", E.box_gap("a_", "b_"))
    first = [F.first(f"a_{c}").alias(c) for c in box] + [F.first(c).alias(c) for c in kept]
    nearest = near.groupBy("page", "cluster").agg(*first, F.min(F.when(F.col("hl_no").isNotNull() & (F.col("gap") <= gap), F.struct("gap", "hl_no")))["hl_no"].alias("hl_no"))
    with placed_by_part_of_keys(found.sparkSession):
        return cut(nearest, "nearest")


@query("pair_nearest", "v_strokes", "v_highlights", sql=f"{PAIRED_SQL} SELECT c.page, c.cluster, p.hl_no FROM clusters c LEFT JOIN pairs p ON c.page = p.page AND c.cluster = p.cluster")
def pair_nearest(strokes: DataFrame, highlights: DataFrame) -> DataFrame:
    return nearest_highlight(clusters(strokes), highlights).select("page", "cluster", "hl_no")


@query("unpaired_highlights", "v_strokes", "v_highlights", sql=f"{PAIRED_SQL} SELECT page, hl_no, text FROM v_highlights h WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.page = h.page AND p.hl_no = h.hl_no)")
def unpaired_highlights(strokes: DataFrame, highlights: DataFrame) -> DataFrame:
    """Highlights that no cluster took: drafts of their own, without ink."""
    taken = pair_nearest(strokes, highlights).where("hl_no IS NOT NULL").select("page", "hl_no")
    return highlights.join(taken, ["page", "hl_no"], "left_anti").select("page", "hl_no", "text")


SIGNED_SQL = "concat_ws('|', CAST(stroke_no AS VARCHAR), CAST(n_points AS VARCHAR), CAST(CAST(round_even(x0, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(y0, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(x1, 0) AS BIGINT) AS VARCHAR), CAST(CAST(round_even(y1, 0) AS BIGINT) AS VARCHAR))"


def signatures(inked: DataFrame) -> DataFrame:
    """(page, cluster, signed): every stroke's id, points and box in whole numbers (half to even), sorted and joined."""
    whole = [F.bround(c, 0).cast("long").cast("string") for c in ("x0", "y0", "x1", "y1")]
    sig = F.concat_ws("|", F.col("stroke_no").cast("string"), F.col("n_points").cast("string"), *whole)
    return inked.withColumn("sig", sig).groupBy("page", "cluster").agg(F.array_join(F.array_sort(F.collect_list("sig")), ";").alias("signed"))


@query("cluster_hash", "v_strokes", sql=f"{REACH_SQL} SELECT page, cluster, string_agg(sig, ';' ORDER BY sig) AS signed FROM (SELECT i.page, l.cluster, {SIGNED_SQL} AS sig FROM ink i JOIN label l USING (stroke_no)) GROUP BY page, cluster")
def cluster_hash(strokes: DataFrame) -> DataFrame:
    """The text that a cluster's fingerprint is made of; ``fingerprints`` adds the hash."""
    return signatures(labelled(strokes))


def fingerprints(inked: DataFrame) -> DataFrame:
    """(page, cluster, hash): FNV-1a of the signature, whatever order the strokes came in."""
    return signatures(inked).select("page", "cluster", T.fnv64(F.col("signed")).alias("hash"))


@query("page_drafts", "v_strokes", "v_highlights", sql=f"{PAIRED_SQL} SELECT c.page, CAST(count(*) AS BIGINT) AS clusters, CAST(count(p.hl_no) AS BIGINT) AS paired, CAST(sum(strokes) AS BIGINT) AS strokes FROM clusters c LEFT JOIN pairs p ON c.page = p.page AND c.cluster = p.cluster GROUP BY c.page")
def page_drafts(strokes: DataFrame, highlights: DataFrame) -> DataFrame:
    """What each page gives: clusters, how many found a highlight, and their strokes."""
    paired = nearest_highlight(clusters(strokes), highlights)
    return paired.groupBy("page").agg(F.count(F.lit(1)).alias("clusters"), F.count("hl_no").alias("paired"), F.sum("strokes").alias("strokes"))
