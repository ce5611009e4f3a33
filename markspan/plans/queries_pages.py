"""Queries over page measurements, regions and layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from markspan.operators import layout, marks, normalize
from markspan.plans.registry import query

# --- blank pages and pixel measures ----------------------------------------------------------------------------


@query(
    "p4_not_blank_pages",
    """SELECT page_id, std_dev, ink_ratio, edge_ratio FROM v_stat
  WHERE NOT coalesce(std_dev < 10 AND ink_ratio < 0.0020 AND edge_ratio < 0.0010, FALSE)""",
)
def _(i):
    return i.stat.filter(~layout.blank_by_measures(F.col("std_dev"), F.col("ink_ratio"), F.col("edge_ratio")))


PX = """px AS (SELECT page_id, label, pixels, CAST(unnest(pixels) AS BIGINT) AS p, unnest(range(64)) AS k FROM v_page),
  st AS (SELECT page_id, any_value(label) AS label, sqrt(CAST(count(*) * sum(p * p) - sum(p) * sum(p) AS DOUBLE)) / count(*) AS std_dev,
    (max(p) - min(p)) / 255.0 AS contrast, CAST(count(*) FILTER (WHERE p <= 245) AS DOUBLE) / count(*) AS ink_ratio,
    CAST(sum(p) AS DOUBLE) / count(*) AS mean FROM px GROUP BY page_id)"""


@query("p5_variance_blank", f"WITH {PX} SELECT page_id, std_dev, std_dev < 10 AS is_blank FROM st")
def _(i):
    return layout.page_stats(i.page).select("page_id", "std_dev", "is_blank")


@query("f25_pixel_statistics", f"WITH {PX} SELECT page_id, std_dev, CAST(contrast AS DOUBLE) AS contrast, ink_ratio FROM st")
def _(i):
    return layout.page_stats(i.page).select("page_id", "std_dev", "contrast", "ink_ratio")


@query(
    "f24_average_hash",
    f"""WITH {PX} SELECT px.page_id, sha256(string_agg(CASE WHEN px.p > st.mean THEN '1' ELSE '0' END, '' ORDER BY px.k)) AS image_hash
  FROM px JOIN st ON st.page_id = px.page_id GROUP BY 1""",
)
def _(i):
    return layout.page_stats(i.page).select("page_id", "image_hash")


LAP = """lap AS (SELECT a.page_id, a.k, sum(b.p * CASE WHEN b.r = a.r AND b.c = a.c THEN -4 ELSE
      (CASE WHEN b.c = a.c THEN (CASE WHEN b.r = abs(a.r - 1) THEN 1 ELSE 0 END) + (CASE WHEN b.r = 7 - abs(6 - a.r) THEN 1 ELSE 0 END) ELSE 0 END) +
      (CASE WHEN b.r = a.r THEN (CASE WHEN b.c = abs(a.c - 1) THEN 1 ELSE 0 END) + (CASE WHEN b.c = 7 - abs(6 - a.c) THEN 1 ELSE 0 END) ELSE 0 END) END) AS v
    FROM (SELECT page_id, k, k // 8 AS r, k % 8 AS c FROM px) a JOIN (SELECT page_id, p, k // 8 AS r, k % 8 AS c FROM px) b ON b.page_id = a.page_id GROUP BY 1, 2),
  lv AS (SELECT page_id, CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS DOUBLE) / (count(*) * count(*)) AS laplacian_var FROM lap GROUP BY 1)"""


@query(
    "f26_quality_score",
    f"""WITH {PX}, {LAP} SELECT st.page_id, lv.laplacian_var, round(least(lv.laplacian_var / 500.0, 1.0) * 0.6 + CAST(st.contrast AS DOUBLE) * 0.4, 9) AS quality
  FROM st JOIN lv ON lv.page_id = st.page_id""",
)
def _(i):
    return layout.page_quality(i.page).select("page_id", "laplacian_var", F.round("quality", 9).alias("quality"))


@query(
    "f27_header_regions",
    """WITH h AS (SELECT page_id, CAST(unnest(pixels[1:8]) AS BIGINT) AS p FROM v_page),
  s AS (SELECT page_id, sqrt(CAST(count(*) * sum(p * p) - sum(p) * sum(p) AS DOUBLE)) / count(*) AS header_std FROM h GROUP BY 1)
  SELECT page_id, 'header' AS region_type, 0 AS x, 0 AS y, 8 AS w, 1 AS h, header_std FROM s WHERE header_std > 10""",
)
def _(i):
    return layout.header_regions(i.page)


# --- regions ---------------------------------------------------------------------------------------------------


@query(
    "f28_drawing_areas",
    "SELECT page, x, y, w, h FROM v_reg WHERE w * h > page_w * page_h * 0.02 AND CAST(w AS DOUBLE) / h > 0.5 AND CAST(w AS DOUBLE) / h < 5",
)
def _(i):
    return layout.drawing_areas(i.reg).select("page", "x", "y", "w", "h")


@query(
    "a14_answer_grids",
    """SELECT page, min(cx) - 20 AS x, min(cy) - 20 AS y, max(cx) - min(cx) + 40 AS w, max(cy) - min(cy) + 40 AS h, count(*) AS bubble_count
  FROM v_circ GROUP BY 1 HAVING count(*) > 10""",
)
def _(i):
    return layout.answer_grids(i.circ)


@query(
    "a15_largest_region",
    """SELECT page, x, y, w, h, area FROM (SELECT page, x, y, w, h, w * h AS area,
    row_number() OVER (PARTITION BY page ORDER BY w * h DESC, y, x, w DESC, h DESC) AS rn FROM v_reg WHERE region_type = 'answer_grid') WHERE rn = 1""",
)
def _(i):
    return layout.largest_regions(i.reg)


CELL = """region_type || ':' || CAST(CAST(trunc(x / CAST(page_w AS DOUBLE) * 10) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(trunc(y / CAST(page_h AS DOUBLE) * 10) AS BIGINT) AS VARCHAR)
    || ',' || CAST(CAST(trunc(w / CAST(page_w AS DOUBLE) * 10) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(trunc(h / CAST(page_h AS DOUBLE) * 10) AS BIGINT) AS VARCHAR)"""
HASHES = f"""hs AS (SELECT page, left(md5(string_agg(cell, '|' ORDER BY cell)), 12) AS layout_hash FROM (SELECT page, {CELL} AS cell FROM v_reg) GROUP BY 1)"""


@query("f23_layout_hash", f"WITH {HASHES} SELECT page, layout_hash FROM hs")
def _(i):
    return layout.layout_hashes(i.reg)


@query("a13_layout_clusters", f"WITH {HASHES} SELECT layout_hash, count(*) AS n_pages, min(page) AS first_page FROM hs GROUP BY 1")
def _(i):
    return layout.layout_clusters(layout.layout_hashes(i.reg))


@query(
    "a13_cluster_pages",
    f"WITH {HASHES} SELECT layout_hash, row_number() OVER (PARTITION BY layout_hash ORDER BY page) AS n, page FROM hs",
)
def _(i):
    return layout.cluster_pages(layout.layout_hashes(i.reg))


@query("a13_format_count", f"WITH {HASHES} SELECT count(DISTINCT layout_hash) AS n_formats FROM hs")
def _(i):
    return layout.layout_clusters(layout.layout_hashes(i.reg)).agg(F.count(F.lit(1)).alias("n_formats"))


@query(
    "w2_representative_page",
    f"""WITH {HASHES}, q AS (SELECT hs.layout_hash, hs.page, greatest(v.quality, 0) AS quality FROM hs JOIN v_quality v ON v.page = hs.page)
  SELECT layout_hash, page FROM (SELECT *, row_number() OVER (PARTITION BY layout_hash ORDER BY quality DESC, page) AS rn FROM q) WHERE rn = 1""",
)
def _(i):
    return layout.representative_pages(layout.layout_hashes(i.reg).join(i.quality, "page"))


@query(
    "j9_page_formats",
    """WITH f AS (SELECT CAST(p_partkey AS VARCHAR) AS format_id, p_size FROM part WHERE p_partkey % 6 IN (0, 1, 5)),
  g AS (SELECT o_orderkey AS page, CAST(o_custkey AS VARCHAR) AS layout_hash, CASE o_custkey % 6 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 5 THEN 0 WHEN 2 THEN 2 ELSE 1 END AS kind, o_custkey FROM orders)
  SELECT g.page, p.p_partkey IS NULL AS is_fallback, CASE WHEN g.kind = 0 THEN CAST(p.p_size AS BIGINT) END AS mcq_end,
    CASE WHEN p.p_partkey IS NULL OR g.o_custkey % 6 IN (3, 4) THEN CAST(20 AS BIGINT) WHEN g.o_custkey % 6 = 0 THEN 35 END AS numeric_end,
    CASE WHEN p.p_partkey IS NULL OR g.o_custkey % 6 IN (3, 4) THEN 'Fallback format' WHEN g.o_custkey % 6 = 0 THEN p.p_type ELSE 'Unknown format' END AS description
  FROM g LEFT JOIN part p ON p.p_partkey = g.o_custkey""",
)
def _(i):
    pages = i.table("orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").cast("string").alias("layout_hash"))
    out = layout.attach_formats(pages, normalize.parse_format_responses(i.fmtresp))
    return out.select("page", "is_fallback", "mcq_end", "numeric_end", "description")


# --- marked options --------------------------------------------------------------------------------------------

CHOSEN = """sc AS (SELECT page, question, opt, ink_ratio * 0.65 + lower_ink * 0.35 AS score FROM v_cell),
  rk AS (SELECT *, row_number() OVER (PARTITION BY page, question ORDER BY score DESC, opt) AS rn FROM sc),
  bs AS (SELECT page, question, max(opt) FILTER (WHERE rn = 1) AS o, max(score) FILTER (WHERE rn = 1) AS best, coalesce(max(score) FILTER (WHERE rn = 2), 0) AS second FROM rk WHERE rn <= 2 GROUP BY 1, 2),
  ch AS (SELECT page, question, CASE WHEN best >= 0.075 AND best / greatest(second, 1e-6) >= 1.20 THEN o END AS opt, best, second FROM bs),
  seen AS (SELECT page, question, CASE least(opt, 5) WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' ELSE 'E' END AS answer FROM ch WHERE opt IS NOT NULL)"""


@query("w1_marked_options", f"WITH {CHOSEN} SELECT page, question, opt, round(best, 9) AS best, round(second, 9) AS second FROM ch")
def _(i):
    return marks.marked_options(i.cell).withColumn("best", F.round("best", 9)).withColumn("second", F.round("second", 9))


def cell_pages(i):
    return i.cell.select("page", F.concat(F.lit("f"), (F.col("page") % 4).cast("string")).alias("format_id")).distinct()


def choice_ranges(i):
    """Per format: the choice range, its size and whether it has drawings."""
    parsed = normalize.parse_ranges(i.fmt)
    return parsed.groupBy("format_id").agg(
        F.max(F.when(F.col("q_type") == "mcq", F.col("start"))).alias("start"),
        F.max(F.when(F.col("q_type") == "mcq", F.col("end"))).alias("end"),
        F.max(F.when(F.col("q_type") == "mcq", F.col("end") - F.col("start") + 1)).alias("mcq_count"),
        F.coalesce(F.bool_or((F.col("q_type") == "drawing") & F.col("start").isNotNull()), F.lit(False)).alias("has_drawing"),
    )


def in_choice_range(answered, pages, ranges):
    placed = answered.join(pages, "page").join(ranges, "format_id")
    return placed.filter(F.col("question").between(F.col("start"), F.col("end"))).select("page", "question", "answer")


CHOICE = """pg AS (SELECT DISTINCT page, 'f' || CAST(page % 4 AS VARCHAR) AS format_id FROM v_cell),
  rg AS (SELECT * FROM (VALUES ('f0', 1, 4, 4, TRUE), ('f1', 1, 5, 5, TRUE), ('f3', 1, 2, 2, FALSE)) AS t(format_id, a, b, n, d)),
  inr AS (SELECT s.* FROM seen s JOIN pg ON pg.page = s.page JOIN rg ON rg.format_id = pg.format_id WHERE s.question BETWEEN rg.a AND rg.b)"""


@query(
    "u2_unclear_questions",
    f"""WITH {CHOSEN}, {CHOICE}, asked AS (SELECT pg.page, unnest(range(CAST(rg.a AS BIGINT), rg.b + 1)) AS question FROM pg JOIN rg ON rg.format_id = pg.format_id)
  SELECT a.page, a.question FROM asked a WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.page = a.page AND s.question = a.question)""",
)
def _(i):
    ranges = choice_ranges(i).filter(F.col("start").isNotNull()).select("format_id", "start", "end")
    return marks.unclear_questions(cell_pages(i), ranges, marks.option_letters(marks.marked_options(i.cell)))


@query(
    "p15_needs_model",
    f"""WITH {CHOSEN}, {CHOICE}, c AS (SELECT page, count(*) AS m FROM inr GROUP BY 1)
  SELECT pg.page, pg.format_id, coalesce(c.m, 0) AS measured, CAST(coalesce(rg.n, 0) AS BIGINT) AS mcq_count,
    coalesce(c.m, 0) = 0 OR (coalesce(rg.n, 0) > 0 AND coalesce(c.m, 0) < rg.n * 0.8) OR coalesce(rg.d, FALSE) AS needs_model
  FROM pg LEFT JOIN c ON c.page = pg.page LEFT JOIN rg ON rg.format_id = pg.format_id""",
)
def _(i):
    pages, ranges = cell_pages(i), choice_ranges(i)
    answered = in_choice_range(marks.option_letters(marks.marked_options(i.cell)), pages, ranges)
    return marks.needs_model(pages, ranges.select("format_id", "mcq_count", "has_drawing"), answered)


@query(
    "j8_merged_sources",
    f"""WITH {CHOSEN}, al AS (SELECT candidate_id AS page, question, answer AS fu, NULL AS fo, NULL AS ms FROM v_ans UNION ALL SELECT page, question, NULL, answer, NULL FROM v_focus
    UNION ALL SELECT page, question, NULL, NULL, CASE WHEN page % 3 = 0 THEN CASE answer WHEN 'C' THEN 'F' WHEN 'D' THEN '7' ELSE answer END ELSE answer END FROM seen),
  w AS (SELECT page, question, max(fu) AS fu, max(fo) AS fo, max(ms) AS ms FROM al GROUP BY 1, 2),
  m AS (SELECT page, question, CASE WHEN CASE WHEN page % 3 = 0 THEN ms IN ('B', 'F', '7') ELSE ms IN ('A', 'B', 'C', 'D', 'E') END THEN ms WHEN fo IS NOT NULL AND (fo <> 'BL' OR coalesce(fu, '') = 'BL') THEN fo ELSE fu END AS answer FROM w)
  SELECT page, question, answer FROM m WHERE answer IS NOT NULL""",
)
def _(i):
    full = i.ans.withColumnRenamed("candidate_id", "page")
    # Every third page has a format of its own, with an option beyond E and a digit.
    own = F.col("page") % 3 == 0
    seen = marks.option_letters(marks.marked_options(i.cell))
    renamed = F.when(own & (F.col("answer") == "C"), "F").when(own & (F.col("answer") == "D"), "7").otherwise(F.col("answer"))
    formats = full.select("page").union(seen.select("page")).distinct().filter(own).select("page", F.array(F.lit("b"), F.lit("F"), F.lit("7")).alias("options"))
    return marks.merge_sources(full, i.focus, seen.withColumn("answer", renamed), page_options=formats)


# --- sampling --------------------------------------------------------------------------------------------------

SAMPLE = """n AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS rn, count(*) OVER (PARTITION BY doc_id) AS c FROM v_docpage)"""
for _mode, _rule in (
    ("first", "rn <= 3"),
    ("last", "rn > c - 3"),
    ("even", "(rn - 1) % greatest(1, c // 3) = 0 AND (rn - 1) // greatest(1, c // 3) < 3"),
):

    @query(f"w9_sample_{_mode}", f"WITH {SAMPLE} SELECT doc_id, page FROM n WHERE c <= 5 OR ({_rule})")
    def _(i, mode=_mode):
        return layout.sample_pages(i.docpage, 3, mode)
