"""Queries over cohorts: clinical joins, statistics tables, selections, documents. Bindings are those of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import documents, text
from ..operators import assembly, clinical, metrics, ranking, reports, scaling, selection, steps, tiling, vectors
from ..operators.scratch import new_path
from ..sources import tables, versions
from .catalogue import _CANDIDATES, _GRID, _KNN, _LANGS, _PATIENTS, _SURVIVAL, T_SQL, _candidates, _parts, _patients, _references, _slides, _survival, _tiles, query, t_p_sql, table

# Statistics tables --------------------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'AML_' WHEN 1 THEN 'normaleskm-' ELSE 'x' END || doc_id AS slide_name,
    [NULL, 'Acute Leukemia', 'Normal marrow', 'Call for more diagnostics', 'other'][n_chars % 5 + 1] AS d, CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 13 <> 0 THEN 'ok' END AS s FROM documents),
p AS (SELECT slide_name, coalesce(s, 'missing') AS summary_status, CASE WHEN lower(slide_name) LIKE 'aml%' THEN 'AML' WHEN lower(slide_name) LIKE 'normaleskm%' THEN 'Normal marrow' ELSE 'Unknown' END AS ground_truth,
    CASE d WHEN 'Acute Leukemia' THEN 'AML' WHEN 'Normal marrow' THEN d WHEN 'Call for more diagnostics' THEN d ELSE CASE WHEN s = 'ok' THEN 'Call for more diagnostics' ELSE 'Unknown' END END AS predicted_label FROM r)
SELECT *, summary_status <> 'error' AS included_in_statistics, summary_status = 'ok' AND predicted_label IN ('AML', 'Normal marrow') AND predicted_label = ground_truth AS is_correct FROM p""")
def run_result_rows(spark, sf_dir):
    kinds = F.array(F.lit(None), *map(F.lit, ("Acute Leukemia", "Normal marrow", "Call for more diagnostics", "other")))
    name = F.concat(F.when(F.col("doc_id") % 3 == 0, "AML_").when(F.col("doc_id") % 3 == 1, "normaleskm-").otherwise("x"), F.col("doc_id").cast("string"))
    status = F.when(F.col("doc_id") % 11 == 0, "error").when(F.col("doc_id") % 13 != 0, "ok")
    runs = table(spark, sf_dir, "documents").select(name.alias("slide_name"), F.element_at(kinds, (F.col("n_chars") % 5 + 1).cast("int")).alias("final_decision"), status.alias("status"))
    return reports.run_rows(runs).select("slide_name", "summary_status", "ground_truth", "predicted_label", "included_in_statistics", "is_correct")


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two targets with scores: a document's language, and its size class, which a third of them lack."""
    docs = table(spark, sf_dir, "documents")
    lang = [(F.col("n_chars") * (i + 3) % 101 + F.when(F.col("lang") == c, 40).otherwise(0)).alias(f"lang_{c}") for i, c in enumerate(_LANGS)]
    size = F.when(F.col("doc_id") % 3 != 0, F.when(F.col("n_chars") < 1000, "short").otherwise("long"))
    return docs.select("doc_id", (F.col("doc_id") % 5).alias("fold"), "lang", F.lit("").alias("pred_lang"), *lang, size.alias("size"), F.lit("").alias("pred_size"), (F.col("doc_id") % 7).alias("size_long"), (F.col("n_chars") % 7).alias("size_short"))


_CLASSES = {"lang": _LANGS, "size": ["long", "short"]}
_LONG_SQL = (
    "WITH d AS (SELECT doc_id, doc_id % 5 AS fold, lang, CASE WHEN doc_id % 3 <> 0 THEN CASE WHEN n_chars < 1000 THEN 'short' ELSE 'long' END END AS size, "
    + ", ".join(f"(n_chars * {i + 3} % 101 + CASE WHEN lang = '{c}' THEN 40 ELSE 0 END)::DOUBLE AS lang_{c}" for i, c in enumerate(_LANGS))
    + ", (doc_id % 7)::DOUBLE AS size_long, (n_chars % 7)::DOUBLE AS size_short FROM documents),"
    + """ s AS (SELECT fold, 'lang' AS target, lang AS truth, ['de', 'en', 'es', 'fr'] AS c, [lang_de, lang_en, lang_es, lang_fr] AS v FROM d WHERE lang IS NOT NULL
    UNION ALL SELECT fold, 'size', size, ['long', 'short'], [size_long, size_short] FROM d WHERE size IS NOT NULL),
l AS (SELECT fold, target, truth, c[list_position(v, list_max(v))] AS predicted, unnest(c) AS class, unnest(v) AS score FROM s),
i AS (SELECT *, (truth = class)::INTEGER AS y FROM l),
n AS (SELECT fold, target, class, sum(y)::BIGINT AS count, count(*) FILTER (predicted = class AND y = 1) AS tp, count(*) FILTER (predicted = class OR y = 1) AS u FROM i GROUP BY ALL),
g AS (SELECT fold, target, class, score, sum(y)::DOUBLE AS p, sum(1 - y)::DOUBLE AS q FROM i GROUP BY ALL),
a AS (SELECT fold, target, class, p, q, p * (coalesce(sum(q) OVER (PARTITION BY fold, target, class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2) AS won,
    p * sum(p) OVER w / sum(p + q) OVER w AS step FROM g WINDOW w AS (PARTITION BY fold, target, class ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
r AS (SELECT fold, target, class, sum(won) / nullif(sum(p) * sum(q), 0) AS auroc, sum(step) / nullif(sum(p), 0) AS ap FROM a GROUP BY ALL),
m AS (SELECT fold, target, class, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg(score) FILTER (y = 1) AS m1, avg(score) FILTER (y = 0) AS m0, var_pop(score) FILTER (y = 1) AS v1, var_pop(score) FILTER (y = 0) AS v0 FROM i GROUP BY ALL),
t AS (SELECT fold, target, class, n1 + n0 - 2 AS df, (m1 - m0) / nullif(sqrt((n1 * v1 + n0 * v0) / nullif(n1 + n0 - 2, 0) * (1.0::DOUBLE / nullif(n1, 0) + 1.0::DOUBLE / nullif(n0, 0))), 0) AS t FROM m),
c AS (SELECT n.target, n.fold, n.class, n.count, round(auroc, 6) AS roc_auc_score, round(ap, 6) AS average_precision_score, round(coalesce(2.0::DOUBLE * tp / nullif(u + tp, 0), 0), 6) AS f1_score, t, df
    FROM n JOIN r USING (fold, target, class) JOIN t USING (fold, target, class) WHERE n.count > 0)
"""
)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _wide(spark, sf_dir)
    return reports.long_predictions(wide, reports.detected_targets(wide.columns), _CLASSES, ["fold"])


@query(_LONG_SQL + f"SELECT target, fold, class, count, roc_auc_score, average_precision_score, f1_score, round({t_p_sql('t', 'df')}, 4) AS p_value FROM c")
def categorical_individual(spark, sf_dir):
    return reports.categorical_table(_long(spark, sf_dir), ["target", "fold"]).withColumn("p_value", F.round("p_value", 4))


@query(_LONG_SQL + f""", e AS (SELECT target, class, count, unnest(['roc_auc_score', 'average_precision_score', 'f1_score']) AS metric, unnest([roc_auc_score, average_precision_score, f1_score]) AS value FROM c),
f AS (SELECT target, class, metric, count(value) AS folds, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS s, sum(count)::BIGINT AS count FROM e GROUP BY ALL)
SELECT target, class, metric, folds, round(m, 8) AS mean, round(m - {T_SQL} * s, 6) AS low, round(m + {T_SQL} * s, 6) AS high, count FROM f""")
def categorical_aggregated(spark, sf_dir):
    table_ = reports.categorical_table(_long(spark, sf_dir), ["target", "fold"])
    return reports.over_folds(table_, ["target", "class"], reports.SCORES, "count")


@query(f"""WITH r AS (SELECT l_linenumber % 4 AS fold, l_extendedprice AS y, l_quantity * 1500 AS x FROM lineitem),
i AS (SELECT fold, 1 - sum((y - x) * (y - x)) / nullif(regr_syy(y, x), 0) AS r2, corr(y, x) AS pearson_r, avg(abs(y - x)) AS mae, sqrt(avg((y - x) * (y - x))) AS rmse FROM r GROUP BY fold),
e AS (SELECT unnest(['r2', 'pearson_r', 'mae', 'rmse']) AS metric, unnest([round(r2, 6), round(pearson_r, 6), round(mae, 6), round(rmse, 6)]) AS v FROM i),
f AS (SELECT metric, count(v) AS folds, avg(v) AS m, stddev_samp(v) / sqrt(count(v)) AS s FROM e GROUP BY metric)
SELECT metric, folds, round(m, 8) AS mean, round(m - {T_SQL} * s, 6) AS low, round(m + {T_SQL} * s, 6) AS high FROM f""")
def regression_aggregated(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 4).alias("fold"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("x"))
    return reports.over_folds(metrics.regression(rows, ["fold"], "y", "x"), [], ["r2", "pearson_r", "mae", "rmse"])


@query("""WITH d AS (SELECT doc_id % 4 AS fold, quality::DOUBLE AS y, toxic::DOUBLE AS x FROM labels), s AS (SELECT fold, count(*) AS n, CASE WHEN var_pop(y) > 0 AND var_pop(x) > 0 THEN corr(y, x) END AS r FROM d GROUP BY fold),
t AS (SELECT fold, n - 2 AS df, r * sqrt(n - 2) / sqrt(1 - r * r) AS t, r FROM s)
SELECT fold, round(r, 6) AS pearson_r, round(""" + t_p_sql("t", "df") + """, 5) AS pearson_p FROM t""")
def correlation_p(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 4).alias("fold"), F.col("quality").cast("double").alias("y"), F.col("toxic").cast("double").alias("x"))
    return metrics.regression(rows, ["fold"], "y", "x").select("fold", "pearson_r", F.round("pearson_p", 5).alias("pearson_p"))


_SURVIVAL_TABLE = _SURVIVAL + """, v AS (SELECT o_orderpriority AS g, time, event, risk FROM x WHERE o_orderkey % 17 <> 0),
c AS (SELECT g, quantile_cont(risk, 0.5) AS threshold, count(*) AS count, sum(event)::BIGINT AS events, count(*) FILTER (event = 0) AS censored FROM v GROUP BY g),
p AS (SELECT a.g, count(*) AS comparable_pairs, round(avg(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0.0 END), 6) AS c_index FROM v a JOIN v b ON a.g = b.g AND a.time < b.time WHERE a.event = 1 GROUP BY a.g)
SELECT c.g, count, events, censored, comparable_pairs, c_index, round(threshold, 6) AS threshold FROM c JOIN p USING (g)"""


@query(_SURVIVAL_TABLE)
def survival_statistics(spark, sf_dir):
    """Every seventeenth order has no status and is left out."""
    rows = _survival(spark, sf_dir).select(F.col("o_orderpriority").alias("g"), "time", F.when(F.col("o_orderkey") % 17 != 0, F.col("event")).alias("event"), "risk")
    return reports.survival_table(rows, ["g"], "time", "event", "risk").drop("logrank_p")


@query("""WITH r AS (SELECT c_custkey AS patient, CASE WHEN c_custkey % 7 = 0 THEN '--' WHEN c_custkey % 5 = 0 THEN 'NA' ELSE CAST(c_nationkey AS VARCHAR) END AS t, ['dead', ' Alive', '1', '0.0', '2', NULL][c_custkey % 6 + 1] AS s FROM customer)
SELECT patient, t::DOUBLE AS time, CASE s WHEN 'dead' THEN 1 WHEN ' Alive' THEN 0 WHEN '1' THEN 1 WHEN '0.0' THEN 0 WHEN '2' THEN 1 END::INTEGER AS event FROM r WHERE t NOT IN ('--', 'NA')""")
def survival_reader(spark, sf_dir):
    words = F.array(*map(F.lit, ("dead", " Alive", "1", "0.0", "2")), F.lit(None))
    time = F.when(F.col("c_custkey") % 7 == 0, "--").when(F.col("c_custkey") % 5 == 0, "NA").otherwise(F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient"), time.alias("t"), F.element_at(words, (F.col("c_custkey") % 6 + 1).cast("int")).alias("s"))
    return clinical.survival_rows(rows, "patient", "t", "s")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'P') AS error, count(*) FILTER (o_orderstatus = 'O') AS skip, count(*) AS total FROM orders GROUP BY o_orderpriority")
def status_tally(spark, sf_dir):
    word = F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "error").when(F.col("o_orderstatus") == "O", "skip")
    return reports.status_tally(table(spark, sf_dir, "orders").select("o_orderpriority", word.alias("s")), ["o_orderpriority"], "s")


@query("""WITH n AS (SELECT l_returnflag, l_orderkey, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, count(*) AS bags, sum(n)::BIGINT AS rows, min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most FROM n GROUP BY l_returnflag""")
def bag_summary(spark, sf_dir):
    return reports.bag_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey")


@query("""SELECT p_brand, count(*) AS n_in, count(*) FILTER (p_size >= 25) AS n_selected, round(count(*) FILTER (p_size >= 25) / count(*)::DOUBLE, 6) AS fraction, round(avg(p_retailprice), 6) AS mean_p_retailprice,
round(avg(p_retailprice) FILTER (p_size >= 25), 6) AS mean_p_retailprice_selected FROM part GROUP BY p_brand""")
def filter_statistics(spark, sf_dir):
    return reports.filter_statistics(table(spark, sf_dir, "part"), ["p_brand"], F.col("p_size") >= 25, ["p_retailprice"])


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 150000)""")
def pending_work(spark, sf_dir):
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderstatus") == "F", "ok").alias("status"), F.col("o_totalprice").alias("rois"))
    return reports.pending(table(spark, sf_dir, "customer").select("c_custkey"), done.filter("rois >= 150000"), ["c_custkey"])


@query("SELECT conv_id, turn FROM conversations WHERE turn % 3 >= 1 AND trim(text) <> '' AND NOT contains(lower(text), 'unavailable') AND role <> 'user'")
def run_quality_gate(spark, sf_dir):
    said = F.when(F.col("role") != "user", F.col("text"))
    runs = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") % 3).alias("roi_count"), said.alias("final_decision"))
    return reports.good_runs(runs).select("conv_id", "turn")


@query("""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'system' ELSE role END AS role, text FROM conversations),
s AS (SELECT conv_id, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) AS content FROM m WHERE role = 'system' AND trim(text) <> '' GROUP BY conv_id),
r AS (SELECT conv_id, role, text AS content, turn + 1 AS o FROM m WHERE role <> 'system' UNION ALL SELECT conv_id, 'system', content, -1 FROM s)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY o) - 1)::INTEGER AS position, role, content FROM r""")
def system_messages_first(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 4 == 1, "system").otherwise(F.col("role")))
    return reports.messages(turns, ["conv_id"], "turn", "role", "text").select("conv_id", F.posexplode("messages").alias("position", "m")).select("conv_id", "position", "m.role", "m.content")


# Clinical joins -----------------------------------------------------------------------------


@query(_PATIENTS + """, l AS (SELECT patient, label FROM p WHERE label IS NOT NULL AND patient % 3 <> 0)
SELECT h.patient, label, n_slides FROM (SELECT patient, count(DISTINCT slide) AS n_slides FROM s WHERE slide % 5 <> 0 GROUP BY patient) h LEFT JOIN l ON h.patient = l.patient""")
def with_unlabelled(spark, sf_dir):
    labels = assembly.labelled(_patients(spark, sf_dir).filter("patient % 3 <> 0"), ["label"]).select("patient", "label")
    slides = _slides(spark, sf_dir)
    kept = clinical.with_unlabelled(labels, slides, slides.select("slide").filter("slide % 5 <> 0"), "patient", "slide")
    return kept.select("patient", "label", F.size("slides").cast("long").alias("n_slides"))


@query(_PATIENTS + "SELECT CAST(patient AS VARCHAR) AS patient, label, 'features/' || patient || '.h5' AS feature_file FROM p WHERE label IS NOT NULL AND patient IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def patient_level_features(spark, sf_dir):
    labels = assembly.labelled(_patients(spark, sf_dir), ["label"]).select(F.col("patient").cast("string").alias("patient"), "label")
    suffix = F.when(F.col("c_acctbal") > 0, ".h5").otherwise(".csv")
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("features/"), F.col("c_custkey").cast("string"), suffix).alias("file"))
    return clinical.patient_level(labels, files, "patient", "file")


@query("""WITH r AS (SELECT c_custkey AS run, CASE WHEN c_custkey % 3 = 0 THEN 'running' ELSE 'done' END AS status FROM customer),
a AS (SELECT o_custkey AS run, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0 GROUP BY 1), b AS (SELECT o_custkey AS run, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT r.run, status, len(CASE WHEN a.v IS NOT NULL THEN a.v WHEN status = 'done' THEN b.v END)::INTEGER AS n, (CASE WHEN a.v IS NOT NULL THEN a.v WHEN status = 'done' THEN b.v END)[1] AS first_roi FROM r LEFT JOIN a USING (run) LEFT JOIN b USING (run)""")
def live_else_saved(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), "o_orderkey", "o_orderstatus")
    listed = lambda rows: rows.groupBy("run").agg(F.array_sort(F.collect_list("o_orderkey")).alias("rois"))
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), F.when(F.col("c_custkey") % 3 == 0, "running").otherwise("done").alias("status"))
    shown = clinical.overlay(runs, listed(orders.filter("o_orderstatus = 'F' AND o_orderkey % 4 = 0")), listed(orders.filter("o_orderstatus <> 'F'")), "run", "rois")
    return shown.select("run", "status", F.when(F.col("rois").isNotNull(), F.size("rois")).alias("n"), F.try_element_at("rois", F.lit(1)).alias("first_roi"))


@query("""WITH m AS (SELECT p_brand AS model, min(p_partkey) AS o FROM part WHERE p_brand <> 'Brand#1' GROUP BY 1), e AS (SELECT n_name AS extractor, min(n_nationkey) AS o FROM nation WHERE n_regionkey IN (0, 2) GROUP BY 1)
SELECT model, extractor, row_number() OVER (ORDER BY m.o, e.o)::INTEGER AS number FROM m, e""")
def experiment_matrix(spark, sf_dir):
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), F.col("p_partkey").alias("o"))
    models = [r[0] for r in brands.select("model").distinct().filter("model <> 'Brand#1'").collect()]  # a name a brand
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("extractor"), F.col("n_nationkey").alias("o"), "n_regionkey")
    return clinical.experiment_matrix(brands, nations.filter("n_regionkey IN (0, 2)"), models, [], "o")


@query("""WITH f AS (SELECT o_orderkey, o_custkey % 4 AS k, CASE o_orderkey % 4 WHEN 0 THEN 512 WHEN 1 THEN NULL WHEN 2 THEN 224 END AS ts, CASE WHEN o_orderkey % 4 = 0 THEN 'um' END AS unit, CASE WHEN o_orderkey % 4 = 1 THEN 256.0 END AS um FROM orders)
SELECT o_orderkey, CASE WHEN ts IS NOT NULL AND unit = 'um' THEN 'unit' WHEN um IS NOT NULL THEN 'micrometres' ELSE 'historic' END AS dialect, CASE WHEN unit = 'um' THEN 512.0 ELSE 256.0 END::DOUBLE AS tile_size_um,
CASE WHEN o_orderkey % 4 <= 1 THEN NULL ELSE 224 END::INTEGER AS tile_size_px, round(CASE WHEN o_orderkey % 4 <= 1 THEN 1.0 ELSE 256.0 / 224 END::DOUBLE, 6) AS scale FROM f""")
def coordinate_dialects(spark, sf_dir):
    """Files of four dialects: a size with a unit, one in micrometres, the old size, and only an old stride."""
    k = F.col("o_orderkey") % 4
    attributes = {"tile_size": F.when(k == 0, 512).when(k == 2, 224), "unit": F.when(k == 0, "um"), "tile_size_um": F.when(k == 1, 256.0), "tile_size_px": F.lit(None)}
    files = table(spark, sf_dir, "orders").select("o_orderkey", clinical.coordinate_attributes(attributes, F.lit(224.2)).alias("c"))
    return files.select("o_orderkey", "c.dialect", "c.tile_size_um", "c.tile_size_px", F.round("c.scale", 6).alias("scale"))


@query("""WITH c AS (SELECT l_suppkey % 20 AS slide, l_partkey * 13 % 977 * 0.5 AS x, l_orderkey * 7 % 991 * 3 AS y FROM lineitem), v AS (SELECT DISTINCT slide, 'x' AS a, x AS v FROM c UNION SELECT DISTINCT slide, 'y', y FROM c),
d AS (SELECT slide, v - lag(v) OVER (PARTITION BY slide, a ORDER BY v) AS d FROM v) SELECT slide, min(d)::DOUBLE AS stride FROM d GROUP BY slide""")
def least_stride(spark, sf_dir):
    tiles = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("slide"), (F.col("l_partkey") * 13 % 977 * 0.5).alias("x"), (F.col("l_orderkey") * 7 % 991 * 3).alias("y"))
    return clinical.min_stride(tiles, ["slide"])


@query("SELECT c_nationkey, CASE WHEN c_nationkey % 2 = 0 THEN 'tile' ELSE 'patient' END AS feat_type FROM customer GROUP BY c_nationkey")
def feature_types(spark, sf_dir):
    """Folders of patient features, of tile features, and of old tile features without a type."""
    kind = F.when(F.col("c_nationkey") % 2 == 1, "patient").when(F.col("c_custkey") % 2 == 0, "tile")
    files = table(spark, sf_dir, "customer").select("c_nationkey", kind.alias("feat_type"), F.when(F.col("c_nationkey") % 2 == 1, "enc").alias("encoder"))
    return clinical.feature_type(files, ["c_nationkey"])


@query("""WITH t AS (SELECT l_suppkey AS patient, l_linenumber AS slide, l_orderkey * 31 % 1000 * 2.0 AS x FROM lineitem), w AS (SELECT patient, slide, max(x + 256) AS w FROM t GROUP BY ALL),
o AS (SELECT patient, slide, coalesce(sum(w) OVER (PARTITION BY patient ORDER BY slide ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM w)
SELECT t.patient, t.slide, sum(t.x + o)::DOUBLE AS total, max(t.x + o)::DOUBLE AS right_end, count(*) AS n FROM t JOIN o USING (patient, slide) GROUP BY ALL""")
def virtual_slides(spark, sf_dir):
    tiles = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("patient"), F.col("l_linenumber").alias("slide"), (F.col("l_orderkey") * 31 % 1000 * 2.0).alias("x"), F.lit(256.0).alias("size"))
    moved = clinical.virtual_slide(tiles, "patient", "slide", "x", "size")
    return moved.groupBy("patient", "slide").agg(F.sum("x_all").alias("total"), F.max("x_all").alias("right_end"), F.count("*").alias("n"))


@query("""WITH RECURSIVE m AS (SELECT conv_id, turn, length(text) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE length(text) BETWEEN 1 AND 600),
g(conv_id, i, used, taken) AS (SELECT DISTINCT conv_id, 0::BIGINT, 0::BIGINT, CAST([] AS BIGINT[]) FROM m UNION ALL
SELECT g.conv_id, g.i + 1, CASE WHEN len(taken) < 3 AND used + m.s <= 600 THEN used + m.s ELSE used END, CASE WHEN len(taken) < 3 AND used + m.s <= 600 THEN list_append(taken, m.turn) ELSE taken END FROM g JOIN m ON m.conv_id = g.conv_id AND m.i = g.i + 1),
l AS (SELECT conv_id, arg_max(taken, i) AS taken FROM g GROUP BY conv_id) SELECT conv_id, unnest(range(len(taken)))::INTEGER AS taken, unnest(taken) AS turn FROM l""")
def image_budget(spark, sf_dir):
    """Turns of a conversation that fit into three places and 600 characters."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return clinical.budget_take(turns, ["conv_id"], "turn", "turn", "size", 3, 600)


@query("""WITH r AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id * 37 % 101 DESC, vec_id) AS r FROM embeddings)
SELECT label, p::INTEGER AS position, round(avg(embedding[p + 1]::DOUBLE), 6) AS value FROM r, (SELECT unnest(range(64)) AS p) WHERE r <= 25 GROUP BY label, p""")
def attention_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").withColumn("attention", F.col("vec_id") * 37 % 101)
    return clinical.attention_mean(rows, ["label"], "vec_id", "attention", "embedding")


@query("""WITH h AS (SELECT source, least(n_chars // 64, 255) AS b, count(*) AS n FROM documents GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY b) AS c, sum(n) OVER (PARTITION BY source) AS a FROM h)
SELECT source, min(b) FILTER (c >= a * 0.85) AS bin FROM c GROUP BY source""")
def histogram_percentile(spark, sf_dir):
    bins = table(spark, sf_dir, "documents").groupBy("source", F.least(F.floor(F.col("n_chars") / 64), F.lit(255)).alias("b")).agg(F.count("*").alias("n"))
    return clinical.histogram_percentile(bins, ["source"], "b", "n", 85.0)


@query("""WITH d AS (SELECT o_orderstatus, ('0x' || substr(sha256(o_orderkey || ':' || o_orderpriority), 1, 15))::HUGEINT AS h FROM orders)
SELECT o_orderstatus, substr(sha256(sum(h)::VARCHAR || '|' || count(*)::VARCHAR), 1, 16) AS fingerprint FROM d GROUP BY o_orderstatus""")
def table_fingerprint(spark, sf_dir):
    return clinical.fingerprint(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey", "o_orderpriority"])


@query("""WITH f AS (SELECT o_custkey, o_orderkey, 'a' || repeat('/b', (o_orderkey % 3)::INTEGER) || '/s' || o_orderkey || ['.mrxs', '.svs', '.txt'][o_orderkey % 3 + 1] AS path, o_orderkey % 2 = 0 AS sib FROM orders)
SELECT o_custkey, path FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN path LIKE '%.mrxs' THEN 0 WHEN path LIKE '%.svs' THEN 1 ELSE 2 END, NOT sib, len(string_split(path, '/')), length(path), path) AS r FROM f) WHERE r = 1""")
def primary_slide(spark, sf_dir):
    k = (F.col("o_orderkey") % 3).cast("int")
    path = F.concat(F.lit("a"), F.expr("repeat('/b', CAST(o_orderkey % 3 AS INT))"), F.lit("/s"), F.col("o_orderkey").cast("string"), F.element_at(F.array(*map(F.lit, (".mrxs", ".svs", ".txt"))), k + 1))
    files = table(spark, sf_dir, "orders").select("o_custkey", path.alias("path"), (F.col("o_orderkey") % 2 == 0).alias("has_sibling_dir"))
    return clinical.best_file(files, ["o_custkey"], "path", [".mrxs", ".svs"])


@query("""WITH p AS (SELECT l_returnflag AS model, l_orderkey * 10 + l_linenumber AS patient, CASE WHEN l_linenumber <> 5 THEN abs(l_extendedprice - l_quantity * 1500) END AS loss FROM lineitem)
SELECT model, patient, round(loss, 4) AS loss, row_number() OVER (PARTITION BY model ORDER BY loss NULLS LAST, patient) AS place FROM p""")
def loss_sorted_predictions(spark, sf_dir):
    truth = F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice").cast("string")).otherwise("nan")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("patient"), clinical.absolute_loss(truth, F.col("l_quantity") * 1500).alias("loss"))
    return clinical.prediction_table(rows, ["model"]).select("model", "patient", F.round("loss", 4).alias("loss"), F.col("place").cast("long").alias("place"))


@query("SELECT vec_id, unnest(range(70))::INTEGER AS position, round(unnest(list_concat(embedding, list_transform(range(6), lambda i: 0.0::FLOAT)))::DOUBLE, 6) AS value FROM embeddings")
def padded_bag(spark, sf_dir):
    v = clinical.padded(F.col("embedding"), 70, F.lit(0.0).cast("float"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(v).alias("position", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_quantity >= 45 UNION SELECT p_partkey FROM part WHERE p_size = 1")
def unique_indices(spark, sf_dir):
    """The union of two selections, each index once."""
    big = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45").select("l_partkey")
    return big.unionByName(table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))).distinct().orderBy("l_partkey")


@query("SELECT user_id, event_id, (n >= 6 OR s >= 1) AS over_budget, CASE WHEN s >= 5 THEN 2 WHEN s >= 3 THEN 1 ELSE 0 END::INTEGER AS warning FROM (SELECT user_id, event_id, count(*) FILTER (event_type = 'click') OVER w AS n, count(*) FILTER (event_type = 'purchase') OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))")
def step_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    for event, to in (("click", "n"), ("purchase", "s")):
        rows = steps.lookback_count(rows, "user_id", ["ts", "event_id"], F.col("event_type") == event, to)
    return steps.budget(rows, "n", "s").select("user_id", "event_id", "over_budget", "warning")


# Selections ---------------------------------------------------------------------------------

_CELLS = _GRID + """, c AS (SELECT slide, (x0 // 512)::INTEGER AS gx, (y0 // 512)::INTEGER AS gy, (slide * 7 + x0 * 13 + y0 * 29) % 1009 AS score, count(*) OVER (PARTITION BY slide) AS n FROM t),
k AS (SELECT *, least(greatest(4, ceil(n * 0.22)), 56, n)::INTEGER AS keep FROM c)
"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    # counted before the cells are made: Spark takes an exploded table for as small as what it comes from and would broadcast it in a join
    n = F.sum(tiling.cell_count(F.col("width"), F.col("height"), 512)).over(Window.partitionBy("slide"))
    cells = tiling.supertiles(_parts(spark, sf_dir).withColumn("n", n), "width", "height", 512)
    scored = cells.select("slide", F.floor(F.col("x0") / 512).cast("int").alias("gx"), F.floor(F.col("y0") / 512).cast("int").alias("gy"), ((F.col("slide") * 7 + F.col("x0") * 13 + F.col("y0") * 29) % 1009).alias("score"), "n")
    return scored.withColumn("keep", F.least(tiling.keep_count(F.col("n"), 0.22, 4, 56), F.col("n")).cast("int"))


@query("WITH RECURSIVE" + _CELLS.removeprefix("WITH").rstrip() + """, o AS (SELECT *, row_number() OVER (PARTITION BY slide ORDER BY score DESC, gy, gx) AS i FROM k),
rec(slide, i, taken) AS (SELECT DISTINCT slide, 0::BIGINT, CAST([] AS STRUCT(x INTEGER, y INTEGER)[]) FROM o UNION ALL
SELECT rec.slide, rec.i + 1, CASE WHEN len(taken) < o.keep AND len(list_filter(taken, lambda t: greatest(abs(t.x - o.gx), abs(t.y - o.gy)) < CASE WHEN o.n > 2 * o.keep THEN 2 ELSE 1 END)) = 0
    THEN list_append(taken, CAST({'x': o.gx, 'y': o.gy} AS STRUCT(x INTEGER, y INTEGER))) ELSE taken END FROM rec JOIN o ON o.slide = rec.slide AND o.i = rec.i + 1),
l AS (SELECT slide, arg_max(taken, i) AS taken FROM rec GROUP BY slide), sel AS (SELECT slide, unnest(taken).x AS gx, unnest(taken).y AS gy FROM l),
b AS (SELECT o.slide, gx, gy, row_number() OVER (PARTITION BY o.slide ORDER BY i) AS r, keep - len(taken) AS room FROM o JOIN l ON o.slide = l.slide WHERE NOT EXISTS (SELECT 1 FROM sel WHERE sel.slide = o.slide AND sel.gx = o.gx AND sel.gy = o.gy))
SELECT slide, gx, gy FROM sel UNION ALL SELECT slide, gx, gy FROM b WHERE r <= room""")
def supertile_selection(spark, sf_dir):
    return selection.separated(_cells(spark, sf_dir), ["slide"], "score", "keep").select("slide", "gx", "gy")


@query(_CELLS + "SELECT slide, n, least(greatest(4, ceil(n * 0.22)), 56)::BIGINT AS ratio_keep, greatest(least(n, greatest(12, CASE WHEN n > 48 THEN ceil(n * 0.18) ELSE 0 END, ceil(greatest(slide % 40, 1) * 1.5))), 1)::INTEGER AS dark_keep FROM (SELECT DISTINCT slide, n FROM k)")
def supertile_keep_counts(spark, sf_dir):
    n = _cells(spark, sf_dir).groupBy("slide").agg(F.count("*").alias("n"))
    return n.select("slide", "n", tiling.keep_count(F.col("n"), 0.22, 4, 56).alias("ratio_keep"), selection.dark_keep_count(F.col("n"), F.col("slide") % 40).alias("dark_keep"))


@query(_CELLS + "SELECT slide, gx, gy, round(0.52 * (score % 101) / 100.0::DOUBLE + 0.24 * (score % 7) / 6.0::DOUBLE + 0.24 * (score % 5) / 4.0::DOUBLE, 6) AS priority FROM k")
def supertile_priority(spark, sf_dir):
    part = lambda n: F.col("score") % n / float(n - 1)
    return _cells(spark, sf_dir).select("slide", "gx", "gy", F.round(tiling.priority(part(101), part(7), part(5)), 6).alias("priority"))


@query("""WITH p AS (SELECT p_brand, p_partkey, p_size, count(*) OVER (PARTITION BY p_brand) AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part),
c AS (SELECT *, least(greatest(2, ceil(n * 0.25)), n) AS top FROM p), d AS (SELECT *, row_number() OVER (PARTITION BY p_brand, r > top ORDER BY md5('0:' || p_partkey), p_partkey) AS d FROM c)
SELECT p_brand, p_partkey, CASE WHEN n <= 8 THEN 'all' WHEN r <= top THEN 'top' ELSE 'reserve' END AS kept_as FROM d WHERE n <= 8 OR r <= top OR d <= least(ceil(n * 0.05), n - top)""")
def quality_keep(spark, sf_dir):
    """The best of each brand's parts and a reserve of the others by hash."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    return selection.keep_with_reserve(parts, ["p_brand"], "p_size", "p_partkey", 0.25, 2, 0.05, 8).select("p_brand", "p_partkey", "kept_as")


_SCALED = "CASE WHEN h_{0} <= l_{0} THEN 0.5 ELSE least(greatest(({0} - l_{0}) / greatest(h_{0} - l_{0}, 1e-6), 0), 1) END"


@query("""WITH t AS (SELECT p_brand AS slide, p_partkey AS id, (p_size * 13 % 97)::DOUBLE AS screen, p_retailprice AS focus, (p_partkey % 31)::DOUBLE AS ent, (p_partkey * 7 % 53)::DOUBLE AS hm FROM part),
f AS (SELECT *, quantile_cont(screen, 0.1) OVER (PARTITION BY slide) AS fl, count(*) OVER (PARTITION BY slide) AS a FROM t), u AS (SELECT *, screen >= fl AS up FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY slide, up ORDER BY screen DESC, id) AS r, row_number() OVER (PARTITION BY slide, up ORDER BY md5('0:' || id), id) AS d, count(*) OVER (PARTITION BY slide, up) AS n FROM u),
s AS (SELECT * FROM k WHERE CASE WHEN up THEN r <= greatest(ceil(n * 0.3), 1) ELSE d <= ceil(a * 0.05) END),
q AS (SELECT *, """ + ", ".join(f"quantile_cont({c}, 0.05) OVER w AS l_{c}, quantile_cont({c}, 0.95) OVER w AS h_{c}" for c in ("screen", "focus", "ent", "hm")) + """ FROM s WINDOW w AS (PARTITION BY slide)),
x AS (SELECT slide, id, round(least(greatest(0.70 * """ + _SCALED.format("screen") + " + 0.30 * (0.50 * " + _SCALED.format("focus") + " + 0.20 * " + _SCALED.format("ent") + " + 0.30 * " + _SCALED.format("hm") + """), 0), 1), 6) AS score FROM q)
SELECT *, row_number() OVER (PARTITION BY slide ORDER BY score DESC, id)::INTEGER AS rank FROM x""")
def tile_prefilter(spark, sf_dir):
    """The best of what a screening keeps, with a reserve of what it drops."""
    part = table(spark, sf_dir, "part")
    tiles = part.select(F.col("p_brand").alias("slide"), F.col("p_partkey").alias("id"), (F.col("p_size") * 13 % 97).cast("double").alias("screen"), F.col("p_retailprice").alias("focus"), (F.col("p_partkey") % 31).cast("double").alias("entropy"), (F.col("p_partkey") * 7 % 53).cast("double").alias("h_mean"))
    kept = selection.prefilter(tiles, ["slide"], "screen", "id", {"focus": 0.50, "entropy": 0.20, "h_mean": 0.30}, reserve=0.05)
    return kept.select("slide", "id", "score", "rank")


@query("""SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('0:' || c_custkey), c_custkey) <= ceil(count(*) OVER (PARTITION BY c_mktsegment) * 0.25) THEN 'valid' ELSE 'train' END AS part FROM customer""")
def stratified_split(spark, sf_dir):
    return clinical.stratified_split(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey").select("c_custkey", "part")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r FROM orders) WHERE n >= 5 AND r <= 5""")
def seeded_image_sample(spark, sf_dir):
    """Five orders of each customer who has so many."""
    return clinical.seeded_sample(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", 5)


@query(_CANDIDATES + ", b AS (SELECT slide, id, cx, cy FROM q) SELECT slide, id, (cx BETWEEN 100 AND 2100 AND cy BETWEEN 100 AND 1100) OR (cx BETWEEN 5000 AND 6000 AND cy BETWEEN 0 AND 4000) AS inside FROM b")
def candidates_in_boxes(spark, sf_dir):
    boxes = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip("xywh", box)]) for box in ((100, 100, 2000, 1000), (5000, 0, 1000, 4000))])
    return _candidates(spark, sf_dir).select("slide", "id", ranking.inside_any(F.col("cx"), F.col("cy"), boxes).alias("inside"))


@query(_CANDIDATES + ", b AS (SELECT slide, id, slide % 2 = 0 AND id % 9 = 0 AS m FROM q), a AS (SELECT *, bool_or(m) OVER (PARTITION BY slide) AS a FROM b) SELECT slide, id FROM a WHERE NOT a OR m")
def candidate_mask(spark, sf_dir):
    marked = _candidates(spark, sf_dir).withColumn("m", (F.col("slide") % 2 == 0) & (F.col("id") % 9 == 0))
    return ranking.masked(marked, ["slide"], "m").select("slide", "id")


@query(_KNN.split(", m AS")[0] + ", ev AS (SELECT id, CASE WHEN good THEN 'good' ELSE 'bad' END AS class, ref, sim, rn FROM k WHERE rn <= 3) SELECT id, class, rn::INTEGER AS rank, ref, round(sim, 6) AS sim FROM ev")
def reference_evidence(spark, sf_dir):
    tiles = _tiles(spark, sf_dir)
    refs = _references(tiles)
    kinds = refs.select(F.col("id").alias("ref"), F.when(F.col("good"), "good").otherwise("bad").alias("class"))
    near = vectors.nearest(tiles, refs.filter("good"), 3).unionByName(vectors.nearest(tiles, refs.filter("NOT good"), 3)).select("id", "ref", "sim")
    attached = ranking.evidence(near, kinds, [])
    return attached.select("id", "class", F.explode("refs").alias("r")).select("id", "class", "r.rank", "r.ref", F.round("r.sim", 6).alias("sim"))


@query(_KNN.split(", s AS")[0] + """, s AS (SELECT r.id AS ref, q.id AS tile, round(list_dot_product(q.u, r.u), 12) AS sim FROM u q, u r WHERE r.id % 10 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY sim DESC, tile) AS rn FROM s), t AS (SELECT * FROM k WHERE rn <= 20), n AS (SELECT *, count(*) OVER (PARTITION BY tile) AS n, row_number() OVER (PARTITION BY tile ORDER BY sim DESC, ref) AS rank FROM t)
SELECT tile, n, rank::INTEGER AS rank, ref, round(sim, 6) AS sim FROM n WHERE rank <= 3""")
def reference_nominations(spark, sf_dir):
    tiles = _tiles(spark, sf_dir)
    near = vectors.nearest(_references(tiles), tiles, 20).select(F.col("id").alias("ref"), F.col("ref").alias("tile"), "sim")
    return ranking.nominated(near, 3).select("tile", "n", F.explode("refs").alias("r")).select("tile", "n", "r.rank", "r.ref", F.round("r.sim", 6).alias("sim"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, (l_partkey * 17 % 9000)::DOUBLE AS cx, (l_suppkey * 23 % 4000)::DOUBLE AS cy FROM lineitem),
s AS (SELECT *, least(greatest(round_even((cx - 500) / 8000.0::DOUBLE * 999, 0), 0), 999)::INTEGER AS x, least(greatest(round_even((cy - 300) / 3000.0::DOUBLE * 999, 0), 0), 999)::INTEGER AS y FROM v)
SELECT l_orderkey, l_linenumber, x, y, greatest(x - 14, 0)::INTEGER AS x0, greatest(y - 37, 0)::INTEGER AS y0, least(x + 14, 999)::INTEGER AS x1, least(y + 37, 999)::INTEGER AS y1 FROM s""")
def view_coordinates(spark, sf_dir):
    at = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 17 % 9000).cast("double").alias("cx"), (F.col("l_suppkey") * 23 % 4000).cast("double").alias("cy"))
    return at.select("l_orderkey", "l_linenumber", ranking.view_box(F.col("cx"), F.col("cy"), F.lit(224), (500, 300, 8000, 3000)).alias("b")).select("l_orderkey", "l_linenumber", "b.*")


@query("""WITH c AS (SELECT p_partkey, p_size * 100 + 700 AS w, p_size * 70 + 700 AS h, (p_partkey * 31 % (p_size * 100 + 700)) + 0.5 AS cx, (p_partkey * 17 % (p_size * 70 + 700)) + 0.25 AS cy, 0.4 + p_size / 40.0 AS mpp FROM part),
s AS (SELECT *, greatest(round_even(150 / mpp, 0), 1)::BIGINT AS s FROM c), o AS (SELECT *, greatest(least(round_even(cx, 0) - s // 2, w - s), 0)::BIGINT AS x, greatest(least(round_even(cy, 0) - s // 2, h - s), 0)::BIGINT AS y, greatest(s, 240) AS g FROM s)
SELECT p_partkey, CASE WHEN g = s THEN x ELSE greatest(least(x + s // 2 - g // 2, w - g), 0) END::BIGINT AS x, CASE WHEN g = s THEN y ELSE greatest(least(y + s // 2 - g // 2, h - g), 0) END::BIGINT AS y, g AS w, g AS h, g <> s AS enlarged FROM o""")
def candidate_fields(spark, sf_dir):
    w, h = F.col("p_size") * 100 + 700, F.col("p_size") * 70 + 700
    field = selection.candidate_field(F.col("p_partkey") * 31 % w + 0.5, F.col("p_partkey") * 17 % h + 0.25, 150.0, 0.4 + F.col("p_size") / 40.0, F.lit(240), w, h)
    return table(spark, sf_dir, "part").select("p_partkey", field.alias("f")).select("p_partkey", "f.*")


@query("""WITH b AS (SELECT p_partkey, p_size * 100 + 700 AS w, p_size * 70 + 700 AS h, p_partkey * 3 % 1100 - 50 AS a, p_partkey * 5 % 999 AS c, p_partkey * 7 % 999 AS d, p_partkey * 11 % 1100 AS e FROM part),
u AS (SELECT *, least(greatest(least(a, d), 0), 999) / 999.0::DOUBLE AS xl, least(greatest(greatest(a, d), 0), 999) / 999.0::DOUBLE AS xh, least(greatest(least(c, e), 0), 999) / 999.0::DOUBLE AS yl, least(greatest(greatest(c, e), 0), 999) / 999.0::DOUBLE AS yh FROM b),
p AS (SELECT *, 10 + round_even(xl * 600, 0) AS x0, 10 + round_even(xh * 600, 0) AS x1, 20 + round_even(yl * 500, 0) AS y0, 20 + round_even(yh * 500, 0) AS y1 FROM u),
m AS (SELECT *, x0 + floor(greatest(x1 - x0, 1) / 2) AS mx, y0 + floor(greatest(y1 - y0, 1) / 2) AS my FROM p)
SELECT p_partkey, greatest(least(greatest(least(mx - 150, x0), x1 - 300), w - 300), 0)::BIGINT AS x, greatest(least(greatest(least(my - 150, y0), y1 - 300), h - 300), 0)::BIGINT AS y FROM m""")
def region_crops(spark, sf_dir):
    k = F.col("p_partkey")
    crop = selection.region_crop((k * 3 % 1100 - 50, k * 5 % 999, k * 7 % 999, k * 11 % 1100), (F.lit(10), F.lit(20), F.lit(600), F.lit(500)), F.lit(300), F.col("p_size") * 100 + 700, F.col("p_size") * 70 + 700)
    return table(spark, sf_dir, "part").select("p_partkey", crop.alias("c")).select("p_partkey", "c.x", "c.y")


@query("""WITH t AS (SELECT l_suppkey AS slide, l_orderkey * 13 % 4096 AS x, l_partkey * 7 % 4096 AS y, l_quantity > 25 AS k FROM lineitem) SELECT slide, x // 256 AS gx, y // 256 AS gy, bool_or(k) AS included FROM t GROUP BY ALL""")
def inclusion_map(spark, sf_dir):
    tiles = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("slide"), (F.col("l_orderkey") * 13 % 4096).alias("x"), (F.col("l_partkey") * 7 % 4096).alias("y"), (F.col("l_quantity") > 25).alias("k"))
    return selection.inclusion_map(tiles, "slide", "x", "y", 256, "k")


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice / 224.0::DOUBLE, 0)::BIGINT AS gx, round_even(l_quantity * 100 / 224.0::DOUBLE, 0)::BIGINT AS gy FROM lineitem")
def grid_coordinates(spark, sf_dir):
    place = selection.grid_place(F.col("l_extendedprice"), F.col("l_quantity") * 100, F.lit(224.0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", place.alias("g")).select("l_orderkey", "l_linenumber", "g.*")


@query("""WITH e AS (SELECT label AS slide, vec_id, embedding[1:4]::DOUBLE[] AS s, list_transform(embedding[5:8], lambda x: abs(x)::DOUBLE) AS a FROM embeddings),
w AS (SELECT slide, vec_id, s[1] - list_max(s[2:4]) AS support, s[1] = list_max(s) AS leads, a[1] AS m1, list_max(a[2:4]) AS o, list_max(a) AS m FROM e), t AS (SELECT *, max(m) OVER (PARTITION BY slide) AS mm, max(o) OVER (PARTITION BY slide) AS mo FROM w),
h AS (SELECT slide, vec_id, support, CASE WHEN leads THEN m1 / mm ELSE o / mo END AS w FROM t)
SELECT slide, vec_id, round(support, 6) AS support, round(support * (w / max(w) OVER (PARTITION BY slide)), 6) AS score FROM h""")
def weighted_class_support(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("slide"), "vec_id", F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double")).alias("s"), F.transform(F.slice("embedding", 5, 4), lambda x: F.abs(x).cast("double")).alias("a"))
    return selection.weighted_support(rows, ["slide"], "vec_id", "s", "a", 0)


@query(_GRID + "SELECT slide, x0, y0, tx::INTEGER AS tx, ty::INTEGER AS ty, round(x0 * 0.5::DOUBLE + tx * 128, 6) AS x_um, round(y0 * 0.5::DOUBLE + ty * 128, 6) AS y_um FROM t, (SELECT unnest([0, 1]) AS tx), (SELECT unnest([0, 1]) AS ty)")
def supertile_tiles(spark, sf_dir):
    cells = tiling.supertiles(_parts(spark, sf_dir), "width", "height", 512).select("slide", "x0", "y0")
    return tiling.tiles_of(cells, 2, 128.0, F.lit(0.5)).withColumns({"x_um": F.round("x_um", 6), "y_um": F.round("y_um", 6)})


@query("""WITH b AS (SELECT l_orderkey AS slide, l_linenumber AS n, (l_partkey * 13 % 500)::INTEGER AS x, (l_suppkey * 7 % 300)::INTEGER AS y, (l_quantity)::INTEGER AS w, (l_quantity + 5)::INTEGER AS h FROM lineitem)
SELECT a.slide, a.n AS a, b.n AS b FROM b a JOIN b b ON a.slide = b.slide AND a.n < b.n WHERE NOT (a.x + a.w + 8 < b.x OR b.x + b.w + 8 < a.x OR a.y + a.h + 8 < b.y OR b.y + b.h + 8 < a.y)""")
def near_boxes(spark, sf_dir):
    """Pairs of a slide's boxes (seven at most) that touch or lie within a gap."""
    boxes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slide"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") * 13 % 500).cast("int").alias("x"), (F.col("l_suppkey") * 7 % 300).cast("int").alias("y"), F.col("l_quantity").cast("int").alias("w"), (F.col("l_quantity") + 5).cast("int").alias("h"))
    other = boxes.select("slide", *[F.col(c).alias(f"b_{c}") for c in "nxywh"])
    near = tiling.near_or_touching(tuple(F.col(c) for c in "xywh"), tuple(F.col(f"b_{c}") for c in "xywh"), 8)
    return boxes.join(other, "slide").filter((F.col("n") < F.col("b_n")) & near).select("slide", F.col("n").alias("a"), F.col("b_n").alias("b"))


@query("WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.05) AS lo, quantile_cont(p_retailprice, 0.95) AS hi FROM part GROUP BY p_brand) SELECT p_partkey, round(CASE WHEN hi <= lo THEN 0.5 ELSE least(greatest((p_retailprice - lo) / greatest(hi - lo, 1e-6), 0), 1) END, 6) AS scaled FROM part JOIN q USING (p_brand)")
def robust_scale_5_95(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    return scaling.unit_scale(rows, ["p_brand"], "p_retailprice", "scaled", 0.05, 0.95, fall_back_to_range=False).select("p_partkey", F.round("scaled", 6).alias("scaled"))


# Documents and strings ----------------------------------------------------------------------

_REPLY_SQL = """WITH m AS (SELECT conv_id, turn, replace(replace(replace(text, chr(92), ' '), '"', ' '), chr(10), ' ') AS t FROM conversations),
r AS (SELECT conv_id, turn, t, (conv_id + turn) % 4 AS k FROM m)
"""


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as replies: a whole contract, one in a fence, one without a nested prediction, and bare prose."""
    t = F.translate("text", '\\"\n', "   ")
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    whole = F.concat(F.lit('{"diagnosis": "AML", "thoughts": '), q(t), F.lit(', "roi_assessment": [{"roi": '), F.col("turn").cast("string"), F.lit(', "debug_path": "/x/y"}, {"roi": 99}], "npm1_prediction": {"applicable": "yes", "classification": "NPM1+", "justification": "j"}}'))
    k = (F.col("conv_id") + F.col("turn")) % 4
    reply = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("Here it is:\n```json\n"), whole, F.lit("\n```"))).when(k == 2, F.concat(F.lit('{"thoughts": '), q(t), F.lit(', "npm1_prediction": "none"}'))).otherwise(F.concat(F.lit("no "), F.translate(t, "{}[]", "    ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"), reply.alias("final_output"), F.lit("fallback").alias("final_decision"))


@query(_REPLY_SQL + """SELECT conv_id, turn, CASE WHEN k <= 1 THEN 'AML' ELSE 'fallback' END AS diagnosis, CASE WHEN k = 3 THEN '' ELSE t END AS thoughts, CASE WHEN k <= 1 THEN 'yes' ELSE '' END AS npm1_applicable,
CASE WHEN k <= 1 THEN 'NPM1+' ELSE '' END AS npm1_classification, CASE WHEN k <= 1 THEN 'j' ELSE '' END AS npm1_justification, CASE WHEN k <= 1 THEN 2 ELSE 0 END::INTEGER AS assessed FROM r""")
def prediction_rows(spark, sf_dir):
    rows = documents.prediction_row(_replies(spark, sf_dir), keep=["conv_id", "turn"])
    n = F.coalesce(F.json_array_length("roi_assessment"), F.lit(0))
    return rows.select("conv_id", "turn", "diagnosis", "thoughts", "npm1_applicable", "npm1_classification", "npm1_justification", n.alias("assessed"))


@query(_REPLY_SQL + """, e AS (SELECT conv_id, turn, k, t, unnest(CASE WHEN k <= 1 THEN [0, 1] ELSE [0] END) AS item FROM r)
SELECT conv_id, turn, item::INTEGER AS item, CASE WHEN k <= 1 THEN 'AML' ELSE '' END AS diagnosis, CASE WHEN k = 3 THEN '' ELSE t END AS thoughts, CASE WHEN k <= 1 THEN CASE item WHEN 0 THEN CAST(turn AS VARCHAR) ELSE '99' END ELSE '' END AS roi FROM e""")
def json_flatten(spark, sf_dir):
    bodies = _replies(spark, sf_dir).withColumn("body", text.json_object(F.col("final_output")))
    flat = documents.flattened(bodies, "body", ["conv_id", "turn"])
    return documents.columns_of(flat, ["conv_id", "turn"], ["diagnosis", "thoughts", "roi"])


@query(_REPLY_SQL + "SELECT conv_id, turn, k <= 1 AS meets, k <= 1 AS had_path, false AS has_path FROM r")
def contract_check(spark, sf_dir):
    body = text.json_object(F.col("final_output"))
    rows = _replies(spark, sf_dir).select("conv_id", "turn", F.coalesce(body, F.lit("")).alias("b"))
    clean = documents.without_paths(F.col("b"))
    return rows.select("conv_id", "turn", documents.meets_contract(clean).alias("meets"), F.col("b").contains("debug_path").alias("had_path"), clean.contains("debug_path").alias("has_path"))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Acute leukemia' END AS k FROM conversations")
def recovered_decisions(spark, sf_dir):
    """Errors of unknown tools: a decision called as a tool, another name, and another error."""
    error = F.when(F.col("turn") % 3 == 0, "Tool <|x|>'acute  LEUKEMIA': not found in agent VLM").when(F.col("turn") % 3 == 1, "Tool zoom not found in agent VLM").otherwise("timeout")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.unknown_tool_decision(error).alias("k"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'uni2' WHEN 1 THEN 'dino-bloom' WHEN 2 THEN 'h-optimus-1' ELSE lower(p_brand) END AS name FROM part")
def extractor_names(spark, sf_dir):
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, " UNI2-49b04e14 ").when(k == 1, "DinoBloom_S").when(k == 2, "h_optimus_1").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", text.extractor_name(raw).alias("name"))


@query("SELECT page_id, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY split_part(url, '/', 3), page_id)::INTEGER AS place FROM pages")
def natural_order(spark, sf_dir):
    """Pages of a host in the natural order of names that hold their number without leading zeros."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(3)).alias("host"))
    named = pages.withColumn("name", F.concat(F.lit("Page "), F.col("page_id").cast("string"), F.lit(".html")))
    return named.select("page_id", F.row_number().over(Window.partitionBy("host").orderBy(text.natural_key(F.col("name")))).alias("place"))


@query("""WITH l AS (SELECT conv_id, string_agg('- turn ' || turn || ': ' || role, chr(10) ORDER BY turn % 5 DESC, turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, '# ' || conv_id || chr(10) || t AS report FROM l""")
def region_reports(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"), "role", (F.col("turn") % 5).alias("importance"))
    return documents.report(rows, ["conv_id"], "title", "role", "importance", "turn")


# Sources and sinks --------------------------------------------------------------------------


@query("SELECT CAST(c_custkey AS VARCHAR) AS patient, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS label FROM customer")
def clinical_csv_scan(spark, sf_dir):
    """A clinical table written as CSV with its preferred columns first, and read again by its suffix and header words."""
    rows = table(spark, sf_dir, "customer").select("c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment")).alias("label"), F.col("c_custkey").alias("PATIENT"))
    path = new_path(spark, "clini") + ".csv"
    tables.write_csv(tables.ordered_union([rows], ["PATIENT", "label"]), path)
    read = clinical.require_columns(tables.read_table(spark, path), ["PATIENT", "label"])
    key = tables.resolve_column(read.columns, tables.PATIENT_WORDS)
    return read.select(F.col(key).alias("patient"), F.col("c_name").alias("name"), assembly.null_tokens(F.col("label")).alias("label"))


@query("SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS task FROM nation")
def directory_partition_scan(spark, sf_dir):
    """Tables in a folder for each task, read together with the task from the path."""
    base = new_path(spark, "tasks")
    nation = table(spark, sf_dir, "nation")
    nation.select("n_nationkey", "n_name", F.concat(F.lit("task_"), F.col("n_regionkey").cast("string")).alias("t")).write.partitionBy("t").json(base)
    rows = spark.read.schema("n_nationkey int, n_name string").json(f"{base}/*/*.json")
    return tables.with_path_keys(rows, r"/t=task_([^/]+)/", ["task"])


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'nested' ELSE 'top' END AS found FROM supplier WHERE s_suppkey % 3 <= 1")
def report_fallback(spark, sf_dir):
    """Reports at the first path of two where one is."""
    base = new_path(spark, "reports")
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("slide"), "s_suppkey")
    rows.filter("s_suppkey % 3 = 1").withColumn("found", F.lit("top")).write.json(f"{base}/top")
    rows.filter("s_suppkey % 3 <= 1 AND (s_suppkey % 3 = 0 OR s_suppkey % 2 = 0)").withColumn("found", F.lit("nested")).write.json(f"{base}/nested")
    read = lambda where: spark.read.schema("slide string, s_suppkey long, found string").json(f"{base}/{where}")
    return tables.first_found([read("top"), read("nested")], ["slide"]).select("s_suppkey", "found")


@query("SELECT DISTINCT split_part(url, '/', 3) AS value FROM pages")
def slide_list(spark, sf_dir):
    host = F.concat(F.lit(' "'), F.split_part("url", F.lit("/"), F.lit(3)), F.lit('" '))
    return tables.distinct_first_column(table(spark, sf_dir, "pages").select(host.alias("slide"), "page_id"))


@query("SELECT source AS value, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY source")
def patient_ids_in_order(spark, sf_dir):
    return tables.first_seen(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.23 WHEN 3 THEN 0.25 ELSE 0.3 END::DOUBLE AS mpp, ['property', 'comment', 'xml', 'power', 'default'][p_partkey % 5 + 1] AS source FROM part""")
def slide_resolution(spark, sf_dir):
    k = F.col("p_partkey") % 5
    none = F.create_map().cast("map<string,string>")
    properties = F.when(k == 0, F.create_map(F.lit("openslide.mpp-x"), F.lit("0.25"))).when(k == 3, F.create_map(F.lit("openslide.objective-power"), F.lit("40"))).otherwise(none)
    mpp = tables.microns_per_pixel(properties, F.when(k == 1, "Aperio MPP = 0.5|x"), F.when(k == 2, '<Pixels PhysicalSizeX="0.23"/>'), 0.3)
    return table(spark, sf_dir, "part").select("p_partkey", mpp.alias("m")).select("p_partkey", "m.mpp", "m.source")


@query("SELECT l_orderkey, l_linenumber, (l_partkey * 3)::BIGINT AS x, (l_suppkey * 5)::BIGINT AS y FROM lineitem")
def coordinate_csv(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 3).alias("x0"), (F.col("l_suppkey") * 5).alias("y0"), "l_orderkey", "l_linenumber")
    path = new_path(spark, "coords") + ".csv"
    tables.write_csv(rows, path)
    return tables.read_coordinates(spark, path, keep=["l_orderkey", "l_linenumber"]).withColumns({c: F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber")})


@query("SELECT doc_id, '{\"doc_id\":' || doc_id || ',\"source\":' || coalesce('\"' || source || '\"', 'null') || '}' AS manifest FROM documents")
def public_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct("doc_id", "source", F.col("lang").alias("_lang")).alias("m"))
    return docs.select("doc_id", tables.public_json(F.col("m"), ["doc_id", "source", "_lang"]).alias("manifest"))


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey + 1000000, c_name FROM customer WHERE c_custkey % 10 = 0")
def guarded_append(spark, sf_dir):
    """An append that is run twice, then with rows that are new."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    path = new_path(spark, "append")
    versions.append_new(rows, path, ["c_custkey"])
    versions.append_new(rows, path, ["c_custkey"])
    versions.append_new(rows.unionByName(rows.filter("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)), path, ["c_custkey"])
    return versions.read(spark, path)


@query("SELECT 1 AS version, c_custkey, c_mktsegment AS segment FROM customer UNION ALL SELECT 2, c_custkey, upper(c_name) FROM customer WHERE c_custkey % 3 = 0")
def published_versions(spark, sf_dir):
    """Two versions of a table; the first is read after the second is published."""
    rows, path = table(spark, sf_dir, "customer"), new_path(spark, "versions")
    versions.publish(rows.select("c_custkey", F.col("c_mktsegment").alias("segment")), path)
    first = versions.read(spark, path)
    versions.publish(rows.filter("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("segment")), path)
    return first.select(F.lit(1).alias("version"), "*").unionByName(versions.read(spark, path).select(F.lit(2).alias("version"), "*"))


@query("""SELECT doc_id, '{"keep":' || doc_id || ',"list":[1,{"z":"' || coalesce(source, '') || '"},{}],"in":{"b":[]}}' AS document FROM documents""")
def nested_path_strip(spark, sf_dir):
    """Path members with objects, lists and texts as values, first, amid and last, at several depths."""
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    parts = ['{"path":{"x":"/s","path":[1]},"keep":', F.col("doc_id").cast("string"), ',"debug_path":["/p",{"a":"}"}],"list":[1,{"z":', quoted(F.col("source")), ',"out_dir":null},{"save_dir":"a, \\"b"}],"in":{"path":1,"b":[]},"overview_path":{}}']
    text_ = F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    return table(spark, sf_dir, "documents").select("doc_id", documents.without_paths(text_).alias("document"))
