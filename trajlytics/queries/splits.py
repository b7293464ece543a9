"""Split, fold, identity and support queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from trajlytics.operators import splits as S
from trajlytics.plans.joins import checked_join, join_report
from trajlytics.queries.registry import register
from trajlytics.sources import adapters as A
from trajlytics.sources.adapters import table, with_ctes


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")


_RANKED = """ranked AS (SELECT user_id, ROW_NUMBER() OVER (ORDER BY sha256('42|' || user_id), user_id) AS r,
    COUNT(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM events))"""
_SPLIT = """split AS (SELECT user_id, CASE WHEN r <= GREATEST(1, FLOOR(n * 0.2::DOUBLE)) THEN 'test'
    WHEN r <= GREATEST(1, FLOOR(n * 0.2::DOUBLE)) + GREATEST(1, FLOOR(n * 0.15::DOUBLE)) THEN 'validation' ELSE 'train' END AS split FROM ranked)"""


def _split(spark, sf_dir):
    return S.stable_group_split(_events(spark, sf_dir), ["user_id"], validation_fraction=0.15, test_fraction=0.2)


@register("c1_stable_group_split", "event_id:i user_id:i split", with_ctes(
    "", "SELECT event_id, user_id, split FROM events JOIN split USING (user_id)", _RANKED, _SPLIT))
def c1_stable_group_split(spark, sf_dir):
    return _split(spark, sf_dir)


@register("c2_explicit_holdout", "split n_rows:i n_groups:i", """SELECT CASE WHEN o_orderpriority IN ('1-URGENT') THEN 'test'
    WHEN o_orderpriority IN ('2-HIGH') THEN 'validation' ELSE 'train' END AS split, COUNT(*) AS n_rows,
    COUNT(DISTINCT o_orderpriority) AS n_groups FROM orders GROUP BY 1""")
def c2_explicit_holdout(spark, sf_dir):
    df = S.explicit_holdout_split(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT"], ["2-HIGH"])
    return S.summarize_split(df, ["o_orderpriority"])


@register("c3_isolation_violations", "o_custkey:i n_splits:i", """SELECT o_custkey, COUNT(DISTINCT o_orderstatus) AS n_splits
    FROM orders GROUP BY 1 HAVING n_splits > 1""")
def c3_isolation_violations(spark, sf_dir):
    return S.isolation_violations(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderstatus")


@register("c4_split_summary", "split n_rows:i n_groups:i", with_ctes(
    "", "SELECT split, COUNT(*) AS n_rows, COUNT(DISTINCT user_id) AS n_groups FROM events JOIN split USING (user_id) GROUP BY 1",
    _RANKED, _SPLIT))
def c4_split_summary(spark, sf_dir):
    return S.summarize_split(_split(spark, sf_dir), ["user_id"])


@register("c5_stable_group_folds", "fold:i user_id:i n_rows:i", with_ctes(
    "", "SELECT (r - 1) % 5 AS fold, user_id, COUNT(*) AS n_rows FROM events JOIN ranked USING (user_id) GROUP BY 1, 2", _RANKED))
def c5_stable_group_folds(spark, sf_dir):
    return S.stable_group_folds(_events(spark, sf_dir), "user_id").groupBy("fold", "user_id").agg(F.count(F.lit(1)).alias("n_rows"))


_PROFILE = "profile AS (SELECT DISTINCT condition_id, temperature_c, storage_soc_fraction FROM calendar_obs)"


@register("c6_scenario_folds", "scenario fold_id condition_id:i", with_ctes("cal", """
    SELECT 'leave_one_condition_out' AS scenario, CAST(condition_id AS VARCHAR) AS fold_id, condition_id FROM profile UNION ALL
    SELECT 'leave_one_temperature_out', CAST(temperature_c AS VARCHAR), condition_id FROM profile UNION ALL
    SELECT 'fixed_condition_holdout', 'fixed_holdout', condition_id FROM profile WHERE condition_id IN (1, 2, 3)""", _PROFILE))
def c6_scenario_folds(spark, sf_dir):
    return S.scenario_folds(S.condition_profile(A.calendar_obs(spark, sf_dir)), fixed=[1, 2, 3])


@register("c7_fold_statistics",
          "held_out prefix_cycle:i prefix_rows:i prefix_sum:d4 history_entities:i history_rows:i history_sum:d4", with_ctes("cycles", """
    SELECT o.cell_id AS held_out, prefix_cycle, prefix_rows, prefix_sum, te - 1 AS history_entities, tn - n AS history_rows, ts - s AS history_sum
    FROM (SELECT cell_id, prefix_cycle, COUNT(*) FILTER (WHERE cycle_index <= prefix_cycle) AS prefix_rows,
            SUM(discharge_capacity_ah) FILTER (WHERE cycle_index <= prefix_cycle) AS prefix_sum, COUNT(*) AS n, SUM(discharge_capacity_ah) AS s
          FROM cycles, (VALUES (20), (100), (300)) AS m(prefix_cycle) GROUP BY 1, 2) o,
         (SELECT COUNT(*) AS tn, SUM(discharge_capacity_ah) AS ts, COUNT(DISTINCT cell_id) AS te FROM cycles)"""))
def c7_fold_statistics(spark, sf_dir):
    return S.fold_statistics(A.cycles(spark, sf_dir), "cell_id", "cycle_index", "discharge_capacity_ah", [20, 100, 300])


@register("c7_fold_table", "held_out prefix_cycle:i row_role cell_id n_rows:i last_cycle:i capacity:d4", with_ctes("cycles", """
    SELECT held_out, prefix_cycle, CASE WHEN batch_id = held_out THEN 'target_prefix' ELSE 'training_history' END AS row_role, cell_id,
        COUNT(*) AS n_rows, MAX(cycle_index) AS last_cycle, SUM(discharge_capacity_ah) AS capacity
    FROM cycles, (SELECT DISTINCT batch_id AS held_out FROM cycles), (VALUES (50), (200)) AS f(prefix_cycle)
    WHERE batch_id <> held_out OR cycle_index <= prefix_cycle GROUP BY 1, 2, 3, 4"""))
def c7_fold_table(spark, sf_dir):
    folds = [(batch, p) for batch in ("0", "1", "2") for p in (50, 200)]
    return S.fold_table(A.cycles(spark, sf_dir), folds, "batch_id", "cycle_index").groupBy(
        "held_out", "prefix_cycle", "row_role", "cell_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("cycle_index").alias("last_cycle"), F.sum("discharge_capacity_ah").alias("capacity"))


@register("c8_nested_reference_partition", "domain:i repeat_index:i entity_id:i reference_rank:i role", with_ctes("sig", """
    SELECT domain, repeat_index, entity_id, reference_rank,
      CASE WHEN n <= 10 THEN 'too_small' WHEN reference_rank <= 10 THEN 'reference' ELSE 'query' END AS role FROM (
      SELECT domain, repeat_index, entity_id, COUNT(*) OVER (PARTITION BY domain, repeat_index) AS n,
        ROW_NUMBER() OVER (PARTITION BY domain, repeat_index ORDER BY sha256(concat_ws('|', 7, domain, repeat_index, entity_id)), entity_id) AS reference_rank
      FROM signatures, (SELECT UNNEST([0, 1, 2]) AS repeat_index))"""))
def c8_nested_reference_partition(spark, sf_dir):
    return S.nested_reference_partition(A.signatures(spark, sf_dir), domain="domain", entity="entity_id", max_k=10, repeats=3, seed=7)


@register("c9_k_shot_support", "k:i eligible_domains:i eligible_cells:i query_cells:i excluded_domains:i status", """
    SELECT k, COUNT(*) FILTER (WHERE n >= k + 5) AS eligible_domains, COALESCE(SUM(n) FILTER (WHERE n >= k + 5), 0) AS eligible_cells,
      COALESCE(SUM(n - k) FILTER (WHERE n >= k + 5), 0) AS query_cells, COUNT(*) FILTER (WHERE n < k + 5) AS excluded_domains,
      CASE WHEN COUNT(*) FILTER (WHERE n >= k + 5) >= 20 THEN 'passed' ELSE 'failed' END AS status
    FROM (SELECT s_nationkey, COUNT(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1), (SELECT UNNEST([1, 3, 5, 10, 40]) AS k) GROUP BY k""")
def c9_k_shot_support(spark, sf_dir):
    return S.k_shot_support(table(spark, sf_dir, "supplier"), domain="s_nationkey", entity="s_suppkey", ks=[1, 3, 5, 10, 40], min_query=5, min_domains=20)


@register("c9_domain_sizes", "domain_size:i n_domains:i", """SELECT n AS domain_size, COUNT(*) AS n_domains FROM
    (SELECT s_nationkey, COUNT(DISTINCT s_suppkey) AS n FROM supplier GROUP BY 1) GROUP BY 1""")
def c9_domain_sizes(spark, sf_dir):
    return S.domain_size_histogram(table(spark, sf_dir, "supplier"), domain="s_nationkey", entity="s_suppkey")


def _crosswalk(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("BC"), F.col("l_suppkey").cast("string")).alias("barcode"), "l_quantity")
    walk = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("BC"), F.expr("CASE WHEN s_nationkey = 3 THEN s_suppkey + 100000 ELSE s_suppkey END").cast("string")).alias("barcode"),
        F.col("s_name").alias("official_id"))
    return items, walk


_WALK = """items AS (SELECT 'BC' || l_suppkey AS barcode, l_quantity FROM lineitem),
    walk AS (SELECT 'BC' || CASE WHEN s_nationkey = 3 THEN s_suppkey + 100000 ELSE s_suppkey END AS barcode, s_name AS official_id FROM supplier)"""


@register("c10_crosswalk_join", "official_id n_rows:i quantity:d", with_ctes(
    "", "SELECT official_id, COUNT(*) AS n_rows, SUM(l_quantity) AS quantity FROM items JOIN walk USING (barcode) GROUP BY 1", _WALK))
def c10_crosswalk_join(spark, sf_dir):
    items, walk = _crosswalk(spark, sf_dir)
    return S.crosswalk_join(items, walk, ["barcode"])[0].groupBy("official_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("quantity"))


@register("c10_crosswalk_report", "barcode left_rows:i right_rows:i issue", with_ctes("", """
    SELECT barcode, COALESCE(l, 0) AS left_rows, COALESCE(r, 0) AS right_rows,
        CASE WHEN r IS NULL THEN 'missing_right' WHEN l IS NULL THEN 'missing_left' WHEN l > 1 THEN 'duplicate_both' ELSE 'duplicate_right' END AS issue
    FROM (SELECT barcode, COUNT(*) AS l FROM items GROUP BY 1) FULL JOIN (SELECT barcode, COUNT(*) AS r FROM walk GROUP BY 1) USING (barcode)
    WHERE r IS NULL OR l IS NULL OR r > 1""", _WALK))
def c10_crosswalk_report(spark, sf_dir):
    return S.crosswalk_join(*_crosswalk(spark, sf_dir), ["barcode"])[1]


_LABELS11 = """official AS (SELECT o_custkey AS cell, MAX(o_totalprice) AS cycle_life, MIN(o_orderpriority) AS protocol_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)"""


def _metadata(spark, sf_dir):
    meta = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("source_protocol"), F.col("c_nationkey").alias("batch_id"),
        (F.col("c_acctbal") * 50).alias("source_life"))
    labels = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("cell")).agg(
        F.max("o_totalprice").alias("cycle_life"), F.min("o_orderpriority").alias("protocol_id"))
    return S.authoritative_labels(
        meta, labels, "cell", {"protocol_id": "source_protocol", "cycle_life": "source_life"},
        F.when(F.col("batch_id") == 2, "merged_continuation").otherwise("no_authoritative_label"))


_META = f"""{_LABELS11}, meta AS (SELECT c_custkey AS cell, COALESCE(protocol_id, c_mktsegment) AS protocol_id, c_nationkey AS batch_id,
    COALESCE(cycle_life, c_acctbal * 50) AS cycle_life, c_acctbal * 50 AS source_life, official.cell IS NOT NULL AS official_cohort,
    CASE WHEN official.cell IS NULL THEN CASE WHEN c_nationkey = 2 THEN 'merged_continuation' ELSE 'no_authoritative_label' END END AS exclusion_reason
    FROM customer LEFT JOIN official ON c_custkey = official.cell)"""


@register("c11_authoritative_labels", "cell:i protocol_id cycle_life:d official_cohort:b exclusion_reason", with_ctes("", "SELECT * FROM meta", _META))
def c11_authoritative_labels(spark, sf_dir):
    return _metadata(spark, sf_dir)


@register("c13_metadata_audit", "batch_id:i official_cohort:b n_cells:i n_protocols:i life_min:d life_max:d n_label_differences:i max_label_difference:d",
          with_ctes("", """SELECT batch_id, official_cohort, COUNT(*) AS n_cells, COUNT(DISTINCT protocol_id) AS n_protocols, MIN(cycle_life) AS life_min,
    MAX(cycle_life) AS life_max, COUNT(*) FILTER (WHERE cycle_life - source_life <> 0) AS n_label_differences,
    MAX(ABS(cycle_life - source_life)) AS max_label_difference FROM meta GROUP BY 1, 2""", _META))
def c13_metadata_audit(spark, sf_dir):
    return S.metadata_audit(_metadata(spark, sf_dir), ["batch_id", "official_cohort"], "cycle_life", "source_life")


@register("c12_composite_crosswalk", "local_key author_key issue", """WITH loc AS (SELECT DISTINCT concat_ws('|', l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT)) AS k FROM lineitem WHERE l_returnflag = 'A'),
    aut AS (SELECT DISTINCT concat_ws('|', l_suppkey, l_linenumber, CAST(l_quantity AS BIGINT)) AS k FROM lineitem WHERE l_returnflag = 'R')
    SELECT loc.k AS local_key, aut.k AS author_key, CASE WHEN loc.k IS NULL THEN 'local_missing' WHEN aut.k IS NULL THEN 'author_missing' ELSE 'matched' END AS issue
    FROM loc FULL JOIN aut ON loc.k = aut.k""")
def c12_composite_crosswalk(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", S.composite_key("l_suppkey", "l_linenumber", F.col("l_quantity").cast("bigint")).alias("k"))
    local = items.filter("l_returnflag = 'A'").select(F.col("k").alias("local_key")).distinct()
    author = items.filter("l_returnflag = 'R'").select(F.col("k").alias("author_key")).distinct()
    issue = F.when(F.col("local_key").isNull(), "local_missing").when(F.col("author_key").isNull(), "author_missing").otherwise("matched")
    return local.join(author, F.col("local_key") == F.col("author_key"), "full_outer").withColumn("issue", issue)


@register("c14_file_pairs", "stem n_files:i missing complete:b", """WITH files AS (SELECT split_part(url, '?', 1) || '/' || source || '_' || CASE WHEN n_chars % 2 = 0 THEN 'cycle_data' ELSE 'timeseries' END || '.csv' AS path
        FROM (SELECT p_name AS url, p_brand AS source, p_size AS n_chars FROM part))
    SELECT stem, COUNT(*) AS n_files, concat_ws(';', CASE WHEN MAX(CAST(kind = 'cycle_data' AS INT)) = 0 THEN 'cycle_data' END,
        CASE WHEN MAX(CAST(kind = 'timeseries' AS INT)) = 0 THEN 'timeseries' END) AS missing, COUNT(DISTINCT kind) = 2 AS complete
    FROM (SELECT regexp_extract(path, '^(.+)_(cycle_data|timeseries)\\.csv$', 1) AS stem, regexp_extract(path, '^(.+)_(cycle_data|timeseries)\\.csv$', 2) AS kind FROM files)
    WHERE stem <> '' GROUP BY 1""")
def c14_file_pairs(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(
        "p_name", F.lit("/"), "p_brand", F.lit("_"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'cycle_data' ELSE 'timeseries' END"), F.lit(".csv")).alias("path"))
    return S.file_pairs(files, "path", r"^(.+)_(cycle_data|timeseries)\.csv$", ["cycle_data", "timeseries"])


@register("c15_checked_join", "o_orderstatus c_mktsegment n_rows:i total:d4", """SELECT o_orderstatus, c_mktsegment, COUNT(*) AS n_rows, SUM(o_totalprice) AS total
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def c15_checked_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return checked_join(orders, customer, ["c_custkey"], validate="m:1", require_match=True).groupBy("o_orderstatus", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("o_totalprice").alias("total"))


@register("c15_join_report", "issue n_keys:i left_rows:i right_rows:i", """SELECT issue, COUNT(*) AS n_keys, SUM(l) AS left_rows, SUM(r) AS right_rows FROM (
    SELECT COALESCE(l, 0) AS l, COALESCE(r, 0) AS r, CASE WHEN r IS NULL THEN 'missing_right' WHEN l IS NULL THEN 'missing_left'
        WHEN l > 1 AND r > 1 THEN 'duplicate_both' WHEN r > 1 THEN 'duplicate_right' WHEN l > 1 THEN 'duplicate_left' END AS issue
    FROM (SELECT o_custkey AS k, COUNT(*) AS l FROM orders GROUP BY 1) FULL JOIN (SELECT user_id AS k, COUNT(*) AS r FROM events WHERE event_type = 'error' GROUP BY 1) USING (k))
    WHERE issue IS NOT NULL GROUP BY 1""")
def c15_join_report(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    right = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("user_id").alias("k"))
    return join_report(left, right, ["k"]).groupBy("issue").agg(
        F.count(F.lit(1)).alias("n_keys"), F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"))


# Stress profile with uneven levels: one (nation, size) condition per supplier.
STRESS_SQL = "stress AS (SELECT s_suppkey AS condition_id, FLOOR(s_acctbal / 1e2) AS temperature_c, s_nationkey / 2.4e1 AS storage_soc_fraction FROM supplier)"


def stress(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("condition_id"), F.expr("CAST(FLOOR(s_acctbal / 1e2) AS DOUBLE)").alias("temperature_c"),
        F.expr("s_nationkey / 2.4e1").alias("storage_soc_fraction"))


@register("c16_support_classes", "condition_id:i temperature_in_range:b soc_in_range:b temperature_level_seen:b soc_level_seen:b support_class", with_ctes("", """
    SELECT condition_id, ti AS temperature_in_range, si AS soc_in_range, tl AS temperature_level_seen, sl AS soc_level_seen,
      CASE WHEN ti AND si THEN 'stress_covariate_interpolation' WHEN ti THEN 'soc_range_extrapolation'
           WHEN si THEN 'temperature_range_extrapolation' ELSE 'temperature_and_soc_range_extrapolation' END AS support_class
    FROM (SELECT a.condition_id, a.temperature_c BETWEEN MIN(b.temperature_c) AND MAX(b.temperature_c) AS ti,
        a.storage_soc_fraction BETWEEN MIN(b.storage_soc_fraction) AND MAX(b.storage_soc_fraction) AS si,
        bool_or(a.temperature_c = b.temperature_c) AS tl, bool_or(a.storage_soc_fraction = b.storage_soc_fraction) AS sl
      FROM stress a JOIN stress b ON a.condition_id <> b.condition_id GROUP BY a.condition_id, a.temperature_c, a.storage_soc_fraction)""", STRESS_SQL))
def c16_support_classes(spark, sf_dir):
    return S.support_classes(stress(spark, sf_dir))


@register("c17_convex_hull", "condition_id:i in_hull:b", with_ctes("", """
    SELECT condition_id, NOT EXISTS (SELECT 1 FROM edges e WHERE (e.bx - e.ax) * (q.y - e.ay) - (e.by_ - e.ay) * (q.x - e.ax) < -1e-10) AS in_hull FROM q""",
    STRESS_SQL,
    "pts AS (SELECT DISTINCT temperature_c AS x, storage_soc_fraction AS y FROM stress WHERE condition_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 6000))",
    """edges AS (SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM pts a JOIN pts b ON a.x <> b.x OR a.y <> b.y
        WHERE NOT EXISTS (SELECT 1 FROM pts c WHERE (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-12))""",
    "q AS (SELECT condition_id, temperature_c AS x, storage_soc_fraction AS y FROM stress)"))
def c17_convex_hull(spark, sf_dir):
    profile = stress(spark, sf_dir)
    low = table(spark, sf_dir, "supplier").filter("s_acctbal < 6000").select(F.col("s_suppkey").alias("condition_id"))
    return S.in_convex_hull(profile, profile.join(low, "condition_id", "left_semi"), "temperature_c", "storage_soc_fraction")


_SLICE = ["""ref AS (SELECT temperature_c AS t, storage_soc_fraction AS s, checkup_index AS i, AVG(capacity_retention_pct) AS v
        FROM calendar_obs WHERE checkup_index < 10 GROUP BY 1, 2, 3)""",
    "grid AS (SELECT DISTINCT t, s FROM ref)",
    """req AS (SELECT condition_id AS request_id, 5e0 * (condition_id % 11) AS t, (condition_id % 17) / 1.6e1 AS s, checkup_index AS i, capacity_retention_pct AS v
        FROM calendar_obs WHERE checkup_index < 10)""",
    """nb AS (SELECT r.request_id, r.t, r.s, bool_or(g.t = r.t AND g.s = r.s) AS ex,
        MAX(CASE WHEN g.t = r.t AND g.s < r.s THEN g.s END) AS slo, MIN(CASE WHEN g.t = r.t AND g.s > r.s THEN g.s END) AS shi,
        MAX(CASE WHEN g.s = r.s AND g.t < r.t THEN g.t END) AS tlo, MIN(CASE WHEN g.s = r.s AND g.t > r.t THEN g.t END) AS thi
        FROM (SELECT DISTINCT request_id, t, s FROM req) r, grid g GROUP BY 1, 2, 3)""",
    """md AS (SELECT *, CASE WHEN ex THEN 'exact_reference_condition' WHEN slo IS NOT NULL AND shi IS NOT NULL THEN 'same_temperature_soc_interpolation'
        WHEN tlo IS NOT NULL AND thi IS NOT NULL THEN 'same_soc_temperature_interpolation' ELSE 'unavailable' END AS reference_mode FROM nb)""",
    """res AS (SELECT q.request_id, m.reference_mode, q.i, q.v - CASE m.reference_mode WHEN 'exact_reference_condition' THEN e.v
        WHEN 'same_temperature_soc_interpolation' THEN a.v + (q.s - m.slo) / (m.shi - m.slo) * (b.v - a.v)
        WHEN 'same_soc_temperature_interpolation' THEN c.v + (q.t - m.tlo) / (m.thi - m.tlo) * (d.v - c.v) END AS r
        FROM req q JOIN md m USING (request_id)
        LEFT JOIN ref e ON e.t = q.t AND e.s = q.s AND e.i = q.i LEFT JOIN ref a ON a.t = q.t AND a.s = m.slo AND a.i = q.i
        LEFT JOIN ref b ON b.t = q.t AND b.s = m.shi AND b.i = q.i LEFT JOIN ref c ON c.s = q.s AND c.t = m.tlo AND c.i = q.i
        LEFT JOIN ref d ON d.s = q.s AND d.t = m.thi AND d.i = q.i)"""]


@register("c18_local_slice_reference", "request_id:i reference_mode max_point_deviation:d max_step_deviation:d prefix_supported:b", with_ctes("cal", """
    SELECT request_id, reference_mode, MAX(ABS(r)) AS max_point_deviation, MAX(ABS(r - pr)) AS max_step_deviation,
      COALESCE(MAX(ABS(r)) <= 1.0 + 1e-12 AND MAX(ABS(r - pr)) <= 1.0 + 1e-12, FALSE) AS prefix_supported
    FROM (SELECT *, LAG(r) OVER (PARTITION BY request_id ORDER BY i) AS pr FROM res) GROUP BY 1, 2""", *_SLICE))
def c18_local_slice_reference(spark, sf_dir):
    obs = A.calendar_obs(spark, sf_dir).filter("checkup_index < 10")
    ordered = lambda v: F.transform(F.sort_array(F.collect_list(F.struct("checkup_index", v))), lambda p: p[v])
    ref = (
        obs.groupBy("temperature_c", "storage_soc_fraction", "checkup_index").agg(F.avg("capacity_retention_pct").alias("v"))
        .groupBy("temperature_c", "storage_soc_fraction").agg(ordered("v").alias("prefix"))
    )
    req = obs.groupBy(F.col("condition_id").alias("request_id")).agg(ordered("capacity_retention_pct").alias("prefix")).withColumns({
        "temperature_c": F.expr("5e0 * (request_id % 11)"), "storage_soc_fraction": F.expr("(request_id % 17) / 1.6e1")})
    return S.local_slice_reference(req, ref, point_margin=1.0, step_margin=1.0)
