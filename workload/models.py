"""Registered queries of the failure model: trained, tuned, saved, loaded, scored and run to the queue."""

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stromlage import fixed_values as fv
from stromlage.operators.boosting import Growth, even_cuts
from stromlage.plans import scoring, training
from stromlage.plans.features import chronological_split
from stromlage.plans.training import Params, Trained, evaluate, train_and_tune, with_probability
from stromlage.session import scratch_path, stage
from stromlage.sources import artifacts
from workload import bindings as b
from workload.catalog import FEATURES, LATEST, _queue_sql, _risk_sql, _scores_sql, feature_table, query, rounded, shaped, widened

#: Rows before this instant train, the others test.
CUTOFF = "2024-01-20 00:00:00"

# --- one round, with a twin -----------------------------------------------

#: Depth two, all rows and columns, 15 even cuts: what SQL can follow exactly.
SMALL = Growth(rounds=1, depth=2, rate=0.3, row_share=1.0, column_share=1.0, bins=16)
F_NUMBERS = f"(SELECT unnest(range(1, {len(fv.FEATURES) + 1})) AS f)"


def _bin(f: int, name: str) -> str:
    return f"""CASE WHEN {name} IS NULL THEN 0 ELSE 1 + len(list_filter(range(1, {SMALL.bins}),
      lambda i: lo[{f}] + (hi[{f}] - lo[{f}]) * i / {SMALL.bins} < {name})) END"""


def _level_sql(k: int) -> str:
    """Best splits of the nodes of level k by histogram sums, and the rows one level down."""
    return f"""
totals_{k} AS (SELECT node, SUM(g) AS g, SUM(h) AS h FROM rows_{k} GROUP BY node),
cells_{k} AS (SELECT node, f, bs[f] AS bin, SUM(g) AS g, SUM(h) AS h FROM rows_{k}, {F_NUMBERS} GROUP BY ALL),
tries_{k} AS (
  SELECT node, f, cut, side, COALESCE(SUM(g) FILTER (below), 0) AS gl, COALESCE(SUM(h) FILTER (below), 0) AS hl
  FROM (SELECT *, bin BETWEEN 1 AND cut OR (bin = 0 AND side = 1) AS below
        FROM cells_{k}, (SELECT unnest(range(1, {SMALL.bins})) AS cut), (SELECT unnest([0, 1]) AS side))
  GROUP BY node, f, cut, side),
gains_{k} AS (
  SELECT tries_{k}.*, g - gl AS gr, h - hl AS hr,
         ROUND(gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1), 6) AS gain
  FROM tries_{k} JOIN totals_{k} USING (node)),
best_{k} AS (
  SELECT * FROM gains_{k} WHERE hl >= 1 AND hr >= 1 AND gain > 0
  QUALIFY ROW_NUMBER() OVER (PARTITION BY node ORDER BY gain DESC, f, cut, side) = 1),
rows_{k + 1} AS (
  SELECT 2 * node + 2 - if(bs[f] = 0, side, CAST(bs[f] <= cut AS INTEGER)) AS node, rows_{k}.g, rows_{k}.h, bs
  FROM rows_{k} JOIN best_{k} USING (node))"""


NAMES = ", ".join(f"'{c}'" for c in fv.FEATURES)
INNER = " UNION ALL ".join(f"SELECT node, f, cut, side, gain, gl, hl, gr, hr FROM best_{k}" for k in range(SMALL.depth))

ONE_TREE = f"""{FEATURES},
labelled AS (
  SELECT * FROM features WHERE "timestamp" < TIMESTAMP '{CUTOFF}' AND failure_event IS NOT NULL),
balance AS (
  SELECT COALESCE(COUNT(*) FILTER (failure_event < 0.5)
                  / NULLIF(COUNT(*) FILTER (failure_event >= 0.5), 0)::DOUBLE, 1) AS heavy FROM labelled),
spans AS (
  SELECT [{', '.join(f'MIN({c})::DOUBLE' for c in fv.FEATURES)}] AS lo,
         [{', '.join(f'MAX({c})::DOUBLE' for c in fv.FEATURES)}] AS hi FROM labelled),
rows_0 AS (
  SELECT 0 AS node, if(failure_event >= 1, heavy, 1) * (0.5::DOUBLE - failure_event) AS g,
         if(failure_event >= 1, heavy, 1) * 0.25::DOUBLE AS h, [{', '.join(_bin(f, c) for f, c in enumerate(fv.FEATURES, 1))}] AS bs
  FROM labelled, balance, spans),
{','.join(_level_sql(k) for k in range(SMALL.depth))},
inner_nodes AS ({INNER}),
leaves AS (
  SELECT * FROM (
    SELECT 0 AS node, -0.3::DOUBLE * g / (h + 1) AS leaf FROM totals_0
    UNION ALL SELECT 2 * node + 1, -0.3::DOUBLE * gl / (hl + 1) FROM inner_nodes
    UNION ALL SELECT 2 * node + 2, -0.3::DOUBLE * gr / (hr + 1) FROM inner_nodes)
  WHERE node NOT IN (SELECT node FROM inner_nodes)),
nodes AS (
  SELECT node, list_extract([{NAMES}], f) AS feature, lo[f] + (hi[f] - lo[f]) * cut / {SMALL.bins} AS cut,
         side = 1 AS missing_left, gain, NULL AS value FROM inner_nodes, spans
  UNION ALL SELECT node, NULL, NULL, NULL, NULL, leaf FROM leaves)"""


def _small_model(spark: SparkSession, rows: DataFrame):
    train_rows, _ = chronological_split(rows, CUTOFF)
    return training.train(train_rows.where(F.col(fv.TARGET).isNotNull()), Params(growth=SMALL), even_cuts)


@query("boosted_round", f"""WITH {ONE_TREE}
  SELECT CAST(node AS BIGINT) AS node, feature, ROUND(cut, 6) AS cut, missing_left, ROUND(gain, 4) AS gain,
         ROUND(value, 6) AS value FROM nodes""")
def boosted_round(spark, d):
    """M1, M2: the first tree on fractional labels, missing weather as it is."""
    rows = stage(feature_table(spark, d), "features")
    nodes = _small_model(spark, rows).nodes(spark).drop("tree").withColumn("gain", F.round("gain", 4))
    return shaped(nodes)


def _step(k: int) -> str:
    return f"""walk_{k + 1} AS (
  SELECT * EXCLUDE (node, f, cut, side), if(f IS NULL, node, 2 * node + 2 - if(vs[f] IS NULL, side,
           CAST(vs[f] <= lo[f] + (hi[f] - lo[f]) * cut / {SMALL.bins} AS INTEGER))) AS node
  FROM walk_{k} LEFT JOIN (SELECT node, f, cut, side FROM inner_nodes) USING (node))"""


WALKED = f"""{ONE_TREE}, {LATEST},
walk_0 AS (SELECT latest.*, lo, hi, [{', '.join(f'{c}::DOUBLE' for c in fv.FEATURES)}] AS vs, 0 AS node FROM latest, spans),
{', '.join(_step(k) for k in range(SMALL.depth))},
margins AS (SELECT *, leaf AS margin FROM walk_{SMALL.depth} JOIN leaves USING (node))"""


@query("scoring_run", f"""WITH {_queue_sql(_scores_sql(_risk_sql(WALKED)))}
  SELECT priority, corridor_name, {widened('critical_infra_score')},
    {rounded('failure_probability_pct risk_score economic_loss_per_hr')} FROM queue""")
def scoring_run(spark, d):
    """A model saved and loaded, latest rows scored, kept, weighed and ranked in one run."""
    rows = stage(feature_table(spark, d), "features")
    paths = scoring.Paths(*(scratch_path(spark, n) for n in ("model", "threshold", "risk")))
    artifacts.save_model(spark, _small_model(spark, rows), paths.model)
    performance = stage(b.performance(spark, d), "performance")
    return shaped(scoring.run(spark, rows, b.corridors(spark, d), performance, paths))


# --- the whole model, without a twin for its numbers -----------------------

_WHOLE: WeakKeyDictionary[SparkSession, dict[str, tuple]] = WeakKeyDictionary()


def _whole(spark: SparkSession, d: str) -> tuple[Trained, DataFrame, DataFrame]:
    """(model and threshold of all rounds, staged features, later rows): trained once per session and table."""
    held = _WHOLE.setdefault(spark, {})
    if d not in held:
        rows = stage(feature_table(spark, d), "features")
        trained, test = train_and_tune(rows, Params(), CUTOFF)
        path = scratch_path(spark, "model")
        artifacts.save_model(spark, trained.model, path)
        held[d] = Trained(artifacts.load_model(spark, path), trained.threshold), rows, test
    return held[d]


@query("gbt_soft_labels")
def gbt_soft_labels(spark, d):
    """Boosted trees on fractional labels of all features; no SQL twin."""
    trained, _, test = _whole(spark, d)
    return with_probability(test, trained.model).select(
        "corridor_id", "timestamp", F.round("probability", 6).alias("probability"),
        (F.col("probability") >= F.lit(trained.threshold)).cast("bigint").alias("at_risk"),
    )


@query("model_evaluation")
def model_evaluation(spark, d):
    """Reports on the later rows at 0.5 and at the tuned threshold; no SQL twin."""
    trained, _, test = _whole(spark, d)
    default, tuned, _ = evaluate(trained, test)
    both = default.withColumn("at", F.lit("default")).unionByName(tuned.withColumn("at", F.lit("tuned")))
    return shaped(both.select("at", *default.columns))


@query("model_facts", f"""WITH {FEATURES}
  SELECT COUNT(*) FILTER ("timestamp" >= TIMESTAMP '{CUTOFF}') AS scored,
         COUNT(*) FILTER ("timestamp" < TIMESTAMP '{CUTOFF}' AND failure_event IS NOT NULL) AS trained_on,
         CAST(0 AS BIGINT) AS nulls, TRUE AS all_in_range, TRUE AS threshold_is_a_score, TRUE AS beats_the_mean,
         CAST(300 AS BIGINT) AS trees
  FROM features""")
def model_facts(spark, d):
    """M2-M5: what holds of every trained model, whatever its numbers."""
    trained, rows, _ = _whole(spark, d)
    p, y, early = F.col("probability"), F.col(fv.TARGET), F.col("timestamp") < F.lit(CUTOFF).cast("timestamp_ntz")
    learnt = early & y.isNotNull()
    mean = rows.where(learnt).agg(F.avg(fv.TARGET)).head()[0]
    factor = F.when(y >= 1, F.lit(_heavy(rows.where(learnt)))).otherwise(1.0)

    def loss(q):
        return F.sum(F.when(learnt, -factor * (y * F.log(q) + (1 - y) * F.log(1 - q))))

    return shaped(with_probability(rows, trained.model).agg(
        F.count_if(~early).alias("scored"), F.count_if(learnt).alias("trained_on"), F.count_if(p.isNull()).alias("nulls"),
        F.every((p > 0) & (p < 1)).alias("all_in_range"),
        F.coalesce(F.bool_or(learnt & (p == trained.threshold)), F.lit(False)).alias("threshold_is_a_score"),
        (loss(p) < loss(F.lit(mean))).alias("beats_the_mean"),
    ).withColumn("trees", F.lit(len(trained.model.trees)).cast("long")))


def _heavy(rows: DataFrame) -> float:
    ratio = training.class_balance(rows).head().ratio
    return 1.0 if ratio is None else float(ratio)
