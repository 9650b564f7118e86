"""DuckDB SQL that gives the rows of each query, from the same tables."""

from __future__ import annotations

VECTORS = """
v AS (SELECT CAST(vec_id AS VARCHAR) id, CAST(vec_id % 4 AS INTEGER) shard, embedding, vec_id,
  CASE WHEN CAST(embedding[1] AS DOUBLE) + CAST(embedding[2] AS DOUBLE)
       - CAST(embedding[3] AS DOUBLE) > 0 THEN 1 ELSE 0 END label,
  CAST(label < 5 AS INTEGER) hard,
  md5('42:' || CAST(vec_id AS VARCHAR)) key FROM embeddings)"""

VECTOR_SCORES = f"""{VECTORS},
vs AS (SELECT *, 1/(1+exp(-(0.5 + list_sum(list_transform(range(0, 64),
  lambda i: CAST(embedding[i+1] AS DOUBLE) * ((i*7)%13 - 6)))))) score FROM v)"""

ORDERS = """
o AS (SELECT CAST(o_orderkey AS VARCHAR) id, CAST(o_orderkey % 3 AS INTEGER) shard,
  [CAST(o_totalprice / 500000 AS FLOAT), CAST((o_custkey % 97) / 97 AS FLOAT),
   CAST((o_orderkey % 89) / 89 AS FLOAT), CAST(month(o_orderdate) / 12 AS FLOAT),
   CAST(day(o_orderdate) / 31 AS FLOAT), CAST((year(o_orderdate) - 1990) / 12 AS FLOAT),
   CAST(length(o_orderpriority) / 16 AS FLOAT), CAST((o_orderkey % 7) / 7 AS FLOAT)] embedding,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END label,
  md5('42:' || CAST(o_orderkey AS VARCHAR)) key FROM orders)"""

ORDER_SCORES = f"""{ORDERS},
os AS (SELECT *, 1/(1+exp(-(-0.75 + list_sum(list_transform(range(0, 8),
  lambda i: CAST(embedding[i+1] AS DOUBLE) * ([2.0, -3.0, 1.5, 4.0, -2.5, 1.0, -1.0, 0.5])[i+1])))))
  score FROM o),
ot AS (SELECT * REPLACE (round(score, 1) AS score) FROM os)"""

TOTAL = "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) total"
CORRECT = "CASE WHEN (score >= 0.5) = (label = 1) THEN 1 ELSE 0 END"
DISTANCE = """list_sum(list_transform(range(1, 65), lambda i:
  (CAST(embedding[i] AS DOUBLE) - CAST(ce[i] AS DOUBLE))
  * (CAST(embedding[i] AS DOUBLE) - CAST(ce[i] AS DOUBLE))))"""


def _lloyd(shard: str, k: int, steps: int, starts: str = "w") -> str:
    """CTEs: start centres by seeded key, ``steps`` mean steps, then ``a`` the assignment."""
    parts = [
        f"w AS (SELECT *, {shard} part FROM v)",
        f"""c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY key, id) - 1 cluster,
        embedding ce FROM {starts} QUALIFY row_number() OVER (PARTITION BY part ORDER BY key, id) <= {k})""",
    ]
    for step in range(steps + 1):
        name = "a" if step == steps else f"a{step}"
        parts.append(
            f"""{name} AS (SELECT * FROM (SELECT w.*, cluster, {DISTANCE} d
            FROM w JOIN c{step} USING (part))
            QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1)"""
        )
        if step < steps:
            parts.append(
                f"""m{step} AS (SELECT part, cluster, list(x ORDER BY pos) ce FROM (
                SELECT part, cluster, pos, avg(CAST(x AS DOUBLE)) x FROM (
                SELECT part, cluster, unnest(embedding) x, generate_subscripts(embedding, 1) pos
                FROM {name}) GROUP BY ALL) GROUP BY part, cluster)"""
            )
            parts.append(
                f"""c{step + 1} AS (SELECT * FROM m{step} UNION ALL
                SELECT part, cluster, list_transform(ce, lambda x: CAST(x AS DOUBLE))
                FROM c{step} WHERE (part, cluster) NOT IN (SELECT (part, cluster) FROM m{step}))"""
            )
    return ",\n".join(parts)


EIGHT = f"{VECTORS},\n{_lloyd('0', 8, 1)}"
SHARDED = f"{VECTORS},\n{_lloyd('shard', 6, 2)}"
REPS = "QUALIFY row_number() OVER (PARTITION BY part, cluster ORDER BY d, id) = 1"

DISTINCT = """(SELECT * FROM w
  QUALIFY row_number() OVER (PARTITION BY part, embedding ORDER BY key, id) = 1)"""
COPIES = f"""v AS (SELECT i || '-' || vec_id id, embedding, md5('42:' || i || '-' || vec_id) key
  FROM embeddings CROSS JOIN range(0, 5) t(i)), {_lloyd('0', 50, 5, DISTINCT)}"""


def sampled(rows: int, name: str = "l") -> str:
    return f"{name} AS (SELECT * FROM v ORDER BY key, id LIMIT {rows})"


def votes(rows: int) -> str:
    return f"""{sampled(rows)}, vt AS (SELECT a.cluster, count(*) FILTER (a.label = 1) positives,
      count(*) FILTER (a.label <> 1) negatives FROM l JOIN a USING (id) GROUP BY a.cluster)"""


DOCUMENT_ROWS = """
d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 row_index, text,
  CASE WHEN quality = 1 THEN 1 ELSE 0 END label
  FROM documents LEFT JOIN labels USING (doc_id))"""

DAMAGED = f"""{VECTORS},
x AS (SELECT CASE WHEN vec_id % 50 = 0 THEN NULL WHEN vec_id % 41 = 1 THEN '1' ELSE id END id,
  CASE WHEN vec_id % 60 = 1 THEN NULL
    WHEN vec_id % 45 = 2 THEN list_transform(embedding, lambda x, i: CASE WHEN i <> 4 THEN x END)
    WHEN vec_id % 30 = 4 THEN embedding[1:10]
    WHEN vec_id % 70 = 5 THEN CAST([] AS FLOAT[])
    WHEN vec_id % 37 = 6 THEN list_transform(embedding,
      lambda x, i: CASE WHEN i <> 6 THEN x ELSE CAST('inf' AS FLOAT) END)
    ELSE embedding END embedding,
  CASE WHEN vec_id % 33 = 7 THEN 2 WHEN vec_id % 34 = 8 THEN NULL ELSE label END label FROM v)"""

HAS_NULL = "len(list_filter(embedding, lambda x: x IS NULL)) > 0"
WIDTHS = """count(*) FILTER (len(embedding) = 0) zero_width,
  CAST(min(len(embedding)) AS INTEGER) min_width, CAST(max(len(embedding)) AS INTEGER) max_width"""

CURVE = f"""avg({CORRECT}) OVER (PARTITION BY shard ORDER BY abs(score-0.5) DESC, id
  ROWS UNBOUNDED PRECEDING)"""


def evaluated(source: str, group: str) -> str:
    """All measures of one evaluation per ``group``."""

    def band(name: str, low: float, high: float) -> str:
        return f"""count(*) FILTER (score > {low} AND score < {high}) {name}_escalations,
        round(avg(CASE WHEN score <= {low} THEN CASE WHEN label = 0 THEN 1 ELSE 0 END
          WHEN score >= {high} THEN CASE WHEN label = 1 THEN 1 ELSE 0 END ELSE 1 END), 9)
          {name}_final_accuracy"""

    keys = f"{group}," if group else ""
    part = f"PARTITION BY {group}" if group else ""
    tail = f"GROUP BY {group}" if group else ""
    return f"""SELECT {keys} count(*) n_rows, round(avg({CORRECT}), 9) proxy_accuracy,
      round(avg(r), 9) aurac, {band("band_02", 0.2, 0.8)}, {band("band_01", 0.1, 0.9)}
      FROM (SELECT *, avg({CORRECT}) OVER ({part} ORDER BY abs(score-0.5) DESC, id
      ROWS UNBOUNDED PRECEDING) r FROM {source}) {tail}"""


def mean_model(name: str, rows: str, part: str = "0") -> str:
    """``(position, weight)``: mean of label 1 less mean of label 0, averaged over ``part``."""
    return f"""{name} AS (SELECT CAST(pos - 1 AS INTEGER) "position", avg(d) weight FROM (
      SELECT part, pos, coalesce(avg(x) FILTER (label = 1), 0) - coalesce(avg(x) FILTER (label = 0), 0) d
      FROM (SELECT {part} part, label, CAST(unnest(embedding) AS DOUBLE) x,
        generate_subscripts(embedding, 1) pos FROM {rows}) GROUP BY part, pos) GROUP BY pos)"""


def mean_scores(name: str, model: str, rows: str) -> str:
    return f"""{name} AS (SELECT r.*, 1/(1+exp(-list_sum(list_transform(range(1, 65),
      lambda i: CAST(embedding[i] AS DOUBLE) * wl[i])))) score
      FROM {rows} r, (SELECT list(weight ORDER BY "position") wl FROM {model}))"""


def uncertain(name: str, model: str, ledger: str, number: int, rows: int, part: str = "0") -> str:
    """The ``rows`` unlabeled rows per ``part`` nearest to one half under ``model``."""
    return f"""{mean_scores(f'{name}s', model, 'v')}, {name} AS (SELECT * EXCLUDE score, {number} round
      FROM {name}s WHERE id NOT IN (SELECT id FROM {ledger})
      QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY abs(score - 0.5), id) <= {rows})"""


RUN_LEDGER = """n AS (SELECT *, row_number() OVER (ORDER BY key, id) rn FROM v)"""
LEARNED = "SELECT count(*) > 0 learned FROM embeddings"

ORACLES: dict[str, str] = {
    "load_candidates": f"""SELECT CAST(vec_id AS VARCHAR) id, md5(text) text_md5,
      CAST(len(embedding) AS INTEGER) width, {TOTAL}
      FROM embeddings LEFT JOIN documents ON doc_id = vec_id""",
    "load_embeddings_only": f"""SELECT CAST(vec_id AS VARCHAR) id,
      CAST(len(embedding) AS INTEGER) width, {TOTAL} FROM embeddings""",
    "read_labeled_csv": f"WITH {DOCUMENT_ROWS} SELECT row_index, md5(text) text_md5, label FROM d",
    "positional_row_number": f"""WITH {DOCUMENT_ROWS}
      SELECT row_index, CAST(length(text) AS INTEGER) chars FROM d""",
    "attach_embeddings": f"""SELECT CAST(o_orderkey AS VARCHAR) id, o_orderpriority text,
      CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END label, {TOTAL} FROM
      (SELECT * FROM embeddings ORDER BY vec_id
       LIMIT (SELECT count(*) * 3 // 4 FROM embeddings)) e
      JOIN orders ON o_orderkey = vec_id * 2""",
    "write_examples": f"""WITH {VECTORS} SELECT id, md5(coalesce(text, '')) text_md5, label, {TOTAL}
      FROM v LEFT JOIN documents ON doc_id = vec_id""",
    "label_ledger": f"""WITH {VECTORS}, {RUN_LEDGER}
      SELECT id, label, shard, CASE WHEN rn <= 20 THEN 0 ELSE 1 END round FROM n WHERE rn <= 40""",
    "model_artifact": """SELECT 'easy' run_id, CAST(max(len(embedding)) AS INTEGER) width,
      true finite, true equal FROM embeddings""",
    "sweep_report": """SELECT 'vectors' dataset, sampler, training_data_mode,
      CAST(16 AS BIGINT) label_budget, CAST(r AS BIGINT) rounds, CAST(42 AS BIGINT) seed,
      (SELECT count(*) FROM embeddings) "rows",
      CAST((SELECT max(len(embedding)) FROM embeddings) AS INTEGER) embedding_dimensions,
      CAST(16 AS BIGINT) phase_a_labels, true data_setup_ms, true proxy_scoring_ms,
      true phase_a_total_ms, true initial_sampling_ms, true initial_fetching_ms,
      true initial_labeling_ms, true initial_training_ms, true recursive_sampling_ms,
      true recursive_fetching_ms, true recursive_labeling_ms, true recursive_training_ms, true calls
      FROM (VALUES ('random', 'direct', 1), ('cluster', 'direct', 1),
        ('cluster', 'cluster_propagation', 1), ('random', 'direct', 2))
        m(sampler, training_data_mode, r)""",
    "filter_nonnull_id": f"WITH {VECTORS} SELECT id FROM v WHERE vec_id % 7 <> 0",
    "pool_columns": f"WITH {VECTORS} SELECT id, {TOTAL} FROM v",
    "validate_candidates": f"""WITH {DAMAGED} SELECT count(*) n_rows,
      count(*) FILTER (id IS NULL) null_id, count(*) FILTER (embedding IS NULL) null_embedding,
      count(*) FILTER ({HAS_NULL}) null_element, {WIDTHS},
      count(id) - count(DISTINCT id) duplicate_id FROM x""",
    "validate_labeled_examples": f"""WITH {DAMAGED} SELECT count(*) n_rows,
      count(*) FILTER (label = 1) positives,
      count(*) FILTER (label IS NULL OR label NOT IN (0, 1)) bad_label,
      count(*) FILTER (embedding IS NULL) null_embedding,
      count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0)
        not_finite, {WIDTHS} FROM x""",
    "validate_selection": f"""WITH {VECTORS}, {sampled(30)}, {sampled(5, "again")},
      u AS (SELECT id FROM l UNION ALL SELECT id FROM again)
      SELECT count(*) n_rows, count(*) - count(DISTINCT id) duplicate_id,
      CAST(greatest(count(*) - 25, 0) AS BIGINT) over_budget FROM u""",
    "validate_labels": f"""WITH {VECTORS}, {sampled(30)}, {sampled(40, "ll")},
      b AS (SELECT * FROM ll WHERE right(id, 1) <> '3'),
      t AS (SELECT id, label FROM b UNION ALL SELECT id, label FROM b WHERE right(id, 1) = '1'),
      g AS (SELECT id, count(*) n, count(*) FILTER (label IS NULL) z FROM t GROUP BY id)
      SELECT count(l.id) selected, CAST(coalesce(sum(n), 0) AS BIGINT) returned,
      count(*) FILTER (n IS NULL) missing, count(*) FILTER (l.id IS NULL) unexpected,
      count(*) FILTER (n > 1) repeated, CAST(coalesce(sum(z), 0) AS BIGINT) null_label
      FROM g FULL JOIN l ON g.id = l.id""",
    "validate_run_config": """SELECT p_partkey,
      CASE WHEN p_size % 4 <= 0 THEN 1 ELSE 0 END + CASE WHEN p_size - 5 <= 0 THEN 1 ELSE 0 END
      + CASE WHEN p_retailprice / 1000 <= 0 OR p_retailprice / 1000 > 1 THEN 1 ELSE 0 END
      + CASE WHEN p_size / 45.0 > 1 THEN 1 ELSE 0 END
      + CASE WHEN p_size % 9 = 0 OR p_size / 60.0 > 1 THEN 1 ELSE 0 END violations FROM part""",
    "fetch_by_ids": f"WITH {VECTORS}, {sampled(50)} SELECT id, label, {TOTAL} FROM l",
    "exclude_labeled": f"""WITH {VECTORS}, {sampled(50)}
      SELECT id, label FROM v WHERE id NOT IN (SELECT id FROM l)""",
    "fetch_by_ids_large": f"""WITH {ORDERS} SELECT id, label, {TOTAL} FROM o ORDER BY key, id
      LIMIT (SELECT count(*) // 10 FROM orders)""",
    "exclude_labeled_large": f"""WITH {ORDERS} SELECT id, label FROM o
      QUALIFY row_number() OVER (ORDER BY key, id) > count(*) OVER () // 10""",
    "assign_join": f"""WITH {EIGHT}, {sampled(60)} SELECT id, CAST(cluster AS INTEGER) cluster,
      l.label FROM l JOIN a USING (id) WHERE cluster < 6""",
    "covered_clusters": f"""WITH {EIGHT}, {votes(3)} SELECT id, CAST(cluster AS INTEGER) cluster,
      positives, negatives FROM a JOIN vt USING (cluster)""",
    "label_lookup": f"WITH {VECTORS} SELECT id, shard, hard label FROM v",
    "cluster_votes": f"""WITH {EIGHT}, {sampled(60)} SELECT CAST(cluster AS INTEGER) cluster,
      count(*) FILTER (l.label = 1 AND l.vec_id % 11 <> 0) positives,
      count(*) FILTER (l.label <> 1 OR l.vec_id % 11 = 0) negatives
      FROM l JOIN a USING (id) GROUP BY cluster""",
    "majority_label": f"""WITH {EIGHT}, {votes(60)} SELECT CAST(cluster AS INTEGER) cluster,
      CASE WHEN positives >= negatives THEN 1 ELSE 0 END label FROM vt""",
    "proxy_accuracy": f"""WITH {VECTOR_SCORES}
      SELECT shard, round(avg({CORRECT}), 9) proxy_accuracy FROM vs GROUP BY shard""",
    "cascade_summary": f"""WITH {VECTOR_SCORES}, b(reject, accept) AS (VALUES
      (CAST(0.2 AS DOUBLE), CAST(0.8 AS DOUBLE)), (CAST(0.1 AS DOUBLE), CAST(0.9 AS DOUBLE)))
      SELECT reject, accept, count(*) FILTER (score > reject AND score < accept) escalations,
      round(avg(CASE WHEN score <= reject THEN 1 - label WHEN score >= accept THEN label ELSE 1 END),
        9) final_accuracy FROM vs CROSS JOIN b GROUP BY reject, accept""",
    "run_totals": """SELECT CAST(l_orderkey AS VARCHAR) run_id,
      CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) phase_a_labels,
      round(sum(CASE WHEN l_linenumber = 1 THEN l_discount ELSE 0 END), 6) initial_sampling_s,
      round(sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_discount END), 6) recursive_sampling_s,
      round(sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END), 6) initial_fetching_s,
      round(sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_quantity END), 6) recursive_fetching_s,
      round(sum(CASE WHEN l_linenumber = 1 THEN l_tax ELSE 0 END), 6) initial_labeling_s,
      round(sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_tax END), 6) recursive_labeling_s,
      round(sum(CASE WHEN l_linenumber = 1 THEN l_extendedprice / 1000 ELSE 0 END), 6)
        initial_training_s,
      round(sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_extendedprice / 1000 END), 6)
        recursive_training_s FROM lineitem GROUP BY l_orderkey""",
    "risk_coverage_curve": f"""WITH {VECTOR_SCORES} SELECT id,
      row_number() OVER (ORDER BY abs(score-0.5) DESC, id) kept,
      round(row_number() OVER (ORDER BY abs(score-0.5) DESC, id) / (SELECT count(*) FROM vs), 9)
        coverage,
      round(avg({CORRECT}) OVER (ORDER BY abs(score-0.5) DESC, id ROWS UNBOUNDED PRECEDING), 9)
        accuracy FROM vs""",
    "risk_coverage_curve_tied": f"""WITH {ORDER_SCORES} SELECT shard, id,
      row_number() OVER (PARTITION BY shard ORDER BY abs(score-0.5) DESC, id) kept,
      round(row_number() OVER (PARTITION BY shard ORDER BY abs(score-0.5) DESC, id)
        / count(*) OVER (PARTITION BY shard), 9) coverage,
      round({CURVE}, 9) accuracy FROM ot""",
    "aurac": f"""WITH {ORDER_SCORES} SELECT round(avg(r), 9) aurac FROM (SELECT avg({CORRECT})
      OVER (ORDER BY abs(score-0.5) DESC, id ROWS UNBOUNDED PRECEDING) r FROM os)""",
    "cluster_representatives": f"""WITH {EIGHT}
      SELECT CAST(cluster AS INTEGER) cluster, id FROM a {REPS}""",
    "sample_random": f"WITH {ORDERS} SELECT id FROM o ORDER BY key, id LIMIT 200",
    "sample_random_large": f"""WITH {ORDERS} SELECT id FROM o ORDER BY key, id
      LIMIT (SELECT count(*) // 10 FROM orders)""",
    "subset_representatives": f"""WITH {EIGHT} SELECT id FROM (SELECT id, key FROM a {REPS})
      ORDER BY key, id LIMIT 5""",
    "select_uncertain": f"""WITH {VECTOR_SCORES}, {sampled(20)}
      SELECT id, round(u, 9) u FROM (SELECT id, least(abs(score-0.2), abs(score-0.8)) u FROM vs
      WHERE id NOT IN (SELECT id FROM l)) ORDER BY u, id LIMIT 25""",
    "select_uncertain_large": f"""WITH {ORDER_SCORES} SELECT id, round(abs(score-0.5), 9) u FROM os
      ORDER BY abs(score-0.5), id LIMIT (SELECT count(*) // 10 FROM orders)""",
    "select_uncertain_orders": f"""WITH {ORDER_SCORES} SELECT id, round(u, 9) u FROM
      (SELECT id, abs(score-0.5) u FROM os ORDER BY abs(score-0.5), id LIMIT 100)""",
    "shard_top_k": f"""WITH {VECTOR_SCORES} SELECT id, shard FROM (SELECT id, shard,
      least(abs(score-0.2), abs(score-0.8)) u FROM vs)
      QUALIFY row_number() OVER (PARTITION BY shard ORDER BY u, id)
      <= 22 // 4 + CASE WHEN shard < 22 % 4 THEN 1 ELSE 0 END""",
    "pool_batches": f"""WITH {VECTORS} SELECT id, shard, label FROM v
      QUALIFY row_number() OVER (PARTITION BY shard ORDER BY key, id)
      <= 30 // 4 + CASE WHEN shard < 30 % 4 THEN 1 ELSE 0 END""",
    "accumulate_labels": f"""WITH {VECTORS}, {RUN_LEDGER}
      SELECT CASE WHEN rn <= 20 THEN 0 ELSE 1 END round, count(*) labels,
      CAST(sum(label) AS BIGINT) positives FROM n WHERE rn <= 40 GROUP BY 1""",
    "predict_probability": f"WITH {VECTOR_SCORES} SELECT id, round(score, 9) score FROM vs",
    "predict_probability_orders": f"WITH {ORDER_SCORES} SELECT id, round(score, 9) score FROM os",
    "stable_sigmoid": """SELECT o_orderkey, round(CASE WHEN z >= 0 THEN 1 / (1 + exp(-z))
      ELSE exp(z) / (1 + exp(z)) END, 9) p
      FROM (SELECT o_orderkey, (o_totalprice - 250000) / 250 z FROM orders)""",
    "squared_distance": f"WITH {EIGHT} SELECT id, round(d, 9) distance FROM a",
    "seeded_hash": f"WITH {ORDERS} SELECT id, key FROM o",
    "zone": f"""WITH {VECTOR_SCORES} SELECT id, CASE WHEN score <= 0.2 THEN 'reject'
      WHEN score >= 0.8 THEN 'accept' ELSE 'escalate' END zone FROM vs""",
    "streaming_scores": f"""WITH {VECTOR_SCORES} SELECT id, CASE WHEN score <= 0.2 THEN 'reject'
      WHEN score >= 0.8 THEN 'accept' ELSE 'escalate' END zone, round(score, 9) score FROM vs""",
    "projected_latency": f"""WITH {ORDER_SCORES}, b(reject, accept) AS (VALUES
      (CAST(0.2 AS DOUBLE), CAST(0.8 AS DOUBLE)), (CAST(0.1 AS DOUBLE), CAST(0.9 AS DOUBLE))),
      t AS (SELECT shard, reject, 200 + count(*) FILTER (score > reject AND score < accept)
        total_calls FROM os CROSS JOIN b GROUP BY shard, reject)
      SELECT *, round(total_calls / 75, 9) hosted_seconds,
      round(total_calls / 250, 9) server_seconds, round(total_calls / 1800, 9) inprocess_seconds
      FROM t""",
    "kmeans_partition": """SELECT count(*) n_rows, CAST(12 AS BIGINT) clusters,
      count(*) > 0 centred FROM embeddings""",
    "nearest_centroid": f"""WITH {EIGHT}
      SELECT id, CAST(cluster AS INTEGER) cluster, round(d, 9) distance FROM a""",
    "train_logistic": """SELECT CAST(i AS INTEGER) "position", true flat, true learned
      FROM range(0, (SELECT max(len(embedding)) + 1 FROM embeddings)) t(i)""",
    "train_logistic_optimum": """SELECT CAST(i AS INTEGER) "position",
      (SELECT count(*) > 0 FROM orders) flat FROM range(0, 9) t(i)""",
    "direct_training_set": f"WITH {VECTORS}, {sampled(60)} SELECT id, label, {TOTAL} FROM l",
    "propagated_training_set": f"""WITH {EIGHT}, {votes(3)} SELECT id,
      CASE WHEN positives >= negatives THEN 1 ELSE 0 END label, {TOTAL}
      FROM a JOIN vt USING (cluster)""",
    "propagated_from_table": f"""WITH {EIGHT}, {votes(3)} SELECT id,
      CASE WHEN positives >= negatives THEN 1 ELSE 0 END label FROM a JOIN vt USING (cluster)""",
    "round_budget": """WITH s AS (SELECT source, count(*) budget FROM documents GROUP BY source),
      f AS (SELECT *, CAST(greatest(1, least(budget, floor(budget * 0.3))) AS BIGINT) f FROM s),
      r AS (SELECT source, budget, CAST(i AS INTEGER) round, CASE WHEN i = 0 THEN f ELSE
        (budget - f) // 3 + CASE WHEN i - 1 < (budget - f) % 3 THEN 1 ELSE 0 END END requested
        FROM f CROSS JOIN range(0, 4) t(i))
      SELECT source, budget, round, CAST(requested AS BIGINT) requested FROM r
      WHERE requested > 0""",
    "shard_budget": """SELECT c_mktsegment, CAST(i AS INTEGER) shard,
      count(*) // 7 + CASE WHEN i < count(*) % 7 THEN 1 ELSE 0 END quota
      FROM customer CROSS JOIN range(0, 7) t(i) GROUP BY c_mktsegment, i""",
    "run_proxy_training": f"""WITH {VECTORS}, {sampled(30)}, l0 AS (SELECT *, 0 round FROM l),
      {mean_model('w0', 'l0')}, {uncertain('u1', 'w0', 'l0', 1, 15)},
      l1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM u1),
      {mean_model('w1', 'l1')}, {uncertain('u2', 'w1', 'l1', 2, 15)}
      SELECT id, label, round FROM l1 UNION ALL SELECT id, label, round FROM u2""",
    "run_sharded_text": f"""WITH {SHARDED}
      SELECT id, 's' || shard region, label, 0 round FROM a {REPS}""",
    "random_sharded": f"""WITH {VECTORS} SELECT id, shard, label FROM v
      QUALIFY row_number() OVER (PARTITION BY shard ORDER BY key, id)
      <= 26 // 4 + CASE WHEN shard < 26 % 4 THEN 1 ELSE 0 END""",
    "kmeans_copies": f"""WITH {COPIES}, s AS (SELECT cluster, count(*) in_cluster FROM a GROUP BY cluster),
      t AS (SELECT count(*) clusters, CAST(sum(in_cluster) AS BIGINT) n_rows,
        CAST(sum(in_cluster % 5) AS BIGINT) parted FROM s)
      SELECT id, CAST(cluster AS INTEGER) cluster, in_cluster, clusters, n_rows, parted
      FROM (SELECT id, cluster FROM a {REPS}) JOIN s USING (cluster) CROSS JOIN t""",
    "run_sharded_central": f"""WITH {SHARDED}
      SELECT id, shard, label, 0 round FROM a {REPS}""",
    "round_report": """SELECT 'gc1rec' run_id, CAST(i AS INTEGER) round, n requested,
      least(n, count(*)) acquired, true fetched
      FROM embeddings CROSS JOIN (VALUES (0, 20::BIGINT), (1, 7), (2, 7), (3, 6)) t(i, n) GROUP BY i, n""",
    "model_broadcast": f"""WITH {VECTORS}, sent AS (
      SELECT shard, CAST(vec_id // 4 % 5 AS INTEGER) model_round, unnest(embedding) x,
        generate_subscripts(embedding, 1) pos FROM v WHERE (shard + vec_id // 4 % 5) % 3 <> 0),
      mean AS (SELECT shard, model_round, pos, avg(CAST(x AS DOUBLE)) m FROM sent GROUP BY ALL),
      model AS (SELECT shard, model_round, list(m ORDER BY pos) w FROM mean GROUP BY ALL),
      asked AS (SELECT id, shard, embedding, CAST(vec_id % 7 - 1 AS INTEGER) round FROM v)
      SELECT a.id, a.shard, a.round, m.model_round,
        round(1 / (1 + exp(-(m.model_round / 10 + list_sum(list_transform(range(1, 65),
          lambda i: CAST(a.embedding[i] AS DOUBLE) * m.w[i]))))), 9) score
      FROM asked a ASOF LEFT JOIN model m ON a.shard = m.shard AND a.round >= m.model_round""",
    "evaluate_proxy": f"WITH {VECTOR_SCORES} {evaluated('vs', '')}",
    "evaluate_proxy_orders": f"WITH {ORDER_SCORES} {evaluated('os', 'shard')}",
    "run_sweep": f"""WITH {VECTORS}, m AS (SELECT 'm' || i run_id, id, label,
      1/(1+exp(-(i / 8 + list_sum(list_transform(range(0, 64),
        lambda j: CAST(embedding[j+1] AS DOUBLE) * (((j*7)%13 - 6) * (1 - i / 10))))))) score
      FROM v CROSS JOIN range(0, 20) t(i))
      {evaluated('m', 'run_id')}""",
    "Sampler": f"""WITH {VECTORS} SELECT id FROM v ORDER BY md5('7:' || id), id LIMIT 40""",
    "cluster_sampler": f"""WITH {SHARDED}, p AS (SELECT * FROM a {REPS})
      SELECT id, shard FROM p QUALIFY row_number() OVER (PARTITION BY shard ORDER BY key, id)
      <= 10 // 4 + CASE WHEN shard < 10 % 4 THEN 1 ELSE 0 END""",
    "Labeler": f"""WITH {VECTORS} SELECT id,
      CASE WHEN length(coalesce(text, '')) % 2 = 0 THEN 1 ELSE 0 END label
      FROM v LEFT JOIN documents ON doc_id = vec_id""",
    "FunctionLabeler": """SELECT CAST((length(text) - length(replace(text, 'e', ''))) % 2 AS INTEGER)
      label, count(*) n_rows FROM documents GROUP BY 1""",
    "labeler_log": """SELECT CAST((length(text) - length(replace(text, 'e', ''))) % 2 AS INTEGER)
      label, count(*) n_rows FROM documents GROUP BY 1""",
    "TrainingDataBuilder": f"""WITH {VECTORS}, t AS (SELECT * REPLACE (
      CASE WHEN embedding[6] > 0 THEN 1 ELSE 0 END AS label) FROM v), {mean_model('w', 't')}
      SELECT "position", round(weight, 9) weight, 0.0::DOUBLE intercept FROM w""",
    "semantic_filter": f"""WITH {VECTOR_SCORES} SELECT id,
      CASE WHEN score >= 0.8 THEN 'accept' ELSE 'escalate' END zone, round(score, 9) score
      FROM vs WHERE score >= 0.8 OR (score > 0.2 AND label = 1)""",
    "semantic_filter_trained": f"""WITH {VECTORS}, {sampled(100)}, {mean_model('w', 'l')},
      {mean_scores('s', 'w', 'v')} SELECT id,
      CASE WHEN score >= 0.52 THEN 'accept' ELSE 'escalate' END zone, round(score, 9) score
      FROM s WHERE score >= 0.52 OR (score > 0.48 AND label = 1)""",
    "semantic_filter_text": f"""WITH {VECTOR_SCORES} SELECT id,
      CASE WHEN score >= 0.8 THEN 'accept' ELSE 'escalate' END zone
      FROM vs LEFT JOIN documents ON doc_id = vec_id
      WHERE score >= 0.8 OR (score > 0.2 AND length(coalesce(text, '')) % 3 = 0)""",
    "lc2_local_propagation": f"""WITH {SHARDED}, p AS (SELECT * FROM a {REPS}),
      l AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY shard ORDER BY key, id) <= 3),
      vt AS (SELECT part, cluster, count(*) FILTER (label = 1) y, count(*) FILTER (label <> 1) n
        FROM l GROUP BY part, cluster)
      SELECT id, shard, CASE WHEN y >= n THEN 1 ELSE 0 END label
      FROM a JOIN vt USING (part, cluster)""",
    "federated_train": f"""WITH {VECTORS}, {mean_model('w', 'v', 'shard')}
      SELECT "position", round(weight, 9) weight, 0.0::DOUBLE intercept FROM w""",
    "federated_logistic": LEARNED,
    "federated_average": f"""WITH {VECTORS}, p AS (SELECT shard, unnest(embedding) x,
      generate_subscripts(embedding, 1) - 1 pos FROM v),
      m AS (SELECT shard, pos, avg(CAST(x AS DOUBLE)) m FROM p GROUP BY shard, pos)
      SELECT CAST(pos AS INTEGER) "position", round(avg(m), 9) weight,
      round(avg(shard / 2.0), 9) intercept FROM m GROUP BY pos""",
    "recursive_shards": """SELECT round, CAST(vec_id % 4 AS INTEGER) shard,
      CAST(max(share) AS BIGINT) labels, CAST(max(share) AS BIGINT) ids
      FROM embeddings CROSS JOIN (VALUES (0, 4), (1, 2), (2, 2)) t(round, share) GROUP BY 1, 2""",
    "naurac": f"""WITH {ORDER_SCORES}, t AS (SELECT shard, avg(r) aurac, count(*) n,
      count(*) FILTER (label = 1) k FROM (SELECT *, {CURVE} r FROM os) GROUP BY shard),
      i AS (SELECT *, k / n base,
        (k + k * (SELECT sum(1.0::DOUBLE / j) FROM range(1, 1000000) h(j) WHERE j > k AND j <= n))
        / n ideal FROM t)
      SELECT shard, round(aurac, 9) aurac, round(base, 9) base_rate, round(ideal, 9) oracle_aurac,
      round((aurac - base) / (ideal - base), 9) naurac FROM i""",
    "auc": f"""WITH {ORDER_SCORES}, k AS (SELECT shard, label,
      rank() OVER (PARTITION BY shard ORDER BY score) rk,
      count(*) OVER (PARTITION BY shard, score) g FROM ot)
      SELECT shard, round((sum(CASE WHEN label = 1 THEN rk + (g-1)/2 ELSE 0 END)
        - sum(label) * (sum(label)+1) / 2) / (sum(label) * (count(*) - sum(label))), 9) auc
      FROM k GROUP BY shard""",
    "score_separation": f"""WITH {ORDER_SCORES} SELECT shard, round(avg(score) FILTER (label = 1)
      - avg(score) FILTER (label = 0), 9) separation FROM os GROUP BY shard""",
    "zone_report": f"""WITH {ORDER_SCORES} SELECT zone, n_rows, round(c, 9) correctness,
      round(n_rows / sum(n_rows) OVER (), 9) mass FROM (SELECT
      CASE WHEN score <= 0.2 THEN 'reject' WHEN score >= 0.8 THEN 'accept' ELSE 'escalate' END zone,
      count(*) n_rows, avg({CORRECT}) c FROM os GROUP BY 1)""",
    "accuracy_at_budget": f"""WITH {ORDER_SCORES},
      q AS (SELECT {CORRECT} c, row_number() OVER (ORDER BY abs(score-0.5) DESC, id) rk FROM os),
      n AS (SELECT count(*) n FROM q),
      b AS (SELECT CAST(budget AS DOUBLE) budget, CAST(CASE WHEN budget > 0 AND budget < 1
        THEN floor(n * CAST(budget AS DOUBLE)) ELSE least(budget, n) END AS BIGINT) escalated, n
        FROM (VALUES (0), (100), (1000000000), (0.05), (0.3)) t(budget) CROSS JOIN n)
      SELECT budget, escalated, round((escalated + (SELECT coalesce(sum(c), 0) FROM q
      WHERE rk <= n - escalated)) / n, 9) accuracy FROM b""",
    "call_reduction_at_fnr": f"""WITH {ORDER_SCORES},
      g AS (SELECT score, count(*) c, count(*) FILTER (label = 1) p FROM ot GROUP BY score),
      w AS (SELECT score, sum(c) OVER (ORDER BY score) - c below,
        sum(p) OVER (ORDER BY score) - p pos, sum(c) OVER () n, sum(p) OVER () k FROM g)
      SELECT CAST(alpha AS DOUBLE) alpha, round(max(score), 9) threshold,
      round(max(below / n), 9) reduction
      FROM (VALUES (0.01), (0.05), (0.1), (0.5)) t(alpha) JOIN w
      ON pos <= CAST(alpha AS DOUBLE) * k GROUP BY alpha""",
    "certainty_mass": f"""WITH {ORDER_SCORES} SELECT shard,
      round(avg(CASE WHEN abs(score-0.5) >= 0.2 THEN 1 ELSE 0 END), 9) certainty_mass
      FROM os GROUP BY shard""",
    "confusion_report": f"""WITH {ORDER_SCORES}, c AS (SELECT shard,
      count(*) FILTER (score >= 0.5 AND label = 1) tp, count(*) FILTER (score >= 0.5 AND label = 0) fp,
      count(*) FILTER (score < 0.5 AND label = 1) fn, count(*) FILTER (score < 0.5 AND label = 0) tn
      FROM os GROUP BY shard)
      SELECT *, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) recall,
      round((tp + tn) / (tp + fp + fn + tn), 9) accuracy FROM c""",
    "score_dump_join": f"WITH {VECTOR_SCORES} SELECT id, round(score, 9) score, label FROM vs",
    "calibrate_band": f"""WITH {ORDER_SCORES}, f AS (SELECT score, abs(score-0.5) c FROM ot),
      g AS (SELECT c, count(*) m FROM f GROUP BY c),
      w AS (SELECT c, sum(m) OVER (ORDER BY c) - m below FROM g),
      b AS (SELECT budget, max(c) FILTER (below <= budget AND budget < (SELECT count(*) FROM f)) cut
        FROM (VALUES (10), (2000), (6000), (1000000000)) t(budget) CROSS JOIN w GROUP BY budget)
      SELECT CAST(budget AS BIGINT) budget,
      round(coalesce((SELECT max(score) FROM f WHERE c >= cut AND score < 0.5), -1), 9) reject,
      round(coalesce((SELECT min(score) FROM f WHERE c >= cut AND score >= 0.5), 2), 9) accept,
      (SELECT count(*) FROM f WHERE cut IS NULL OR c < cut) escalations FROM b""",
    "seed_average": """SELECT cell, setting, rank, round(mean_, 9) mean FROM (SELECT cell, setting,
      avg(q) mean_, CAST(rank() OVER (PARTITION BY cell ORDER BY avg(q) DESC) AS INTEGER) rank
      FROM (SELECT l_suppkey % 36 cell, l_returnflag setting, l_quantity q FROM lineitem)
      GROUP BY cell, setting)""",
    "seed_wins": """SELECT setting, count(*) FILTER (rank = 1) wins FROM (SELECT cell, setting,
      rank() OVER (PARTITION BY cell ORDER BY avg(q) DESC) rank
      FROM (SELECT l_suppkey % 36 cell, l_returnflag setting, l_quantity q FROM lineitem)
      GROUP BY cell, setting) GROUP BY setting""",
}


def strategy(
    shard: str, clusters: int, first: int, later: int, spread: bool, averaged: bool
) -> str:
    """``first`` representatives per shard, trained on as they are or ``spread`` over their
    clusters, with models ``averaged`` over shards; then ``later`` uncertain rows per shard, if any,
    else the model."""
    part = "shard" if averaged else "0"
    training = "SELECT shard, embedding, label FROM l"
    if spread:
        training = """SELECT a.shard, a.embedding, CASE WHEN y >= n THEN 1 ELSE 0 END label
          FROM a JOIN (SELECT part, cluster, count(*) FILTER (label = 1) y,
            count(*) FILTER (label <> 1) n FROM l GROUP BY part, cluster) USING (part, cluster)"""
    start = f"""WITH {VECTORS}, {_lloyd(shard, clusters, 2)}, p AS (SELECT * FROM a {REPS}),
      l AS (SELECT * FROM p
        QUALIFY row_number() OVER (PARTITION BY part ORDER BY key, id) <= {first}),
      t AS ({training}), {mean_model('m', 't', part)}"""
    if not later:
        return f"""{start} SELECT "position", round(weight, 9) weight, 0.0::DOUBLE intercept FROM m"""
    return f"""{start}, {uncertain('u', 'm', 'l', 1, later, shard)}
      SELECT id, CAST({shard} AS INTEGER) shard, label, 0 round FROM l
      UNION ALL SELECT id, CAST({shard} AS INTEGER), label, round FROM u"""


for _kind in (1, 2, 3, 4):
    _how = {"spread": _kind in (2, 4), "averaged": _kind in (3, 4)}
    if _kind > 1:
        ORACLES[f"lc{_kind}"] = strategy("shard", 6, 6, 0, **_how)
    ORACLES[f"lc{_kind}rec"] = strategy("shard", 6, 3, 3, **_how)
ORACLES["gc1"] = strategy("0", 24, 24, 0, False, False)
ORACLES["gc2"] = strategy("0", 24, 24, 0, True, False)
ORACLES["gc2rec"] = strategy("0", 24, 12, 12, True, False)
