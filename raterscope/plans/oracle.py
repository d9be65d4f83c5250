"""The registered queries in ANSI SQL as DuckDB runs it, from the same tables."""

from __future__ import annotations

_SUPPLIER = "SELECT l_suppkey AS user_id, l_partkey AS movie_id, ceil(l_quantity / 10.0)::DOUBLE AS rating FROM lineitem"
_CUSTOMER = (
    "SELECT o_custkey AS user_id, p_name AS movie, l_partkey AS movie_id, ceil(l_quantity / 10.0)::DOUBLE AS rating "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"
)
_EVENT_USER = (
    "SELECT user_id, event_type AS movie, event_id AS movie_id, "
    "least(5.0, 1.0 + floor(value / 25.0))::DOUBLE AS rating FROM events"
)
# Fixed values, as in ``operators.sampling``.
_TEMPERATURES = "[1.0::DOUBLE, 0.8::DOUBLE, 0.5::DOUBLE, 0.25::DOUBLE, 0.1::DOUBLE, 0.01::DOUBLE]"
# The columns of ``schemas``.
_STATISTICS = (
    "mean_rating",
    "median_rating",
    "mode_rating",
    "sd_rating",
    "max_rating",
    "min_rating",
    "iqr_rating",
    "kurtosis_rating",
    "skewness_rating",
    "entropy_rating",
)
_PLOT = ("mode_rating", "mean_rating", "kurtosis_rating", "iqr_rating", "entropy_rating")


def _r(expression: str, name: str | None = None) -> str:
    return f"round(({expression})::DOUBLE + 1e-9, 6) + 0.0 AS {name or expression}"


def _key(seed: int, *columns: str) -> str:
    return f"md5(concat_ws('|', {seed}, {', '.join(columns)}))"


def _head(key: str) -> str:
    return f"('0x' || substr({key}, 1, 8))::BIGINT"


def _temperature() -> str:
    head = _head(_key(42, "'temperature'", "user_id"))
    return f"{_TEMPERATURES}[1 + {head} % 6]"


def _moments(rating: str) -> str:
    r = rating
    skew = (
        f"(avg({r}*{r}*{r}) - 3*avg({r})*avg({r}*{r}) + 2*avg({r})*avg({r})*avg({r}))"
        f" / (stddev_pop({r})*stddev_pop({r})*stddev_pop({r}))"
    )
    return (
        f"stddev_samp({r}) AS sd_rating, "
        f"CASE WHEN min({r}) < max({r}) THEN kurtosis_pop({r}) END AS kurtosis_rating, "
        f"CASE WHEN min({r}) < max({r}) THEN {skew} END AS skewness_rating"
    )


def _stats(source: str, name: str) -> str:
    """CTEs ending in ``name``: the ten statistics of each rater with defined ones only."""
    return f"""
{name}_h AS (SELECT user_id, rating, count(*) AS n FROM ({source}) GROUP BY ALL),
{name}_m AS (SELECT user_id, rating AS mode_rating FROM {name}_h
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, rating) = 1),
{name}_t AS (SELECT *, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS p FROM {name}_h),
{name}_e AS (SELECT user_id, sum(-p * ln(p)) AS entropy_rating FROM {name}_t GROUP BY user_id),
{name}_s AS (SELECT user_id, avg(rating) AS mean_rating, quantile_disc(rating, 0.5) AS median_rating,
  max(rating) AS max_rating, min(rating) AS min_rating,
  quantile_disc(rating, 0.75) - quantile_disc(rating, 0.25) AS iqr_rating, {_moments("rating")}
  FROM ({source}) GROUP BY user_id),
{name} AS (SELECT user_id, {", ".join(_STATISTICS)} FROM {name}_s JOIN {name}_m USING (user_id)
  JOIN {name}_e USING (user_id)
  WHERE sd_rating IS NOT NULL AND kurtosis_rating IS NOT NULL AND skewness_rating IS NOT NULL)"""


_ROUNDED_STATISTICS = ", ".join(_r(s) for s in _STATISTICS)


def _labelled(n_human: int | None = None) -> str:
    """CTE chain ending in ``d``."""
    keep = ""
    if n_human is not None:
        head = _head(_key(42, "user_id"))
        keep = f"WHERE {head} / 4294967296.0::DOUBLE < {n_human}.0::DOUBLE / (SELECT count(*) FROM human)"
    return f"""WITH {_stats(_CUSTOMER, "human")}, {_stats(_EVENT_USER, "machine")},
d AS (SELECT (user_id::VARCHAR || '0')::BIGINT AS user_id, {_ROUNDED_STATISTICS}, 0 AS ai_label FROM human {keep}
  UNION ALL
  SELECT (user_id::VARCHAR || '1')::BIGINT AS user_id, {_ROUNDED_STATISTICS}, 1 AS ai_label FROM machine)"""


def _ranked(seed: int = 42) -> str:
    """CTE chain ending in ``k``: the labelled table with class rank and the smallest class size."""
    return f"""{_labelled()},
k AS (SELECT *, row_number() OVER (PARTITION BY ai_label ORDER BY {_key(seed, "user_id")}) AS class_rank,
  (SELECT min(n) FROM (SELECT count(*) AS n FROM d GROUP BY ai_label)) AS smallest FROM d)"""


def _balanced() -> str:
    return f"{_ranked()}, b AS (SELECT *, ((class_rank - 1) % 6)::INT AS fold FROM k WHERE class_rank <= smallest)"


def _scored() -> str:
    return f"""{_ranked(7)},
s AS (SELECT ((class_rank - 1) % 6)::INT AS fold, user_id, ai_label AS label, kurtosis_rating AS score,
  CASE WHEN kurtosis_rating > -1 THEN 1 ELSE 0 END AS prediction FROM k)"""


def _areas(by: str) -> str:
    """CTEs after ``s``: area per value of ``by`` from mid-ranks."""
    part = f"PARTITION BY {by}" if by else ""
    select = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
r AS (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {select}score) - 1) / 2.0 AS mid FROM s),
a AS (SELECT {select}sum(label)::BIGINT AS n_pos, (count(*) - sum(label))::BIGINT AS n_neg,
  (sum(CASE WHEN label = 1 THEN mid ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0)
  / (sum(label) * (count(*) - sum(label))) AS auc FROM r {group})"""


def _report() -> str:
    ratio = "coalesce({0}::DOUBLE / nullif({1}, 0), 0)"

    def row(name: str, p: str, r: str, f: str, n: str) -> str:
        return f"SELECT fold, '{name}' AS class, {p} AS precision, {r} AS recall, {f} AS f1, {n} AS support FROM m"

    accuracy = ratio.format("(tp + tn)", "(tp + tn + fp + fn)")
    weighted = [f"({m}0 * n0 + {m}1 * n1) / (n0 + n1)" for m in "prf"]
    macro = [f"({m}0 + {m}1) / 2" for m in "prf"]
    rows = [
        row("0", "p0", "r0", "f0", "n0"),
        row("1", "p1", "r1", "f1", "n1"),
        row("accuracy", accuracy, accuracy, accuracy, "n0 + n1"),
        row("macro avg", *macro, "n0 + n1"),
        row("weighted avg", *weighted, "n0 + n1"),
    ]
    return f"""{_scored()},
c AS (SELECT fold, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 1 AND prediction = 0) AS fn,
  count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 0 AND prediction = 0) AS tn
  FROM s GROUP BY fold),
m AS (SELECT *, tn + fp AS n0, tp + fn AS n1, {ratio.format("tn", "(tn + fn)")} AS p0, {ratio.format("tn", "(tn + fp)")} AS r0,
  {ratio.format("2 * tn", "(2 * tn + fn + fp)")} AS f0, {ratio.format("tp", "(tp + fp)")} AS p1,
  {ratio.format("tp", "(tp + fn)")} AS r1, {ratio.format("2 * tp", "(2 * tp + fn + fp)")} AS f1 FROM c),
rep AS ({" UNION ALL ".join(rows)})
SELECT class, {_r("avg(precision)", "precision")}, {_r("avg(recall)", "recall")}, {_r("avg(f1)", "f1")},
  sum(support)::BIGINT AS support FROM rep GROUP BY class"""


def _long() -> str:
    parts = [f"SELECT '{f}' AS feature, ai_label, {f} AS value FROM d" for f in _PLOT]
    return f"{_labelled()}, v AS ({' UNION ALL '.join(parts)})"


def _answer_lines() -> str:
    text = "CASE WHEN movie = 'error' THEN 'n/a' ELSE rating::INT::VARCHAR END"
    return f"""e AS ({_EVENT_USER}),
l AS (SELECT *, CASE WHEN movie_id % 51 = 0 THEN '{{'
    WHEN movie_id % 53 = 0 THEN '{{"response":{{"candidates":[]}},'
    ELSE '{{"response":{{"candidates":[{{"content":{{"parts":[{{"text":" ' || {text} || '\\n"}}]}}}}]}},' END
  || '"user_id":' || user_id || ',"movie":"' || movie || '","movie_id":' || movie_id || ',"temperature":'
  || {_temperature()} || '}}' AS line FROM e),
x AS (SELECT movie_id, CASE WHEN movie_id % 50 = 0 THEN substr(line, 1, 30) ELSE line END AS line FROM l),
j AS (SELECT movie_id, json_valid(line) AS is_valid, CASE WHEN json_valid(line) THEN line::JSON END AS doc FROM x),
p AS (SELECT is_valid, doc->>'$.movie' AS movie, (doc->>'$.user_id')::BIGINT AS user_id,
  (doc->>'$.movie_id')::BIGINT AS movie_id, (doc->>'$.temperature')::DOUBLE AS temperature,
  trim(doc->>'$.response.candidates[0].content.parts[0].text', chr(10) || ' ') AS text FROM j),
n AS (SELECT *, TRY_CAST(text AS DOUBLE) AS rating FROM p)"""


def _status() -> str:
    return (
        "CASE WHEN NOT is_valid THEN 'malformed' WHEN text IS NULL THEN 'no_response' "
        "WHEN rating IS NULL THEN 'non_numeric' WHEN rating NOT BETWEEN 1 AND 4 THEN 'out_of_range' ELSE 'ok' END"
    )


def _requests() -> str:
    # Fixed value: the prompt of ``operators.prompts``.
    prompt = (
        "'As a Netflix user, please rate the following movie on a scale of 1 to 5.' || chr(10) || 'Movie: ' || movie "
        "|| chr(10) || 'Provide only the numeric rating.'"
    )
    return f"""WITH r AS ({_CUSTOMER}),
u AS (SELECT user_id, {_temperature()} AS temperature FROM (SELECT DISTINCT user_id FROM r)
  ORDER BY {_key(42, "user_id")} LIMIT 100),
t AS (SELECT user_id, trim(movie) AS movie, movie_id, temperature FROM r JOIN u USING (user_id))
SELECT to_json({{'request': {{'contents': [{{'role': 'user', 'parts': [{{'text': {prompt}}}]}}],
  'generationConfig': {{'max_output_tokens': 64, 'temperature': temperature}}}},
  'user_id': user_id, 'movie': movie, 'movie_id': movie_id, 'temperature': temperature}})::VARCHAR AS value FROM t"""


def _knn() -> str:
    gap = " + ".join(f"(q.{f} - t.{f}) * (q.{f} - t.{f})" for f in ("sd_rating", "kurtosis_rating", "skewness_rating"))
    return f"""{_ranked(7)},
f AS (SELECT *, (class_rank - 1) % 6 AS fold FROM k),
n AS (SELECT q.fold, q.user_id, t.ai_label FROM f q JOIN f t ON t.fold <> q.fold
  QUALIFY row_number() OVER (PARTITION BY q.user_id ORDER BY {gap}, t.user_id) <= 5)
SELECT fold::INT AS fold, user_id, {_r("avg(ai_label)", "score")}, CASE WHEN avg(ai_label) > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS prediction
FROM n GROUP BY fold, user_id"""


def _wide() -> str:
    """Moments about each rater's own mean: one-pass sums would cancel on this scale."""
    source = (
        "SELECT l_suppkey AS user_id, l_linenumber + CASE WHEN l_suppkey % 3 = 0 AND l_partkey % 5 = 0 "
        "THEN 1000000.0 ELSE 0.0 END::DOUBLE AS rating FROM lineitem"
    )
    names = [s for s in _STATISTICS if s not in ("sd_rating", "kurtosis_rating", "skewness_rating")]
    plain = _stats(source, "u").replace("WHERE sd_rating IS NOT NULL AND kurtosis_rating IS NOT NULL AND skewness_rating IS NOT NULL", "")
    return f"""WITH {plain},
c AS (SELECT user_id, rating - avg(rating) OVER (PARTITION BY user_id) AS d FROM ({source})),
m AS (SELECT user_id, count(*) AS n, sum(d*d) / count(*) AS m2, sum(d*d*d) / count(*) AS m3, sum(d*d*d*d) / count(*) AS m4
  FROM c GROUP BY user_id)
SELECT user_id, {", ".join(_r(s) for s in names)}, {_r("sqrt(m2 * n / (n - 1))", "sd_rating")},
  {_r("m4 / (m2 * m2) - 3", "kurtosis_rating")}, {_r("m3 / (m2 * sqrt(m2))", "skewness_rating")}
FROM u JOIN m USING (user_id) WHERE n > 1 AND m2 > 0"""


def _scored_rows(*models: str) -> str:
    """What must hold of the scores of fitted models: each balanced row once, in its own fold."""
    parts = [
        f"SELECT '{m}' AS model, fold, user_id, ai_label::DOUBLE AS label, true AS agrees, true AS bounded FROM b" for m in models
    ]
    return f"{_balanced()} {' UNION ALL '.join(parts)}"


def _curve() -> str:
    return f"""{_balanced()}, sizes AS (SELECT held_out, count(*) AS n FROM b, range(6) g(held_out) WHERE fold <> held_out GROUP BY 1)
SELECT step::INT AS step, min(n * step // 10)::BIGINT AS n_train, true AS bounded FROM sizes, range(1, 11) t(step) GROUP BY 1"""


def _vif(a: str, b: str, c: str) -> str:
    return f"""SELECT '{a}' AS feature, {_r(f"(1 - corr({b}, {c})^2) / det", "vif")} FROM d, t GROUP BY det"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name, for every query that has a SQL form."""
    core = ("sd_rating", "kurtosis_rating", "skewness_rating")
    a, b, c = core
    white = "(SELECT string_agg(chr(i::INT), '') FROM (SELECT unnest(range(9, 14) || range(28, 33) || [133, 160, 5760] || range(8192, 8203) || [8232, 8233, 8239, 8287, 12288]) AS i))"
    width = "(hi - lo)"
    grid_x = f"lo + {width} * point / 199"
    return {
        "q_scan_parquet": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders",
        "q_output_summary": f"SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM ({_CUSTOMER})",
        "q_dropna_any": "SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id) "
        "WHERE lang IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL",
        "q_encode_id": f"SELECT DISTINCT user_id, (user_id::VARCHAR || '0')::BIGINT AS encoded_id, 0 AS ai_label FROM ({_CUSTOMER}) "
        f"UNION ALL SELECT DISTINCT user_id, (user_id::VARCHAR || '1')::BIGINT AS encoded_id, 1 AS ai_label FROM ({_EVENT_USER})",
        "q_target_user": f"SELECT * FROM ({_EVENT_USER}) WHERE user_id::VARCHAR = '42'",
        "q_clean_text": f"WITH t AS (SELECT doc_id, trim(text, {white}) AS text FROM documents) "
        "SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars FROM t",
        "q_label_name": "SELECT doc_id, CASE quality WHEN 0 THEN 'Human' WHEN 1 THEN 'AI' ELSE 'Unknown' END AS label_name "
        "FROM documents LEFT JOIN labels USING (doc_id)",
        "q_distinct_values": "SELECT DISTINCT event_type AS value FROM events",
        "q_qualified_users": f"SELECT user_id FROM ({_SUPPLIER}) GROUP BY user_id HAVING count(*) >= 600",
        "q_qualified_ratings": f"SELECT * FROM ({_SUPPLIER}) QUALIFY count(*) OVER (PARTITION BY user_id) >= 600",
        "q_distinct_users": f"SELECT count(DISTINCT user_id) AS n_users FROM ({_CUSTOMER})",
        "q_sample_k": f"SELECT * FROM ({_SUPPLIER}) QUALIFY count(*) OVER (PARTITION BY user_id) >= 600 AND "
        f"row_number() OVER (PARTITION BY user_id ORDER BY {_key(42, 'user_id', 'movie_id')}, movie_id, rating) <= 300",
        "q_sample_about": f"WITH {_stats(_CUSTOMER, 'human')} SELECT user_id FROM human WHERE {_head(_key(42, 'user_id'))} "
        "/ 4294967296.0::DOUBLE < 1000.0::DOUBLE / (SELECT count(*) FROM human)",
        "q_sample_users": f"SELECT user_id FROM (SELECT DISTINCT user_id FROM ({_CUSTOMER})) ORDER BY {_key(42, 'user_id')} LIMIT 100",
        "q_assign_temperature": f"SELECT user_id, {_temperature()} AS temperature FROM (SELECT DISTINCT user_id FROM ({_CUSTOMER}))",
        "q_requests": _requests(),
        "q_json_valid": f"WITH {_answer_lines()} SELECT movie_id, is_valid FROM j",
        "q_quarantine": f"WITH {_answer_lines()} SELECT movie_id, line AS value FROM x WHERE NOT json_valid(line)",
        "q_rejected_ids": f"SELECT count(DISTINCT user_id) AS rejected FROM ({_CUSTOMER}) WHERE user_id % 7 = 0",
        "q_user_stats_wide": _wide(),
        "q_parse_responses": f"WITH {_answer_lines()} SELECT movie, user_id, movie_id, temperature, rating FROM n WHERE rating IS NOT NULL",
        "q_parse_audit": f"WITH {_answer_lines()} SELECT {_status()} AS status, count(*) AS n FROM n GROUP BY 1",
        "q_user_stats": f"WITH {_stats(_SUPPLIER, 'u')} SELECT user_id, {_ROUNDED_STATISTICS} FROM u",
        "q_user_stats_deliveries": f"WITH {_stats(_SUPPLIER, 'u')} SELECT user_id, {_ROUNDED_STATISTICS} FROM u",
        "q_user_stats_general": f"WITH {_stats(_CUSTOMER, 'u')} SELECT user_id, {_ROUNDED_STATISTICS} FROM u",
        "q_user_stats_core": f"WITH {_stats(_CUSTOMER, 'u')} SELECT user_id, {', '.join(_r(f) for f in core)} FROM u",
        "q_rating_hist": f"WITH h AS (SELECT user_id, rating, count(*) AS rating_count FROM ({_SUPPLIER}) GROUP BY ALL), "
        "t AS (SELECT *, sum(rating_count) OVER (PARTITION BY user_id)::BIGINT AS total_count FROM h) "
        f"SELECT *, {_r('rating_count * 1.0::DOUBLE / total_count', 'share')} FROM t",
        "q_mode": f"WITH h AS (SELECT user_id, rating, count(*) AS n FROM ({_CUSTOMER}) GROUP BY ALL) "
        "SELECT user_id, rating AS mode_rating FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, rating) = 1",
        "q_mode_window": f"WITH h AS (SELECT user_id, rating, count(*) AS rating_count FROM ({_CUSTOMER}) GROUP BY ALL) "
        "SELECT * FROM h QUALIFY rating_count = max(rating_count) OVER (PARTITION BY user_id)",
        "q_entropy": f"WITH h AS (SELECT user_id, count(*) AS n FROM ({_CUSTOMER}) GROUP BY user_id, rating), "
        "p AS (SELECT user_id, n * 1.0::DOUBLE / sum(n) OVER (PARTITION BY user_id) AS p FROM h) "
        f"SELECT user_id, {_r('sum(-p * ln(p))', 'entropy_rating')} FROM p GROUP BY user_id",
        "q_ml_dataset": f"{_labelled(1000)} SELECT * FROM d",
        "q_balance": f"{_balanced()} SELECT user_id, ai_label FROM b",
        "q_folds": f"{_balanced()} SELECT user_id, ai_label, fold FROM b",
        "q_class_means": f"{_balanced()} SELECT ai_label, {', '.join(_r(f'avg({f})', f) for f in core)} FROM b GROUP BY ai_label",
        "q_class_counts": f"{_balanced()} SELECT ai_label, count(*) AS n FROM b GROUP BY ai_label",
        "q_vif": f"{_labelled()}, t AS (SELECT 1 + 2 * corr({a}, {b}) * corr({a}, {c}) * corr({b}, {c}) "
        f"- corr({a}, {b})^2 - corr({a}, {c})^2 - corr({b}, {c})^2 AS det FROM d) "
        f"{_vif(a, b, c)} UNION ALL {_vif(b, a, c)} UNION ALL {_vif(c, a, b)}",
        "q_correlation": f"{_labelled()} "
        + " UNION ALL ".join(
            f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, {_r(f'corr({x}, {y})', 'corr')} FROM d" for x, y in ((a, b), (a, c), (b, c))
        ),
        "q_learning_subsets": f"{_balanced()}, h AS (SELECT user_id, ai_label, fold, held_out FROM b, range(6) g(held_out) WHERE fold <> held_out), "
        f"t AS (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY {_key(42, 'user_id')}) AS train_rank, "
        "count(*) OVER (PARTITION BY held_out) AS train_size FROM h) "
        "SELECT * REPLACE (held_out::INT AS held_out), ((train_rank * 10 + train_size - 1) // train_size)::INT AS first_step FROM t",
        "q_int_hist": f"WITH r AS ({_CUSTOMER}), b AS (SELECT unnest(range(floor(min(rating))::BIGINT, ceil(max(rating))::BIGINT + 1)) AS bin FROM r) "
        "SELECT bin, count(rating) AS n FROM b LEFT JOIN r ON floor(rating) = bin GROUP BY bin",
        "q_first_user_hist": f"WITH s AS ({_CUSTOMER}), r AS (SELECT * FROM s WHERE user_id = (SELECT min(user_id) FROM s)), "
        "b AS (SELECT unnest(range(floor(min(rating))::BIGINT, ceil(max(rating))::BIGINT + 1)) AS bin FROM r) "
        "SELECT bin, count(rating) AS n FROM b LEFT JOIN r ON floor(rating) = bin GROUP BY bin",
        "q_feature_hist": f"""{_long()},
g0 AS (SELECT feature, ai_label, min(value) AS l, max(value) AS h FROM v GROUP BY ALL),
g AS (SELECT feature, ai_label, CASE WHEN l = h THEN l - 0.5 ELSE l END AS lo, CASE WHEN l = h THEN h + 0.5 ELSE h END AS hi FROM g0),
c AS (SELECT feature, ai_label, least(floor((value - lo) / {width} * 30) + 1, 30)::BIGINT AS bin, count(*) AS n
  FROM v JOIN g USING (feature, ai_label) GROUP BY ALL)
SELECT feature, ai_label, bin, {_r(f"lo + {width} / 30 * (bin - 1)", "bin_start")}, {_r(f"lo + {width} / 30 * bin", "bin_end")},
  coalesce(n, 0) AS n
FROM (SELECT g.*, b.bin FROM g, range(1, 31) b(bin)) LEFT JOIN c USING (feature, ai_label, bin)""",
        "q_kde": f"""{_long()},
g AS (SELECT feature, ai_label, min(value) AS lo, max(value) AS hi, count(*) AS n,
  CASE WHEN min(value) < max(value) THEN stddev_samp(value) * pow(count(*), -0.2) END AS h FROM v GROUP BY ALL),
p AS (SELECT g.*, i.point, {grid_x} AS x FROM g, range(200) i(point) WHERE h IS NOT NULL OR point = 0),
k AS (SELECT feature, ai_label, point, x, lo, hi, n, sum(exp(-0.5 * ((x - value) / h) * ((x - value) / h))) / (n * h * sqrt(2 * pi())) AS density
  FROM p JOIN v USING (feature, ai_label) GROUP BY feature, ai_label, point, x, lo, hi, n, h)
SELECT feature, ai_label, point::INT AS point, {_r("x")}, {_r("density")}, {_r(f"density * n * {width} / 30", "scaled")} FROM k""",
        "q_auc": f"{_scored()}, {_areas('fold')} SELECT fold, n_pos, n_neg, {_r('auc')} FROM a",
        "q_mean_auc": f"{_scored()}, {_areas('fold')}, r2 AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid FROM s) "
        f"SELECT 'mean_fold_auc' AS metric, {_r('avg(auc)', 'auc')} FROM a UNION ALL "
        f"SELECT 'pooled_auc' AS metric, {_r('(sum(CASE WHEN label = 1 THEN mid ELSE 0 END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))', 'auc')} FROM r2",
        "q_roc": f"{_scored()}, t AS (SELECT score AS threshold, sum(label) AS pos, count(*) - sum(label) AS neg FROM s GROUP BY score) "
        f"SELECT threshold, {_r('sum(neg) OVER w / sum(neg) OVER ()', 'fpr')}, {_r('sum(pos) OVER w / sum(pos) OVER ()', 'tpr')} "
        "FROM t WINDOW w AS (ORDER BY threshold DESC) UNION ALL SELECT NULL, 0.0, 0.0",
        "q_confusion": f"{_scored()} SELECT l.v::INT AS label, p.v::INT AS prediction, count(s.label) AS n FROM range(2) l(v) CROSS JOIN range(2) p(v) "
        "LEFT JOIN s ON s.label = l.v AND s.prediction = p.v GROUP BY ALL",
        "q_fold_report": _report(),
        "q_score_stats": f"SELECT user_id, {_r('sd_rating', 'SD')}, {_r('skewness_rating', 'Skewness')}, {_r('kurtosis_rating', 'Kurtosis')} "
        f"FROM (SELECT user_id, {_moments('rating')} FROM ({_CUSTOMER}) GROUP BY user_id)",
        "q_score_combined": f"SELECT 'Combined' AS user_id, {', '.join(_r(f) for f in core)}, 'ok' AS status "
        f"FROM (SELECT {_moments('rating')} FROM ({_EVENT_USER}))",
        "q_knn": _knn(),
        "q_rf_oof": _scored_rows("random_forest"),
        "q_svm_oof": _scored_rows("support_vectors"),
        "q_lr_oof": _scored_rows("logistic_regression"),
        "q_oof": _scored_rows("random_forest", "logistic_regression"),
        "q_model_compare": "SELECT unnest(['boosted_trees', 'random_forest', 'support_vectors', 'logistic_regression', "
        "'nearest_neighbours']) AS model, true AS above_floor",
        "q_learning_curve": _curve(),
        "q_score": f"WITH s AS (SELECT user_id, {_moments('rating')} FROM ({_CUSTOMER}) GROUP BY user_id), "
        "v AS (SELECT *, sd_rating IS NOT NULL AND kurtosis_rating IS NOT NULL AS ok FROM s) "
        "SELECT user_id, CASE WHEN ok THEN 'ok' ELSE 'undefined_features' END AS status, "
        "CASE WHEN ok THEN true END AS agrees, CASE WHEN ok THEN true END AS bounded FROM v",
    }
