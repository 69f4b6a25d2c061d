"""DuckDB SQL twins of the registered queries (same column names and rounding)."""

from __future__ import annotations

from riskspark.plans.views import DOCUMENTS_VIEW_SQL, EMBEDDINGS_VIEW_SQL, ORDERS_VIEW_SQL

VIEWS = {"v_ord": ORDERS_VIEW_SQL, "v_doc": DOCUMENTS_VIEW_SQL, "v_emb": EMBEDDINGS_VIEW_SQL}


def w(views, *ctes_and_body: str) -> str:
    """WITH <views>, <ctes> <body>: the last argument is the final SELECT."""
    *ctes, body = ctes_and_body
    parts = [VIEWS[v].strip() for v in views] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def r6(x: str) -> str:
    return f"round({x}, 6)"


def sdiv(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) = 0 THEN 0.0 ELSE CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) END)"


def sev(x: str, high: float, mid: float | None) -> str:
    midc = f" WHEN {x} > {mid} THEN 'medium'" if mid is not None else ""
    return f"(CASE WHEN {x} > {high} THEN 'high'{midc} ELSE 'low' END)"


RATE = "avg(CAST(label AS DOUBLE)) * 100.0"


def rate_by(view: str, key: str, high, mid) -> str:
    return w([view], f"""
SELECT {key}, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, {r6(RATE)} AS rate_pct,
       {sev(RATE, high, mid)} AS severity
FROM {view} WHERE {key} IS NOT NULL GROUP BY {key}""")


AMOUNT_EDGES = [0, 100000, 200000, 300000, 450000]
AMOUNT_LABELS = ["<100K", "100K-200K", "200K-300K", "300K-450K"]


def band_case(x: str, edges, labels, index: bool = False) -> str:
    whens = []
    for i, (lo, hi, lab) in enumerate(zip(edges[:-1], edges[1:], labels), start=1):
        val = str(i) if index else f"'{lab}'"
        whens.append(f"WHEN {x} > {lo} AND {x} <= {hi} THEN {val}")
    return "(CASE " + " ".join(whens) + " END)"


def hist(view: str, col: str, bins: int, label: str | None, views=None, ctes=()) -> str:
    k = f"{label}, " if label else ""
    on = f"g.{label} = c.{label} AND " if label else ""
    using = f"USING ({label})" if label else "ON TRUE"
    grp = f"GROUP BY {label}" if label else ""
    return w([view] if views is None else views, *ctes, f"""
d AS (SELECT {k}CAST({col} AS DOUBLE) AS x FROM {view} WHERE {col} IS NOT NULL)""", f"""
rng AS (SELECT {k}CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
               CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi
        FROM d {grp})""", f"""
cnt AS (SELECT {k}CAST(least({bins}, floor((d.x - rng.lo) / (rng.hi - rng.lo) * {float(bins)}) + 1) AS INTEGER) AS bin,
               count(*) AS n
        FROM d JOIN rng {using} GROUP BY ALL)""", f"""
grid AS (SELECT {k}lo, hi, CAST(unnest(range(1, {bins + 1})) AS INTEGER) AS bin FROM rng)""", f"""
SELECT {('g.' + label + ', ') if label else ''}g.bin,
       {r6(f'g.lo + CAST(g.bin - 1 AS DOUBLE) * ((g.hi - g.lo) / {float(bins)})')} AS bin_lo,
       {r6(f'g.lo + CAST(g.bin AS DOUBLE) * ((g.hi - g.lo) / {float(bins)})')} AS bin_hi,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM grid g LEFT JOIN cnt c ON {on}g.bin = c.bin""")


def share(view: str) -> str:
    return w([view], f"""
SELECT label, count(*) AS n,
       {r6('CAST(count(*) AS DOUBLE) * 100.0 / CAST(sum(count(*)) OVER () AS DOUBLE)')} AS pct
FROM {view} GROUP BY label""")


def risk_level_sql(x: str) -> str:
    return (f"(CASE WHEN {x} > 0.0 AND {x} <= 0.35 THEN 'Low' WHEN {x} > 0.35 AND {x} <= 0.55 THEN 'Medium' "
            f"WHEN {x} > 0.55 AND {x} <= 1.0 THEN 'High' END)")


RISK_LEVEL = risk_level_sql("p")
PCT = "(round_even(p * 100.0 * 10.0, 0) / 10.0)"
PRED = "CAST(CASE WHEN p >= 0.35 THEN 1 ELSE 0 END AS INTEGER)"
SCORED = """
s AS (SELECT id, label, segment, nation, urgent, tenure, amount, fixed_score AS p FROM v_ord)"""
PREDICTED = """
pr AS (SELECT *, CAST(CASE WHEN p >= 0.35 THEN 1 ELSE 0 END AS INTEGER) AS pred FROM s)"""


def describe(view: str, cols) -> str:
    sel = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        sel.append(f"""SELECT '{c}' AS "column", count({x}) AS count, round_even(avg({x}), 1) AS mean,
  round_even(stddev_samp({x}), 1) AS std, round_even(min({x}), 1) AS min,
  round_even(quantile_cont({x}, 0.25), 1) AS p25, round_even(quantile_cont({x}, 0.5), 1) AS p50,
  round_even(quantile_cont({x}, 0.75), 1) AS p75, round_even(max({x}), 1) AS max FROM {view}""")
    return w([view], "\nUNION ALL\n".join(sel))


def percentiles(view: str, cols, probs) -> str:
    sel = []
    for c in cols:
        for p in probs:
            sel.append(f"""SELECT '{c}' AS "column", CAST({float(p)} AS DOUBLE) AS prob,
  {r6(f'quantile_cont(CAST({c} AS DOUBLE), {float(p)})')} AS value FROM {view} WHERE {c} IS NOT NULL""")
    return w([view], "\nUNION ALL\n".join(sel))


def validate(view: str, n_cols: int, required) -> str:
    req = ",".join(required)
    return w([view], f"""
st AS (SELECT count(*) AS n,
              (SELECT string_agg(v, ',' ORDER BY v) FROM
                 (SELECT DISTINCT CAST(label AS VARCHAR) AS v FROM {view} WHERE label IS NOT NULL)) AS vals,
              sum(CASE WHEN label IS NOT NULL AND CAST(label AS VARCHAR) NOT IN ('0', '1') THEN 1 ELSE 0 END)
                AS n_bad
       FROM {view})""", f"""
ch AS (
  SELECT 1 AS ordinal, 'max_rows' AS "check", CAST(n AS VARCHAR) AS observed, CAST(NULL AS VARCHAR) AS "limit",
         TRUE AS passed FROM st
  UNION ALL SELECT 2, 'required_columns', '', '{req}', TRUE FROM st
  UNION ALL SELECT 3, 'label_values', vals, '0,1', n_bad = 0 FROM st
  UNION ALL SELECT 4, 'min_rows', CAST(n AS VARCHAR), '50', n >= 50 FROM st
  UNION ALL SELECT 5, 'max_columns', '{n_cols}', '100', {n_cols} <= 100 FROM st)""", """
SELECT CAST(ordinal AS INTEGER) AS ordinal, "check", observed, "limit", passed,
       (NOT passed) AND coalesce(bool_and(passed) OVER (ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING
                                                        AND 1 PRECEDING), TRUE) AS first_failure
FROM ch""")


def roc_cte(src: str, keys: str = "") -> list[str]:
    kp = f"PARTITION BY {keys} " if keys else ""
    kc = f"{keys}, " if keys else ""
    kg = f"GROUP BY {keys}" if keys else ""
    return [f"""
st AS (SELECT {kc}CAST(p AS DOUBLE) AS score,
              CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp_s,
              CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp_s
       FROM {src} GROUP BY ALL)""", f"""
tot AS (SELECT {kc}CAST(sum(tp_s) AS BIGINT) AS "P", CAST(sum(fp_s) AS BIGINT) AS "N" FROM st {kg})""", f"""
cum AS (SELECT {kc}score, tp_s, fp_s,
               sum(tp_s) OVER ({kp}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctp,
               sum(fp_s) OVER ({kp}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cfp
        FROM st)"""]


def roc_auc_sql(view_ctes, src: str, keys: str = "", extra_ctes=()) -> str:
    kc = f"{keys}, " if keys else ""
    join = f"USING ({keys})" if keys else "ON TRUE"
    return w(view_ctes, *extra_ctes, *roc_cte(src, keys), f"""
pc AS (SELECT {('cum.' + keys + ', ') if keys else ''}sum(({sdiv('cfp', '"N"')} - {sdiv('cfp - fp_s', '"N"')})
                      * ({sdiv('ctp', '"P"')} + {sdiv('ctp - tp_s', '"P"')}) / 2.0) AS area
       FROM cum JOIN tot {join} {('GROUP BY cum.' + keys) if keys else ''})""", f"""
SELECT {('tot.' + keys + ', ') if keys else ''}{r6('coalesce(pc.area, 0.0) + (1.0 - CASE WHEN "N" > 0 THEN 1.0 ELSE 0.0 END) * '
                  '(CASE WHEN "P" > 0 THEN 1.0 ELSE 0.0 END + 1.0) / 2.0')} AS roc_auc,
       "P" AS positives, "N" AS negatives
FROM tot LEFT JOIN pc {join}""")


def metrics_select(src: str, keys: str = "") -> str:
    kc = f"{keys}, " if keys else ""
    kg = f"GROUP BY {keys}" if keys else ""
    return f"""
SELECT {kc}n, tp, fp, fn, {r6(sdiv('correct', 'n'))} AS accuracy, {r6('prec')} AS precision, {r6('rec')} AS recall,
       {r6('CASE WHEN prec + rec > 0 THEN 2.0 * prec * rec / (prec + rec) ELSE 0.0 END')} AS f1
FROM (SELECT *, {sdiv('tp', 'tp + fp')} AS prec, {sdiv('tp', 'tp + fn')} AS rec FROM (
  SELECT {kc}count(*) AS n,
         sum(CASE WHEN label = pred THEN 1 ELSE 0 END) AS correct,
         CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN label <> 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM {src} {kg}))"""


def folds_cte(view: str, cols: str, k: int, seed: int = 42, name: str = "fo") -> str:
    return f"""
{name} AS (SELECT {cols},
       row_number() OVER (PARTITION BY label ORDER BY md5('{seed}:' || CAST(id AS VARCHAR)), id) AS class_rank,
       CAST(ntile({k}) OVER (PARTITION BY label ORDER BY md5('{seed}:' || CAST(id AS VARCHAR)), id) - 1 AS INTEGER)
         AS fold
   FROM {view})"""


SCORERS = f"""
{folds_cte('v_ord', 'id, label, fixed_score, priority_score', 5).strip()},
sc AS (SELECT 'hash_score' AS model, 1 AS model_order, id, label, fold, fixed_score AS p FROM fo
       UNION ALL
       SELECT 'priority_score', 2, id, label, fold, CAST(6 - priority_score AS DOUBLE) / 5.0 FROM fo),
pr AS (SELECT *, {PRED} AS pred FROM sc)"""

FOLD_RECALL = f"""
fr AS (SELECT model, fold, {sdiv('tp', 'tp + fn')} AS recall FROM (
         SELECT model, fold, sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp,
                sum(CASE WHEN label = 1 AND pred <> 1 THEN 1 ELSE 0 END) AS fn
         FROM pr GROUP BY model, fold))"""

CV = """
cv AS (SELECT model, avg(recall) AS cv_mean, stddev_pop(recall) AS cv_std, count(*) AS n_folds FROM fr GROUP BY model)"""

COMPARISON = [SCORERS, FOLD_RECALL, CV, f"""
tm AS ({metrics_select("(SELECT * FROM pr WHERE fold = 0)", "model")})""",
              "tst AS (SELECT model, p, label FROM pr WHERE fold = 0)",
              *roc_cte("tst", "model"),
              f"""
pc AS (SELECT cum.model, sum(({sdiv('cfp', '"N"')} - {sdiv('cfp - fp_s', '"N"')})
                      * ({sdiv('ctp', '"P"')} + {sdiv('ctp - tp_s', '"P"')}) / 2.0) AS area
       FROM cum JOIN tot USING (model) GROUP BY cum.model)""", """
au AS (SELECT tot.model, coalesce(pc.area, 0.0) + (1.0 - CASE WHEN "N" > 0 THEN 1.0 ELSE 0.0 END) *
                 (CASE WHEN "P" > 0 THEN 1.0 ELSE 0.0 END + 1.0) / 2.0 AS roc_auc
       FROM tot LEFT JOIN pc USING (model))""", """
cmp AS (SELECT tm.model, tm.accuracy, tm.recall, tm.precision, tm.f1, cv.cv_mean, cv.cv_std, au.roc_auc,
               mo.model_order
        FROM tm LEFT JOIN cv USING (model) LEFT JOIN au USING (model)
        JOIN (SELECT DISTINCT model, model_order FROM sc) mo USING (model))"""]


KNN_PAIRS = """
pr AS (SELECT a.id AS q_id, b.id AS nb_id,
              list_reduce(list_transform(list_zip(a.features, b.features), lambda t: (t[1] - t[2]) * (t[1] - t[2])),
                          lambda acc, v: acc + v, 0.0) AS d2,
              row_number() OVER (PARTITION BY a.id ORDER BY
                list_reduce(list_transform(list_zip(a.features, b.features), lambda t: (t[1] - t[2]) * (t[1] - t[2])),
                            lambda acc, v: acc + v, 0.0), b.id) AS rank
       FROM v_emb a JOIN v_emb b ON TRUE {cond})"""

SMOTE_FEATURES = ["n_chars", "n_words", "n_lines", "lang", "source"]
HASH_U = "(CAST(('0x' || substr(md5({x}), 1, 13))::BIGINT AS DOUBLE) / CAST(4503599627370496 AS DOUBLE))"


def _u(tag: str) -> str:
    return HASH_U.format(x=f"'42:' || CAST(m.label AS VARCHAR) || ':{tag}:' || CAST(i AS VARCHAR)")


SMOTE_CTES = ["""
enc AS (SELECT id, label, CAST(n_chars AS DOUBLE) AS n_chars, CAST(n_words AS DOUBLE) AS n_words,
               CAST(n_lines AS DOUBLE) AS n_lines, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS lang,
               CAST(dense_rank() OVER (ORDER BY source) - 1 AS DOUBLE) AS source FROM v_doc)""", """
cnt AS (SELECT label, count(*) AS n FROM enc GROUP BY label)""", """
minr AS (SELECT c.label, c.n, (SELECT max(n) FROM cnt) - c.n AS need, least(5, c.n - 1) AS kk
         FROM cnt c WHERE c.n < (SELECT max(n) FROM cnt))""", """
ordd AS (SELECT e.*, row_number() OVER (PARTITION BY e.label ORDER BY
                  md5('42:smote:' || CAST(e.label AS VARCHAR) || ':' || CAST(e.id AS VARCHAR)), e.id) - 1 AS ord
         FROM enc e JOIN minr USING (label))""", """
nn AS (SELECT a.id AS parent_id, b.id AS nb_id,
              row_number() OVER (PARTITION BY a.id ORDER BY
                 ((((0.0 + (a.n_chars - b.n_chars) * (a.n_chars - b.n_chars)) + (a.n_words - b.n_words) * (a.n_words - b.n_words))
                   + (a.n_lines - b.n_lines) * (a.n_lines - b.n_lines)) + (a.lang - b.lang) * (a.lang - b.lang))
                   + (a.source - b.source) * (a.source - b.source), b.id) AS rnk
       FROM ordd a JOIN ordd b ON a.label = b.label AND a.id <> b.id)""", f"""
syn AS (SELECT m.label, i AS synth_index, CAST(floor({_u('p')} * m.n) AS BIGINT) AS ord,
               CAST(floor({_u('n')} * greatest(m.kk, 1)) + 1 AS BIGINT) AS nbr, {_u('l')} AS lam
        FROM (SELECT *, unnest(range(need)) AS i FROM minr) m)""", f"""
gen AS (SELECT s.label, s.synth_index, p.id AS parent_id, nn.nb_id, s.lam,
               {", ".join(f"p.{c} AS p_{c}, q.{c} AS n_{c}" for c in SMOTE_FEATURES)}
        FROM syn s JOIN ordd p ON p.label = s.label AND p.ord = s.ord
        JOIN nn ON nn.parent_id = p.id AND nn.rnk = s.nbr
        JOIN enc q ON q.id = nn.nb_id)"""]


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["label_summary"] = w(["v_ord"], f"""
SELECT count(*) AS n, CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS positives,
       CAST(sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS BIGINT) AS negatives,
       {r6(RATE)} AS rate_pct, CAST(10 AS INTEGER) AS n_features FROM v_ord""")
    q["rate_by_segment"] = rate_by("v_ord", "segment", 20.0, 14.0)
    q["rate_by_urgent"] = rate_by("v_ord", "urgent", 20.0, None)
    q["rate_by_nation_ranked"] = rate_by("v_ord", "nation", 25.0, 15.0)
    q["rate_by_scores"] = w(["v_ord"], f"""
SELECT metric, score, count(*) AS n, {r6(RATE)} AS rate_pct, {sev(RATE, 20.0, 12.0)} AS severity FROM (
  SELECT 'priority_score' AS metric, CAST(priority_score AS BIGINT) AS score, label FROM v_ord
  UNION ALL SELECT 'tenure', CAST(tenure AS BIGINT), label FROM v_ord) u
WHERE score IS NOT NULL GROUP BY metric, score""")
    q["rate_by_band"] = w(["v_ord"], f"""
b AS (SELECT {band_case('amount', AMOUNT_EDGES, AMOUNT_LABELS, True)} AS band_no,
             {band_case('amount', AMOUNT_EDGES, AMOUNT_LABELS)} AS band, label FROM v_ord)""", f"""
SELECT band_no, band, count(*) AS n, {r6(RATE)} AS rate_pct, {sev(RATE, 20.0, 12.0)} AS severity
FROM b WHERE band IS NOT NULL GROUP BY band_no, band""")
    q["class_histogram_amount"] = hist("v_ord", "amount", 30, "label")
    q["class_histogram_tenure"] = hist("v_ord", "tenure", 25, "label")
    q["class_histogram_balance"] = hist("v_ord", "balance", 20, "label")
    q["score_histogram"] = hist("v_ord", "fixed_score", 40, None)
    q["class_share"] = share("v_ord")
    q["class_counts_docs"] = share("v_doc")
    q["level_counts"] = w(["v_ord"], f"""
lv AS (SELECT * FROM (VALUES (1, 'High'), (2, 'Medium'), (3, 'Low')) t(ordinal, risk_level))""", f"""
c AS (SELECT {risk_level_sql('fixed_score')} AS risk_level,
             count(*) AS n FROM v_ord GROUP BY 1)""", """
SELECT CAST(lv.ordinal AS INTEGER) AS ordinal, lv.risk_level, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM lv LEFT JOIN c ON lv.risk_level = c.risk_level""")
    q["describe_numeric"] = describe("v_ord", ["amount", "balance", "tenure", "priority_score", "fixed_score"])
    q["exact_percentiles"] = percentiles("v_ord", ["amount", "balance", "fixed_score"],
                                         [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0])
    q["distinct_labels"] = w(["v_ord"], "SELECT DISTINCT label FROM v_ord WHERE label IS NOT NULL")
    q["validate_table"] = validate("v_ord", 12, ["id", "label", "amount"])
    q["binarize_label"] = w(["v_ord"], """
SELECT id, CAST(coalesce(CAST(lower(label_text) = 'yes' AS INTEGER), 0) AS INTEGER) AS label_bin FROM v_ord""")
    q["binarize_label_strict"] = w(["v_ord"], """
t AS (SELECT id, CASE WHEN segment = 'BUILDING' THEN upper(label_text) ELSE label_text END AS label_text FROM v_ord)""", """
SELECT id, CAST(CASE WHEN (SELECT bool_and(coalesce(lower(label_text) IN ('yes', 'no'), FALSE)) FROM t)
                     THEN coalesce(CAST(lower(label_text) = 'yes' AS INTEGER), 0) END AS INTEGER) AS label_bin
FROM t""")
    q["standardize_columns"] = w(["v_ord"], "SELECT id, segment AS MarketSegment, nation AS Nation FROM v_ord")
    q["preview"] = w(["v_ord"], f"SELECT id, label, segment, {r6('amount')} AS amount FROM v_ord ORDER BY id LIMIT 10")
    q["consistency_violations"] = w(["v_ord"], """
SELECT id, violation FROM (
  SELECT id, CASE WHEN coalesce(NOT (balance >= 0), FALSE) THEN 'negative_balance'
                  WHEN coalesce(NOT (amount <= 450000.0), FALSE) THEN 'amount_above_top_band'
                  WHEN coalesce(NOT (tenure <= priority_score + 2), FALSE) THEN 'tenure_beyond_priority_window'
             END AS violation FROM v_ord) t
WHERE violation IS NOT NULL""")
    q["band_amount"] = w(["v_ord"], f"SELECT id, {band_case('amount', AMOUNT_EDGES, AMOUNT_LABELS)} AS band FROM v_ord")
    q["score_bands"] = w(["v_ord"], SCORED, f"""
SELECT id, {r6('p')} AS p, {r6(PCT)} AS p_pct, {RISK_LEVEL} AS risk_level,
       CASE WHEN p > 0.6 THEN 'HIGH RISK' WHEN p > 0.35 THEN 'MEDIUM RISK' ELSE 'LOW RISK' END AS risk_label,
       {PRED} AS pred,
       CASE WHEN p >= 0.35 AND p > 0.65 THEN 'high' WHEN p >= 0.35 THEN 'medium' ELSE 'retain' END AS action
FROM s""")
    q["at_risk_list"] = w(["v_ord"], SCORED, f"""
SELECT id, segment, nation, urgent, tenure, {r6('amount')} AS amount, {r6(PCT)} AS p_pct, label
FROM s WHERE p >= 0.40 ORDER BY p_pct DESC, id""")
    q["at_risk_summary"] = w(["v_ord"], SCORED, f"""
SELECT count(*) AS n_total, CAST(sum(CASE WHEN p >= 0.4 THEN 1 ELSE 0 END) AS BIGINT) AS n_at_risk,
       {r6(f'avg(CASE WHEN p >= 0.4 THEN {PCT} END)')} AS avg_risk_pct,
       CAST(sum(CASE WHEN p >= 0.4 THEN label ELSE 0 END) AS BIGINT) AS actual_positives,
       {r6(sdiv('sum(CASE WHEN p >= 0.4 THEN 1 ELSE 0 END) * 100.0', 'count(*)'))} AS pct_of_total,
       CAST(0.4 AS DOUBLE) AS threshold
FROM s""")
    q["confusion_matrix"] = w(["v_ord"], SCORED, PREDICTED, """
lab AS (SELECT DISTINCT v FROM (SELECT label AS v FROM pr UNION ALL SELECT pred FROM pr) WHERE v IS NOT NULL)""", """
c AS (SELECT label AS actual, pred AS predicted, count(*) AS n FROM pr GROUP BY 1, 2)""", """
SELECT a.v AS actual, b.v AS predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM lab a JOIN lab b ON TRUE LEFT JOIN c ON c.actual = a.v AND c.predicted = b.v""")
    q["binary_metrics"] = w(["v_ord"], SCORED, PREDICTED, metrics_select("pr"))
    q["binary_metrics_by_segment"] = w(["v_ord"], SCORED, PREDICTED, metrics_select("pr", "segment"))
    q["classification_report"] = w(["v_ord"], SCORED, PREDICTED, """
cls AS (SELECT DISTINCT label AS c FROM pr WHERE label IS NOT NULL)""", f"""
per AS (SELECT c, sum(CASE WHEN label = c AND pred = c THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN label <> c AND pred = c THEN 1 ELSE 0 END) AS fp,
               sum(CASE WHEN label = c AND pred <> c THEN 1 ELSE 0 END) AS fn,
               sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS support
        FROM cls JOIN pr ON TRUE GROUP BY c)""", f"""
pp AS (SELECT c, {sdiv('tp', 'tp + fp')} AS prec, {sdiv('tp', 'tp + fn')} AS rec, support FROM per)""", f"""
SELECT CAST(c AS VARCHAR) AS cls, {r6('prec')} AS precision, {r6('rec')} AS recall,
       {r6('CASE WHEN prec + rec > 0 THEN 2.0 * prec * rec / (prec + rec) ELSE 0.0 END')} AS f1,
       CAST(support AS BIGINT) AS support FROM pp
UNION ALL
SELECT 'accuracy', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
       {r6(sdiv('sum(CASE WHEN label = pred THEN 1 ELSE 0 END)', 'count(*)'))}, count(*) FROM pr""")
    q["roc_curve"] = w(["v_ord"], SCORED, *roc_cte("s"), f"""
SELECT CAST(1.01 AS DOUBLE) AS threshold,
       {r6(sdiv('coalesce((SELECT sum(fp_s) FROM st WHERE score >= 1.01), 0)', '"N"'))} AS fpr,
       {r6(sdiv('coalesce((SELECT sum(tp_s) FROM st WHERE score >= 1.01), 0)', '"P"'))} AS tpr,
       CAST(coalesce((SELECT sum(tp_s) FROM st WHERE score >= 1.01), 0) AS BIGINT) AS tp,
       CAST(coalesce((SELECT sum(fp_s) FROM st WHERE score >= 1.01), 0) AS BIGINT) AS fp FROM tot
UNION ALL
SELECT {r6('score')}, {r6(sdiv('cfp', '"N"'))}, {r6(sdiv('ctp', '"P"'))}, CAST(ctp AS BIGINT), CAST(cfp AS BIGINT)
FROM cum JOIN tot ON TRUE
UNION ALL
SELECT CAST(NULL AS DOUBLE), 1.0, 1.0, "P", "N" FROM tot""")
    q["roc_auc"] = roc_auc_sql(["v_ord"], "s", "", [SCORED])
    q["roc_auc_by_segment"] = roc_auc_sql(["v_ord"], "s", "segment", [SCORED])
    q["class_weights"] = w(["v_doc"], f"""
c AS (SELECT label, count(*) AS n FROM v_doc GROUP BY label)""", f"""
SELECT label, n, {r6('CAST(sum(n) OVER () AS DOUBLE) / CAST(count(*) OVER () * n AS DOUBLE)')} AS weight FROM c""")
    q["stratified_split"] = w(["v_doc"], f"""
r AS (SELECT id, label,
             row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS class_rank,
             count(*) OVER (PARTITION BY label) AS n_c FROM v_doc)""", """
SELECT id, label, class_rank,
       CASE WHEN class_rank <= greatest(1, round_even(CAST(n_c AS DOUBLE) * CAST(0.2 AS DOUBLE), 0))
            THEN 'test' ELSE 'train' END AS split
FROM r""")
    q["random_split"] = w(["v_ord"], """
r AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS class_rank,
             count(*) OVER () AS n FROM v_ord)""", """
SELECT id, class_rank,
       CASE WHEN class_rank <= greatest(1, round_even(CAST(n AS DOUBLE) * CAST(0.25 AS DOUBLE), 0))
            THEN 'test' ELSE 'train' END AS split
FROM r""")
    q["fold_assign"] = w(["v_ord"], folds_cte("v_ord", "id, label", 5), "SELECT id, label, class_rank, fold FROM fo")
    q["fold_assign_docs"] = w(["v_doc"], folds_cte("v_doc", "id, label", 3),
                              "SELECT id, label, class_rank, fold FROM fo")
    q["cv_summary"] = w(["v_ord"], SCORERS, FOLD_RECALL, CV, f"""
SELECT model, {r6('cv_mean')} AS cv_mean, {r6('cv_std')} AS cv_std, n_folds FROM cv""")
    q["model_comparison"] = w(["v_ord"], *COMPARISON, f"""
SELECT model, accuracy, recall, precision, f1, {r6('cv_mean')} AS cv_mean, {r6('cv_std')} AS cv_std,
       {r6('roc_auc')} AS roc_auc, CAST(model_order AS INTEGER) AS model_order FROM cmp""")
    q["best_model"] = w(["v_ord"], *COMPARISON, """
SELECT model, recall, CAST(model_order AS INTEGER) AS model_order FROM cmp
ORDER BY recall DESC, model_order ASC LIMIT 1""")
    q["label_encode"] = w(["v_doc"], """
SELECT id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang,
       CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS source FROM v_doc""")
    q["standard_scale"] = w(["v_doc"], """
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rk,
             count(*) OVER (PARTITION BY label) AS n_c FROM v_doc)""", """
sp AS (SELECT *, CASE WHEN rk <= greatest(1, round_even(CAST(n_c AS DOUBLE) * CAST(0.2 AS DOUBLE), 0))
                      THEN 'test' ELSE 'train' END AS split FROM r)""", """
st AS (SELECT avg(CAST(n_chars AS DOUBLE)) AS m1, stddev_pop(CAST(n_chars AS DOUBLE)) AS s1,
              avg(CAST(n_words AS DOUBLE)) AS m2, stddev_pop(CAST(n_words AS DOUBLE)) AS s2,
              avg(CAST(n_lines AS DOUBLE)) AS m3, stddev_pop(CAST(n_lines AS DOUBLE)) AS s3
       FROM sp WHERE split = 'train')""", f"""
SELECT id, split,
       {r6("(n_chars - m1) / CASE WHEN s1 = 0 THEN 1.0 ELSE s1 END")} AS n_chars,
       {r6("(n_words - m2) / CASE WHEN s2 = 0 THEN 1.0 ELSE s2 END")} AS n_words,
       {r6("(n_lines - m3) / CASE WHEN s3 = 0 THEN 1.0 ELSE s3 END")} AS n_lines
FROM sp JOIN st ON TRUE""")
    q["align_features"] = w(["v_ord"], f"SELECT id, {r6('amount')} AS amount, 0 AS missing_feature, tenure FROM v_ord")
    q["feature_frame"] = w(["v_ord"], f"""
SELECT label_text, urgent, segment, nation, region, priority_score, {r6('amount')} AS amount,
       {r6('balance')} AS balance, tenure, {r6('fixed_score')} AS fixed_score FROM v_ord""")
    q["knn_join"] = w(["v_emb"], KNN_PAIRS.format(cond=""), f"""
SELECT q_id, CAST(rank AS INTEGER) AS rank, nb_id, {r6('sqrt(d2)')} AS dist FROM pr WHERE rank <= 5""")
    q["self_knn"] = w(["v_emb"], KNN_PAIRS.format(cond="WHERE a.id <> b.id"), f"""
SELECT q_id, CAST(rank AS INTEGER) AS rank, nb_id, {r6('sqrt(d2)')} AS dist FROM pr WHERE rank <= 5""")
    q["knn_classify"] = w(["v_emb"], KNN_PAIRS.format(cond="WHERE a.id <> b.id"), """
cw AS (SELECT label, CAST(sum(count(*)) OVER () AS DOUBLE) / CAST(count(*) OVER () * count(*) AS DOUBLE) AS cw
       FROM v_emb GROUP BY label)""", """
nbw AS (SELECT pr.q_id, e.label, (1.0 / (sqrt(d2) + 1e-8)) * cw.cw AS wt
        FROM pr JOIN v_emb e ON e.id = pr.nb_id JOIN cw ON cw.label = e.label WHERE rank <= 5)""", f"""
SELECT q_id AS id, {r6('sum(CASE WHEN label = 1 THEN wt ELSE 0.0 END) / (sum(wt) + 1e-8)')} AS p,
       count(*) AS n_neighbours
FROM nbw GROUP BY q_id""")
    q["smote_docs"] = w(["v_doc"], *SMOTE_CTES, f"""
SELECT label, synth_index, parent_id, nb_id, {r6('lam')} AS lam,
       {", ".join(r6(f"p_{c} + lam * (n_{c} - p_{c})") + f" AS {c}" for c in SMOTE_FEATURES)},
       -(synth_index + 1) AS id
FROM gen""")
    q["smote_class_counts"] = w(["v_doc"], *SMOTE_CTES, """
SELECT label, is_synthetic, count(*) AS n FROM (
  SELECT label, FALSE AS is_synthetic FROM enc UNION ALL SELECT label, TRUE FROM gen) GROUP BY ALL""")
    q["importance_tier"] = w(["v_ord"], f"""
r AS (SELECT nation, {RATE} AS rate_pct FROM v_ord WHERE nation IS NOT NULL GROUP BY nation)""", """
k AS (SELECT * FROM r ORDER BY rate_pct DESC, nation ASC LIMIT 15)""", """
qq AS (SELECT quantile_cont(rate_pct, 0.75) AS q75, quantile_cont(rate_pct, 0.5) AS q50 FROM k)""", f"""
SELECT nation, {r6('rate_pct')} AS rate_pct,
       CASE WHEN rate_pct > q75 THEN 'high' WHEN rate_pct > q50 THEN 'medium' ELSE 'low' END AS tier
FROM k JOIN qq ON TRUE""")
    q["driver_weights"] = w(["v_ord"], f"""
r AS (SELECT nation, {RATE} AS rate_pct FROM v_ord WHERE nation IS NOT NULL GROUP BY nation)""", f"""
wt AS (SELECT nation, rate_pct - (SELECT {RATE} FROM v_ord) AS weight FROM r)""", f"""
SELECT nation, {r6('weight')} AS weight, {r6('abs(weight)')} AS abs_weight,
       CASE WHEN weight > 0 THEN 'leave' ELSE 'stay' END AS direction
FROM wt ORDER BY abs(weight) DESC, nation ASC LIMIT 10""")
    nums = ["amount", "balance", "tenure", "priority_score"]
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}, "
                      f"corr(CAST({c} AS DOUBLE), CAST(label AS DOUBLE)) AS w_{c}" for c in nums)
    unp = "\n  UNION ALL ".join(
        f"SELECT id, '{c}' AS feature, ((CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END)"
        f" * coalesce(w_{c}, 0.0) AS contribution FROM v_ord JOIN st ON TRUE" for c in nums)
    q["row_contributions"] = w(["v_ord"], f"st AS (SELECT {stats} FROM v_ord)", f"c AS ({unp})", """
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(contribution) DESC, feature ASC) AS position
       FROM c)""", f"""
SELECT id, CAST(position AS INTEGER) AS position, feature, {r6('contribution')} AS contribution,
       CASE WHEN contribution > 0 THEN 'leave' ELSE 'stay' END AS direction
FROM rk WHERE position <= 3""")
    q["read_table"] = """
SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus"""
    q["write_at_risk"] = w(["v_ord"], SCORED, f"""
SELECT id, segment, {r6(PCT)} AS p_pct, label FROM s WHERE p >= 0.40""")
    ord_cols = [("id", "bigint"), ("label", "int"), ("label_text", "string"), ("urgent", "string"),
                ("segment", "string"), ("nation", "string"), ("region", "string"), ("priority_score", "int"),
                ("amount", "double"), ("balance", "double"), ("tenure", "int"), ("fixed_score", "double")]
    q["schema_table"] = w(["v_ord"], "\nUNION ALL\n".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null "
        f"FROM v_ord" for i, (c, t) in enumerate(ord_cols)))
    kinds = {"label_text": "categorical", "urgent": "categorical", "segment": "categorical",
             "nation": "categorical", "region": "categorical", "priority_score": "numeric", "amount": "numeric",
             "balance": "numeric", "tenure": "numeric", "fixed_score": "numeric"}
    q["column_roles"] = w(["v_ord"], "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", '{k}' AS kind, count({c}) AS non_null FROM v_ord" for c, k in kinds.items()))
    q["filter_by_class"] = w(["v_ord"], f"SELECT id, label, {r6('amount')} AS amount FROM v_ord WHERE label = 1")
    q["decode_lookup"] = w(["v_doc"], """
SELECT id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS lang_code, lang FROM v_doc""")
    zterms = " + ".join(f"((CAST({c} AS DOUBLE) - m_{c}) / CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END) * "
                        f"coalesce(w_{c}, 0.0)" for c in nums)
    prob = "1.0 / (1.0 + exp(-greatest(least(z, 500.0), -500.0)))"
    q["linear_score"] = w(["v_ord"], f"st AS (SELECT {stats} FROM v_ord)", f"""
zz AS (SELECT id, -0.5 + {zterms} AS z FROM v_ord JOIN st ON TRUE)""", f"""
SELECT id, {r6(prob)} AS p, {r6('1.0 - ' + prob)} AS p_stay FROM zz""")
    return q
