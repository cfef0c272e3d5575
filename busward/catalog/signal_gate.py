"""Queries over decoded signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from busward.catalog.leakage import fit_rows
from busward.catalog.registry import cte, query
from busward.operators import signals, windows

SIGNALS = ("s1", "s2", "s3", "s4")
# Values and changes that a signal of an ID must have to be active.
MIN_VALUES, MIN_DELTAS = 200, 100


def _scale_sql(value: str, table: str, least: int) -> str:
    return (f"SELECT can_id, m AS center, greatest(1.4826e0 * median(abs({value} - m)), (quantile_cont({value}, 0.75::DOUBLE) - quantile_cont({value}, 0.25::DOUBLE)) / 1.349e0, "
            f"0.05e0, 1e-4 * greatest(abs(m), 1e0)) AS scale FROM (SELECT *, median({value}) OVER (PARTITION BY can_id) AS m, count({value}) OVER (PARTITION BY can_id) AS n "
            f"FROM {table}) WHERE n >= {least} AND {value} IS NOT NULL GROUP BY 1, 2")


cte(
    sig_delta="SELECT *, " + ", ".join(f"{s} - lag({s}) OVER w AS delta_{s}" for s in SIGNALS) + " FROM signals WINDOW w AS (PARTITION BY capture, can_id ORDER BY seq)",
    fit_delta="SELECT s.* FROM sig_delta s JOIN sig_roles g ON g.capture = s.capture AND g.role = 'profile_fit'",
    **{f"pv_{s}": _scale_sql(s, "fit_delta", MIN_VALUES) for s in SIGNALS},
    **{f"pd_{s}": _scale_sql(f"delta_{s}", "fit_delta", MIN_DELTAS) for s in SIGNALS},
    profile="SELECT * FROM (SELECT DISTINCT can_id FROM (" + " UNION ALL ".join(f"SELECT can_id FROM pv_{s}" for s in SIGNALS) + ")) "
    + " ".join(f"LEFT JOIN (SELECT can_id, center AS vc_{s}, scale AS vs_{s} FROM pv_{s}) USING (can_id) "
               f"LEFT JOIN (SELECT can_id, center AS dc_{s}, scale AS ds_{s} FROM pd_{s}) USING (can_id)" for s in SIGNALS),
    sig_z="SELECT d.*, p.can_id IS NOT NULL AS known, list_sort(list_filter([" + ", ".join(f"abs((d.{s} - vc_{s}) / vs_{s})" for s in SIGNALS)
    + "], lambda x: x IS NOT NULL)) AS zv, list_sort(list_filter([" + ", ".join(f"abs((delta_{s} - dc_{s}) / ds_{s})" for s in SIGNALS)
    + "], lambda x: x IS NOT NULL)) AS zd, CASE WHEN p.can_id IS NULL OR " + " OR ".join(f"(vc_{s} IS NULL AND d.{s} IS NOT NULL)" for s in SIGNALS)
    + " OR (" + " AND ".join(f"(vc_{s} IS NULL OR d.{s} IS NULL)" for s in SIGNALS) + ") THEN 1 ELSE 0 END AS unknown_signal "
    + "FROM sig_delta d LEFT JOIN profile p ON p.can_id = d.can_id",
)


def _q90(z: str) -> str:
    at = f"(len({z}) - 1) * 0.9e0"
    low = f"{z}[floor({at})::INTEGER + 1]"
    return f"CASE WHEN len({z}) > 0 THEN {low} + ({z}[ceil({at})::INTEGER + 1] - {low}) * ({at} - floor({at})) ELSE 0e0 END"


cte(
    sig_scores=f"""SELECT capture, seq, can_id, label, unknown_signal, CASE WHEN NOT known THEN 50e0 WHEN unknown_signal = 1 THEN greatest(a, 50e0) ELSE a END AS marginal_score,
  CASE WHEN NOT known THEN 50e0 WHEN unknown_signal = 1 THEN greatest(b, 50e0) ELSE b END AS transition_score FROM (SELECT *, {_q90('zv')} AS a, {_q90('zd')} AS b FROM sig_z)""",
    sig_windows="""SELECT capture, seq // 20 AS window_index, max(label) AS attack_target, avg(label) AS attack_row_fraction, avg(unknown_signal) AS unknown_signal_fraction,
  """ + ", ".join(f"quantile_cont({s}, 0.95::DOUBLE) AS {s}_q95, max({s}) AS {s}_max, list_avg(list_sort(list({s}), 'DESC')[1:3]) AS {s}_top3_mean"
                  for s in ("marginal_score", "transition_score")) + " FROM sig_scores GROUP BY 1, 2 HAVING count(*) = 20",
)


def deltas(t):
    def build():
        rows = t.staged("signals", t.signals)
        return signals.with_deltas(rows, SIGNALS, rows.count())
    return t.staged("signal_deltas", build)


def profile(t):
    def build():
        rows = fit_rows(t, deltas(t))
        return signals.profile_table(rows, rows, SIGNALS, MIN_VALUES, MIN_DELTAS,
                                     lambda name, table: t.staged(f"signal_{name}_counted", lambda: table))
    return t.staged("signal_profile", build)


def scores(t):
    return t.staged("signal_scores", lambda: signals.row_scores(deltas(t), profile(t), SIGNALS))


@query("e10_signal_scales", "can_id:i " + " ".join(f"v_center_{s}:d v_scale_{s}:d d_center_{s}:d d_scale_{s}:d" for s in SIGNALS),
       "SELECT can_id, " + ", ".join(f"vc_{s} AS v_center_{s}, vs_{s} AS v_scale_{s}, dc_{s} AS d_center_{s}, ds_{s} AS d_scale_{s}" for s in SIGNALS) + " FROM profile")
def e10(t):
    return profile(t)


# Standardized values of the active signals in rows of (ID, row, place), their moments, and the inverse by elimination.
cte(
    zrow="SELECT can_id, row_number() OVER () AS r, list_filter([" + ", ".join(
        f"CASE WHEN vc_{s} IS NOT NULL THEN coalesce((d.{s} - vc_{s}) / vs_{s}, 0e0) END" for s in SIGNALS) + "], lambda x: x IS NOT NULL) AS z FROM fit_delta d JOIN profile USING (can_id)",
    zlong="SELECT can_id, r, i, v - avg(v) OVER (PARTITION BY can_id, i) AS c FROM (SELECT can_id, r, unnest(z) AS v, generate_subscripts(z, 1) AS i FROM zrow)",
    moment="""SELECT a.can_id, a.i, b.i AS j, count(*) AS n, avg(a.c * b.c) AS second, avg((a.c * b.c) * (a.c * b.c)) AS fourth
  FROM zlong a JOIN zlong b ON a.can_id = b.can_id AND a.r = b.r GROUP BY 1, 2, 3""",
    spread="SELECT *, avg(CASE WHEN i = j THEN second END) OVER (PARTITION BY can_id) AS variance FROM moment",
    shrink="""SELECT *, CASE WHEN distance > 0 THEN least(noise, distance) / distance ELSE 0e0 END AS shrinkage FROM (
  SELECT can_id, max(i) AS p, any_value(n) AS n, sum((second - CASE WHEN i = j THEN variance ELSE 0e0 END) ** 2) AS distance, sum(fourth - second * second) / any_value(n) AS noise
  FROM spread GROUP BY 1)""",
    shrunk="SELECT can_id, i, j, s.n, p, shrinkage, (1 - shrinkage) * second + shrinkage * CASE WHEN i = j THEN variance ELSE 0e0 END AS covariance FROM spread s JOIN shrink USING (can_id)",
    elim="""SELECT can_id, p, n, shrinkage, 0 AS k, list(row ORDER BY i) AS m FROM (
  SELECT can_id, i, any_value(p) AS p, any_value(n) AS n, any_value(shrinkage) AS shrinkage,
    list(covariance ORDER BY j) || [CASE WHEN x = i THEN 1e0 ELSE 0e0 END for x in range(1, any_value(p) + 1)] AS row FROM shrunk GROUP BY 1, 2) GROUP BY 1, 2, 3, 4
  UNION ALL SELECT can_id, p, n, shrinkage, k + 1, [[CASE WHEN i = k + 1 THEN m[k + 1][j] / m[k + 1][k + 1] ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END
    for j in range(1, 2 * p + 1)] for i in range(1, p + 1)] FROM elim WHERE k < p""",
    precise="""SELECT can_id, p, n, CASE WHEN p = 1 THEN 0e0 ELSE shrinkage END AS shrinkage,
  CASE WHEN p = 1 THEN [[1e0]] ELSE [[m[i][p + j] for j in range(1, p + 1)] for i in range(1, p + 1)] END AS m FROM elim WHERE k = p""",
    sig_form="SELECT *, list_sum([zz[i] * list_sum([zz[j] * m[i][j] for j in range(1, q.p + 1)]) for i in range(1, q.p + 1)]) / q.p AS form FROM (SELECT z.*, list_filter(["
    + ", ".join(f"CASE WHEN vc_{s} IS NOT NULL THEN coalesce((z.{s} - vc_{s}) / vs_{s}, 0e0) END" for s in SIGNALS)
    + "], lambda x: x IS NOT NULL) AS zz FROM sig_z z LEFT JOIN profile f ON f.can_id = z.can_id) s LEFT JOIN precise q ON q.can_id = s.can_id",
)


def precision(t):
    return t.staged("signal_precision", lambda: signals.precision_matrices(fit_rows(t, deltas(t)), profile(t), SIGNALS))


@query("e10_shrunk_covariance", "can_id:i one:i two:i rows:i shrinkage:d covariance:d",
       "SELECT can_id, i AS one, j AS two, n AS rows, shrinkage, covariance FROM shrunk")
def e10_covariance(t):
    fitted = signals.shrunk_covariances(fit_rows(t, deltas(t)), profile(t), SIGNALS)
    one = fitted.select("can_id", "rows", "shrinkage", F.posexplode("covariance").alias("i", "row"))
    two = one.select("can_id", "rows", "shrinkage", (F.col("i") + 1).alias("one"), F.posexplode("row").alias("j", "covariance"))
    return two.withColumn("two", F.col("j") + 1)


@query("e10_precision_profile", "can_id:i signals:i rows:i shrinkage:d trace:d",
       "SELECT can_id, p AS signals, n AS rows, shrinkage, list_sum([m[i][i] for i in range(1, p + 1)]) AS trace FROM precise")
def e10_precision(t):
    diagonal = F.transform(F.sequence(F.lit(0), F.size("precision") - 1), lambda i: F.get(F.get("precision", i), i))
    return precision(t).select("can_id", F.size("active").alias("signals"), "rows", "shrinkage",
                               F.aggregate(diagonal, F.lit(0.0), lambda a, x: a + x).alias("trace"))


@query("e11_row_scores", "capture seq:i can_id:i marginal_score:d transition_score:d", "SELECT * FROM sig_scores")
def e11(t):
    return scores(t)


@query("e11_context_score", "capture seq:i can_id:i context_score:d",
       "SELECT capture, seq, can_id, CASE WHEN unknown_signal = 1 THEN greatest(c, 50e0) ELSE c END AS context_score FROM (SELECT *, coalesce(sqrt(greatest(form, 0e0)), 50e0) AS c FROM sig_form)")
def e11_context(t):
    return signals.context_score(scores(t), profile(t), precision(t), SIGNALS)


@query("e12_novelty", "capture can_id:i rows:i novel_rows:i",
       "SELECT capture, can_id, count(*) AS rows, sum(unknown_signal) AS novel_rows FROM sig_scores GROUP BY 1, 2")
def e12(t):
    return scores(t).groupBy("capture", "can_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("unknown_signal").alias("novel_rows"))


@query("w14_window_reducers", "capture window_index:i attack_target:i attack_row_fraction:d unknown_signal_fraction:d "
       + " ".join(f"{s}_{r}:d" for s in ("marginal_score", "transition_score") for r in ("q95", "max", "top3_mean")), "SELECT * FROM sig_windows")
def w14(t):
    return windows.score_reducers(scores(t), 20, ["marginal_score", "transition_score"])
