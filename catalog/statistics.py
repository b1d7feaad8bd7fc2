"""Statistical test queries; p-values are checked in the tests against known values."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import SURVEY, query
from cohort import fixtures
from cohort.functions.columns import rounded
from cohort.operators import stats

S = f"WITH {SURVEY}"


def _lines(spark, sf):
    return fixtures.table(spark, sf, "lineitem")


@query("t_test", f"""{S}, g AS (SELECT target, count(*) AS n, avg(balance) AS m, var_samp(balance) AS v FROM survey GROUP BY target), p AS (
   SELECT a.target AS label_a, b.target AS label_b, a.n AS n_a, b.n AS n_b, a.m AS mean_a, b.m AS mean_b, a.m-b.m AS difference, sqrt(a.v/a.n+b.v/b.n) AS se,
     pow(a.v/a.n+b.v/b.n,2)/(pow(a.v/a.n,2)/(a.n-1)+pow(b.v/b.n,2)/(b.n-1)) AS dof, (a.m-b.m)/sqrt(((a.n-1)*a.v+(b.n-1)*b.v)/(a.n+b.n-2)) AS cohen_d
   FROM g a JOIN g b ON a.target < b.target) SELECT *, difference/se AS t FROM p""", "mean_a mean_b difference se dof cohen_d t", 4)
def _(spark, sf):
    out = stats.t_test(fixtures.survey(spark, sf), "balance", "target")
    return rounded(out.drop("p", "ci95_low", "ci95_high", "var_a", "var_b"), 4)


@query("paired_t_test", """WITH p AS (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus='F') AS x, avg(o_totalprice) FILTER (o_orderstatus='O') AS y FROM orders GROUP BY 1),
   d AS (SELECT count(*) AS n, avg(x-y) AS difference, stddev_samp(x-y)/sqrt(count(*)) AS se, sqrt((var_samp(x)+var_samp(y))/2) AS sd FROM p WHERE x IS NOT NULL AND y IS NOT NULL)
   SELECT n, difference, se, (n-1)::DOUBLE AS dof, difference/se AS t, difference/sd AS cohen_d FROM d""", "difference se t cohen_d", 4)
def _(spark, sf):
    orders = fixtures.table(spark, sf, "orders")
    out = stats.t_test(orders, "o_totalprice", "o_orderstatus", paired=True, pair_key="o_custkey", labels=["F", "O"])
    return rounded(out.drop("p", "ci95_low", "ci95_high"), 4)


def _anova(value, group, source):
    return f"""g AS (SELECT {group} AS label, count(*) AS n, avg({value}) AS m, sum(({value}-gm)^2) AS ss FROM (SELECT *, avg({value}) OVER (PARTITION BY {group}) AS gm FROM {source}) GROUP BY 1),
      a AS (SELECT count(*) AS k, sum(n)::BIGINT AS n, sum(n*pow(m-(SELECT avg({value}) FROM {source}),2)) AS ss_between, sum(ss) AS ss_within FROM g),
      t AS (SELECT *, (k-1)::DOUBLE AS df_between, (n-k)::DOUBLE AS df_within FROM a)"""


@query("anova_one_way", f"""WITH {_anova('value', 'event_type', 'events')} SELECT *, ss_between/df_between AS ms_between, ss_within/df_within AS ms_within,
   (ss_between/df_between)/(ss_within/df_within) AS f, ss_between/(ss_between+ss_within) AS eta_squared FROM t""", "ss_between ss_within ms_between ms_within f eta_squared", 4)
def _(spark, sf):
    return rounded(stats.anova_one_way(fixtures.table(spark, sf, "events"), "value", "event_type").drop("p"), 4)


@query("levene_test", f"""WITH z AS (SELECT event_type, abs(value - m) AS z FROM events JOIN (SELECT event_type, quantile_cont(value,0.5) AS m FROM events GROUP BY 1) USING (event_type)),
   {_anova('z', 'event_type', 'z')} SELECT k, n, (ss_between/df_between)/(ss_within/df_within) AS w, df_between, df_within FROM t""", "w")
def _(spark, sf):
    return rounded(stats.levene(fixtures.table(spark, sf, "events"), "value", "event_type").drop("p", "equal_var"))


@query("anova_two_way")
def _(spark, sf):
    return rounded(stats.anova_two_way(_lines(spark, sf), "l_extendedprice", "l_returnflag", "l_linestatus"), 4)


# Three levels of status leave a 2 x 2 system; with even degrees of freedom p is a finite sum.
_TAIL = "list_sum(list_transform(range(0, (df/2)::BIGINT), lambda k: exp(dw/2*ln(dw/(dw+df*f)) + lgamma(dw/2+k) - lgamma(dw/2) - lgamma(k+1.0) + k*ln(1-dw/(dw+df*f)))))"


@query("anova_two_way_orders", f"""WITH y AS (SELECT o_orderpriority AS a, o_orderstatus AS b, (o_totalprice - avg(o_totalprice) OVER ())/1000 AS y FROM orders),
   c AS MATERIALIZED (SELECT a, b, count(*)::DOUBLE AS n, avg(y) AS y, coalesce(var_samp(y), 0) AS v FROM y GROUP BY 1, 2),
   d AS (SELECT *, (b='O')::INT AS u, (b='P')::INT AS w FROM c), e AS (SELECT *, sum(n) OVER g AS na, sum(n*y) OVER g/sum(n) OVER g AS ya, sum(n*u) OVER g/sum(n) OVER g AS ua, sum(n*w) OVER g/sum(n) OVER g AS wa FROM d WINDOW g AS (PARTITION BY a)),
   s AS (SELECT sum(n*(u-ua)*(u-ua)) AS uu, sum(n*(u-ua)*(w-wa)) AS uw, sum(n*(w-wa)*(w-wa)) AS ww, sum(n*(u-ua)*(y-ya)) AS uy, sum(n*(w-wa)*(y-ya)) AS wy, sum(n*(y-ya)*(y-ya)) AS ra FROM e),
   r AS (SELECT ra, ra - (uy*(ww*uy-uw*wy) + wy*(uu*wy-uw*uy))/(uu*ww-uw*uw) AS both_ FROM s),
   b AS (SELECT sum(n*pow(y-yb,2)) AS rb FROM (SELECT *, sum(n*y) OVER (PARTITION BY b)/sum(n) OVER (PARTITION BY b) AS yb FROM c)),
   k AS (SELECT count(DISTINCT a)::DOUBLE AS ka, count(DISTINCT b)::DOUBLE AS kb, count(*)::DOUBLE AS cells, sum(n) - count(*) AS dw, sum((n-1)*v) AS sw FROM c),
   t AS (SELECT 'o_orderpriority' AS source, rb - both_ AS ss, ka - 1 AS df, dw, sw FROM r, b, k UNION ALL SELECT 'o_orderstatus', ra - both_, kb - 1, dw, sw FROM r, k
     UNION ALL SELECT 'o_orderpriority * o_orderstatus', both_, cells - ka - kb + 1, dw, sw FROM r, k),
   f AS (SELECT *, ss/df AS ms, (ss/df)/(sw/dw) AS f FROM t)
   SELECT source, ss, df, ms, f, {_TAIL} AS p, ss/(ss+sw) AS partial_eta_squared FROM f UNION ALL SELECT 'Residual', sw, dw, sw/dw, NULL, NULL, NULL FROM k""", "ss df ms f p partial_eta_squared", 4)
def _(spark, sf):
    orders = fixtures.table(spark, sf, "orders").withColumn("thousands", F.col("o_totalprice") / 1000)
    return rounded(stats.anova_two_way(orders, "thousands", "o_orderpriority", "o_orderstatus"), 4)


@query("tukey_hsd")
def _(spark, sf):
    return rounded(stats.tukey_hsd(fixtures.table(spark, sf, "events"), "value", "event_type"), 4)


@query("pairwise_t_tests")
def _(spark, sf):
    return rounded(stats.post_hoc(fixtures.table(spark, sf, "events"), "value", "event_type", "holm"), 4)


_PAIRS = """g AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1),
   p AS (SELECT a.event_type AS label_a, b.event_type AS label_b, a.n AS na, b.n AS nb, a.m-b.m AS difference, a.v AS va, b.v AS vb, ((a.n-1)*a.v+(b.n-1)*b.v)/(a.n+b.n-2) AS sp FROM g a JOIN g b ON a.event_type < b.event_type)"""


@query("pairwise_t_statistics", f"""WITH {_PAIRS}, s AS (SELECT *, CASE WHEN na<>nb THEN sqrt(va/na+vb/nb) ELSE sqrt(sp*(1.0/na+1.0/nb)) END AS se,
   CASE WHEN na<>nb THEN pow(va/na+vb/nb,2)/(pow(va/na,2)/(na-1)+pow(vb/nb,2)/(nb-1)) ELSE na+nb-2 END AS dof FROM p)
   SELECT label_a, label_b, difference, dof, difference/se AS t, difference/sqrt(sp) AS cohen_d FROM s""", "difference dof t cohen_d")
def _(spark, sf):
    out = stats.pairwise_t_tests(fixtures.table(spark, sf, "events"), "value", "event_type")
    return rounded(out.select("label_a", "label_b", "difference", "dof", "t", "cohen_d"))


@query("tukey_statistics", f"""WITH {_PAIRS}, w AS (SELECT sum((n-1)*v)/(sum(n)-count(*)) AS msw FROM g)
   SELECT label_a, label_b, difference, abs(difference)/sqrt(msw/2*(1.0/na+1.0/nb)) AS q FROM p, w""", "difference q")
def _(spark, sf):
    return rounded(stats.tukey_hsd(fixtures.table(spark, sf, "events"), "value", "event_type").select("label_a", "label_b", "difference", "q"))


@query("normality_moments", """WITH m AS (SELECT *, avg(l_quantity) OVER () AS mq, avg(l_tax) OVER () AS mt FROM lineitem),
   s AS (SELECT 'l_quantity' AS "column", count(*) AS n, avg((l_quantity-mq)^3)/pow(avg((l_quantity-mq)^2),1.5) AS skew, avg((l_quantity-mq)^4)/pow(avg((l_quantity-mq)^2),2)-3 AS kurtosis FROM m
     UNION ALL SELECT 'l_tax', count(*), avg((l_tax-mt)^3)/pow(avg((l_tax-mt)^2),1.5), avg((l_tax-mt)^4)/pow(avg((l_tax-mt)^2),2)-3 FROM m)
   SELECT *, n/6.0*(skew*skew+kurtosis*kurtosis/4) AS jb FROM s""", "skew kurtosis jb", 4)
def _(spark, sf):
    return rounded(stats.normality(_lines(spark, sf), ["l_quantity", "l_tax"]).select("column", "n", "skew", "kurtosis", "jb"), 4)


@query("normality_tests")
def _(spark, sf):
    return rounded(stats.normality(_lines(spark, sf), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4)


def _mwu(c):
    return f"""SELECT '{c}' AS "column", sum(1-target)::BIGINT AS n1, sum(target)::BIGINT AS n2, sum((1-target)*r) - sum(1-target)*(sum(1-target)+1)/2.0 AS u,
      1 - 2*(sum((1-target)*r) - sum(1-target)*(sum(1-target)+1)/2.0)/(sum(target)*sum(1-target)) AS rank_biserial
      FROM (SELECT target, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0 AS r FROM survey WHERE {c} IS NOT NULL)"""


@query("mann_whitney", f"{S} {_mwu('age')} UNION ALL {_mwu('balance')} UNION ALL {_mwu('pressure')}", "u rank_biserial")
def _(spark, sf):
    out = stats.mann_whitney(fixtures.survey(spark, sf), ["age", "balance", "pressure"], "target", 0, 1)
    return rounded(out.select("column", "n1", "n2", "u", "rank_biserial"))


def _cohen(c):
    return f"""SELECT '{c}' AS "column", count({c}) FILTER (target=1) AS n1, count({c}) FILTER (target=0) AS n2, avg({c}) FILTER (target=1) AS m1, avg({c}) FILTER (target=0) AS m2,
     (avg({c}) FILTER (target=1) - avg({c}) FILTER (target=0))/sqrt(((count({c}) FILTER (target=1)-1)*var_samp({c}) FILTER (target=1)+(count({c}) FILTER (target=0)-1)*var_samp({c}) FILTER (target=0))/(count({c})-2)) AS cohen_d FROM survey"""


@query("cohen_d", f"""{S} SELECT *, CASE WHEN abs(cohen_d) < 0.2 THEN 'very small' WHEN abs(cohen_d) < 0.5 THEN 'small' WHEN abs(cohen_d) < 0.8 THEN 'medium' ELSE 'large' END AS size
   FROM ({_cohen('age')} UNION ALL {_cohen('balance')} UNION ALL {_cohen('pressure')})""", "m1 m2 cohen_d", 4)
def _(spark, sf):
    return rounded(stats.cohen_d(fixtures.survey(spark, sf), ["age", "balance", "pressure"], "target", 1, 0), 4)


def _chi(c):
    return f"""(WITH o AS (SELECT {c} AS l, target AS t, count(*) AS n FROM survey GROUP BY ALL), r AS (SELECT l, sum(n) AS rn FROM o GROUP BY l), c AS (SELECT t, sum(n) AS cn FROM o GROUP BY t),
      full_ AS (SELECT coalesce(n,0) AS n, rn*cn/(SELECT sum(n) FROM o) AS e FROM r CROSS JOIN c LEFT JOIN o USING (l,t)),
      d AS (SELECT (SELECT count(*) FROM r) AS rr, (SELECT count(*) FROM c) AS cc, (SELECT sum(n) FROM o)::BIGINT AS n)
     SELECT '{c}' AS "column", any_value(d.n) AS n, any_value((rr-1)*(cc-1)) AS dof, sum(pow(abs(full_.n-e) - CASE WHEN (rr-1)*(cc-1)=1 THEN least(0.5, abs(full_.n-e)) ELSE 0 END,2)/e) AS chi2,
       any_value(least(rr,cc)-1) AS k FROM full_, d)"""


@query("chi_square", f"""{S}, x AS ({_chi('gender')} UNION ALL {_chi('sensitive')} UNION ALL {_chi('city')}), v AS (SELECT *, sqrt(chi2/(n*k)) AS cramers_v FROM x)
   SELECT "column", n, dof, chi2, cramers_v, CASE WHEN cramers_v < 0.1 THEN 'very small' WHEN cramers_v < 0.3 THEN 'small' WHEN cramers_v < 0.5 THEN 'medium' ELSE 'large' END AS size FROM v""", "chi2 cramers_v")
def _(spark, sf):
    return rounded(stats.chi_square(fixtures.survey(spark, sf), ["gender", "sensitive", "city"], "target").drop("p"))


_ODDS = """odds AS (SELECT "column", level, reference, pos, neg, CASE WHEN level=reference THEN 1.0::DOUBLE ELSE (pos+0.5)*(rn+0.5)/((neg+0.5)*(rp+0.5)) END AS odds_ratio FROM (
   SELECT *, first_value(level) OVER w AS reference, first_value(pos) OVER w AS rp, first_value(neg) OVER w AS rn FROM (
     SELECT 'priority' AS "column", priority AS level, sum(target)::BIGINT AS pos, sum(1-target)::BIGINT AS neg FROM survey GROUP BY 2
     UNION ALL SELECT 'city', city, sum(target)::BIGINT, sum(1-target)::BIGINT FROM survey GROUP BY 2) WINDOW w AS (PARTITION BY "column" ORDER BY level)))"""


@query("odds_ratios", f"{S}, {_ODDS} SELECT * FROM odds", "odds_ratio")
def _(spark, sf):
    return rounded(stats.odds_ratios(fixtures.survey(spark, sf), ["priority", "city"], "target"))


@query("extreme_odds", f"""{S}, {_ODDS} SELECT "column", max(odds_ratio) AS max_or, min(odds_ratio) AS min_or, (list(level ORDER BY abs(ln(odds_ratio)) DESC, level))[1] AS extreme_level,
   (list(odds_ratio ORDER BY abs(ln(odds_ratio)) DESC, level))[1] AS extreme_or FROM odds GROUP BY 1""", "max_or min_or extreme_or")
def _(spark, sf):
    return rounded(stats.extreme_odds(stats.odds_ratios(fixtures.survey(spark, sf), ["priority", "city"], "target")))


def _spearman(a, b):
    r = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0"
    return f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, corr(ra, rb) AS r FROM (SELECT {r(a)} AS ra, {r(b)} AS rb FROM survey WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


@query("spearman", f"{S} {_spearman('age', 'balance')} UNION ALL {_spearman('age', 'target')} UNION ALL {_spearman('balance', 'target')}", "r")
def _(spark, sf):
    return rounded(stats.correlation(fixtures.survey(spark, sf), ["age", "balance", "target"], "spearman"))


def _kendall(a, b):
    return f"""(WITH c AS (SELECT {a} AS x, {b} AS y, count(*) AS n FROM lineitem GROUP BY ALL),
      p AS (SELECT sum(CASE WHEN u.y < v.y THEN u.n*v.n ELSE 0 END)::DOUBLE AS concordant, sum(CASE WHEN u.y > v.y THEN u.n*v.n ELSE 0 END)::DOUBLE AS discordant FROM c u JOIN c v ON u.x < v.x),
      t AS (SELECT (SELECT sum(k*(k-1)/2.0) FROM (SELECT sum(n) AS k FROM c GROUP BY x)) AS tx, (SELECT sum(k*(k-1)/2.0) FROM (SELECT sum(n) AS k FROM c GROUP BY y)) AS ty, (SELECT sum(n) FROM c)::BIGINT AS n)
      SELECT '{a}' AS x, '{b}' AS y, n, concordant, discordant, (concordant-discordant)/sqrt((n*(n-1)/2.0-tx)*(n*(n-1)/2.0-ty)) AS r FROM p, t)"""


@query("kendall_tau", f"{_kendall('l_quantity', 'l_discount')}", "r")
def _(spark, sf):
    return rounded(stats.kendall(_lines(spark, sf), "l_quantity", "l_discount"))


_KS = lambda c: f"""SELECT '{c}' AS "column", (SELECT count({c}) FROM survey WHERE family_history='No') AS n1, (SELECT count({c}) FROM survey WHERE family_history='Yes') AS n2,
   max(abs(c1/(SELECT count({c}) FROM survey WHERE family_history='No') - c2/(SELECT count({c}) FROM survey WHERE family_history='Yes'))) AS d FROM (
   SELECT sum((family_history='No')::INT) OVER w AS c1, sum((family_history='Yes')::INT) OVER w AS c2 FROM survey WHERE {c} IS NOT NULL WINDOW w AS (ORDER BY {c} RANGE UNBOUNDED PRECEDING))"""  # noqa: E731


@query("ks_two_sample", f"{S} {_KS('age')} UNION ALL {_KS('price')} UNION ALL {_KS('pressure')}", "d")
def _(spark, sf):
    return rounded(stats.ks_two_sample(fixtures.survey(spark, sf), ["age", "price", "pressure"], "family_history", "No", "Yes").drop("p", "similar"))


@query("partial_correlation", """WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS xy, corr(l_quantity, l_tax) AS xz, corr(l_extendedprice, l_tax) AS yz, count(*) AS n FROM lineitem)
   SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, n, (xy - xz*yz)/sqrt((1-xz*xz)*(1-yz*yz)) AS r FROM r""", "r")
def _(spark, sf):
    return rounded(stats.partial_correlation(_lines(spark, sf), "l_quantity", "l_extendedprice", ["l_tax"]).select("x", "y", "n", "r"))


@query("linear_regression_one", """WITH s AS (SELECT regr_slope(l_extendedprice,l_quantity) AS b, regr_intercept(l_extendedprice,l_quantity) AS a, regr_r2(l_extendedprice,l_quantity) AS r2, count(*) AS n FROM lineitem)
   SELECT 'l_quantity' AS term, b AS coef, n, r2 FROM s UNION ALL SELECT 'intercept', a, n, r2 FROM s""", "coef r2", 4)
def _(spark, sf):
    return rounded(stats.linear_regression(_lines(spark, sf), "l_extendedprice", ["l_quantity"]).select("term", "coef", "n", "r2"), 4)


@query("linear_regression")
def _(spark, sf):
    return rounded(stats.linear_regression(_lines(spark, sf), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))


@query("logistic_inference")
def _(spark, sf):
    df = fixtures.survey(spark, sf).withColumn("flag", (F.col("sensitive") == "Yes").cast("int"))
    return rounded(stats.logistic_regression(df, "target", ["flag", "age", "pressure"]))


@query("factor_analysis")
def _(spark, sf):
    lines = _lines(spark, sf).withColumn("net", F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")))
    return rounded(stats.factor_analysis(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net"], 2)["loadings"])
