"""Queries I01-I18 over the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricepanel.functions.expressions import bin_index
from pricepanel.operators import sampling as sm
from pricepanel.operators.calendar import bars
from pricepanel.operators.panel import UNIVERSE_SQL, panel, table, universe
from pricepanel.plans.calendar_queries import ORIGINS, YEARS, origins
from pricepanel.plans.feature_queries import K, P
from pricepanel.plans.registry import query
from pricepanel.plans.trend_queries import FIT, KT, samples

SEED = 7


def h(*keys: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(f'{k}::VARCHAR' for k in keys)}))"


@query(f"{P} SELECT issue_id FROM (SELECT DISTINCT issue_id FROM panel) ORDER BY {h('issue_id')}, issue_id LIMIT 5")
def i01_random_securities(spark, d):
    return sm.random_ids(panel(spark, d), 5, SEED)


@query(f"{P}, r AS (SELECT issue_id, row_number() OVER (ORDER BY issue_id) AS n, count(*) OVER () AS c FROM (SELECT DISTINCT issue_id FROM panel)) SELECT issue_id, CASE WHEN n <= c // 2 THEN 'train' ELSE 'val' END AS split FROM r")
def i02_split_securities(spark, d):
    return sm.split_ids(panel(spark, d))


@query(f"{P}, r AS (SELECT {K}, row_number() OVER (ORDER BY {h('issue_id', 'date')}, issue_id, date) AS n, count(*) OVER () AS c FROM panel) SELECT {K}, CASE WHEN n <= floor(0.8 * c) THEN 'train' ELSE 'val' END AS split FROM r")
def i03_random_row_split(spark, d):
    return sm.random_split(panel(spark, d).select("issue_id", "date"), ["issue_id", "date"], 0.8, SEED)


@query(f"{FIT}, r AS (SELECT {KT}, label, row_number() OVER (PARTITION BY label ORDER BY {h('issue_id', 'test_date')}, issue_id, test_date) AS n FROM samples) SELECT {KT}, label FROM r WHERE n <= (SELECT min(c) FROM (SELECT count(*) AS c FROM samples GROUP BY label))")
def i04_class_balance(spark, d):
    return sm.balanced(samples(spark, d).select("issue_id", "test_date", "label"), "label", ["issue_id", "test_date"], SEED)


@query(
    f"""{FIT}, b AS (SELECT {KT}, least(greatest(floor((residual_label + 15) / 3.0)::INT, 0), 9) AS bin FROM samples), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {h('issue_id', 'test_date')}, issue_id, test_date) AS n, count(*) OVER (PARTITION BY bin) AS c FROM b),
    draws AS (SELECT bin, k::INT AS copy, (('0x' || substr(md5(concat_ws('|', '{SEED}', bin::VARCHAR, k::VARCHAR)), 1, 8))::BIGINT % c) + 1 AS n FROM (SELECT bin, count(*) AS c FROM b GROUP BY 1), range(1, 101) t(k) WHERE c < 100)
    SELECT issue_id, test_date, bin, 0 AS copy FROM r WHERE c >= 100 AND n <= 100 UNION ALL SELECT issue_id, test_date, bin, copy FROM r JOIN draws USING (bin, n)"""
)
def i05_residual_bin_balance(spark, d):
    rows = samples(spark, d).select("issue_id", "test_date", bin_index(F.col("residual_label"), -15.0, 15.0, 10, clip=True).alias("bin"))
    return sm.balanced_bins(rows, "bin", ["issue_id", "test_date"], 100, SEED)


TAGGED = f"{FIT}, g AS (SELECT {KT}, label, issue_id::INT % 3 = 0 AS synthetic FROM samples)"


def _tagged(spark, d):
    return samples(spark, d).select("issue_id", "test_date", "label", (F.col("issue_id").cast("int") % 3 == 0).alias("synthetic"))


@query(f"{TAGGED}, r AS (SELECT *, row_number() OVER (PARTITION BY label, synthetic ORDER BY {h('issue_id', 'test_date')}, issue_id, test_date) AS n FROM g) SELECT {KT}, label, synthetic FROM r WHERE n <= CASE WHEN synthetic THEN 62 ELSE 188 END")
def i06_synthetic_share_balance(spark, d):
    return sm.synthetic_share_balance(_tagged(spark, d), "label", "synthetic", ["issue_id", "test_date"], 750, 0.25, SEED)


@query(f"{TAGGED}, c AS (SELECT label, count(*) FILTER (synthetic) AS s, count(*) FILTER (NOT synthetic) AS r FROM g GROUP BY 1), p AS (SELECT share, floor(least(s / share, r / (1 - share)))::BIGINT AS cap FROM c, (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS share)) SELECT share, min(cap) AS per_class, (min(cap) * count(*))::BIGINT AS total FROM p GROUP BY 1")
def i06_synthetic_caps(spark, d):
    return sm.synthetic_caps(_tagged(spark, d), "label", "synthetic", [0.25, 0.5, 0.75])


@query(f"{P} SELECT issue_id, date, cl_adj_loc FROM panel UNION ALL SELECT issue_id || '_synthetic_0', date, round(cl_adj_loc) FROM panel")
def i07_real_and_synthetic(spark, d):
    real = panel(spark, d).select("issue_id", "date", "cl_adj_loc")
    made = real.select(F.concat("issue_id", F.lit("_synthetic_0")).alias("issue_id"), F.col("date").cast("string").alias("date"), F.round("cl_adj_loc").cast("long").alias("cl_adj_loc"))
    return sm.appended(real, made)


SECTORED = f"{P}, {UNIVERSE_SQL}"


@query(f"WITH {UNIVERSE_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY {h('issue_id')}, issue_id) AS n FROM universe), k AS (SELECT *, count(*) OVER (PARTITION BY sector) AS c FROM r WHERE n <= floor(22.0 / (SELECT count(DISTINCT sector) FROM universe) + 0.5)) SELECT issue_id, sector, CASE WHEN n <= c // 2 THEN 'train' ELSE 'val' END AS split FROM k")
def i08_sector_allocation(spark, d):
    return sm.sector_allocation(universe(spark, d), 22, SEED)


@query(
    f"""{SECTORED}, s AS (SELECT issue_id, date, sector, row_number() OVER (PARTITION BY sector ORDER BY {h('issue_id', 'date')}, issue_id, date) AS batch, count(*) OVER (PARTITION BY sector) AS c, count(*) OVER () AS a FROM panel JOIN universe USING (issue_id))
    SELECT issue_id, date, sector, batch, c / a AS weight FROM s WHERE batch <= (SELECT min(c) FROM s)""",
    "weight",
)
def i09_matched_batches(spark, d):
    rows = panel(spark, d).select("issue_id", "date").join(universe(spark, d), "issue_id")
    return sm.matched_batches(rows, "sector", ["issue_id", "date"], SEED).select("issue_id", "date", "sector", "batch", "weight")


@query(
    f"""{SECTORED}, q AS (SELECT sector, count(*) AS c, sum(count(*)) OVER () AS a FROM panel JOIN universe USING (issue_id) GROUP BY 1), quota AS (SELECT sector, round_even(c / a * 8, 0)::INT AS quota FROM q),
    e AS (SELECT u.issue_id, u.sector, row_number() OVER (PARTITION BY sector ORDER BY {h('issue_id')}, issue_id) AS n FROM universe u WHERE issue_id IN ({YEARS}))
    SELECT issue_id, sector FROM e JOIN quota USING (sector) ORDER BY CASE WHEN n <= quota THEN 0 ELSE 1 END, {h('issue_id')}, issue_id LIMIT 8"""
)
def i10_stratified_sample(spark, d):
    from pricepanel.operators.calendar import full_year_ids

    rows = panel(spark, d).select("issue_id").join(universe(spark, d), "issue_id")
    eligible = universe(spark, d).join(full_year_ids(panel(spark, d), "1995-01-01", "2001-12-31"), "issue_id", "left_semi")
    return sm.stratified_ids(rows, eligible, 8, SEED)


FIRST, LAST = "1996-01-01", "1996-12-31"


@query(
    f"""{P}, wk AS (SELECT issue_id, (date_trunc('week', date + 2) + INTERVAL 4 DAY)::DATE AS date, arg_max(cl_adj_loc, date) AS cl_adj_loc FROM panel GROUP BY 1, 2), i AS (SELECT * FROM wk WHERE date BETWEEN DATE '{FIRST}' AND DATE '{LAST}'), g AS (SELECT issue_id, date, cl_adj_loc AS x FROM (SELECT DISTINCT issue_id FROM i) CROSS JOIN (SELECT DISTINCT date FROM i) LEFT JOIN i USING (issue_id, date)),
    k AS (SELECT *, avg(CASE WHEN x IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY issue_id) AS s FROM g), f AS (SELECT issue_id, date, last_value(x IGNORE NULLS) OVER (PARTITION BY issue_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS x FROM k WHERE s >= 0.5),
    c AS (SELECT a.issue_id AS a, b.issue_id AS b, abs(corr(a.x, b.x)) AS c FROM f a JOIN f b USING (date) WHERE a.issue_id < b.issue_id AND a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT issue_id, round(avg(c), 9) AS mean_abs_corr FROM (SELECT a AS issue_id, c FROM c UNION ALL SELECT b, c FROM c) WHERE c IS NOT NULL AND NOT isnan(c) GROUP BY 1)
    SELECT * FROM m ORDER BY mean_abs_corr, issue_id LIMIT 5""",
    "mean_abs_corr",
)
def i11_least_correlated(spark, d):
    weekly = bars(panel(spark, d), "cl_adj_loc", "weekly").withColumnRenamed("bar", "date")
    return sm.least_correlated(weekly, "cl_adj_loc", FIRST, LAST, 5)


def _dense(spark, d):
    return panel(spark, d).select("issue_id", "date", "cl_adj_loc")


@query(f"{ORIGINS} SELECT issue_id, origin_date, row_number() OVER (PARTITION BY issue_id ORDER BY {h('issue_id', 'origin_date')}, origin_date) AS turn FROM origins ORDER BY turn, issue_id LIMIT 25")
def i12_round_robin(spark, d):
    return sm.round_robin(origins(spark, d), 25, SEED).select("issue_id", "origin_date", "turn")


@query(f"{ORIGINS} SELECT issue_id, origin_date, k::INT AS iteration FROM origins, range(4) t(k) ORDER BY issue_id, origin_date, k LIMIT 90")
def i13_path_expansion(spark, d):
    return sm.expanded(origins(spark, d).select("issue_id", "origin_date"), 4, 90)


@query(f"{P}, y AS (SELECT issue_id, year(date) AS y, max(cl_adj_loc) / min(cl_adj_loc) < 1.6 AS ok FROM panel GROUP BY 1, 2) SELECT issue_id, y FROM y WHERE ok ORDER BY {h('issue_id', 'y')}, issue_id, y LIMIT 12")
def i14_first_valid(spark, d):
    paths = panel(spark, d).groupBy("issue_id", F.year("date").alias("y")).agg((F.max("cl_adj_loc") / F.min("cl_adj_loc") < 1.6).alias("ok"))
    return sm.first_valid(paths, "ok", ["issue_id", "y"], 12, SEED).select("issue_id", "y")


@query("SELECT l_suppkey::VARCHAR AS issue_id, l_shipdate::DATE AS date, avg(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2", "l_quantity", 4)
def i15_mean_of_duplicates(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("issue_id"), F.to_date("l_shipdate").alias("date"), "l_quantity")
    return sm.mean_of_duplicates(lines, "l_quantity")


@query(f"{P}, r AS (SELECT issue_id, row_number() OVER (ORDER BY issue_id) - 1 AS n, count(*) OVER () AS c FROM (SELECT DISTINCT issue_id FROM panel)) SELECT issue_id FROM r WHERE n IN (0, (c - 1) // 2, c - 1)")
def i16_evenly_spaced(spark, d):
    return sm.evenly_spaced(panel(spark, d))


@query(f"{P} SELECT issue_id, min(date) AS date, arg_min(cl_adj_loc, date) AS cl_adj_loc FROM panel GROUP BY 1")
def i17_first_row_per_group(spark, d):
    return sm.first_per_group(_dense(spark, d), ["issue_id"], ["date"])


@query(f"{P}, a AS (SELECT DISTINCT issue_id FROM panel WHERE vo_adj > 120), b AS (SELECT DISTINCT issue_id FROM panel WHERE cl_adj_loc > 130) SELECT issue_id, 'both' AS side FROM a WHERE issue_id IN (SELECT issue_id FROM b) UNION ALL SELECT issue_id, 'first' FROM a WHERE issue_id NOT IN (SELECT issue_id FROM b)")
def i18_set_operations(spark, d):
    rows = panel(spark, d)
    a, b = rows.where("vo_adj > 120").select("issue_id").distinct(), rows.where("cl_adj_loc > 130").select("issue_id").distinct()
    return a.intersect(b).withColumn("side", F.lit("both")).union(a.join(b, "issue_id", "left_anti").withColumn("side", F.lit("first")))
