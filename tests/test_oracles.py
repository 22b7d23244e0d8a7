"""Spark plans vs their DuckDB oracle SQL on the sf0.001 tables (row count,
column names, order-insensitive value digest).  A representative subset by
default; RIPPLEKIT_FULL=1 runs every key that has an oracle."""
import os

import pytest

import __spark_entry__ as E
from tools.check import digest

SUBSET = ["event_lift", "daily_treatment", "spine_fill", "source_select", "cancel_filter", "outlier_trim",
          "cutover_union", "donor_pool", "event_window", "contamination", "offset_lookup", "climatology", "theta_min",
          "neighbour_exclude", "substring_join", "totals_row", "top10_weights", "resample_week", "quantiles",
          "weighted_mean", "wald_screen", "corr_matrix", "argmin_bias", "threshold_sweep", "overview_table",
          "lags", "cum_target", "ewm", "deseason", "centred_rolling", "prescale", "logdiff_roundtrip", "interpolate",
          "ffill_edges", "pivot_unit_day", "one_hot", "ragged_to_table", "bootstrap_unit", "resample_global",
          "placebo_events", "parse_quantity", "org_labels", "boilerplate_clean", "kwic", "sessionize", "html_text",
          "text_history", "bh_by", "ipw_att", "wald_binary", "baseline_auc", "scaled_donor_mean", "donor_pool_size",
          "csv_roundtrip", "partitioned_scan", "service_counts", "rolling_auc", "best_f1", "pr_curve", "movable_feasts",
          "number_words", "size_tags", "contamination_modes", "day_text_series", "word_count_summary"]

KEYS = sorted(E.oracle_sql()) if os.environ.get("RIPPLEKIT_FULL") else SUBSET


@pytest.mark.parametrize("name", KEYS)
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, "/root/testdata/sf0.001")
    srows = [tuple(r) for r in df.collect()]
    cur = duck.execute(E.oracle_sql()[name])
    dcols = [c[0] for c in cur.description]
    drows = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(df.columns, srows)[0] == digest(dcols, drows)[0]


def test_every_query_has_callable():
    qs = E.queries()
    assert len(qs) >= 150
    assert set(E.oracle_sql()) <= set(qs)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 25
    assert df.columns == ["unit", "event_days", "n_days", "mean_event", "mean_other", "lift"]
