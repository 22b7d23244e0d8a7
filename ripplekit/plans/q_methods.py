"""All causal methods over targets, steps, treatments, sources and placebos."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .. import roles
from ..estimators import multi as M
from ..estimators import synth as SC
from ..functions.dates import WEEKDAYS, holiday_flag, weekday_name
from ..operators import windows as W
from ..operators.aggregates import effect_summary
from ..operators.events import daily_treatment
from ..operators.reshape import one_hot_drop_first
from ..operators.sampling import bootstrap_within, hash_fold, resample_global
from ..operators.spine import fill_on_spine
from ..session import materialize
from ..sources import views as V
from ..sources.tables import dim
from .registry import query

TARGETS = ("media_online_protest", "media_print_protest")
LAGS = list(range(-6, 1))


def wide_design(spark, d, p, treatments, targets=TARGETS, steps=(0, 1, 7), cumulative=True, shift_instruments: int = 0, name="methods"):
    """Stored design with all lags, responses and instruments, and its plan.  One shuffle on the unit."""
    area = dim(spark, d, "nation").join(dim(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")) \
        .select(F.col("n_name").alias("unit"), F.col("r_name").alias("area"))
    p = p.join(F.broadcast(area), "unit").repartition("unit").withColumn("wd", weekday_name("day"))
    p = p.select("*", *one_hot_drop_first("wd", WEEKDAYS, "weekday"), holiday_flag("day", "area").alias("holiday"))
    lags = W.lag_block(p, [*treatments, *targets], LAGS, keep=roles.design_lag)
    if shift_instruments:  # an instrument that comes after the treatment can not move it
        lags = lags.withColumns({z: W.shift(z, -shift_instruments) for z in V.INSTR_COLS})
    ys = {f"y__{t}__{s}": (t, s) for t in targets for s in steps}
    lags = lags.withColumns({c: W.cumulative_target(t, s) if cumulative else W.lead_target(t, s) for c, (t, s) in ys.items()})
    control = [c for c in lags.columns if c.startswith("media_") and "_lag" in c] \
        + [f"weekday_{w}" for w in sorted(WEEKDAYS)[1:]] + ["holiday"]
    designs = {}
    for t in treatments:  # all events together stand alone; kinds of events control for each other
        own = [t] if t == "occ_protest" else [x for x in treatments if x != "occ_protest"]
        designs[f"{t}_lag0"] = [c for x in own for c in lags.columns if c.startswith(f"{x}_lag")] + control
    xs = list(dict.fromkeys(c for cols in designs.values() for c in cols))
    inst = [c for c in V.INSTR_COLS if c in lags.columns]
    out = lags.select(hash_fold(F.concat_ws("|", "unit", F.col("day").cast("string")), 5, 1).cast("int").alias("fold"),
                      F.xxhash64("unit", "day").alias("h"), *[F.col(c).cast("double").alias(c) for c in [*xs, *ys, *inst]])
    return materialize(out.dropna(subset=xs), f"{name}_design"), M.Plan(designs, ys, inst)


def synthetic_rows(p, treatments, targets, steps, start=None):
    """The synthetic control's mean cumulative effect by step, in the runner's columns."""
    parts = []
    for t in treatments:
        sc = SC.synthetic_control(p, list(targets), 28, max(steps) + 1, treatment=t, start=start, scale="demean")
        s = effect_summary(SC.effect_table(sc, cumulative=True).where(F.col("rel_day").isin(list(steps))), ["outcome", "rel_day"], "effect")
        parts.append(s.select(F.lit("synthetic_control").alias("method"), F.lit("att").alias("estimand"), F.lit(f"{t}_lag0").alias("treatment"),
                              F.col("outcome").alias("target"), F.col("rel_day").alias("step"), F.col("mean").alias("coef"), "ci_lower",
                              "ci_upper", "n", F.lit(True).alias("settled")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("methods_grid")
def methods_grid(spark, d):
    """Regression, 2SLS, LIML, propensity weighting, doubly robust and synthetic control for all targets x steps."""
    p = V.panel(spark, d, with_instruments=True)
    design, plan = wide_design(spark, d, p, ["occ_protest"])
    return M.run_methods(design, plan).unionByName(synthetic_rows(p, ["occ_protest"], TARGETS, (0, 1, 7), V.START))


@query("weighting_ci")
def weighting_ci(spark, d):
    """ATT and ATE on fitted, cross-fitted scores with bootstrap intervals."""
    design, plan = wide_design(spark, d, V.panel(spark, d), ["occ_protest"], TARGETS[:1], (7,), name="weighting")
    return M.run_methods(design, plan, ("propensity_weighting", "doubly_robust"))


def source_panel(spark, d, source):
    """The panel whose treatment days come from the events of one source only."""
    e = V.evall(spark, d).where(F.col("source") == source).select(
        F.col("region").alias("unit"), "day", F.col("type").alias("actor"), F.col("size_pre").alias("size"), "notes")
    t = daily_treatment(e, V.ACTORS).select("unit", "day", "occ_protest", *[f"occ_{a}" for a in V.ACTORS])
    occ = ["occ_protest", *[f"occ_{a}" for a in V.ACTORS]]
    return fill_on_spine(V.panel(spark, d, with_instruments=True).drop(*occ), t, fill={c: 0 for c in occ})


@query("groups_grid")
def groups_grid(spark, d):
    """Sources x treatments (all events, each kind) x methods, one runner call for each source."""
    parts = []
    for source in ("acled", "gpreg"):
        design, plan = wide_design(spark, d, source_panel(spark, d, source), ["occ_protest", *[f"occ_{a}" for a in V.ACTORS]],
                                   TARGETS[:1], (7,), name=f"groups_{source}")
        parts.append(M.run_methods(design, plan).withColumn("source", F.lit(source)))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("placebo_grid")
def placebo_grid(spark, d):
    """The runner on placebos: treatment resampled within units, over all units, instruments of a later week, and the
    outcome before the event."""
    p = V.panel(spark, d, with_instruments=True).select("unit", "day", "occ_protest", TARGETS[0], *V.INSTR_COLS)
    cases = {
        "treatment_regional": dict(p=bootstrap_within(p, "unit", "day", ["occ_protest"], seed=17)),
        "treatment_global": dict(p=resample_global(p, ["unit", "day"], ["occ_protest"], seed=18).select(*p.columns)),
        "instruments_shifted": dict(p=p, shift_instruments=7),
        "outcome_before": dict(p=p, steps=(-7, -1), cumulative=False),
    }
    parts = []
    for name, case in cases.items():
        design, plan = wide_design(spark, d, case.pop("p"), ["occ_protest"], TARGETS[:1], **{"steps": (7,), **case}, name=f"placebo_{name}")
        kinds = [m for m in M.METHODS if m.startswith("instr")] if name == "instruments_shifted" else M.METHODS
        parts.append(M.run_methods(design, plan, kinds).withColumn("placebo", F.lit(name)))
    return reduce(lambda a, b: a.unionByName(b), parts)
