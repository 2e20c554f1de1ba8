"""DuckDB SQL for the registered queries (the oracle side of the correctness check).

Each statement reads the driver's pre-registered views (``events``,
``customer``, ``lineitem``) and recomputes the same result independently of
Spark.  Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from txnwatch.sources.fixture import FIXTURE_FORMATS, SCORED_SQL, TXN_SQL
from txnwatch.schema import N_NEGATIVES, SEED, pay_column

N_SAMPLE_NEGATIVES = 2000     # sampling query: negatives kept next to every positive
SPLIT_SEED = 42
EXPLAIN_SAMPLE = 1000
TARGET = 0.75
# A fixed linear model for the attribution queries: feature -> weight, centre, scale, background mean of z.
LINEAR = {
    "amount_paid": (0.8, 5000.0, 4000.0, 0.1), "sender_24h_count": (1.5, 2.0, 1.5, -0.2), "sender_24h_volume": (0.4, 9000.0, 8000.0, 0.0),
    "amt_vs_7d_avg": (-0.7, 1.0, 0.5, 0.3), "unique_receivers_24h": (0.9, 2.0, 1.0, 0.05), "is_round_1000": (0.2, 0.01, 0.0, 0.0),
    "rapid_exit_risk": (0.3, 2.0, 3.0, -0.1), "pay_click": (-0.5, 0.2, 0.4, 0.0), "pay_error": (0.6, 0.2, 0.4, 0.1),
    "pay_purchase": (0.1, 0.2, 0.4, 0.0), "pay_signup": (-0.3, 0.2, 0.4, 0.0), "pay_view": (0.25, 0.2, 0.4, -0.05),
}
LINEAR_INTERCEPT = -2.0

TXN = f"t as ({TXN_SQL})"
TIMED = "s as (select *, epoch_us(ts) // 1000000 as ts_sec from t)"

_pay = ",\n       ".join(f"cast(payment_format = '{p}' as int) as {pay_column(p)}" for p in FIXTURE_FORMATS)

SILVER = f"""silver as (
select txn_id, ts_sec, from_bank, from_account, to_bank, to_account, amount_paid, payment_format, label, typology,
       cast(count(*) over w24 as int) as sender_24h_count,
       sum(amount_paid) over w24 as sender_24h_volume,
       amount_paid / (avg(amount_paid) over w7 + 1e-6) as amt_vs_7d_avg,
       cast(count(distinct to_account) over w24 as int) as unique_receivers_24h,
       cast((amount_paid % 1000) = 0 as int) as is_round_1000,
       (sum(amount_paid) over w24) / (amount_paid + 1e-6) as rapid_exit_risk,
       cast(from_bank <> to_bank as int) as is_interbank,
       {_pay}
from s
window w24 as (partition by from_account order by ts_sec range between 86399 preceding and current row),
       w7 as (partition by from_account order by ts_sec range between 604799 preceding and current row))"""

SILVER_CTES = f"with {TXN}, {TIMED}, {SILVER}"

SCORED = f"sc as ({SCORED_SQL})"
SCORE_TABLE = """g as (select prob as score, cast(sum(label) as bigint) as pos, cast(sum(1 - label) as bigint) as neg
       from sc group by prob),
c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as cum_pos,
             sum(neg) over (order by score desc rows between unbounded preceding and current row) as cum_neg,
             sum(pos) over () as P, sum(neg) over () as N from g),
curve as (select score as threshold, cum_pos / (cum_pos + cum_neg) as precision,
                 case when P = 0 then 1.0 else cum_pos / P end as recall from c)"""
RANK_CTES = f"with {SCORED}, {SCORE_TABLE}"

RULE_SQL = [("large_amount", "amount_paid > 10000"),
            ("high_velocity", "sender_24h_count > 3"),
            ("round_number", "(amount_paid % 1000) = 0"),
            ("interbank_risk", "is_interbank = 1 and amount_paid > 5000")]
_rules_flags = ",\n       ".join(f"cast(coalesce({e}, false) as int) as {n}" for n, e in RULE_SQL)
_rules_any = "greatest(" + ", ".join(f"cast(coalesce({e}, false) as int)" for _, e in RULE_SQL) + ")"

HASH = "cast(('0x' || substr(md5('{seed}:' || cast({key} as varchar)), 1, 8)) as bigint)"


def _sample_ctes(n_neg: int = N_SAMPLE_NEGATIVES, seed: int = SPLIT_SEED) -> str:
    h = HASH.format(seed=seed, key="txn_id")
    return f"""{SILVER_CTES},
neg as (select *, {h} as h, row_number() over (order by {h}, txn_id) as rn from silver where label = 0),
sample as (select * exclude (h, rn) from neg where rn <= {n_neg}
           union all select * from silver where label = 1)"""


def _split_ctes(seed: int = SPLIT_SEED, n_neg: int = N_SAMPLE_NEGATIVES) -> str:
    h = HASH.format(seed=seed + 1, key="txn_id")
    return f"""{_sample_ctes(n_neg, seed)},
ranked as (select *, row_number() over (partition by label order by {h}, txn_id) as r,
                  count(*) over (partition by label) as n_c from sample),
split as (select * exclude (r, n_c),
                 case when r <= floor(0.6 * n_c) then 'train'
                      when r <= floor(0.8 * n_c) then 'val' else 'test' end as split from ranked)"""


def _phi(f: str) -> str:
    w, centre, scale, background = LINEAR[f]
    z = f"(coalesce(cast({f} as double), 0) - {centre}) / {scale}" if scale else "0"
    return f"cast({w} as double) * ({z} - ({background}))"


_LINEAR_BASE = " + ".join(f"{w} * ({m})" for w, _, _, m in LINEAR.values())
_LINEAR_BASE = f"round(cast({LINEAR_INTERCEPT} + {_LINEAR_BASE} as double), 6)"
_WIDE = ", ".join(f"{_phi(f)} as phi_{f}" for f in LINEAR)


def _long_phi(rows: str) -> str:
    """One row per transaction and feature of ``rows``."""
    return "\nunion all ".join(f"select txn_id, '{f}' as feature, coalesce(cast({f} as double), 0) as value, {_phi(f)} as phi from {rows}"
                               for f in LINEAR)


def _summary_sql(rows: str) -> str:
    return f"""f as (select label, {_rules_any} as pred from {rows}),
a as (select count(*) filter (where pred = 1 and label = 1) as tp, count(*) filter (where pred = 1 and label <> 1) as fp,
             count(*) filter (where pred <> 1 and label = 1) as fn, count(*) as n from f)
select 'Rule-based system (4 rules)' as system, tp + fp as alerts, tp as true_positives, fp as false_positives,
       round(tp / greatest(tp + fn, 1), 6) as recall, round(tp / greatest(tp + fp, 1), 6) as precision,
       round((tp + fp) / n, 6) as alert_rate from a"""


def _breakdown_sql(rows: str) -> str:
    return f"""f as (select label, {_rules_flags} from {rows}),
l as (select 'large_amount' as rule, large_amount as fired, label from f
      union all select 'high_velocity', high_velocity, label from f
      union all select 'round_number', round_number, label from f
      union all select 'interbank_risk', interbank_risk, label from f)
select rule, cast(sum(fired) as bigint) as alerts,
       round(case when sum(fired) > 0 then sum(fired * label) / sum(fired) else 0.0 end, 4) as precision,
       round(case when sum(label) > 0 then sum(fired * label) / sum(label) end, 4) as recall
from l group by rule"""


def _silver_select() -> str:
    pays = ", ".join(pay_column(p) for p in FIXTURE_FORMATS)
    return f"""select txn_id, from_account, label, ts_sec, amount_paid, sender_24h_count,
       round(sender_24h_volume, 6) as sender_24h_volume, round(amt_vs_7d_avg, 6) as amt_vs_7d_avg,
       unique_receivers_24h, is_round_1000, round(rapid_exit_risk, 6) as rapid_exit_risk, is_interbank, {pays}
from silver"""


#: What must hold in the tables of any full run (``gold_invariants``): no row against it.
INVARIANTS = [
    "champion has the best validation precision (F6, J9)",
    "every model logs its threshold, seconds and settings (A9)",
    "run ids belong to the benchmark (A9)",
    "row ids are unique (A7)",
    "scores are probabilities (J7)",
    "alerts are the highest scores (F2)",
    "reasons fall in effect (M4, F5)",
    "no feature passes the third reason but the first two (M4)",
    "base and effects add up to the score (M1, M3)",
    "a point for every feature of the sample (M6)",
    "gains are not negative and come from splits (J6)",
]


def oracle_sql() -> dict[str, str]:
    pos_type = "cast(sum(cast(label = 1 and typology is not null as int)) as bigint)"
    return {
        "gold_invariants": "select * from (values " + ", ".join(f"('{r}', 0::BIGINT)" for r in INVARIANTS) + ") t(rule, broken)",
        "txn_fixture": f"""with {TXN}, {TIMED}
select txn_id, ts_sec, from_bank, from_account, to_bank, to_account, amount_paid, payment_format, label, typology
from s""",
        "velocity_alerts": f"""{SILVER_CTES}
select txn_id, from_account, ts_sec, sender_24h_count, round(sender_24h_volume, 6) as sender_24h_volume
from silver where sender_24h_count > 3""",
        "silver_features": f"{SILVER_CTES}\n{_silver_select()}",
        "feature_class_means": f"""{SILVER_CTES}
select label, round(avg(amount_paid), 3) as amount_paid, round(avg(sender_24h_count), 3) as sender_24h_count,
       round(avg(sender_24h_volume), 3) as sender_24h_volume, round(avg(amt_vs_7d_avg), 3) as amt_vs_7d_avg,
       round(avg(unique_receivers_24h), 3) as unique_receivers_24h, round(avg(is_round_1000), 3) as is_round_1000,
       round(avg(rapid_exit_risk), 3) as rapid_exit_risk, round(avg(is_interbank), 3) as is_interbank
from silver group by label""",
        "silver_reconcile": f"""{SILVER_CTES}
select (select count(*) from silver) as silver_rows, (select count(*) from t) as bronze_rows,
       (select count(*) from silver) = (select count(*) from t) as rows_match""",
        "ingest_profile": f"""with {TXN}
select count(*) as rows, cast(sum(label) as bigint) as positives,
       cast(sum(cast(ts is null as int)) as bigint) as null_timestamps,
       cast(sum(cast(typology is not null as int)) as bigint) as rows_with_typology,
       {pos_type} as positives_with_typology,
       round(sum(label) / count(*), 6) as positive_rate
from t""",
        "typology_counts": f"""with {TXN}
select typology, count(*) as count from t where label = 1 group by typology""",
        "rule_breakdown": f"{SILVER_CTES},\n{_breakdown_sql('silver')}",
        "rules_summary": f"{SILVER_CTES},\n{_summary_sql('silver')}",
        "ranking_summary": f"""{RANK_CTES}
select cast(max(P) as bigint) as positives, cast(max(N) as bigint) as negatives,
       round(sum(case when P > 0 then pos / P * cum_pos / (cum_pos + cum_neg) else 0 end), 6) as auprc,
       round(case when max(P) > 0 and max(N) > 0
                  then sum(pos * (N - cum_neg + neg / 2.0)) / (max(P) * max(N)) end, 6) as roc_auc
from c""",
        "pr_curve": f"""{RANK_CTES}
select threshold, round(precision, 6) as precision, round(recall, 6) as recall from curve
union all select null, 1.0, 0.0""",
        "threshold_for_recall": f"""{RANK_CTES}
select coalesce(max(case when recall >= {TARGET} then threshold end), 0.5) as threshold from curve""",
        "baseline_lift": f"""{RANK_CTES},
s2 as (select max(P) as P, max(N) as N,
              sum(case when P > 0 then pos / P * cum_pos / (cum_pos + cum_neg) else 0 end) as ap from c)
select round(P / (P + N), 6) as positive_rate, round(ap, 6) as auprc,
       round(case when P > 0 then ap / (P / (P + N)) end, 6) as lift from s2""",
        "tradeoff": f"""{RANK_CTES}
select threshold, round(precision, 6) as precision, round(recall, 6) as recall from curve""",
        "operating_point": f"""{RANK_CTES},
thr as (select coalesce(max(case when recall >= {TARGET} then threshold end), 0.5) as v from curve),
p as (select * from curve where threshold >= (select v from thr) order by threshold limit 1)
select (select threshold from p) as threshold, round(coalesce((select precision from p), 1.0), 6) as precision,
       round(coalesce((select recall from p), 0.0), 6) as recall""",
        "confusion": f"""{RANK_CTES},
thr as (select coalesce(max(case when recall >= {TARGET} then threshold end), 0.5) as v from curve)
select count(*) filter (where prob < (select v from thr) and label = 0) as tn,
       count(*) filter (where prob >= (select v from thr) and label = 0) as fp,
       count(*) filter (where prob < (select v from thr) and label = 1) as fn,
       count(*) filter (where prob >= (select v from thr) and label = 1) as tp from sc""",
        "precision_at_k": f"""with {SCORED},
r as (select label, row_number() over (order by prob desc, l_orderkey, l_linenumber) as rk from sc),
n as (select count(*) as n from sc)
""" + "\nunion all\n".join(
            f"select {k} as k, case when (select n from n) >= {k} then round(avg(label), 6) end as precision_at_k "
            f"from r where rk <= {k}" for k in (100, 1000, 5000)),
        "top_alerts": f"""with {SCORED}
select * from sc order by prob desc, l_orderkey, l_linenumber limit 1000""",
        "top_case": f"""with {SCORED}
select * from sc where label = 1 order by prob desc, l_orderkey, l_linenumber limit 1""",
        "rules_vs_model": _rules_vs_model_sql(),
        "pattern_lookup": f"""with {RAW}
select * from lk""",
        "ingest_roundtrip": f"""with {RAW}
select r.ts_min, r.from_bank, r.from_account, r.to_bank, r.to_account, r.amount_paid, r.payment_format, r.label,
       lk.typology
from r left join lk on r.ts_min = lk.ts_min and r.from_bank = lk.from_bank and r.from_account = lk.from_account
     and r.to_bank = lk.to_bank and r.to_account = lk.to_account and r.amount_paid = lk.amount_paid
     and r.payment_currency = lk.payment_currency and r.payment_format = lk.payment_format""",
        "reason_codes_zscore": _reason_codes_sql(),
        "behaviour_fp_reduction": f"""with cmp as ({_rules_vs_model_sql()})
select round(1 - max(false_positives) filter (where system like '%same recall as rules')
             / greatest(max(false_positives) filter (where system like 'Rule-based%'), 1), 6) as fp_reduction from cmp""",
        "threshold_metrics": f"""{RANK_CTES},
thr as (select coalesce(max(case when recall >= {TARGET} then threshold end), 0.5) as v from curve),
m as (select count(*) filter (where prob < (select v from thr) and label = 0) as tn,
       count(*) filter (where prob >= (select v from thr) and label = 0) as fp,
       count(*) filter (where prob < (select v from thr) and label = 1) as fn,
       count(*) filter (where prob >= (select v from thr) and label = 1) as tp from sc)
select *, tp + fp as alerts, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision,
       round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall from m""",
        "linear_attributions": f"""{SILVER_CTES},
a as (select txn_id, {_WIDE} from silver)
select txn_id, {_LINEAR_BASE} as base, {", ".join(f"round(phi_{f}, 6) as phi_{f}" for f in LINEAR)} from a""",
        "linear_global_drivers": f"""{SILVER_CTES},
a as ({_long_phi("silver")})
select feature, round(avg(abs(phi)), 6) as mean_abs_shap from a group by feature""",
        "linear_case_breakdown": f"""{SILVER_CTES},
top as (select * from silver where label = 1 order by round(amt_vs_7d_avg, 3) desc, txn_id limit 1),
a as ({_long_phi("top")})
select feature, round(phi, 6) as contribution, {_LINEAR_BASE} as base from a""",
        "linear_points": f"""{_split_ctes()},
te as (select *, {HASH.format(seed=SPLIT_SEED, key='txn_id')} as h from split where split = 'test'),
smp as (select * from te order by h, txn_id limit {EXPLAIN_SAMPLE}),
a as ({_long_phi("smp")})
select txn_id, feature, round(value, 6) as value, round(phi, 6) as attribution from a""",
        "split_membership": f"""{_split_ctes()}
select txn_id, label, split from split""",
        "class_weights": f"""{_split_ctes()},
k as (select label, count(*) as n, sum(count(*)) over () as total,
             sum(case when label = 0 then count(*) else 0 end) over () as neg from split where split = 'train' group by label)
select 'balanced' as weighting, label, n as rows, round(total / (2.0 * n), 6) as weight from k
union all select 'positive', label, n, round(case when label = 1 then neg / n else 1.0 end, 6) from k""",
        "training_matrix": f"""{_sample_ctes()}
select txn_id, {", ".join(f"round(coalesce(cast({f} as double), 0), 6) as {f}" for f in LINEAR)} from sample""",
        "interbank_lookup": f"""{_split_ctes()}
select s.txn_id, s.label, silver.is_interbank from split s left join silver using (txn_id) where s.split = 'test'""",
        "test_rule_breakdown": f"""{_split_ctes()},
te as (select * from split where split = 'test'),
{_breakdown_sql("te")}""",
        "pattern_counts": f"""with {RAW}
select (select count(*) from r where src_typology is not null) as parsed_records, (select count(*) from lk) as unique_records""",
        "test_prediction_ids": f"""{_split_ctes(SEED, N_NEGATIVES)}
select txn_id, label from split where split = 'test'""",
        "rbs_rules_row": f"""{_split_ctes(SEED, N_NEGATIVES)},
te as (select * from split where split = 'test'),
{_summary_sql("te")}""",
        "training_sample": f"""{_sample_ctes()}
select txn_id, label, typology, sender_24h_count, round(amt_vs_7d_avg, 6) as amt_vs_7d_avg from sample""",
        "class_counts": f"""{_sample_ctes()}
select label, count(*) as count from sample group by label""",
        "split_counts": f"""{_split_ctes()}
select split, label, count(*) as rows from split group by split, label""",
        "explain_sample": f"""{_split_ctes()},
te as (select *, {HASH.format(seed=SPLIT_SEED, key='txn_id')} as h from split where split = 'test')
select txn_id, label from te order by h, txn_id limit {EXPLAIN_SAMPLE}""",
    }


RAW = f"""{TXN},
r as (select strftime(ts, '%Y/%m/%d %H:%M') as ts_min, cast(from_bank as varchar) as from_bank,
             cast(from_account as varchar) as from_account, cast(to_bank as varchar) as to_bank,
             cast(to_account as varchar) as to_account, amount_paid, 'US Dollar' as payment_currency,
             payment_format, label, typology as src_typology from t),
lk as (select ts_min, from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format,
              min(src_typology) as typology
       from r where src_typology is not null
       group by ts_min, from_bank, from_account, to_bank, to_account, amount_paid, payment_currency, payment_format)"""

_REASON_FEATURES = ["amount_paid", "sender_24h_count", "sender_24h_volume", "amt_vs_7d_avg",
                    "unique_receivers_24h", "rapid_exit_risk"] + [pay_column(p) for p in FIXTURE_FORMATS]


def _reason_codes_sql() -> str:
    z = ", ".join(f"{{'v': (x.{f} - (select m_{f} from st)) / (select s_{f} from st), 'i': {i}, 'name': '{f}'}}"
                  for i, f in enumerate(_REASON_FEATURES))
    stats = ", ".join(f"avg({f}) as m_{f}, stddev_samp({f}) as s_{f}" for f in _REASON_FEATURES)
    return f"""{SILVER_CTES},
st as (select {stats} from silver),
a as (select x.txn_id, list_sort(list_transform([{z}], lambda e: {{'nv': -e.v, 'i': e.i, 'name': e.name, 'v': e.v}}))
             as srt from silver x),
b as (select txn_id, srt[1] as r1, srt[2] as r2, srt[3] as r3 from a)
select txn_id, r1.name as reason_1, r2.name as reason_2, r3.name as reason_3,
       round(r1.v, 6) as reason_1_shap, round(r2.v, 6) as reason_2_shap, round(r3.v, 6) as reason_3_shap from b"""


def _rules_vs_model_sql() -> str:
    """Rules against a behaviour score (rounded 7-day deviation) on the whole silver table."""
    flags = _rules_flags
    return f"""{SILVER_CTES},
sc as (select txn_id, label, round(amt_vs_7d_avg, 3) as prob, greatest(large_amount, high_velocity, round_number,
              interbank_risk) as rbs
       from (select *, {flags} from silver)),
g as (select prob as score, cast(sum(label) as bigint) as pos, cast(sum(1 - label) as bigint) as neg
      from sc group by prob),
c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as cum_pos,
             sum(pos) over () as P from g),
thr as (select coalesce(max(case when (case when P = 0 then 1.0 else cum_pos / P end) >= {TARGET}
                                  then score end), 0.5) as v from c),
r as (select *, row_number() over (order by prob desc, txn_id) as rk,
             sum(label) over (order by prob desc, txn_id rows between unbounded preceding and current row) as cum_tp
      from sc),
k as (select count(*) filter (where rbs = 1 and label = 1) as k from sc),
n_alerts as (select case when (select k from k) = 0 then 0
                         else (select min(rk) from r where cum_tp >= (select k from k)) end as n),
flags as (select label, rbs, cast(prob >= (select v from thr) as int) as own,
                 cast(rk <= (select n from n_alerts) as int) as matched from r),
summ as (
  select 'Rule-based system (4 rules)' as system,
         count(*) filter (where rbs = 1 and label = 1) as tp, count(*) filter (where rbs = 1 and label = 0) as fp,
         count(*) filter (where rbs = 0 and label = 1) as fn, count(*) as n from flags
  union all
  select 'amt_vs_7d_avg @ threshold ' || printf('%.3f', (select v from thr)),
         count(*) filter (where own = 1 and label = 1), count(*) filter (where own = 1 and label = 0),
         count(*) filter (where own = 0 and label = 1), count(*) from flags
  union all
  select 'amt_vs_7d_avg @ same recall as rules',
         count(*) filter (where matched = 1 and label = 1), count(*) filter (where matched = 1 and label = 0),
         count(*) filter (where matched = 0 and label = 1), count(*) from flags)
select system, tp + fp as alerts, tp as true_positives, fp as false_positives,
       round(tp / greatest(tp + fn, 1), 6) as recall, round(tp / greatest(tp + fp, 1), 6) as precision,
       round((tp + fp) / n, 6) as alert_rate from summ"""
