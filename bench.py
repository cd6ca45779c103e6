"""Headline queries on local[$BENCH_CPUS]; prints one JSON line.

The session is warmed up by one untimed run of the first query (JVM start and
just-in-time compilation); every query is then timed once, from the tables to
its last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sentria.operators import bayes, shrinkage  # noqa: E402
from sentria.operators.contingency import contingency  # noqa: E402
from sentria.operators.counts import pair_counts_from_tables  # noqa: E402
from sentria.operators.disproportionality import cells, rfet  # noqa: E402
from sentria.plans.registry import registry  # noqa: E402
from sentria.session import local_session  # noqa: E402
from sentria.sources.star_views import view  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Registered queries, from the tables to the last row.
END_TO_END = (
    "a1_pair_counts_from_tables",
    "a1_pair_counts_pt",
    "a6_contingency",
    "d1_prr",
    "d9_signals_pt",
    "d9_signals_hlt",
    "d10_signals_quarter",
    "d11_cumulative_contingency",
    "d12_cumulative_ic",
    "d13_error_rates_null_probability",
    "f11_search_reports",
    "f13_restrict",
    "j1_add_hierarchy",
    "a7_report_series",
    "a11_serious_reasons",
    "a14_age_histogram",
    "a17_top_drugs",
    "a18_drugs_per_report",
    "a26_pair_series",
    "a28_nested_series",
    "a32_nested_top_generic",
    "a33_nested_top_hlt",
)


def _run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=max(8, int(CPUS)))
    times: dict[str, float] = {}

    def timed(name: str, make) -> None:
        start = time.perf_counter()
        _run(make())
        times[name] = round(time.perf_counter() - start, 3)

    queries = registry()
    _run(queries[END_TO_END[0]](spark, SF_DIR))
    for name in END_TO_END:
        timed(name, lambda: queries[name](spark, SF_DIR))

    # Statistics on a materialised contingency frame, as in the published scratch figures.
    counts = pair_counts_from_tables(
        view(spark, SF_DIR, "report_drug"), view(spark, SF_DIR, "reactions"), "DRUGNAME", "PT_NAME_ENG"
    )
    ct = contingency(counts, "DRUGNAME", "PT_NAME_ENG").cache()
    ct.count()
    timed("cached_d4_exact_test", lambda: rfet(cells(ct)))
    timed("cached_d6_bcpnn", lambda: bayes.bcpnn(ct))
    start = time.perf_counter()
    prior = shrinkage.gps_fit(ct)
    times["cached_d8a_gps_fit"] = round(time.perf_counter() - start, 3)
    timed("cached_d8b_gps", lambda: shrinkage.gps(ct, prior))
    timed("cached_d7_bcpnn_mc_10000", lambda: bayes.bcpnn_mc(ct, draws=10_000))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").split("sf")[-1],
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
