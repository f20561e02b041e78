"""Write the executed (AQE-final) physical plans of Q1-Q8 to docs/PLANS.md.

    python tools/show_plans.py [sf_dir]

The star is conformed from ``sf_dir`` and written to the session's
checkpoint directory first, so the plans are the ones the queries run with
over a stored star; Q6 is also shown end to end from the raw tables.
"""

from __future__ import annotations

import os
import re
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HERE)

from tillstar.plans import analytics as A  # noqa: E402
from tillstar.plans.conform import star_from_dir  # noqa: E402
from tillstar.session import local_session, scratch_path  # noqa: E402
from tillstar.sources.parquet_store import read_star, write_star  # noqa: E402

QUERIES = [
    ("Q1 kpi_overview", A.kpi_overview),
    ("Q2 category_performance", A.category_performance),
    ("Q3 channel_performance", A.channel_performance),
    ("Q4 region_performance", A.region_performance),
    ("Q5 customers_by_loyalty_tier", A.customers_by_loyalty_tier),
    ("Q6 top_selling_products(10)", lambda s: A.top_selling_products(s, 10)),
    ("Q7 monthly_revenue_trends(1998)", lambda s: A.monthly_revenue_trends(s, 1998)),
    ("Q8 top_customers(10)", lambda s: A.top_customers(s, 10)),
]


def final_plan(df) -> str:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    # drop expression ids and plan ids to keep the text readable
    text = re.sub(r"#\d+L?", "", text)
    text = re.sub(r", \[plan_id=\d+\]", "", text)
    return text.split("+- == Initial Plan ==")[0]


def scans(df) -> list[str]:
    jvm = df.sparkSession._jvm
    text = jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    out = []
    for block in text.split("\n\n"):
        if "Scan parquet" in block and "Location" in block:
            loc = re.search(r"Location: .*\[(.*)\]", block)
            table = os.path.basename(loc.group(1)) if loc else "?"
            pushed = re.search(r"PushedFilters: (.*)", block)
            schema = re.search(r"ReadSchema: (.*)", block)
            out.append(f"- `{table}` pushed: `{pushed.group(1) if pushed else '[]'}`  \n"
                       f"  read: `{schema.group(1) if schema else ''}`")
    return sorted(set(out))


def main(argv) -> None:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(extra={"spark.sql.maxMetadataStringLength": "10000",
                                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2m"})
    root = scratch_path(spark, "plans-star")
    write_star(star_from_dir(spark, sf_dir), root)
    star = read_star(spark, root)
    parts = ["# Executed plans\n",
             f"Generated by `tools/show_plans.py` over a stored star conformed from `{sf_dir}`, "
             "local[*], AQE on. Expression ids removed.\n"]
    for title, fn in QUERIES:
        df = fn(star)
        parts.append(f"## {title}\n\nScans:\n\n" + "\n".join(scans(df)) + "\n\n```\n" + final_plan(df) + "```\n")
    raw = A.top_selling_products(star_from_dir(spark, sf_dir), 10)
    parts.append("## Q6 end to end from the driver tables\n\nScans:\n\n" + "\n".join(scans(raw))
                 + "\n\n```\n" + final_plan(raw) + "```\n")
    os.makedirs(os.path.join(HERE, "docs"), exist_ok=True)
    with open(os.path.join(HERE, "docs", "PLANS.md"), "w") as fh:
        fh.write("\n".join(parts))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
