"""Scheduled jobs: `spark-submit jobs.py {monitor,train,retrain} DATA RESULTS [SALES_FILES]`.

`retrain` with a pattern of sales files reads only those that are new or have changed.
"""

from __future__ import annotations

import sys

from demandloom.plans.flow import PlanningFlow
from demandloom.session import get_session


def run(job: str, flow: PlanningFlow, files: str | None = None) -> None:
    if job == "monitor":
        print(flow.monitor())
    elif job == "retrain" and files:
        print(flow.retrain(files))
    elif job in ("train", "retrain"):
        flow.train()
    else:
        raise ValueError(f"unknown job {job!r}")


if __name__ == "__main__":
    name, data, results, *files = sys.argv[1:]
    run(name, PlanningFlow(get_session(f"demandloom-{name}"), data, results), *files)
