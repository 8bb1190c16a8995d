"""Headline timings: prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each job is forced end to end through the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from mixtext.operators import errors as ER  # noqa: E402
from mixtext.operators import evaluate as E  # noqa: E402
from mixtext.operators import features as FE  # noqa: E402
from mixtext.operators import models as M  # noqa: E402
from mixtext.operators import prep  # noqa: E402
from mixtext.operators.scoring import function_word_scorer, score  # noqa: E402
from mixtext.plans import documents as D  # noqa: E402
from mixtext.session import local_session, materialize  # noqa: E402

FIT_ITERS = 20  # fixed L-BFGS budget: the fit figure is time per 20 iterations


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = local_session(cores=cpus, shuffle_partitions=max(2 * cpus, 8), app="mixtext-bench")
    times: dict[str, float] = {}
    rows: dict[str, int] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    n_raw = D.raw_documents(spark, sf_dir).count()
    # warm-up: JVM / Python worker start, not part of any figure
    run(D.projected(spark, "/root/testdata/sf0.001"))

    timed("clean", lambda: run(D.projected(spark, sf_dir)))
    prepared = timed("clean_dedupe", lambda: materialize(D.prepared(spark, sf_dir), "bench_prepared"))
    rows["prepared"] = prepared.count()
    split = timed("split", lambda: materialize(prep.stratified_split(prepared), "bench_split"))
    train = split.where("split = 'train'").drop("split")
    test = split.where("split = 'test'").drop("split")

    def tfidf():
        run(FE.tfidf_from_docs(train, table=materialize))

    timed("tfidf", tfidf)
    model = function_word_scorer()
    scored = timed("score", lambda: materialize(score(test, model), "bench_scored"))

    def evaluate():
        run(E.class_report(scored))
        run(E.confusion_cells(scored, model.classes))

    timed("evaluate", evaluate)

    def errors():
        out = ER.error_analysis(scored, model, top_n=20)
        run(out["summary"])
        run(out["hardest"])

    timed("error_analysis", errors)
    timed("fit_tfidf_lr_20it", lambda: M.TfidfModel.fit(train, max_iter=FIT_ITERS))
    total = round(sum(times.values()), 3)
    result = {
        "metric": "total_sec",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": sf,
        "cpus": cpus,
        "rows": {"raw": n_raw, **rows},
        "rows_per_sec": {"clean": round(n_raw / times["clean"], 1),
                         "clean_dedupe": round(n_raw / times["clean_dedupe"], 1),
                         "split": round(rows["prepared"] / times["split"], 1)},
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
