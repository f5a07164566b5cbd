"""Headline timings over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then the faster of two runs counts.
"""

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from sparklex.functions.scoring import Scoring
from sparklex.operators.index import index_fields
from sparklex.operators.search import Searcher
from sparklex.plans import queries as q
from sparklex.sources.store import load_index, save_index

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="bench-")
    seconds = {}

    def timed(name, run):
        run()
        best = []
        for _ in range(2):
            began = time.perf_counter()
            run()
            best.append(time.perf_counter() - began)
        seconds[name] = round(min(best), 3)

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    timed("index_build", lambda: save_index(q.document_index(spark, SF_DIR), f"{folder}/index", mode="overwrite"))
    saved = load_index(spark, f"{folder}/index")
    for name, scoring in (("okapi", Scoring()), ("plus", Scoring("plus")), ("l", Scoring("l")), ("adpt", Scoring("adpt"))):
        timed(f"{name}_top10", lambda s=scoring: run(Searcher(saved, s).top_n(q.QUERY, 10)))
    timed("okapi_batch_top10", lambda: run(Searcher(saved).batch_top_n(q.asked(spark, SF_DIR), 10)))
    timed("okapi_scores", lambda: run(Searcher(saved).scores(q.QUERY)))
    timed("bm25f_top10", lambda: run(Searcher(index_fields(q.parts(spark, SF_DIR), q.WEIGHTS), Scoring("field")).top_n(q.FIELD_QUERY, 10)))
    timed("rrf_okapi_plus", lambda: run(q.rrf_okapi_plus(spark, SF_DIR)))
    timed("compressed_bytes", lambda: run(q.compressed_bytes(spark, SF_DIR)))
    shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
