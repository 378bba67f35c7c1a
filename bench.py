"""Times the headline queries, each run once to warm up and then three times, and DuckDB's SQL for those that have it on the same files; prints one JSON line."""

import glob
import importlib
import json
import os
import statistics
import sys
import threading
import time

import duckdb
from pyspark.sql import SparkSession

HEADLINE = (
    "G02_digest_by_day", "G04_token_costs", "G13_projects_overview", "G09_failure_rate", "W01_W02_turns", "W03_folded_bursts", "W15_D05_duplicates", "X04_X05_bm25", "X16_find", "X13_J02_memory_recall", "V03_V04_nearest",
    "D01_content_hash", "P04_W05_W06_compressed_blocks", "K04_markdown", "M01_I06_upsert",
    "op1_sharding", "op2_decontamination", "op3_bpe", "op4_secrets", "op5_simhash", "op6_toxicity", "op7_warc", "op8_licenses", "op9_suffix_dedup", "op10_topk", "op11_alignment", "op12_spelling", "op13_quality",
    "X18_search", "X03_I05_postings_kept", "D06_semantic_join", "K01_M01_session_replaced",
)


#: Seconds after which DuckDB's run of one query is given up.
PATIENCE = 60


def duckdb_times(sql: dict[str, str], sf_dir: str, cpus: str) -> dict[str, float | None]:
    """The better of two runs of each query, all rows fetched; null where it took too long."""
    con = duckdb.connect(config={"threads": cpus})
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    out = {}
    for name in HEADLINE:
        if name in sql:
            timer = threading.Timer(PATIENCE, con.interrupt)
            timer.start()
            try:
                runs = []
                for _ in range(2):
                    began = time.perf_counter()
                    con.execute(sql[name]).fetchall()
                    runs.append(time.perf_counter() - began)
                out[name] = round(min(runs), 3)
            except duckdb.InterruptException:
                out[name] = None
            timer.cancel()
    con.close()
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    entry = importlib.import_module("__spark_entry__")
    found = entry.queries()
    times = {}
    for name in HEADLINE:
        if name not in found:
            continue
        runs = []
        for _ in range(2 if name.startswith("op") else 4):
            began = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 3)
        print(name, times[name], file=sys.stderr)
    spark.stop()
    other = duckdb_times(entry.oracle_sql(), sf_dir, cpus)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "duckdb": other, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
