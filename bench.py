"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line.

With ``--scale N`` it times the detectors, the counts against their frame form and the streams over N million packets with one
source that sends a third of them, made from the events by repeating them 100 us apart.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wiretide.operators.detectors import detect_arp_spoof, detect_port_scan, detect_syn_flood, detect_traffic_anomaly  # noqa: E402
from wiretide.operators.predicates import port_scan_eligible, syn_packets  # noqa: E402
from wiretide.operators.sliding import sliding_count, sliding_distinct_count  # noqa: E402
from wiretide.plans.registry import QUERIES  # noqa: E402
from wiretide.scratch import drop_scratch, materialize, scratch_path  # noqa: E402
from wiretide.session import local_session  # noqa: E402
from wiretide.sources.events import event_packets  # noqa: E402
from wiretide.sources.packets import load_packets  # noqa: E402
from wiretide.streaming.streams import start_detect_all  # noqa: E402

HEADLINE = [
    "detect_all",
    "port_scan",
    "arp_spoof",
    "syn_flood",
    "traffic_anomaly",
    "sliding_syn_count",
    "sliding_syn_count_3d",
    "sliding_distinct_ports",
    "sliding_distinct_ports_3d",
    "arp_bindings",
    "cooldown",
    "anchored_windows",
    "top_source_per_window",
    "decode_frames",
    "whitelist_filter",
]
RUNS = 3


def hot_packets(spark: SparkSession, sf_dir: str, millions: float) -> DataFrame:
    """The events again and again, 100 us apart; every third packet is from one source."""
    rows = materialize(event_packets(spark, sf_dir).withColumn("_k", F.row_number().over(Window.orderBy("seq")) - 1))
    n = rows.count()
    copies = spark.range(max(1, round(millions * 1e6 / n))).withColumnRenamed("id", "_copy")
    seq = F.col("_copy") * n + F.col("_k")
    repeated = rows.crossJoin(copies).withColumn("seq", seq).withColumn("ts_us", F.lit(1_700_000_000_000_000) + seq * 100)
    hot = F.when(seq % 3 == 0, "10.9.9.9").otherwise(F.col("src_ip"))
    repeated = repeated.withColumns({"src_ip": hot, "ts": F.col("ts_us") / 1e6, "event_time": F.timestamp_micros("ts_us")})
    return materialize(repeated.drop("_k", "_copy"))


def framed_count(rows: DataFrame, window_s: int) -> DataFrame:
    """The sliding count as one frame per source, which the library does not use."""
    frame = Window.partitionBy("src_ip").orderBy("ts_us").rangeBetween(-window_s * 1_000_000, 0)
    return rows.withColumn("observed", F.count(F.lit(1)).over(frame))


def scale(millions: float) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=4 * cpus)
    rows = hot_packets(spark, sf_dir, millions)
    n = rows.count()
    syn = syn_packets(rows).select("src_ip", "ts_us", "seq")
    ports = port_scan_eligible(rows).select("src_ip", "dst_port", "ts_us", "seq")

    def stream() -> None:
        path = scratch_path(spark)
        source = load_packets(spark, rows.inputFiles()[0].rsplit("/", 1)[0], streaming=True)
        start_detect_all(source, f"{path}/log", f"{path}/checkpoint", f"{path}/state", available_now=True).awaitTermination()

    def write(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    runs = {
        "port_scan": lambda: write(detect_port_scan(rows)),
        "arp_spoof": lambda: write(detect_arp_spoof(rows)),
        "syn_flood": lambda: write(detect_syn_flood(rows)),
        "traffic_anomaly": lambda: write(detect_traffic_anomaly(rows)),
        "sliding_count": lambda: write(sliding_count(syn, "src_ip", 5)),
        "sliding_count_as_frame": lambda: write(framed_count(syn, 5)),
        "sliding_distinct_count": lambda: write(sliding_distinct_count(ports, "src_ip", "dst_port", 10)),
        "stream_detect_all": stream,
    }
    times = {}
    for name, run in runs.items():
        started = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - started, 1)
    print(json.dumps({"metric": "one run each over packets with a hot source", "packets": n, "unit": "sec", "queries": times}))
    drop_scratch(spark)
    spark.stop()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            started = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "total best-of-3 time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    if sys.argv[1:2] == ["--scale"]:
        scale(float(sys.argv[2]))
    else:
        main()
