"""Jobs coalesced on a stream, by buckets of keys."""

import tempfile

from lektra.streaming import jobs


def test_jobs_by_buckets(spark):
    big = 2**60
    events = [(None if i % 7 == 0 else big + i % 1500, None if i % 601 == 0 else big + 5000 - i, None if i % 11 == 0 else i % 3 != 0) for i in range(4000)]
    folder = tempfile.mkdtemp(prefix="spark-")
    held, wanted, runs = {}, [], []
    for half in (events[:3000], events[3000:]):
        spark.createDataFrame(half, "key long, seq long, submitted boolean").write.mode("append").parquet(f"{folder}/events")
        stream = jobs.coalesced(spark.readStream.schema("key long, seq long, submitted boolean").parquet(f"{folder}/events"))
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/actions").trigger(availableNow=True).start()
        query.awaitTermination()
        runs.append(query.recentProgress)
        for key, seq, submitted in sorted(half, key=lambda e: (e[1] is None, e[1] or 0, 2 if e[2] is None else int(e[2]))):
            held[key], action = jobs.step(held.get(key, jobs.IDLE), bool(submitted))
            wanted.append((key, seq, action))
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/actions").collect()), key=repr) == sorted(wanted, key=repr)
    states = [o["numRowsTotal"] for run in runs for p in run for o in p["stateOperators"]]
    assert 0 < max(states) <= 64 < sum(s != jobs.IDLE for s in held.values())
    assert jobs.buckets_for(0) == 64 and jobs.buckets_for(10_000_000) == 1024
