"""The heartbeats of a stream: who is forgotten takes no room."""

from datetime import datetime, timedelta

from nothi.sources import scratch
from nothi.streaming import activity

START = datetime(2024, 1, 1, 12)
SCHEMA = "ts timestamp, user_id long, x string"


def test_state_shrinks(spark, tmp_path):
    source = f"file://{tmp_path}/events"
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [[(at(0), u, "a") for u in range(50)], [(at(10), 1, "b"), (at(10), 2, "b")], [(at(20), 1, "c")], [(at(30), 1, "d"), (at(5), 3, "late")], [(at(40), 9, "e")]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    seen = []
    query = activity.presence(stream, "5 minutes", "1 minute").writeStream.outputMode("update").option("checkpointLocation", scratch.path(spark, "presence")).foreachBatch(lambda df, n: seen.append(sorted(map(tuple, df.collect())))).trigger(availableNow=True).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) == 50 and held[-1] <= 2 and held[0] == 50
    rows = [r for batch in seen for r in batch]
    assert {r[0] for r in rows if r[2]} >= set(range(50)) and {r[0] for r in rows if not r[2]} >= set(range(3, 50))
    last = {}
    for u, when, online in rows:
        last[u] = (when, online)
    assert last[5] == (at(0), False) and last[2] == (at(10), False)
    assert (3, at(5), True) not in rows
