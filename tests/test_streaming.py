"""The gate on a stream of frames commits what the replay commits."""

from spanwright.streaming.commit_gate import Config, replay, stream_commits

SCHEMA = "stream_id long, frame int, tag int"


def test_stream_equals_replay(spark, tmp_path):
    config = Config(stride=2, delta=1, votes=3, cap=40)
    tags = ([1] * 3 + [2] + [3] * 7 + [1] * 9) * 4
    rows = [(s, i, t) for s in (1, 2, 3) for i, t in enumerate(tags[s:])]
    for part in range(4):
        lo, hi = part * len(tags) // 4, (part + 1) * len(tags) // 4
        spark.createDataFrame([r for r in rows if lo <= r[1] < hi], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frames = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    query = (
        stream_commits(frames, config)
        .writeStream.format("memory").queryName("commits").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = sorted(map(tuple, spark.table("commits").collect()))
    whole = sorted(map(tuple, replay(spark.createDataFrame(rows, SCHEMA), config).collect()))
    assert got and set(got) <= set(whole)
    # what only the replay has is what the end of the stream commits
    assert all(r[3] >= len(tags) - r[0] for r in set(whole) - set(got))
