import random

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from logweave.operators import archive

SCHEMA = "fragment_id bigint, source_path string, seq_no int, body string, arrived_at timestamp, path string, entries string"


def table(spark, rows):
    return spark.createDataFrame([(i, p, s, b, None, "clash", "clash") for i, (p, s, b) in enumerate(rows)], SCHEMA)


def test_round_trip_and_counts(spark):
    rng = random.Random(3)
    rows = [("hot/x" if rng.random() < 0.5 else f"u\\{rng.randrange(9)}", rng.randrange(60), "".join(rng.choice("ab\n\r é") for _ in range(rng.randrange(40)))) for _ in range(700)]
    rows += [(None, 1, "x"), ("n", None, "x"), ("n", 1, None), ("n", 2, ""), ("long", 1, "y" * 400_000 + "\n"), ("long", 2, "z\n\nz")]
    best = {}
    for p, s, b in rows:
        if p is not None and s is not None:
            key = (p.replace("\\", "/"), s)
            if key not in best or len((b or "").encode()) > len(best[key].encode()):
                best[key] = b or ""
    frame = table(spark, rows)
    containers = archive.pack(archive.best_deliveries(frame), block_bytes=500, partitions=3).cache()
    assert {(r.path, r.seq_no): r.body for r in archive.unpack(containers).collect()} == best
    assert all(r.n_payload <= 500 or r.n_entries == 1 for r in containers.collect())
    assert [r.body for r in archive.lookup(containers, "n", 2).collect()] == [""]
    assert {r.seq_no for r in archive.lookup(containers, "long").collect()} == {1, 2}
    got = {r.source_path: (r.n_fragments, r.n_records, r.n_bytes) for r in archive.found_sources(frame).collect()}
    assert got["long"] == (2, 3, 400_002) and got["n"] == (2, 0, 0)
    assert archive.found_sources(table(spark, [])).count() == 0


def test_damage_is_found(spark):
    containers = archive.pack(archive.best_deliveries(table(spark, [("a", 1, "body")])))
    with pytest.raises(PythonException, match="damaged"):
        archive.unpack(containers.withColumn("payload", F.lit("bodx").cast("binary"))).collect()


def test_files(spark, tmp_path):
    archive.write_archive(table(spark, [("a", i, "body" * 10) for i in range(100)]), str(tmp_path / "x"), block_bytes=2000)
    back = spark.read.parquet(str(tmp_path / "x"))
    assert archive.unpack(back).count() == 100 and back.count() <= 8
