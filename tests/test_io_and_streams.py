import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from acreage.operators import bookings as B
from acreage.plans import streams
from acreage.sources import exports, files, snapshots
from acreage.streaming.bookings import last_states, stream_plot_state
from test_business import commands


def test_census_manifest_and_uploads(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF /Type /Page /Font x")
    (tmp_path / "b.pdf").write_bytes(b"%PDF /Subtype /Image")
    (tmp_path / "c.dxf").write_bytes(b"0\nSECTION")
    got = {r.path.rsplit("/", 1)[1]: r for r in files.census_files(spark, str(tmp_path)).collect()}
    assert got["a.pdf"].recommended_parser == "DIGITAL_PDF_VECTOR_PARSER" and got["b.pdf"].is_scanned
    assert got["c.dxf"].recommended_parser == "CAD_DXF_PARSER"
    manifest = files.build_manifest(spark, str(tmp_path)).collect()
    kept = spark.createDataFrame(manifest).withColumn("sha256", F.when(F.col("path").endswith("b.pdf"), "0").otherwise(F.col("sha256")))
    (tmp_path / "c.dxf").unlink()
    status = {r.path.rsplit("/", 1)[1]: r.status for r in files.verify_manifest(kept, files.build_manifest(spark, str(tmp_path))).collect()}
    assert status == {"a.pdf": "OK", "b.pdf": "MISMATCH", "c.dxf": "MISSING"}
    up = files.check_uploads(spark.createDataFrame([("my plan.PDF", 10), ("x.exe", 10), ("y.png", 10**9)], "file_name string, size_bytes long")).collect()
    assert up[0].safe_name == "my_plan.PDF" and up[0].error is None and up[1].error and up[2].error


def test_snapshots(spark, tmp_path):
    model = {"boundary": {"geometry": [[0, 0], [1, 0], [1, 1]], "area": 0.5}, "plots": [{"id": "a", "plotNumber": "1", "polygon": [[0, 0], [1, 0], [1, 1]]}], "labels": []}
    folder = tmp_path / "gt" / "proj" / "v2"
    folder.mkdir(parents=True)
    (folder / "layout_model.json").write_text(json.dumps(model))
    m = snapshots.read_layout_models(spark, str(tmp_path / "gt"))
    row = m.first()
    assert (row.project_id, row.version, row.is_corrupt) == ("proj", "v2", False)
    ents = snapshots.model_entities(m)
    assert ents["plots"].first().plot_number == "1" and len(ents["boundary"].first().ring) == 3
    out = str(tmp_path / "snap")
    snapshots.write_snapshot(ents["plots"], out, "v1")
    with pytest.raises(Exception, match="(?i)already exists"):
        snapshots.write_snapshot(ents["plots"], out, "v1")
    assert snapshots.read_snapshots(spark, out).first().version == "v1"


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("p", "P-1", 1200.04, "a,b")], "project_id string, plot_number string, area_sqft double, road_name string")
    df = df.selectExpr("*", "'SOLD' status", "30.0 width_ft", "40.0 depth_ft", "cast(null as string) facing", "true is_corner", "cast(3 as double) price")
    exports.write_plot_schedule(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).first()
    assert (back["Area (Sq Ft)"], back["Road Access"], back["Facing"], back["Corner Plot"]) == ("1200.0", "a,b", "NORTH", "YES")
    ring = spark.sql("SELECT 'p' project_id, 'PLOT' entity_type, 'x' name, array(struct(0D x, 0D y), struct(1D x, 0D y), struct(1D x, 1D y)) ring")
    f = json.loads(exports.to_geojson(ring, ["name"]).first().feature)
    assert f["geometry"]["coordinates"][0][0] == f["geometry"]["coordinates"][0][-1] and f["properties"]["entityType"] == "PLOT"


def _stream(spark, root, arrivals, delay):
    """Decisions of a stream that reads one arrival after the other."""
    folder = f"{root}/arrivals"
    for part in arrivals:
        part.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(arrivals[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream_plot_state(source, root, delay).awaitTermination()
    return spark.read.parquet(f"{root}/decisions")


def test_stream_decides_late_and_repeated_commands_in_their_place(spark, tmp_path):
    """Three arrivals; every seventh command comes one later, some come twice, a tick ends the input."""
    rows, df = commands(spark, 300)
    times = sorted(r[1] for r in rows)
    span = times[-1] - times[0]
    part = F.when(F.col("ts") < F.lit(times[100]), 0).when(F.col("ts") < F.lit(times[200]), 1).otherwise(2) + F.when(F.col("seq") % 7 == 3, 1).otherwise(0)
    tick = df.limit(1).select(*[F.lit(times[-1] + 3 * span).alias("ts") if c == "ts" else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    arrivals = [df.filter(part == i) for i in range(4)]
    arrivals[1] = arrivals[1].unionByName(df.filter((part == 0) & (F.col("seq") % 5 == 1)))
    done = _stream(spark, str(tmp_path), [*arrivals, tick], f"{int(span.total_seconds()) + 1} seconds")
    want = B.replay_bookings(df)
    columns = ["seq", "state_before", "accepted", "state_after"]
    assert sorted(tuple(r) for r in done.select(columns).collect()) == sorted(tuple(r) for r in want.select(columns).collect())
    assert sorted(tuple(r) for r in last_states(spark, str(tmp_path), "string").collect()) == sorted(tuple(r) for r in B.final_states(want).collect())


def test_stream_holds_what_the_watermark_has_not_passed_and_drops_what_is_too_late(spark, tmp_path):
    schema = "seq long, ts timestamp, plot_id long, command string, patch_status string"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    arrivals = [
        [(1, at(5), 7, "book", None), (2, at(3), 7, "cancel", None), (3, at(4), 8, "book", None)],
        [(4, at(30), 8, "book", None)],
        [(6, at(31), 8, "cancel", None)],
        [(5, at(2), 7, "book", None)],
    ]
    done = _stream(spark, str(tmp_path), [spark.createDataFrame(a, schema) for a in arrivals], "10 hours")
    got = {r.seq: (r.state_before, r.accepted) for r in done.collect()}
    assert got == {2: ("AVAILABLE", True), 1: ("AVAILABLE", True), 3: ("AVAILABLE", True)}


def test_an_arrival_of_many_files_is_one_micro_batch(spark, tmp_path, monkeypatch):
    """Six arrivals, the late ones and the closing event: as many micro-batches as with a file each, though every arrival has five."""
    events = spark.range(3000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 860).alias("ts"), (F.col("id") * 7 % 40).alias("user_id"),
        F.element_at(F.array(*map(F.lit, ("purchase", "error", "signup", "view"))), (F.col("id") % 4 + 1).cast("int")).alias("event_type"), F.lit(1.0).alias("value"),
    )
    events.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    root = str(tmp_path / "root")
    monkeypatch.setattr(streams, "fresh_folder", lambda s, name: root)
    monkeypatch.setattr(streams, "FILE_EVENTS", 100, raising=False)
    got = streams._plot_state(spark, str(tmp_path)).collect()
    want = B.final_states(B.replay_bookings(streams.v.commands(spark, str(tmp_path)))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 30
    assert len([f for f in os.listdir(f"{root}/checkpoint/commits") if f.isdigit()]) <= 10
