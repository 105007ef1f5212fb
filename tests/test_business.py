import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from acreage.functions import scalars as S
from acreage.operators import bookings as B
from acreage.operators import crm as C
from acreage.operators import inventory as I
from acreage.operators import versions as V
from acreage.session import numbered
from acreage.sources import tables


def commands(spark, n=400):
    rng = random.Random(11)
    rows = []
    for i in range(n):
        cmd = rng.choice(["book", "cancel", "patch"])
        plot = "hot" if rng.random() < 0.5 else f"p{rng.randint(0, 5)}"
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 3000)), plot, cmd, rng.choice(["SOLD", "BOOKED", "RESERVED"]) if cmd == "patch" else None))
    return rows, spark.createDataFrame(rows, "seq long, ts timestamp, plot_id string, command string, patch_status string")


def test_replay_equals_the_sequential_ledger(spark):
    rows, df = commands(spark)
    state, want = {}, {}
    for seq, ts, plot, cmd, patch in sorted(rows, key=lambda r: (r[1], r[0])):
        now = state.get(plot, "AVAILABLE")
        ok = not (cmd == "book" and now == "BOOKED")
        state[plot] = {"book": "BOOKED", "cancel": "AVAILABLE", "patch": patch}[cmd]
        want[seq] = (now, ok, state[plot])
    got = {r.seq: (r.state_before, r.accepted, r.state_after) for r in B.replay_bookings(df).collect()}
    assert got == want
    assert {r.plot_id: r.status for r in B.final_states(B.replay_bookings(df)).collect()} == state


def test_numbering_splits_hot_keys(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    out = numbered(df, ["k"], [F.desc("v")], F.floor(F.col("v") / 100), "n", descending=True).collect()
    assert all(r.n == 1000 - r.v for r in out)


def test_booking_amounts_and_patch(spark):
    df = spark.createDataFrame([(Decimal(100), None, Decimal(30), None), (Decimal(0), None, Decimal(30), Decimal(2000000)), (Decimal(50), None, Decimal(50), None)], "base decimal(18,2), total decimal(18,2), dep decimal(18,2), paid decimal(18,2)")
    got = [r.a for r in df.select(S.booking_amounts("base", "total", "dep", "paid").alias("a")).collect()]
    assert [(float(a.total), float(a.remaining), a.payment_status) for a in got] == [(100, 70, "PARTIAL"), (1000000, 0, "PAID"), (50, 0, "PAID")]
    b = spark.createDataFrame([("b", "n", "p", "UPI", Decimal(100), Decimal(10), Decimal(10), Decimal(90))], "booking_id string, customer_name string, notes string, payment_method string, total_amount decimal(18,2), booking_amount decimal(18,2), paid_amount decimal(18,2), remaining_amount decimal(18,2)")
    p = spark.createDataFrame([("b", " ", "  ", Decimal(40))], "booking_id string, customer_name string, notes string, paid_amount decimal(18,2)")
    r = B.apply_booking_patch(b, p).first()
    assert (r.customer_name, r.notes, float(r.paid_amount), float(r.remaining_amount)) == ("n", None, 40.0, 60.0)


def test_status_patches(spark):
    plots = spark.createDataFrame([("a", 1, "AVAILABLE", Decimal(500), None, None), ("b", 1, "BOOKED", Decimal(700), "k1", None), ("c", 1, "BOOKED", None, "k2", None)], "plot_id string, project_id int, status string, base_price decimal(18,2), customer_id string, reservation_date timestamp")
    books = spark.createDataFrame([("k1", 1, "b", "Asha", "BOOKED", dt.datetime(2024, 1, 1)), ("k2", 1, "c", "Ravi", "BOOKED", dt.datetime(2024, 1, 1))], "booking_id string, project_id int, plot_id string, customer_name string, booking_status string, created_at timestamp")
    patches = spark.createDataFrame([("a", "sold", "Mira"), ("b", "AVAILABLE", None), ("c", "SOLD", "Ravi K"), ("a2", "nonsense", None)], "plot_id string, status string, customer_name string")
    p, b = B.apply_status_patches(plots, books, patches, F.lit("2024-02-01").cast("timestamp"))
    state = {r.plot_id: (r.status, r.customer_id is not None) for r in p.collect()}
    assert state == {"a": ("SOLD", True), "b": ("AVAILABLE", False), "c": ("SOLD", True)}
    rows = {r.plot_id: r for r in b.collect()}
    assert rows["b"].booking_status == "CANCELLED" and rows["c"].customer_name == "Ravi K"
    assert rows["a"].payment_method == "DIRECT" and float(rows["a"].total_amount) == 500.0 and len(rows) == 3


def test_patches_without_a_state(spark):
    """A contact-only patch on a SOLD plot opens its booking; an invalid state refuses the whole patch."""
    plots = spark.createDataFrame([("a", 1, "SOLD", Decimal(0), None, None, None), ("b", 1, "AVAILABLE", Decimal(5), None, None, "old")], "plot_id string, project_id int, status string, base_price decimal(18,2), customer_id string, reservation_date timestamp, notes string")
    books = spark.createDataFrame([], "booking_id string, project_id int, plot_id string, customer_name string, customer_phone string, customer_email string, booking_status string, created_at timestamp")
    patches = spark.createDataFrame([("a", None, " Mira ", "n", "900", "2024-03-01T10:00:00", "7"), ("b", "nope", "X", "lost", None, None, "9")], "plot_id string, status string, customer_name string, notes string, customer_phone string, reservation_date string, base_price string")
    p, b = B.apply_status_patches(plots, books, patches, F.lit("2024-02-01").cast("timestamp"))
    rows = {r.plot_id: r for r in p.collect()}
    made = b.collect()
    assert len(made) == 1 and made[0].customer_name == "Mira" and float(made[0].total_amount) == 7.0 and made[0].customer_phone == "900"
    assert rows["a"].notes == "n" and float(rows["a"].base_price) == 7.0 and rows["a"].customer_id == made[0].booking_id
    assert rows["b"].notes == "old" and float(rows["b"].base_price) == 5.0 and rows["b"].status == "AVAILABLE"


def test_search_facets_sorting(spark):
    df = spark.createDataFrame([("A-10", "x"), ("a-2", "Pune"), ("B-1", "y")], "plot_number string, city string").withColumn("plot_id", F.col("plot_number"))
    assert [r.plot_number for r in C.sort_plots(df, "plotNo_asc").collect()] == ["a-2", "A-10", "B-1"]
    assert C.search(df, " pUn ", ["city"]).count() == 1 and C.search(df, "  ", ["city"]).count() == 3
    seq = C.with_seq(df.withColumn("g", F.lit(1)), ["g"], [F.asc("plot_number")], F.lit(0), "plot-", 3)
    assert {r.seq_id for r in seq.collect()} == {"plot-001", "plot-002", "plot-003"}


def test_upsert_keeps_state_and_counts(spark):
    old = spark.createDataFrame([("i", 1, "P-1", 10.0, "SOLD")], "plot_id string, project_id int, plot_number string, area_sqft double, status string")
    new = spark.createDataFrame([(1, "P-1", 20.0), (1, "P-2", 5.0)], "project_id int, plot_number string, area_sqft double")
    merged = I.upsert_plots(old, new)
    assert sorted((r.plot_number, r.area_sqft, r.status, r.change) for r in merged.collect()) == [("P-1", 20.0, "SOLD", "updated"), ("P-2", 5.0, "AVAILABLE", "created")]
    c = I.upsert_counts(merged).first()
    assert (c.created, c.updated, c.persisted) == (1, 1, 2)


def test_versions_are_numeric_and_rollback_appends(spark):
    v = spark.createDataFrame([("p", f"v{i}") for i in (1, 2, 10)], "project_id string, version string")
    assert [r.version for r in V.version_summaries(v).filter("is_latest").collect()] == ["v10"]
    m = spark.createDataFrame([("p", 1, "one"), ("p", 2, "two")], "project_id string, version int, model string")
    out = V.rollback(m, spark.createDataFrame([("p", 1)], "project_id string, version int"))
    assert out.filter("version = 3").first().model == "one"


def test_project_payloads_split(spark):
    doc = '{"name":"N","developerName":"D","surveyNumbers":["1"," ","2 "],"layout":{"fileName":"f.pdf"}}'
    t = tables.normalize_projects(spark.createDataFrame([(doc,), ('{"name":"M","legal":{"reraNumber":"R"}}',)], "payload string"))
    assert {r.name: r.status for r in t["projects"].collect()} == {"N": "LAYOUT_PENDING", "M": "DRAFT"}
    assert sorted(r.survey_number for r in t["project_surveys"].collect()) == ["1", "2"] and t["project_legal"].count() == 1


def test_plots_that_are_not_found_do_not_travel_to_the_customers(spark, monkeypatch):
    plots = spark.createDataFrame([(i, i % 7 if i % 5 else None, i % 3, f"A-{i}") for i in range(60)], "plot_id long, customer_id long, broker_id long, plot_number string")
    people = [(1, "Ann Oak"), (1, "Oak"), (2, "Bob"), (3, None), (None, "Oak")]
    customers = spark.createDataFrame(people, "customer_id long, name string")
    agents = {0: "Zed", 1: "Oakley"}
    brokers = spark.createDataFrame(list(agents.items()), "broker_id long, name string")
    seen, plain = [], C.with_names
    monkeypatch.setattr(C, "with_names", lambda df, dim, key, *rest: seen.append((key, df.count())) or plain(df, dim, key, *rest))
    for query in (" OAK ", "a-1", "zzz", " "):
        want = []
        for p in plots.collect():
            for name in [n for k, n in people if k is not None and k == p.customer_id] or [None]:
                texts = (p.plot_number, name or "", agents.get(p.broker_id, ""))
                if not query.strip() or any(query.strip().lower() in t.lower() for t in texts):
                    want.append((p.broker_id, p.customer_id, p.plot_id, p.plot_number, name or "", texts[2]))
        got = C.search_plots(plots, customers, brokers, query)
        assert got.columns == ["broker_id", "customer_id", "plot_id", "plot_number", "customer_name", "broker_name"]
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert [n for key, n in seen if key == "customer_id"][2] == 0
