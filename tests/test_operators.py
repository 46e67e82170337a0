"""Golden values, derived by hand from the formulas, and properties of the operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fotonflow.functions import scalar
from fotonflow.operators import coeffs, pixels, routing, rules, slots
from fotonflow.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_safe_division_is_ieee(spark):
    got = one(spark, a=scalar.safe_div(1.0, 0.0), b=scalar.safe_div(-1.0, 0.0), c=scalar.safe_div(0.0, 0.0), d=scalar.safe_div(6.0, 3.0), e=scalar.safe_div(F.lit(None).cast("double"), 0.0))
    assert (got.a, got.b, got.d, got.e) == (math.inf, -math.inf, 2.0, None) and math.isnan(got.c)


def test_clip_and_quantise(spark):
    got = one(spark, low=scalar.clip(F.lit(-1.0), 0, 2), nan=scalar.clip(F.lit(float("nan")), 0, 2), half=scalar.quantise(F.lit(0.5)), over=scalar.quantise(F.lit(7.0)), bytes=scalar.byte_length(F.array(F.lit(2).cast("long"), F.lit(3).cast("long")), F.lit(True)), low32=scalar.unsigned32(F.lit((1 << 32) + 5)))
    assert (got.low, got.nan, got.half, got.over, got.bytes, got.low32) == (0.0, 2.0, 128, 255, 24, 5)


@pytest.mark.parametrize("change, wb, sharpness, nr", [(False, [1.0375, 0.959375, 1.01875], 0.925, 0.6), (True, [1.05625, 0.9359375, 1.0234375], 0.85, 0.75)])
def test_rule_engine_step(change, wb, sharpness, nr):
    # fixed values: inputs of the goldens
    step = lambda c, raw, prev: rules.Stepper(c)(np.array(raw), np.array(prev), np.array(change)).tolist()
    p, raw = rules.PARAMS, np.array([1.2, 0.9, 1.1])
    assert step(p.wb, raw / raw.mean(), [1.0] * 3) == pytest.approx(wb)
    assert step(p.sharpness, [1.0 / 2], [1.0]) == pytest.approx([sharpness])
    assert step(p.nr, [0.5 * 2], [0.5]) == pytest.approx([nr])
    assert step(p.gamma(4, linear=True), [0, 1 / 3, 2 / 3, 1], [0, 1 / 3, 2 / 3, 1]) == pytest.approx([0, 1 / 3, 2 / 3, 1])


def test_fold_keeps_state_over_nulls_and_stays_in_limits(spark):
    rows = [(1, 1, i, False, None if i == 3 else [float(i * 50 - 100)]) for i in range(8)] + [(None, 1, 99, None, [0.5])]
    df = spark.createDataFrame(rows, "stream_id long, ts long, event_id long, scene_change boolean, raw array<double>")
    got = {r.event_id: r["values"][0] for r in rules.stabilise(df, rules.PARAMS.nr).collect()}
    assert len(got) == 9 and got[3] == got[2] and all(0 <= v <= 5 for v in got.values())


def test_fold_equals_a_row_by_row_one(spark):
    """Several batches per stream, nulls and NaN among the rows; the stateful form's steps are the same."""
    pick = np.random.default_rng(5)
    values = [None if x < 0.1 else [math.nan if x < 0.2 else x * 5, x] for x in pick.random(600).tolist()]
    rows = [(int(s), i, i, bool(i % 7 == 0), v) for i, (s, v) in enumerate(zip(pick.integers(0, 3, 600), values))]
    channel = rules.Channel("x", (1.0, 0.5), 0.0, 2.0, step=0.05)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    df = spark.createDataFrame(rows, "stream_id long, ts long, event_id long, scene_change boolean, raw array<double>")
    got = {r.event_id: r["values"] for r in rules.stabilise(df, channel).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    states = {}
    for s, _, i, change, raw in rows:
        state = states.setdefault(s, [1.0, 0.5])
        for k in range(2):
            if raw is not None and not math.isnan(raw[k]):
                a = 0.5 if change else 0.2
                out = (a * raw[k] + (1 - a) * state[k] + state[k] + min(max(raw[k] - state[k], -0.05), 0.05)) / 2
                state[k] = min(max(out, 0.0), 2.0)
        assert got[i] == pytest.approx(state)


def test_only_narrow_rows_are_shuffled_by_a_fold(spark):
    """Arrays given as an expression are made after the exchange, with the same results as those of a column."""
    rows = [(i % 3, i, i, i % 7 == 0, None if i % 11 == 0 else i / 50) for i in range(200)]
    df = spark.createDataFrame(rows, "stream_id long, ts long, event_id long, scene_change boolean, x double")
    raw, channel = F.array(*[F.col("x") * i for i in range(64)]), rules.PARAMS.gamma(64)
    late = rules.stabilise(df, channel, raw)
    plan = late._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression") :]
    assert "array(" in plan and "array(" not in below
    early = rules.stabilise(df.withColumn("raw", raw), channel)
    assert sorted(map(tuple, late.collect())) == sorted(map(tuple, early.collect()))


def test_a_zero_mean_does_not_stop_the_job(spark):
    got = one(spark, **{f"c{i}": c for i, c in enumerate(rules.normalised([F.lit(1.0), F.lit(-1.0), F.lit(0.0)]))})
    assert got.c0 == math.inf and got.c1 == -math.inf and math.isnan(got.c2)


def test_output_lookup(spark):
    names = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, hit=coeffs.output_index(names, F.lit("b")), miss=coeffs.output_index(names, F.lit("z"))) == (1, 0)
    with pytest.raises(Exception, match="no output is named z"):
        one(spark, x=coeffs.output_index(names, F.lit("z"), strict=True))


def test_release_follows_allocation(spark):
    """64 slots are given out in order; given back, they stand in the queue with numbers 65 to 128."""
    queue = tables.preloaded_fifo(spark)
    got = slots.allocated(spark.range(64).select((F.col("id") + 1).alias("nth")), queue)
    assert [r.slot_index for r in got.orderBy("nth").collect()] == list(range(64))
    back = got.select(F.col("nth").alias("id"), F.timestamp_seconds("nth").alias("ts"), "slot_index", F.lit(1).cast("long").alias("epoch"))
    none = spark.createDataFrame([], "event_id long, ts timestamp, control_type string, frame_id long, alloc_ticket long, epoch long")
    notices = spark.createDataFrame([], "order_id long, frame_id long, ts timestamp")
    rows = slots.ledger(none, notices, back).withColumn("free_seq", F.col("free_seq") + slots.last_sequence(queue).first()[0]).orderBy("free_seq").collect()
    assert [r.free_seq for r in rows] == list(range(65, 129)) and [r.slot_index for r in rows] == list(range(64))
    first = slots.allocated(spark.range(3).select((F.col("id") + 1).alias("nth")), queue, spark.createDataFrame([(1, 900), (2, 901)], "nth long, slot_index long"))
    assert [r.slot_index for r in first.orderBy("nth").collect()] == [900, 901, 0]

def test_controller_golden(spark):
    one_frame = spark.createDataFrame([(0, 0, 0.35, 0.4, 0.6, 0.5)], "stream_id int, frame_id int, mean_y double, r double, g double, b double")
    got = coeffs.controller_step(one_frame).first()
    assert (got.ae_gain, got.awb_r, got.awb_g, got.awb_b) == pytest.approx((1.075, 1.25, 0.833333, 1.0), abs=1e-6)
    five = spark.createDataFrame([(0, i, 0.4) for i in range(5)], "stream_id int, frame_id int, mean_y double")
    assert [r.ae_gain for r in coeffs.controller_feedback(five).orderBy("frame_id").collect()] == pytest.approx([1.05, 1.10, 1.15, 1.20, 1.25])


def test_bayer_coefficients_golden(spark):
    v = np.random.default_rng(0).random((1080, 1920), np.float32)
    stats = spark.createDataFrame([(0, float(v.mean(dtype=np.float64)), float(v.var(dtype=np.float64)), float(v.mean(dtype=np.float64)))], "frame_id int, mean double, var double, channel double")
    got = coeffs.adaptive(stats).first()
    assert (got.ae_gain, got.awb_r, got.awb_g, got.gamma, got.noise, got.sharp) == pytest.approx((-0.224154, 1, 0.500220, 0.342469, 0.833676, 0.666575), abs=1e-4)


def test_black_frame_has_undefined_white_balance(spark):
    stats = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "frame_id int, mean double, var double, channel double")
    assert math.isnan(coeffs.adaptive(stats).first().awb_r)


def test_box_filter_against_numpy(spark):
    frames = tables.synthetic_frames(spark, 2, 5, 7).withColumn("u8", F.floor(F.col("v") * 256).cast("int")).cache()
    got = {(r.frame_id, r.y, r.x): r.value for r in pixels.denoise_box3(frames).collect()}
    image = {(r.frame_id, r.y, r.x): r.u8 for r in frames.collect()}
    for (f, y, x), value in got.items():
        near = [image[f, a, b] for a in (y - 1, y, y + 1) for b in (x - 1, x, x + 1) if (f, a, b) in image]
        assert value == sum(near) // len(near)
    assert len(got) == 70


def test_handoff_demo(spark):
    routed = routing.monitored(routing.fast_forward(tables.synthetic_items(spark)))
    control = routing.control_items(routed).collect()
    assert len(control) == 5 and {r.reason for r in control} == {3}
    assert routed.where("owner_after = 2").count() == 3


def simulate(items):
    """The hand-off rules, item by item."""
    out, after = {}, {}
    for batch in sorted({(i["worker"], i["batch"]) for i in items}):
        rows = sorted((i for i in items if (i["worker"], i["batch"]) == batch), key=lambda i: i["packet_id"])
        first = {}
        for i in rows:
            if i["token"] is not None:
                first.setdefault(i["token"], i["owner"])
        taken, fine = set(), True
        for i in rows:
            if i["token"] is not None:
                fine &= first[i["token"]] == 0 and i["token"] not in taken
                taken.add(i["token"])
        owners = dict(first)
        for i in rows:
            t = i["token"]
            if fine:
                out[i["packet_id"]] = "FF"
            elif i["publish"] == 0:
                out[i["packet_id"]] = "EPOCH"
            elif t is not None and owners[t] != 0:
                out[i["packet_id"]] = "FAIL"
            elif t is None:
                out[i["packet_id"]] = "FIFO"
            else:
                owners[t] = 1
                out[i["packet_id"]] = "RECLAIM" if i["hw"] else "CTRL"
        after |= {i["packet_id"]: None if i["token"] is None else 2 if fine else owners[i["token"]] for i in rows}
    return {p: (out[p], after[p]) for p in out}


def test_routing_against_simulation(spark):
    from conftest import SF

    from fotonflow.sources import views

    items = views.items(spark, SF).cache()
    got = {r.packet_id: (r.outcome, r.owner_after) for r in routing.monitored(routing.fast_forward(items)).collect()}
    assert got == simulate([r.asDict() for r in items.collect()])


def test_slots_are_conserved(spark):
    queue = tables.preloaded_fifo(spark)
    requests = spark.range(70).select((F.col("id") + 1).alias("nth"))
    got = slots.allocated(requests, queue)
    assert got.where("slot_index IS NOT NULL").count() == 64 and got.where("slot_index IS NULL").count() == 6
    assert [r.slot_index for r in slots.popped(queue, 32).collect()] == list(range(32))


def test_numbering_is_gapless(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = slots.numbered(rows, F.floor(F.col("k") / 100), ["k"], "n").orderBy("k").collect()
    assert [r.n for r in got] == list(range(1, 1001))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "stream_id long, ts long, event_id long, scene_change boolean, raw array<double>")
    assert rules.stabilise(none, rules.PARAMS.nr).count() == 0
    none = spark.createDataFrame([], "event_id long, ts timestamp, control_type string, frame_id long, alloc_ticket long, epoch long, idempotency_key long")
    assert slots.appended(none).count() == 0 and slots.frame_table(none).count() == 0 and slots.first_by_key(none).count() == 0


def test_bayer_files(spark, tmp_path):
    plane = np.arange(24, dtype="<u2").reshape(4, 6)
    (tmp_path / "good.raw").write_bytes(plane.tobytes())
    (tmp_path / "short.raw").write_bytes(plane.tobytes()[:-2])
    got = tables.bayer_files(spark, str(tmp_path), width=5, height=4, stride=12, bits=10)
    assert {(r.y, r.x): r.v for r in got.collect()} == {(y, x): plane[y, x] / 1023 for y in range(4) for x in range(5)}
