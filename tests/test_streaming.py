from pyspark.sql import functions as F

from packetweave import fit, load
from packetweave.checks.views import spark_packets
from packetweave.storage import scratch_path
from packetweave.streaming import ListArrivals, LiveScorer, MergingRefitter, Refitter, packet_stream, running_counts

BY = ("capture_id",)


def arrive(packets, folder, low, high):
    part = packets.filter((F.col("frame_number") > low) & (F.col("frame_number") <= high))
    part.withColumn("length", F.col("length").cast("double")).write.mode("append").parquet(folder)


def test_stream_equals_batch(spark, small):
    packets = spark_packets(spark, small, captures=True)
    model = fit(packets, by=BY, trainer="lloyd", iterations=2)
    scorer = LiveScorer(model, scratch_path(spark, "live"))
    folder = scratch_path(spark, "arrivals")
    for low, high in ((0, 1), (1, 400), (400, 1000)):
        arrive(packets, folder, low, high)
        scorer.start(packet_stream(spark, folder, captures=True), availableNow=True).awaitTermination()
    columns = ["capture_id", "frame_number", "packet_number", "cluster_id", F.round("anomaly_score", 8), "is_anomaly"]
    found = sorted(map(tuple, scorer.results(spark).select(*columns).collect()))
    assert found == sorted(map(tuple, model.scored().select(*columns).collect()))


def test_late_packets_get_no_negative_delta(spark, small):
    packets = spark_packets(spark, small)
    scorer = LiveScorer(fit(packets, trainer="lloyd", iterations=1), scratch_path(spark, "live"))
    folder = scratch_path(spark, "arrivals")
    for low, high in ((500, 1000), (0, 500)):
        arrive(packets, folder, low, high)
        scorer.start(packet_stream(spark, folder), availableNow=True).awaitTermination()
    found = scorer.results(spark)
    assert found.count() == 1000
    assert found.agg(F.min("time_delta")).first()[0] == 0.0
    assert found.agg(F.max("packet_number")).first()[0] == 1000


def test_a_repeated_batch_overwrites_its_output(spark, small):
    packets = spark_packets(spark, small).withColumn("length", F.col("length").cast("double"))
    scorer = LiveScorer(fit(packets, trainer="lloyd", iterations=1), scratch_path(spark, "live"))
    first, second = packets.filter("frame_number <= 300"), packets.filter("frame_number > 300")
    for batch, number in ((first, 0), (second, 1), (second, 1)):
        scorer._write(batch, number)
    numbers = [r[0] for r in scorer.results(spark).select("packet_number").collect()]
    assert sorted(numbers) == list(range(1, 1001))


def test_new_captures_are_scored_by_the_pooled_model(spark, small):
    packets = spark_packets(spark, small, captures=True).withColumn("length", F.col("length").cast("double"))
    own, pooled = fit(packets.filter("capture_id = 'cap0'"), by=BY, trainer="lloyd", iterations=1), fit(packets.drop("capture_id"), trainer="lloyd", iterations=1)
    alone = LiveScorer(own, scratch_path(spark, "live")).score(packets, 0)
    assert alone.filter("model is null").count() == alone.filter("capture_id <> 'cap0'").count() > 0
    scored = LiveScorer(own, scratch_path(spark, "live"), fallback=pooled).score(packets, 0)
    assert scored.count() == packets.count() and scored.filter("anomaly_score is null or is_anomaly is null").isEmpty()
    assert {(r[0], r[1]) for r in scored.select("capture_id", "model").distinct().collect()} == {("cap0", "own"), ("cap1", "pooled"), ("cap2", "pooled")}


def test_the_newest_model_scores(spark, small):
    packets = spark_packets(spark, small).withColumn("length", F.col("length").cast("double"))
    refitter = Refitter(scratch_path(spark, "refit"), {"trainer": "lloyd", "iterations": 1, "k": 3})
    assert refitter.newest(spark) is None
    first, second = packets.filter("frame_number <= 300"), packets.filter("frame_number > 300")
    scorer = LiveScorer(fit(first, trainer="lloyd", iterations=1), scratch_path(spark, "live"), refitter=refitter)
    scorer._write(first, 0)
    refitter._batch(packets, 0)
    scorer._write(second, 1)
    found = scorer.results(spark)
    assert found.filter("frame_number <= 300 and cluster_id > 2").count() > 0
    wanted = {r["frame_number"]: r["cluster_id"] for r in fit(packets, trainer="lloyd", iterations=1, k=3).scored().collect()}
    late = found.filter("frame_number > 301").select("frame_number", "cluster_id").collect()
    assert {r[0]: r[1] for r in late} == {k: v for k, v in wanted.items() if k > 301}


def test_user_features_travel_with_the_model(spark, small):
    packets = spark_packets(spark, small).withColumn("length", F.col("length").cast("double"))
    model = fit(packets, extra={"info_chars": "length(coalesce(info, ''))"}, trainer="lloyd", iterations=1)
    path = scratch_path(spark, "model")
    model.save(path)
    scored = LiveScorer(load(spark, path), scratch_path(spark, "live")).score(packets, 0)
    columns = ["frame_number", "cluster_id", F.round("anomaly_score", 8)]
    assert sorted(map(tuple, scored.select(columns).collect())) == sorted(map(tuple, model.scored().select(columns).collect()))


def test_refit_rule():
    rule = Refitter("unused")
    assert not rule.due(0, 99)
    assert rule.due(0, 100) and rule.due(99, 130)
    assert not rule.due(130, 499)
    assert rule.due(499, 500) and rule.due(300, 1700)
    assert not rule.due(500, 999)


def test_refits_follow_the_packet_count(spark, small):
    packets = spark_packets(spark, small)
    refitter = Refitter(scratch_path(spark, "refit"), {"trainer": "lloyd", "iterations": 1, "k": 3})
    folder = scratch_path(spark, "arrivals")
    for low, high in ((0, 60), (60, 200), (200, 450), (450, 700)):
        arrive(packets, folder, low, high)
        refitter.start(packet_stream(spark, folder), availableNow=True).awaitTermination()
    fits = refitter.fits(spark).orderBy("batch_id").collect()
    assert [(r["batch_id"], r["total_packets"]) for r in fits] == [(1, 200), (3, 700)]


def test_running_counts(spark, small):
    packets = spark_packets(spark, small)
    folder = scratch_path(spark, "arrivals")
    arrive(packets, folder, 0, 1000)
    query = running_counts(packet_stream(spark, folder)).writeStream.outputMode("complete").format("memory")
    query.queryName("counts").trigger(availableNow=True).start().awaitTermination()
    found = {r["protocol"]: r["packets"] for r in spark.table("counts").collect()}
    expected = packets.filter("protocol is not null").groupBy("protocol").count().collect()
    assert found == {r["protocol"]: r["count"] for r in expected}


def test_steps_read_their_batch_only(spark, small, tmp_path):
    """After the first fit no history is read until the cost drifts; then all of it is."""
    packets = spark_packets(spark, small).withColumn("length", F.col("length").cast("double"))
    refitter = MergingRefitter(str(tmp_path / "refit"), {"trainer": "lloyd", "iterations": 2}, every=200)
    parts = [packets.filter(f"frame_number > {low} and frame_number <= {high}") for low, high in ((0, 50), (50, 300), (300, 550), (550, 800))]
    refitter._batch(parts[0], 0)
    assert refitter.newest(spark) is None
    refitter._batch(parts[1], 1)
    # Nothing can be read from these any more.
    held = {f: f.read_bytes() for i in (0, 1) for f in (tmp_path / "refit" / "history" / f"batch={i}").glob("*.parquet")}
    for f in held:
        f.write_bytes(b"unreadable")
    refitter._batch(parts[2], 2)
    first = spark.read.parquet(f"{refitter.folder}/state/2").first()
    refitter._batch(parts[2], 2)
    assert spark.read.parquet(f"{refitter.folder}/state/2").first() == first
    refitter._batch(packets.limit(0), 3)
    for f, content in held.items():
        f.write_bytes(content)
    # Packets unlike all before: the cost drifts.
    refitter._batch(parts[3].withColumn("length", F.col("length") * 1000), 4)
    told = [tuple(r) for r in refitter.fits(spark).orderBy("batch_id").collect()]
    assert told == [(1, 300, "full", 300), (2, 550, "step", 250), (4, 800, "full", 800)]
    scored = refitter.newest(spark)
    assert scored.settings.k == 5


def test_merged_moments_are_those_of_all(spark, small):
    from packetweave.streaming.refit import Moments

    rows = spark_packets(spark, small).select(F.col("frame_number").cast("double").alias("a"), F.col("length").cast("double").alias("b"))
    whole = Moments.of(rows, ("a", "b"))
    parts = Moments.of(rows.filter("a < 100"), ("a", "b")).merged(Moments.of(rows.filter("a >= 100"), ("a", "b")))
    assert parts.n == whole.n and abs(parts.means - whole.means).max() < 1e-9 and abs(parts.squares / whole.squares - 1).max() < 1e-9


def test_lists_arrive_with_one_header(spark, tmp_path):
    """Later files follow the header of the first batch; odd and foreign ones are listed; a repeated batch decides alike."""
    head = "No.,Time,Source,Destination,Protocol,Length,Info\n"
    arrivals, source = ListArrivals(str(tmp_path / "own")), tmp_path / "in"
    source.mkdir()
    files = [
        {"empty.csv": b"", "a.csv": (head + '1,0,a,b,TCP,5,"x\ny"\n').encode()},
        {"b.csv": (head + "2,1,a,b,TCP,5,caf\xe9\n").encode("latin1"), "c.csv": (head + "3,2,a,b,TCP,5,x,more\n").encode(), "d.csv": b"Info,No.\nx,4\n"}]
    for batch_id, arrived in enumerate(files):
        for name, content in arrived.items():
            (source / name).write_bytes(content)
        listed = spark.createDataFrame([(f"{source}/{n}", len(c)) for n, c in arrived.items()], "path string, length bigint")
        for _ in range(2):
            found = sorted((r["frame_number"], r["info"]) for r in arrivals.packets(listed, batch_id).collect())
            assert found == ([(1, "x\ny")] if batch_id == 0 else [(2, "café"), (3, "x")])
    told = {r["file"].rsplit("/", 1)[1]: (r["latin1"], r["ragged"], r["reason"] is not None) for r in arrivals.files(spark).collect()}
    assert told == {"a.csv": (False, False, False), "b.csv": (True, False, False), "c.csv": (False, True, False), "d.csv": (False, False, True)}
    assert arrivals.packets(listed.limit(0), 2).collect() == []
