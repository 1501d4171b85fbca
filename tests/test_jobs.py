"""Streams, sources and sinks in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from grainfield.operators import frontier, gold, operations, tables
from grainfield.sources import files, keyed_store, sinks
from grainfield.streaming import jobs


def run(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_event_stream(spark, tmp_path):
    lines = [json.dumps({"ts": f"2024-01-0{d}T00:0{m}:00", "level": "INFO", "event": e, "message": "m", "url": "u"}) for d in (1, 2, 3) for m, e in enumerate(("CRAWL", "CRAWL", "PRIVACY"))]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.jsonl").write_text("\n".join([*lines, "", "kaputt"]))
    batch = files.events(spark, str(tmp_path / "log"))
    assert batch.count() == 9 and batch.first().extra == {"url": "u"}
    rows = run(jobs.event_counts(files.event_stream(spark, str(tmp_path / "log"))), tmp_path, "counts").collect()
    assert {(r.start.day, r.event, r.n) for r in rows} >= {(1, "CRAWL", 2), (1, "PRIVACY", 1), (2, "CRAWL", 2)}


def stream(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name), mode="append")
    return spark.readStream.schema(schema).parquet(str(tmp_path / name))


def test_windows(spark, tmp_path):
    rows = [("r", f"2024-01-01 00:{m:02d}:00", 5, "h", "t") for m in (0, 1, 2, 10, 11, 40)] + [("r", "2024-01-03 00:00:00", 1, "x", "t")]
    source = stream(spark, tmp_path, "in", rows, "run string, t string, tokens int, hash string, target string").withColumn("ts", F.col("t").cast("timestamp"))
    spans = run(jobs.liveness(source), tmp_path, "spans").collect()
    assert sorted(r.beats for r in spans) == [1, 2, 3]
    assert run(jobs.distinct_content(source), tmp_path, "content").count() == 2
    assert {r.n for r in run(jobs.daily_findings(source), tmp_path, "days").collect()} == {6}
    assert max(r.requests for r in run(jobs.rates(source), tmp_path, "rates").collect()) == 1


def test_liveness_timer(spark, tmp_path):
    """A run is told to be inactive by its timer, on time, without a later beat of its own."""
    schema, at = "run string, t string", lambda m: f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00"
    args = (str(tmp_path / "out"), str(tmp_path / "check"))
    for beats in ([("a", 0), ("a", 1), ("b", 1)], [("b", 2), ("b", 30)], [("b", 31), ("a", 32)], [("c", 90)], [("c", 91)]):
        source = stream(spark, tmp_path, "beats", [(r, at(m)) for r, m in beats] + [("a", None)], schema).withColumn("ts", F.col("t").cast("timestamp"))
        jobs._write_batches(jobs.liveness_changes(source, "2 minutes", "1 minute"), *args).awaitTermination(120)
    rows = sorted((r.run, r["at"].hour * 60 + r["at"].minute, r.status) for r in spark.read.parquet(args[0]).collect())
    assert rows == [("a", 0, "active"), ("a", 3, "inactive"), ("a", 32, "active"), ("a", 34, "inactive"), ("b", 1, "active"), ("b", 4, "inactive"), ("b", 30, "active"), ("b", 33, "inactive"), ("c", 90, "active")]


def test_liveness_by_the_clock(spark, tmp_path):
    """Without any further data the timer of the processing clock tells."""
    import time

    source = stream(spark, tmp_path, "beats", [("a", "2024-01-01 00:00:00")], "run string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    q = jobs.liveness_changes(source, "2 seconds", clock="processing").writeStream.format("memory").queryName("clock").option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="500 milliseconds").start()
    until = time.time() + 60
    while time.time() < until and spark.table("clock").count() < 2:
        time.sleep(0.5)
    q.stop()
    assert sorted(r.status for r in spark.table("clock").collect()) == ["active", "inactive"]


def test_page_changes(spark, tmp_path):
    """Eight batches against a plain dictionary, then the last one again from the state before it."""
    import random
    import shutil

    schema, args, rng, known = "target string, url_key string, hash string, seen long", [str(tmp_path / x) for x in ("out", "check")], random.Random(1), {}
    for n in range(8):
        rows = [(f"t{rng.randrange(3)}", f"u{rng.randrange(9)}", rng.choice("xyz"), rng.randrange(99)) for _ in range(15)] + [(None, "u", None, n)]
        q = jobs.page_changes(stream(spark, tmp_path, "pages", rows, schema), *args)
        q.awaitTermination(120)
        state = q.lastProgress["stateOperators"][0]
        last = {}
        for t, u, h, s in sorted(rows, key=lambda r: (r[3], r[2] or "")):
            last[t, u] = h or ""
        want = {(*k, h, k not in known) for k, h in last.items() if known.get(k) != h}
        found = spark.read.parquet(f"{args[0]}/batch={n}").collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)
        assert state["numRowsUpdated"] == len(last)  # the state of this batch's pages, not of all before
        known |= last
    for kind in ("commits/7", "commits/.7.crc"):  # as after a failure between writing and committing
        (tmp_path / "check" / kind).unlink(missing_ok=True)
    shutil.rmtree(tmp_path / "out/batch=7")
    jobs.page_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "pages")), *args).awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(f"{args[0]}/batch=7").collect()} == want


def test_insert_findings(spark, tmp_path):
    schema = "ags string, massnahme string, start string, pos long"
    args = [str(tmp_path / x) for x in ("store", "check")]
    for rows in ([(None, "Bau ", None, 1), (None, "bau", None, 2), ("1", "Bau", None, 3), ("1", None, None, 9)], [(None, "BAU", None, 4), ("2", "Neu", None, 5), ("1", None, None, 8)]):
        q = jobs.insert_findings(stream(spark, tmp_path, "finds", rows, schema), *args)
        q.awaitTermination(120)
    assert sorted(r.pos for r in spark.read.parquet(args[0]).collect()) == [1, 3, 5, 9]
    assert q.lastProgress["stateOperators"][0]["numRowsUpdated"] <= 3


def test_keyed_store(spark, tmp_path):
    """A write touches its keys' buckets alone; one that fails leaves the version before."""
    path, rows = str(tmp_path / "store"), [(i, f"v{i}", None if i % 5 else i) for i in range(200)] + [(None, "n", 0)]
    keyed_store.create_store(spark.createDataFrame(rows, "id int, v string, n int"), path, ["id"], 16)
    read = lambda v=None: {r.id: (r.v, r.n) for r in keyed_store.read_store(spark, path, v).collect()}
    known = {i: (v, n) for i, v, n in rows}
    assert read() == known
    files = lambda: {p.name for p in (tmp_path / "store/data").rglob("*.parquet")}
    before = files()
    batch = spark.createDataFrame([(7, "neu", 1)], "id int, v string, n int")
    touched = keyed_store.merge_store(batch, path, lambda old, new: tables.upsert(old, new, ["id"]))
    assert len(touched) == 1 and len(files() - before) == 1 and read() == known | {7: ("neu", 1)} and read(0) == known
    keyed_store.merge_store(spark.createDataFrame([(7, None, 5), (8, "acht", None)], "id int, v string, n int"), path, lambda old, new: tables.apply_updates(old, new, "id"))
    known |= {7: ("neu", 5), 8: ("acht", known[8][1])}
    keyed_store.merge_store(spark.createDataFrame([(8, "x", 0), (900, "y", 0)], "id int, v string, n int"), path, lambda old, new: old.unionByName(tables.insert_if_absent(old, new, {"id": F.col("id")}, "v")))
    known |= {900: ("y", 0)}
    assert read() == known and keyed_store.merge_store(batch.limit(0), path, lambda old, new: old) == set()
    keyed_store.merge_store(spark.createDataFrame([(900,)], "id int"), path, lambda old, new: old.join(new, "id", "left_anti"))
    del known[900]
    assert read() == known

    def broken(old, new):
        return old.unionByName(new).withColumn("v", F.expr("CASE WHEN id = 7 THEN raise_error('no') ELSE v END"))

    with pytest.raises(Exception, match="no"):
        keyed_store.merge_store(batch, path, broken)
    assert read() == known
    keyed_store.create_store(batch.limit(0), str(tmp_path / "none"), ["id"])
    assert keyed_store.read_store(spark, str(tmp_path / "none")).collect() == []
    keyed_store.merge_store(batch, str(tmp_path / "none"), lambda old, new: tables.upsert(old, new, ["id"]))
    assert keyed_store.read_store(spark, str(tmp_path / "none")).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿Internetadresse;AGS\nhttps://a.de;01001\n;01002\n", encoding="utf-8")
    assert [(r.Internetadresse, r.AGS) for r in files.master_targets(spark, str(tmp_path / "m.csv")).collect()] == [("https://a.de", "01001"), (None, "01002")]
    (tmp_path / "s.csv").write_text(" Ort ,URL,ags,Bundesland,Einwohner\nA, https://a.de ,1,B,12\nB,,2,B,5\nC,https://c.de,3,B,viele\n", encoding="utf-8")
    assert [(r.url, r.einwohner) for r in files.seeds(spark, str(tmp_path / "s.csv")).collect()] == [("https://a.de", 12), ("https://c.de", 0)]
    (tmp_path / "g.json").write_text(json.dumps({"domain": "a.de", "entries": [{"url": "u", "relevant": True, "kategorie": "bauen"}, {"url": "v", "relevant": False, "kategorie": "falsch"}]}))
    good, bad = files.gold_corpus(spark, str(tmp_path / "g.json"))
    assert (good.count(), bad.count()) == (1, 1)
    assert sinks.gold_export(good).first().total_relevant == 1
    (tmp_path / "c.json").write_text(json.dumps([{"label": "a", "seed_url": "u", "max_pages": 1}, {"label": "b"}]))
    good, bad = files.scenarios(spark, str(tmp_path / "c.json"))
    assert good.count() == 1 and bad.first().missing == ["seed_url", "max_pages"]
    (tmp_path / "k.json").write_text(json.dumps({"max_domains": 3}))
    assert files.seed_config(spark, str(tmp_path / "k.json")).first().random_seed == 42
    (tmp_path / "r/ort/m1").mkdir(parents=True)
    (tmp_path / "r/ort_m1.json").write_text(json.dumps({"ort": "A", "massnahmen": []}))
    (tmp_path / "r/ort/m1/normalized.json").write_text(json.dumps({"ort": "B", "massnahmen": []}))
    assert sorted(r.ort for r in files.model_results(spark, str(tmp_path / "r"), "m1").collect()) == ["A", "B"]


def test_sinks(spark, tmp_path):
    records = spark.createDataFrame([("bauen", "A"), ("bauen", None), ("verkehr", "A")], "kategorie string, ort string")
    row = sinks.project_export(records, "x.de").first()
    assert (row.total, row.by_kategorie, row.by_ort) == (3, {"bauen": 2, "verkehr": 1}, {"A": 2, "(unbekannt)": 1})
    pairs = spark.createDataFrame([("a", "train"), ("b", "eval")], "input string, part string")
    sinks.write_split(pairs, str(tmp_path / "split"))
    assert spark.read.json(str(tmp_path / "split/part=eval")).count() == 1
    log = spark.createDataFrame([("2024-01-01 00:00:00", "DEBUG", "CRAWL", {"a": "b"}), ("2024-01-01 00:00:00", "AUDIT", "PRIVACY", {}), ("2024-01-01 00:00:00", "OK", "RELEVANCE", {"url": "u", "keywords": "a,b"})], "t string, level string, event string, extra map<string,string>")
    sinks.write_channels(log.withColumn("ts", F.col("t").cast("timestamp")).drop("t"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log/all")).count() == 2
    assert spark.read.csv(str(tmp_path / "log/relevance"), header=True).first().matched_keywords == "a;b"
    sinks.skipped_lines(spark.createDataFrame([("2024-01-01 00:00:00", "u", "robots")], "t string, url string, reason string").withColumn("ts", F.col("t").cast("timestamp")), str(tmp_path / "skip"))
    assert spark.read.text(str(tmp_path / "skip")).first().value.endswith("u\trobots")


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("b", None), ("a", 0.5)], "label string, rate double")
    sinks.write_json_array(rows, str(tmp_path / "array"))
    assert json.loads(spark.read.text(str(tmp_path / "array")).first().value) == [{"label": "a", "rate": 0.5}, {"label": "b", "rate": None}]
    try:
        sinks.write_json_array(rows, str(tmp_path / "array"), 1)
        raise AssertionError
    except ValueError:
        pass
    sinks.write_project(spark.createDataFrame([("bauen", "A")], "kategorie string, ort string"), "x.de", str(tmp_path / "project"))
    assert spark.read.json(str(tmp_path / "project/records")).count() == spark.read.json(str(tmp_path / "project/summary")).first().total == 1
    assert spark.range(1).select(sinks.keyword_text(F.array(*[F.lit(f"k{i},x") for i in range(12)]))).first()[0].count("|") == 9
    sinks.write_json(rows, str(tmp_path / "lines"))
    sinks.write_json(rows, str(tmp_path / "lines"), "append")
    assert spark.read.json(str(tmp_path / "lines")).count() == 4
    results = spark.createDataFrame([("a-dorf", "m1", 1)], "ort_slug string, modell string, funde int")
    sinks.write_by_place_and_model(results, str(tmp_path / "models"))
    assert spark.read.json(str(tmp_path / "models/ort_slug=a-dorf/modell=m1")).first().funde == 1
    snap = sinks.seed_snapshot(spark.createDataFrame([(42,)], "random_seed int"), spark.createDataFrame([("2",), ("1",)], "ags string")).first()
    assert (snap.domains, snap.total) == (["1", "2"], 2)
    children = sinks.insert_children(spark.createDataFrame([("1.0", "x"), ("9", "y")], "version string, message string"), spark.createDataFrame([(7, "1.0")], "id int, version string"))
    assert [tuple(r) for r in children.collect()] == [("x", 7)]
    (tmp_path / "pairs.jsonl").write_text('{"instruction": "i", "input": "x", "output": "{}"}\n\n')
    assert files.pairs(spark, str(tmp_path / "pairs.jsonl")).count() == 1
    known = spark.createDataFrame([("1", "u", 3)], "ags string, url string, x int")
    assert files.targets_or_inline(spark, known, None).collect() == [("1", "u")] and files.targets_or_inline(spark, known, [("5", "v")]).collect() == [("5", "v")]


def test_months(spark, tmp_path):
    rows = [(f"2024-0{m}-0{d} 00:00:00",) for m in (1, 2, 3, 5) for d in (1, 2)]
    source = stream(spark, tmp_path, "months", rows, "t string").withColumn("ts", F.col("t").cast("timestamp"))
    found = {r.month.month: r.n for r in run(jobs.monthly_findings(source), tmp_path, "per_month").collect()}
    assert found == {1: 2, 2: 2, 3: 2}


def test_status_row(spark):
    rows = [(1, 1, "active", "a"), (1, 2, "heartbeat", "b"), (1, 3, "inactive", None), (1, 4, "active", "c"), (2, 1, "heartbeat", "x"), (3, 1, "active", "a"), (3, 2, "inactive", None)]
    df = spark.createDataFrame([(k, p, f"2024-01-01 00:00:0{p}", e, t) for k, p, e, t in rows], "k int, pos int, t string, event string, target string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r.k: (r.status, r.started_at and r.started_at.second, r.stopped_at and r.stopped_at.second, r.last_heartbeat.second, r.current_target) for r in tables.status_row(df, "k").collect()}
    assert got == {1: ("active", 4, None, 4, "c"), 2: ("inactive", None, None, 1, "x"), 3: ("inactive", 1, 2, 1, None)}


def test_recall_and_rates(spark):
    rows = spark.createDataFrame([("s", "focused", i < 6, 0.5) for i in range(10)] + [("s", "bfs", i < 3, 0.5) for i in range(10)] + [("z", "focused", True, 0.5), ("z", "bfs", False, 0.5)], "scenario string, mode string, is_relevant boolean, score double")
    out = {r.scenario: r for r in gold.compare_runs(rows).collect()}
    assert out["s"].hr_focused == 0.6 and out["s"].improvement == 100.0 and out["z"].improvement == 0.0
    empty = spark.createDataFrame([], "url string, relevant boolean")
    assert gold.recall(empty, empty.select("url")).first().recall == 0.0


def test_recursive_twin(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 10)], "src long, dst long")
    seeds = spark.createDataFrame([(1,)], "node long")
    expected = {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.node: r.level for r in frontier.reach(edges, seeds, 5).collect()} == expected
    assert {r.node: r.level for r in frontier.bfs_sql(spark, edges, seeds, 5).collect()} == expected


def test_dominant_first_on_ties(spark):
    log = spark.createDataFrame([(1, 0, "OK"), (1, 1, "HTTP_500"), (1, 2, "ROBOTS"), (2, 0, "OK")], "target int, pos int, status string")
    assert {r.target: r.dominant for r in operations.dominant_status(log).collect()} == {1: "HTTP_500", 2: "UNKNOWN"}


def test_insert_if_absent_nulls(spark):
    rows = spark.createDataFrame([(1, None, "T"), (2, None, "T")], "id int, ags string, m string")
    kept = tables.insert_if_absent(rows.limit(0), rows, {"a": F.col("ags"), "m": F.col("m")}, "id")
    assert [r.id for r in kept.collect()] == [1]
