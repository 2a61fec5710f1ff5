"""Order-dependent operators against plain loops, sources round trip, plans and streams."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from leadweave.operators import baseline, dedup, export, leads
from leadweave.operators import greedy as greedy_module
from leadweave.plans import understanding as U
from leadweave.plans.validate import validate
from leadweave.schema import EXPORT_COLUMNS
from leadweave.sources import files, providers


def greedy(rows):
    seen, kept = set(), []
    for seq, keys in sorted(rows):
        if keys and not seen & set(keys):
            seen |= set(keys)
            kept.append(seq)
    return kept


def key_rows(seed):
    rng = random.Random(seed)
    rows = [(i, [f"k{rng.randrange(150)}" for _ in range(rng.randrange(4))]) for i in range(300)] + [(1000 + i, [f"c{i}", f"c{i + 1}"]) for i in range(40)]
    rows += [(2000 + i, [f"d{i}", f"d{i + 1}"] + [f"e{i - i % 7}"] * (i % 7 in (3, 6))) for i in range(60)]
    return rows + [(3000 + i, ["hot", f"h{i % 9}"]) for i in range(90)] + [(3100 + i, [f"h{i}", None]) for i in range(12)]


@pytest.mark.parametrize(("rounds", "range_keys"), [(0, 10_000), (0, 200), (1, 150), (3, 80), (24, 10_000)], ids=["one range", "many ranges", "firsts first", "chains first", "all"])
def test_greedy_distinct(spark, rounds, range_keys):
    rows = key_rows(rounds + range_keys)
    df = spark.createDataFrame(rows, "seq long, keys array<string>")
    want = greedy([(s, [k for k in keys if k is not None]) for s, keys in rows])
    assert sorted(r["seq"] for r in dedup.greedy_distinct(df, rounds=rounds, range_keys=range_keys).collect()) == want


def test_chains_settle_without_a_sweep(spark, monkeypatch):
    """3,000 links, with a branch at each hundredth: doubling reaches the end of it."""
    rows = [(i, [f"c{i}", f"c{i + 1}"] + [f"b{i}"] * (i % 100 == 50)) for i in range(3000)] + [(5000 + i, [f"b{i}", f"x{i}"]) for i in range(50, 3000, 100)]
    monkeypatch.setattr(greedy_module, "swept", None)
    df = spark.createDataFrame(rows, "seq long, keys array<string>")
    assert sorted(r["seq"] for r in dedup.greedy_distinct(df).collect()) == greedy(rows)


def test_size_estimates_stay_small(spark):
    """Doubling pointers 12 times squares no estimate of Spark's, whose number of digits would double with each."""
    left = spark.createDataFrame([(i, k) for i in range(3000) for k in (f"c{i}", f"c{i + 1}")], "seq long, key string")
    assert int(greedy_module.chained(left)._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length() < 1000


@pytest.mark.parametrize("range_keys", [700, 10_000])
def test_braids_settle_in_two_passes(spark, monkeypatch, range_keys):
    """Chains that end in rows with two forerunners, which are always blocked: neither doubling nor a sweep is needed."""
    rows = [(i, [f"a{i}", f"a{i + 1}"] + [f"b{i - i % 7}"] * (i % 7 in (3, 5)) + [f"x{i // 50}"] * (i % 50 == 9)) for i in range(3000)]
    monkeypatch.setattr(greedy_module, "swept", None)
    monkeypatch.setattr(greedy_module, "chained", None)
    df = spark.createDataFrame(rows, "seq long, keys array<string>")
    assert sorted(r["seq"] for r in dedup.greedy_distinct(df, range_keys=range_keys).collect()) == greedy(rows)


def test_braids_look_for_nothing_that_firsts_block(spark, monkeypatch):
    """One row comes first in all of its keys: what it blocks took five joins of all rows, for a handful of them."""
    rows = [(i, [f"a{i}", f"a{i + 1}"] + [f"b{i - i % 7}"] * (i % 7 in (3, 5))) for i in range(2000)]
    monkeypatch.setattr(greedy_module, "without_blocked", None)
    df = spark.createDataFrame(rows, "seq long, keys array<string>")
    assert sorted(r["seq"] for r in dedup.greedy_distinct(df, range_keys=900).collect()) == greedy(rows)


def test_ranges_that_hang_together_are_not_read(spark, monkeypatch):
    """Keys of several ranges are counted before any range is read row by row."""
    left = spark.createDataFrame([(i, f"k{i % 500}") for i in range(2000)], "seq long, key string")
    monkeypatch.setattr(greedy_module, "_under_conditions", None)
    assert greedy_module.conditional(left, 4, 499) is None


@pytest.mark.parametrize("seed", range(4))
def test_conditional(spark, seed):
    """Ranges that hang together in all ways: rows with several conditions, keys of many ranges, one range."""
    rng = random.Random(seed)
    rows = [(i, [f"a{i + rng.randint(0, 3)}", f"b{i + rng.randint(0, 9)}", f"h{rng.randint(0, 40)}"][: rng.randint(1, 3)]) for i in range(150)]
    left = spark.createDataFrame([(s, k) for s, keys in rows for k in set(keys)], "seq long, key string")
    for ranges in (1, 9):
        assert sorted(r["seq"] for r in greedy_module.conditional(left, ranges, 10_000).collect()) == greedy(rows)
    assert greedy_module.conditional(left, 9, 3) is None


def test_greedy_blocking_and_baseline(spark):
    rows = spark.createDataFrame([(0, "A", None), (1, "B", "https://x.example"), (2, "C", "https://x.example")], "seq long, company_name string, website string")
    known = spark.createDataFrame([("name:b",)], "key string")
    assert [r["seq"] for r in validate(rows, known).collect()] == [0]


def test_greedy_empty(spark):
    assert dedup.greedy_distinct(spark.createDataFrame([], "seq long, keys array<string>")).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = root(u), root(v)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == root(x) for x in parent)


def test_best_by_name(spark):
    rows = spark.createDataFrame([(0, "X", None), (1, "Y", "w"), (2, "X", "w1"), (3, "X", "w2")], "seq long, company_name string, website string")
    assert sorted(map(tuple, dedup.best_by_name(rows).collect())) == [(0, "X", "w1"), (1, "Y", "w")]


def test_pages_check_their_bounds(spark):
    rows = spark.range(5).withColumnRenamed("id", "seq")
    assert [tuple(r) for r in leads.page(rows, 3, 10).collect()] == [(3, 5), (4, 5)]
    with pytest.raises(ValueError):
        leads.page(rows, 0, 501)


def test_export_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("A", None, ["x", "y"])], "company_name string, gst string, remarks array<string>")
    path = f"{tmp_path}/e"
    for job in ("1", "2", "1", "a/b c"):
        export.append_export(rows, path, job)
    back = export.read_export(spark, path)
    once = rows.count()
    assert {r["job"]: r["count"] for r in back.groupBy("job").count().collect()} == {"1": once, "2": once, "a/b c": once}
    back = back.drop("job")
    assert back.columns == [h for h, _ in EXPORT_COLUMNS] and back.first()["Remarks"] == "x; y" and back.first()["GST"] == ""
    export.export_rows(rows).write.parquet(f"{path}/rows/job=2/attempt=broken")  # no commit: not there
    assert export.read_export(spark, path).count() == 3 * once
    late = (1 << 62, ["GST Confidence"]), ((1 << 62) + 1, ["Else"])
    spark.createDataFrame([("old", "x", late[0][0], [*back.columns, *late[0][1]])], export.COMMITS).write.mode("append").parquet(f"{path}/commits")
    back.withColumn("GST Confidence", F.lit("")).write.parquet(f"{path}/rows/job=old/attempt=x")
    assert export.read_export(spark, path).count() == 6 * once
    spark.createDataFrame([("old", "y", late[1][0], [*back.columns, *late[1][1]])], export.COMMITS).write.mode("append").parquet(f"{path}/commits")
    with pytest.raises(ValueError, match="unexpected headers"):
        export.read_export(spark, path)
    assert export.checked_export(back.withColumn("GST Sources", F.lit(""))).columns == back.columns
    with pytest.raises(ValueError):
        export.checked_export(back.drop("City"))


def test_baseline_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.csv").write_bytes("﻿Company Name,Website,Contact Number\nAcmé,,98765 43210\n".encode())
    (tmp_path / "sub" / "a.csv").write_bytes("Company,Alt Phone\nCaf\xe9,1234567\n".encode("cp1252"))
    (tmp_path / "C.xlsx").write_bytes(files.xlsx_bytes(["Company Name", "GSTIN"], [["Pumps & Co", "29ABCDE1234F1ZW"]]))
    assert [r["name"] for r in files.catalogue(spark, str(tmp_path)).collect()] == ["b.csv", "C.xlsx"]
    rows = files.baseline(spark, str(tmp_path))
    assert sorted(r["company_name"] for r in rows.collect()) == ["Acmé", "Café", "Pumps & Co"]
    keys = {r["key"] for r in baseline.key_set(rows).collect()}
    assert keys == {"name:acmé", "phone:9876543210", "name:café", "phone:1234567", "name:pumpsco", "gst:29ABCDE1234F1ZW"}


def test_workbook_is_well_formed():
    body = files.xlsx_bytes(["A", "B"], [["1", "<&>"], ["", "x" * 80]])
    assert zipfile.ZipFile(io.BytesIO(body)).testzip() is None
    assert files.xlsx_rows(body) == [["A", "B"], ["1", "<&>"], ["", "x" * 80]]


def test_file_names():
    assert files.is_plain_file_name("a.CSV") and not files.is_plain_file_name("../a.csv") and not files.is_plain_file_name("a.txt")


def test_providers(spark):
    web = '<div class="g"><a href="https://a.example"><h3>A Ltd</h3></a></div><div class="g"><h3>No link</h3></div>'
    maps = '<div class="Nv2PK"><a class="hfpxzc" href="/maps/1"></a><div class="qBF1Pd">Acme</div><div class="W4Efsd">Pump supplier · 42 Main St</div><span class="UsdlK"> 98765 </span><a href="https://www.google.com/aclk?x">ad</a></div><div class="Nv2PK"><div class="qBF1Pd">Acme</div><a href="https://acme.example">site</a></div>'
    listing = '<div class="card"><a href="https://d.example/1">D One</a><span class="city">Salem</span></div><div class="card"><a href="https://d.example/2">d one</a></div>'

    def pages(html):
        return spark.createDataFrame([("q", 0, html), ("q", 1, None)], "query string, place int, html string")

    assert [(r["company_name"], r["website"]) for r in providers.web_search(pages(web)).collect()] == [("A Ltd", "https://a.example")]
    row = providers.map_listing(pages(maps)).collect()
    assert [(r["company_name"], r["website"], r["rank"]) for r in row] == [("Acme", "https://acme.example", 0)]
    assert [(r["company_name"], r["city"]) for r in providers.directory_listing(pages(listing)).collect()] == [("D One", "Salem")]


def test_recorded_pages_source(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text('{"query": "q", "place": 1, "html": "<p>"}\n')
    spark.dataSource.register(providers.RecordedPages)
    rows = spark.read.format("recorded_pages").option("path", str(tmp_path)).load().collect()
    assert [tuple(r) for r in rows] == [("q", 1, "<p>")]


def test_planner_and_answers(spark):
    fenced = '```json\n{"intent":"list","industry":"Valve","workflow":"lead_generation","confidence":0.9}\n```'
    assert U.parse_answer(fenced)["industry"] == "Valve"
    with pytest.raises(ValueError):
        U.parse_answer("sorry")
    rows = spark.createDataFrame([("list all valve industries in hyderabad", "list_industries", "", "Hyderabad", None)], "user_query string, workflow string, industry string, location string, buyer_persona string")
    plan = U.planned(rows).first().asDict()
    assert (plan["workflow"], plan["industry"], plan["location"]) == ("lead_generation", "Valve", "Hyderabad")
    assert U.request_of(plan) == {"industry": "Valve", "location": "Hyderabad", "keywords": [], "max_results": 100}


def test_workflow_tells_its_steps(spark):
    told = []
    context = U.Context({"workflow": "lead_generation"}, listener=lambda step, status: told.append((step, status)))
    out = U.run_workflow(spark.range(3), context, {"search": lambda df, c: df.filter("id > 0")})
    assert out.count() == 2 and told[:2] == [("search", "running"), ("search", "completed")] and len(told) == 10


def test_remote_jobs():
    base = "https://x.example/v2/e/runsync"
    assert (U.endpoint(base), U.endpoint(base, "async"), U.status_endpoint(base, "job-123")) == (base, "https://x.example/v2/e/run", "https://x.example/v2/e/status/job-123")
    assert U.request_payload("System", "User", 0.4, 25)["input"]["prompt"] == "System\n\nUser: User\n\nAssistant:"
    assert [m["role"] for m in U.request_payload("S", "U", 0, 1, "messages")["input"]["messages"]] == ["system", "user"]
    from leadweave.functions.payloads import completion_text

    answers = iter([{"id": "1", "status": "IN_QUEUE"}, {}, {"status": "COMPLETED", "output": [{"text": "Done"}]}])
    waits = []
    assert U.poll(lambda: next(answers), completion_text, sleep=waits.append, clock=lambda: 0.0) == "Done" and waits == [1.0, 2.0]
    with pytest.raises(U.JobFailed, match="broken"):
        U.poll(lambda: {"status": "FAILED", "error": "broken"}, completion_text)


def test_uploads(tmp_path):
    folder = str(tmp_path / "in")
    files.store_upload(folder, "a.csv", b"x")
    with pytest.raises(FileExistsError):
        files.store_upload(folder, "a.csv", b"y")
    with pytest.raises(ValueError):
        files.store_upload(folder, "../a.csv", b"y")
    with pytest.raises(ValueError):
        files.store_upload(folder, "b.csv", bytes(files.MAX_UPLOAD_BYTES + 1))
    files.remove_upload(folder, "a.csv")
    assert not list((tmp_path / "in").iterdir())


def test_job_log(spark, tmp_path):
    from leadweave.operators import jobs

    job = jobs.new_job_id()
    for i, (step, status) in enumerate([("", "queued"), ("search", "running"), ("search", "step failed"), ("search", "failed")]):
        jobs.log_event(spark, f"{tmp_path}/log", i, job, step, status)
    events = spark.read.parquet(f"{tmp_path}/log")
    assert jobs.latest_states(events).first()["status"] == "failed" and len(job) == 32
    assert [r["id"] for r in jobs.events_of(events, job).collect()] == [0, 1, 2, 3]


def test_settings_and_pace():
    from leadweave.plans.settings import Settings, throttled

    assert Settings.from_env({"LEADWEAVE_POLL_ATTEMPTS": "3", "LEADWEAVE_LOOKUP_PEOPLE": "TRUE"}) == Settings(poll_attempts=3, lookup_people=True)
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    assert list(throttled("abc", 0.5, sleep, lambda: now[0])) == ["a", "b", "c"] and waits == [0.5, 0.5]


def test_export_stream_forgets_nothing_over_restarts(spark, tmp_path):
    """Rows of several keys, some shared by most rows, in batches that a restart parts; keyed state against a loop."""
    from leadweave.streaming.jobs import append_new, exported, until_idle

    rng = random.Random(8)
    batches = [[(b * 100 + i, [f"k{rng.randrange(60)}", "hot" if rng.random() < 0.3 else f"r{rng.randrange(90)}", None][: rng.randrange(4)]) for i in range(40)] for b in range(4)]
    want, taken = [], set()
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, "seq long, keys array<string>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("seq long, keys array<string>").parquet(f"{tmp_path}/in")
        until_idle(append_new(stream, f"{tmp_path}/out", f"{tmp_path}/state", lambda x: x))
        first = greedy([(s, [k for k in keys if k]) for s, keys in rows])
        new = [s for s in first if not taken & set(dict(rows)[s])]
        taken |= {k for s in new for k in dict(rows)[s] if k}
        want += new
    assert sorted(r["seq"] for r in exported(spark, f"{tmp_path}/out").collect()) == sorted(want)


def test_export_stream_asks_only_for_what_a_batch_keeps(spark, tmp_path):
    """Duplicates within a batch meet no state, and the keys of a batch run again do not bar its own rows."""
    from leadweave.streaming.jobs import _answered, append_new, exported, until_idle

    for b in range(2):
        spark.createDataFrame([(b * 500 + i, ["hot", f"r{i}"] if i else [f"own{b}", "first"]) for i in range(500)], "seq long, keys array<string>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("seq long, keys array<string>").parquet(f"{tmp_path}/in")
        until_idle(append_new(stream, f"{tmp_path}/out", f"{tmp_path}/state", lambda x: x))
    assert sorted(r["seq"] for r in exported(spark, f"{tmp_path}/out").collect()) == [0, 1]
    asked = spark.read.parquet(f"{tmp_path}/out/asked").filter("`to` >= 0").collect()
    assert sorted((r["batch"], r["key"]) for r in asked) == sorted([(0, "own0"), (0, "first"), (0, "hot"), (0, "r1"), (1, "own1"), (1, "first"), (1, "hot"), (1, "r1")])
    again = spark.createDataFrame([("own0", 0), ("hot", 0), ("hot", 1), ("own1", 1)], "key string, batch long")
    again.write.mode("append").parquet(f"{tmp_path}/out/asked/to=7")
    before = spark.read.parquet(f"{tmp_path}/out/known").count()
    _answered(spark, f"{tmp_path}/out", f"{tmp_path}/state")
    assert spark.read.parquet(f"{tmp_path}/out/known").count() == before + 1


def test_followed_jobs_keep_the_last_state(spark, tmp_path):
    from leadweave.schema import JOB_EVENT
    from leadweave.streaming.jobs import current_jobs, follow_jobs, until_idle

    batches = [[(1, "a", "t1", "queue", "queued", ""), (2, "b", "t2", "queue", "queued", "")], [(3, "a", "t3", "search", "running", "")], [(4, "a", "t4", "search", "failed", ""), (5, "a", "t5", "", "failed", "")]]
    for rows in batches:
        spark.createDataFrame(rows, JOB_EVENT).write.mode("append").parquet(f"{tmp_path}/in")
        events = spark.readStream.schema(spark.createDataFrame([], JOB_EVENT).schema).parquet(f"{tmp_path}/in")
        until_idle(follow_jobs(events, f"{tmp_path}/jobs", f"{tmp_path}/state"))
    found = {r["job_id"]: (r["status"], r["created_at"], r["last_event"]) for r in current_jobs(spark, f"{tmp_path}/jobs").collect()}
    assert found == {"a": ("failed", "t1", 5), "b": ("queued", "t2", 2)}


def test_folded_log_counts_each_event_once(spark, tmp_path):
    from leadweave.operators import jobs
    from leadweave.schema import JOB_EVENT

    log, ids = f"{tmp_path}/log", []
    for turn in range(3):
        for i in range(4):
            ids.append(turn * 4 + i)
            spark.createDataFrame([(ids[-1], f"j{i % 2}", "t", "s", "running", "")], JOB_EVENT).coalesce(1).write.mode("append").parquet(log)
        assert sorted(r["id"] for r in jobs.read_log(spark, log).collect()) == ids
        assert jobs.fold_log(spark, log) == turn
        assert sorted(r["id"] for r in jobs.read_log(spark, log).collect()) == ids
        if turn:
            assert jobs.drop_folded(spark, log) == (8 if turn == 1 else 4)
            assert sorted(r["id"] for r in jobs.read_log(spark, log).collect()) == ids


def test_lookups_ask_once(spark, tmp_path):
    """A key is asked for once, found or not; live lookups keep their pace; nothing is asked for empty and null keys."""
    import time

    from leadweave.operators import lookups
    from leadweave.plans.settings import Settings

    asked = tmp_path / "asked"
    asked.mkdir()

    def answer(key):
        (asked / f"{key}-{time.time_ns()}").touch()
        return {"v": key.upper()} if key != "none" else None

    ask = lookups.ask_live(answer, "v string", Settings(lookup_pause=0.05))
    keys = [("a",), ("b",), ("a",), (None,), ("",), ("none",)]
    first = lookups.look_up(spark.createDataFrame(keys, "key string").coalesce(1), f"{tmp_path}/m", ask, "v string", 1)
    assert {(r["key"], r["answer"] and r["answer"]["v"], r["run"]) for r in first.collect()} == {("a", "A", 1), ("b", "B", 1), ("none", None, 1)}
    second = lookups.look_up(spark.createDataFrame([*keys, ("c",)], "key string"), f"{tmp_path}/m", ask, "v string", 2)
    assert {(r["key"], r["run"]) for r in second.collect()} == {("a", 1), ("b", 1), ("none", 1), ("c", 2)}
    names = sorted(p.name.split("-")[0] for p in asked.iterdir())
    assert names == ["a", "b", "c", "none"]
    assert {r["key"]: r["v"] for r in lookups.answered(second, "key").collect()} == {"a": "A", "b": "B", "c": "C"}
    assert lookups.look_up(spark.createDataFrame([], "key string"), f"{tmp_path}/new", ask, "v string", 1).count() == 0


def test_missing_baseline_is_empty(spark, tmp_path):
    assert files.baseline(spark, f"{tmp_path}/nowhere").count() == 0 and "company_name" in files.baseline(spark, f"{tmp_path}/nowhere").columns


def test_page_source_skips_other_queries(spark, tmp_path):
    """Folders of other queries are no partitions; odd lines and unfinished files do no harm; one frame serves many questions."""
    spark.dataSource.register(providers.RecordedPages)
    pages = [(q, p, None if p == 3 else f"<p>{p}") for q in ("a b", "c", "d/e") for p in range(5)]
    spark.createDataFrame(pages, "query string, place long, html string").repartition("query").write.partitionBy("query").json(f"{tmp_path}/in")
    (tmp_path / "in" / "loose.jsonl").write_text('{"query": "c", "place": 9, "html": "x"}\n\n{"query": 7, "place": null}\n')
    (tmp_path / "in" / "_part.jsonl").write_text("not finished")
    source = spark.read.format("recorded_pages").option("path", f"{tmp_path}/in")
    df = source.load()
    assert df.count() == 17 and df.rdd.getNumPartitions() == 4
    own = source.option("queries", '["c"]').load()
    assert own.rdd.getNumPartitions() == 2  # its folder, and the file that names no query
    assert sorted((r["place"], r["html"]) for r in own.filter("place >= 3").collect()) == [(3, None), (4, "<p>4"), (9, "x")]
    assert sorted({r["query"] for r in df.filter("query IN ('a b', 'd/e') OR query = '7'").collect()}) == ["7", "a b", "d/e"]
    assert df.filter("place IS NULL").count() == 1 and df.filter("query <> 'c'").count() == 11 and df.count() == 17
    assert spark.read.format("recorded_pages").option("path", f"{tmp_path}/none").load().count() == 0
