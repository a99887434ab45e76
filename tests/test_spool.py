"""Spools, files that are committed, settings over time, repeats: against plain Python."""

import json
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.functions import folds, rules
from pagemill.operators import settings, shelf, transcripts
from pagemill.sinks import files, notes
from pagemill.sources import records, spool
from pagemill.streaming import queue as streams

JOB = {"channel": "c", "thread_ts": "t", "target": "x", "source_label": "l"}


def put(folder, name, body):
    (folder / f".{name}").write_text(body)
    (folder / f".{name}").rename(folder / name)


# --- spools --------------------------------------------------------------------------------------


def test_spool_stream_goes_on_after_a_restart(spark, tmp_path):
    where, folder = f"file://{tmp_path}/spool", tmp_path / "spool"
    folder.mkdir()
    for i in range(5):
        put(folder, f"{i:03}.json", json.dumps(JOB | {"id": f"{i:03}", "attempts": i}))
    put(folder, "002.pages", "{}")
    put(folder, "0025.json", "{")
    first = streams.finished(spool.spool_stream(spark, where), "append", str(tmp_path))
    assert first.count() == 6
    assert streams.finished(spool.spool_stream(spark, where), "append", str(tmp_path)).count() == 6  # nothing new
    put(folder, "900.json", json.dumps(JOB | {"id": "900"}))
    put(folder, "901.json", json.dumps([1]))
    put(folder, "902.json", json.dumps(JOB | {"id": "902", "odd": 1}))
    put(folder, "903.json", json.dumps({"id": "903"}))
    got = {r.name: r for r in streams.finished(spool.spool_stream(spark, where), "append", str(tmp_path)).collect()}
    assert len(got) == 10 and sorted(n for n, r in got.items() if r.error) == ["0025.json", "901.json", "902.json", "903.json"]
    assert [got[f"{i:03}.json"].attempts for i in range(5)] == list(range(5)) and got["900.json"].attempts == 0 and "odd" in got["902.json"].error and got["903.json"].error.endswith("no channel")
    assert {tuple(r) for r in spool.spool_table(spark, where).collect()} == {tuple(r) for r in got.values()}


def test_spool_of_an_empty_folder(spark, tmp_path):
    assert spool.spool_table(spark, f"file://{tmp_path}/none").collect() == []
    assert streams.finished(spool.spool_stream(spark, f"file://{tmp_path}/none"), "append").collect() == []


def test_spool_triggers_of_a_few_records(tmp_path):
    """Offsets by name: each trigger takes the next few, and a reader that starts anew gives the same parts for the same offsets."""
    for i in range(7):
        put(tmp_path, f"{i}.json", "{}")
    options = {"path": f"file://{tmp_path}", "per_trigger": "3"}
    reader, at, seen = spool._SpoolStream(options), {"last": ""}, []
    for _ in range(4):
        end = reader.latestOffset()
        parts = [n for p in spool._SpoolStream(options).partitions(at, end) for n in p.value]
        assert parts == [n for p in reader.partitions(at, end) for n in p.value]
        seen, at = seen + [parts], end
    assert seen == [["0.json", "1.json", "2.json"], ["3.json", "4.json", "5.json"], ["6.json"], []]


def test_jobs_are_written_whole_and_completed(spark, tmp_path):
    path = f"file://{tmp_path}/spool"
    jobs = spark.createDataFrame([(f"{i:02}", f"file://{tmp_path}/a{i}" if i % 2 else None) for i in range(20)], "id string, attachment string")
    assert {r.outcome for r in records.write_jobs(jobs, path).collect()} == {"created"}
    assert {r.outcome for r in records.write_jobs(jobs, path).collect()} == {"same"}
    assert {r.outcome for r in records.write_jobs(jobs.withColumn("more", F.lit(1)), path).collect()} == {"replaced"}
    (tmp_path / "a1").write_text("upload")
    (tmp_path / "spool" / "03.pages").write_text("{}")
    got = {(r.id, r.file.rsplit("/", 1)[1]): r.outcome for r in records.completed(jobs.where("id < 10"), path).collect()}
    assert got["01", "a1"] == "removed" and got["03", "03.pages"] == "removed" and got["05", "05.json"] == "removed" and got["03", "a3"] == "gone" and len(got) == 25
    assert {r.outcome for r in records.completed(jobs.where("id < 10"), path).collect()} == {"gone"}
    assert len(list((tmp_path / "spool").iterdir())) == 10


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 35, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="no"):
        files.write_files(rows, f"file://{tmp_path}/out")
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []
    assert files.write_files(rows.where("name <> 'f35'"), f"file://{tmp_path}/out").count() == 39 == len(list((tmp_path / "out").iterdir()))


def test_a_move_that_is_repeated(spark, tmp_path):
    (tmp_path / "part").write_text("x")
    batch = pa.RecordBatch.from_pydict({"name": ["a", "b"], "part": [f"{tmp_path}/part", None], "outcome": ["created", "kept"]}, pa.schema([("name", pa.string()), ("part", pa.string()), ("outcome", pa.string())]))
    for _ in range(2):  # a task's second attempt finds what the first has moved
        assert [b.to_pydict() for b in files._moves(f"file://{tmp_path}")([batch])] == [{"name": ["a", "b"], "outcome": ["created", "kept"]}]
    assert (tmp_path / "a").read_text() == "x" and not (tmp_path / "part").exists()
    with pytest.raises(OSError):
        list(files._moves(f"file://{tmp_path}")([batch.set_column(0, "name", pa.array(["c", "b"]))]))


def test_notes_of_one_name(spark, tmp_path):
    rows = spark.range(30).select(F.lit("Untitled note").alias("title"), F.format_string("%02d", "id").alias("markdown"))
    notes.write_markdown(rows, f"file://{tmp_path}/n")
    found = {f.name: f.read_text() for f in (tmp_path / "n").iterdir()}
    assert found == {"Untitled note.md": "00"} | {f"Untitled note {i + 1}.md": f"{i:02}" for i in range(1, 30)}


# --- settings ------------------------------------------------------------------------------------

COMMAND = "ts int, seq long, user string, key string, value string"


def commands(n, seed):
    rng = random.Random(seed)
    return [(rng.randrange(40), i, rng.choice(["u", "v", None]), rng.choice([*rules.ALLOWED_KEYS[:2], "model"]), rng.choice(["a", "b", "c", "", None])) for i in range(n)]


def plain_history(rows):
    out, places = set(), {}
    for ts, seq, user, key, value in sorted(rows, key=lambda r: r[:2]):
        if key in rules.ALLOWED_KEYS:
            places.setdefault((user, key), []).append((ts, value or ""))
    for (user, key), said in places.items():
        for i, (ts, value) in enumerate(said):
            until = said[i + 1][0] if i + 1 < len(said) else None
            if until != ts:
                out.add((user, key, value or None, ts, until))
    return out


def timed(spark, rows):
    return spark.createDataFrame(rows, COMMAND).withColumn("ts", F.timestamp_seconds("ts"))


def seconds(history):
    at = lambda c: F.unix_timestamp(c).cast("int").alias(c)
    return [tuple(r) for r in history.select("user", "key", "value", at("valid_from"), at("valid_to")).collect()]


def test_history_and_late_commands(spark):
    rows = commands(120, 1)
    got = seconds(settings.intervals(timed(spark, rows)))
    assert set(got) == plain_history(rows) and len(got) == len(set(got))
    late = [(ts, 1000 + i, user, key, value) for i, (ts, _, user, key, value) in enumerate(commands(25, 2)) if user != "v"]
    both = seconds(settings.merged(settings.intervals(timed(spark, rows)), timed(spark, late)))
    assert set(both) == plain_history(rows + late) and len(both) == len(set(both))


def test_settings_at_a_time(spark):
    rows = commands(60, 3)
    asks = [(user, t, 9) for t in (0, 7, 20, 39, 99) for user in ("u", "v", "w", None)] + [("u", 7, 9)]
    df = spark.createDataFrame(asks, "user string, at int, settings_no int").withColumn("at", F.timestamp_seconds("at"))
    got = sorted(((r.user, r.t, r.settings) for r in settings.settings_at(df, settings.intervals(timed(spark, rows))).withColumn("t", F.unix_timestamp("at")).collect()), key=str)
    want = []
    for user, t, _ in asks:
        held = {}
        for who in (None, user):
            held |= {k: value for u, k, value, start, end in plain_history(rows) if u == who and value and start <= t and (end is None or end > t)}
        want.append((user, t, held))
    assert got == sorted(want, key=str)


def test_sections(spark):
    rows = spark.createDataFrame([("u", '{"tts_voice": "a", "model": "x", "cover_style": null}'), (None, '{"note_format": "md"}'), ("v", "not json"), ("w", "[1]")], "user string, body string")
    found = settings.layers(rows)
    assert {tuple(r) for r in found.collect()} == {("u", "tts_voice", "a"), (None, "note_format", "md")}
    assert {r.user: json.loads(r.body) for r in settings.sections(found).collect()} == {"u": {"tts_voice": "a"}, None: {"note_format": "md"}}


# --- repeats and voices --------------------------------------------------------------------------


def plain_collapse(text):
    lines, n = text.split("\n"), rules.REPEAT_WINDOW
    flat = [" ".join(x.split()) for x in lines]
    full, begins, at = [i for i, x in enumerate(flat) if x], {}, 0
    for i in full:
        begins[i] = at
        at += len(flat[i]) + 1
    joined = " ".join(flat[i] for i in full)
    for i in full:
        probe = joined[begins[i] : begins[i] + n]
        again = joined.find(probe, begins[i] + 1) if len(probe) == n and len(joined) >= 2 * n else -1
        place = max((k for k in full if begins[k] <= again and k > i), default=None)
        if place is not None:
            return "\n".join(lines[: place - (place > 0 and 0 < len(flat[place - 1]) <= rules.HEADER_CHARS)]).rstrip(), True
    return text, False


def test_repetition_against_the_plain_search(monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(rules, "REPEAT_WINDOW", 9)
    cut = 0
    for _ in range(1500):
        text = "".join(rng.choice("aab \n") for _ in range(rng.randrange(90)))
        got = folds.collapse_repetition(text)
        assert got == plain_collapse(text)
        cut += got[1]
    assert cut > 40
    monkeypatch.setattr(rules, "REPEAT_WINDOW", 160)
    page = "\n".join("".join(rng.choice("abcdefgh ") for _ in range(70)) for _ in range(30))
    assert folds.collapse_repetition(f"{page}\nHeader\n{page}\nHeader") == plain_collapse(f"{page}\nHeader\n{page}\nHeader") == (page, True)
    assert folds.collapse_repetition(None) == ("", False)


def test_repetition_of_long_texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    text = "\n".join(" ".join(rng.choice(words) for _ in range(10)) for _ in range(60_000))  # 4 MB without a repeat
    began = time.time()
    assert folds.collapse_repetition(text) == (text, False)
    assert folds.collapse_repetition("a" * 2_000_000)[1] is False
    assert time.time() - began < 30


def test_places_of_repeats(spark):
    rows = [(1, "k", n, 30) for n in range(30)] + [(1, "once", 31, 1), (2, "k", 5, 2), (2, "k", 3, 2)]
    got = {(r.conv, r.k): (r.times, r.places) for r in transcripts.repeat_places(spark.createDataFrame(rows, "conv int, k string, n int, times long"), "conv", 4).collect()}
    assert got == {(1, "k"): (30, [0, 1, 2, 3]), (2, "k"): (2, [3, 5])}


def test_voices(spark):
    rows = spark.createDataFrame([(v,) for v in ("bm_x", "af_v0a", "af_b", "odd", "af_a", "zf_x")], "voice string")
    assert [tuple(r) for r in shelf.grouped_voices(rows).orderBy("group_rank", "group", "place").collect()] == [
        (1, "American English, female", 0, "af_a"), (1, "American English, female", 1, "af_b"), (1, "American English, female", 2, "af_v0a"), (2, "British English, male", 0, "bm_x"), (9, "Chinese, female", 0, "zf_x"), (10, "other", 0, "odd")]
    assert [r.voice for r in shelf.near_voices(rows, "F_").collect()] == ["af_a", "af_b", "af_v0a"] and shelf.kept_voices(rows).count() == 4
