import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from sensorloom.plans.pipeline import fuse, hqscore
from sensorloom.registry import HarmonizeError
from sensorloom.sources import ingest

START = datetime(2024, 1, 1)


def write(path, rows, header="timestamp,acc_x,acc_y,acc_z"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([header, *rows]) + "\n")
    return path.parent


def samples(n, step, start=START):
    return [f"{(start + timedelta(seconds=i * step)).isoformat()},{i},1.0,9.8" for i in range(n)]


def kind(f):
    with pytest.raises(HarmonizeError) as e:
        f()
    return e.value.kind


def test_empty_dataset(spark, tmp_path):
    root = write(tmp_path / "a.csv", [], "timestamp,acc_x")
    assert kind(lambda: ingest.read_slot(spark, str(root), "d1")) == "dataset_empty"


def test_unclosed_quote(spark, tmp_path):
    (tmp_path / "a.csv").write_text('timestamp,acc_x\n2024-01-01T00:00:00,"1.0\n')
    assert kind(lambda: ingest.read_slot(spark, str(tmp_path), "d1")) == "invalid_csv"


def test_no_files_and_too_many(spark, tmp_path):
    assert kind(lambda: ingest.find_files(str(tmp_path))) == "no_csv_files"
    for i in range(3):
        write(tmp_path / f"{i}.csv", samples(1, 1))
    assert kind(lambda: ingest.find_files(str(tmp_path), 2)) == "too_many_files"


def test_time_column(spark, tmp_path):
    root = write(tmp_path / "x" / "a.csv", ["1,2"], "acc_x,acc_y")
    assert kind(lambda: ingest.read_slot(spark, str(root), "d")) == "missing_timestamp_column"
    root = write(tmp_path / "y" / "a.csv", ["soon,2"], "timestamp,acc_y")
    assert kind(lambda: ingest.read_slot(spark, str(root), "d")) == "invalid_timestamp_format"


def test_row_limit(spark, tmp_path):
    root = write(tmp_path / "a.csv", samples(30, 1))
    assert kind(lambda: ingest.read_slot(spark, str(root), "d", max_rows=10, strict=True)) == "dataset_too_large"
    assert ingest.read_slot(spark, str(root), "d", max_rows=10).frame.count() == 10


def test_no_overlap(spark, tmp_path):
    a = write(tmp_path / "1" / "a.csv", samples(50, 0.1))
    b = write(tmp_path / "2" / "a.csv", samples(50, 0.1, START + timedelta(minutes=2)))
    slots = [ingest.read_slot(spark, str(r), n).frame for r, n in ((a, "d1"), (b, "d2"))]
    assert kind(lambda: fuse(slots)) == "no_time_overlap"
    assert kind(lambda: fuse(slots[:1])) == "invalid_dataset_count"


def test_single_modality(spark, tmp_path):
    frames = []
    for name, value in (("d1", 1.0), ("d2", 1.2)):
        rows = [f"{(START + timedelta(milliseconds=100 * i)).isoformat(timespec='milliseconds')},{value}" for i in range(120)]
        frames.append(ingest.read_slot(spark, str(write(tmp_path / name / "a.csv", rows, "timestamp,acc_x")), name).frame)
    out = fuse(frames)
    assert out.warnings == ["Limited modality available."]
    assert (out.missingness, out.coverage, out.master_rate) == (0.75, 0.25, 10.0)
    assert out.fused.count() == 120 and out.fused.select(F.avg("acc_x")).head()[0] == pytest.approx(1.1)


def test_participants_and_zip(spark, tmp_path):
    rows = samples(5, 1)
    write(tmp_path / "participant_01" / "acc.csv", rows)
    write(tmp_path / "src" / "acc.csv", rows)
    with zipfile.ZipFile(tmp_path / "more.zip", "w") as z:
        z.write(tmp_path / "src" / "acc.csv", "participant_02/acc.csv")
        z.writestr("../evil.csv", "timestamp,acc_x\n")
    (tmp_path / "src" / "acc.csv").unlink()
    slot = ingest.read_slot(spark, str(tmp_path), "d1")
    assert slot.participants == ["participant_01", "participant_02"] and slot.grouping == "folder_based"
    assert len(slot.warnings) == 1 and not (tmp_path.parent / "evil.csv").exists()
    assert slot.frame.count() == 10 and slot.modalities == ["accelerometer"]


def test_score():
    assert hqscore(1, 1, 1, 0, 1, 1) == pytest.approx(1)
    assert hqscore(0.55, 0.5, 0.5, 0.75, 0.25, 0.57, "limited_modality") == pytest.approx(0.4226, abs=1e-3)


def test_participants_are_spelled_one_way(spark, tmp_path):
    """A participant's key is kind_number, from the start of a path's part; tokens inside a part do not count."""
    files = lambda *names: [ingest.File(n, n, n) for n in names]
    owners = lambda *names: ({f.rel: p for f, p in ingest.group_files(files(*names))[0].items()}, ingest.group_files(files(*names))[1])
    assert owners("Participant-01/a.csv", "participant02/a.csv", "data/Subject 3_acc.csv") == ({"Participant-01/a.csv": "participant_01", "participant02/a.csv": "participant_02", "data/Subject 3_acc.csv": "subject_3"}, "folder_based")
    assert owners("x/p1_acc.csv", "x/p1_gyro.csv", "y/run_p7.csv") == (dict.fromkeys(("x/p1_acc.csv", "x/p1_gyro.csv", "y/run_p7.csv"), "participant_01"), "single_group")
    assert owners("ab12_acc.csv", "AB13-acc.csv", "other.csv") == ({"ab12_acc.csv": "ab12", "AB13-acc.csv": "ab13"}, "filename_prefix")
    slots = []
    for name, spelling in (("1", "participant-{:02d}"), ("2", "Participant{:02d}")):
        for k in (1, 2):
            write(tmp_path / name / spelling.format(k) / "a.csv", samples(60, 0.1))
        slots.append(ingest.read_slot(spark, str(tmp_path / name), "d" + name))
    assert slots[0].participants == slots[1].participants == ["participant_01", "participant_02"]
    assert {r.participant_id for r in fuse([s.frame for s in slots]).report.collect()} == {"participant_01", "participant_02"}


def test_archives_are_read_by_tasks(spark, tmp_path):
    """Members of several archives, also in folders and with odd names; those that would leave the archive are named."""
    root = tmp_path / "slot"
    (root / "deep").mkdir(parents=True)
    text = lambda x: "timestamp,acc_x\r\n" + "".join(f"2024-01-01T00:00:{i:02d},{x}\r\n" for i in range(20))
    with zipfile.ZipFile(root / "one.ZIP", "w") as z:
        for name in ("p1/a b.csv", "p2/A.CSV", "/p3/abs.csv", "../../out.csv", "p1/../../out.csv", "p1/notes.txt"):
            z.writestr(name, text(1.0))
        z.writestr("folder/", "")
    with zipfile.ZipFile(root / "deep" / "two.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("p1_more.csv", text(2.0).replace(":00:", ":01:"))
    (root / "broken.zip").write_bytes(b"no archive")
    before = sorted(p for p in tmp_path.rglob("*"))
    slot = ingest.read_slot(spark, str(root), "d")
    assert slot.participants == ["p_1", "p_2", "p_3"] and slot.grouping == "folder_based"
    assert sorted(w.split(":")[0] for w in slot.warnings) == ["skipped ../../out.csv of one.ZIP", "skipped broken.zip", "skipped p1/../../out.csv of one.ZIP"]
    got = {r.participant_id: (r.n, r.files) for r in slot.frame.groupBy("participant_id").agg(F.count("acc_x").alias("n"), F.array_sort(F.collect_set("source_file")).alias("files")).collect()}
    assert got == {"p_1": (40, ["deep/two.zip/p1_more.csv", "one.ZIP/p1/a b.csv"]), "p_2": (20, ["one.ZIP/p2/A.CSV"]), "p_3": (20, ["one.ZIP/p3/abs.csv"])}
    assert sorted(p for p in tmp_path.rglob("*")) == before  # nothing is unpacked beside the archives
    assert kind(lambda: ingest.find_files(str(root), 3)) == "too_many_files"
    assert kind(lambda: ingest.find_files(str(tmp_path / "none"))) == "no_csv_files"


def test_one_scan_for_files_of_one_header(spark, tmp_path):
    """Files of two headers, each with its own time column, gaps, warnings and thinning; equal times merge by file order."""
    write(tmp_path / "a.csv", [f"2024-01-01T00:00:{i:02d},,{i},x" for i in range(40)], "timestamp,time,acc_x,note")
    write(tmp_path / "b.csv", [f",2024-01-01T00:00:{i:02d},{100 + i},y" for i in range(30)], "timestamp,time,acc_x,note")
    write(tmp_path / "c.csv", [f"2024-01-01T00:00:{i:02d},{i},"  for i in range(10)], "time,hr,acc_x")
    slot = ingest.read_slot(spark, str(tmp_path), "d", max_rows=20)
    rows = {r.s: r for r in slot.frame.withColumn("s", F.second("ts")).collect()}
    assert [rows[k].acc_x for k in (0, 2, 38)] == [0.0, 2.0, 38.0] and rows[1].acc_x is None and rows[1].heart_rate == 1.0
    assert (rows[0].source_file, rows[1].source_file, rows[0].heart_rate) == ("a.csv", "c.csv", 0.0) and 39 not in rows
    assert sorted(w for w in slot.warnings) == ["a.csv: 40 rows, thinned to at most 20", "b.csv: 30 rows, thinned to at most 20", "c.csv: acc_x has no number and is left out"]


def test_tables_of_known_formats(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a,b\n1,x\n2,\n")
    assert [tuple(r) for r in ingest.read_table(spark, str(tmp_path / "t.txt")).orderBy("a").collect()] == [("1", "x"), ("2", None)]
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    assert ingest.read_table(spark, str(tmp_path / "t.parquet")).count() == 3
    with pytest.raises(ValueError, match="no reader"):
        ingest.read_table(spark, "x.xlsx")


def test_names_with_spaces_and_signs(spark, tmp_path):
    """Names that look otherwise in an address than in a folder."""
    for name in ("p1 left+right.csv", "p2 50%.csv", "p3 \u00e9.csv"):
        write(tmp_path / "my data" / name, samples(5, 1))
    slot = ingest.read_slot(spark, str(tmp_path / "my data"), "d")
    assert slot.participants == ["p_1", "p_2", "p_3"] and slot.frame.count() == 15 and slot.frame.where("source_file is null").count() == 0
