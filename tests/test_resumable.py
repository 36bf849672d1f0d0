"""Lines that come once each: whatever partitions cut, whichever read fails, and however often a stream is restarted."""

import json
import random

import pytest
from pyarrow import fs

from sparkloom.sources import resumable


class Flaky:
    """A file system whose reads fail now and then."""

    def __init__(self, rng, rate):
        self.system, self.rng, self.rate, self.failed = fs.LocalFileSystem(), rng, rate, 0

    def open_input_file(self, path):
        file, outer = self.system.open_input_file(path), self

        class File:
            def read_at(self, n, at):
                if outer.rng.random() < outer.rate:
                    outer.failed += 1
                    raise OSError("connection lost")
                return file.read_at(n, at)[: outer.rng.randrange(1, n + 1)]  # short reads

            def close(self):
                file.close()

        return File()


def reader(path, rng, rate, **options):
    out = resumable.LinesReader({"path": str(path), "pause": "0", **options})
    system = Flaky(rng, rate)
    out.opened = lambda p: resumable.ResumedFile(system, p, 0, out.retries, 0)
    return out, system


def test_each_line_comes_once_though_reads_fail(tmp_path, monkeypatch):
    rng, failures = random.Random(4), 0
    for _ in range(200):
        monkeypatch.setattr(resumable, "STEP", rng.choice([1, 3, 17, 4096]))
        lines = [rng.choice(["", "", "x", "long " * 9, "ä漢\r"]) for _ in range(rng.randrange(0, 20))]
        tail = rng.choice(["", "no break"])
        (tmp_path / "a").write_bytes(("".join(x + "\n" for x in lines) + tail).encode())
        source, system = reader(tmp_path / "a", rng, 0.2, partitionBytes=str(rng.choice([1, 5, 40, 10**6])), retries="40")
        got = [(r["at"], r["value"]) for p in source.partitions() for b in source.read(p) for r in b.to_pylist()]
        assert [v for _, v in got] == [x.removesuffix("\r") for x in lines] + [tail] * bool(tail)
        assert len({a for a, _ in got}) == len(got)
        failures += system.failed
    assert failures > 100


def test_a_source_that_goes_on_failing_is_an_error(tmp_path):
    (tmp_path / "a").write_text("one\ntwo\n")
    source, system = reader(tmp_path / "a", random.Random(1), 1.1)
    with pytest.raises(OSError, match="connection lost"):
        list(source.read(source.partitions()[0]))
    assert system.failed == resumable.RETRIES + 1


def run(spark, folder, out, mark, fail_at=None):
    """Takes in all that is there; fails behind the write of a batch, before its commit, if told so."""

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == fail_at:
            raise RuntimeError("executor lost")

    stream = resumable.read_json_lines_stream(spark, f"{folder}/*.jsonl", partitionBytes=50)
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(mark)).trigger(availableNow=True).start()
    query.awaitTermination(120)


def line(i):
    return json.dumps({"text": f"row {i}", "source": "s"}) + "\n"


def test_a_stream_goes_on_after_failures(spark, tmp_path):
    folder, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n" + line(0) + json.dumps({"text": ""}) + "\n{bad\n" + line(1) + line(2) + line(3)[:9])
    run(spark, folder, out, mark)
    with (folder / "a.jsonl").open("a") as file:
        file.write(line(3)[9:] + line(4))
    (folder / "b.jsonl").write_text("\n\n" + line(5) + line(6))
    (folder / "_c.jsonl").write_text(line(99))
    with pytest.raises(Exception, match="executor lost"):
        run(spark, folder, out, mark, fail_at=1)
    with (folder / "b.jsonl").open("a") as file:
        file.write(line(7))
    run(spark, folder, out, mark)
    run(spark, folder, out, mark)
    rows = spark.read.parquet(str(out)).collect()
    assert sorted(r.text for r in rows) == [f"row {i}" for i in range(8)]
    assert len({(r.file, r["at"]) for r in rows}) == 8 and {r.kind for r in rows} == {"prose"}


def test_a_file_that_was_cut_is_an_error(tmp_path):
    (tmp_path / "a").write_text("one\ntwo\n")
    source = resumable.LinesStreamReader({"path": str(tmp_path)})
    assert list(source.latestOffset()["files"].values()) == [8]
    (tmp_path / "a").write_text("one\n")
    with pytest.raises(OSError, match="were read"):
        source.latestOffset()


def test_batches_and_empty_folders(spark, tmp_path):
    spark.dataSource.register(resumable.ResumableLines)
    load = lambda: spark.read.format("resumable_lines").option("partitionBytes", "7").load(str(tmp_path))
    assert load().count() == 0
    (tmp_path / "a").write_text("one\n\ntwo two two\nthree")
    assert sorted((r["at"], r.value) for r in load().collect()) == [(0, "one"), (4, ""), (5, "two two two"), (17, "three")]
