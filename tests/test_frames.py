"""Lines out of frames: whatever the cuts between frames and partitions, each line comes once."""

import json
import random

import pytest

zstandard = pytest.importorskip("zstandard")

from sparkloom.sources import frames, readers


def written(path, data, cuts, rng):
    """``data`` as frames that end at ``cuts``, with checksums, sizes and frames to skip here and there."""
    begin, out = 0, b""
    for end in [*cuts, len(data)]:
        coder = zstandard.ZstdCompressor(level=3, write_checksum=rng.random() < 0.5, write_content_size=rng.random() < 0.5)
        out += coder.compress(data[begin:end])
        if rng.random() < 0.2:
            out += (frames.SKIP_MAGIC + rng.randrange(16)).to_bytes(4, "little") + (5).to_bytes(4, "little") + b"skip!"
        begin = end
    path.write_bytes(out)
    return out


def values(spark, path, partition_bytes):
    spark.dataSource.register(frames.ZstdLines)
    df = spark.read.format("zstd_lines").option("partitionBytes", str(partition_bytes)).load(str(path))
    return df.rdd.getNumPartitions(), sorted(r.value for r in df.collect())


def test_each_line_comes_once_however_frames_cut(tmp_path):
    rng = random.Random(2)
    for _ in range(150):
        lines = ["x" * rng.choice([0, 1, 3, 40]) + str(i) for i in range(rng.randrange(0, 15))]
        data = "".join(line + "\n" for line in lines).encode() + rng.choice([b"", b"cut off"])
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(rng.randrange(0, 8)))
        cuts += [i + 1 for i, b in enumerate(data) if b == 10 and rng.random() < 0.3]  # some frames end with their lines
        raw = written(tmp_path / "a.zst", data, sorted(cuts), rng)
        reader = frames.ZstdLinesReader({"path": str(tmp_path / "a.zst"), "partitionBytes": str(rng.choice([1, 40, 10**9]))})
        parts = reader.partitions()
        assert sum(p.end - p.begin for p in parts) == len(raw)
        got = [v for p in parts for b in reader.read(p) for v in b.column(2).to_pylist()]
        assert got == lines


def test_64_frames_are_64_partitions(spark, tmp_path):
    rng = random.Random(3)
    rows = [{"text": f"text {i} é", "source": "s", **({"kind": "code"} if i % 3 == 0 else {})} for i in range(640)]
    data = "".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows).encode()
    cuts = [m for m in range(len(data) // 64, len(data) - 64, len(data) // 64)][:63]
    (tmp_path / "in").mkdir()
    written(tmp_path / "in" / "a.jsonl.zst", data, cuts, rng)
    n, got = values(spark, tmp_path / "in", 1)
    assert n == 64 and got == sorted(data.decode().splitlines())
    assert values(spark, f"{tmp_path}/in/*.zst", 1 << 30) == (1, got)
    (tmp_path / "none").mkdir()
    assert values(spark, tmp_path / "none", 1)[1] == []
    new = sorted(map(tuple, frames.read_json_lines_zstd(spark, f"{tmp_path}/in", 1).collect()))
    assert new == sorted(map(tuple, readers.read_json_lines_zstd(spark, f"{tmp_path}/in/a.jsonl.zst").collect())) and len(new) == 640


def test_streamed_frames_and_damaged_files(tmp_path):
    """Frames of unknown size of many blocks, as a stream writer makes them; a cut file is an error."""
    rng = random.Random(5)
    data = "".join(f"{rng.random()} {'word ' * rng.randrange(30)}\n" for _ in range(20_000)).encode()
    with open(tmp_path / "s.zst", "wb") as f, zstandard.ZstdCompressor(level=1).stream_writer(f) as out:
        for at in range(0, len(data), 70_000):
            out.write(data[at : at + 70_000])
            if at % 210_000 == 0:
                out.flush(zstandard.FLUSH_FRAME)
    reader = frames.ZstdLinesReader({"path": str(tmp_path / "s.zst"), "partitionBytes": "1"})
    parts = reader.partitions()
    assert len(parts) > 3 and [v for p in parts for b in reader.read(p) for v in b.column(2).to_pylist()] == data.decode().splitlines()
    raw = (tmp_path / "s.zst").read_bytes()
    for bad in (raw[:-20], raw[: parts[1].end + 3], b"no frame at all"):
        (tmp_path / "bad.zst").write_bytes(bad)
        with pytest.raises(ValueError, match="cut off|no frame"):
            frames.ZstdLinesReader({"path": str(tmp_path / "bad.zst")}).partitions()
