import os

import pytest

from riskweave.sources.tail import TailReader, tail
from riskweave.streaming import logs


def lines(reader, start, end):
    return sorted(v for p in reader.partitions(start, end) for _, _, v in reader.read(p))


@pytest.mark.parametrize("part", [1, 3, 7, 1 << 20])
def test_every_line_is_read_once_whatever_the_parts(tmp_path, part):
    text = "a\n\nlong line\r\nü\n" * 5
    (tmp_path / "x.log").write_text(text + "unfinished")
    reader = TailReader(str(tmp_path / "*.log"), True, part)
    got = [(at, v) for p in reader.partitions({}, reader.latestOffset()) for _, at, v in reader.read(p)]
    assert [v for _, v in sorted(got)] == text.split("\n")[:-1] and len({at for at, _ in got}) == len(got)


def test_rotation_and_truncation(tmp_path):
    log, other = tmp_path / "a.log", tmp_path / "b.log"
    log.write_text("1\n2\n3")
    reader = TailReader(str(tmp_path / "*.log"), False, 1 << 20)
    first = reader.initialOffset()
    assert lines(reader, first, first) == []
    with log.open("a") as f:
        f.write("x\n4\n")
    other.write_text("new\n")
    second = reader.latestOffset()
    assert lines(reader, first, second) == ["3x", "4", "new"]
    with log.open("a") as f:
        f.write("5\n")
    os.rename(log, tmp_path / "a.log.1")  # out of the pattern, with a line that nobody read
    log.write_text("6\n")
    os.rename(other, tmp_path / "c.log")  # within it
    third = reader.latestOffset()
    assert lines(reader, second, third) == ["5", "6"] and lines(reader, first, second) == ["3x", "4", "new"]
    log.write_text("7\n8\n9\n")  # written anew, longer than it was
    fourth = reader.latestOffset()
    assert lines(reader, third, fourth) == ["7", "8", "9"]
    log.write_text("")
    fifth = reader.latestOffset()
    assert lines(reader, fourth, fifth) == []
    with pytest.raises(OSError, match="gone"):
        lines(reader, third, fourth)
    log.write_text("\n")
    assert lines(reader, fifth, reader.latestOffset()) == [""]


def test_long_lines_and_odd_bytes(tmp_path):
    (tmp_path / "a.log").write_bytes(b"y" * 200_000 + b"\n\xff\n" + b"z" * 100_000)
    reader = TailReader(str(tmp_path / "*.log"), True, 50_000)
    assert lines(reader, {}, reader.latestOffset()) == ["y" * 200_000, "�"]
    assert TailReader(str(tmp_path / "none*"), True, 10).latestOffset() == {}


def test_stream_goes_on_after_a_stop(spark, tmp_path):
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    event = '{"ts":"2024-01-01T00:00:00Z","ip":"%d","path":"/","status":500}\n'
    (folder / "a.log").write_text(event % 1)

    def run():
        alerts = logs.stateless_alerts(logs.parsed_log(tail(spark, str(folder / "*.log"), "earliest")).drop("malformed"))
        query = alerts.writeStream.foreachBatch(logs.new_alerts_sink(str(out))).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            query.processAllAvailable()
            return query
        except Exception:
            query.stop()
            raise

    query = run()
    query.stop()
    with (folder / "a.log").open("a") as f:
        f.write(event % 2)
    os.rename(folder / "a.log", folder / "a.old")
    (folder / "a.log").write_text(event % 3 + event % 1)
    query = run()
    try:
        assert sorted(r["ip"] for r in spark.read.parquet(str(out)).collect()) == ["1", "2", "3"]
    finally:
        query.stop()
