import math

import pytest

from atomweave.sources import msgpack

VALUES = [None, True, False, 0, 127, 128, 255, 256, 70_000, 2**40, 2**63, -1, -32, -33, -129, -40_000, -(2**40), 0.5, -math.pi, "", "é" * 40, "x" * 70_000, [], list(range(40)), {"a": [1, {"b": None}], "c": "d"}, {str(i): i for i in range(20)}]


@pytest.mark.parametrize("value", VALUES, ids=lambda v: str(v)[:20])
def test_round_trip(value):
    data = msgpack.encode(value)
    assert msgpack.decode(data) == (value, len(data))


def test_stream_and_order():
    data = msgpack.encode({"b": 1, "a": 2}, sort_keys=True) + msgpack.encode([1])
    assert list(msgpack.messages(data)) == [{"a": 2, "b": 1}, [1]] and data[1:3] == b"\xa1a"
    assert msgpack.decode(b"\xc4\x02\x01\xff")[0] == "01ff"
    with pytest.raises(ValueError):
        msgpack.decode(b"\xa5ab")


def test_files(spark, tmp_path):
    whole = msgpack.encode({"atoms": [{"id": 1}, {"id": 2}], "n": 2}) + msgpack.encode({"other": 1})
    (tmp_path / "a.msgpack").write_bytes(whole + msgpack.encode({"atoms": [{"id": 3}]})[:-1])
    items = msgpack.read_messages(spark, str(tmp_path), "atoms").orderBy("item").collect()
    assert [(r.message, r.item, r.json) for r in items] == [(0, 0, '{"id": 1}'), (0, 1, '{"id": 2}')]
    assert msgpack.read_messages(spark, str(tmp_path)).count() == 2
    rows = msgpack.to_messages(spark.createDataFrame([(1, "x", [1.5])], "id int, name string, v array<double>")).collect()
    assert msgpack.decode(bytes(rows[0].message))[0] == {"id": 1, "name": "x", "v": [1.5]}
