import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeloom.llm.cutting import cut, line_starts
from codeloom.llm.splitting import oversized_items, split_oversized


def check(data, pieces, limit, first=0, last=None):
    last = len(data) if last is None else last
    assert pieces[0][0] == first and pieces[-1][1] == last
    for s, e in pieces:
        assert 0 < e - s <= limit
        data[s:e].decode("utf-8")  # no character is cut
    for (s, e), (s2, e2) in zip(pieces, pieces[1:]):
        assert s < s2 <= e < e2
    assert data[pieces[0][0] : pieces[0][1]] + b"".join(data[a[1] : b[1]] for a, b in zip(pieces, pieces[1:])) == data[first:last]


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab é漢\t😀", max_size=120), min_size=1, max_size=80), st.integers(40, 400), st.integers(0, 15))
def test_round_trip(lines, limit, overlap):
    data = "\n".join(lines).encode()
    if not data:
        return
    pieces = cut(data, line_starts(data), [(3, 9), (4, 5), (20, 30)], limit, overlap)
    check(data, pieces, limit)
    assert (len(pieces) == 1) == (len(data) <= limit)


def test_cuts_fall_on_symbols():
    text = "".join(f"def f{i}():\n" + "    x = 1\n" * 8 + "\n" for i in range(100))
    data = text.encode()
    spans = [(1 + 10 * i, 9 + 10 * i) for i in range(100)]
    pieces = cut(data, line_starts(data), spans, 1000, 100)
    check(data, pieces, 1000)
    bounds = {int(line_starts(data)[a - 1]) for a, _ in spans} | {int(line_starts(data)[z]) for _, z in spans}
    assert all(e in bounds for _, e in pieces[:-1])
    assert all(50 <= a[1] - b[0] <= 200 and data[b[0] - 1 : b[0]] == b"\n" for a, b in zip(pieces, pieces[1:]))


def test_one_long_line_and_no_ascii():
    for text in ("x" * 20_000, "漢" * 7_000, "wort " * 4000, "😀" * 5000):
        data = text.encode()
        pieces = cut(data, line_starts(data), [], 6000, 300)
        check(data, pieces, 6000)
        assert all(296 <= a[1] - b[0] <= 304 for a, b in zip(pieces, pieces[1:]))


def test_tables(spark):
    rng = random.Random(1)
    big = "\r\n".join("word " * rng.randrange(1, 20) for _ in range(400))
    exact = "a" * 6000
    contents = spark.createDataFrame([(1, big, 5), (2, exact, 5), (3, exact + "é", 5), (4, None, 5), (5, "", 5)], "file_id long, content string, id int")
    n = big.count("\n") + 1
    symbols = spark.createDataFrame(
        [(10, 1, 1, n, "active"), (11, 1, 1, n, "deleted"), (12, 1, 5, 6, "active"), (13, 1, None, 6, "active"), (14, 1, 9, 3, "active"), (15, 1, n + 5, n + 9, "active"), (16, None, 1, 2, "active"), (17, 2, 1, 1, "active"), (18, 3, 1, 99, "active"), (19, 1, 2, 9999, " ACTIVE")],
        "id long, file_id long, start_line int, end_line int, status string",
    )
    assert sorted(map(tuple, oversized_items(contents, symbols).collect())) == [("file", 1), ("file", 3), ("symbol", 10), ("symbol", 18), ("symbol", 19)]
    rows = split_oversized(contents, symbols).where("item_kind = 'file' and item_id = 1").orderBy("piece_no").collect()
    assert all(len(r["piece"].encode()) <= 6000 for r in rows) and rows[0]["n_pieces"] == len(rows)
    data = big.encode()
    check(data, [(r["start_byte"], r["end_byte"]) for r in rows], 6000)
    assert all(data[r["start_byte"] : r["end_byte"]].decode() == r["piece"] for r in rows)
    assert split_oversized(contents.limit(0), symbols).collect() == []
    with pytest.raises(ValueError):
        split_oversized(contents, symbols, 500, 300)


def test_size_counts_without_the_last_line_end(spark):
    for end, over in (("\n", False), ("\r\n", False), ("x\n", True)):
        text = "a" * 6000 + end + "tail line here"
        contents = spark.createDataFrame([(1, text)], "file_id long, content string")
        symbols = spark.createDataFrame([(7, 1, 1, 1, "active")], "id long, file_id long, start_line int, end_line int, status string")
        assert (("symbol", 7) in set(map(tuple, oversized_items(contents, symbols).collect()))) == over
