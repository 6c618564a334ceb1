import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm.eliasfano import EliasFano, dump, encode, load, map_bytes, map_file, put_file


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, (1 << 64) - 1), max_size=300), st.sampled_from([1, 1000, 1 << 20, 1 << 64]))
def test_round_trip_and_search(values, universe):
    values = sorted({v % universe for v in values})
    sequence = EliasFano(load(map_bytes(dump(encode(np.array(values, np.uint64), "x")))), "x")
    assert sequence.access(np.arange(len(values))).tolist() == values
    asked = sorted({*values, *[v + 1 for v in values if v + 1 < 1 << 64], *[v - 1 for v in values if v], 0, 5, (1 << 64) - 1})
    want = [values.index(v) if v in values else -1 for v in asked]
    assert sequence.search(np.array(asked, np.uint64)).tolist() == want


def test_repeated_values_and_size():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 40, 20_000).astype(np.uint64))
    arrays = encode(values, "x")
    assert sum(a.nbytes for a in arrays.values()) < 20_000 * 4
    assert (EliasFano(arrays, "x").access(np.arange(len(values))) == values).all()


def test_files_are_replaced_whole(tmp_path):
    uri = f"file://{tmp_path}/a/b.ef"
    put_file(uri, dump({"x": np.arange(5)}), "0")
    put_file(uri, dump({"x": np.arange(6)}), "1")
    assert load(map_file(uri))["x"].tolist() == list(range(6))
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["b.ef"]
