from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.sources import fax


def test_codes_are_prefix_free():
    for table in (*fax.RUNS, fax.MODES):
        codes = sorted(table)
        assert not any(b.startswith(a) for a, b in zip(codes, codes[1:]))
        assert sum(Fraction(1, 2 ** len(c)) for c in codes) < 1
    assert all(set(t.values()) == {*range(64), *range(64, 2561, 64)} for t in fax.RUNS)


@given(st.integers(1, 90), st.lists(st.lists(st.tuples(st.booleans(), st.integers(1, 40)), max_size=8), max_size=6), st.booleans())
@settings(deadline=None)
def test_round_trip(columns, rows, align):
    data = b""
    for runs in rows:
        bits = "".join("01"[c] * n for c, n in runs)[:columns].ljust(columns, "0")
        data += int(bits.ljust(-(-columns // 8) * 8, "0"), 2).to_bytes(-(-columns // 8), "big")
    assert fax.decode(fax.encode(data, columns, align), columns, align) == data


def test_long_runs():
    data = bytes(700) + b"\xff" * 700 + b"\x0f" * 700
    assert fax.decode(fax.encode(data, 5600), 5600) == data
