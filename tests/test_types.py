from itertools import product

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tabloom.functions.infer import infer_python
from tabloom.options import FALSES, NULLS, TRUES, CsvOptions, FwfOptions, tokens
from tabloom.types import DataType as D
from tabloom.types import can_promote, parse_type, wider

HOW = (tokens(NULLS), tokens(TRUES), tokens(FALSES))


@pytest.mark.parametrize(
    "text, kind",
    [
        ("", D.NA), ("NA", D.NA), ("null", D.NA), ("true", D.BOOL), ("F", D.BOOL), ("Yes", D.BOOL), ("0", D.INT32), ("-17", D.INT32), ("2147483647", D.INT32), ("2147483648", D.INT64),
        ("-2147483648", D.INT64), ("+2147483647", D.INT64), ("123456789012345678901234", D.INT64), ("1.5", D.FLOAT64), (".5", D.FLOAT64), ("5.", D.FLOAT64), ("1e3", D.FLOAT64), ("nan", D.FLOAT64),
        ("+-5", D.FLOAT64), ("-inf", D.FLOAT64), ("1d", D.STRING), ("2024-01-02", D.DATE), ("2024/13/45", D.DATE), ("2024-01/02", D.STRING), ("2024-01-02T10:11", D.TIMESTAMP), ("2024-01-02 101112", D.TIMESTAMP),
        ("2024-01-02T", D.STRING), ("9:05", D.TIME), ("14:30:00", D.TIME), ("11:02:03.5 PM", D.TIME), ("13:00 PM", D.STRING), ("25:00", D.STRING), ("hello", D.STRING), (" 1", D.STRING),
    ],
)
def test_inference(text, kind):
    assert infer_python(text, *HOW) == kind


def test_integers_as_floats():
    assert infer_python("12", *HOW, False) == D.FLOAT64
    assert infer_python("1,5", *HOW, True, ",") == D.FLOAT64


def test_lattice_is_a_join():
    kinds = list(D)
    for a, b, c in product(kinds, kinds, kinds):
        if D.UNKNOWN in (a, b, c):
            continue
        assert wider(a, b) == wider(b, a)
        assert wider(wider(a, b), c) == wider(a, wider(b, c))
    assert wider(D.INT32, D.BOOL) == D.INT32
    assert wider(D.DATE, D.TIMESTAMP) == D.STRING
    assert wider(D.NA, D.TIME) == D.TIME
    assert wider(D.INT64, D.DATE) == D.STRING
    assert can_promote(D.BOOL, D.STRING) and not can_promote(D.STRING, D.BOOL)


def test_type_names():
    assert parse_type("int") == D.INT32 and parse_type("float64") == D.FLOAT64
    with pytest.raises(ValueError):
        parse_type("decimal")


@given(st.text(alphabet="0123456789+-.eE:/T NAtrue", max_size=22))
def test_inference_never_fails(text):
    assert infer_python(text, *HOW) in D


@pytest.mark.parametrize("bad", [{"error_mode": "loud"}, {"quote": "''"}, {"decimal_mark": ";"}, {"separator": ","  , "decimal_mark": ","}, {"skip": -1}])
def test_options_are_checked(bad):
    with pytest.raises(ValueError):
        CsvOptions(**bad).check()


def test_fwf_options_are_checked():
    for bad in ({}, {"col_starts": [0], "col_ends": [1, 2]}, {"col_starts": [3], "col_ends": [1]}, {"col_starts": [0], "col_ends": [1], "col_names": ["a", "b"]}):
        with pytest.raises(ValueError):
            FwfOptions(**bad).check()


def test_token_lists():
    assert tokens("") == [] and tokens("a,") == ["a", ""]
