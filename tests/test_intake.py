"""CSV documents under their own headers; domains in the spelling of stored settings."""

import json

import pytest

from doctables.operators import extract
from doctables.sources import files


def settings(spark, domain):
    return spark.createDataFrame([("domains", json.dumps({"mine": domain})), ("other", "x")], "key string, value string")


def test_csv_files_of_different_headers(spark, tmp_path):
    texts = {"one.csv": 'a,b\n1,2\n\n"x, ""y""","two\nlines"\n', "two.csv": "b,c,d\n3,4,5\n6\n7,8,9,10\n", "sub/three.csv": "﻿a,a,,_c9\n1,2,3,4\n,,,\n", "head.csv": "a,b\n", "none.csv": ""}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = {}
    for r in files.scan_csv_rows(spark, str(tmp_path)).orderBy("path", "row_no").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row_no, r.cells))
    assert got == {
        "one.csv": [(1, {"a": "1", "b": "2"}), (2, {"a": 'x, "y"', "b": "two\nlines"})],
        "two.csv": [(1, {"b": "3", "c": "4", "d": "5"}), (2, {"b": "6", "c": None, "d": None}), (3, {"b": "7", "c": "8", "d": "9", "_c3": "10"})],
        "three.csv": [(1, {"a": "1", "_c1": "2", "_c2": "3", "_c3": "4"}), (2, {"a": None, "_c1": None, "_c2": None, "_c3": None})]}


def test_domain_in_either_spelling(spark):
    stored = {"label": "Mine", "prompt": "", "chargeTypeAliases": {"LANDING": "^landing"}, "fieldVocabulary": {"time": "T"}, "movementPattern": {"flightPrefix": "E", "defaultAirport": "XXX"}}
    own = {"charge_aliases": {"LANDING": ["^landing"]}, "vocabulary": {"time": "T"}, "default_airport": "XXX"}
    first, second = (extract.load_domain(settings(spark, d), "mine") for d in (stored, own))
    assert first == second and first["charge_aliases"] == {"LANDING": ["^landing"]} and first["default_airport"] == "XXX"
    assert first["vocabulary"]["time"] == "T" and first["vocabulary"]["origin"] == extract.DOMAINS["aviation"]["vocabulary"]["origin"]
    assert extract.load_domain(settings(spark, {"movementPattern": None}), "mine")["charge_aliases"] == {}


@pytest.mark.parametrize("domain", [{"chargeAliases": {}}, {"movementPattern": {"airport": "X"}}, {"charge_aliases": {}, "chargeTypeAliases": {}}])
def test_unknown_names_are_errors(spark, domain):
    with pytest.raises(ValueError, match="domain mine"):
        extract.load_domain(settings(spark, domain), "mine")
