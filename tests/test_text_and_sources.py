import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from votelake.functions import maths, text
from votelake.operators import rollup
from votelake.sources import scan


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, expected", [
    ("3–5 Mar", (dt.date(2022, 3, 3), dt.date(2022, 3, 5))),
    ("28 Feb − 2 Mar", (dt.date(2022, 2, 28), dt.date(2022, 3, 2))),
    ("11-14 August 2016[b]", (dt.date(2016, 8, 11), dt.date(2016, 8, 14))),
    ("7 May 2014", (dt.date(2014, 5, 7), dt.date(2014, 5, 7))),
    ("28 Feb 2020 - 1 March 2020", (dt.date(2020, 2, 28), dt.date(2020, 3, 1))),
    ("19 Nov – 4 Jan", None),
    ("unknown", None),
    ("30 Feb", None),
    ("5 anm", None),
    ("4", None),
    ("1-2-3 Mar", None),
    (None, None),
])
def test_date_range(spark, raw, expected):
    got = value(spark, text.date_range(F.lit(raw).cast("string"), F.lit(2022)))
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize("raw, name, expected", [("17,25%", None, 17.25), ("—", None, None), ("33% (Rivera)", "rivera", 33.0), ("35% (Soto)", "rivera", None), ("8[x]", None, 8.0)])
def test_number_cell(spark, raw, name, expected):
    assert value(spark, text.number_cell(F.lit(raw), name)) == expected


@pytest.mark.parametrize("raw, expected", [("Norte Pesquisa[2]", "norte"), ("Sul / Mérito", "merito"), ("MÉRITO", "merito"), ("A New  One", "wiki_a_new_one"), ("Mérito Archived 9 June at a site", "merito"), ("Sul/Leste", "wiki_sul_leste")])
def test_canonical_house(spark, raw, expected):
    aliases = {"norte pesquisa": "norte", "merito": "merito"}
    assert value(spark, text.canonical(F.lit(raw), aliases)) == expected
    assert value(spark, text.canonical(F.lit(raw), {})).startswith("wiki_")


def test_small_text_functions(spark):
    assert value(spark, text.name_key(F.lit(" São-José  d'Oeste "))) == "SAO JOSE D OESTE"
    assert value(spark, text.sample_size(F.lit("2.000[a]"))) == 2000
    assert value(spark, text.zero_padded(F.lit("71"), 5)) == "00071"
    assert value(spark, text.proper_name(F.lit("RIO DE JANEIRO"))) == "Rio de Janeiro"
    assert value(spark, text.header_label(F.lit("Unnamed: 3"), F.lit(None).cast("string"), F.lit("Rivera [note]"))) == "Rivera"
    assert value(spark, text.header_label(F.lit("Unnamed: 3"))) == "?"
    assert value(spark, text.lenient(F.lit("x1"), "long")) is None
    assert value(spark, text.date_of(F.lit("03/10/2022"), "yyyy-MM-dd", "dd/MM/yyyy")) == dt.date(2022, 10, 3)
    assert value(spark, text.same_prefix(F.lit("ESCOLA MUNICIPAL A"), F.lit("ESCOLA MUNICIPAL B"))) is True


@pytest.mark.parametrize("share, label", [(72.1, "clear"), (50.2, "narrow"), (29.7, "behind")])
def test_label_by_share(spark, share, label):
    c = maths.band(F.lit(share), [0, 45, 55, 101], ["behind", "narrow", "clear"])
    assert value(spark, c) == label


def test_normal_cdf(spark):
    for z, p in ((0.0, 0.5), (1.0, 0.841344746), (-1.96, 0.024997895), (4.0, 0.999968329)):
        assert abs(value(spark, maths.normal_cdf(F.lit(z))) - p) < 3e-7


def test_raw_scan(spark, tmp_path):
    a, b = tmp_path / "votes_XX.csv", tmp_path / "votes_BRASIL.csv"
    a.write_bytes("SG_UF;QT;NM\nSP;1;x\n".encode("latin-1"))
    b.write_bytes("SG_UF;QT;NM\nSP;10;José\nrj;-1;#NULO#\nAC;3;z\n".encode("latin-1"))
    names = spark.createDataFrame([(p.name,) for p in (a, b, tmp_path / "leia.pdf")], "name string")
    assert [r["name"] for r in scan.preferred_files(names).collect()] == ["votes_BRASIL.csv"]
    assert scan.preferred_files(names.where("name <> 'votes_BRASIL.csv'")).count() == 1
    rows = scan.raw_delimited(spark, str(b), ["SG_UF", "QT", "NM", "GONE"], {"SG_UF": ["sp", "RJ"]}).orderBy("SG_UF").collect()
    assert [(r["SG_UF"], r["QT"], r["NM"]) for r in rows] == [("SP", "10", "José"), ("rj", None, None)]
    assert rows[0]["source_file"] == "votes_BRASIL.csv"


def test_conform_and_roles(spark):
    df = spark.createDataFrame([("1", None), (None, "x")], "a string, b string")
    out = scan.conform(df, {"t": ["old", "a", "b"], "n": ["none"]}, {"t": "int"}).collect()
    assert [r["t"] for r in out] == [1, None] and out[0]["n"] is None
    assert scan.first_existing(df, "z", "b") == "b"
    roles = {"date": "date|period", "sample": "sample", "candidate*": "rivera|soto"}
    assert scan.column_roles(["Date", "Sample", "Rivera", "Soto"], roles)["Soto"] == "candidate*"
    with pytest.raises(ValueError):
        scan.column_roles(["Date", "Sample", "Odd"], roles)


def test_nested_results(spark, tmp_path):
    doc = {"cdabr": "sp", "pst": "99,5", "carg": [{"cd": "1", "agr": [{"par": [{"sg": "PX", "cand": [{"n": "13", "nm": "A", "vap": "10"}, {"n": "14", "nm": "B", "vap": "x"}]}]}]}]}
    (tmp_path / "r.json").write_text(json.dumps(doc))
    rows = scan.nested_results(spark.read.schema(scan.RESULT_SCHEMA).json(str(tmp_path), multiLine=True)).orderBy("number").collect()
    assert [(r["counted_pct"], r["party"], r["votes"]) for r in rows] == [(99.5, "PX", 10), (99.5, "PX", None)]


def test_snapshots(spark):
    s = spark.createDataFrame([("d", "1", "x"), ("d", "2", "x"), ("d", "3", "y"), ("e", "1", None)], "dataset string, version string, sha256 string")
    assert {(r["dataset"], r["version"]) for r in scan.changed_snapshots(s).collect()} == {("d", "1"), ("d", "3"), }
    assert {r["version"] for r in scan.latest_version(s, ["dataset"]).collect()} == {"3", "1"}
    assert scan.to_recompute(s, s.where("sha256 = 'x'")).where("sha256 = 'x'").count() == 0


def test_expectations_and_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    rules = scan.expect(df, ["k", "gone"], 1, 2, {"v given": F.col("v").isNotNull()})
    assert {r["rule"]: (r["passed"], r["found"]) for r in rules.collect()} == {"required_columns": (False, 1), "min_rows": (True, 2), "exact_rows": (True, 2), "v given": (False, 1)}
    with pytest.raises(ValueError):
        scan.require(df, rules)
    for run in ("2022", "2026"):
        scan.write_run(df, str(tmp_path / "out"), run, {"n": "1"}, {"in": "abc"})
    assert scan.latest_run(spark, str(tmp_path / "out")).select("run_id").distinct().collect()[0][0] == "2026"


def test_census_counts(spark):
    a = spark.createDataFrame([("1", "2,5", "X"), ("2", "1", "4")], "s string, v1 string, v2 string")
    b = spark.createDataFrame([("2", "7"), ("3", "8")], "cd string, w string")
    out = scan.census_counts([(a, "s", {"t": ["v1", "v2"]}), (b, "cd", {"w": ["w"]})]).orderBy("sector").collect()
    assert [(r["sector"], r["t"], r["w"]) for r in out] == [("1", 2.5, 0.0), ("2", 5.0, 7.0), ("3", 0.0, 8.0)]


def test_inventory_and_dimension(spark, tmp_path):
    m = spark.createDataFrame([("d", "1", [(3,), (4,)], "abcdef0123456789")], "dataset string, version string, files array<struct<bytes:long>>, sha256 string")
    r = scan.inventory(m).first()
    assert (r["n_files"], r["bytes"], r["digest"]) == (2, 7, "abcdef012345")
    assert scan.dimension(spark, {"a": ["x", "y"], "b": "z"}, "k", "v").count() == 3
    (tmp_path / "f.bin").write_bytes(b"hello")
    assert scan.file_digests(spark, str(tmp_path / "f.bin")).first()["sha256"].startswith("2cf24dba")


def test_repeated_run_replaces_its_rows(spark, tmp_path):
    at = str(tmp_path / "runs")
    for run, n in (("1", 3), ("2", 5), ("2", 4)):
        scan.write_run(spark.range(n), at, run, {"n": str(n)}, {})
    assert scan.latest_run(spark, at).count() == 4 and spark.read.parquet(f"{at}/data").count() == 7 and spark.read.parquet(f"{at}/runs").count() == 2
    scan.write_run(spark.range(0), at, "2", {}, {})
    assert spark.read.parquet(f"{at}/data").count() == 3
    with pytest.raises(ValueError):
        scan.write_run(spark.range(1), at, "a/b", {}, {})


def test_preferred_files_by_year(spark):
    f = spark.createDataFrame([(1, "a_BRASIL.csv"), (1, "b.csv"), (2, "c.csv"), (2, "d.txt"), (2, "e.pdf")], "year int, name string")
    assert {r["name"] for r in scan.preferred_files(f, by=["year"]).collect()} == {"a_BRASIL.csv", "c.csv", "d.txt"}


def test_set_verdict(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("x", None), ("y", 1)], "g string, k int")
    b = spark.createDataFrame([("x", None), ("x", 1), ("y", 1), ("y", 2)], "g string, k int")
    assert {r["g"]: (r["first"], r["second"], r["both"], r["equal"]) for r in rollup.set_verdict(a, b, "k", ["g"]).collect()} == {"x": (2, 2, 2, True), "y": (1, 2, 1, False)}
    assert rollup.set_verdict(a.limit(0), b.limit(0), "k").first()["equal"] is True
