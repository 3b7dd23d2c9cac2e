"""Queries over scans and registries: files are written from the given tables and read back by the library's scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dims, rollup
from ..sources import scan
from .bindings import query, r6, scratch, table

# --- raw files ---------------------------------------------------------------


def _customer_files(spark: SparkSession, d: str) -> list[str]:
    """Customers as delimited text with marks for missing values and decimal commas, in two folders."""
    c = table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("CODE"), F.when(F.col("c_nationkey") == 3, "#NULO#").when(F.col("c_nationkey") == 7, "-1").otherwise(F.col("c_nationkey").cast("string")).alias("UNIT"),
        F.replace(F.format_string("%.2f", "c_acctbal"), F.lit("."), F.lit(",")).alias("VALUE"), F.col("c_mktsegment").alias("SEGMENT"), (F.col("c_custkey") % 2).alias("half"))
    root = scratch(spark, "raw")
    for half in (0, 1):
        c.where(f"half = {half}").drop("half").write.csv(f"{root}/part{half}", sep=";", header=True, encoding="ISO-8859-1")
    return [f"{root}/part0", f"{root}/part1"]


@query("raw_scan", """SELECT CAST(c_custkey AS VARCHAR) AS code, CASE WHEN c_nationkey IN (3, 7) THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS unit, c_acctbal AS value, c_mktsegment AS segment
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""")
def raw_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = scan.raw_delimited(spark, _customer_files(spark, d), ["CODE", "UNIT", "VALUE", "SEGMENT", "GONE"], {"SEGMENT": ["building", "Machinery"]})
    return rows.select(F.col("CODE").alias("code"), F.col("UNIT").alias("unit"), text.decimal_comma("VALUE").alias("value"), F.col("SEGMENT").alias("segment"))


@query("files_by_unit", """SELECT CASE WHEN c_nationkey IN (3, 7) THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS unit, count(*) AS n, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1""")
def files_by_unit(spark: SparkSession, d: str) -> DataFrame:
    """Sums over all files of a scan; each task's part is combined before the shuffle."""
    rows = scan.raw_delimited(spark, _customer_files(spark, d), ["UNIT", "VALUE"])
    return rows.groupBy(F.col("UNIT").alias("unit")).agg(F.count("*").alias("n"), F.round(F.sum(text.decimal_comma("VALUE")), 2).alias("value"))


@query("preferred_listing", """WITH f AS (SELECT n_name || CASE WHEN n_regionkey = 2 THEN '_BRASIL.csv' WHEN n_regionkey = 3 THEN '.pdf' ELSE '.TXT' END AS name FROM nation) SELECT name FROM f WHERE name LIKE '%_BRASIL.csv'""")
def preferred_listing(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("n_regionkey") == 2, "_BRASIL.csv").when(F.col("n_regionkey") == 3, ".pdf").otherwise(".TXT")
    return scan.preferred_files(table(spark, d, "nation").select(F.concat("n_name", end).alias("name")))


@query("preferred_by_region", """WITH f AS (SELECT n_regionkey AS region, n_name || CASE WHEN n_regionkey < 2 AND n_nationkey % 4 = 0 THEN '_BRASIL.csv' WHEN n_nationkey % 5 = 0 THEN '.pdf' ELSE '.TXT' END AS name FROM nation), g AS (SELECT region, max(CAST(name LIKE '%_BRASIL.csv' AS INTEGER)) AS h FROM f GROUP BY region)
SELECT region, name FROM f JOIN g USING (region) WHERE name NOT LIKE '%.pdf' AND (h = 0 OR name LIKE '%_BRASIL.csv')""")
def preferred_by_region(spark: SparkSession, d: str) -> DataFrame:
    """Regions with a consolidated file and regions without, whose files are all read."""
    end = F.when((F.col("n_regionkey") < 2) & (F.col("n_nationkey") % 4 == 0), "_BRASIL.csv").when(F.col("n_nationkey") % 5 == 0, ".pdf").otherwise(".TXT")
    files = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.concat("n_name", end).alias("name"))
    return scan.preferred_files(files, by=["region"])


@query("set_verdicts", """WITH m AS (SELECT c_mktsegment AS segment, c_nationkey AS unit, 1 AS s FROM customer UNION SELECT c_mktsegment, n_nationkey, 2 FROM nation, (SELECT DISTINCT c_mktsegment FROM customer)), g AS (SELECT segment, unit, max(CAST(s = 1 AS INTEGER)) AS a, max(CAST(s = 2 AS INTEGER)) AS b FROM m GROUP BY ALL)
SELECT segment, CAST(sum(a) AS BIGINT) AS first, CAST(sum(b) AS BIGINT) AS second, CAST(sum(a * b) AS BIGINT) AS both, min(CAST(a = b AS INTEGER)) = 1 AS equal FROM g GROUP BY segment""")
def set_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether the customers of each segment come from all units."""
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("unit"))
    units = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"))
    every = units.crossJoin(F.broadcast(c.select("segment").distinct()))  # units and segments are fixed
    return rollup.set_verdict(c, every, "unit", ["segment"])


@query("reference_codes", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS code, CASE WHEN s_nationkey = 4 THEN NULL ELSE s_name END AS name, lpad(CAST(s_nationkey AS VARCHAR), 2, '0') AS unit FROM supplier")
def reference_codes(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "reference")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("code"), F.when(F.col("s_nationkey") == 4, "").otherwise(F.col("s_name")).alias("name"), F.col("s_nationkey").alias("unit"))
    s.write.csv(at, header=True, emptyValue="")
    return scan.reference_csv(spark, at, {"code": 7, "unit": 2})


@query("reference_units", "SELECT n_nationkey AS code, n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def reference_units(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    at = scratch(spark, "list")
    n.select(F.col("n_nationkey").alias("id"), F.struct(F.col("n_name").alias("long"), F.struct(F.col("r_name").alias("name")).alias("above")).alias("label")).write.json(at)
    return scan.reference_json(spark, at, "id int, label struct<long:string,above:struct<name:string>>", {"code": "id", "name": "label.long", "region": "label.above.name"})


@query("census_table", """WITH a AS (SELECT CAST(c_nationkey AS VARCHAR) AS sector, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS x, sum(CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) AS y FROM customer GROUP BY 1),
b AS (SELECT CAST(s_nationkey AS VARCHAR) AS sector, round(sum(s_acctbal), 2) AS w FROM supplier WHERE s_nationkey % 3 <> 0 GROUP BY 1)
SELECT coalesce(a.sector, b.sector) AS sector, CAST(coalesce(CASE WHEN x = 0 THEN 0 ELSE x END + y, 0) AS DOUBLE) AS people, coalesce(w, 0.0) AS income FROM a FULL JOIN b ON a.sector = b.sector""")
def census_table(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.sum((F.col("c_mktsegment") == s).cast("int"))
    a = table(spark, d, "customer").groupBy("c_nationkey").agg(n("BUILDING").alias("x"), n("MACHINERY").alias("y"))
    a = a.select(F.concat(F.col("c_nationkey").cast("string"), F.lit(" ")).alias("s"), F.when(F.col("x") == 0, "X").otherwise(F.concat(F.col("x").cast("string"), F.lit(",0"))).alias("v1"), F.col("y").cast("string").alias("v2"))
    b = table(spark, d, "supplier").where("s_nationkey % 3 <> 0").groupBy("s_nationkey").agg(F.sum("s_acctbal").alias("w"))
    b = b.select(F.col("s_nationkey").cast("string").alias("cd"), F.replace(F.format_string("%.2f", "w"), F.lit("."), F.lit(",")).alias("w"))
    return scan.census_counts([(a, "s", {"people": ["v1", "v2"]}), (b, "cd", {"income": ["w"]})])


# --- snapshots and runs ------------------------------------------------------


@query("snapshot_inventory", """SELECT event_type AS dataset, CAST(CAST(ts AS DATE) AS VARCHAR) AS version, count(*) AS n_files, CAST(sum(event_id) AS BIGINT) AS bytes, left(sha256(event_type || CAST(CAST(ts AS DATE) AS VARCHAR)), 12) AS digest FROM events GROUP BY ALL""")
def snapshot_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Manifests written as JSON, one for each day of a type of event, and read back."""
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("dataset"), F.to_date("ts").cast("string").alias("version")).agg(F.collect_list(F.struct(F.col("event_id").alias("bytes"))).alias("files"))
    at = scratch(spark, "manifests")
    e.withColumn("sha256", F.sha2(F.concat("dataset", "version"), 256)).write.json(at)
    return scan.inventory(spark.read.schema("dataset string, version string, files array<struct<bytes:long>>, sha256 string").json(at))


@query("file_digests", "SELECT sha256(n_name || chr(10)) AS sha256, length(n_name) + 1 AS length FROM nation")
def file_digests(spark: SparkSession, d: str) -> DataFrame:
    at = scratch(spark, "files")
    table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value")).write.partitionBy("n_nationkey").text(at)
    return scan.file_digests(spark, f"{at}/*/*.txt").select("sha256", "length")


@query("stored_results", "SELECT md5(CAST(CAST(ts AS DATE) AS VARCHAR)) AS sha256, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY CAST(ts AS DATE)")
def stored_results(spark: SparkSession, d: str) -> DataFrame:
    """Days of events as inputs; half of them have results when all are asked for, and these are not computed again."""
    e = table(spark, d, "events").withColumn("sha256", F.md5(F.to_date("ts").cast("string").cast("binary")))
    at = scratch(spark, "results")
    compute = lambda x: x.groupBy("sha256").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))
    scan.stored_results(spark, at, e.where(F.dayofmonth("ts") % 2 == 0), compute)
    return scan.stored_results(spark, at, e, compute).select("sha256", "n", "value")


@query("result_documents", """SELECT n_name AS cdabr, n_regionkey + 0.5 AS counted_pct, CAST(s_suppkey % 3 AS VARCHAR) AS office, 'P' || (s_suppkey % 5) AS party, CAST(s_suppkey AS VARCHAR) AS number, s_name AS name,
CASE WHEN s_suppkey % 7 = 0 THEN -1 ELSE CAST(floor(s_acctbal) AS BIGINT) END AS votes FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def result_documents(spark: SparkSession, d: str) -> DataFrame:
    """Result documents of every unit written as JSON and flattened."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    votes = F.when(F.col("s_suppkey") % 7 == 0, "-").otherwise(F.floor("s_acctbal").cast("string"))
    cand = F.struct(F.col("s_suppkey").cast("string").alias("n"), F.col("s_name").alias("nm"), votes.alias("vap"))
    by = ["n_name", "n_regionkey", (F.col("s_suppkey") % 3).cast("string").alias("cd")]
    party = s.groupBy(*by, F.concat(F.lit("P"), F.col("s_suppkey") % 5).alias("sg")).agg(F.collect_list(cand).alias("cand"))
    office = party.groupBy("n_name", "n_regionkey", "cd").agg(F.collect_list(F.struct("sg", "cand")).alias("par"))
    docs = office.groupBy("n_name", "n_regionkey").agg(F.collect_list(F.struct("cd", F.array(F.struct("par")).alias("agr"))).alias("carg"))
    at = scratch(spark, "documents")
    docs.select(F.col("n_name").alias("cdabr"), F.concat(F.col("n_regionkey").cast("string"), F.lit(",5")).alias("pst"), "carg").write.json(at)
    return scan.nested_results(spark.read.schema(scan.RESULT_SCHEMA).json(at)).fillna(-1, ["votes"])


@query("run_outputs", "SELECT 'r2' AS run_id, c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_custkey % 2 = 1 GROUP BY ALL")
def run_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs with their parameters; the last one is read."""
    at = scratch(spark, "runs")
    for run, odd in (("r1", 0), ("r2", 1)):
        own = table(spark, d, "customer").where(f"c_custkey % 2 = {odd}").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
        scan.write_run(own, at, run, {"odd": str(odd)}, {"customer": str(odd)})
    return scan.latest_run(spark, at).select("run_id", "segment", "n")


@query("checked_seats", "SELECT n_nationkey AS unit, 8 + n_nationkey % 3 AS seats FROM nation")
def checked_seats(spark: SparkSession, d: str) -> DataFrame:
    """Seats per unit, of which there must be 25, none below 8."""
    s = table(spark, d, "nation").select(F.col("n_nationkey").alias("unit"), (8 + F.col("n_nationkey") % 3).alias("seats"))
    return scan.require(s, scan.expect(s, ["unit", "seats"], 25, 25, {"at least 8": F.col("seats") >= 8}))


@query("column_roles", "SELECT CAST(ts AS DATE) AS \"date\", event_type AS name, count(*) AS n FROM events GROUP BY ALL")
def column_roles(spark: SparkSession, d: str) -> DataFrame:
    """Columns by what their names say, and by the first of several names that exists."""
    e = table(spark, d, "events")
    roles = scan.column_roles(["ts", "event_type"], {"date": "^ts$|date", "name": "type"})
    own = {role: column for column, role in roles.items()}
    counted = scan.first_existing(e, "missing", "event_id")
    return e.groupBy(F.to_date(own["date"]).alias("date"), F.col(own["name"]).alias("name")).agg(F.count(counted).alias("n"))


# --- reference keys ----------------------------------------------------------


@query("crosswalk_methods", """SELECT n_regionkey AS within, n_nationkey AS code, CASE n_nationkey % 5 WHEN 4 THEN CASE WHEN n_nationkey = 4 THEN 1004 ELSE -1 END ELSE 1000 + n_nationkey END AS target,
CASE n_nationkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'alternative' WHEN 2 THEN 'similar' WHEN 3 THEN 'exact' ELSE CASE WHEN n_nationkey = 4 THEN 'manual' ELSE 'none' END END AS method,
CASE WHEN n_nationkey = 4 THEN 'renamed' END AS reason FROM (SELECT n_nationkey // 5 AS n_regionkey, n_nationkey FROM nation)""")
def crosswalk_methods(spark: SparkSession, d: str) -> DataFrame:
    """Names that meet exactly, by a listed alternative, by likeness, by hand, or not at all."""
    key = F.col("n_nationkey")
    word = F.element_at(F.array(*[F.lit(w) for w in ("Águas Claras", "Monte-Verde", "Santo Antonio do Norte", "Vila Rica", "Porto Velho")]), (key % 5 + 1).cast("int"))
    n = table(spark, d, "nation").select(F.floor(key / 5).cast("int").alias("within"), key, F.concat(word, F.lit(" "), F.chr((F.floor(key / 5) + 65).cast("int"))).alias("name"))
    mine = F.when(key % 5 == 1, F.concat(F.lit("Old "), F.col("within"))).when(key % 5 == 2, F.replace("name", F.lit("Antonio"), F.lit("Antônyo"))).when(key % 5 == 4, F.lit("??")).otherwise(F.upper("name"))
    left = n.select("within", key.alias("code"), mine.alias("name"), F.when(key % 5 == 1, F.concat(F.lit("nothing|"), F.lower("name"))).alias("others"))
    right = n.select("within", (1000 + key).alias("target"), F.col("name").alias("other"))
    manual = spark.createDataFrame([(0, 4, 1004, "renamed")], "within int, code int, target int, reason string")
    return dims.match_names(left, right, "within", "code", "target", "name", "other", alternatives="others", manual=manual).fillna(-1, ["target"])


@query("house_in_period", """SELECT CAST(c_custkey AS BIGINT) AS poll, 2018 + c_custkey % 6 AS year, CASE WHEN (2018 + c_custkey % 6) IN (2018, 2020 + c_nationkey % 3) THEN n_name END AS house FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def house_in_period(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("poll"), F.col("c_nationkey").alias("registry"), (2018 + F.col("c_custkey") % 6).alias("year"))
    h = table(spark, d, "nation").select(F.col("n_nationkey").alias("registry"), F.array_distinct(F.array(F.lit(2018).cast("long"), (2020 + F.col("n_nationkey") % 3).cast("long"))).alias("years"), F.col("n_name").alias("house"))
    return dims.valid_in(p, h, "registry", "year", "years", "house").select("poll", "year", "house")


@query("fixed_composition", """WITH RECURSIVE b AS (SELECT DISTINCT p_brand AS party, CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part),
steps AS (SELECT party, 'Brand#' || (n + 1) AS successor, 1995 + n // 10 AS year FROM b WHERE n % 2 = 1 AND n < 25),
walk AS (SELECT party, party AS successor, 1994 AS at, 0 AS hop FROM b UNION ALL SELECT w.party, s.successor, s.year, w.hop + 1 FROM walk w JOIN steps s ON s.party = w.successor AND s.year > 1994 AND s.year <= 1999 AND s.year >= w.at),
t AS (SELECT party, arg_max(successor, hop) AS s FROM walk GROUP BY party) SELECT p_partkey AS part, p_brand AS party, 'f' || (CAST(substr(s, 7) AS INTEGER) + 1999) % 6 AS family FROM part JOIN t ON party = p_brand""")
def fixed_composition(spark: SparkSession, d: str) -> DataFrame:
    from .votes import assigned_families

    parts = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("party"))
    n = F.substring("party", 7, 9).cast("int")
    chain = parts.select("party").distinct().where((n % 2 == 1) & (n < 25)).select("party", F.concat(F.lit("Brand#"), n + 1).alias("successor"), (F.lit(1995) + F.floor(n / 10).cast("int")).alias("year"))
    return dims.fixed_composition(parts, chain, assigned_families(spark, d), 1999, 1994)


@query("upserted", """SELECT c_custkey AS code, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 'new' ELSE 'old' END AS state FROM customer WHERE c_custkey % 4 <> 0
UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 = 0""")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a new delivery replace those of their key, but for units that were complete."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("code"))
    old = c.where("code % 4 <> 0").withColumn("state", F.lit("old"))
    new = c.where("code % 3 = 0").withColumn("state", F.lit("new"))
    return dims.upsert(old, new, ["code"], frozen="code % 5 = 0")


@query("last_legislature", "SELECT s_suppkey AS member, s_nationkey AS legislature FROM supplier WHERE s_nationkey = (SELECT max(s_nationkey) FROM supplier)")
def last_legislature(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import territory

    members = table(spark, d, "supplier").select(F.col("s_suppkey").alias("member"), F.col("s_nationkey").alias("legislature"))
    return territory.continuing(members, "legislature", members.where(F.col("legislature") == members.agg(F.max("legislature")).first()[0]).count()).select("member", "legislature")


@query("completed_places", """WITH c AS (SELECT c_custkey AS place, c_nationkey AS unit, c_mktsegment AS district, 'SCHOOL ' || (c_custkey // 3) AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS lat FROM customer),
o AS (SELECT c_custkey AS place, c_nationkey AS unit, 'SCHOOL ' || (c_custkey // 3) AS name, c_acctbal + 1 AS lat FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT unit, district, avg(lat) AS lat FROM c WHERE lat IS NOT NULL GROUP BY ALL), n AS (SELECT unit, name, arg_min(lat, place) AS lat FROM o GROUP BY ALL)
SELECT c.place, round(coalesce(c.lat, o.lat, n.lat, m.lat), 4) AS lat, CASE WHEN c.lat IS NOT NULL THEN 'own' WHEN o.lat IS NOT NULL THEN 'same place' WHEN n.lat IS NOT NULL THEN 'same name' WHEN m.lat IS NOT NULL THEN 'district' ELSE 'none' END AS coord_origin
FROM c LEFT JOIN o ON o.unit = c.unit AND o.place = c.place LEFT JOIN n ON n.unit = c.unit AND n.name = c.name LEFT JOIN m ON m.unit = c.unit AND m.district = c.district""")
def completed_places(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("place"), F.col("c_nationkey").alias("unit"), F.col("c_mktsegment").alias("district"), F.concat(F.lit("SCHOOL "), F.floor(F.col("c_custkey") / 3)).alias("name"), F.col("c_acctbal").alias("v"))
    lat = F.when(F.col("place") % 3 != 0, F.col("v"))
    now = c.select("place", "unit", "district", "name", lat.alias("lat"), lat.alias("lon"))
    before = c.where("place % 2 = 0").select("place", "unit", "district", "name", (F.col("v") + 1).alias("lat"), (F.col("v") + 1).alias("lon"), F.lit(2018).alias("year"))
    return dims.completed_coordinates(now, before, ["unit"]).select("place", F.round("lat", 4).alias("lat"), "coord_origin")


@query("set_operations", """WITH a AS (SELECT DISTINCT c_nationkey AS unit FROM customer WHERE c_mktsegment = 'BUILDING'), b AS (SELECT DISTINCT s_nationkey AS unit FROM supplier)
SELECT 'both' AS side, unit, 0 AS extra FROM (SELECT unit FROM a INTERSECT SELECT unit FROM b) UNION ALL SELECT 'first', unit, 0 FROM (SELECT unit FROM a EXCEPT SELECT unit FROM b)
UNION ALL SELECT 'second', unit, 1 FROM (SELECT unit FROM b EXCEPT SELECT unit FROM a)""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Keys of two tables: common ones and those of one only, aligned by name; equal sets have only common ones."""
    a = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("unit")).distinct()
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("unit")).distinct()
    named = lambda df, name: df.withColumn("side", F.lit(name))
    out = named(a.intersect(b), "both").unionByName(named(a.subtract(b), "first"))
    out = out.unionByName(named(b.subtract(a), "second").withColumn("extra", F.lit(1)), allowMissingColumns=True)
    return out.fillna(0, ["extra"])


@query("name_order", """SELECT code, CAST(row_number() OVER (ORDER BY plain, code) AS INTEGER) AS place, plain FROM (SELECT n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'AGUA ' ELSE 'AZUL ' END || lpad(CAST(99 - n_nationkey AS VARCHAR), 2, '0') AS plain FROM nation)""")
def name_order(spark: SparkSession, d: str) -> DataFrame:
    """Units in the order of their names without regard to marks; the units are few."""
    from pyspark.sql import Window

    key = F.col("n_nationkey")
    n = table(spark, d, "nation").select(key.alias("code"), F.concat(F.when(key % 2 == 0, "Água ").otherwise("azul "), F.lpad((99 - key).cast("string"), 2, "0")).alias("name"))
    return n.select("code", F.row_number().over(Window.orderBy(text.name_key("name"), "code")).alias("place"), text.name_key("name").alias("plain"))


@query("extremes", """WITH m AS (SELECT c_custkey AS code, c_acctbal AS x FROM customer), t AS ((SELECT 'top' AS kind, code, x FROM m ORDER BY x DESC, code LIMIT 5) UNION ALL (SELECT 'bottom', code, x FROM m ORDER BY x, code LIMIT 5) UNION ALL (SELECT 'nearest 5000', code, x FROM m ORDER BY abs(x - 5000), code LIMIT 5)) SELECT kind, code, round(x, 6) AS x FROM t""")
def extremes(spark: SparkSession, d: str) -> DataFrame:
    """The five largest, the five smallest, and the five nearest to a value; each task keeps five rows."""
    m = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_acctbal").alias("x"))
    some = lambda kind, *order: m.orderBy(*order, "code").limit(5).withColumn("kind", F.lit(kind))
    out = some("top", F.desc("x")).unionByName(some("bottom", F.asc("x"))).unionByName(some("nearest 5000", F.abs(F.col("x") - 5000)))
    return out.select("kind", "code", r6("x"))
