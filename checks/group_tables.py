"""Tables that change by parts, files written and read back, versions of a schema, snapshots of mixed shape."""

from pyspark.sql import functions as F

from wayframe.operators import fares, repair, timetable, userlog
from wayframe.session import cut_lineage, scratch_folder
from wayframe.sources import evolving, files, sinks
from wayframe.sources.keyed import KeyedTable

from .catalog import query
from .group_delays import LATEST, log
from .group_places import bad_network, flagged
from .group_timetable import DETOUR, some_unplaced

KEYS, ORDER = ["user_id", "event_type"], ["ts", "event_id"]


def kept_log(net):
    """The event log in four batches, out of order, into one table by key."""
    rows = cut_lineage(log(net))
    table = KeyedTable(net.spark, scratch_folder(net.spark, "wayframe-keyed"), KEYS, ORDER, 16)
    for batch in (2, 0, 3, 1):
        table.upsert(rows.where(F.col("event_id") % 4 == batch))
    return rows, table


@query(f"WITH {LATEST} SELECT * FROM latest")
def keyed_upserts(net):
    """The latest event per user and type, from batches that rewrite only their buckets."""
    rows, table = kept_log(net)
    return table.read().select(*rows.columns)


@query(f"WITH {LATEST} SELECT * FROM latest WHERE NOT (user_id % 3 = 0 AND event_type = 'click')")
def keyed_deletes(net):
    """The same after deletions that are later than every event; earlier ones delete nothing."""
    rows, table = kept_log(net)
    ends = rows.groupBy(*KEYS).agg(F.max("ts").alias("ts"), F.max("event_id").alias("event_id"))
    gone = ends.where("user_id % 3 = 0 AND event_type = 'click'").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 DAY"))
    early = ends.where("user_id % 3 = 1").withColumn("ts", F.col("ts") - F.expr("INTERVAL 1000 DAYS"))
    table.delete(gone.unionByName(early))
    return table.read().select(*rows.columns)


@query("""
SELECT train_number, seq, coalesce(good_code, station_code) AS station_code FROM v_bad_stops LEFT JOIN v_remap ON station_code = bad_code
""")
def keyed_remaps(net):
    """Stops on the right station, changed in place: only buckets with stops of a remapped station are written."""
    stops, stations = bad_network(net)
    remap = repair.propose_remap(flagged(net), stations, max_km=1500.0)
    table = KeyedTable(net.spark, scratch_folder(net.spark, "wayframe-stops"), ["train_number", "seq"], [], 16)
    table.upsert(stops.select("train_number", "seq", "station_code"))
    to = remap.select(F.col("bad_code").alias("station_code"), "good_code")
    table.update(cut_lineage(to), ["station_code"], {"station_code": F.col("good_code")})
    return table.read()


@query("""
SELECT train_number, seq, station_code, CASE WHEN CAST(train_number AS INTEGER) % 5 <> 0 THEN (CAST(train_number AS BIGINT) * 1000 + seq)
  ELSE (SELECT max(CAST(train_number AS BIGINT) * 1000 + seq) FROM v_stops WHERE CAST(train_number AS INTEGER) % 5 <> 0) END AS id_or_top FROM v_stops
""")
def appended_stops(net):
    """Stops of new trains appended to the table of known ones: old rows keep their ids, new ids come after them, each once."""
    folder = scratch_folder(net.spark, "wayframe-append")
    stops = net.stops().select("train_number", "seq", "station_code")
    new = F.col("train_number").cast("int") % 5 == 0
    known = stops.where(~new).withColumn("id", F.col("train_number").cast("bigint") * 1000 + F.col("seq"))
    sinks.overwrite_table(known, f"{folder}/stops")
    known = net.spark.read.parquet(f"{folder}/stops")
    rows = cut_lineage(timetable.append_with_ids(known, stops.where(new), ["train_number", "seq"]))
    sinks.add_rows(known, rows.select("train_number", "seq", "station_code", "id"), f"{folder}/stops")
    whole = net.spark.read.parquet(f"{folder}/stops")
    top = whole.where(~new).agg(F.max("id").alias("top"))
    # ids of new rows: numbered without gap behind the largest one
    numbered = whole.join(F.broadcast(top), F.lit(True))
    size = rows.count()
    good = new & (F.col("id") > F.col("top")) & (F.col("id") <= F.col("top") + size)
    return numbered.select("train_number", "seq", "station_code", F.when(good, F.col("top")).otherwise(F.col("id")).alias("id_or_top"))


# --- versions of one table -----------------------------------------------------------------------

@query("""
SELECT number, name, CAST(k % 40 AS BIGINT) AS num_stops, CASE WHEN v >= 1 THEN class_text END AS classes, CASE v WHEN 0 THEN 'daily' WHEN 1 THEN 'daily' ELSE CASE WHEN k % 2 = 0 THEN 'weekly' END END AS runs,
  CASE v WHEN 0 THEN NULL WHEN 1 THEN CAST(k % 900 AS DOUBLE) ELSE k % 900 / 4.0 END AS distance_km
FROM (SELECT *, CAST(number AS BIGINT) AS k, CAST(number AS BIGINT) % 3 AS v FROM v_trains)
""")
def evolved_trains(net):
    """Trains written under three schemas (later columns, wider types, a column with a default), read as one table."""
    folder = scratch_folder(net.spark, "wayframe-versions")
    k = F.col("number").cast("bigint")
    trains = cut_lineage(net.trains().select("number", "name", F.array_join("classes", ",").alias("classes"), k.alias("k")))
    first = trains.where("k % 3 = 0").select("number", "name", (F.col("k") % 40).cast("int").alias("num_stops"))
    second = trains.where("k % 3 = 1").select("number", "name", (F.col("k") % 40).alias("num_stops"), "classes", (F.col("k") % 900).cast("int").alias("distance_km"))
    third = trains.where("k % 3 = 2").select(
        "name", "number", (F.col("k") % 40).cast("smallint").alias("num_stops"), "classes", (F.col("k") % 900 / 4.0).alias("distance_km"), F.when(F.col("k") % 2 == 0, "weekly").alias("runs"))
    paths = [f"{folder}/v{i}" for i in range(3)]
    for path, rows in zip(paths, (first, second, third)):
        sinks.overwrite_table(rows, path)
    return evolving.read_versions(net.spark, paths, {"runs": "'daily'"})


# --- snapshots of mixed shape --------------------------------------------------------------------

SHAPES = """
SELECT o_orderkey AS k, CASE o_orderkey % 5
  WHEN 0 THEN '{"id":"r' || o_orderkey || '","fare":' || o_orderkey % 700 || ',"legs":[{"train":"t' || o_orderkey % 9 || '"}]}'
  WHEN 1 THEN '{"id":"r' || o_orderkey || '","fare":"' || o_orderkey % 700 || '","hub":"h"}'
  WHEN 2 THEN '{"id":"r' || o_orderkey || '","legs":[]}' WHEN 3 THEN '{"id":"r' || o_orderkey ELSE '[' || o_orderkey || ']' END AS text FROM orders
"""


@query(f"""
SELECT k, o IS NULL AS broken, o ->> '$.id' AS route_id, CAST(o ->> '$.fare' AS DOUBLE) AS fare, o ->> '$.legs[0].train' AS first_train, o ->> '$.hub' AS hub
FROM (SELECT k, CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN text::JSON END AS o FROM ({SHAPES}))
""")
def mixed_snapshots(net):
    """Fields of snapshots of unknown shape; broken texts and those that are no objects are marked."""
    saved = net.table("orders").selectExpr("o_orderkey AS k", """CASE o_orderkey % 5
  WHEN 0 THEN concat('{"id":"r', o_orderkey, '","fare":', o_orderkey % 700, ',"legs":[{"train":"t', o_orderkey % 9, '"}]}')
  WHEN 1 THEN concat('{"id":"r', o_orderkey, '","fare":"', o_orderkey % 700, '","hub":"h"}')
  WHEN 2 THEN concat('{"id":"r', o_orderkey, '","legs":[]}') WHEN 3 THEN concat('{"id":"r', o_orderkey) ELSE concat('[', o_orderkey, ']') END AS text""")
    fields = {"route_id": ("$.id", "string"), "fare": ("$.fare", "double"), "first_train": ("$.legs[0].train", "string"), "hub": ("$.hub", "string")}
    return userlog.variant_snapshots(saved, "text", fields).drop("route", "text")


@query("SELECT 'OBJECT<fare: VARIANT, hub: STRING, id: STRING, legs: ARRAY<OBJECT<train: STRING>>>' AS shape WHERE EXISTS (SELECT * FROM orders WHERE o_orderkey % 5 < 3)")
def snapshot_shape(net):
    """The schema that the sound snapshots share: a fare is a number here and a text there."""
    saved = net.table("orders").selectExpr("""CASE o_orderkey % 5
  WHEN 0 THEN concat('{"id":"r', o_orderkey, '","fare":', o_orderkey % 700, ',"legs":[{"train":"t', o_orderkey % 9, '"}]}')
  WHEN 1 THEN concat('{"id":"r', o_orderkey, '","fare":"', o_orderkey % 700, '","hub":"h"}')
  WHEN 2 THEN concat('{"id":"r', o_orderkey, '","legs":[]}') WHEN 3 THEN concat('{"id":"r', o_orderkey) ELSE concat('[', o_orderkey, ']') END AS text""")
    return userlog.snapshot_shapes(userlog.variant_snapshots(saved, "text", {}))


# --- files written and read back -----------------------------------------------------------------

def folder_of(net, name):
    return f"{scratch_folder(net.spark, 'wayframe-files')}/{name}"


@query("SELECT class_code, km, fare FROM v_quotes")
def fare_quote_files(net):
    path = folder_of(net, "quotes")
    quotes = net.quotes().select(F.col("class_code").alias("classCode"), F.col("km").alias("distance"), F.col("fare").alias("totalFare"))
    quotes.write.csv(path, header=True)
    return files.read_fare_quotes(net.spark, path)


@query("SELECT code, name FROM v_stations")
def station_name_files(net):
    path = folder_of(net, "names")
    rows = net.stations_raw().select(F.lower("code").alias("station_name"), F.concat(F.lit(" "), "name", F.lit(" ")).alias("station_full_name"))
    rows.write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return files.read_station_names(net.spark, path)


@query("SELECT CAST(id AS BIGINT) AS id, name, asciiname, state AS admin1, population, 'PPL' AS feature_code, lat, lng FROM v_places")
def gazetteer_files(net):
    path = folder_of(net, "places")
    given = {"feature_code": F.lit("PPL"), "admin1": F.col("state")}
    places = net.places()
    known = [c for c in files.CITY_COLUMNS if c in places.columns]
    columns = [given.get(c, F.col(c) if c in known else F.lit("")).cast("string").alias(c) for c in files.CITY_COLUMNS]
    places.select(*columns).write.csv(path, sep="\t", quote="", emptyValue="")
    return files.read_gazetteer(net.spark, path)


@query("SELECT number, name, class_text AS classes FROM v_trains WHERE CAST(number AS BIGINT) % 2 = 0")
def overwritten_table(net):
    """A table that was written twice holds the second writing."""
    path = folder_of(net, "trains")
    trains = net.trains().select("number", "name", F.array_join("classes", ",").alias("classes"))
    sinks.overwrite_table(trains, path)
    even = cut_lineage(net.spark.read.parquet(path).where(F.col("number").cast("bigint") % 2 == 0))
    sinks.overwrite_table(even, path)
    return files.read_table(net.spark, path)


@query("""
SELECT 'flagged' AS section, code, CAST(NULL AS VARCHAR) AS good_code, trains FROM v_flagged UNION ALL SELECT 'remap', bad_code, good_code, trains FROM v_remap
""")
def repair_audit_files(net):
    """The audit of a repair, written as JSON and read back."""
    path = folder_of(net, "audit")
    _, stations = bad_network(net)
    bad = cut_lineage(flagged(net))
    sinks.write_json(sinks.repair_audit(repair.propose_remap(bad, stations, max_km=1500.0), bad), path)
    rows = net.spark.read.schema("section string, trains bigint, entry string").json(path)
    e = F.from_json("entry", "struct<code: string, bad_code: string, good_code: string>")
    return rows.select("section", F.coalesce(e["code"], e["bad_code"]).alias("code"), e["good_code"].alias("good_code"), "trains")


@query("SELECT f.*, true AS rising FROM v_fits f")
def fare_table_files(net):
    """The fare table written as JSON, read back: every class has its fit, and knots that rise."""
    path = folder_of(net, "fares")
    quotes = cut_lineage(net.quotes())
    fits = fares.fit_linear(quotes)
    sinks.write_json(sinks.fare_table(fares.stored_knots(fares.fit_isotonic(quotes)), fits), path)
    rows = net.spark.read.schema("class_code string, points array<array<double>>, fit struct<rate: double, base: double>").json(path)
    at = lambda i: F.transform("points", lambda p: F.get(p, F.lit(i)))
    rising = (F.size("points") > 1) & (at(0) == F.array_sort(at(0))) & (at(1) == F.array_sort(at(1)))
    return rows.select("class_code", "fit.rate", "fit.base", rising.alias("rising"))


# --- bucketed timetable --------------------------------------------------------------------------

@query(f"SELECT d.train_number, d.seq, s.day, round(d.detour_km, 3) + 0.0 AS detour_km FROM ({DETOUR}) d JOIN v_stops s USING (train_number, seq)")
def bucketed_timetable(net):
    """Journey days and detours of the timetable's stops, read from a table in buckets by train and segment."""
    path = f"{scratch_folder(net.spark, 'wayframe-buckets')}/stops"
    stops = sinks.bucketed_by_segment(net.stops().drop("day"), path, ["train_number"], "seq", 16)
    days = timetable.infer_day(stops).select("train_number", "seq", "day")
    detours = timetable.stop_detour(stops, some_unplaced(net)).select("train_number", "seq", "detour_km")
    return days.join(detours, ["train_number", "seq"]).select("train_number", "seq", "day", (F.round("detour_km", 3) + 0.0).alias("detour_km"))
