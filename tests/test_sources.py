import json
import struct

import pytest
from pyspark.sql import functions as F

from skeinflow.functions import jsonfns
from skeinflow.operators.frame import RID, from_lists
from skeinflow.sources import arrowio, container, database, datalog, media, msgpack, text, trials


def test_container_round_trips(spark, tmp_path):
    df = from_lists(spark, id=[1, 2, 3], s=["a", "b", ""], f=[0.5, 1.5, 2.5], n=[[1, 2], [], [3]])
    for suffix in ("dg", "dgz", "lz4"):
        path = str(tmp_path / f"x.{suffix}")
        container.write_group(df, path)
        got = container.read_groups(spark, path).orderBy(RID).collect()
        assert [(r.id, r.s, r.f, r.n) for r in got] == [(1, "a", 0.5, [1, 2]), (2, "b", 1.5, []), (3, "", 2.5, [3])]
    assert container.read_groups(spark, str(tmp_path / "x")).count() == 3
    with pytest.raises(Exception, match="no_such"):
        container.read_groups(spark, str(tmp_path / "no_such.dgz")).count()


def test_container_bytes():
    g = container.Group("g", {"a": container.TypedList("short", [1, -2]), "b": container.TypedList("list", [container.TypedList("string", ["x"]), container.TypedList("float", [1.5])])})
    assert container.decode(container.encode(g)) == g
    assert container.from_base64(container.to_base64(g)) == g
    assert container.list_from_base64(container.list_to_base64(g.columns["a"])) == g.columns["a"]
    with pytest.raises(ValueError):
        container.decode(container.encode(g)[:-9])
    with pytest.raises(ValueError):
        container.decode(b"nothing")


def test_text(spark, tmp_path):
    p = tmp_path / "t.txt"
    p.write_text("# a b\n 1 2.5\n3  4\n")
    assert [tuple(r) for r in text.read_ascii(spark, str(p)).collect()] == [(1.0, 2.5), (3.0, 4.0)]
    assert [tuple(r) for r in text.read_ascii(spark, str(p), "b:int:1", "a:string:0").collect()] == [(2, "1"), (4, "3")]
    with pytest.raises(Exception, match="missing"):
        text.read_ascii(spark, str(p), "c:float:5").collect()
    text.write_csv(from_lists(spark, a=[1, 2], l=[[1], [2, 3]]), str(tmp_path / "csv"))
    assert sorted(x for f in (tmp_path / "csv").glob("*.csv") for x in f.read_text().splitlines()) == ["1,[1]", '2,"[2,3]"', "a,l"]


def test_arrow(spark, tmp_path):
    df = spark.range(10).select("id", F.array(*(F.lit(i / 10) for i in range(5))).alias("colors"))
    assert [tuple(r) for r in arrowio.from_arrow(spark, arrowio.to_arrow(df)).orderBy("id").collect()] == [tuple(r) for r in df.collect()]
    arrowio.write_arrow(df, str(tmp_path / "x.arrow"))
    assert arrowio.read_arrow(spark, str(tmp_path / "x.arrow")).count() == 10
    assert arrowio.rectangular(df)


def test_msgpack():
    for x in (None, True, False, 0, 127, 128, 70000, -1, -33, -40000, 1 << 40, 1.5, "é" * 40, b"\x00" * 300, [1, [2, "x"]], {"a": list(range(20)), "b": {}}, "x" * 70000):
        assert msgpack.unpack(msgpack.pack(x)) == x


def test_json(spark):
    df = spark.createDataFrame([('{"a":[{"b":5}],"c":null}',), ("[1]",), ("{x",)], "j string")
    got = df.select(jsonfns.get("j", "a.0.b").alias("g"), jsonfns.valid("j").alias("v"), jsonfns.kind("j").alias("k"), jsonfns.kind("j", "c").alias("c")).collect()
    assert [tuple(r) for r in got][:2] == [("5", True, "object", "null"), ("", True, "array", "")] and got[2].v is False
    h = jsonfns.hybrid_json(spark.createDataFrame([(0, 1, [1, 2]), (1, 2, [3])], "o int, s int, l array<int>"), "o", "g").first()["json"]
    assert json.loads(h) == {"name": "g", "rows": [{"s": 1, "l": 0}, {"s": 2, "l": 1}], "arrays": {"l": [[1, 2], [3]]}}


def test_datalog(spark, tmp_path):
    path = str(tmp_path / "x.log")
    begin, other, end = (datalog.event_kind(k, 1) for k in (datalog.BEGIN_OBS, 5, datalog.END_OBS))
    points = [
        datalog.Datapoint("v", 1_500_000, 0, datalog.TYPES.index("float"), struct.pack("<2f", 1.5, 2.5)), datalog.Datapoint("s", 1_600_000, 0, datalog.TYPES.index("string"), b"hi"),
        datalog.Datapoint("e", 2_000_000, 0, begin, struct.pack("<i", 7)), datalog.Datapoint("e", 2_010_000, 0, other, b""), datalog.Datapoint("e", 2_020_000, 0, end, b""),
    ]
    datalog.write_log(path, 1_000_000, points)
    rows = datalog.read_log(spark, path).orderBy("n").collect()
    assert [(r.varname, r.seconds, r.numbers, r.text) for r in rows[:2]] == [("v", 0.5, [1.5, 2.5], ""), ("s", 0.6, [], "hi")]
    o = datalog.read_observations(spark, path).collect()
    assert [(r.e_types, r.e_times, r.e_params, r.obs_times) for r in o] == [([19, 5, 20], [0, 10, 20], [[7.0], [], []], 0)]
    datalog.register(spark)
    feed = spark.readStream.format("skein_log").option("path", path).load()
    q = feed.writeStream.format("memory").queryName("log").trigger(once=True).start()
    q.awaitTermination(60)
    assert spark.table("log").count() == 5


def test_media_and_sqlite(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(media.wav_bytes([0, 100, -100], 8000))
    r = media.read_wav(spark, str(tmp_path / "a.wav")).first()
    assert (r.rate, r.samples) == (8000, [0, 100, -100])
    assert media.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == ("gif", 3, 4)
    import sqlite3

    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table t(a int, b text)")
        db.execute("insert into t values (1, 'x')")
    assert database.sqlite_query(spark, str(tmp_path / "d.db"), "select * from t").first().b == "x"


def test_trials(spark, tmp_path):
    row = ("f", 0, "t", "", 1, 0, 100, [(3, 10, [1]), (4, 20, [2])], (2.0, 0, [1.0, 2.0, 3.0, 4.0], [0.0] * 4), [(1, [5.0, 15.0, 25.0])])
    spark.createDataFrame([row], trials.SCHEMA).write.parquet(str(tmp_path / "t"))
    x = trials.Trials(spark)
    h = x.open(str(tmp_path / "t"))
    assert x.events(h).count() == 2
    assert x.spikes(h, 1, F.lit(5.0), F.lit(25.0), F.lit(5.0)).first().times == [10.0, 20.0]
    assert x.eye(h, F.lit(2), F.lit(4), F.lit(0), F.lit(2)).first().h == [1.5, 2.5]
    x.set(h, "title", F.lit("new"), 0)
    assert x.get(h, "title").first().value == "new"
