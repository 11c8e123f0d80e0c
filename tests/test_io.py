"""Sources, sinks and streams."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.sources import ods, tabular
from tessera.streaming import windows


def test_csv_round_trip_and_bad_rows(spark, tmp_path):
    text = 'id,name,note\n1," a ","x, ""y""\nz"\n2,only two\n,,\n3,c,\n'
    (tmp_path / "in.csv").write_text(text)
    df = tabular.read_csv(spark, str(tmp_path / "in.csv"), ["id", "name", "note"])
    want = [("1", "a", 'x, "y"\nz'), ("3", "c", "")]
    assert sorted(map(tuple, df.collect())) == want
    assert df.select("id").count() == 2
    tabular.write_csv(df, str(tmp_path / "out"), single=True)
    assert sorted(map(tuple, tabular.read_csv(spark, str(tmp_path / "out"), ["id", "name", "note"]).collect())) == want


def test_scans(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, v int")
    assert [r["id"] for r in tabular.after(df, "id", 6, 2).collect()] == [7, 8]
    hit, lack = tabular.cached_or_new(spark.createDataFrame([(1,), (99,)], "id int"), df, ["id"])
    assert [r["id"] for r in hit.collect()] == [1] and [r["id"] for r in lack.collect()] == [99]
    good, bad = tabular.split_valid(spark.createDataFrame([(1,), (-1,), (None,)], "x int"), F.col("x") > 0)
    assert (good.count(), bad.count()) == (1, 2)


def test_bulk_load(spark):
    csv = spark.createDataFrame([("1", "a; b"), ("2", "b;"), ("3", "")], "id string, tags string")
    out = tabular.bulk_load(csv, "id", {"tags": "tag"})
    assert sorted(r["tag"] for r in out["tag"].collect()) == ["a", "b"]
    assert out["id_tag"].count() == 3


def test_ods_round_trip(spark, tmp_path):
    ods.register(spark)
    df = spark.createDataFrame([(1, "a & b\nc", None), (2, "https://x.org/?a=1&b=2", 2.5)], "id int, s string, x double").repartition(1)
    df.write.format("ods").option("path", str(tmp_path / "o")).mode("append").save()
    back = ods.read_ods(spark, str(tmp_path / "o"), ["id", "s"])
    assert sorted(map(tuple, back.collect())) == [("1", "a & b\nc"), ("2", "https://x.org/?a=1&b=2")]
    with pytest.raises(ValueError, match="no sheet"):
        list(ods.filled_runs(next((tmp_path / "o").glob("*.ods")).read_bytes(), "other"))
    df.limit(1).write.format("ods").option("path", str(tmp_path / "o")).mode("append").save()
    assert ods.read_ods(spark, str(tmp_path / "o"), ["id"]).count() == 3
    df.limit(1).write.format("ods").option("path", f"file://{tmp_path}/o").mode("overwrite").save()
    assert [tuple(r) for r in ods.read_ods(spark, str(tmp_path / "o"), ["id"]).collect()] == [("1",)]
    assert not list((tmp_path / "o").glob("_temporary*"))


def test_ods_repeats_and_spaces(spark, tmp_path):
    cell = lambda t, n=1: f'<table:table-cell table:number-columns-repeated="{n}">{t}</table:table-cell>'
    row = lambda cells, n=1: f'<table:table-row table:number-rows-repeated="{n}">{cells}</table:table-row>'
    p = lambda t: f"<text:p>{t}</text:p>"
    spaced = p('a<text:s text:c="3"/>b<text:tab/>c<text:line-break/>d')
    note = "<office:annotation>" + p("a note") + "</office:annotation>"
    body = row(cell(p("x")) + cell("", 2) + cell(p("y")) + cell("", 16_000)) + row(cell("", 1), 1_000_000) + row(cell(p("1"), 5), 5000) + row(cell(note + spaced) + '<table:covered-table-cell/>' + cell("") + cell(p("&lt;") + p("2")), 1) + row(cell(""), 1_048_576)
    one = ods.build(["x"], iter(()), "first")
    import io
    import zipfile

    xml = zipfile.ZipFile(io.BytesIO(one)).read("content.xml").decode().replace("</table:table>", '</table:table><table:table table:name="second">' + body + "</table:table>")
    with zipfile.ZipFile(tmp_path / "a.ods", "w") as z:
        z.writestr("content.xml", xml)
    found = ods.read_ods(spark, str(tmp_path / "a.ods"), ["y", "x"], "second").collect()
    assert len(found) == 5001 and tuple(found[0]) == ("1", "1") and tuple(found[-1]) == ("<\n2", "a   b\tc\nd")
    assert [(r.row, r.rows) for r in ods.filled_runs((tmp_path / "a.ods").read_bytes(), "second")] == [(0, 1), (1_000_001, 5000), (1_005_001, 1)]


def test_stream_rate_limit_like_batch(spark, tmp_path):
    frame = pd.DataFrame({"k": ["a"] * 6, "ms": [0, 10, 20, 99, 100, 250], "id": range(6)})
    spark.createDataFrame(frame).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ms long, id long").parquet(str(tmp_path / "in"))
    q = windows.rate_limit(stream, "k", "ms", "id", 2, 100).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["id"], r["count"], r["allowed"]) for r in spark.sql("select * from limited order by id").collect()] == [(0, 1, True), (1, 2, True), (2, 3, False), (3, 4, False), (4, 1, True), (5, 1, True)]


def test_stream_rate_limit_over_many_frames(spark, tmp_path):
    n = 25_000
    spark.createDataFrame([("a", n - i, i) for i in range(n)], "k string, ms long, id long").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ms long, id long").parquet(str(tmp_path / "in"))
    for late in (None, "1 hour"):
        name = f"many{bool(late)}"
        windows.rate_limit(stream, "k", "ms", "id", 10, 10_000, late).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        found = {r["id"]: (r["count"], r["allowed"]) for r in spark.table(name).collect()}
        assert found == {i: ((n - i - 1) % 10_000 + 1, (n - i - 1) % 10_000 < 10) for i in range(n)}


def test_stream_upsert(spark, tmp_path):
    schema = "k int, v string, at int"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        windows.upsert_batches(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["k"], "at", str(tmp_path / "t"), str(tmp_path / "s")).awaitTermination()
        return sorted(map(tuple, windows.upserted(spark, str(tmp_path / "t"), spark.createDataFrame([], schema).schema).select("k", "v", "at").collect()))

    assert feed([(1, "a", 1), (2, "old", 1), (2, "b", 5), (2, "older", 0)]) == [(1, "a", 1), (2, "b", 5)]
    assert feed([(2, "late", 3), (1, "same", 1), (3, "c", 2)]) == [(1, "same", 1), (2, "b", 5), (3, "c", 2)]


def test_upserts_leave_no_copies(spark, tmp_path):
    """Batches replace buckets whole, a batch that runs again changes nothing, another stream goes on, and old versions go."""
    schema = "k int, v string, at int"
    table = str(tmp_path / "t")

    def feed(state, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / state / "in"))
        windows.upsert_batches(spark.readStream.schema(schema).parquet(str(tmp_path / state / "in")), ["k"], "at", table, str(tmp_path / state / "s")).awaitTermination()

    want = {}
    for i in range(5):
        rows = [(k, f"{i}-{k}", i) for k in range(0, 40, i + 1)]
        feed("one" if i < 3 else "two", rows)
        want |= {k: (v, at) for k, v, at in rows}
        found = windows.upserted(spark, table, spark.createDataFrame([], schema).schema).collect()
        assert {r["k"]: (r["v"], r["at"]) for r in found} == want and len(found) == len(want)
    assert len(list((tmp_path / "t" / "manifest").iterdir())) == 2
    buckets = len({p.name for p in (tmp_path / "t" / "data").glob("*/bucket=*")})
    assert len(list((tmp_path / "t" / "data").glob("*/bucket=*"))) <= 2 * buckets
    # the manifest of the newest batch is lost, as in a crash before it was written: the batch is taken in again
    newest = max((tmp_path / "t" / "manifest").iterdir(), key=lambda p: int(p.name))
    (newest / "_SUCCESS").unlink()
    before = windows.upserted(spark, table, spark.createDataFrame([], schema).schema).count()
    assert before == len(want)
    assert windows.upserted(spark, str(tmp_path / "nothing"), spark.createDataFrame([], schema).schema).count() == 0


def test_ods_types_and_names(spark):
    import datetime
    import decimal
    import io
    import zipfile
    from xml.etree import ElementTree

    rows = [(True, 3, 2.5, decimal.Decimal("1.50"), datetime.date(2024, 5, 1), datetime.datetime(2024, 5, 1, 10, 30), "a <b>\n&c", "https://x.org/?a=1&b=2", None)]
    raw = ods.build([f"c{i}" for i in range(9)], iter(rows), "a[b]/c'd" + "x" * 40)
    z = zipfile.ZipFile(io.BytesIO(raw))
    assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and z.read("mimetype").decode() == ods.MIME
    root = ElementTree.fromstring(z.read("content.xml"))
    sheet = next(root.iter(f"{{{ods.TABLE}}}table"))
    assert sheet.get(f"{{{ods.TABLE}}}name") == ("a_b__c_d" + "x" * 40)[:31]
    cells = list(sheet)[1]
    kinds = [c.get(f"{{{ods.OFFICE}}}value-type") for c in cells]
    assert kinds == ["boolean", "float", "float", "float", "date", "date", "string", "string", None]
    assert [c.get(f"{{{ods.OFFICE}}}{a}") for c, a in zip(cells, ["boolean-value", "value", "value", "value", "date-value", "date-value"], strict=False)] == ["true", "3", "2.5", "1.50", "2024-05-01", "2024-05-01T10:30:00"]
    assert ["".join(p.itertext()) for p in cells[6]] == ["a <b>", "&c"] and next(cells[7].iter(f"{{{ods.TEXT}}}a")).get(f"{{{ods.XLINK}}}href") == rows[0][7]


def test_sweep_takes_old_tables_only(spark):
    import time

    from tessera import storage

    kept = storage.stored(spark.range(3), "swept")
    name = kept._stored_at.rsplit("/", 1)[1]
    assert name not in storage.sweep(spark, 3600) and kept.count() == 3
    assert name in storage.sweep(spark, 3600, time.time() + 7200)
    assert not storage.exists(spark, kept._stored_at)
