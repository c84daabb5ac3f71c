"""Editor buffers with their text in state, over restarts, and a stream of catalogue files."""

from pyspark.sql import functions as F
from test_rules import catalogue

from polyglint.sources.po import CatalogueSource
from polyglint.streaming.editor import watch_buffers


def test_buffers(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / ".polyglint.toml").write_text('[check]\nselect = ["tabs", "pipes"]\n')
    (tmp_path / "bad" / "polyglint.toml").write_text("[check]\nshort_factor = 1\n")
    u, v = f"file://{tmp_path}/u.po", f"file://{tmp_path}/bad/v.po"
    tab, pipe, good = (catalogue(s, t).decode() for s, t in (("a\tb", "ab"), ("a", "😀|"), ("a", "b")))
    steps = [
        ([(u, "open", tab, 1), (v, "open", good, 1)], {u: ["tabs"], v: ["config-error"]}),
        ([(u, "change", pipe, 4), (u, "change", tab, 3)], {u: ["pipes"]}),
        ([(u, "change", good, 2), (u, "change", good, 4)], {}),  # late and repeated
        ([(u, "save", None, 5)], {u: ["pipes"]}),  # the text before
        ([(u, "close", None, 6), (v, "change", good, 2)], {u: [], v: ["config-error"]}),
        ([(u, "change", tab, 5)], {}),  # late, after the close
        ([(u, "open", good, 7)], {u: []}),
    ]
    schema, got = "uri string, event string, text string, seq long", []
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.createDataFrame([], schema).coalesce(1).write.json(str(tmp_path / "in"))
    try:
        for rows, want in steps:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            got.clear()
            query = watch_buffers(spark.readStream.schema(schema).json(str(tmp_path / "in")), lambda df, _: got.extend(df.collect()), checkpointLocation=str(tmp_path / "ck"), trigger={"availableNow": True})
            query.awaitTermination()
            assert {r.uri: [d.rule for d in r.diagnostics] for r in got} == want, rows
            for r in got:
                assert r.on_disk == (r.event in ("open", "save"))
                for d in r.diagnostics:
                    if d.rule == "pipes":
                        assert tuple(d.range)[1:] == (10, tuple(d.range)[0], 11)
    finally:
        spark.conf.set(key, before)


def test_stream_of_files(spark, tmp_path):
    spark.dataSource.register(CatalogueSource)
    (tmp_path / "po").mkdir()
    out = lambda: sorted((r.path.rsplit("/", 1)[1], r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    for k, names in enumerate((["a.po", "b.po"], ["c.po"])):
        for n in names:
            (tmp_path / "po" / n).write_bytes(catalogue(n, "x"))
        rows = spark.readStream.format("po").option("range", 60).load(str(tmp_path / "po")).filter("not is_header").select("path", F.col("msgid.value").alias("value"))
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
        assert out() == [(n, n) for n in ("a.po", "b.po", "c.po")[: 2 + k]]
