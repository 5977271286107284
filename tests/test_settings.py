import pytest
from pyspark.sql import functions as F

from rillflow.plans import config, spec
from rillflow.plans.pipeline import Pipeline
from rillflow.rowkind import OP
from rillflow.sources import sinks
from rillflow.streaming.metrics import Progress, observed


def test_layers(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("job_mode: true\nprint_sink: {sample_every: 5}\n")
    got = config.settings(str(f), {"RILLFLOW__PRINT_SINK__SAMPLE_EVERY": "7", "RILLFLOW__NEW__A__B": "x", "OTHER": "1"})
    assert got["job_mode"] is True and got["print_sink"]["sample_every"] == 7 and got["new"]["a"]["b"] == "x" and got["kafka_source"]["bootstrap_servers"] == "localhost:9092"
    assert config.settings(None, {})["job_mode"] is False


def test_observed_counts(spark):
    df, seen = observed(spark.createDataFrame([(1, "i"), (5, "u"), (3, "d")], f"t int, {OP} string"), "m", "t")
    df.count()
    assert seen.get == {"rows": 3, "updates": 1, "deletes": 1, "latest": 5}


def test_listener_and_sample(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id\n1\n2\n")
    p = Pipeline(spark, {"sources": {"s": {"type": "file", "format": "csv", "path": str(tmp_path / "in")}}, "sinks": {"b": {"type": "blackhole", "from": "s"}}})
    assert p.sample("s", 1) == [{"id": 1, OP: "i"}]
    listener = Progress()
    p.session.spark.streams.addListener(listener)
    p.run("available_now")
    p.session.spark.streams.removeListener(listener)


def test_wide_decimals_are_kept_from_narrow_sinks(spark):
    df = spark.createDataFrame([("1",)], "d string").select(F.col("d").alias("d", metadata={"decimal_arb": {"p": 100, "s": 0}}))
    sinks.checked_decimals(df, spec.Node("a", "postgres", {}))
    with pytest.raises(spec.SpecError):
        sinks.checked_decimals(df, spec.Node("a", "kafka", {}))
