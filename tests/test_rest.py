import io
import json

import pytest

from semclean import cli, evaluate, streaming
from semclean.config import load_config
from semclean.evaluate import Case, Evaluator
from semclean.providers import create_provider
from semclean.session import SemClean, get_provider
from semclean.sources import runner
from semclean.tracking import ParquetTracker


def test_config_order(monkeypatch, tmp_path):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "pyproject.toml").write_text('[tool.semclean]\nmodel = "file"\nhost = "h"\n')
    assert (load_config().model, load_config().host) == ("file", "h")
    monkeypatch.setenv("SEMCLEAN_MODEL", "env")
    monkeypatch.setenv("SEMCLEAN_VERBOSE", "Yes")
    assert load_config().model == "env" and load_config().verbose is True
    assert load_config(model="now").model == "now"
    with pytest.raises(ValueError):
        load_config(colour="red")


def test_providers():
    with pytest.raises(NotImplementedError):
        create_provider("openai")
    assert get_provider() is get_provider() and get_provider(engine="rules") is not get_provider()


def run(spark, text):
    out = io.StringIO()
    code = runner.main(spark, io.StringIO(text), out)
    return code, json.loads(out.getvalue())


def test_runner(spark):
    code, out = run(spark, json.dumps({"data": [{"w": "5 kg", "n": 1}, {"w": None, "x": 2.5}], "target_col": "w"}))
    assert code == 0 and out["row_count"] == 2 and {r["clean_value"] for r in out["data"]} == {5.0, None}
    assert run(spark, "{")[0] == 1 and run(spark, '{"data": []}')[0] == 1 and run(spark, "[1]")[0] == 1
    code, out = run(spark, json.dumps({"data": [{"w": "1"}], "target_col": "zz"}))
    assert code == 2 and out["status"] == "error"


def test_metrics():
    assert evaluate.exact_match(" a\n", "a")[0] == 1.0
    assert evaluate.partial_json_match('{"a": 1, "b": 3}', '{"a": 1, "b": 2}')[0] == 0.5
    assert evaluate.partial_json_match("x", "{}")[0] == 0 and evaluate.partial_json_match("{}", "{}")[0] == 1
    assert evaluate.pii_masking_recall("[EMAIL] b", "", {"pii_tokens": ["a", "b"]})[0] == 0.5
    with pytest.raises(ValueError):
        evaluate.get_metric("x")


def test_evaluator(spark, tmp_path):
    tracker = ParquetTracker(spark, str(tmp_path / "runs"))
    cases = [
        Case("a@b.co", "[EMAIL]", "scrub", metadata={"strategies": ["email"]}),
        Case("name: x", '{"name": "x"}', "extract", "partial_json_match", {"fields": ["name:str"]}),
        Case("x", "y", "nonsense"),
    ]
    summary = Evaluator(tracker=tracker).run(cases)
    assert [r.score for r in summary.results] == [1, 1, 0] and summary.pass_rate == pytest.approx(2 / 3)
    assert spark.read.parquet(str(tmp_path / "runs")).filter("kind = 'score'").count() == 4


def test_shell():
    out = io.StringIO()
    lines = ["/help\n", "/mode scrub\n", "mail a@b.co\n", "/mode nope\n", "/schema name:str\n", "/schema x:y\n", "/mode extract\n", "name: Bo\n", "/model\n", "/what\n", "/quit\n", "never\n"]
    cli.shell(cli.State(), io.StringIO("".join(lines)), out)
    said = out.getvalue()
    assert "mail [EMAIL]" in said and '"name":"Bo"' in said and "Unknown mode" in said and "Unknown type" in said and "never" not in said


def test_cli_files(spark, tmp_path):
    spark.createDataFrame([("a@b.co",)], "t string").write.parquet(str(tmp_path / "in"))
    assert cli.main(["scrub", str(tmp_path / "in"), str(tmp_path / "out"), "--column", "t"]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).first().t == "[EMAIL]"


def test_facade(spark):
    df = spark.createDataFrame([("3 kg", "x")], "w string, t string")
    assert SemClean().clean(df, "w").first().clean_value == 3.0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a@b.co 5 kg",), (None,)], "t string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = streaming.clean_stream(streaming.scrub_stream(stream, "t", ["email"]), "t")
    query = out.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(60)
    assert {(r.t, r.clean_value) for r in spark.table("cleaned").collect()} == {("[EMAIL] 5 kg", 5.0), (None, None)}
    query = streaming.for_each_batch(stream, lambda b: b.limit(1), str(tmp_path / "o"), str(tmp_path / "c2"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
