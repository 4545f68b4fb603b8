from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kabunoki.operators import publication as U
from kabunoki.operators.learning import Ridge
from kabunoki.sources import saved as S


def test_publish_and_read_back(spark, tmp_path):
    root = f"file://{tmp_path}/pub"
    with pytest.raises(FileNotFoundError):
        U.published(spark, root, "ranking")
    assert U.publish(spark, root, "r1", {"ranking": spark.range(3)})["rows"] == {"ranking": 3}
    U.publish(spark, root, "r2", {"ranking": spark.range(5), "empty": spark.range(0)})
    assert U.published(spark, root, "ranking").count() == 5 and U.published(spark, root, "empty").count() == 0
    with pytest.raises(ValueError):
        U.publish(spark, root, "../x", {})
    with pytest.raises(ValueError):
        U.published(spark, root, "../r1/ranking")
    assert not list((tmp_path / "pub").glob("*.tmp"))


def test_versions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    row = lambda v, n: spark.range(n).withColumn("version", F.lit(v))
    for v, n in (("a", 3), ("b", 2), ("a", 1)):
        U.replace_version(row(v, n), path, "version")
    assert {r.version: r["count"] for r in spark.read.parquet(path).groupBy("version").count().collect()} == {"a": 1, "b": 2}


def test_registry(spark, tmp_path):
    m = Ridge(["x_pct"], [0.5], [0.1], [2.0], 1.0, 10.0)
    U.save_models(spark, str(tmp_path), "run", {"6m": m}, {"ic": 0.1})
    assert U.load_models(spark, str(tmp_path), ["6m"]) == {"6m": m}
    with pytest.raises(KeyError):
        U.load_models(spark, str(tmp_path), ["12m"])


def test_model_inputs_take_the_last_calculation(spark):
    day = F.lit("2026-01-01").cast("date").alias("snapshot_date")
    ranks = spark.createDataFrame([("1", 2), ("2", 1)], "canonical_code string, rank_12m int").select(day, "*", F.lit("v").alias("ranking_version"))
    who = spark.createDataFrame([("1", "a", "s"), ("2", "b", "s")], "canonical_code string, company_name string, sector33_name string")
    feature = lambda name: spark.createDataFrame([("1", 1.0, 1), ("1", 2.0, 2)], f"canonical_code string, {name} double, calculated_at int").select(day, "*")
    out = U.model_inputs(ranks, who, feature("latest_close"), feature("per"), feature("document_count"), "2026-01-01", "v").collect()
    assert [r.canonical_code for r in out] == ["2", "1"] and (out[1].latest_close, out[1].per, out[1].qualitative_document_count) == (2.0, 2.0, 2.0) and out[0].per is None


def test_raw_content_is_kept_once(spark):
    known = spark.createDataFrame([], "content_hash string, source string, retrieved_at int")
    new = spark.createDataFrame([(b"abc", "s", 1), (b"abc", "s", 2), (b"d", "s", 1)], "content binary, source string, retrieved_at int")
    once = U.raw_manifest(known, new)
    assert once.count() == 2 and U.raw_manifest(once, new).count() == 2
    assert once.where("content_hash = 'ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad'").count() == 1


def test_runs_are_evaluated_and_applied(spark, tmp_path):
    root, out = f"file://{tmp_path}/models", f"file://{tmp_path}/pub"
    with pytest.raises(FileNotFoundError):
        U.latest_run(spark, root, ["6m"])
    model = Ridge(["per_pct", "roe_pct"], [0.5, 0.5], [0.25, 0.25], [-1.0, 2.0], 0.0, 1.0)
    rows = [(f"2025-0{m}-28", f"{i:02d}", float(i), i / 10.0, float(-i), "test") for m in (1, 2) for i in range(20)] + [("2025-03-28", "00", 9.0, 9.0, 9.0, "latest")]
    predictions = spark.createDataFrame(rows, "evaluation_date string, canonical_code string, prediction double, actual_return double, baseline_score double, split string")
    U.save_models(spark, root, "r1", {"6m": model, "12m": model}, {}, {"6m": predictions, "12m": predictions})
    U.save_models(spark, root, "r2", {"6m": model}, {}, {"6m": predictions})
    assert U.runs(spark, root) == ["r1", "r2"] and U.latest_run(spark, root, ["6m"]) == "r2" and U.latest_run(spark, root, ["6m", "12m"]) == "r1"
    got = {r.scored_by: r for r in U.evaluate_model(spark, root, "6m").collect()}
    assert got["model"].mean_spearman_ic == pytest.approx(1.0) and got["rule"].mean_spearman_ic == pytest.approx(-1.0) and got["model"].model_run == "r2" and got["model"].rows == 40
    inputs = spark.createDataFrame([("1001", 10.0, 0.1, 1), ("1002", 5.0, 0.2, 2), ("1003", None, None, 3)], "canonical_code string, per double, roe double, rank_6m int")
    inputs = inputs.withColumns({"snapshot_date": F.lit("2026-01-01").cast("date"), "rank_12m": F.col("rank_6m")})
    U.publish(spark, out, "d1", {"model_input_latest": inputs})
    ranked = U.infer_latest(spark, out, root)
    assert [(r.canonical_code, r.model_rank, r.rule_rank) for r in ranked["6m"].collect()] == [("1002", 1, 2), ("1003", 2, 3), ("1001", 3, 1)] and ranked["12m"].first().model_run == "r1"


def test_backup_and_copies(spark, tmp_path):
    table, to = f"file://{tmp_path}/t", f"file://{tmp_path}/backup/t-1"
    spark.range(10).repartition(3).write.parquet(table)
    one = U.backup(spark, table, to, "2026-01-01")
    two = U.backup(spark, table, f"file://{tmp_path}/backup/t-2", "2026-01-01")
    assert spark.read.parquet(to).count() == 10 and one["sha256"] == two["sha256"] and one["files"] >= 3 and (tmp_path / "backup/t-1.json").exists()
    with pytest.raises(FileNotFoundError):
        U.backup(spark, table + "-none", to + "x", "")
    for text in ("a", "b"):
        (tmp_path / "report.txt").write_text(text)
        U.copy_file(spark, f"file://{tmp_path}/report.txt", f"file://{tmp_path}/out/report.txt")
        assert (tmp_path / "out/report.txt").read_text() == text and not list((tmp_path / "out").glob("*.tmp"))


def test_saved_responses_and_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"Date": "2026-01-05", "Code": "72030", "O": 1.5, "C": "x"}]}')
    (tmp_path / "b.json").write_text('{"data": [], "daily_quotes": [{"Date": "20260106", "Code": 72030, "Open": "2", "AdjustmentClose": null}]}')
    (tmp_path / "c.json").write_text("not json")
    got = S.bars(S.responses(spark, f"{tmp_path}/*.json")).orderBy("trade_date").collect()
    assert [(str(r.trade_date), r.code, r.open, r.close, r.adjusted_close) for r in got] == [("2026-01-05", "72030", 1.5, None, None), ("2026-01-06", "72030", 2.0, None, None)]
    filed = spark.createDataFrame([('{"data": [{"DiscNo": "1", "DiscDate": "", "Sales": "", "EPS": "NaN", "ROE": "0.1"}]}',)], "content string").withColumn("retrieved_at", F.current_timestamp())
    (r,) = S.filings(filed).collect()
    assert (r.disclosure_number, r.disclosure_date, r.sales, r.eps, r.roe) == ("1", None, None, None, 0.1)
    with pytest.raises(ValueError):
        S.filing_query()
    with pytest.raises(ValueError):
        S.filing_query("1", "2026-01-01")
    assert S.filing_query(date="2026-01-05") == {"date": "20260105"}
    (tmp_path / "t.txt").write_text("売上\nは増加")
    (t,) = S.texts(S.responses(spark, f"{tmp_path}/t.txt"), "7203.T", "2026-01-05", "t", "u").collect()
    assert t.text_content == "売上\nは増加" and t.canonical_code == "7203" and t.document_id == f"manual:7203.T:2026-01-05:{t.content_hash[:16]}" and len(t.content_hash) == 64
    S.write_csv(spark.createDataFrame([(1, 'a"b,\nc'), (2, None)], "k int, v string"), f"{tmp_path}/csv", mark=True)
    (file,) = (tmp_path / "csv").glob("part-*.csv")
    assert file.read_bytes().startswith(b"\xef\xbb\xbfk,v")
    assert {(r.k, r.v) for r in S.read_csv(spark, f"{tmp_path}/csv", "k int, v string").collect()} == {(1, 'a"b,\nc'), (2, None)}
    assert S.register(spark.range(3), "some_view").count() == 3 and spark.sql("SELECT count(*) AS n FROM some_view").first().n == 3


def test_sessions_and_folders(spark):
    from kabunoki import session

    assert session.session().sparkContext.applicationId == spark.sparkContext.applicationId
    assert "kabunoki" in session.workspace(spark) and session.workspace(spark) == session.workspace(spark)
