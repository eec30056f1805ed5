"""Targets of the command line."""

import pytest

from quantloom import cli

SF = "/root/testdata/sf0.001"


def test_every_target_names_registered_queries():
    assert len(cli.TARGETS) == 10
    for target in cli.TARGETS:
        for method in cli.METHODS:
            for graph in cli.GRAPHS:
                for clustering in cli.CLUSTERINGS:
                    names = cli.Options(method=method, graph=graph, clustering=clustering).names(target)
                    assert set(names) <= set(cli.registered())


def test_a_target_writes_its_results(spark, tmp_path, capsys):
    assert cli.main(["run", "gen_risk", SF, str(tmp_path), "--start", "1998-01-01", "--end", "1998-12-31"], spark) == 0
    assert capsys.readouterr().out.split() == list(cli.TARGETS["gen_risk"])
    got = spark.read.parquet(f"{tmp_path}/gen_risk/fac_size")
    assert {r[0] for r in got.selectExpr("year(trade_date)").distinct().collect()} == {1998}
    assert cli.main(["run", "backtest_factor", SF, str(tmp_path)], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/backtest_factor/factor_record").count() == 1  # results without dates are whole


def test_unknown_names_are_refused(capsys):
    for args in (["run", "nothing", SF, "out"], ["no_query", SF], ["ic"]):
        with pytest.raises(SystemExit):
            cli.main(args)
    assert cli.main(["list"]) == 0
    assert "perf_stats" in capsys.readouterr().out
