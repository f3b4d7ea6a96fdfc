"""Gene sets read line by line."""

from strandframe.sources import tables


def test_gene_set_lines_are_split_once(spark, tmp_path):
    (tmp_path / "x.gmt").write_text("s1\td\ta\tb\t\tc\ns2\td\ns3\t\tz\n")
    out = tables.read_gmt(spark, str(tmp_path / "x.gmt"))
    assert sorted((r.gs_name, r.description, r.gene) for r in out.collect()) == [("s1", "d", "a"), ("s1", "d", "b"), ("s1", "d", "c"), ("s3", "", "z")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "split" not in plan[: plan.index("Generate")]
