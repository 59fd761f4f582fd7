"""Named graphs as folders: what is read follows the graphs that are asked for."""

from collections import Counter

from pyspark.sql import functions as F

from vellum.operators import retrieve


def triples(spark):
    t = spark.range(600).select(
        F.concat(F.lit("g"), F.pmod("id", F.lit(6))).alias("graph"), F.concat(F.lit("s"), F.floor(F.col("id") / 6)).alias("s"), F.when(F.col("id") % 5 == 0, "name").otherwise("nick").alias("p"),
        F.col("id").cast("string").alias("o")
    )
    return t.unionByName(spark.createDataFrame([(None, "s0", "name", "x"), ("a/b c=d", "s1", "name", "y")], "graph string, s string, p string, o string"))


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.nodeName().startswith("Adaptive") else plan
    found = []

    def walk(p):
        if p.nodeName().startswith("Scan parquet"):
            found.append(p.metrics().apply("numFiles").value())
        p = p.plan() if p.nodeName().endswith("QueryStage") else p
        for i in range(p.children().size()):
            walk(p.children().apply(i))

    walk(plan)
    return sum(found)


def test_folders_of_other_graphs_are_not_read(spark, tmp_path):
    path = str(tmp_path / "graphs")
    retrieve.write_graphs(triples(spark), path, files=2)
    spark.createDataFrame([("g1", 1), ("g4", 1), ("g4", 1), ("g2", 0), ("none", 1)], "graph string, wanted int").write.parquet(str(tmp_path / "list"))
    wanted = spark.read.parquet(str(tmp_path / "list")).filter("wanted = 1")
    got = retrieve.read_graphs(spark, path, wanted)
    want = triples(spark).filter("graph IN ('g1', 'g4')")
    key = lambda d: Counter(tuple(r) for r in d.select("graph", "s", "p", "o").collect())
    assert key(got) == key(want)
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()
    one = retrieve.read_graphs(spark, path, wanted.filter("graph = 'g1'")).filter("p = 'name'")
    everything = spark.read.parquet(path)
    assert files_read(one) < files_read(everything)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p,name)" in plan


def test_odd_names_of_graphs(spark, tmp_path):
    path = str(tmp_path / "graphs")
    retrieve.write_graphs(triples(spark), path)
    ask = lambda *names: retrieve.read_graphs(spark, path, spark.createDataFrame([(n,) for n in names], "graph string")).count()
    assert ask("a/b c=d") == 1 and ask("g0", "g0") == 100 and ask("no such") == 0
    retrieve.write_graphs(triples(spark).limit(0), str(tmp_path / "empty"))
    assert retrieve.read_graphs(spark, str(tmp_path / "empty"), spark.createDataFrame([("g0",)], "graph string")).collect() == []
