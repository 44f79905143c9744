"""Cross references: clauses within names are found by equal pieces, with the results of trying all pairs."""

from pyspark.sql import functions as F

from tideline.operators import graph as gr


def test_cross_references_against_all_pairs(spark):
    names = ["Hot bolt", "hot", "BOLT", "a", "", "x" * 40 + "end", "hot bolt", "é bolt", None]
    entities = [(i, n, str(i % 2)) for i, n in enumerate(names * 2)]
    edges = [(i, (i * 5 + 1) % 18, ("similar_to", "equivalent_to", "other")[i % 3], (0.9, 0.81, 0.8, None)[i % 4]) for i in range(18)] + [(0, 7, "similar_to", 0.95), (9, 2, "similar_to", 0.95)]
    asked = [(c, s, t) for c in ("hot", "bolt", "", "BOLT", "x" * 35, "x" * 33 + "e", "é", "none", None) for s in "01" for t in "01"] * 2
    want = set()
    for c, s, t in {a for a in asked if a[0] is not None}:
        hits = [(-w, i, j) for i, j, kind, w in edges if kind != "other" and w and w > 0.8 and entities[i][1] is not None and c.lower() in entities[i][1].lower() and entities[i][2] == s and entities[j][2] == t]
        if hits:
            w, i, j = min(hits)
            want.add((c, s, t, i, j, entities[j][1], -w))
    got = gr.cross_references(
        spark.createDataFrame(entities, "entity_id long, name string, society string"), spark.createDataFrame(edges, "src long, dst long, rtype string, confidence double"), spark.createDataFrame(asked, "clause string, society string, target string")
    )
    assert want and sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_no_pairs_are_tried(spark):
    """A join on the society alone made a row of every clause and name of it (F4, F5)."""
    entities = spark.range(4000).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit("0").alias("society")).withColumnRenamed("id", "entity_id")
    edges = spark.range(4000).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("similar_to").alias("rtype"), F.lit(0.9).alias("confidence"))
    asked = entities.select(F.col("name").alias("clause"), "society", F.lit("0").alias("target"))
    found = gr.cross_references(entities, edges, asked)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 4000
    assert not any("Join" in line and "Contains(" in line and "piece" not in line for line in plan.splitlines())
