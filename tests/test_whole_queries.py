"""Queries over whole tables reach all rows, texts and keys; their SQL is compared in test_queries.py."""

from conftest import SMALL

from factloom import queries

ALL = queries.queries()


def test_normalized_reads_whole_texts_of_all_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a" * 40 + "b"), (2, "A" * 40 + "c"), (3, " " + "a" * 40 + "B\n"), (4, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.n for r in ALL["fn_04_normalized"](spark, str(tmp_path)).collect()] == [2]


def test_every_file_has_a_score(spark):
    files = ALL["agg_05_file_statistics"](spark, SMALL).count()
    assert ALL["agg_03_score_by_file"](spark, SMALL).count() == files


def test_diffs_reach_all_lines(spark):
    found = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr("l_orderkey % 2 AS side", "l_linenumber AS line", "concat(l_partkey % 2000, '|', l_suppkey % 7) AS key").collect()
    base, head = ({r.key for r in found if r.side == k} for k in (0, 1))
    lines = lambda side, other: sorted(r.line for r in found if r.side == side and r.key not in other)
    for name, wanted in (("join_13_new", lines(1, base)), ("join_14_resolved", lines(0, head))):
        assert sorted(r.line for r in ALL[name](spark, SMALL).collect()) == wanted
        assert max(wanted) > 2


def test_flows_batches_and_sort_take_all_rows(spark):
    pairs = ALL["join_05_flow_pairs"](spark, SMALL).agg({"pairs": "sum"}).first()[0]
    assert ALL["join_05_flow"](spark, SMALL).count() == pairs
    ids = [r.fact_id for r in ALL["srt_01_by_id"](spark, SMALL).collect()]
    assert len(ids) == ALL["src_02_fact_count"](spark, SMALL).first().n and ids == sorted(ids)
    fingerprints = spark.read.parquet(f"{SMALL}/lineitem.parquet").selectExpr("concat(l_partkey % 2000, '|', l_suppkey % 7) AS k").distinct().count()
    assert ALL["mut_01_upsert"](spark, SMALL).where("project = 'project-3' AND updated_at = '2000-01-01 00:00:00'").count() == fingerprints


def test_graph_has_full_keys_of_all_rows(spark, tmp_path):
    """A chain 3 -> 4 -> ... -> 59 and one edge back, against a breadth-first search; no row has l_orderkey % 40 = l_linenumber."""
    ends = [(k, k + 1) for k in range(3, 59)] + [(20, 5), (70, 71)]
    spark.createDataFrame([(k,) for k in range(100)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(39, 1, a, b + 100) for a, b in ends], "l_orderkey long, l_linenumber int, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    depth, todo = {3: 0}, [3]
    for a in todo:
        for b in (y for x, y in ends if x == a and y not in depth):
            depth[b] = depth[a] + 1
            todo.append(b)
    assert {r.node: r.depth for r in ALL["graph_02_distances"](spark, str(tmp_path)).collect()} == depth
    assert ALL["graph_02_shortest_path"](spark, str(tmp_path)).first().steps == 5
    assert tuple(ALL["graph_03_size"](spark, str(tmp_path)).first()) == (len(ends), len({a for a, _ in ends}))
