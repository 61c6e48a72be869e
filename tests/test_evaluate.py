import pytest

from foliant.operators import evaluate as E


def _frames(spark):
    truth = [(1, "# A\n| x | y |\n| x |\nsame  line\nlast"), (2, None), (3, ""), (4, "only here"), (5, "| |\n|\n####### no\n## b")]
    predicted = [("a", 1, "last\n# A\n|x|z|\nsame  line"), ("a", 3, ""), ("a", 5, " | |\n|\n## c"), ("b", 1, truth[0][1]), ("b", 2, "more")]
    return spark.createDataFrame(truth, "doc_id long, text string"), spark.createDataFrame(predicted, "engine string, doc_id long, text string")


def test_scores_of_pairs(spark):
    got = {(r.engine, r.doc_id): r for r in E.evaluate_corpus(*_frames(spark), ("a", "b"), 3).collect()}
    a = got["a", 1]
    assert (a.tokens, a.order, a.heading, a.heading_s) == (pytest.approx(2 * 5 / (13 + 6)), 0.5, 1.0, 1.0)
    assert (a.table, a.table_s) == (pytest.approx(2 * 1 / 5), pytest.approx(2 * 1 / 3)) and not a.table_timed_out
    assert (got["b", 1].overall, got["b", 1].order) == (1.0, 1.0)
    assert [(got["a", d].tokens, got["a", d].order, got["a", d].table, got["a", d].heading) for d in (2, 3, 4)] == [(1.0, None, None, None), (1.0, None, None, None), (0.0, None, None, None)]
    assert (got["b", 2].tokens, got["a", 4].prediction_available) == (0.0, False)
    assert (got["a", 5].table, got["a", 5].heading, got["a", 5].heading_s) == (1.0, 0.0, 1.0)
    low = {(r.engine, r.doc_id): r for r in E.evaluate_corpus(*_frames(spark), ("a", "b"), 2).collect()}
    assert low["a", 1].table is None and low["a", 1].table_timed_out


def test_what_is_counted_of_a_pair_never_leaves_its_row(spark):
    """Neither tokens nor lines are rows of their own: what is shuffled are the texts alone."""
    pairs = E.pair_all(*_frames(spark), ("a", "b"))
    for scores in (E.evaluate_corpus(*_frames(spark), ("a", "b")), E.reading_order_score(pairs), E.table_score(pairs), E.heading_score(pairs)):
        plan = scores._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Window" not in plan and plan.count("Generate") == 1
