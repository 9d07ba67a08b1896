"""Negatives are drawn in parts, and again only for slots whose draw was not allowed; edges carry what is asked for."""

from chronoflow.operators import sampling
from chronoflow.plans import catalogue, views

SF = "/root/testdata/sf0.001"


def test_clocks_of_days_are_dealt(spark, monkeypatch):
    e, seen, ask = catalogue.edges(spark, SF, "party"), [], sampling.from_pool
    monkeypatch.setattr(sampling, "from_pool", lambda clocks, *rest: seen.append(clocks) or ask(clocks, *rest))
    sampling.day_negatives(e, "inductive", 1, catalogue.n_nodes(e))
    parts = sampling.dealt(seen[0].where("hi > lo AND need > 0"), "clock")
    assert "REPARTITION_BY_NUM" in parts._jdf.queryExecution().executedPlan().toString()


def test_slots_are_drawn_again_only_if_they_failed(spark, monkeypatch):
    e, drawn, ask = catalogue.edges(spark, SF, "party"), [], sampling._attempts

    def counted(rows, *how):
        out = ask(rows, *how)
        drawn.append(out.count())
        return out

    monkeypatch.setattr(sampling, "_attempts", counted)
    n, nodes = e.count(), catalogue.n_nodes(e)
    assert sampling.uniform_targets(e, nodes, 1).count() == n and sum(drawn) < 2 * n
    drawn.clear()
    assert sampling.mixture(e, nodes, 1).count() == n and sum(drawn) < 3 * n


def test_edges_carry_amounts_only_when_asked(spark):
    bare, full = views.edges(spark, SF, "nation"), views.edges(spark, SF, "nation", amounts=True)
    assert "usd_sum" in full.columns and not {"usd_sum", "txn", "amt_0"} & set(bare.columns)
    assert sorted(bare.collect()) == sorted(full.select(*bare.columns).collect())
