from graphs import frame, labelled

from graphloom.operators import levels


def test_all_levels_are_found_in_one_table(spark, monkeypatch):
    made = []
    whole = levels.staged
    monkeypatch.setattr(levels, "staged", lambda df, tag: made.append(tag) or whole(df, tag))
    parts = levels.hierarchy(frame(spark, labelled()), "affinity")
    assert max(len(r.path) for r in parts.collect()) > 0 and made == ["parts"]
    top = {tuple(r) for r in levels.hierarchy(frame(spark, labelled()), "affinity", depth=1).where("size(path) = 0").selectExpr("graph_id", "string(communities)").collect()}
    assert top == {tuple(r) for r in parts.where("size(path) = 0").selectExpr("graph_id", "string(communities)").collect()}
