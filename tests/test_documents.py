"""Documents whose rows grow with the tables come in pieces, none of which is whole in a row."""

import json

from surfacegraph import catalogue_capture
from surfacegraph.sources import graph_json


def test_large_documents_are_made_in_pieces(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = catalogue_capture.documents(spark, sf)
    monkeypatch.setattr(catalogue_capture, "PIECE", 40)
    pieces = catalogue_capture.documents(spark, sf)
    sizes = [len(json.loads(r["text"]).get(k, [])) for r in pieces.collect() for k in ("axNodes", "visualNodes")]
    assert pieces.count() > whole.count() == 25 and max(sizes) <= 40
    a, b = graph_json.from_documents(whole), graph_json.from_documents(pieces)
    for name in ("pages", "ax", "edges", "auth", "tokens", "diagnostics", "meta"):
        one, other = (sorted(map(str, getattr(c, name).drop("seq").collect())) for c in (a, b))
        assert one and one == other
    looks = [sorted(map(str, c.visual.select("id", "ax_id", "rect", "z_index", "tethers").collect())) for c in (a, b)]
    assert looks[0] and looks[0] == looks[1]  # tethers are found in the other pieces too
    order = [[r["id"] for r in c.ax.orderBy("seq").collect()] for c in (a, b)]
    assert order[0] == order[1]
