"""Porter2 on words whose stems are published."""

import pyarrow as pa

from lodestar.functions import stemming
from lodestar.functions.stemming import stem

PUBLISHED = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist",
    "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consoles": "consol", "consolidate": "consolid", "consolidated": "consolid", "consolidating": "consolid",
    "knack": "knack", "knackeries": "knackeri", "knacks": "knack", "knave": "knave", "knaves": "knave", "knavish": "knavish", "kneaded": "knead", "kneading": "knead", "knee": "knee", "kneeling": "kneel", "knees": "knee", "knell": "knell",
    "knightly": "knight", "knitting": "knit", "knives": "knive", "knocked": "knock", "knot": "knot", "knotted": "knot", "generate": "generat", "generically": "generic", "hopping": "hop", "hoping": "hope", "sky": "sky", "skies": "sky",
    "relational": "relat", "happy": "happi", "say": "say", "cries": "cri", "ties": "tie", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "agreed": "agre", "approval": "approv", "approved": "approv", "approve": "approv", "dying": "die", "news": "news", "exceed": "exceed", "authentication": "authent",
}


def test_published_stems():
    assert {w: stem(w) for w in PUBLISHED} == PUBLISHED


def test_stemmed_search(spark):
    from lodestar.functions.stemming import stemmed
    from lodestar.operators import search

    passages = spark.createDataFrame([(1, None, "Approving a requestToken for orders"), (2, "Payroll", "nothing else")], "chunk long, heading string, text string")
    questions = spark.createDataFrame([(1, "approve the order request unicorns"), (2, "the and")], "question int, text string")
    got = [(r.question, r.chunk, r.score) for r in search.keyword_hits(passages, questions, lexed=stemmed).collect()]
    assert got == [(1, 1, 0.75)]


def test_stems_are_made_a_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(stemming, "TEXTS_AT_ONCE", 2)
    most = []
    monkeypatch.setattr(stemming, "_tokens_at_once", lambda t, f=stemming._tokens_at_once: most.append(len(t)) or f(t))
    assert stemming._stems.func(pa.array(["Running the dogs", None, "", "cats", "x1"])).to_pylist() == [["run", "dog"], [], [], ["cat"], ["x1"]]
    assert most == [2, 2, 1] and stemming._stems.func(pa.array([], pa.string())).to_pylist() == []
