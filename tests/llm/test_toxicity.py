import itertools

import numpy as np
import pytest

from graphloom.llm import queries, toxicity

SF = "/root/testdata/sf0.1"
CLEAN = "the weather is fine and we walk along the river with a good friend while others read a long book about old towns and small hills".split()


def model(words):
    counts = {}
    for w in words:
        p = f"^^{''.join(map(toxicity.symbol, w))}$"
        for i in range(len(p) - 2):
            counts[p[i : i + 3]] = counts.get(p[i : i + 3], 0) + 1
    total = {}
    for g, n in counts.items():
        total[g[:2]] = total.get(g[:2], 0) + n
    return {g: float(np.log(n / (total[g[:2]] + 1))) for g, n in counts.items()}


LM = model(["idiot"] * 30 + ["stupid"] * 30 + ["loser"] * 20 + ["shit"] * 20 + ["ass"] * 20 + CLEAN * 10)


@pytest.mark.parametrize("span,word", [("1d10t", "idiot"), ("iiidiot", "idiot"), ("id!ot", "idiot"), ("iddiot", "idiot"), ("$tupid", "stupid"), ("shi+", "shit"), ("a$$", "ass"), ("s t u p i d", "stupid"), ("a l o s e r", "a loser"), ("stu-pid", "stupid"), ("stu pid", "stupid"), ("st*pid", "stupid"), ("stuupid", "stupid"), ("idiot!", "idiot"), ("\"idiot,", "idiot"), ("good-friend", "good friend")])
def test_restore(span, word):
    assert toxicity.restore(span, LM) == word


def paths(span):
    """Every path of the lattice, written out."""
    first, last = len(span) - len(span.lstrip(toxicity._MARKS + "!")), len(span.rstrip(toxicity._MARKS + "!"))
    choices = []
    for at, c in enumerate(span):
        own = [("say", c, 0.0)] if c.isalnum() else []
        own += [("say", x, toxicity.DISGUISE) for x in toxicity.LEET.get(c, "")]
        own += [("drop", "", toxicity.REPEAT)] if at and span[at - 1] == c else []
        if not c.isalnum():
            outside = at < first or at >= last
            own += [("drop", "", 0.0 if outside else toxicity.SPACE if c == " " else toxicity.MARK * (2 if c in "$+|@!" else 1))]
            own += [] if outside or c in toxicity.LEET else [("part", " ", 0.0)]
        choices.append(own)
    for way in itertools.product(*choices):
        text, cost, fine, state = "", 0.0, True, "^^"
        for kind, x, price in way:
            cost += price
            if kind == "say":
                s = toxicity.symbol(x)
                cost += LM.get(state + s, toxicity.FLOOR)
                state, text = state[1] + s, text + x
            elif kind == "part":
                fine = fine and state[1] != "^"
                cost += LM.get(state + "$", toxicity.FLOOR)
                state, text = "^^", text + " "
        if fine:
            yield cost + (0.0 if state[1] == "^" else LM.get(state + "$", toxicity.FLOOR)), text


@pytest.mark.parametrize("span", ["1d10t", "a$$!", "s t u", "st*p", "l00-ser", "+h3", "aa bb", "x", "-1-"])
def test_viterbi_finds_the_best_path(span):
    got = toxicity.restore(span, LM)
    best = max(paths(span))[0]
    assert max(s for s, t in paths(span) if t == got) == pytest.approx(best)


def planted(spark, say):
    rng = np.random.default_rng(1)
    docs, labels = [], []
    for i in range(600):
        w = rng.choice(CLEAN, 40).tolist()
        if i % 4 == 0:
            w[rng.integers(40)] = say(["idiot", "stupid", "loser"][i // 4 % 3], i)
        docs.append((i, " ".join(w), "x", 1))
        labels.append((i, int(i % 4 == 0)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_disguised_words_are_caught(spark):
    forms = {"idiot": ["idiot", "1d10t", "idiott!", "i d i o t", "id-iot", "Idiot,", "id iot"], "stupid": ["stupid", "$tupid", "stuupid", "s t u p i d", "st*pid", "stu pid"], "loser": ["loser", "l0ser", "looser", "l o s e r", "los3r", "lo ser"]}
    docs, labels = planted(spark, lambda w, i: forms[w][(i // 12) % len(forms[w])])
    got = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    wrong = [i for i, p in got.items() if p != (i % 4 == 0)]
    assert len(got) == 600 and len(wrong) <= 6, (wrong, [docs.where(f'doc_id = {i}').first().text for i in wrong])
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, p in got.items() if not p)


def test_odd_rows(spark):
    docs, labels = planted(spark, lambda w, i: w)
    odd = docs.unionByName(spark.createDataFrame([(None, "you idiot", "x", 0), (None, None, "x", 0), (1000, "", "x", 0), (1001, "walk " * 50_000, "x", 0), (1001, "walk", "x", 0)], docs.schema))
    got = [(r.doc_id, r.held_out, r.predicted) for r in toxicity.score_toxicity(odd, labels).collect()]
    assert len(got) == 605 and sorted(p for i, _, p in got if i is None) == [0, 1] and all(not h for i, h, _ in got if i is None)
    assert [p for i, _, p in got if i and i >= 1000] == [0, 0, 0]
    two = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    for few in (two, two.where("toxic = 1"), labels.limit(0)):
        assert all(r.predicted == 0 and 0 <= r.score < 0.3 for r in toxicity.score_toxicity(odd, few).collect())
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_held_out_table(spark):
    scored = queries.op7_toxicity(spark, SF).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in scored if r.held_out and r.doc_id in label]
    right, found = sum(p == y for p, y in held), sum(p for p, y in held if y)
    print("held out", len(held), "right", right, "toxic found", found, "of", sum(y for _, y in held))
    assert right >= 0.95 * len(held) and found >= 0.85 * sum(y for _, y in held)
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
